"""Operators over many rows: repeats, sections, budgets, calls and their results, retention, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_tokens, truncate_chars


#: Sequence numbers of one part of a group when occurrences are counted; bounds what one task sorts.
PART = 1 << 20


def occurrences(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds `occurrence`: the how-maniest row of its keys each is by the whole number `order`, ties in any
    order. A group is counted by parts of PART numbers, so that a hot one isn't sorted in one task."""
    cut = rows.withColumn("__part", F.floor(F.col(order) / PART))
    counts = cut.groupBy(*keys, "__part").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__c")
    ranked = cut.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(order)))
    out = ranked.join(counts, [*keys, "__part"])
    return out.withColumn("occurrence", F.col("__rank") + F.col("__before")).drop("__part", "__rank", "__before")


def repeats(outputs: DataFrame, session: str, seq: str, key: str, ids: list[str]) -> DataFrame:
    """(ids, occurrence) of outputs whose key came before in their session; `ids` tell outputs apart. Keys
    and numbers are shuffled, no texts, and what gives the key is evaluated once: no filter asks for it, as
    that would be evaluated below, with all that gives the key written out in it. An output without a key
    stands alone under its ids instead."""
    own = F.coalesce(F.col(key), F.concat(F.lit("no key "), F.concat_ws(" ", *[F.col(i).cast("string") for i in ids])))
    narrow = outputs.select(F.col(session).alias("__s"), own.alias("__k"), F.col(seq).alias("__q"), *ids)
    rank = F.when(~F.col("__k").startswith("no key "), F.row_number().over(Window.partitionBy("__s", "__k").orderBy("__q", *ids)))
    return narrow.withColumn("occurrence", rank).where("occurrence > 1").select(*ids, "occurrence")


def repeated_outputs(outputs: DataFrame, session: str, seq: str, text: str) -> DataFrame:
    """Adds `occurrence`, and `shown`: a marker for every output of a session that came before. `seq` numbers
    a session's outputs. Raw ids number the markers of a session in order. Windows carry hashes and numbers;
    texts only join once."""
    found = repeats(outputs.withColumn("__h", F.sha2(text, 256)), session, seq, "__h", [session, seq])
    found = occurrences(found.withColumnRenamed("occurrence", "__o"), [session], seq).withColumnsRenamed({"occurrence": "raw_output_id", "__o": "occurrence"})
    out = outputs.join(found, [session, seq], "left")
    marker = F.concat(F.lit("[repeated output, occurrence "), F.col("occurrence").cast("string"), F.lit(", raw_output_id="), F.col("raw_output_id").cast("string"), F.lit("]"))
    out = out.withColumn("shown", F.when(F.col("occurrence") > 1, marker).otherwise(F.col(text)))
    return out.withColumn("occurrence", F.coalesce("occurrence", F.lit(1)))


def sections(messages: DataFrame, payload: str, idx: str, role: str, keep_tail: int) -> DataFrame:
    """Adds `section` and `guarded`. The leading system rows are the prefix, the last `keep_tail` other rows
    the tail, the rest the middle; the tail is guarded where there is a middle. A payload is what one request
    holds, so its windows are small."""
    other = F.when(F.col(role) == "system", 0).otherwise(1)
    upto = Window.partitionBy(payload).orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(payload)
    out = messages.withColumn("__in", F.max(other).over(upto))
    out = out.withColumns({"__rank": F.sum("__in").over(upto), "__n": F.sum("__in").over(whole)})
    section = F.when(F.col("__in") == 0, "prefix").when(F.col("__rank") > F.col("__n") - keep_tail, "tail").otherwise("middle")
    out = out.withColumn("section", section)
    return out.withColumn("guarded", (F.col("section") == "tail") & (F.col("__n") > keep_tail)).drop("__in", "__rank", "__n")


def keep_newest(messages: DataFrame, payload: str, idx: str, role: str, content: str, keep_tail: int, least: int = 200) -> DataFrame:
    """Replaces tool contents that a later row of the payload repeats, before the guarded tail; adds `superseded`."""
    out = messages if "guarded" in messages.columns else sections(messages, payload, idx, role, keep_tail)
    out = out.withColumn("__h", F.when((F.col(role) == "tool") & (F.length(content) >= least), F.sha2(content, 256)))
    out = out.withColumn("__last", F.max(idx).over(Window.partitionBy(payload, "__h")))
    old = F.col("__h").isNotNull() & (F.col(idx) < F.col("__last")) & ~F.col("guarded")
    marker = F.concat(F.lit("[superseded by identical re-read below — "), F.format_number(F.length(content), 0), F.lit(" chars omitted]"))
    out = out.withColumn("superseded", F.coalesce(old, F.lit(False)))
    return out.withColumn(content, F.when(F.col("superseded"), marker).otherwise(F.col(content))).select(*messages.columns, "superseded")


def shrink_results(messages: DataFrame, role: str, content: str, budget: int) -> DataFrame:
    """Tool contents within a character budget; adds `saved`."""
    long = (F.col(role) == "tool") & (F.length(content) > budget)
    out = messages.withColumn("__new", F.when(long, truncate_chars(F.col(content), budget)).otherwise(F.col(content)))
    return out.withColumn("saved", F.coalesce(F.greatest(F.length(content) - F.length("__new"), F.lit(0)), F.lit(0))).withColumn(content, F.col("__new")).drop("__new")


def message_tokens(content: Column, calls: Column | None = None) -> Column:
    """Tokens of a message: a fixed share, its content and its calls."""
    own = F.lit(15) + F.coalesce(count_tokens(content), F.lit(0))
    return own + (F.coalesce(count_tokens(calls), F.lit(0)) if calls is not None else F.lit(0))


def completed_calls(calls: DataFrame, results: DataFrame, keys: list[str], completed: bool = True) -> DataFrame:
    """Calls that have a result, or those that have none."""
    return calls.join(results.select(*keys), keys, "left_semi" if completed else "left_anti")


def named_results(results: DataFrame, calls: DataFrame, key: list[str], name: str, order: str) -> DataFrame:
    """Results with the name of the latest call of their id; unknown where there is none."""
    latest = calls.groupBy(*key).agg(F.max_by(name, order).alias("__name"))
    return results.join(latest, key, "left").withColumn(name, F.coalesce("__name", F.lit("unknown"))).drop("__name")


def newest(rows: DataFrame, keys: list[str], order: str, keep: int) -> DataFrame:
    """The last rows of each key: retention of raw outputs and telemetry."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("__r") <= keep).drop("__r")


def even_sample(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Rows of each key at the whole part of every n/most-th place, so that `most` stay, spread evenly; all
    of a key with fewer. In whole numbers: place i is taken if some k < most has floor(k*n/most) = i."""
    out = rows.join(rows.groupBy(*keys).agg(F.count("*").alias("__n")), keys)
    out = occurrences(out, keys, order).withColumn("__i", F.col("occurrence").cast("long") - 1).drop("occurrence")
    out = out.withColumn("__k", F.expr(f"(__i * {most} + __n - 1) div __n"))  # the least k whose place isn't before i
    taken = (F.col("__k") < most) & (F.expr(f"(__k * __n) div {most}") == F.col("__i"))
    return out.where((F.col("__n") <= most) | taken).drop("__i", "__n", "__k")


def every_nth(rows: DataFrame, order: str, most: int) -> DataFrame:
    """Every (n div most)-th row in order, `most` of them at most."""
    n = rows.count()
    if n <= most:
        return rows
    step = n // most
    ranked = rows.withColumn("__i", F.row_number().over(Window.orderBy(order)) - 1)
    return ranked.where((F.col("__i") % step == 0) & (F.col("__i") < step * most)).drop("__i")


def snapshots(messages: DataFrame, payload: str, idx: str, role: str, content: str, least: int, last: int | None = None) -> DataFrame:
    """(payload, idx, chars) of every tool row whose prefix has at least `least` characters; with `last`, of
    the last so many tool rows of a payload where none has."""
    upto = Window.partitionBy(payload).orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    narrow = messages.select(payload, idx, role, F.coalesce(F.length(content), F.lit(0)).alias("__c"))
    tools = narrow.withColumn("chars", F.sum("__c").over(upto)).where(F.col(role) == "tool").select(payload, idx, "chars")
    large = tools.where(F.col("chars") >= least)
    if last is None:
        return large
    return large.unionByName(newest(tools.join(large.select(payload), payload, "left_anti"), [payload], idx, last))


def expanded(messages: DataFrame, chosen: DataFrame, payload: str, idx: str) -> DataFrame:
    """The messages of each chosen snapshot (payload, idx): all up to its row; adds `snapshot`, its idx."""
    ends = chosen.select(payload, F.col(idx).alias("snapshot"))
    return messages.join(ends, payload).where(F.col(idx) <= F.col("snapshot"))


#: Characters kept of a stored output, outputs kept of a session.
STORED_CHARS, STORED = 256_000, 200


def stored(outputs: DataFrame, session: str, seq: str, raw: str, keep: int = STORED) -> DataFrame:
    """The raw store of each session: outputs numbered from 1 in order, the newest kept, texts capped."""
    ids = Window.partitionBy(session).orderBy(seq)
    narrow = outputs.select(session, seq).withColumn("raw_id", F.row_number().over(ids))
    kept = newest(narrow, [session], "raw_id", keep)
    return outputs.join(kept, [session, seq]).withColumn(raw, F.substring(raw, 1, STORED_CHARS))


def stored_view(raw: Column, tail_lines: int, max_chars: int) -> Column:
    """The last lines of a stored text with a count of the others, cut to a length."""
    lines = F.split(raw, "\n", -1)
    n = F.size(lines)
    note = F.concat(F.lit("[... "), (n - tail_lines).cast("string"), F.lit(" earlier lines ...]\n"))
    last = F.array_join(F.slice(lines, F.greatest(F.lit(1), n - tail_lines + 1), F.lit(tail_lines)), "\n")
    return F.substring(F.when(n > tail_lines, F.concat(note, last)).otherwise(raw), 1, max_chars)
