"""Repeats in a live stream of outputs: per session the last `KEPT` different texts are known."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT = 500
_OUT = "session_id string, seq long, occurrence int, shown string"
_STATE = "hashes array<string>, counts array<int>"


def count_repeats(rows: pd.DataFrame, seen: dict[str, int], kept: int | None = None, ties: list[str] | None = None) -> pd.DataFrame:
    """Occurrences in order of seq; `seen` is carried on. A repeat doesn't refresh its place, a text that
    was forgotten starts over. A null text is shown as null and never repeats."""
    kept = KEPT if kept is None else kept
    rows = rows.sort_values(["seq", *(ties or [])], kind="stable")
    out, counts = rows.drop(columns="text"), []
    for text in rows["text"]:
        if text is None:
            counts.append(1)
            continue
        key = hashlib.sha256(text.encode()).hexdigest()
        counts.append(seen.get(key, 0) + 1)
        seen[key] = counts[-1]
        if len(seen) > kept:
            del seen[next(iter(seen))]
    out["occurrence"] = counts
    out["shown"] = [t if n == 1 else f"[repeated output, occurrence {n}]" for t, n in zip(rows["text"], counts, strict=True)]
    return out


def batch(outputs: DataFrame) -> DataFrame:
    """The same over a table: only hashes are gathered by session, and texts join their occurrences."""
    narrow = outputs.select("session_id", "seq", F.sha2("text", 256).alias("text"))
    found = narrow.groupBy("session_id").applyInPandas(lambda pdf: count_repeats(pdf, {})[["session_id", "seq", "occurrence"]], "session_id string, seq long, occurrence int")
    note = F.concat(F.lit("[repeated output, occurrence "), F.col("occurrence").cast("string"), F.lit("]"))
    return outputs.select("session_id", "seq", "text").join(found, ["session_id", "seq"]).select("session_id", "seq", "occurrence", F.when(F.col("occurrence") > 1, note).otherwise(F.col("text")).alias("shown"))


def stream(outputs: DataFrame) -> DataFrame:
    """outputs(session_id, seq, text) of a stream; state survives restarts with the query's checkpoint."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = dict(zip(*state.get, strict=True)) if state.exists else {}
        yield count_repeats(pd.concat(list(batches)), seen)[["session_id", "seq", "occurrence", "shown"]]
        state.update((list(seen), list(seen.values())))

    return outputs.select("session_id", "seq", "text").groupBy("session_id").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")


def numbered(outputs: DataFrame) -> DataFrame:
    """(session_id, seq, raw_id) of a stream of outputs(session_id, seq): ids from 1 by session in order of
    arrival, by seq within a micro-batch; they go on after a restart."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        rows["raw_id"] = range(last + 1, last + 1 + len(rows))
        yield rows[["session_id", "seq", "raw_id"]]
        state.update((last + len(rows),))

    return outputs.select("session_id", "seq").groupBy("session_id").applyInPandasWithState(step, "session_id string, seq long, raw_id long", "last long", "append", "NoTimeout")


def live_savings(telemetry: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Savings by window of time and kind; rows later than the watermark are left out."""
    return telemetry.withWatermark("ts", late).groupBy(F.window("ts", width), "filter_kind").agg(F.count("*").alias("n"), F.sum("raw_chars").alias("raw_chars"), F.sum("filtered_chars").alias("filtered_chars"))
