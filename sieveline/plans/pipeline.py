"""The staged filter over tool outputs, and the payload strategies, as plans."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import boosted, enabled
from ..functions import classify
from ..functions import text as T
from ..operators import filters, structured, windows
from ..streaming.dedupe import count_repeats

_LEAST = 500


def _native(kind: Column, text: Column, cfg: dict, detailed: Column) -> Column:
    """struct(output, truncated) by category. Limits are columns, so that every filter stands in the plan
    once, and so does the generic one that the others fall back to."""
    more, noise = boosted(cfg), cfg["normalize_noise"]

    def lim(name: str) -> Column:
        return F.lit(cfg[name]) if cfg[name] == more[name] else F.when(detailed, more[name]).otherwise(cfg[name])

    own = F.when(kind == "git-log", filters.one_line_log(text, lim("git_log_head"), lim("git_log_tail")))
    if cfg["status_group"]:
        own = own.when(kind == "git-status", filters.grouped_status(text, cfg["git_status_group_max_per_line"]))
    own = own.when(kind == "logs", filters.logs(text, lim("log_head"), lim("log_tail"), cfg["log_max_consecutive_dupes"], noise))
    if cfg["build_summary"]:
        own = own.when(kind == "build", filters.build_summary(text, noise))
    own = own.when(kind == "git-diff", filters.diff_sections(text, lim("git_diff_file_head"), lim("git_diff_tail")))
    own = own.when(kind == "git-show", filters.commit_sections(text, lim("git_diff_file_head"), lim("git_diff_tail")))
    own = own.when(kind == "search", filters.matches_by_file(text, lim("search_max_matches_per_file"), lim("search_max_files"), cfg["heading_reformat"]))
    own = own.when(kind == "ls-tree", filters.listed_entries(text, lim("fs_max_entries"), cfg["table_whitespace"], cfg["lsl_abbreviate"]))
    # what the generic filter is given where the category's own has no answer
    clean = F.when(kind.isin("test", "build"), T.normalize_noise(text)).otherwise(text) if noise else text
    edges = {k: (lim(f"{k}_head"), lim(f"{k}_tail")) for k in ("test", "build", "lint", "typecheck")}
    edges |= {"search": (lim("search_head_lines"), lim("search_tail_lines")), "ls-tree": (lim("fs_head_lines"), lim("fs_tail_lines")), "git-show": (F.lit(filters.SHOW_HEAD), F.lit(filters.SHOW_TAIL))}
    default = (F.lit(filters.HEAD), F.lit(filters.TAIL))
    edges |= {k: default for k in ("git-log", "git-diff", "json", "read_file")}
    status = filters.is_status(text)
    head, tail = (F.when(kind == "git-status", F.when(status, lim(f"git_status_{e}")).otherwise(d)) for e, d in zip(("head", "tail"), default, strict=True))
    for k, (h, t) in edges.items():
        head, tail = head.when(kind == k, h), tail.when(kind == k, t)
    head, tail = head.otherwise(lim("generic_head")), tail.otherwise(lim("generic_tail"))
    own_limits = kind.isin(*edges, "git-status", "logs")
    frames = F.when(own_limits, filters.FRAMES).otherwise(cfg["generic_stack_collapse_min_frames"] if cfg["stack_collapse"] else F.lit(None).cast("int"))
    return F.coalesce(own, filters.generic(clean, head, tail, frames))


def _cleaned(df: DataFrame, cfg: dict, roots: tuple[str, ...], workspace: str, redact_max_chars: int | None) -> DataFrame:
    """Adds raw_chars, redactions, binary, preview and plain to rows with `text`."""
    clean, found = T.redact(F.col("text"), redact_max_chars) if cfg["redact"] else (F.col("text"), F.lit(0))
    df = df.withColumns({"raw_chars": F.length("text"), "__redacted": clean, "redactions": found})
    none = F.lit(None).cast("string")
    df = df.withColumns({"__binary": T.binary_message(F.col("__redacted")) if cfg["binary_detection"] else none, "__preview": T.oversized_preview(F.col("__redacted"), cfg["oversized_max_chars"]) if cfg["oversized_guard"] else none})
    plain = T.strip_ansi(F.col("__redacted"))
    plain = T.strip_thinking(plain) if cfg["strip_thinking"] else plain
    df = df.withColumn("__plain", plain)
    if cfg["normalize_paths"] and roots:
        df = df.withColumn("__plain", structured.normalize_paths(F.col("__plain"), roots, workspace))
    return df


def _staged(df: DataFrame, cfg: dict) -> DataFrame:
    """Adds stage, category, shown, truncated, failed to cleaned rows with occurrence."""
    failed = F.coalesce("timed_out", F.lit(False)) | (F.coalesce("exit_code", F.lit(0)) != 0)
    stage = F.when(F.col("__binary").isNotNull(), "binary").when(F.col("__preview").isNotNull(), "oversized").when(F.col("occurrence") > 1, "dedupe").when(failed, "error").when(F.length("__plain") < _LEAST, "small").otherwise("filter")
    df = df.withColumns({"stage": stage, "category": classify.category(F.col("command"), F.col("tool"), F.col("__plain"))})
    active = (F.col("stage") == "filter") & ~F.col("category").isin("passthrough", "shell")
    detailed = classify.is_verbose(F.coalesce("command", F.lit("")))
    todo, masked = F.when(active, F.col("category")), F.when(active, F.col("__plain"))
    df = df.withColumn("__s", structured.filtered(todo, masked, cfg, detailed))
    native = F.when(active & F.col("__s.output").isNull(), _native(F.col("category"), F.col("__plain"), cfg, detailed))
    df = df.withColumn("__n", native)
    out, cut = F.coalesce("__s.output", "__n.output"), F.coalesce("__s.truncated", "__n.truncated", F.lit(False))
    ids, plain = F.col("output_id").cast("string"), F.col("__plain")
    repeat = F.concat(F.lit("[repeated output, occurrence "), F.col("occurrence").cast("string"), F.lit(", raw_output_id="), ids, F.lit("]"))
    mark = F.concat(F.lit("\n[filtered "), F.length(plain).cast("string"), F.lit(" chars -> "), F.length(out).cast("string"), F.lit(" chars, raw_output_id="), ids, F.lit("]"))
    shown = F.when(F.col("stage") == "binary", F.col("__binary")).when(F.col("stage") == "oversized", F.col("__preview")).when(F.col("stage") == "dedupe", repeat).when(out.isNull(), plain).when(cut, F.concat(out, mark)).otherwise(out)
    df = df.withColumns({"shown": shown, "truncated": cut | F.col("stage").isin("binary", "oversized", "dedupe"), "failed": F.coalesce("__s.failed", F.lit(False))})
    return df.withColumn("filtered_chars", F.length("shown"))


_ADDED = ("stage", "category", "redactions", "occurrence", "shown", "raw_chars", "filtered_chars", "truncated", "failed")


def filter_outputs(outputs: DataFrame, cfg: dict, roots: tuple[str, ...] = (), workspace: str = "", redact_max_chars: int | None = None, kept: int | None = None, on: bool | None = None) -> DataFrame:
    """outputs(output_id, session_id, seq, command, tool, exit_code, timed_out, text) with `shown`, `stage`,
    `category`, raw_chars, filtered_chars, truncated. Repeats within a session are found over hashes and join
    their outputs by id; all else is row by row. `kept`: a session knows its last so many different texts
    only, and one that was forgotten starts over. With the master switch off (`on`, by default from the
    environment) texts are shown as they are."""
    if not (enabled() if on is None else on):
        n = F.length("text")
        return outputs.withColumns({"stage": F.lit("off"), "category": F.lit("passthrough"), "redactions": F.lit(0), "occurrence": F.lit(1), "shown": F.col("text"), "raw_chars": n, "filtered_chars": n, "truncated": F.lit(False), "failed": F.lit(False)})
    df = _cleaned(outputs, cfg, roots, workspace, redact_max_chars)
    df = df.withColumn("__key", F.when(F.col("__binary").isNull() & F.col("__preview").isNull(), F.sha2("__plain", 256)))
    if kept is None:
        again = windows.repeats(df, "session_id", "seq", "__key", ["output_id"])
    else:
        narrow = df.where("__key is not null").select("session_id", F.col("seq").cast("long").alias("seq"), F.col("output_id").cast("long").alias("output_id"), F.col("__key").alias("text"))
        again = narrow.groupBy("session_id").applyInPandas(lambda pdf: count_repeats(pdf, {}, kept, ["output_id"])[["output_id", "occurrence"]], "output_id long, occurrence long").where("occurrence > 1")
    # texts join as they came, once, and are cleaned behind the join
    joined = outputs.join(again, "output_id", "left").withColumn("occurrence", F.coalesce(F.col("occurrence").cast("int"), F.lit(1)))
    return _staged(_cleaned(joined, cfg, roots, workspace, redact_max_chars), cfg).select(*outputs.columns, *_ADDED)


#: Tools whose results tell something and may be filtered; files' contents stay whole.
COMPRESSIBLE = (
    "search", "grep", "rg", "ripgrep", "search_content", "find", "fd", "locate", "web_fetch", "webfetch", "fetch", "web_search", "websearch",
    "list_directory", "listdir", "ls", "glob", "bash", "shell", "run_command", "execute",
)
#: Tools whose arguments hold a file's content.
WRITERS = ("write", "write_file", "create_file", "create", "str_replace_editor")
EDITORS = ("edit", "edit_file", "patch", "str_replace")
_OLD, _NEW = ("old_string", "old_str", "old"), ("new_string", "new_str", "new")


def is_compressible(tool: Column) -> Column:
    """One of the tools, or a name that ends in `_` and one of them, in any case."""
    return F.coalesce(F.lower(tool).rlike("(?:^|_)(?:" + "|".join(COMPRESSIBLE) + r")\z"), F.lit(False))


def _guarded(rewrite: Callable[..., str]) -> Callable[..., str]:
    """A rewriting of arguments that leaves what it can't handle as it is."""

    def run(raw: str, *more) -> str:
        try:
            return rewrite(raw, *more)
        except (ValueError, TypeError, AttributeError, RecursionError):
            return raw

    return run


@_guarded
def _compacted(raw: str, tool: str) -> str:
    args = json.loads(raw)
    if not isinstance(args, dict):
        return raw
    path = args.get("file_path") or args.get("path") or "file"
    keys = ("content",) if tool in WRITERS else _OLD + _NEW if tool in EDITORS else ()
    for key in keys:
        value = args.get(key)
        if isinstance(value, str) and len(value) > 500:
            n = value.count("\n") + 1
            review = f" -- use Read on {path} to review]"
            args[key] = f"[written, {n} lines, {len(value):,} chars{review}" if key == "content" else f"[{n} lines replaced]" if key in _OLD else f"[{n} lines{review}"
    out = json.dumps(args, ensure_ascii=False)
    return out if len(out) < len(raw) else raw


def compact_arguments(arguments: Column, tool: Column) -> Column:
    """Written contents in a call's arguments become a note of their size, if that is shorter."""

    @F.pandas_udf("string")
    def run(values: pd.Series, tools: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else _compacted(v, t) for v, t in zip(values, tools, strict=True)], dtype=object)

    return run(arguments, F.coalesce(F.lower(tool), F.lit("")))


def _no_strings(raw: str) -> str:
    try:
        args = json.loads(raw)
    except (ValueError, RecursionError):
        return raw if len(raw) <= 200 else f"{raw[:200]}…[shrunk: {len(raw)} chars, unparsed]"
    if not isinstance(args, dict):
        return raw
    note = lambda v: f"[…shrunk: {len(v)} chars, {v.count(chr(10)) + 1} lines — tool already responded, see result]"
    return json.dumps({k: note(v) if isinstance(v, str) and len(v) > 300 else v for k, v in args.items()})


def shrink_arguments(arguments: Column) -> Column:
    """Long top-level strings in call arguments become a note; invalid JSON keeps its first characters."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else _no_strings(v))

    return run(arguments)


def _rewritten(messages: DataFrame, keys: list[str], calls: DataFrame, old: Column, new: Column, *sums: Column) -> DataFrame:
    """Messages whose tool calls have new arguments: calls(keys, place) are rewritten from `old` to `new`,
    and `sums` over a message's rewritten calls are added. Only calls to rewrite are exploded and joined."""
    changed = calls.withColumn("__new", new).where(F.col("__new") != old)
    put = changed.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "__new"))).alias("__put"), *sums)
    call = lambda c, k: F.when(F.map_contains_key("__put", k), c.withField("function", c["function"].withField("arguments", F.element_at("__put", k)))).otherwise(c)
    out = messages.join(put, keys, "left")
    return out.withColumn("tool_calls", F.when(F.col("__put").isNotNull(), F.transform("tool_calls", call)).otherwise(F.col("tool_calls"))).drop("__put")


def _calls(messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, id, tool, arguments of the assistants' calls."""
    calls = messages.where("role = 'assistant'").select(*keys, F.posexplode("tool_calls").alias("place", "c"))
    return calls.select(*keys, "place", F.col("c.id").alias("id"), F.col("c.function.name").alias("tool"), F.col("c.function.arguments").alias("arguments"))


def shrink_calls(messages: DataFrame, max_tokens: int) -> DataFrame:
    """messages(payload_id, idx, role, tool_calls): arguments over a token budget lose their long strings, if
    that saves tokens; adds calls_healed, calls_tokens_saved, calls_chars_saved."""
    keys, args = ["payload_id", "idx"], F.col("arguments")
    calls = _calls(messages, keys).where((F.length(args) > max_tokens) & (T.count_tokens(args) > max_tokens))
    new = shrink_arguments(args)
    calls = calls.withColumn("__shrunk", new)
    better = F.when(T.count_tokens(F.col("__shrunk")) < T.count_tokens(args), F.col("__shrunk")).otherwise(args)
    sums = (F.count("*").alias("calls_healed"), F.sum(T.count_tokens(args) - T.count_tokens(F.col("__new"))).alias("calls_tokens_saved"), F.sum(F.length(args) - F.length("__new")).alias("calls_chars_saved"))
    out = _rewritten(messages, keys, calls, args, better, *sums)
    return out.fillna(0, subset=["calls_healed", "calls_tokens_saved", "calls_chars_saved"])


STEPS = ("compact", "filter", "dedup", "shrink")


def compress_payloads(messages: DataFrame, cfg: dict, keep_tail: int = 10, max_tokens: int = 2000, tail_tokens: int = 2000, compact: bool = True, filter_middle: bool = False, dedup: bool = False, shrink: bool = False) -> tuple[DataFrame, DataFrame]:
    """messages(payload_id, idx, role, content, tool_calls, tool_call_id, name): first the arguments of
    completed writes, then tool results of the middle by their filters and of the tail by length, then
    repeats before the tail, then what is still too long before it. Returns the messages, and for each
    payload the characters that every step saved, the steps that saved some, and why none was taken."""
    keys, size = ["payload_id", "idx"], lambda c: F.coalesce(F.length(c), F.lit(0))
    own = F.col("role") == "tool"
    df = messages.withColumns({s: F.lit(0).cast("long") for s in STEPS})
    if compact:
        done = messages.where(own & F.col("tool_call_id").isNotNull()).select("payload_id", F.col("tool_call_id").alias("id")).distinct()
        calls = windows.completed_calls(_calls(messages, keys).where(F.length("arguments") >= _LEAST), done, ["payload_id", "id"])
        saved = F.sum(F.length("arguments") - F.length("__new")).alias("__saved")
        df = _rewritten(df, keys, calls, F.col("arguments"), compact_arguments(F.col("arguments"), F.col("tool")), saved)
        df = df.withColumn("compact", F.coalesce("__saved", F.lit(0))).drop("__saved")
    if filter_middle or dedup or shrink:
        df = windows.sections(df, "payload_id", "idx", "role", keep_tail)
    if filter_middle:
        may = own & (F.col("section") == "middle") & is_compressible(F.col("name")) & (F.length("content") >= _LEAST)
        row = {"text": F.when(may, F.col("content")), "command": F.lit(""), "tool": F.lower("name"), "exit_code": F.lit(None).cast("int"), "timed_out": F.lit(False), "output_id": F.col("idx"), "occurrence": F.lit(1)}
        before = df.columns
        done = _staged(_cleaned(df.select(F.struct(*before).alias("__row"), *[c.alias(n) for n, c in row.items()]), cfg, (), "", None), cfg)
        shorter = F.coalesce(F.col("truncated") & (F.col("filtered_chars") < F.length("text")), F.lit(False))
        df = done.select(*[F.when(shorter, F.col("shown")).otherwise(F.col("__row.content")).alias("content") if c == "content" else F.col(f"__row.{c}") for c in before], F.when(shorter, F.length("text") - F.col("filtered_chars")).otherwise(0).cast("long").alias("__saved"))
        long = own & (F.col("section") == "tail") & (F.length("content") > 4 * tail_tokens)
        df = df.withColumn("__new", F.when(long, T.truncate_chars(F.col("content"), 4 * tail_tokens)).otherwise(F.col("content")))
        df = df.withColumn("filter", F.col("__saved") + size("content") - size("__new")).withColumn("content", F.col("__new")).drop("__new", "__saved")
    if dedup:
        df = df.withColumn("__before", size("content"))
        df = windows.keep_newest(df, "payload_id", "idx", "role", "content", keep_tail).withColumn("dedup", (F.col("__before") - size("content")).cast("long")).drop("__before", "superseded")
    if shrink:
        long = own & ~F.col("guarded") & (F.length("content") > 4 * max_tokens)
        df = df.withColumn("__new", F.when(long, T.truncate_chars(F.col("content"), 4 * max_tokens)).otherwise(F.col("content")))
        df = df.withColumn("shrink", (size("content") - size("__new")).cast("long")).withColumn("content", F.col("__new")).drop("__new")
    stats = df.groupBy("payload_id").agg(*[F.sum(s).alias(s) for s in STEPS])
    more = F.lit(filter_middle or dedup or shrink)
    why = F.when(~more & ((F.col("compact") == 0) | F.lit(not compact)), "no_strategies_enabled")
    stats = stats.withColumns({"total": sum((F.col(s) for s in STEPS[1:]), F.col(STEPS[0])), "strategies": F.array_compact(F.array(*[F.when(F.col(s) > 0, s) for s in STEPS])), "skipped_reason": why})
    return df.select(*messages.columns), stats


def strategy_sweep(messages: DataFrame, cfg: dict, **how) -> DataFrame:
    """label, chars (of tool results), saved and savings_pct of every set of the strategies, best first."""
    sets = {"A": ("shrink",), "B": ("dedup",), "C": ("filter_middle",), "A+B": ("shrink", "dedup"), "A+C": ("shrink", "filter_middle"), "B+C": ("dedup", "filter_middle"), "A+B+C": ("shrink", "dedup", "filter_middle")}
    whole = messages.agg(F.sum(F.when(F.col("role") == "tool", F.length("content"))).alias("chars"))
    rows = None
    for label, names in sets.items():
        stats = compress_payloads(messages, cfg, compact=False, **{n: True for n in names}, **how)[1]
        own = stats.agg(F.sum("total").alias("saved")).select(F.lit(label).alias("label"), "saved")
        rows = own if rows is None else rows.unionByName(own)
    out = rows.join(F.broadcast(whole))  # one row
    return out.select("label", "chars", "saved", F.round(F.col("saved") * 100.0 / F.greatest(F.col("chars"), F.lit(1)), 1).alias("savings_pct")).orderBy(F.desc("saved"), "label")
