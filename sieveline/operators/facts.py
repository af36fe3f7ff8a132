"""Facts that tool calls' results state, and the register of what extracts them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import limits
from ..functions import classify
from ..functions import lines as L
from ..functions.text import strip_ansi
from . import structured

#: What is found in a test's output, the words around it, and its type.
TEST = ((r"(\d+) passed", "test: ", " passed", "tool_result"), (r"(\d+) failed", "test: ", " failed", "error"), (r"(\d+) warning", "test: ", " warnings", "tool_result"), (r"(?U)FAILED\s+([\w/.:]+)", "FAILED: ", "", "error"))
#: Paths of a status and of a diff, commits of a log, errors.
STATUS_PATH = r"(?mU)^\s+(?:modified|new file|deleted):\s+(.+)"
DIFF_PATH = r"(?mU)^(?:\+\+\+|---)\s+(?:a/|b/)(.+)"
COMMIT = r"(?m)^([0-9a-f]{7,} .+)"
ERROR = r"(?U)(?:error|Error|ERROR):?\s+(.{0,120})"
_FACTS = "array<struct<content:string,fact_type:string,confidence:double>>"
RESULT = f"struct<facts:{_FACTS},files_touched:array<string>>"


def _found(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), L.stripped)


def _stated(found: Column, before: Column | str, after: str, kind: str, confidence: float) -> Column:
    before = F.lit(before) if isinstance(before, str) else before
    return F.transform(found, lambda m: F.struct(F.concat(F.lit("[Bash] "), before, m, F.lit(after)).alias("content"), F.lit(kind).alias("fact_type"), F.lit(confidence).alias("confidence")))


def bash_facts(args: Column, result: Column, turn: Column) -> Column:
    """struct(facts, files_touched) of a command's result, by the command's category; one plain fact where
    nothing is found."""
    command, nothing = F.coalesce(args["command"], F.lit("")), F.array().cast("array<string>")

    def use(row: Column) -> Column:
        text, kind = row["text"], row["kind"]
        paths = F.when(kind == "git-status", _found(text, STATUS_PATH)).when(kind == "git-diff", _found(text, DIFF_PATH)).otherwise(nothing)
        tests = F.concat(*[_stated(_found(text, pattern), before, after, kind_, 1.0) for pattern, before, after, kind_ in TEST])
        own = lambda p: F.when(kind == "test", tests).when(kind == "git-status", _stated(p, "git status: ", "", "tool_result", 1.0)).when(kind == "git-diff", _stated(p, "git diff file: ", "", "tool_result", 1.0)).when(kind == "git-log", _stated(_found(text, COMMIT), "git log: ", "", "tool_result", 1.0)).when(kind.isin("build", "lint", "typecheck"), _stated(_found(text, ERROR), F.concat(kind, F.lit(" error: ")), "", "error", 0.9))
        low = F.lower(text)
        note = F.when(low.contains("error") | low.contains("fail"), " (errors detected)").otherwise("")
        plain = F.array(F.struct(F.concat(F.lit("[Bash] "), F.substring(command, 1, 100), note).alias("content"), F.lit("tool_result").alias("fact_type"), F.lit(0.6).alias("confidence")))
        shaped = lambda p: L.let(own(p), lambda f: F.struct(F.when(F.size(f) > 0, f).otherwise(plain).alias("facts"), p.alias("files_touched")))
        return L.let(paths, shaped)

    text = strip_ansi(F.coalesce(result, F.lit("")))
    return L.let(F.struct(text.alias("text"), classify.command_category(command).alias("kind")), use)


#: Names under which a path is given, and what the filter's notes say about a file.
PATHS = ("file_path", "path", "filePath", "filename", "target_file")
NOTES = ((("import lines omitted",), "import-heavy"), (("generated lines omitted", "minified lines omitted"), "generated file, collapsed"), (("CSS body lines omitted",), "stylesheet"), (("comment lines omitted",), "comment-heavy"))


def read_facts(args: Column, result: Column, turn: Column) -> Column:
    """struct(facts, files_touched) of a file that was read: its path, and what the source filter's notes
    tell of it."""
    text = F.coalesce(result, F.lit(""))
    given = F.coalesce(*[F.nullif(args[n], F.lit("")) for n in PATHS])
    path = F.coalesce(given, F.nullif(L.stripped(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", 2)[0]), F.lit("")), F.lit("unknown"))
    shown = structured.filtered(F.when(~L.is_blank(text), "read_file"), text, limits("balanced", {}))["output"]

    def said(row: Column) -> Column:
        notes = F.array_compact(F.array(*[F.when(_any(row["shown"], marks), name) for marks, name in NOTES]))
        tail = lambda n: F.when(F.size(n) > 0, F.concat(F.lit(" ("), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("string"), F.lit(" lines) — "), F.array_join(n, ", "))).otherwise("")
        content = L.let(notes, lambda n: F.concat(F.lit("[Read] "), row["path"], F.lit(" read at turn "), turn.cast("string"), tail(n)))
        fact = F.struct(content.alias("content"), F.lit("file_state").alias("fact_type"), F.lit(1.0).alias("confidence"))
        return F.struct(F.array(fact).alias("facts"), F.when(row["path"] != "unknown", F.array(row["path"])).otherwise(F.array().cast("array<string>")).alias("files_touched"))

    return L.let(F.struct(path.alias("path"), F.coalesce(shown, F.lit("")).alias("shown")), said)


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = text.contains(marks[0])
    for m in marks[1:]:
        out = out | text.contains(m)
    return out


@dataclass(frozen=True)
class Extractor:
    """What reads facts from the results of some tools: (args, result, turn) as columns to RESULT."""

    source: str
    tools: tuple[str, ...]
    extract: Callable[[Column, Column, Column], Column]
    may_use_llm: bool = False


EXTRACTORS = (Extractor("Bash", ("Bash", "run_command"), bash_facts), Extractor("Read", ("Read",), read_facts))


def extracted(calls: DataFrame, extractors: tuple[Extractor, ...] = EXTRACTORS) -> DataFrame:
    """calls(tool_call_id, tool_name, args map<string,string>, result, turn) with `source_tool`, `facts` and
    `files_touched`; calls of other tools are left out. Further extractors are given in the tuple."""
    own, names = None, [n for e in extractors for n in e.tools]
    source = F.lit(None).cast("string")
    for e in extractors:
        mine = F.col("tool_name").isin(*e.tools)
        got = e.extract(F.when(mine, F.col("args")), F.when(mine, F.col("result")), F.col("turn")).cast(RESULT)
        own = F.when(mine, got) if own is None else own.when(mine, got)
        source = F.when(mine, e.source).otherwise(source)
    out = calls.where(F.col("tool_name").isin(*names)).withColumns({"source_tool": source, "__r": own})
    return out.select(*calls.columns, "source_tool", F.col("__r.facts").alias("facts"), F.col("__r.files_touched").alias("files_touched"))


def fact_rows(calls: DataFrame) -> DataFrame:
    """(tool_call_id, source_tool, content, fact_type, confidence), a row per fact."""
    return L.exploded(calls.select("tool_call_id", "source_tool", "facts"), "facts", "f").select("tool_call_id", "source_tool", "f.*")
