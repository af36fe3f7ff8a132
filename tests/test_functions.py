"""Vectors for the text functions and filters, positive and negative."""

import pytest
from pyspark.sql import functions as F

from sieveline import config
from sieveline.functions import classify, lines as L, text as T
from sieveline.operators import facts, filters, stacks, structured, windows

BAL, HIGH = config.limits("balanced", {}), config.limits("high", {})


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_redact(spark):
    rows = ["k AKIA" + "A" * 16, "postgres://u:p@h/db", 'api_key = "' + "a" * 32 + '"', "api_key=" + "a" * 32, "twilio x\n= " + "0" * 32, "plain", "-----BEGIN RSA PRIVATE KEY-----"]
    out = one(spark, lambda c: F.struct(*T.redact(c)), *rows)
    assert [r[1] for r in out] == [1, 1, 1, 0, 1, 0, 1]
    assert out[1][0] == "postgres://[REDACTED]@h/db" and out[3][0] == rows[3]
    assert one(spark, lambda c: T.redact(c, 5)[1], rows[0]) == [0]


def test_ansi_keeps_the_stack(spark):
    assert one(spark, T.strip_ansi, "\x1b[1;31mred\x1b[0m", "\x1b]0;" + "t" * 50_000 + "\x07x", "\x9b1mq", "no") == ["red", "x", "q", "no"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("<thinking>a</thinking>b", "b"), ("<a:thinking>o <reasoning>i</reasoning> x</a:thinking>b", "b"), ("b<scratchpad>open", "b"), ("b</thinking", "b"), ("a\n\n\n\nb ", "a\n\nb"), ("<b>kept</b>", "<b>kept</b>"), ("  ", "  ")],
)
def test_thinking(spark, raw, want):
    assert one(spark, T.strip_thinking, raw) == [want]


def test_noise(spark):
    assert one(spark, T.normalize_noise, "[2026-05-27T14:30:00.1Z] pid=12 42ms 1.5s 3 GB", "2026-05-27 only") == ["[TIMESTAMP] [PID] [X]ms [X]s [X]SIZE", "2026-05-27 only"]


def test_binary_and_oversized(spark):
    assert one(spark, T.binary_message, "\0" * 100 + "abc", "\0\0\0abc")[0].startswith("[Binary output suppressed — 4 NUL bytes, 2.9%")
    assert one(spark, T.binary_message, "\0\0\0abc") == [None]
    assert "[... Output truncated: 6,000 chars (limit: 5,000)." in one(spark, lambda c: T.oversized_preview(c, 5000), "x" * 6000)[0]


@pytest.mark.parametrize(
    ("command", "want"),
    [("git status", "git-status"), ("git -C d status", "git-other"), ("cd x && git status", "generic"), ("npm test", "test"), ("npm run test", "generic"), ("mypy .", "lint"), ("gradle build -x test", "test"), ("npx tsc", "typecheck"), ("pnpm run type-check", "typecheck"), ("cargo clippy", "lint"), ("ls", "ls-tree"), ("", "generic"), ("aws s3 ls --output json", "json")],
)
def test_commands(spark, command, want):
    assert one(spark, classify.command_category, command) == [want]


def test_verbose(spark):
    assert one(spark, classify.is_verbose, "make -v", "make -vv", "x --debug", "x --debugger") == [False, True, True, False]


def test_config():
    assert config.limits("nonsense", {})["generic_head"] == 20
    cfg = config.limits(None, {"SIEVELINE_RISK_LEVEL": "high", "SIEVELINE_GENERIC_HEAD": "9999", "SIEVELINE_GENERIC_TAIL": "-1", "SIEVELINE_REDACT_ENABLED": "0"})
    assert (cfg["generic_head"], cfg["generic_tail"], cfg["redact"]) == (500, 15, False)
    assert config.boosted(BAL)["generic_head"] == 40 and config.boosted(BAL)["json_max_depth"] == BAL["json_max_depth"]
    assert not config.enabled({"SIEVELINE_FILTERS": "off"})


def test_runs_and_blanks(spark):
    runs = lambda c: L.let(L.split_lines(c), lambda x: L.joined(L.collapse_runs(x, 2)))
    assert one(spark, runs, "a\na\na\na\nb\nb\nc", "a") == ["a\na\n[... 2 repeated lines omitted ...]\nb\nb\nc", "a"]
    blanks = lambda c: L.let(L.split_lines(c), lambda x: L.joined(L.collapse_blank(x)))
    assert one(spark, blanks, "a\n\n \n\nb\n\nc") == ["a\n\nb\n\nc"]


def test_native_filters(spark):
    log = "\n".join(f"{k:07x} c{k}" for k in range(60))
    out = one(spark, lambda c: filters.git_log(c, 25, 15), log, "x\ny")
    assert "[... 20 commits omitted ...]" in out[0][0] and out[0][1] and not out[1][1]
    status = "MM a/x\nMM a/y\n?? b\nMM a/z"
    assert one(spark, lambda c: filters.git_status(c, 50, 30, 2), status)[0][0] == "MM a/x, y, +1 more\n?? b"
    build = "$ b\n> Task :one\nnoise\nwarning: w\n> Task :two\nBUILD SUCCESSFUL in 3s"
    assert one(spark, lambda c: filters.build(c, 15, 25), build)[0][0] == "$ b\nBUILD SUCCESSFUL in [X]s\nTasks: one, two\n\nWarnings:\nwarning: w"
    logs = "\n".join(["ok"] * 9 + [f"l{k}" for k in range(60)] + ["fatal: x"] + [f"m{k}" for k in range(60)])
    out = one(spark, lambda c: filters.logs(c, 15, 30, 3), logs)[0][0]
    assert "[... 6 repeated lines omitted ...]" in out and "Important lines from omitted output:\nfatal: x" in out
    assert one(spark, lambda c: filters.generic(c, 2, 0), "a\nb\nc")[0][0] == "a\nb\n\n[... 1 lines omitted ...]\n"


def test_sections_of_diffs(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ 1\n" + "\n".join(f"+{k}" for k in range(40))
    out, cut = one(spark, lambda c: filters.git_diff(c, 8, 10), "$ git diff\n stat\n" + diff)[0]
    assert cut and out.startswith("$ git diff\n stat\ndiff --git") and "[... 37 lines omitted in this file ...]" in out
    shown, cut = one(spark, lambda c: filters.git_show(c, 8, 10), "commit 1\n\n" + diff)[0]
    assert cut and shown.startswith("commit 1\n\ndiff --git")
    plain = "diff --git a/x b/x\n" + "\n".join(f" same {k}" for k in range(30))
    assert one(spark, lambda c: filters.git_diff(c, 8, 10), plain)[0][0] == "diff --git a/x b/x\n same 0\n same 1\n same 29\n\n[... 27 lines omitted in this file ...]\n"
    assert one(spark, lambda c: filters.git_diff(c, 8, 10), "no diff\n\n\nhere", diff[:60]) == [("no diff\n\nhere", False), (diff[:60], False)]
    assert one(spark, lambda c: filters.git_show(c, 8, 10), "a blob\nof lines", "")[0][0] == "a blob\nof lines"


def test_searches_and_listings(spark):
    search = lambda c: filters.search(c, 5, 15, 20, 30)
    hits = "\n".join(f"src/a.py:{k}:x{k}" for k in range(9)) + "\nsrc/b.py:1:y"
    out, cut = one(spark, search, hits)[0]
    assert cut and "  [... 4 more matches in src/a.py ...]" in out and "src/b.py\n  1: y" in out
    assert one(spark, search, "nothing\nfound", "loose line\nsrc/a.py:1:x") == [("nothing\nfound", False), ("(unsorted)\n  loose line\nsrc/a.py\n  1: x", False)]
    listing = lambda c: filters.listing(c, 50, 20, 30)
    ls = "total 4\ndrwxr-xr-x 5 a b 160 May 26 14:30 src\n-rw-r--r-- 1 a b 4205 May 26 14:30 p.json\nlrwxrwxrwx 1 a b 3 May 26 14:30 l -> p"
    assert one(spark, listing, ls)[0][0] == "total 4\nsrc/             (dir, 3 entries)\np.json     4.1K\nl     3 -> p"
    names = "\n".join(f"f{k}" for k in range(80)) + "\nREADME.md\nREADME.md\nls: x: Permission denied"
    out, cut = one(spark, listing, names)[0]
    assert cut and out.startswith("README.md\n\nf0") and out.endswith("Permission denied") and out.count("README") == 2
    tree = ".\n├── a\n" + "│   x\n" * 90
    assert "[... 43 lines omitted ...]" in one(spark, listing, tree)[0][0] and one(spark, listing, "a | b |  c")[0][0] == "a|b|c"


def test_stack(spark):
    make = lambda c: L.let(L.split_lines(c), lambda x: L.joined(stacks.collapsed_stacks(c, x, 5)))
    frames = [f"    at org.springframework.A{k}.r(A.java:1)" for k in range(4)] + ["    at com.me.B.r(B.java:1)"]
    assert one(spark, make, "\n".join(["E", *frames]))[0].split("\n") == ["E", "[... 4 framework frames (org.springframework) ...]", frames[-1]]
    assert one(spark, make, "\n".join(frames[:4] * 2))[0].split("\n")[3:] == ["[... 5 framework frames omitted ...]", frames[3]]
    assert one(spark, make, "\n".join(frames[:3]), "") == ["\n".join(frames[:3]), ""]
    assert one(spark, lambda c: filters.generic(c, 20, 30, None)["output"], "\n".join(frames)) == ["\n".join(frames)]
    long = "\n".join(frames * 400)
    assert one(spark, make, long)[0].count("framework frames") == 400
    for cut in (lambda c: filters.build(c, 15, 25), lambda c: filters.git_log(c, 9, 9), lambda c: filters.git_status(c, 9, 9, 9)):
        assert "[... 4 framework frames (org.springframework) ...]" in one(spark, cut, "\n".join(["E", *frames]))[0][0]


def test_json():
    import json

    rows = [{"id": k, "s": "x", "t": None if k else True} for k in range(25)]
    out, cut = structured.json_text(json.dumps(rows), BAL)
    assert cut and out.startswith("s=x\nt=\n\nid,t\n0,true\n1,\n") and out.endswith("[... 5 more rows, keys: id, s, t]")
    assert structured.json_text('{"a": {"b": 1, "c": "x"}, "d": null, "e": true}', BAL)[0] == "a.b: 1\na.c: x\nd: null\ne: true"
    assert structured.json_text('{"b": 2.50, "a": "y", "c": 3}', BAL)[0] == "b: 2.5\na: y\nc: 3"
    assert structured.json_text("[]", BAL)[0] == "[]" and structured.json_text("{bad", BAL) == (None, None)
    assert "... +4 more items" in structured.json_text(json.dumps({"a": list(range(9))}), BAL)[0]


def test_read_file():
    text = "import a\nimport b\nfrom c import d\nimport e\n\n\n\n" + "\n".join(["# c"] * 12) + "\nx = [\n" + "\n".join(["1,"] * 9) + "\n]\n" + ".a {\n" + "p: 1;\n" * 5 + "}\n" + "y" * 600
    out, _ = structured.read_file(text, BAL)
    assert out.split("\n") == ["import a", " [... 3 import lines omitted ...]", "", "# c", " [... 11 comment lines omitted ...]", "x = [", " [... 9 array literal lines omitted ...]", "]", ".a {", " [... 5 CSS body lines omitted ...]", "}", "y" * 600]


def test_short_generated_run_takes_the_next_line_along():
    text = "y" * 600 + "\nimport a\nimport b\nimport c\nimport d\nimport e"
    assert structured.read_file(text, BAL)[0].split("\n")[1:] == ["import a", "import b", " [... 3 import lines omitted ...]"]
    assert structured.read_file(text.replace("\nimport a", "\n\nimport a"), BAL)[0].split("\n")[2:] == ["import a", " [... 4 import lines omitted ...]"]


def test_dispatch_survives_bad_rows(spark):
    df = spark.createDataFrame([('{"a": 1}',), (None,), ("[" * 100_000,)], "t string")
    out = structured.apply(df, "json", F.col("t"), BAL).collect()
    assert out[0].failed is False and out[1].output is None and out[2].failed is True and out[2].output == "[" * 100_000


def test_paths(spark):
    make = lambda c: structured.normalize_paths(c, ("/ws/org/app", "C:/p"), "/ws")
    assert one(spark, make, "see /ws/org/app/src/a.py", r"C:\p\x\y.c", r"other\z.c", "plain") == ["see app/src/a.py", "x/y.c", "other/z.c", "plain"]


def test_facts(spark):
    ask = lambda command, text: (command, text)
    rows = [ask("pytest", "3 passed, 1 failed\nFAILED t::a[x]"), ask("pytest", "nothing failed"), ask("git status", "  modified:   a b.py \n"), ask("ls", "fine"), ask(None, None), ask("make", "ERROR  x" + "y" * 200)]
    df = spark.createDataFrame([(str(k), "Bash", {"command": c} if c else {}, t, 1) for k, (c, t) in enumerate(rows)] + [("w", "Write", {}, "x", 1)], "tool_call_id string, tool_name string, args map<string,string>, result string, turn int")
    out = {r.tool_call_id: r for r in facts.extracted(df).collect()}
    said = lambda k: [f.content for f in out[str(k)].facts]
    assert "w" not in out and said(0) == ["[Bash] test: 3 passed", "[Bash] test: 1 failed", "[Bash] FAILED: t::a"] and [f.fact_type for f in out["0"].facts] == ["tool_result", "error", "error"]
    assert said(1) == ["[Bash] pytest (errors detected)"] and said(2) == ["[Bash] git status: a b.py"] and out["2"].files_touched == ["a b.py"]
    assert said(3) == ["[Bash] ls"] and said(4) == ["[Bash] "] and len(said(5)[0]) == len("[Bash] build error: ") + 120 and out["5"].facts[0].confidence == 0.9
    own = facts.Extractor("Own", ("Write",), lambda args, result, turn: F.struct(F.array(F.struct(result, F.lit("t"), F.lit(0.1))), F.array().cast("array<string>")))
    assert [r.facts[0].content for r in facts.extracted(df, (*facts.EXTRACTORS, own)).where("source_tool = 'Own'").collect()] == ["x"]


def test_read_facts(spark):
    df = spark.createDataFrame([("a", "Read", {"path": "p.py"}, "import a\n" * 5, 2), ("b", "Read", {}, "  first\rsecond", 2), ("c", "Read", {"path": ""}, None, 2)], "tool_call_id string, tool_name string, args map<string,string>, result string, turn int")
    out = {r.tool_call_id: r for r in facts.extracted(df).collect()}
    assert out["a"].facts[0].content == "[Read] p.py read at turn 2 (6 lines) — import-heavy" and out["a"].files_touched == ["p.py"]
    assert out["b"].facts[0].content == "[Read] first read at turn 2" and out["c"].facts[0].content == "[Read] unknown read at turn 2" and out["c"].files_touched == []


def test_truncation(spark):
    out = one(spark, lambda c: T.truncate_chars(c, 100), "a" * 150, "b")
    assert "…truncated 50 chars" in out[0] and out[1] == "b"
    assert one(spark, lambda c: T.truncate_tokens(c, 100), "a" * 150) == ["a" * 150]
    assert "chars) — raise budget" in one(spark, lambda c: T.truncate_tokens(c, 100), "word " * 900)[0]


def test_sections_and_sampling(spark):
    df = spark.createDataFrame([(1, k, "system" if k < 2 else "user", "x") for k in range(8)], "p int, i int, role string, c string")
    out = {r.i: r.section for r in windows.sections(df, "p", "i", "role", 3).collect()}
    assert [out[k] for k in range(8)] == ["prefix"] * 2 + ["middle"] * 3 + ["tail"] * 3
    assert windows.even_sample(df, ["p"], "i", 3).count() == 3 and windows.newest(df, ["p"], "i", 2).count() == 2


def test_source_truncation():
    from sieveline.operators.budget import shortened_source

    text = "\n".join(["import a"] * 6 + ["# c"] * 2 + ["def f():", "    x = 1"])
    assert shortened_source(text, 78) == "import a\n [... 5 more import lines …]\n# c\n# c\ndef f():\n    x = 1"
    many = "\n".join(f"def f{k}():\n    return {'x' * 90}" for k in range(40))
    out = shortened_source(many, 400)
    assert out.startswith("def f0():") and "declarations & body lines omitted" in out and len(out) <= 400
    assert shortened_source("x\n" * 500, 100) is None


def test_source_truncation_by_tokens():
    from sieveline.operators.budget import shortened_source_tokens, tokens_of

    few = "def f(x):\n" + "    a line of words here\n" * 60 + "class C:"
    assert shortened_source_tokens(few, 100) == "def f(x):\nclass C:\n\n[…read_file compressed: 60 non-declaration lines omitted…]\n\n"
    many = "\n".join(f"def function_number_{k}(argument):\n    return {k}" for k in range(200))
    out = shortened_source_tokens(many, 150)
    assert out.startswith("def function_number_0(") and "def function_number_199(" in out and tokens_of(out) <= 150 and "declarations & body lines omitted" in out
    assert shortened_source_tokens("words " * 900, 100) is None and shortened_source_tokens("short", 10) == "short"


def test_occurrences_by_parts(spark, monkeypatch):
    monkeypatch.setattr(windows, "PART", 10)
    df = spark.createDataFrame([("a" if k % 3 else "b", k) for k in range(95)] + [("a", 94)], "k string, o long")
    got = sorted((r.k, r.o, r.occurrence) for r in windows.occurrences(df, ["k"], "o").collect())
    want = [(k, o, n) for k in "ab" for n, o in enumerate([x for x in range(95) if (x % 3 > 0) == (k == "a")] + [94] * (k == "a"), 1)]
    assert got == sorted(want)


def test_roots(tmp_path):
    (tmp_path / "ws" / "projects" / "org" / "app").mkdir(parents=True)
    (tmp_path / "ws" / ".git").mkdir()
    deep = tmp_path / "ws" / "projects" / "org"
    assert config.workspace_root({}, str(deep)) == str(tmp_path / "ws") and config.workspace_root({"SIEVELINE_WORKSPACE_ROOT": str(deep)}, "/") == str(deep)
    assert config.project_roots(str(tmp_path / "ws")) == [str(deep / "app")] and config.project_roots(str(deep)) == [str(deep)]


def test_redact_is_evaluated_once(spark):
    """Text and count are fields of one expression, without a condition that keeps it from being shared."""
    df = spark.createDataFrame([("x AKIA" + "A" * 16,), (None,), ("plain",)], "t string")
    out, n = T.redact(F.col("t"))
    both = df.select(out.alias("o"), n.alias("n"))
    assert [tuple(r) for r in both.collect()] == [("x [REDACTED]", 1), (None, None), ("plain", 0)]
    fields = both._jdf.queryExecution().analyzed().toString().split("\n")[0]
    assert not fields.removeprefix("Project [").startswith("CASE WHEN")
