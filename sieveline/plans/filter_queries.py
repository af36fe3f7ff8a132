"""Queries over the filters' branches that the headline queries don't reach, and the stages of the whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import limits
from ..functions import text as T
from ..operators import filters, structured
from ..sources import corpora as C
from . import pipeline
from .registry import query

#: One secret of each family, made of a hash's hexadecimal digits.
_H = "a1b2c3d4e5f60718293a4b5c6d7e8f90"
SECRETS = (
    "AKIA" + _H[:16].upper(), "sk-ant-api03-" + _H * 3, "sk-ant-" + _H, "sk-proj-" + _H * 2, "sk-svcacct-" + _H * 2, "sk_proj_" + _H * 2, "sk_svcacct_" + _H * 2, "sk-" + _H, "github_pat_" + _H * 2, "ghp_" + _H * 2, "glpat-" + _H, "sk_live_" + _H,
    "xoxb-" + _H, "https://hooks.slack.com/services/T" + _H[:9].upper() + "/B" + _H[:9].upper() + "/" + _H, "SG." + _H + "." + _H * 2, "twilio token = " + _H, "npm_" + _H * 2, "pypi-" + _H, "dckr_pat_" + _H, "https://" + _H + "@sentry.io/42",
    "eyJ" + _H + ".eyJ" + _H + "." + _H, "-----BEGIN RSA PRIVATE KEY-----", "auth_token: '" + _H + "'", "TWILIO_AUTH_TOKEN=\"" + _H + "\"",
)


@query(f"""SELECT p_partkey, family, CASE WHEN family = 24 THEN 'x' || p_partkey || ' ftp://[REDACTED]@host/p and end' WHEN family = 25 THEN 'x' || p_partkey || ' sk-short and ghp_short and end' ELSE 'x' || p_partkey || ' [REDACTED] and end' END AS redacted, CASE WHEN family = 25 THEN 0 ELSE 1 END AS redactions
 FROM part CROSS JOIN (SELECT unnest(range({len(SECRETS) + 2})) AS family)""")
def redact_families(spark, sf_dir):
    """Every family of secrets on its own, and near misses."""
    texts = F.array(*[F.lit(s) for s in (*SECRETS, "ftp://user:pass@host/p", "sk-short and ghp_short")])
    rows = C.table(spark, sf_dir, "part").select("p_partkey", F.posexplode(texts).alias("family", "secret"))
    out, n = T.redact(F.concat(F.lit("x"), F.col("p_partkey"), F.lit(" "), F.col("secret"), F.lit(" and end")))
    return rows.select("p_partkey", F.col("family").cast("long").alias("family"), out.alias("redacted"), n.alias("redactions"))


def _outputs(spark, sf_dir):
    """Outputs of many commands and tools, some failed, short, binary, too large or repeated."""
    e = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id")).withColumns({"k": F.col("event_id") % 8, "n": F.col("event_id").cast("string")})
    lines = lambda what, n: F.concat(F.lit("top"), F.repeat(F.concat(F.lit("\n" + what + " "), F.col("n")), F.lit(n)))
    text = F.when(F.col("k") == 0, F.concat(F.repeat(F.lit("\0"), F.lit(300)), F.lit("ab"))).when(F.col("k") == 1, F.repeat(F.concat(F.lit("w"), F.col("n")), F.lit(2000))).when(F.col("k") == 2, "short").when(F.col("k") == 3, F.lit("the same text again " * 40)).otherwise(lines("a line of", 80))
    command = F.when(F.col("k") == 4, "npx vitest run").when(F.col("k") == 5, "eslint . --debug").when(F.col("k") == 6, "cargo test").otherwise("")
    tool = F.when(F.col("k") == 7, "run_command").otherwise("web_fetch")
    return e.select(F.col("event_id").alias("output_id"), F.expr("event_id div 400").cast("string").alias("session_id"), F.col("event_id").alias("seq"), command.alias("command"), tool.alias("tool"), F.when(F.col("k") == 6, 1).alias("exit_code"), F.lit(False).alias("timed_out"), text.alias("text"))


_STAGES = """e AS (SELECT event_id, event_id % 8 AS k, event_id // 400 AS s, CAST(event_id AS VARCHAR) AS n FROM (SELECT c_custkey AS event_id FROM customer)), r AS (SELECT *, row_number() OVER (PARTITION BY s, k ORDER BY event_id) AS rk FROM e),
 t AS (SELECT *, CASE WHEN k = 0 THEN 'binary' WHEN k = 1 THEN 'oversized' WHEN k IN (2, 3) AND rk > 1 THEN 'dedupe' WHEN k = 6 THEN 'error' WHEN k = 2 THEN 'small' ELSE 'filter' END AS stage, 'top' || repeat(chr(10) || 'a line of ' || n, 80) AS l FROM r),
 o AS (SELECT *, CASE k WHEN 4 THEN 'top' || repeat(chr(10) || 'a line of ' || n, 9) || chr(10) || chr(10) || '[... 31 lines omitted ...]' || chr(10) || repeat(chr(10) || 'a line of ' || n, 40) ELSE l END AS out FROM t)"""


@query(f"""WITH {_STAGES} SELECT event_id AS output_id, stage, CASE stage WHEN 'binary' THEN '[Binary output suppressed — 4 NUL bytes, 0.7% text content.]' WHEN 'oversized' THEN left(repeat('w' || n, 2000), 2000) || chr(10) || '[... Output truncated: ' || format('{{:,}}', 2000 * (1 + length(n))) || ' chars (limit: 2,500). Showing first 2,000 and last 1,000 chars. Use targeted queries or narrower tool scope to see the full output. ...]' || chr(10) || right(repeat('w' || n, 2000), 1000)
 WHEN 'dedupe' THEN '[repeated output, occurrence ' || rk || ', raw_output_id=' || event_id || ']' WHEN 'small' THEN 'short' ELSE CASE WHEN k = 3 THEN rtrim(repeat('the same text again ', 40)) WHEN k = 4 THEN out || chr(10) || '[filtered ' || length(l) || ' chars -> ' || length(out) || ' chars, raw_output_id=' || event_id || ']' ELSE l END END AS shown FROM o""")
def filter_stages(spark, sf_dir):
    """Every stage: binary, oversized, repeated, failed, short, filtered by command, passed on by tool."""
    cfg = limits("balanced", {}) | {"oversized_max_chars": 2500}
    return pipeline.filter_outputs(_outputs(spark, sf_dir), cfg, on=True).select("output_id", "stage", "shown")


@query("""SELECT c_custkey AS output_id, 'off' AS stage, c_custkey % 8 = 2 AS short FROM customer""")
def filter_switched_off(spark, sf_dir):
    out = pipeline.filter_outputs(_outputs(spark, sf_dir), limits("balanced", {}), on=False)
    return out.where(F.col("shown") == F.col("text")).select("output_id", "stage", (F.col("shown") == "short").alias("short"))


_WINDOW = "'l0' || repeat(chr(10) || 'x', 19) || chr(10) || chr(10) || '[... 30 lines omitted ...]' || chr(10) || repeat(chr(10) || 'x', 30)"


@query(f"""SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 0 THEN '$ cmd' || chr(10) || '[exit 0]' || chr(10) WHEN 1 THEN '[job 3]' || chr(10) || chr(10) WHEN 2 THEN '[killed after timeout]' || chr(10) ELSE '' END || {_WINDOW} AS output, TRUE AS truncated FROM part""")
def tool_headers(spark, sf_dir):
    """Lines that a tool puts before its output stay out of the window."""
    k = F.col("p_partkey") % 4
    top = F.when(k == 0, "$ cmd\n[exit 0]\n").when(k == 1, "[job 3]\n\n").when(k == 2, "[killed after timeout]\n").otherwise("")
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), filters.generic(F.concat(top, F.lit("l0" + "\nx" * 79))).alias("r")).select("key", "r.*")


@query("""SELECT p_partkey AS key, 'commit c' || p_partkey || chr(10) || 'Author: a' || chr(10) || chr(10) || '    why' || chr(10) || chr(10) || 'diff --git a/f b/f' || chr(10) || '--- a/f' || chr(10) || '+++ b/f' || chr(10) || '@@ -1 +1 @@' || chr(10) || '+new 1 ' || p_size || chr(10) || '+new 20 ' || p_size || chr(10) || chr(10) || '[... 18 lines omitted in this file ...]' || chr(10) AS output, TRUE AS truncated FROM part""")
def git_show_commit(spark, sf_dir):
    changed = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("+new "), i, F.lit(" "), F.col("p_size"))), "\n")
    t = F.concat(F.lit("commit c"), F.col("p_partkey"), F.lit("\nAuthor: a\n\n    why\n\ndiff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n"), changed)
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), filters.git_show(t, 5, 5).alias("r")).select("key", "r.*")


@query("""WITH l AS (SELECT p_partkey // 90 AS key, p_partkey AS o, CASE p_partkey % 30 WHEN 0 THEN './README.' || p_partkey WHEN 7 THEN 'ls: cannot access x' || p_partkey ELSE 'd/f' || p_partkey || '.c' END AS line, CASE p_partkey % 30 WHEN 0 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS kind FROM part),
 g AS (SELECT key, list(line ORDER BY o) AS body, list(line ORDER BY o) FILTER (kind = 1) AS kept, list(line ORDER BY o) FILTER (kind <> 1) AS reg, list(line ORDER BY o) FILTER (kind = 2) AS err FROM l GROUP BY key), r AS (SELECT *, 50 - coalesce(len(kept), 0) - coalesce(len(err), 0) AS room FROM g),
 h AS (SELECT *, room // 2 AS a, room - room // 2 AS b FROM r), w AS (SELECT *, list_concat(list_concat(list_concat(CASE WHEN len(kept) > 0 THEN list_append(kept, '') ELSE [] END, reg[1:a]), ['', '[... ' || (len(reg) - room) || ' entries omitted ...]', '']), reg[-b:]) AS shown FROM h)
SELECT key, array_to_string(CASE WHEN len(body) <= 50 OR len(reg) <= room THEN body ELSE list_concat(shown, list_filter(coalesce(err, []), lambda x: NOT list_contains(shown, x))) END, chr(10)) AS output, len(body) > 50 AND len(reg) > room AS truncated FROM w""")
def listing_important(spark, sf_dir):
    """Many entries: important names and errors stay, the others from both ends."""
    k, name = F.col("p_partkey") % 30, F.col("p_partkey").cast("string")
    line = F.when(k == 0, F.concat(F.lit("./README."), name)).when(k == 7, F.concat(F.lit("ls: cannot access x"), name)).otherwise(F.concat(F.lit("d/f"), name, F.lit(".c")))
    t = C.lines_of(C.table(spark, sf_dir, "part").withColumn("k", F.expr("p_partkey div 90")), "k", "p_partkey", line)
    return t.select("key", filters.listing(F.col("text"), 50, 20, 30).alias("r")).select("key", "r.*")


@query("""WITH m AS (SELECT l_orderkey // 60 AS key, 'src/o' || l_orderkey || '.py' AS path, l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem),
 a AS (SELECT *, row_number() OVER (PARTITION BY key, path ORDER BY n, p) AS rn, count(*) OVER (PARTITION BY key, path) AS k, dense_rank() OVER (PARTITION BY key ORDER BY o) AS f FROM m),
 g AS (SELECT key, f, path, max(k) AS k, list(n || ':part ' || p ORDER BY n, p) FILTER (rn <= 2) AS ls FROM a WHERE f <= 4 GROUP BY ALL),
 t AS (SELECT key, array_to_string(list_concat(list_concat([path], ls), CASE WHEN k > 2 THEN ['  [... ' || (k - 2) || ' more matches in ' || path || ' ...]'] ELSE [] END), chr(10)) AS part, f FROM g),
 x AS (SELECT key, max(f) - 4 AS files, count(*) FILTER (f > 4) AS ms FROM a GROUP BY key)
SELECT t.key, string_agg(part, chr(10) || chr(10) ORDER BY f) || CASE WHEN any_value(files) > 0 THEN chr(10) || chr(10) || '[... ' || any_value(files) || ' more files with ' || any_value(ms) || ' matches omitted ...]' ELSE '' END AS output FROM t JOIN x USING (key) GROUP BY t.key""")
def search_headings(spark, sf_dir):
    """Results that stand under their file's name already, with blank lines between files."""
    li = C.table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey"))
    per_file = C.lines_of(li, "l_orderkey", "o", F.concat(F.col("l_linenumber"), F.lit(":part "), F.col("l_partkey")))
    files = per_file.select(F.expr("key div 60").alias("k"), "key", F.concat(F.lit("src/o"), F.col("key"), F.lit(".py\n"), F.col("text"), F.lit("\n")).alias("t"))
    t = C.lines_of(files, "k", "key", F.col("t"))
    return t.select("key", filters.search(F.col("text"), 2, 4, 10, 15)["output"].alias("output"))


@query("""SELECT key, 'set=a' || chr(10) || chr(10) || 'id,rank' || chr(10) || string_agg(p_partkey || ',' || (p_partkey % 7), chr(10) ORDER BY p_partkey) AS csv FROM (SELECT *, p_partkey // 12 AS key, count(*) OVER (PARTITION BY p_partkey // 12) AS n FROM part) WHERE n >= 10 GROUP BY key""")
def json_factored(spark, sf_dir):
    """A table with a column of one value."""
    p = C.table(spark, sf_dir, "part").withColumn("k", F.expr("p_partkey div 12"))
    rows = p.groupBy(F.col("k").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.lit("a").alias("set"), (F.col("p_partkey") % 7).alias("rank")))).alias("l")).where(F.size("l") >= 10)
    return structured.apply(rows.select("key", F.to_json("l").alias("text")), "json", F.col("text"), limits("balanced", {})).select("key", F.col("output").alias("csv"))


@query("""SELECT p_partkey AS key, 'not json {' || chr(10) || 'x' || p_size AS output, FALSE AS truncated FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, '{' || chr(10) || '  "a": ' || p_size || chr(10) || '}', FALSE FROM part WHERE p_partkey % 2 = 1""")
def json_selection(spark, sf_dir):
    """Text that isn't JSON is generic; of an object too small for another notation the plain one stays."""
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("not json {\nx"), F.col("p_size"))).otherwise(F.concat(F.lit('{"a":'), F.col("p_size"), F.lit("}")))
    rows = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), t.alias("text"))
    return structured.apply(rows, "json", F.col("text"), limits("balanced", {})).select("key", "output", "truncated")


@query("""SELECT p_partkey AS key, CASE p_partkey % 5 WHEN 0 THEN 'a();' || repeat('b=1;', 60) || chr(10) || ' [... 5 minified lines omitted ...]' WHEN 1 THEN '# one' || chr(10) || ' [... 11 comment lines omitted ...]' WHEN 2 THEN 'rows = [' || chr(10) || ' [... 9 array literal lines omitted ...]' || chr(10) || ']'
 WHEN 3 THEN '.a {' || chr(10) || ' [... 5 CSS body lines omitted ...]' || chr(10) || '}' ELSE 's = ' || repeat(chr(34), 3) || chr(10) || ' [... 9 multiline string lines omitted ...]' || chr(10) || repeat(chr(34), 3) END || chr(10) || 'end ' || p_size AS output, TRUE AS truncated FROM part""")
def read_file_blocks(spark, sf_dir):
    """Minified lines, comments, literals, style rules and long strings of source files."""
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, "\n".join(["a();" + "b=1;" * 60] * 6)).when(k == 1, "# one" + "\n# more words" * 11).when(k == 2, "rows = [" + "\n    1234, 'text'," * 9 + "\n]").when(k == 3, ".a {" + "\n  color: red; margin: 0" * 5 + "\n}").otherwise('s = """' + "\nwords in a text" * 9 + '\n"""')
    rows = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat(t, F.lit("\nend "), F.col("p_size")).alias("text"))
    return structured.apply(rows, "read_file", F.col("text"), limits("balanced", {})).select("key", "output", "truncated")


@query("""SELECT p_partkey AS key, 'Error: x' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN '  File "app/a.py", line 1, in f' || chr(10) || '[... 5 framework frames (Python stdlib) ...]' WHEN 1 THEN '    at run (src/app.js:1:2)' || chr(10) || '[... 5 framework frames (Node) ...]'
 WHEN 2 THEN repeat('    at java.lang.reflect.M.i(M.java:1)' || chr(10), 3) || '[... 2 framework frames omitted ...]' ELSE repeat('    at org.apache.A.b(A.java:1)' || chr(10), 3) || '    at com.acme.A.b(A.java:1)' END || chr(10) || 'done ' || p_size AS output, FALSE AS truncated FROM part""")
def stack_languages(spark, sf_dir):
    """Frames of other languages, of frameworks alone, and runs too short."""
    k = F.col("p_partkey") % 4
    t = F.when(k == 0, '  File "app/a.py", line 1, in f' + '\n  File "/usr/lib/python3/x.py", line 2, in g' * 5).when(k == 1, "    at run (src/app.js:1:2)" + "\n    at next (node_modules/x/y.js:1:2)" * 5).when(k == 2, "\n".join(["    at java.lang.reflect.M.i(M.java:1)"] * 5)).otherwise("    at org.apache.A.b(A.java:1)\n" * 3 + "    at com.acme.A.b(A.java:1)")
    return C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), filters.generic(F.concat(F.lit("Error: x\n"), t, F.lit("\ndone "), F.col("p_size"))).alias("r")).select("key", "r.*")
