"""Queries by name and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LEVELS, limits
from ..functions import classify, text as T
from ..functions import lines as L
from ..operators import budget, filters, structured, telemetry, windows
from ..sources import corpora as C
from . import filter_queries, log_queries, message_queries, pipeline  # noqa: F401 (they register their queries)
from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged filter over all documents, summed up by source."""
    return filter_savings(spark, sf_dir)


_INJECTED = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' AKIA' || upper(substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))
  WHEN 1 THEN text || ' postgres://u:p' || doc_id || '@h/db' ELSE text || ' api_key="' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 40) || '"' END AS t FROM documents"""


@query(f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_replace(t, 'AKIA[A-Z0-9]{{16}}', '[REDACTED]', 'gi') WHEN 1 THEN regexp_replace(t, '(://)[^\\s:@/]*:[^\\s@/]+(@)', '\\1[REDACTED]\\2', 'g')
  ELSE regexp_replace(t, 'api_key="[A-Za-z0-9]{{32,}}"', '[REDACTED]', 'gi') END AS redacted, 1 AS redactions FROM ({_INJECTED})""")
def redact_inject(spark, sf_dir):
    sha = F.sha2(F.col("doc_id").cast("string"), 256)
    added = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" AKIA"), F.upper(F.substring(sha, 1, 16)))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" postgres://u:p"), F.col("doc_id"), F.lit("@h/db"))).otherwise(F.concat(F.lit(' api_key="'), F.substring(sha, 1, 40), F.lit('"')))
    out, n = T.redact(F.concat("text", added))
    return C.table(spark, sf_dir, "documents").select("doc_id", out.alias("redacted"), n.alias("redactions"))


@query("""SELECT lang, count(*) AS n, CAST(sum(len(regexp_extract_all(text, '(?i)(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}|sk-[A-Za-z0-9]{32,}|gh[pousr]_[A-Za-z0-9_]{36,}|xox[baprs]-[A-Za-z0-9\\-]{10,}|npm_[A-Za-z0-9]{36,}|(?:apikey|api_key|secret_key|auth_token)\\s*[=:]\\s*["''][A-Za-z0-9\\-_]{32,}["'']'))) AS BIGINT) AS redactions FROM documents GROUP BY lang""")
def redact_plain_documents(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(T.redact(F.col("text"))[1]).cast("long").alias("redactions"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(chr(27) || '[31m' || text || chr(27) || '[0m' || chr(27) || ']0;title' || chr(7), '\\x1b\\][^\\x07]*\\x07', '', 'g'), '\\x1b\\[[0-?]*[ -/]*[@-~]', '', 'g') AS plain FROM documents""")
def ansi_strip(spark, sf_dir):
    t = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m\x1b]0;title\x07"))
    return C.table(spark, sf_dir, "documents").select("doc_id", T.strip_ansi(t).alias("plain"))


@query("""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\\n{3,}', E'\\n\\n', 'g'), '^\\s+|\\s+$', '', 'g') AS spoken FROM conversations""")
def thinking_strip(spark, sf_dir):
    t, k = F.col("text"), F.col("turn") % 4
    wrapped = F.when(k == 0, F.concat(F.lit("<thinking>a\nb</thinking>"), t)).when(k == 1, F.concat(t, F.lit("<reasoning>open <b>"))).when(k == 2, F.concat(F.lit("<x:thinking>o <reasoning>i</reasoning> b</x:thinking>"), t)).otherwise(F.concat(t, F.lit("</thinking")))
    return C.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_thinking(wrapped).alias("spoken"))


_NOISE = "'[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] pid=' || user_id || ' took ' || (event_id % 900) || 'ms used ' || (event_id % 64) || ' MB in 2s'"


@query(f"""SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_NOISE}, '\\[[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}\\]', '[TIMESTAMP]', 'g'), '(?i)\\bpid\\s*[:=]?\\s*\\d{{1,7}}\\b', '[PID]', 'g'), '\\b\\d+\\s*ms\\b', '[X]ms', 'g'), '\\b\\d+\\s*s\\b', '[X]s', 'g'), '(?i)\\b\\d+\\s*MB\\b', '[X]SIZE', 'g') AS line FROM events""")
def noise_norm(spark, sf_dir):
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] pid="), F.col("user_id"), F.lit(" took "), F.col("event_id") % 900, F.lit("ms used "), F.col("event_id") % 64, F.lit(" MB in 2s"))
    return C.table(spark, sf_dir, "events").select("event_id", T.normalize_noise(line).alias("line"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '[Binary output suppressed — 4 NUL bytes, ' || format('{:.1f}', length(regexp_replace(substr(text, 1, 10), '^\\s+|\\s+$', '', 'g')) * 100.0 / (200 + length(substr(text, 1, 10)))) || '% text content.]' END AS message FROM documents""")
def binary_flag(spark, sf_dir):
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(F.repeat(F.lit("\0"), F.lit(200)), F.substring("text", 1, 10))).otherwise(F.col("text"))
    return C.table(spark, sf_dir, "documents").select("doc_id", T.binary_message(t).alias("message"))


@query("""SELECT doc_id, substr(text, 1, 2000) || chr(10) || '[... Output truncated: ' || format('{:,}', length(text)) || ' chars (limit: 5,000). Showing first 2,000 and last 1,000 chars. Use targeted queries or narrower tool scope to see the full output. ...]' || chr(10) || right(text, 1000) AS preview FROM documents WHERE length(text) > 5000""")
def oversized_preview(spark, sf_dir):
    p = T.oversized_preview(F.col("text"), 5000)
    return C.table(spark, sf_dir, "documents").select("doc_id", p.alias("preview")).where("preview IS NOT NULL")


_EVENTS = f"SELECT event_id, {C.picked_sql(C.COMMANDS, 'event_id')} AS command, {C.picked_sql(C.TOOLS, 'event_id')} AS tool FROM events"
_BASE = "string_split_regex(regexp_replace(command, '^(?:npx|pnpm|yarn\\s+run|yarn|npm\\s+run|npm|bun|deno)\\s+', ''), '\\s+')[1]"


@query(f"""SELECT command, category, detailed, count(*) AS n FROM (SELECT command, regexp_matches(command, '(?:^|\\s)(?:--verbose|-verbose|-v{{2,}}|--debug|--full|--detailed|--show-all|--no-summary)\\b') AS detailed,
 CASE WHEN regexp_matches(command, '^(npm|pnpm|yarn|bun|deno)\\s+test\\b') THEN 'test' WHEN regexp_matches(command, '^(npm|pnpm|yarn|bun|deno)\\s+run\\s+build\\b') THEN 'build' WHEN regexp_matches(command, '^(npm|pnpm|yarn|bun|deno)\\s+run\\s+lint\\b') THEN 'lint'
  WHEN regexp_matches(command, '^(npm|pnpm|yarn|bun|deno)\\s+run\\s+type-?check\\b') THEN 'typecheck' WHEN regexp_matches(command, '^(npm|pnpm|yarn|bun|deno)\\s+ls\\b.*--json') THEN 'json'
  WHEN base = 'git' THEN CASE string_split(command, ' ')[2] WHEN 'status' THEN 'git-status' WHEN 'diff' THEN 'git-diff' WHEN 'log' THEN 'git-log' WHEN 'show' THEN 'git-show' ELSE 'git-other' END
  WHEN base IN ('ls', 'dir', 'tree', 'find') THEN 'ls-tree' WHEN base IN ('grep', 'rg', 'findstr', 'ag', 'ack') THEN 'search'
  WHEN base IN ('jq', 'yq', 'json_pp') OR base = 'python3' AND contains(command, '-m json.tool') OR base IN ('aws', 'gcloud', 'az') AND (contains(command, '--output json') OR contains(command, '--format json')) OR base = 'curl' AND contains(command, 'jq') THEN 'json'
  WHEN base IN ('vitest', 'jest', 'pytest') OR base IN ('cargo', 'go') AND contains(command, ' test') OR base IN ('mvn', 'gradle', 'dotnet') AND contains(command, 'test') THEN 'test'
  WHEN base IN ('make', 'cmake', 'ninja') OR base = 'cargo' AND (contains(command, ' build') OR contains(command, ' check')) OR base = 'go' AND contains(command, ' build') OR base IN ('mvn', 'gradle') AND (contains(command, 'compile') OR contains(command, 'build')) THEN 'build'
  WHEN base IN ('eslint', 'ruff', 'mypy') OR base = 'cargo' AND contains(command, ' clippy') THEN 'lint' WHEN base IN ('tsc', 'pyright') OR base = 'biome' AND contains(command, 'check') THEN 'typecheck' ELSE 'generic' END AS category
 FROM (SELECT command, {_BASE} AS base FROM ({_EVENTS}))) GROUP BY ALL""")
def classify_commands(spark, sf_dir):
    c = C.table(spark, sf_dir, "events").select(C.picked(C.COMMANDS, "event_id").alias("command"))
    return c.groupBy("command").agg(F.count("*").alias("n")).select("command", classify.command_category(F.col("command")).alias("category"), classify.is_verbose(F.col("command")).alias("detailed"), "n")


@query(f"""SELECT tool, CASE tool WHEN 'raw_output' THEN 'passthrough' WHEN 'run_command' THEN 'shell' WHEN 'read_file' THEN 'read_file' WHEN 'edit_file' THEN 'edit_file' WHEN 'search_content' THEN 'search' WHEN 'list_jobs' THEN 'logs' WHEN 'mcp__db' THEN 'json' ELSE 'generic' END AS category, count(*) AS n FROM ({_EVENTS}) GROUP BY ALL""")
def classify_tools(spark, sf_dir):
    t = C.table(spark, sf_dir, "events").select(C.picked(C.TOOLS, "event_id").alias("tool"), F.col("props"))
    return t.select("tool", classify.tool_category(F.col("tool"), F.col("props")).alias("category")).groupBy("tool", "category").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN CAST(event_id % 7 AS INT) WHEN event_id % 4 = 2 THEN CAST(event_id % 5 AS INT) END AS exit_code, event_id % 4 = 0 AS timed_out FROM events""")
def result_meta(spark, sf_dir):
    k = F.col("event_id") % 4
    t = F.when(k == 0, "[killed after timeout]\n[exit 1]").when(k == 1, F.concat(F.lit("$ x\n[exit "), F.col("event_id") % 7, F.lit("]\nexit 9"))).when(k == 2, F.concat(F.lit("process exited "), F.col("event_id") % 5)).otherwise("fine")
    return C.table(spark, sf_dir, "events").select("event_id", T.result_meta(t).alias("m")).select("event_id", "m.*")


_HEAD_TAIL = """SELECT doc_id, CASE WHEN len(l) > 10 THEN array_to_string(list_concat(list_concat(l[1:5], ['', '[... ' || (len(l) - 10) || ' lines omitted ...]', '']), l[-5:]), chr(10)) ELSE array_to_string(l, chr(10)) END AS output, len(l) > 10 AS truncated FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""


@query(_HEAD_TAIL)
def head_tail(spark, sf_dir):
    r = filters.generic(F.col("text"), 5, 5)
    return C.table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query("""SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS thinned FROM documents""")
def blank_collapse(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").select("doc_id", L.let(L.split_lines(F.replace("text", F.lit("\n"), F.lit("\n\n \n\n"))), lambda x: L.joined(L.collapse_blank(x))).alias("thinned"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
 c AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM l), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS rn, count(*) OVER (PARTITION BY doc_id, run) AS k FROM g),
 e AS (SELECT doc_id, pos, CASE WHEN rn <= 2 THEN line ELSE '[... ' || (k - 2) || ' repeated lines omitted ...]' END AS line FROM r WHERE rn <= 3)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS thinned FROM e GROUP BY doc_id""")
def dup_run_collapse(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").select("doc_id", L.let(L.split_lines(F.col("text")), lambda x: L.joined(L.collapse_runs(x, 2))).alias("thinned"))


_COMMITS = "SELECT o_orderkey // 500 AS key, string_agg(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 9) || ' order ' || o_orderkey, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY 1"


@query(f"""SELECT key, array_to_string(CASE WHEN len(l) > 40 THEN list_concat(list_concat(l[1:25], ['', '[... ' || (len(l) - 40) || ' commits omitted ...]', '']), l[-15:]) ELSE l END, chr(10)) AS output, len(l) > 40 AS truncated FROM (SELECT key, string_split(text, chr(10)) AS l FROM ({_COMMITS}))""")
def git_log_window(spark, sf_dir):
    o = C.table(spark, sf_dir, "orders").withColumn("k", F.expr("o_orderkey div 500"))
    t = C.lines_of(o, "k", "o_orderkey", F.concat(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 9), F.lit(" order "), F.col("o_orderkey")))
    return t.select("key", filters.git_log(F.col("text"), 25, 15).alias("r")).select("key", "r.*")


@query("""WITH s AS (SELECT p_partkey // 100 AS key, p_partkey AS o, CASE p_partkey % 3 WHEN 0 THEN 'MM' WHEN 1 THEN 'AM' ELSE '??' END AS st, p_brand || '/' AS dir, 'f' || p_partkey || '.py' AS name FROM part),
 g AS (SELECT key, st, dir, min(o) AS first, list(name ORDER BY o) AS names FROM s GROUP BY ALL)
SELECT key, string_agg(st || ' ' || dir || array_to_string(names[1:10], ', ') || CASE WHEN len(names) > 10 THEN ', +' || (len(names) - 10) || ' more' ELSE '' END, chr(10) ORDER BY first) AS output, TRUE AS truncated FROM g GROUP BY key""")
def git_status_group(spark, sf_dir):
    p = C.table(spark, sf_dir, "part").withColumn("k", F.expr("p_partkey div 100"))
    status = F.when(F.col("p_partkey") % 3 == 0, "MM").when(F.col("p_partkey") % 3 == 1, "AM").otherwise("??")
    t = C.lines_of(p, "k", "p_partkey", F.concat(status, F.lit(" "), F.col("p_brand"), F.lit("/f"), F.col("p_partkey"), F.lit(".py")))
    return t.select("key", filters.git_status(F.col("text"), 50, 30, 10).alias("r")).select("key", "r.*")


@query("""WITH l AS (SELECT l_orderkey // 100 AS key, l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END || 'q' || CAST(l_quantity AS INT) AS line FROM lineitem),
 s AS (SELECT key, l_orderkey, list(line ORDER BY l_linenumber, l_partkey, l_quantity) AS b FROM l GROUP BY ALL),
 c AS (SELECT key, l_orderkey, 'diff --git a/f' || l_orderkey || ' b/f' || l_orderkey AS h, b, ['--- a/f' || l_orderkey, '+++ b/f' || l_orderkey] AS hh FROM s),
 d AS (SELECT key, l_orderkey, CASE WHEN len(b) + 3 <= 5 OR len(b) <= 3 THEN list_concat(list_concat([h], hh), b) ELSE list_concat(list_concat(list_concat([h], hh), [b[1], b[-1]]), ['', '[... ' || (len(b) - 2) || ' lines omitted in this file ...]', '']) END AS lines FROM c)
SELECT key, string_agg(array_to_string(lines, chr(10)), chr(10) ORDER BY l_orderkey) AS output, TRUE AS truncated FROM d GROUP BY key""")
def git_diff_sections(spark, sf_dir):
    li = C.table(spark, sf_dir, "lineitem")
    li = li.withColumn("o", F.struct("l_linenumber", "l_partkey", "l_quantity"))
    body = C.lines_of(li, "l_orderkey", "o", F.concat(F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-"), F.lit("q"), F.col("l_quantity").cast("int")))
    file = F.concat(F.lit("f"), F.col("key"))
    body = body.select(F.expr("key div 100").alias("k"), "key", F.concat(F.lit("diff --git a/"), file, F.lit(" b/"), file, F.lit("\n--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n"), F.col("text")).alias("t"))
    texts = C.lines_of(body, "k", "key", F.col("t"))
    return texts.select("key", filters.git_diff(F.col("text"), 5, 5).alias("r")).select("key", "r.*")


@query("""WITH m AS (SELECT l_orderkey // 60 AS key, 'src/o' || l_orderkey || '.py' AS path, l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem),
 a AS (SELECT *, row_number() OVER (PARTITION BY key, path ORDER BY n, p) AS rn, count(*) OVER (PARTITION BY key, path) AS k, dense_rank() OVER (PARTITION BY key ORDER BY o) AS f FROM m),
 g AS (SELECT key, f, path, max(k) AS k, list('  ' || n || ': part ' || p ORDER BY n, p) FILTER (rn <= 3) AS ls FROM a WHERE f <= 8 GROUP BY ALL),
 t AS (SELECT key, array_to_string(list_concat(list_concat([path], ls), CASE WHEN k > 3 THEN ['  [... ' || (k - 3) || ' more matches in ' || path || ' ...]'] ELSE [] END), chr(10)) AS part, f FROM g),
 x AS (SELECT key, max(f) - 8 AS files, count(*) FILTER (f > 8) AS ms FROM a GROUP BY key)
SELECT t.key, string_agg(part, chr(10) || chr(10) ORDER BY f) || CASE WHEN any_value(files) > 0 THEN chr(10) || chr(10) || '[... ' || any_value(files) || ' more files with ' || any_value(ms) || ' matches omitted ...]' ELSE '' END AS output, TRUE AS truncated FROM t JOIN x USING (key) GROUP BY t.key""")
def search_cap(spark, sf_dir):
    li = C.table(spark, sf_dir, "lineitem").withColumns({"k": F.expr("l_orderkey div 60"), "o": F.struct("l_orderkey", "l_linenumber", "l_partkey")})
    t = C.lines_of(li, "k", "o", F.concat(F.lit("src/o"), F.col("l_orderkey"), F.lit(".py:"), F.col("l_linenumber"), F.lit(":part "), F.col("l_partkey")))
    return t.select("key", filters.search(F.col("text"), 3, 8, 10, 15).alias("r")).select("key", "r.*")


@query("""WITH l AS (SELECT event_id // 700 AS key, list(CASE WHEN event_type IN ('error', 'purchase') AND event_id % 50 = 0 THEN 'error in ' || event_id ELSE 'ok ' || event_type || ' ' || event_id END ORDER BY event_id) AS l FROM events GROUP BY 1),
 w AS (SELECT key, l, l[1:15] AS h, l[-30:] AS t, len(l) > 45 AS long, list_filter(l[16:-31], lambda x: regexp_matches(x, '\\berror\\b')) AS imp FROM l)
SELECT key, CASE WHEN NOT long THEN array_to_string(l, chr(10)) ELSE array_to_string(list_concat(list_concat(list_concat(list_concat(list_concat(h, ['', '[... ' || (len(l) - 45) || ' lines omitted ...]']), CASE WHEN len(imp) > 0 THEN ['', 'Important lines from omitted output:'] ELSE [] END), imp), ['']), t), chr(10)) END AS output, long AS truncated FROM w""")
def logs_important(spark, sf_dir):
    e = C.table(spark, sf_dir, "events").withColumn("k", F.expr("event_id div 700"))
    line = F.when(F.col("event_type").isin("error", "purchase") & (F.col("event_id") % 50 == 0), F.concat(F.lit("error in "), F.col("event_id"))).otherwise(F.concat(F.lit("ok "), F.col("event_type"), F.lit(" "), F.col("event_id")))
    return C.lines_of(e, "k", "event_id", line).select("key", filters.logs(F.col("text"), 15, 30, 3).alias("r")).select("key", "r.*")


_SIZE = "CASE WHEN s < 1024 THEN CAST(s AS VARCHAR) WHEN s < 1048576 THEN format('{:.1f}K', s / 1024.0) ELSE format('{:.1f}M', s / 1048576.0) END"


@query(f"""WITH l AS (SELECT p_partkey // 80 AS key, p_partkey AS o, CAST(p_retailprice * 700 AS BIGINT) AS s, p_partkey % 6 = 0 AS d, p_size + 1 AS n FROM part)
SELECT key, 'total 64' || chr(10) || string_agg(CASE WHEN d THEN 'd' || o || '/             (dir' || CASE WHEN n > 2 THEN ', ' || (n - 2) || ' entries' ELSE '' END || ')' ELSE 'f' || o || '.txt     ' || {_SIZE} END, chr(10) ORDER BY o) AS output, TRUE AS truncated FROM l GROUP BY key HAVING count(*) >= 3""")
def ls_abbrev(spark, sf_dir):
    p = C.table(spark, sf_dir, "part").withColumns({"k": F.expr("p_partkey div 80"), "d": F.col("p_partkey") % 6 == 0})
    line = F.concat(F.when(F.col("d"), "drwxr-xr-x").otherwise("-rw-r--r--"), F.lit("  "), F.col("p_size") + 1, F.lit(" me staff  "), (F.col("p_retailprice") * 700).cast("decimal(20,0)").cast("long"), F.lit(" May 26 14:30 "), F.when(F.col("d"), F.concat(F.lit("d"), F.col("p_partkey"))).otherwise(F.concat(F.lit("f"), F.col("p_partkey"), F.lit(".txt"))))
    t = C.lines_of(p, "k", "p_partkey", line).select("key", F.concat(F.lit("total 64\n"), F.col("text")).alias("text"))
    t = t.where(F.size(F.split("text", "\n")) > 3)  # a shorter listing isn't one
    return t.select("key", filters.listing(F.col("text"), 50, 20, 30).alias("r")).select("key", "r.*")


@query("""SELECT s_suppkey, s_name || '|' || s_nationkey || '|' || CAST(floor(s_acctbal) AS INT) || '|' AS line FROM supplier""")
def table_whitespace(spark, sf_dir):
    line = F.concat(F.col("s_name"), F.lit("   |  "), F.col("s_nationkey"), F.lit(" |"), F.floor("s_acctbal").cast("int"), F.lit("   |  "))
    return C.table(spark, sf_dir, "supplier").select("s_suppkey", filters.minimized_tables(line).alias("line"))


@query("""SELECT n_regionkey AS key, 'BUILD SUCCESSFUL in [X]s' || chr(10) || 'Tasks: ' || string_agg('compile' || n_name, ', ' ORDER BY n_nationkey) || chr(10) || chr(10) || 'Warnings:' || chr(10) || string_agg('warning: ' || n_nationkey, chr(10) ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 0) AS output, TRUE AS truncated FROM nation GROUP BY 1""")
def build_summary(spark, sf_dir):
    n = C.table(spark, sf_dir, "nation")
    line = F.concat(F.lit("> Task :compile"), F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("\nwarning: "), F.col("n_nationkey"))).otherwise("\nplain text that goes away"))
    t = C.lines_of(n, "n_regionkey", "n_nationkey", line)
    return t.select("key", filters.build(F.concat("text", F.lit("\nBUILD SUCCESSFUL in 12s")), 15, 25).alias("r")).select("key", "r.*")


_TABLE = "SELECT event_id // 90 AS key, list(struct_pack(id := event_id, kind := event_type, n := event_id % 4) ORDER BY event_id) AS l FROM events GROUP BY 1"


@query(f"""WITH t AS ({_TABLE}), c AS (SELECT key, 'id,kind,n' || chr(10) || array_to_string(list_transform(l[1:20], lambda r: r.id || ',' || r.kind || ',' || r.n), chr(10)) || CASE WHEN len(l) > 20 THEN chr(10) || '[... ' || (len(l) - 20) || ' more rows, keys: id, kind, n]' ELSE '' END AS csv,
  '[' || chr(10) || array_to_string(list_transform(l[1:5], lambda r: '  {{' || chr(10) || '    "id": ' || r.id || ',' || chr(10) || '    "kind": "' || r.kind || '",' || chr(10) || '    "n": ' || r.n || chr(10) || '  }}'), ',' || chr(10)) || CASE WHEN len(l) > 5 THEN ',' || chr(10) || '  ... +' || (len(l) - 5) || ' more items' ELSE '' END || chr(10) || ']' AS cut, len(l) AS n FROM t)
SELECT key, CASE WHEN n >= 3 AND length(csv) <= length(cut) THEN csv ELSE cut END AS csv FROM c""")
def json_csv(spark, sf_dir):
    e = C.table(spark, sf_dir, "events").withColumn("k", F.expr("event_id div 90"))
    rows = e.groupBy(F.col("k").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("event_id") % 4).alias("n")))).alias("l"))
    return structured.apply(rows.select("key", F.to_json("l").alias("text")), "json", F.col("text"), limits("balanced", {})).select("key", F.col("output").alias("csv"))


@query("""SELECT c_custkey, 'name: ' || c_name || chr(10) || 'nation: ' || c_nationkey || chr(10) || 'segment: ' || c_mktsegment || chr(10) || 'active: ' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS kv FROM customer""")
def json_kv(spark, sf_dir):
    c = C.table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 2 == 0).alias("active"))).alias("text"))
    return structured.apply(c, "json", F.col("text"), limits("balanced", {})).select("c_custkey", F.col("output").alias("kv"))


@query("""SELECT c_custkey, 'id: ' || c_custkey || chr(10) || 'who.name: ' || c_name || chr(10) || 'who.home.nation: ' || c_nationkey AS dotted FROM customer""")
def json_dotted(spark, sf_dir):
    c = C.table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("home")).alias("who"))).alias("text"))
    return structured.apply(c, "json", F.col("text"), limits("balanced", {})).select("c_custkey", F.col("output").alias("dotted"))


@query("""WITH f AS (SELECT p_partkey AS key, p_size, CASE WHEN p_size % 4 = 0 THEN 'import a' || p_partkey || chr(10) || 'import b' || chr(10) || 'from c import d' || chr(10) || 'import e' ELSE 'import a' || p_partkey END AS imports FROM part)
SELECT key, CASE WHEN p_size % 4 = 0 THEN 'import a' || key || chr(10) || ' [... 3 import lines omitted ...]' ELSE imports END || chr(10) || chr(10) || 'x = ' || p_size || chr(10) || 'y = 2' AS output FROM f""")
def read_file_imports(spark, sf_dir):
    p = C.table(spark, sf_dir, "part")
    imports = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("import a"), F.col("p_partkey"), F.lit("\nimport b\nfrom c import d\nimport e"))).otherwise(F.concat(F.lit("import a"), F.col("p_partkey")))
    t = p.select(F.col("p_partkey").alias("key"), F.concat(imports, F.lit("\n\n\n\nx = "), F.col("p_size"), F.lit("\ny = 2")).alias("text"))
    return structured.apply(t, "read_file", F.col("text"), limits("balanced", {})).select("key", "output")


@query("""WITH l AS (SELECT s_suppkey // 7 AS key, s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN '    at com.acme.S' ELSE '    at org.springframework.S' END || s_suppkey || '.run(S.java:1)' AS line, s_suppkey % 4 = 1 AS app FROM supplier),
 r AS (SELECT *, sum(CASE WHEN app THEN 1 ELSE 0 END) OVER w AS g, count(*) FILTER (app) OVER (PARTITION BY key) AS apps, count(*) OVER (PARTITION BY key) AS n FROM l WINDOW w AS (PARTITION BY key ORDER BY s_suppkey)),
 e AS (SELECT key, min(s_suppkey) AS o, line FROM r WHERE n < 5 GROUP BY key, line
  UNION ALL SELECT key, min(s_suppkey), CASE WHEN app THEN any_value(line) ELSE '[... ' || count(*) || ' framework frames (org.springframework) ...]' END FROM r WHERE apps > 0 AND n >= 5 GROUP BY key, g, app)
SELECT key, 'Exception: x' || chr(10) || string_agg(line, chr(10) ORDER BY o) AS output FROM e GROUP BY key""")
def stack_frames(spark, sf_dir):
    s = C.table(spark, sf_dir, "supplier").withColumn("k", F.expr("s_suppkey div 7"))
    t = C.lines_of(s, "k", "s_suppkey", F.concat(F.lit("    at "), F.when(F.col("s_suppkey") % 4 == 1, "com.acme.S").otherwise("org.springframework.S"), F.col("s_suppkey"), F.lit(".run(S.java:1)")))
    return t.select("key", filters.generic(F.concat(F.lit("Exception: x\n"), F.col("text")), 20, 30)["output"].alias("output"))


_REPEATS = """SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) AS occurrence FROM documents"""


@query(f"""SELECT doc_id, occurrence, CASE WHEN occurrence > 1 THEN '[repeated output, occurrence ' || occurrence || ', raw_output_id=' || CAST(sum(CASE WHEN occurrence > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) || ']' ELSE text END AS shown FROM ({_REPEATS})""")
def dedupe_cross_turn(spark, sf_dir):
    return windows.repeated_outputs(C.table(spark, sf_dir, "documents"), "lang", "doc_id", "text").select("doc_id", F.col("occurrence").cast("long").alias("occurrence"), "shown")


@query("""WITH d AS (SELECT doc_id, text, max(CASE WHEN length(text) >= 200 THEN doc_id END) OVER (PARTITION BY doc_id // 400, sha256(text)) AS last, row_number() OVER (PARTITION BY doc_id // 400 ORDER BY doc_id DESC) AS rk, count(*) OVER (PARTITION BY doc_id // 400) AS n FROM documents),
 o AS (SELECT *, coalesce(length(text) >= 200 AND doc_id < last AND (rk > 10 OR n <= 10), FALSE) AS superseded FROM d)
SELECT doc_id, superseded, CASE WHEN superseded THEN '[superseded by identical re-read below — ' || format('{:,}', length(text)) || ' chars omitted]' ELSE text END AS text FROM o""")
def dedupe_keep_newest(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select(F.expr("doc_id div 400").alias("payload"), "doc_id", F.lit("tool").alias("role"), "text")
    return windows.keep_newest(d, "payload", "doc_id", "role", "text", 10).select("doc_id", "superseded", "text")


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' AND length(text) > 200 THEN substr(text, 1, 180) || E'\\n\\n[…truncated ' || (length(text) - 200) || E' chars — raise budget or call the tool with a narrower scope…]\\n\\n' || right(text, 20) ELSE text END AS text FROM conversations""")
def shrink_chars(spark, sf_dir):
    c = C.table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")))
    return windows.shrink_results(c, "role", "text", 200).select("conv_id", "turn", "text")


@query("""WITH a AS (SELECT *, max(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
 b AS (SELECT *, sum(i) OVER (PARTITION BY conv_id ORDER BY turn) AS rk, sum(i) OVER (PARTITION BY conv_id) AS n FROM a)
SELECT conv_id, turn, CASE WHEN i = 0 THEN 'prefix' WHEN rk > n - 3 THEN 'tail' ELSE 'middle' END AS section FROM b""")
def split_sections(spark, sf_dir):
    return windows.sections(C.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", 3).select("conv_id", "turn", "section")


_COUNT = "CASE WHEN len(regexp_extract_all(text, '[{}()\\[\\];=<>:,\"''/\\\\_|&*+#@$%^~`]')) > length(text) * 0.08 THEN CAST(ceil(length(text) / 3.2) AS BIGINT) ELSE length(text) // 4 END"


@query(f"""SELECT conv_id, CAST(sum(15 + {_COUNT}) AS BIGINT) AS tokens, CAST(sum(round_even(length(text) / 4.0, 0)) AS BIGINT) AS estimate FROM conversations GROUP BY conv_id""")
def conversation_tokens(spark, sf_dir):
    return C.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(windows.message_tokens(F.col("text"))).alias("tokens"), F.sum(T.estimated_tokens(F.length("text"))).alias("estimate"))


@query("""SELECT o_orderstatus, count(*) AS completed FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1""")
def completed_calls(spark, sf_dir):
    results = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return windows.completed_calls(C.table(spark, sf_dir, "orders"), results, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("completed"))


@query("""WITH c AS (SELECT user_id, arg_max(event_type, event_id) AS name FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT coalesce(c.name, 'unknown') AS name, count(*) AS n FROM events e LEFT JOIN c USING (user_id) WHERE e.event_id % 3 = 1 GROUP BY 1""")
def tool_name_resolution(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    calls = e.where("event_id % 3 = 0").select("user_id", F.col("event_type").alias("name"), "event_id")
    return windows.named_results(e.where("event_id % 3 = 1").select("user_id", F.lit(None).cast("string").alias("name")), calls, ["user_id"], "name", "event_id").groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT user_id % 50 AS user, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id DESC) <= 20""")
def raw_store_retention(spark, sf_dir):
    return windows.newest(C.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("user"), "event_id"), ["user"], "event_id", 20)


@query("""SELECT doc_id, substr(CASE WHEN len(l) > 3 THEN '[... ' || (len(l) - 3) || ' earlier lines ...]' || chr(10) || array_to_string(l[-3:], chr(10)) ELSE text END, 1, 400) AS view FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""")
def raw_store_view(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").select("doc_id", windows.stored_view(F.col("text"), 3, 400).alias("view"))


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, doc_id FROM r WHERE n <= 40 OR i IN (SELECT CAST(floor(k * n / 40.0) AS BIGINT) FROM range(40) t(k))""")
def even_sample(spark, sf_dir):
    return windows.even_sample(C.table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 40)


@query("""WITH c AS (SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS chars FROM conversations) SELECT conv_id, turn, CAST(chars AS BIGINT) AS chars FROM c WHERE role = 'assistant' AND chars >= 500""")
def progressive_snapshots(spark, sf_dir):
    c = C.table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")))
    return windows.snapshots(c, "conv_id", "turn", "role", "text", 500)


_SAVED = f"SELECT *, length(text) AS raw_chars, length(output) AS filtered_chars, CASE WHEN length(text) > 0 THEN round_even((length(text) - length(output)) * 100.0 / length(text), 0) ELSE 0 END AS pct FROM ({_HEAD_TAIL}) JOIN documents USING (doc_id)"


@query(f"""SELECT source, count(*) AS total, count(*) FILTER (doc_id % 10 = 0) AS fallbacks, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 3 = 0) AS deduped, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 3 <> 0) AS filtered, CAST(sum(raw_chars) AS BIGINT) AS raw_chars, CAST(sum(filtered_chars) AS BIGINT) AS filtered_chars, CAST(sum(round_even(raw_chars / 4.0, 0)) AS BIGINT) AS raw_tokens, CAST(sum(round_even(filtered_chars / 4.0, 0)) AS BIGINT) AS filtered_tokens,
 CAST(sum(round_even(raw_chars / 4.0, 0)) - sum(round_even(filtered_chars / 4.0, 0)) AS BIGINT) AS saved_tokens, CAST(round_even(avg(pct) FILTER (raw_chars > 0), 0) AS BIGINT) AS mean_savings_pct, TRUE AS token_counts_are_estimate FROM ({_SAVED}) GROUP BY source""")
def telemetry_summary(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("raw_chars"), F.length(filters.generic(F.col("text"), 5, 5)["output"]).alias("filtered_chars"), F.when(F.col("doc_id") % 3 == 0, "dedupe").otherwise("generic").alias("kind"), (F.col("doc_id") % 10 == 0).alias("fallback_used"))
    return telemetry.summary(telemetry.rows(d, "kind", "raw_chars", "filtered_chars"), "source")


@query("""SELECT lang, CASE WHEN length(text) < 500 THEN '<500B' WHEN length(text) < 2000 THEN '500B-2KB' WHEN length(text) < 10000 THEN '2-10KB' WHEN length(text) < 50000 THEN '10-50KB' WHEN length(text) < 100000 THEN '50-100KB' WHEN length(text) < 500000 THEN '100-500KB' ELSE '>500KB' END AS bucket, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((1), (2), (1, 2))""")
def size_buckets(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select("lang", telemetry.size_bucket(F.length("text")).alias("bucket"), F.length("text").alias("c"))
    return d.groupingSets([["lang"], ["bucket"], ["lang", "bucket"]], "lang", "bucket").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


_TYPE = "CASE role WHEN 'assistant' THEN 'model_prose' WHEN 'user' THEN 'user_text' ELSE 'other' END"


@query(f"""SELECT {_TYPE} AS type, role AS category, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({_COUNT}) AS BIGINT) AS tokens FROM conversations GROUP BY ROLLUP ({_TYPE}, role)""")
def content_type_rollup(spark, sf_dir):
    return telemetry.corpus_stats(C.table(spark, sf_dir, "conversations"), "role", "text", T.count_tokens(F.col("text")))


@query("""SELECT risk_level, CAST(sum(CASE WHEN len(l) > h + t THEN length(array_to_string(list_concat(list_concat(l[1:h], ['', '[... ' || (len(l) - h - t) || ' lines omitted ...]', '']), l[-t:]), chr(10))) ELSE length(array_to_string(l, chr(10))) END) AS BIGINT) AS chars FROM (SELECT string_split(text, chr(10)) AS l FROM documents) CROSS JOIN (VALUES ('low', 30, 45), ('balanced', 20, 30), ('high', 10, 15)) v(risk_level, h, t) GROUP BY 1""")
def risk_levels(spark, sf_dir):
    d, out = C.table(spark, sf_dir, "documents"), []
    sums = [F.sum(F.length(filters.generic(F.col("text"), (c := limits(v, {}))["generic_head"], c["generic_tail"])["output"])).alias(v) for v in LEVELS]
    pairs = ", ".join(f"'{v}', {v}" for v in LEVELS)
    return d.agg(*sums).selectExpr(f"stack({len(LEVELS)}, {pairs}) AS (risk_level, chars)")


@query(f"""SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS raw_chars, CAST(sum(CASE WHEN rk > 1 THEN length('[repeated output, occurrence ' || rk || ', raw_output_id=' || id || ']') WHEN length(t) < 500 OR len(l) <= 50 THEN length(t)
  ELSE length(array_to_string(list_concat(list_concat(l[1:20], ['', '[... ' || (len(l) - 50) || ' lines omitted ...]', '']), l[-30:]), chr(10))) + length(chr(10) || '[filtered ' || length(t) || ' chars -> ' || length(array_to_string(list_concat(list_concat(l[1:20], ['', '[... ' || (len(l) - 50) || ' lines omitted ...]', '']), l[-30:]), chr(10))) || ' chars, raw_output_id=' || id || ']') END) AS BIGINT) AS shown_chars
 FROM (SELECT *, row_number() OVER (PARTITION BY source, sha256(t) ORDER BY doc_id) AS rk, string_split(t, chr(10)) AS l FROM (SELECT *, regexp_replace(regexp_replace(text, '\\n{{3,}}', E'\\n\\n', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents))
 CROSS JOIN LATERAL (SELECT doc_id AS id) GROUP BY source""")
def filter_savings(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("output_id"), F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), F.lit("").alias("command"), F.lit("").alias("tool"), F.lit(None).cast("int").alias("exit_code"), F.lit(False).alias("timed_out"), "text")
    done = pipeline.filter_outputs(d, limits("balanced", {}), roots=())
    return done.groupBy(F.col("session_id").alias("source")).agg(F.count("*").alias("n"), F.sum("raw_chars").alias("raw_chars"), F.sum(F.length("shown")).alias("shown_chars"))


@query("""SELECT event_id, 'src/a' || event_id || '.py and lib/x.py and /other/y.py' AS plain FROM events""")
def paths_norm(spark, sf_dir):
    t = F.concat(F.lit("/work/app/src/a"), F.col("event_id"), F.lit(".py and C:\\proj\\lib\\x.py and /other/y.py"))
    return C.table(spark, sf_dir, "events").select("event_id", structured.normalize_paths(t, ("/work/app", "C:/proj")).alias("plain"))


_ITEM = """'    {' || chr(10) || '      "n": "' || p_name || '",' || chr(10) || '      "s": [... 9 items]' || chr(10) || '    }'"""


@query(f"""SELECT key, output, length(output) < raw AS truncated FROM (SELECT p_partkey AS key, 8 * (length('{{"n":"","s":[]}},') + length(p_name) + 9 * length(CAST(p_size AS VARCHAR)) + 8) - 1 + length('{{"parts":[],"long":""}}') + 9 * length(p_name) AS raw,
 '{{' || chr(10) || '  "parts": [' || chr(10) || repeat({_ITEM} || ',' || chr(10), 5) || '    ... +3 more items' || chr(10) || '  ],' || chr(10) || '  "long": "' || CASE WHEN 9 * length(p_name) > 80 THEN substr(repeat(p_name, 9), 1, 80) || '"... [' || 9 * length(p_name) || ' chars]' ELSE repeat(p_name, 9) || '"' END || chr(10) || '}}' AS output FROM part)""")
def json_nested(spark, sf_dir):
    """Nested JSON beyond every limit: recursive truncation."""
    p = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.to_json(F.struct(F.array(*[F.struct(F.col("p_name").alias("n"), F.array(*[F.col("p_size")] * 9).alias("s")) for _ in range(8)]).alias("parts"), F.repeat("p_name", F.lit(9)).alias("long"))).alias("text"))
    return structured.apply(p, "json", F.col("text"), limits("balanced", {})).select("key", "output", "truncated")


@query("""SELECT p_partkey AS key, 'import a' || chr(10) || ' [... 4 more import lines …]' || chr(10) || 'x = ' || p_size || chr(10) || '# c' || chr(10) || ' [... 5 more comment lines …]' || chr(10) || 'end' AS content, TRUE AS healed FROM part""")
def shrink_source(spark, sf_dir):
    t = F.concat(F.lit("import a\nimport bbbbbbbbbbbb\nimport cccccccccc\nimport d\nfrom e import f\nx = "), F.col("p_size"), F.lit("\n# c" + "\n# ddddddddddd" * 5 + "\nend"))
    m = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit("tool").alias("role"), F.lit("read_file").alias("name"), t.alias("content"))
    return budget.shrink_messages(m, max_chars=100).select("key", "content", "healed")


def _count(text: str) -> str:
    return _COUNT.replace("(text", f"({text}")


@query(f"""WITH c AS (SELECT conv_id, turn, role, text, length(text) AS n, {_COUNT} AS k FROM conversations), s AS (SELECT *, CAST(floor(65 * (n / k)) AS BIGINT) AS h, CAST(floor(7 * (n / k)) AS BIGINT) AS t FROM c WHERE role = 'assistant' AND n > 120 AND k > 120),
 e AS (SELECT *, substr(text, 1, h) AS head, right(text, t) AS tail FROM s), f AS (SELECT *, {_count("head")} + {_count("tail")} AS kept, length(head) + length(tail) AS chars FROM e)
SELECT conv_id, turn, head || E'\n\n[…truncated ~' || greatest(0, CAST(floor(n * (kept / chars)) AS BIGINT) - kept) || ' tokens (' || (n - chars) || E' chars) — raise budget or call the tool with a narrower scope…]\n\n' || tail AS content FROM f
UNION ALL SELECT conv_id, turn, text FROM c WHERE NOT (role = 'assistant' AND n > 120 AND k > 120)""")
def shrink_tokens(spark, sf_dir):
    c = C.table(spark, sf_dir, "conversations")
    m = c.select("conv_id", "turn", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), F.lit("search").alias("name"), F.col("text").alias("content"))
    return budget.shrink_messages(m, max_tokens=120).select("conv_id", "turn", "content")


def _shown(n: str) -> str:
    return f"CASE WHEN {n} >= 1000000 THEN format('{{:.1f}}M', {n} / 1e6) WHEN {n} >= 1000 THEN format('{{:.1f}}k', {n} / 1e3) ELSE CAST({n} AS VARCHAR) END"


@query(f"""SELECT lang, 'tool output raw: ' || {_shown('r')} || ' chars' || chr(10) || 'tool output filtered: ' || {_shown('f')} || ' chars' || chr(10) || '~saved: ' || {_shown('s')} || ' tokens' || chr(10) || 'average savings: ' || pct || '%' || chr(10) || 'dedupes: ' || d || chr(10) || 'fallbacks: ' || b AS text
 FROM (SELECT lang, CAST(sum(raw_chars) AS BIGINT) AS r, CAST(sum(filtered_chars) AS BIGINT) AS f, CAST(sum(round_even(raw_chars / 4.0, 0)) - sum(round_even(filtered_chars / 4.0, 0)) AS BIGINT) AS s, CAST(round_even(avg(pct), 0) AS BIGINT) AS pct, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 3 = 0) AS d, count(*) FILTER (doc_id % 10 = 0) AS b FROM ({_SAVED}) GROUP BY lang)""")
def telemetry_text(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select("lang", "doc_id", F.length("text").alias("raw_chars"), F.length(filters.generic(F.col("text"), 5, 5)["output"]).alias("filtered_chars"), F.when(F.col("doc_id") % 3 == 0, "dedupe").otherwise("generic").alias("kind"), (F.col("doc_id") % 10 == 0).alias("fallback_used"))
    return telemetry.summary_text(telemetry.summary(telemetry.rows(d, "kind", "raw_chars", "filtered_chars"), "lang")).select("lang", "text")
