"""Queries over messages, their budgets, the payload strategies, and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import limits
from ..functions import text as T
from ..operators import budget, facts, telemetry, windows
from ..sources import corpora as C
from . import pipeline
from .registry import query

_MARKS = "[{}()\\[\\];=<>:,\"''/\\\\_|&*+#@$%^~`]"


def count_sql(text: str) -> str:
    """Tokens of a text, as functions.text.count_tokens has it."""
    return f"(CASE WHEN len(regexp_extract_all({text}, '{_MARKS}')) > length({text}) * 0.08 THEN CAST(ceil(length({text}) / 3.2) AS BIGINT) ELSE length({text}) // 4 END)"


def _calls(df, tool: str, command, result, id_: str):
    args = F.create_map(F.lit("command"), command) if tool == "Bash" else command
    return df.select(F.col(id_).alias("tool_call_id"), F.lit(tool).alias("tool_name"), args.alias("args"), result.alias("result"), F.lit(3).alias("turn"))


@query("""WITH e AS (SELECT event_id AS tool_call_id, '[Bash] ' AS b, event_id FROM events)
SELECT tool_call_id, 'Bash' AS source_tool, b || 'test: ' || (event_id % 40) || ' passed' AS content, 'tool_result' AS fact_type, 1.0::DOUBLE AS confidence FROM e
UNION ALL SELECT tool_call_id, 'Bash', b || 'test: ' || (event_id % 3) || ' failed', 'error', 1.0 FROM e
UNION ALL SELECT tool_call_id, 'Bash', b || 'test: 4 warnings', 'tool_result', 1.0 FROM e WHERE event_id % 5 = 0
UNION ALL SELECT tool_call_id, 'Bash', b || 'FAILED: a/t' || event_id || '.py::x', 'error', 1.0 FROM e""")
def facts_test(spark, sf_dir):
    extra = F.when(F.col("event_id") % 5 == 0, ", 4 warnings").otherwise("")
    t = F.concat(F.lit("ran:\n\x1b[31m"), F.col("event_id") % 40, F.lit(" passed\x1b[0m, "), F.col("event_id") % 3, F.lit(" failed"), extra, F.lit(" in 2s\nFAILED a/t"), F.col("event_id"), F.lit(".py::x[p1] - boom"))
    return facts.fact_rows(facts.extracted(_calls(C.table(spark, sf_dir, "events"), "Bash", F.lit("pytest -q"), t, "event_id")))


@query("""SELECT o_orderkey // 500 AS tool_call_id, 'Bash' AS source_tool, '[Bash] git log: ' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 9) || ' order ' || o_orderkey AS content, 'tool_result' AS fact_type, 1.0::DOUBLE AS confidence FROM orders""")
def facts_git_log(spark, sf_dir):
    o = C.table(spark, sf_dir, "orders").withColumn("k", F.expr("o_orderkey div 500"))
    t = C.lines_of(o, "k", "o_orderkey", F.concat(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 9), F.lit(" order "), F.col("o_orderkey")))
    return facts.fact_rows(facts.extracted(_calls(t, "Bash", F.lit("git log --oneline"), F.col("text"), "key")))


@query("""SELECT p_partkey AS tool_call_id, CASE WHEN p_partkey % 2 = 0 THEN '[Bash] git status: ' || p_brand || '/f' || p_partkey || '.py; [Bash] git status: n' || p_partkey || '.py' ELSE '[Bash] git diff file: f' || p_partkey || '.py; [Bash] git diff file: f' || p_partkey || '.py' END AS contents,
 CASE WHEN p_partkey % 2 = 0 THEN p_brand || '/f' || p_partkey || '.py; n' || p_partkey || '.py' ELSE 'f' || p_partkey || '.py; f' || p_partkey || '.py' END AS files FROM part""")
def facts_paths(spark, sf_dir):
    p, even, key = C.table(spark, sf_dir, "part"), F.col("p_partkey") % 2 == 0, F.col("p_partkey")
    status = F.concat(F.lit("On branch main\n\tmodified:   "), F.col("p_brand"), F.lit("/f"), key, F.lit(".py  \n\tnew file:   n"), key, F.lit(".py\n\nnothing else"))
    diff = F.concat(F.lit("diff --git a/x b/x\n--- a/f"), key, F.lit(".py\n+++ b/f"), key, F.lit(".py\n@@ -1 +1 @@\n-a\n+b"))
    got = facts.extracted(_calls(p, "Bash", F.when(even, "git status").otherwise("git diff HEAD"), F.when(even, status).otherwise(diff), "p_partkey"))
    return got.select("tool_call_id", F.array_join(F.transform("facts", lambda f: f["content"]), "; ").alias("contents"), F.array_join("files_touched", "; ").alias("files"))


@query("""SELECT event_id AS tool_call_id, 'Bash' AS source_tool, CASE event_id % 3 WHEN 0 THEN '[Bash] build error: bad ' || event_id WHEN 1 THEN '[Bash] lint error: bad ' || event_id ELSE '[Bash] python3 a.py (errors detected)' END AS content,
 CASE WHEN event_id % 3 < 2 THEN 'error' ELSE 'tool_result' END AS fact_type, CASE WHEN event_id % 3 < 2 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM events""")
def facts_errors(spark, sf_dir):
    k = F.col("event_id") % 3
    command = F.when(k == 0, "make all").when(k == 1, "ruff check .").otherwise("python3 a.py")
    t = F.concat(F.lit("step\nError: bad "), F.col("event_id"), F.lit("  \ndone"))
    return facts.fact_rows(facts.extracted(_calls(C.table(spark, sf_dir, "events"), "Bash", command, t, "event_id")))


@query("""SELECT p_partkey AS tool_call_id, '[Read] ' || CASE p_partkey % 3 WHEN 0 THEN 'src/a' || p_partkey WHEN 1 THEN 'lib/b' || p_partkey ELSE CASE WHEN p_partkey % 2 = 0 THEN 'import a' ELSE 'x = ' || p_size END END || ' read at turn 3' || CASE WHEN p_partkey % 2 = 0 THEN ' (6 lines) — import-heavy' ELSE '' END AS content, 'file_state' AS fact_type FROM part""")
def facts_read(spark, sf_dir):
    k, name = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    args = F.when(k == 0, F.create_map(F.lit("file_path"), F.concat(F.lit("src/a"), name))).when(k == 1, F.create_map(F.lit("target_file"), F.concat(F.lit("lib/b"), name))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    t = F.concat(F.when(F.col("p_partkey") % 2 == 0, "import a\nimport b\nfrom c import d\nimport e\n").otherwise(""), F.lit("x = "), F.col("p_size"), F.lit("\ny = 1"))
    return facts.fact_rows(facts.extracted(_calls(C.table(spark, sf_dir, "part"), "Read", args, t, "p_partkey"))).select("tool_call_id", "content", "fact_type")


@query("""SELECT o_orderstatus, count(*) AS open FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 3) GROUP BY 1""")
def open_calls(spark, sf_dir):
    results = C.table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return windows.completed_calls(C.table(spark, sf_dir, "orders"), results, ["o_orderkey"], completed=False).groupBy("o_orderstatus").agg(F.count("*").alias("open"))


def _payloads(spark, sf_dir):
    """Conversations as JSON payloads; every assistant's message has a call."""
    call = F.array(F.struct(F.concat(F.lit("c"), F.col("turn")).alias("id"), F.struct(F.lit("read").alias("name"), F.lit('{"path": "a"}').alias("arguments")).alias("function")))
    m = F.struct("turn", F.struct("role", F.when(F.col("role") != "assistant", F.col("text")).alias("content"), F.when(F.col("role") == "assistant", call).alias("tool_calls")).alias("m"))
    rows = C.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("payload_id")).agg(F.array_sort(F.collect_list(m)).alias("ms"))
    return rows.select("payload_id", F.to_json(F.transform("ms", lambda x: x["m"])).alias("messages"))


@query("""SELECT conv_id AS payload_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx, role, CASE WHEN role <> 'assistant' THEN text END AS content, CASE WHEN role = 'assistant' THEN 'c' || turn || ' function read {"path": "a"}' END AS call FROM conversations""")
def message_rows(spark, sf_dir):
    """Payloads of JSON to rows, to JSON, and to rows again."""
    once = budget.parsed_messages(_payloads(spark, sf_dir))
    c = F.col("tool_calls")[0]
    return budget.parsed_messages(budget.written_messages(once)).select("payload_id", "idx", "role", "content", F.concat_ws(" ", c["id"], c["type"], c["function"]["name"], c["function"]["arguments"]).alias("call")).withColumn("call", F.nullif("call", F.lit("")))


_NOTE = "'{\"path\": \"p' || p_partkey || '\", \"content\": \"[\\u2026shrunk: ' || 60 * length(p_name) || ' chars, 1 lines \\u2014 tool already responded, see result]\", \"n\": ' || p_size || '}'"
_ARGS = "'{\"path\":\"p' || p_partkey || '\",\"content\":\"' || repeat(p_name, 60) || '\",\"n\":' || p_size || '}'"


@query(f"""SELECT p_partkey AS payload_id, CASE WHEN p_size % 2 = 0 THEN '{{"a": 1}}' ELSE {_NOTE} END AS arguments, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS healed,
 CASE WHEN p_size % 2 = 0 THEN 0 ELSE {count_sql('(' + _ARGS + ')')} - {count_sql('(' + _NOTE + ')')} END AS tokens_saved, CASE WHEN p_size % 2 = 0 THEN 0 ELSE length({_ARGS}) - length({_NOTE}) END AS chars_saved FROM part""")
def shrink_call_args(spark, sf_dir):
    args = F.when(F.col("p_size") % 2 == 0, '{"a": 1}').otherwise(F.to_json(F.struct(F.concat(F.lit("p"), F.col("p_partkey")).alias("path"), F.repeat("p_name", F.lit(60)).alias("content"), F.col("p_size").alias("n"))))
    call = F.array(F.struct(F.lit("c").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("write").alias("name"), args.alias("arguments")).alias("function")))
    m = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("payload_id"), F.lit(0).alias("idx"), F.lit("assistant").alias("role"), call.alias("tool_calls"))
    out = pipeline.shrink_calls(m, 40)
    return out.select("payload_id", F.col("tool_calls")[0]["function"]["arguments"].alias("arguments"), F.col("calls_healed").alias("healed"), F.col("calls_tokens_saved").alias("tokens_saved"), F.col("calls_chars_saved").alias("chars_saved"))


@query(f"""SELECT conv_id, count(*) FILTER (n > 200) AS healed_count, CAST(coalesce(sum(n) FILTER (n > 200), 0) AS BIGINT) AS healed_from, CAST(coalesce(sum(greatest(0, {count_sql('text')} - {count_sql('new')})) FILTER (n > 200), 0) AS BIGINT) AS tokens_saved, CAST(coalesce(sum(greatest(0, n - length(new))) FILTER (n > 200), 0) AS BIGINT) AS chars_saved
 FROM (SELECT conv_id, text, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS n, substr(text, 1, 180) || E'\\n\\n[…truncated ' || (length(text) - 200) || E' chars — raise budget or call the tool with a narrower scope…]\\n\\n' || right(text, 20) AS new FROM conversations) GROUP BY conv_id""")
def shrink_totals(spark, sf_dir):
    m = C.table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), F.lit("grep").alias("name"), F.col("text").alias("content"))
    return budget.shrink_totals(budget.shrink_messages(m, max_chars=200), "conv_id")


@query("""SELECT p_partkey AS key, 'def f' || p_partkey || '(x):' || chr(10) || 'class C' || p_size || ':' || E'\\n\\n[…read_file compressed: 43 non-declaration lines omitted…]\\n\\n' AS content FROM part""")
def shrink_source_tokens(spark, sf_dir):
    t = F.concat(F.lit("import os\nimport re\n" + "    a body line of words\n" * 40 + "def f"), F.col("p_partkey"), F.lit("(x):\n    pass\nclass C"), F.col("p_size"), F.lit(":"))
    m = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit("tool").alias("role"), F.lit("read_file").alias("name"), t.alias("content"))
    return budget.shrink_messages(m, max_tokens=100).select("key", "content")


@query(f"""SELECT conv_id, CAST(sum(15 + {count_sql('text')}) + {count_sql("'read(path): reads a file'")} AS BIGINT) AS tokens FROM conversations GROUP BY conv_id""")
def request_tokens(spark, sf_dir):
    c = C.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(windows.message_tokens(F.col("text"))).alias("t"))
    return c.select("conv_id", budget.request_tokens(F.col("t"), "read(path): reads a file").alias("tokens"))


@query("""SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS tool_chars FROM conversations GROUP BY conv_id""")
def tool_content_chars(spark, sf_dir):
    m = C.table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))
    return telemetry.tool_chars(m, "conv_id")


@query("""WITH c AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS chars, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS latest FROM conversations),
 big AS (SELECT conv_id, turn FROM c WHERE role = 'assistant' AND chars >= 2000), s AS (SELECT * FROM big UNION ALL SELECT conv_id, turn FROM c WHERE role = 'assistant' AND turn = latest AND conv_id NOT IN (SELECT conv_id FROM big))
SELECT s.conv_id, s.turn AS snapshot, count(*) AS messages, CAST(sum(length(c.text)) AS BIGINT) AS chars FROM s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn <= s.turn GROUP BY 1, 2""")
def snapshot_messages(spark, sf_dir):
    c = C.table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")))
    chosen = windows.snapshots(c, "conv_id", "turn", "role", "text", 2000, last=1)
    return windows.expanded(c, chosen, "conv_id", "turn").groupBy("conv_id", "snapshot").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () // 64 AS step FROM documents) WHERE i % step = 0 AND i < 64 * step""")
def every_nth_document(spark, sf_dir):
    return windows.every_nth(C.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64)


@query("""WITH e AS (SELECT user_id % 50 AS user, event_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS raw_id, count(*) OVER (PARTITION BY user_id % 50) AS n FROM events)
SELECT user, event_id, raw_id, 256000 AS chars FROM e WHERE raw_id > n - 20""")
def raw_store_ids(spark, sf_dir):
    e = C.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("user"), "event_id", F.lit("x").alias("raw"))
    kept = windows.stored(e.withColumn("raw", F.repeat("raw", F.lit(256_001))), "user", "event_id", "raw", keep=20)
    return kept.select("user", "event_id", "raw_id", F.length("raw").alias("chars"))


def _solo(spark, sf_dir):
    """Payloads whose assistants write files and whose tools answer with lists of lines or repeats."""
    turn, name = F.col("turn"), F.concat(F.lit("f"), F.col("turn"))
    answer = F.when(turn % 3 == 1, F.concat(F.lit("same "), F.col("conv_id"), F.repeat(F.lit(" ab"), F.lit(100)))).otherwise(F.concat(F.lit("first"), F.repeat(F.concat(F.lit("\nentry "), turn, F.lit(" of "), F.col("conv_id")), (turn + 69).cast("int"))))
    args = F.to_json(F.struct(name.alias("file_path"), F.repeat(F.lit("word "), F.lit(200)).alias("content")))
    call = F.array(F.struct(F.concat(F.lit("c"), turn).alias("id"), F.lit("function").alias("type"), F.struct(F.lit("Write").alias("name"), args.alias("arguments")).alias("function")))
    tool, asks = F.col("role") == "assistant", F.col("role") == "user"
    return C.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("payload_id"), turn.alias("idx"), F.when(tool, "tool").when(asks, "assistant").otherwise(F.col("role")).alias("role"), F.when(tool, answer).when(~asks, F.col("text")).alias("content"),
        F.when(asks, call).alias("tool_calls"), F.when(tool, F.concat(F.lit("c"), turn - 1)).alias("tool_call_id"), F.when(tool, F.when(turn % 3 == 1, "read_file").otherwise("my_grep")).alias("name"),
    )


_SOLO = """c AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'tool' WHEN 'user' THEN 'assistant' ELSE role END AS role, CASE WHEN turn % 3 = 1 THEN 'same ' || conv_id || repeat(' ab', 100) ELSE 'first' || repeat(chr(10) || 'entry ' || turn || ' of ' || conv_id, CAST(turn + 69 AS BIGINT)) END AS content FROM conversations),
 f AS (SELECT *, min(turn) FILTER (role <> 'system') OVER (PARTITION BY conv_id) AS first FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk, count(*) FILTER (turn >= first) OVER (PARTITION BY conv_id) AS n FROM f),
 d AS (SELECT *, CASE WHEN turn < first OR first IS NULL THEN 'prefix' WHEN rk <= 2 THEN 'tail' ELSE 'middle' END AS section, n > 2 AS has_middle, 'entry ' || turn || ' of ' || conv_id AS e FROM r),
 w AS (SELECT *, CASE WHEN role = 'assistant' AND EXISTS (SELECT 1 FROM c t WHERE t.conv_id = d.conv_id AND t.turn = d.turn + 1 AND t.role = 'tool') THEN 1000 + length('{"file_path":"f","content":""}') - length('{"file_path": "f", "content": "[written, 1 lines, 1,000 chars -- use Read on f to review]"}') - length(CAST(turn AS VARCHAR)) ELSE 0 END AS compact,
  CASE WHEN role = 'tool' AND section = 'middle' AND turn % 3 <> 1 THEN 'first' || repeat(chr(10) || e, 9) || chr(10) || chr(10) || '[... ' || (turn + 45) || ' lines omitted ...]' || chr(10) || repeat(chr(10) || e, 15) END AS short FROM d),
 x AS (SELECT *, CASE WHEN short IS NOT NULL THEN short || chr(10) || '[filtered ' || length(content) || ' chars -> ' || length(short) || ' chars, raw_output_id=' || turn || ']'
   WHEN role = 'tool' AND section = 'tail' AND length(content) > 240 THEN substr(content, 1, 216) || E'\\n\\n[…truncated ' || (length(content) - 240) || E' chars — raise budget or call the tool with a narrower scope…]\\n\\n' || right(content, 24) ELSE content END AS c1 FROM w),
 y AS (SELECT *, CASE WHEN role = 'tool' AND length(c1) >= 200 AND turn < max(turn) FILTER (role = 'tool') OVER (PARTITION BY conv_id, c1) AND NOT (section = 'tail' AND has_middle) THEN '[superseded by identical re-read below — ' || format('{:,}', length(c1)) || ' chars omitted]' ELSE c1 END AS c2 FROM x),
 z AS (SELECT *, CASE WHEN role = 'tool' AND NOT (section = 'tail' AND has_middle) AND length(c2) > 200 THEN substr(c2, 1, 180) || E'\\n\\n[…truncated ' || (length(c2) - 200) || E' chars — raise budget or call the tool with a narrower scope…]\\n\\n' || right(c2, 20) ELSE c2 END AS c3 FROM y)"""


@query(f"""WITH {_SOLO}, s AS (SELECT conv_id AS payload_id, CAST(sum(compact) AS BIGINT) AS compact, CAST(coalesce(sum(length(content) - length(c1)) FILTER (role = 'tool'), 0) AS BIGINT) AS filter, CAST(coalesce(sum(length(c1) - length(c2)) FILTER (role = 'tool'), 0) AS BIGINT) AS dedup, CAST(coalesce(sum(length(c2) - length(c3)) FILTER (role = 'tool'), 0) AS BIGINT) AS shrink FROM z GROUP BY 1)
SELECT *, compact + filter + dedup + shrink AS total, concat_ws(',', CASE WHEN compact > 0 THEN 'compact' END, CASE WHEN filter > 0 THEN 'filter' END, CASE WHEN dedup > 0 THEN 'dedup' END, CASE WHEN shrink > 0 THEN 'shrink' END) AS strategies, CAST(NULL AS VARCHAR) AS skipped_reason FROM s""")
def agent_solo(spark, sf_dir):
    """All four payload strategies; their savings by payload."""
    stats = pipeline.compress_payloads(_solo(spark, sf_dir), limits("high", {}), keep_tail=2, max_tokens=50, tail_tokens=60, filter_middle=True, dedup=True, shrink=True)[1]
    return stats.withColumn("strategies", F.concat_ws(",", "strategies"))


@query(f"""WITH {_SOLO} SELECT conv_id AS payload_id, turn AS idx, role, CASE WHEN role = 'tool' THEN md5(c3) WHEN role <> 'assistant' THEN 'spoken' END AS content FROM z""")
def agent_solo_messages(spark, sf_dir):
    out = pipeline.compress_payloads(_solo(spark, sf_dir), limits("high", {}), keep_tail=2, max_tokens=50, tail_tokens=60, filter_middle=True, dedup=True, shrink=True)[0]
    return out.select("payload_id", "idx", "role", F.when(F.col("role") == "tool", F.md5("content")).when(F.col("role") != "assistant", "spoken").alias("content"))


@query(f"""WITH {_SOLO} SELECT conv_id AS payload_id, CAST(sum(compact) AS BIGINT) AS total, CASE WHEN sum(compact) > 0 THEN 'compact' ELSE '' END AS strategies, CASE WHEN sum(compact) = 0 THEN 'no_strategies_enabled' END AS skipped_reason FROM z GROUP BY 1""")
def agent_solo_defaults(spark, sf_dir):
    """What is on by default: arguments of completed writes."""
    stats = pipeline.compress_payloads(_solo(spark, sf_dir), limits("high", {}))[1]
    return stats.select("payload_id", "total", F.concat_ws(",", "strategies").alias("strategies"), "skipped_reason")


@query()
def strategy_sweep(spark, sf_dir):
    """Every set of strategies, the best first."""
    return pipeline.strategy_sweep(_solo(spark, sf_dir), limits("high", {}), keep_tail=2, max_tokens=50, tail_tokens=60)


@query("""SELECT tool, regexp_matches(lower(tool), '(^|_)(search|grep|rg|ripgrep|search_content|find|fd|locate|web_fetch|webfetch|fetch|web_search|websearch|list_directory|listdir|ls|glob|bash|shell|run_command|execute)$') AS compressible FROM (SELECT DISTINCT CASE event_id % 8 WHEN 0 THEN 'Grep' WHEN 1 THEN 'mcp__x__search' WHEN 2 THEN 'my_find' WHEN 3 THEN 'read_file' WHEN 4 THEN 'bash_runner' WHEN 5 THEN 'WebFetch' WHEN 6 THEN 'cat' ELSE 'list_dir' END AS tool FROM events)""")
def compressible_tools(spark, sf_dir):
    tool = C.picked(("Grep", "mcp__x__search", "my_find", "read_file", "bash_runner", "WebFetch", "cat", "list_dir"), "event_id")
    return C.table(spark, sf_dir, "events").select(tool.alias("tool")).distinct().withColumn("compressible", pipeline.is_compressible(F.col("tool")))


@query("""SELECT lang, 3 * count(*) AS n, round(median(length(text)), 3) AS median_ms, round(quantile_cont(length(text), 0.95), 3) AS p95_ms FROM documents GROUP BY lang""")
def run_times(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select("lang", F.length("text").cast("double").alias("ms"))
    times = telemetry.run_times(d, ["lang"], "ms").select("lang", F.round("median_ms", 3).alias("median_ms"), F.round("p95_ms", 3).alias("p95_ms"))
    return times.join(d.groupBy("lang").agg((3 * F.count("*")).alias("n")), "lang")


@query(f"""SELECT lang, CAST(sum({count_sql('text')}) AS BIGINT) AS raw_tokens, CAST(sum({count_sql('substr(text, 1, 100)')}) AS BIGINT) AS filtered_tokens, FALSE AS token_counts_are_estimate, count(*) AS total FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 100 GROUP BY lang""")
def telemetry_counted(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select("lang", "doc_id", "text", F.length("text").alias("raw_chars"), F.length(F.substring("text", 1, 100)).alias("filtered_chars"), F.lit("generic").alias("kind"), F.lit(False).alias("fallback_used"))
    rows = telemetry.rows(d, "kind", "raw_chars", "filtered_chars", T.count_tokens(F.col("text")), T.count_tokens(F.substring("text", 1, 100)))
    return telemetry.summary(telemetry.retained(rows, "lang", "doc_id", 100), "lang").select("lang", "raw_tokens", "filtered_tokens", "token_counts_are_estimate", "total")
