"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from sieveline.config import limits
from sieveline.operators import telemetry, windows
from sieveline.plans import catalogue, pipeline
from sieveline.sources import corpora, sessions, sinks
from sieveline.streaming import dedupe

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(df, columns):
    return sorted(tuple("" if pd.isna(v) is True else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    clean = lambda r: [tuple("" if x in ("<NA>", "nan", "NaT") else x.removesuffix(".0") for x in t) for t in r]
    assert clean(rows(got, columns)) == clean(rows(want, columns))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert catalogue.entry(spark, SF).count() > 0


def test_repeats_in_stream_and_batch(spark, tmp_path):
    data = [("s", k, "t%d" % (k % 3)) for k in range(9)] + [("r", k, "same") for k in range(4)] + [("n", 1, None), ("n", 2, None)]
    df = spark.createDataFrame(data, "session_id string, seq long, text string")
    want = {(r.session_id, r.seq): r.occurrence for r in dedupe.batch(df).collect()}
    assert want["s", 8] == 3 and want["r", 3] == 4 and want["n", 2] == 1
    df.write.parquet(str(tmp_path / "in"))
    live = dedupe.stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.format("memory").queryName("repeats").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.session_id, r.seq): r.occurrence for r in spark.sql("select * from repeats").collect()} == want


def test_fifo_forgets(monkeypatch):

    monkeypatch.setattr(dedupe, "KEPT", 2)
    frame = pd.DataFrame({"session_id": ["s"] * 5, "seq": range(5), "text": ["a", "b", "a", "c", "a"]})
    assert dedupe.count_repeats(frame, {}).occurrence.tolist() == [1, 1, 2, 1, 1]


def test_stream_numbers_and_savings(spark, tmp_path):
    rows = [("s", k, "2026-01-01 00:%02d:00" % k, "generic", 100, 40) for k in range(20)]
    df = spark.createDataFrame(rows, "session_id string, seq long, at string, filter_kind string, raw_chars long, filtered_chars long").withColumn("ts", F.to_timestamp("at")).drop("at")
    for name, part in (("a", df.where("seq < 12")), ("b", df.where("seq >= 12"))):
        part.coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path))
    for name, make, mode in (("ids", dedupe.numbered, "append"), ("saved", dedupe.live_savings, "complete")):
        make(read()).writeStream.format("memory").outputMode(mode).queryName(name).option("checkpointLocation", str(tmp_path / ("cp_" + name))).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.raw_id for r in spark.table("ids").collect()) == list(range(1, 21))
    got = spark.table("saved").collect()
    assert len(got) == 4 and all((r.n, r.raw_chars, r.filtered_chars) == (5, 500, 200) for r in got)


def _outputs(spark, texts):
    rows = [(k, "s", k, "", "web_fetch", None, False, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "output_id long, session_id string, seq long, command string, tool string, exit_code int, timed_out boolean, text string")


def test_plan_forgets_and_can_be_off(spark):
    texts = ["a", "b", "a", "c", "a", "a"]
    run = lambda **how: [r.occurrence for r in pipeline.filter_outputs(_outputs(spark, texts), limits("balanced", {}), **how).orderBy("output_id").collect()]
    assert run(on=True) == [1, 1, 2, 1, 3, 4] and run(on=True, kept=2) == [1, 1, 2, 1, 1, 2]
    off = pipeline.filter_outputs(_outputs(spark, ["AKIA" + "A" * 16]), limits("balanced", {}), on=False).first()
    assert off.shown == off.text and off.stage == "off"
    nothing = pipeline.filter_outputs(_outputs(spark, [None, "", None]), limits("balanced", {}), on=True).orderBy("output_id").collect()
    assert [r.shown for r in nothing] == [None, "", None]


def test_verbose_commands_get_more(spark):
    text = "\n".join(f"line {k} of a long output" for k in range(90))
    df = _outputs(spark, [text, "x" + text]).withColumn("command", F.when(F.col("seq") == 0, "foo").otherwise("foo --verbose"))
    got = [r.shown.count("line") for r in pipeline.filter_outputs(df, limits("balanced", {}), on=True).orderBy("output_id").collect()]
    assert got == [51, 90]


def test_sinks_and_files(spark, tmp_path):
    m = spark.createDataFrame([(1, 0, "user", "hi", None, None, None), (1, 1, "assistant", None, [("c", "function", ("f", "{}"))], None, None)], "payload_id int, idx int, role string, content string, tool_calls array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>, tool_call_id string, name string")
    sinks.write_payloads(m, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().messages == '[{"role":"user","content":"hi"},{"role":"assistant","content":null,"tool_calls":[{"id":"c","type":"function","function":{"name":"f","arguments":"{}"}}]}]'
    page = sinks.write_report(spark.createDataFrame([("a|b", 12345, 1.25)], "x string, n int, p double"), str(tmp_path / "report"), "Sums")
    assert "| a\\|b | 12,345 | 1.2 |" in page and spark.read.text(str(tmp_path / "report" / "markdown"), wholetext=True).first().value.strip() == page.strip()
    sinks.write_table(m.select("payload_id", "role"), str(tmp_path / "table"), "role")
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    (tmp_path / "logs").mkdir()
    for k in range(3):
        (tmp_path / "logs" / f"{k}.jsonl").write_text('{"type": "compacted", "payload": {"data": "x"}}\n' * (k + 1))
    found = sessions.largest_files(spark, str(tmp_path / "logs"), 2).collect()
    assert [os.path.basename(r.path) for r in found] == ["2.jsonl", "1.jsonl"] and sessions.items(sessions.read_lines(spark, str(tmp_path / "logs"))).count() == 6


def test_store_lookup(spark):
    s = spark.createDataFrame([("abc1", 1), ("abc2", 3), ("x", 2)], "id string, time_updated long")
    assert sessions.session_of(s, "abc2") == "abc2" and [r.id for r in sessions.listed_sessions(s, 2).collect()] == ["abc2", "x"]
    for prefix in ("abc", "none"):
        with pytest.raises(ValueError):
            sessions.session_of(s, prefix)
    assert sessions.schemas({"session": s}) == [("session", "id", "string"), ("session", "time_updated", "bigint")]


def test_sweep_is_ranked(spark):
    got = [r.saved for r in catalogue.QUERIES["strategy_sweep"](spark, SF).collect()]
    assert len(got) == 7 and got == sorted(got, reverse=True) and got[0] > 0


def test_arguments_survive_anything(spark):
    kept = ["[1, 2]", "nonsense", '{"content": 5}', "null", '{"content": "' + "x" * 100 + '"}']
    df = spark.createDataFrame([(x,) for x in kept], "a string")
    assert [r[0] for r in df.select(pipeline.compact_arguments(F.col("a"), F.lit("Write"))).collect()] == kept
    assert "unparsed" in df.select(pipeline.shrink_arguments(F.repeat("a", F.lit(40)))).collect()[1][0]


def test_content_types(spark):
    df = spark.createDataFrame([("tool_result/view_image", ""), ("tool_result/Bash", ""), ("mcp_result/x", "A=" * 60), ("mcp_result/x", "plain"), ("odd", "")], "c string, s string")
    assert [r[0] for r in df.select(telemetry.content_type(F.col("c"), F.col("s"))).collect()] == ["base64/image", "cli_output", "base64/image", "json_api", "other"]


@pytest.mark.parametrize("name", ["part", "customer", "events"])
def test_rows_of_one_row_group_are_dealt(spark, name):
    tasks = corpora.table(spark, SF, name).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= spark.sparkContext.defaultParallelism


def test_no_filter_asks_for_a_key(spark):
    """A filter on what a text gives would be evaluated below, written out as often as the text is used."""
    plan = catalogue.QUERIES["filter_stages"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter " in x[:80] and "c_custkey" in x]


def test_outputs_without_key_are_no_repeats(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 1, None), ("s", 2, "a"), ("s", 3, "a")], "s string, q long, k string")
    assert [(r.q, r.occurrence) for r in windows.repeats(df, "s", "q", "k", ["q"]).collect()] == [(3, 2)]


def test_savings_by_tool_of_odd_texts(spark, tmp_path):
    lines = "\n".join(f"l{k}" for k in range(12))
    texts = [("blank", "x\n\n\n" * 8), ("head", "$ cmd\n[exit 0]\n" + lines), ("lead", "\n\n" + lines), ("frames", "Error: x\n" + "    at org.apache.A.b(A.java:1)\n" * 12 + "end"), ("empty", ""), ("some", ""), ("some", "abc"), ("none", None), ("some", None), ("white", " \n\t\nx\n" * 9)]
    spark.createDataFrame(texts, "source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = catalogue.QUERIES["savings_by_tool"](spark, str(tmp_path)).toPandas(), c.sql(catalogue.ORACLE_SQL["savings_by_tool"]).df()
    columns = sorted(got.columns)
    clean = lambda r: [tuple("" if x in ("<NA>", "nan") else x.removesuffix(".0") for x in t) for t in r]
    assert clean(rows(got, columns)) == clean(rows(want, columns))


def test_facts_are_found_once(spark):
    """The explosion asks for no size of what is found, as that would find it a second time."""
    plan = catalogue.QUERIES["facts_errors"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter " in x[:80] and "size(" in x]


def test_filters_on_what_rows_give_stay_behind_the_dealing(spark):
    """Below it one task may read all rows, and would evaluate them."""
    plan = catalogue.QUERIES["session_conversation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = [plan[k + 1] for k, x in enumerate(plan) if "RepartitionByExpression" in x]
    assert below and not [x for x in below if "from_json" in x or "get_json_object" in x]
