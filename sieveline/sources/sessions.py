"""Session logs: JSON lines of two layouts, and rows of a store exported as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines as L
from ..operators.windows import named_results

_ITEM = "type string, payload struct<type:string,call_id:string,name:string,arguments:string,output:string,content:string,result:string,summary:string,base_instructions:string,dynamic_tools:string,data:string,user_instructions:string>"
_LISTS = "payload struct<output:array<string>,content:array<string>,summary:array<string>,result:array<string>>"
_BLOCK = "type string, text string, thinking string, id string, name string, input string, tool_use_id string, content string"
_PART = "struct<type:string,text:string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session, pos, line) of text files; the file is the session, pos grows along it."""
    return spark.read.text(path).select(F.input_file_name().alias("session"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def largest_files(spark: SparkSession, folder: str, most: int = 5, glob: str = "*.jsonl") -> DataFrame:
    """(path, length) of the largest files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length").orderBy(F.desc("length"), "path").limit(most)


def _row(category: Column | str, text: Column) -> Column:
    return F.struct((F.lit(category) if isinstance(category, str) else category).alias("category"), text.alias("text"))


def _named(kind: str, name: Column) -> Column:
    return F.concat(F.lit(kind + "/"), F.coalesce(name, F.lit("unknown")))


def items(lines: DataFrame) -> DataFrame:
    """lines(session, pos, line) to (session, pos, category, name, text) of logs whose lines are typed items.
    Results get the name of their call, the last of its id, by a join on session and id; results that are
    lists give a row per item, as written. Lines that aren't JSON and empty texts are left out."""
    p, l = F.col("i.payload"), F.col("l.payload")  # noqa: E741
    parsed = lines.select("session", "pos", F.from_json("line", _ITEM).alias("i"), F.from_json("line", _LISTS).alias("l"))
    item = F.when(F.col("i.type").isin("response_item", "event_msg"), F.coalesce(p["type"], F.lit(""))).otherwise(F.coalesce(F.col("i.type"), F.lit("")))
    parsed = parsed.select("session", "pos", F.concat(F.when(F.col("i.type") == "event_msg", "event ").otherwise(""), item).alias("kind"), p.alias("p"), l.alias("l"))
    calls = parsed.where("kind = 'function_call' and p.call_id != ''").select("session", F.col("p.call_id").alias("id"), "pos", F.coalesce("p.name", F.lit("unknown")).alias("name"))
    kind, p, l = F.col("kind"), F.col("p"), F.col("l")  # noqa: E741
    out = parsed.withColumns({"id": F.when(kind == "function_call_output", p["call_id"]), "name": p["name"]})
    results = named_results(out.where("kind = 'function_call_output'"), calls, ["session", "id"], "name", "pos")
    out = out.where("kind <> 'function_call_output'").withColumn("name", F.coalesce("name", F.lit("unknown"))).unionByName(results)
    plain = lambda f: F.when(l[f].isNull(), p[f])
    listed = F.transform(F.coalesce(l["output"], F.array(p["output"])), lambda x: _row(_named("tool_result", F.col("name")), x))
    rows = (
        F.when(kind == "function_call", F.array(_row(_named("tool_call_args", F.col("name")), p["arguments"])))
        .when(kind == "function_call_output", listed)
        .when(kind == "reasoning", F.array(_row("reasoning/summary", plain("summary"))))
        .when(kind == "message", F.array(_row("assistant/message", plain("content"))))
        .when(kind == "event mcp_tool_call_end", F.array(_row(_named("mcp_result", F.col("name")), plain("result"))))
        .when(kind == "event agent_message", F.array(_row("agent_message", plain("content"))))
        .when(kind == "session_meta", F.array(_row("session_meta/base_instructions", p["base_instructions"]), _row("session_meta/dynamic_tools", p["dynamic_tools"])))
        .when(kind == "compacted", F.array(_row("compacted", p["data"])))
        .when(kind == "turn_context", F.array(_row("turn_context/user_instructions", p["user_instructions"])))
    )
    return out.select("session", "pos", "name", F.explode(rows).alias("r")).where("r.text <> ''").select("session", "pos", "r.category", "name", "r.text")


def _as_blocks(content: Column) -> Column:
    """Blocks (as JSON or plain strings) of a content that is a list or a string."""
    return F.coalesce(F.from_json(content, "array<string>"), F.array(content))


def _texts(content: Column) -> Column:
    """Texts of a result's content: itself, or its parts of type text and its strings."""
    parts = F.from_json(content, "array<string>")
    each = lambda x: F.when(x.startswith("{"), F.from_json(x, _PART.removeprefix("struct<").removesuffix(">").replace(":", " "))["text"]).otherwise(x)
    return F.when(parts.isNotNull(), F.filter(F.transform(parts, each), lambda t: t.isNotNull())).otherwise(F.array(content))


def _message_blocks(lines: DataFrame) -> DataFrame:
    """(session, pos, place, kind, plain, b) of every block of the messages; content that is a string is one block."""
    entry = F.from_json("line", "type string, message struct<role:string,content:string>")
    parsed = lines.select("session", "pos", entry.alias("m"), F.get_json_object("line", "$.message").alias("whole"))
    parsed = parsed.select("session", "pos", F.col("m.type").alias("kind"), F.coalesce("m.message.role", "m.type").alias("role"), "whole", F.when(F.col("m.type") == "system", F.array("whole")).otherwise(_as_blocks(F.col("m.message.content"))).alias("blocks"))
    rows = L.exploded(parsed.select("session", "pos", "kind", "role", "blocks"), "blocks", "place", "block").drop("blocks")
    block = F.when(F.col("block").startswith("{"), F.from_json("block", _BLOCK))
    return rows.withColumn("b", F.when(F.col("kind") != "system", block)).withColumn("plain", F.when(F.col("b.type").isNull(), F.col("block"))).drop("block")


def blocks(lines: DataFrame) -> DataFrame:
    """lines(session, pos, line) to (session, pos, category, name, text) of logs whose messages hold content
    blocks. Content that is a string, and blocks that are, count as text; a result's parts give a row each."""
    rows = _message_blocks(lines)
    calls = rows.where("kind = 'assistant' and b.type = 'tool_use' and b.id <> ''").select("session", F.col("b.id").alias("id"), F.struct("pos", "place").alias("o"), F.coalesce("b.name", F.lit("unknown")).alias("name"))
    rows = rows.withColumns({"id": F.col("b.tool_use_id"), "name": F.col("b.name")})
    result = (F.col("kind") == "user") & (F.coalesce("b.type", F.lit("")) == "tool_result")
    rows = rows.where(~result).withColumn("name", F.coalesce("name", F.lit("unknown"))).unionByName(named_results(rows.where(result), calls, ["session", "id"], "name", "o"))
    kind, b = F.col("kind"), F.col("b")
    some = F.when(b["input"] != "{}", b["input"])
    found = (
        F.when(kind == "system", F.array(_row("system", F.col("plain"))))
        .when(kind.isin("assistant", "user") & F.col("plain").isNotNull(), F.array(_row(F.concat(kind, F.lit("/text")), F.col("plain"))))
        .when(kind.isin("assistant", "user") & (b["type"] == "text"), F.array(_row(F.concat(kind, F.lit("/text")), b["text"])))
        .when((kind == "assistant") & (b["type"] == "thinking"), F.array(_row("assistant/thinking", b["thinking"])))
        .when((kind == "assistant") & (b["type"] == "tool_use"), F.array(_row(_named("tool_call_args", F.col("name")), some)))
        .when((kind == "user") & (b["type"] == "tool_result"), F.transform(_texts(b["content"]), lambda t: _row(_named("tool_result", F.col("name")), t)))
    )
    return L.exploded(rows.select("session", "pos", "name", found.alias("rows")), "rows", "r").where("r.text <> ''").select("session", "pos", "r.category", "name", "r.text")


def tool_results(rows: DataFrame) -> DataFrame:
    """(tool, text) of the results among rows that `items` or `blocks` gave."""
    return rows.where(F.col("category").startswith("tool_result/")).select(F.col("name").alias("tool"), "text")


def conversation(lines: DataFrame) -> DataFrame:
    """Messages (payload_id, idx, role, content, tool_calls, tool_call_id, name) of a log of blocks: an
    assistant's uses become calls beside its joined texts, a user's results messages of their own after its
    texts, named by the last call of their id."""
    rows = _message_blocks(lines).where("kind in ('user', 'assistant')")
    text = F.coalesce("plain", F.when(F.col("b.type") == "text", F.coalesce("b.text", F.lit(""))))
    call = F.when((F.col("role") == "assistant") & (F.col("b.type") == "tool_use"), F.struct(F.coalesce("b.id", F.lit("")).alias("id"), F.lit("function").alias("type"), F.struct(F.coalesce("b.name", F.lit("unknown")).alias("name"), F.coalesce("b.input", F.lit("{}")).alias("arguments")).alias("function")))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("place", c.alias("v"))))), lambda x: x["v"])
    spoken = rows.groupBy("session", "pos", "role").agg(in_order(text).alias("texts"), in_order(call).alias("tool_calls"))
    spoken = spoken.where((F.size("texts") > 0) | (F.size("tool_calls") > 0)).select("session", "pos", F.lit(-1).alias("place"), "role", F.when(F.size("texts") > 0, F.array_join("texts", "\n")).alias("content"), F.when(F.size("tool_calls") > 0, F.col("tool_calls")).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("name"))
    calls = L.exploded(spoken.select("session", "pos", "tool_calls"), "tool_calls", "c").select("session", F.col("c.id").alias("tool_call_id"), "pos", F.col("c.function.name").alias("name"))
    none = F.lit(None).cast(spoken.schema["tool_calls"].dataType)
    results = rows.where("role = 'user' and b.type = 'tool_result'").select("session", "pos", "place", F.lit("tool").alias("role"), F.array_join(_texts(F.coalesce("b.content", F.lit(""))), "\n").alias("content"), none.alias("tool_calls"), F.coalesce("b.tool_use_id", F.lit("")).alias("tool_call_id"), F.lit(None).cast("string").alias("name"))
    return _numbered(spoken.unionByName(named_results(results, calls, ["session", "tool_call_id"], "name", "pos")), "session", "pos", "place")


def _numbered(rows: DataFrame, payload: str, *order: str) -> DataFrame:
    """Messages with payload_id, and idx from 0 in order."""
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy(payload).orderBy(*order)) - 1
    return rows.withColumn("idx", idx).select(F.col(payload).alias("payload_id"), "idx", "role", "content", "tool_calls", "tool_call_id", "name")


def stored_parts(parts: DataFrame, session: str | None = None, limit: int | None = None) -> DataFrame:
    """(session_id, tool, text) of a store's tool parts (columns session_id, data)."""
    own = parts.where(F.col("data").contains('"type":"tool"'))
    own = own.where(F.col("session_id") == session) if session else own
    own = own.select("session_id", F.coalesce(F.get_json_object("data", "$.tool"), F.lit("unknown")).alias("tool"), F.get_json_object("data", "$.state.output").alias("text"))
    own = own.where("text <> ''")
    return own.limit(limit) if limit else own


def part_types(parts: DataFrame) -> DataFrame:
    """(type, n, bytes) of a store's parts, the largest first; data that isn't JSON is left out."""
    kind = F.coalesce(F.get_json_object("data", "$.type"), F.lit("unknown"))
    fine = parts.where(F.get_json_object("data", "$").isNotNull())
    return fine.groupBy(kind.alias("type")).agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("bytes")).orderBy(F.desc("bytes"), "type")


def part_keys(parts: DataFrame, path: str = "$") -> DataFrame:
    """(type, key, n, chars): keys of the objects at a path of the parts' data (`$.state`: a tool's state), in
    how many parts they occur, and the characters of their values."""
    own = parts.select(F.get_json_object("data", "$.type").alias("type"), F.from_json(F.get_json_object("data", path), "map<string,string>").alias("m"))
    return own.select("type", F.explode("m").alias("key", "value")).groupBy("type", "key").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("value"), F.lit(0))).alias("chars"))


def schemas(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) of a store's tables."""
    return [(name, c, t) for name, df in tables.items() for c, t in df.dtypes]


def listed_sessions(sessions: DataFrame, most: int = 15) -> DataFrame:
    """The sessions updated last."""
    return sessions.orderBy(F.desc("time_updated"), "id").limit(most)


def session_of(sessions: DataFrame, prefix: str) -> str:
    """The one session whose id begins so; an error where there is none, or are several."""
    found = [r.id for r in sessions.where(F.col("id").startswith(prefix)).select("id").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'several sessions begin' if found else 'no session begins'} with {prefix!r}")
    return found[0]


def assembled(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages with their parts in order of time; parts of unknown messages are dropped."""
    own = parts.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("time", "data"))), lambda x: x["data"]).alias("parts"))
    return messages.join(own, "message_id")


def store_messages(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages (as `conversation` gives them) of a store: messages(session_id, message_id, time, data) and
    parts(message_id, time, data). Texts take their message's role, invocations are an assistant's calls,
    results messages of their own; a message without parts gives its own content."""
    json_of = lambda c, *paths: F.coalesce(*[F.get_json_object(c, p) for p in paths])
    known = messages.select("session_id", "message_id", F.col("time").alias("at"), F.get_json_object("data", "$.role").alias("owner"), F.col("data").alias("whole"))
    rows = known.join(parts.where(F.get_json_object("data", "$").isNotNull()).select("message_id", F.col("time").alias("part_at"), "data"), "message_id", "left")
    kind = json_of("data", "$.type")
    tool = F.coalesce(json_of("data", "$.toolName", "$.tool"), F.lit("unknown"))
    call = F.array(F.struct(F.coalesce(json_of("data", "$.toolInvocationId", "$.id"), F.lit("")).alias("id"), F.lit("function").alias("type"), F.struct(tool.alias("name"), F.coalesce(json_of("data", "$.args", "$.input"), F.lit("{}")).alias("arguments")).alias("function")))
    is_call, is_result = kind == "tool-invocation", kind.isin("tool-result", "tool")
    output = F.coalesce(F.nullif(json_of("data", "$.state.output", "$.state.result"), F.lit("")), F.array_join(_texts(json_of("data", "$.result")), "\n"))
    content = F.when(F.col("data").isNull(), json_of("whole", "$.content")).when(kind == "text", json_of("data", "$.text")).when(is_result, output)
    text = F.lit(None).cast("string")
    rows = rows.select("session_id", "at", "message_id", "part_at", "data", F.when(is_call, "assistant").when(is_result, "tool").otherwise(F.col("owner")).alias("role"), content.alias("content"), F.when(is_call, call).alias("tool_calls"), F.when(is_result, F.coalesce(json_of("data", "$.toolInvocationId", "$.toolCallId"), F.lit(""))).otherwise(text).alias("tool_call_id"), F.when(is_result, tool).otherwise(text).alias("name"))
    rows = rows.where((F.coalesce("content", F.lit("")) != "") | F.col("tool_calls").isNotNull())
    return _numbered(rows, "session_id", "at", "message_id", "part_at", "data")
