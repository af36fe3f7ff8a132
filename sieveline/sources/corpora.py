"""Tool outputs made from the tables: each input once as a DataFrame, once as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commands and tools that events stand for, by event_id.
COMMANDS = ("git status", "git diff HEAD~1", "git log --oneline", "git show abc", "git push", "ls -la", "find . -name x", "rg foo src", "npm test", "npm run build", "yarn run lint", "pnpm run type-check", "npm ls --json", "npx vitest run", "cargo test", "cargo build", "cargo clippy", "go test ./...", "go build", "gradle build -x test", "mvn compile", "mypy src", "tsc -p .", "pyright", "biome check", "curl x | jq .", "aws s3 ls --output json", "python3 -m json.tool", "python3 a.py", "npm run test", "make -vv", "eslint . --debug")
TOOLS = ("read_file", "search_content", "run_command", "raw_output", "list_jobs", "mcp__db", "web_fetch", "unknown", "edit_file")


#: Tasks a core that rows are dealt to.
TASKS = 3
#: Rows of these tables become texts, each by patterns that cost far more than moving the row's columns: these
#: are dealt out by their key. lineitem is only grouped into texts, which moves it anyway.
DEALT = {"documents": None, "conversations": None, "pages": None, "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out where its rows may lie in fewer tasks than there are cores. Texts have that many files
    or splits, or not. Keys and figures are small: millions of rows lie in one row group, which one task reads
    however many splits the file has, so splits tell nothing until there are several a core."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in DEALT:
        return df
    cores, key, parts = spark.sparkContext.defaultParallelism, DEALT[name], df._jdf.queryExecution().toRdd().getNumPartitions()
    if key is None:
        return df.repartition(cores) if parts < cores else df
    if parts >= TASKS * cores:
        return df
    # holds for every row; filters on what is made of the rows stop at one that isn't deterministic, and aren't
    # evaluated below, in the tasks that read
    return df.repartition(TASKS * cores, key).where(F.monotonically_increasing_id() >= 0)


def sql_list(items: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def array(items: tuple[str, ...]):
    return F.array(*[F.lit(x) for x in items])


def picked(items: tuple[str, ...], column: str):
    return F.element_at(array(items), (F.col(column) % len(items) + 1).cast("int"))


def picked_sql(items: tuple[str, ...], column: str) -> str:
    return f"{sql_list(items)}[CAST({column} % {len(items)} + 1 AS INT)]"


def lines_of(df: DataFrame, key: str, order: str, line) -> DataFrame:
    """One text per key from its rows' lines in order."""
    rows = df.select(F.col(key).alias("key"), F.struct(F.col(order).alias("o"), line.alias("line")).alias("r"))
    return rows.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n").alias("text"))
