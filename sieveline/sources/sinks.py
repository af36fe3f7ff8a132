"""Where results go: payload files, tables, reports for people."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..operators.budget import written_messages


def write_payloads(messages: DataFrame, path: str) -> None:
    """A line of JSON per payload: its id and its messages."""
    written_messages(messages).write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str, *by: str) -> None:
    """Parquet, in folders by some columns."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table for people; numbers with thousands separators."""
    cell = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.1f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows])


def write_report(summary: DataFrame, path: str, title: str, most: int = 1_000) -> str:
    """A summary of at most `most` rows as JSON (path/json) and as a page (path/markdown); gives the page."""
    rows = [r.asDict() for r in summary.limit(most).collect()]
    page = f"# {title}\n\n" + markdown(rows, summary.columns) + "\n"
    spark = summary.sparkSession
    for kind, text in (("json", json.dumps({"title": title, "rows": rows}, default=str, ensure_ascii=False)), ("markdown", page)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{kind}")
    return page
