"""Sinks for rows as text, for debugging, for errors and for traces, of tables and of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_text(df: DataFrame, separator: str = "|") -> DataFrame:
    """(value): the columns of each row, nulls as nothing."""
    return df.select(F.concat_ws(separator, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def text_rows(df: DataFrame, path: str, checkpoint: str | None = None, separator: str = "|"):
    """Rows as lines of text files in a folder; a stream's query is returned, run over all that is there."""
    lines = as_text(df, separator)
    if not df.isStreaming:
        lines.write.mode("append").text(path)
        return None
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint or f"{path}/_checkpoint").trigger(availableNow=True).start()


def debug_text(df: DataFrame, path: str) -> None:
    """Rows as text with the partition that they were in: a file for each, replaced by the next call."""
    as_text(df.select(F.spark_partition_id().alias("task"), "*")).write.mode("overwrite").text(path)


def console(df: DataFrame, label: str, rows: int = 20):
    """Rows printed under a label; of a stream those of each batch."""

    def show(batch: DataFrame, number: int | None = None) -> None:
        print(label if number is None else f"{label} {number}")
        batch.show(rows, truncate=False)

    if not df.isStreaming:
        show(df)
        return None
    return df.writeStream.foreachBatch(show).trigger(availableNow=True).start()


def errors(df: DataFrame, path: str | None = None, checkpoint: str | None = None):
    """Errors to a text folder if there is a path, to the console if not."""
    return text_rows(df, path, checkpoint) if path else console(df, "errors")
