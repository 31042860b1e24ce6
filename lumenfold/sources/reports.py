"""Report sinks, committed as a whole: the job commit makes a report appear at once or not at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _flat(df: DataFrame) -> DataFrame:
    """Arrays joined by ``;``."""
    return df.select([F.array_join(F.col(c), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, order: Sequence[Column | str]) -> None:
    """Write a report sorted by ``order``, with a header in each file.

    The sort is by ranges, so a large report is several files whose names are in its order, and no
    task sorts it alone; a small one is one file. An empty report still has its header.
    """
    _flat(df.orderBy(*order)).write.mode("overwrite").csv(path, header=True, escape='"', lineSep="\n")


def write_rows(df: DataFrame, path: str, order: Sequence[Column | str], fallback: Sequence[str] = ("path", "status")) -> None:
    """``write_csv`` of rows whose columns are not known before: without any column the header is ``fallback``."""
    if not df.columns:
        df = df.sparkSession.createDataFrame([], ", ".join(f"`{c}` string" for c in fallback))
        order = list(fallback)
    write_csv(df, path, order)


def write_json(df: DataFrame, path: str, order: Sequence[Column | str]) -> None:
    """One JSON object a line, sorted; nulls are written."""
    df.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_text(df: DataFrame, path: str, column: str, order: Sequence[Column | str]) -> None:
    """The lines of one text column, sorted by ``order``."""
    df.orderBy(*order).select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def write_parquet(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Append a run's rows, by directory of ``partition`` if given."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
