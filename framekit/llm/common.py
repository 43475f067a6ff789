"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an Arrow function holds as Python values at once.
SLICE_ROWS = 256
#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1024
#: A table of at most so many narrow rows may be hinted for broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def long_texts(df: DataFrame) -> DataFrame:
    """``df``, from now on in Arrow batches of at most ``BATCH_ROWS`` rows.

    Batches are counted in rows, and both the JVM and the Python worker hold a whole one; texts of many kilobytes need few rows to a batch. A
    smaller setting of the session stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` hinted for broadcast if it has at most ``rows`` rows, else as it is (adaptive execution then shuffles both sides).

    Counting stops after ``rows`` + 1 rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_text(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
