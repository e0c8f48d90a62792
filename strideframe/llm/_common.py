"""Helpers that the text operators share: table access, sizes, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python step works on at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the scale-factor folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Bytes of text in all rows: what partition counts are sized by."""
    return int(docs.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0)


def slices(batch: pa.RecordBatch, col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text; one long text makes a run of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_pylist()
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


#: Rows of an Arrow batch at most: the JVM holds batches of texts whole, outside its heap.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's batch size to BATCH_ROWS if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def map_texts(docs: DataFrame, rows: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a batch function to (doc_id, text, ...) rows in bounded slices.

    ``rows()`` runs once for each Python worker task, so that models and tables load once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = rows()
        for batch in batches:
            for part in slices(batch):
                yield step(part)

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
