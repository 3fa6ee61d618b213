"""Incremental indexing: a stream of changes, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.model import INCOMING
from skein.plans.build import latest
from skein.plans.engine import Engine


def changes(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """A stream of documents (model.INCOMING, plus ``arrived`` for the order within a key) from files added to a folder."""
    return spark.readStream.schema(INCOMING + ", arrived bigint, deleted boolean").format(file_format).load(path)


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Apply each micro-batch: the last change of each key wins, deletions go after upserts.

    A batch that runs again after a failure gives the same index, as changes go by key. No watermark is
    needed: nothing is held between batches.
    """

    def apply(batch: DataFrame, _: int) -> None:
        last = latest(batch, "arrived").persist()
        try:
            gone = last.where(F.coalesce("deleted", F.lit(False)))
            kept = last.where(~F.coalesce("deleted", F.lit(False))).drop("arrived", "deleted")
            if not kept.isEmpty():
                engine.index(kept)
            if not gone.isEmpty():
                engine.delete(gone.select("provider_id", "document_id"))
        finally:
            last.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
