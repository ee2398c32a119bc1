"""Arriving documents to a collection: of each batch's documents alone all that is derived is made anew and put in place of what was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.collection import Collection, Derive


def follow(
    spark: SparkSession, folder: str, schema: StructType, collection: Collection, derive: Derive, log: str, name: str, newest: str, files_per_batch: int = 1000
) -> None:
    """Take all Parquet files of documents (document_id, ``newest``, ...) that have come to ``folder`` since the last call with this ``log``, and end.

    A batch's number in the stream is its key in the collection: after a crash Spark repeats a batch that may have been
    committed, and it is committed once. A document that comes again replaces the former one."""

    def take(batch: DataFrame, number: int) -> None:
        collection.replace(f"{name}/{number}", batch, derive, newest)

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    arriving.writeStream.foreachBatch(take).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
