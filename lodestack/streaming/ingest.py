"""Incremental ingest: files with parser results become chunks as they arrive.

Each micro-batch reads only new files, keeps the latest state of each document
within the batch, makes its chunks and writes them under the batch's number, so
a repeated batch overwrites itself. :func:`current_chunks` reads the result: of
each document the chunks of its latest batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators import chunking, nested
from lodestack.schema import DOCUMENTS
from lodestack.sources import parse


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, limit: int = 768, files_per_batch: int = 100, once: bool = True) -> StreamingQuery:
    """Start ingesting the document files below ``source``; with ``once`` it ends when all present files are read."""
    arriving = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        newest = nested.latest(batch, "id", "updated_at", "parse_json")
        made = chunking.chunk_items(parse.read_items(newest, "id", "parse_json"), limit)
        made.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_chunks(spark: SparkSession, sink: str) -> DataFrame:
    """The chunks of each document's latest batch."""
    rows = spark.read.parquet(sink)
    newest = Window.partitionBy("doc_id").orderBy(F.desc("batch"))
    return rows.withColumn("nth", F.rank().over(newest)).filter(F.col("nth") == 1).drop("nth", "batch")
