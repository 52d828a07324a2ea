"""Incremental ingestion: each micro-batch of files goes through the index lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import ChunkingPolicy
from ..operators.lifecycle import IndexState
from ..plans.ingestion import POLICY, Embed, add_files, refusal
from ..sources.files import checksum, media_type
from ..functions.text import safe_path


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as they come: path, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(folder)


def ingest(stream: DataFrame, state: IndexState, checkpoint: str, versions: str = "1", root: str = "", policy: ChunkingPolicy = POLICY, embed: Embed | None = None, embedding: str = "") -> StreamingQuery:
    """Read, chunk and store files, batch by batch; a batch that is run again changes nothing.

    Paths are judged and kept without the root; a file that isn't admitted is a failed attempt.
    """

    def batch(files: DataFrame, _: int) -> None:
        path = safe_path(F.replace(F.col("path"), F.lit(root), F.lit("")))
        latest = Window.partitionBy("source_path").orderBy(F.desc("modificationTime"), checksum(F.col("content")))
        rows = files.select(path.alias("source_path"), media_type(path, F.lit("")).alias("media_type"), "content", "modificationTime").where("source_path is not null")
        newest = rows.withColumn("n", F.row_number().over(latest)).where("n = 1").withColumn("error", refusal())
        add_files(state, newest, versions, policy, embed, embedding)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
