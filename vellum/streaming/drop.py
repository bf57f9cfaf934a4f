"""Documents as they arrive in a folder: an extension, stateless, exactly once with a file sink.

Each new file is parsed in the micro-batch that sees it; a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import layout, output
from ..sources import pdf

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, pattern: str = "*.pdf", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as (doc_id, path, content)."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def page_texts(batch: DataFrame) -> DataFrame:
    """Page texts of a batch of documents."""
    chars = layout.glyph_boxes(layout.laid_out(pdf.glyphs(batch)))
    return output.page_text(chars)


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] = page_texts, once: bool = False) -> StreamingQuery:
    """Extract from each batch and write it under its number, so a batch that runs again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        extract(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = arrivals(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def glyph_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Glyph rows of arriving files, appended to Parquet: a plain stateless stream."""
    stream = pdf.glyphs(arrivals(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
