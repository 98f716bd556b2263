"""Files as they arrive: every operator on a document is stateless, so a stream runs the batch code in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.markdown import MarkdownOptions
from ..operators.documents import process_pdfs
from ..sources.pdf import text_items

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def pdf_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(doc_id, path, content) of .pdf files that appear in a folder."""
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def stream_items(spark: SparkSession, path: str) -> DataFrame:
    """Positioned items of arriving files, as a stream: no state, no watermark."""
    return text_items(pdf_stream(spark, path))


def stream_markdown(spark: SparkSession, path: str, out: str, checkpoint: str, options: MarkdownOptions = MarkdownOptions()) -> StreamingQuery:
    """Appends process_pdfs of each batch of new files to a Parquet folder, and ends when all present files are done.

    A batch that is run again after a failure overwrites its own part of the folder, so each file counts once.
    """

    def batch(files: DataFrame, number: int) -> None:
        results = process_pdfs(files.select("doc_id", "content"), options=options)
        results.withColumn("error", F.to_json("error")).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return pdf_stream(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
