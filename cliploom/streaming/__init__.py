"""Clips and transforms on streams.

All transforms are row-wise and keep no state, so the same objects work on streaming DataFrames; late
rows need no watermark. Indexes (row numbers) are batch only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expr import has_extension
from ..sources import stores
from ..sources.files import EXTENSIONS
from ..sources.load import load_index

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_clips(spark: SparkSession, directory: str, schema, max_files: int = 64) -> DataFrame:
    """Records from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(directory)


def stream_clip_files(
    spark: SparkSession, directory: str, max_bytes: int = 1 << 30, sample_rate: int | None = 44100, mono: bool = True, duration: float | None = 1.0, offset: float = 0.0,
    opener: stores.Opener = stores.open_input,
) -> DataFrame:
    """Rows (record_key, clip) of clip files as they arrive below a directory of any Hadoop file system, each file once.

    Spark's file source keeps the files it has seen in the query's checkpoint, so a restart goes on where it was, and admits files of about
    ``max_bytes`` at a time (one at least). Tasks open the files themselves and read the frames of the excerpt; where they can't, Spark reads
    the contents. ``record_key`` is a hash of the path, so random transforms give a file the same numbers whenever it comes.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxBytesPerTrigger", max_bytes).load(directory)
    named = files.where(has_extension(F.col("path"), EXTENSIONS)).withColumn("record_key", F.xxhash64(stores.canonical_column(F.col("path"))))
    own = ["record_key", "path"] if stores.reachable(directory) else ["record_key", "path", "content"]
    return load_index(named.select(*own), sample_rate, mono, duration, offset, opener=opener)


def run_transform(clips: DataFrame, transform, output: str, checkpoint: str) -> StreamingQuery:
    """Apply a transform to all available records and write them as Parquet, exactly once."""
    return transform(clips).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
