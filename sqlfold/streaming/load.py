"""R4, stream variant: resumable, exactly-once loading of dump files as they arrive.

Each micro-batch holds whole new files; every file is written as its own output
partition with dynamic overwrite, so a batch that is retried after a failure
replaces exactly the files it owns (atomic per file). The streaming checkpoint
records which files were taken, so a restart resumes after the last committed
batch and never repeats a finished file. File arrival order is the stream's
(modification time), so use this variant only where load order is free; the
ordered queue is the batch variant in :mod:`sqlfold.operators.queue`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from ..operators.queue import load_log, load_wave, log_wave, pending
from ..sources.text import number_lines


def stream_load(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_location: str,
                max_files_per_trigger: int = 100, log_dir: str | None = None):
    """Lines as (line_no, line) in one partition per file; ``file_id`` is the file's full path, so
    files of one name in different folders stay apart. With ``log_dir`` each batch logs its files once
    they are written, as ``queue.commit_wave`` does (wave: the batch); a batch that runs again after a
    failure logs only what is not logged yet. Returns the query, stopped when no file is left."""
    lines = (
        spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files_per_trigger)
        .option("recursiveFileLookup", True).text(source_dir)
        .select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    )

    def write_batch(df, epoch_id):
        rows = number_lines(df).select("file_id", "line_no", "line")
        load_wave(rows, out_dir, "file_id", ["file_id", "line_no"])
        if log_dir:
            written = spark.read.schema("line_no long, line string, file_id string").parquet(out_dir)
            files = pending(rows.select("file_id").distinct(), load_log(spark, log_dir).withColumnRenamed("path", "file_id"), "file_id")
            log_wave(written, files, log_dir, epoch_id, "file_id", ["line_no", "line"])

    q = (
        lines.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_location)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q
