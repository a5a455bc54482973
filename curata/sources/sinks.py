"""Sinks: manifests, reports, partitioned datasets, label files, versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions.scalar import yolo_line
from curata.sources.readers import MANIFEST_COLUMNS


def write_manifest_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The manifest's columns in their order, then nothing else; columns that the table lacks are empty."""
    names = columns or MANIFEST_COLUMNS
    df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in names]).write.mode("errorifexists").option("header", "true").csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    """A report as one file: for reports, whose rows are counts. Tables of data go to ``write_dataset``."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def write_dataset(df: DataFrame, path: str, *keys: str) -> None:
    """A partitioned dataset, all or nothing: files appear when the job commits, and an existing path is refused. Rows are
    rebalanced by the keys first: small partitions come to one file, and adaptive execution splits a large one over tasks."""
    df.hint("rebalance", *keys).write.mode("errorifexists").partitionBy(*keys).parquet(path)


def write_label_lines(boxes: DataFrame, path: str) -> None:
    """One folder a (split, stem) with a text file of label lines in order."""
    y = F.struct("cx", "cy", "w", "h")
    lines = boxes.withColumn("value", yolo_line(F.col("class_id"), y))
    lines.repartition("split", "stem").sortWithinPartitions("split", "stem", "line_no").select("split", "stem", "value").write.mode("errorifexists").partitionBy("split", "stem").text(path)


def write_version(df: DataFrame, path: str, version: str) -> str:
    """A new version beside the earlier ones, which stay as backups; returns its folder."""
    folder = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(folder)
    return folder


def session_log(stream: DataFrame, log_path: str, summary_path: str, checkpoint: str):
    """Appends each micro-batch's rows to a log and its sums by session to a summary; restarts don't repeat a batch, as each
    has a folder of its own. ``session_totals`` adds the sums up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        batch.groupBy("session").agg(F.count("*").alias("n"), F.count("confidence").alias("n_confidence"), F.sum("confidence").alias("confidence")).write.mode("overwrite").parquet(f"{summary_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_totals(spark: SparkSession, summary_path: str) -> DataFrame:
    """(session, n, avg_confidence) over all batches of a ``session_log``."""
    sums = spark.read.parquet(summary_path)
    return sums.groupBy("session").agg(F.sum("n").alias("n"), F.try_divide(F.sum("confidence"), F.sum("n_confidence")).alias("avg_confidence"))
