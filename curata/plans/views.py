"""The driver tables seen as the operators' inputs, each as a DataFrame and as a DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset candidates: an id, a class, a source and the digest of the content."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("class"), "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "n_chars")


DOCS = "docs AS (SELECT doc_id, lang AS class, source, sha256(text) AS sha, n_chars FROM documents)"


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content."""
    return docs(spark, sf_dir).groupBy("sha").agg(F.min_by(F.struct("doc_id", "class", "source", "n_chars"), "doc_id").alias("k")).select("k.*", "sha")


KEPT = DOCS + ", kept AS (SELECT * FROM docs d WHERE doc_id = (SELECT min(doc_id) FROM docs e WHERE e.sha = d.sha))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of predictions a session: time in seconds, label, confidence."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("time"), F.col("event_type").alias("label"), F.least(F.lit(1.0), F.col("value") / 500.0).alias("confidence"))


PRED = "pred AS (SELECT user_id AS session, event_id AS seq, epoch(ts) AS time, event_type AS label, least(1.0, value / 500.0) AS confidence FROM events)"


def truth_boxes(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Boxes of a frame (an order) from its lines, those of the table or of a stream."""
    x1, y1 = F.col("l_partkey") % 200, F.col("l_suppkey") % 150
    q = F.col("l_quantity").cast("long")
    lines = table(spark, sf_dir, "lineitem") if lines is None else lines
    return lines.select(
        F.col("l_orderkey").alias("frame"), (F.col("l_linenumber") * F.lit(10**10) + F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("box_id"), F.col("l_returnflag").alias("class_name"), F.least(F.lit(1.0), F.col("l_extendedprice") / 60000.0).alias("confidence"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 20 + q).alias("x2"), (y1 + 20 + q * 7 % 50).alias("y2"), "l_partkey", "l_suppkey",
    )


def predicted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = F.col("l_partkey") % 13
    t = truth_boxes(spark, sf_dir).filter("l_suppkey % 7 <> 0")
    return t.select("frame", "box_id", F.when(F.col("l_partkey") % 5 == 0, "N").otherwise(F.col("class_name")).alias("class_name"), "confidence", (F.col("x1") + shift).alias("x1"), "y1", (F.col("x2") + shift).alias("x2"), "y2")


BOXES = """t AS (
  SELECT l_orderkey AS frame, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS box_id, l_returnflag AS class_name, least(1.0, l_extendedprice / 60000.0) AS confidence,
         l_partkey % 200 AS x1, l_suppkey % 150 AS y1, l_partkey % 200 + 20 + CAST(l_quantity AS BIGINT) AS x2,
         l_suppkey % 150 + 20 + CAST(l_quantity AS BIGINT) * 7 % 50 AS y2, l_partkey, l_suppkey FROM lineitem),
p AS (
  SELECT frame, box_id, CASE WHEN l_partkey % 5 = 0 THEN 'N' ELSE class_name END AS class_name, confidence, x1 + l_partkey % 13 AS x1, y1, x2 + l_partkey % 13 AS x2, y2
  FROM t WHERE l_suppkey % 7 <> 0)"""

IOU = (
    "(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))::DOUBLE"
    " / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1)"
    " - greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"
)


def iou_sql(a: str, b: str) -> str:
    return IOU.format(a=a, b=b)


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a rule's prediction and score."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = F.col("n_chars")
    return lab.join(d, "doc_id").select(
        F.col("doc_id").alias("sample_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("true_class"), F.when(n % 5 > 0, "q1").when(n % 10 > 0, "q0").otherwise("q2").alias("pred_class"),
        (n % 100 / 100.0).alias("score"), F.col("lang").alias("grp"), (F.col("toxic") == 1).alias("positive"),
    )


EVAL = """e AS (
  SELECT l.doc_id AS sample_id, 'q' || l.quality AS true_class, CASE WHEN n_chars % 5 > 0 THEN 'q1' WHEN n_chars % 10 > 0 THEN 'q0' ELSE 'q2' END AS pred_class,
         n_chars % 100 / 100.0 AS score, lang AS grp, toxic = 1 AS positive
  FROM labels l JOIN documents d USING (doc_id))"""


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of text columns with faults of every kind."""
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    return table(spark, sf_dir, "documents").select(
        i.alias("row_number"), F.concat(F.lit("img"), s(i % 990)).alias("image_id"), F.concat(F.lit("p/"), s(i % 995), F.lit(".jpg")).alias("image_path"), F.col("lang").alias("fruit_type"),
        F.when(i % 7 == 0, "rotten").when(i % 7 == 1, "Fresh").when(i % 7 == 2, "mouldy").when(i % 7 == 3, "").otherwise("fresh").alias("freshness_label"),
        F.concat(F.lit("f"), s(i % 400)).alias("physical_fruit_id"), F.concat(F.lit("s"), s(i % 9)).alias("capture_session_id"), F.when(i % 11 == 0, "not-a-date").otherwise("2024-01-02T03:04:05").alias("capture_timestamp"),
        F.when(i % 17 == 0, F.lit(" ")).otherwise(F.lit("cam")).alias("camera_id"), s(i % 13 - 1).alias("days_since_purchase"), F.when(i % 19 == 0, "1.7").when(i % 19 == 1, "x").otherwise("0.5").alias("annotation_confidence"),
    )


MANIFEST = """m AS (
  SELECT doc_id AS row_number, 'img' || doc_id % 990 AS image_id, 'p/' || doc_id % 995 || '.jpg' AS image_path, lang AS fruit_type,
         CASE doc_id % 7 WHEN 0 THEN 'rotten' WHEN 1 THEN 'Fresh' WHEN 2 THEN 'mouldy' WHEN 3 THEN '' ELSE 'fresh' END AS freshness_label,
         'f' || doc_id % 400 AS physical_fruit_id, 's' || doc_id % 9 AS capture_session_id,
         CASE WHEN doc_id % 11 = 0 THEN 'not-a-date' ELSE '2024-01-02T03:04:05' END AS capture_timestamp,
         CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE 'cam' END AS camera_id, CAST(doc_id % 13 - 1 AS VARCHAR) AS days_since_purchase,
         CASE doc_id % 19 WHEN 0 THEN '1.7' WHEN 1 THEN 'x' ELSE '0.5' END AS annotation_confidence
  FROM documents)"""
