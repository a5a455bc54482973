"""Queries: evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import metrics
from curata.plans import views as v
from curata.plans.registry import query

CONFUSION = f"""{v.EVAL}, cl AS (SELECT true_class AS c FROM e UNION SELECT pred_class FROM e),
cm AS (SELECT a.c AS true_class, b.c AS pred_class, count(e.sample_id) AS n FROM cl a CROSS JOIN cl b LEFT JOIN e ON e.true_class = a.c AND e.pred_class = b.c GROUP BY ALL)"""
PER_CLASS = f"""{CONFUSION}, pc AS (
  SELECT c AS class, (SELECT sum(n) FROM cm WHERE true_class = c)::BIGINT AS support, (SELECT sum(n) FROM cm WHERE pred_class = c)::BIGINT AS predicted,
         (SELECT sum(n) FROM cm WHERE true_class = c AND pred_class = c)::BIGINT AS hits FROM cl),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall FROM pc),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)"""


@query(f"WITH {CONFUSION} SELECT * FROM cm")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(v.evaluated(spark, sf_dir))


@query(f"WITH {PER_CLASS} SELECT class, support, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM f")
def per_class_scores(spark, sf_dir):
    d = metrics.per_class(confusion_matrix(spark, sf_dir))
    return d.select("class", "support", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {PER_CLASS} SELECT sum(support)::BIGINT AS n, round(sum(hits) / sum(support), 8) AS accuracy, round(avg(precision), 8) AS macro_precision, round(avg(recall), 8) AS macro_recall, round(avg(f1), 8) AS macro_f1,
  round(sum(precision * support) / sum(support), 8) AS weighted_precision, round(sum(recall * support) / sum(support), 8) AS weighted_recall, round(sum(f1 * support) / sum(support), 8) AS weighted_f1,
  round(avg(recall) FILTER (support > 0), 8) AS balanced_accuracy FROM f""")
def score_summary(spark, sf_dir):
    d = metrics.summary(confusion_matrix(spark, sf_dir))
    return d.select("n", *[F.round(c, 8).alias(c) for c in d.columns if c != "n"])


@query(f"WITH {v.EVAL} SELECT sample_id, true_class, pred_class FROM e WHERE true_class <> pred_class")
def misclassified(spark, sf_dir):
    return metrics.misclassified(v.evaluated(spark, sf_dir)).select("sample_id", "true_class", "pred_class")


@query(f"""WITH {v.EVAL}, p AS (SELECT sample_id, true_class, k AS class, (sample_id * (k_ix + 3) % 17) / 17.0 AS prob FROM e, (VALUES ('q0', 0), ('q1', 1), ('q2', 2), ('q3', 3)) x(k, k_ix)),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY prob DESC, class) AS r FROM p)
SELECT round(avg(h), 8) AS accuracy, count(*) AS n FROM (SELECT sample_id, max(CASE WHEN r <= 2 AND class = true_class THEN 1 ELSE 0 END) AS h FROM r GROUP BY sample_id)""")
def top_two_accuracy(spark, sf_dir):
    e = v.evaluated(spark, sf_dir)
    each = e.select("sample_id", "true_class", F.posexplode(F.array(*[F.lit(f"q{i}") for i in range(4)])).alias("k", "class")).withColumn("prob", F.col("sample_id") * (F.col("k") + 3) % 17 / 17.0)
    return metrics.top_k_accuracy(each, 2).withColumn("accuracy", F.round("accuracy", 8))


@query(f"WITH {v.EVAL} SELECT i::INT AS bin, count(e.sample_id) AS n FROM range(10) t(i) LEFT JOIN e ON least(floor(score * 10), 9) = i GROUP BY i")
def confidence_histogram(spark, sf_dir):
    return metrics.histogram(v.evaluated(spark, sf_dir), "score")


@query(f"WITH {v.EVAL} SELECT t AS threshold, round(avg((score < t)::INT), 8) AS share FROM e, (VALUES (0.25::DOUBLE), (0.5), (0.75)) x(t) GROUP BY t")
def confidence_ecdf(spark, sf_dir):
    return metrics.ecdf(v.evaluated(spark, sf_dir), "score", [0.25, 0.5, 0.75]).withColumn("share", F.round("share", 8))


@query(f"WITH {v.EVAL} SELECT round(greatest(quantile_cont(score::DOUBLE, 0.4), 0.3), 8) AS threshold, count(score) AS n FROM e WHERE true_class = pred_class")
def uncertainty_threshold(spark, sf_dir):
    right = v.evaluated(spark, sf_dir).filter("true_class = pred_class")
    return metrics.percentile_floor(right, "score", 0.4).withColumn("threshold", F.round("threshold", 8))


@query(f"""WITH {v.EVAL}, s AS (SELECT grp, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM e GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT grp, round(CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (below + n / 2)) / (sum(p) * sum(n)) ELSE 0.0 END, 8) AS auc FROM b GROUP BY grp""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(v.evaluated(spark, sf_dir), "score", "positive", "grp").withColumn("auc", F.round("auc", 8))


@query(f"""WITH {v.EVAL}, s AS (SELECT grp, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM e GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY grp) AS pos FROM s WINDOW w AS (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
q AS (SELECT grp, score, pos, tp / (tp + fp) AS pr, CASE WHEN pos > 0 THEN tp / pos ELSE 0.0 END AS re FROM c),
z AS (SELECT grp, pos, (re - coalesce(lag(re) OVER w, 0)) * (pr + coalesce(lag(pr) OVER w, 1)) / 2 AS part FROM q WINDOW w AS (PARTITION BY grp ORDER BY score DESC))
SELECT grp, round(CASE WHEN max(pos) > 0 THEN sum(part) ELSE 0.0 END, 8) AS auc FROM z GROUP BY grp""")
def pr_auc(spark, sf_dir):
    return metrics.pr_auc(v.evaluated(spark, sf_dir), "score", "positive", "grp").withColumn("auc", F.round("auc", 8))


@query(f"""WITH {v.PRED}, s AS (SELECT label, list_sort(list(confidence)) AS x, avg(confidence) AS mean, max(confidence) AS max FROM pred GROUP BY label)
SELECT label, x[greatest(floor(len(x) * 0.5)::INT, 1)] AS p50, x[greatest(floor(len(x) * 0.95)::INT, 1)] AS p95, round(mean, 8) AS mean, max FROM s""")
def latency_percentiles(spark, sf_dir):
    return metrics.latency(v.predictions(spark, sf_dir), "confidence", "label").withColumn("mean", F.round("mean", 8))


@query("WITH s AS (SELECT lang, list_sort(list(n_chars)) AS x FROM documents GROUP BY lang) SELECT lang, x[len(x) // 2 + 1] AS median FROM s")
def upper_medians(spark, sf_dir):
    return metrics.upper_median(v.table(spark, sf_dir, "documents"), "n_chars", "lang")


@query(f"""WITH {v.EVAL} SELECT grp, round(avg((true_class = pred_class)::INT), 8) AS accuracy, count(*) AS n, count(*) FILTER (score < 0.5) AS uncertain FROM e GROUP BY grp""")
def group_accuracy(spark, sf_dir):
    hit = (F.col("true_class") == F.col("pred_class")).cast("int")
    return v.evaluated(spark, sf_dir).groupBy("grp").agg(F.round(F.avg(hit), 8).alias("accuracy"), F.count("*").alias("n"), F.sum((F.col("score") < 0.5).cast("int")).alias("uncertain"))
