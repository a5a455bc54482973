"""Queries: rules over manifests, lookups, comparisons, shelf life."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curata.functions import scalar as s
from curata.operators import rules, tables
from curata.plans import views as v
from curata.plans.registry import query

FIELDS = [f for f in rules.MANIFEST_FIELDS if f.name in {"image_id", "image_path", "fruit_type", "freshness_label", "physical_fruit_id", "capture_session_id", "capture_timestamp", "camera_id", "days_since_purchase", "annotation_confidence"}]

FINDINGS = f"""{v.MANIFEST},
fd AS (
  SELECT row_number::VARCHAR AS ref, 'missing_required' AS kind, 'error' AS severity, 'freshness_label' AS detail FROM m WHERE trim(freshness_label) = ''
  UNION ALL SELECT row_number::VARCHAR, 'invalid_label', 'warning', 'freshness_label=' || freshness_label FROM m WHERE trim(freshness_label) <> '' AND lower(freshness_label) NOT IN ('fresh', 'stale', 'rotten')
  UNION ALL SELECT row_number::VARCHAR, 'missing_required', 'error', 'camera_id' FROM m WHERE trim(camera_id) = ''
  UNION ALL SELECT row_number::VARCHAR, 'invalid_value', 'error', 'capture_timestamp=' || capture_timestamp FROM m WHERE capture_timestamp = 'not-a-date'
  UNION ALL SELECT row_number::VARCHAR, 'invalid_value', 'error', 'days_since_purchase=' || days_since_purchase FROM m WHERE try_cast(days_since_purchase AS DOUBLE) < 0
  UNION ALL SELECT row_number::VARCHAR, 'invalid_value', 'error', 'annotation_confidence=' || annotation_confidence FROM m WHERE coalesce(try_cast(annotation_confidence AS DOUBLE), 9) > 1
  UNION ALL SELECT row_number::VARCHAR, 'duplicate_id', 'error', 'image_id=' || image_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY row_number) AS r FROM m) WHERE r > 1
  UNION ALL SELECT row_number::VARCHAR, 'duplicate_path', 'error', 'image_path=' || image_path FROM (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY row_number) AS r FROM m) WHERE r > 1
  UNION ALL SELECT row_number::VARCHAR, 'type_conflict', 'error', physical_fruit_id || ': ' || fruit_type || ' vs ' || lead FROM m JOIN (SELECT physical_fruit_id, arg_min(fruit_type, row_number) AS lead FROM m GROUP BY 1) USING (physical_fruit_id) WHERE fruit_type <> lead
  UNION ALL SELECT capture_session_id || '/' || physical_fruit_id, 'impossible_combination', 'warning', 'fresh+rotten' FROM m WHERE freshness_label IN ('fresh', 'rotten') GROUP BY capture_session_id, physical_fruit_id HAVING count(DISTINCT freshness_label) > 1)"""


@query(f"WITH {FINDINGS} SELECT * FROM fd")
def manifest_findings(spark, sf_dir):
    return rules.validate_manifest(v.manifest_rows(spark, sf_dir), FIELDS)


@query(f"WITH {FINDINGS} SELECT (SELECT count(*) FROM m) AS total, count(DISTINCT ref) AS invalid, (SELECT count(*) FROM m) - count(DISTINCT ref) AS valid FROM fd WHERE kind IN ('missing_required', 'invalid_value')")
def manifest_valid_rows(spark, sf_dir):
    m = v.manifest_rows(spark, sf_dir)
    return rules.valid_rows(m, rules.validate_manifest(m, FIELDS))


@query(f"""WITH {FINDINGS}, k AS (SELECT kind, ref, row_number() OVER (PARTITION BY kind ORDER BY ref) AS r FROM fd)
SELECT kind, count(*) AS n, count(DISTINCT ref) AS files, string_agg(CASE WHEN r <= 3 THEN ref END, ',' ORDER BY ref) AS refs FROM k GROUP BY kind""")
def issue_summary(spark, sf_dir):
    d = tables.issue_summary(manifest_findings(spark, sf_dir), 3)
    return d.withColumn("refs", F.array_join("refs", ","))


@query("""WITH q AS (SELECT doc_id, n_chars % 260 AS brightness, n_chars % 40 AS contrast, n_chars % 300 AS blur FROM documents)
SELECT doc_id, blur < 100 AS blurry, brightness < 40 AS too_dark, brightness > 220 AS too_bright, contrast < 20 AS low_contrast,
  CASE WHEN blur < 100 THEN 'blurry' WHEN brightness < 40 THEN 'too_dark' WHEN brightness > 220 THEN 'too_bright' WHEN contrast < 20 THEN 'low_contrast' END AS first_fault,
  ((blur >= 100)::INT + (brightness >= 40)::INT + (brightness <= 220)::INT + (contrast >= 20)::INT) / 4.0::DOUBLE AS score FROM q""")
def quality_reports(spark, sf_dir):
    n = F.col("n_chars")
    d = v.table(spark, sf_dir, "documents").select("doc_id", (n % 260).alias("brightness"), (n % 40).alias("contrast"), (n % 300).alias("blur"))
    return rules.quality_report(d).drop("brightness", "contrast", "blur", "faults")


DIAG = """d AS (SELECT doc_id, (n_chars % 100) / 100.0::DOUBLE AS confidence, 'c' || doc_id % 3 AS predicted_class, CASE WHEN doc_id % 4 > 0 THEN 'c' || doc_id % 2 END AS true_class,
  (n_chars % 300)::DOUBLE AS blur_score, (n_chars % 260)::DOUBLE AS brightness, (doc_id % 10) / 10.0::DOUBLE AS detector_confidence, (doc_id % 7) / 7.0::DOUBLE AS classifier_confidence, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 9) / 9.0::DOUBLE END AS stability_score FROM documents),
r AS (SELECT doc_id, list_filter([CASE WHEN confidence < 0.5 THEN printf('low_confidence_%.3f', confidence) END, CASE WHEN predicted_class <> true_class AND confidence > 0.9 THEN printf('high_confidence_error_%.3f', confidence) END,
  CASE WHEN predicted_class <> true_class AND confidence <= 0.9 THEN 'misclassified' END, CASE WHEN blur_score < 100 THEN printf('blurry_%.1f', blur_score) END, CASE WHEN brightness < 40 THEN 'too_dark' END, CASE WHEN brightness > 220 THEN 'too_bright' END,
  CASE WHEN abs(detector_confidence - classifier_confidence) > 0.3 THEN 'detector_classifier_disagreement' END, CASE WHEN stability_score < 0.5 THEN 'temporally_unstable' END, CASE WHEN confidence > 0.4 AND confidence < 0.6 THEN 'near_decision_boundary' END], lambda x: x IS NOT NULL) AS reasons FROM d)"""


def _hard(spark, sf_dir):
    i, n = F.col("doc_id"), F.col("n_chars")
    d = v.table(spark, sf_dir, "documents").select(
        "doc_id", (n % 100 / 100.0).alias("confidence"), F.concat(F.lit("c"), (i % 3).cast("string")).alias("predicted_class"), F.when(i % 4 > 0, F.concat(F.lit("c"), (i % 2).cast("string"))).alias("true_class"),
        (n % 300).cast("double").alias("blur_score"), (n % 260).cast("double").alias("brightness"), (i % 10 / 10.0).alias("detector_confidence"), (i % 7 / 7.0).alias("classifier_confidence"), F.when(i % 3 > 0, i % 9 / 9.0).alias("stability_score"),
    )
    return rules.hard_case_reasons(d)


@query(f"WITH {DIAG} SELECT doc_id, array_to_string(reasons, ',') AS reasons FROM r")
def hard_cases(spark, sf_dir):
    return _hard(spark, sf_dir).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {DIAG}, u AS (SELECT unnest(reasons) AS x FROM r), t AS (SELECT count(*) AS t FROM r WHERE len(reasons) > 0)
SELECT regexp_replace(x, '_\\d+\\.\\d+$', '') AS reason, count(*) AS n, round(100.0 * count(*) / any_value(t), 2) AS percent FROM u, t GROUP BY 1""")
def hard_case_reasons(spark, sf_dir):
    return rules.reason_distribution(_hard(spark, sf_dir))


def label_lines(spark, sf_dir):
    """Label lines of an order's items: classes, places and sizes that are sound for some and wrong in each way for others; neighbouring lines may be equal."""
    q, key = F.col("l_quantity").cast("long"), F.col("l_orderkey") * 31 + F.floor(F.col("l_linenumber") / 2) * 17
    share = lambda n, m: F.format_string("%d.%02d", F.floor(key * n % m / 100).cast("long"), (key * n % m % 100).cast("long"))
    name = F.when(q % 17 == 0, "1.5").when(q % 13 == 0, "x").otherwise((key % 4).cast("string"))
    sides = [share(1, 125), share(3, 110), share(7, 103), F.when(q % 11 == 0, "wide").otherwise(share(5, 101))]
    raw = F.when(q % 19 == 0, "  ").when(q % 23 == 0, F.concat_ws(" ", name, *sides[:3])).otherwise(F.concat(F.lit(" "), F.concat_ws("  ", name, *sides)))
    lines = v.table(spark, sf_dir, "lineitem")
    return lines.select(F.lit("train").alias("split"), F.col("l_orderkey").cast("string").alias("stem"), F.col("l_linenumber").cast("int").alias("line_no"), raw.alias("raw"))


def _share(n: int, m: int) -> str:
    return f"(k * {n} % {m} // 100) || '.' || lpad((k * {n} % {m} % 100)::VARCHAR, 2, '0')"


#: The lines, their fields and the numbers in them.
LINES = f"""k AS (SELECT l_orderkey AS stem, l_linenumber::INT AS line_no, l_quantity::BIGINT AS q, l_orderkey * 31 + l_linenumber // 2 * 17 AS k FROM lineitem),
raw AS (SELECT stem, line_no, CASE WHEN q % 19 = 0 THEN '  ' ELSE concat_ws(' ', CASE WHEN q % 17 = 0 THEN '1.5' WHEN q % 13 = 0 THEN 'x' ELSE (k % 4)::VARCHAR END, {_share(1, 125)}, {_share(3, 110)}, {_share(7, 103)},
  CASE WHEN q % 23 = 0 THEN NULL WHEN q % 11 = 0 THEN 'wide' ELSE {_share(5, 101)} END) END AS raw FROM k),
parts AS (SELECT *, string_split(raw, ' ') AS p FROM raw WHERE trim(raw) <> ''),
nums AS (SELECT *, len(p) AS n, list_transform(p, lambda x: try_cast(x AS DOUBLE)) AS v FROM parts),
num AS (SELECT *, n = 5 AS five, n = 5 AND len(list_filter(v, lambda x: x IS NULL)) = 0 AS numeric, v[1] AS c, v[2] AS x, v[3] AS y, v[4] AS w, v[5] AS h FROM nums),
line AS (SELECT *, numeric AND c = floor(c) AND c >= 0 AND c < 3 AS usable FROM num)"""


@query(f"""WITH {LINES}, again AS (SELECT *, row_number() OVER (PARTITION BY stem, c, round(x, 9), round(y, 9), round(w, 9), round(h, 9) ORDER BY line_no) AS r FROM line WHERE usable),
f AS (SELECT stem, line_no, 'field_count' AS kind FROM line WHERE NOT five UNION ALL SELECT stem, line_no, 'non_numeric' FROM line WHERE five AND NOT numeric UNION ALL SELECT stem, line_no, 'invalid_class' FROM line WHERE numeric AND NOT usable
  UNION ALL SELECT stem, line_no, 'center_out_of_range' FROM line WHERE usable AND (x < 0 OR x > 1 OR y < 0 OR y > 1) UNION ALL SELECT stem, line_no, 'size_out_of_range' FROM line WHERE usable AND (w <= 0 OR w > 1 OR h <= 0 OR h > 1)
  UNION ALL SELECT stem, line_no, 'covers_almost_all' FROM line WHERE usable AND w * h >= 0.95 UNION ALL SELECT stem, line_no, 'duplicate_row' FROM again WHERE r > 1)
SELECT 'train:' || stem || ':' || line_no AS ref, kind FROM f""")
def label_line_audit(spark, sf_dir):
    return rules.audit_label_lines(label_lines(spark, sf_dir), 3)[0].select("ref", "kind")


SHELF = "req AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN ' Apple' WHEN 1 THEN 'banana' WHEN 2 THEN 'kiwi' WHEN 3 THEN 'broken' ELSE 'grape' END AS item, CASE p_size % 6 WHEN 0 THEN 'fresh' WHEN 1 THEN 'stale' WHEN 2 THEN 'rotten' WHEN 3 THEN 'unknown' WHEN 4 THEN 'odd' ELSE 'fresh' END AS cls, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN -2.5 WHEN p_size % 7 = 2 THEN 99.0 ELSE p_size / 50.0 END::DOUBLE AS conf FROM part), dim(item, lo, hi) AS (VALUES ('apple', 14, 30), ('banana', 3, 7), ('broken', 9, 2), ('grape', 5, 10))"


@query(f"""WITH {SHELF}, j AS (SELECT id, cls, CASE WHEN conf IS NOT NULL THEN greatest(0.0, least(1.0, conf)) END AS c, dim.item IS NOT NULL AS known, lo <= hi AS ok, lo, hi FROM req LEFT JOIN dim ON lower(trim(req.item)) = dim.item),
st AS (SELECT *, CASE WHEN NOT known OR NOT ok THEN 'unsupported' WHEN cls IN ('rotten', 'stale') THEN 'expired' WHEN cls = 'unknown' THEN 'unknown' WHEN cls = 'fresh' AND c IS NULL THEN 'uncertain' WHEN cls = 'fresh' THEN 'estimated' ELSE 'unavailable' END AS status FROM j)
SELECT id, status, CASE status WHEN 'expired' THEN 0 WHEN 'estimated' THEN greatest(1, least(hi, round_even(hi * c, 0)::INT)) END::INT AS days, CASE WHEN status <> 'unsupported' THEN hi END AS typical_max FROM st""")
def shelf_life(spark, sf_dir):
    z, k = F.col("p_size"), F.col("p_partkey")
    req = v.table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 5 == 0, " Apple").when(k % 5 == 1, "banana").when(k % 5 == 2, "kiwi").when(k % 5 == 3, "broken").otherwise("grape").alias("item"),
        F.when(z % 6 == 1, "stale").when(z % 6 == 2, "rotten").when(z % 6 == 3, "unknown").when(z % 6 == 4, "odd").otherwise("fresh").alias("freshness_class"),
        F.when(z % 7 == 0, F.lit(None)).when(z % 7 == 1, -2.5).when(z % 7 == 2, 99.0).otherwise(z / 50.0).cast("double").alias("confidence"), F.lit(None).cast("string").alias("storage"),
    )
    items = spark.createDataFrame([("apple", 14, 30), ("banana", 3, 7), ("broken", 9, 2), ("grape", 5, 10)], "item string, typical_min int, typical_max int")
    return tables.shelf_life(req, items).select("id", "status", "days", "typical_max")


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'one' WHEN p_brand = 'Brand#12' THEN 'two' END AS mapped, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN NULL WHEN p_brand = 'Brand#13' THEN 'excluded' ELSE 'unmapped_label' END AS rejection FROM part""")
def mapped_labels(spark, sf_dir):
    m = spark.createDataFrame([("Brand#11", "one", None), ("Brand#12", "two", None), ("Brand#13", None, "excluded")], "label string, mapped string, rejection string")
    return tables.map_labels(v.table(spark, sf_dir, "part"), m, "p_brand").select("p_partkey", "mapped", "rejection")


@query("""WITH k AS (SELECT p_partkey, contains(lower(p_name || ' ' || p_type), 'a') AS a, contains(lower(p_name || ' ' || p_type), 'steel') AS b, contains(lower(p_name || ' ' || p_type), 'brass') AS c FROM part)
SELECT p_partkey, CASE WHEN b AND NOT c THEN 'steel' WHEN c AND NOT b THEN 'brass' END AS matched FROM k""")
def keyword_classes(spark, sf_dir):
    d = v.table(spark, sf_dir, "part").withColumn("t", F.concat_ws(" ", "p_name", "p_type"))
    return tables.match_keywords(d, "t", [("steel", "steel"), ("brass", "brass")]).select("p_partkey", "matched")


@query("SELECT p_partkey AS k, 'left_only' AS side FROM part WHERE p_partkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT o_orderkey, 'right_only' FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)")
def unmatched_keys(spark, sf_dir):
    p, o = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return tables.unmatched(p, o, ["k"])


@query("SELECT count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def dangling_references(spark, sf_dir):
    o = v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_partkey"))
    return tables.dangling(v.table(spark, sf_dir, "lineitem"), o, "l_partkey").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_returnflag AS k, avg(l_discount) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_returnflag AS k, avg(l_discount) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT k, round(a.v, 8) AS old, round(b.v, 8) AS new, CASE WHEN a.v IS NULL THEN 'ADDED' WHEN b.v IS NULL THEN 'REMOVED' WHEN b.v - a.v > 0.0001 THEN 'IMPROVED' WHEN b.v - a.v < -0.0001 THEN 'REGRESSED' ELSE 'UNCHANGED' END AS verdict FROM a FULL JOIN b USING (k)""")
def compared_metrics(spark, sf_dir):
    m = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"), "l_linestatus").agg(F.avg("l_discount").alias("value"))
    d = tables.compare_metrics(m.filter("l_linestatus = 'F'"), m.filter("l_linestatus = 'O'"), ["k"], tolerance=0.0001)
    return d.select("k", F.round("old", 8).alias("old"), F.round("new", 8).alias("new"), "verdict")


@query("""WITH c AS (SELECT o_custkey AS k, o_orderkey AS version, o_totalprice AS price FROM orders)
SELECT k, version, price FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS r FROM c) WHERE r = 1""")
def latest_versions(spark, sf_dir):
    c = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("price"))
    return tables.upsert(c.filter("version % 2 = 0"), c.filter("version % 2 = 1"), ["k"], "version").select("k", "version", "price")


@query("""WITH d AS (SELECT doc_id AS image, source AS split, sha256(text) AS h, lang AS labels, doc_id % 10 = 0 AS e FROM documents),
t AS (SELECT h, count(*) AS n, count(DISTINCT labels) AS kinds, list(DISTINCT split) AS sp FROM d WHERE NOT e GROUP BY h)
SELECT image, split, coalesce(n, 0) AS n_twins, CASE WHEN n IS NULL THEN 'no_twin' WHEN kinds = 1 THEN 'apply' ELSE 'needs_manual_review' END AS verdict, coalesce(len(list_filter(sp, lambda x: x <> split)) > 0, false) AS cross_split FROM d LEFT JOIN t USING (h) WHERE e""")
def twin_evidence(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image"), F.col("source").alias("split"), F.sha2(F.col("text").cast("binary"), 256).alias("h"), F.col("lang").alias("labels"))
    return tables.twin_evidence(d.filter("image % 10 = 0"), d.filter("image % 10 <> 0"), "h")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_twenty(spark, sf_dir):
    return tables.top_rows(v.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20)


@query("""(SELECT o_orderkey, 'least' AS "end" FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 6) UNION ALL (SELECT o_orderkey, 'most' FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6)""")
def extreme_rows(spark, sf_dir):
    return tables.extremes(v.table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", "end")


@query("""WITH p AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS before FROM conversations)
SELECT before, role, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY ALL""")
def role_transitions(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    d = v.table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w)).filter("before IS NOT NULL")
    return d.groupBy("before", "role").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'rejected' WHEN 3 THEN 'kept' WHEN 4 THEN 'uncertain' ELSE '' END AS d FROM orders)
SELECT count(*) AS total, count(*) FILTER (d = 'accepted') AS accepted, count(*) FILTER (d = 'corrected') AS corrected, count(*) FILTER (d = 'rejected') AS rejected, count(*) FILTER (d = 'kept') AS kept, count(*) FILTER (d = 'uncertain') AS uncertain,
round(count(*) FILTER (d IN ('accepted', 'corrected')) / count(*) FILTER (d <> ''), 8) AS acceptance FROM r""")
def review_acceptance(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    d = F.when(k == 0, "accepted").when(k == 1, "corrected").when(k == 2, "rejected").when(k == 3, "kept").when(k == 4, "uncertain").otherwise("")
    return tables.acceptance(v.table(spark, sf_dir, "orders").withColumn("decision", d)).withColumn("acceptance", F.round("acceptance", 8))


@query("SELECT p_partkey, len(string_split(lower(p_type), ' '))::INT AS n, lower(p_type) AS joined FROM part")
def name_tokens(spark, sf_dir):
    d = v.table(spark, sf_dir, "part")
    t = s.tokens(F.translate("p_type", " ", "_"))
    return d.select("p_partkey", F.size(t).alias("n"), F.array_join(t, " ").alias("joined"))
