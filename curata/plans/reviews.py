"""Queries: review queues, decisions and their reports, gates of datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import boxes, review, rules
from curata.plans import views as v
from curata.plans.manifests import LINES, label_lines
from curata.plans.registry import query

QUEUE = """items AS (
  SELECT p_partkey AS id, 'img' || p_partkey % 700 AS image, CASE p_size % 5 WHEN 0 THEN ' Test' WHEN 1 THEN 'train' WHEN 2 THEN 'Valid' WHEN 3 THEN '' END AS split,
         CASE p_partkey % 4 WHEN 0 THEN 'A_EMPTY_LABEL' WHEN 1 THEN 'B_MANUAL_REVIEW' WHEN 2 THEN 'C_TIGHTEN' ELSE 'D_UNCERTAIN' END AS category,
         CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' END AS priority FROM part),
resolved AS (SELECT 'img' || p_partkey % 700 AS image, 'C_TIGHTEN' AS category FROM part WHERE p_partkey % 6 = 0)"""
LEVEL = "CASE upper(coalesce(priority, 'MEDIUM')) WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END"


def _queue(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    image = F.concat(F.lit("img"), (k % 700).cast("string"))
    category = F.when(k % 4 == 0, "A_EMPTY_LABEL").when(k % 4 == 1, "B_MANUAL_REVIEW").when(k % 4 == 2, "C_TIGHTEN").otherwise("D_UNCERTAIN")
    part = v.table(spark, sf_dir, "part")
    items = part.select(
        k.alias("id"), image.alias("image"), F.when(z % 5 == 0, " Test").when(z % 5 == 1, "train").when(z % 5 == 2, "Valid").when(z % 5 == 3, "").alias("split"), category.alias("category"),
        F.when(z % 4 == 0, "high").when(z % 4 == 1, "LOW").when(z % 4 == 2, "MEDIUM").alias("priority"),
    )
    return items, part.filter(k % 6 == 0).select(image.alias("image"), F.lit("C_TIGHTEN").alias("category"))


@query(f"""WITH {QUEUE}, u AS (SELECT * FROM items i WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.image = i.image AND r.category = i.category)),
h AS (SELECT 'high' AS kept, id FROM items WHERE upper(priority) = 'HIGH' UNION ALL SELECT 'tighten', id FROM items WHERE category = 'C_TIGHTEN' UNION ALL SELECT 'unresolved', id FROM u UNION ALL SELECT 'resolved', id FROM items WHERE id NOT IN (SELECT id FROM u))
SELECT kept, id FROM h""")
def queue_filters(spark, sf_dir):
    items, resolved = _queue(spark, sf_dir)
    found = [review.filter_queue(items, resolved, keep).select(F.lit(keep).alias("kept"), "id") for keep in ("high", "tighten", "unresolved", "resolved")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(f"""WITH {QUEUE}, o AS (SELECT 'priority' AS sorted_by, id, row_number() OVER (ORDER BY {LEVEL}, category, image, id) AS place FROM items UNION ALL SELECT 'category', id, row_number() OVER (ORDER BY category, {LEVEL}, image, id) FROM items
UNION ALL SELECT 'split', id, row_number() OVER (ORDER BY coalesce(split, ''), {LEVEL}, image, id) FROM items UNION ALL SELECT 'image', id, row_number() OVER (ORDER BY image, id) FROM items) SELECT sorted_by, id, place FROM o WHERE place <= 50""")
def queue_orders(spark, sf_dir):
    """The first page of a queue in each of its orders."""
    from pyspark.sql import Window

    items, found = _queue(spark, sf_dir)[0], None
    for by in ("priority", "category", "split", "image"):
        order = [*review.queue_order(by), F.col("id")]
        page = items.orderBy(*order).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select(F.lit(by).alias("sorted_by"), "id", "place")
        found = page if found is None else found.unionByName(page)
    return found


@query(f"WITH {QUEUE}, s AS (SELECT id, CASE WHEN trim(coalesce(split, '')) = '' THEN 'train' ELSE lower(trim(split)) END AS split FROM items) SELECT id, split FROM s WHERE split IN ('train', 'valid')")
def queue_blockers(spark, sf_dir):
    return review.blockers(_queue(spark, sf_dir)[0]).select("id", "split")


@query(f"""WITH {QUEUE} SELECT count(*) FILTER (category = 'A_EMPTY_LABEL') AS empty, count(*) FILTER (category = 'B_MANUAL_REVIEW') AS manual, count(*) FILTER (category = 'C_TIGHTEN') AS tighten,
count(*) FILTER (category = 'D_UNCERTAIN') AS uncertain, count(DISTINCT image) AS total FROM items""")
def queue_counts(spark, sf_dir):
    return review.queue_counts(_queue(spark, sf_dir)[0])


@query(f"""WITH {v.BOXES}, pr AS (SELECT o_orderkey AS image, CASE o_orderkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 2 THEN 'odd' END AS level, o_orderkey % 100 AS score FROM orders WHERE o_orderkey % 3 > 0)
SELECT frame AS image, count(*) AS n, string_agg(box_id::VARCHAR, ',' ORDER BY confidence DESC, box_id) AS proposals, CASE WHEN any_value(level) IN ('HIGH', 'LOW') THEN any_value(level) ELSE 'MEDIUM' END AS level, coalesce(any_value(score), 0)::DOUBLE AS score
FROM p LEFT JOIN pr ON frame = image GROUP BY frame""")
def proposal_units(spark, sf_dir):
    k = F.col("o_orderkey")
    priorities = v.table(spark, sf_dir, "orders").filter(k % 3 > 0).select(k.alias("image"), F.when(k % 5 == 0, "HIGH").when(k % 5 == 1, "LOW").when(k % 5 == 2, "odd").alias("level"), (k % 100).cast("double").alias("score"))
    proposals = v.predicted_boxes(spark, sf_dir).select(F.col("frame").alias("image"), "confidence", F.col("box_id").alias("proposal_id"))
    return review.proposal_units(proposals, priorities).withColumn("proposals", F.concat_ws(",", F.col("proposals").cast("array<string>")))


SCORED = """sc AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS level, o_orderkey % 7 AS matched, o_orderkey % 7 // 3 AS dis, o_orderkey % 4 AS proposals, o_orderkey % 5 AS truths, greatest(0, o_orderkey % 5 - o_orderkey % 7) AS missing,
  o_orderkey % 90 / 90.0::DOUBLE AS conf, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'tiny' END, CASE WHEN o_orderkey % 5 = 0 THEN 'empty' END], lambda x: x IS NOT NULL) AS categories, list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'no_proposal' END, CASE WHEN o_orderkey % 6 = 1 THEN 'conflict' END], lambda x: x IS NOT NULL) AS flags FROM orders)"""


@query(f"""WITH {SCORED}, u AS (SELECT 'level' AS facet, level AS name FROM sc UNION ALL SELECT 'category', unnest(categories) FROM sc UNION ALL SELECT 'flag', unnest(flags) FROM sc)
SELECT facet, name, count(*) AS n, NULL::DOUBLE AS value FROM u GROUP BY ALL
UNION ALL SELECT 'total', 'class_agreement', sum(matched - dis)::BIGINT, round(sum(matched - dis) / greatest(1, sum(matched)), 4) FROM sc
UNION ALL SELECT 'total', 'mean_confidence', count(*) FILTER (proposals > 0), round(sum(conf) FILTER (proposals > 0) / greatest(1, count(*) FILTER (proposals > 0)), 4) FROM sc
UNION ALL SELECT 'total', 'needs_box', count(*) FILTER (truths = 0 OR missing > 0), NULL FROM sc""")
def priority_report(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))
    scored = v.table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "MEDIUM").otherwise("LOW").alias("level"), (k % 7).alias("matched"), F.floor(k % 7 / 3).alias("class_disagreements"), (k % 4).alias("proposals"), (k % 5).alias("truths"),
        F.greatest(F.lit(0), k % 5 - k % 7).alias("missing"), (k % 90 / 90.0).alias("confidence_mean"), some((k % 2 == 0, "tiny"), (k % 5 == 0, "empty")).alias("categories"), some((k % 4 == 0, "no_proposal"), (k % 6 == 1, "conflict")).alias("flags"),
    )
    return review.priority_report(scored)


RECORDS = """rec AS (SELECT o_orderkey AS record, 'img' || o_orderkey % 3000 AS image, CASE o_orderkey % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'Kept ' WHEN 3 THEN 'uncertain' WHEN 4 THEN '' ELSE 'rejected' END AS decision,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Grape' ELSE 'Apple' END AS class_name, o_orderkey % 5 = 0 AS adj, o_orderkey % 8 AS cls, (o_orderkey % 11) / 10.0::DOUBLE AS cx, (o_orderkey % 9) / 40.0::DOUBLE AS w, o_custkey AS pid, o_orderkey % 7 AS pcls FROM orders)"""


@query(f"""WITH {RECORDS}, d AS (SELECT *, lower(trim(decision)) AS dec FROM rec),
e AS (
  SELECT record::VARCHAR AS ref, 'gate' AS kind FROM d WHERE dec IN ('', 'uncertain')
  UNION ALL SELECT record::VARCHAR, 'class_name' FROM d WHERE NOT adj AND dec IN ('accepted', 'corrected') AND pcls = 6
  UNION ALL SELECT record::VARCHAR, 'class_id' FROM d WHERE NOT adj AND dec IN ('accepted', 'corrected') AND pcls >= 5
  UNION ALL SELECT record::VARCHAR, 'coordinates' FROM d WHERE adj AND (cls >= 5 OR cx > 1 OR w <= 0 OR w > 1 OR cx - w / 2 < 0 OR cx + w / 2 > 1)
  UNION ALL SELECT record::VARCHAR, 'zero_area' FROM d WHERE adj AND w <= 0
  UNION ALL SELECT record::VARCHAR, 'too_small' FROM d WHERE adj AND class_name = 'Grape' AND w < 0.1
  UNION ALL SELECT record::VARCHAR, 'unknown_proposal' FROM d WHERE NOT adj AND pid NOT IN (SELECT c_custkey * 2 FROM customer)
  UNION ALL SELECT 's' || s_suppkey, 'manual_row' FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 4 = 1 OR s_suppkey % 4 = 2
  UNION ALL SELECT record::VARCHAR, 'repeated_record' FROM (SELECT *, row_number() OVER (PARTITION BY image, dec, adj, CASE WHEN NOT adj THEN pid END, CASE WHEN NOT adj THEN pcls END ORDER BY record) AS r FROM d) WHERE r > 1)
SELECT ref, kind FROM e""")
def resolved_state(spark, sf_dir):
    """Faults of every kind in a state of decisions, proposals and hand-drawn rows."""
    k = F.col("o_orderkey")
    adjudicated = k % 5 == 0
    names = ["Apple", "Grape", "Kiwi", "Mango", "Orange"]
    pcls = (k % 7).cast("int")
    records = v.table(spark, sf_dir, "orders").select(
        k.alias("record"), F.concat(F.lit("img"), (k % 3000).cast("string")).alias("image"),
        F.when(k % 6 == 0, "accepted").when(k % 6 == 1, "corrected").when(k % 6 == 2, "Kept ").when(k % 6 == 3, "uncertain").when(k % 6 == 4, "").otherwise("rejected").alias("decision"),
        F.when(k % 4 == 0, "Grape").otherwise("Apple").alias("class_name"), F.when(adjudicated, F.array((k % 8).cast("double"), k % 11 / 10.0, F.lit(0.5), k % 9 / 40.0, F.lit(0.1))).alias("row"),
        F.when(~adjudicated, F.array(F.struct(F.col("o_custkey").alias("proposal_id"), pcls.alias("class_id"), F.when(pcls == 6, "Plum").otherwise("Kiwi").alias("class_name")))).alias("proposals"),
    )
    proposals = v.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("proposal_id"))
    z = F.col("s_suppkey")
    n = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    manual = v.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), z.cast("string")).alias("stem"), F.when(z % 4 == 0, n(1, 0.5, 0.5, 0.2)).when(z % 4 == 1, n(9, 0.5, 0.5, 0.2, 0.2)).when(z % 4 == 2, n(1, 0.95, 0.5, 0.2, 0.2)).otherwise(n(1, 0.5, 0.5, 0.2, 0.2)).alias("row")
    )
    return review.resolved_state(records, proposals, manual, names, "Grape", 0.1).select("ref", "kind")


@query("""WITH r AS (SELECT c_custkey AS id, 'img' || c_custkey AS image, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS category, 'open' AS decision FROM customer),
m AS (SELECT 'img' || o_custkey AS image, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS category, CASE o_orderkey % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'drop' ELSE 'odd' END AS action FROM orders UNION ALL SELECT 'none', 'A', 'keep'),
j AS (SELECT m.*, count(*) OVER (PARTITION BY image, category) AS n, EXISTS (SELECT 1 FROM r WHERE r.image = m.image AND r.category = m.category) AS known,
  CASE WHEN action = 'keep' THEN 'kept' WHEN action = 'drop' AND category = 'B' THEN 'rejected' END AS outcome FROM m),
l AS (SELECT *, CASE WHEN NOT known THEN 'no_record' WHEN n > 1 THEN 'repeated' WHEN outcome IS NULL THEN 'action_not_allowed' ELSE 'applied' END AS status FROM j)
SELECT id, coalesce(outcome, decision) AS decision FROM r LEFT JOIN (SELECT * FROM l WHERE status = 'applied') USING (image, category)
UNION ALL SELECT -row_number() OVER (ORDER BY status), status || ':' || count(*) FROM l GROUP BY status""")
def merged_resolutions(spark, sf_dir):
    """Records after a manifest, and the counts of its log."""
    from pyspark.sql import Window

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    image = lambda i: F.concat(F.lit("img"), i.cast("string")).alias("image")
    category = lambda i: F.when(i % 2 == 0, "A").otherwise("B").alias("category")
    records = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), image(F.col("c_custkey")), category(F.col("c_custkey")), F.lit("open").alias("decision"))
    manifest = v.table(spark, sf_dir, "orders").select(image(c), category(c), F.when(k % 3 == 0, "keep").when(k % 3 == 1, "drop").otherwise("odd").alias("action"))
    manifest = manifest.unionByName(spark.createDataFrame([("none", "A", "keep")], "image string, category string, action string"))
    merged, log = review.merge_resolutions(records, manifest, {("A", "keep"): "kept", ("B", "keep"): "kept", ("B", "drop"): "rejected"})
    counts = log.groupBy("status").agg(F.count("*").alias("n")).select((-F.row_number().over(Window.orderBy("status"))).cast("long").alias("id"), F.concat_ws(":", "status", F.col("n").cast("string")).alias("decision"))
    return merged.select("id", "decision").unionByName(counts)


GATE = "im AS (SELECT doc_id, doc_id % 9 > 0 AS readable, n_chars % 600 AS width, n_chars % 500 AS height, (n_chars % 300)::DOUBLE AS blur, (n_chars % 256)::DOUBLE AS bright FROM documents)"


@query(f"""WITH {GATE} SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT readable THEN 'unreadable' END, CASE WHEN NOT readable OR width < 224 OR height < 224 THEN 'low_resolution' END, CASE WHEN NOT readable OR blur < 100 THEN 'blurry' END,
CASE WHEN NOT readable OR bright < 40 THEN 'underexposed' END, CASE WHEN readable AND bright > 220 THEN 'overexposed' END], lambda x: x IS NOT NULL), ',') AS reasons, readable AND width >= 224 AND height >= 224 AND blur >= 100 AND bright >= 40 AND bright <= 220 AS accepted FROM im""")
def loader_gate(spark, sf_dir):
    n = F.col("n_chars")
    d = v.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 9 > 0).alias("readable"), (n % 600).alias("width"), (n % 500).alias("height"), (n % 300).cast("double").alias("blur_score"), (n % 256).cast("double").alias("brightness"))
    return rules.loader_gate(d).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query(f"""WITH {GATE}, g AS (SELECT *, readable AND width >= 224 AND height >= 224 AND blur >= 100 AND bright >= 40 AND bright <= 220 AS ok FROM im) SELECT 'accepted' AS view, count(*) AS n, min(doc_id) AS first FROM g WHERE ok UNION ALL SELECT 'rejected', count(*), min(doc_id) FROM g WHERE NOT ok""")
def accepted_and_rejected(spark, sf_dir):
    d = loader_gate(spark, sf_dir)
    part = lambda name, rows: rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).withColumn("view", F.lit(name))
    return part("accepted", rules.accepted_rows(d)).unionByName(part("rejected", rules.rejected_rows(d)))


@query(f"""WITH {LINES}, e AS (SELECT stem, line_no, CASE WHEN NOT five THEN 'field_count' WHEN NOT numeric THEN 'non_numeric' WHEN c <> floor(c) OR c < 0 OR c >= 3 THEN 'class_id' WHEN x < 0 OR x > 1 OR y < 0 OR y > 1 THEN 'out_of_range'
  WHEN w <= 0 OR h <= 0 THEN 'zero_size' WHEN x + w / 2 > 1 OR y + h / 2 > 1 OR x - w / 2 < 0 OR y - h / 2 < 0 THEN 'outside_frame' END AS error FROM line),
b AS (SELECT stem, least.l AS line_no, least.e AS error FROM (SELECT stem, min({{'l': line_no, 'e': error}}) AS least FROM e WHERE error IS NOT NULL GROUP BY stem))
SELECT o_orderkey::VARCHAR AS image, CASE WHEN o_orderkey % 8 = 7 THEN 'missing' WHEN error IS NULL THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN o_orderkey % 8 < 7 THEN line_no END AS line_no, CASE WHEN o_orderkey % 8 < 7 THEN error END AS error FROM orders LEFT JOIN b ON stem = o_orderkey""")
def annotation_directory(spark, sf_dir):
    """Orders as images, their items as hand-drawn rows; each rule is computed from the fields of a row on both sides."""
    lines = label_lines(spark, sf_dir).select(F.col("stem").alias("image"), "line_no", "raw")
    images = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("image"), (F.col("o_orderkey") % 8 < 7).alias("has_label"))
    return rules.annotation_directory(images, lines, 3)


def _cases(value, cases, other):
    out = F.lit(other)
    for k, text in cases:
        out = F.when(value == k, F.lit(text)).otherwise(out)
    return out


@query("""WITH d AS (SELECT doc_id, lang AS class, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, n_chars, sha256(text) AS sha, source FROM documents),
cl AS (SELECT unnest(['de', 'en', 'es', 'fr', 'xx']) AS class), g AS (SELECT class, s AS split FROM cl, (VALUES ('train'), ('valid'), ('test')) x(s)),
dirs AS (SELECT split, count(*) AS n FROM g WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.class = g.class AND d.split = g.split) GROUP BY split),
grp AS (SELECT source || n_chars % 40 AS grp, class, split FROM d), sp AS (SELECT grp, count(DISTINCT split) AS s, count(DISTINCT class) AS c FROM grp GROUP BY grp),
meta AS (SELECT class, split, count(*) + max((class = 'de')::INT) AS n FROM d GROUP BY class, split),
mm AS (SELECT g.class, g.split FROM g LEFT JOIN meta USING (class, split) LEFT JOIN (SELECT class, split, count(*) AS f FROM d GROUP BY ALL) USING (class, split) WHERE n IS DISTINCT FROM coalesce(f, 0)),
c AS (
  SELECT 'class_dirs_exist_' || split AS "check", n FROM (SELECT s AS split, coalesce(n, 0) AS n FROM (VALUES ('train'), ('valid'), ('test')) x(s) LEFT JOIN dirs ON split = s)
  UNION ALL SELECT 'class_mapping_correct', 0 UNION ALL SELECT 'all_images_readable', count(*) FROM d WHERE doc_id % 50 = 0 UNION ALL SELECT 'no_zero_byte', count(*) FROM d WHERE doc_id % 70 = 0
  UNION ALL SELECT 'no_cross_split_duplicates', count(*) FROM (SELECT sha FROM d GROUP BY sha HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'no_sha256_leakage', count(*) FROM (SELECT sha FROM d GROUP BY sha HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'near_duplicates_listed', 0 UNION ALL SELECT 'no_near_duplicate_cross_split', count(*) FROM sp WHERE s > 1 AND c = 1 UNION ALL SELECT 'provenance_exists', count(*) FROM d WHERE trim(coalesce(source, '')) = ''
  UNION ALL SELECT 'license_exists', count(*) FROM d WHERE doc_id % 30 = 0 UNION ALL SELECT 'source_url_exists', 0 UNION ALL SELECT 'no_ambiguous_labels', count(*) FROM d WHERE trim(coalesce(class, '')) = ''
  UNION ALL SELECT 'metadata_matches_files', count(*) FROM mm UNION ALL SELECT 'manifest_matches_files', count(*) FROM d WHERE doc_id % 25 = 0 UNION ALL SELECT 'manifest_has_rows', 0
  UNION ALL SELECT 'recorded_files_unchanged', count(*) FROM region WHERE r_regionkey % 2 = 1 UNION ALL SELECT 'recorded_files_present', 1 UNION ALL SELECT 'no_unrecorded_files', 1)
SELECT "check", n = 0 AS passed, n::BIGINT AS n FROM c""")
def dataset_checks(spark, sf_dir):
    """The named checks of a dataset with faults of most kinds."""
    i = F.col("doc_id")
    d = v.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("class"), _cases(i % 3, ((0, "train"), (1, "valid")), "test").alias("split"), "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "source")
    path = i.cast("string").alias("path")
    files = d.select(path, "class", "split", "sha256", F.when(i % 70 == 0, 0).otherwise(F.col("n_chars")).alias("length"), (i % 50 > 0).alias("readable"))
    manifest = d.select(F.when(i % 25 == 0, F.concat(F.lit("gone"), path)).otherwise(path).alias("path"), "class", "split", "source", F.when(i % 30 > 0, "cc").alias("license"), F.lit("u").alias("url"))
    metadata = d.groupBy("class", "split").agg((F.count("*") + F.max((F.col("class") == "de").cast("int"))).alias("n"))
    classes = ["de", "en", "es", "fr", "xx"]
    groups = d.select(F.concat("source", (F.col("n_chars") % 40).cast("string")).alias("group"), F.when(i % 25 == 0, F.concat(F.lit("gone"), path)).otherwise(path).alias("path"))
    r = v.table(spark, sf_dir, "region")
    one = lambda name: spark.createDataFrame([(name, "h")], "name string, sha256 string")
    before = r.select(F.col("r_name").alias("name"), F.lit("h").alias("sha256")).unionByName(one("was"))
    after = r.select(F.col("r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 1, "other").otherwise("h").alias("sha256")).unionByName(one("is"))
    mapping = spark.createDataFrame(list(enumerate(classes)), "id int, class string")
    return rules.dataset_checks(files, manifest, metadata, mapping, classes, groups, (before, after))


@query(f"WITH {v.BOXES} SELECT frame, box_id, CASE WHEN confidence < 0.5 THEN 'uncertain' ELSE class_name END AS label FROM t")
def uncertain_labels(spark, sf_dir):
    return v.truth_boxes(spark, sf_dir).select("frame", "box_id", boxes.least_confident(F.col("class_name"), F.col("confidence")).alias("label"))
