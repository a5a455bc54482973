"""Queries: scalar functions and small rules, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import scalar as s
from curata.operators import boxes, rules, tables
from curata.plans import views as v
from curata.plans.registry import query


@query("""SELECT vec_id, list_sum(list_transform(range(10, 65), lambda i: CASE WHEN embedding[i] > embedding[i - 9] THEN (1::HUGEINT << (64 - i)::INT) ELSE 0 END))::BIGINT AS h FROM embeddings""")
def gradient_hashes_above(spark, sf_dir):
    return v.table(spark, sf_dir, "embeddings").select("vec_id", s.gradient_hash_above(F.col("embedding")).alias("h"))


@query("""WITH p AS (SELECT p_partkey, lower(p_type) AS name, CASE WHEN p_size % 2 = 0 THEN 'fresh' ELSE 'rotten' END AS state FROM part)
SELECT p_partkey, (contains(name, 'brushed') AND state = 'fresh') OR (list_contains(string_split(regexp_replace(name, '[-_.\\s]+', ' ', 'g'), ' '), 'fresh') AND state = 'rotten') AS wrong FROM p""")
def contradictions(spark, sf_dir):
    state = F.when(F.col("p_size") % 2 == 0, "fresh").otherwise("rotten")
    return v.table(spark, sf_dir, "part").select("p_partkey", tables.contradicts(F.col("p_type"), state, ["brushed"]).alias("wrong"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.99 THEN 'tighten' WHEN l_discount * 10 >= 0.96 THEN 'manual_review' ELSE 'keep' END AS advice FROM lineitem")
def huge_box_advice(spark, sf_dir):
    return v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", boxes.huge_suggestion(F.col("l_discount") * 10).alias("advice"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def undecided_items(spark, sf_dir):
    items = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag", "l_linestatus")
    return tables.undecided(v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), items.filter("l_returnflag = 'R'"), items.filter("l_linestatus = 'O'"), "k")


PATHS = "t AS (SELECT 'f' || p_partkey || '.jpg' AS k, min(p_size) AS v FROM part WHERE p_partkey % 3 > 0 GROUP BY 1)"


@query(f"""WITH {PATHS} SELECT c_custkey, coalesce(a.v, b.v)::INT AS size FROM customer LEFT JOIN t a ON a.k = 'f' || c_custkey || '.jpg' LEFT JOIN t b ON b.k = 'f' || c_custkey + 1 || '.jpg'""")
def first_matching_sizes(spark, sf_dir):
    """The size under the first of two paths, by file name, that a table knows."""
    p = v.table(spark, sf_dir, "part").filter("p_partkey % 3 > 0").select(F.concat(F.lit("x/f"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("k"), F.col("p_size").alias("size"))
    k = F.col("c_custkey")
    c = v.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("a\\b/f"), k.cast("string"), F.lit(".jpg")).alias("one"), F.concat(F.lit("f"), (k + 1).cast("string"), F.lit(".jpg")).alias("two"))
    return tables.first_matching_key(c, p, ["one", "two"], "k", "size").select("c_custkey", "size")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 IN (SELECT s_suppkey % 7 FROM supplier)")
def resolved_names(spark, sf_dir):
    """Records whose name ends with a resolved image's name."""
    k = F.col("c_custkey")
    c = v.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("data/"), k.cast("string"), F.lit("/i"), (k % 10).cast("string"), F.lit(".png")).alias("name"))
    r = v.table(spark, sf_dir, "supplier").select(F.concat(F.lit("i"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".png")).alias("image")).distinct()
    return tables.ends_with_any(c, r, "name", "image").select("c_custkey")


@query("""WITH p AS (SELECT doc_id, [n_chars % 640, n_chars % 480, n_chars % 700, n_chars % 500] AS b, doc_id % 5 = 0 AS short FROM documents)
SELECT doc_id, CASE WHEN short THEN 'four_values' WHEN b[3] <= b[1] OR b[4] <= b[2] THEN 'degenerate' WHEN b[3] - b[1] < 1 OR b[4] - b[2] < 1 THEN 'under_one_pixel' WHEN b[1] < 0 OR b[2] < 0 OR b[3] > 640 OR b[4] > 480 THEN 'outside_frame' END AS error FROM p""")
def pixel_box_errors(spark, sf_dir):
    n = F.col("n_chars")
    b = F.when(F.col("doc_id") % 5 == 0, F.array(n)).otherwise(F.array(n % 640, n % 480, n % 700, n % 500))
    return v.table(spark, sf_dir, "documents").select("doc_id", rules.pixel_box_error(b, F.lit(640), F.lit(480)).alias("error"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'two_values' WHEN p_size % 7 = 1 THEN 'missing' WHEN p_size - 20 < 0 THEN 'negative' WHEN p_size - 20 > p_partkey % 30 THEN 'order' WHEN p_partkey % 30 <= 0 THEN 'zero' END AS fault FROM part""")
def range_faults(spark, sf_dir):
    z, k = F.col("p_size"), (F.col("p_partkey") % 30).cast("int")
    r = F.when(z % 7 == 0, F.array(z)).when(z % 7 == 1, F.array(z, F.lit(None).cast("int"))).otherwise(F.array(z - 20, k))
    return v.table(spark, sf_dir, "part").select("p_partkey", rules.range_fault(r).alias("fault"))


@query(f"""WITH {v.MANIFEST} SELECT row_number, array_to_string(list_filter([CASE WHEN trim(freshness_label) = '' THEN 'freshness_label' END, CASE WHEN trim(camera_id) = '' THEN 'camera_id' END], lambda x: x IS NOT NULL), ',') AS missing FROM m""")
def missing_fields(spark, sf_dir):
    return rules.missing_fields(v.manifest_rows(spark, sf_dir), ["freshness_label", "camera_id"]).select("row_number", F.array_join("missing", ",").alias("missing"))


@query("""WITH a AS (SELECT n_name AS name, n_regionkey AS h FROM nation WHERE n_nationkey % 5 > 0), b AS (SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 9 ELSE n_regionkey END AS h FROM nation WHERE n_nationkey % 4 > 0)
SELECT name, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'new' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS verdict FROM a FULL JOIN b USING (name)""")
def compared_hashes(spark, sf_dir):
    n, k = v.table(spark, sf_dir, "nation"), F.col("n_nationkey")
    a = n.filter(k % 5 > 0).select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("sha256"))
    return rules.compare_hashes(a, n.filter(k % 4 > 0).select(F.col("n_name").alias("name"), F.when(k % 3 == 0, 9).otherwise(F.col("n_regionkey")).alias("sha256")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'fix_errors' WHEN c_custkey % 7 = 0 THEN 'leaking_splits' WHEN c_custkey % 6 < 3 THEN 'too_few_groups' WHEN c_custkey % 4 < 2 THEN 'too_few_sessions' WHEN c_custkey % 8 > 3 THEN 'imbalanced' ELSE 'ready' END AS verdict FROM customer""")
def readiness_verdicts(spark, sf_dir):
    k = F.col("c_custkey")
    r = v.table(spark, sf_dir, "customer").select("c_custkey", (k % 5 == 0).cast("int").alias("errors"), (k % 7 == 0).cast("int").alias("leaks"), (k % 6).alias("groups"), (k % 4).alias("sessions"), (k % 8).cast("double").alias("imbalance"))
    return rules.readiness_verdict(r).select("c_custkey", "verdict")


@query("""WITH m AS (SELECT max(n) / min(n) AS imbalance, (SELECT count(*) FROM documents WHERE n_chars = 0) AS bad, (SELECT count(*) - count(DISTINCT sha256(text)) FROM documents) AS dup FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
SELECT 'imbalance' AS topic FROM m WHERE imbalance >= 5 UNION ALL SELECT 'labels' FROM m WHERE bad > 0 UNION ALL SELECT 'duplicates' FROM m WHERE dup > 0""")
def recommendations(spark, sf_dir):
    d = v.docs(spark, sf_dir)
    n = d.groupBy("class").agg(F.count("*").alias("n")).agg((F.max("n") / F.min("n")).alias("imbalance"))
    facts = d.agg(F.sum((F.col("n_chars") == 0).cast("int")).alias("affected_files"), (F.count("*") - F.count_distinct("sha")).alias("duplicates"))
    return rules.recommendations(n.crossJoin(facts)).select("topic")  # one row each


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 OR o_orderkey % 4 = 0 THEN 'HIGH' WHEN o_orderkey % 100 < 50 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM orders")
def proposal_priorities(spark, sf_dir):
    k = F.col("o_orderkey")
    return v.table(spark, sf_dir, "orders").select("o_orderkey", rules.proposal_priority(k % 4, k % 100 / 100.0, F.col("o_custkey") % 3 == 0).alias("priority"))


@query("""WITH d AS (SELECT event_id, json_extract_string(props, '$.' || k) AS val, k FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events))
SELECT event_id, sha256('{' || string_agg('"' || k || '":"' || val || '"', ',' ORDER BY k) || '}') AS digest FROM d GROUP BY event_id""")
def json_digests(spark, sf_dir):
    """Digests of JSON objects of plain values, whatever the order of their keys."""
    d = v.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m")).filter(F.size("m") > 0)
    return d.select("event_id", s.canonical_json_digest(F.col("m")).alias("digest"))


@query("""WITH p AS (SELECT sample, k, (sample * (k + 3) % 17 + 1) AS w FROM (SELECT doc_id AS sample FROM documents), range(4) x(k)), n AS (SELECT sample, k, w / sum(w) OVER (PARTITION BY sample) AS p FROM p)
SELECT sample, round(0.9 * -ln(max(p) FILTER (k = sample % 4)) + 0.1 * avg(-ln(p)), 8) AS loss, round(max(p) - list_sort(list(p), 'DESC')[2], 8) AS gap, arg_max(k, (p, -k))::INT AS top FROM n GROUP BY sample""")
def smoothed_losses(spark, sf_dir):
    i = F.col("doc_id")
    w = F.array(*[(i * (k + 3) % 17 + 1).cast("double") for k in range(4)])
    d = v.table(spark, sf_dir, "documents").select(i.alias("sample"), w.alias("w")).withColumn("total", F.aggregate("w", F.lit(0.0), lambda a, b: a + b)).withColumn("p", F.transform("w", lambda x: x / F.col("total")))
    return d.select("sample", F.round(s.smoothed_cross_entropy(F.col("p"), (F.col("sample") % 4).cast("int")), 8).alias("loss"), F.round(s.top_two_gap(F.col("p")), 8).alias("gap"), s.argmax(F.col("p")).alias("top"))


@query("""WITH c AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'rotten_' ELSE 'other' END || p_brand AS name FROM part), x AS (SELECT regexp_extract(lower(name), '^(fresh|rotten)[_-]?(.+)$', 1) AS st, regexp_extract(lower(name), '^(fresh|rotten)[_-]?(.+)$', 2) AS item FROM c)
SELECT item, bool_or(st = 'fresh') AS fresh, bool_or(st = 'rotten') AS rotten, bool_or(st = 'fresh') AND bool_or(st = 'rotten') AS both_states FROM x WHERE st <> '' GROUP BY item""")
def availability(spark, sf_dir):
    k = F.col("p_partkey") % 3
    c = v.table(spark, sf_dir, "part").select(F.concat(F.when(k == 0, "fresh").when(k == 1, "rotten_").otherwise("other"), "p_brand").alias("class")).distinct()
    return tables.availability(c).withColumnRenamed("both", "both_states")


@query("""WITH f AS (SELECT 'n' || doc_id % 90 AS name, CASE doc_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.txt' END AS ext, source AS folder, CASE WHEN doc_id % 40 = 0 THEN 0 ELSE n_chars END AS length FROM documents)
SELECT 'extension' AS facet, ext AS value, count(*) AS n FROM f GROUP BY ext UNION ALL SELECT 'folder', folder, count(*) FROM f GROUP BY folder UNION ALL SELECT 'empty_files', 'all', count(*) FROM f WHERE length = 0 UNION ALL SELECT 'repeated_name', name, count(*) FROM f GROUP BY name HAVING count(*) > 1""")
def file_profile(spark, sf_dir):
    i = F.col("doc_id")
    f = v.table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), (i % 90).cast("string")).alias("name"), F.when(i % 3 == 0, ".jpg").when(i % 3 == 1, ".png").otherwise(".txt").alias("extension"), F.col("source").alias("folder"), F.when(i % 40 == 0, 0).otherwise(F.col("n_chars")).alias("length"))
    return tables.profile(f)


@query("""WITH f AS (SELECT CASE WHEN source IS NULL THEN '.' ELSE source END AS top, source IS NOT NULL AND doc_id % 4 > 0 AS deep, 'n' || doc_id || '.png' AS name, CASE WHEN source IS NOT NULL AND doc_id % 4 > 0 THEN lang WHEN source IS NULL THEN 'data' ELSE source END AS folder, n_chars AS length, n_chars % 9 > 0 AS readable FROM documents),
c AS (SELECT top, count(*) AS n FROM f GROUP BY top), l AS (SELECT n_nationkey, 'src' || n_nationkey AS label, n_regionkey > 1 AS accepted FROM nation), e AS (SELECT label, accepted, coalesce(n, 0) AS n FROM l LEFT JOIN c ON top = label)
SELECT 'extension' AS facet, '.png' AS value, count(*) AS n FROM f UNION ALL SELECT 'folder', folder, count(*) FROM f GROUP BY folder UNION ALL SELECT 'empty_files', 'all', count(*) FROM f WHERE length = 0 HAVING count(*) > 0 UNION ALL SELECT 'repeated_name', name, count(*) FROM f GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'corrupt_files', 'all', count(*) FROM f WHERE NOT readable UNION ALL SELECT 'class', top, n FROM c UNION ALL SELECT 'nested_files', 'all', count(*) FROM f WHERE deep
UNION ALL SELECT CASE WHEN accepted THEN 'accepted_label' ELSE 'rejected_label' END, label, n FROM e UNION ALL SELECT CASE WHEN accepted THEN 'accepted_files' ELSE 'rejected_files' END, 'all', sum(n)::BIGINT FROM e GROUP BY accepted""")
def source_profile(spark, sf_dir):
    """Documents as files of a source: classes by folder, nested and unreadable files, accepted and rejected labels."""
    d = v.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".png"))
    deep = F.when(F.col("doc_id") % 4 > 0, F.col("lang"))
    folder = F.when(F.col("source").isNull(), "data").otherwise(F.coalesce(deep, F.col("source")))
    path = F.concat_ws("/", F.lit("data"), "source", F.when(F.col("source").isNotNull(), deep), name)
    files = d.select(path.alias("path"), name.alias("name"), F.lit(".png").alias("extension"), folder.alias("folder"), F.col("n_chars").alias("length"), (F.col("n_chars") % 9 > 0).alias("readable"))
    labels = v.table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("label"), F.lit("x").alias("class"), (F.col("n_regionkey") > 1).alias("accepted"))
    return tables.profile(files, "data", labels)


@query("""SELECT c_custkey, n_name, n_name IS NOT NULL AS available FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 1) ON n_nationkey = c_nationkey""")
def dimension_lookup(spark, sf_dir):
    n = v.table(spark, sf_dir, "nation").filter("n_regionkey > 1").select(F.concat(F.lit(" N"), F.col("n_nationkey").cast("string")).alias("k"), "n_name")
    c = v.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("k"))
    return tables.lookup(c, n, "k", ["n_name"]).select("c_custkey", "n_name", "available")
