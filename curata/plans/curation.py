"""Queries: exact and near duplicates, splits, leakage, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions.scalar import gradient_hash
from curata.operators import dedup, splits, tables
from curata.plans import views as v
from curata.plans.registry import query
from curata.session import materialize

HASH = "sha256('42:' || {k})"


def _rank_split(place: str, total: str) -> str:
    return f"CASE WHEN {place} < floor({total} * 0.7::DOUBLE + 0.5) THEN 'train' WHEN {place} < floor({total} * (0.7::DOUBLE + 0.15::DOUBLE) + 0.5) THEN 'valid' ELSE 'test' END"


STRATIFIED = f"""s AS (
  SELECT *, {_rank_split("r", "n")} AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {HASH.format(k="doc_id")}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY class) AS n FROM kept))"""


@query(f"""WITH {v.KEPT}, {STRATIFIED},
leak AS (SELECT count(*) AS leaked FROM (SELECT sha FROM s GROUP BY sha HAVING count(DISTINCT split) > 1))
SELECT class, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test, count(*) AS total,
       (SELECT leaked FROM leak) AS leaked
FROM s GROUP BY class""")
def curate_documents(spark, sf_dir):
    """Flagship: exact dedup, stratified split, class x split table with the number of leaked contents."""
    # written, as two aggregates read it: a few columns a document, no texts
    divided = materialize(splits.stratified(v.kept(spark, sf_dir), "class", "doc_id").select("class", "split", "sha"), "divided")
    leaked = dedup.leaked_keys(divided, "sha").agg(F.count("*").alias("leaked"))
    return tables.contingency(divided, "class", "split", list(splits.SPLITS)).crossJoin(leaked)


@query(f"WITH {v.DOCS} SELECT sha, min(doc_id) AS first_id, count(*) AS n FROM docs GROUP BY sha HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return dedup.first_of_each(v.docs(spark, sf_dir), "sha", "doc_id").filter("n > 1")


@query(f"WITH {v.DOCS} SELECT doc_id, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS copy_rank FROM docs")
def copy_ranks(spark, sf_dir):
    return dedup.mark_copies(v.docs(spark, sf_dir), "sha", "doc_id").select("doc_id", F.col("copy_rank").cast("long").alias("copy_rank"))


@query(f"""WITH {v.DOCS}, f AS (SELECT sha, min(doc_id) AS first_id, arg_min(source, doc_id) AS kept_source FROM docs GROUP BY sha)
SELECT kept_source, source AS dropped_source, count(*) AS n FROM docs JOIN f USING (sha) WHERE doc_id <> first_id GROUP BY ALL""")
def copy_report(spark, sf_dir):
    return dedup.copy_report(v.docs(spark, sf_dir), "sha", "doc_id", "source")


@query(f"WITH {v.DOCS} SELECT x.doc_id AS a, y.doc_id AS b FROM docs x JOIN docs y ON x.sha = y.sha AND x.doc_id < y.doc_id")
def equal_pairs(spark, sf_dir):
    return dedup.equal_pairs(v.docs(spark, sf_dir), "sha", "doc_id")


GRADIENT = """h AS (
  SELECT vec_id, list_sum(list_transform(range(1, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN (1::HUGEINT << (len(embedding) - 1 - i)::INT) ELSE 0 END))::BIGINT AS h
  FROM embeddings)"""


@query(f"WITH {GRADIENT} SELECT vec_id, h FROM h")
def gradient_hashes(spark, sf_dir):
    return v.table(spark, sf_dir, "embeddings").select("vec_id", gradient_hash(F.col("embedding")).alias("h"))


DISTANCE = 13


@query(f"WITH {GRADIENT} SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.h, y.h)) <= {DISTANCE}")
def hamming_pairs(spark, sf_dir):
    return dedup.hamming_pairs(gradient_hashes(spark, sf_dir), "h", "vec_id", DISTANCE)


@query(f"""WITH {GRADIENT} SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id
WHERE bit_count(xor(x.h, y.h)) <= 16 AND bit_count(xor(x.h >> 55, y.h >> 55)) <= 2""")
def prefix_probe_pairs(spark, sf_dir):
    return dedup.prefix_probe_pairs(gradient_hashes(spark, sf_dir), "h", "vec_id", 16)


@query(f"""WITH RECURSIVE {v.DOCS}, pairs AS (SELECT DISTINCT source AS a, class || '-' || n_chars % 50 AS b FROM docs),
both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS r FROM both_ UNION SELECT reach.id, both_.b FROM reach JOIN both_ ON reach.r = both_.a)
SELECT id, min(r) AS group_id FROM reach GROUP BY id""")
def linked_groups(spark, sf_dir):
    """Connected components of sources and the (class, length) marks that they share."""
    d = v.docs(spark, sf_dir).select(F.col("source").alias("a"), F.concat(F.col("class"), F.lit("-"), (F.col("n_chars") % 50).cast("string")).alias("b"))
    return dedup.components(d.distinct())


@query(f"""WITH RECURSIVE {GRADIENT}, pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM h x JOIN h y ON x.vec_id <> y.vec_id WHERE bit_count(xor(x.h, y.h)) <= 14),
n AS (SELECT a AS id, list(b) AS near, row_number() OVER (ORDER BY a) AS r FROM pairs GROUP BY a),
f AS (
  SELECT 0::BIGINT AS r, NULL::BIGINT AS id, []::BIGINT[] AS taken, []::BIGINT[] AS mine
  UNION ALL
  SELECT r, id, list_concat(taken, mine), mine
  FROM (SELECT n.r, n.id, f.taken, CASE WHEN list_contains(f.taken, n.id) THEN [] ELSE list_append(list_filter(n.near, lambda x: x > n.id AND NOT list_contains(f.taken, x)), n.id) END AS mine FROM f JOIN n ON n.r = f.r + 1))
SELECT unnest(mine) AS id, id AS anchor FROM f WHERE len(mine) > 1""")
def star_clusters(spark, sf_dir):
    """Direct neighbours of anchors; the SQL goes through the ids one by one."""
    return dedup.hash_stars(gradient_hashes(spark, sf_dir), "h", "vec_id", 14)


@query(f"WITH {v.KEPT}, {STRATIFIED} SELECT doc_id, split FROM s")
def stratified_split(spark, sf_dir):
    return splits.stratified(v.kept(spark, sf_dir), "class", "doc_id").select("doc_id", "split")


BY_HASH = "CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'valid' ELSE 'test' END"
HASHED = f"hs AS (SELECT *, {BY_HASH} AS split FROM (SELECT *, CAST(('0x' || left({HASH.format(k='doc_id')}, 8)) AS BIGINT) / 4294967296.0 AS u FROM docs))"


@query(f"WITH {v.DOCS}, {HASHED} SELECT doc_id, split FROM hs")
def hash_split(spark, sf_dir):
    return splits.by_hash(v.docs(spark, sf_dir), "doc_id").select("doc_id", "split")


@query(f"""WITH {v.DOCS}, g AS (SELECT sha AS unit, arg_min(class, doc_id) AS stratum, count(*) AS n FROM docs GROUP BY sha),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY {HASH.format(k="unit")}, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r, sum(n) OVER (PARTITION BY stratum) AS t FROM g)
SELECT doc_id, {_rank_split("r", "t")} AS split FROM docs JOIN w ON sha = unit""")
def grouped_split(spark, sf_dir):
    return splits.grouped(v.docs(spark, sf_dir), "class", "doc_id", "sha").select("doc_id", "split")


MODAL = """modal AS (SELECT grp, class AS modal, n FROM (SELECT grp, class, n, row_number() OVER (PARTITION BY grp ORDER BY n DESC, class) AS r
  FROM (SELECT source AS grp, class, count(*) AS n FROM docs GROUP BY ALL)) WHERE r = 1)"""


@query(f"WITH {v.DOCS}, {MODAL} SELECT grp AS source, modal, n FROM modal")
def modal_classes(spark, sf_dir):
    return splits.modal_class(v.docs(spark, sf_dir), "source", "class")


@query(f"""WITH {v.DOCS}, u AS (SELECT source || '/' || doc_id % 5 AS unit, class, count(*) AS n FROM docs GROUP BY ALL),
m AS (SELECT unit, class AS modal FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, class) AS r FROM u) WHERE r = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY modal ORDER BY {HASH.format(k="unit")}, unit) - 1 AS place, count(*) OVER (PARTITION BY modal) AS n FROM m),
e AS (SELECT *, n * 0.7::DOUBLE AS e0, n * 0.15::DOUBLE AS e1, n * 0.15::DOUBLE AS e2 FROM r), b AS (SELECT *, floor(e0) AS b0, floor(e1) AS b1, floor(e2) AS b2, n - floor(e0) - floor(e1) - floor(e2) AS rest FROM e),
p AS (SELECT *, b0 + ((e1 - b1 > e0 - b0)::INT + (e2 - b2 > e0 - b0)::INT < rest)::INT AS p0, b1 + ((e0 - b0 >= e1 - b1)::INT + (e2 - b2 > e1 - b1)::INT < rest)::INT AS p1, b2 + ((e0 - b0 >= e2 - b2)::INT + (e1 - b1 >= e2 - b2)::INT < rest)::INT AS p2 FROM b),
q AS (SELECT *, CASE WHEN n >= 3 THEN (p0 = 0)::INT + (p1 = 0)::INT + (p2 = 0)::INT ELSE 0 END AS gives, list_position([p0, p1, p2], greatest(p0, p1, p2)) AS top FROM p),
z AS (SELECT *, CASE WHEN n >= 3 AND p0 = 0 THEN 1 ELSE p0 - CASE WHEN top = 1 THEN gives ELSE 0 END END AS q0, CASE WHEN n >= 3 AND p1 = 0 THEN 1 ELSE p1 - CASE WHEN top = 2 THEN gives ELSE 0 END END AS q1 FROM q)
SELECT unit, modal, CASE WHEN place < q0 THEN 'train' WHEN place < q0 + q1 THEN 'valid' ELSE 'test' END AS split FROM z""")
def group_split(spark, sf_dir):
    """Groups by modal class and largest remainder."""
    d = v.docs(spark, sf_dir).withColumn("unit", F.concat("source", F.lit("/"), (F.col("doc_id") % 5).cast("string")))
    return splits.group_split(d, "unit", "class")


@query(f"WITH {v.DOCS}, {HASHED} SELECT class, split, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 1) AS percent FROM hs GROUP BY class, split")
def split_shares(spark, sf_dir):
    return tables.split_shares(splits.by_hash(v.docs(spark, sf_dir), "doc_id"), "class", "split")


@query(f"""WITH {v.DOCS}, c AS (SELECT class, count(*) AS n FROM docs GROUP BY class)
SELECT max(n) AS most, min(n) AS least, arg_min(class, (n, class)) AS rarest, max(n)::DOUBLE / min(n) AS ratio, max(n)::DOUBLE / min(n) <= 3.0 AS balanced, min(n) FILTER (n > 0) AS least_nonzero, round(max(n)::DOUBLE / min(n) FILTER (n > 0), 3) AS ratio_nonzero FROM c""")
def class_imbalance(spark, sf_dir):
    return tables.imbalance(v.docs(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n")))


@query(f"WITH {v.DOCS} SELECT class, source, grouping(class) * 2 + grouping(source) AS level, count(*) AS n FROM docs GROUP BY ROLLUP (class, source)")
def counts_with_totals(spark, sf_dir):
    d = tables.with_totals(v.docs(spark, sf_dir), ["class", "source"])
    return d.withColumn("level", F.col("level").cast("long"))


@query(f"""WITH {v.DOCS}, {HASHED}, l AS (SELECT sha, list_sort(list(DISTINCT split)) AS sp FROM hs GROUP BY sha HAVING count(DISTINCT split) > 1),
a AS (SELECT sp, unnest(sp) AS split_a FROM l), b AS (SELECT split_a, unnest(sp) AS split_b FROM a)
SELECT split_a, split_b, count(*) AS n FROM b WHERE split_a < split_b GROUP BY ALL""")
def leaked_pairs(spark, sf_dir):
    return dedup.leaked_pairs(splits.by_hash(v.docs(spark, sf_dir), "doc_id"), "sha")


@query(f"""WITH {v.DOCS}, {HASHED} SELECT n_chars, count(DISTINCT split) AS n_splits, count(DISTINCT class) AS n_classes, count(DISTINCT class) = 1 AS fails
FROM hs GROUP BY n_chars HAVING count(DISTINCT split) > 1""")
def group_leaks(spark, sf_dir):
    return dedup.group_leaks(splits.by_hash(v.docs(spark, sf_dir), "doc_id"), "n_chars", "split", "class")


@query(f"""WITH {v.DOCS}, {HASHED} SELECT x.doc_id AS a, y.doc_id AS b, x.split AS split_a, y.split AS split_b
FROM hs x JOIN hs y ON x.sha = y.sha AND x.doc_id < y.doc_id AND x.split <> y.split""")
def cross_split_copies(spark, sf_dir):
    d = splits.by_hash(v.docs(spark, sf_dir), "doc_id")
    return dedup.cross_split_pairs(dedup.equal_pairs(d, "sha", "doc_id"), d, "doc_id", "split")


@query(f"""WITH {v.DOCS}, r AS (SELECT sha256(doc_id || chr(9) || sha) AS h FROM docs),
b AS (SELECT left(h, 3) AS k, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM r GROUP BY k)
SELECT sha256(string_agg(d, chr(10) ORDER BY k)) AS digest, sum(n)::BIGINT AS n FROM b""")
def dataset_digest(spark, sf_dir):
    return dedup.ordered_digest(v.docs(spark, sf_dir), "doc_id", "sha")


@query(f"""WITH {v.DOCS}, {HASHED} SELECT doc_id, split FROM hs WHERE split = 'test' OR doc_id % 4 <> 0""")
def exclusion_build(spark, sf_dir):
    d = splits.by_hash(v.docs(spark, sf_dir), "doc_id").select("doc_id", "split")
    return splits.exclude(d, d.filter("doc_id % 4 = 0"), "doc_id")


@query(f"""WITH {v.DOCS}, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM docs)
SELECT r.doc_id FROM r JOIN (SELECT DISTINCT floor(i * (SELECT count(*) FROM docs) / 37.0)::BIGINT AS at FROM range(37) t(i)) k ON r.r = k.at""")
def stride_sample(spark, sf_dir):
    return splits.stride_sample(v.docs(spark, sf_dir).select("doc_id"), ["doc_id"], 37)


@query(f"""WITH {v.DOCS}, {HASHED}, c AS (SELECT class, count(*) FILTER (split='train') AS train, count(*) FILTER (split='valid') AS valid, count(*) FILTER (split='test') AS test, count(*) AS total FROM hs GROUP BY class)
SELECT *, CASE WHEN total < 20 THEN 'critical' WHEN total < 50 THEN 'insufficient' WHEN valid < 10 OR test < 10 THEN 'thin_evaluation' ELSE 'ready' END AS verdict FROM c""")
def class_readiness(spark, sf_dir):
    from curata.operators.rules import readiness

    d = splits.by_hash(v.docs(spark, sf_dir), "doc_id")
    return readiness(tables.contingency(d, "class", "split", list(splits.SPLITS)).drop("total"))


FAULTS = """bad AS (SELECT doc_id FROM docs WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id FROM docs WHERE doc_id % 7 = 0 AND doc_id % 5 <> 0 UNION ALL SELECT -1 - doc_id FROM docs WHERE doc_id % 11 = 0)"""


@query(f"""WITH {v.DOCS}, {FAULTS}, o AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS d FROM docs), m AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS d FROM bad),
w AS (SELECT count(*) AS n FROM bad WHERE doc_id NOT IN (SELECT doc_id FROM docs))
SELECT 'sound' AS partition, c AS "check", true AS passed FROM (VALUES ('row_count'), ('distinct_ids'), ('no_new_rows')) x(c)
UNION ALL SELECT 'faulty', 'row_count', o.n = m.n FROM o, m UNION ALL SELECT 'faulty', 'distinct_ids', o.d = m.d FROM o, m UNION ALL SELECT 'faulty', 'no_new_rows', n = 0 FROM w""")
def partition_checks(spark, sf_dir):
    """The checks of a sound split, and of one that lost rows, doubled some and made up others."""
    d = v.docs(spark, sf_dir)
    found = splits.check_partition(d, splits.stratified(d, "class", "doc_id"), "doc_id").withColumn("partition", F.lit("sound"))
    i = F.col("doc_id")
    bad = d.filter(i % 5 != 0).select("doc_id").unionByName(d.filter((i % 7 == 0) & (i % 5 != 0)).select("doc_id")).unionByName(d.filter(i % 11 == 0).select((-1 - i).alias("doc_id")))
    return found.unionByName(splits.check_partition(d, bad, "doc_id").withColumn("partition", F.lit("faulty")))


@query(f"WITH {v.DOCS}, f AS (SELECT sha, min(doc_id) AS first_id FROM docs GROUP BY sha) SELECT first_id, doc_id AS id FROM docs JOIN f USING (sha) WHERE doc_id <> first_id")
def copy_stars(spark, sf_dir):
    return dedup.copy_stars(v.docs(spark, sf_dir), "sha", "doc_id")


@query(f"""WITH {v.DOCS}, {HASHED}, h AS (SELECT sha, split, min(doc_id) AS first, count(*) AS n FROM hs GROUP BY ALL)
SELECT a.sha, a.split AS split_a, a.first AS first_a, a.n AS n_a, b.split AS split_b, b.first AS first_b, b.n AS n_b FROM h a JOIN h b ON a.sha = b.sha AND a.split < b.split""")
def cross_split_groups(spark, sf_dir):
    return dedup.cross_split_groups(splits.by_hash(v.docs(spark, sf_dir), "doc_id"), "sha", "doc_id", "split")


RANK_ONE = """CASE WHEN r < CASE WHEN t >= 3 THEN least(greatest(floor(t * 0.7::DOUBLE + 0.5), 1), t - 2) ELSE floor(t * 0.7::DOUBLE + 0.5) END THEN 'train'
WHEN r < CASE WHEN t >= 3 THEN least(greatest(floor(t * (0.7::DOUBLE + 0.15::DOUBLE) + 0.5), CASE WHEN t >= 3 THEN least(greatest(floor(t * 0.7::DOUBLE + 0.5), 1), t - 2) END + 1), t - 1) ELSE floor(t * (0.7::DOUBLE + 0.15::DOUBLE) + 0.5) END THEN 'valid' ELSE 'test' END"""


@query(f"""WITH {v.DOCS}, s AS (SELECT *, source || '/' || n_chars % 100 AS stratum FROM docs), g AS (SELECT sha AS unit, arg_min(stratum, doc_id) AS stratum, count(*) AS n FROM s GROUP BY sha),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY {HASH.format(k="unit")}, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r, sum(n) OVER (PARTITION BY stratum) AS t FROM g)
SELECT doc_id, {RANK_ONE} AS split FROM docs JOIN w ON sha = unit""")
def grouped_split_least_one(spark, sf_dir):
    """Small strata: each of three rows or more leaves room in every split."""
    d = v.docs(spark, sf_dir).withColumn("stratum", F.concat("source", F.lit("/"), (F.col("n_chars") % 100).cast("string")))
    return splits.grouped(d, "stratum", "doc_id", "sha", least_one=True).select("doc_id", "split")


@query(f"""WITH s AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY {HASH.format(k="conv_id")}, conv_id) - 1 AS r, count(*) OVER () AS n FROM s)
SELECT conv_id, CASE WHEN r < greatest(1, floor(n * 0.7::DOUBLE + 0.5)) THEN 'train' WHEN r < greatest(1, floor(n * 0.7::DOUBLE + 0.5)) + floor(n * 0.15::DOUBLE + 0.5) THEN 'valid' ELSE 'test' END AS split FROM r""")
def session_split(spark, sf_dir):
    return splits.session_split(v.table(spark, sf_dir, "conversations"), "conv_id")


@query("SELECT conv_id, turn, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS session FROM conversations JOIN labels ON conv_id = doc_id WHERE quality IS NOT NULL AND toxic = 0")
def resolved_sessions(spark, sf_dir):
    """Turns with a session from a lookup; those that it lacks, or gives none for, go."""
    lookup = v.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), F.when(F.col("toxic") == 0, F.when(F.col("quality") == 1, "good").when(F.col("quality").isNotNull(), "poor")).otherwise("").alias("session"))
    return splits.by_lookup(v.table(spark, sf_dir, "conversations"), lookup, "conv_id", "session").select("conv_id", "turn", "session")


@query(f"""WITH {v.DOCS}, {HASHED} SELECT split, count(*) AS source, count(*) FILTER (split <> 'test' AND doc_id % 4 = 0) AS excluded, count(*) - count(*) FILTER (split <> 'test' AND doc_id % 4 = 0) AS kept FROM hs GROUP BY split""")
def exclusion_counts(spark, sf_dir):
    d = splits.by_hash(v.docs(spark, sf_dir), "doc_id").select("doc_id", "split")
    return splits.exclusion_counts(d, d.filter("doc_id % 4 = 0"), "doc_id")


@query("SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_exclusions(spark, sf_dir):
    return splits.repeated_exclusions(v.docs(spark, sf_dir), "sha")


@query(f"""WITH {v.DOCS}, u AS (SELECT class, doc_id, 0 AS source_rank FROM docs WHERE source IS NULL OR doc_id % 2 = 0 UNION ALL SELECT class, doc_id, 1 FROM docs)
SELECT doc_id, min(source_rank)::INT AS source_rank, count(*) AS n FROM u GROUP BY doc_id""")
def ordered_union(spark, sf_dir):
    d = v.docs(spark, sf_dir).select("class", "doc_id")
    both = tables.ordered_union(v.docs(spark, sf_dir).filter("source IS NULL OR doc_id % 2 = 0").select("doc_id", "class"), d)
    return both.groupBy("doc_id").agg(F.min("source_rank").alias("source_rank"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT c_nationkey % 20 AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier), c AS (SELECT DISTINCT n_nationkey AS k FROM nation),
x AS (SELECT 'customers-suppliers' AS pair, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS left_only, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS right_only
UNION ALL SELECT 'nations-nations', 0, 0 UNION ALL SELECT 'suppliers-orders', (SELECT count(*) FROM b WHERE k NOT IN (SELECT o_orderkey FROM orders)), (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM b)))
SELECT pair, left_only = 0 AND right_only = 0 AS equal, left_only::BIGINT AS left_only, right_only::BIGINT AS right_only FROM x""")
def set_equality(spark, sf_dir):
    a = v.table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 20).cast("long").alias("k"))
    b = v.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    c = v.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    o = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    named = [("customers-suppliers", a, b), ("nations-nations", c, c), ("suppliers-orders", b, o)]
    found = [tables.same_sets(x, y, "k").withColumn("pair", F.lit(n)) for n, x, y in named]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""SELECT doc_id, list_has_any(string_split(coalesce(source, ''), '_'), string_split(coalesce(lang, ''), '_')) OR len(list_intersect([n_chars % 3, n_chars % 5], [n_chars % 4])) > 0 AS overlap FROM documents""")
def set_overlaps(spark, sf_dir):
    n = F.col("n_chars")
    d = v.table(spark, sf_dir, "documents")
    words = lambda c: F.split(F.coalesce(c, F.lit("")), "_")
    both = tables.overlaps(d.withColumns({"a": words("source"), "b": words("lang"), "c": F.array(n % 3, n % 5), "d": F.array(n % 4)}), "a", "b").withColumnRenamed("overlap", "names")
    return tables.overlaps(both, "c", "d").select("doc_id", (F.col("names") | F.col("overlap")).alias("overlap"))
