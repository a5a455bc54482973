"""Queries: resolutions by action, manifests against files, calibration, held-back rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import boxes, calibration, resolve, review, rules, splits
from curata.plans import detection
from curata.plans import views as v
from curata.plans.registry import query

CLASSES = 4
#: Actions by category, as the queries deal them; the last of each isn't one of the category's.
ACTIONS = {
    "A_EMPTY_LABEL": ["MANUALLY_ANNOTATE", "CONFIRM_BACKGROUND", "MARK_UNCERTAIN", "KEEP"],
    "B_MANUAL_REVIEW": ["KEEP", "TIGHTEN", "REPLACE", "UNCERTAIN", "CORRECT"],
    "C_TIGHTEN": ["TIGHTEN", "KEEP", "UNCERTAIN", "REPLACE", "ACCEPT_ALL"],
    "D_UNCERTAIN": ["ACCEPT_SELECTED", "ACCEPT_ALL", "REJECT_SELECTED", "KEEP_ORIGINAL", "CORRECT", "UNCERTAIN", "TIGHTEN"],
}


def _image(i):
    return F.concat(F.lit("img"), i.cast("string"))


def _inputs(spark, sf_dir):
    """Records are orders, several to the image of a customer; the manifest has a row for each customer, and a second one for some."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    box = F.array(*[F.lit(x) for x in (1.0, 0.5, 0.5, 0.9, 0.9)])
    records = v.table(spark, sf_dir, "orders").select(
        o.alias("record"), _image(F.col("o_custkey")).alias("image"), F.concat(F.lit("p"), (o % 5).cast("string")).alias("proposal_id"), F.lit("open").alias("decision"), F.when(o % 3 > 0, "review").alias("action"),
        F.when(o % 2 == 0, box).alias("bbox"), F.lit(None).cast("string").alias("reviewer"), F.col("o_orderpriority").alias("notes"),
    )
    customers = v.table(spark, sf_dir, "customer")
    category = F.element_at(F.array(*[F.lit(k) for k in (*ACTIONS, "E_OTHER")]), (c % 5 + 1).cast("int"))
    words = F.create_map(*[x for k, a in ACTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, a)))])
    mine = words[F.col("category")]
    row = F.array(F.lit(1.0), (c % 9 + 1) / 10.0, F.lit(0.5), F.lit(0.2), F.when(c % 11 == 0, 1.5).otherwise(0.25))
    own = customers.select(c, category.alias("category"), _image(c).alias("image"), F.when(c % 7 > 0, row).alias("coordinates"), F.when(c % 3 > 0, F.array(F.lit("p0"), F.lit("p3"))).alias("proposal_ids"), F.when(c % 2 == 0, F.concat(F.lit("by "), c.cast("string"))).otherwise(F.lit("")).alias("notes"))
    own = own.withColumn("action", F.get(mine, (F.floor(c / 5) % F.size(mine)).cast("int")))
    fields = ("image", "category", "action", "coordinates", "proposal_ids", "notes")
    again = {"image": F.col("image"), "category": F.lit("B_MANUAL_REVIEW"), "action": F.lit("KEEP"), "coordinates": F.lit(None).cast("array<double>"), "proposal_ids": F.lit(None).cast("array<string>"), "notes": F.lit("")}
    twice = F.when(c % 17 == 0, F.struct(*[again[f].alias(f) for f in fields]))
    return records, own.select(F.explode(F.array_compact(F.array(F.struct(*fields), twice))).alias("m")).select("m.*")


_LISTS = " ".join(f"WHEN '{k}' THEN {a!r}" for k, a in ACTIONS.items())
#: The rules of each action, written out by category.
RESOLVED = f"""r AS (SELECT o_orderkey AS record, 'img' || o_custkey AS image, 'p' || o_orderkey % 5 AS proposal_id, 'open' AS decision, CASE WHEN o_orderkey % 3 > 0 THEN 'review' END AS action,
  CASE WHEN o_orderkey % 2 = 0 THEN [1.0, 0.5, 0.5, 0.9, 0.9]::DOUBLE[] END AS bbox, NULL::VARCHAR AS reviewer, o_orderpriority AS notes FROM orders),
m0 AS (SELECT c_custkey AS c, 'img' || c_custkey AS image, ['A_EMPTY_LABEL', 'B_MANUAL_REVIEW', 'C_TIGHTEN', 'D_UNCERTAIN', 'E_OTHER'][c_custkey % 5 + 1] AS category FROM customer),
m1 AS (SELECT image, category, CASE category {_LISTS} END AS words, c, CASE WHEN c % 7 > 0 THEN [1.0, (c % 9 + 1) / 10.0::DOUBLE, 0.5, 0.2, CASE WHEN c % 11 = 0 THEN 1.5 ELSE 0.25 END]::DOUBLE[] END AS row_, CASE WHEN c % 3 > 0 THEN ['p0', 'p3'] ELSE [] END AS ids, CASE WHEN c % 2 = 0 THEN 'by ' || c ELSE '' END AS note FROM m0),
m AS (SELECT image, category, words[c // 5 % len(words) + 1] AS act, row_, ids, note FROM m1 UNION ALL SELECT 'img' || c_custkey, 'B_MANUAL_REVIEW', 'KEEP', NULL, [], '' FROM customer WHERE c_custkey % 17 = 0),
w AS (SELECT *, count(*) OVER (PARTITION BY image) AS n,
  CASE WHEN category = 'A_EMPTY_LABEL' THEN act IN ('MANUALLY_ANNOTATE', 'CONFIRM_BACKGROUND', 'MARK_UNCERTAIN') WHEN category IN ('B_MANUAL_REVIEW', 'C_TIGHTEN') THEN act IN ('KEEP', 'TIGHTEN', 'REPLACE', 'UNCERTAIN')
    WHEN category = 'D_UNCERTAIN' THEN act IN ('ACCEPT_SELECTED', 'ACCEPT_ALL', 'REJECT_SELECTED', 'KEEP_ORIGINAL', 'CORRECT', 'UNCERTAIN') ELSE false END AS allowed,
  act IN ('MANUALLY_ANNOTATE', 'TIGHTEN', 'REPLACE') AS drawn, act IN ('ACCEPT_SELECTED', 'REJECT_SELECTED', 'CORRECT') AS chosen, (SELECT list(DISTINCT proposal_id) FROM r WHERE r.image = m.image) AS has FROM m),
f AS (SELECT *, CASE WHEN row_[2] < 0 OR row_[2] > 1 OR row_[3] < 0 OR row_[3] > 1 THEN 'center' WHEN row_[4] <= 0 OR row_[4] > 1 OR row_[5] <= 0 OR row_[5] > 1 THEN 'size'
  WHEN row_[2] - row_[4] / 2 < 0 OR row_[2] + row_[4] / 2 > 1 OR row_[3] - row_[5] / 2 < 0 OR row_[3] + row_[5] / 2 > 1 THEN 'outside_frame' END AS wrong FROM w),
l AS (SELECT *, CASE WHEN category = 'E_OTHER' THEN 'refused unknown_category' WHEN NOT allowed THEN 'refused action_not_allowed' WHEN has IS NULL THEN 'skipped no_record' WHEN n > 1 THEN 'refused repeated'
  WHEN act IN ('UNCERTAIN', 'MARK_UNCERTAIN') THEN 'skipped stays_blocked' WHEN drawn AND row_ IS NULL THEN 'refused no_coordinates' WHEN drawn AND wrong IS NOT NULL THEN 'refused ' || wrong
  WHEN chosen AND NOT list_has_any(ids, has) THEN 'skipped nothing_listed' ELSE 'applied' END AS verdict FROM f),
k AS (SELECT r.*, l.act, l.row_, l.drawn, l.category, l.act IS NOT NULL AND (NOT l.chosen OR list_contains(l.ids, r.proposal_id)) AS hit, coalesce(nullif(l.note, ''), 'human resolution') AS note,
  first_value(r.proposal_id) OVER o AS p1, first_value(r.action) OVER o AS a1 FROM r LEFT JOIN l ON l.image = r.image AND l.verdict = 'applied' WINDOW o AS (PARTITION BY r.image ORDER BY r.record)),
g AS (SELECT record, image, CASE WHEN hit AND category <> 'D_UNCERTAIN' THEN p1 ELSE proposal_id END AS proposal_id,
  CASE WHEN NOT hit THEN decision WHEN act = 'MANUALLY_ANNOTATE' THEN 'annotate' WHEN act = 'CONFIRM_BACKGROUND' THEN 'keep_empty' WHEN act = 'KEEP' THEN 'keep' WHEN act IN ('TIGHTEN', 'REPLACE') THEN 'tighten' WHEN act IN ('ACCEPT_SELECTED', 'ACCEPT_ALL') THEN 'accepted'
    WHEN act = 'REJECT_SELECTED' THEN 'rejected' WHEN act = 'KEEP_ORIGINAL' THEN 'kept' WHEN act = 'CORRECT' THEN 'corrected' END AS decision,
  CASE WHEN NOT hit THEN action WHEN drawn THEN 'manual_annotation_supplied' WHEN act IN ('KEEP', 'CONFIRM_BACKGROUND') THEN 'no_change' ELSE action END AS action,
  CASE WHEN NOT hit THEN bbox WHEN drawn THEN row_ WHEN act IN ('KEEP', 'CONFIRM_BACKGROUND') THEN NULL ELSE bbox END AS bbox, CASE WHEN hit THEN 'human' ELSE reviewer END AS reviewer, CASE WHEN hit THEN note ELSE notes END AS notes FROM k)"""

_TEXT = "array_to_string(list_transform({0}, lambda x: CASE WHEN x = floor(x) THEN x::INT || '.0' ELSE x::VARCHAR END), ' ')"


@query(f"WITH {RESOLVED} SELECT record, image, proposal_id, decision, action, {_TEXT.format('bbox')} AS bbox, reviewer, notes FROM g")
def merged_actions(spark, sf_dir):
    """Records after the manifest: decisions, boxes, action words, reviewers and notes."""
    merged, _ = resolve.merge(*_inputs(spark, sf_dir), CLASSES)
    return merged.withColumn("bbox", F.array_join(F.transform("bbox", lambda x: x.cast("string")), " "))


@query(f"WITH {RESOLVED} SELECT image, category, act AS action, split_part(verdict, ' ', 1) AS status, nullif(split_part(verdict, ' ', 2), '') AS detail FROM l")
def merge_log(spark, sf_dir):
    return resolve.merge(*_inputs(spark, sf_dir), CLASSES)[1]


@query(f"""WITH {RESOLVED}, b AS (SELECT g.record, g.image, unnest([{", ".join(f"{{'field': '{c}', 'before': {_TEXT.format('r.bbox') if c == 'bbox' else 'r.' + c}, 'after': {_TEXT.format('g.bbox') if c == 'bbox' else 'g.' + c}}}" for c in ["proposal_id", *resolve.FIELDS])}]) AS x FROM g JOIN r USING (record))
SELECT record, image, x.field AS field, x.before AS before, x.after AS after FROM b WHERE x.before IS DISTINCT FROM x.after""")
def merge_changes(spark, sf_dir):
    """The dry run: each field that the merge changes, before and after."""
    records, manifest = _inputs(spark, sf_dir)
    return resolve.changes(records, resolve.merge(records, manifest, CLASSES)[0])


@query(f"""WITH {v.MANIFEST}, files AS (SELECT 'p/' || doc_id * 5 % 995 || '.jpg' AS path, md5(arg_min(lang || n_chars % 40, doc_id)) AS d FROM documents GROUP BY 1),
j AS (SELECT row_number, image_path, d FROM m LEFT JOIN files ON path = image_path),
a AS (SELECT *, first_value(image_path) OVER (PARTITION BY d ORDER BY row_number) AS first FROM j WHERE d IS NOT NULL)
SELECT row_number::VARCHAR AS ref, 'missing_file' AS kind, 'error' AS severity, image_path AS detail FROM j WHERE d IS NULL
UNION ALL SELECT row_number::VARCHAR, 'duplicate_file', 'error', first || ' = ' || image_path FROM a WHERE image_path <> first""")
def manifest_file_findings(spark, sf_dir):
    """A manifest against a listing of files: a path has the bytes that its first document's class and length make."""
    path = F.concat(F.lit("p/"), (F.col("doc_id") * 5 % 995).cast("string"), F.lit(".jpg"))
    mark = F.concat("lang", (F.col("n_chars") % 40).cast("string"))
    files = v.table(spark, sf_dir, "documents").groupBy(path.alias("path")).agg(F.md5(F.min_by(mark, "doc_id").cast("binary")).alias("md5"))
    return rules.manifest_files(v.manifest_rows(spark, sf_dir), files)


def _logits(spark, sf_dir):
    """Scores of four classes from an embedding, and a label that is their greatest more often than not."""
    e = F.transform(F.slice("embedding", 1, CLASSES), lambda x: x.cast("double") * 40)
    top = F.array_position(e, F.array_max(e)) - 1
    df = v.table(spark, sf_dir, "embeddings").select("vec_id", e.alias("logits"), top.alias("top"))
    return df.withColumn("label", F.when(F.col("vec_id") % 5 < 3, F.col("top")).otherwise(F.col("vec_id") % CLASSES).cast("int"))


_LOGITS = f"""z AS (SELECT vec_id, list_transform(embedding[1:{CLASSES}], lambda x: x::DOUBLE * 40) AS z FROM embeddings), t AS (SELECT *, list_position(z, list_max(z)) - 1 AS top FROM z),
y AS (SELECT *, CASE WHEN vec_id % 5 < 3 THEN top ELSE vec_id % {CLASSES} END AS y FROM t)"""
_LOSS = "ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / {t})))) - (z[y + 1] - list_max(z)) / {t}"


@query(f"""WITH {_LOGITS}, g AS (SELECT exp(ln(0.05::DOUBLE) + i * (ln(50.0::DOUBLE) - ln(0.05::DOUBLE)) / 3000) AS temp FROM range(3001) x(i)),
l AS (SELECT temp, avg({_LOSS.format(t="temp")}) AS loss FROM g, y GROUP BY temp), b AS (SELECT * FROM l ORDER BY loss LIMIT 1)
SELECT round((SELECT loss FROM b), 4) AS loss, round((SELECT avg({_LOSS.format(t="1")}) FROM y), 4) AS loss_before, (SELECT count(*) FROM y) AS n, (SELECT temp FROM b) > 1 AS softer""")
def fitted_temperature(spark, sf_dir):
    """The least mean negative log likelihood over temperatures; the SQL tries 3001 of them."""
    found = calibration.fit_temperature(_logits(spark, sf_dir))
    return spark.createDataFrame([(round(found["loss"], 4), round(found["loss_before"], 4), int(found["n"]), found["temperature"] > 1)], "loss double, loss_before double, n long, softer boolean")


@query(f"""WITH {_LOGITS}, c AS (SELECT vec_id, list_max(p) AS confidence, list_position(p, list_max(p)) - 1 = y AS ok FROM (SELECT vec_id, y, list_transform(z, lambda x: exp((x - list_max(z)) / 2) / list_sum(list_transform(z, lambda w: exp((w - list_max(z)) / 2)))) AS p FROM y)),
b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, abs(avg(confidence) - avg(ok::INT)) AS gap FROM c GROUP BY 1) SELECT round(sum(gap * n) / sum(n), 8) AS error, sum(n)::BIGINT AS n FROM b""")
def calibration_error(spark, sf_dir):
    p = calibration.calibrated(_logits(spark, sf_dir), 2.0)
    top = F.array_max("probabilities")
    d = p.select(top.alias("confidence"), (F.array_position("probabilities", top) - 1 == F.col("label")).alias("ok"))
    return calibration.calibration_error(d, "confidence", "ok").withColumn("error", F.round("error", 8))


def _hash(c: str) -> str:
    return f"sha256('42:' || {c})"


_QUOTA = """c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), a AS (SELECT sum(n) AS n, ceil(sum(n) * 0.15::DOUBLE / (1 - 0.2::DOUBLE) - 1e-9)::BIGINT AS held FROM c),
q0 AS (SELECT lang, c.n * held // a.n AS f, c.n * held % a.n AS rest FROM c, a), q AS (SELECT lang, f + (row_number() OVER (ORDER BY rest DESC, lang NULLS FIRST) <= (SELECT held FROM a) - (SELECT sum(f) FROM q0))::INT AS take FROM q0)"""


@query(f"WITH {_QUOTA}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_hash('doc_id')}, doc_id) AS r FROM documents) SELECT doc_id, CASE WHEN r <= take THEN 'valid' ELSE 'train' END AS split FROM r JOIN q ON r.lang IS NOT DISTINCT FROM q.lang")
def held_back_rows(spark, sf_dir):
    """A validation share of 0.15 / (1 - 0.2) of each language."""
    return splits.held_back(v.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.15, 0.2).select("doc_id", "split")


@query(f"""WITH l AS (SELECT doc_id, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN 'rare' ELSE lang END AS lang FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY {_hash('doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM l)
SELECT doc_id, CASE WHEN r <= ceil(n * 0.15::DOUBLE / (1 - 0.2::DOUBLE) - 1e-9) THEN 'valid' ELSE 'train' END AS split FROM r""")
def held_back_plain(spark, sf_dir):
    """One class has a single row, so the rows are divided without regard to classes."""
    d = v.table(spark, sf_dir, "documents").select("doc_id", "lang")
    least = d.agg(F.min("doc_id").alias("least"))
    d = d.join(F.broadcast(least), F.col("doc_id") == F.col("least"), "left").withColumn("lang", F.when(F.col("least").isNotNull(), "rare").otherwise(F.col("lang")))
    return splits.held_back(d.select("doc_id", "lang"), "lang", "doc_id", 0.15, 0.2).select("doc_id", "split")


@query("""WITH r AS (SELECT o_orderkey AS record, 'img' || o_custkey % 200 AS image, CASE o_orderkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'corrected' ELSE 'accepted' END AS decision, CASE WHEN o_custkey % 200 % 7 > 0 THEN 100.0 END AS size FROM orders),
p AS (SELECT l_orderkey AS record, CASE l_linenumber % 4 WHEN 0 THEN 'apple' WHEN 1 THEN 'pear' WHEN 3 THEN 'plum' END AS cn, l_linenumber * 10 % 50 AS x1, l_orderkey % 3 * 10 AS y1, l_linenumber * 10 % 50 + 20 + l_linenumber % 2 * 50 AS x2, l_orderkey % 3 * 10 + 20 AS y2 FROM lineitem),
j AS (SELECT r.*, decision IN ('accepted', 'corrected') AS ch, p.record AS has, cn, x1, y1, x2, y2, CASE WHEN cn = 'plum' THEN 'class_name' WHEN size IS NOT NULL AND (x2 <= x1 OR y2 <= y1 OR x1 < 0 OR y1 < 0 OR x2 > size OR y2 > size) THEN 'outside_frame' END AS why FROM r LEFT JOIN p USING (record)),
a AS (SELECT record, image, decision, ch, count(has) AS before, count(has) FILTER (NOT ch OR why IS NULL) AS kept, count(has) FILTER (ch AND why = 'class_name') AS bad_class, count(has) FILTER (ch AND why = 'outside_frame') AS bad_box,
  coalesce(array_to_string(list_sort(list(DISTINCT concat_ws(',', coalesce(cn, '?'), x1, y1, x2, y2)) FILTER (has IS NOT NULL AND why IS NULL)), ';'), '') AS sign FROM j GROUP BY ALL),
b AS (SELECT *, ch AND before > 0 AND kept = 0 AS emptied FROM a), c AS (SELECT *, min(CASE WHEN ch AND NOT emptied THEN record END) OVER (PARTITION BY image, sign, ch AND NOT emptied) AS first FROM b)
SELECT record, kept, bad_class, bad_box, CASE WHEN emptied THEN 'emptied' WHEN ch AND record > first THEN 'duplicate' END AS dropped FROM c""")
def repaired_records(spark, sf_dir):
    """Orders as records, their items as proposals; copies of an image's records and malformed proposals go."""
    o, k, n = F.col("o_orderkey"), F.col("l_orderkey"), F.col("l_linenumber")
    x1 = n * 10 % 50
    p = F.struct(F.when(n % 4 == 0, "apple").when(n % 4 == 1, "pear").when(n % 4 == 3, "plum").alias("class_name"), x1.cast("double").alias("x1"), (k % 3 * 10).cast("double").alias("y1"), (x1 + 20 + n % 2 * 50).cast("double").alias("x2"), (k % 3 * 10 + 20).cast("double").alias("y2"))
    proposals = v.table(spark, sf_dir, "lineitem").groupBy(k.alias("record")).agg(F.collect_list(p).alias("proposals"))
    image = F.col("o_custkey") % 200
    size = F.when(image % 7 > 0, F.lit(100.0))
    records = v.table(spark, sf_dir, "orders").select(o.alias("record"), _image(image).alias("image"), F.when(o % 5 == 0, "rejected").when(o % 5 == 1, "uncertain").when(o % 5 == 2, "corrected").otherwise("accepted").alias("decision"), size.alias("width"), size.alias("height"))
    d = rules.repair_records(records.join(proposals, "record", "left"), ["apple", "pear"])
    bad = lambda why: F.size(F.filter("removed", lambda x: x["reason"] == why)).cast("long")
    return d.select("record", F.size("proposals").cast("long").alias("kept"), bad("class_name").alias("bad_class"), bad("outside_frame").alias("bad_box"), "dropped")


@query("""WITH i AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 3 = 0 THEN 'D_UNCERTAIN' ELSE 'A_EMPTY_LABEL' END AS category, CASE WHEN c_custkey % 2 = 0 THEN 'MANUALLY_ANNOTATE' ELSE 'CONFIRM_BACKGROUND' END AS action FROM customer),
b AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders)
SELECT 'img' || i.c AS image, category, action, CASE WHEN category = 'A_EMPTY_LABEL' AND action = 'MANUALLY_ANNOTATE' THEN b.k::DOUBLE ELSE 0.5 END AS cx FROM i JOIN b ON b.c = i.c WHERE category = 'A_EMPTY_LABEL' AND action = 'MANUALLY_ANNOTATE'
UNION ALL SELECT 'img' || c, category, action, CASE WHEN category = 'A_EMPTY_LABEL' AND action = 'MANUALLY_ANNOTATE' THEN NULL ELSE 0.5 END FROM i WHERE NOT (category = 'A_EMPTY_LABEL' AND action = 'MANUALLY_ANNOTATE') OR c NOT IN (SELECT c FROM b)""")
def fanned_out(spark, sf_dir):
    """Items of a review with several boxes as manifest rows; items without boxes stay."""
    c = F.col("c_custkey")
    row = lambda x: F.array(F.lit(0.0), x.cast("double"), F.lit(0.5), F.lit(0.1), F.lit(0.1))
    boxes_ = v.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(row(F.col("o_orderkey"))).alias("boxes"))
    items = v.table(spark, sf_dir, "customer").join(boxes_, "c_custkey", "left").select(
        _image(c).alias("image"), F.when(c % 3 == 0, "D_UNCERTAIN").otherwise("A_EMPTY_LABEL").alias("category"), F.when(c % 2 == 0, "MANUALLY_ANNOTATE").otherwise("CONFIRM_BACKGROUND").alias("action"), row(F.lit(0.5)).alias("coordinates"), "boxes"
    )
    return resolve.fan_out(items).select("image", "category", "action", F.get("coordinates", F.lit(1)).alias("cx"))


@query(f"""WITH RECURSIVE {detection.ONE_TO_ONE}, x AS (SELECT g.frame, t.class_name AS a, p.class_name AS b FROM g JOIN t ON t.frame = g.frame AND t.box_id = g.truth_id JOIN p ON p.frame = g.frame AND p.box_id = g.box_id WHERE t.class_name <> p.class_name),
f AS (SELECT frame, count(*) AS n, list_sort(list_distinct(list_concat(list(a), list(b)))) AS classes FROM x GROUP BY frame)
SELECT array_to_string(classes, '/') AS classes, sum(n)::BIGINT AS n FROM f GROUP BY classes""")
def class_confusions(spark, sf_dir):
    """Which classes the disagreeing matches of a frame hold, and how many disagree."""
    t, p = v.truth_boxes(spark, sf_dir), v.predicted_boxes(spark, sf_dir)
    pairs = boxes.one_to_one(t, p).join(t.select("frame", F.col("box_id").alias("truth_id"), F.col("class_name").alias("truth_class")), ["frame", "truth_id"]).join(p.select("frame", "box_id", "class_name"), ["frame", "box_id"])
    return review.class_confusions(pairs).withColumn("classes", F.array_join("classes", "/"))
