"""Queries: boxes derived from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import scalar as s
from curata.operators import boxes
from curata.plans import views as v
from curata.plans.registry import query

def _corners():
    return s.box("x1", "y1", "x2", "y2")


FRAME_AREA = 300.0 * 250.0


def _area(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


SIZE = "CASE WHEN {a} < 0.01 THEN 'small' WHEN {a} > 0.25 THEN 'large' ELSE 'medium' END"


@query(f"WITH {v.BOXES} SELECT frame, box_id FROM t WHERE confidence >= 0.5 AND {_area('t')} >= 900 AND least(x2 - x1, y2 - y1) >= 25")
def filtered_boxes(spark, sf_dir):
    return boxes.filter_boxes(v.truth_boxes(spark, sf_dir), 0.5, 900, 25).select("frame", "box_id")


@query(f"""WITH {v.BOXES} SELECT t.frame, t.box_id, p.box_id AS other, round({v.iou_sql("t", "p")}, 8) AS overlap,
round(sqrt(pow(floor((t.x1 + t.x2) / 2) - floor((p.x1 + p.x2) / 2), 2) + pow(floor((t.y1 + t.y2) / 2) - floor((p.y1 + p.y2) / 2), 2)), 8) AS distance
FROM t JOIN p USING (frame) WHERE {v.iou_sql("t", "p")} > 0.2""")
def overlapping_boxes(spark, sf_dir):
    corners = ("x1", "y1", "x2", "y2")
    t = v.truth_boxes(spark, sf_dir).select("frame", "box_id", *corners, s.area(_corners()).alias("area"))
    p = v.predicted_boxes(spark, sf_dir).select("frame", F.col("box_id").alias("other"), *[F.col(c).alias(f"p{c}") for c in corners], s.area(_corners()).alias("parea"))
    # areas are computed once a box, and plain comparisons come first: most pairs of a frame don't overlap
    meets = (F.col("x1") < F.col("px2")) & (F.col("px1") < F.col("x2")) & (F.col("y1") < F.col("py2")) & (F.col("py1") < F.col("y2"))
    shared = F.greatest(F.least("x2", "px2") - F.greatest("x1", "px1"), F.lit(0)) * F.greatest(F.least("y2", "py2") - F.greatest("y1", "py1"), F.lit(0))
    overlap = shared.cast("double") / (F.col("area") + F.col("parea") - shared.cast("double"))
    j = t.join(p, "frame").filter(meets & (overlap > 0.2))
    return j.select("frame", "box_id", "other", F.round(overlap, 8).alias("overlap"), F.round(s.center_distance(_corners(), s.box("px1", "py1", "px2", "py2")), 8).alias("distance"))


MATCH = f"""{v.BOXES}, sc AS (SELECT p.frame, p.box_id, p.class_name, t.box_id AS tid, t.class_name AS tc, {v.iou_sql("t", "p")} AS o FROM p JOIN t USING (frame)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, box_id ORDER BY o DESC, tid) AS r FROM sc) WHERE r = 1),
m AS (SELECT frame, box_id, class_name, CASE WHEN o >= 0.5 THEN tid END AS truth_id, o, CASE WHEN o < 0.5 THEN 'fp' WHEN tc = class_name THEN 'tp' ELSE 'wrong_cls' END AS verdict FROM b)"""


@query(f"WITH {MATCH} SELECT frame, box_id, truth_id, round(o, 8) AS overlap, verdict FROM m")
def best_matches(spark, sf_dir):
    d = boxes.best_matches(v.predicted_boxes(spark, sf_dir), v.truth_boxes(spark, sf_dir))
    return d.select("frame", "box_id", "truth_id", F.round("overlap", 8).alias("overlap"), "verdict")


@query(f"""WITH {MATCH}, x AS (SELECT t.class_name, {SIZE.format(a=_area("t") + f" / {FRAME_AREA}::DOUBLE")} AS size FROM t LEFT JOIN (SELECT DISTINCT frame, truth_id FROM m WHERE truth_id IS NOT NULL) u ON u.frame = t.frame AND u.truth_id = t.box_id WHERE u.frame IS NULL),
a AS (SELECT class_name, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp, count(*) FILTER (verdict = 'wrong_cls') AS wrong_cls FROM m GROUP BY class_name),
c AS (SELECT class_name, count(*) AS fn, count(*) FILTER (size = 'small') AS fn_small, count(*) FILTER (size = 'medium') AS fn_medium, count(*) FILTER (size = 'large') AS fn_large FROM x GROUP BY class_name)
SELECT class_name, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(wrong_cls, 0) AS wrong_cls, coalesce(fn, 0) AS fn, coalesce(fn_small, 0) AS fn_small, coalesce(fn_medium, 0) AS fn_medium, coalesce(fn_large, 0) AS fn_large
FROM a FULL JOIN c USING (class_name)""")
def detection_errors(spark, sf_dir):
    t = v.truth_boxes(spark, sf_dir)
    return boxes.error_tally(boxes.best_matches(v.predicted_boxes(spark, sf_dir), t), t, FRAME_AREA)


def _frames(df):
    """The columns of order-dependent steps, which are tested against their sequential form."""
    return df.select("frame", "box_id", "class_name", "confidence", "x1", "y1", "x2", "y2")


PAIRS = f"pairs AS (SELECT frame, t.box_id AS truth_id, p.box_id, t.class_name = p.class_name AS same, {v.iou_sql('t', 'p')} AS o FROM t JOIN p USING (frame) WHERE {v.iou_sql('t', 'p')} > 0)"
ONE_TO_ONE = f"""{v.BOXES}, {PAIRS},
c AS (SELECT frame, truth_id, list({{'o': o, 'id': box_id}} ORDER BY o DESC, box_id) AS c FROM pairs GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY truth_id) AS r FROM c),
g AS (
  SELECT frame, 0::BIGINT AS r, NULL::BIGINT AS truth_id, NULL::BIGINT AS box_id, NULL::DOUBLE AS o, []::BIGINT[] AS used FROM (SELECT DISTINCT frame FROM n)
  UNION ALL
  SELECT frame, r, truth_id, CASE WHEN pick.o >= 0.5 THEN pick.id END, pick.o, CASE WHEN pick.o >= 0.5 THEN list_append(used, pick.id) ELSE used END
  FROM (SELECT n.frame, n.r, n.truth_id, g.used, list_filter(n.c, lambda x: NOT list_contains(g.used, x.id))[1] AS pick FROM g JOIN n ON n.frame = g.frame AND n.r = g.r + 1))"""


@query(f"WITH RECURSIVE {ONE_TO_ONE} SELECT frame, truth_id, box_id, round(o, 8) AS overlap FROM g WHERE box_id IS NOT NULL")
def one_to_one_matches(spark, sf_dir):
    d = boxes.one_to_one(v.truth_boxes(spark, sf_dir), v.predicted_boxes(spark, sf_dir))
    return d.withColumn("overlap", F.round("overlap", 8))


def _apart(keys: str, order: str, clash: str) -> str:
    """Boxes of ``t`` that, in order, clash with none kept before."""
    on = " AND ".join(f"n.{k} = g.{k}" for k in keys.split(", "))
    row = "{'box_id': n.box_id, 'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2}"
    return f"""{v.BOXES}, n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS r FROM t),
g AS (
  SELECT {", ".join("n." + k for k in keys.split(", "))}, n.r, [{row}] AS kept, n.box_id FROM n WHERE r = 1
  UNION ALL
  SELECT {", ".join("n." + k for k in keys.split(", "))}, n.r, CASE WHEN hit THEN kept ELSE list_append(kept, {row}) END, CASE WHEN hit THEN NULL ELSE n.box_id END
  FROM (SELECT n, g.kept, len(list_filter(g.kept, lambda k: {clash})) > 0 AS hit FROM g JOIN n ON {on} AND n.r = g.r + 1))
SELECT {keys}, box_id FROM g WHERE box_id IS NOT NULL"""


@query("WITH RECURSIVE " + _apart("frame", "confidence DESC, box_id", v.iou_sql("k", "n") + " > 0.3"))
def suppressed_boxes(spark, sf_dir):
    return boxes.suppress(_frames(v.truth_boxes(spark, sf_dir)), 0.3).select("frame", "box_id")


@query("WITH RECURSIVE " + _apart("frame, class_name", "(x2 - x1) * (y2 - y1) DESC, box_id", v.iou_sql("k", "n") + " >= 0.5"))
def merged_labels(spark, sf_dir):
    return boxes.merge_labels(_frames(v.truth_boxes(spark, sf_dir)), 0.5).select("frame", "class_name", "box_id")


SLOT = "{{'box_id': {a}.box_id, 'class_name': {a}.class_name, 'x1': {a}.x1, 'y1': {a}.y1, 'x2': {a}.x2, 'y2': {a}.y2, 'done': {done}}}"


@query(f"""WITH RECURSIVE {v.BOXES}, n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY box_id) AS r FROM p), last AS (SELECT frame, max(r) AS m FROM n GROUP BY frame),
g AS (
  SELECT frame, 0::BIGINT AS r, list({SLOT.format(a="t", done="false")} ORDER BY box_id) AS slots FROM t GROUP BY frame
  UNION ALL
  SELECT frame, r, CASE WHEN place > 0 THEN list_transform(slots, lambda x, i: CASE WHEN i = place THEN mine ELSE x END) ELSE list_append(slots, mine) END
  FROM (SELECT n.frame, n.r, g.slots, {SLOT.format(a="n", done="true")} AS mine, coalesce(list_position(list_transform(g.slots, lambda k: NOT k.done AND k.class_name = n.class_name AND {v.iou_sql("k", "n")} >= 0.3), true), 0) AS place
        FROM g JOIN n ON n.frame = g.frame AND n.r = g.r + 1))
SELECT frame, x.box_id AS box_id, x.class_name AS class_name, x.x1 AS x1, x.x2 AS x2 FROM (SELECT frame, unnest(slots) AS x FROM g LEFT JOIN last USING (frame) WHERE g.r = coalesce(m, 0))""")
def replaced_boxes(spark, sf_dir):
    return boxes.replace_boxes(_frames(v.truth_boxes(spark, sf_dir)), _frames(v.predicted_boxes(spark, sf_dir))).select("frame", "box_id", "class_name", "x1", "x2")


def track_rows(spark, sf_dir, lines=None):
    """Boxes whose session is a stretch of 300 frames."""
    return _frames(v.truth_boxes(spark, sf_dir, lines)).withColumn("session", F.floor(F.col("frame") / 300))


_NEAR = "1.0::DOUBLE - sqrt(pow(floor((k.x1 + k.x2) / 2) - floor((n.x1 + n.x2) / 2), 2) + pow(floor((k.y1 + k.y2) / 2) - floor((n.y1 + n.y2) / 2), 2)) / 120"
#: Boxes one by one, by falling confidence in their frame: the list ``live`` has a session's tracks, with the frame and corners of their last box.
TRACKS = f"""{v.BOXES}, n AS (SELECT *, frame // 300 AS session, row_number() OVER (PARTITION BY frame // 300 ORDER BY frame, confidence DESC, box_id) AS r FROM t),
g AS (
  SELECT session, 0::BIGINT AS r, NULL::BIGINT AS frame, NULL::BIGINT AS box_id, 0::BIGINT AS next_id, NULL::BIGINT AS track_id, []::STRUCT(id BIGINT, f BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[] AS live FROM (SELECT DISTINCT session FROM n)
  UNION ALL
  SELECT session, r, frame, box_id, next_id + (pick IS NULL)::INT, coalesce(pick, next_id),
    list_append(list_filter(live, lambda k: k.id IS DISTINCT FROM pick AND m.frame - k.f <= 15), {{'id': coalesce(pick, next_id), 'f': frame, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}})
  FROM (SELECT n.session, n.r, n.frame, n.box_id, n.x1, n.y1, n.x2, n.y2, g.next_id, g.live, list_sort(list_filter(list_transform(list_filter(g.live, lambda k: k.f < n.frame AND n.frame - k.f <= 15),
      lambda k: {{'s': CASE WHEN {v.iou_sql("k", "n")} >= 0.3 OR {_NEAR} >= 0.5 THEN -greatest({v.iou_sql("k", "n")}, {_NEAR}) ELSE 0 END, 'id': k.id}}), lambda c: c.s < 0))[1].id AS pick
    FROM g JOIN n ON n.session = g.session AND n.r = g.r + 1) m)"""


@query(f"WITH RECURSIVE {TRACKS} SELECT session, frame, box_id, track_id FROM g WHERE r > 0")
def tracked_boxes(spark, sf_dir):
    return boxes.track(track_rows(spark, sf_dir)).select("session", "frame", "box_id", "track_id")


@query()
def review_priorities(spark, sf_dir):
    ev = boxes.evidence(v.truth_boxes(spark, sf_dir), v.predicted_boxes(spark, sf_dir), FRAME_AREA)
    categories = F.when(F.col("frame") % 5 == 0, F.array(F.lit("ambiguous_classes"))).when(F.col("frame") % 5 == 1, F.array(F.lit("tiny_boxes"))).otherwise(F.array().cast("array<string>"))
    scored = boxes.review_score(ev.withColumn("categories", categories))
    return scored.select("frame", "matched", "missing", "extra", "class_disagreements", "score", "level", F.concat_ws(",", "flags").alias("flags"))


@query(f"WITH {v.BOXES} SELECT frame, count(*) FILTER (confidence >= 0.5) AS n_valid, CASE count(*) FILTER (confidence >= 0.5) WHEN 0 THEN 'NO_OBJECT' WHEN 1 THEN 'OK' ELSE 'MULTIPLE' END AS verdict FROM t GROUP BY frame")
def preview_verdicts(spark, sf_dir):
    t = v.truth_boxes(spark, sf_dir)
    return boxes.preview_verdict(t.select("frame").distinct(), t)


NORMAL = f"{v.BOXES}, y AS (SELECT frame AS image, box_id, class_name, CASE WHEN frame % 3 = 0 THEN 'train' WHEN frame % 3 = 1 THEN 'valid' ELSE 'test' END AS split, (x2 - x1) / 300.0::DOUBLE AS w, (y2 - y1) / 250.0::DOUBLE AS h, (x1 + x2) / 2.0::DOUBLE / 300.0 AS cx, (y1 + y2) / 2.0::DOUBLE / 250.0 AS cy FROM t), im AS (SELECT DISTINCT frame AS image, CASE WHEN frame % 3 = 0 THEN 'train' WHEN frame % 3 = 1 THEN 'valid' ELSE 'test' END AS split FROM t UNION SELECT DISTINCT -1 - frame, 'test' FROM t WHERE frame % 10 = 0)"


def _normal(spark, sf_dir):
    t = v.truth_boxes(spark, sf_dir)
    split = F.when(F.col("frame") % 3 == 0, "train").when(F.col("frame") % 3 == 1, "valid").otherwise("test").alias("split")
    y = t.select(F.col("frame").alias("image"), "box_id", "class_name", split, s.to_yolo(_corners(), F.lit(300.0), F.lit(250.0)).alias("y"), _corners().alias("b")).select("*", "y.*")
    empty = t.filter("frame % 10 = 0").select((-1 - F.col("frame")).alias("image"), F.lit("test").alias("split"))
    return y, t.select(F.col("frame").alias("image"), split).unionByName(empty).distinct()


@query(f"WITH {NORMAL} SELECT class_name, count(*) AS n, round(avg(w * h), 8) AS mean_area, round(median(w * h), 8) AS median_area, round(min(w * h), 8) AS min_area, round(max(w * h), 8) AS max_area, count(*) FILTER ({SIZE.format(a='w * h')} = 'small') AS n_small, count(*) FILTER ({SIZE.format(a='w * h')} = 'medium') AS n_medium, count(*) FILTER ({SIZE.format(a='w * h')} = 'large') AS n_large FROM y GROUP BY class_name")
def box_statistics(spark, sf_dir):
    d = boxes.box_statistics(_normal(spark, sf_dir)[0])
    return d.withColumns({c: F.round(c, 8) for c in ("mean_area", "median_area", "min_area", "max_area")})


@query(f"""WITH {NORMAL}, c AS (SELECT im.image, im.split, count(y.box_id) AS n FROM im LEFT JOIN y USING (image) GROUP BY ALL)
SELECT split, count(*) AS images, sum(n)::BIGINT AS objects, round(avg(n), 8) AS mean_objects, min(n) AS min_objects, max(n) AS max_objects, count(*) FILTER (n = 0) AS empty_images FROM c GROUP BY split""")
def objects_per_image(spark, sf_dir):
    y, images = _normal(spark, sf_dir)
    return boxes.objects_per_image(images, y).withColumn("mean_objects", F.round("mean_objects", 8))


@query(f"""WITH {NORMAL}, c AS (SELECT im.image, count(y.box_id) AS n, max(w * h) AS mx, min(w * h) AS mn, bool_or(class_name = 'R') AS amb FROM im LEFT JOIN y USING (image) GROUP BY ALL)
SELECT image, n, n = 0 AS "empty", coalesce(mx >= 0.06, false) AS huge_box, coalesce(mn < 0.008, false) AS tiny_boxes, n > 5 AS many_objects, coalesce(amb, false) AS ambiguous_classes FROM c""")
def suspicion_flags(spark, sf_dir):
    y, images = _normal(spark, sf_dir)
    return boxes.suspicion_flags(images.select("image"), y, ["R"], huge=0.06, tiny=0.008, many=5)


@query(f"WITH {NORMAL} SELECT image, box_id, printf('%d %.6f %.6f %.6f %.6f', box_id % 9, cx, cy, w, h) AS line FROM y")
def label_lines(spark, sf_dir):
    y = _normal(spark, sf_dir)[0]
    return y.select("image", "box_id", s.yolo_line(F.col("box_id") % 9, F.col("y")).alias("line"))


# faults of every kind: boxes moved out, flattened, without a value
FAULTY = "f AS (SELECT image, box_id, CASE box_id % 11 WHEN 0 THEN cx + 0.7 WHEN 1 THEN cx - 0.25 ELSE cx END AS cx, CASE WHEN box_id % 7 = 0 THEN NULL ELSE cy END AS cy, CASE box_id % 13 WHEN 0 THEN 0.0 WHEN 1 THEN w + 1 ELSE w END AS w, h FROM y)"


@query(f"""WITH {NORMAL}, {FAULTY} SELECT image, box_id, CASE WHEN cx IS NULL OR cy IS NULL OR w IS NULL OR h IS NULL THEN 'missing' WHEN cx < 0 OR cx > 1 OR cy < 0 OR cy > 1 THEN 'center_out_of_range' WHEN w <= 0 OR w > 1 OR h <= 0 OR h > 1 THEN 'size_out_of_range'
WHEN cx - w / 2 < -1e-6::DOUBLE OR cx + w / 2 > 1 + 1e-6::DOUBLE OR cy - h / 2 < -1e-6::DOUBLE OR cy + h / 2 > 1 + 1e-6::DOUBLE THEN 'outside_frame' END AS error FROM f""")
def box_errors(spark, sf_dir):
    from curata.operators.rules import strict_box_error

    k, y = F.col("box_id"), _normal(spark, sf_dir)[0]
    y = y.withColumns({
        "cx": F.when(k % 11 == 0, F.col("cx") + 0.7).when(k % 11 == 1, F.col("cx") - 0.25).otherwise(F.col("cx")), "cy": F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("cy")),
        "w": F.when(k % 13 == 0, 0.0).when(k % 13 == 1, F.col("w") + 1).otherwise(F.col("w")),
    })
    return y.select("image", "box_id", strict_box_error(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")).alias("error"))


@query(f"""WITH {v.BOXES}, g AS (SELECT frame, box_id, greatest(0, x1 - floor((x2 - x1) * 0.08::DOUBLE)) AS a, greatest(0, y1 - floor((y2 - y1) * 0.08::DOUBLE)) AS b, least(300, x2 + floor((x2 - x1) * 0.08::DOUBLE)) AS c, least(250, y2 + floor((y2 - y1) * 0.08::DOUBLE)) AS d FROM t)
SELECT frame, box_id, CASE WHEN least(c - a, d - b) < 32 THEN 'side_too_small' WHEN (c - a) * (d - b) < 1400 THEN 'area_too_small' END AS rejection FROM g""")
def crop_gates(spark, sf_dir):
    t = v.truth_boxes(spark, sf_dir)
    return t.select("frame", "box_id", boxes.crop_gate(_corners(), F.lit(300), F.lit(250), min_area=1400).alias("rejection"))


@query(f"WITH {v.BOXES} SELECT frame, box_id FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY box_id) AS r FROM t) WHERE r <= 3")
def capped_boxes(spark, sf_dir):
    return boxes.cap_boxes(v.truth_boxes(spark, sf_dir), 3).select("frame", "box_id")


@query(f"WITH {v.BOXES} SELECT frame, box_id, round(greatest(1e-6, least(1.0, (0.3::DOUBLE * confidence + 0.7::DOUBLE * (box_id % 7 / 7.0::DOUBLE)) / (0.3::DOUBLE + 0.7::DOUBLE))), 8) AS fused FROM t")
def fused_confidences(spark, sf_dir):
    t = v.truth_boxes(spark, sf_dir)
    return t.select("frame", "box_id", F.round(s.fuse(F.col("confidence"), F.col("box_id") % 7 / 7.0), 8).alias("fused"))


ASSIGNED = f"""{v.BOXES}, {PAIRS},
c AS (SELECT frame, box_id, list({{'o': o, 'id': truth_id}} ORDER BY o DESC, truth_id) AS c FROM pairs WHERE same GROUP BY ALL),
n AS (SELECT c.*, row_number() OVER (PARTITION BY frame ORDER BY confidence DESC, box_id) AS r FROM c JOIN p USING (frame, box_id)),
g AS (
  SELECT frame, 0::BIGINT AS r, NULL::BIGINT AS box_id, NULL::DOUBLE AS o, []::BIGINT[] AS used FROM (SELECT DISTINCT frame FROM n)
  UNION ALL
  SELECT frame, r, box_id, pick.o, CASE WHEN pick IS NOT NULL THEN list_append(used, pick.id) ELSE used END
  FROM (SELECT n.frame, n.r, n.box_id, g.used, list_filter(n.c, lambda x: NOT list_contains(g.used, x.id))[1] AS pick FROM g JOIN n ON n.frame = g.frame AND n.r = g.r + 1)),
a AS (SELECT p.class_name, p.confidence, coalesce(g.o, 0) AS o FROM p LEFT JOIN g ON g.frame = p.frame AND g.box_id = p.box_id)"""


@query(f"""WITH RECURSIVE {ASSIGNED}, b AS (SELECT (50 + 5 * i) / 100::DOUBLE AS bound FROM range(10) x(i)), tn AS (SELECT class_name, count(*) AS n FROM t GROUP BY class_name),
st AS (SELECT class_name, bound, confidence, count(*) FILTER (o >= bound) AS hits, count(*) AS rows FROM a, b GROUP BY ALL),
cu AS (SELECT *, sum(hits) OVER w AS tp, sum(rows) OVER w AS k FROM st WINDOW w AS (PARTITION BY class_name, bound ORDER BY confidence DESC)),
pr AS (SELECT *, max(tp / k) OVER (PARTITION BY class_name, bound ORDER BY confidence) AS best FROM cu),
ap AS (SELECT class_name, bound, sum(best * hits / n) AS ap, max(tp / n) AS recall, arg_min(tp / k, confidence) AS prec FROM pr JOIN tn USING (class_name) GROUP BY ALL)
SELECT class_name AS class, round(max(prec) FILTER (bound = 0.5), 8) AS precision, round(max(recall) FILTER (bound = 0.5), 8) AS recall, round(max(ap) FILTER (bound = 0.5), 8) AS ap50, round(avg(ap), 8) AS ap50_95 FROM ap GROUP BY class_name""")
def detector_precision(spark, sf_dir):
    """Precision, recall and average precision a class, at an overlap of 0.5 and on average from 0.5 to 0.95."""
    from curata.operators.metrics import mean_average_precision

    t = v.truth_boxes(spark, sf_dir)
    d = mean_average_precision(boxes.assign(v.predicted_boxes(spark, sf_dir), t), t.groupBy("class_name").agg(F.count("*").alias("n")))
    return d.select("class", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "ap50", "ap50_95")])


@query(f"WITH {v.BOXES} SELECT frame, box_id, row_number() OVER (PARTITION BY frame ORDER BY confidence DESC, box_id) AS place FROM t")
def preview_order(spark, sf_dir):
    return boxes.by_confidence(v.truth_boxes(spark, sf_dir)).select("frame", "box_id", F.col("place").cast("long").alias("place"))
