"""Detections: filters, matching, suppression, tracking and error analysis over box rows.

Box tables are long: one row a box, with the frame's key. Steps that depend on the order of
earlier choices (greedy matching, suppression, replacement) run once per frame over that frame's
boxes, which are few; frames are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.functions.scalar import area, box, height, iou, width
from curata.operators import arrow
from curata.operators.ranks import value_at
from curata.session import materialize


def by_confidence(df: DataFrame) -> DataFrame:
    """A preview's boxes, the most confident of each frame first; ``place`` is their number in it."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("frame").orderBy(F.col("confidence").desc(), "box_id")))


def least_confident(label: Column, confidence: Column, threshold: float = 0.5) -> Column:
    """The label, or ``uncertain`` where the confidence is below the threshold."""
    return F.when(confidence < threshold, F.lit("uncertain")).otherwise(label)


def filter_boxes(df: DataFrame, min_confidence: float = 0.0, min_area: float = 0.0, min_side: float = 0.0) -> DataFrame:
    b = box("x1", "y1", "x2", "y2")
    return df.filter((F.col("confidence") >= min_confidence) & (area(b) >= min_area) & (F.least(width(b), height(b)) >= min_side))


def crop_gate(b: Column, frame_width: Column, frame_height: Column, margin: float = 0.08, min_side: int = 32, min_area: int = 1024) -> Column:
    """Why a box can't be cropped: null where it can."""
    from curata.functions.scalar import expand

    grown = expand(b, margin, frame_width, frame_height)
    return F.when(F.least(width(grown), height(grown)) < min_side, F.lit("side_too_small")).when(area(grown) < min_area, F.lit("area_too_small"))


def area_share(df: DataFrame) -> Column:
    return (F.col("w") * F.col("h")).cast("double")


def size_category(share: Column, small: float = 0.01, large: float = 0.25) -> Column:
    return F.when(share < small, "small").when(share > large, "large").otherwise("medium")


def huge_suggestion(share: Column) -> Column:
    return F.when(share >= 0.99, "tighten").when(share >= 0.96, "manual_review").otherwise("keep")


def suspicion_flags(images: DataFrame, boxes: DataFrame, ambiguous: list[str], huge: float = 0.9025, tiny: float = 0.005, many: int = 60) -> DataFrame:
    """(image, n, empty, huge_box, tiny_boxes, many_objects, ambiguous_classes) from images (image) and normalised boxes
    (image, class_name, w, h)."""
    share = F.col("w") * F.col("h")
    per = boxes.groupBy("image").agg(
        F.count("*").alias("n"), F.max(share).alias("most"), F.min(share).alias("least"), F.max(F.col("class_name").isin(ambiguous)).alias("ambiguous_classes")
    )
    out = images.join(per, "image", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    no = F.lit(False)
    return out.select("image", "n", (F.col("n") == 0).alias("empty"), F.coalesce(F.col("most") >= huge, no).alias("huge_box"), F.coalesce(F.col("least") < tiny, no).alias("tiny_boxes"), (F.col("n") > many).alias("many_objects"), F.coalesce("ambiguous_classes", no).alias("ambiguous_classes"))


def preview_verdict(frames: DataFrame, boxes: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """(frame, n_valid, verdict): NO_OBJECT, MULTIPLE or OK by the confident boxes of a frame."""
    valid = boxes.filter(F.col("confidence") >= min_confidence).groupBy("frame").agg(F.count("*").alias("n_valid"))
    n = F.coalesce("n_valid", F.lit(0))
    return frames.join(valid, "frame", "left").select("frame", n.alias("n_valid"), F.when(n == 0, "NO_OBJECT").when(n > 1, "MULTIPLE").otherwise("OK").alias("verdict"))


def best_matches(pred: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(frame, box_id, class_name, confidence, truth_id, overlap, verdict): every prediction against the true box that it
    overlaps most (of equals the smallest id); many may share one. tp, wrong_cls or fp."""
    t = truth.select("frame", F.col("box_id").alias("truth_id"), F.col("class_name").alias("truth_class"), *[F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")])
    # plain comparisons first: most pairs of a frame don't overlap
    meets = (F.col("x1") < F.col("tx2")) & (F.col("tx1") < F.col("x2")) & (F.col("y1") < F.col("ty2")) & (F.col("ty1") < F.col("y2"))
    pairs = pred.join(t, "frame").filter(meets).select("frame", "box_id", "truth_id", "truth_class", iou(box("x1", "y1", "x2", "y2"), box("tx1", "ty1", "tx2", "ty2")).alias("overlap"))
    best = pairs.groupBy("frame", "box_id").agg(F.max_by(F.struct("truth_id", "truth_class", "overlap"), F.struct(F.col("overlap"), -F.col("truth_id"))).alias("m"))
    out = pred.select("frame", "box_id", "class_name", "confidence").join(best, ["frame", "box_id"], "left")
    hit = F.col("m.overlap") >= threshold
    verdict = F.when(~F.coalesce(hit, F.lit(False)), "fp").when(F.col("m.truth_class") == F.col("class_name"), "tp").otherwise("wrong_cls")
    return out.select("frame", "box_id", "class_name", "confidence", F.when(hit, F.col("m.truth_id")).alias("truth_id"), F.coalesce("m.overlap", F.lit(0.0)).alias("overlap"), verdict.alias("verdict"))


def error_tally(matches: DataFrame, truth: DataFrame, frame_area: float) -> DataFrame:
    """(class_name, tp, fp, wrong_cls, fn, fn_small, fn_medium, fn_large): a true box that no prediction is matched with is
    missed. Matches are written once, as two counts read them."""
    matches = materialize(matches, "matches")
    used = matches.filter("truth_id IS NOT NULL").select("frame", F.col("truth_id").alias("box_id")).distinct()
    b = box("x1", "y1", "x2", "y2")
    missed = truth.join(used, ["frame", "box_id"], "left_anti").withColumn("size", size_category(area(b) / frame_area))
    count_if = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a = matches.groupBy("class_name").agg(*[count_if(F.col("verdict") == v).alias(v) for v in ("tp", "fp", "wrong_cls")])
    m = missed.groupBy("class_name").agg(F.count("*").alias("fn"), *[count_if(F.col("size") == s).alias(f"fn_{s}") for s in ("small", "medium", "large")])
    return a.join(m, "class_name", "full").na.fill(0)


def _frames(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """(keys, rows): a frame's rows as an array in order. Arrays hold a frame's boxes, which are few."""
    row = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*df.columns).alias("row"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _rows_type(df: DataFrame) -> str:
    return f"array<{df.schema.simpleString()}>"


def _keep_apart(df: DataFrame, keys: list[str], order: list[Column], clash) -> DataFrame:
    """The rows that, in order, clash with no row kept before."""
    none = F.array().cast(_rows_type(df))
    kept = F.aggregate("rows", none, lambda kept, x: F.when(F.exists(kept, lambda k: clash(k, x["row"])), kept).otherwise(F.concat(kept, F.array(x["row"]))))
    return _frames(df, keys, order).select(F.explode(kept).alias("row")).select("row.*")


def one_to_one(truth: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(frame, truth_id, box_id, overlap): true boxes in order of id each take the free prediction that overlaps most.

    Overlapping pairs come from a join; a frame's pairs, in order, are folded: the first free prediction of a true box
    decides it, and is taken if it overlaps by the threshold."""
    t = truth.select("frame", F.col("box_id").alias("truth_id"), *[F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")])
    p = pred.select("frame", "box_id", "x1", "y1", "x2", "y2")
    # plain comparisons first: most pairs of a frame don't overlap
    meets = (F.col("x1") < F.col("tx2")) & (F.col("tx1") < F.col("x2")) & (F.col("y1") < F.col("ty2")) & (F.col("ty1") < F.col("y2"))
    pairs = t.join(p, "frame").filter(meets).select("frame", "truth_id", "box_id", iou(box("tx1", "ty1", "tx2", "ty2"), box("x1", "y1", "x2", "y2")).alias("overlap"))
    frames = _frames(pairs.filter("overlap > 0"), ["frame"], [F.col("truth_id"), -F.col("overlap"), F.col("box_id")])
    start = F.struct(F.lit(None).cast("long").alias("decided"), F.array().cast("array<bigint>").alias("taken"), F.array().cast(_rows_type(pairs)).alias("found"))

    def step(state, x):
        row = x["row"]
        good = row["overlap"] >= threshold
        add = lambda name, value: F.when(good, F.concat(state[name], F.array(value))).otherwise(state[name]).alias(name)
        decides = F.struct(row["truth_id"].alias("decided"), add("taken", row["box_id"]), add("found", row))
        skip = F.coalesce(state["decided"] == row["truth_id"], F.lit(False)) | F.array_contains(state["taken"], row["box_id"])
        return F.when(skip, state).otherwise(decides)

    return frames.select(F.explode(F.aggregate("rows", start, step)["found"]).alias("row")).select("row.*")


def assign(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(frame, box_id, class_name, confidence, overlap): predictions by falling confidence each take the free true box of their
    class that overlaps most; overlap is 0 without one. A true box is taken once, so doubles count as false."""
    t = truth.select("frame", F.col("box_id").alias("truth_id"), "class_name", *[F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")])
    meets = (F.col("x1") < F.col("tx2")) & (F.col("tx1") < F.col("x2")) & (F.col("y1") < F.col("ty2")) & (F.col("ty1") < F.col("y2"))
    pairs = pred.join(t, ["frame", "class_name"]).filter(meets)
    pairs = pairs.select("frame", "box_id", "truth_id", "confidence", iou(box("tx1", "ty1", "tx2", "ty2"), box("x1", "y1", "x2", "y2")).alias("overlap")).filter("overlap > 0")
    frames = _frames(pairs, ["frame"], [-F.col("confidence"), F.col("box_id"), -F.col("overlap"), F.col("truth_id")])
    start = F.struct(F.array().cast("array<bigint>").alias("decided"), F.array().cast("array<bigint>").alias("taken"), F.array().cast(_rows_type(pairs)).alias("found"))

    def step(state, x):
        row = x["row"]
        skip = F.array_contains(state["decided"], row["box_id"]) | F.array_contains(state["taken"], row["truth_id"])
        more = lambda name, value: F.concat(state[name], F.array(value)).alias(name)
        return F.when(skip, state).otherwise(F.struct(more("decided", row["box_id"]), more("taken", row["truth_id"]), more("found", row)))

    found = frames.select(F.explode(F.aggregate("rows", start, step)["found"]).alias("row")).select("row.frame", "row.box_id", "row.overlap")
    return pred.select("frame", "box_id", "class_name", "confidence").join(found, ["frame", "box_id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def suppress(df: DataFrame, threshold: float = 0.5, per_class: bool = False) -> DataFrame:
    """Non-maximum suppression: by falling confidence, a box goes if it overlaps a kept one by more than the threshold."""
    return _keep_apart(df, ["frame", *(["class_name"] if per_class else [])], [-F.col("confidence"), F.col("box_id")], lambda k, x: iou(k, x) > threshold)


def merge_labels(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Of boxes of one class that overlap by the threshold or more the larger stays."""
    return _keep_apart(df, ["frame", "class_name"], [-area(box("x1", "y1", "x2", "y2")), F.col("box_id")], lambda k, x: iou(k, x) >= threshold)


def replace_boxes(original: DataFrame, corrected: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Corrected boxes, in order of id, each replace the first original of their class that overlaps by the threshold and is
    not replaced yet; without one they are added. Originals without a correction stay."""
    names, kind = original.columns, original.schema.simpleString()
    old = _frames(original, ["frame"], [F.col("box_id")]).select("frame", F.transform("rows", lambda x: F.struct(x["row"].alias("row"), F.lit(False).alias("done"))).alias("old"))
    new = _frames(corrected.select(*names), ["frame"], [F.col("box_id")]).select("frame", F.transform("rows", lambda x: x["row"]).alias("new"))
    slots = f"array<struct<row:{kind},done:boolean>>"
    both = old.join(new, "frame", "full").select(F.coalesce("old", F.array().cast(slots)).alias("old"), F.coalesce("new", F.array().cast(f"array<{kind}>")).alias("new"))

    def step(slots, x):
        free = F.transform(slots, lambda s: ~s["done"] & (s["row"]["class_name"] == x["class_name"]) & (iou(s["row"], x) >= threshold))
        at = F.array_position(free, True)
        mine = F.struct(x.alias("row"), F.lit(True).alias("done"))
        return F.when(at > 0, F.transform(slots, lambda s, i: F.when(i + 1 == at, mine).otherwise(s))).otherwise(F.concat(slots, F.array(mine)))

    return both.select(F.explode(F.aggregate("new", F.col("old"), step)).alias("s")).select("s.row.*")


#: Rows of a stretch that a tracker scores at once, and pairs a row up to which it does so.
STRETCH, ROW_PAIRS = 512, 300


class Tracker:
    """Associates a frame's boxes with the live tracks of its session.

    Every box is scored against every live track at once: the better of IoU and nearness (1 - distance of the centres /
    ``reach``), where IoU is ``least`` or nearness 0.5 at least. Boxes choose by falling confidence, a track takes one
    box a frame, and a box without a track starts one. A track is live up to ``patience`` frames after its last box,
    counted by frame numbers, so that frames without any box age it too."""

    def __init__(self, least: float = 0.3, reach: float = 120.0, patience: int = 15):
        self.least, self.reach, self.patience = least, reach, patience
        #: next track id, and (id, last frame, corners) of each track that may be live
        self.state: tuple[int, tuple] = (0, ())

    def _scores(self, boxes, tracks):
        """Boxes x tracks; -1 where a box can't join a track."""
        import numpy as np

        return self._scored(np.array(boxes, dtype=float).T[:, :, None], np.array(tracks, dtype=float).T[:, None, :])

    def _scored(self, a, b):
        """Scores of boxes with boxes, both as (x1, y1, x2, y2) of arrays; -1 where one can't join the other's track."""
        import numpy as np

        (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a, b
        sides = lambda x1, y1, x2, y2: np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
        shared = sides(np.maximum(ax1, bx1), np.maximum(ay1, by1), np.minimum(ax2, bx2), np.minimum(ay2, by2))
        union = sides(*a) + sides(*b) - shared
        overlap = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
        dx, dy = (np.floor((p + q) / 2) - np.floor((v + w) / 2) for p, q, v, w in ((ax1, ax2, bx1, bx2), (ay1, ay2, by1, by2)))
        near = 1.0 - np.sqrt(dx * dx + dy * dy) / max(1.0, self.reach)
        return np.where((overlap >= self.least) | (near >= 0.5), np.maximum(overlap, near), -1.0)

    def step(self, frame: int | None, boxes: list[tuple]) -> list[int | None]:
        """Track ids of a frame's (confidence, x1, y1, x2, y2) rows, in their order; none for a box without a corner, or in a frame without a number."""
        next_id, tracks = self.state
        ids: list[int | None] = [None] * len(boxes)
        placed = [n for n, b in enumerate(boxes) if frame is not None and all(c is not None and c == c for c in b[1:])]
        if not placed:
            return ids
        live = [t for t in tracks if frame - t[1] <= self.patience]
        scores = self._scores([boxes[n][1:] for n in placed], [t[2] for t in live]) if live else None
        # by falling confidence, none last
        for k, n in sorted(enumerate(placed), key=lambda kn: (boxes[kn[1]][0] is None, -(boxes[kn[1]][0] or 0))):
            at = int(scores[k].argmax()) if scores is not None else -1
            if at >= 0 and scores[k, at] >= 0:
                ids[n] = live[at][0]
                live[at] = (ids[n], frame, tuple(boxes[n][1:]))
                scores[:, at] = -1.0
            else:
                ids[n], next_id = next_id, next_id + 1
                live.append((ids[n], frame, tuple(boxes[n][1:])))
        self.state = (next_id, tuple(live))
        return ids

    def steps(self, frames: list[int | None], boxes: list[tuple]) -> list[int | None]:
        """The track ids of ``step`` for the rows of several frames, in order of their frames. Where frames are small, a stretch of them is scored at once."""
        ids: list[int | None] = [None] * len(boxes)
        placed = [n for n, b in enumerate(boxes) if frames[n] is not None and all(c is not None and c == c for c in b[1:])]
        start = 0
        while start < len(placed):
            end = min(start + STRETCH, len(placed))
            while end < len(placed) and frames[placed[end]] == frames[placed[end - 1]]:
                end += 1
            rows, start = placed[start:end], end
            # by falling confidence in their frame, none last
            rows.sort(key=lambda n: (frames[n], boxes[n][0] is None, -(boxes[n][0] or 0)))
            found = self._stretch([frames[n] for n in rows], [tuple(boxes[n][1:]) for n in rows])
            if found is None:
                for number in dict.fromkeys(frames[n] for n in rows):
                    own = [n for n in rows if frames[n] == number]
                    for n, i in zip(own, self.step(number, [boxes[n] for n in own]), strict=True):
                        ids[n] = i
            else:
                for n, i in zip(rows, found, strict=True):
                    ids[n] = i
        return ids

    def _stretch(self, frames: list[int], corners: list[tuple]) -> list[int] | None:
        """The track ids of rows in order; None, and nothing changed, where so many boxes are near in time that a frame by itself is less work.

        Every pair of boxes up to ``patience`` frames apart is scored. A box goes to the best of those that are still the last box of their track."""
        import numpy as np

        next_id, tracks = self.state
        old, own = len(tracks), np.array(frames)
        before, upto = np.searchsorted(own, own - self.patience), np.searchsorted(own, own)
        i0, j0 = np.nonzero(own[:, None] - np.array([t[1] for t in tracks])[None, :] <= self.patience) if old else (np.zeros(0, int), np.zeros(0, int))
        near = upto - before
        if len(i0) + near.sum() > ROW_PAIRS * len(own):
            return None
        i1 = np.repeat(np.arange(len(own)), near)
        j1 = np.arange(len(i1)) - np.repeat(np.cumsum(near) - near, near) + np.repeat(before, near) + old
        i, j = np.concatenate([i0, i1]), np.concatenate([j0, j1])
        every = [*(t[2] for t in tracks), *corners]
        at = np.array(every, dtype=float).T.copy()
        score = self._scored(at[:, old:][:, i], at[:, j])
        able = np.flatnonzero(score >= 0)
        able = able[np.lexsort((-score[able], i[able]))]
        starts = np.searchsorted(i[able], np.arange(len(own) + 1)).tolist()
        rivals, scores = j[able].tolist(), score[able].tolist()
        track_of, last = [t[0] for t in tracks] + [0] * len(own), [True] * (old + len(own))
        for k in range(len(own)):
            best = None
            for p in range(starts[k], starts[k + 1]):
                if best is not None and scores[p] < scores[best]:
                    break
                # of equal scores the first track wins
                if last[rivals[p]] and (best is None or track_of[rivals[p]] < track_of[rivals[best]]):
                    best = p
            if best is None:
                track_of[old + k], next_id = next_id, next_id + 1
            else:
                last[rivals[best]] = False
                track_of[old + k] = track_of[rivals[best]]
        numbers = [*(t[1] for t in tracks), *frames]
        live = sorted((track_of[x], numbers[x], every[x]) for x in range(len(every)) if last[x] and frames[-1] - numbers[x] <= self.patience)
        self.state = (next_id, tuple(live))
        return track_of[old:]


def track(df: DataFrame, session: str = "session", frame: str = "frame", settings: dict | None = None) -> DataFrame:
    """``df`` (session, frame, box_id, confidence, corners) with ``track_id``. Frames of a session are streamed in order of their
    whole numbers, and one frame is in memory at a time; a session is one task's work, as a track depends on all before it. Rows without a
    session are one session."""
    from pyspark.sql import types as T

    given = [T.StructField("track_id", T.LongType())]
    schema = T.StructType([*df.schema.fields, *given])

    def run(batches):
        known, tracker, fields = None, None, arrow.arrow_fields(given)
        for batch, keys in arrow.whole_groups(batches, [session, frame]):
            found, ids, start = arrow.rows(batch, ["confidence", "x1", "y1", "x2", "y2"]), [], 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and arrow.same(keys[end][0], keys[start][0]):
                    continue
                name = keys[start][0]
                if tracker is None or not arrow.same(name, known):
                    known, tracker = name, Tracker(**(settings or {}))
                ids += tracker.steps([k[1] for k in keys[start:end]], found[start:end])
                start = end
            yield arrow.appended(batch, fields, [(i,) for i in ids])

    return df.repartition(session).sortWithinPartitions(session, frame, "box_id").mapInArrow(run, schema)


def track_spans(tracked: DataFrame, time: str, session: str = "session") -> DataFrame:
    """(session, track_id, first_seen, last_seen, n_boxes) of the tracks of ``track``'s rows."""
    own = tracked.filter(F.col("track_id").isNotNull())
    return own.groupBy(session, "track_id").agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("n_boxes"))


def box_statistics(boxes: DataFrame) -> DataFrame:
    """Per class: count, mean, median, least and most area share, and the size histogram; boxes are normalised (w, h). The two middle
    values are found by rank."""
    share = F.col("w") * F.col("h")
    sizes = size_category(share)
    own = boxes.withColumn("_share", share)
    middle = [value_at(own, ["class_name"], "_share", 0.5, lambda n, up=up: F.floor((n + up) / 2), f"m{up}").withColumnRenamed("class_name", f"c{up}") for up in (1, 2)]
    stats = boxes.groupBy("class_name").agg(
        F.count("*").alias("n"), F.avg(share).alias("mean_area"), F.min(share).alias("min_area"), F.max(share).alias("max_area"),
        *[F.sum(F.when(sizes == s, 1).otherwise(0)).alias(f"n_{s}") for s in ("small", "medium", "large")],
    )
    for up, found in zip((1, 2), middle, strict=True):
        stats = stats.join(found, F.col("class_name").eqNullSafe(F.col(f"c{up}")), "left")
    return stats.withColumn("median_area", (F.col("m1") + F.col("m2")) / 2).drop("c1", "c2", "m1", "m2")


def objects_per_image(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per split: images, objects, mean, least and most objects an image; images without a box count 0."""
    per = boxes.groupBy("image").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return images.join(per, "image", "left").groupBy("split").agg(
        F.count("*").alias("images"), F.sum(n).alias("objects"), F.avg(n).alias("mean_objects"), F.min(n).alias("min_objects"), F.max(n).alias("max_objects"), F.sum(F.when(n == 0, 1).otherwise(0)).alias("empty_images")
    )


def evidence(truth: DataFrame, pred: DataFrame, frame_area: float, small_share: float = 0.005, many_small: int = 8, conflict_class: str | None = None) -> DataFrame:
    """One row a frame: class sets, matched pairs and their mean IoU, disagreements, missing and extra boxes, confidences, and
    whether a class comes in many small boxes."""
    pairs = one_to_one(truth, pred)
    named = pairs.join(truth.select("frame", F.col("box_id").alias("truth_id"), F.col("class_name").alias("truth_class")), ["frame", "truth_id"]).join(pred.select("frame", "box_id", "class_name"), ["frame", "box_id"])
    m = named.groupBy("frame").agg(F.count("*").alias("matched"), F.avg("overlap").alias("mean_iou"), F.sum((F.col("truth_class") != F.col("class_name")).cast("int")).alias("class_disagreements"))
    t = truth.groupBy("frame").agg(F.count("*").alias("truths"), F.array_sort(F.collect_set("class_name")).alias("truth_classes"))
    small = (area(box("x1", "y1", "x2", "y2")) / frame_area < small_share) & (F.col("class_name") == conflict_class if conflict_class else F.lit(True))
    p = pred.groupBy("frame").agg(
        F.count("*").alias("proposals"), F.array_sort(F.collect_set("class_name")).alias("proposed_classes"),
        F.avg("confidence").alias("confidence_mean"), F.min("confidence").alias("confidence_min"), F.max("confidence").alias("confidence_max"), F.sum(small.cast("int")).alias("n_small"),
    )
    out = t.join(p, "frame", "full").join(m, "frame", "left").na.fill(0, ["truths", "proposals", "matched", "class_disagreements", "n_small"]).na.fill(0.0, ["mean_iou", "confidence_mean", "confidence_min", "confidence_max"])
    empty = F.array().cast("array<string>")
    return out.withColumns({
        "truth_classes": F.coalesce("truth_classes", empty), "proposed_classes": F.coalesce("proposed_classes", empty),
        "missing": F.col("truths") - F.col("matched"), "extra": F.col("proposals") - F.col("matched"), "policy_conflict": F.col("n_small") >= many_small,
    }).drop("n_small")


# The names of a review's flags.
FLAGS = (
    "class_disagreement", "missing_detection", "extra_detection", "grape_policy_conflict", "conflicting_classes", "low_confidence", "unusual_object_count", "poor_box_overlap",
    "no_ai_proposal", "ai_detects_no_gt_object",
)

# Weights and caps of the review score.
CATEGORY_BASE = (("ambiguous_classes", 25.0), ("empty_labels", 20.0), ("tiny_boxes", 15.0), ("many_objects", 15.0), ("huge_box", 10.0), ("huge_boxes", 10.0))


def review_score(ev: DataFrame, many: int = 60) -> DataFrame:
    """``evidence`` rows with an array column ``categories``, scored 0 to 100, with level and flags."""
    base = F.lit(0.0)
    for name, points in reversed(CATEGORY_BASE):
        base = F.when(F.array_contains("categories", name), F.lit(points)).otherwise(base)
    capped = lambda c, cap, points: F.least(F.col(c), F.lit(cap)) * points
    when = lambda c, points: F.when(c, F.lit(float(points))).otherwise(F.lit(0.0))
    matched, overlap = F.col("matched") > 0, F.col("mean_iou")
    sets_differ = F.col("truth_classes") != F.col("proposed_classes")
    odd_count = (F.col("truths") >= many) | ((F.col("truths") > 0) & (F.col("proposals") >= 2 * F.col("truths")))
    unsure = (F.col("proposals") > 0) & (F.col("confidence_mean") < 0.5)
    score = (
        base + capped("class_disagreements", 3, 18) + capped("missing", 4, 15) + capped("extra", 6, 8)
        + F.when(matched & (overlap < 0.3), 25.0).when(matched & (overlap < 0.5), 12.0).otherwise(0.0)
        + when(sets_differ, 20) + when(odd_count, 10) + when(unsure, 15) + when(F.col("policy_conflict"), 30)
    )
    raised = [
        F.col("class_disagreements") > 0, F.col("missing") > 0, F.col("extra") > 0, F.col("policy_conflict"), sets_differ, unsure, odd_count, matched & (overlap < 0.5),
        F.col("proposals") == 0, (F.col("truths") == 0) & (F.col("proposals") > 0),
    ]
    flags = dict(zip(FLAGS, raised, strict=True))
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
    out = ev.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), "flags": named})
    return out.withColumn("level", F.when(F.col("score") >= 40, "HIGH").when(F.col("score") >= 15, "MEDIUM").otherwise("LOW"))


def cap_boxes(df: DataFrame, most: int = 20, order: str = "box_id") -> DataFrame:
    """The first ``most`` boxes of each frame in the detector's order."""
    w = Window.partitionBy("frame").orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")
