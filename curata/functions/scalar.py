"""Scalar functions as Column expressions."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# ---- hashes

def gradient_hash(values: Column) -> Column:
    """Bits of a numeric array's adjacent differences, first difference highest: bit i is set where the array rises.
    Arrays of 64 values give 63 bits, which fit a BIGINT."""
    n = F.size(values)
    bits = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.when(F.element_at(values, i + 1) > F.element_at(values, i), F.lit(1)).otherwise(F.lit(0)))
    return F.when(n >= 2, F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc * 2 + b))


def gradient_hash_above(pixels: Column, width: int = 9) -> Column:
    """Bits of an image's rows of ``width`` pixels, given as one array: set where a pixel is brighter than the one above it, the first
    pixel of the second row highest. Eight rows of nine give 63 bits."""
    bits = F.transform(F.sequence(F.lit(width + 1), F.size(pixels)), lambda i: F.when(F.element_at(pixels, i) > F.element_at(pixels, i - width), F.lit(1)).otherwise(F.lit(0)))
    return F.when(F.size(pixels) > width, F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc * 2 + b))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes differ."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming_text(a: Column, b: Column) -> Column:
    """Places in which two bit strings differ; of unequal lengths the longer length."""
    la, lb = F.length(a), F.length(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(la != lb, F.greatest(la, lb)).when(la == 0, F.lit(0)).otherwise(F.aggregate(pairs, F.lit(0), lambda acc, d: acc + d))


def canonical_json_digest(value: Column) -> Column:
    """SHA-256 of a map as JSON with its keys in order, whatever the order of its entries."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(value)))
    return F.sha2(F.to_json(ordered).cast("binary"), 256)


# ---- boxes; a box is a struct of x1, y1, x2, y2

def box(x1, y1, x2, y2) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.col(v)
    return F.struct(*[as_col(v).alias(n) for v, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)])


def width(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0))


def height(b: Column) -> Column:
    return F.greatest(b["y2"] - b["y1"], F.lit(0))


def area(b: Column) -> Column:
    return width(b) * height(b)


def center(b: Column) -> Column:
    """Whole-number centre of a box with whole-number corners."""
    return F.struct(F.floor((b["x1"] + b["x2"]) / 2).alias("x"), F.floor((b["y1"] + b["y2"]) / 2).alias("y"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0))
    both = (w * h).cast("double")
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def center_distance(a: Column, b: Column) -> Column:
    ca, cb = center(a), center(b)
    return F.sqrt(F.pow(ca["x"] - cb["x"], 2) + F.pow(ca["y"] - cb["y"], 2))


def expand(b: Column, ratio: float, frame_width: Column, frame_height: Column) -> Column:
    """A box with a margin of ``ratio`` of its sides, within the frame."""
    dx, dy = F.floor(width(b) * ratio), F.floor(height(b) * ratio)
    return clamp(box(b["x1"] - dx, b["y1"] - dy, b["x2"] + dx, b["y2"] + dy), frame_width, frame_height)


def clamp(b: Column, frame_width: Column, frame_height: Column) -> Column:
    inside = lambda v, top: F.greatest(F.lit(0), F.least(v, top)).cast("long")
    return box(inside(b["x1"], frame_width), inside(b["y1"], frame_height), inside(b["x2"], frame_width), inside(b["y2"], frame_height))


def scale_from_letterbox(b: Column, size: float, frame_width: Column, frame_height: Column) -> Column:
    """A box of a ``size`` x ``size`` letterboxed image in the coordinates of the original frame."""
    ratio = F.least(F.lit(float(size)) / frame_width, F.lit(float(size)) / frame_height)
    pad_x, pad_y = (F.lit(float(size)) - frame_width * ratio) / 2, (F.lit(float(size)) - frame_height * ratio) / 2
    moved = box((b["x1"] - pad_x) / ratio, (b["y1"] - pad_y) / ratio, (b["x2"] - pad_x) / ratio, (b["y2"] - pad_y) / ratio)
    return clamp(moved, frame_width, frame_height)


def polygon_box(xs: Column, ys: Column) -> Column:
    """The tight box of a polygon given by two arrays."""
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def to_yolo(b: Column, frame_width: Column, frame_height: Column) -> Column:
    """Normalised centre and size of a pixel box."""
    return F.struct(
        ((b["x1"] + b["x2"]) / 2 / frame_width).alias("cx"),
        ((b["y1"] + b["y2"]) / 2 / frame_height).alias("cy"),
        ((b["x2"] - b["x1"]) / frame_width).alias("w"),
        ((b["y2"] - b["y1"]) / frame_height).alias("h"),
    )


def from_yolo(y: Column, frame_width: Column, frame_height: Column) -> Column:
    return box(
        (y["cx"] - y["w"] / 2) * frame_width, (y["cy"] - y["h"] / 2) * frame_height, (y["cx"] + y["w"] / 2) * frame_width, (y["cy"] + y["h"] / 2) * frame_height
    )


def drift(a: Column, b: Column) -> Column:
    """Distance of two centres over the diagonal of the first box; 0 where that is a point."""
    mid = lambda p, lo, hi: (p[lo] + p[hi]) / 2
    far = F.sqrt(F.pow(mid(a, "x1", "x2") - mid(b, "x1", "x2"), 2) + F.pow(mid(a, "y1", "y2") - mid(b, "y1", "y2"), 2))
    diagonal = F.sqrt(F.pow(width(a), 2) + F.pow(height(a), 2))
    return F.when(diagonal > 0, far / diagonal).otherwise(F.lit(0.0))


def yolo_line(class_id: Column, y: Column) -> Column:
    """A label line with six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, y["cx"], y["cy"], y["w"], y["h"])


# ---- text

def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def parent_folder(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -2)


def tokens(text: Column) -> Column:
    """Lower-case tokens between dashes, underscores and blanks."""
    return F.filter(F.split(F.translate(F.lower(text), "-_", "  "), r"\s+"), lambda t: t != "")


def parse_state_class(name: Column, states: Sequence[str] = ("fresh", "stale", "rotten")) -> Column:
    """(state, item) from ``item_state``, ``state_item`` or ``stateitem(s)``; (null, name) where no state is found."""
    either = "|".join(states)
    low = F.lower(F.trim(name))
    pick = lambda pattern, i: F.regexp_extract(low, pattern, i)
    suffix, prefix, joined = rf"^(.+)_({either})$", rf"^({either})_(.+)$", rf"^({either})(.+?)s?$"
    return (
        F.when(low.rlike(suffix), F.struct(pick(suffix, 2).alias("state"), pick(suffix, 1).alias("item")))
        .when(low.rlike(prefix), F.struct(pick(prefix, 1).alias("state"), pick(prefix, 2).alias("item")))
        .when(low.rlike(joined), F.struct(pick(joined, 1).alias("state"), pick(joined, 2).alias("item")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("state"), low.alias("item")))
    )


def listed_names(markdown: Column) -> Column:
    """Names between back ticks in list items of a Markdown text."""
    return F.regexp_extract_all(markdown, F.lit(r"(?m)^\s*[-*]\s+`([^`]+)`"), F.lit(1))


# ---- numbers

def fuse(a: Column, b: Column, weight_a: float = 0.3, weight_b: float = 0.7, floor: float = 1e-6) -> Column:
    """Weighted mean of two confidences, within [floor, 1]."""
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), (a * weight_a + b * weight_b) / (weight_a + weight_b)))


def sanitize_confidence(value: Column) -> Column:
    """A finite number within [0, 1]; null where the value is null, NaN or infinite."""
    v = value.cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    """Place of the largest value, from 0; the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_two_gap(values: Column) -> Column:
    """Largest value less the second largest; the largest where there is one alone."""
    s = F.sort_array(values, asc=False)
    return F.element_at(s, 1) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))


def smoothed_cross_entropy(probs: Column, target: Column, smoothing: float = 0.1) -> Column:
    """Cross entropy against a target that holds 1 - smoothing, the rest spread over all classes."""
    logs = F.transform(probs, lambda p: -F.log(F.greatest(p, F.lit(1e-12))))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, b: a + b) / F.size(probs)
    return (1 - smoothing) * F.element_at(logs, target + 1) + smoothing * mean


# ---- dates, lookups

# The four accepted forms of a capture time.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")


def parse_time(text: Column, formats: Iterable[str] = TIME_FORMATS) -> Column:
    """A timestamp in any of the formats, else null. Fractions of a second are not among them."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def storage_condition(value: Column, default: str = "ambient", allowed: Sequence[str] = ("ambient", "refrigerated")) -> Column:
    """Normalised storage condition; null is the default; any other value raises."""
    key = F.lower(F.trim(F.coalesce(value, F.lit(default))))
    return F.when(key.isin(*allowed), key).otherwise(F.raise_error(F.concat(F.lit("unsupported storage condition: "), value)).cast("string"))


def class_ids(text: Column) -> Column:
    """Whole numbers of an "a/b" list."""
    return F.filter(F.transform(F.split(text, "/"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def votes(labels: Column) -> Column:
    """Map from label to its count in an array."""
    return F.map_from_entries(F.transform(F.array_distinct(labels), lambda l: F.struct(l.alias("key"), F.size(F.filter(labels, lambda x: x == l)).alias("value"))))


def majority(labels: Column) -> Column:
    """The most frequent label of an array; of equals the one that occurs first."""
    distinct = F.array_distinct(labels)
    ranked = F.transform(distinct, lambda l: F.struct(F.size(F.filter(labels, lambda x: x == l)).alias("n"), (-F.array_position(labels, l)).alias("at"), l.alias("label")))
    return F.array_max(ranked)["label"]


def apportion(n: int, ratios: Sequence[float]) -> list[int]:
    """Largest-remainder split of ``n`` units; each share gets one at least where there are as many units as shares."""
    if n <= 0:
        return [0] * len(ratios)
    exact = [n * r / sum(ratios) for r in ratios]
    parts = [int(x) for x in exact]
    by_rest = sorted(range(len(ratios)), key=lambda i: (parts[i] - exact[i], i))
    for i in by_rest[: n - sum(parts)]:
        parts[i] += 1
    if n >= len(ratios):
        while 0 in parts:
            parts[parts.index(max(parts))] -= 1
            parts[parts.index(0)] += 1
    return parts


def all_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions)
