"""Records of large JSON arrays, read by many tasks.

A JSON file that is one array can't be cut at lines. Spark's text reader cuts it at each ``}`` instead, so that a file's byte
ranges go to tasks. Where a range begins, it is open whether that is within a string and how deep in brackets; so each
range is summed up first under both assumptions (the state of strings at its end, the change of depth), and the sums of the
ranges before it, one row a range, tell which of them holds. Then each range gives the records that end in it; what is
left of a record at a range's edges is put together, whole, from the few ranges that hold its pieces.

Records are the elements of a root array, or of the arrays of a root object, told by their ``key``. Only objects are records.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.session import materialize

#: The rest of a string up to its closing quote, which is not escaped.
_CLOSE = re.compile(r'(?:[^"\\]|\\.)*?"', re.DOTALL)
_TOKEN = re.compile(r'["\[\]{}]')
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)

PIECE = "file string, block long, value string"


class Scanner:
    """Walks over text from a state (in a string or not, depth) and tells of each bracket outside strings."""

    def __init__(self, in_string: bool, depth: int):
        self.in_string, self.depth = in_string, depth

    def brackets(self, text: str):
        """(place, bracket, depth after it)."""
        at = 0
        while at < len(text):
            if self.in_string:
                found = _CLOSE.match(text, at)
                if not found:
                    return
                at, self.in_string = found.end(), False
                continue
            token = _TOKEN.search(text, at)
            if not token:
                return
            at = token.end()
            c = token[0]
            if c == '"':
                self.in_string = True
                continue
            self.depth += 1 if c in "[{" else -1
            yield token.start(), c, self.depth


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``PIECE``: text up to each ``}``, which is left out, by file and the start of its range."""
    df = spark.read.option("lineSep", "}").text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _ranges(batches):
    """(file, block, text) of each piece, with its bracket."""
    for batch in batches:
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            yield file, block, (value or "") + "}"


def _sums(batches):
    """For mapInArrow over pieces: (file, block, ends_out, delta_out, ends_in, delta_in, root), under both assumptions; root is the first bracket
    of a file's first range."""
    import pyarrow as pa

    known, scans, root, rows = None, (), None, []
    for file, block, text in _ranges(batches):
        if (file, block) != known:
            if known:
                rows.append((*known, *(x for s in scans for x in (s.in_string, s.depth)), root))
            known, scans, root = (file, block), (Scanner(False, 0), Scanner(True, 0)), None
        for i, scan in enumerate(scans):
            for _, c, _ in scan.brackets(text):
                if i == 0 and root is None:
                    root = c
    if known:
        rows.append((*known, *(x for s in scans for x in (s.in_string, s.depth)), root))
    if rows:
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "block", "ends_out", "delta_out", "ends_in", "delta_in", "root"])


def _states(sums: DataFrame) -> DataFrame:
    """(file, block, in_string, depth, level): the state in which each range begins, and the depth of the records' array. One row a range is walked
    over in order, a file at a time."""

    def walk(batches):
        import pyarrow as pa

        file, state, root = None, None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != file:
                    file, state, root = r["file"], (False, 0), r["root"]
                rows.append((file, r["block"], *state, 1 if root == "[" else 2))
                ends, delta = (r["ends_in"], r["delta_in"]) if state[0] else (r["ends_out"], r["delta_out"])
                state = (ends, state[1] + delta)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "block", "in_string", "depth", "level"])

    return sums.repartition("file").sortWithinPartitions("file", "block").mapInArrow(walk, "file string, block long, in_string boolean, depth long, level long")


FOUND = "file string, block long, place long, kind string, key string, value string"


def _find(batches):
    """For mapInArrow over pieces with their range's state: the rows of ``FOUND``. ``record``: a whole one. ``head``: text before the first bracket that ends the record with
    which the range began, to that bracket (``closed`` in its key; ``other`` if it was no record) or all of it; ``tail``: the start of a record that doesn't end here. ``array``: a value of a root object
    opens, with its key if it is an array, or closes."""
    import pyarrow as pa

    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    known, scan, level, held, open_, before, place, out = None, None, 0, [], False, "", 0, []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def end():
        if known and open_:
            out.append((*known, place + 1, "head" if began else "tail", None, "".join(held)))

    began = False
    for batch in batches:
        for file, block, value, in_string, depth, base in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value", "in_string", "depth", "level")), strict=True):
            if (file, block) != known:
                end()
                known, scan, level, held, before, place = (file, block), Scanner(in_string, depth), base, [], "", 0
                open_ = began = depth > level
            text = (value or "") + "}"
            at = 0
            for where, c, after in scan.brackets(text):
                if c == "{" and after == level + 1:
                    open_, began, at, held = True, False, where, []
                elif c == "}" and after == level and open_:
                    held.append(text[at : where + 1])
                    place += 1
                    out.append((*known, place, "head" if began else "record", "closed" if began else None, "".join(held)))
                    open_ = began = False
                    held = []
                elif open_ and after <= level:
                    # the range began in something else of that depth
                    place += 1
                    out.append((*known, place, "head", "other", None))
                    open_ = began = False
                    held = []
                if level == 2 and c in "[{" and after == 2:
                    key = _KEY.search((before + text[:where])[-4096:]) if c == "[" else None
                    place += 1
                    out.append((*known, place, "array", key[1] if key else None, None))
                elif level == 2 and c in "]}" and after == 1:
                    place += 1
                    out.append((*known, place, "array", None, None))
            if open_:
                held.append(text[at:])
            before = text if len(text) >= 4096 else (before + text)[-4096:]
            if len(out) >= 4096:
                yield made()
                out.clear()
    end()
    if out:
        yield made()


def json_records(spark: SparkSession, path: str, key: str = "records") -> DataFrame:
    """(file, row_number, value): the text of each object in the root array of JSON files, or in the array ``key`` of a root object, numbered
    from 1 in the order of the file."""
    rows = pieces(spark, path)
    states = materialize(_states(rows.mapInArrow(_sums, "file string, block long, ends_out boolean, delta_out long, ends_in boolean, delta_in long, root string")), "ranges")
    # one row a range of a file
    found = materialize(rows.join(F.broadcast(states), ["file", "block"]).mapInArrow(_find, FOUND), "found", compression="zstd")
    # pieces of records over the edges of ranges: a tail, whole ranges within a record, and a head that closes
    edges = found.filter(F.col("kind").isin("head", "tail"))
    by_block = Window.partitionBy("file").orderBy("block", "place")
    starts = F.when(F.col("kind") == "tail", F.struct("block", "place"))
    ends = F.when((F.col("kind") == "head") & F.col("key").isNotNull(), F.struct("block", "place"))
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumns({"start": F.last(starts, True).over(by_block), "ended": F.last(ends, True).over(earlier)})
    edges = edges.filter(F.col("start").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("start"))))
    whole = edges.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("parts"), F.max(F.col("key") == "closed").alias("closed")).filter("closed")
    whole = whole.select("file", F.col("start.block").alias("block"), F.col("start.place").alias("place"), F.lit(True).alias("tail"), F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    records = found.filter("kind = 'record'").select("file", "block", "place", F.lit(False).alias("tail"), "value").unionByName(whole)
    # the array in which a range begins is the last that an earlier one opened; marks are few, unless an object has very many arrays
    marks = found.filter("kind = 'array'").select("file", "block", "place", F.col("key").alias("array"))
    last = marks.groupBy("file", "block").agg(F.max_by(F.struct("array"), "place").alias("last"))
    carried = states.select("file", "block", "level").join(last, ["file", "block"], "left")
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("file", "block", "level", F.last("last", True).over(ahead)["array"].alias("carried"))
    own = marks.groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("place", "array"))).alias("marks"))
    placed = records.join(F.broadcast(carried.join(own, ["file", "block"], "left")), ["file", "block"])
    # a record that is cut by the range's end comes after all of its marks
    mine = F.filter("marks", lambda m: F.col("tail") | (m["place"] < F.col("place")))
    array = F.when(F.coalesce(F.size(mine), F.lit(0)) > 0, F.element_at(mine, -1)["array"]).otherwise(F.col("carried"))
    kept = placed.filter((F.col("level") == 1) | (array == key)).select("file", "block", F.when(F.col("tail"), F.lit(1 << 62)).otherwise(F.col("place")).alias("place"), "value")
    kept = materialize(kept, "records", compression="zstd")
    counts = kept.groupBy("file", "block").agg(F.count("*").alias("n"))
    counts = counts.select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("place"))
    return kept.withColumn("r", within).join(F.broadcast(counts), ["file", "block"]).select("file", (F.col("before") + F.col("r")).alias("row_number"), "value")
