"""Vector code compression: product codes of integer vectors, entries found by annular norm pruning.

Components become ``floor(scale * x)``, vectors are cut into equal consecutive parts, and each part position has
a codebook. A part's nearest entry is found exactly: entries are sorted by norm, the few nearest in norm
(binary search) give a first distance d, and as |norm(part) - norm(entry)| is at most their distance, only entries
whose norm lies within d of the part's, bounds included, are evaluated, in whole numbers. The bounds are widened by more than the rounding
of square roots, so no entry that ties is missed; ties go to the lower index.

A round is one pass: each task assigns its parts and sends a count and the sums of each entry that it used;
those are added up by entry, and the codebooks, ``entries`` x dimensions whole numbers at any number of vectors, go
to the tasks of the next pass.

Defined results: a vector that is null or holds a null or a component that is not finite is dropped. Rows may share an id or have
none: ids decide the first codebook only, null after all others, ties by the vector. Fewer vectors than entries give smaller codebooks; an
empty table gives no rows and empty codebooks. A null label is a label. Equal vectors have equal codes, and empty vectors a code of zeros. Other columns are not
read. Vectors of unequal length, or of a length that the parts don't divide, stop the job with a message, as does an error beyond a 64-bit number; large
components are computed in whole numbers of any size.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import only
from curata.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that give the first distance.
PROBES = 8
#: Whole numbers below it can be squared and summed in 64 bits, over up to 2048 components.
SAFE = 1 << 25


def to_integers(values, scale: int):
    """floor(scale * x) of finite floats: 64-bit numbers, or Python's where one is too large to be squared in them."""
    import numpy as np

    scaled = np.floor(values.astype(np.float64) * scale)
    if not len(scaled) or np.abs(scaled).max() < SAFE:
        return scaled.astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in values.tolist()]
    return np.array(exact, dtype=object)


def norms(parts):
    """Lengths of integer vectors, as floats."""
    import numpy as np

    return np.sqrt((parts * parts).sum(axis=1).astype(np.float64))


class AnnularSearch:
    """Nearest entries of one codebook, an array of entries x width."""

    def __init__(self, codebook):
        import numpy as np

        own = norms(codebook)
        self.order = np.argsort(own, kind="stable")
        self.norms = own[self.order]
        self.entries = codebook[self.order]

    def nearest(self, parts):
        """(index, squared distance, entries evaluated) of each row of ``parts``."""
        import numpy as np

        length, known = norms(parts), self.norms
        # the best distance so far: of the entries nearest in norm, PROBES at most
        probes = min(PROBES, len(known))
        start = np.clip(np.searchsorted(known, length) - probes // 2, 0, len(known) - probes)
        away = parts[:, None, :] - self.entries[start[:, None] + np.arange(probes)]
        reach = np.sqrt((away * away).sum(axis=2).min(axis=1).astype(np.float64))
        slack = 1e-9 * (reach + length + 1)
        low = np.searchsorted(known, length - reach - slack, side="left")
        high = np.searchsorted(known, length + reach + slack, side="right")
        widths = high - low
        starts = np.cumsum(widths) - widths
        row = np.repeat(np.arange(len(parts)), widths)
        place = np.arange(int(widths.sum())) - np.repeat(starts - low, widths)
        away = parts[row] - self.entries[place]
        squared = (away * away).sum(axis=1)
        least = np.minimum.reduceat(squared, starts)
        index = np.where(squared == np.repeat(least, widths), self.order[place], len(known))
        return np.minimum.reduceat(index, starts), least, widths


def _vectors(batch, scale: int, dimensions: int):
    """The kept vectors of an Arrow batch with a list column ``v``, as integers."""
    import numpy as np

    column = batch.column("v")
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) and (len(lengths) > 1 or lengths[0] != dimensions):
        raise ValueError(f"vectors of {dimensions} components are expected, there are some of {lengths.tolist()}")
    return to_integers(np.asarray(column.flatten().to_numpy(zero_copy_only=False)), scale).reshape(len(column), dimensions)


def _assigned(vectors, codebooks):
    """For each part position (position, its parts, index, squared distance)."""
    width = codebooks[0].shape[1]
    for p, codebook in enumerate(codebooks):
        parts = vectors[:, p * width : (p + 1) * width]
        index, squared, _ = AnnularSearch(codebook).nearest(parts)
        yield p, parts, index, squared


def _sums(codebooks, scale: int, dimensions: int):
    """For mapInArrow: (part, entry, n, place, total) of a task's rows, totals as decimal numbers."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts, totals = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, parts, index, _ in _assigned(_vectors(batch, scale, dimensions), codebooks):
                for e in np.unique(index).tolist():
                    mine = parts[index == e]
                    counts[p, e] = counts.get((p, e), 0) + len(mine)
                    totals[p, e] = [a + int(b) for a, b in zip(totals.get((p, e), [0] * parts.shape[1]), mine.sum(axis=0), strict=True)]
        rows = [(p, e, counts[p, e], str(place), str(total)) for (p, e), own in sorted(totals.items()) for place, total in enumerate(own)]
        if rows:
            part, entry, n, place, total = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array([int(x) for x in place], pa.int32()), pa.array(total, pa.string())], names=["part", "entry", "n", "place", "total"])

    return run


def finite_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, v, label) of the rows whose vector is finite throughout."""
    own = only(vectors, id_col, vector_col, label_col).toDF("id", "v", "label")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.filter(F.col("v").isNotNull() & ~bad)


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> list:
    """One array of entries x width for each part: that part of the vectors with the smallest ids."""
    import numpy as np

    first = [list(r.v) for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    if not first:
        return []
    dimensions = len(first[0])
    if dimensions % parts or any(len(v) != dimensions for v in first):
        raise ValueError(f"{parts} parts don't divide vectors of {sorted({len(v) for v in first})} components")
    whole = to_integers(np.array(first, dtype=np.float64).reshape(-1), scale).reshape(len(first), dimensions)
    width = dimensions // parts
    return [whole[:, p * width : (p + 1) * width] for p in range(parts)]


def refined(kept: DataFrame, codebooks: list, scale: int = SCALE) -> list:
    """The codebooks after one round: entries are the floors of the means of their parts; unused ones stay."""
    import numpy as np

    if not codebooks:
        return codebooks
    dimensions = len(codebooks) * codebooks[0].shape[1]
    found = kept.select("v").mapInArrow(_sums(codebooks, scale, dimensions), "part int, entry int, n long, place int, total string")
    # totals stay exact: a decimal of 38 digits holds them, or they come as they are
    added = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    made = [c.astype(object) for c in codebooks]
    for r in added.collect():  # entries x dimensions rows
        made[r.part][r.entry, r.place] = int(r.total) // r.n
    return [c.astype(np.int64) if all(abs(x) < SAFE for x in c.reshape(-1)) else c for c in made]


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list:
    codebooks = first_codebooks(kept, parts, entries, scale)
    for _ in range(rounds):
        codebooks = refined(kept, codebooks, scale)
    return codebooks


def encode(kept: DataFrame, codebooks: list, scale: int = SCALE) -> DataFrame:
    """(id, label, code, error): a byte a part, and the squared distance to the coded vector in whole numbers."""
    if codebooks and len(codebooks[0]) > 256:
        raise ValueError("a code is a byte: at most 256 entries")
    dimensions = len(codebooks) * codebooks[0].shape[1] if codebooks else 0

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros((batch.num_rows, len(codebooks)), dtype=np.uint8)
            error = 0
            for p, _, index, squared in _assigned(_vectors(batch, scale, dimensions), codebooks):
                codes[:, p] = index
                error = error + squared.astype(object)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.tolist(), pa.int64())], names=["id", "label", "code", "error"])

    types = dict(kept.dtypes)
    return kept.mapInArrow(run, f"id {types['id']}, label {types['label']}, code binary, error long")


def decode(coded: DataFrame, codebooks: list, scale: int = SCALE) -> DataFrame:
    """``coded`` with ``v``: each code's entries side by side, divided by the scale."""
    tables = [c.tolist() for c in codebooks]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [[x / scale for part, i in zip(tables, code, strict=True) for x in part[i]] for code in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*batch.schema.names, "v"])

    return coded.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in coded.dtypes) + ", v array<double>")


def codebook_digest(codebooks: list) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for c in codebooks for x in c.reshape(-1)).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list]:
    """(id, label, code, error, label_error) of the kept rows, written once, and the codebooks."""
    kept = finite_vectors(vectors, id_col, vector_col, label_col)
    codebooks = train(kept)
    coded = materialize(encode(kept, codebooks), "codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), codebooks


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The contract's rows in DuckDB's SQL: all entries are compared."""

    def assigned(name: str, book: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT vec_id, r, label, p, parts.part, min((list_sum(list_transform(list_zip(parts.part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS best
  FROM parts JOIN {book} USING (p) GROUP BY vec_id, r, label, p, parts.part)"""

    def averaged(name: str, last: str, book: str) -> str:
        return f"""{name}_s AS (SELECT p, e, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT p, best[2] AS e, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM {last}) GROUP BY p, e, i),
{name} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM {book} b LEFT JOIN (
  SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS entry FROM {name}_s GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""

    steps, book = [], "b0"
    for k in range(1, rounds + 1):
        steps += [assigned(f"a{k}", book), averaged(f"b{k}", f"a{k}", book)]
        book = f"b{k}"
    steps.append(assigned("a", book))
    return f"""
WITH kept AS (SELECT vec_id, label, embedding, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, r, label, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS part FROM kept, range({parts}) t(p)),
b0 AS (SELECT p, r - 1 AS e, part AS entry FROM parts WHERE r <= {entries}),
{", ".join(steps)},
coded AS (SELECT vec_id, r, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a GROUP BY vec_id, r, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM {book}) AS codebooks_sha256
FROM coded
"""
