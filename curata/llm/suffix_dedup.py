"""Suffix-array dedup: removes bytes covered by strings of ``LENGTH`` bytes that also start elsewhere.

Sorting every suffix of the corpus would move many times its size, and almost all suffixes
have no long common prefix with any other. So suffixes are sorted only where that is open:

1. *Texts.* Rows with equal texts are one text with a number of copies; copies are found by their
   SHA-256 and compared byte by byte, within their partition and then with those of other ones. A text that has
   copies goes as a whole, and takes part once in what follows.
2. *Anchors.* Of the ``LENGTH - GRAM + 1`` grams of each window (the string of ``LENGTH``
   bytes from a start) the one with the smallest hash is its anchor. Equal windows have equal
   anchors at equal places, so starts fall into segments, runs with one anchor, and windows
   can be equal only if their anchors are. Gram hashes are differences of prefix polynomial
   hashes; one row a segment is moved (about 1 in 85 starts). An anchor that occurs once
   settles its whole segment: nothing in it repeats.
3. *Kinds.* Segments around equal anchors that have one digest are one kind. Their bytes are
   fetched and compared, not only their digests; where two or more are equal, all of their
   windows repeat. One segment of each kind goes on, with the number of its copies.
4. *Suffix sort.* In each anchor's group the suffixes of its kinds are mergesorted, by numpy
   within a task: two suffixes are compared by a binary search for their common extension over
   prefix hashes, at most 8 steps for ``LENGTH`` bytes, and then by one byte. Only suffixes at
   equal distance from the anchor can share ``LENGTH`` bytes, so those are sorted against each
   other. Neighbours whose common extension reaches ``LENGTH`` repeat; their bytes are compared,
   so a collision of hashes can't remove anything.
5. *Frequent anchors.* An anchor of more than ``GROUP_KINDS`` kinds (a short passage in very
   many surroundings) is not sorted in one task: its windows are counted by hash with map-side
   sums, and those that occur twice are compared byte by byte like the kinds of step 3.
6. *Removal.* Each text's repeated starts are joined to it, and the bytes they cover are cut.
   Judgement is on the input, matches never cross documents.

Groups of step 3 are dealt over tasks in shares of about ``SHARE_ROWS``, and a task sends on
only the first two of equal segments; the others it compares and settles itself. So nothing is
removed without a comparison of bytes, be it of whole texts, of segments or of neighbours in the sort. A repeat can be missed only where two different
strings collide in both a 64-bit polynomial hash and a 64-bit digest.

Defined results: null texts are empty, null ids stay null; texts under ``LENGTH`` bytes are kept; very long texts are
hashed ``SLICE`` starts at a time, with the same result; rows that repeat a text lose all of it, whatever their ids; ties
don't occur, as all places of a repeated string are cut; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import by_key, partitions, text_key, worker_state
from curata.llm.tokens import text_batches
from curata.session import materialize, release

LENGTH = 200
GRAM = 32
#: Starts that are handled at once in a long text.
SLICE = 1 << 20
#: An anchor's group of at most so many kinds is sorted in one task.
GROUP_KINDS = 2000
#: Segments of one share of equal digests, about.
SHARE_ROWS = 2000
#: Digests that a task holds at once while it looks for equal segments.
HELD = 50_000
#: Bytes of texts that a task holds while it looks for copies.
HELD_TEXT = 16 << 20
#: Bytes of segments whose suffixes are sorted at once.
SORT_BYTES = 1 << 20

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _tables(n: int):
    """(code of each byte, powers of the base, inverse powers), for n places."""
    state = worker_state("suffixes")
    if len(state.get("powers", ((), ()))[1]) < n:
        rng = np.random.default_rng(200)
        codes = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            up = np.full(n, base, dtype=np.uint64)
            down = np.full(n, pow(base, -1, 2**64), dtype=np.uint64)
            up[0] = down[0] = 1
            state["powers"] = (codes, np.multiply.accumulate(up), np.multiply.accumulate(down))
    return state["powers"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash modulo 2^64: the hash of a stretch is a difference, shifted by a power."""
    codes, up, _ = _tables(max(len(data) + 1, SLICE + LENGTH))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes[data] * up[: len(data)], out=out[1:])
    return out


def gram_hashes(prefix: np.ndarray, gram: int) -> np.ndarray:
    down = _tables(len(prefix))[2]
    with np.errstate(over="ignore"):
        h = (prefix[gram:] - prefix[:-gram]) * down[: len(prefix) - gram]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from running minima forwards and backwards in blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def segments(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """(first start, starts, anchor's distance from the first start, anchor's hash) of each segment, as arrays."""
    found = []
    last = len(text) - length
    for at in range(0, last + 1, SLICE):
        stop = min(at + SLICE, last + 1)
        h = gram_hashes(prefix_hashes(np.frombuffer(text, dtype=np.uint8)[at : stop + length - 1]), gram)
        # hash and place in one number: the smallest hash, of equal ones the first
        keyed = (h & np.uint64(0xFFFFFFFFFFC00000)) | np.arange(len(h), dtype=np.uint64)
        best = window_minima(keyed, length - gram + 1)
        cut = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1, [len(best)]])
        place = (best[cut[:-1]] & np.uint64(0x3FFFFF)).astype(np.int64)
        found.append((cut[:-1] + at, np.diff(cut), place - cut[:-1], h[place].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


SEGMENTS = "anchor long, digest long, text_id long, start long, shape int"


def _segment_rows(length: int, gram: int):
    """For mapInArrow over (text_id, text): a row a segment. shape: its starts and its anchor's distance."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        hash64 = xxhash.xxh3_64_intdigest
        for batch, texts in text_batches(batches, rows=64):
            cols: list[list] = [[], [], [], [], []]
            for text_id, text in zip(batch.column("text_id").to_pylist(), texts, strict=True):
                first, n, distance, anchor = segments(text, length, gram)
                ends = first + n + (length - 1)
                cols[0].append(anchor)
                cols[1].append(np.fromiter((hash64(text[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(first)).view(np.int64))
                cols[2].append(np.full(len(first), text_id, dtype=np.int64))
                cols[3].append(first)
                cols[4].append((n * 1024 + distance).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["anchor", "digest", "text_id", "start", "shape"])

    return run


def _window_rows(length: int):
    """For mapInArrow over representatives of frequent anchors: a row a window, as a segment of one start."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for anchor, text_id, start, shape, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "text_id", "start", "shape", "bytes")), strict=True):
                n, distance = divmod(shape, 1024)
                at = np.arange(n)
                cols[0].append(np.full(n, anchor, dtype=np.int64))
                # a window is told by its hash and by its distance from the anchor
                cols[1].append((gram_hashes(prefix_hashes(np.frombuffer(data, dtype=np.uint8)), length)[:n] ^ (distance - at).astype(np.uint64)).view(np.int64))
                cols[2].append(np.full(n, text_id, dtype=np.int64))
                cols[3].append(start + at)
                cols[4].append((1024 + distance - at).astype(np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["anchor", "digest", "text_id", "start", "shape"])

    return run


PIECES = "anchor long, digest long, share int, shares int, kinds long, text_id long, start long, shape int, bytes binary"


def _fetch(length: int, held_at_once: int):
    """For mapInArrow over (text, parts): the bytes of the listed segments. Of segments with one digest the first two in a
    task are sent on, to one share; a later one whose bytes equal the first's is settled here, and has no bytes then."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple[int, int], list] = {}
        fields = PIECES.split(", ")
        types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in fields]
        for batch, texts in text_batches(batches, rows=64):
            parts = batch.column("parts")
            flat = parts.flatten()
            bounds = (parts.offsets.to_numpy() - parts.offsets[0].as_py()).tolist()
            listed = {c: flat.field(c).to_pylist() for c in ("anchor", "digest", "n", "kinds", "share", "shares", "text_id", "start", "shape")}
            found: list[bytes | None] = []
            for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
                for i in range(a, b):
                    at = listed["start"][i]
                    data: bytes | None = text[at : at + listed["shape"][i] // 1024 + length - 1]
                    if listed["n"][i] > 2:
                        key = (listed["anchor"][i], listed["digest"][i])
                        known = held.get(key)
                        if known is None:
                            if len(held) >= held_at_once:
                                held.clear()
                            held[key] = [data, listed["share"][i], 1]
                        elif known[0] == data:
                            known[2] += 1
                            listed["share"][i] = known[1]
                            if known[2] > 2:
                                # settled: it needs no group, so it goes to any task
                                data = None
                                listed["share"][i] = -1 - listed["text_id"][i] % 1009
                    found.append(data)
            columns = [pa.array(found if name == "bytes" else listed[name], t) for name, t in zip((f.split()[0] for f in fields), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields])

    return run


COMPARED = "anchor long, digest long, shares int, kinds long, text_id long, start long, shape int, again boolean, bytes binary"


def _compare(batches):
    """For mapInArrow over ``PIECES`` by (anchor, digest, share): which segments repeat as a whole (``again``); the bytes
    stay with one segment of each kind, if its anchor has other kinds or its digest other shares. Segments that were
    settled before pass."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for table, starts in by_key(batches, ["anchor", "digest", "share"]):
        data = table.column("bytes").combine_chunks()
        sizes = np.diff(starts)
        head = np.repeat(starts[:-1], sizes)
        with_bytes = pc.is_valid(data).to_numpy(zero_copy_only=False)
        # rows with bytes come first in a group
        same = pc.fill_null(pc.equal(data, data.take(pa.array(head))), True).to_numpy(zero_copy_only=False)
        again = np.repeat(np.add.reduceat(with_bytes.astype(np.int64), starts[:-1]) > 1, sizes)
        keep = np.arange(len(head)) == head
        for g in np.flatnonzero(~np.logical_and.reduceat(same, starts[:-1])):
            # different bytes of one digest: each content by itself
            rows = range(starts[g], starts[g + 1])
            by_bytes: dict[bytes, list[int]] = {}
            for r in rows:
                if with_bytes[r]:
                    by_bytes.setdefault(data[r].as_py(), []).append(r)
            for members in by_bytes.values():
                again[members] = len(members) > 1
                keep[members[0]] = True
        again |= ~with_bytes
        keep &= (table.column("kinds").to_numpy() > 1) | (table.column("shares").to_numpy() > 1)
        kept = pc.if_else(pa.array(keep), data, pa.scalar(None, pa.binary()))
        columns = [table.column(c).combine_chunks() for c in ("anchor", "digest", "shares", "kinds", "text_id", "start", "shape")]
        whole = pa.RecordBatch.from_arrays([*columns, pa.array(again), kept], names=[f.split()[0] for f in COMPARED.split(", ")])
        yield whole.filter(pa.array(again | keep))


class Suffixes:
    """Suffixes of a buffer, compared over their first ``depth`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data, self.depth = data, depth
        self.prefix = prefix_hashes(data)
        self.up = _tables(len(data) + 1)[1]

    def extension(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes at p and q, up to ``depth``: a binary search over hashes."""
        low, high = np.zeros(len(p), dtype=np.int64), np.full(len(p), self.depth, dtype=np.int64)
        first, second = np.minimum(p, q), np.maximum(p, q)
        with np.errstate(over="ignore"):
            shift = self.up[second - first]
            a, b = self.prefix[first], self.prefix[second]
            while (low < high).any():
                mid = (low + high + 1) >> 1
                same = (self.prefix[first + mid] - a) * shift == self.prefix[second + mid] - b
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """True where the suffix at p sorts before that at q."""
        same = self.extension(p, q)
        at = np.minimum(same, self.depth - 1)
        return (same < self.depth) & (self.data[p + at] < self.data[q + at])

    def sort(self, pos: np.ndarray, group_start: np.ndarray, group_end: np.ndarray) -> np.ndarray:
        """``pos`` mergesorted within groups; rows of a group lie together, and each has its group's bounds."""
        pos = pos.copy()
        index = np.arange(len(pos))
        local, size = index - group_start, group_end - group_start
        run = 1
        while run < size.max(initial=0):
            block = local // (2 * run) * (2 * run)
            left = local - block < run
            # the bounds of the run that each row is merged with
            other = group_start + block + np.where(left, run, 0)
            low = np.minimum(other, group_end)
            high = np.minimum(other + run, group_end)
            from_ = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                mine, theirs = pos[open_], pos[mid]
                # of equal suffixes those of the left run come first
                goes = np.where(left[open_], self.before(theirs, mine), ~self.before(mine, theirs))
                low[open_[goes]] = mid[goes] + 1
                high[open_[~goes]] = mid[~goes]
            own = np.where(left, local - block, local - block - run)
            target = group_start + block + own + (low - from_)
            merged = np.empty_like(pos)
            merged[target] = pos
            pos = merged
            run *= 2
        return pos

    def same_bytes(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether ``depth`` bytes at p and q are equal, byte by byte."""
        out = np.zeros(len(p), dtype=bool)
        span = np.arange(self.depth)
        for at in range(0, len(p), 4096):
            a, b = p[at : at + 4096, None] + span, q[at : at + 4096, None] + span
            out[at : at + 4096] = (self.data[a] == self.data[b]).all(axis=1)
        return out


def repeated_starts(data: np.ndarray, pos: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes at ``pos`` share ``length`` bytes with another suffix of their group."""
    out = np.zeros(len(pos), dtype=bool)
    order = np.argsort(group, kind="stable")
    g = group[order]
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    sizes = np.diff(np.concatenate([new, [len(g)]]))
    several = np.repeat(sizes > 1, sizes)
    start, end = np.repeat(new, sizes)[several], np.repeat(new + sizes, sizes)[several]
    order = order[several]
    if not len(order):
        return out
    # close the gaps that groups of one leave
    shift = np.arange(len(order)) - np.flatnonzero(several)
    start, end = start + shift, end + shift
    suffixes = Suffixes(data, length)
    sorted_pos = suffixes.sort(pos[order], start, end)
    near = np.flatnonzero(start[1:] == start[:-1])
    p, q = sorted_pos[near], sorted_pos[near + 1]
    full = suffixes.extension(p, q) >= length
    p, q = p[full], q[full]
    right = suffixes.same_bytes(p, q)
    again = np.zeros(len(data), dtype=bool)
    again[p[right]] = True
    again[q[right]] = True
    out[order] = again[pos[order]]
    return out


def _sort(length: int):
    """For mapInArrow over representatives by anchor: runs of repeated starts of segments that don't repeat as a whole."""

    def run(batches):
        import pyarrow as pa

        for table, starts in by_key(batches, ["anchor"]):
            data = table.column("bytes").combine_chunks()
            sizes = np.diff(np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1]).astype(np.int64)
            ends = np.cumsum(sizes)
            cols = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("shape", "again", "text_id", "start")}
            out: list[list] = [[], [], []]
            a = 0
            groups = np.array(starts)
            while a < len(groups) - 1:
                # whole groups, up to about SORT_BYTES
                before = int(ends[groups[a] - 1]) if groups[a] else 0
                b = a + 1
                while b < len(groups) - 1 and ends[groups[b + 1] - 1] - before <= SORT_BYTES:
                    b += 1
                lo, hi = int(groups[a]), int(groups[b])
                _sort_groups({c: v[lo:hi] for c, v in cols.items()}, data.slice(lo, hi - lo), sizes[lo:hi], groups[a : b + 1] - lo, length, out)
                a = b
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["text_id", "first", "last"])

    return run


def _sort_groups(cols, bytes_, sizes, groups, length, out) -> None:
    data = np.frombuffer(b"".join(bytes_.to_pylist()), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n, distance = np.divmod(cols["shape"].astype(np.int64), 1024)
    segment = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    group_of = np.repeat(np.arange(len(groups) - 1), np.diff(groups))
    # windows that are equal lie at equal distance before their anchor
    group = group_of[segment] * 1024 + (distance[segment] - within)
    hit = np.flatnonzero(repeated_starts(data, begin[segment] + within, group, length) & ~cols["again"].astype(bool)[segment])
    if not len(hit):
        return
    new = np.concatenate([[True], (np.diff(hit) != 1) | (segment[hit[1:]] != segment[hit[:-1]])])
    firsts = hit[new]
    lasts = hit[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hit) - 1]])]
    of = segment[firsts]
    for col, values in zip(out, (cols["text_id"][of], cols["start"][of] + within[firsts], cols["start"][of] + within[lasts]), strict=True):
        col.extend(values.tolist())


def _cut(length: int):
    """For mapInArrow over (key, copies, text, runs): what is left of each text."""

    def run(batches):
        import pyarrow as pa

        for batch, texts in text_batches(batches, rows=64):
            cols: list[list] = [[], [], [], []]
            for text, copies, runs in zip(texts, batch.column("copies").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                spans: list[list[int]] = [[0, len(text)]] if copies > 1 else []
                for r in sorted((r["first"], r["last"] + length) for r in (runs or ()) if copies == 1):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                left = b"".join(kept)
                for col, value in zip(cols, (len(text), len(text) - len(left), len(spans), left), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["key", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return run


def _equal_texts(batches):
    """For mapInArrow over (key, copies, text), in order of the key: one row a text, copies compared with it and counted."""
    import pyarrow as pa

    held: list = []
    out: list[list] = []
    size = 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["key", "copies", "text"])

    for batch in batches:
        for key, copies, text in zip(*(batch.column(c).to_pylist() for c in ("key", "copies", "text")), strict=True):
            if held and held[0] == key:
                if held[2] != text:
                    raise ValueError("unequal texts under one digest")
                held[1] += copies
                continue
            if held:
                out.append(held)
                size += len(held[2])
            held = [key, copies, text]
            if size >= 4 << 20:
                yield made()
                out, size = [], 0
    if held:
        out.append(held)
        yield made()


def _partition_texts(batches):
    """For mapInArrow over (key, copies, text): copies of a text that this partition has held lately are compared with it and sent on as one row."""
    import pyarrow as pa

    held: dict[bytes, list] = {}
    size = 0

    def made():
        rows = [(k, n, t) for k, (n, t) in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["key", "copies", "text"])

    for batch in batches:
        for key, copies, text in zip(*(batch.column(c).to_pylist() for c in ("key", "copies", "text")), strict=True):
            known = held.get(key)
            if known is None:
                held[key] = [copies, text]
                size += len(text)
            elif known[1] == text:
                known[0] += copies
            else:
                raise ValueError("unequal texts under one digest")
        if size >= HELD_TEXT:
            yield made()
            held, size = {}, 0
    if held:
        yield made()


def long_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(text_id, key, copies, text), written: the different texts of ``length`` bytes or more. The id is made as they are written. Two texts
    of one SHA-256 stop the job."""
    source = docs.select(F.col("text").cast("string").alias("text")).filter(F.octet_length("text") >= length)
    rows = source.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), F.lit(1).cast("long").alias("copies"), F.col("text").cast("binary").alias("text"))
    kinds = "key binary, copies long, text binary"
    some = rows.mapInArrow(_partition_texts, kinds)
    texts = some.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_equal_texts, kinds)
    return materialize(texts.select(F.monotonically_increasing_id().alias("text_id"), F.substring("key", 1, 16).alias("key"), "copies", F.col("text").cast("string").alias("text")), "texts", compression="zstd")


def _settle(texts: DataFrame, segs: DataFrame, length: int) -> DataFrame:
    """``COMPARED`` rows of ``SEGMENTS`` rows with ``n`` (those with their digest) and ``kinds``, written."""
    n, group = partitions(texts.sparkSession), ["anchor", "digest", "share"]
    shares = F.ceil(F.col("n") / SHARE_ROWS).cast("int")
    share = F.pmod(F.xxhash64("text_id", "start"), shares).cast("int").alias("share")
    parts = segs.groupBy("text_id").agg(F.collect_list(F.struct("anchor", "digest", "n", "kinds", share, shares.alias("shares"), "text_id", "start", "shape")).alias("parts"))
    pieces = texts.select("text_id", "text").join(parts, "text_id").select("text", "parts").mapInArrow(_fetch(length, HELD), PIECES)
    # segments that a task settled come last in their group
    order = [*group, F.col("bytes").isNull(), "text_id", "start"]
    compared = materialize(pieces.repartition(n, *group).sortWithinPartitions(*order).mapInArrow(_compare, COMPARED), "compared", compression="zstd")
    first = compared.filter("shares > 1 AND bytes IS NOT NULL")
    alone = first.filter("NOT again").select("anchor", "digest").distinct()
    if alone.limit(1).count():
        # one of a digest that met no other in its share is compared with one of each other share
        others = first.join(alone, ["anchor", "digest"]).withColumn("share", F.lit(0)).select([f.split()[0] for f in PIECES.split(", ")])
        met = others.repartition(n, *group).sortWithinPartitions(*order).mapInArrow(_compare, COMPARED)
        compared = compared.unionByName(met.filter("again").withColumn("bytes", F.lit(None).cast("binary")))
    return compared


def _runs(compared: DataFrame) -> DataFrame:
    """(text_id, first, last): the starts of segments that repeat as a whole."""
    return compared.filter("again").select("text_id", F.col("start").alias("first"), (F.col("start") + F.floor(F.col("shape") / 1024) - 1).cast("long").alias("last"))


def repeated_runs(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(text_id, first, last): runs of starts of ``long_texts`` whose window starts elsewhere too."""
    n = partitions(texts.sparkSession)
    rows = materialize(texts.select("text_id", "text").mapInArrow(_segment_rows(length, gram), SEGMENTS), "segments", compression="zstd")
    # written, so that joins have a plain exchange on both sides and AQE can split a key of very many rows
    often = materialize(rows.groupBy("anchor").agg(F.count("*").alias("total")).filter("total > 1").select("anchor"), "anchors")
    shared = materialize(rows.join(often, "anchor"), "shared", compression="zstd")
    release(rows)
    counts = materialize(shared.groupBy("anchor", "digest").agg(F.count("*").alias("n")), "counts")
    kinds = materialize(counts.groupBy("anchor").agg(F.count("*").alias("kinds")), "kinds")
    counted = materialize(counts.join(kinds, "anchor"), "counted")
    compared = _settle(texts, shared.join(counted, ["anchor", "digest"]), length)
    release(shared)
    kept = compared.filter("bytes IS NOT NULL")
    sorted_runs = (
        kept.filter(F.col("kinds") <= GROUP_KINDS).select("anchor", "text_id", "start", "shape", "again", "bytes")
        .repartition(n, "anchor").sortWithinPartitions("anchor", "text_id", "start").mapInArrow(_sort(length), "text_id long, first long, last long")
    )
    found = _runs(compared).unionByName(sorted_runs)
    frequent = kept.filter(F.col("kinds") > GROUP_KINDS)
    if frequent.limit(1).count():
        windows = materialize(frequent.mapInArrow(_window_rows(length), SEGMENTS), "windows", compression="zstd")
        common = materialize(windows.groupBy("anchor", "digest").agg(F.count("*").alias("n")).filter("n > 1"), "common")
        listed = windows.join(common, ["anchor", "digest"]).withColumn("kinds", F.lit(1).cast("long"))
        found = found.unionByName(_runs(_settle(texts, listed, length)))
    return found


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` is what is left of the text, as bytes."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = long_texts(source, length)
    listed = repeated_runs(texts, length, gram).groupBy("text_id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    cut = texts.join(listed, "text_id", "left").select("key", "copies", "text", "runs").mapInArrow(_cut(length), "key binary, n_bytes long, n_removed long, n_spans long, kept binary")
    is_long = F.octet_length("text") >= length
    after = source.filter(is_long).select("doc_id", text_key(F.col("text")).alias("key")).join(cut, "key").drop("key")
    none = F.lit(0).cast("long")
    short = source.filter(~is_long).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return after.unionByName(short)
