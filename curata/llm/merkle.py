"""Merkle manifest of a dataset: a tree of SHA-256 digests a source, a tree of the sources' roots above, a proof a row.

Nodes are events. A task puts each digest that it meets, in any order, into its partial parent; a parent
whose children, as many as its place and the size of its tree ask for, are all there is resolved at once, becomes a digest itself and goes on to its
own parent. Leaves lie in order of source and id, so a task resolves all but the parents at its edges. Those
partial parents send their children on: the frontier, a few rows a level and task, is dealt again by wider and wider
stretches of leaves until each tree is one root. Leaves themselves aren't shuffled for it.

Each resolved parent leaves a reverse link, its children's digests. Proofs are made from the top down, ``STEP``
levels at a time: the links of ``3 ** STEP`` neighbouring nodes and the path above them meet in one task, which gives each node its
path. Neither a source nor a tree is ever in one task, whatever its share of the rows.

``build`` returns leaves with their paths; ``fold`` recomputes a root from a leaf and a path, and ``siblings`` lists a path's digests.

Defined results: a null field is ``-`` and an empty one ``0:``. A null source is a source, before all others; a null id precedes the
others of its source; rows of one id are ordered by their leaf, and equal rows have equal leaves and places side
by side. Very long texts are hashed whole in one pass. Other columns are not read. An empty table has no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import only
from curata.operators.ranks import numbered
from curata.session import materialize

ARITY = 3
#: Levels of a tree that a task walks down while it makes proofs.
STEP = 6
#: Levels that a round of the frontier resolves above those of the last.
ROUND = 6

#: Up to so many sources are broadcast to the rows; more are joined by a shuffle. Both give the same rows.
BROADCAST_SOURCES = 100_000

NODES, LINKS = 0, 1
GROWN = "tree long, size long, kind int, level int, at long, digest binary, children array<binary>"
PATHS = "tree long, size long, level int, at long, path binary"


def join_digests(digests: list[bytes]) -> bytes:
    """The digest of digests, taken as hex text one after the other."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def width(size: int, level: int) -> int:
    """Nodes on a level of a tree of so many leaves."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


def _grow(batches):
    """For mapInArrow over (tree, size, level, at, digest): links of resolved parents, and the nodes left over."""
    import pyarrow as pa

    schema = pa.schema([("tree", pa.int64()), ("size", pa.int64()), ("kind", pa.int32()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.binary()), ("children", pa.list_(pa.binary()))])
    partial: dict[tuple, dict[int, bytes]] = {}
    out: list[tuple] = []

    def event(tree, size, level, at, digest):
        while True:
            nodes = width(size, level)
            if nodes == 1:
                out.append((tree, size, NODES, level, at, digest, None))  # a root
                return
            parent = at // ARITY
            key = (tree, size, level + 1, parent)
            held = partial.setdefault(key, {})
            held[at] = digest
            if len(held) < min(ARITY, nodes - parent * ARITY):
                return
            children = [partial[key][i] for i in sorted(held)]
            del partial[key]
            digest, level, at = join_digests(children), level + 1, parent
            out.append((tree, size, LINKS, level, at, digest, children))

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "size", "level", "at", "digest")), strict=True):
            event(*row)
        if out:
            yield made(out)
            out.clear()
    for (tree, size, level, _), held in partial.items():
        out.extend((tree, size, NODES, level - 1, at, digest, None) for at, digest in held.items())
    if out:
        yield made(out)


def grow(leaves: DataFrame, spread: int) -> tuple[DataFrame, DataFrame]:
    """(links, roots) of trees whose leaves are (tree, size, level 0, at, digest); ``spread`` leaves or so lie in a task.

    Each round deals the frontier by stretches of leaves that are ``3 ** ROUND`` times as long as those of the last,
    so that the rounds are the logarithm of the number of tasks to that base."""
    grown = materialize(leaves.mapInArrow(_grow, GROWN), "grown")
    links, roots = [grown.filter(F.col("kind") == LINKS)], []
    reach = 0
    while ARITY**reach < spread:
        reach += 1
    whole = (F.col("kind") == NODES) & (F.col("level") == _height(F.col("size")))
    while True:
        roots.append(grown.filter(whole))
        frontier = grown.filter((F.col("kind") == NODES) & (F.col("level") < _height(F.col("size"))))
        if not frontier.limit(1).count():
            break
        reach += ROUND
        # the stretch of leaves, so many levels up, in which a node lies
        stretch = F.floor(F.col("at") / F.pow(F.lit(float(ARITY)), F.greatest(F.lit(reach) - F.col("level"), F.lit(0)).cast("double")))
        dealt = frontier.repartition("tree", F.greatest(F.col("level") - reach, F.lit(0)), stretch)
        grown = materialize(dealt.select("tree", "size", "level", "at", "digest").mapInArrow(_grow, GROWN), "grown")
        links.append(grown.filter(F.col("kind") == LINKS))
    all_links, all_roots = links[0], roots[0]
    for more in links[1:]:
        all_links = all_links.unionByName(more)
    for more in roots[1:]:
        all_roots = all_roots.unionByName(more)
    return all_links, all_roots.select("tree", "size", "digest")


def _height(size: Column) -> Column:
    """The level of a tree's root."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(33)), lambda k: F.pow(F.lit(float(ARITY)), k.cast("double")) < size.cast("double")))


def step(position: int, others: list[bytes]) -> bytes:
    """One level of a path: the node's position in its run, and its siblings."""
    return bytes((position, len(others))) + b"".join(others)


def levels(path: bytes):
    """(position, siblings) of each level of a path."""
    at = 0
    while at < len(path):
        position, n = path[at], path[at + 1]
        at += 2
        yield position, [path[at + 32 * i : at + 32 * (i + 1)] for i in range(n)]
        at += 32 * n


def siblings(path: bytes) -> list[bytes]:
    return [d for _, others in levels(path) for d in others]


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and a path make."""
    for position, others in levels(path):
        leaf = join_digests([*others[:position], leaf, *others[position:]])
    return leaf


def _descend(bottom: int):
    """For mapInArrow over links and paths of one block after the other (a block's path first, then links from the top): the paths of
    the nodes ``bottom``, or of a tree's leaves if that is 0."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("path", pa.binary())])
        block, paths = None, {}
        for batch in batches:
            rows = []
            for tree, size, number, level, at, path, children in zip(*(batch.column(c).to_pylist() for c in ("tree", "size", "block", "level", "at", "path", "children")), strict=True):
                if (tree, number) != block:
                    block, paths = (tree, number), {}
                if children is None:
                    paths[level, at] = path
                    if level == bottom:
                        rows.append((tree, size, level, at, path))
                    continue
                above = paths.pop((level, at))
                for i, _ in enumerate(children):
                    own = step(i, children[:i] + children[i + 1 :]) + above
                    if level - 1 == bottom:
                        rows.append((tree, size, bottom, at * ARITY + i, own))
                    else:
                        paths[level - 1, at * ARITY + i] = own
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def paths(links: DataFrame, tops: DataFrame) -> DataFrame:
    """(tree, size, at, path) of every leaf; ``tops`` has (tree, size, path) of every tree's root.

    A round takes the nodes of one level, a multiple of ``STEP``, and walks down to the next such level in blocks of one node of the upper level."""
    found = tops.select("tree", "size", _height(F.col("size")).alias("level"), F.lit(0).cast("long").alias("at"), "path")
    highest = found.agg(F.max("level")).first()[0] or 0
    bottom = -(-highest // STEP) * STEP
    found = materialize(found, "paths")
    while bottom > 0:
        bottom -= STEP
        # trees that end at or below this level wait for a later round
        waiting = found.filter(F.col("level") <= bottom)
        now = found.filter(F.col("level") > bottom)
        block = F.floor(F.col("at") / F.pow(F.lit(float(ARITY)), (F.lit(bottom + STEP) - F.col("level")).cast("double"))).cast("long")
        none = F.lit(None)
        rows = now.select("tree", "size", "level", "at", "path", none.cast("array<binary>").alias("children"))
        rows = rows.unionByName(links.filter((F.col("level") > bottom) & (F.col("level") <= bottom + STEP)).select("tree", "size", "level", "at", none.cast("binary").alias("path"), "children"))
        dealt = rows.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("level").desc(), F.col("children").isNotNull())
        found = materialize(dealt.mapInArrow(_descend(bottom), PATHS).unionByName(waiting), "paths")
    return found.select("tree", "size", "at", "path")


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def build(leaves: DataFrame) -> DataFrame:
    """``leaves``, rows of (source, doc_id, leaf, ...), with their ``subroot``, ``root`` and ``path`` to it."""
    spark = leaves.sparkSession
    placed = numbered(materialize(leaves, "leaves"), ["source", "doc_id", "leaf"], "place")
    placed = materialize(placed, "placed")  # still in order
    sources = placed.groupBy("source").agg(F.count("*").alias("size"), F.min("place").alias("first"))
    sources = materialize(numbered(sources, ["source"], "tree"), "sources")
    known = sources.select(F.col("source").alias("_source"), "size", "first", "tree")
    few = sources.count() <= BROADCAST_SOURCES
    own = placed.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("at", F.col("place") - F.col("first")).drop("_source", "first", "place")
    # a join by shuffle mixes the leaves, so that they are put in order again
    own = materialize(own if few else own.repartitionByRange("tree", "at").sortWithinPartitions("tree", "at"), "leaves-at")
    n, tasks = own.count(), max(1, own.rdd.getNumPartitions())
    if not n:
        return own.select(*leaves.columns, *(F.lit(None).cast("binary").alias(c) for c in ("subroot", "root", "path")))
    links, subroots = grow(own.select("tree", "size", F.lit(0).alias("level"), "at", F.col("leaf").alias("digest")), -(-n // tasks))
    subroots = materialize(subroots, "subroots")
    n_sources = subroots.count()
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_sources).cast("long").alias("size"), F.lit(0).alias("level"), F.col("tree").alias("at"), "digest")
    top_links, top = grow(tops, -(-n_sources // max(1, subroots.rdd.getNumPartitions())))
    root = top.first().digest
    whole = spark.createDataFrame([(0, n_sources, b"")], "tree long, size long, path binary")
    above = paths(top_links, whole).select(F.col("at").alias("tree"), "path")
    above = above.join(subroots, "tree").select("tree", "size", "path", "digest")
    below = paths(links, above.select("tree", "size", "path"))
    named = subroots.select("tree", F.col("digest").alias("subroot"))
    met = own.join(below.select("tree", "at", "path"), ["tree", "at"]).join(F.broadcast(named) if few else named, "tree")
    return met.select(*leaves.columns, "subroot", F.lit(bytearray(root)).alias("root"), "path")


def _folded(batches):
    """For mapInArrow over (doc_id, leaf, altered, subroot, root, path): the contract's columns."""
    import pyarrow as pa

    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in ("leaf", "altered", "subroot", "root", "path")}
        proofs = [join_digests(siblings(p)).hex() for p in columns["path"]]
        folded = [fold(x, p) for x, p in zip(columns["altered"], columns["path"], strict=True)]
        made = [batch.column("doc_id"), *(pa.array([d.hex() for d in columns[c]]) for c in ("leaf", "subroot", "root")), pa.array(proofs), pa.array([d.hex() for d in folded]), pa.array([a == b for a, b in zip(folded, columns["root"], strict=True)])]
        yield pa.RecordBatch.from_arrays(made, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def tampered(text: Column, doc_id: Column) -> Column:
    """The text without its line feeds where 2 divides the CRC-32 of the decimal id; a row without an id keeps its text."""
    cut = F.replace(text, F.lit("\n"), F.lit(""))
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, cut).otherwise(text)


def manifest(docs: DataFrame) -> DataFrame:
    own = only(docs, "doc_id", "text", "lang", "source", "n_chars")
    d, s, la, n, t = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    leaves = own.select("source", d.cast("long").alias("doc_id"), leaf_digest(d, s, la, n, t).alias("leaf"), leaf_digest(d, s, la, n, tampered(t, d)).alias("altered"))
    return build(leaves).mapInArrow(_folded, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


ORACLE_SQL = """
WITH RECURSIVE
fields AS (SELECT doc_id, source, text,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents),
leaves AS (SELECT doc_id, source,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' WHEN crc & 1 = 1 THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') ELSE strlen(text) || ':' || text END) AS altered
  FROM fields),
own AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS size,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (SELECT tree, 0 AS level, pos, size AS n, leaf AS digest FROM own
  UNION ALL SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n),
subroots AS MATERIALIZED (SELECT tree, level AS height, digest FROM nodes WHERE n = 1),
upper AS (SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 3, n),
every AS MATERIALIZED (SELECT tree, level, pos, digest FROM nodes WHERE n > 1 UNION ALL SELECT -1, level, pos, digest FROM upper WHERE n > 1),
beside AS MATERIALIZED (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 GROUP BY a.tree, a.level, a.pos),
walk AS (SELECT o.doc_id, o.tree, o.pos AS leaf_at, o.tree AS own_tree, 0 AS level, o.pos, '' AS proof, o.altered AS folded FROM own o
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf_at, CASE WHEN b.tree IS NULL THEN -1 ELSE w.own_tree END, CASE WHEN b.tree IS NULL THEN 0 ELSE w.level + 1 END, CASE WHEN b.tree IS NULL THEN w.tree ELSE w.pos // 3 END,
    CASE WHEN b.tree IS NULL THEN w.proof ELSE w.proof || b.l || b.r END, CASE WHEN b.tree IS NULL THEN w.folded ELSE sha256(b.l || w.folded || b.r) END
  FROM walk w LEFT JOIN beside b ON b.tree = w.own_tree AND b.level = w.level AND b.pos = w.pos WHERE b.tree IS NOT NULL OR w.own_tree >= 0),
ends AS (SELECT tree, leaf_at, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM walk WHERE own_tree = -1 GROUP BY tree, leaf_at)
SELECT o.doc_id, o.leaf, s.digest AS subroot, (SELECT digest FROM upper WHERE n = 1) AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
  e.folded = (SELECT digest FROM upper WHERE n = 1) AS verified
FROM own o JOIN subroots s ON o.tree = s.tree JOIN ends e ON e.tree = o.tree AND e.leaf_at = o.pos
"""
