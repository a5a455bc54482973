"""Corpus pipeline: language ID, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``. So a stage's own
intermediate tables are of no use once the next stage begins, and are deleted then.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import language_id, line_dedup, mixing, ngram_join, packing
from curata.llm.tokens import text_batches, vocabulary
from curata.session import materialize, named_folders, release_folders

#: A document whose leading language has a smaller share of it is rejected.
LEAST_SHARE = 0.4

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Intermediate tables of the stage before.
_LEFT: list[str] = []


def _stage(function):
    """Deletes the tables of the stage before, unless ``docs`` is still made from them, and notes this one's."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {f"{r}/" for r in docs.inputFiles()} if _LEFT else set()
        if not any(x.partition(":")[2].lstrip("/").startswith(folder.partition(":")[2].lstrip("/") + "/") for x in read for folder in _LEFT):
            release_folders(spark, _LEFT)
            _LEFT.clear()
        before = len(named_folders())
        made = function(spark, docs, sf_dir)
        _LEFT.extend(named_folders()[before:])
        return made

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a leading language, go; a null ``lang`` is filled in."""
    found = language_id.identify(docs)
    kept = found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut but for their first occurrence; documents of which nothing is left go."""
    cut = line_dedup.deduplicate_runs(docs.select(COLUMNS))
    left = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) > 0
    changed = F.col("n_removed_lines") > 0
    return cut.filter(left | ~changed).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the smallest id (any id before none), whatever other texts
    share its id; so does every row without words."""
    return ngram_join.keep_one(docs.select(COLUMNS))


def _cut_words(batches):
    """For mapInArrow over documents with ``parts``: the text of the words that the mix takes. Parts of the text that
    follow each other keep the white space between them."""
    import re

    import pyarrow as pa

    word = re.compile(r"[^\x20\x09-\x0D]+")
    for batch, texts in text_batches(batches):
        out = []
        for text, size, parts in zip(texts, batch.column("size").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            text = text.decode()
            runs: list[list[int]] = []
            for p in sorted((p["first_word"], p["first_word"] + p["n_words"]) for p in parts):
                if runs and runs[-1][1] == p[0]:
                    runs[-1][1] = p[1]
                else:
                    runs.append(list(p))
            if runs != [[0, size]]:
                spans = [m.span() for m in word.finditer(text)]
                text = "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)
            out.append(text)
        kept = [pa.array(out, pa.string()) if name == "text" else pa.array(map(len, out), pa.int64()) if name == "n_chars" else batch.column(name) for name in COLUMNS]
        yield pa.RecordBatch.from_arrays(kept, names=COLUMNS)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each round of the mix in which a row of ``docs`` is used, with the words that the round takes of it."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    # a key for each row, made once: rows may share an id, or an id and a text
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "rows", compression="zstd")
    _, _, taken = mixing.mix(own, row="row")
    parts = taken.groupBy("row", "epoch", "size").agg(F.collect_list(F.struct("first_word", "n_words")).alias("parts"))
    return own.join(parts, "row").select(*COLUMNS, "size", "parts").mapInArrow(_cut_words, "doc_id long, text string, lang string, source string, n_chars long")


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's rows as pieces of sequences of at most 2048 tokens."""
    return packing.pack_digest(docs, vocabulary())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Mixing draws pseudorandom numbers and packing counts a vocabulary's ids: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
