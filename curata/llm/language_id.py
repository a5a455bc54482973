"""Language identification as multilingual mixture inference.

``fit`` learns, from labelled rows, how likely each language makes each character trigram
(hashed into ``BUCKETS`` cells, additively smoothed). Counting is a Spark aggregation; the
rows it counts are a sample of at most about ``SAMPLE_ROWS`` a language, chosen by a hash of
the text, and a model has ``languages x BUCKETS`` numbers, whatever the size of the corpus. The model is
what reaches the driver and is broadcast.

``predict`` reads every whole text. Expectation-maximisation estimates the share of each
language among a text's trigrams; the set of languages grows one at a time, as long as the
log-likelihood gains more than a penalty a language (half the logarithm of the number of
trigrams, as in BIC, times ``PENALTY``). Each estimation runs until no share changes by ``TOLERANCE``: the likelihood is
concave in the shares, so it gets there. The prediction is the language with the largest
share, and that share is its score.

Defined results: a text that is null or has no letter is ``und`` with score 0; rows with a
null label teach nothing; a text without a single known trigram gets the most likely language
under smoothing; with no labelled rows at all every prediction is ``und``. Repeated rows are
judged each by itself; ties between languages go to the first in code point order. A very long text is hashed ``SLICE``
characters at a time, with the same counts. Other columns pass through, whatever their names, but for those that are made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm.common import worker_state

BUCKETS = 1 << 15
#: Labelled rows a language that are counted, about; chosen by a hash of the text.
SAMPLE_ROWS = 4000
SMOOTHING = 0.5
PENALTY = 4.0
#: Estimation ends when no share changes by so much.
TOLERANCE = 1e-4
#: Characters that are hashed at once.
SLICE = 1 << 20

UNDETERMINED = "und"


def trigram_counts(text: str) -> np.ndarray:
    """How often each cell occurs among the character trigrams of a lower-cased text; a blank stands at both ends."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(text), SLICE):
        part = (" " if at == 0 else text[max(0, at - 2) : at]) + text[at : at + SLICE] + (" " if at + SLICE >= len(text) else "")
        code = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        if len(code) < 3:
            continue
        with np.errstate(over="ignore"):
            h = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)
            h *= np.uint64(0xD6E8FEB86659FD93)
        total += np.bincount((h >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    return total


def held_out(doc_id: Column) -> Column:
    """True for the fold that teaches nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each cell under each language) from (text, lang) rows."""
    known = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    # a share of each language's rows by hash of the text: the same rows whatever their order
    cuts = labelled.sparkSession.createDataFrame([(lang, min(1 << 20, -(-(sample_rows << 20) // sizes[lang]))) for lang in languages], "lang string, cut long")
    sample = known.join(F.broadcast(cuts), "lang").filter(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20)) < F.col("cut")).select("text", "lang")
    place = {lang: i for i, lang in enumerate(languages)}

    def count(frames):
        import pandas as pd

        worker_state("language")
        sums = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"], strict=True):
                counts = trigram_counts(text)
                sums[lang] = sums[lang] + counts if lang in sums else counts
        for lang, counts in sums.items():
            has = np.flatnonzero(counts)
            yield pd.DataFrame({"l": np.int32(place[lang]), "cell": has.astype(np.int32), "n": counts[has]})

    cells = sample.mapInPandas(count, "l int, cell int, n long").groupBy("l", "cell").agg(F.sum("n").alias("n"))
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    got = cells.toPandas()  # at most languages x BUCKETS rows
    np.add.at(table, (got["l"].to_numpy(), got["cell"].to_numpy()), got["n"].to_numpy())
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def estimate(shares: np.ndarray, p: np.ndarray, n: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Expectation-maximisation of the shares of languages, whose likelihoods of the cells are the rows of ``p``."""
    part = n / n.sum()
    while True:
        weighted = shares[:, None] * p
        new = (weighted / weighted.sum(axis=0)) @ part
        if np.abs(new - shares).max() < tolerance:
            return new
        shares = new


def mixture(counts: np.ndarray, log_p: np.ndarray, penalty: float = PENALTY, tolerance: float = TOLERANCE) -> np.ndarray:
    """Shares of the languages (rows of ``log_p``) in a text with these cell counts."""
    cells = np.flatnonzero(counts)
    n = counts[cells].astype(np.float64)
    logs = log_p[:, cells].astype(np.float64)
    # languages enter by how well they explain the text alone
    alone = logs @ n
    chosen = [int(np.argmax(alone))]
    best, shares = alone[chosen[0]], np.ones(1)
    p = np.exp(logs - logs.max(axis=0))
    base = float(n @ logs.max(axis=0))
    cost = penalty * 0.5 * np.log(max(2.0, n.sum()))
    rest = set(range(len(log_p))) - set(chosen)
    while rest:
        # the language that a small share would help most
        mixed = shares @ p[chosen]
        gain = {l: float(n @ np.log(0.9 * mixed + 0.1 * p[l])) for l in sorted(rest)}
        new = max(gain, key=gain.get)
        q = p[[*chosen, new]]
        w = estimate(np.append(shares * 0.9, 0.1), q, n, tolerance)
        value = base + float(n @ np.log(w @ q))
        if value - best <= cost:
            break
        best, shares = value, w
        chosen.append(new)
        rest.discard(new)
    out = np.zeros(len(log_p))
    out[chosen] = shares / shares.sum()
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``n_languages`` (those of the selected set)."""
    import re

    languages, log_p = model
    shared = docs.sparkSession.sparkContext.broadcast(log_p)  # languages x BUCKETS numbers
    base = docs.drop("lang_pred", "score", "n_languages")
    schema = T.StructType([*base.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_languages", T.IntegerType())])
    letter = re.compile(r"[^\W\d_]")

    def run(batches):
        import pyarrow as pa

        worker_state("language")
        for batch in batches:
            found, scores, sizes = [], [], []
            for t in batch.column(text):
                t = t.as_py()
                if not t or not languages or not (letter.search(t) and any(map(str.isalpha, t))):
                    found.append(UNDETERMINED)
                    scores.append(0.0)
                    sizes.append(0)
                    continue
                shares = mixture(trigram_counts(t), shared.value)
                top = int(np.argmax(shares))
                found.append(languages[top])
                scores.append(float(min(1.0, shares[top])))
                sizes.append(int((shares > 0).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32())], names=[*batch.schema.names, "lang_pred", "score", "n_languages"])

    return base.mapInArrow(run, schema)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learns from the rows of ``docs`` outside the held-out fold and predicts all of them."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))), sample_rows)
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
