"""Quality rules: a threshold table compiled into one Spark projection.

Every metric and every threshold is a built-in expression, so the whole operator is a
projection of the scan: no user function, no shuffle, one pass over whole texts.

Defined results: null, empty and blank texts have no words and fail the base rules;
repeated rows are judged each by itself; a value that ties with a threshold passes; very long texts are judged whole; other columns of
the input pass through, whatever their names, and one that has the name of a metric or verdict is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import WHITE, split_words

SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for on with as by at are was this it from be have "
    "le la les de des du et un une que est dans pour sur par avec qui au "
    "der die das und den von zu mit ein eine ist im auf für sich nicht dem "
    "el los las del y en por con para es se al lo como"
).split()

#: (rule, metric, comparison, threshold, words from which the rule holds): a document fails the
#: rule if the comparison is true. ``too_short`` and ``repeated_words`` are the base rules.
THRESHOLDS: tuple[tuple[str, str, str, float, int], ...] = (
    ("too_short", "n_words", "<", 50, 0),
    ("repeated_words", "n_repeat_words / n_words", ">", 0.5, 1),
    ("short_words", "word_chars / n_words", "<", 2, 1),
    ("long_words", "word_chars / n_words", ">", 15, 1),
    ("symbols", "n_symbols / n_words", ">", 0.1, 1),
    ("exclamations", "n_exclaim / n_words", ">", 0.5, 1),
    ("few_stop_words", "n_stop_words", "<", 2, 50),
    ("stop_word_ratio", "n_stop_words / n_words", "<", 0.06, 50),
    ("repeated_lines", "n_dup_lines / n_lines", ">", 0.5, 1),
    ("short_lines", "word_chars / n_lines", "<", 10, 50),
    ("bullet_lines", "n_bullet_lines / n_lines", ">", 0.9, 50),
    ("ellipsis_lines", "n_ellipsis_lines / n_lines", ">", 0.3, 50),
)
BASE_RULES = ("too_short", "repeated_words")
METRICS = ("n_words", "word_chars", "n_symbols", "n_exclaim", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words")
VERDICTS = ("failed_rules", "base_failed", "kept")

_WINDOW = "struct<a:string,b:string,c:string,i:int>"

#: Lines that begin with a bullet, and that end in an ellipsis.
BULLET = r"^[\x20\x09]*[-*\x{2022}\x{2023}\x{25AA}\x{25E6}\x{2013}]"
ELLIPSIS = r"(\.\.\.|\x{2026})[\x20\x09\r]*\z"


def compile_rule(metric: str, comparison: str, threshold: float, least_words: int) -> Column:
    """A rule of the table as a boolean column; ratios are compared by multiplication, so nothing divides by zero."""
    over, _, under = metric.partition(" / ")
    value = F.col(over) * 100
    bound = F.lit(round(threshold * 100)) * (F.col(under) if under else F.lit(1))
    fails = value < bound if comparison == "<" else value > bound
    return fails & (F.col("n_words") >= least_words)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``METRICS``."""
    base = docs.drop(*METRICS)
    # the input's columns travel in a struct, where no name can clash
    df = base.select(F.struct(*[base[c] for c in base.columns]).alias("row"), F.coalesce(base[text].cast("string"), F.lit("")).alias("whole"))
    count_of = lambda chars: F.length("whole") - F.length(F.translate("whole", chars, ""))
    df = df.withColumn("w", split_words(F.col("whole")))
    df = df.withColumn("l", F.filter(F.split("whole", "\n", -1), lambda line: F.length(F.translate(line, WHITE, "")) > 0))
    # each 3-word window with its place; sorting brings equal windows together. Structs of the words sort faster here
    # than their hashes, which a lambda has to make (4.5 and 6.2 s a core for 25 MB)
    df = df.withColumn("s", F.expr("CASE WHEN size(w) >= 3 THEN sort_array(slice(arrays_zip(w, slice(w, 2, size(w)), slice(w, 3, size(w)), sequence(0, size(w) - 1)), 1, size(w) - 2)) END").cast(f"array<{_WINDOW}>"))
    df = df.withColumn("z", F.expr("arrays_zip(s, slice(s, 2, size(s)))").cast(f"array<struct<x:{_WINDOW},y:{_WINDOW}>>"))
    df = df.withColumn("z", F.expr("filter(z, z -> z.x.a = z.y.a AND z.x.b = z.y.b AND z.x.c = z.y.c)"))
    df = df.withColumn("i", F.expr("sort_array(array_distinct(concat(transform(z, z -> z.x.i), transform(z, z -> z.y.i))))"))
    # a repeated window covers its three words; windows that overlap share words
    df = df.withColumn("g", F.expr("arrays_zip(i, slice(i, 2, greatest(size(i), 0)))").cast("array<struct<at:int,next:int>>"))
    measured = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.translate("whole", WHITE, "")),
        "n_symbols": count_of(SYMBOLS),
        "n_exclaim": count_of("!"),
        "n_stop_words": F.size(F.filter("w", lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_lines": F.size("l"),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_bullet_lines": F.size(F.filter("l", lambda line: line.rlike(BULLET))),
        "n_ellipsis_lines": F.when(F.contains("whole", F.lit("...")) | F.contains("whole", F.lit("\u2026")), F.size(F.filter("l", lambda line: line.rlike(ELLIPSIS)))).otherwise(F.lit(0)),
        "n_repeat_words": F.coalesce(F.expr("aggregate(g, 0, (n, g) -> n + least(3, coalesce(g.next - g.at, 3)))"), F.lit(0)),
    }
    return df.select("row.*", *[v.cast("long").alias(k) for k, v in measured.items()])


def apply_rules(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS, base=BASE_RULES) -> DataFrame:
    """``docs`` with the metrics, ``failed_rules`` (array of rule names), ``base_failed`` and ``kept``."""
    df = measure(docs.drop(*VERDICTS), text)
    failed = {name: compile_rule(*rule) for name, *rule in thresholds}
    names = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in failed.items()]), lambda x: x.isNotNull())
    df = df.withColumn("failed_rules", names)
    return df.withColumns({"base_failed": F.arrays_overlap("failed_rules", F.array(*map(F.lit, base))), "kept": F.size("failed_rules") == 0})


def oracle_sql() -> str:
    """DuckDB SQL for ``op10_quality_rules``."""
    ws = r"[\x20\x09-\x0D]+"
    word = r"[^\x20\x09-\x0D]+"
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    rules = []
    for name, metric, comparison, threshold, least in THRESHOLDS:
        over, _, under = metric.partition(" / ")
        rules.append(f"({over} * 100 {comparison} {round(threshold * 100)} * {under or 1} AND n_words >= {least})")
    base = " OR ".join(r for r, t in zip(rules, THRESHOLDS, strict=True) if t[0] in BASE_RULES)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{word}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{ws}', '', 'g') <> '') AS l,
         row_number() OVER () AS r
  FROM documents),
win AS (
  SELECT r, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS j FROM rep) GROUP BY r),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{ws}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaim,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(l, lambda x: regexp_matches(x, '{BULLET}'))) AS BIGINT) AS n_bullet_lines,
         CAST(len(list_filter(l, lambda x: regexp_matches(x, '{ELLIPSIS}'))) AS BIGINT) AS n_ellipsis_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({base}) AS base_failed,
       NOT ({" OR ".join(rules)}) AS kept
FROM m"""
