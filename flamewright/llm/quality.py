"""Quality rules (operator 5): a threshold table compiled into one projection of Spark functions.

Every rule is a ratio of two measures with bounds; ``compile_rules`` turns the table into one boolean
column.  No user function runs, nothing is shuffled, each document is judged from its own whole text.

Defined cases: null or word-less text has all measures 0 and fails; ties at a bound pass; repeated rows
are judged alike; very long texts are judged whole (one text and its word arrays in memory) and no rule rejects them for their length; extra columns pass
through whatever their names, see ``judge``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import graph

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as by this are was or at from he an "
    "le la les de des du et un une que qui est en dans pour par sur au avec ne pas il elle "
    "der die das und von zu mit sich auf ist nicht als ein eine den im dem für es so wie "
    "el los las del y se no con su al lo como más pero sus"
).split()

#: measure / per, kept while low <= ratio <= high (None: unbounded).
RULES = (
    ("length", "n_words", None, 50, None),
    ("repeated_words", "n_repeat_words", "n_words", None, 0.5),
    ("mean_word", "word_chars", "n_words", 2.0, 12.0),
    ("symbols", "n_symbols", "n_words", None, 0.1),
    ("stop_words", "n_stop", "n_words", 0.05, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop")


def measures(docs: DataFrame) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop): a row of docs as a struct and its measures (long)."""
    t = F.col("t")
    out = docs.select(F.struct(*graph.columns(docs)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    out = out.withColumn("words", F.regexp_extract_all(t, F.lit(WORD), 0))
    out = out.withColumn("lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)))
    out = out.withColumn("n_words", F.size("words").cast("long"))
    # A window of three words is named by a 64-bit hash; the arrays live for one row.
    out = out.withColumn("windows", F.when(F.size("words") >= 3, F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2))), F.lit(1), F.size("words") - 2)))
    out = out.withColumn("again", F.size(F.array_distinct("windows")) < F.size("windows"))
    out = out.withColumn("ordered", F.when(F.col("again"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, k: F.get(F.col("ordered"), k - 1)["h"].eqNullSafe(x["h"]) | F.get(F.col("ordered"), k + 1)["h"].eqNullSafe(x["h"])
    out = out.withColumn("starts", F.filter("ordered", near))
    return out.select(
        "row",
        "n_words",
        F.length(F.regexp_replace(t, rf"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), F.size(F.array_distinct(F.flatten(F.transform("starts", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.regexp_count(t, F.lit(rf"(?<![^{SPACE}])(?iu:{'|'.join(STOP_WORDS)})(?![^{SPACE}.,;:!?])")).cast("long").alias("n_stop"),
    )


def compile_rules(rules=RULES) -> Column:
    """One boolean column: every rule of the table holds."""
    verdict = F.lit(True)
    for _, measure, per, low, high in rules:
        value = F.col(measure) if per is None else F.col(measure) / F.greatest(F.col(per), F.lit(1))
        if low is not None:
            verdict = verdict & (value >= low)
        if high is not None:
            verdict = verdict & (value <= high)
    return verdict


def _judged(docs: DataFrame, rules) -> DataFrame:
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # The last test is always true; being non-deterministic it keeps later filters from being pushed below the measures,
    # where each would work out every measure again.
    barrier = F.monotonically_increasing_id() >= 0
    return measures(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compile_rules(rules) & barrier)


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with their measures, base_failed and kept; columns of docs with one of these names give way, all others stay."""
    new = (*MEASURES, "base_failed", "kept")
    return _judged(docs, rules).select(*graph.fields(docs, *new), *new)


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    return _judged(docs, rules).where("kept").select(*graph.fields(docs))


def oracle(rules=RULES) -> str:
    """The same verdicts as DuckDB SQL over the documents view."""
    tests = []
    for _, measure, per, low, high in rules:
        value = measure if per is None else f"{measure} / greatest({per}, 1)"
        tests += [f"{value} >= {low}"] * (low is not None) + [f"{value} <= {high}"] * (high is not None)
    stops = "|".join(STOP_WORDS)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
    tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM tri) WHERE n > 1),
    cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS j FROM rep) GROUP BY r),
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: regexp_full_match(x, '(?i:{stops})([.,;:!?].*)?', 's')))::BIGINT AS n_stop
        FROM w LEFT JOIN cov USING (r)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept, n_lines, n_stop FROM b
    """
