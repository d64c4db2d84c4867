"""Secret scans (operator 9): base patterns plus a randomness test battery, SQL functions only.

A candidate is any maximal run of at least MIN_LENGTH characters of [A-Za-z0-9+/_=-].  Its encoding is
inferred (decimal, hex, lower, upper, letters, base32, base36, base62, base64), its characters become numbers in that alphabet, and three tests ask whether they
look drawn at random: chi-squared uniformity over the alphabet, runs above and below the middle, lag-one serial
correlation.  Their least p-value, corrected for being the least of three, is the string's p-value for "random": even between 0 and 1 for random strings,
near 0 for others (less so for short ones, whose tests are weak).

What is reported are strings that look random, so the false discoveries to control are ordinary strings among them.  For each class
(length, and whether digits occur: words run together hold none) a histogram over the whole corpus gives their number: above p = TOP nearly only random
strings are left, which tells how many random strings there are and how many of them lie above any bound; what else lies above it is false.  The bound is
the least one, Q at least, above which the false ones are at most a share Q (an excess within half a standard error of chance does not count).  Ordinary strings
that all three tests take for random are not seen by this estimate; tests measure what is left.  The p-values are only ever summed in a fixed histogram of class and p bin.

Defined cases: null text is empty; equal strings get equal verdicts; repeated rows get equal results and count each; ties at the bound are reported;
very long texts and runs are read whole, in linear time; extra columns pass through whatever their names, save that columns
named secrets or secret_spans are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from . import graph, spans

KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH, Q, BINS, TOP = 20, 0.01, 400, 0.3
#: Upper lengths of the classes.
CLASSES = (24, 32, 40, 64, 128, 512, 2**31)

# The alphabets in the order of their digit values.
ALPHABETS = {
    "decimal": "0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[a-z0-9+/_.=-]+"""
VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}+"


def base_spans(text: Column) -> dict[str, Column]:
    long = lambda hit: F.length(F.regexp_extract(hit, VALUE, 1)) >= 6
    return {
        "assign": spans.find(text, ASSIGN, "assign", long),
        "access": spans.find(text, ACCESS, "access", needs="AKIA"),
        "hex": spans.find(text, HEX, "hex"),
    }


def in_order(every: Column) -> Column:
    """Spans by start, then kind as listed."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("b"), s.alias("s"))))
    return F.transform(keyed, lambda x: x["s"])


def _tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (a rational approximation of erfc, good to 1e-7 relative to 1)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = F.lit(c) + t * poly
    erfc = t * F.exp(-x * x - 1.26551223 + t * poly)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def encoding(s: Column) -> Column:
    """Name of the smallest alphabet that holds s, padding aside."""
    return (
        F.when(s.rlike("^[0-9]+$"), "decimal")
        .when(s.rlike("^[0-9a-f]+$") | s.rlike("^[0-9A-F]+$"), "hex")
        .when(s.rlike("^[a-z]+$"), "lower")
        .when(s.rlike("^[A-Z]+$"), "upper")
        .when(s.rlike("^[A-Za-z]+$"), "letters")
        .when(s.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(s.rlike("^[0-9a-z]+$"), "base36")
        .when(s.rlike("^[0-9A-Za-z]+$"), "base62")
        .otherwise("base64")
    )


def randomness(s: Column) -> Column:
    """p-value of "s is random in its encoding": chance that the least of three p-values is as small as here."""
    name = encoding(s)
    body = F.regexp_replace(F.when(name == "hex", F.lower(s)).otherwise(F.translate(s, "-_", "+/")), "=+", "")
    alphabet = F.element_at(F.create_map(*[x for k, v in ALPHABETS.items() for x in (F.lit(k), F.lit(v))]), name)
    size = F.length(alphabet).cast("double")
    digits = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)
    stats = lambda v: _battery(v, alphabet, body, size)
    return F.get(F.transform(F.array(digits), stats), 0)


def _battery(v: Column, alphabet: Column, body: Column, size: Column) -> Column:
    n = F.size(v).cast("double")
    count = lambda c: (F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double")
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(count(c) * count(c)))
    chi, df = squares * size / n - n, size - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    sums = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))
    high = sums(lambda x: F.when(x >= size / 2, 1.0).otherwise(0.0))
    low = n - high
    steps = lambda f: F.aggregate(F.sequence(F.lit(0), F.size(v) - 2), F.lit(0.0), lambda a, i: a + f(F.get(v, i), F.get(v, i + 1)))
    runs = 1 + steps(lambda x, y: F.when((x >= size / 2) != (y >= size / 2), 1.0).otherwise(0.0))
    expected = 1 + 2 * high * low / n
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    mean = (size - 1) / 2
    around = sums(lambda x: (x - mean) * (x - mean))
    serial = steps(lambda x, y: (x - mean) * (y - mean)) / F.greatest(around, F.lit(1e-9)) * F.sqrt(n)
    least = F.least(_tail(z_chi), 2 * _tail(F.abs((runs - expected) / spread)), 2 * _tail(F.abs(serial)))
    return 1 - F.pow(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), least)), 3)


def class_of(hit: Column) -> Column:
    """Number of the class by length and by whether digits occur."""
    out = F.lit(len(CLASSES) - 1)
    for k in reversed(range(len(CLASSES) - 1)):
        out = F.when(F.length(hit) <= CLASSES[k], k).otherwise(out)
    return 2 * out + F.when(hit.rlike("[0-9]"), 1).otherwise(0)


def _bin(p: Column) -> Column:
    """Bins even in log p, so that small p-values are told apart; bin 0 holds the smallest."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(BINS + 20 * F.log10(F.greatest(p, F.lit(1e-300)))))).cast("int")


def candidates(text: Column) -> Column:
    """Spans of kind random before any test; only runs with fewer than two characters besides padding, which hold nothing to test, are left out."""
    return spans.find(text, CANDIDATE, "random", lambda x: F.length(F.replace(x, F.lit("="), F.lit(""))) >= 2)


def random_bins(found: DataFrame, q: float = Q) -> dict[int, int]:
    """For each class the least bin whose strings are reported; found has hit and p."""
    table = found.groupBy(class_of(F.col("hit")).alias("c"), _bin(F.col("p")).alias("b")).agg(F.count("*").alias("n"))
    rows = table.collect()  # at most classes x BINS rows
    edge = lambda b: 10 ** ((b - BINS) / 20)
    least, top = (math.ceil(BINS + 20 * math.log10(x) - 1e-9) for x in (q, TOP))
    out = {}
    for c in range(2 * len(CLASSES)):
        hist = {r.b: r.n for r in rows if r.c == c}
        above = lambda b: sum(n for k, n in hist.items() if k >= b)  # noqa: B023, E731
        random = above(top) / (1 - edge(top))
        false = lambda b: above(b) - random * (1 - edge(b)) - 0.5 * math.sqrt(above(b))  # noqa: B023, E731
        out[c] = next((b for b in range(least, top) if false(b) <= q * above(b)), top)
    return out


def find_secrets(docs: DataFrame, q: float = Q) -> DataFrame:
    """docs with ``secrets`` (struct of the base kinds' spans) and ``secret_spans`` (all spans in order)."""
    held = docs.select(F.struct(*graph.columns(docs)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hits = held.select(F.explode(F.transform(candidates(F.col("text")), lambda s: s["hit"])).alias("hit"))
    low = random_bins(hits.withColumn("p", randomness(F.col("hit"))), q)
    bound = lambda hit: F.get(F.array(*[F.lit(low[k]) for k in sorted(low)]), class_of(hit))
    random = F.filter(candidates(F.col("text")), lambda s: _bin(randomness(s["hit"])) >= bound(s["hit"]))
    base = held.select("row", F.struct(*[c.alias(k) for k, c in base_spans(F.col("text")).items()]).alias("secrets"), random.alias("random"))
    every = F.concat(*[F.col(f"secrets.{k}") for k in KINDS[:3]], F.col("random"))
    return base.select(*graph.fields(docs, "secrets", "secret_spans"), "secrets", in_order(every).alias("secret_spans"))
