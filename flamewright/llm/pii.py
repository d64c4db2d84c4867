"""Personal data (operator 2): pattern spans plus information-theoretic sanitisation, SQL functions only.

Base spans (email, ip, card, phone) are the protected entities.  Corpus co-occurrence then estimates what other
terms give away: for entity v and term t within CONTEXT words of a mention,
PMI(v;t) = log(P(t|v) / P(t)), with P(t|v) over v's distinct contexts and P(t) over all documents, and
IC(v) = -log P(v).  A term whose PMI reaches ALPHA of IC for some entity discloses it and is masked wherever it stands.  Every
entity is examined, also one with a single context; every word of two characters or more outside the base spans is a term, with
digits or without.  Equal contexts count once.

Defined cases: null text is empty; no spans give an empty string; repeated rows get equal results and count as documents each; ties:
a term at the threshold is masked, of terms that fit at one place the longest is; very long texts are read whole (one text in memory); nulls in
other columns and extra columns pass through whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import graph, spans

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT, ALPHA = 8, 0.8
#: Stands for a base span among the words of a text (a private-use character, taken out of the text itself).
MARK = "\ue000"
#: Rows of a table of words or keys (under 100 bytes each) that may be broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000

_E, _D = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# Possessive forms of the base expressions; a match starts where a run starts or where the last match ended.
EMAIL = rf"(?:\G|(?<!{_E})){_E}++@{_D}++(?:\.{_D}++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_SPACE, _EDGE = r"\x20\x09-\x0D", r""".,;:!?()\[\]{}"'<>|"""


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))
    value = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, value(i)).otherwise(F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + part(i))
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


def _octets(x: Column) -> Column:
    trimmed = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(trimmed, lambda p: F.when(F.length(p) > 3, False).otherwise(p.cast("int") <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """The four base kinds, each as an array of spans."""
    return {
        "email": spans.find(text, EMAIL, "email", needs="@"),
        "ip": spans.find(text, IP, "ip", _octets),
        "card": spans.find(text, CARD, "card", _luhn),
        "phone": spans.find(text, PHONE, "phone", lambda x: F.length(_digits(x)).between(9, 15), needs="+"),
    }


def _small(df: DataFrame) -> tuple[DataFrame, bool]:
    """df cut from its lineage, hinted for broadcast only when its counted rows are within BROADCAST_ROWS."""
    df = graph.cut(df)
    n = df.count()
    return (F.broadcast(df) if n <= BROADCAST_ROWS else df), n > 0


def _words(text: Column) -> Column:
    """Words without punctuation at their edges."""
    return F.regexp_extract_all(text, F.lit(rf"[^{_SPACE}{_EDGE}](?:[^{_SPACE}]*[^{_SPACE}{_EDGE}])?"), F.lit(0))


def _cut(text: Column, base: Column) -> Column:
    """Words of text outside the base spans, and MARK in place of each run of overlapping spans."""
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, " ")).otherwise(text)
    return _words(spans.mask(clean, base, lambda kind, hit: F.lit(f" {MARK} ")))


def _plain(text: Column, base: Column) -> Column:
    return F.filter(_cut(text, base), lambda w: w != MARK)


def _entity(kind: Column, hit: Column) -> Column:
    return F.concat_ws(":", kind, F.lower(hit))


def _marked(base: Column) -> Column:
    """(entity, index of its mark) of each span; a span that starts inside another has that one's mark."""
    order = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("stop"), _entity(s["kind"], s["hit"]).alias("entity"))))
    kind = "array<struct<entity:string,mark:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("mark"), F.array().cast(kind).alias("out"))

    def step(a, s):
        fresh = s["start"] >= a["at"]
        mark = F.when(fresh, a["mark"] + 1).otherwise(a["mark"])
        return F.struct(F.when(fresh, -s["stop"]).otherwise(a["at"]).alias("at"), mark.alias("mark"), F.concat(a["out"], F.array(F.struct(s["entity"].alias("entity"), mark.alias("mark"))).cast(kind)).alias("out"))

    return F.aggregate(order, zero, step, lambda a: a["out"])


def contexts_of(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(entity, terms, context) for each distinct context of an entity; docs has text and _base."""
    personal = docs.where(F.size("_base") > 0).withColumn("_cut", _cut(F.col("text"), F.col("_base")))
    personal = personal.select(F.explode(_marked(F.col("_base"))).alias("s"), F.filter("_cut", lambda w: w != MARK).alias("plain"), F.filter(F.transform("_cut", lambda w, i: F.when(w == MARK, i)), lambda i: i.isNotNull()).alias("at"))
    # Plain words ahead of mark k: its place among all words less the k marks before it.
    ahead = F.get(F.col("at"), F.col("s.mark")) - F.col("s.mark")
    before = F.slice("plain", F.greatest(ahead - context, F.lit(0)) + 1, F.least(ahead, F.lit(context)))
    words = F.array_distinct(F.concat(before, F.slice("plain", ahead + 1, F.lit(context))))
    found = personal.select(F.col("s.entity").alias("entity"), F.filter(words, lambda w: F.length(w) > 1).alias("terms"))
    return found.withColumn("context", F.xxhash64("terms")).dropDuplicates(["entity", "context"])


def disclosing_terms(docs: DataFrame, alpha: float = ALPHA, context: int = CONTEXT) -> DataFrame:
    """(term, entity, pmi, ic) of every term that exceeds the disclosure threshold; docs has text and _base."""
    contexts = graph.cut(contexts_of(docs, context))
    n_v = contexts.groupBy("entity").agg(F.count("*").alias("n_v"))
    df_v = docs.where(F.size("_base") > 0).select(F.explode(F.array_distinct(F.transform("_base", lambda s: _entity(s["kind"], s["hit"])))).alias("entity")).groupBy("entity").agg(F.count("*").alias("df_v"))
    entities, some = _small(n_v.join(df_v, "entity"))
    if not some:
        return contexts.select(F.lit("").alias("term"), "entity", F.lit(0.0).alias("pmi"), F.lit(0.0).alias("ic")).limit(0)
    n = docs.count()
    pair = contexts.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_vt")).join(entities, "entity")
    ic = F.log(n / F.col("df_v"))
    pair = graph.cut(pair.where(ic > 0).select("term", "entity", ic.alias("ic"), F.log((F.col("n_vt") / F.col("n_v")) * n).alias("top")))
    # The document frequency of every word, as in any word count.  A term discloses when log df_t <= top - alpha * ic for some entity:
    # the largest bound of each term decides first, one row a term, so that no frequent word is joined row by row.
    df_t = docs.select(F.explode(F.array_distinct(_plain(F.col("text"), F.col("_base")))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))
    bound = pair.groupBy("term").agg(F.max(F.col("top") - alpha * F.col("ic")).alias("bound"))
    over, _ = _small(bound.join(df_t, "term").where(F.log("df_t") <= F.col("bound") + 1e-9).select("term", "df_t"))
    scored = pair.join(over, "term").select("term", "entity", (F.col("top") - F.log("df_t")).alias("pmi"), "ic")
    return scored.where(F.col("pmi") >= alpha * F.col("ic") - 1e-9)


def _pattern(terms: Column) -> Column:
    """A regular expression for the terms as whole words, the longest that fits winning; \\E inside a term cannot end its quotation."""
    longest = F.transform(F.array_sort(F.transform(terms, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    quoted = F.array_join(F.transform(longest, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), "|")
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])"))


def _held(docs: DataFrame, alpha: float, context: int) -> DataFrame:
    """(row, text, pii, spans): a row of docs as a struct, so that no inner name clashes with its columns, with base and all spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.struct(*graph.columns(docs)).alias("row"), text.alias("text"))
    found = found.withColumn("pii", F.struct(*[c.alias(k) for k, c in base_spans(F.col("text")).items()]))
    found = found.withColumn("base", F.concat(*[F.col(f"pii.{k}") for k in KINDS[:4]]))
    base = found.select("text", F.col("base").alias("_base"))
    terms, some = _small(disclosing_terms(base, alpha, context).select("term").distinct())
    if not some:
        return found.withColumnRenamed("base", "spans")
    # A text is named by two hashes (96 bits); its words travel with them, never with the text.
    named = base.select(F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), F.explode(F.array_distinct(_plain(F.col("text"), F.col("_base")))).alias("term"))
    own, _ = _small(named.join(terms, "term").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("term")).alias("terms")))
    keyed = found.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.hash("text")).join(own, ["k1", "k2"], "left")
    extra = F.when(F.col("terms").isNull(), F.array().cast(spans.SPAN)).otherwise(spans.find(F.col("text"), _pattern(F.col("terms")), "term"))
    return keyed.select("row", "text", "pii", F.concat("base", extra).alias("spans"))


def find_personal(docs: DataFrame, alpha: float = ALPHA, context: int = CONTEXT) -> DataFrame:
    """docs with its base spans (the four kinds as fields email, ip, card, phone of ``pii``) and all spans ``pii_spans``.

    Columns of docs with these two names are replaced; all others stay.
    """
    return _held(docs, alpha, context).select(*graph.fields(docs, "pii", "pii_spans"), "pii", F.col("spans").alias("pii_spans"))


def sanitise(docs: DataFrame, alpha: float = ALPHA, context: int = CONTEXT) -> DataFrame:
    """docs with personal data replaced by its kind; disclosing terms become <term> (with a capital ahead: <name>).  n_chars follows; a null text stays null."""
    label = lambda kind, hit: F.when(kind == "term", F.when(hit.rlike("^[\\p{Lu}]"), F.lit("<name>")).otherwise(F.lit("<term>"))).otherwise(F.concat(F.lit("<"), kind, F.lit(">")))
    clean = F.when(F.col("row")["text"].isNotNull(), spans.mask(F.col("text"), F.col("spans"), label))
    held = _held(docs, alpha, context).select("row", clean.alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.coalesce(F.length("clean").cast("long"), F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return held.select(*[new[c].alias(c) if new.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns])
