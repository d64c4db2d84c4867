"""Operators 2, 3, 4, 5 and 7 and the pipeline against brute force."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from flamewright.llm import bagminhash, mixing, packing, pii, quality, queries, secrets, shingles, spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(d):
    total = 0
    for k, ch in enumerate(reversed(d)):
        v = int(ch) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_personal(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, t) if ok(m[0])]


def rows(df):
    return [r.asDict() for r in df.collect()]


def check_personal(docs, got):
    want = collections.Counter()
    for r in docs:
        base = base_personal(r["text"] or "")
        n = collections.Counter(k for k, _, _ in base)
        want[(r["doc_id"], n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want


def personal(df):
    found = pii.find_personal(df)
    base = F.concat(*[F.col(f"pii.{k}") for k in pii.KINDS[:4]])
    return rows(found.select("doc_id", "text", *[F.size(f"pii.{k}").alias(f"n_{k}") for k in pii.KINDS[:4]], spans.digest(base).alias("base_sha256"), spans.joined(F.col("pii_spans")).alias("spans")))


def test_personal_data(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_personal(rows(docs), rows(queries.op2_pii(spark, "/root/testdata/sf0.01")))
    check_personal(rows(awkward), personal(awkward))
    assert personal(empty) == []
    tricky = spark.createDataFrame([(1, "a@b.co_c@d.ef x@y z@@q.w 1.2.3.4.5.6.7.8 0001.002.3.255 +1 2 +12345678 9+9 5105-1051 0510 5100 a@b.c."), (2, "1" * 2000 + "a" * 2000)], "doc_id long, text string")
    check_personal(rows(tricky), personal(tricky))


def test_disclosing_terms_and_masking(spark):
    fill = ["red", "green", "blue", "stone", "river", "cloud", "maple", "brick", "amber", "coral"]
    named = [(i, f"{fill[i]} {fill[(i + 3) % 10]} write Zorblax now to z@x.io {fill[(i + 5) % 10]} write") for i in range(5)]
    plain = [(100 + i, f"{fill[i % 10]} {fill[(i * 7) % 10]} write to the {fill[(i + 1) % 10]}") for i in range(200)] + [(999, "Zorblax stands alone")]
    docs = spark.createDataFrame(named + plain, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal(docs)}
    assert got[999] == "term:0:7" and "term:" in got[0] and got[100] == ""
    clean = {r["doc_id"]: r["text"] for r in rows(pii.sanitise(docs))}
    assert clean[999] == "<name> stands alone" and "<email>" in clean[0] and "Zorblax" not in clean[0] and clean[100] == dict(plain)[100]


SPACE, EDGE = r"\x20\x09-\x0D", r""".,;:!?()\[\]{}"'<>|"""
PLAIN = re.compile(rf"[^{SPACE}{EDGE}](?:[^{SPACE}]*[^{SPACE}{EDGE}])?")


def cut_out(text):
    """(plain words, plain words ahead of each used span, [(entity, its span)]) of a text."""
    order = sorted(((a, -b, f"{k}:{text[a:b].lower()}") for k, a, b in base_personal(text)))
    at, parts, entities = 0, [], []
    for a, b, entity in order:
        if a >= at:
            parts.append(text[at:a])
            at = -b
        entities.append((entity, len(parts) - 1))
    words = [PLAIN.findall(p) for p in [*parts, text[at:]]]
    ahead = [sum(map(len, words[: k + 1])) for k in range(len(parts))]
    return [w for x in words for w in x], ahead, entities


def terms_brute(texts, alpha=pii.ALPHA, context=pii.CONTEXT):
    """The disclosing terms by the definition, in plain loops."""
    contexts, df_v, df_t = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for text in texts:
        plain, ahead, entities = cut_out(text)
        df_t.update(set(plain))
        df_v.update({e for e, _ in entities})
        for e, k in entities:
            near = plain[max(0, ahead[k] - context) : ahead[k]] + plain[ahead[k] : ahead[k] + context]
            contexts[e].add(tuple(w for w in dict.fromkeys(near) if len(w) > 1))
    found, n = set(), len(texts)
    for e, own in contexts.items():
        ic = math.log(n / df_v[e])
        if ic > 0:
            count = collections.Counter(t for c in own for t in c)
            found |= {t for t, k in count.items() if math.log(k / len(own) * n / df_t[t]) >= alpha * ic - 1e-9}
    return found


def check_term_spans(docs, got):
    texts = [r["text"] or "" for r in docs]
    terms = terms_brute(texts)
    want = collections.Counter()
    for r, text in zip(docs, texts):
        own = sorted(terms & set(cut_out(text)[0]), key=lambda t: (-len(t), t))
        hits = regex.finditer(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(regex.escape, own)) + r")(?![\p{L}\p{N}])", text) if own else ()
        spans_ = [f"{k}:{a}:{b}" for k, a, b in base_personal(text)] + [f"term:{m.start()}:{m.end()}" for m in hits]
        want[(r["doc_id"], ",".join(spans_))] += 1
    assert collections.Counter((r["doc_id"], r["spans"]) for r in got) == want
    return sum(k[1].count("term:") for k in want)


def test_term_spans_match_the_definition(spark, sf, awkward):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert check_term_spans(rows(docs), rows(queries.op2_pii(spark, sf)))
    check_term_spans(rows(awkward), personal(awkward))
    odd = ["fine words all around here", "also fine words here", r"Zo\E(x met ann@x.org near Zo\E(x and Zo", r"later Zo\E(x alone", "staff-77 wrote bob@y.org, (staff-77) staff", "staff stays; staff-77 too", "two a@b.co c@d.ef 1.2.3.4 together twin", "over 4111 1111 1111 1111@x.org lap", ""] + [f"plain text {i} goes on fine here" for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd + odd[2:4])], "doc_id long, text string")
    assert check_term_spans(rows(df), personal(df)) >= 6


def mixed(docs):
    size = collections.Counter()
    for r in docs:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(size.values())
    while left > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in list(free):
            if target[s] >= 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = 2.0 * size[s]
                free.discard(s)
    return size, target


@pytest.mark.parametrize("where", ["/root/testdata/sf0.01", "awkward"])
def test_mixing(spark, awkward, where):
    df = awkward if where == "awkward" else spark.read.parquet(f"{where}/documents.parquet")
    docs, got = rows(df), rows(mixing.takes(df))
    size, target = mixed(docs)
    assert sorted(map(repr, [(r["doc_id"], len(WORD.findall(r["text"] or "")), size[r["source"]]) for r in docs])) == sorted(map(repr, [(r["doc_id"], r["size"], r["source_size"]) for r in got]))
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    source = {r["doc_id"]: r["source"] for r in docs}
    taken, longest = collections.Counter(), collections.Counter()
    for r in got:
        if r["doc_id"] is not None:
            s = source[r["doc_id"]]
            assert r["target"] == pytest.approx(target[s])
            taken[s] += r["taken"]
            longest[s] = max(longest[s], r["size"])
    if where != "awkward":
        assert all(abs(taken[s] - target[s]) <= longest[s] for s in size)
        assert sorted(map(repr, got)) == sorted(map(repr, rows(mixing.takes(df.repartition(5)))))
        times = collections.Counter(r["doc_id"] for r in rows(mixing.mix(df)))
        assert times == collections.Counter({r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]})


CLASHES = ("epochs", "threshold", "_s", "s", "h", "of", "times", "row", "kept", "n_words", "words", "lines", "pii", "pii_spans", "_k1", "k1", "terms", "base", "spans", "clean", "secrets", "secret_spans", "_random", "term", "a.b", "class_id", "node")


def test_columns_whose_names_clash_pass_through(spark):
    """No operator that returns documents loses, doubles or confuses a column for its name."""
    words = " ".join(f"the word{i} of thing{i}" for i in range(30))
    docs = [(i, f"{words} mail x{i}@y.org about item {i}", "s" + str(i % 2), *[f"{c}{i}" for c in CLASHES]) for i in range(6)]
    docs.append((6, None, None, *[None for _ in CLASHES]))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    same = lambda out: {tuple(r[c] for c in CLASHES) for r in out.collect()} <= {x[3:] for x in docs} and out.columns == df.columns
    kept, mixed, clean, single = quality.keep(df), mixing.mix(df), pii.sanitise(df), bagminhash.deduplicate(df)
    assert kept.count() == 6 and same(kept) and same(mixed) and mixed.count() and same(clean) and clean.count() == 7 and same(single) and single.count()
    assert mixing.takes(df).count() == 7
    assert all(r["text"] is None or "<email>" in r["text"] for r in clean.collect())
    for out, new in ((quality.judge(df), {*quality.MEASURES, "base_failed", "kept"}), (pii.find_personal(df), {"pii", "pii_spans"}), (secrets.find_secrets(df), {"secrets", "secret_spans"})):
        assert sorted(out.columns) == sorted(set(df.columns) | new) and out.count() == 7
        left = [c for c in CLASHES if c not in new]
        assert {tuple(r[c] for c in left) for r in out.collect()} == {tuple(x[3 + CLASHES.index(c)] for c in left) for x in docs}


def test_mixing_empty(empty):
    assert rows(mixing.takes(empty)) == [] and rows(mixing.mix(empty)) == []


def check_packing(docs, got, tok, copies=1):
    ids = [np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4") for r in docs]
    want = collections.Counter()
    for r, x in zip(docs, ids):
        first = len(x) % 1024 or 1024
        at = [0, *range(first, len(x), 1024)]
        for k, (a, b) in enumerate(zip(at, [*at[1:], len(x)])):
            want[(r["doc_id"], k, a, b - a, zlib.crc32(x[a:b].tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 1024
    return len(bins), -(-sum(map(len, ids)) // 1024)


def test_packing(spark, awkward, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bins, least = check_packing(rows(docs), rows(packing.pack(docs, path)), tok)
    assert bins <= 1.02 * least + 1
    check_packing(rows(awkward), rows(packing.pack(awkward, path)), tok)
    special = spark.createDataFrame([(1, "<|endoftext|>"), (2, "one<|endoftext|> two <|endoftext|>three <|endoftext"), (3, " <|endoftext|><|endoftext|>" * 700), (4, "plain")], "doc_id long, text string")
    check_packing(rows(special), rows(packing.pack(special, path)), tok)
    assert packing.encoder(path, special=True)("a<|endoftext|>")[-1] == 50256 and 50256 not in packing.encoder(path)("a<|endoftext|>")
    assert rows(packing.pack(empty, path)) == []


def test_quality(spark, awkward, empty):
    for df in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), awkward):
        con = duckdb.connect()
        documents = df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})
        con.register("documents", documents)
        want = con.execute(quality.oracle()).df()
        got = quality.judge(df).select(*want.columns).toPandas()
        key = lambda x: sorted(map(str, x.astype(str).itertuples(index=False)))
        got["doc_id"] = got["doc_id"].astype("Int64")
        assert key(got) == key(want)
        for r in rows(quality.judge(df)):
            w = WORD.findall(r["text"] or "")
            tri = collections.Counter(zip(w, w[1:], w[2:]))
            cover = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
            lines = [x for x in (r["text"] or "").split("\n") if WORD.search(x)]
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
    assert quality.judge(empty).count() == 0


def near_classes_brute(docs):
    bags, root = {}, {}
    for r in docs:
        if r["doc_id"] is not None:
            w = (r["text"] or "").encode().split()
            bags[r["doc_id"]] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else collections.Counter([tuple(w)])
            root[r["doc_id"]] = r["doc_id"]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = collections.defaultdict(list)
    for i, bag in sorted(bags.items()):
        seen = {j for g in bag for j in index[g]}
        for j in seen:
            both = sum((bag & bags[j]).values())
            if both / (sum(bag.values()) + sum(bags[j].values()) - both) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in bag:
            index[g].append(i)
    return {i: find(i) for i in root}


def test_near_classes(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (docs, awkward):
        got = rows(bagminhash.near_classes(df))
        assert len(got) == df.count()
        assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == near_classes_brute(rows(df))
    assert rows(bagminhash.near_classes(empty)) == [] and rows(bagminhash.deduplicate(empty)) == []
    single = rows(bagminhash.deduplicate(awkward.union(awkward.where("doc_id is null"))))
    leads = set(near_classes_brute(rows(awkward)).values())
    assert sorted(r["doc_id"] for r in single if r["doc_id"] is not None) == sorted(leads)
    assert [r["text"] for r in single if r["doc_id"] is None] == ["solo text of no id"]


def test_a_family_of_near_copies(spark):
    r = np.random.default_rng(11)
    base = [f"w{k}" for k in range(150)]
    docs = []
    for i in range(90):
        words = list(base)
        for _ in range(int(r.integers(0, 9))):
            words[int(r.integers(0, 12)) * 12] = f"alt{int(r.integers(0, 3))}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(f"x{int(k)}" for k in r.integers(0, 10_000, 120))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in rows(bagminhash.near_classes(df))}
    assert got == near_classes_brute(rows(df)) and 2 < len(set(got.values())) - 30 < 90


def test_bag_signature_estimates_similarity():
    r = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    a = " ".join(words[k] for k in r.integers(0, 60, 400))
    b = a.split()
    for k in range(0, 400, 60):
        b[k] = "other"
    texts = [a.encode(), " ".join(b).encode(), b"same few words again same few words again " * 30, b"same few words again " * 40]
    sig = bagminhash.bag_signatures(*shingles.weighted(texts), 4, slots=4096)
    for i, j in ((0, 1), (2, 3)):
        want = shingles.similarity([texts[i]], [texts[j]])[0]
        assert abs((sig[i] == sig[j]).mean() - want) < 0.04


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    kept = p.keep_quality(spark, docs, sf)
    bad = {r["doc_id"] for r in rows(quality.judge(docs)) if not r["kept"]}
    assert {r["doc_id"] for r in rows(kept)} == {r["doc_id"] for r in rows(docs)} - bad and kept.columns == docs.columns
    single = p.drop_near_duplicates(spark, kept, sf)
    classes = near_classes_brute(rows(kept))
    assert sorted(r["doc_id"] for r in rows(single)) == sorted(set(classes.values())) and single.columns == docs.columns
    got = rows(p.run(spark, sf))
    assert got and {r["doc_id"] for r in got} <= set(classes.values())


@pytest.mark.parametrize("kind", ["awkward", "empty", "nulls"])
def test_pipeline_on_odd_tables(spark, awkward, empty, tmp_path, kind):
    """Each stage's columns are those of documents, and the last returns pieces; no table breaks a stage."""
    import corpus_pipeline as p

    rows_of = {"awkward": awkward, "empty": empty, "nulls": awkward.select(*[F.lit(None).cast(t).alias(c) for c, t in awkward.dtypes])}[kind]
    rows_of.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    got = rows(p.run(spark, str(tmp_path)))
    ids = {r["doc_id"] for r in rows(quality.keep(docs))}
    assert {r["doc_id"] for r in got} <= ids and (kind == "awkward") == bool(got)
    bins = collections.defaultdict(int)
    for r in got:
        bins[r["sequence_id"]] += r["length"]
    assert all(n <= 1024 for n in bins.values())


def test_pipeline_stages_match_brute_force(spark, sf):
    """Personal data, mixing and packing in the pipeline, each on its predecessor's rows."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    single = p.drop_near_duplicates(spark, p.keep_quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), sf).cache()
    clean = p.remove_personal_data(spark, single, sf).cache()
    before, after = {r["doc_id"]: r for r in rows(single)}, {r["doc_id"]: r for r in rows(clean)}
    assert before.keys() == after.keys()
    found = {r["doc_id"]: r["spans"] for r in personal(single)}
    for i, r in before.items():
        at, out = 0, []
        for a, b, k in sorted((int(x.split(":")[1]), -int(x.split(":")[2]), x.split(":")[0]) for x in found[i].split(",") if x):
            if a >= at:
                hit = r["text"][a:-b]
                out += [r["text"][at:a], f"<{k}>" if k != "term" else "<name>" if hit[0].isupper() else "<term>"]
                at = -b
        want = "".join([*out, r["text"][at:]])
        assert after[i]["text"] == want and after[i]["n_chars"] == len(want)
    mixed_rows = p.mix_sources(spark, clean, sf).cache()
    size, target = mixed(list(after.values()))
    taken = collections.Counter()
    for r in rows(mixed_rows):
        assert r["text"] == after[r["doc_id"]]["text"]
        taken[r["source"]] += len(WORD.findall(r["text"]))
    longest = max(len(WORD.findall(r["text"])) for r in after.values())
    assert all(abs(taken[x] - target[x]) <= longest for x in size)
    check_packing(rows(mixed_rows), rows(p.pack_sequences(spark, mixed_rows, sf)), Tokenizer.from_file(queries.tokenizer_path()))


def test_a_single_mention_discloses_and_words_with_digits_count(spark):
    url = "http://host.example/" + "p" * 300
    docs = [(i, f"the usual words stand here and there in note {i % 5}") for i in range(300)]
    docs += [(900, f"the usual jdoe42 {url} wrote from ann.lee@example.org about staff-77 and the usual words"), (901, "later jdoe42 and staff-77 came back"), (902, r"then quoted\Etext here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in rows(pii.sanitise(df))}
    for i in (900, 901):
        assert "jdoe42" not in clean[i] and "staff-77" not in clean[i] and "ann.lee" not in clean[i]
    assert "the usual words" in clean[900]
    assert clean[0] == docs[0][1]
