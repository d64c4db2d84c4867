"""Operators 1, 8, 9 and 10 against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flamewright.llm import cws, queries, secrets, shingles, spans, suffixes, token_counts


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_sampling_estimates_similarity():
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    a = [r.choice(words) for _ in range(800)]
    for share in (0.02, 0.1, 0.3):
        b = [w if r.random() > share else r.choice(words) for w in a]
        for x, y in ((a, b), (a[:50] * 6 + b[:300], a[:50] * 3 + b[:400])):
            x, y = " ".join(x).encode(), " ".join(y).encode()
            s = cws.fingerprints([x, y], 4096)
            assert abs(shingles.similarity([x], [y])[0] - (s[0] == s[1]).mean()) < 0.035


def check_fingerprints(docs, got):
    order = sorted(docs, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), (r["text"] or "").encode()))
    want = collections.Counter()
    for k, r in enumerate(order):
        text, after = r["text"] or "", order[(k + 1) % len(order)]["text"] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        s = cws.fingerprints([text.encode(), edited.encode(), after.encode()])
        want[(r["doc_id"], len(text), hashlib.sha256(edited.encode()).hexdigest(), cws.text_of(s[0]), cws.text_of(s[1]), (s[0] == s[1]).mean(), (s[0] == s[2]).mean())] += 1
    assert collections.Counter(tuple(r.values()) for r in got) == want


def test_fingerprints(spark, sf, awkward, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows(queries.op1_fingerprints(spark, sf))
    check_fingerprints(rows(docs), got)
    check_fingerprints(rows(docs), rows(cws.compare_with_next(docs, buckets=37)))
    check_fingerprints(rows(awkward), rows(cws.compare_with_next(awkward)))
    check_fingerprints(rows(docs.limit(1)), rows(cws.compare_with_next(docs.limit(1))))
    assert rows(cws.compare_with_next(empty)) == []
    assert np.mean([r["near_edited"] for r in got]) > 0.3 > 0.1 > np.mean([r["near_next"] for r in got])


def check_repeats(docs, got, length):
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs]
    seen = collections.Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    want = collections.Counter()
    for i, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[(i, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    return sum(k[2] for k in want)


def check_passages(docs, got, length):
    texts = [(r["doc_id"], re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode())) for r in docs]
    seen = collections.Counter(tuple(t[p : p + length]) for _, t in texts for p in range(len(t) - length + 1))
    want = collections.Counter()
    for i, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[tuple(t[p : p + length])] > 1:
                gone[p : p + length] = True
        want[(i, int((gone[1:] < gone[:-1]).sum()))] += 1
    assert collections.Counter((r["doc_id"], r["n_passages"]) for r in got) == want
    return sum(k[1] for k in want)


def test_repeats(spark, sf, awkward, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows(queries.op8_suffix_dedup(spark, sf))
    assert check_repeats(rows(docs), got, 400) and check_passages(rows(docs), got, 51)
    got = rows(suffixes.remove_repeats(awkward))
    check_repeats(rows(awkward), got, 400)
    check_passages(rows(awkward), got, 51)
    assert rows(suffixes.remove_repeats(empty)) == []


def test_cover_holds_every_difference():
    for v in (3, 7, 13, 21):
        d = suffixes.cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert len(suffixes.cover(21)) == 5 and len(suffixes.cover(7)) == 3


@pytest.mark.parametrize("seed, hot", [(0, 1 << 18), (1, 3), (2, 3)])
def test_repeats_at_small_lengths(spark, seed, hot):
    """Few letters, so that buckets are crowded; hot: buckets over it are counted instead of gathered."""
    r = random.Random(seed)
    pool = ["".join(r.choice("ab") for _ in range(r.randint(5, 90))) for _ in range(6)]
    docs = spark.createDataFrame([(i, "".join(r.choice(pool)[r.randint(0, 4) :] for _ in range(r.randint(0, 8)))) for i in range(60)], "doc_id long, text string")
    assert check_repeats(rows(docs), rows(suffixes.remove_repeats(docs, suffixes.Kind(False, 40, 8, 7, 7), None, hot)), 40)
    spaced = docs.withColumn("text", F.regexp_replace("text", "(...)", "$1 "))
    assert check_passages(rows(spaced), rows(suffixes.remove_repeats(spaced, suffixes.Kind(False, 40, 8, 7, 13), suffixes.Kind(True, 12, 3, 5, 3), hot)), 12)


def test_repeats_in_runs_periods_and_long_texts(spark, monkeypatch):
    r = random.Random(4)
    prose = lambda n: " ".join(f"w{r.randint(0, 400)}" for _ in range(n))
    shared = prose(90)
    texts = ["z" * 3000, "z" * 399, "ab" * 900, "x" + "ab" * 300, "abc" * 700 + "q", prose(9000) + " " + shared + " " + prose(5000), prose(40) + " " + shared, "\u00e9" * 700, None, "", "0123456789" * 41]
    # One row a run of equal blocks, not one a byte.
    assert len(suffixes.blocks([b"z" * 300_000])[0]) < 5 and len(suffixes.blocks([b"ab" * 150_000])[0]) < 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(suffixes.remove_repeats(docs))
    assert check_repeats(rows(docs), got, 400)
    assert check_passages(rows(docs), got, 51)


@pytest.mark.parametrize("stretch", [700, 1500])
def test_blocks_of_long_texts_are_cut_alike(stretch, monkeypatch):
    """Stretches split blocks; the windows they name are all the windows, each once."""
    r = random.Random(5)
    text = "".join(r.choice("abcd ") for _ in range(6000)).encode()
    monkeypatch.setattr(suffixes, "STRETCH", stretch)
    _, p, n, *_ = suffixes.blocks([text])
    assert sorted(x for a, k in zip(p, n) for x in range(a, a + k)) == list(range(len(text) - 399))


def base_secrets(t):
    kinds = (
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    found = [(m.start(), k, n, m.end()) for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m)]
    return [(n, a, b) for a, _, n, b in sorted(found)]


def check_secrets(docs, df):
    base = secrets.in_order(F.concat(*[F.col(f"secrets.{k}") for k in secrets.KINDS[:3]]))
    got = rows(secrets.find_secrets(df).select("doc_id", spans.joined(base).alias("base"), spans.joined(F.col("secret_spans")).alias("spans")))
    want = collections.Counter((r["doc_id"], ",".join(f"{k}:{a}:{b}" for k, a, b in base_secrets(r["text"] or ""))) for r in docs)
    assert collections.Counter((r["doc_id"], r["base"]) for r in got) == want
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in got)
    return got


def test_secrets(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_secrets(rows(docs), docs)
    check_secrets(rows(awkward), awkward)
    assert rows(secrets.find_secrets(empty)) == []


def test_random_strings_stand_out(spark):
    r = random.Random(7)
    chars = secrets.ALPHABETS["base62"]
    good = ["".join(r.choice(chars) for _ in range(40)) for _ in range(50)]
    good = [x for x in good if re.search("[0-9]", x)]
    plain = ["see-the-readme-for-release-2024-notes", "aaaaaaaaaaaaaaaaaaaaaaaaaa1111111111", "abcabcabcabcabcabcabc123123123123123", "user-user-user-user-user-user-0001"]
    docs = spark.createDataFrame([(i, f"x {s} y") for i, s in enumerate(good + plain * 5)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in rows(secrets.find_secrets(docs).select("doc_id", spans.joined(F.col("secret_spans")).alias("spans")))}
    caught = sum("random:" in got[i] for i in range(len(good)))
    assert caught >= 0.9 * len(good) and not any("random:" in got[i] for i in range(len(good), len(got)))


def test_token_counts(spark, sf, awkward, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), awkward):
        want = collections.Counter((r["doc_id"], len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows(df))
        for size in (64, 1 << 16):
            got = rows(token_counts.scan(token_counts.token_blocks(df, path, block_ids=size)))
            assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert rows(token_counts.scan(token_counts.token_blocks(empty, path))) == []


def test_token_files_without_names(spark, tmp_path):
    end = token_counts.END_ID
    streams = {"a.bin": [1, 2, end, end, 5, end, 7, 8], "b.bin": [end], "c.bin": [3, 3, 3]}
    for name, ids in streams.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    got = {(r["file"].rsplit("/", 1)[-1], r["ordinal"]): r["n_tokens"] for r in rows(token_counts.scan(token_counts.read_token_files(spark, str(tmp_path), block_ids=2)))}
    assert got == {("a.bin", 0): 2, ("a.bin", 1): 0, ("a.bin", 2): 1, ("a.bin", None): 2, ("b.bin", 0): 0, ("c.bin", None): 3}


def test_random_letters_and_digits_alone_are_tested(spark):
    r = random.Random(11)
    good = ["".join(r.choice(secrets.ALPHABETS[k]) for _ in range(40)) for k in ("letters", "lower", "upper", "decimal") for _ in range(10)]
    plain = ["=" * 30, "-" * 30, "=" * 29 + "a", "a" * 30, "0" * 30, "supercalifragilisticexpialidociousnessesses"] * 5
    docs = spark.createDataFrame([(i, f"x {s} y") for i, s in enumerate(good + plain)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in rows(secrets.find_secrets(docs).select("doc_id", spans.joined(F.col("secret_spans")).alias("spans")))}
    for k in range(4):
        assert sum("random:" in got[i] for i in range(10 * k, 10 * k + 10)) >= 8
    assert not any("random:" in got[i] for i in range(len(good), len(got)) if (i - len(good)) % 6 != 5)


def plain_p(s):
    """p-value of "random" by the definitions, one character at a time."""
    def of(pattern):
        return re.fullmatch(pattern, s)

    name = "decimal" if of("[0-9]+") else "hex" if of("[0-9a-f]+") or of("[0-9A-F]+") else "lower" if of("[a-z]+") else "upper" if of("[A-Z]+") else "letters" if of("[A-Za-z]+") else "base32" if of("[A-Z2-7]+=*") else "base36" if of("[0-9a-z]+") else "base62" if of("[0-9A-Za-z]+") else "base64"
    letters = secrets.ALPHABETS[name]
    body = (s.lower() if name == "hex" else s.replace("-", "+").replace("_", "/")).replace("=", "")
    v = [letters.index(c) for c in body]
    n, size = len(v), len(letters)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    counts = collections.Counter(v)
    chi, df = sum(k * k for k in counts.values()) * size / n - n, size - 1
    chi = (max(chi, 0.0) / df) ** (1 / 3)
    z_chi = (chi - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [x >= size / 2 for x in v]
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    expected = 1 + 2 * sum(high) * (n - sum(high)) / n
    spread = math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    mean = (size - 1) / 2
    serial = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / max(sum((a - mean) ** 2 for a in v), 1e-9) * math.sqrt(n)
    least = min(tail(z_chi), 2 * tail(abs((runs - expected) / spread)), 2 * tail(abs(serial)))
    return 1 - (1 - min(1.0, max(0.0, least))) ** 3


def mixture(seed, n=400):
    """(string, is it random) of random keys in several encodings and of identifiers that look like keys."""
    r = random.Random(seed)
    words = "get set user account token name value index cache store build parse render list table query batch shard index model layer input output config http json file path stream".split()
    out = []
    for _ in range(n):
        kind = r.choice(["base62", "base64", "hex", "letters", "base36", "base32"])
        out.append(("".join(r.choice(secrets.ALPHABETS[kind]) for _ in range(r.choice([32, 40, 48, 64]))), True))
        pick = [r.choice(words) for _ in range(r.randint(5, 9))]
        out.append((r.choice(["_".join(pick), "/".join(pick), "".join(w.title() for w in pick), "-".join(pick) + "-2024", "".join(pick), f"{r.choice(words)}_" * 6 + "end", f"{r.randint(0, 9)}" * 24 + "0001"]), False))
    return [(s, x) for s, x in out if len(s) >= secrets.MIN_LENGTH]


def test_randomness_matches_the_definitions(spark):
    r = random.Random(2)
    strings = [s for s, _ in mixture(1, 60)] + ["".join(r.choice(secrets.ALPHABETS[k]) for _ in range(n)) for k in secrets.ALPHABETS for n in (20, 33, 200, 3000)] + ["A" * 20, "Ab" * 15, "0123456789abcdef" * 3, "QUJD" * 8 + "==", "aB3-_" * 6, "ABCDEF0123" * 4]
    got = spark.createDataFrame([(s,) for s in strings], "hit string").withColumn("p", secrets.randomness(F.col("hit"))).collect()
    for row in got:
        assert abs(row.p - plain_p(row.hit)) < 1e-5, row.hit


def test_few_reported_strings_are_false_and_few_keys_are_missed(spark):
    for seed in range(2):
        strings = mixture(seed)
        docs = spark.createDataFrame([(i, f"see {s} there") for i, (s, _) in enumerate(strings)], "doc_id long, text string")
        spotted = {row.doc_id for row in secrets.find_secrets(docs).select("doc_id", F.filter("secret_spans", lambda x: x["kind"] == "random").alias("r")).where("size(r) > 0").collect()}
        random_ones = {i for i, (_, x) in enumerate(strings) if x}
        # Half of the strings are identifiers; those that pass all three tests are what remains.
        assert len(spotted & random_ones) >= 0.93 * len(random_ones)
        assert len(spotted - random_ones) <= 0.08 * len(spotted)
        # The verdicts follow from the histogram by the definition.
        bins = collections.defaultdict(collections.Counter)
        place = lambda s: (2 * next(k for k, n in enumerate(secrets.CLASSES) if len(s) <= n) + any(c.isdigit() for c in s), max(0, min(secrets.BINS - 1, math.floor(secrets.BINS + 20 * math.log10(max(plain_p(s), 1e-300))))))
        for s, _ in strings:
            c, b = place(s)
            bins[c][b] += 1
        low = {}
        for c, hist in bins.items():
            above = lambda b: sum(n for k, n in hist.items() if k >= b)  # noqa: B023, E731
            edge = lambda b: 10 ** ((b - secrets.BINS) / 20)
            top, first = math.ceil(secrets.BINS + 20 * math.log10(secrets.TOP) - 1e-9), math.ceil(secrets.BINS + 20 * math.log10(secrets.Q) - 1e-9)
            keys = above(top) / (1 - edge(top))
            low[c] = next((b for b in range(first, top) if above(b) - keys * (1 - edge(b)) - 0.5 * math.sqrt(above(b)) <= secrets.Q * above(b)), top)
        want = {i for i, (s, _) in enumerate(strings) if place(s)[1] >= low[place(s)[0]]}
        assert len(want ^ spotted) <= 1  # a p-value on the edge of a bin may fall either way
