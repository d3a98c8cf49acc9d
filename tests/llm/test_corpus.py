"""The ten corpus operators and the pipeline against brute force, round trips and held-out accuracy."""

import copy
import hashlib
import json
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rankloom.llm import chat, decontaminate, hamming, langid, linededup, lm, neardup, pii, queries, secrets, texts, trigrams
from rankloom.llm.bpe import Coder, bpe_decode, bpe_encode

DATA = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = "word " * 60_000 + "9" * 30_000 + "@" * 1000 + "a." * 20_000


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like those that operators add."""
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (6, "Ünïcode ñ \x00 \U0001f600 text")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("lang", "id", "candidates", "removed", "ids", "words", "pii", "secrets", "score", "hash", "block", "version")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 1 personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def accepted(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in double) % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def base_pii(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if accepted(k, m[0])]


PII_TEXTS = [
    "a@b.c a@b.cd@e.f x@y_.c@d.e a@b@c.d a@b.c._d@e.f @a.b a@b. é a.b+c@x-y.org.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255 1..2.3.4 9.9.9 1.1.1.1é1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4111  1111 1111 1111 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "+1 (613) 555-8758 +12 +1-- +123456789012345 +1234567890123456 ++12345678 +1 2345678)",
    "\U0001f600 a@b.co \U0001f600 10.0.0.1",
]


def test_pii_base_equals_brute_force(spark, documents):
    rng = random.Random(5)
    more = ["".join(rng.choice("0123456789.-+ @ab()") for _ in range(300)) for _ in range(150)]
    rows = list(enumerate(PII_TEXTS + more + [t for _, t in documents]))
    scorer = pii.Scorer("0D", {k: 1.01 for k in pii.KINDS})
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), scorer)
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.pii if s.base] for r in found.collect()}
    assert got == {i: base_pii(t) for i, t in rows}


def test_pii_query_keeps_base_and_adds_spans(spark, documents):
    got = {r.doc_id: r for r in queries.op1_pii(spark, DATA).collect()}
    for i, t in documents:
        base = base_pii(t)
        assert got[i].base_sha256 == digest(",".join(base)) and set(base) <= set(filter(None, got[i].spans.split(",")))
        assert got[i].n_email == sum(s.startswith("email") for s in base)


def test_pii_trees_add_what_looks_alike(spark):
    rng = random.Random(1)
    rows = [(i, f"call {'+1 (613) 555-%04d' % rng.randrange(10000)} or mail x{i}@example.com pay 4111111111111111 host 10.0.0.{i % 250}") for i in range(200)]
    rows += [(1000, "mail: bob[at]example[dot]com please"), (1001, "call (613) 555-8758 now"), (1002, "no data here"), (1003, "ratio 1:2:3:4 only")]
    found = {r.doc_id: [(s.kind, s.base) for s in r.pii] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ("email", False) in found[1000] and ("phone", False) in found[1001]
    assert found[1002] == [] and found[1003] == []


def test_pii_trees_and_thresholds_are_of_all_candidates(spark, monkeypatch):
    features = f"transform(sequence(1, {len(pii.FEATURES)}), i -> if(i = 1, 1D, double(id * i % 7)))"
    candidate = f"named_struct('kind', 'email', 'start', int(id), 'end', int(id + 9), 'base', id % 7 > 2, 'features', {features})"
    candidates = spark.range(40_000).filter("id * 12 % 7 > 0").selectExpr(f"array({candidate}) as candidates")
    n = candidates.count()
    weighed, fit = [], pii.GBTClassifier.fit
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, df: (weighed.append(df.agg(F.sum("n") if "n" in df.columns else F.count("*")).first()[0]), fit(self, df))[1])
    pii.train_scorer(candidates)
    half = F.pmod(F.shiftright(F.xxhash64("c"), 32), F.lit(2))
    seeds = pii._seed_rows(spark).filter("half = 0").count() * n / 20_000
    assert abs(weighed[0] - candidates.select(F.explode("candidates").alias("c")).filter(half == 0).count() - seeds) < 1e-6


def test_pii_of_a_text_with_many_spans(spark):
    rng = random.Random(8)
    kinds = ["ann%d@example.org", "10.0.3.%d", "call +1 (613) 555-%04d", "pay 4111 1111 1111 1111 é %d", "(613) 555-%04d", "bob%d[at]example[dot]com"]
    text = " ".join(rng.choice(kinds) % rng.randrange(250) for _ in range(12_000))
    found = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.Scorer("9D", {k: 0.5 for k in pii.KINDS})).first().pii
    assert [f"{s.kind}:{s.start}:{s.end}" for s in found if s.base] == base_pii(text)
    base = {k: [(s.start, s.end) for s in found if s.base and s.kind == k] for k in pii.KINDS}
    assert sum(not s.base for s in found) > 2000
    for s in found[::37]:
        assert s.base or not any(a < s.end and s.start < b for a, b in base[s.kind])


def test_redaction(spark):
    found = pii.find_pii(spark.createDataFrame([(1, "é a@b.co, 10.0.0.1."), (2, None)], "doc_id long, text string"), pii.Scorer("0D", {k: 1.01 for k in pii.KINDS}))
    assert [r.text for r in pii.redact(found).orderBy("doc_id").collect()] == ["é [EMAIL], [IP].", ""]


# 2 secrets

SECRET = {"assign": r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
LEAST = {"assign": (2, 6), "access": (0, 20), "hex": (0, 24)}


def base_secrets(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(SECRET.items()) for m in re.finditer(p, text or "") if len(m[LEAST[k][0]]) >= LEAST[k][1]]
    return [x[2] for x in sorted(found)]


def test_secrets_equal_brute_force(spark, documents):
    odd = ["PassWord = 'abcdef' paſſword=abcdefg token:short api_key=abcdef apikey: \"x/y+z=.-_\"", "AKIA" + "A1" * 9, "f" * 24 + "g" + "0" * 23, "é token=abcdef123"]
    rows = list(enumerate(odd)) + [(1000 + i, t) for i, t in documents]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.secrets if s.kind in LEAST] for r in found.collect()}
    assert got == {i: base_secrets(t) for i, t in rows}


def test_trigram_queries_hold_for_matches():
    assert trigrams.trigram_query("[0-9a-f]+") is None and trigrams.trigram_query("ab|cde") is None
    assert trigrams.trigram_query("AKIA[A-Z]+") == ("all", (("has", b"aki"), ("has", b"kia")))

    def holds(query, text):
        if query is None:
            return True
        return query[1] in text.lower() if query[0] == "has" else (all if query[0] == "all" else any)(holds(q, text) for q in query[1])

    for pattern, text in (("api_?key[:=]x{3}", b"APIKEY:xxx"), ("(foo|ba[rz])+qux", b"barfooqux"), ("a(bcd)?efg", b"aefg"), ("x*longer", b"longer"), ("(?i:secret)s", b"SeCrEts")):
        assert re.search(pattern.encode(), text, re.IGNORECASE) and holds(trigrams.trigram_query(pattern), text)


# 3 near duplicates


def linked_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held, ids = {}, sorted(sets)
    for i in ids:
        shared = Counter(j for s in sets[i] for j in held.get(s, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            held.setdefault(s, []).append(i)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, documents):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = list(documents)
    for i in range(300):  # a large group of copies at all distances, its base among them
        copy = list(base)
        for _ in range(i % 12):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(copy)))
    rows += [(20_000, "A b"), (20_001, "a  B"), (20_002, ""), (20_003, None), (20_004, "a b c d")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == linked_components(rows, 3, 85)


def test_near_duplicates_of_repeated_ids(spark):
    """Every text of an id keeps its links, also where a copy of one has the smaller id."""
    rng = random.Random(8)
    bases = [[f"w{b}x{rng.randrange(10**6)}" for _ in range(80)] for b in range(12)]

    def near(b):
        text = list(bases[b])
        text[rng.randrange(80)] = f"y{rng.randrange(10**6)}"
        return " ".join(text)

    rows = [(i, near(b)) for i, b in ((3, 0), (7, 0), (7, 1), (9, 1), (20, 2), (20, 2), (21, 3), (20, 3), (30, 4), (31, 5), (32, 6))]
    rows += [(30, rows[-1][1]), (40, " ".join(bases[7])), (41, " ".join(bases[7])), (41, " ".join(bases[8])), (42, near(8)), (50, None), (50, near(9)), (51, near(9))]
    # brute force over rows, whose numbers stand in for ids; rows of one id belong together
    parts = linked_components(list(enumerate(t for _, t in rows)), 3, 85)
    label = {i: i for i, _ in rows}
    for _ in rows:
        by_part = {}
        for n, (i, _) in enumerate(rows):
            by_part[parts[n][1]] = min(by_part.get(parts[n][1], i), label[i])
        for n, (i, _) in enumerate(rows):
            label[i] = min(label[i], by_part[parts[n][1]])
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, parts[n][0], label[i]) for n, (i, _) in enumerate(rows))
    assert label[7] == label[9] == 3 and label[42] == 40 and label[51] == 50 and label[32] == 30


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    both = np.concatenate([x[:1000], x[500:]])
    signature = neardup.superminhash(both, np.repeat([0, 1], 1000), 3, 512)
    assert abs((signature[0] == signature[1]).mean() - 1 / 3) < 0.08
    assert np.isinf(signature[2]).all() and signature[0].max() < 512
    few = neardup.superminhash(x[:3], np.zeros(3, int), 1, 64)
    assert np.isfinite(few).all() and sorted(np.floor(few[0]))[-1] > 0


# 4 benchmark items


def test_decontamination_finds_items_in_long_documents(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([5, 7, 12, 30, 60, 200, 3])] + [(90, None), (91, "")]
    docs = [(100 + i, text(5000) + " " + t.upper().replace(" ", ", ") + " " + text(5000)) for i, t in items[:6]]
    partly = items[4][1].split()
    docs += [(200, text(50) + " " + " ".join(partly[:54])), (201, " ".join(partly[:20])), (202, text(400)), (203, items[6][1]), (204, "x " + items[6][1] + " y z w"), (205, None)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(100 + i, i) for i in range(6)} | {(200, 4), (203, 6)}


@pytest.mark.parametrize("percent", [30, 60, 95])
def test_decontamination_at_other_thresholds(spark, percent):
    rng = random.Random(percent)
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    items = [text(n) for n in (12, 12, 20, 40, 80, 200)]  # a 12-word item has 8 shingles
    docs, want = [], set()
    for i, t in enumerate(items):
        for share in (25, 35, 62.5, 70, 97, 100):
            kept = t[: 4 + math.ceil((len(t) - 4) * share / 100)]
            docs.append((100 * i + int(share), " ".join(text(30) + kept + text(30))))
            if 100 * (len(kept) - 4) >= percent * (len(t) - 4):
                want.add((docs[-1][0], i))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"), percent=percent)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


# 5 repeated lines


def plain_line_dedup(rows):
    """All runs a..b of 25 words or more that an earlier (id, line) has too; a line that occurs once is in none."""
    often, seen, out = Counter(x for _, t in rows for x in t.split("\n")), set(), {}
    for i, t in rows:
        lines, gone = t.split("\n"), set()
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                if often[lines[b]] == 1:
                    break
                n += len(words(lines[b]))
                if n >= 25:
                    run = tuple(lines[a : b + 1])
                    gone |= set(range(a, b + 1)) if run in seen else set()
                    seen.add(run)
        out[i] = ("\n".join(x for j, x in enumerate(lines) if j not in gone), len(gone))
    return out


def test_line_dedup_equals_brute_force(spark, documents):
    rng = random.Random(6)
    pool = [" ".join(f"l{i}w{j}" for j in range(rng.choice([0, 1, 3, 9, 30]))) for i in range(40)]
    rows = sorted(documents) + [(5000 + i, "\n".join(rng.choices(pool, k=rng.randrange(1, 25)))) for i in range(150)]
    got = {r.doc_id: (r.text, sum(x.last - x.first + 1 for x in r.removed)) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 25).collect()}
    assert got == plain_line_dedup(rows)


def test_line_dedup_takes_whole_runs(spark):
    rng = random.Random(7)
    pool = [" ".join(f"l{i}w{j}" for j in range(rng.choice([0, 1, 3, 9, 30]))) for i in range(25)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 20)))) for i in range(80)]
    long = " ".join(f"q{j}" for j in range(30))
    rows += [(100, f"{long}\nshort closing line\na"), (101, f"b\n{long}\nshort closing line\n\nc"), (102, f"{long}\nshort closing line\n\nd")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(frame, 25).collect()}
    seen = set()
    for i, t in rows:
        lines = t.split("\n")
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(n[a:b]) >= 25:
                    run = tuple(lines[a:b])
                    gone |= set(range(a, b)) if run in seen else set()
                    seen.add(run)
        assert got[i].text == "\n".join(x for j, x in enumerate(lines) if j not in gone), i
        assert [j for x in got[i].removed for j in range(x.first, x.last + 1)] == sorted(gone), i
        assert all(x.last + 1 < y.first for x, y in zip(got[i].removed, got[i].removed[1:])), i
    assert got[101].text == "b\n\nc" and got[102].text == "d"


# 6 language


def test_language_held_out_accuracy(spark):
    found = queries.op6_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    right = [r.lang == r.lang_pred for r in held if r.lang_pred != "und"]
    assert sum(right) / len(right) > 0.97 and all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_texts(spark, none):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 10)] + [(100, None, "en"), (101, "12 34 !", None), (102, "²", None), (103, "und der", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "de"
    assert langid.predict(spark.createDataFrame([(1, "text")], "doc_id long, text string"), langid.train(none)).first().lang_pred == "und"


def test_language_equals_brute_force(spark):
    """Naive Bayes over the n-grams themselves; none of these share a bucket."""
    rng = random.Random(11)
    pool = {"aa": ["kala", "mesi", "tuo"], "bb": ["kola", "drif", "tuo"], "cc": ["zhen", "mesi"]}
    rows = [(i, " ".join(rng.choices(pool[lang], k=rng.randrange(1, 6))).title(), lang) for i, lang in enumerate(rng.choices(list(pool), [5, 3, 2], k=60))] + [(100, "Kola, tuo 3", None), (101, "mesi", "aa"), (102, "qqq", None)]

    def grams(text):
        padded = f" {' '.join(re.sub('[^a-z]+', ' ', text.lower()).split())} "
        return Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))

    every = {g for _, t, _ in rows for g in grams(t)}
    buckets = langid._grams(pa.array([t for _, t, _ in rows]))[0]
    assert len(set(buckets.tolist())) == len(every)
    learned = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 5]
    counts = {lang: sum((grams(t) for t, x in learned if x == lang), Counter()) for lang in pool}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        log = {lang: math.log(sum(x == lang for _, x in learned) / len(learned)) + sum(n * math.log((c[g] + 0.5) / (c.total() + 0.5 * langid.BUCKETS)) for g, n in grams(t).items()) for lang, c in counts.items()}
        best = max(sorted(log), key=log.get)
        assert got[i][0] == best and math.isclose(got[i][1], 1 / sum(math.exp(x - log[best]) for x in log.values()), rel_tol=1e-3), i


def test_language_keeps_the_most_frequent_labels(spark):
    rows = [(i, "the cat", "en") for i in range(5)] + [(10, "der hund", "de"), (11, "le chien", "fr")]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=2)[0] == ["de", "en"]


# 7 nearest codes


def test_nearest_codes_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 48))
    v[200:700] = v[200]  # one vector with many copies
    v[700:900] = v[699] + rng.normal(size=(200, 48)) * 0.2
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(5000, None), (5001, [1.0]), (1, [float(x) for x in v[1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hamming.nearest_codes(df, df.filter("vec_id % 100 = 0"), k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    bits = v > 0
    for q in range(0, 1500, 100):
        d = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(1500))[:7]
        assert sorted(got[q]) == [(k + 1, *x) for k, x in enumerate(d)]


def test_nearest_codes_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id, r.distance) for r in hamming.nearest_codes(df, df.filter("vec_id = 0"), k=5).orderBy("rank").collect()] == [(1, 0, 0), (2, 3, 1)]
    assert hamming.nearest_codes(df.limit(0), df).isEmpty()


def test_nearest_codes_never_broadcast_what_is_looked_up(spark, monkeypatch):
    """One query is estimated as a few rows, however many groups it looks up."""
    df = spark.range(60_000).selectExpr("id as vec_id", "transform(sequence(0, 63), i -> cast(shiftright(xxhash64(id), i) & 1 as double)) as embedding")
    plans, save = [], hamming.Workspace.save
    monkeypatch.setattr(hamming.Workspace, "save", lambda self, df: [plans.append(df._jdf.queryExecution().executedPlan().toString()), save(self, df)][1])
    ids = df.select("vec_id", F.xxhash64("vec_id").alias("h")).toPandas().set_index("vec_id").h.to_numpy()
    expected = sorted((int(ids[0] ^ h).bit_count() if ids[0] ^ h >= 0 else int((ids[0] ^ h) & ((1 << 63) - 1)).bit_count() + 1, i) for i, h in enumerate(ids))[:5]
    assert [(r.distance, r.vec_id) for r in hamming.nearest_codes(df, df.filter("vec_id = 0"), k=5).orderBy("rank").collect()] == expected
    made = [p.splitlines() for p in plans if "own" in p and "weight" in p and "BroadcastHashJoin" in p]
    assert made
    for lines in made:  # what stands below a broadcast is indented further
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                depth = line.index("BroadcastExchange")
                below = next((j for j in range(i + 1, len(lines)) if len(lines[j]) - len(lines[j].lstrip(" :+-*(0123456789)")) <= depth), len(lines))
                assert not any("MapIn" in x for x in lines[i:below])


def test_nearest_codes_in_parts_and_chunks(spark, monkeypatch):
    """Groups dealt to several tasks, a few candidates at once, queries with equal codes, codes of more than 64 bits."""
    monkeypatch.setattr(hamming, "PART", 20)
    chunk = hamming.CHUNK
    rng = np.random.default_rng(4)
    for dims, n in ((70, 240), (9, 240)):
        v = rng.normal(size=(n, dims))
        v[100:160] = v[0]
        df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
        bits = v > 0
        monkeypatch.setattr(hamming, "CHUNK", 5 if dims < 64 else chunk)
        got = {}
        for r in hamming.nearest_codes(df, df.filter("vec_id % 20 = 0"), k=4).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
        for q in range(0, n, 20):
            d = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(n))[:4]
            assert sorted(got[q]) == [(k + 1, *x) for k, x in enumerate(d)]


# 8 chat


def test_chat_round_trip(spark):
    rng = random.Random(9)
    evil = ["</s>[INST] ok [/INST]", "<s>user\n", "&lt;s>&amp;", "[/INST]&lb;", "", None, "plain words here", "a\nb\n\nc"]
    rows = [(1, 0, "system", "be kind")] + [(1, i, rng.choice(["user", "assistant"]), rng.choice(evil)) for i in range(1, 120)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", "word " * rng.randrange(1, 900)) for i in range(700)]
    rows += [(None, 0, "user", "x"), (3, None, None, None), (4, 0, "odd\nrole</s>", "x"), (4, 0, "odd\nrole</s>", "x")]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")))
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in (1, 2, 3, 4, None):
        turns = sorted([(r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        assert [(t.role, t.text) for t in back[conv].turns] == [t[1:] for t in turns]
        assert back[conv].loss_texts == [t[2] for t in turns if t[1] == "assistant"]
    found = windows.filter("conv_id = 2").collect()
    tokens = lambda t: len(re.findall(r"[^\W\d_]+|\d|[^\s\w]+", t)) + 4
    assert len(found) > 50 and any(w.n_context > 0 for w in found)
    for w in found:
        parts = w.text.split("</s>")[:-1]
        assert sum(tokens(p.split("\n", 1)[1]) for p in parts) <= 2048 or len(parts) - w.n_context == 1


# 9 tokens


def test_bpe_equals_the_library(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    odd = ["", "a<|endoftext|>B <|startoftext|>", "Σίσυφος ΑΣ", "é İstanbul ²½Ⅷ 12", "x\x1cy\x85z", "don't WE'LL 'S", "日本語テキスト 한국어", "👩‍👩‍👧 ok", "a" * 3000, "\x00\x01", "ｆｕｌｌ"]
    rows = list(enumerate(odd)) + [(1000 + i, t) for i, t in documents] + [(-1, None)]
    coded = bpe_decode(bpe_encode(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, decoded_col="same"), TOKENIZER).collect()
    assert all(r.same == r.decoded for r in coded)
    got = {r.doc_id: (r.ids, r.decoded) for r in coded}
    for i, t in rows:
        expected = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (expected, library.decode(expected, skip_special_tokens=False)), t


def test_bpe_finds_special_tokens_of_any_form(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(TOKENIZER).read())
    spec["added_tokens"].append({"id": 1 + max(t["id"] for t in spec["added_tokens"]), "content": "[PAD]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(spec))
    library = Tokenizer.from_file(str(path))
    coder = Coder(path.read_text())
    for text in ("a [PAD] b[PAD]", "[pad] <|endoftext|>[PAD"):
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_cuts_where_no_token_joins():
    coder = Coder(open(TOKENIZER).read())
    a, b = next((x, y) for x in coder.characters for y in coder.characters if (x, y) not in coder.inside)
    assert coder._merge(a + b, True) == coder._merge(a, False) + coder._merge(b, True)


# 10 language model


@pytest.fixture(scope="module")
def lm_parts(documents):
    """The model's parts made in this process: blocks, counts by block, lexicon, counts of pieces."""
    ids, given = zip(*documents[:60], strict=True)
    given = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(given), pa.array([i % 4 == 0 for i in range(60)])], ["id", "text", "out"])
    held = SimpleNamespace(value={"source": open(TOKENIZER).read()})
    end = lm.Pieces(held.value["source"]).size
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
        blocks = list(lm._blocks(held)([given]))
    rows = [r for b in blocks for r in b.to_pylist()]
    total, begin = Counter(), {}
    for r in rows:
        for h, n, g in zip(r["hashes"], r["learned"], r["begins"], strict=True):
            total[h] += n
            begin[h] = g
    tokens, types = np.zeros(end + 1, np.int64), np.zeros(end + 1, np.int64)
    for h, n in total.items():
        tokens[begin[h]] += n
        types[begin[h]] += n > 0
    lexicon = lm.Lexicon(tokens, types)
    read = lambda batches, n: np.bincount(*[np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1)], n)
    profiles = read(list(lm._counted(SimpleNamespace(value={"markers": lexicon.markers}), end)(blocks)), (lm.MARKERS + 1) * end).reshape(-1, end)
    lexicon.group(profiles[:-1].T)
    pairs = read(list(lm._paired(SimpleNamespace(value={"pieces": profiles[-1]}))(blocks)), lm.SPELLING**2)
    lexicon.spell(profiles[-1], pairs.reshape(lm.SPELLING, -1))
    return SimpleNamespace(blocks=blocks, rows=rows, total=total, lexicon=lexicon, pieces=profiles[-1] + tokens[:-1], end=end)


def test_lm_learns_from_every_window(lm_parts, monkeypatch):
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    learned = sum(n + 1 for r in lm_parts.rows for n, out in zip(r["words"], r["out"], strict=True) if not out)
    start = SimpleNamespace(value={"pieces": lm_parts.pieces, "mass": lm_parts.lexicon.mass, "classes": lm_parts.lexicon.classes, "flat": None})
    assert [b.column("n").to_pylist() for b in lm._trained(start)(lm_parts.blocks)] == [[learned]]


def test_lm_rounds_hold_every_block_once():
    assert lm.ROUNDS[0] == 0 and list(lm.ROUNDS) == sorted(set(lm.ROUNDS))


def test_lm_score_equals_a_plain_one(lm_parts, documents):
    """Word by word, with the attention of each window written out."""
    lex, rng = lm_parts.lexicon, np.random.default_rng(3)
    model = lm.Attention(lm_parts.pieces, lex.mass)
    model.flat += rng.normal(0, 0.3, len(model.flat)).astype(np.float32)
    row = lm_parts.rows[0]
    counts = np.array([lm_parts.total[h] for h in row["hashes"]])
    shared = SimpleNamespace(value={"pieces": lm_parts.pieces, "pickled": cloudpickle.dumps(lex), "flat": model.flat})
    order = rng.permutation(len(counts))
    scored = lm._scores(shared, 1000, 500)(pa.Table.from_pylist([row], lm_parts.blocks[0].schema), pa.table({"at": order, "n": counts[order]})).to_pydict()
    block, w = lm.Block(row), model.w
    pieces = np.split(block.subs, block.stops[:-1])

    def share(word):
        if word == len(pieces):
            return 0.0
        ids = pieces[word]
        spelled = lex.begin[ids[0]] + sum(float(lex.follows[lex.kind[a], lex.kind[b]]) + lex.inside[b] for a, b in zip(ids, ids[1:]))
        of = lex.classes[ids[0]]
        if not lex.mass[of]:
            return spelled
        return math.log(max(counts[word] - lm.DISCOUNT, 0) / lex.mass[of] + lex.lost[of] / lex.mass[of] * math.exp(spelled))

    at = 0
    for text in range(8):
        said = [*block.place[at : at + row["words"][text]], len(pieces)]
        at += row["words"][text]
        read, begins = [lm.OWN - 2], []  # rows of the begin and of all pieces; where each word begins
        for word in said[:-1]:
            begins.append(len(read) - 1)
            read += [model.row[p] for p in pieces[word]]
        begins.append(len(read) - 1)
        expected = 0.0
        for t, word in zip(begins, said, strict=True):
            step = lm.WINDOW - lm.CONTEXT
            first = 0 if t < lm.WINDOW else ((t - lm.CONTEXT) // step) * step
            x = np.array([w["embed"][read[i]] + w["place"][i - first] for i in range(first, t + 1)])
            q, k, v = np.split(x @ w["qkv"], 3, axis=1)
            e = np.exp(k @ q[-1] / math.sqrt(lm.WIDTH))
            logits = ((e / e.sum()) @ v @ w["join"] + x[-1]) @ w["out"] + w["bias"]
            of = lex.classes[pieces[word][0]] if word < len(pieces) else lex.classes[-1]
            expected += logits[of] - np.log(np.exp(logits).sum()) + share(word)
        assert math.isclose(scored["score"][text], expected / math.log(10), rel_tol=1e-3)


@pytest.fixture(scope="module")
def lm_divided(lm_parts):
    """The lexicon with the network's classes of pieces inside words."""
    lex = copy.copy(lm_parts.lexicon)
    found = list(lm._paired(SimpleNamespace(value={"pieces": lm_parts.pieces - lex.counts[:-1]}))(lm_parts.blocks))
    lex.divide(np.bincount(*[np.concatenate([b.column(i).to_numpy() for b in found]) for i in (0, 1)], lm.SPELLING**2).reshape(lm.SPELLING, -1))
    return lex


def test_lm_predicts_every_piece_once(lm_parts, lm_divided):
    block, model = lm.Block(lm_parts.rows[0]), lm.Attention(lm_parts.pieces, lm_divided.mass)
    ids, begins, _ = block.pieces(lm_parts.end)
    found = list(lm._all_windows(block, model, lm_divided, np.ones(len(block.words), bool), 64))
    inside = np.concatenate([places for _, places, *_ in found])
    assert np.sort(np.concatenate([x[0] for x in found])).tolist() == np.flatnonzero(begins).tolist() and len(inside) > 0.5 * begins.sum()
    assert np.sort(inside).tolist() == np.flatnonzero(~begins).tolist()
    weights = np.concatenate([given[-1] for *_, given in found])
    several = block.lengths > 1
    assert math.isclose(weights.sum(), (block.lengths[several] - 1).sum(), rel_tol=1e-4)  # each distinct word as much as another


def test_lm_learns_pieces_inside_words(lm_parts, lm_divided, monkeypatch):
    """After training the network gives them more than the counts that it starts from."""
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    start = SimpleNamespace(value={"pieces": lm_parts.pieces, "mass": lm_divided.mass, "pickled": cloudpickle.dumps(lm_divided), "flat": None})
    for _ in range(4):
        start.value["flat"] = np.array(list(lm._trained(start)(lm_parts.blocks))[0].column("flat")[0].as_py(), np.float32)
    losses = []
    for flat in (None, start.value["flat"]):
        model, loss = lm.Attention(lm_parts.pieces, lm_divided.mass, flat), 0.0
        for row in lm_parts.rows:
            block = lm.Block(row)
            for _, _, rows, counts, classes, inside in lm._all_windows(block, model, lm_divided, ~block.out, 64):
                loss -= (model.score(rows, counts, classes, inside)[1] * inside[-1]).sum()
        losses.append(loss)
    assert losses[1] < 0.98 * losses[0]


def test_lm_score_of_every_piece_equals_a_plain_one(lm_parts, lm_divided):
    """Piece by piece, with the attention of each window written out."""
    lex, rng = lm_divided, np.random.default_rng(5)
    model = lm.Attention(lm_parts.pieces, lex.mass)
    model.flat += rng.normal(0, 0.3, len(model.flat)).astype(np.float32)
    row = lm_parts.rows[0]
    counts = np.array([lm_parts.total[h] for h in row["hashes"]])
    counts[:-1][rng.random(len(counts) - 1) < 0.5] = 0
    shared = SimpleNamespace(value={"pieces": lm_parts.pieces, "pickled": cloudpickle.dumps(lex), "flat": model.flat})
    scored = lm._scores(shared, 1000, 500)(pa.Table.from_pylist([row], lm_parts.blocks[0].schema), pa.table({"at": np.arange(len(counts)), "n": counts})).to_pydict()
    block, w = lm.Block(row), model.w
    pieces = np.split(block.subs, block.stops[:-1])
    at = 0
    for text in range(8):
        said = block.place[at : at + row["words"][text]]
        at += row["words"][text]
        read = [lm.OWN - 2, *(model.row[p] for word in said for p in pieces[word])]

        def state(t):
            step = lm.WINDOW - lm.CONTEXT
            first = 0 if t < lm.WINDOW else ((t - lm.CONTEXT) // step) * step
            x = np.array([w["embed"][read[i]] + w["place"][i - first] for i in range(first, t + 1)])
            q, k, v = np.split(x @ w["qkv"], 3, axis=1)
            e = np.exp(k @ q[-1] / math.sqrt(lm.WIDTH))
            return (e / e.sum()) @ v @ w["join"] + x[-1]

        expected, t = 0.0, 0
        for word in [*said, None]:
            logits = state(t) @ w["out"] + w["bias"]
            logits -= np.log(np.exp(logits).sum())
            if word is None:
                expected += logits[lex.classes[-1]]
                break
            ids = pieces[word]
            of, spelled = lex.classes[ids[0]], float(lex.begin[ids[0]])
            for a, b in zip(ids, ids[1:]):
                t += 1
                follows = np.exp(lex.follows[lex.kind[a]].astype(float))
                own = lex.inner == lex.inner[lex.kind[b]]
                of_class = [follows[lex.inner == c].sum() for c in range(lm.INNER)]
                inner = state(t) @ w["inner"] + w["inner_bias"] + np.log(np.maximum(of_class, 1e-12))
                spelled += inner[lex.inner[lex.kind[b]]] - np.log(np.exp(inner).sum()) + math.log(follows[lex.kind[b]] / follows[own].sum()) + lex.inside[b]
            t += 1
            expected += logits[of] + (math.log(max(counts[word] - lm.DISCOUNT, 0) / lex.mass[of] + lex.lost[of] / lex.mass[of] * math.exp(spelled)) if lex.mass[of] else spelled)
        assert math.isclose(scored["score"][text], expected / math.log(10), rel_tol=1e-3)


def test_lm_pieces_inside_words_are_a_distribution(lm_divided):
    of = np.column_stack([np.exp(lm_divided.within)[:, lm_divided.inner == c].sum(axis=1) for c in np.unique(lm_divided.inner)])
    assert np.allclose(of, 1, atol=1e-3) and np.allclose(np.exp(lm_divided.prior).sum(axis=1), 1, atol=1e-3)


def test_lm_words_of_a_class_are_a_distribution(lm_parts):
    """Shares of the words of a class and of what is left to unseen ones add up to one."""
    lex = lm_parts.lexicon
    begin = {h: g for r in lm_parts.rows for h, g in zip(r["hashes"], r["begins"], strict=True)}
    seen = np.zeros(lm.CLASSES)
    for h, n in lm_parts.total.items():
        seen[lex.classes[begin[h]]] += max(n - lm.DISCOUNT, 0)
    full = lex.mass > 0
    assert np.allclose((seen + lex.lost)[full], lex.mass[full])
    assert np.allclose(np.exp(lex.follows).sum(axis=1), 1, atol=1e-4) and np.allclose(np.bincount(lex.kind, np.exp(lex.inside), lm.SPELLING)[np.unique(lex.kind)], 1)
    assert np.allclose(np.bincount(lex.classes[:-1], np.exp(lex.begin), lm.CLASSES)[np.unique(lex.classes[:-1])], 1)


def test_lm_beats_word_counts_on_held_out_texts(spark):
    found = queries.op10_lm_score(spark, "/root/testdata/sf0.1").groupBy("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).collect()
    assert len(found) == 2 and all(r.score > r.base for r in found)


def test_lm_base_scores_and_probabilities(spark, documents):
    got = {r.doc_id: r for r in queries.op10_lm_score(spark, DATA).collect()}
    tokens = {i: [*words(t), None] for i, t in documents}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    total = sum(counts.values())
    for i, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in t)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and r.score < 0


def test_lm_attention_has_a_share_of_its_own(lm_parts, monkeypatch):
    """Held-out texts are more probable with the trained attention than with the classes' shares in its place."""
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    lex = lm_parts.lexicon
    start = SimpleNamespace(value={"pieces": lm_parts.pieces, "mass": lex.mass, "classes": lex.classes, "flat": None})
    flat = None
    for _ in range(6):  # the small table gives few batches
        start.value["flat"] = flat
        flat = np.array(list(lm._trained(start)(lm_parts.blocks))[0].column("flat")[0].as_py(), np.float32)
    model = lm.Attention(lm_parts.pieces, lex.mass, flat)
    prior = np.log(np.maximum(lex.mass, 0.5) / lex.mass.sum())
    own = shares = n = 0
    for row in lm_parts.rows:
        block = lm.Block(row)
        for _, rows, counts, classes in lm._windows(block, model, lex.classes, block.out, 64):
            own, shares, n = own + model.score(rows, counts, classes).sum(), shares + prior[classes].sum(), n + len(classes)
    assert n > 1000 and (own - shares) / n / math.log(10) > 0.1


def test_lm_windows_score_every_word_once():
    lengths = np.array([1, 31, 32, 33, 56, 57, 200])
    ids = np.arange(lengths.sum())
    begins = np.random.default_rng(2).random(len(ids)) < 0.4
    seen = np.concatenate([targets for *_, targets in lm.TextWindows(ids, begins, lengths, -1).batches(3)])
    assert sorted(seen) == np.flatnonzero(begins).tolist()


def test_lm_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    n = 40
    tokens = np.cumsum(rng.integers(1, 3, 8000)) % n  # each token tells much about the next one
    model = lm.Attention(np.bincount(tokens, minlength=n), np.ones(lm.CLASSES))
    windows = lm.TextWindows(tokens, np.ones(8000, bool), np.array([8000]), n)
    given = lambda size: [(np.minimum(i, lm.OWN - 1), c, t) for _, i, c, t in windows.batches(size)]
    rows, counts, targets = given(4)[0]
    total = sum(np.exp(model.score(rows, counts, np.full_like(targets, c))) for c in range(lm.CLASSES))
    assert np.allclose(total, 1, atol=1e-3)
    loss = lambda: -np.mean([model.score(*x).mean() for x in given(64)])
    before = loss()
    for _ in range(12):
        model.fit(given(32))
    assert loss() < 0.5 * before


def test_lm_gradient_is_right():
    rng = np.random.default_rng(1)
    model = lm.Attention(rng.integers(1, 99, 301), rng.integers(1, 99, lm.CLASSES))
    model.flat *= 2
    rows, counts = rng.integers(0, 301, (3, lm.WINDOW)), rng.random((3, lm.WINDOW)) < 0.6
    classes = rng.integers(0, lm.CLASSES, counts.sum())
    grad = model.gradient(rows, counts, classes)
    for name in lm.SHAPES:
        view, g = lm._views(model.flat)[name].ravel(), lm._views(grad)[name].ravel()
        i = int(np.abs(g).argmax())
        values = []
        for step in (0.01, -0.02):
            view[i] += step
            values.append(-model.score(rows, counts, classes).mean())
        view[i] += 0.01
        assert np.isclose((values[0] - values[1]) / 0.02, g[i], rtol=0.05, atol=1e-4), name


def test_lm_gradient_inside_words_is_right():
    rng = np.random.default_rng(2)
    model = lm.Attention(rng.integers(1, 99, 301), rng.integers(1, 99, lm.CLASSES))
    model.flat *= 2
    model.flat += rng.normal(0, 0.2, len(model.flat)).astype(np.float32)
    rows, own = rng.integers(0, 301, (3, lm.WINDOW)), rng.random((3, lm.WINDOW))
    counts, places = own < 0.4, (own > 0.4) & (own < 0.9)
    classes, n = rng.integers(0, lm.CLASSES, counts.sum()), places.sum()
    inside = (places, rng.integers(0, lm.INNER, n), rng.normal(size=(n, lm.INNER)).astype(np.float32), rng.random(n).astype(np.float32))
    grad = model.gradient(rows, counts, classes, inside)
    for name in lm.SHAPES:
        view, g = lm._views(model.flat)[name].ravel(), lm._views(grad)[name].ravel()
        i = int(np.abs(g).argmax())
        values = []
        for step in (0.01, -0.02):
            view[i] += step
            first, later = model.score(rows, counts, classes, inside)
            values.append(-(first.astype(float).sum() + (later * inside[-1]).astype(float).sum()) / len(classes))
        view[i] += 0.01
        assert np.isclose((values[0] - values[1]) / 0.02, g[i], rtol=0.05, atol=1e-4), name


def test_pieces_of_any_length():
    held = lm.Pieces(open(TOKENIZER).read())
    data = np.frombuffer(b"internationally", np.uint8)
    ids, n = held.cut(texts.Hashes(data), np.array([0]), np.array([15]))
    vocabulary = json.loads(open(TOKENIZER).read())["model"]["vocab"]
    longest = max((p for p in vocabulary if "internationally</w>".startswith(p.removesuffix("</w>")) and (not p.endswith("</w>") or p == "internationally</w>")), key=len)
    assert ids[0] == vocabulary[longest] and len(longest) > 10 and n.sum() == len(ids)


WITHOUT_PACKAGE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in ("op2_secrets", "op10_lm_score", "op11_phrases", "op12_conversation_trie", "op13_packing"):
    print(name, __spark_entry__.queries()[name](spark, {data!r}).count())
"""


def test_workers_need_not_have_the_package(tmp_path):
    """A session that is started in an empty folder, the package on the driver's path alone."""
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(WITHOUT_PACKAGE.format(root=root, data=DATA))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.count("op1") == 4, done.stderr[-3000:]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_a_polynomial_confuses(spark):
    """Thue-Morse words and their complements are equal to any polynomial hash modulo 2^64."""
    swap = str.maketrans("ab", "ba")
    rows = [(i, f"same before {w} and after") for i, w in enumerate(x for n in (1024, 2048, 4096) for x in (thue_morse(n), thue_morse(n).translate(swap)))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == linked_components(rows, 3, 85)
    counted = {r.doc_id: (r.n_known, r.train_tokens) for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()}
    tokens = {i: [*words(t), None] for i, t in rows}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    assert counted == {i: (sum(counts[w] > 0 for w in t), sum(counts.values())) for i, t in tokens.items()}


# all of them: odd rows, empty tables, other columns

OPERATORS = {
    "pii": lambda d: pii.find_pii(d),
    "secrets": lambda d: secrets.find_secrets(d),
    "neardup": lambda d: neardup.near_duplicates(d),
    "decontaminate": lambda d: decontaminate.contaminated(d, d.select(F.coalesce("doc_id", F.lit(9)).alias("item_id"), "text")),
    "lines": lambda d: linededup.dedup_lines(d, 5),
    "language": lambda d: langid.identify(d),
    "bpe": lambda d: bpe_decode(bpe_encode(d, TOKENIZER), TOKENIZER),
    "lm": lambda d: lm.score_texts(d, TOKENIZER),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    rows = OPERATORS[name](odd).collect()
    assert len(rows) == (len({(r.doc_id, r.item_id) for r in rows}) if name == "decontaminate" else odd.count())
    by_id = {r.doc_id: r for r in rows}
    if name == "neardup":
        assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0 and by_id[1].kept and by_id[5].component_id == 5 and by_id[None].component_id is None
    if name == "lines":
        assert by_id[1].text is None and by_id[2].text == "" and by_id[4].text == LONG
    if name == "lm":
        assert by_id[1].n_tokens == 1 and by_id[4].n_tokens == len(words(LONG)) + 1
    if name == "pii":
        assert by_id[1].pii == [] and by_id[1].candidates == "x"


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, name):
    assert OPERATORS[name](none).isEmpty()


def test_chat_puts_null_turns_first(spark):
    rows = [(1, -1000, "user", "b"), (1, None, "system", "a"), (1, 5, "assistant", "c"), (1, 5, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("block", "window", "number", "tokens", "said")})
    back = chat.read_back(chat.format_windows(df)).first()
    assert [t.text for t in back.turns] == ["a", "b", "c", "c"]


def test_chat_of_very_long_texts(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG[::-1])]
    back = chat.read_back(chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t.text for t in back.turns] == [LONG, LONG[::-1]] and back.loss_texts == [LONG[::-1]]


def test_chat_of_nothing(spark):
    assert chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()


# the pipeline


def test_pipeline_equals_its_parts_by_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.language(spark, docs, DATA).collect()}
    lined = {i: left for i, (left, gone) in plain_line_dedup(sorted(kept.items())).items() if left or not gone}
    near = {i for i, (_, _, kept_) in linked_components(list(lined.items()), 5, 80).items() if kept_}
    grams = lambda t: {tuple(w[j : j + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] for j in range(len(w) - 4)}
    items = [grams(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {i for i in near if not any(g and 100 * len(g & grams(lined[i])) >= 80 * len(g) for g in items)}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {i: library.encode(lined[i], add_special_tokens=False).ids for i in clean}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, another column; then an empty table."""
    import corpus_pipeline

    given = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("extra", F.lit("x"))
    three = given.orderBy("doc_id").limit(3)
    empty = given.limit(2).withColumns({"text": F.when(F.col("doc_id") % 2 == 0, "").cast("string"), "doc_id": F.col("doc_id") + 100_000})
    unnamed = given.orderBy(F.desc("doc_id")).limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    plain, odd = given, given.union(three).union(three).union(empty).union(unnamed).union(unnamed)
    for name, docs in (("plain", plain), ("odd", odd), ("none", given.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    rows = lambda name: Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect())
    want, got = rows("plain"), rows("odd")
    assert max(got.values()) == 1 and {k for k in got if k[0] is not None} <= set(want) and len(got) >= len(want) - 1
    assert not rows("none")
