"""Phrases, the conversation trie and packing against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import packing, phrases, queries, trie
from tests.test_oracles import rows_of

DATA = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word " * 60_000 + "9" * 30_000 + "@" * 1000 + "a." * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like those that operators add."""
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (6, "Ünïcode ñ \x00 \U0001f600 text<|endoftext|> more")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("lang", "key", "word", "words", "n", "a", "range", "part", "sketch", "kind", "score")})


# 11 phrases


def plain_collocations(rows, least, top):
    """The definition: counts of all phrases, then scores of all cuts."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang or "und", *words[i : i + k]] += 1
    frequent = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    dropped = set()
    for (lang, *words), a in frequent.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * a >= 100 * f[lang, *words[i : i + k]]:
                    dropped.add((lang, *words[i : i + k]))
    found = defaultdict(list)
    for (lang, *words), a in frequent.items():
        if (lang, *words) not in dropped:
            cuts = [(1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
            score, _, left, right = min(cuts)
            found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, x in found.items() for i, (s, a, p, x, y) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize(("coded", "range_words"), [(2_000_000, 1 << 19), (40, 500), (0, 100), (500, 3000)])
def test_phrases_equal_brute_force(spark, coded, range_words):
    rng = random.Random(3)
    common = ["the", "of", "Éa", "la", "rare%d"]
    passage = "and so it was, said the old man of the sea to the boy"
    rows = []
    for i in range(900):
        text = " ".join(rng.choice(common).replace("%d", str(rng.randrange(60))) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "fr", None]), text + (" " + passage if i % 3 == 0 else "")))
    rows += [("en", None), ("en", ""), (None, ",,.")]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=20, top=50, coded=coded, range_words=range_words)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 20, 50)


def test_phrases_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    df, sql = queries.op11_phrases(spark, DATA), con.sql(queries.ORACLE_SQL["op11_phrases"])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(sql.columns, sql.fetchall())


def test_phrases_of_odd_rows(spark, odd):
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert sorted(map(tuple, phrases.collocations(odd, least=2).collect())) == plain_collocations(rows, 2, 2000)
    assert phrases.collocations(odd.limit(0)).count() == 0
    assert phrases.collocations(odd.withColumn("lang", F.lit(None).cast("string")).limit(3)).count() == 0


def test_phrase_scores_beyond_64_bits(spark):
    """a n passes 2^63 where counts do; the exact quotient is what decimals give."""
    row = spark.sql("select (1000BD * cast(9000000000000 as decimal(18,0)) * cast(90000000000000000 as decimal(17,0))) div (cast(7000000000000 as decimal(18,0)) * cast(3000000000 as decimal(18,0))) as score").first()
    assert row.score == 1000 * 9000000000000 * 90000000000000000 // (7000000000000 * 3000000000)


# 12 trie


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items())


def rows_of_trie(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("run", "ranges"), [(1 << 18, (1 << 14, 1 << 20)), (40, (60, 60)), (7, (12, 12)), (300, (5, 5))])
def test_trie_equals_brute_force(spark, run, ranges):
    rng = random.Random(run)
    rows = []
    for c in [*range(130), *range(-40, 0, 3), *range(1000, 1015)]:
        said = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é\U0001f600", None, ""])) for _ in range(rng.randrange(1, 9))]
        rows += [(c, i, *x) for i, x in enumerate(said)]
    for c in range(200, 260):  # copies, and copies that go on
        rows += [(c, i, "user", "same") for i in range(8 + c % 3)]
    rows += [(300, None, "user", "first"), (300, -5, "system", "then"), (300, 1, "user", "tie"), (300, 1, "user", "tie"), (300, 1, "assistant", "tie"), (None, 1, "user", "nobody's")]
    rows += [(400, i, "user", f"turn {i}") for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("id", "depth", "digests", "range", "parent", "base")})
    assert rows_of_trie(trie.conversation_trie(df.repartition(5), run_turns=run, range_turns=ranges)) == plain_trie(rows)


def test_trie_of_little(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    long = [(5, 0, "user", "x" * 300_000), (5, 1, None, None)]
    assert rows_of_trie(trie.conversation_trie(spark.createDataFrame(long, TURNS))) == plain_trie(long)


def test_merge_keeps_common_prefixes():
    rng = random.Random(2)
    entries = sorted((bytes(rng.randrange(2) for _ in range(rng.randrange(6))), i) for i in range(400))
    split = lambda key: [bytes([b]) * trie.WIDTH for b in key]
    pieces = []
    for r in range(7):
        mine = [e for e in entries if e[1] % 7 == r]
        keys = [b"".join(split(k)) for k, _ in mine]
        lcps = [0, *(trie._lcp(a, b) for a, b in zip(keys, keys[1:]))]
        pieces.append({"convs": [c for _, c in mine], "lcps": lcps, "lengths": [len(k) for k, _ in mine], "tails": b"".join(k[trie.WIDTH * h :] for k, h in zip(keys, lcps)), "chars": [0 for (k, _), h in zip(mine, lcps) for _ in k[h:]]})
    got, last = [], b""
    for head in trie.merged([trie.Run(p) for p in pieces]):
        key = b"".join(head.digests)
        assert head.lcp == trie._lcp(last, key)
        got.append((bytes(d[0] for d in head.digests), head.conv))
        last = key
    assert got == entries


# 13 packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def check_pieces(pieces, texts, library):
    """Every id in one piece, sequences gapless and full or a power of two. texts: list of (doc_id, text)."""
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts}
    times = Counter(i for i, _ in texts)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        by_doc[p.doc_id] += range(p.start, p.start + p.length)
        by_sequence[p.sequence_id].append(p)
    for i, tokens in ids.items():
        assert Counter(by_doc[i]) == {at: times[i] for at in range(len(tokens))}
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    assert set(by_doc) == set(ids)


def test_packing_query(spark, library):
    texts = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(queries.op13_packing(spark, DATA).collect(), texts, library)


@pytest.mark.parametrize(("shard", "part"), [(1 << 18, 8_000_000), (3000, 40_000), (1, 500)])
def test_packing_odd_rows(spark, odd, library, shard, part):
    got = packing.pack_documents(odd, JSON, shard_tokens=shard, part_chars=part).collect()
    check_pieces(got, [tuple(r) for r in odd.select("doc_id", "text").collect()], library)
    assert packing.pack_documents(odd.limit(0), JSON).count() == 0


def test_packing_copies_meet(spark):
    """Documents on the same subject share windows, a hot group of copies is dealt to several tasks."""
    rng = random.Random(4)
    vocabulary = [[f"t{t}w{i}" for i in range(40)] for t in range(12)]
    rows = [(i, " ".join(rng.choices(vocabulary[i % 12], k=30))) for i in range(240)]
    shard = packing.Shard(*plain_terms([t for _, t in rows]))
    packer = packing.Packer()
    packer.pack(shard, [i for i, _ in rows], [np.arange(100, dtype=np.uint32)] * len(rows))
    together = defaultdict(Counter)
    for p in packer.finished():
        together[p.sequence][p.doc_id % 12] += len(p.ids)
    assert sum(max(c.values()) for c in together.values()) > 0.75 * 1024 * len(together)
    copies = spark.createDataFrame([(i, "a copy of the very same text here " * 20) for i in range(400)], "doc_id long, text string")
    pieces = packing.pack_documents(copies, JSON, part_chars=30_000).collect()
    assert len({p.sequence_id >> 40 for p in pieces}) > 2


def plain_terms(rows):
    words = [Counter(t.split()) for t in rows]
    number = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    terms = [np.array(sorted(number[w] for w in c)) for c in words]
    names = sorted(number)
    counts = [np.array([c[names[i]] for i in t]) for t, c in zip(terms, words)]
    df = np.array([sum(w in c for c in words) for w in names])
    return terms, counts, np.log1p((len(rows) - df + 0.5) / (df + 0.5)), sum(c.total() for c in words) / len(rows)


def test_bm25_equals_the_formula():
    rng = random.Random(6)
    rows = [" ".join(rng.choices("abcdefghij", k=rng.randrange(1, 30))) for _ in range(40)]
    shard = packing.Shard(*plain_terms(rows))
    docs = [Counter(r.split()) for r in rows]
    average = sum(d.total() for d in docs) / 40
    for seed in range(0, 40, 7):
        for i, score in enumerate(shard.scores(seed)):
            want = 0.0
            for w in docs[seed]:
                df = sum(w in d for d in docs)
                tf = docs[i][w]
                want += math.log(1 + (40 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * docs[i].total() / average))
            assert score == pytest.approx(want)
    shard.unused[shard.ranked(0)[:5]] = False
    left = shard.ranked(0)
    assert len(left) == 35 and (np.diff(shard.scores(0)[left]) <= 1e-12).all()


def test_tokens_equal_the_library(spark, library):
    coder = packing.Coder(open(JSON).read())
    rng = random.Random(9)
    texts = ["", " ", "  a", "a\n\n b  c \t", "don't we'll 'S", "\x1c\x85　x", "x<|endoftext|>y", "é" * 500, "9" * 5000, LONG[:400_000:7]] + ["".join(rng.choice("ab é'\n\t9. Ωß中") for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert coder(t).tolist() == [*library.encode(t, add_special_tokens=False).ids, 0]


def test_packing_cuts_runs_of_blanks_as_the_library_does():
    """No text without special strings goes the slower way, and all have the library's ids."""
    coder, plain = packing.Coder(open(JSON).read()), Tokenizer.from_file(JSON)
    plain.no_truncation(), plain.no_padding()
    rng = random.Random(3)
    blanks = [" ", "  ", "\n", "\n\n", " \t", "\x1c", "\x1f\x1f", "\x85\u2003", "\u3000 ", "\u200b", "\xa0\xa0", "\ufeff "]
    some = [*blanks, "word", "don't", "'s", "42", "...", "é", "\U0001f600", "Ωmega", "\x00"]
    random_texts = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(3000)]
    special = [t + "  <|endoftext|>  " + t for t in random_texts[:200]]
    for text in special:
        assert coder(text)[:-1].tolist() == plain.encode(text, add_special_tokens=False).ids
    coder.encoding = None
    for text in ["", " ", "   ", "a  b", *random_texts]:
        assert coder(text)[:-1].tolist() == plain.encode(text, add_special_tokens=False).ids
