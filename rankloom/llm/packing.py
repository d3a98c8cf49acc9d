"""Packing documents into sequences: a sharded BM25 index finds unused neighbours that fill each seed's window."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.workspace import Workspace
from . import texts
from .bpe import byte_characters

#: Fixed value of the tokenizer: the pattern of its pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same but for looking ahead, which the library does at half the speed: all of a run of blanks is one piece.
#: Cut before the last blank of each run that something follows, a text has the same pieces by both.
PLAIN_PIECES = PIECES.replace(r"|\s+(?!\S)", "")
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_CUT = re.compile(f"{_BLANK}(?={_BLANK}[^{_BLANK[1:]})")

WINDOW = 1024
#: Terms are hashed into so many buckets, each with the number of documents of the whole table that hold it.
BUCKETS = 1 << 18
#: Tokens of a shard: what one index holds. Characters of a partition: what one task packs, shard by shard.
SHARD_TOKENS = 1 << 18
PART_CHARS = 8_000_000
MOST_HOT = 4096
K1, B = 1.2, 0.75
SKETCH_WORDS = 5

_U = np.uint64


def _sketch(hashes: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    """The least shingle of each text, spread over all 64 bits: texts that share most of their shingles mostly have the same."""
    out = np.full(rows, np.iinfo(np.uint64).max, _U)
    np.minimum.at(out, at, hashes)
    return texts.mix(out)


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as many as the longest chunk so far has bytes."""

    base = 0xD6E8FEB86659FD93
    up = down = np.ones(0, _U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = 1 << (n - 1).bit_length()  # chunks differ little in length
            cls.up, cls.down = (np.full(n, x, _U) for x in (cls.base, pow(cls.base, -1, 1 << 64)))
            for powers in (cls.up, cls.down):
                powers[:1] = 1
                np.multiply.accumulate(powers, out=powers)
        return cls.up, cls.down


_VALUES = texts.mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_VALUES[65:91] = _VALUES[97:123]  # A-Z as a-z


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, from prefix sums: quick, and collisions of very long words do no harm here."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    starts, ends = texts.word_spans(data, offsets)
    up, down = _Powers.of(len(data))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    hashes = texts.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def _terms(word: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms (hash buckets of words) of the texts one after another, their counts, and the offsets of the texts."""
    pairs, counts = np.unique((row.astype(_U) << _U(32)) | (word & _U(BUCKETS - 1)), return_counts=True)
    bounds = np.searchsorted(pairs, np.arange(rows + 1, dtype=_U) << _U(32))
    return (pairs & _U(0xFFFFFFFF)).astype(np.int64), counts, bounds


def _statistics(text: str):
    """(kind, key, n): documents that hold a term (0), characters by sketch (1), documents and words of all texts (2, 3)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        documents = total = 0
        for part in texts.chunks(batches, text):
            data, offsets = texts.raw(part.column(0))
            rows = part.num_rows
            word, row = _words(data, offsets)
            held += np.bincount(_terms(word, row, rows)[0], minlength=BUCKETS)
            documents, total = documents + rows, total + len(word)
            sketch, sizes = _sketch(*texts.shingles(word, row, rows, SKETCH_WORDS), rows), np.diff(offsets) + 1
            keys, same = np.unique(sketch, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), pa.array(keys.view(np.int64)), pa.array(np.bincount(same, sizes).astype(np.int64))], ["kind", "key", "n"])
        some = np.flatnonzero(held)
        keys, n = np.concatenate([some, [0, 0]]), np.concatenate([held[some], [documents, total]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(len(some), np.int32), np.array([2, 3], np.int32)])), pa.array(keys), pa.array(n)], ["kind", "key", "n"])

    return run


def _place(shared, parts: int):
    """Id and text, and with them the sketch and the partition: that of the sketch, hot sketches by id too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, shares = shared.value
        for part in texts.chunks(batches, "text"):
            data, offsets = texts.raw(part.column("text"))
            rows = part.num_rows
            sketch = _sketch(*texts.shingles(*_words(data, offsets), rows, SKETCH_WORDS), rows)
            ids = np.array([0 if i is None else i for i in part.column("doc_id").to_pylist()], np.int64).view(_U)
            share = np.zeros(rows, _U)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, sketch), len(hot) - 1)
                share = np.where(hot[at] == sketch, texts.mix(ids + _U(1)) % shares[at], 0).astype(_U)
            target = (texts.mix(sketch + share * _U(0x9E3779B97F4A7C15)) >> _U(16)) % _U(parts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(sketch.view(np.int64)), pa.array(target.astype(np.int32))], ["doc_id", "text", "sketch", "part"])

    return run


class Coder:
    """Token ids of a byte-level vocabulary (its JSON text); equal to the tokenizers library's, special strings included."""

    def __init__(self, source: str):
        import tiktoken

        spec = json.loads(source)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: i for i, c in enumerate(byte_characters())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = list(special)
        self.encoding, self.plain = (tiktoken.Encoding("packing", pat_str=p, mergeable_ranks=ranks, special_tokens=special) for p in (PIECES, PLAIN_PIECES))

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):  # blanks before a special string end a text
            ids = self.encoding.encode_to_numpy(text, allowed_special="all")
        else:
            cuts = [0, *(m.end() for m in _CUT.finditer(text)), len(text)]
            ids = [self.plain.encode_to_numpy(text[a:b], disallowed_special=()) for a, b in zip(cuts, cuts[1:])]
            ids = ids[0] if len(ids) == 1 else np.concatenate(ids)
        return np.append(ids, np.uint32(0))


@dataclass
class Shard:
    """Some documents with an inverted index of their terms; neighbours are looked up among the unused ones."""

    terms: list[np.ndarray]
    counts: list[np.ndarray]
    idf: np.ndarray
    average: float
    unused: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.terms)
        self.unused = np.ones(n, bool)
        term = np.concatenate(self.terms)
        count = np.concatenate(self.counts)
        doc = np.repeat(np.arange(n), [len(t) for t in self.terms])
        length = np.array([c.sum() for c in self.counts], float)
        weight = self.idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[doc] / self.average))
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.vocabulary, self.starts = np.unique(term[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(term))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's distinct terms."""
        at = np.searchsorted(self.vocabulary, self.terms[seed])
        starts, sizes = self.starts[at], self.ends[at] - self.starts[at]
        postings = np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(at) else np.zeros(0, np.int64)
        return np.bincount(self.docs[postings], self.weights[postings], minlength=len(self.terms))

    def ranked(self, seed: int) -> np.ndarray:
        """The unused documents, best neighbour of the seed first, ties by place."""
        left = np.flatnonzero(self.unused)
        scores = self.scores(seed)[left]
        return left[np.argsort(-scores, kind="stable")]


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    sequence: int
    offset: int


class Packer:
    """Windows of one task, filled one after another."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.sequence = self.fill = 0
        self.pieces: list[Piece] = []

    def put(self, doc_id: int | None, tokens: np.ndarray, start: int = 0) -> int:
        """A document's tokens from ``start`` on into the window at hand; how many fitted."""
        n = min(len(tokens) - start, self.window - self.fill)
        self.pieces.append(Piece(doc_id, start, tokens[start : start + n], len(tokens), self.sequence, self.fill))
        self.fill += n
        if self.fill == self.window:
            self.sequence, self.fill = self.sequence + 1, 0
        return n

    def pack(self, shard: Shard, ids: list[int | None], tokens: list[np.ndarray]) -> None:
        """All documents of a shard: a seed, and its neighbours while its last window has room.
        A neighbour that does not fit is cut and is the seed of the next window."""
        for first in range(len(tokens)):
            seed = first if shard.unused[first] else -1
            while seed >= 0:
                shard.unused[seed] = False
                at = 0
                while at < len(tokens[seed]):
                    at += self.put(ids[seed], tokens[seed], at)
                neighbours = shard.ranked(seed).tolist() if self.fill else []
                seed = -1
                for best in neighbours:
                    if len(tokens[best]) > self.window - self.fill:
                        seed = best
                        break
                    shard.unused[best] = False
                    self.put(ids[best], tokens[best])
                    if not self.fill:
                        break

    def finished(self) -> list[Piece]:
        """The pieces of full windows, which are handed out once."""
        full = [p for p in self.pieces if p.sequence < self.sequence]
        self.pieces = [p for p in self.pieces if p.sequence == self.sequence]
        return full

    def finish(self) -> list[Piece]:
        """The rest: the window that is not full is cut into sequences of powers of two, which need no padding."""
        out, left = self.finished(), self.fill
        at, room = 0, 0
        for p in self.pieces:
            start = 0
            while start < len(p.ids):
                if not room:
                    at, room = 0, 1 << (left.bit_length() - 1)
                    left -= room
                n = min(room, len(p.ids) - start)
                out.append(Piece(p.doc_id, p.start + start, p.ids[start : start + n], p.doc_tokens, self.sequence, at))
                start, at, room = start + n, at + n, room - n
                self.sequence += not room
        self.pieces, self.fill = [], 0
        return out


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(shared, shard_tokens: int):
    """All pieces of the documents of a task, in shards of consecutive documents."""

    def rows(pieces: list[Piece], base: int) -> pa.RecordBatch:
        found = [(p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, base + p.sequence, p.offset) for p in pieces]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(7)], [c.split()[0] for c in PIECE.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "coder" not in held:
            held["coder"] = Coder(held["source"])
        packer = Packer()
        base = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        terms: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0
        for part in texts.chunks(batches, "text"):
            term, count, bounds = _terms(*_words(*texts.raw(part.column("text"))), part.num_rows)
            for i, (doc_id, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())):
                ids.append(doc_id)
                tokens.append(held["coder"](text or ""))
                terms.append(term[bounds[i] : bounds[i + 1]])
                counts.append(count[bounds[i] : bounds[i + 1]])
                size += len(tokens[-1])
                if size >= shard_tokens:
                    packer.pack(Shard(terms, counts, held["idf"], held["average"]), ids, tokens)
                    yield rows(packer.finished(), base)
                    ids, tokens, terms, counts, size = [], [], [], [], 0
        if ids:
            packer.pack(Shard(terms, counts, held["idf"], held["average"]), ids, tokens)
        yield rows(packer.finish(), base)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, part_chars: int = PART_CHARS) -> DataFrame:
    """The pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents packed into windows of 1024 tokens.

    A document is its ids by the byte-level vocabulary file ``tokenizer`` and one id 0. Documents are dealt to
    tasks by their least shingle of five words, so that texts with much in common meet; the documents of a sketch that
    is more than a part's share are dealt by id too. A task sorts its documents and indexes them shard by shard
    (``shard_tokens`` each). A seed fills windows; while its last one has room, the unused document of the highest BM25 score
    for all the seed's terms comes next, ties and documents without common terms in order. One that does not fit is
    cut and goes on as the next seed, so every window is full. A task's last one is cut into sequences of
    powers of two. Document frequencies and mean length are of the whole table (terms are
    hash buckets of words).

    A null or empty text is one id; a null id stays null; repeated rows are documents of their own. Other columns are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = ws.save(given.select("text").mapInArrow(_statistics("text"), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    totals = {r.kind: r.n for r in found.filter("kind > 0").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    documents, words, size = (totals.get(k, 0) for k in (2, 3, 1))
    table = found.filter("kind = 0").select("key", "n").toPandas()  # one row a bucket at most
    df = np.zeros(BUCKETS)
    df[table["key"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    idf = np.log1p((documents - df + 0.5) / (df + 0.5))
    limit = max(part_chars // 8, size // MOST_HOT)
    hot = found.filter("kind = 1").filter(F.col("n") > limit).select("key", "n").toPandas()  # MOST_HOT rows at most
    keys, shares = hot["key"].to_numpy(np.int64).view(_U), -(-hot["n"].to_numpy(np.int64) // limit)
    order = np.argsort(keys)
    parts = max(1, -(-size // part_chars))
    dealt = given.mapInArrow(_place(spark.sparkContext.broadcast((keys[order], shares[order].astype(_U))), 8 * parts), "doc_id long, text string, sketch long, part int")
    near = dealt.repartition(parts, "part").sortWithinPartitions("part", "sketch", "doc_id", "text").select("doc_id", "text")
    shared = spark.sparkContext.broadcast({"source": Path(tokenizer).read_text(), "idf": idf, "average": max(1.0, words / max(1, documents))})
    return near.mapInArrow(_pack(shared, shard_tokens), PIECE)
