"""Phrase collocations by growing frequent phrases to the right, depth first, on projected occurrences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.workspace import Workspace
from . import texts

LONGEST = 5
UNKNOWN = "und"

#: Words that have a code of their own in every task, about 25 MB; the others are carried as hashes.
CODED_WORDS = 2_000_000
#: Occurrences that a task grows phrases from at a time; words that are more frequent are split by what follows them.
RANGE_WORDS = 1 << 19
BLOCK_BYTES = 2_500_000
BUCKETS = 64

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_ESCAPE = np.uint32(1 << 31)
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [*range(10, 14)]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Block:
    """The words of some texts: key (hash of language and word), piece, and where each stands."""

    def __init__(self, batch: pa.RecordBatch, text: str, lang: str):
        self.data, offsets = texts.raw(batch.column(text))
        self.starts, self.ends = texts.word_spans(self.data, offsets, _OUTSIDE) if len(self.data) else (np.zeros(0, np.int64),) * 2
        coded = batch.column(lang).cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        row = np.searchsorted(offsets, self.starts, "right") - 1
        self.lang = coded.indices.to_numpy()[row]
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], _U)
        self.keys = texts.mix(texts.word_hashes(self.data, self.starts, self.ends, _OUTSIDE) + seeds[self.lang]) if len(row) else np.zeros(0, _U)
        broken = np.cumsum(_BREAK[self.data])[self.starts] if len(row) else row
        self.piece = np.cumsum(np.concatenate([[0], (np.diff(row) != 0) | (np.diff(broken) != 0)])) if len(row) else row

    def words(self, at: np.ndarray) -> pa.Array:
        """The lower-cased words at these places."""
        lengths = self.ends[at] - self.starts[at]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        take = np.arange(offsets[-1]) + np.repeat(self.starts[at] - offsets[:-1], lengths)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWER[self.data[take]])).cast(pa.string())


def _count_words(text: str, lang: str):
    """(key, lang, word, n) of every distinct word of a block, and a row without word for the words of each language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts.chunks(batches, text, BLOCK_BYTES):
            block = _Block(part, text, lang)
            keys, at, n = np.unique(block.keys, return_index=True, return_counts=True)
            totals = np.bincount(block.lang, minlength=len(block.langs))
            names = pa.array(block.langs, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), names.take(pa.array(block.lang[at])), block.words(at), pa.array(n)], ["key", "lang", "word", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int64()), names, pa.nulls(len(names), pa.string()), pa.array(totals)], ["key", "lang", "word", "n"])

    return run


def _project(text: str, lang: str, shared, ranges: int):
    """(range, windows): every occurrence of a frequent word with up to four that follow it, packed by range.

    A window ends before the first infrequent word. Its range is that of its shortest prefix that holds
    a word which is not hot, so all windows of such a prefix are in one range, and no more
    than that word has occurrences. Equal windows of a block are one with a count.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes, hot, complete = shared.value
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in texts.chunks(batches, text, BLOCK_BYTES):
            block = _Block(part, text, lang)
            n = len(block.keys)
            if n < 2:
                continue
            place = np.minimum(np.searchsorted(known, block.keys), max(0, len(known) - 1))
            found = known[place] == block.keys if len(known) else np.zeros(n, bool)
            word = np.where(found, codes[place], 0).astype(np.uint32) if len(known) else np.zeros(n, np.uint32)
            is_hot = found & hot[place] if len(known) else found
            escaped = np.zeros(0, _U)
            if not complete and not found.all():
                escaped, local = np.unique(block.keys[~found], return_inverse=True)
                word[~found] = _ESCAPE + local.astype(np.uint32)
            at = np.flatnonzero((word[:-1] != 0) & (word[1:] != 0) & (block.piece[:-1] == block.piece[1:]))
            if not len(at):
                continue
            columns, prefix, whole = [word[at]], texts.mix(block.keys[at]), texts.mix(block.keys[at])
            inside, split = np.ones(len(at), bool), is_hot[at]
            for j in range(1, LONGEST):
                next_ = np.minimum(at + j, n - 1)
                inside &= (at + j < n) & (block.piece[next_] == block.piece[at]) & (word[next_] != 0)
                columns.append(np.where(inside, word[next_], 0).astype(np.uint32))
                longer = texts.mix(whole * _GOLDEN + block.keys[next_])
                whole = np.where(inside, longer, whole)
                prefix = np.where(inside & split, longer, prefix)
                split &= inside & is_hot[next_]
            _, first, times = np.unique(whole, return_index=True, return_counts=True)
            in_range = ((prefix[first] >> _U(20)) % _U(ranges)).astype(_U)
            order = np.argsort((in_range << _U(32)) | columns[0][first])
            first, in_range = first[order], in_range[order]
            table = np.stack([c[first] for c in columns] + [times[order].astype(np.uint32)])
            cuts = np.flatnonzero(np.diff(in_range, prepend=in_range[0] + _U(1)))
            rows: dict[str, list] = {"range": [], "size": [], "windows": [], "escaped": []}
            for a, b in zip(cuts, [*cuts[1:], len(first)], strict=True):
                piece = table[:, a:b]
                own = np.zeros(0, _U)
                if len(escaped):  # only the hashes that this piece names, numbered anew
                    mask = piece[:LONGEST] >= _ESCAPE
                    used, again = np.unique(piece[:LONGEST][mask] - _ESCAPE, return_inverse=True)
                    piece = piece.copy()
                    piece[:LONGEST][mask] = _ESCAPE + again.astype(np.uint32)
                    own = escaped[used]
                rows["range"].append(int(in_range[a]))
                rows["size"].append(int(b - a))
                # bytes of the same weight stand together, which packs well
                rows["windows"].append(pack(np.ascontiguousarray(np.ascontiguousarray(piece).view(np.uint8).reshape(len(piece), b - a, 4).transpose(0, 2, 1)).tobytes()))
                rows["escaped"].append(own.tobytes())
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("range", pa.int64()), ("size", pa.int64()), ("windows", pa.binary()), ("escaped", pa.binary())]))

    return run


def _grow(least: int, shared):
    """(words, a, hot) of the phrases of one range: those of hot words alone have a share of their occurrences here."""

    def run(pieces: pa.Table) -> pa.Table:
        known, codes, hot, _ = shared.value
        by_code = np.zeros(len(known) + 1, np.int64)
        by_code[codes] = known.view(np.int64)
        hot_code = np.zeros(len(known) + 1, bool)
        hot_code[codes] = hot
        unpack = zstandard.ZstdDecompressor().decompress
        tables, escapes, shift = [], [], 0
        for row in pieces.select(["size", "windows", "escaped"]).to_pylist():
            m = row["size"]
            planes = np.frombuffer(unpack(row["windows"]), np.uint8).reshape(-1, 4, m)
            table = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint32).reshape(-1, m).copy()
            escaped = np.frombuffer(row["escaped"], np.int64)
            if len(escaped):
                table[:LONGEST][table[:LONGEST] >= _ESCAPE] += np.uint32(shift)
                escapes.append(escaped)
                shift += len(escaped)
            tables.append(table)
        *columns, times = np.concatenate(tables, axis=1)
        times = times.astype(np.int64)
        if escapes:  # one code a word, whichever piece it came with
            distinct, same = np.unique(np.concatenate(escapes), return_inverse=True)
            by_code = np.concatenate([by_code, distinct])
            hot_code = np.concatenate([hot_code, np.zeros(len(distinct), bool)])
            for c in columns:
                mask = c >= _ESCAPE
                c[mask] = len(known) + 1 + same[c[mask] - _ESCAPE]
        found: list[list[int]] = []
        counts: list[int] = []
        shares: list[bool] = []
        stack = [(np.arange(len(times)), (), True)]
        while stack:
            pointers, prefix, all_hot = stack.pop()
            word = columns[len(prefix)][pointers]
            if prefix:
                pointers, word = pointers[word != 0], word[word != 0]
            if not len(word):
                continue
            order = np.argsort(word, kind="stable")
            pointers, word = pointers[order], word[order]
            cuts = np.flatnonzero(np.diff(word, prepend=word[0] + np.uint32(1)))
            sums, heads = np.add.reduceat(times[pointers], cuts), word[cuts]
            ends = np.append(cuts[1:], len(word))
            partial = hot_code[heads] if all_hot else np.zeros(len(heads), bool)
            for i in np.flatnonzero((sums >= least) | partial).tolist():
                phrase = (*prefix, int(heads[i]))
                if prefix:
                    found.append([int(by_code[w]) for w in phrase])
                    counts.append(int(sums[i]))
                    shares.append(bool(partial[i]))
                if len(phrase) < LONGEST:
                    stack.append((pointers[cuts[i] : ends[i]], phrase, bool(partial[i])))
        return pa.table({"words": pa.array(found, pa.list_(pa.int64())), "a": pa.array(counts, pa.int64()), "hot": pa.array(shares, pa.bool_())})

    return run


def frequent_phrases(docs: DataFrame, ws: Workspace, least: int = 100, text_col: str = "text", lang_col: str = "lang", coded: int = CODED_WORDS, range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): the frequent words (key, lang, word, n; without word: all words of the language), and the
    frequent phrases of 2 to 5 words (words as keys, a)."""
    spark = docs.sparkSession
    given = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = given.mapInArrow(_count_words("text", "lang"), "key long, lang string, word string, n long")
    words = ws.save(counts.groupBy("key", "lang", "word").agg(F.sum("n").alias("n")).filter(f"word is null or n >= {least}"))
    total = words.filter("word is null").agg(F.sum("n")).first()[0] or 0
    # the most frequent words have codes: as many whole powers of two of frequency as fit
    sizes = sorted(words.filter("word is not null").groupBy(F.length(F.bin("n")).alias("bits")).count().collect(), reverse=True)
    held, floor = 0, 65
    for bits, n in sizes:
        if held + n > coded:
            break
        held, floor = held + n, bits
    complete = held == sum(n for _, n in sizes)
    table = words.filter(F.col("word").isNotNull() & (F.length(F.bin("n")) >= floor)).select("key", "n").toPandas()
    keys, n = table["key"].to_numpy(np.int64).view(_U), table["n"].to_numpy(np.int64)
    codes = np.empty(len(keys), np.uint32)
    codes[np.lexsort((keys, -n))] = np.arange(1, len(keys) + 1, dtype=np.uint32)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], codes[order], (n > range_words)[order], complete))
    ranges = max(1, -(-total // range_words))
    windows = given.mapInArrow(_project("text", "lang", shared, ranges), "range long, size long, windows binary, escaped binary")
    grown = ws.save(windows.groupBy("range").applyInArrow(_grow(least, shared), "words array<long>, a long, hot boolean"))
    summed = grown.filter("hot").groupBy("words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return words, ws.save(grown.filter("not hot").select("words", "a").union(summed))



def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", coded: int = CODED_WORDS, range_words: int = RANGE_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to 5 words of each language.

    A phrase has ``least`` occurrences or more within pieces of text. Its score is floor(1000 a n / (l r)) of its
    weakest cut, ties to the first; phrases inside a longer one that is as frequent are left out.

    Words are counted first, and infrequent ones end the windows. Every occurrence of a frequent word is
    then sent with its next four words to the task of its prefix, which groups its pointers by
    the next word, drops what is too rare and goes on depth first. A hot word's occurrences are dealt by what
    follows it too, until a word is not hot; counts of phrases of hot words alone are sums over tasks.
    Words are equal by 64-bit hashes of language and word.

    A null or empty text has no words, a null language is ``und``, repeated rows count each. The
    columns may have any names besides; others are not read. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "phrases")
    words, phrases = frequent_phrases(docs, ws, least, text_col, lang_col, coded, range_words)
    totals = words.filter("word is null").select("lang", F.col("n").alias("n"))
    single = words.filter("word is not null").select(F.array("key").alias("words"), F.col("n").alias("a"))
    counted = phrases.union(single)
    longer = phrases.filter(F.size("words") > 2)
    parts = F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))
    covered = longer.select("a", F.explode(parts).alias("words")).distinct()
    kept = ws.save(phrases.join(covered, ["words", "a"], "left_anti").withColumn("lang_key", F.col("words")[0]))
    cut = kept.select("words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    sides = cut.withColumn("left", F.expr("slice(words, 1, k)")).withColumn("right", F.expr("slice(words, k + 1, size(words) - k)"))
    sides = sides.join(counted.withColumnsRenamed({"words": "left", "a": "l"}), "left").join(counted.withColumnsRenamed({"words": "right", "a": "r"}), "right").select("words", "a", "k", "l", "r")
    languages = words.filter("word is not null").select(F.col("key").alias("lang_key"), "lang")
    named = sides.withColumn("lang_key", F.col("words")[0]).join(languages, "lang_key").join(totals, "lang")
    score = F.expr("(1000BD * cast(a as decimal(18,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = named.withColumn("score", score).groupBy("words", "lang").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    scored = ws.save(best.select("words", "lang", "best.a", "best.l", "best.r", "best.n", "best.score"))
    spelled = scored.select("words", F.posexplode("words").alias("at", "key")).join(words.filter("word is not null").select("key", "word"), "key")
    spelled = spelled.groupBy("words").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ").alias("phrase"))
    full = scored.join(spelled, "words").withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of each bucket, then the first of those
    few = full.withColumn("place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
