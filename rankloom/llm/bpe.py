"""Byte-level BPE with word ends: encoding by forced boundaries, and decoding."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts

#: Fixed values of the file format: its word pattern, its white space and the characters that stand for bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
SPACE = "[\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]

#: Words whose ids a worker remembers, about 100 MB; beyond it the memory starts anew.
WORD_CACHE = 350_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    other = iter(range(256, 512))
    return [chr(b if b in set(PRINTABLE) else next(other)) for b in range(256)]


class Coder:
    """Encodes and decodes with one tokenizer file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in (self.ids | self.special).items()}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_begins = {t[0] for t in self.special if t}
        self.pattern = regex.compile(WORDS.replace(r"\s", SPACE[1:-1]))
        self.characters = byte_characters()
        bare = [t.removesuffix(self.suffix) for t in self.ids]
        self.inside = {pair for t in bare for pair in zip(t, t[1:])}
        self.words = _Words(self._encode_word)
        self.fragments: dict[str, list[int]] = {}

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if any(c in text for c in self.special_begins):
            parts = self.special_pattern.split(text)
        else:
            parts = [text]
        found = []
        for i, part in enumerate(parts):
            if i % 2:
                found.append(np.array([self.special[part]], np.int32).tobytes())
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part)
                found += map(self.words.__getitem__, self.pattern.findall(part.replace("Σ", "σ").lower()))  # white space is in no word
        if len(self.words) + len(self.fragments) > WORD_CACHE:
            self.words.clear()
            self.fragments.clear()
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.texts.__getitem__, ids))

    def _encode_word(self, word: str) -> bytes:
        characters = "".join(self.characters[b] for b in word.encode())
        cuts = [0, *(i for i in range(1, len(characters)) if (characters[i - 1], characters[i]) not in self.inside), len(characters)]
        if len(cuts) == 2:
            return np.array(self._merge(characters, True), np.int32).tobytes()
        ids: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            fragment = characters[a:b] + (self.suffix if b == len(characters) else "")
            if fragment not in self.fragments:
                self.fragments[fragment] = self._merge(characters[a:b], b == len(characters))
            ids += self.fragments[fragment]
        return np.array(ids, np.int32).tobytes()

    def _merge(self, characters: str, last: bool) -> list[int]:
        """Merge pairs of the least rank, leftmost first, until none is left."""
        parts: list[str | None] = list(characters)
        if last:
            parts[-1] += self.suffix
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        queue = [(ranks[pair], i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if parts[i] != pair[0] or j < 0 or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = pair[0] + pair[1], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (pair := (parts[i], parts[k])) in ranks:
                    heapq.heappush(queue, (ranks[pair], i, pair))
            h = before[i]
            if h >= 0 and (pair := (parts[h], parts[i])) in ranks:
                heapq.heappush(queue, (ranks[pair], h, pair))
        return [self.ids[p] for p in parts if p is not None]


class _Words(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encode(word)
        return ids


def _coder(shared) -> Coder:
    """One coder for each Python worker, kept beside the file's text."""
    held = shared.value
    if "coder" not in held:
        held["coder"] = Coder(held["source"])
    return held["coder"]


def _with_column(part: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, name])


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each whole text in ``ids_col`` (array<int>), as the tokenizers
    library gives them for the file ``tokenizer`` without special tokens added; with ``decoded_col``
    also what bpe_decode() makes of the ids, in the same pass.

    Where two bytes of a word stand together in no vocabulary token, no merge can
    ever join them: the word is cut there, the fragments are encoded on their own
    and their ids follow one another.  Rows stay where they are; nothing is
    shuffled.  The file (a fixed vocabulary) is broadcast as its text.

    A null text counts as empty; an empty text has no ids.  Other columns stay; a
    column already named ``ids_col`` is replaced.  Strings of special tokens in a
    text become their ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"source": Path(tokenizer).read_text()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for part in texts.chunks(batches, text_col):
            rows = [coder.encode(t or "") for t in part.column(text_col).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            out = _with_column(part, ids_col, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows))))
            yield _with_column(out, decoded_col, pa.array([coder.decode(r.tolist()) for r in rows], pa.string())) if decoded_col else out

    docs = docs.drop(ids_col, decoded_col) if decoded_col else docs.drop(ids_col)
    schema = docs.withColumn(ids_col, F.lit(None).cast("array<int>"))
    return docs.mapInArrow(run, (schema.withColumn(decoded_col, F.lit(None).cast("string")) if decoded_col else schema).schema)


def bpe_decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text of ``ids_col`` in ``decoded_col``.

    The file names no decoder, so the tokens' own strings are joined by spaces,
    special tokens included.  Null ids decode to an empty text; an id outside
    the vocabulary is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast({"source": Path(tokenizer).read_text()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                column = part.column(ids_col)
                ids, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().fill_null(0))
                decoded = [coder.decode(ids[a:b].tolist()) for a, b in zip([0, *ends[:-1]], ends)]
                yield _with_column(part, decoded_col, pa.array(decoded, pa.string()))

    encoded = encoded.drop(decoded_col)
    return encoded.mapInArrow(run, encoded.withColumn(decoded_col, F.lit(None).cast("string")).schema)
