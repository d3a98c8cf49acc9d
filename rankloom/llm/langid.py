"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import texts
from ..operators.workspace import Workspace

UNDETERMINED = "und"
#: Buckets of n-grams; the model has so many numbers for each language.
BUCKETS = 1 << 16
#: Bytes of text worked on at once; each makes about 150 bytes of arrays.
CHUNK_BYTES = 500_000
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages of a model at most, those with the most texts; each takes a quarter of a megabyte.
MAX_LANGUAGES = 512

_U = np.uint64
_OTHER = re.compile(r"[\W\d_]+")


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the row of each, and whether a row has a letter.

    Letters are lower-cased; every run of other characters counts as one space,
    and a text is taken to begin and end with one.
    """
    rows = [" ".join(_OTHER.sub(" ", t.lower()).split()) for t in column.fill_null("").to_pylist()]
    letters = np.array([any(map(str.isalpha, r)) for r in rows])
    points = np.frombuffer("".join(f" {r} " for r in rows).encode("utf-32-le"), np.uint32).astype(_U)
    lengths = np.array([len(r) + 2 for r in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    buckets, at = [], []
    for order in ORDERS:
        if len(points) < order:
            continue
        key = np.full(len(points) - order + 1, order, _U)
        for i in range(order):
            key = key * _U(0x9E3779B97F4A7C15) + points[i : len(key) + i]
        same = row[: len(key)] == row[order - 1 :]
        buckets.append((texts.mix(key)[same] >> _U(48)).astype(np.int64) % BUCKETS)
        at.append(row[: len(key)][same])
    return np.concatenate(buckets), np.concatenate(at), letters


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages, and their log-probabilities of each bucket with the log prior in the last row.

    Counts cover every whole text with a language.  Tasks add up their own rows
    first, so that the shuffle carries at most one row for each task, language
    and bucket; the result has BUCKETS numbers a language whatever the input.
    Of more than ``languages`` label values those with the most texts are learned, of equal ones the first by name.
    """
    ws = Workspace(labelled.sparkSession, "langid")
    given = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in texts.chunks(batches, size=CHUNK_BYTES):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            bucket, row, _ = _grams(part.column("text"))
            counts = np.bincount(code[row] * (BUCKETS + 1) + bucket, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), BUCKETS + 1)
            counts[:, BUCKETS] = np.bincount(code, minlength=len(names))  # texts
            for name, c in zip(names, counts, strict=True):
                totals[name] = totals[name] + c if name in totals else c
        for name, c in totals.items():
            full = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full), pa.array(c[full])], ["lang", "bucket", "n"])

    counted = ws.save(given.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    known = counted.filter(F.col("bucket") == BUCKETS).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    found = counted.join(F.broadcast(known), "lang", "left_semi").groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).collect()
    ws.close()
    found.sort(key=lambda r: r["lang"])
    counts = np.zeros((BUCKETS + 1, len(found)))
    for i, r in enumerate(found):
        counts[r["bucket"], i] = r["n"]
    grams, docs = counts[:BUCKETS] + SMOOTHING, counts[BUCKETS]
    matrix = np.vstack([np.log(grams / grams.sum(axis=0)), np.log(docs / docs.sum())]) if found else counts
    return [r["lang"] for r in found], matrix.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the most probable language of each whole text and its posterior probability.

    ``und`` with score 0 where the text is null, has no letter, or nothing was
    learned.  Languages as probable as each other: the first by name.  Only the
    text is read; columns already named like the two new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        values = np.array([*names, UNDETERMINED], object)
        for part in texts.chunks(batches, text_col, CHUNK_BYTES):
            best = np.full(part.num_rows, len(names))
            score = np.zeros(part.num_rows)
            if names:
                bucket, row, letters = _grams(part.column(text_col))
                log = np.column_stack([np.bincount(row, matrix[bucket, i], part.num_rows) for i in range(len(names))]) + matrix[-1]
                top = log.max(axis=1)
                best = np.where(letters, log.argmax(axis=1), best)
                score = np.where(letters, 1 / np.exp(log - top[:, None]).sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values[best], pa.string()), pa.array(score)], [*part.schema.names, *out])

    docs = docs.drop(*out)
    return docs.mapInArrow(run, docs.withColumn(out[0], F.lit("").cast("string")).withColumn(out[1], F.lit(0.0)).schema)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with held_out, lang_pred and score; learns from the rows that are not held out and have a language."""
    marked = docs.withColumn("held_out", held_out(id_col))
    return predict(marked, train(marked.filter("not held_out")))
