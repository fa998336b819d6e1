"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

An n-gram's ratio compares how many toxic and how many other labelled documents
have it.  A document is the set of its n-grams (hashed to 2**BITS buckets), each
with its ratio as value, scaled to length one; a logistic regression weighs them.
Ratios come from all labelled rows; the regression is fitted on every n-gram of a
bounded sample of rows.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.sized import join_small
from loomwork.storage import checkpointed

SIZES = (4, 5)
BITS = 18
#: Rows of each label that the regression is fitted on.
SAMPLE = {1: 1000, 0: 2000}
#: N-grams of the sample that are in the driver's memory at once, or those of one row if it has more.
BLOCK = 2**19
ROUNDS, PENALTY = 40, 1e-4


def grams(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's n-grams, ascending; lower case, runs of white space as one space."""
    plain = " " + " ".join((text or "").lower().split()) + " "
    x = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found = []
    for n in SIZES:
        m = len(x) - n + 1
        if m > 0:
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + x[k : k + m]
            found.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    if not found:
        return np.empty(0, np.int32)
    seen = np.zeros(2**BITS, bool) if len(x) > 30_000 else None
    if seen is None:
        return np.unique(np.concatenate(found)).astype(np.int32)
    seen[np.concatenate(found).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """score = logistic(weight . values + bias), the values being the ratios of a text's n-grams scaled to length one."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at = grams(text)
        value = self.ratio[at].astype(np.float64)
        length = np.sqrt((value * value).sum())
        z = self.bias + ((value * self.weight[at]).sum() / length if length else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What one task has seen: the documents of either label with each n-gram, a row for each bucket that occurs."""
    count = np.zeros((2, 2**BITS), np.int32)
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            count[int(label), grams(text)] += 1
    at = np.flatnonzero(count.any(axis=0))
    for x in range(0, len(at), 2**16):
        part = at[x : x + 2**16]
        yield pd.DataFrame({"bucket": part.astype(np.int32), "none": count[0, part], "some": count[1, part]})


def gram_counts(labelled: DataFrame) -> np.ndarray:
    """Two rows of 2**BITS counts: the documents of label 0 and of label 1 with each n-gram.

    Tasks count alone, and Spark adds up their buckets; the driver gets 2**BITS rows at most.
    """
    part = labelled.select("text", "label").mapInPandas(_counted, "bucket int, none int, some int")
    found = part.groupBy("bucket").agg(F.sum("none").alias("none"), F.sum("some").alias("some")).toPandas()
    out = np.zeros((2, 2**BITS), np.int64)
    out[0, found["bucket"]], out[1, found["bucket"]] = found["none"], found["some"]
    return out


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "at": [grams(t).astype(np.int32).tobytes() for t in batch["text"]]})


class _Vectors:
    """The n-grams of the sampled rows in a file of the driver, read in blocks of whole rows."""

    def __init__(self, rows: DataFrame, file: BinaryIO):
        found, end = [], 0
        for row in rows.toLocalIterator():
            at = bytes(row["at"])
            file.write(at)
            found.append((row["label"], row["doc_id"], len(at), zlib.crc32(at), end))
            end += len(at)
        found.sort()
        self.label = np.array([f[0] for f in found])
        self._file, self._size, self._start = file, [f[2] for f in found], [f[4] for f in found]

    def _read(self, k: int) -> np.ndarray:
        self._file.seek(self._start[k])
        return np.frombuffer(self._file.read(self._size[k]), np.int32)

    def blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Rows, and of each of their n-grams the row in the block and the bucket."""
        first = 0
        while first < len(self._size):
            last, total = first + 1, self._size[first]
            while last < len(self._size) and total + self._size[last] <= 4 * BLOCK:
                total += self._size[last]
                last += 1
            parts = [self._read(k) for k in range(first, last)]
            yield slice(first, last), np.repeat(np.arange(last - first), [len(p) for p in parts]), np.concatenate(parts)
            first = last


def _regression(sample: _Vectors, share: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of least penalised logistic loss, by adaptive gradient steps over the whole sample."""
    label = sample.label
    length = np.empty(len(label))
    for rows, row, at in sample.blocks():
        length[rows] = np.sqrt(np.bincount(row, ratio[at].astype(np.float64) ** 2, rows.stop - rows.start))
    scale = 1 / np.where(length > 0, length, 1)
    weight, bias = np.zeros(len(ratio), np.float32), float(np.log(max(share[label == 1].sum(), 1e-9) / max(share[label == 0].sum(), 1e-9)))
    step_w, step_b = np.full(len(ratio), 1e-8), 1e-8
    for _ in range(ROUNDS):
        slope, total = np.zeros(len(ratio)), 0.0
        scaled = ratio * weight
        for rows, row, at in sample.blocks():
            z = np.bincount(row, scaled[at], rows.stop - rows.start) * scale[rows] + bias
            miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[rows]) * share[rows]
            slope += np.bincount(at, (miss * scale[rows])[row], len(ratio))
            total += miss.sum()
        slope = slope * ratio + PENALTY * weight
        step_w += slope * slope
        weight -= (1.5 * slope / np.sqrt(step_w)).astype(np.float32)
        step_b += total**2
        bias -= 0.3 * total / np.sqrt(step_b)
    return weight, float(bias)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from the documents that labels has a row for.

    Of several labels of one doc_id the largest counts; null labels and null
    doc_ids don't.  With labels of one kind only, or none, every text gets the
    same score: the smoothed share of label 1.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marks = marks.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = checkpointed(marks)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = join_small(docs, marks, "doc_id")
    total = {row["label"]: row["k"] for row in labelled.groupBy("label").agg(F.count("*").alias("k")).collect()}
    if not total.get(0) or not total.get(1):
        odds = (total.get(1, 0) + 1) / (total.get(0, 0) + 1)
        return Model(np.zeros(2**BITS, np.float32), np.zeros(2**BITS, np.float32), float(np.log(odds)))
    none, some = gram_counts(labelled) + 1.0
    ratio = np.log((some / (total[1] + 2)) / (none / (total[0] + 2))).astype(np.float32)
    chosen = [marks.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in SAMPLE.items()]
    rows = docs.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").mapInPandas(_sampled, "doc_id long, label int, at binary")
    with tempfile.TemporaryFile() as file:
        sample = _Vectors(checkpointed(rows).coalesce(8), file)
        y = sample.label
        share = np.where(y == 1, total[1] / max((y == 1).sum(), 1), total[0] / max((y == 0).sum(), 1)) / (total[0] + total[1])
        weight, bias = _regression(sample, share, ratio)
    return Model(ratio, weight, bias)


def score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """documents with a column of that name: 0 to 1, higher for toxic; whole texts, a null text as an empty one.

    Other columns stay as they are; a column of that name is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 x 2**BITS numbers of 4 bytes

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(t) for t in batch], dtype="float64")

    return documents.withColumn(name, scored(F.col("text").cast("string")))


def held_out() -> F.Column:
    """Rows that no model learns from: crc32 of doc_id as text divides by five."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents, by a model of the labels that aren't held out.

    A null doc_id is not held out.  Repeated rows give repeated rows, empty
    tables an empty result; columns other than doc_id and text are not read.
    """
    model = fit(documents, labels.where(~held_out()))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = score(docs, model).drop("text")
    return rows.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of documents whose score is under the threshold, with the columns of documents, whatever their names."""
    name = max((c for c in documents.columns if c.lower().startswith("score")), key=len, default="score") + "_"
    kept = score(documents, fit(documents, labels.where(~held_out())), name).where(F.col(f"`{name}`") < threshold)
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])
