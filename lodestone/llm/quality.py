"""Quality classifier: hashed word n-gram logistic regression, learned by FTRL-proximal.

Features are hashed counts of words, word pairs, word shapes and pairs of
shapes; a shape tells a word's case, punctuation, digits and length, and
whether it repeats the word before. The counts are damped and each text's
vector has length one. A score is the sigmoid of a sparse dot product.

The model learns from at most `sample` labelled rows, those with the least
hash of their id, in one task of bounded size; all texts are scored whole.
Nulls and empty texts have the bias feature only. Without labels all scores are
a half. Several labels of a document count as several rows, and so do repeated
documents; equal rows score alike. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free, release, releasing, remainder, small_batches, whole

BITS = 18
SAMPLE = 8192
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-6, 1e-5
THRESHOLD = 0.3
FOLDS = 5
#: Words whose hashes a task remembers, and words of a text handled at a time.
_REMEMBERED, _PART = 50_000, 1 << 18

_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


_STRANGE = re.compile(r"[\W_]")
_DIGIT = re.compile(r"\d")


def _case(core: str) -> int:
    return 0 if core.islower() else 1 if core.istitle() else 2 if core.isupper() else 3


def _shape(word: str) -> int:
    size = min(len(word).bit_length(), 6)
    if word.isalpha():
        return _case(word) + 5 * 48 * size
    core = word.strip(".,;:!?\"'()[]")
    tail = word[len(word.rstrip(".,;:!?")) :]
    end = 0 if not tail else 1 if tail in ".," else 2 if "!" in tail or "?" in tail else 3
    if core.isalpha():
        return _case(core) + 5 * (end + 48 * size)
    digits = 2 if core.isdigit() else int(bool(_DIGIT.search(core)))
    odd = int(not core) + 2 * int(bool(_STRANGE.search(core)))
    return 4 + 5 * (end + 4 * (digits + 3 * (odd + 4 * size)))


class _Words(dict):
    """Word to its hash, with the shape in the upper bits; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) | _shape(word) << 32
        return h


_words = _Words()


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their values; feature 0 is the bias."""
    known = _words.__getitem__
    tokens = text.split()
    found = []
    for at in range(0, len(tokens), _PART):  # one word of overlap: pairs across the cut count
        ids = np.fromiter(map(known, tokens[max(at - 1, 0) : at + _PART]), _U)
        word, shape = ids & _U(0xFFFFFFFF), ids >> _U(32)
        again = (ids[1:] == ids[:-1]).astype(_U)
        alone = slice(1 if at else 0, None)
        hashed = [
            word[alone] * _MIX[0], word[:-1] * _MIX[1] + word[1:] * _MIX[2],
            (shape[alone] + _U(1)) * _MIX[3], (shape[:-1] * _U(2) + again) * _MIX[4] + (shape[1:] + _U(1)) * _MIX[5],
        ]
        found.append(np.concatenate(hashed) * _MIX[0] >> _U(64 - bits))
    if not found:
        return np.zeros(1, np.int64), np.ones(1)
    at, counts = np.unique(np.concatenate(found), return_counts=True)
    values = np.log1p(counts)
    at = at.astype(np.int64)
    return np.append(at[at > 0], 0), np.append(values[at > 0] / np.sqrt((values * values).sum()), 0.3)


class Ftrl:
    """Follow-the-regularised-leader, per coordinate, for log loss."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[str, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (text, label) rows, in an order that depends on the rows alone."""
    made = []
    for t, y in rows:
        at, x = features(t, bits)
        made.append((at.astype(np.int32), x.astype(np.float32), y))
    model = Ftrl(1 << bits)
    for epoch in range(epochs):
        for i in np.random.Generator(np.random.PCG64(epoch)).permutation(len(made)):
            model.learn(*made[i])
    return model.weights(np.arange(1 << bits)).astype(np.float32)


def _fit_task(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rows.sort()
        yield pa.record_batch([pa.array([fit(rows, bits, epochs).tobytes()])], ["weights"])

    return run


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:  # noqa: A002
    """Weights learned from labelled texts outside the held-out fold (see FOLDS)."""
    small_batches(docs.sparkSession)
    rows = labels.select(F.col(id).alias("__i"), F.col(label).cast("int").alias("__y"))
    rows = rows.filter(F.col("__y").isin(0, 1) & F.col("__i").isNotNull() & (remainder("__i", FOLDS) != 0))
    rows = rows.orderBy(F.xxhash64(F.col("__i").cast("string")), "__i", "__y").limit(sample)
    texts = docs.select(F.col(id).alias("__j"), whole(text).alias("__t")).join(F.broadcast(rows), F.col("__i") == F.col("__j"))
    made = texts.select("__t", "__y").repartition(1).mapInArrow(releasing(_fit_task(bits, epochs)), "weights binary").collect()
    return np.frombuffer(made[0][0], np.float32) if made else np.zeros(1 << bits, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of label 1; a column of that name is an error. The model is broadcast: its size is fixed."""
    free(docs, name)
    small_batches(docs.sparkSession)
    bits = int(len(weights)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def f(texts: pa.Array) -> pa.Array:
        w, out = shared.value, []
        for t in texts:
            at, x = features(t.as_py(), bits)
            out.append(float(1 / (1 + np.exp(-(w[at] @ x)))))
        release()
        return pa.array(out, pa.float64())

    return docs.withColumn(name, f(whole(text)))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of documents; a fifth of the labels is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, weights).withColumn("held_out", remainder("doc_id", FOLDS) == 0)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
