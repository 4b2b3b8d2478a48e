"""Supervised quality classifier on hashed word and character n-gram vectors.

A document's features are its words, its word pairs and its 3- to 5-byte strings, each
hashed to one of BUCKETS vectors. Their mean is the document vector, and a softmax on it
gives the class probabilities. Vectors and softmax are learned together by stochastic
gradient descent on a bounded sample of labelled rows, in numpy on the driver.

Scoring reads whole texts. As mean and output layer are linear, each bucket's vector can
be multiplied with the output layer once; a document then needs the mean of one number
per feature. That table (1 MB, fixed) is broadcast.

Null texts count as empty; a text without features is scored by the output's bias. With no
label, or one class only, every score is that class's share (0.5 without labels).
Labels and ids are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.llm.common import hashed_sample
from siftgate.plans.scratch import forget, written

BITS = 18
BUCKETS = 1 << BITS
DIM = 16
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 64_000_000
STEPS = 9_000
RATE = 8.0
THRESHOLD = 0.3
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SAME = np.uint64(0xD1B54A32D192ED03)
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _power(sign: int, n: int) -> np.ndarray:
    """Powers 0..n of the hash base, or of its inverse, modulo 2**64."""
    if len(_powers[sign]) <= n:
        base = np.full(max(n, 1 << 17) + 1, _BASE if sign > 0 else _BASE_INVERSE, np.uint64)
        base[0] = 1
        _powers[sign] = np.cumprod(base)
    return _powers[sign][: n + 1]


def features(text: bytes) -> np.ndarray:
    """Buckets of a text's words, word pairs and byte strings, repeats included."""
    b = np.frombuffer(text, np.uint8)
    n = len(b)
    if not n:
        return np.empty(0, np.int64)
    parts = []
    word = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if len(start):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(1, n)[:n])])
        h = (sums[end] - sums[start]) * _power(-1, n)[start]
        h = (h ^ (h >> np.uint64(29))) * _MIX
        pair = h[:-1] * _BASE + (h[1:] ^ (h[1:] >> np.uint64(31)))
        parts += [h, np.where(h[:-1] == h[1:], _SAME, pair)]
    wide = b.astype(np.uint64)
    string = wide[: n - 1] | wide[1:] << np.uint64(8) if n > 1 else wide[:0]
    for size in (3, 4, 5):
        if n < size:
            break
        string = string[: n - size + 1] | wide[size - 1 :] << np.uint64(8 * (size - 1))
        parts.append(string + np.uint64(size << 40))
    return ((np.concatenate(parts) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64) if parts else np.empty(0, np.int64)


@dataclass
class Model:
    """Bucket vectors, output layer and bias; `buckets` is their product, all that scoring needs."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def buckets(self) -> tuple[np.ndarray, float]:
        w = self.output[:, 1] - self.output[:, 0]
        return (self.vectors @ w).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(texts: list[bytes], labels: list[int], dim: int = DIM, steps: int = STEPS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document at a time, at a falling rate.

    Goes over the sample as often as it takes to make about `steps` steps.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output = np.zeros((dim, 2), np.float32)
    share = y.mean() if len(y) else 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    bias = np.log([1 - share, share]).astype(np.float32)
    if 0 < y.sum() < len(y):
        epochs = -(-steps // len(y))
        total, done = epochs * len(y), 0
        for _ in range(epochs):
            for i in rng.permutation(len(y)):
                step = rate * (1 - done / total)
                done += 1
                ids, times = np.unique(features(texts[i]), return_counts=True)
                if not len(ids):
                    continue
                weight = (times / times.sum()).astype(np.float32)
                hidden = weight @ vectors[ids]
                z = hidden @ output + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                back = output @ p
                output -= np.float32(0.05 * step) * np.outer(hidden, p)
                bias -= np.float32(0.001 * step) * p
                vectors[ids] -= np.float32(step) * weight[:, None] * back[None, :]
    return Model(vectors, output, bias)


def held_out(id_col: Column) -> Column:
    """True for the fifth of the ids never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most `rows` labelled documents outside the held-out fifth.

    The sample is the labels with the smallest hash of their id, so it is the same for
    each run; it ends before its texts exceed SAMPLE_BYTES. An id that several documents have counts once, with
    the smallest text. Labels other than 0 and 1, null ids and labels without a document are ignored.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    picked = hashed_sample(usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")), ["id", "y"], rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    labelled = texts.join(F.broadcast(picked.distinct()), "id").groupBy("id", "y").agg(F.min("t").alias("t"))
    table = written(labelled.withColumn("mark", F.xxhash64("id", "y")), "sample")
    sizes = table.select("mark", F.octet_length("t").cast("long")).orderBy("mark").collect()  # at most `rows` rows
    last = max((m for m, total in zip([r[0] for r in sizes], np.cumsum([r[1] for r in sizes])) if total <= SAMPLE_BYTES), default=None)
    found = table.where(F.lit(False) if last is None else F.col("mark") <= last).select("id", "y", "t").toArrow()
    forget(table)
    order = sorted(range(found.num_rows), key=lambda i: (found["id"][i].as_py(), found["y"][i].as_py()))
    return train([found["t"][i].as_py() for i in order], [found["y"][i].as_py() for i in order])


def scorer(docs: DataFrame, model: Model) -> Callable[[Column], Column]:
    """A column function: whole text to the probability of label 1."""
    table = docs.sparkSession.sparkContext.broadcast(model.buckets())

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        weights, bias = table.value
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            ids = features(text.as_py() or b"")
            out[k] = bias + (weights[ids].mean(dtype=np.float64) if len(ids) else 0.0)
        return pa.array(1 / (1 + np.exp(-out)))

    return lambda text: score(F.coalesce(text, F.lit("")).cast("binary"))
