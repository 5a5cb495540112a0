"""Quality classifier: a factorisation machine.

A text's features are its hashed words (weight tf / total), statistics of its structure, and its size as metadata. The
score is the logistic of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, where the pairs are summed in linear time:
half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2. Word hashes and structure share one table of vectors, so pairs such as a
word with the share of capitals count too.

The model is fitted on at most `sample` labelled rows (those with the smallest hashes of the id), whose features, not texts,
go to the driver; full-batch Adam with fixed seeds, so a rerun gives the same weights. Every text is scored.

Defined results: a null text is empty and is scored from its structure alone; null labels are not learnt from; without any
labelled row every score is 0.5; equal rows get equal scores; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from velometric.llm.common import packed, text_bytes
from velometric.llm.quality_rules import counts_of

WORDS = 1 << 13
FACTORS = 8
SAMPLE = 6000
ROUNDS = 120
RATE = 0.05
DECAY = 1e-3
HELD_OUT = 2
FOLDS = 4
THRESHOLD = 0.7
#: Structure features, after the word buckets; the last ones are one-hot classes of the length.
STATS = 10
LENGTHS = 24
SIZE = WORDS + STATS + LENGTHS

_DIGITS = b"0123456789"


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights. Words are lower-cased in ASCII."""
    n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines, n_upper, n_letters = counts_of(data)
    counts = Counter(data.lower().split())
    total = max(n_words, 1)
    index = np.fromiter((zlib.crc32(w) % WORDS for w in counts), np.int64, len(counts))
    share = np.fromiter(counts.values(), np.float64, len(counts)) / total
    chars = max(word_chars, 1)
    marks = sum(map(data.count, b"!?.,;:"))
    digits = len(data) - len(data.translate(None, _DIGITS))
    stats = [
        min(1.0, 10 * n_symbols / chars),
        n_dup / max(n_lines, 1),
        n_repeat / total,
        n_upper / max(n_letters, 1),
        min(1.0, word_chars / total / 20),
        len(counts) / total,
        min(1.0, 5 * marks / chars),
        min(1.0, digits / chars),
        min(1.0, np.log1p(n_words) / 12),
        1.0 if n_words < 50 else 0.0,
    ]
    length = WORDS + STATS + min(LENGTHS - 1, len(data).bit_length())
    index = np.concatenate([index, np.arange(WORDS, WORDS + STATS), [length]])
    return index, np.concatenate([share, stats, [1.0]])


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        """The sum-of-squares identity: one pass over the text's features."""
        v = self.vectors[index] * value[:, None]
        pairs = 0.5 * (np.square(v.sum(axis=0)) - np.square(v).sum(axis=0)).sum()
        z = self.bias + float(self.weights[index] @ value) + float(pairs)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, factors: int = FACTORS, rounds: int = ROUNDS) -> Machine:
    """Full-batch Adam on the logistic loss, classes weighted alike."""
    rng = np.random.default_rng(0)
    bias, weights = np.zeros(1), np.zeros(SIZE)
    vectors = rng.normal(0, 0.05, (SIZE, factors))
    if not rows:
        return Machine(0.0, weights, np.zeros((SIZE, factors)))
    # Single precision and few whole-table temporaries: the driver holds about 40 bytes a feature and factor.
    used, index = np.unique(np.concatenate([i for i, _ in rows]), return_inverse=True)
    value = np.concatenate([x for _, x in rows]).astype(np.float32)
    starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i, _ in rows])
    y = labels.astype(float)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    params = [bias, weights[used], vectors[used]]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    gather = lambda flat: np.bincount(index, flat, len(used))
    for t in range(1, rounds + 1):
        b, w, v = params
        part = v.astype(np.float32)[index]
        part *= value[:, None]
        total = np.add.reduceat(part, starts, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", part, part), starts)
        z = b[0] + np.add.reduceat(w[index] * value, starts) + 0.5 * (np.square(total).sum(axis=1) - squares)
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        each = slope[row] * value
        pull = np.empty_like(v)
        for f in range(factors):
            pull[:, f] = gather(each * (total[row, f] - part[:, f]))
        grads = [
            np.array([slope.sum()]),
            gather(each) + DECAY * w / len(used),
            pull + DECAY * v / len(used),
        ]
        for p, g, (m, s) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    weights[used], vectors[:] = params[1], 0.0
    vectors[used] = params[2]
    return Machine(float(params[0][0]), weights, vectors)


@F.arrow_udf(StructType([StructField("index", ArrayType(IntegerType())), StructField("value", ArrayType(DoubleType()))]))
def feature_lists(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in arrays:
        rows = [features(x.as_buffer().to_pybytes()) for x in array]
        index = pa.array([i.astype(np.int32) for i, _ in rows], pa.list_(pa.int32()))
        value = pa.array([x for _, x in rows], pa.list_(pa.float64()))
        yield pa.StructArray.from_arrays([index, value], names=["index", "value"])


def score_function(machine: Machine):
    @F.arrow_udf("double")
    def scores(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array([machine.score(*features(x.as_buffer().to_pybytes())) for x in array], pa.float64())

    return scores


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, by the number of folds; a null id is in none."""
    return F.crc32(id_column.cast("string").cast("binary")) % FOLDS


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> Machine:
    """Fits on the labelled rows outside the held-out fold, at most `sample` of them."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (fold(F.col("id")) != HELD_OUT))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    # `sample` narrow rows at most, so they may be broadcast against the documents.
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = packed(docs).select(F.col(f"row.`{id_col}`").alias("id"), text_bytes(text_col).alias("body"))
    joined = texts.join(F.broadcast(drawn), "id").groupBy("id").agg(F.min("body").alias("body"), F.min("label").alias("label"))
    found = joined.select("id", "label", feature_lists("body").alias("f")).orderBy("id")
    table = found.select("label", "f.index", "f.value").toArrow()
    rows = [
        (i.values.to_numpy().astype(np.int64), x.values.to_numpy())
        for i, x in zip(table["index"], table["value"], strict=True)
    ]
    return fit(rows, np.array(table["label"].to_pylist(), dtype=float))


def score_quality(
    docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: id, `held_out`, `score` and `predicted`."""
    rows = packed(docs).select(
        F.col(f"row.`{id_col}`").alias(id_col),
        F.coalesce(fold(F.col(f"row.`{id_col}`")) == HELD_OUT, F.lit(False)).alias("held_out"),
        score_function(machine)(text_bytes(text_col)).alias("score"),
    )
    return rows.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
