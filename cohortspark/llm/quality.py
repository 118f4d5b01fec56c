"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

A text's features are its distinct words, hashed into ``WORD_SLOTS`` and scaled to unit length,
and one-hot bins of structure statistics (repetition, capitals, symbols, word and line lengths)
and of the text's length as metadata. The score is the logistic of
``b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``: all pairwise
interactions through ``RANK`` factors in time linear in the features.

The machine is fitted with Adagrad on labelled rows outside the held-out fold, at most
``TRAIN_ROWS`` rows and ``labelled.TRAIN_BYTES`` of features; language, source and document ids are
never features. These features are the only thing sent to the driver. The model has a fixed size (some 2.5 MB) and is broadcast.

Defined results: a null text is scored as the empty one; without labelled rows, or with one class
only, every score is the (smoothed) share of label 1; repeated rows give repeated rows; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import operator
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.labelled import bounded_rows, held_out, training_rows

WORD_SLOTS = 1 << 16
RANK = 8
TRAIN_ROWS = 8000
EPOCHS = 8
THRESHOLD = 0.3

#: Edges of the bins of each statistic.
_BINS = {
    "repeated neighbours": (0.004, 0.01, 0.03, 0.1, 0.3),
    "distinct words": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "capital words": (0.01, 0.03, 0.1, 0.2, 0.4, 0.7),
    "symbols": (0.01, 0.03, 0.1, 0.2, 0.4, 0.8, 1.6),
    "bars": (0.01, 0.03, 0.1, 0.2, 0.4),
    "marks": (0.01, 0.03, 0.1, 0.2, 0.4, 0.8),
    "word length": (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 15.0),
    "lines": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
    "digits": (0.003, 0.01, 0.03, 0.1, 0.3),
    "length": tuple(float(x) for x in range(4, 22)),
}
_STARTS: dict[str, int] = {}
_at = WORD_SLOTS
for _name, _edges in _BINS.items():
    _STARTS[_name] = _at
    _at += len(_edges) + 1
SLOTS = _at


def statistics(text: str, words: list[str], distinct: int) -> dict[str, float]:
    n = max(1, len(words))
    return {
        "repeated neighbours": sum(map(operator.eq, words, words[1:])) / n,
        "distinct words": distinct / n,
        "capital words": sum(map(str.isupper, words)) / n,
        "symbols": sum(map(text.count, "#$%&*+<=>@^_{}~\\")) / n,
        "bars": text.count("|") / n,
        "marks": (text.count("!") + text.count("?")) / n,
        "word length": len(text) / n - 1,
        "lines": text.count("\n") / n,
        "digits": sum(map(text.count, "0123456789")) / max(1, len(text)),
        "length": math.log2(len(text) + 1),
    }


def features(text: str | None, slots: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; ``slots`` is a memo of words' slots, emptied when it gets large."""
    text = text or ""
    words = text.split()
    distinct = set(words)
    if len(slots) > 1 << 19:
        slots.clear()
    index = []
    for w in distinct:
        slot = slots.get(w)
        if slot is None:
            slot = slots[w] = crc32(w.lower().encode()) % WORD_SLOTS
        index.append(slot)
    # Words that share a slot are one feature: never more features than slots, however long the text is.
    used, times = np.unique(np.array(index, np.int32), return_counts=True)
    scaled = times / math.sqrt(max(1, len(index)))
    bins = {_STARTS[name] + bisect_right(_BINS[name], x): 1.0 for name, x in statistics(text, words, len(distinct)).items()}
    return np.concatenate([used, np.array(list(bins), np.int32)]), np.concatenate([scaled, list(bins.values())]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.squares = (self.factors**2).sum(axis=1)

    def score(self, index: np.ndarray, values: np.ndarray) -> float:
        mixed = values @ self.factors[index]
        raw = self.bias + values @ self.linear[index] + 0.5 * (mixed @ mixed - (values**2) @ self.squares[index])
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, float(raw)))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 5, epochs: int = EPOCHS, rate: float = 0.08, l2: float = 1e-5) -> Machine:
    """Adagrad over mini-batches; sparse gradients are summed by slot."""
    rng = np.random.default_rng(seed)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    machine = Machine(math.log(share / (1 - share)), np.zeros(SLOTS, np.float32), (rng.standard_normal((SLOTS, RANK)) * 0.01).astype(np.float32))
    if len(y) == 0 or y.min() == y.max():
        machine.factors[:] = 0
        machine.squares[:] = 0
        return machine
    w, v = machine.linear, machine.factors
    gw, gv, gb = np.full(SLOTS, 1e-6, np.float32), np.full((SLOTS, RANK), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 128):
            chosen = order[at : at + 128]
            index = np.concatenate([rows[i][0] for i in chosen])
            x = np.concatenate([rows[i][1] for i in chosen])
            sizes = np.array([len(rows[i][0]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            xv = x[:, None] * v[index]
            mixed = np.add.reduceat(xv, starts)
            pair = 0.5 * ((mixed**2).sum(axis=1) - np.add.reduceat((xv**2).sum(axis=1), starts))
            raw = machine.bias + np.add.reduceat(x * w[index], starts) + pair
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[chosen]) / len(chosen)
            each = np.repeat(slope, sizes)
            used, where = np.unique(index, return_inverse=True)
            dw = np.bincount(where, each * x, len(used)) + l2 * w[used]
            dv_each = (each * x)[:, None] * (np.repeat(mixed, sizes, axis=0) - xv)
            dv = np.stack([np.bincount(where, dv_each[:, f], len(used)) for f in range(RANK)], axis=1) + l2 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            db = float(slope.sum())
            gb += db**2
            machine.bias -= rate * db / math.sqrt(gb)
    machine.__post_init__()
    return machine


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_ROWS) -> Machine:
    """A machine fitted on at most ``most`` labelled rows outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, int] = {}
        for batch in batches:
            found = [features(t.as_py(), slots) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())],
                names=["key", "y", "index", "values"],
            )

    rows = training_rows(docs, labels, label, key, text, most)
    schema = T.StructType(
        [T.StructField("key", docs.schema[key].dataType), T.StructField("y", T.IntegerType()), T.StructField("index", T.BinaryType()), T.StructField("values", T.BinaryType())]
    )
    got = bounded_rows(rows.mapInArrow(run, schema), "key", ["index", "values"])
    got = got.sort_values(["key", "index"], kind="stable")
    found = [(np.frombuffer(bytes(i), np.int32), np.frombuffer(bytes(x), np.float32)) for i, x in zip(got["index"], got["values"], strict=True)]
    return fit(found, got["y"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, machine: Machine, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` and ``score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slots = Machine(*shared.value), {}
        for batch in batches:
            scores = [model.score(*features(t.as_py(), slots)) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=[*keep, "score", "predicted"],
            )

    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of every row."""
    scored = quality_scores(docs, train(docs, labels, key, text), [key], text)
    return scored.select(key, held_out(key).alias("held_out"), "score", "predicted")
