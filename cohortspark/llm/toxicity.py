"""Toxicity by noisy-channel deobfuscation.

Writers hide words by look-alike signs (``1d10t``), spacing (``i d i o t``, ``i.d.i.o.t``) and
repetition (``idiooot``, ``iddiioott``). Each suspicious token, and each run of three or more single
signs with their gaps, is one lattice over its runs of equal signs: a run of letters is read as one
or more of them; a look-alike stands for itself or for letters; any other sign and a gap stand for
nothing, for a word edge or for themselves. An exact Viterbi search (all states are kept: the last
two signs written) finds the reading that a character trigram model of the corpus finds likeliest,
less the channel's costs; its time is linear in the token. Tokens with one reading pass unchanged.
The restored words are scored by a sparse logistic model over words and word beginnings, each with
levels of how often they occur in the text.

The language model counts trigrams of all documents' words: each task folds its own texts into
counts, which are summed in a shuffle; the table's size is bounded by the alphabet's cube. The
logistic model is fitted (FTRL with an L1 term) on labelled rows outside the held-out fold, at most
``TRAIN_ROWS`` rows and ``labelled.TRAIN_BYTES`` of features; language, source and document ids are
never features.

Defined results: a null text is scored as the empty one; without labelled rows, or with one class
only, every score is the (smoothed) share of label 1; repeated rows give repeated rows; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.labelled import bounded_rows, held_out, training_rows

TRAIN_ROWS = 8000
EPOCHS = 5
THRESHOLD = 0.5
#: Slots of words and word beginnings, each with ``LEVELS`` levels of frequency.
BASES, LEVELS = 1 << 19, 4
SLOTS = BASES * LEVELS

#: The model's alphabet: word edge, letters; everything else is one further sign.
ALPHABET = " abcdefghijklmnopqrstuvwxyzßàáâäæçèéêëìíîïñòóôöøùúûüýÿœ"
_OTHER = len(ALPHABET)
_N = _OTHER + 1
_CODE = {c: i for i, c in enumerate(ALPHABET)}

#: Letters that a sign may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
}
#: Signs that may begin or end a word in disguise; other signs at a token's ends are punctuation.
_FRONT, _BACK = frozenset("@$!|+€£¡(<"), frozenset("@$|+€£")
#: Three or more single signs with single gaps: one lattice.
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_RUNS = re.compile(r"(.)\1*", re.S)
_REPEAT = re.compile(r"(.)\1", re.S)

#: Channel costs in nats: a letter for a sign, a sign or gap for nothing or a word edge, a sign for
#: itself, a letter of a double or of a longer run left out.
COST_SWAP, COST_DROP, COST_EDGE, COST_KEEP, COST_DOUBLE, COST_FOLD = 1.0, 0.7, 1.0, 6.0, 2.0, 0.3


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``cell, n`` over all documents: trigrams of lower-case words with their edges, ``cell`` = (a*N+b)*N+c."""
    table = np.full(0x250, _OTHER, np.int64)
    for c, i in _CODE.items():
        table[ord(c)] = i
    table[[9, 10, 11, 12, 13]] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, np.int64)
        for batch in batches:
            for value in batch.column(0):
                content = value.as_py()
                for at in range(0, len(content or ""), 1 << 20):  # bounded memory; neighbours overlap by two signs
                    piece = content[max(0, at - 2) : at + (1 << 20)].lower()
                    codes = np.frombuffer(f"{piece} ".encode("utf-32-le"), np.uint32)
                    codes = table[np.minimum(codes, 0x24F)]
                    if len(codes) >= 3:
                        total += np.bincount((codes[:-2] * _N + codes[1:-1]) * _N + codes[2:], minlength=_N**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    counts = docs.select(text).mapInArrow(run, "cell long, n long")
    return counts.groupBy("cell").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log P(c | a, b) as float32, smoothed with bigrams; at most the alphabet's cube of cells reaches the driver."""
    n = np.full(_N**3, 0.0)
    got = counts.toPandas()
    n[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    n = n.reshape(_N, _N, _N)
    pairs = n.sum(axis=0) + 0.5
    second = pairs / pairs.sum(axis=1, keepdims=True)
    third = (n + 8.0 * second[None, :, :]) / (n.sum(axis=2, keepdims=True) + 8.0)
    return np.log(third).astype(np.float32)


@lru_cache(1 << 16)
def readings(sign: str, n: int, inner: bool) -> tuple[tuple[str, int, float], ...]:
    """What ``n`` equal signs in a row may stand for: (letter or sign, copies, cost); 0 copies are nothing.

    Each letter left out of a run costs the same, so of the numbers of copies only one, two and all
    can be the cheapest, whatever the model: from the second copy on every further one costs the same.
    """
    fold = COST_DOUBLE if n == 2 else COST_FOLD
    copies = sorted({1, min(2, n), n})
    if sign.isalpha():
        return tuple((sign, k, fold * (n - k)) for k in copies)
    out = [(x, k, COST_SWAP * k + fold * (n - k)) for x in LOOK_ALIKES.get(sign, "") for k in copies]
    if sign == " ":
        return (("", 0, COST_DROP), (" ", 1, 0.0))
    out.append((sign, n, COST_KEEP * n))
    if not sign.isdigit():
        out.append(("", 0, COST_DROP))
        if inner:
            out.append((" ", 1, COST_EDGE))
    return tuple(out)


class Decoder:
    """Viterbi search over character lattices; remembers what it has decoded."""

    def __init__(self, model: np.ndarray):
        #: Rows by the last two codes.
        self.model = model.reshape(_N * _N, _N).tolist()
        self.known: dict[str, str] = {}

    def restore(self, token: str) -> str:
        """The likeliest reading of a lower-case token or run of single signs."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 1 << 17:
                self.known.clear()
            found = self._search(token)
            if len(token) <= 256:
                self.known[token] = found
        return found

    def _search(self, token: str) -> str:
        model, code = self.model, _CODE
        # State: last two codes -> (cost, what was written last, what was written before that)
        states: dict[int, tuple[float, str, tuple | None]] = {0: (0.0, "", None)}
        place, last = 0, len(token)
        for number, run in enumerate(_RUNS.finditer(token)):
            sign, end = run[1], run.end()
            nexts: dict[int, tuple[float, str, tuple | None]] = {}
            for written, copies, extra in readings(sign, end - place, 0 < place and end < last):
                if copies == 0:
                    for key, (cost, tail, before) in states.items():
                        total = cost + extra
                        if key not in nexts or total < nexts[key][0]:
                            nexts[key] = (total, tail, before)
                    continue
                c = code.get(written, _OTHER)
                for ab, (cost, tail, before) in states.items():
                    key = ab % _N * _N + c
                    total = cost + extra - model[ab][c]
                    if copies > 1:
                        twice = c * _N + c
                        total -= model[key][c] + (copies - 2) * model[twice][c]
                        key = twice
                    if key not in nexts or total < nexts[key][0]:
                        nexts[key] = (total, tail + written * copies, before)
            if number & 63 == 63:  # short strings are grown, long ones are linked
                nexts = {key: (cost, "", (before, tail)) for key, (cost, tail, before) in nexts.items()}
            states, place = nexts, end
        _, tail, before = min(((cost - model[ab][0], tail, before) for ab, (cost, tail, before) in states.items()), key=lambda x: x[0])
        parts = [tail]
        while before is not None:
            before, part = before
            parts.append(part)
        return "".join(reversed(parts))

    def words(self, raw: str) -> list[str]:
        """The lower-case words of a token, or of a run of single signs: restored if suspicious."""
        if raw.isalpha():
            word = raw.lower()
            return [self.restore(word) if _REPEAT.search(word) else word]
        start, end = 0, len(raw)
        while start < end and not (raw[start].isalnum() or raw[start] in _FRONT):
            start += 1
        while end > start and not (raw[end - 1].isalnum() or raw[end - 1] in _BACK):
            end -= 1
        word = raw[start:end].lower()
        if not word or word.isdigit():
            return [word] if word else []
        if word.isalpha() and not _REPEAT.search(word):
            return [word]
        return self.restore(word).split()

    def pieces(self, text: str) -> Iterator[str]:
        """The tokens of a text; a run of single signs is one."""
        at = 0
        for m in _SPACED.finditer(text):
            yield from text[at : m.start()].split()
            yield m[0].replace("\t", " ")
            at = m.end()
        yield from text[at:].split()

    def text(self, text: str) -> str:
        """The whole text restored."""
        return " ".join(w for piece in self.pieces(text) for w in self.words(piece))


def word_slots(word: str) -> tuple[int, ...]:
    """Bases of a word and of its beginnings of four and five letters."""
    out = [crc32(f"w{word}".encode()) % BASES]
    if len(word) >= 4:
        out.append(crc32(f"4{word[:4]}".encode()) % BASES)
    if len(word) >= 5:
        out.append(crc32(f"5{word[:5]}".encode()) % BASES)
    return tuple(out)


def levels(base: int, seen: int, words: int) -> list[int]:
    """Slots of a base by its frequency: at all, twice, four times, one word in a hundred (and twice)."""
    at = base * LEVELS
    out = [at]
    if seen >= 2:
        out.append(at + 1)
        if seen >= 4:
            out.append(at + 2)
        if seen * 100 >= words:
            out.append(at + 3)
    return out


class Features:
    """Sets of slots of texts; tokens are remembered, only bases of slots in ``only`` (if given) are counted."""

    def __init__(self, decoder: Decoder, only: frozenset[int] | None = None):
        self.decoder, self.only = decoder, only
        self.bases = None if only is None else frozenset(s // LEVELS for s in only)
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> set[int]:
        if not text:
            return set()
        if len(self.known) > 1 << 19:
            self.known.clear()
        pieces = Counter(self.decoder.pieces(text))
        seen: dict[int, int] = {}
        for piece, n in pieces.items():
            bases = self.known.get(piece)
            if bases is None:
                bases = tuple(b for w in self.decoder.words(piece) for b in word_slots(w))
                if self.bases is not None:
                    bases = tuple(b for b in bases if b in self.bases)
                if len(piece) <= 256:
                    self.known[piece] = bases
            for b in bases:
                seen[b] = seen.get(b, 0) + n
        words = pieces.total()
        out = {s for b, n in seen.items() for s in levels(b, n, words)}
        return out if self.only is None else out & self.only


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, l1: float = 3.0, l2: float = 0.1, alpha: float = 1.0, seed: int = 3, keep: float = 0.6) -> tuple[float, dict[int, float]]:
    """Bias and weights by slot; FTRL-proximal leaves slots without steady evidence at zero.

    A text is toxic by what it holds, whatever else is in it: no weight is below zero. Each visit
    sees a share ``keep`` of a row's slots, so that few of a text's hidden words are enough.
    """
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    bias = math.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return bias, {}
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    bias_n = 1.0
    rng = np.random.default_rng(seed)

    def weights(index: np.ndarray) -> np.ndarray:
        zi = z[index]
        return np.maximum(-zi - l1, 0.0) / ((1.0 + np.sqrt(n[index])) / alpha + l2)

    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            index = rows[i]
            index = index[rng.random(len(index)) < keep]
            w = weights(index)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + float(w.sum())))))
            g = p - y[i]
            n_old = n[index]
            sigma = (np.sqrt(n_old + g * g) - np.sqrt(n_old)) / alpha
            z[index] += g - sigma * w
            n[index] = n_old + g * g
            bias_n += g * g
            bias -= 0.1 * g / math.sqrt(bias_n)
    used = np.flatnonzero(z < -l1)
    return bias, dict(zip(used.tolist(), weights(used).tolist(), strict=True))


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_ROWS):
    """(bias, weights) fitted on at most ``most`` labelled rows outside the held-out fold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(Decoder(shared.value))
        for batch in batches:
            found = [np.array(sorted(features.of(t.as_py())), np.int32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["key", "y", "slots"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("y", T.IntegerType()), T.StructField("slots", T.BinaryType())])
    rows = training_rows(docs, labels, label, key, text, most).mapInArrow(run, schema)
    got = bounded_rows(rows, "key", ["slots"]).sort_values(["key", "slots"], kind="stable")
    return fit([np.frombuffer(bytes(s), np.int32) for s in got["slots"]], got["y"].to_numpy(np.float64))


def toxicity_scores(docs: DataFrame, model: np.ndarray, bias: float, weights: dict[int, float], keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` and ``score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, held = shared.value
        features = Features(Decoder(lm), frozenset(held))
        for batch in batches:
            scores = []
            for value in batch.column(len(keep)):
                raw = bias + math.fsum(held[s] for s in features.of(value.as_py()))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, raw)))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=[*keep, "score", "predicted"],
            )

    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def restored_texts(docs: DataFrame, model: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """``keep, restored``: the decoded text of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [decoder.text(t.as_py() or "") for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "restored"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, T.StructType([*(docs.schema[k] for k in keep), T.StructField("restored", T.StringType())]))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of every row."""
    model = language_model(trigram_counts(docs, text))
    bias, weights = train(docs, labels, model, key, text)
    return toxicity_scores(docs, model, bias, weights, [key], text).select(key, held_out(key).alias("held_out"), "score", "predicted")
