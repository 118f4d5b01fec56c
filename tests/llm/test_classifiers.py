"""Classifiers: identities, held-out accuracy, edge cases."""

import itertools
import math
import random
import re
import time
from zlib import crc32

import numpy as np
import pytest

from cohortspark.llm import labelled, quality, toxicity
from tests.llm.fixtures import empty, frame, rows, words

SF = "/root/testdata/sf0.1"


def auc(labels, scores):
    order = sorted(zip(scores, labels, strict=True))
    ones = sum(labels)
    below = wins = 0
    for s, y in order:
        below += y == 0
        wins += below * (y == 1)
    return wins / (ones * (len(labels) - ones))


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.2, rng.standard_normal(quality.SLOTS).astype(np.float32), (rng.standard_normal((quality.SLOTS, quality.RANK)) * 0.2).astype(np.float32))
    index, values = quality.features("The text of a few words, a text.", {})
    raw = machine.bias + sum(machine.linear[i] * x for i, x in zip(index, values, strict=True))
    for a in range(len(index)):
        for b in range(a):
            raw += machine.factors[index[a]] @ machine.factors[index[b]] * values[a] * values[b]
    assert machine.score(index, values) == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-4)


def labels_of(spark, data):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def test_edges(spark):
    for op in (quality, toxicity):
        for labels in ([], [(1, 1, 1), (2, 1, 1)], [(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (3, None, None), (4, 1, 1)]):
            got = op.classify(frame(spark), labels_of(spark, labels)).collect()
            assert len(got) == len(rows())
            assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= op.THRESHOLD) for r in got)
            assert all(r.held_out == (r.doc_id is None or crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
        assert op.classify(empty(spark), labels_of(spark, [])).count() == 0


def held_out_rows(spark, op, label):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return [(r[label], r.score, r.predicted) for r in op.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()]


def test_held_out_quality(spark):
    got = held_out_rows(spark, quality, "quality")
    assert auc([y for y, _, _ in got], [s for _, s, _ in got]) > 0.98
    assert sum(p == y for y, _, p in got) / len(got) > 0.97


def test_held_out_toxicity(spark):
    got = held_out_rows(spark, toxicity, "toxic")
    assert sum(p for y, _, p in got if y) / sum(y for y, _, _ in got) >= 0.9
    assert sum(p for y, _, p in got if not y) <= 0.005 * len(got)


def exhaustive(model, token):
    """The least cost over all readings of a token, each run read as any number of copies."""
    runs = [m[0] for m in re.finditer(r"(.)\1*", token)]
    best = math.inf
    choices = []
    for i, run in enumerate(runs):
        n, sign = len(run), run[0]
        fold = toxicity.COST_DOUBLE if n == 2 else toxicity.COST_FOLD
        if sign.isalpha():
            choices.append([(sign * k, fold * (n - k)) for k in range(1, n + 1)])
            continue
        if sign == " ":
            choices.append([("", toxicity.COST_DROP), (" ", 0.0)])
            continue
        own = [(x * k, toxicity.COST_SWAP * k + fold * (n - k)) for x in toxicity.LOOK_ALIKES.get(sign, "") for k in range(1, n + 1)]
        own.append((run, toxicity.COST_KEEP * n))
        if not sign.isdigit():
            own.append(("", toxicity.COST_DROP))
            if 0 < i < len(runs) - 1:
                own.append((" ", toxicity.COST_EDGE))
        choices.append(own)
    for path in itertools.product(*choices):
        best = min(best, sum(c for _, c in path) + reading_cost(model, "".join(w for w, _ in path)))
    return best


def reading_cost(model, written):
    a, b, total = 0, 0, 0.0
    for c in [*written, " "]:
        code = toxicity._CODE.get(c, toxicity._OTHER)
        total -= float(model[a, b, code])
        a, b = b, code
    return total


@pytest.fixture(scope="module")
def corpus_model(spark):
    return toxicity.language_model(toxicity.trigram_counts(spark.read.parquet(f"{SF}/documents.parquet")))


def channel_cost(token, written):
    """The least channel cost of a reading of ``token``: runs are aligned by dynamic programming."""
    runs = [m[0] for m in re.finditer(r"(.)\1*", token)]
    reach = {0: 0.0}
    for i, run in enumerate(runs):
        after = {}
        for at, cost in reach.items():
            for sign, k, extra in toxicity.readings(run[0], len(run), 0 < i < len(runs) - 1):
                if written.startswith(sign * k, at):
                    after[at + len(sign) * k] = min(after.get(at + len(sign) * k, math.inf), cost + extra)
        reach = after
    return reach[len(written)]


def test_viterbi_is_exhaustive(corpus_model):
    rng = random.Random(11)
    decoder = toxicity.Decoder(corpus_model)
    tokens = ["1d10t", "iddiioott", "i.d.i.o.t", "m00r0nn", "aaaa", "$$tup1d", "i d i o t", "x9"]
    tokens += ["".join(rng.choice("iod1100t.$ae") for _ in range(rng.randint(1, 8))) for _ in range(150)]
    for token in tokens:
        written = decoder._search(token)
        assert channel_cost(token, written) + reading_cost(corpus_model, written) == pytest.approx(exhaustive(corpus_model, token), abs=1e-3), token


def test_long_tokens_take_linear_time(corpus_model):
    decoder = toxicity.Decoder(corpus_model)
    assert decoder.words("a" * 1_000_000) and decoder.words("." * 1_000_000) == [] and decoder.words("a" + "." * 1_000_000 + "b")
    seconds = []
    for n in (10_000, 100_000):
        for token in ("1d10t", "x.y-", "i "):
            began = time.process_time()
            decoder.words((token * n).strip())
            seconds.append(time.process_time() - began)
    assert all(b < 25 * a + 0.5 for a, b in zip(seconds[:3], seconds[3:], strict=True))
    words = ["a" * 25 + "b", "a" * 25 + "c"]
    assert toxicity.word_slots(words[0])[0] != toxicity.word_slots(words[1])[0] and toxicity.word_slots("ab")


def test_fits_are_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(i, i % 2, b"x" * (10 if i % 3 else 1000)) for i in range(300)], "key long, y int, slots binary")
    whole = labelled.bounded_rows(rows, "key", ["slots"])
    part = labelled.bounded_rows(rows, "key", ["slots"], 20_000)
    assert len(whole) == 300 and 0 < part["slots"].map(len).sum() <= 20_000 and set(part["key"]) < set(whole["key"])
    assert sorted(labelled.bounded_rows(rows.repartition(7), "key", ["slots"], 20_000)["key"]) == sorted(part["key"])
    assert len(labelled.bounded_rows(rows.limit(0), "key", ["slots"])) == 0
    index, values = quality.features(" ".join(f"w{i}" for i in range(300_000)), {})
    assert len(index) == len(set(index.tolist())) <= quality.SLOTS and len(values) == len(index)


def test_one_key_gives_one_row_to_fit_on(spark):
    hot = spark.range(20_000).selectExpr("7L AS doc_id", "concat('text ', id % 3) AS text")
    docs = hot.unionByName(spark.createDataFrame([(1, None), (2, "b"), (None, "c")], "doc_id long, text string"))
    for parts in (1, 5):
        got = labelled.training_rows(docs.repartition(parts), labels_of(spark, [(7, 1, 0), (1, 0, 1), (2, 1, 1), (9, 1, 1), (None, 1, 1)]), "quality", "doc_id", "text", 100)
        assert {r.doc_id for r in got.collect()} == {i for i in (1, 2, 7) if crc32(str(i).encode()) % 5}
        assert got.count() == got.select("doc_id").distinct().count() and (parts == 1 or set(got.collect()) == first)
        first = set(got.collect())


def test_decoding(spark, corpus_model):
    assert np.allclose(np.exp(corpus_model).sum(axis=2), 1, atol=1e-3)
    decoder = toxicity.Decoder(corpus_model)
    for hidden, plain in {
        "1d10t": "idiot", "m0r0n": "moron", "idiooot": "idiot", "tr4sh": "trash", "$tup1d": "stupid", "i.d.i.o.t": "idiot", "iddiioott": "idiot",
        "id*iot": "idiot", "clown$$$": "clown", "trash***": "trash", "SCUM!!": "scum", "i d i o t": "idiot", "1 d 1 0 t": "idiot",
    }.items():
        assert decoder.words(hidden) == [plain]
    assert decoder.words("w0rthl3ss") == decoder.words("worthless")
    assert decoder.text("The i d i o t and others,  trash***") == "the idiot and others trash"
    assert decoder.words("2024") == ["2024"] and decoder.words("***") == [] and decoder.words("ordinary") == ["ordinary"]
    docs = spark.createDataFrame([(1, "An 1d10t"), (2, None), (None, "")], "doc_id long, text string")
    assert sorted((tuple(r) for r in toxicity.restored_texts(docs, corpus_model, ["doc_id"]).collect()), key=repr) == sorted([(1, "an idiot"), (2, ""), (None, "")], key=repr)


def test_counts_cover_all_texts(spark):
    got = {r.cell: r.n for r in toxicity.trigram_counts(frame(spark)).collect()}
    texts = [t.lower() + " " for _, t, *_ in rows() if t]
    assert sum(got.values()) == sum(len(t.encode("utf-32-le")) // 4 - 2 for t in texts if len(t) > 2)


def test_planted_words_are_learned_and_found(spark):
    rng = random.Random(8)
    bad = ["grobalik", "snarfu", "wexlon"]
    data, labels = [], []
    for i in range(500):
        toxic = i % 3 == 0
        ws = words(rng, 40).split()
        if toxic:
            for _ in range(2):
                ws[rng.randrange(40)] = rng.choice(bad)
        data.append((i, " ".join(ws), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    data += [(900, words(rng, 20) + " sn4rfu w3xl0n " + words(rng, 5), "en", "s", 0), (901, words(rng, 30), "en", "s", 0)]
    got = {r.doc_id: r for r in toxicity.classify(frame(spark, data), labels_of(spark, labels)).collect()}
    assert got[900].predicted == 1 and got[901].predicted == 0
    held = [i for i in range(500) if got[i].held_out]
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) / len(held) > 0.97
