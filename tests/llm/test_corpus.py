"""Operators over the whole corpus, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash
from pyspark.sql import functions as F

from cohortspark.llm import decontamination, mixing, simhash, substring_dedup
from tests.llm.fixtures import empty, frame, rows, words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(SPLIT.findall(text or ""))


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held = set()
    while True:
        left = Fraction(sum(sizes.values()) - sum(cap * sizes[s] for s in held))
        free = sum(w[s] for s in names if s not in held)
        target = {s: Fraction(cap * sizes[s]) if s in held else left * w[s] / free for s in names}
        over = {s for s in names if s not in held and target[s] > cap * sizes[s]}
        if not over:
            return target
        held |= over


def test_targets_and_rounding(spark):
    rng = random.Random(4)
    data = [(i, words(rng, rng.choice([1, 5, 40, 40, 300])), "en", rng.choice(["a", "b", "b", "b", "c", "d", None, "ü"]), 0) for i in range(400)]
    data += [(1000, "one two", "en", "tiny", 0), (1001, None, "en", "none", 0), data[5]]
    found = mixing.mix_sources(frame(spark, data))
    got = found.collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d[0], d[3]) for d in data)
    sizes = defaultdict(int)
    for d in data:
        sizes[d[3]] += size(d[1])
    target = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - float(target[r.source])) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        share = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        taken[r.source] += r.taken
    for s, t in target.items():
        if sizes[s]:
            assert abs(taken[s] - t) <= max(10, 0.05 * t), (s, taken[s], float(t))
    again = mixing.mix_sources(frame(spark, data).repartition(7))
    key = lambda rs: sorted(((r.doc_id, r.taken) for r in rs), key=repr)
    assert key(again.collect()) == key(got)
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_rounding_keeps_mass_and_expectation(spark):
    n = 700
    long = lambda c, name: F.lit(c).cast("bigint").alias(name)
    docs = spark.range(n).select(F.lit("g").alias("group"), long(n, "n_docs"), long(10, "size"), F.col("id"), long(0, "copies"), long(1, "n"), long(0, "more"), F.lit(0.3).alias("p"))
    hits = Counter()
    for seed, last in ((0, 30), (1, 30), (2, 1000), (3, 60)):
        got = mixing.pivotal_round(docs, n, 1, seed=seed, fan_in=16, last_block=last).collect()
        assert len(got) == n and abs(sum(r.more for r in got) - 0.3 * n) < 1.0
        hits.update(r.id for r in got if r.more)
    assert set(hits.values()) <= {1, 2, 3, 4} and len(hits) > 0.55 * n  # other seeds draw other documents


def test_one_key_may_hold_most_rows(spark):
    n = 100_000
    hot = spark.range(n).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("hot").alias("source"))
    none = spark.range(5000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b").alias("text"), F.lit(None).cast("string").alias("source"))
    rest = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), 40)).alias("text"), F.lit("a").alias("source"))
    found = mixing.mix_sources(hot.unionByName(none).unionByName(rest))
    by_source = {r.source: r for r in found.groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"), F.min("copies").alias("least"), F.max("size").alias("size")).collect()}
    assert {s: r.n for s, r in by_source.items()} == {"hot": n, None: 5000, "a": 300}
    target = brute_targets({"hot": 3 * n, None: 10_000, "a": 12_000})
    for s, r in by_source.items():
        assert abs(r.target - float(target[s])) < 1e-6 and abs(r.taken - r.target) <= r.size and r.most - r.least <= 1 and r.most <= 3


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = SPLIT.findall(lowered)
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least id reachable over links of two bits or fewer, by row."""
    comp = list(range(len(prints)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                comp[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def least_ids(ids, prints):
    roots = brute_components(prints)
    least = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in roots]


def test_simhash(spark):
    data = rows()
    prints = [brute_fingerprint(r[1]) for r in data]
    want = sorted(zip((r[0] for r in data), (f"{p:016x}" for p in prints), least_ids([r[0] for r in data], prints), strict=True), key=repr)
    got = simhash.near_duplicates(frame(spark))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_links_cold_and_hot(spark):
    rng = random.Random(9)
    centre = [rng.getrandbits(64) for _ in range(12)]
    points = set(centre)
    for c in centre:
        for _ in range(60):
            p = c
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
            points.add(p)
    points = sorted(points)
    want = brute_components(points)
    groups = Counter(want)
    frame_ = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    from cohortspark.operators.components import connected_components

    for hot in (1, 3, 10_000):
        edges = simhash.links(frame_, hot)
        assert edges.where("bit_count(src ^ dst) > 2").count() == 0
        parts = connected_components(edges).groupBy("component").count().collect()
        assert sorted(r["count"] for r in parts) == sorted(n for n in groups.values() if n > 1)


def brute_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        ws = brute_words(text)
        n = min(13, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            windows[tuple(ws[i : i + n])].add(str(item) if item is not None else None)
    out = []
    for doc_id, text in docs:
        ws, hit, found = brute_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(ws[i : i + n])]
        ids = sorted(i for i in found if i is not None)
        out.append((doc_id, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=repr)


def test_contamination(spark, monkeypatch):
    rng = random.Random(6)
    texts = [r[1] for r in rows()]
    long = [t for t in texts if t and len(t.split()) > 40]
    items = [(1, " ".join(long[0].split()[:20])), (2, " ".join(long[1].split()[3:33]).upper()), (10, " ".join(long[1].split()[8:40])), (3, "x"), (4, "same same"), (5, words(rng, 30)), (6, None), (7, " "), (1, " ".join(long[0].split()[:20])), (8, "same " * 30)]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, token long")
    data = rows() + [(500, "filler " * 400 + " ".join(long[0].split()[:20]), "en", "s", 1)]
    want = brute_contamination([(r[0], r[1]) for r in data], items)
    got = decontamination.contamination(frame(spark, data), benchmark).drop("items")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 20)  # shuffled joins give the same
    got = decontamination.contamination(frame(spark, data), benchmark).drop("items")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    none = decontamination.contamination(frame(spark), benchmark.limit(0)).collect()
    assert len(none) == len(rows()) and all(r.n_hit == 0 and not r.contaminated for r in none)
    assert decontamination.contamination(empty(spark), benchmark).count() == 0


def test_many_equal_documents(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.range(9000).select(F.lit(3).cast("bigint").alias("doc_id"), F.lit(f"so {item} it goes").alias("text"))
    got = decontamination.contamination(docs, benchmark).groupBy("doc_id", "n_words", "n_hit", "contaminated").count().collect()
    assert list(map(tuple, got)) == [(3, 17, 14, True, 9000)]


def brute_kept(docs, window):
    first = {}
    for doc_id, text in docs:
        ws = SPLIT.findall(text or "")
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            if doc_id is not None:
                first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        ws, gone = SPLIT.findall(text or ""), set()
        for i in range(len(ws) - window + 1):
            if doc_id is not None and first[tuple(ws[i : i + window])] < doc_id:
                gone |= set(range(i, i + window))
        out.append((doc_id, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup(spark):
    data = rows()
    got = substring_dedup.without_spans(substring_dedup.repeated_spans(frame(spark)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_kept([(r[0], r[1]) for r in data], 50)
    assert substring_dedup.repeated_spans(empty(spark)).count() == 0


def test_substring_dedup_on_tangled_texts(spark):
    rng = random.Random(3)
    blocks = [words(rng, rng.randint(2, 25)) for _ in range(12)]
    data = [(rng.randrange(60), " ".join(rng.choice(blocks) for _ in range(rng.randint(1, 8))), "en", "s", 0) for _ in range(80)]
    data += [(i, " ".join(rng.choice("ab") for _ in range(60)), "en", "s", 0) for i in range(100, 110)]
    for window, k in ((8, 3), (20, 12)):
        found = substring_dedup.repeated_spans(frame(spark, data), window=window, k=k)
        got = substring_dedup.without_spans(found, window=window)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_kept([(r[0], r[1]) for r in data], window)


def test_many_equal_rows_of_tangled_texts(spark):
    rng = random.Random(5)
    blocks = [words(rng, 30) for _ in range(5)]
    data = [(i, " ".join(rng.choice(blocks) for _ in range(6))) for i in range(12)]
    rows_ = spark.createDataFrame([*data, *[data[3]] * 1500, *[data[9]] * 1500], "doc_id long, text string").repartition(6)
    got = substring_dedup.without_spans(substring_dedup.repeated_spans(rows_)).distinct().collect()
    assert sorted(map(tuple, got), key=repr) == brute_kept(data, 50)


def test_pieces_are_cut_alike_in_chunks(monkeypatch):
    rng = random.Random(7)
    ids = substring_dedup.Words(" ".join(rng.choice("abcdefgh") for _ in range(900)), {}).ids

    def windows(found):
        return [(m, at) for m, first, n in found for at in range(first, first + n)]

    whole = substring_dedup.pieces(ids)
    want = [(min(int(substring_dedup.rolling(ids[at : at + 50], 12)[i]) for i in range(39)), at) for at in range(len(ids) - 49)]
    assert [(m % (1 << 64), at) for m, at in windows(whole)] == want and all(n <= substring_dedup.PIECE_WINDOWS for *_, n in whole)
    for chunk in (1, 37, 851, 852):
        monkeypatch.setattr(substring_dedup, "_CHUNK_WORDS", chunk)
        assert windows(substring_dedup.pieces(ids)) == windows(whole)
    assert substring_dedup.pieces(ids[:49]) == [] and len(substring_dedup.rolling(ids[:3], 4)) == 0


def test_words_are_digested_themselves():
    a, b = substring_dedup.Words("x yz \n w é", {}), substring_dedup.Words("é  x yz w é", {})
    assert a.digest(0, 4, 16) == b.digest(1, 4, 16) == hashlib.blake2b("x yz w é".encode(), digest_size=16).digest()
    assert a.digest(0, 2, 8) != a.digest(0, 3, 8) and len(substring_dedup.Words(None, {}).ids) == 0


def test_repeats_compact_into_paths(spark):
    # Edges 10 to 29 of one piece run along a source; at 20 the graph branches, 25 goes elsewhere.
    data = [(1, 7, 10, at, 0, at + 90 if at < 25 else at + 500, at != 20) for at in range(10, 30)]
    hits = spark.createDataFrame(data, "key long, h long, first int, at int, least long, source int, plain boolean")
    got = sorted((r.path.first, r.path.windows, r.path.least, r.path.source) for r in substring_dedup.compact(hits).collect())
    assert got == [(10, 10, 0, 100), (20, 1, 0, 110), (21, 4, 0, 111), (25, 5, 0, 525)]


def test_edges_know_their_neighbours(spark):
    text = " ".join("abcdefghij")
    docs = spark.createDataFrame([(1, 2, text, [(2, 4)]), (3, 4, " ".join("xbcdefghiy"), [(2, 4)])], "key long, h long, text string, pieces array<struct<first:int,windows:int>>")
    got = {(r.key, r["at"]): r for r in substring_dedup.edges(docs, 3).collect()}
    assert sorted(got) == [(k, at) for k in (1, 3) for at in range(2, 6)]
    for at in range(2, 6):
        assert all(got[1, at][c] == got[3, at][c] for c in ("e", "v", "beside", "first"))
    assert got[1, 2].beside < 1 << 32 and got[1, 5].beside % (1 << 32) == 0  # nothing before the first edge, after the last
    assert len({got[1, at].v for at in range(2, 6)}) == 4
