"""The registered queries themselves, over whole tables of sf0.001, against SQL or brute force."""

import hashlib
import math
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import pytest

from cohortspark.llm import html_text, queries, secrets
from tests.llm.test_corpus import brute_fingerprint, brute_targets, least_ids, size
from tests.llm.test_rowwise import brute_base, library_count

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    result = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(row[names.index(c)] for c in columns) for row in result.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_token_counts(spark, texts):
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        n = library_count(texts[i].text or "")
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[i].text or "").encode()), n, n > 1024)


def test_html_text(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op2_html_text(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, html_text.main_text(pages[r.page_id].html), len(r.text)) and r.text


def test_mix_sources(spark, texts):
    got = {r.doc_id: r for r in queries.op4_mix_sources(spark, SF).collect()}
    assert set(got) == set(texts)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in texts.values():
        sizes[r.source] += size(r.text)
    target = brute_targets(sizes)
    for i, r in got.items():
        n, source = size(texts[i].text), texts[i].source
        assert (r["size"], r.source_size) == (n, sizes[source]) and r.target == pytest.approx(float(target[source]), abs=1e-6)
        assert r.taken in {n * k for k in range(4)}
        taken[source] += r.taken
    assert sum(abs(taken[s] - t) for s, t in target.items()) <= 0.03 * sum(sizes.values())


def test_simhash(spark, texts):
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i].text) for i in ids]
    got = sorted(map(tuple, queries.op5_simhash_dedup(spark, SF).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == list(zip(ids, (f"{p:016x}" for p in prints), least_ids(ids, prints), strict=True))


def test_secret_scan(spark):
    texts = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}

    def listed(spans):
        return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    got = {r.doc_id: r for r in queries.op6_secret_scan(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        base = brute_base(texts[i].text or "")
        kinds = Counter(k for *_, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert r.spans == listed(secrets.scan(texts[i].text)) and set(filter(None, listed(base).split(","))) <= set(r.spans.split(","))
    assert any(r.spans for r in got.values())


@pytest.mark.parametrize("name, threshold", [("op9_quality", 0.3), ("op10_toxicity", 0.5)])
def test_scores(spark, texts, name, threshold):
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and not math.isnan(r.score) and r.predicted == int(r.score >= threshold)
