"""The pipeline's stages against brute-force versions of what each has to keep."""

import random

import corpus_pipeline
from cohortspark.llm import secrets
from tests.llm.test_corpus import brute_components, brute_contamination, brute_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        after = {r.doc_id: r for r in docs.collect()}
        if name != "mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        if name == "quality":
            gone = set(before) - set(after)
            assert len(gone & bad) >= 0.8 * len(bad)
        if name == "near_duplicates":
            ids = sorted(before)
            roots = brute_components([brute_fingerprint(before[i].text) for i in ids])
            groups = {}
            for i, r in zip(ids, roots, strict=True):
                groups.setdefault(r, i)
            assert set(after) == set(groups.values())
        if name == "decontaminate":
            hit = {r[0] for r in brute_contamination([(i, before[i].text) for i in before], benchmark) if r[-1]}
            assert hit and set(after) == set(before) - hit
        if name == "secrets":
            assert set(after) == set(before)
            for i, r in before.items():
                assert after[i].text == secrets.redact(r.text, secrets.scan(r.text)) and not secrets.base_spans(after[i].text)
        if name == "mix":
            assert set(after) == set(before)


def test_empty_and_null_documents(spark, tmp_path):
    from tests.llm.fixtures import rows

    for case, data in (("empty", []), ("edges", rows())):
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{case}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{case}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{case}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{case}").count()
        assert got == 0 if case == "empty" else got > 20


def test_null_and_repeated_ids(spark, tmp_path):
    from tests.llm.fixtures import words

    rng = random.Random(5)
    a, b, c, d, e, item = (words(rng, 60) for _ in range(6))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    schema_names = ["doc_id", "text", "lang", "source", "n_chars"]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).repartition(3)
    kept = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    clean = [(None, a), (None, b), (None, b), (7, c), (8, d)]
    found = corpus_pipeline.drop_contaminated(spark, frame([*clean, (None, item), (7, item), (9, item)]), str(tmp_path))
    assert found.columns == schema_names and kept(found) == sorted(clean, key=repr)
    found = corpus_pipeline.drop_near_duplicates(spark, frame([(7, a), (7, b), (7, b), (12, b), (None, c), (None, c), (None, d), (8, d), (None, e), (3, a)]), str(tmp_path))
    assert found.columns == schema_names and kept(found) == sorted([(3, a), (7, b), (None, c), (8, d), (None, e)], key=repr)


def test_clashing_names_ties_and_long_texts(spark, tmp_path):
    from tests.llm.fixtures import words

    rng = random.Random(9)
    a, b, item = (words(rng, 60) for _ in range(3))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = "score double, predicted int, text_hash long, row_key string, row string, rest long, key long, `a.b` string, component_id long, fingerprint string, contaminated boolean"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    tail = (0.5, 0, 7, "k", "r", 1, 2, "d", 3, "f", True)
    rows = [(1, a, "en", "s", 5, *tail), (1, a, "de", "t", 5, *tail), (2, b, "en", None, 5, *tail), (2, b, "en", None, 5, *tail), (2, None, None, None, None, *tail)]
    rows += [(3, words(rng, 30_000), "en", "s", 9, *tail), (4, item, "en", "s", 9, *tail), (5, "", "en", "s", 0, *tail)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = set()
        for parts in (1, 3, 8):
            docs = spark.createDataFrame(rows, schema).repartition(parts)
            found = stage(spark, docs, str(tmp_path))
            assert found.schema == docs.schema
            seen.add(tuple(sorted(map(tuple, found.collect()), key=repr)))
        assert len(seen) == 1, name
        left = next(iter(seen))
        want = {"quality": 8, "near_duplicates": 5, "decontaminate": 7, "secrets": 8}[name]
        assert len(left) == want, (name, [(r[0], r[2]) for r in left])
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 2, 3]


def test_stage_folders_go(spark, tmp_path, monkeypatch):
    import os

    from cohortspark.functions import lineage

    for name, columns in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        data = [(1, "some words", "en", "s", 10)] if name == "documents" else []
        spark.createDataFrame(data, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    folder = lineage._checkpoint_folder(spark).removeprefix("file:")
    before = {x for x in os.listdir(folder) if x.startswith("table-")}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    assert len({x for x in os.listdir(folder) if x.startswith("table-")} - before) == 1
