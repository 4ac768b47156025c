import random

import pytest

import corpus_pipeline as P
from stepwell.llm import quality, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("sf"))
    vocabulary = [f"w{k}" for k in range(2000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts, good = [], []
    for k in range(120):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(100, 200))]
        bad = k % 5 == 0
        if bad:
            t = [w.upper() + "!!" for w in t]
        if k % 7 == 1:
            t[50:50] = passage.split()
        texts.append(" ".join(t))
        good.append(not bad)
        if k % 4 == 1:
            t = list(t)
            t[rng.randrange(len(t))] = "new"
            texts += [" ".join(t), texts[-1]]
            good += [not bad, not bad]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)] + [(None, None, None, None, None), (9000, "", "en", "s", 0), (3, texts[3], "en", "s0", len(texts[3]))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(g), 0) for k, g in enumerate(good)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts, good


def test_stages(spark, data):
    path, texts, good = data
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["quality classifier", "simhash near-dedup", "substring dedup", "packing"]
    one = P.keep_quality(spark, docs, path)
    assert one.columns == list(P.COLUMNS)
    kept = {r.doc_id for r in one.collect() if r.doc_id is not None and r.doc_id < 9000}
    assert kept == {k for k, g in enumerate(good) if g}
    two = P.drop_near_duplicates(spark, one, path)
    assert two.columns == list(P.COLUMNS)
    left = [r.doc_id for r in two.collect() if r.doc_id is not None and r.doc_id < 9000]
    assert len(left) == len(set(left))
    originals = {k for k, t in enumerate(texts) if good[k] and "new" not in t.split() and texts.index(t) == k}
    assert set(left) == originals
    three = P.drop_repeated_passages(spark, two, path)
    assert three.columns == list(P.COLUMNS)
    before = two.collect()
    want = {r.doc_id: w for r, w in zip(before, substring.brute_force([r.text for r in before], 35), strict=True)}
    removed = 0
    for r in three.collect():
        n_words, n_removed, _ = want[r.doc_id]
        assert len((r.text or "").split()) == n_words - n_removed
        assert r.text is None or r.n_chars == len(r.text)
        removed += n_removed
    assert removed > 500
    four = P.pack(spark, three, path)
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()}


def test_run_and_empty_table(spark, data, tmp_path):
    path, *_ = data
    got = P.run(spark, path)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_ids(spark, data):
    rows = [(5, "one text of some length here", "en", "a", 1), (5, "one text of some length here", "en", "b", 1), (5, "quite another text stands here now", "en", "a", 1), (None, "lonely text with no id at all", "en", "a", 1), (None, None, None, None, None)]
    got = P.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.source) for r in got))) == sorted(map(str, [(5, rows[0][1], "a"), (5, rows[2][1], "a"), (None, rows[3][1], "a"), (None, None, None)]))
    assert quality.THRESHOLD == 0.3
