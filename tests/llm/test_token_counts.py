import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stepwell.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(files, end):
    out = []
    for name, tokens in files.items():
        start = number = 0
        for k, t in enumerate(tokens):
            if t == end:
                out.append((name, number, start, k - start, True))
                start, number = k + 1, number + 1
        if start < len(tokens):
            out.append((name, number, start, len(tokens) - start, False))
    return sorted(out)


@pytest.mark.parametrize("block,kind", [(1, "<u2"), (7, "<u2"), (64, "<u4"), (1 << 17, "<u2")])
def test_raw_files(spark, tmp_path, block, kind):
    rng = random.Random(block)
    files = {"a": [], "b": [9], "c": [5, 5, 9], "d": [9, 9, 9], "e": [rng.choice([1, 2, 3, 9]) for _ in range(500)], "f": [4] * 300 + [9] + [4] * 20}
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(np.array(tokens, kind).tobytes())
    got = T.count_tokens(T.read_blocks(spark, str(tmp_path), kind, block), 9, kind).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.number, r.start, r.n_tokens, r.closed) for r in got) == plain(files, 9)
    assert all(r.doc_id is None for r in got)


@pytest.mark.parametrize("block", [5, 100, 1 << 17])
def test_documents(spark, block):
    rng = random.Random(1)
    texts = [None, "", "a", "x<|endoftext|>y"] + [" ".join(rng.choice(["the", "ö", "and"]) for _ in range(rng.randrange(60))) for _ in range(70)]
    rows = [(None if k == 5 else 6 if k == 7 else k, t, "clash", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, start int").repartition(3)
    got = T.count_tokens(T.token_blocks(docs, PATH, block_tokens=block)).collect()
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want = [(i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert sorted(map(str, ((r.doc_id, r.n_tokens) for r in got))) == sorted(map(str, want))
    assert all(r.closed for r in got)
    assert T.count_documents(docs.limit(0), PATH).count() == 0


def test_ranges_of_a_file(spark, tmp_path, monkeypatch):
    """Files that are many ranges of many blocks, of which several tasks read parts."""
    monkeypatch.setattr(T, "RANGE", 3)
    monkeypatch.setattr(T, "RUN", 2)
    rng = random.Random(4)
    files = {"a": [rng.choice([1, 2, 3, 70_000]) for _ in range(900)], "b": [5] * 400 + [70_000] + [5] * 100 + [70_000] * 3, "c": [6] * 333}
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(np.array(tokens, "<u4").tobytes())
    blocks = T.read_blocks(spark, str(tmp_path), "<u4", 10)
    assert blocks.selectExpr("spark_partition_id() as p").distinct().count() > 1
    got = T.count_tokens(blocks, 70_000, "<u4").collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.number, r.start, r.n_tokens, r.closed) for r in got) == plain(files, 70_000)
    (tmp_path / "d").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole number of ids"):
        T.read_blocks(spark, str(tmp_path), "<u4", 10).count()


@pytest.mark.parametrize("end_id,width", [(50255, "<u2"), (50300, "<u2"), (70_000, "<u4")])
def test_other_end_ids(spark, end_id, width):
    docs = spark.createDataFrame([(1, "the and"), (2, "the"), (3, None)], "doc_id long, text string")
    assert T.width_for(PATH, end_id) == width
    got = T.count_documents(docs, PATH, end_id=end_id).collect()
    assert sorted((r.doc_id, r.n_tokens, r.closed) for r in got) == [(1, 2, True), (2, 1, True), (3, 0, True)]


def test_an_end_id_that_a_text_has(spark):
    ids = Tokenizer.from_file(PATH).encode(" the", add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, "on the way")], "doc_id long, text string")
    with pytest.raises(Exception, match="its end could not be told"):
        T.count_documents(docs, PATH, end_id=ids[0]).count()


def test_a_wide_vocabulary(spark, tmp_path):
    """Ids beyond 16 bits: the entries moved up by 20,000."""
    import json

    spec = json.load(open(PATH))
    spec["model"]["vocab"] = {t: i + 20_000 for t, i in spec["model"]["vocab"].items()}
    spec["added_tokens"] = []
    wide = tmp_path / "wide.json"
    wide.write_text(json.dumps(spec))
    docs = spark.createDataFrame([(1, "the and"), (2, "the"), (3, "")], "doc_id long, text string")
    got = T.count_documents(docs, str(wide), end_id=3).collect()
    assert T.width_for(str(wide), 3) == "<u4"
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 2), (2, 1), (3, 0)]
