import random

import numpy as np
import pytest

from stepwell.llm import substring

ROWS = "doc_id long, text string, id string, unit int"


def texts(seed, n, vocabulary=30):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(vocabulary)) for _ in range(40)) for _ in range(4)]
    out = [None, "", "  \n\t ", "one", "é ü\x0bß"]
    for _ in range(n):
        t = " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(80)))
        if rng.random() < 0.4:
            t += rng.choice([" ", "\n", "  "]) + rng.choice(pool) + " " + t[:50]
        out.append(t)
    return out


@pytest.mark.parametrize("width,seed", [(35, 1), (5, 2), (2, 3), (1, 4)])
def test_against_brute_force(spark, width, seed, monkeypatch):
    monkeypatch.setattr(substring, "PIECE_BYTES", 100)
    t = texts(seed, 120)
    t += [t[7], t[8], "x " * 300, "a" * 2000]
    docs = spark.createDataFrame([(k if k % 9 else None, x, "clash", 1) for k, x in enumerate(t)], ROWS)
    got = substring.digests(substring.drop_repeats(docs, width)).collect()
    want = substring.brute_force(t, width)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got)) == sorted(
        (not k % 9, k if k % 9 else 0, *w) for k, w in enumerate(want)
    )


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "", 0), (1, text, "", 0), (2, "short text", "", 0)], ROWS)
    got = {(r.doc_id, r.n_words, r.n_removed, str(r.removed)) for r in substring.drop_repeats(docs).collect()}
    assert got == {(1, 40, 40, "[[0, 40]]"), (2, 2, 0, "[]")}
    assert substring.drop_repeats(docs.limit(0)).count() == 0


def test_carried_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7)], ROWS)
    docs = docs.union(spark.createDataFrame([(2, None, "y", 8), (3, "z  z ", "y", 8), (4, " z z", "y", 9)], ROWS))
    got = {r.doc_id: r for r in substring.drop_repeats(docs, 2, carry=("id", "unit"), with_text=True).collect()}
    assert (got[1].id, got[1].unit, got[1].text, bytes(got[1].kept)) == ("x", 7, "a b", b"a b")
    assert [got[k].text for k in (2, 3, 4)] == [None, "", ""]


def test_words_that_meet_at_a_border():
    data = np.frombuffer(b"ab cdef gh", np.uint8)
    hashes, counts = substring.word_hashes(data, np.array([0, 5, 5, 10]))
    assert counts.tolist() == [2, 0, 2]
    alone = substring.word_hashes(np.frombuffer(b"ab cd", np.uint8), np.array([0, 5]))[0]
    assert hashes[:2].tolist() == alone.tolist()


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(6)
    parts = ["".join(rng.choice("ab  \n") for _ in range(rng.randrange(n))).encode() for n in (1, 5, 50, 900, 3, 2000) * 5] + [b"x" * 700, b" ", b""]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    whole, counts = substring.word_hashes(data, offsets)
    assert counts.tolist() == [len(p.split()) for p in parts]
    for size in (1, 7, 100, 1000):
        monkeypatch.setattr(substring, "PIECE_BYTES", size)
        got, again = substring.word_hashes(data, offsets)
        assert got.tolist() == whole.tolist() and again.tolist() == counts.tolist()
    words = [w for p in parts for w in p.split()]
    assert len({*zip(words, whole.tolist(), strict=True)}) == len(set(words)) == len(set(whole.tolist()))


@pytest.mark.parametrize("buckets", [8, 1000, 1 << 17])
def test_buckets_of_windows(buckets):
    """A window's bucket is the same wherever it stands, and says nothing about its hash."""
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    words[15_000:15_050] = words[40:90]
    hashes, starts = substring.window_hashes(words, np.array([20_000]), 35)
    got = substring.bucket_of(words, starts, 35, buckets)
    assert got[15_000:15_016].tolist() == got[40:56].tolist() and hashes[15_000:15_016].tolist() == hashes[40:56].tolist()
    assert int(got.max()) < buckets and abs(np.corrcoef(got, hashes.astype(float))[0, 1]) < 0.05
    if buckets == 8:
        assert np.bincount(got, minlength=8).min() > 2200
    assert not len(substring.bucket_of(words, starts[:0], 35, buckets))


def test_unit_by_bucket():
    data = b"a b c d a b c e"
    hashes, edges, again, starts, which, counts = substring.distinct_windows(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 2, np.array([1]), 8)
    assert counts.tolist() == [8] and len(hashes) == 5 and edges[-1] == 5 and len(edges) == 9
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        assert (np.diff(hashes[lo:hi].astype(float)) > 0).all()
    assert sorted(starts[again[which]].tolist()) == [0, 1, 4, 5]
