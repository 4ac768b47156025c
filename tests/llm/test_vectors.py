import math
import random

import numpy as np
import pytest

from stepwell.llm import ann, topk

ROWS = "vec_id long, embedding array<float>, label int, v string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", "clash") for i, v in rows], ROWS)


def rows_of(seed, n, width=6):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([-1.0, 0.25, rng.gauss(0, 1)]) for _ in range(width)]) for k in range(n)]
    same = rows[5][1]
    rows += [(n + k, same) for k in range(40)]
    rows += [(1000, None), (1001, []), (1002, [1.0, None]), (1003, [float("nan")] * width), (1004, [float("inf")] * width), (1005, [0.0] * width), (None, same), (1010, [0.5, 2.0])]
    return rows


def plain_topk(rows, every, k):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v[i] = [math.floor(1024 * float(np.float32(c))) for c in x]
    out = []
    for q in v:
        if q % every == 0:
            got = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(got)]
    return sorted(out)


@pytest.mark.parametrize("n,k", [(300, 10), (6, 10), (60, 100)])
def test_topk_against_brute_force(spark, monkeypatch, n, k):
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 3)
    monkeypatch.setattr(topk, "QUERY_CHUNK", 9)
    monkeypatch.setattr(topk, "PIVOTS", 5)
    monkeypatch.setattr(topk, "TILE", 4)
    monkeypatch.setattr(topk, "BOUND_ROWS", 4)
    rows = rows_of(n, n)
    vectors = topk.clean(frame(spark, rows))
    got = topk.top_k(vectors, vectors.where("id % 10 = 0"), k).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_topk(rows, 10, k)


def test_topk_empty_and_huge(spark):
    vectors = topk.clean(frame(spark, [(1000, None)]))
    assert topk.top_k(vectors, vectors).count() == 0
    a = np.array([[1 << 53, -(1 << 53)]])
    assert topk.products(a, a).tolist() == [[(1 << 63) - 1]]
    assert topk.products(a, np.array([[512, 0]])).tolist() == [[1 << 62]]


def test_topk_visits_few_blocks():
    """On vectors in tight groups the bounds leave most blocks unvisited."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (20, 16))
    blocks = [(c + rng.integers(-20, 20, (50, 16)), np.arange(50), np.arange(50) + 50 * k) for k, c in enumerate(centres)]
    query = centres[3]
    table = topk.bounds(query[None, :], np.array([b[0].max(axis=0) for b in blocks]), np.array([b[0].min(axis=0) for b in blocks]))[0]
    visited = []
    seen = [type("B", (tuple,), {})(b) for b in blocks]

    class Watched(list):
        def __getitem__(self, k):
            visited.append(k)
            return super().__getitem__(k)

    scores, ids = topk.search_group(-1, query, table, Watched(seen), 10, None)
    every = np.concatenate([b[0] @ query for b in blocks])
    assert scores.tolist() == sorted(every.tolist(), reverse=True)[:10]
    assert len(visited) < 10


def plain_nearest(rows, every, k):
    v = {i: np.array(x, np.float32).astype(float) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)}
    width = max(map(len, v.values()), default=0)
    v = {i: np.pad(x, (0, width - len(x))) for i, x in v.items()}
    out = {}
    for q in v:
        if q % every == 0:
            got = sorted((-(v[q] @ v[c]) / np.sqrt((v[q] @ v[q]) * (v[c] @ v[c])), c) for c in v if c != q)
            out[q] = [(c, -s) for s, c in got[:k]]
    return out


def test_nearest_small(spark, monkeypatch):
    monkeypatch.setattr(ann, "SEGMENT", 50)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 9)
    rows = rows_of(4, 300)
    vectors = ann.clean(frame(spark, rows))
    got = ann.nearest(vectors, vectors.where("id % 10 = 0"), 5).collect()
    want = plain_nearest(rows, 10, 5)
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert mine.keys() == want.keys()
    for q, pairs in want.items():  # segments are smaller than the least number reranked, so this is exact
        assert np.allclose([s for _, s in pairs], [s for _, s in mine[q]], rtol=0, atol=1e-12)
        assert len({c for c, _ in mine[q]}) == len(pairs)
    assert [c for c, _ in mine[310]] == [5, 300, 301, 302, 303]
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_recall(spark):
    """Vectors without structure are the hardest case."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 64)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    vectors = ann.clean(frame(spark, rows))
    got = ann.nearest(vectors, vectors.where("id % 50 = 0"), 5).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -2
        found += len({*np.argsort(-s)[:5].tolist()} & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 600 and found / 600 >= 0.95


def test_repeated_query_rows_leave_the_others_of_their_class(spark):
    """Four rows hold the asking id, fifteen others its vector, two of them one id."""
    same, far = [1.0, 2.0, 3.0], [0.5, 0.1, 0.2]
    rows = [(0, same)] * 4 + [(k, same) for k in range(1, 15)] + [(3, same)] + [(k, far) for k in range(20, 40)]
    for module, find, k in ((topk, topk.top_k, 10), (ann, ann.nearest, 5)):
        vectors = module.clean(frame(spark, rows))
        got = find(vectors, vectors.where("id = 0"), k).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [1, 2, 3, 3, 4, 5, 6, 7, 8, 9][:k]
        assert len({r.score for r in got}) == 1
        got = find(vectors, vectors.where("id = 9"), k).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [0, 0, 0, 0, 1, 2, 3, 3, 4, 5][:k]
