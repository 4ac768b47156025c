import random

import numpy as np
import pytest
import xxhash

from stepwell.llm import simhash

ROWS = "doc_id long, text string, fp string, id int"


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def parts(fps, bits):
    """Component number of each fingerprint by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5, 50, 600]:
        t = "  ".join(rng.choice(["Aé", "b\tC", "Ärger", "d", "e" * 40]) for _ in range(n))
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 300)
    t = " ".join(str(k * k % 977) for k in range(2000))
    assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


def flipped(rng, x, bits):
    for b in rng.sample(range(64), bits):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("short,split", [(24, 30_000), (2, 30_000), (2, 5)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, short, split):
    monkeypatch.setattr(simhash, "SHORT", short)
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:20]:
        for _ in range(12):
            x = flipped(rng, x, rng.randrange(1, 7))
            fps.add(x)
    fps = sorted(fps)
    keys = simhash.postings(np.array(fps, np.uint64))
    order = np.argsort(keys.ravel(), kind="stable")
    a, b = simhash.forest(keys.ravel()[order], np.repeat(np.array(fps, np.uint64), 35)[order], 4)
    at = {x: i for i, x in enumerate(fps)}
    want = parts(fps, 4)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (x ^ y).bit_count() <= 4
        root[find(at[x])] = find(at[y])
    got = [find(i) for i in range(len(fps))]
    assert len({*zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(-5, 7), (200, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: -5 for k in [-5, *range(41)]}, **{k: 100 for k in range(100, 160)}}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(rng.randrange(200, 400))) for _ in range(15)]
    texts = [None, "", " \n", "one", "ONE", "two words"]
    for t in base:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
        texts += [t, t]
    rng.shuffle(texts)
    ids = [None if k == 3 else 7 if k in (7, 8) else k for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], ROWS)
    got = simhash.as_query(simhash.near_duplicates(docs)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    part = parts(fps, 4)
    least = {}
    for i, p in zip(ids, part, strict=True):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    want = sorted(str((i, f"{f:016x}", least.get(p))) for i, f, p in zip(ids, fps, part, strict=True))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert len(set(least.values())) < len(texts) - 20
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
