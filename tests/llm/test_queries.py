"""The thin queries on the smallest tables, against SQL or brute force."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from stepwell.llm import queries, quality
from stepwell.llm.substring import BYTE_BASE, BYTE_VALUE, mixed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(con):
    return con.execute("select doc_id, text from documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


def test_op1(spark, texts):
    prints = {}
    for i, t in texts:
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    component = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and component[b] < component[a]:
                    component[a], changed = component[b], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash_dedup(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", component[i]) for i in prints}


def test_op4(spark, texts):
    got = {r.doc_id: r for r in queries.op4_license_scan(spark, SF).collect()}
    import re

    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, t in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places, labels = [], set()
        for p, label in phrases.items():
            p = p.split()
            found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r.labels.split(",")) | ({""} if not r.labels else set()) and 0 <= r.score <= 1


def test_op5_op7_op10(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4") for i, t in texts}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_bpe_codec(spark, SF).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {i: (len(x), sha(x.tobytes()), sha(tokenizer.decode(x.tolist(), skip_special_tokens=False).encode())) for i, x in ids.items()}

    windows, pieces = defaultdict(list), defaultdict(list)
    for r in queries.op5_packing(spark, SF).collect():
        whole = np.append(ids[r.doc_id], np.uint32(1)).astype("<u4")
        assert r.doc_tokens == len(whole) and zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for parts, ends in [(p, None) for p in windows.values()] + [(pieces[i], len(ids[i]) + 1) for i in ids]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= 2048 if ends is None else at == ends

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in queries.op10_token_counts(spark, SF).collect()}
    assert got == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in texts}


def plain_features(text: bytes) -> set[int]:
    """The features of a text, one by one, in integers of Python."""
    cut, out = 1 << 64, set()
    for k in range(len(text) - 2):
        out.add(((text[k] << 16 | text[k + 1] << 8 | text[k + 2]) * 2654435761 % (1 << 32)) >> 16)
    words = []
    for w in text.split():
        h = sum(int(BYTE_VALUE[b]) * pow(int(BYTE_BASE), j, cut) for j, b in enumerate(w)) + len(w)
        words.append(int(mixed(np.array([h % cut], np.uint64))[0]))
    out |= {(w >> 48) + quality.SPACE for w in words}
    return out | {((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93 % cut >> 48) + 2 * quality.SPACE for a, b in zip(words, words[1:])}


def test_op6(spark, con):
    """Against a version that makes features one by one and sums up margins in a loop."""
    rows = con.execute("select doc_id, text, quality from documents left join labels using (doc_id) order by doc_id").fetchall()
    found = {i: np.array(sorted(plain_features((t or "").encode())), np.int64) for i, t, _ in rows}
    learn = [(i, q) for i, _, q in rows if q is not None and zlib.crc32(str(i).encode()) % 5]
    order = np.random.default_rng(3).permutation(len(learn))
    model = quality.fit([found[learn[k][0]] for k in order], np.array([learn[k][1] > 0 for k in order]))
    got = {r.doc_id: r for r in queries.op6_quality_classifier(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        length = sum(float(model.squares[f]) for f in found[i]) ** 0.5 or 1.0
        margin = sum(float(model.weights[f]) for f in found[i]) / length + model.bias
        score = 1 / (1 + np.exp(-(model.slope * margin + model.shift)))
        assert abs(got[i].score - score) < 1e-6 and got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op6_sample_is_bounded_in_bytes(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    every, _ = quality.training_rows(docs, labels, 1000)
    some, positive = quality.training_rows(docs, labels, 1000, most_bytes=sum(4 * len(f) for f in every) // 3)
    assert 0 < len(some) == len(positive) < len(every) and sum(4 * len(f) for f in some) <= sum(4 * len(f) for f in every) // 3


def test_op9(spark, con):
    rows = con.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = defaultdict(list)
    for r in queries.op9_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = wanted = 0
    for k, i in enumerate(ids):
        if i % 50 == 0:
            score = unit @ unit[k]
            score[k] = -2
            best = np.lexsort((ids, -score))[:5]
            hits, wanted = hits + len({*ids[best]} & {v for v, _ in got[i]}), wanted + min(5, len(ids) - 1)
            for v, s in got[i]:
                assert abs(s - score[ids.tolist().index(v)]) < 1e-9
    assert hits >= 0.9 * wanted
