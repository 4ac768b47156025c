import random
import re

from stepwell.llm import license_scan as L

ROWS = "doc_id long, text string, labels string, score int"


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text):
    """Every template at every start, every phrase at every place."""
    words = plain_words(text)
    places, base = [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    labels, best = set(base), 1.0 if base else 0.0
    for label, template, keys in L.TEMPLATES:
        t = template.split()
        for start in range(-len(t), len(words)):
            pairs = [(a, words[start + k]) for k, a in enumerate(t) if 0 <= start + k < len(words)]
            hit = [a for a, b in pairs if a == b]
            agreed = {a for a in hit if a.encode() not in L.FUNCTION_WORDS}
            near = True
            for key in keys:
                k = key.split()
                at = start + next(i for i in range(len(t)) if t[i : i + len(k)] == k)
                near &= any(words[i : i + len(k)] == k for i in range(max(0, at - 3), at + 4))
            if near and len(agreed) >= 2 and len(hit) / len(t) >= L.COVERAGE:
                labels.add(label)
                best = max(best, len(hit) / len(t))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(best, 9))


def cases():
    rng = random.Random(3)
    noise = "The and Attion to thanedble 3 4.0 é version licence under".split()
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "CC BY CC BY cc-by", "license mit the under released", "This workß is licensed under gnu general Public LICENSE"]
    out = [None, "", " ", "cc by", "all rights reserved all rights reserved", "Ccby cc  by", lines[3][:40], "ccé by cc by"]
    for k in range(60):
        t = " ".join(rng.choice(noise) for _ in range(rng.randrange(40)))
        for _ in range(rng.randrange(3)):
            t += rng.choice([" ", "\n"]) + rng.choice(lines) + " " + " ".join(rng.choice(noise) for _ in range(5))
        out.append(t)
    for _, template, _ in L.TEMPLATES:
        w = template.split()
        w[rng.randrange(len(w))] = "changed"
        out += [template.upper(), "x " + " ".join(w) + " y"]
    return out


def test_against_brute_force(spark):
    texts = cases()
    docs = spark.createDataFrame([(None if k == 3 else 1 if k == 4 else k, t, "clash", 9) for k, t in enumerate(texts)], ROWS)
    got = L.as_query(L.scan(docs)).collect()
    want = [(None if k == 3 else 1 if k == 4 else k, *plain(t)) for k, t in enumerate(texts)]
    mine = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got]
    assert sorted(map(str, mine)) == sorted(map(str, want))
    assert L.as_query(L.scan(docs.limit(0))).count() == 0


def test_frequencies_cover_all_documents(spark):
    docs = spark.createDataFrame([(k, "the mit license" if k % 3 else "gnu", "", 0) for k in range(30)], ROWS).repartition(7)
    found, n = L.document_frequencies(docs, L.Index.of())
    assert (n, found[b"mit"], found[b"gnu"]) == (30, 20, 10)


def test_a_word_in_very_many_places(monkeypatch):
    monkeypatch.setattr(L, "MANY", 5)
    index = L.Index.of()
    text = b"license " * 50 + b"released under the mit license"
    assert set(index.matches(L.words_of(text))) == {"mit"}
    assert set(index.matches(L.words_of(b"mit license " * 10 + b" released under the mit license"))) == {"mit"}


def test_files_with_several_long_notices(spark):
    notice = {}
    for label, template, _ in L.TEMPLATES:
        notice.setdefault(label, []).append(template)
    apache, mit, isc, gpl = notice["apache-2.0"], notice["mit"][1], notice["isc"][0], notice["gpl"][0]
    texts = [f"{mit}\n\n{apache[0]}", f"x {apache[1]} y {mit} z {isc}", f"{gpl} {isc} {mit} {apache[0]}", " or ".join(t for label in notice for t in notice[label])]
    # Common words of some notices, none of others: the others' words are the rarest.
    common = [f"{apache[0]} {k}" for k in range(40)]
    docs = spark.createDataFrame([(k, t, "clash", 9) for k, t in enumerate(texts + common)], ROWS)
    got = {r.doc_id: r for r in L.as_query(L.scan(docs)).collect()}
    assert got[0].labels == "apache-2.0,mit"
    for k, t in enumerate(texts):
        assert (got[k].labels, round(got[k].score, 9)) == plain(t)[5:]


def test_a_frequent_line_beside_another_notice(monkeypatch):
    index = L.Index.of()
    text = b"Released under the MIT License. " * 2001 + b"Licensed under the GNU Affero General Public License"
    assert set(index.matches(L.words_of(text))) == {"mit", "agpl"}
    for many in (1, 3, 7):  # a notice may lie across the ends of blocks
        monkeypatch.setattr(L, "MANY", many)
        for t in cases():
            got = index.matches(L.words_of((t or "").encode()))
            base = {label for _, label in L.PHRASES}
            assert set(got) | base == set(filter(None, plain(t)[5].split(","))) | base
