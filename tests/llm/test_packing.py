import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stepwell.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, lengths, size):
    """Every id once, offsets without gaps; returns the padding."""
    docs, windows = defaultdict(list), defaultdict(list)
    for window, offset, doc, start, length in pieces:
        assert length > 0
        docs[doc].append((start, length))
        windows[window].append((offset, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(docs[doc]):
            assert start == at
            at += length
        assert at == n
    lost = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        lost += packing.padding(at, size)
    return lost


@pytest.mark.parametrize("size,most,seed,open_ids", [(2048, 6000, 1, 1 << 23), (64, 64, 2, 1 << 23), (64, 300, 3, 500), (16, 9, 4, 1 << 23), (2, 5, 5, 10)])
def test_pieces(monkeypatch, size, most, seed, open_ids):
    monkeypatch.setattr(packing, "OPEN_IDS", open_ids)
    rng = random.Random(seed)
    lengths = [rng.randint(1, most) for _ in range(800)]
    packer = packing.Packer(size)
    pieces = [p for d, n in enumerate(lengths) for p in packer.add(d, n)] + list(packer.finish())
    assert check(pieces, lengths, size) == 0


def test_rule_against_the_definition():
    rng = random.Random(9)
    packer = packing.Packer(32)
    for d in range(500):
        w = rng.randint(1, 31)
        n = packer.levels.copy()

        def squares(h):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + w < 32:
                m[h + w] += 1
            return int((m[1:32] ** 2).sum())

        choices = [h for h in range(0, 32 - w + 1) if h == 0 or n[h]]
        assert squares(packer.level_for(w)) == min(map(squares, choices))
        list(packer.add(d, w))


def test_frame(spark):
    rng = random.Random(2)
    texts = [None, "", "a"] + [" ".join(rng.choice(["the", "and", "ö", "x1"]) for _ in range(rng.randint(1, 3000))) for _ in range(60)]
    rows = [(None if k == 4 else k, t, 5, 6) for k, t in enumerate(texts)] + [(1, "", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, id int")
    got = packing.pack_documents(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by[r.doc_id].append(r)
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(by[i], key=lambda r: r.start)
        if i != 1:
            assert np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist() == ids
        assert all(r.doc_tokens == len(ids) for r in parts)
    assert [r.length for r in by[1]] == [1, 1]
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert packing.padding(at) == 0
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


class Watched(packing.Packer):
    """Counts ids laid down by the rule, those laid down a second time, and holds every cut against the definition."""

    placed = again = cuts = 0

    def _put(self, window, level, doc, start, length):
        self.placed += length
        return super()._put(window, level, doc, start, length)

    def _dissolve(self):
        self.again += int(np.flatnonzero(self.levels)[0])
        return super()._dissolve()

    def _to_close(self):
        self.cuts += 1
        n = self.levels[1 : self.size].astype(int)
        squares = {h + 1: int((n**2).sum() - n[h] ** 2 + (n[h] - 1) ** 2) for h in np.flatnonzero(n)}
        level = super()._to_close()
        assert squares[level] == min(squares.values()) and level == max(h for h, x in squares.items() if x == squares[level])
        return level


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
@pytest.mark.parametrize("partitions", [1, 4, 8])
def test_nearly_all_ids_are_placed_by_the_rule(spark, sf, partitions):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").selectExpr("cast(greatest(n_chars, 0) / 4 as int) + 1 as n").collect()
    lengths = [r.n for r in rows]
    step = -(-len(lengths) // partitions)
    placed = partial = cuts = 0
    for k in range(0, len(lengths), step):
        part = lengths[k : k + step]
        packer = Watched()
        pieces = [p for d, n in enumerate(part) for p in packer.add(d, n)] + list(packer.finish())
        assert check(pieces, part, 2048) == 0
        whole = sum(n // 2048 * 2048 for n in part)
        partial += sum(part) - whole
        placed += packer.placed - packer.again
        cuts += packer.cuts
        rest = sum(n for *_, n in pieces) % 2048
        assert sum(part) - whole - (packer.placed - packer.again) == 0 and rest < 2048
        sizes = defaultdict(int)
        for w, _, _, _, n in pieces:
            sizes[w] += n
        assert sum(n < 2048 for n in sizes.values()) <= 11  # the last rest of a partition
    assert placed >= 0.95 * partial and cuts <= 0.3 * len(lengths)
