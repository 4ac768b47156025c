"""Substring dedup: words covered by a window of ``width`` words whose word sequence starts anywhere else are removed.

Method: Rabin-Karp hashes of every window, counted in Spark.

1. Documents are dealt by a hash of (id, text, partition) into *units* of some MB; so even a row that is repeated very
   often is many units. Equal texts of a unit are worked on once, with their number. One task turns a unit into word hashes and
   rolling window hashes (polynomials modulo 2**64, prefix sums over NumPy arrays, finished by a bijective mix), drops
   the repeats inside the unit (they are known as repeated there) and sends each different hash once, with one bit
   "repeated here", to the *bucket* that a second, independent polynomial of the window names. A very common window
   therefore leaves a unit once, and the bucket's number is a further part of the hash that costs no bytes.
2. A bucket sorts its hashes; those that came from two units or were marked are repeated. It answers every unit with
   one bit for each hash received.
3. Units meet their answers (the exchange of the documents is the one of step 1, reused), windows flagged as repeated
   merge into maximal removal intervals, and the words outside are kept.

Shuffled: every text once, 8 bytes a different window of a unit, one bit back. Units and buckets have a bounded size;
their number grows with the input. Windows with equal 64-bit hashes in one bucket count as equal. As the bucket comes from
another polynomial, n windows in b buckets have some n**2 / (b * 2**65) pairs of different windows that collide; b is about
n / BUCKET_HASHES, so that is one pair at 10**13 windows and grows with n, not with its square.

Defined results: null text has no words; a text shorter than the window loses nothing; rows that are repeated in the
table (same id and text) each count as a document, so they lose all words that a window covers; an id may be null. A
word is never cut or changed; kept words are joined by one blank.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import binaries, mixed

UNIT_BYTES = 4 << 20
BUCKET_HASHES = 3_000_000
#: Text hashed at a time.
PIECE_BYTES = 1 << 18

_U = np.uint64
#: Odd multipliers of the polynomials over bytes and over words, and a random value for each byte.
BYTE_BASE, WORD_BASE, BUCKET_BASE = _U(0x5851F42D4C957F2D), _U(0x2545F4914F6CDD1D), _U(0xDA942042E4DD58B5)
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1024) * 5 // 4, _U(base), np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[base] = known
    return known[:n]


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of values[starts:ends], each as if it stood alone: sums of value times base**place, modulo 2**64."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(values, powers(int(base), n), out=sums[1:])
    np.cumsum(sums, out=sums)
    inverse = pow(int(base), -1, 1 << 64)
    return (sums[ends] - sums[starts]) * powers(inverse, n + 1)[starts]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) of texts that lie side by side in data."""
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    k = 0
    while k < len(counts):
        # Some texts together, or one long text in pieces that end at a blank.
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE_BYTES, "right")) - 1)
        at, stop = int(offsets[k]), int(offsets[end])
        while at < stop or at == stop == int(offsets[k]):
            to = stop
            if to - at > 2 * PIECE_BYTES:
                to = at + PIECE_BYTES
                while to < stop and not BLANK[data[to - 1]]:
                    to += 1
            part = data[at:to]
            inside = np.empty(len(part) + 2, bool)
            inside[0] = inside[-1] = False
            np.logical_not(BLANK[part], out=inside[1:-1])
            borders = np.unique(np.clip(offsets[k : end + 1] - at, 0, len(part)))
            first = inside[1:] & ~inside[:-1]  # first[i]: a word starts at i
            last = ~inside[1:] & inside[:-1]  # last[i]: a word ends before i
            both = borders[(borders > 0) & (borders < len(part))]
            touch = both[inside[both] & inside[both + 1]]  # texts that meet without a blank
            first[touch] = last[touch] = True
            starts, ends = np.flatnonzero(first), np.flatnonzero(last)
            if len(starts):
                found.append(mixed(polynomial(BYTE_VALUE[part], starts, ends, BYTE_BASE) + (ends - starts).astype(np.uint64)))
                counts[k:end] += np.diff(np.searchsorted(starts, np.clip(offsets[k : end + 1] - at, 0, len(part))))
            if to == stop:
                break
            at = to
        k = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word's place among all words) of every window of width words that lies in one text."""
    per = np.maximum(counts - width + 1, 0)
    total = int(per.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    shift = np.repeat(np.cumsum(counts) - counts - (np.cumsum(per) - per), per)
    starts = np.arange(total) + shift
    return mixed(polynomial(words, starts, starts + width, WORD_BASE)), starts


def bucket_of(words: np.ndarray, starts: np.ndarray, width: int, buckets: int) -> np.ndarray:
    """The bucket of the windows at starts, from a polynomial of its own over the words' hashes mixed once more."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    other = mixed(polynomial(mixed(words ^ BUCKET_BASE), starts, starts + width, BUCKET_BASE)) >> _U(32)
    return (other * _U(buckets) >> _U(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def distinct_windows(data, offsets, width: int, times_of_text: np.ndarray, buckets: int):
    """Of one unit of different texts and the number of times each is there: different hashes by bucket and value, where
    each bucket begins among them, whether each comes up more than once, the windows' starts, the hash of each, words of
    each text."""
    words, counts = word_hashes(data, offsets)
    hashes, starts = window_hashes(words, counts, width)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    which = np.cumsum(new) - 1
    different = ranked[new]
    times = np.bincount(which, minlength=len(different)) if len(different) else np.zeros(0, np.int64)
    again = times > 1
    if (times_of_text > 1).any():
        again[which[np.repeat(times_of_text > 1, np.maximum(counts - width + 1, 0))[order]]] = True
    starts = starts[order]
    bucket = bucket_of(words, starts[new], width, buckets)
    by = np.argsort(bucket, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    edges = np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))
    return different[by], edges, again[by], starts, place[which], counts


def sorted_rows(table: pa.Table) -> pa.Table:
    """Rows of a unit in an order that does not depend on how they came."""
    return table.combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])


def texts_of(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different texts of a unit (null as empty), which of them each row has, and how many rows have each."""
    texts = table.column("text").combine_chunks()
    if not len(texts):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = (texts.fill_null(b"") if texts.null_count else texts).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    rows = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, rows, np.bincount(rows, minlength=len(coded.dictionary))


def drop_repeats(docs: DataFrame, width: int = 35, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, kept (UTF-8 bytes of the kept words), removed (the
    maximal intervals of removed words, as [start, end) pairs), the columns named in carry and, if with_text, text: the
    text as it was where nothing is removed, else the kept words."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length(text_column)).alias("n")).first()["n"] or 0
    units = max(8, -(-total // UNIT_BYTES))
    # A window needs a word and a blank for each of its words: n bytes have n / 2 windows at most, about n / 6 as a rule.
    buckets = max(8, -(-total // (6 * BUCKET_HASHES)))
    id_type = docs.schema[id_column].dataType.simpleString()

    dealt = docs.select(
        F.pmod(F.xxhash64(F.col(id_column), F.col(text_column), F.spark_partition_id()), F.lit(units)).cast("long").alias("unit"),
        F.col(id_column).alias("id"),
        F.col(text_column).cast("binary").alias("text"),
        *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)],
    )
    carried = [f.name for f in dealt.schema if f.name.startswith("carried_")]

    def send(key, table):
        texts, _, times = texts_of(sorted_rows(table))
        data, offsets = binaries(texts)
        hashes, edges, again, *_ = distinct_windows(data, offsets, width, times, buckets)
        full = np.flatnonzero(np.diff(edges))
        return pa.table(
            {
                "bucket": pa.array(full, pa.int64()),
                "from_unit": pa.array(np.full(len(full), key[0].as_py()), pa.int64()),
                "hashes": pa.array([hashes[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
                "again": pa.array([np.packbits(again[edges[b] : edges[b + 1]]).tobytes() for b in full], pa.binary()),
            }
        )

    def answer(table):
        table = table.combine_chunks()
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        marks = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("again"), parts, strict=True)]
        pool = np.concatenate(parts)
        pool.sort()
        repeated = np.union1d(pool[1:][pool[1:] == pool[:-1]], np.concatenate([p[m] for p, m in zip(parts, marks, strict=True)]))
        del pool
        bits = []
        for p in parts:
            at = np.searchsorted(repeated, p)
            at[at == len(repeated)] = 0
            bits.append(np.packbits(repeated[at] == p if len(repeated) else np.zeros(len(p), bool)).tobytes())
        return pa.table({"unit": table.column("from_unit"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    def remove(docs_table, answers):
        table = sorted_rows(docs_table)
        texts, rows, times = texts_of(table)
        data, offsets = binaries(texts)
        hashes, edges, _, starts, which, counts = distinct_windows(data, offsets, width, times, buckets)
        repeated = np.zeros(len(hashes), bool)
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits"), strict=True):
            lo, hi = int(edges[b]), int(edges[b + 1])
            repeated[lo:hi] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=hi - lo)
        hit = starts[repeated[which]] if len(starts) else starts
        change = np.zeros(int(counts.sum()) + 1, np.int32)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + width, -1)
        gone = np.cumsum(change[:-1]) > 0
        firsts = np.cumsum(counts) - counts
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), firsts) * (counts > 0) if len(counts) else counts
        kept, spans = [], []
        for k, text in enumerate(texts):
            words = text.as_py().split()
            mine = gone[firsts[k] : firsts[k] + counts[k]]
            if removed[k]:
                words = list(compress(words, ~mine))
                edge = np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8))
                spans.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(words))
        out = {
            "id": table.column("id"),
            "n_words": pa.array(counts[rows], pa.int64()),
            "n_removed": pa.array(removed[rows], pa.int64()),
            "kept": pa.array([kept[r] for r in rows], pa.binary()),
            "removed": pa.array([spans[r] for r in rows], pa.list_(pa.list_(pa.int64()))),
        }
        if with_text:
            original = table.column("text").to_pylist()
            out["text"] = pa.array([kept[r] if removed[r] else t for r, t in zip(rows, original, strict=True)], pa.binary()).cast(pa.string())
        return pa.table(out | {c: table.column(c) for c in carried})

    # Both uses of dealt have the same columns, so that Spark makes one exchange of them.
    sent = dealt.groupBy("unit").applyInArrow(send, "bucket long, from_unit long, hashes binary, again binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "unit long, bucket long, bits binary")
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in dealt.schema if f.name in carried)
    got = (
        dealt.groupBy("unit")
        .cogroup(answers.groupBy("unit"))
        .applyInArrow(remove, f"id {id_type}, n_words long, n_removed long, kept binary, removed array<array<long>>{', text string' * with_text}{kinds}")
    )
    return got.select(F.col("id").alias(id_column), "n_words", "n_removed", "kept", "removed", *["text"] * with_text, *[F.col(k).alias(c) for k, c in zip(carried, carry, strict=True)])


def digests(result: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], width: int) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, digest) of each text, by a table of all windows; for tests."""
    words = [(t or "").encode().split() for t in texts]
    where: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - width + 1):
            where[tuple(w[i : i + width])] = where.get(tuple(w[i : i + width]), 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if where[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out

