"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint has 64 bits, eight bytes in eight places. Two fingerprints that differ in at most ``max_bits`` = 4 bits
share at least 8 - 4 = 4 positional bytes, hence at least 3 of any 7 places. So the index posts each different
fingerprint under every 3 of its first 7 positional bytes (35 postings of 24 bits and a place set): a posting list is
the intersection of three one-byte lists. Inside a list the shared positional bytes of pairs are tallied (NumPy, eight
byte comparisons); pairs that reach the guaranteed minimum are verified by counting differing bits. A pair is taken
only in the list of its first three shared places, so it is met once.

No list ever emits its pairs: it emits a forest that connects what its pairs connect (fewer rows than the list is
long). Equal fingerprints are one entry from the start (pre-aggregated before the shuffle), so groups of exact copies
cost nothing. Lists longer than ``SPLIT`` are compared by a fourth positional byte, which linked fingerprints must share,
so the work falls by a factor of some 50; nothing is dropped. A list is held by one task at 16 bytes an entry; it holds
different fingerprints only: the N / 2**24 that share three bytes by chance, and the spread of a group of near copies,
which few unstable bits bound however many documents the group has. Components come from alternating large-star and
small-star steps over the forest, checkpointed.

Defined results: null or blank text has no words and fingerprint zero, which is linked like any other. Rows with equal
ids keep a row each. An id may be null: it takes part, but the smallest id is taken over those that aren't null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stepwell.llm.common import cut, text_bytes

PLACES = 7
SHARED = 3
#: A bit set differs in at most this many bits if the index is to be complete: 8 places less 4 shared ones.
MOST_BITS = 4
#: Hashes tallied at a time.
BLOCK = 1 << 14
#: Runs up to this length are compared by shifting; longer ones by growing connected parts.
SHORT = 24
#: Lists beyond this are dealt again by a fourth byte.
SPLIT = 30_000
TRIPLES = list(combinations(range(PLACES), SHARED))


# ---------------------------------------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, width: int = 4) -> int:
    """Bits set in over half of the XXH64 (seed 42) of the shingles of ``width`` words, as an unsigned integer."""
    words = text.lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
        n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        h = np.fromiter((digest(s, 42) for s in islice(shingles, BLOCK)), "<u8")
        ones += bit_counts(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


#: For each byte value, eight counters of 8 bits in one 64-bit integer.
_SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits: counters of 8 bits, added up 255 at a time."""
    planes = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(planes, np.arange(0, len(planes), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, width: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "fp": pa.array(got.view(np.int64))})

    id_type = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_bytes(text_column)).mapInArrow(run, f"id {id_type}, fp long")


# ---------------------------------------------------------------------------------------------------- links


def differing_bytes(x: np.ndarray) -> np.ndarray:
    """From XORs: how many of the eight positional bytes differ."""
    x = x | x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x0101010101010101))


def _near(x: np.ndarray, max_bits: int) -> np.ndarray:
    """From XORs: the places of the pairs to link. The tally of shared bytes first: it keeps those that reach the minimum
    which max_bits guarantees; of these the differing bits are counted."""
    kept = np.flatnonzero(8 - differing_bytes(x) >= 8 - max_bits)
    return kept[np.bitwise_count(x[kept]) <= max_bits]


def _first_shared(x: np.ndarray) -> np.ndarray:
    """From XORs: the index of the place triple of the first three equal bytes, -1 where fewer than 3 of 7 are equal."""
    same = x.view(np.uint8).reshape(-1, 8) == 0
    return _TRIPLE_OF[same[:, :PLACES] @ (1 << np.arange(PLACES))]


_TRIPLE_OF = np.array(
    [TRIPLES.index(tuple(on[:SHARED])) if len(on := [p for p in range(PLACES) if m >> p & 1]) >= SHARED else -1 for m in range(1 << PLACES)]
)


def _grown(fps: np.ndarray, triple: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over one long list: parts grow from a member by all members linked to it that aren't yet in a part.
    A member is compared only with those outside all parts, so tight groups cost little."""
    left, right = [], []
    rest = fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            x = rest ^ at
            near = _near(x, max_bits)
            if len(near):
                near = near[_first_shared(x[near]) == triple]
            if len(near):
                got = rest[near]
                left.append(np.full(len(got), at))
                right.append(got)
                front.extend(got)
                rest = np.delete(rest, near)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _split(fps: np.ndarray, triple: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """As _grown(), over the sub-lists of each fourth place: every pair to be found shares one of those bytes."""
    left, right = [], []
    for place in set(range(8)) - set(TRIPLES[triple]):
        value = fps.view(np.uint8).reshape(-1, 8)[:, place]
        order = np.argsort(value, kind="stable")
        for part in np.split(fps[order], np.flatnonzero(np.diff(value[order])) + 1):
            a, b = _grown(part, triple, max_bits)
            left.append(a)
            right.append(b)
    return np.concatenate(left), np.concatenate(right)


def forest(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of posting lists: keys are sorted, equal keys are one list; key = triple * 2**24 + three bytes."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edges)
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for k in np.flatnonzero(sizes > SHORT):
        a, b = (_grown if sizes[k] <= SPLIT else _split)(fps[edges[k] : edges[k + 1]], int(keys[edges[k]] >> 24), max_bits)
        left.append(a)
        right.append(b)
    short = np.repeat((sizes > 1) & (sizes <= SHORT), sizes)
    keys, fps = keys[short], fps[short]
    for shift in range(1, SHORT):
        if len(keys) <= shift:
            break
        at = np.flatnonzero(keys[shift:] == keys[:-shift])
        if not len(at):
            break
        x = fps[at] ^ fps[at + shift]
        near = _near(x, max_bits)
        near = near[_first_shared(x[near]) == keys[at[near]] >> 24]
        left.append(fps[at[near]])
        right.append(fps[at[near] + shift])
    return np.concatenate(left), np.concatenate(right)


def postings(fps: np.ndarray) -> np.ndarray:
    """Keys of the 35 lists of each fingerprint, as a matrix."""
    b = fps.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
    return np.stack([(t << 24) | (b[:, p] << 16) | (b[:, q] << 8) | b[:, r] for t, (p, q, r) in enumerate(TRIPLES)], axis=1)


def links(different: DataFrame, max_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): links that connect what all pairs of fingerprints within max_bits connect. different: one column fp, no repeats."""
    if not 0 <= max_bits <= MOST_BITS:
        raise ValueError(f"the index is complete for 0 to {MOST_BITS} differing bits")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            keys = postings(fps.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel()), "fp": pa.array(np.repeat(fps, keys.shape[1]))})

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))], 0
        for batch in batches:
            parts.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            n += batch.num_rows
            first = next(k[0] for k, _ in parts if len(k))
            if n < 1 << 20 or first == parts[-1][0][-1]:
                continue
            keys, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
            whole = int(np.searchsorted(keys, keys[-1]))  # the last list may go on in the next batch
            yield from out(*forest(keys[:whole], fps[:whole], max_bits))
            parts, n = [(keys[whole:], fps[whole:])], len(keys) - whole
        keys, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(keys):
            yield from out(*forest(keys, fps, max_bits))

    def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    posted = different.select("fp").mapInArrow(post, "key long, fp long")
    return posted.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(match, "a long, b long")


# ----------------------------------------------------------------------------------------------- components


def _splittable(rows: str, per: str):
    """Equality of a column with that of an aggregate, with its hash as a second key: the aggregate's own partitioning
    then doesn't do for the join, so both sides get a plain exchange, of which adaptive execution splits hot parts."""
    return (F.col(rows) == F.col(per)) & (F.xxhash64(rows) == F.xxhash64(per))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn until nothing changes: every step links a node's neighbours to the smallest
    of them, the links of a step are never more than before plus one a node, and the number of steps grows with the
    logarithm of the longest path. A node with very many neighbours is aggregated before the shuffle; the join that
    hands its minimum back to them is one that Spark can split (_splittable)."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(F.col("a").alias("u"), "m")
        large = both.where("b > a").join(least, _splittable("a", "u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(lowest, _splittable("a", "u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(lowest.select("u", "m")).where("a <> b").distinct()
        # Counted by the step itself, as it is written; a task that ran twice can only cost another step.
        seen = Observation()
        edges = cut(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
        now = seen.get
        if now == state or not now["n"]:
            break
        state = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = MOST_BITS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: id, fp (signed 64 bits), component_id (smallest id reachable by links)."""
    rows = cut(fingerprints(docs, width, id_column, text_column))
    different = cut(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    found = components(links(different, max_bits))
    linked = different.join(found, F.col("fp") == F.col("node"))
    named = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    moved = cut(found.join(named, "root").select(F.col("node").alias("fp"), "component_id"))
    # Cut, so that the last join is between two plain exchanges, of which Spark splits the one with a hot fingerprint.
    per = cut(different.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")))
    return rows.join(per, "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def as_query(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
