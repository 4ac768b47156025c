"""Approximate nearest neighbours by a permutation index, for cosine.

Every vector is represented by its nearest pivots in order. It is posted, with its place in that order, in the inverted
file of each of its ``POSTED`` nearest pivots. A query walks the files of its ``ASKED`` nearest pivots and sums the
footrule distance between the places that pivot has in both orders (a vector missing from a file counts as in place
POSTED); the vectors of least footrule are reranked by their cosine in double precision, on the original vectors.

In Spark the index is cut into segments of bounded size by a hash of the vector; a segment is one row with its vectors
and its files as arrays (a pivot's postings side by side). Every query meets every segment in chunks of queries and
leaves the k best of each, which are merged per query. All rows are indexed; only the pivots are a sample: the
``PIVOTS`` vectors of smallest hashed id. Equal vectors are one entry with their k + 1 smallest different ids, each
as often as rows hold it (up to k + 1 times), thinned before the shuffle.

Recall of the 5 nearest against brute force, on vectors without any structure (64 dimensions), is given in the README
and tested.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without id. Vectors of different length are compared as if padded with zeros. Of query rows with one id the smallest
vector asks, and all rows with its id are left out. With fewer than k candidates all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwell.llm.common import cut, smallest_hashes, stored
from stepwell.llm.topk import classes, usable

PIVOTS = 256
POSTED = 128
ASKED = 64
#: Share of a segment that is reranked, and its least number.
RERANKED, RERANKED_LEAST = 0.08, 256
#: The index is sent once a chunk of queries, the queries once a segment: with both of like size neither dominates.
SEGMENT = 8192
QUERY_CHUNK = 8192


def clean(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    v = F.col(vector_column)
    return vectors.where(F.col(id_column).isNotNull() & usable(v) & F.exists(v, lambda x: x != 0)).select(
        F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("v")
    )


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles, padded with zeros, each times a power of two (exact) that brings
    its largest component near 1, so that squares neither overflow nor vanish."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0, keepdims=True))[1])


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def order_of(m: np.ndarray, pivots: np.ndarray, first: int) -> np.ndarray:
    """The first pivots of each vector, nearest first."""
    return np.argsort(-(m @ pivots.T), axis=1, kind="stable")[:, :first].astype(np.int16)


def inverted(orders: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, vectors, places): the postings of pivot p stand at edges[p]:edges[p + 1]."""
    n, posted = orders.shape
    by = np.argsort(orders.ravel(), kind="stable")
    edges = np.searchsorted(orders.ravel()[by], np.arange(pivots + 1))
    return edges, (by // posted).astype(np.int32), (by % posted).astype(np.int16)


def footrule(asked: np.ndarray, files, n: int, posted: int) -> np.ndarray:
    """Summed distance of places for each vector of a segment."""
    edges, vectors, places = files
    total = np.full(n, int(np.abs(posted - np.arange(len(asked))).sum()), np.int32)
    for place, pivot in enumerate(asked):
        at = slice(edges[pivot], edges[pivot + 1])
        # A vector is at most once in a file.
        total[vectors[at]] += np.abs(places[at].astype(np.int32) - place) - abs(posted - place)
    return total


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    dots = (vectors * query).sum(axis=1)
    return dots / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 5, reranked: float = RERANKED) -> DataFrame:
    """query_id, rank, vec_id, score. candidates and queries: (id, v) as from clean()."""
    spark = candidates.sparkSession
    shape = candidates.union(queries).agg(F.max(F.size("v")).alias("width")).first()
    width = shape["width"]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    different = cut(classes(candidates, k + 1))
    size = different.count()
    segments = max(1, -(-size // SEGMENT))
    sample = smallest_hashes(different, ["ids", "v"], PIVOTS, size).select("v").toArrow()
    pivots = unit(matrix(sample.column("v").combine_chunks(), width)) if sample.num_rows else np.zeros((0, width))
    posted, asked_first = min(POSTED, len(pivots)), min(ASKED, len(pivots))

    def pack(key, table):
        table = table.combine_chunks()
        m = matrix(table.column("v").combine_chunks(), width)
        ids = table.column("ids").combine_chunks()
        edges, vectors, places = inverted(order_of(m, pivots, posted), len(pivots))
        arrays = {"vectors": m, "counts": ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), "members": ids.flatten().to_numpy().astype(np.int64), "edges": edges.astype(np.int64), "posted": vectors, "places": places}
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in arrays.items()})

    files = ("vectors", "counts", "members", "edges", "posted", "places")
    index = stored(
        different.select(F.pmod(F.xxhash64("v"), F.lit(segments)).cast("long").alias("segment"), "v", "ids")
        .groupBy("segment")
        .applyInArrow(pack, "segment long" + "".join(f", {c} binary" for c in files))
    )

    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    chunks = max(1, -(-queries.count() // QUERY_CHUNK))

    def search(key, asked, segment):
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not asked.num_rows or not segment.num_rows:
            return none
        kinds = {"vectors": np.float64, "posted": np.int32, "places": np.int16}
        x = {c: np.frombuffer(segment.column(c)[0].as_py(), kinds.get(c, np.int64)) for c in files}
        vectors = x["vectors"].reshape(-1, width)
        n, firsts = len(vectors), np.cumsum(x["counts"]) - x["counts"]
        asked = asked.combine_chunks()
        q = matrix(asked.column("v").combine_chunks(), width)
        orders = order_of(q, pivots, asked_first)
        most = min(n, max(RERANKED_LEAST, int(np.ceil(reranked * n))))
        out = []
        for row, query_id in enumerate(asked.column("query_id").to_pylist()):
            far = footrule(orders[row], (x["edges"], x["posted"], x["places"]), n, posted)
            near = np.argpartition(far, most - 1)[:most] if most < n else np.arange(n)
            score = cosine(q[row], vectors[near])
            best = np.argsort(-score, kind="stable")[: 2 * k + 2]
            best = np.flatnonzero(score >= score[best[-1]])  # ties at the end stay
            counts = x["counts"][near[best]]
            members = np.concatenate([x["members"][firsts[i] : firsts[i] + c] for i, c in zip(near[best], counts, strict=True)])
            scores = np.repeat(score[best], counts)
            own = members != query_id
            members, scores = members[own], scores[own]
            top = np.lexsort((members, -scores))[:k]
            out.append((np.full(len(top), query_id), members[top], scores[top]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(segments - 1).cast("long"))).alias("segment")
    asked = queries.select(F.col("id").alias("query_id"), "v", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(chunks)).cast("long").alias("chunk"), every)
    replicas = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    found = asked.groupBy("segment", "chunk").cogroup(replicas.groupBy("segment", "chunk")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
