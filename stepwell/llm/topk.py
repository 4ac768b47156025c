"""Exact top-k inner products by block-at-a-time pruning.

Vectors are scaled to integers; a component is a term, its value the impact. Candidates lie in *blocks*, ranges of
documents in an order that puts like vectors side by side (nearest of some pivots, then id). A block keeps, for each
term, its largest and its smallest impact and a forward index (the matrix of its vectors). For a query the bound of a
block is the sum over terms of the larger product with either extreme, so no score in the block exceeds it. Blocks are
visited in order of falling bound and scored through their forward index until the next bound is below the kth score
(equal bounds are still visited: ties go to the smaller id). Nothing is approximate, whatever the order is worth.

In Spark: blocks are grouped; a group is one binary row of bounded size. The extremes of groups lie side by side in
*tiles*, queries in chunks, both of bounded size, and bounds are made a (chunk, tile) cell at a time, without a row for
each query and group. A first round finds the group of each query's largest bound (a row for each query and tile), searches
it, and so has a lower limit of every query's kth score. The second makes the bounds again and leaves one row for each
chunk and group, with only those queries whose bound reaches their limit; what is pruned leaves no row at all. Partial
lists of k rows are merged per query.

Equal vectors are one candidate with their k + 1 smallest different ids, each as often as rows hold it, up to k + 1 times
(no other id of the class can appear, whichever id asks and is left out), thinned before the shuffle, so a vector that a third of all rows hold costs as much as one.

Defined results: vectors that are null, or hold null or non-finite components take no part, nor do rows without id. Vectors
of different length are compared as if padded with zeros, so an empty one scores 0 with all. A repeated id counts as so many rows, of which
those with the query's id are all left out; of query rows with one id the smallest vector asks. Scaled components
beyond 2**53 are cut there; scores beyond 64 bits are cut at the limits of a long. With fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.llm.common import cut, smallest_hashes, stored

BLOCK = 128
GROUP_BLOCKS = 64
QUERY_CHUNK = 8192
#: Groups whose extremes lie side by side, and queries whose bounds for them are held at a time.
TILE, BOUND_ROWS = 1024, 512
PIVOTS = 64
SCALE = 1024
_LIMIT = 1 << 53


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def scaled(vector: Column) -> Column:
    """floor(1024 * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(_LIMIT))), F.lit(-float(_LIMIT)))).cast("long"))


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as one int64 matrix, padded with zeros."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [[]]).astype(int)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: in doubles while every partial sum stays below 2**53, else in integers of any size, cut to 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    got = a.astype(object) @ b.T.astype(object)
    return np.clip(got, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block the sum over terms of the larger product with the block's extremes."""
    return products(np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1), np.concatenate([high, low], 1))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_group(query_id: int, query: np.ndarray, bound: np.ndarray, blocks: list, k: int, limit: int | None):
    """The k best of the blocks for one query, visited by falling bound; limit: a score that k rows are known to reach."""
    scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in np.argsort(-bound, kind="stable"):
        kth = scores[-1] if len(scores) == k else None
        if limit is not None and (kth is None or limit > kth):
            kth = limit
        if kth is not None and bound[b] < kth:
            break
        vectors, owner, members = blocks[b]
        got = products(query[None, :], vectors)[0][owner]
        keep = members != query_id
        if kth is not None:
            keep &= got >= kth
        if keep.any():
            scores, ids = best_of(np.concatenate([scores, got[keep]]), np.concatenate([ids, members[keep]]), k)
    return scores, ids


def build_groups(vectors: DataFrame, rows: int, width: int, k: int) -> DataFrame:
    """(gid, data): blocks in groups. vectors: id, v. Rows of a group: matrices of vectors, owners and ids."""
    seeds = smallest_hashes(vectors, ["id", "v"], PIVOTS, rows).select("v").toArrow()
    pivots = matrix(seeds.column("v").combine_chunks(), width).astype(np.float64) if seeds.num_rows else np.zeros((1, width))
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-9)

    different = classes(vectors, k + 1)

    def place(batches):
        for batch in batches:
            m = matrix(batch.column("v"), width).astype(np.float64)
            near = np.argmax(m @ pivots.T, axis=1)
            yield pa.RecordBatch.from_pydict({"v": batch.column("v"), "ids": batch.column("ids"), "near": pa.array(near, pa.int64())})

    placed = cut(different.mapInArrow(place, "v array<long>, ids array<long>, near long"))
    # Rows of a neighbourhood are dealt to as many groups as its size needs, at most GROUP_BLOCKS blocks each.
    sizes = placed.groupBy("near").agg(F.count("*").alias("n"))
    room = BLOCK * GROUP_BLOCKS
    dealt = placed.join(F.broadcast(sizes), "near").withColumn(
        "gid", F.concat_ws("-", "near", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / room)))
    )

    def pack(key, table):
        table = table.combine_chunks()
        counts = table.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        m = matrix(table.column("v").combine_chunks(), width)
        return pa.table(
            {
                "gid": pa.array([key[0].as_py()], pa.string()),
                "vectors": pa.array([m.tobytes()], pa.binary()),
                "counts": pa.array([counts.astype(np.int64).tobytes()], pa.binary()),
                "members": pa.array([table.column("ids").combine_chunks().flatten().to_numpy().astype(np.int64).tobytes()], pa.binary()),
                "high": pa.array([m.max(axis=0).tolist()], pa.list_(pa.int64())),
                "low": pa.array([m.min(axis=0).tolist()], pa.list_(pa.int64())),
            }
        )

    groups = dealt.select("gid", "v", "ids").groupBy("gid").applyInArrow(pack, "gid string, vectors binary, counts binary, members binary, high array<long>, low array<long>")
    return stored(groups)


def classes(vectors: DataFrame, few: int) -> DataFrame:
    """(v, ids): different vectors with the rows of their few smallest different ids, at most few rows an id. Ids of a
    vector are thinned within 64 salts first, so a vector that very many rows hold is never gathered in one task."""
    salted = vectors.select("v", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    ids, rows = Window.partitionBy("v", "salt").orderBy("id"), Window.partitionBy("v", "salt", "id").orderBy("id")
    thin = salted.withColumn("r", F.dense_rank().over(ids)).where(F.col("r") <= few)
    thin = thin.withColumn("n", F.row_number().over(rows)).where(F.col("n") <= few)
    every = thin.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    smallest = F.slice(F.array_distinct("ids"), 1, few)
    return every.select("v", F.filter("ids", lambda x: x <= F.array_max(smallest)).alias("ids"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score. candidates and queries: (id, v) with v an array of longs."""
    spark = candidates.sparkSession
    shape = candidates.union(queries).agg(F.max(F.size("v")).alias("width"), F.count("*").alias("rows")).first()
    if shape["width"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, shape["width"])
    groups = build_groups(candidates, shape["rows"], width, k)
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    chunks, tiles = max(1, -(-queries.count() // QUERY_CHUNK)), max(1, -(-groups.count() // TILE))
    asked = cut(queries.select(F.col("id").alias("query_id"), "v", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(chunks)).cast("long").alias("chunk")))
    # Every chunk meets the extremes of every tile: a stated query set against all rows, in blocks.
    extremes = (
        groups.groupBy(F.pmod(F.xxhash64("gid"), F.lit(tiles)).alias("tile"))
        .agg(F.collect_list(F.struct("gid", "high", "low")).alias("groups"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    )

    def cells(rows: DataFrame) -> DataFrame:
        """rows: query_id, v, chunk, limit, seen."""
        packed = rows.groupBy("chunk").agg(F.collect_list(F.struct("query_id", "v", "limit", "seen")).alias("queries"))  # at most some QUERY_CHUNK rows
        return extremes.join(packed, "chunk").select("queries", "groups")

    def each_cell(make):
        """make(queries, gids, bounds) of each cell; bounds comes for some queries at a time."""

        def over(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    queries, tile = batch.column("queries")[row].values, batch.column("groups")[row].values
                    m, high, low = matrix(queries.field("v"), width), matrix(tile.field("high"), width), matrix(tile.field("low"), width)
                    yield from make(queries, tile.field("gid"), (bounds(m[at : at + BOUND_ROWS], high, low) for at in range(0, len(m), BOUND_ROWS)))

        return over

    def largest(queries, gids, bound):
        best, most = zip(*((b.argmax(axis=1), b.max(axis=1)) for b in bound), strict=True)
        yield pa.RecordBatch.from_pydict({"query_id": queries.field("query_id"), "bound": pa.array(np.concatenate(most), pa.int64()), "gid": gids.take(pa.array(np.concatenate(best)))})

    def reached(queries, gids, bound):
        seen = queries.field("seen")
        low = queries.field("limit").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)[:, None]
        wanted = np.concatenate([b >= low[k * BOUND_ROWS : k * BOUND_ROWS + len(b)] for k, b in enumerate(bound)])
        for g, gid in enumerate(gids.to_pylist()):
            at = np.flatnonzero(wanted[:, g])
            at = at[pc.not_equal(seen.take(pa.array(at)), gid).to_numpy(zero_copy_only=False)]
            if len(at):
                mine = queries.take(pa.array(at))
                listed = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.StructArray.from_arrays([mine.field(c) for c in ("query_id", "v", "limit")], ["query_id", "v", "limit"]))
                yield pa.RecordBatch.from_pydict({"gid": pa.array([gid]), "queries": listed})

    def search(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                wanted = batch.column("queries")[row].values
                vectors = np.frombuffer(batch.column("vectors")[row].as_buffer(), np.int64).reshape(-1, width)
                counts, members = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in ("counts", "members"))
                ends = np.cumsum(counts)
                blocks, high, low = [], [], []
                for lo in range(0, len(vectors), BLOCK):
                    hi = min(lo + BLOCK, len(vectors))
                    part = vectors[lo:hi]
                    blocks.append((part, np.repeat(np.arange(hi - lo), counts[lo:hi]), members[ends[lo] - counts[lo] : ends[hi - 1]]))
                    high.append(part.max(axis=0))
                    low.append(part.min(axis=0))
                m = matrix(wanted.field("v"), width)
                table = bounds(m, np.array(high), np.array(low))
                out = []
                for q, (query, limit) in enumerate(zip(wanted.field("query_id").to_pylist(), wanted.field("limit").to_pylist(), strict=True)):
                    scores, ids = search_group(query, m[q], table[q], blocks, k, limit)
                    out.append((np.full(len(ids), query), ids, scores))
                cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    # A group that all queries want has a row for each chunk; the join is between plain exchanges, so a hot group is split.
    def visit(wanted: DataFrame) -> DataFrame:
        """wanted: gid, queries."""
        return wanted.join(groups.select("gid", "vectors", "counts", "members"), "gid").select("queries", "vectors", "counts", "members").mapInArrow(search, "query_id long, vec_id long, score long")

    nothing = asked.withColumns({"limit": F.lit(None).cast("long"), "seen": F.lit(None).cast("string")})
    best = cells(nothing).mapInArrow(each_cell(largest), "query_id long, bound long, gid string").groupBy("query_id").agg(F.max(F.struct("bound", "gid"))["gid"].alias("seen"))
    started = cut(asked.join(best, "query_id"))
    first = cut(visit(started.groupBy(F.col("seen").alias("gid"), "chunk").agg(F.collect_list(F.struct("query_id", "v", F.lit(None).cast("long").alias("limit"))).alias("queries")).select("gid", "queries")))
    of_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    limits = first.withColumn("r", F.row_number().over(of_query)).where(F.col("r") == k).select("query_id", F.col("score").alias("limit"))
    rest = cells(started.join(limits, "query_id", "left"))
    found = first.union(visit(rest.mapInArrow(each_cell(reached), "gid string, queries array<struct<query_id: long, v: array<long>, limit: long>>")))
    return (
        found.withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def clean(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    return vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector_column))).select(
        F.col(id_column).cast("long").alias("id"), scaled(F.col(vector_column)).alias("v")
    )
