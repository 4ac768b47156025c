"""Token counts of flat token files by a separator scan.

A token file is a flat run of fixed-width ids; each document ends with the end-of-document id, and there is no index. A
file is read in blocks of fixed size that know nothing of documents. One vectorised comparison finds the separators of
a block. A document that begins in one block and ends in another is stitched by a prefix scan over the blocks of its
file: the tokens before a block (running sum) and the place after the last separator before it (running maximum).
The scan has two levels, over ranges of ``RANGE`` blocks and over the ranges of a file, and sees three numbers a block;
what it finds is joined to the blocks, whose ends of documents and ids stay spread over tasks however long a file is.

``token_blocks`` writes such files from documents (parquet rows of one block each, as executors share no folder of
their own); the block also names the documents that end in it, so that counts carry ids. ``read_blocks`` reads raw
binary files of any size as the same rows: a row for each range of bytes, which its task reads by itself.

Defined results: a document without tokens has count 0. What stands after the last separator of a file is a document
that isn't closed; an empty rest is none. Null and empty texts are documents of 0 tokens. Rows with equal ids keep a
row each. A separator's text inside a document is ordinary text, so it is never taken for an end. An end id that is an
ordinary entry of the vocabulary will do as long as no text has it; if one does, its file would be ambiguous, so
``token_blocks`` raises. Ids are as wide as the vocabulary and the end id need (2 or 4 bytes). A file whose size isn't
a multiple of the width is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwell.llm.bpe import codec_of, read_vocabulary, texts_of, vocabulary_size
from stepwell.llm.common import stored, text_bytes

BLOCK_TOKENS = 1 << 17
END_ID = 50256
#: Blocks of the lower level of the prefix scan.
RANGE = 4096
#: Blocks of a raw file that lie side by side in a task.
RUN = 512


def width_of(vocabulary_size: int) -> str:
    """The narrowest unsigned type that holds all ids."""
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def width_for(vocabulary: str, end_id: int = END_ID) -> str:
    """The width of the token files of a vocabulary."""
    return width_of(max(vocabulary_size(read_vocabulary(vocabulary)), end_id + 1))


def token_blocks(docs: DataFrame, vocabulary: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(file, block, data, ids): the token files of docs, one a partition; ids: documents whose separator is in the block."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = width_for(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec = codec_of(shipped.value, specials_as_text=True, library=True)
        file = TaskContext.get().partitionId()
        can_occur = end_id < len(codec.entries) and codec.of.get(codec.entries[end_id]) == end_id
        buffer, used, block, ended = np.empty(block_tokens, kind), 0, 0, []
        id_kind = pa.int64()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([str(file)]),
                    "block": pa.array([block], pa.int64()),
                    "data": pa.array([buffer[:used].tobytes()], pa.binary()),
                    "ids": pa.array([ended], pa.list_(id_kind)),
                }
            )

        for batch in batches:
            id_kind = batch.schema.field("id").type
            for doc_id, text in zip(batch.column("id").to_pylist(), texts_of(batch.column("text")), strict=True):
                tokens = codec.encode(text)
                if can_occur and (tokens == end_id).any():
                    raise ValueError(f"the end id {end_id} is an ordinary entry, and a document has it: its end could not be told")
                tokens = np.append(tokens, np.uint32(end_id)).astype(kind)
                at = 0
                while at < len(tokens):
                    n = min(len(tokens) - at, block_tokens - used)
                    buffer[used : used + n] = tokens[at : at + n]
                    used, at = used + n, at + n
                    if at == len(tokens):
                        ended.append(doc_id)
                    if used == block_tokens:
                        yield out()
                        used, block, ended = 0, block + 1, []
        if used:
            yield out()

    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), text_bytes(text_column))
    return rows.mapInArrow(run, f"file string, block long, data binary, ids array<{id_type}>")


def _open(path: str):
    """A file of a store that Python reaches: a mounted one, or one that Arrow has a client for (S3, GCS, HDFS)."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def read_blocks(spark: SparkSession, path: str, width: str = "<u2", block_tokens: int = BLOCK_TOKENS, opener: Callable = _open) -> DataFrame:
    """(file, block, data) of raw flat files under a path. Spark lists the files; the blocks of a file are dealt in runs,
    and a task reads a block's bytes alone, so a file may be of any size. opener(path): a file with read_at(n, start)."""
    size = np.dtype(width).itemsize * block_tokens
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    blocks = files.select("file", "length", F.explode(F.expr(f"sequence(0L, greatest(0L, (length - 1) div {size}))")).alias("block"))
    # As many partitions as there are runs: these rows are short, but stand for much, so Spark may not put them together.
    runs = blocks.agg(F.countDistinct("file", F.expr(f"block div {RUN}"))).first()[0]
    dealt = blocks.repartition(max(1, runs), "file", F.expr(f"block div {RUN}")).sortWithinPartitions("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None
        for batch in batches:
            for file, length, block in zip(*(batch.column(c).to_pylist() for c in ("file", "length", "block")), strict=True):
                if length % np.dtype(width).itemsize:
                    raise ValueError(f"{file}: {length} bytes are not a whole number of ids")
                if file != name:
                    name, handle = file, opener(file)
                data = handle.read_at(min(size, length - block * size), block * size)
                yield pa.RecordBatch.from_pydict({"file": pa.array([file]), "block": pa.array([block], pa.int64()), "data": pa.array([bytes(data)], pa.binary())})

    return dealt.mapInArrow(run, "file string, block long, data binary")


def _prefix_scan(blocks: DataFrame) -> DataFrame:
    """file, block, base (tokens before the block), n_before (separators before it), open_from (the place after the last
    separator before it), last_end (after its own last one, or null), is_last. blocks: file, range, block, size, n,
    after_last (the place after the last separator, counted in the block)."""

    def scan(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        return rows.withColumn("last_end", F.col("base") + F.col("after_last")).withColumn("open_from", F.max("last_end").over(before))

    inside = scan(blocks, ["file", "range"], "block")
    whole = inside.groupBy("file", "range").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.max("last_end").alias("after_last"), F.max("block").alias("last_block"))
    ranges = scan(whole, ["file"], "range").withColumn("is_last", F.lead("range").over(Window.partitionBy("file").orderBy("range")).isNull())
    ranges = ranges.select("file", "range", *[F.col(c).alias(f"range_{c}") for c in ("base", "n_before", "open_from")], "is_last", "last_block")
    return inside.join(ranges, ["file", "range"]).select(
        "file",
        "block",
        (F.col("base") + F.col("range_base")).alias("base"),
        (F.col("n_before") + F.col("range_n_before")).alias("n_before"),
        F.coalesce(F.col("open_from") + F.col("range_base"), "range_open_from", F.lit(0)).alias("open_from"),
        (F.col("last_end") + F.col("range_base")).alias("last_end"),
        (F.col("is_last") & (F.col("block") == F.col("last_block"))).alias("is_last"),
    )


def count_tokens(blocks: DataFrame, end_id: int = END_ID, width: str = "<u2") -> DataFrame:
    """One row for each document: file, number (from 0, in its file's order), doc_id (where blocks carry ids, else null),
    start (its first token's place in the file), n_tokens (without the separator), closed."""
    named = "ids" in blocks.columns
    id_type = blocks.schema["ids"].dataType.elementType.simpleString() if named else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for data in batch.column("data"):
                tokens = np.frombuffer(data.as_buffer(), width)
                sizes.append(len(tokens))
                ends.append(np.flatnonzero(tokens == end_id).tolist())
            yield pa.RecordBatch.from_pydict(
                {"file": batch.column("file"), "block": batch.column("block"), "size": pa.array(sizes, pa.int64()), "ends": pa.array(ends, pa.list_(pa.int64()))}
                | ({"ids": batch.column("ids")} if named else {})
            )

    columns = ["file", "block", "data", *["ids"] * named]
    scanned = blocks.select(*columns).mapInArrow(run, "file string, block long, size long, ends array<long>" + f", ids array<{id_type}>" * named)
    if not named:
        scanned = scanned.withColumn("ids", F.transform("ends", lambda _: F.lit(None).cast(id_type)))
    scanned = scanned.withColumn("range", F.expr(f"block div {RANGE}"))
    places = _prefix_scan(
        scanned.select("file", "range", "block", "size", F.size("ends").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1).alias("after_last"))
    )
    # Arrays stay where they are dealt by (file, block); a file that is one key is many here.
    placed = scanned.join(places.hint("shuffle_merge"), ["file", "block"])
    rest = F.col("is_last") & (F.coalesce("last_end", "open_from") < F.col("base") + F.col("size"))
    absolute = F.transform("ends", lambda e: e + F.col("base"))
    closing = F.when(rest, F.concat(absolute, F.array(F.col("base") + F.col("size")))).otherwise(absolute)
    # Only the zipped array is exploded: rows carry no other array, so a block of very many short documents stays linear.
    starts = F.concat(F.array("open_from"), F.transform("closing", lambda e: e + 1))
    zipped = placed.select("file", "n_before", "open_from", "ids", F.size("ends").alias("n"), closing.alias("closing"))
    zipped = zipped.select("file", "n_before", "n", F.arrays_zip(F.slice(starts, F.lit(1), F.size("closing")).alias("start"), F.col("closing").alias("end"), F.col("ids").alias("id")).alias("docs"))
    return zipped.select("file", "n_before", "n", F.posexplode("docs").alias("k", "doc")).select(
        "file",
        (F.col("n_before") + F.col("k")).cast("long").alias("number"),
        F.col("doc.id").alias("doc_id"),
        F.col("doc.start").alias("start"),
        (F.col("doc.end") - F.col("doc.start")).alias("n_tokens"),
        (F.col("k") < F.col("n")).alias("closed"),
    )


def count_documents(docs: DataFrame, vocabulary: str, end_id: int = END_ID, **columns: str) -> DataFrame:
    """Token files of docs, written to the shared folder, and their counts."""
    return count_tokens(stored(token_blocks(docs, vocabulary, end_id, **columns)), end_id, width_for(vocabulary, end_id))
