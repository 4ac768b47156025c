"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams, hashed: runs of three bytes, words, pairs of words, each kind into a space of its
own. Each indicator is scaled by its class log-count ratio r = log((p / |p|) / (q / |q|)), where p and q count the
documents of either class that have the feature, plus one; a linear model with hinge loss is fitted on the scaled
indicators by dual coordinate descent; a logistic curve fitted on labelled rows that the model has not seen turns its
margin into a score from 0 to 1.

The model is fitted on a bounded sample of labelled rows: the ``most_rows`` with the smallest hashed id, as long as their
features have no more than ``most_bytes`` together (both are parameters).
Scoring covers every row and whole texts. Only the text is an input of a score.

Defined results: null and empty texts have no features and get the score of the intercept. Of labels that contradict
each other for an id the larger counts; null labels are left out; rows with an id that is null are never learned from.
Without two classes every score is the share of label 1, as Laplace's rule estimates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import binaries, cut, smallest_hashes, text_bytes
from stepwell.llm.substring import word_hashes

SPACE_BITS = 16
SPACE = 1 << SPACE_BITS
FEATURES = 3 * SPACE
TRAINING_ROWS = 12_000
#: Features of the sample that the driver takes, in bytes; long texts have up to 786 KB.
TRAINING_BYTES = 192 << 20
EPOCHS = 12
COST = 10.0
THRESHOLD = 0.3
_ODD = np.uint32(2654435761)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5; null ids too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted different features of each text; some texts at a time share the work on bytes and words."""
    seen = np.zeros(FEATURES, bool)
    k = 0
    while k + 1 < len(offsets):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + (1 << 20), "right")) - 1)
        part, at = data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k]
        words, counts = word_hashes(part, at)
        first = np.concatenate([[0], np.cumsum(counts)])
        single = (words >> np.uint64(64 - SPACE_BITS)).astype(np.int64) + SPACE
        pair = ((words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SPACE_BITS)).astype(np.int64) + 2 * SPACE
        for j in range(end - k):
            for lo in range(int(at[j]), int(at[j + 1]) - 2, 1 << 21):  # runs of bytes of a long text in pieces
                b = part[lo : min(lo + (1 << 21) + 2, at[j + 1])].astype(np.uint32)
                seen[((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * _ODD) >> np.uint32(32 - SPACE_BITS)] = True
            seen[single[first[j] : first[j + 1]]] = True
            seen[pair[first[j] : max(first[j], first[j + 1] - 1)]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found
        k = end


@dataclass
class Model:
    """A text's features make a vector of length 1: margin = bias + sum of weights / root of the sum of squares, over its
    features; score = logistic(slope * margin + shift)."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margins = np.fromiter(map(self.margin, features(data, offsets)), np.float64, len(offsets) - 1)
        return logistic(self.slope * margins + self.shift)

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(self.squares[found].sum(dtype=np.float64))) or 1.0
        return float(self.weights[found].sum(dtype=np.float64)) / length + self.bias


def logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    p, q = np.ones(FEATURES), np.ones(FEATURES)
    for f, y in zip(rows, positive, strict=True):
        (p if y else q)[f] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Hinge loss with a quadratic penalty: (weights times scale, bias). One dual variable a row, kept in [0, cost of its
    class]; classes weigh the same in sum. Rows are scaled to length 1."""
    rng = np.random.default_rng(7)
    square = scale * scale
    norm = np.array([np.sqrt(square[f].sum()) or 1.0 for f in rows])
    weigh = np.where(signs > 0, len(signs) / max(1, 2 * (signs > 0).sum()), len(signs) / max(1, 2 * (signs < 0).sum()))
    alpha, w, bias = np.zeros(len(rows)), np.zeros(len(scale)), 0.0
    top = cost * weigh
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, y = rows[i], signs[i]
            gradient = y * (w[f].sum() / norm[i] + bias) - 1
            new = min(max(alpha[i] - gradient / (2.0 if len(f) else 1.0), 0.0), top[i])
            step = (new - alpha[i]) * y
            if step:
                w[f] += step / norm[i] * square[f]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < tolerance:
            break
    return w, bias


def calibrate(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Logistic curve through margins by Newton steps, towards smoothed targets; a slope that isn't positive becomes 0."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    t = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(100):
        p = logistic(x @ t)
        curvature = x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curvature, x.T @ (target - p))
        size = np.abs(step).max()
        t += step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return (float(t[0]), float(t[1])) if t[0] > 0 else (0.0, float(np.log((n1 + 1) / (n0 + 1))))


def fit(rows: list[np.ndarray], positive: np.ndarray) -> Model:
    """Three rows in four fit ratios and weights, every fourth fits the curve."""
    n1, n = int(positive.sum()), len(positive)
    apart = np.arange(n) % 4 == 3
    if min(positive[~apart].sum(), (~positive[~apart]).sum(), apart.sum()) == 0:
        none = np.zeros(FEATURES, np.float32)
        return Model(none, none, 0.0, 0.0, float(np.log((n1 + 1) / (n - n1 + 1))))
    learn = [rows[i] for i in np.flatnonzero(~apart)]
    ratios = log_count_ratios(learn, positive[~apart])
    weights, bias = dual_coordinate_descent(learn, np.where(positive[~apart], 1.0, -1.0), ratios)
    model = Model(weights.astype(np.float32), (ratios * ratios).astype(np.float32), bias, 1.0, 0.0)
    model.slope, model.shift = calibrate(np.array([model.margin(rows[i]) for i in np.flatnonzero(apart)]), positive[apart])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int, most_bytes: int = TRAINING_BYTES, label: str = "quality", id_column: str = "doc_id", text_column: str = "text") -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the sample. The chosen ids are at most most_rows, so broadcasting them is bounded."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(id_column))).groupBy(id_column).agg(F.max(label).alias("positive"))
    chosen = smallest_hashes(known, [id_column], most_rows, known.count()).select(F.col(id_column).alias("chosen"), (F.col("positive") > 0).alias("positive"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.astype(np.int32).tobytes() for f in features(*binaries(batch.column("text")))]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "positive": batch.column("positive"), "f": pa.array(found, pa.binary())})

    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), text_bytes(text_column)).join(F.broadcast(chosen), F.col("id") == F.col("chosen"))
    # A row for each id: of copies of a row under one id, or different texts under it, the smallest set of bytes.
    got = rows.mapInArrow(run, f"id {id_type}, positive boolean, f binary").groupBy("id").agg(F.min(F.struct("f", "positive")).alias("x")).select("id", "x.f", "x.positive")
    got = cut(got.withColumn("place", F.xxhash64("id")))
    sizes = sorted(map(tuple, got.select("place", F.octet_length("f")).collect()))  # most_rows pairs of numbers at most
    fitting = np.cumsum([n for _, n in sizes]) <= most_bytes
    if not fitting.all():
        last = sizes[int(np.argmin(fitting))][0]
        got = got.where(F.col("place") < last)
    table = got.drop("place").toArrow().sort_by("id")
    order = np.random.default_rng(3).permutation(table.num_rows)
    fs = table.column("f").combine_chunks() if table.num_rows else []
    return [np.frombuffer(fs[int(i)].as_buffer(), np.int32) for i in order], table.column("positive").to_numpy(zero_copy_only=False).astype(bool)[order]


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES, label: str = "quality", **columns: str) -> Model:
    return fit(*training_rows(docs, labels, most_rows, most_bytes, label, **columns))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score and the columns in keep, for every row of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("scored")
            got = shipped.value.score(*binaries(texts.fill_null(b"") if texts.null_count else texts))
            columns = [c for c in batch.schema.names if c != "scored" or text_column in keep]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(got)], [*columns, "score"])

    # The text goes to a worker once, and comes back only if it is kept.
    of = {c: "scored" if c == text_column else f"kept_{k}" for k, c in enumerate(keep)}
    rows = docs.select(F.col(id_column).alias("id"), *[F.col(c).alias(k) for c, k in of.items() if k != "scored"], F.col(text_column).cast("binary").alias("scored"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "scored" or text_column in keep)
    got = rows.mapInArrow(run, kinds + "score double")
    return got.select(F.col("id").alias(id_column), *[F.col(k).cast(docs.schema[c].dataType).alias(c) for c, k in of.items()], "score")


def judged(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
