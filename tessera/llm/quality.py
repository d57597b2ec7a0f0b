"""Quality classifier (operator 3).

Statistics of each whole text are turned into random Fourier features, which approximate a Gaussian kernel. Every partition
adds up its own normal equations; their sum gives the ridge weights. Isotonic regression on labelled rows that the ridge fit
has not seen turns its scores into probabilities.

Scale: one pass over the texts makes a slim table of statistics (a few dozen numbers a document, stored in the shared
folder); the fit reads that. A partition sends one matrix whose size depends on the features alone, and the matrices are
summed in a tree before the driver sees one. The calibration gets counts by rounded score, at most BINS rows. All labelled
rows are used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, rows_of, stored, tidy

FEATURES = 384
GAMMA = 0.35
RIDGE = 1e-2
BINS = 4096
#: Bits of the map of labelled ids.
BITMAP = 1 << 22
SEED = 7
THRESHOLD = 0.7
_CLASSES = np.zeros(256, dtype=np.uint8)
for _chars, _k in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5), (b".,;:", 6), (b"!?", 7), (b"*#%&$|<>{}[]=_\\/@^~+", 8), (range(128, 256), 9)):
    for _c in _chars:
        _CLASSES[_c] = _k
STATS = 24


def statistics(text: bytes) -> list[float]:
    """STATS numbers of a text, each bounded or logarithmic, so that very long texts don't stand apart."""
    n = len(text)
    if not text.strip():
        return [0.0] * (STATS - 1) + [1.0]
    kinds = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=10)[:10] / n
    words = text.split()
    nw = len(words)
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    top = counts.most_common(1)[0][1]
    again = sum(a == b for a, b in zip(lower, lower[1:])) / max(1, nw - 1)
    sizes = np.fromiter(map(len, words), np.int32, nw)
    tails = Counter(w[-3:] for w in words if len(w) > 3)
    junk_tail = sum(c for t, c in tails.items() if len(set(t)) == 1) / nw
    marks = sum(1 for w in words if not any(_CLASSES[c] in (1, 2, 3, 9) for c in w)) / nw
    upper = sum(1 for w in words if w.isupper()) / nw
    lines = [x for x in text.split(b"\n") if x.strip()]
    halves = lower[: nw // 2] == lower[nw // 2 : 2 * (nw // 2)] if nw > 3 else False
    repeated = 1 - len(set(lines)) / len(lines)
    grams = list(zip(lower, lower[1:], lower[2:]))
    fresh = len(set(grams)) / len(grams) if grams else 1.0
    return [
        *kinds.tolist(), np.log1p(nw) / 8, float(sizes.mean()) / 10, float(sizes.std()) / 10, len(counts) / nw * np.log1p(nw) / 8, top / nw, again, junk_tail, marks, upper,
        repeated, fresh, float(halves), np.log1p(len(lines)) / 5, 0.0,
    ]


def _stats_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        rows = [statistics(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text")).mapInArrow(_stats_kernel, "doc_id bigint, stats array<double>")


@dataclass(frozen=True)
class Fourier:
    """cos(w.x + b) of standardised statistics, and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray

    @staticmethod
    def drawn(mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, gamma: float = GAMMA, seed: int = SEED) -> Fourier:
        r = np.random.default_rng(seed)
        w = r.normal(0, np.sqrt(2 * gamma / len(mean)), (len(mean), features))
        return Fourier(mean, scale, w, r.uniform(0, 2 * np.pi, features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), z / 8, np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _equations(fourier: Fourier):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = np.hstack([fourier(_matrix(part.column(0))), np.asarray(part.column(1), dtype=np.float64)[:, None]])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "m"])

    return kernel


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(1).to_pylist():
            m = np.frombuffer(x, np.float64)
            total = m if total is None else total + m
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "m"])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators on sorted x: the block means of the non-decreasing fit, by block centre."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


@dataclass(frozen=True)
class Model:
    fourier: Fourier
    beta: np.ndarray
    at: np.ndarray
    p: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.p), 0, 1)


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """labelled: stats, label (0/1), calibrate (boolean). Rows with calibrate fit the isotonic step, the others the ridge.
    Without rows every score is 0.5; without rows to calibrate on, those of the ridge serve."""
    spark = labelled.sparkSession
    moments = labelled.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # STATS rows
    if not moments:
        one = np.zeros(STATS)
        return Model(Fourier.drawn(one, one + 1, 1), np.zeros(STATS + 2), np.array([0.0]), np.array([0.5]))
    scale = np.array([r.s for r in moments])
    fourier = Fourier.drawn(np.array([r.m for r in moments]), np.where(scale > 1e-9, scale, 1.0), features)
    train = labelled.where(~F.col("calibrate"))
    held = labelled.where("calibrate")
    if train.isEmpty():
        train = labelled
    if held.isEmpty():
        held = labelled
    sums = train.select("stats", F.col("label").cast("double")).mapInArrow(_equations(fourier), "slot int, m binary")
    while sums.rdd.getNumPartitions() > 8:
        sums = sums.repartition(max(1, int(sums.rdd.getNumPartitions() ** 0.5))).mapInArrow(_added, "slot int, m binary")
    n = features + len(moments) + 2
    m = sum(np.frombuffer(r.m, np.float64).reshape(n, n) for r in sums.collect())  # at most 8 matrices
    a, b = m[:-1, :-1], m[:-1, -1]
    beta = np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) / 100 * np.eye(n - 1), b)
    raw = Model(fourier, beta, np.array([0.0]), np.array([0.5]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.clip(raw.raw(_matrix(batch.column(0))), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.round((s + 0.5) * BINS / 2).astype(np.int32)), batch.column(1)], ["bin", "label"])

    bins = held.select("stats", F.col("label").cast("double")).mapInArrow(binned, "bin int, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("y")).orderBy("bin").collect()
    x, w, y = (np.array([r[k] for r in bins], dtype=float) for k in ("bin", "n", "y"))
    at, p = isotonic(x * 2 / BINS - 0.5, y / w, w)
    return Model(fourier, beta, at, p)


def score(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for rows of doc_id and stats."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.select("doc_id", "stats").mapInArrow(kernel, "doc_id bigint, score double, predicted int")


def remainder(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """Learns from the labelled rows outside the held-out quarter: remainders 0 and 1 fit the ridge, 3 calibrates.
    Null labels and ids teach nothing; labels other than 0 and 1 are ignored; repeated label rows count once, conflicting ones not at all."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).where("label in (0, 1) and doc_id is not null")
    y = y.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    rows = stats.withColumn("r", remainder()).where("r <> 2").join(y, "doc_id").select("stats", "label", (F.col("r") == 3).alias("calibrate"))
    return fit(stored(rows, "labelled"))


@tidy
def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Null and empty texts are scored by the statistics of an
    empty text; ids may be null or repeated; other columns are ignored; no documents give no rows; no labels give 0.5."""
    stats = stored(document_statistics(docs), "statistics")
    return score(stats, train(stats, labels), threshold).select("doc_id", (remainder() == 2).alias("held_out"), "score", "predicted")


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """document_statistics of the rows whose id may have a label that teaches: those that meet a labelled id in a bitmap of fixed
    size, which goes to all workers, so that a text whose statistics nobody asks for is not read twice."""
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).where(remainder() != 2)
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit(BITMAP - 1)).cast("int")
    bits = np.zeros(BITMAP, dtype=bool)
    bits[np.asarray(known.select(slot("doc_id").alias("at")).distinct().toArrow().column("at"))] = True  # at most BITMAP numbers
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for batch in batches:
            yield from _stats_kernel([batch.filter(pa.array(held[np.asarray(batch.column(2))])).select([0, 1])])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"))
    slim = slim.where(F.col("doc_id").isNotNull() & (remainder() != 2)).withColumn("at", slot("doc_id"))
    return slim.mapInArrow(kernel, "doc_id bigint, stats array<double>")


@tidy
def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns. Rows are judged one by one by their texts, a
    null one as an empty one, whatever their ids; no labels give every row 0.5; no documents give no rows."""
    model = train(stored(labelled_statistics(docs, labels), "statistics"), labels)
    names = docs.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            good = np.zeros(batch.num_rows, dtype=bool)
            for at in range(0, batch.num_rows, 1024):
                rows = [statistics(x) for x in texts.slice(at, 1024).to_pylist()]
                good[at : at + 1024] = model(np.array(rows)) >= threshold
            yield batch.filter(pa.array(good)).select(names)

    return docs.withColumn("__bytes", as_bytes("text")).mapInArrow(kernel, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


__all__ = ["classify", "fit", "isotonic", "keep_good", "score", "statistics", "train"]
