"""Mean vectors and cosine similarity as expressions and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dot(a: F.Column, b: F.Column) -> F.Column:
    """The inner product in doubles; vectors of different lengths have none."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def similarity(a: F.Column, b: F.Column, same: F.Column | None = None) -> F.Column:
    """Cosine: 1 where `same` (equal token texts in order), 0 for a zero norm."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
    return cosine if same is None else F.when(same, F.lit(1.0)).otherwise(cosine)


def mean_vectors(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """key, dim, value: the mean by key over all rows, where a null vector counts as zeros. One partial sum a key and
    dimension leaves each task."""
    filled = F.coalesce(F.col(vector).cast("array<double>"), F.array_repeat(F.lit(0.0), width))
    return rows.select(key, F.posexplode(filled).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("value"))


def token_vectors(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """Tokens (doc_id, i, text) with the static vector of their text, null where the table has none."""
    return tokens.join(table.select(F.col("key").alias("text"), F.col("vec").alias("vector")), "text", "left")


def span_vector(tokens: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """doc_id, dim, value: the mean over all tokens of each document; those without a vector count as zeros."""
    return mean_vectors(token_vectors(tokens, table), "doc_id", "vector", width)


def _packed(rows: DataFrame, size: int, prefix: str = "") -> DataFrame:
    """Blocks of up to `size` rows (vec_id, embedding): their ids and their vectors scaled to length one, as bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = np.array(part.column(1).to_pylist(), dtype=np.float64)
                norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(part.column(0), dtype=np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], [f"{prefix}ids", f"{prefix}vecs"])

    whole = rows.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return whole.mapInArrow(kernel, f"{prefix}ids binary, {prefix}vecs binary")


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = 4096, small: int = 32 << 20, wide: int = 16) -> DataFrame:
    """q, vec_id, score: for every query (vec_id, embedding) the best k of each block of rows by rounded cosine, then vec_id,
    without the query's own id. Blocks of queries meet blocks of rows; query vectors of `small` bytes or fewer are broadcast,
    beyond that both sides are dealt out to a grid of stripes of up to `wide` query blocks."""
    spark = rows.sparkSession
    count, width = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    stripes = -(-count // (block * wide)) or 1
    few = count * 8 * (width or 0) <= small
    columns = 1 if few else max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // stripes))
    stripes = 1 if few else stripes
    deal = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = _packed(rows, block).withColumn("col", deal(columns, "ids")).withColumn("stripe", every(stripes))
    right = _packed(queries, block, "q_").withColumn("stripe", deal(stripes, "q_ids")).withColumn("col", every(columns))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                ids, q = np.frombuffer(pair["ids"], np.int64), np.frombuffer(pair["q_ids"], np.int64)
                x, e = np.frombuffer(pair["vecs"]).reshape(len(ids), -1), np.frombuffer(pair["q_vecs"]).reshape(len(q), -1)
                by_id = np.argsort(ids, kind="stable")
                ids, x = ids[by_id], x[by_id]
                out: list[tuple[np.ndarray, ...]] = []
                for at in range(0, len(q), 256):
                    scores = np.rint(e[at : at + 256] @ x.T * 1e6) / 1e6
                    scores[q[at : at + 256, None] == ids] = -np.inf
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # ids ascend, so equal scores go to the smaller
                    s = np.take_along_axis(scores, best, axis=1)
                    on = s > -np.inf
                    out.append((np.repeat(q[at : at + 256], on.sum(axis=1)), ids[best[on]], s[on]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["q", "vec_id", "score"])

    pairs = left.join(F.broadcast(right) if few else right, ["stripe", "col"]).select("ids", "vecs", "q_ids", "q_vecs")
    return pairs.mapInArrow(kernel, "q bigint, vec_id bigint, score double")
