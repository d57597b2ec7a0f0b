"""Exact top-k search by inner product (operator 1).

Vectors are sparse rows of (term, weight); a dense vector's terms are its positions. Candidates are packed into blocks,
each kept as postings: term -> (row, weight). A block of queries meets a block of candidates in one task, where each
query's terms scatter weighted postings into one dense score array, from which the k best are selected by partition.
The partial lists, k rows a query and candidate block, are merged by a window over the query.

Scale: the query set is stated, so all pairs of blocks have to be scored. Query blocks of SMALL bytes or fewer in all are
broadcast and the candidates stay where they are. Beyond that both sides are dealt out to a grid: a candidate block moves
once for each stripe of WIDE query blocks, a query block once for each column, and the key is stripe and column. No block
grows with the data, and only k rows leave each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, tidy

SCALE = 256
SMALL = 32 << 20
WIDE = 64
_PACKED = "block int, ids binary, lens binary, terms binary"


def _pack(block_rows: int):
    """Blocks of usable rows (id, vec): their ids, lengths and scaled components."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), *(pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (ids, lens, parts))],
                ["block", "ids", "lens", "terms"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                piece = batch.slice(at, block_rows)
                ids.append(np.asarray(piece.column(0), dtype=np.int64))
                lens.append(np.asarray(pa.compute.list_value_length(piece.column(1)), dtype=np.int64))
                parts.append(np.floor(SCALE * np.asarray(piece.column(1).flatten(), dtype=np.float64)))
                held += piece.num_rows
                if held >= block_rows:
                    yield out()
                    ids, lens, parts, held = [], [], [], 0
        if held:
            yield out()

    return kernel


def _sparse(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, lens, w = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64), np.frombuffer(row["terms"], np.float64)
    starts = np.concatenate([[0], np.cumsum(lens)])
    term = np.arange(len(w)) - np.repeat(starts[:-1], lens)
    return ids, starts, term, w


def _score(k: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                q_ids, q_start, q_term, q_w = _sparse({n: pair["q_" + n] for n in ("ids", "lens", "terms")})
                c_ids, c_start, c_term, c_w = _sparse(pair)
                row = np.repeat(np.arange(len(c_ids)), np.diff(c_start))
                used = c_w != 0
                order = np.argsort(c_term[used], kind="stable")
                p_row, p_w, p_term = row[used][order], c_w[used][order], c_term[used][order]
                n_terms = int(max(c_term.max(initial=-1), q_term.max(initial=-1)) + 1)
                at = np.searchsorted(p_term, np.arange(n_terms + 1))
                top = float(np.abs(c_w).max(initial=0)) * float(np.abs(q_w).max(initial=0)) * max(1, n_terms)
                # Whole numbers below 2**53 are exact as doubles; larger ones are summed as Python integers and held to a long.
                exact = top < 2.0**53
                if not exact:
                    p_w = np.array([int(x) for x in p_w], dtype=object)
                out_q, out_c, out_s = [], [], []
                for i, qid in enumerate(q_ids):
                    acc = np.zeros(len(c_ids), dtype=np.float64 if exact else object)
                    for j in range(q_start[i], q_start[i + 1]):
                        w = q_w[j]
                        if w:
                            t = q_term[j]
                            lo, hi = at[t], at[t + 1]
                            if hi - lo == len(c_ids):
                                acc += (w if exact else int(w)) * p_w[lo:hi]
                            elif hi > lo:
                                acc[p_row[lo:hi]] += (w if exact else int(w)) * p_w[lo:hi]
                    score = acc.astype(np.int64) if exact else np.array([max(-(2**63), min(2**63 - 1, x)) for x in acc], dtype=np.int64)
                    other = np.flatnonzero(c_ids != qid)
                    if len(other) > k:
                        least = np.partition(score[other], len(other) - k)[len(other) - k]
                        other = other[score[other] >= least]
                    best = other[np.lexsort((c_ids[other], -score[other].astype(object) if not exact else -score[other]))][:k]
                    out_q += [int(qid)] * len(best)
                    out_c += c_ids[best].tolist()
                    out_s += score[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_q, out_c, out_s)], ["query_id", "vec_id", "score"])

    return kernel


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vec of the rows whose id and vector are there, with finite components only."""
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return slim.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: F.coalesce(finite(x), F.lit(False))))


@tidy
def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 8192, query_rows: int = 1024, small: int = SMALL, wide: int = WIDE
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates with the highest integer inner product for each query row.

    Components are floor(256 * x). A query never returns its own id; ties go to the smaller id; all candidates if fewer
    than k. Rows whose id or vector is null, or whose vector holds a null or a non-finite component, take no part; an empty
    vector scores 0 with all. Query rows of one id are one query, the least of their usable vectors; a repeated candidate
    row counts each time. Vectors of different lengths are compared on their common terms. Scores past a long's range are
    held to it. Other columns are ignored, so clashing names do no harm.
    """
    cand = usable(vectors, id_col, vec_col).mapInArrow(_pack(block_rows), _PACKED).drop("block")
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec")).mapInArrow(_pack(query_rows), _PACKED)
    asked = stored(asked.select(*(F.col(c).alias("q_" + c) for c in ("ids", "lens", "terms"))), "queries")
    blocks, held = asked.agg(F.count("*"), F.sum(F.octet_length("q_ids") + F.octet_length("q_lens") + F.octet_length("q_terms"))).first()
    # A grid: a stripe has up to `wide` query blocks, and each of its columns a share of the candidate blocks.
    few = (held or 0) <= small
    stripes = 1 if few else -(-blocks // wide)
    columns = 1 if few else max(1, -(-2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // stripes))
    deal = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = cand.withColumn("col", deal(columns, "ids")).withColumn("stripe", every(stripes))
    right = asked.withColumn("stripe", deal(stripes, "q_ids")).withColumn("col", every(columns))
    pairs = left.join(F.broadcast(right) if few else right, ["stripe", "col"])
    part = pairs.select("q_ids", "q_lens", "q_terms", "ids", "lens", "terms").mapInArrow(_score(k), "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for every vec_id divisible by 50."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(v, v.where(F.col("vec_id") % 50 == 0), 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
