"""Sets of word shingles: candidates by banded min-hashes, exact similarity of their sets.

Two texts are near copies where the Jaccard similarity of their sets of five-word shingles is NEAR (0.8) or more. BANDS band
keys of ROWS min-hashes each bring such a pair together but for (1 - 0.8 ** ROWS) ** BANDS, about 3 in 10 million; whatever
they bring together is compared exactly.

Scale: a set moves only if a band key joins it to another set, once for each pair of blocks of its candidates. A block pair
returns a spanning forest of its links, so the output is linear in the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, as_bytes, rows_of, stored

WORDS = 5
#: 0.8 as a fraction.
NEAR = (4, 5)
BANDS = 50
ROWS = 6
SEED = 42
#: Most sets and shingles of a block, on average.
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
BITMAP = 1 << 22
#: Bytes of text that a kernel takes at once.
PIECE = 1 << 20
_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)  # two fixed odd multipliers
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, size: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; a text of `size` words or fewer, or of none, is one shingle."""
    words = text.translate(ASCII_LOWER).split()
    h64 = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h64(b" ".join(words), SEED)], dtype=np.uint64)
    table = {w: h64(w, SEED) for w in set(words)}
    h = np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    x = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        x = _mixed(x ^ h[k : n + k]) + np.uint64(k + 1)
    return np.unique(x)


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(least, (low[at : at + 512, None] * _MULTIPLIERS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mixed(key ^ rows[:, k]) + np.uint64(1)
    return key


def _long(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, dtype=np.uint64).view(np.int64))


def identities(docs: DataFrame, fingerprint: Callable[[bytes], int] | None = None) -> DataFrame:
    """doc_id, fp (names the set of shingles), its size n and bands of every row, and its fingerprint as `print` if there is a
    function for it; a null text is empty."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, PIECE):
            texts = batch.column(1).to_pylist()
            sets = [shingle_set(x) for x in texts]
            keys = np.concatenate([band_keys(s) for s in sets]) if sets else np.zeros(0, np.uint64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64)))
            more = {"print": _long([fingerprint(x) for x in texts])} if fingerprint else {}
            yield pa.RecordBatch.from_arrays([batch.column(0), _long([set_id(s) for s in sets]), pa.array(map(len, sets), pa.int64()), bands, *more.values()], ["doc_id", "fp", "n", "bands", *more])

    ddl = "doc_id bigint, fp bigint, n bigint, bands array<bigint>" + (", print bigint" if fingerprint else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text")).mapInArrow(kernel, ddl)


def named_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp and shingles (packed hashes) of the rows of docs whose fp is in wanted, and of a few others: those that meet a wanted
    one in a bitmap of fixed size, which goes to all workers so that other sets are not moved."""
    spark, low = docs.sparkSession, F.col("fp").bitwiseAND(F.lit(BITMAP - 1)).cast("int").alias("at")
    bitmap = np.zeros(BITMAP, dtype=bool)
    bitmap[np.asarray(wanted.select(low).distinct().toArrow().column("at"))] = True  # at most BITMAP numbers
    bits = spark.sparkContext.broadcast(np.packbits(bitmap).tobytes())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(bits.value, np.uint8)).view(bool)
        given: set[int] = set()  # a number for each set that the task has given
        for batch in rows_of(batches, PIECE):
            sets = {i: s for s in map(shingle_set, batch.column(0).to_pylist()) if held[(i := set_id(s)) & (BITMAP - 1)] and i not in given}
            given.update(sets)
            if sets:
                yield pa.RecordBatch.from_arrays([_long(list(sets)), pa.array([s.tobytes() for s in sets.values()], pa.binary())], ["fp", "shingles"])

    return docs.select(as_bytes("text").alias("text")).mapInArrow(kernel, "fp bigint, shingles binary")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by key: each key's first set with every other."""
    key = first = None
    for batch in batches:
        k, fp = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(k):
            continue
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        new[0] = key is None or k[0] != key
        centre = np.where(new, fp, 0)
        if not new[0]:
            centre[0] = first
        begins = new.copy()
        begins[0] = True
        centre = centre[np.maximum.accumulate(np.where(begins, np.arange(len(k)), 0))]
        key, first = k[-1], centre[-1]
        other = centre != fp
        yield pa.RecordBatch.from_arrays([pa.array(centre[other]), pa.array(fp[other])], ["a", "b"])


def candidates(nodes: DataFrame) -> DataFrame:
    """a, b: links that join every two sets (fp, bands) with a band key in common, directly or through others."""
    keys = nodes.select(F.explode("bands").alias("key"), "fp")
    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_stars, "a bigint, b bigint").distinct()


def forest(sets: list[np.ndarray], left: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the near copies among sets, or of those between the first `left` and the others."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    mark = np.zeros(len(values), dtype=np.int32)
    parent = list(range(len(sets)))
    links: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    p, q = NEAR
    for i in range(len(sets) if left is None else left):
        begin = i + 1 if left is None else left
        if begin >= len(sets):
            break
        own = at[start[i] : start[i] + size[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[at[start[begin] :]], start[begin:] - start[begin])
        mark[own] = 0
        near = (p + q) * common >= p * (size[i] + size[begin:])  # common / union >= p / q
        for k in (np.flatnonzero(near) + begin).tolist():
            a, b = root(i), root(k)
            if a != b:
                parent[b] = a
                links.append((i, k))
    return links


def _exact(table: pa.Table) -> pa.Table:
    table = table.sort_by([("side", "ascending"), ("fp", "ascending")])
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    fp, side = table.column("fp").to_pylist(), np.asarray(table.column("side"))
    one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    found = forest(sets, None if one else int((side == 0).sum()))
    return pa.table({"a": pa.array([fp[i] for i, _ in found], pa.int64()), "b": pa.array([fp[k] for _, k in found], pa.int64())})


def exact_links(docs: DataFrame, nodes: DataFrame, coarse: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """a, b: links that join every two near copies of docs that have one root in coarse (node, root), directly or through
    others. nodes has the size n of each fp."""
    members = coarse.select(F.col("node").alias("fp"), "root").unionByName(coarse.select(F.col("root").alias("fp"), "root")).distinct()
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_shingles)).cast("int")
    members = members.join(members.join(nodes.select("fp", "n"), "fp").groupBy("root").agg(blocks.alias("blocks")), "root")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    members = stored(members, "members")
    # Copies of one text are one set before they leave their task.
    sets = named_sets(docs, members).groupBy("fp").agg(F.first("shingles").alias("shingles"))
    held = stored(sets.join(members, "fp"), "sets")
    # A set of block x takes part in the pairs (x, y) and (y, x), written with the smaller first.
    dealt = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", "shingles")
    return dealt.groupBy("root", "i", "j").applyInArrow(_exact, "a bigint, b bigint").distinct()
