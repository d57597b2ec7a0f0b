"""SimHash near-duplicates (operator 9).

Equal fingerprints are one node. A node's embedding is its number of set bits in each of SEGMENTS segments; the Manhattan
distance of two embeddings is a lower bound of the Hamming distance. With the segments in d + AGREE groups, two embeddings
within distance d agree exactly on AGREE of them at least, so the grid has a cell for each choice of AGREE groups and point of
their subspace, and the range join meets nodes that share a cell. In a cell the Manhattan bound comes first and the exact
distance of the survivors second.

Scale: cells hold distinct fingerprints only, and four of six groups are about 2**32 points, so a cell has few nodes up to
billions of fingerprints. A cell of more than BLOCK nodes all the same is cut into smaller ones by the fingerprints' own bits
(of d + 1 stretches of bits two near ones agree on one), and what is still larger is dealt into pairs of blocks, so no task
gets a whole hot cell. A block pair returns a spanning forest of its links and never its pairs, so the output is linear in
the nodes. Components come from rounds of alternating star contractions over that forest, each round stored. Joins on a
hot fingerprint or a star's centre have a side of distinct keys, so adaptive execution can split them.

near_duplicates and keep_one, which the pipeline uses, take the links of fingerprints over five-word shingles as candidates,
with those of the sets' min-hashes (shingles.py) beside them, since near copies at a similarity of 0.8 differ in more bits than
a grid can bridge. The similarity of the sets, checked exactly, decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import shingles
from .common import ASCII_LOWER, as_bytes, documents, dropped, rows_of, stored, tidy

SHINGLE = 3
DISTANCE = 2
SEGMENTS = 32
#: Groups of segments that a cell fixes; with the distance, the number of groups.
AGREE = 4
BLOCK = 2048
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; a text without words has 0."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    join = b" ".join
    if len(words) <= shingle:
        return h64(join(words), SEED)
    total = np.zeros(64, dtype=np.int64)
    n = len(words) - shingle + 1
    step = 65_536
    for at in range(0, n, step):
        part = [words[at + i : min(n, at + step) + i] for i in range(shingle)]
        h = np.array([h64(join(p), SEED) for p in zip(*part)], dtype=np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def _named(name: str, value: Callable[[bytes], int]):
    """Replaces the last column, a text, by its value."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            fp = np.array([value(x) for x in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], [*batch.schema.names[:-1], name])

    return kernel


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text")).mapInArrow(_named("fp", lambda x: fingerprint(x, shingle)), "doc_id bigint, fp bigint")


def _groups(parts: int) -> list[tuple[int, int]]:
    """The segments dealt into `parts` groups: first and last segment of each."""
    cut = [round(i * SEGMENTS / parts) for i in range(parts + 1)]
    return list(zip(cut, cut[1:]))


def _embedding(fp: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fp), SEGMENTS, 64 // SEGMENTS).sum(axis=2, dtype=np.int8)


def _mask(bits: list[tuple[int, int]]) -> int:
    """A long with the bits of the ranges set."""
    m = sum(((1 << last) - 1) & ~((1 << first) - 1) for first, last in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def cell_column(fp: F.Column, groups: list[tuple[int, int]]) -> F.Column:
    """The point of the groups' segments in the grid: their counts packed two bits each, in bit arithmetic."""
    width = 64 // SEGMENTS
    assert width == 2, "the packed counts below are those of two-bit segments"
    low = F.lit(0x5555555555555555)
    # Each pair of bits becomes its sum, 0 to 2, by a half adder, since a sum of longs may not reach the sign bit.
    high = F.shiftrightunsigned(fp, 1)
    counts = fp.bitwiseXOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))
    return counts.bitwiseAND(F.lit(_mask([(2 * first, 2 * last) for first, last in groups])))


def _forest(a: np.ndarray, b: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a, or of those between a and b."""
    fp = a if b is None else np.concatenate([a, b])
    emb = _embedding(fp)
    parent = np.arange(len(fp))
    links: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    for i in range(len(a)):
        j = np.arange(i + 1, len(a)) if b is None else np.arange(len(a), len(fp))
        if not len(j):
            continue
        near = j[np.abs(emb[j] - emb[i]).sum(axis=1) <= distance]
        if len(near):
            near = near[np.bitwise_count(fp[near] ^ fp[i]) <= distance]
        for k in near.tolist():
            p, q = root(i), root(k)
            if p != q:
                parent[q] = p
                links.append((i, k))
    s = fp.view(np.int64)
    return [(int(s[i]), int(s[k])) for i, k in links]


def _links(distance: int):
    """Rows arrive sorted by cell, block pair and side; a group that a batch cuts is carried into the next one."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table) -> pa.RecordBatch:
            cols = [np.asarray(t.column(n).combine_chunks()) for n in ("g", "cell", "i", "j")]
            side, fp = np.asarray(t.column("side").combine_chunks()), np.asarray(t.column("fp").combine_chunks()).view(np.uint64)
            new = np.zeros(len(fp), dtype=bool)
            new[:1] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            at = np.append(np.flatnonzero(new), len(fp))
            out: list[tuple[int, int]] = []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                if y - x == 2 and side[x] == 0:
                    f = fp[x:y]
                    if int(np.bitwise_count(f[0] ^ f[1])) <= distance:
                        out += _forest(f, None, distance) if cols[2][x] == cols[3][x] else _forest(f[:1], f[1:], distance)
                elif y - x > 1:
                    f, s = fp[x:y], side[x:y]
                    out += _forest(f, None, distance) if cols[2][x] == cols[3][x] else _forest(f[s == 0], f[s == 1], distance)
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            last = t.slice(t.num_rows - 1, 1).to_pylist()[0]
            same = np.ones(t.num_rows, dtype=bool)
            for n in ("g", "cell", "i", "j"):
                same &= np.asarray(t.column(n).combine_chunks()) == last[n]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            if cut:
                yield done(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    return kernel


def _dealt(cells: DataFrame, sizes: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Members of the cells in sizes (keys, n) in pairs of blocks: g, cell, i, j, side, fp. A node of block x takes part in the
    pairs (x, y) and (y, x), written with the smaller first."""
    dealt = cells.join(sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), keys).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.col("cell") if len(keys) == 2 else F.xxhash64(*keys)
    return dealt.select("g", cell.alias("cell"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK, agree: int = AGREE) -> DataFrame:
    """a, b: links that join every two nodes (distinct values of fp) at `distance` bits or fewer, directly or through others."""
    fp = F.col("fp")
    choices = [F.struct(F.lit(g).alias("g"), cell_column(fp, list(c)).alias("cell")) for g, c in enumerate(combinations(_groups(distance + agree), agree))]
    cells = nodes.select("fp", F.explode(F.array(*choices)).alias("c")).select("c.g", "c.cell", "fp")
    sizes = stored(cells.groupBy("g", "cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    dealt = _dealt(cells, sizes.where(F.col("n") <= block), ["g", "cell"], block)
    if not sizes.where(F.col("n") > block).isEmpty():
        # A hot cell is cut by the bits themselves.
        cut = [round(k * 64 / (distance + 1)) for k in range(distance + 2)]
        bands = [F.struct(F.lit(k).alias("band"), fp.bitwiseAND(F.lit(_mask([(x, y)]))).alias("bits")) for k, (x, y) in enumerate(zip(cut, cut[1:]))]
        hot = cells.join(sizes.where(F.col("n") > block).drop("n"), ["g", "cell"], "left_semi")
        hot = hot.select("g", "cell", "fp", F.explode(F.array(*bands)).alias("b")).select("g", "cell", "b.band", "b.bits", "fp")
        keys = ["g", "cell", "band", "bits"]
        inner = stored(hot.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "inner-cells")
        dealt = dealt.unionByName(_dealt(hot, inner, keys, block))
    keys = ["g", "cell", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(_links(distance), "a bigint, b bigint").distinct()


@tidy
def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge: root is the least node it reaches. Alternating large and small stars."""
    e = stored(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # Small star: every node joins the least of its smaller neighbours, and so do these.
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
        new = stored(small.where("u <> v").distinct(), "edges")
        # Settled when the edges are stars: no node is both a centre and a leaf, and no leaf has two centres.
        centres, leaves = new.select(F.col("u").alias("x")).distinct(), new.select(F.col("v").alias("x"))
        if leaves.groupBy("x").count().where("count > 1").isEmpty() and leaves.join(centres, "x", "left_semi").isEmpty():
            break
        e = new
    return new.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _classes(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fp, group, component_id of every row of fps (doc_id, fp), whose fps are linked by edges."""
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(edges)
    # Only nodes that have links can differ from their own root.
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    named = stored(named, "named")
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "group").select("fp", "group", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "group", "component_id")


@tidy
def fingerprint_components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, group (a fingerprint that names the component) and component_id for every row of docs.

    Fingerprints link at `distance` or fewer differing bits; component_id is the smallest doc_id that links reach, null if
    all of them are null. Null, empty and blank texts have fingerprint 0 and link like any other; texts shorter than a
    shingle are one shingle; repeated rows stay; no documents give no rows; other columns are ignored.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    return _classes(fps, links(fps.select("fp").distinct(), distance))


def fingerprint_candidates(ids: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links that join every two sets (fp) of ids (fp, print) whose fingerprints are within `distance` bits, directly or
    through others: the grid's links of the distinct fingerprints, and of each fingerprint's sets the least with every other."""
    pairs = stored(ids.select("print", "fp").distinct(), "prints")
    least = stored(pairs.groupBy("print").agg(F.min("fp").alias("least")), "least-sets")
    same = pairs.join(least, "print").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    found = links(least.select(F.col("print").alias("fp")), distance)
    side = lambda c: least.select(F.col("print").alias(c), F.col("least").alias(f"{c}_set"))
    near = found.join(side("a"), "a").join(side("b"), "b").select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))
    return same.unionByName(near.where("a <> b")).distinct()


@tidy
def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (names the set of shingles), group (an fp that names the component) and component_id for every row of docs.

    Texts link where the Jaccard similarity of their sets of five-word shingles is 0.8 or more, checked exactly; component_id
    and odd rows are as in fingerprint_components.
    """
    ids = stored(shingles.identities(docs, lambda x: fingerprint(x, shingles.WORDS)), "shingles")
    nodes = ids.select("fp", "n", "bands").dropDuplicates(["fp"])
    coarse = stored(components(fingerprint_candidates(ids).unionByName(shingles.candidates(nodes))), "candidates")
    return _classes(ids.select("doc_id", "fp"), shingles.exact_links(docs, nodes, coarse))


@tidy
def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one with the smallest doc_id, with all its columns.
    A document without an id stands for its group only if no member has one."""
    chosen = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "fp", "group").distinct()
    chosen = stored(chosen.groupBy("group").agg(F.min(F.struct("doc_id", "fp")).alias("s")).select("s.*"), "chosen")
    names = docs.columns
    # Rows that share the chosen id are told apart by their own set; of equal ones any may stay.
    own = docs.select(*names, F.col("doc_id").cast("long").alias("__id"))
    with_id = own.join(chosen, F.col("__id").eqNullSafe(chosen["doc_id"]), "left_semi").select(*names)
    doubled = with_id.groupBy("doc_id").count().where("count > 1")
    if doubled.isEmpty():
        return with_id
    schema = StructType([*docs.schema.fields, StructField("__fp", LongType())])
    marked = with_id.select(*names, as_bytes("text").alias("__bytes")).mapInArrow(_named("__fp", lambda x: shingles.set_id(shingles.shingle_set(x))), schema)
    right = chosen.withColumnsRenamed({"doc_id": "__d", "fp": "__f"})
    picked = marked.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__fp") == F.col("__f")), "left_semi")
    return picked.dropDuplicates(["doc_id", "__fp"]).select(*names)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    found = fingerprint_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
