"""Sharding by extendible hashing (operator 10), in DataFrame operations only.

A row's key is a 60-bit hash of its id and text. The directory starts with one bucket of no bits; a bucket over the byte
limit splits on one more bit, until it fits or holds one row. Rows alike in all 60 bits (copies of one row) that are still
too many fill one overflow page of their bucket after another.

Scale: the split decisions need only sums over hash prefixes. Rows are summed once by a prefix a few bits longer than an even
split needs; the sums of all shorter prefixes come from those. Prefixes still too large go round again with more bits, over
their own rows alone. The texts are read once for keys and sizes and aren't shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, numbered, stored, tidy

LIMIT = 1 << 20
BITS = 60
SPARE_BITS = 3
#: A directory of more buckets is not broadcast; one of this many takes about 13 MB.
DIRECTORY_ROWS = 100_000


def key_column(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def size_column(text_col: str = "text") -> F.Column:
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")


def prefix_column(key: str, depth: F.Column | int) -> F.Column:
    """The first `depth` of a key's BITS bits."""
    return F.expr(f"shiftrightunsigned({key}, {BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftrightunsigned", F.col(key), F.lit(BITS) - depth)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """lo, hi, depth, bytes, docs: the buckets, each the range of keys that share its prefix. rows: key, bytes."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    done = None
    start, step = 0, max(1, math.ceil(math.log2(max(1, total / limit))) + SPARE_BITS)
    while True:
        depth = min(BITS, start + step)
        cells = stored(rows.groupBy(prefix_column("key", depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")), "cells")
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(depth)))).withColumn("prefix", F.call_function("shiftrightunsigned", F.col("cell"), F.lit(depth) - F.col("depth")))
        # Both halves of a node are summed in one row, so that a node and its parent are seen together without a join.
        odd = F.col("prefix") % 2 == 1
        halves = levels.groupBy("depth", F.shiftrightunsigned("prefix", 1).alias("parent")).agg(
            *[F.sum(F.when(side, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i, side in enumerate((~odd, odd)) for c in ("bytes", "docs")]
        )
        # The parents of the first depth are known to be too large, or there is none.
        fits = lambda size, n: (size <= limit) | (n <= 1)
        halves = halves.where((F.col("depth") == start) | ~fits(F.col("bytes0") + F.col("bytes1"), F.col("docs0") + F.col("docs1")))
        nodes = halves.select("depth", "parent", F.explode(F.array(*[F.struct(F.lit(i).alias("bit"), F.col(f"bytes{i}").alias("bytes"), F.col(f"docs{i}").alias("docs")) for i in (0, 1)])).alias("half"))
        nodes = nodes.select("depth", (F.col("parent") * 2 + F.col("half.bit")).alias("prefix"), "half.bytes", "half.docs").where("docs > 0")
        nodes = nodes.withColumn("fits", fits(F.col("bytes"), F.col("docs")) | (F.col("depth") == BITS)).where(F.col("fits") | (F.col("depth") == depth))
        nodes = stored(nodes, "nodes")
        width = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(BITS) - F.col("depth"))
        found = nodes.where("fits").select((F.col("prefix") * width).alias("lo"), (F.col("prefix") * width + width - 1).alias("hi"), "depth", "bytes", "docs")
        done = found if done is None else done.unionByName(found)
        large = nodes.where("not fits").select(F.col("prefix").alias("cell"))
        if depth == BITS or large.isEmpty():
            return done
        rows = stored(rows.withColumn("cell", prefix_column("key", depth)).join(large, "cell", "left_semi").drop("cell"), "oversized")
        # Splitting of what is left goes on below this depth.
        start = depth + 1


def _placed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (with key) and their bucket, by one equi-join for each depth in use, as a union of prefixes."""
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # at most BITS + 1 numbers
    if not depths:
        return rows.withColumns({"lo": F.lit(0).cast("long"), "depth": F.lit(0), "shard_bytes": F.lit(0).cast("long"), "shard_docs": F.lit(0).cast("long")})
    named = buckets.select(F.concat_ws(":", "depth", "lo").alias("bucket"), "lo", "depth", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    small = buckets.count() <= DIRECTORY_ROWS
    if small:
        named = F.broadcast(named)
    shortest, longest = min(depths), max(depths)
    if shortest == longest:
        key = F.concat_ws(":", F.lit(shortest), prefix_start(F.lit(shortest)))
        return rows.withColumn("bucket", key).join(named, "bucket").drop("bucket")
    # Buckets tile the keys, so of a key's prefixes just one is in the directory.
    tries = F.array(*[F.concat_ws(":", F.lit(d), prefix_start(F.lit(d))) for d in sorted(depths)])
    if small:
        return rows.withColumn("bucket", F.explode(tries)).join(named, "bucket").drop("bucket")
    # A large directory meets the keys alone; whole rows then move once.
    return rows.join(rows.select("key").distinct().withColumn("bucket", F.explode(tries)).join(named, "bucket").drop("bucket"), "key")


def prefix_start(depth: F.Column) -> F.Column:
    """The least key that shares the first `depth` bits."""
    gap = F.lit(BITS) - depth
    return F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("key"), gap), gap)


def _with_pages(placed: DataFrame, limit: int) -> DataFrame:
    """Splits buckets of copies that are alike in all bits into pages that fit the limit, with their own bytes and rows; all
    other rows have page 0. Every page but a bucket's last is full, so which copy is where doesn't change the rows."""
    over = (F.col("depth") == BITS) & (F.col("shard_docs") > 1) & (F.col("shard_bytes") > limit)
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    rest = placed.where(~over).withColumn("page", F.lit(0).cast("long"))
    copies = numbered(placed.where(over), ["key"], "n").withColumn("page", F.floor(F.col("n") / room).cast("long")).drop("n")
    docs = F.least(room, F.col("shard_docs") - F.col("page") * room)
    return rest.unionByName(copies.withColumns({"shard_docs": docs, "shard_bytes": docs * F.col("bytes")}))


@tidy
def shard(docs: DataFrame, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of every row of docs with shard (its bucket's bits), depth, page, and the page's shard_bytes and shard_docs.

    A page's texts, as UTF-8, have `limit` bytes or fewer unless it is one row that has more by itself; a shard has one page, 0,
    but where copies of a row (same id and text) are too many for one. Null texts have no bytes and null ids count as empty in
    the key; no documents give no rows. The added columns replace columns of the same names.
    """
    # The kept columns travel as one, so that their names can't clash with those of the directory.
    base = docs.select(F.struct(*keep).alias("row"), key_column().alias("key"), size_column().alias("bytes"))
    rows = stored(docs.select(key_column().alias("key"), size_column().alias("bytes")), "keys")
    buckets = directory(rows, limit)
    placed = _placed(base, buckets)
    crowded = not buckets.where((F.col("depth") == BITS) & (F.col("docs") > 1) & (F.col("bytes") > limit)).isEmpty()
    out = _with_pages(placed, limit) if crowded else placed.withColumn("page", F.lit(0).cast("long"))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(F.call_function("shiftrightunsigned", F.col("lo"), F.lit(BITS) - F.col("depth"))), F.col("depth"), F.lit("0")))
    added = {"shard": bits, "depth": F.col("depth").cast("int"), "shard_bytes": F.col("shard_bytes"), "shard_docs": F.col("shard_docs"), "page": F.col("page")}
    return out.select(*[F.col("row")[c].alias(c) for c in keep if c not in added], *[v.alias(k) for k, v in added.items()])


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and page of every document, at a limit of 1 MiB."""
    return shard(documents(spark, sf_dir)).select("doc_id", "shard", "depth", "page", "shard_bytes", "shard_docs")


OP10_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lpad(bin(('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 15))::BIGINT), 60, '0') AS bits,
    coalesce(strlen(text), 0) AS bytes FROM documents),
p AS (SELECT r, doc_id, bytes, k AS depth, left(bits, k) AS shard FROM d, generate_series(0, 60) AS g(k)),
s AS (SELECT depth, shard, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY ALL),
ok AS (SELECT * FROM s WHERE shard_bytes <= {LIMIT} OR shard_docs = 1 OR depth = 60),
m AS (SELECT p.r, p.doc_id, p.bytes, ok.*, row_number() OVER (PARTITION BY p.r ORDER BY p.depth) AS first FROM p JOIN ok USING (depth, shard)),
n AS (SELECT *, shard_bytes > {LIMIT} AND shard_docs > 1 AS over, greatest(1, {LIMIT} // greatest(bytes, 1)) AS room,
    row_number() OVER (PARTITION BY shard, depth) - 1 AS k FROM m WHERE first = 1),
q AS (SELECT *, CASE WHEN over THEN k // room ELSE 0 END AS page FROM n)
SELECT doc_id, shard, depth::INTEGER AS depth, page::BIGINT AS page,
  (CASE WHEN over THEN least(room, shard_docs - page * room) * bytes ELSE shard_bytes END)::BIGINT AS shard_bytes,
  (CASE WHEN over THEN least(room, shard_docs - page * room) ELSE shard_docs END)::BIGINT AS shard_docs
FROM q
"""
