"""Mixing sources to target weights by entropy balancing (operator 8).

Document rates are those closest in relative entropy to taking every document once, under one token constraint a source and
the bound that no document is taken more than CAP times: min(CAP, exp(x * size / mean)), where x is the multiplier of the
document's source and mean the source's mean size. So documents are tilted by their sizes, the long ones first. Newton steps
solve the convex dual; each step's gradient and curvature are sums over the documents, added up by Spark, and so is the
update of the multipliers. Rates are rounded into whole copies by error diffusion, from large documents to small.

Scale: the dual's passes read a stored table of the distinct sizes of each source, with their counts, which gives the same
sums as the documents. Sums are whole numbers of 2**-RATE_BITS, so their order doesn't matter and reruns agree. Sources are
rows of a table and never a collection on the driver, which sees one row a pass. For the rounding equal documents (id, source
and size) are one row, dealt into buckets of about BUCKET_ROWS rows, so a hot source is many groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from .common import documents, numbered, stored, tidy

CAP = 3
BUCKET_ROWS = 5_000
#: The largest relative difference between a source's rates and its target.
TOLERANCE = 1e-6
STEPS = 200
RATE_BITS = 30
WEIGHTS = 3


class NotConverged(EngineError):
    code = "not_converged"


def word_count(text: str = "text") -> F.Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _whole(x: F.Column) -> F.Column:
    return x.cast("decimal(38,0)")


def weighed(sources: DataFrame) -> DataFrame:
    """sources (source, n) with weight: 1, 2, 3, 1, ... by code point, null last. Sources are ranked in ranges of the sorted
    names, each range by itself, and the counts of the ranges before are added."""
    spread = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("range", F.spark_partition_id())
    held = stored(spread, "sources")
    counts = held.groupBy("range").agg(F.count("*").alias("c"))
    counts = counts.select("range", F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row a range
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").isNull(), "source")) - 1
    return held.withColumn("k", own).join(counts, "range").select("source", "n", ((F.col("base") + F.col("k")) % WEIGHTS + 1).cast("int").alias("weight"))


def token_targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources (source, n) with target: all words are shared by weight; a target stops at cap times its source's words, and what
    is left is shared again among the others until none is above."""
    t = stored(weighed(sources).withColumn("full", F.lit(False)), "weights")
    while True:
        total, closed, open_ = t.agg(_whole(F.sum("n")), _whole(F.sum(F.when(F.col("full"), F.col("n")))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        left = int(total or 0) - cap * int(closed or 0)
        if not open_:
            break
        # left * weight > cap * n * open, in whole numbers
        above = ~F.col("full") & (F.lit(left).cast("decimal(38,0)") * F.col("weight") > F.lit(cap * int(open_)).cast("decimal(38,0)") * F.col("n"))
        if t.where(above).isEmpty():
            break
        t = stored(t.withColumn("full", F.col("full") | above), "weights")
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(open_ or 1))
    return t.select("source", "n", F.when(F.col("full"), F.lit(float(cap)) * F.col("n")).otherwise(share).alias("target"))


def rate_column(x: F.Column, size: F.Column, mean: F.Column, cap: int = CAP) -> F.Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(x * size / mean, F.lit(50.0))))


def balance(sizes: DataFrame, targets: DataFrame, cap: int = CAP, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """targets (source, n, target) with mean and x. sizes: source, size, docs (documents of that size).

    Newton steps on the logarithm of a source's words, kept inside a bracket that shrinks with every step; a step that would
    leave it halves it. A source of no words has x = 0, one whose target is cap times its words or nought is at the bracket's
    end: a rate of cap, or of nought, for every document. Raises NotConverged if `steps` don't reach the tolerance.
    """
    held = stored(sizes.where("size > 0"), "sizes-by-source")
    mean = held.groupBy("source").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"), F.min("size").alias("least"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    state = targets.join(mean, same(targets, mean), "left").select(targets["source"], "n", "target", "mean", "least")
    full, none = F.col("target") >= F.col("n") * float(cap), F.col("target") <= 0
    # With x at the upper end even the smallest document is at the cap; the lower end leaves no word of the longest.
    ends = {"hi": F.log(F.lit(float(cap))) * F.col("mean") / F.col("least") + 1, "lo": F.lit(-60.0) * F.col("mean") / F.col("least")}
    state = state.withColumns(ends).withColumns({"done": F.col("mean").isNull() | full | none, "x": F.when(F.col("mean").isNull(), 0.0).when(none, F.col("lo")).when(full, F.col("hi")).otherwise(F.greatest("lo", F.least("hi", F.log(F.col("target") / F.col("n")))))})
    state = stored(state, "multipliers")
    fixed = F.lit(float(1 << RATE_BITS))
    for _ in range(steps):
        left = state.where(~F.col("done"))
        if left.isEmpty():
            return state.select("source", "n", "target", "mean", "x")
        r = rate_column(F.col("x"), F.col("size"), F.col("mean"), cap)
        words = F.sum(_whole(F.col("size") * F.col("docs")) * F.round(r * fixed).cast("long"))
        slope = F.sum(F.when(r < cap, _whole(F.col("size") * F.col("docs")) * F.round(F.least(r * F.col("size") / F.col("mean"), F.lit(1e6)) * fixed).cast("long")).otherwise(_whole(F.lit(0))))
        sums = held.join(left.select(F.col("source").alias("s"), "x", "mean"), F.col("source").eqNullSafe(F.col("s"))).groupBy("source")
        sums = sums.agg((words.cast("double") / fixed).alias("h"), (slope.cast("double") / fixed).alias("g")).withColumnRenamed("source", "s")
        met = F.abs(F.col("h") - F.col("target")) <= F.col("target") * tolerance
        low = F.col("h") < F.col("target")
        new = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        new = new.withColumns({"lo": F.when(F.col("h").isNotNull() & low, F.col("x")).otherwise(F.col("lo")), "hi": F.when(F.col("h").isNotNull() & ~low, F.col("x")).otherwise(F.col("hi")), "met": met})
        step = F.col("x") + F.log(F.col("target") / F.greatest(F.col("h"), F.lit(1e-12))) * F.col("h") / F.col("g")
        inside = (F.col("g") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        moved = F.when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        # A bracket that can't shrink any more is at a whole word's grain.
        tight = F.col("hi") - F.col("lo") <= 1e-13 * F.greatest(F.lit(1.0), F.abs(F.col("x")))
        stop = F.coalesce(F.col("met") | tight, F.lit(True)) | F.col("done")
        new = new.withColumns({"x": F.when(stop, F.col("x")).otherwise(moved), "done": stop})
        state = stored(new.select(*state.columns), "multipliers")
    raise NotConverged(f"{state.where('not done').count()} sources are not within {tolerance} of their targets after {steps} steps")


def diffused(size: np.ndarray, rate: np.ndarray, many: np.ndarray, cap: int = CAP) -> tuple[np.ndarray, np.ndarray]:
    """For groups of `many` equal documents, in order: the whole copies of each, at most cap, and how many of the group get one
    more. What a group takes too little or too much of is due from the next."""
    least, more = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
    due = 0.0
    for i in range(len(size)):
        s, n = int(size[i]), int(many[i])
        if s:
            due += float(rate[i]) * s * n
            copies = min(cap * n, max(0, round(due / s)))
            least[i], more[i] = divmod(copies, n)
            due -= copies * s
    return least, more


def _rounded(cap: int):
    def kernel(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("tie", "ascending"), ("doc_id", "ascending")])
        least, more = diffused(np.asarray(t.column("size")), np.asarray(t.column("rate")), np.asarray(t.column("many")), cap)
        return pa.table({**{c: t.column(c) for c in ("doc_id", "source", "size", "many")}, "least": pa.array(least), "more": pa.array(more)})

    return kernel


def plan(docs: DataFrame, cap: int = CAP, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """The sources (source, n, target, mean, x), and doc_id, source, size, many, least, more for every distinct doc_id, source and
    size: of its `many` rows each is taken `least` times and `more` of them once more."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    groups = stored(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("many")), "sizes")
    sizes = stored(groups.groupBy("source", "size").agg(F.sum("many").alias("docs")), "size-counts")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("n"))
    solved = balance(sizes, token_targets(sources, cap), cap)
    rows = groups.groupBy("source").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("buckets"))
    both = solved.join(rows, solved["source"].eqNullSafe(rows["source"])).select(solved["source"].alias("s"), "n", "target", "mean", "x", "buckets")
    both = stored(both, "solved")
    rated = groups.join(both, F.col("source").eqNullSafe(F.col("s"))).withColumn("tie", F.xxhash64("doc_id", "size")).withColumn("bucket", F.pmod("tie", "buckets"))
    rated = rated.withColumn("rate", F.when((F.col("size") > 0) & (F.col("target") > 0), rate_column(F.col("x"), F.col("size"), F.col("mean"), cap)).otherwise(0.0))
    taken = rated.select("doc_id", "source", "size", "many", "rate", "tie", "bucket").groupBy("source", "bucket")
    return both, taken.applyInArrow(_rounded(cap), "doc_id bigint, source string, size bigint, many bigint, least bigint, more bigint")


@tidy
def mix(docs: DataFrame, cap: int = CAP, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of docs.

    A null or empty text has size 0 and no copies; a null source is a source of its own, the last; documents tied in size
    are taken in the order of a hash of their id, so that reruns agree; rows of one id, source and size differ by one copy at
    most; no documents give no rows; other columns are ignored.
    """
    sources, taken = plan(docs, cap, bucket_rows)
    rows = taken.join(sources.select("s", F.col("n").alias("source_size"), "target"), F.col("source").eqNullSafe(F.col("s")))
    parts = F.array(F.struct(F.col("more").alias("k"), (F.col("least") + 1).alias("copies")), F.struct((F.col("many") - F.col("more")).alias("k"), F.col("least").alias("copies")))
    rows = rows.withColumn("part", F.explode(F.filter(parts, lambda p: p["k"] > 0)))
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("part.k"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", "part.copies")


@tidy
def mixed_documents(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, with all their columns.

    Of rows that agree in id, source and size, those that come first in a stored order are taken once more where the plan says
    so. Null ids and sources are values like others; null and empty texts are never taken; no documents give no rows."""
    names = docs.columns
    taken = stored(plan(docs, cap)[1].where("least + more > 0"), "taken")
    right = taken.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__n"), "many", "least", "more")
    right = right.select("__d", "__s", "__n", F.struct("many", "least", "more").alias("__t"))
    same = F.col("__id").eqNullSafe(F.col("__d")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__n"))
    own = docs.select(F.struct(*names).alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.col("source").cast("string").alias("__source"), word_count().alias("__size"))
    found = own.join(right, same).select("__row", "__d", "__s", "__n", "__t")
    even = found.where("__t.more = 0").select("__row", F.col("__t.least").alias("__copies"))
    # Groups of one row differ in nothing; larger ones are numbered to say which rows are taken once more.
    single = found.where("__t.more > 0 and __t.many = 1").select("__row", (F.col("__t.least") + 1).alias("__copies"))
    out = even.unionByName(single)
    if not taken.where("more > 0 and many > 1").isEmpty():
        uneven = found.where("__t.more > 0 and __t.many > 1").withColumn("__key", F.struct(F.coalesce("__d", F.lit(0)).alias("d"), F.col("__d").isNull().alias("nd"), F.coalesce("__s", F.lit("")).alias("s"), F.col("__s").isNull().alias("ns"), F.col("__n").alias("n")))
        out = out.unionByName(numbered(uneven, ["__key"], "__k").select("__row", (F.col("__t.least") + (F.col("__k") < F.col("__t.more")).cast("long")).alias("__copies")))
    return out.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select("__row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
