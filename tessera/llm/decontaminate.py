"""Benchmark decontamination (operator 6).

Every shard of training documents (a few hundred thousand words, cut on document bounds) gets an FM-index over the test
vocabulary: words outside it can't be part of a match, so each run of them is one separator. Test windows are searched
backwards, all at once, through ranks of a wavelet matrix over the Burrows-Wheeler transform; occurrences are located by
walking to sampled suffix positions; overlapping occurrences merge into removal spans.

Scale: shards are built inside the scan's tasks, so nothing is shuffled and memory depends on SHARD_WORDS alone. The test
set is read in blocks of at most BLOCK_BYTES, and the driver holds one at a time. Executors get the blocks as files; of more
than one a worker loads one at a time, for HELD_BYTES of documents, so its memory doesn't grow with the test set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, documents, rows_of

WINDOW = 10
SHARD_WORDS = 400_000
BLOCK_BYTES = 32 << 20
#: Bytes of documents that a further block of the test set is loaded for.
HELD_BYTES = 32 << 20
SAMPLE = 8
#: Runs longer than this are cut, with an overlap of a window less one word, which bounds the depth of the suffix sort.
PIECE = 256
#: A-Z become a-z; every byte that is not in a word becomes a space. All bytes of characters from U+0080 belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(_FOLD).split()


class WaveletMatrix:
    """Ranks of every symbol in a sequence, one level a bit, by cumulated counts."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def mapped(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1
            up = self.ones[k][at]
            at = np.where(one == 1, self.zeros[k] + up, at - up)
        return at


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """The order of all suffixes, where every separator has a rank of its own: packed triples, then doubling on ties only."""
    n = len(rank)
    r = rank.astype(np.int64)
    pad = np.concatenate([r + 1, [0, 0]])
    base = int(pad.max()) + 1
    if base < 1 << 21:
        key, h = (pad[:n] * base + pad[1 : n + 1]) * base + pad[2 : n + 2], 3
    else:
        key, h = pad[:n] * base + pad[1 : n + 1], 2
    sa = np.argsort(key)
    k = key[sa]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    while True:
        first = np.flatnonzero(new)
        group = np.repeat(first, np.diff(np.append(first, n)))
        order = np.empty(n, dtype=np.int64)
        order[sa] = group
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        pos = sa[at]
        nxt = pos + h
        second = np.where(nxt < n, order[np.minimum(nxt, n - 1)] + 1, 0)
        key = group[at] * (n + 1) + second
        o = np.argsort(key, kind="stable")
        sa[at] = pos[o]
        k = key[o]
        new[at] = np.concatenate([[True], k[1:] != k[:-1]])
        h *= 2


class FMIndex:
    """Backward search and location over codes from 1; 0 is a separator, and a text never matches across one."""

    def __init__(self, codes: np.ndarray, top: int) -> None:
        n = len(codes)
        sep = codes == 0
        m = int(sep.sum())
        rank = np.where(sep, np.cumsum(sep) - 1, m + codes - 1)
        sa = suffix_array(rank)
        bwt = codes[(sa - 1) % n]
        self.matrix = WaveletMatrix(bwt.astype(np.int64), max(1, int(top).bit_length()))
        self.first = self.matrix.mapped(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))
        counts = np.bincount(codes, minlength=top + 1)
        self.c = np.concatenate([[0], np.cumsum(counts)])[: top + 1]
        self.counts = counts
        kept = (sa % SAMPLE == 0) | (bwt == 0)
        self.mark = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = sa[kept]
        self.bwt = bwt

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.c[symbol] + self.matrix.mapped(symbol, at) - self.first[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [lo, hi) of the rows of phrases, all of one length."""
        lo = self.c[phrases[:, -1]].copy()
        hi = lo + self.counts[phrases[:, -1]]
        live = np.flatnonzero(hi > lo)
        for j in range(phrases.shape[1] - 2, -1, -1):
            s = phrases[live, j]
            lo[live], hi[live] = self.step(s, lo[live]), self.step(s, hi[live])
            live = live[hi[live] > lo[live]]
        hi[hi < lo] = lo[hi < lo]
        dead = np.ones(len(lo), dtype=bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        at, walked, out = at.copy(), np.zeros(len(at), dtype=np.int64), np.full(len(at), -1)
        todo = np.arange(len(at))
        while len(todo):
            here = at[todo]
            found = self.mark[here + 1] > self.mark[here]
            done = todo[found]
            out[done] = self.sampled[self.mark[at[done]]] + walked[done]
            todo = todo[~found]
            at[todo] = self.step(self.bwt[at[todo]], at[todo])
            walked[todo] += 1
        return out


class Phrases:
    """The distinct windows of a block of test items, by length, over the block's vocabulary."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int) -> None:
        self.code: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.ids: list[str | None] = []
        number: dict[int | None, int] = {}
        for item, text in items:
            w = [self.code.setdefault(x, len(self.code) + 1) for x in words_of(text)]
            if w:
                k = number.setdefault(item, len(number))
                if k == len(self.ids):
                    self.ids.append(None if item is None else str(item))
                for i in range(max(1, len(w) - window + 1)):
                    owners.setdefault(tuple(w[i : i + window]), set()).add(k)
        self.groups: list[tuple[np.ndarray, list[list[int]]]] = []
        for size in sorted({len(p) for p in owners}):
            own = [(p, sorted(o)) for p, o in owners.items() if len(p) == size]
            self.groups.append((np.array([p for p, _ in own], dtype=np.int64), [o for _, o in own]))


def _shard(texts: list[bytes], phrases: Phrases, window: int) -> list[tuple[int, np.ndarray, set[int]]]:
    """For each text: its number of words, its merged removal spans (word ranges) and the items found."""
    code = phrases.code
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    total = int(starts[-1])
    get = code.get
    known = np.fromiter((get(w, 0) for ws in split for w in ws), dtype=np.int64, count=total)
    # A run of known words ends at an unknown one, at a document's end, and, with an overlap, after PIECE words.
    bound = np.zeros(total + 1, dtype=bool)
    bound[starts] = True
    inside = np.flatnonzero(known)
    found: list[tuple[np.ndarray, np.ndarray, int, int]] = []
    if len(inside):
        head = np.concatenate([[True], (np.diff(inside) > 1) | bound[inside[1:]]])
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, len(inside)))
        begin = inside[at]
        if (length > PIECE).any():
            step = PIECE - (window - 1)
            parts = [(b + o, min(PIECE, n - o)) for b, n in zip(begin.tolist(), length.tolist(), strict=True) for o in range(0, max(1, n - (window - 1)), step)]
            begin, length = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        end = np.cumsum(length + 1)
        word = np.arange(int(end[-1])) - np.repeat(end - length - 1, length + 1) + np.repeat(begin, length + 1)
        codes = known[np.minimum(word, total - 1)]
        codes[end - 1] = 0
        index = FMIndex(codes, len(code))
        for rows, owners in phrases.groups:
            lo, hi = index.search(rows)
            hit = np.flatnonzero(hi > lo)
            if len(hit):
                n = hi[hit] - lo[hit]
                which = np.repeat(hit, n)
                row = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)
                pos = word[index.locate(row)]
                found.append((which, pos, rows.shape[1], owners))
    cover = np.zeros(total + 1, dtype=np.int64)
    items: list[set[int]] = [set() for _ in texts]
    for which, pos, size, owners in found:
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + size, -1)
        doc = np.searchsorted(starts, pos, side="right") - 1
        for d, p in np.unique(np.stack([doc, which]), axis=1).T.tolist():
            items[d].update(owners[p])
    hit = np.cumsum(cover)[:total] > 0
    out = []
    for i in range(len(texts)):
        h = np.concatenate([[False], hit[starts[i] : starts[i + 1]], [False]])
        out.append((int(sizes[i]), np.flatnonzero(h[1:] != h[:-1]).reshape(-1, 2), items[i]))
    return out


_SPANS = "array<struct<start:int,end:int>>"


def _merged(spans: list[list[int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [{"start": a, "end": e} for a, e in out]


def _pieces(batches: Iterator[pa.RecordBatch], most: int, alone: bool) -> Iterator[tuple[pa.RecordBatch, list[pa.RecordBatch]]]:
    """Batches with their shards; with more than one block, a batch is all that a block is loaded for."""
    for batch in rows_of(batches, most if alone else HELD_BYTES):
        yield batch, [batch] if alone else list(rows_of([batch], most))


def _search(blocks: list, window: int, shard_words: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shards in _pieces(batches, shard_words * 6, len(blocks) == 1):
            texts = [s.column(s.num_columns - 1).to_pylist() for s in shards]
            sizes = [0] * batch.num_rows
            spans: list[list[list[int]]] = [[] for _ in sizes]
            found: list[set[str]] = [set() for _ in sizes]
            for b in blocks:
                phrases: Phrases = b.value
                at = 0
                for part in texts:
                    for n, s, items in _shard(part, phrases, window):
                        sizes[at] = n
                        spans[at] += s.tolist()
                        found[at].update(x for k in items if (x := phrases.ids[k]) is not None)
                        at += 1
                del phrases
                if len(blocks) > 1 and getattr(b, "_path", None) is not None:
                    del b._value  # a worker holds one block; it reads the next use of this one from its file
            extra = [pa.array(sizes, pa.int64()), pa.array([_merged(s) for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], [*batch.schema.names[:-1], "n_words", "spans", "items"])

    return kernel


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """The test set in blocks of at most BLOCK_BYTES and one item; the driver holds one at a time."""
    block, held = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), as_bytes(text_col)).toLocalIterator():
        if held and held + len(r[1]) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((r[0], bytes(r[1])))
        held += len(r[1])
    yield block


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), shard_words: int = SHARD_WORDS) -> DataFrame:
    """The `keep` columns and, for every row of docs, n_words, spans (merged word ranges, end exclusive) and items (sorted ids of the items found).

    A document's word is in a span when it lies inside any occurrence of a window: `window` consecutive words of an item, or
    all words of an item with fewer. Null and empty texts have no words; items without words match nothing; an item whose id
    is null marks words but is no entry of items; repeated items count once. Repeated documents are separate rows. Columns
    other than the named ones are ignored.
    """
    sc = docs.sparkSession.sparkContext
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    schema += f", n_words bigint, spans {_SPANS}, items array<string>"
    base = docs.select(*keep, as_bytes(text_col).alias("__bytes"))
    return base.mapInArrow(_search(list(_blocks_phrases(benchmark, window, sc)), window, shard_words), schema)


def _blocks_phrases(benchmark: DataFrame, window: int, sc):
    for block in _blocks(benchmark, "item_id", "text"):
        yield sc.broadcast(Phrases(block, window))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold any test window, with all their columns. Rows are judged one by one: repeated rows all stay
    or all go, null and empty texts stay, ids may be null; no test set removes nothing; no documents give no rows."""
    whole = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return find_overlaps(whole, benchmark, window, keep=("__row",)).where(F.size("spans") == 0).select("__row.*")


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str:
    """The text without the words of its removal spans and what stands between them."""
    raw = (text or "").encode()
    folded = raw.translate(_FOLD)
    bounds, i = [], 0
    while i < len(folded):
        if folded[i] == 32:
            i += 1
            continue
        j = folded.find(b" ", i)
        j = len(folded) if j < 0 else j
        bounds.append((i, j))
        i = j
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : bounds[a][0]])
        at = bounds[b - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document lie inside test windows."""
    found = find_overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
bi AS (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS n FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM di),
m AS (SELECT DISTINCT r, i, dw.n, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
