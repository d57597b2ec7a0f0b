"""Language-model scores by stupid backoff (operator 5), over trigrams unless told otherwise.

A word scores log(count(context, word) / count(context, any)) under the longest context whose n-gram occurs at least MIN_COUNT
times in all documents, plus log(BACKOFF) for every longer context that the document has there; without such a context it
scores log(count(word) / words). Contexts don't reach over a document's start. Each log is a whole number of micro-nats, so a
document's sum doesn't depend on the order of addition.

Texts become blocks of documents with vocabularies of their own. The words of all blocks meet in the partition of their hash,
which gives each word a number and its counts: the unigram table, joined back to the blocks. All n-grams are then exploded and
partitioned by the hash of the word before the last, so a partition has the whole count tables of the n-grams and contexts of
all orders that end so; it joins them to its n-grams, and sums scores per document.

Scale: words are compared as they are and numbered exactly; hashes only say where they go. Frequent words have small numbers.
Exchanges carry packed rows, one for each block and partition; an n-gram takes a few bytes however many partitions there are,
since a row needs no dictionary. A word that would fill more than a part of a partition is hot: the n-grams after it go to two
partitions, dealt by the two words before the last, which scores those with a frequent trigram, and by the last two words,
which scores the others; either has all counts that it needs. The number of partitions follows the number of words, which is
all that the driver learns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, as_bytes, documents, stored, tidy

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2
#: A word that fills this much of a partition is hot.
HOT = 1.0
BLOCK_BYTES = 12 << 20
BLOCK_DOCS = 1 << 16
PART_WORDS = 1_500_000
MICRO = 1_000_000
CODEC = "zstd"
#: Most bytes of a word that are taken from the word before.
PREFIX = 10
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)


def micro(x: float | np.ndarray) -> np.ndarray:
    return np.rint(np.log(x) * MICRO).astype(np.int64)


def _spread(a: np.ndarray, b: np.ndarray | int, parts: int) -> np.ndarray:
    """A partition for each pair of numbers."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.asarray(b).astype(np.uint64)  # two fixed odd multipliers
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(parts)).astype(np.int64)


# ---- packed arrays -------------------------------------------------------------------------------------------------


def _squeezed(*arrays: np.ndarray, steps: int = 0) -> bytes:
    """Arrays of whole numbers from 0, each in as few bytes a number as its largest takes and a plane for each of these, compressed
    together. The first `steps` arrays are kept as differences, which are small where they ascend."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for k, a in enumerate(arrays):
        kind = "<u1" if not len(a) or a.max() < 1 << 8 else "<u2" if a.max() < 1 << 16 else "<u4" if a.max() < 1 << 32 else "<u8"
        whole = a.astype(kind)
        if k < steps and len(whole):
            whole[1:] -= whole[:-1].copy()  # modulo the width
        planes = whole.view(np.uint8).reshape(len(a), int(kind[2])).T
        parts += [np.array([len(a), int(kind[2]), k < steps], "<i8").tobytes(), planes.tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, CODEC, asbytes=True)


def _loosened(b: bytes) -> list[np.ndarray]:
    """The arrays, with 32 bits a number if that is enough."""
    raw = memoryview(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), CODEC, asbytes=True))
    out, at = [], 8
    for _ in range(int(np.frombuffer(raw, "<i8", 1)[0])):
        n, width, step = (int(x) for x in np.frombuffer(raw, "<i8", 3, at))
        whole = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at + 24).reshape(width, n).T).view(f"<u{width}").reshape(n)
        whole = np.cumsum(whole, dtype=whole.dtype) if step else whole
        out.append(whole.astype(np.int32 if width < 4 else np.int64))
        at += 24 + n * width
    return out


def _gaps(a: np.ndarray) -> np.ndarray:
    """An array by its differences, as whole numbers from 0: 0, -1, 1, -2, ... are 0, 1, 2, 3, ..."""
    d = np.diff(a.astype(np.int64), prepend=0)
    return d << 1 ^ d >> 63


def _from_gaps(z: np.ndarray) -> np.ndarray:
    z = z.astype(np.int64)
    return np.cumsum(z >> 1 ^ -(z & 1))


class Words:
    """Words as one run of bytes and where each ends."""

    def __init__(self, raw: np.ndarray, size: np.ndarray) -> None:
        self.raw, self.size = raw, size.astype(np.int64)
        self.start = np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return len(self.size)

    @staticmethod
    def of(array: pa.Array) -> Words:
        ends = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
        return Words(data[int(ends[0]) : int(ends[-1])], np.diff(ends))

    def arrow(self) -> pa.Array:
        ends = np.concatenate([self.start, [len(self.raw)]]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(self.raw))])

    def taken(self, which: np.ndarray) -> Words:
        size = self.size[which]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[which], size)
        return Words(self.raw[at], size)

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.arrow().to_pylist()), dtype=np.uint64, count=len(self))

    def packed(self) -> tuple[bytes, bytes]:
        """Words in order: how many bytes each has in common with the one before (at most PREFIX) and of its own, and these."""
        if not len(self):
            return _squeezed(self.size, self.size), bytes(8) + pa.compress(b"", CODEC, asbytes=True)
        column = np.arange(PREFIX)
        head = np.where(column < self.size[:, None], self.raw[np.minimum(self.start[:, None] + column, len(self.raw) - 1)], 0)
        common = np.zeros(len(self), dtype=np.int64)
        common[1:] = np.minimum(np.minimum.accumulate(head[1:] == head[:-1], axis=1).sum(axis=1), np.minimum(self.size[1:], self.size[:-1]))
        own = self.raw[np.arange(len(self.raw)) - np.repeat(self.start, self.size) >= np.repeat(common, self.size)].tobytes()
        return _squeezed(common, self.size - common), len(own).to_bytes(8, "little") + pa.compress(own, CODEC, asbytes=True)

    @staticmethod
    def unpacked(sizes: bytes, raw: bytes) -> Words:
        common, rest = _loosened(sizes)
        data = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), CODEC, asbytes=True), np.uint8)
        size = (common + rest).astype(np.int64)
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), dtype=np.uint8)
        out[np.arange(len(data)) - np.repeat(np.cumsum(rest) - rest, rest) + np.repeat(start + common, rest)] = data
        for j in range(int(common.max(initial=0))):
            # A word's byte j is that of the last word before it that has it as its own.
            has = np.maximum.accumulate(np.where((common <= j) & (size > j), np.arange(len(size)), 0))
            at = np.flatnonzero(common > j)
            out[start[at] + j] = out[start[has[at]] + j]
        return Words(out, size)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (large binary) of binary texts, the number of each word in order, and how many words each text has. Words
    are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[int(ends[0]) : int(ends[-1])]]
    ends = ends - ends[0]
    word = ~_SPACE[data]
    inner = ends[:-1][ends[:-1] < len(data)]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    begins[inner] = word[inner]  # a text's first byte continues no word of the text before
    stops[:-1] &= ~word[1:] | begins[1:]
    at = np.flatnonzero(begins)
    coded = Words(data[word], np.flatnonzero(stops) + 1 - at).arrow().dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), np.diff(np.searchsorted(at, ends))


def _order(*keys: np.ndarray) -> np.ndarray:
    """An order of rows by whole numbers from 0, the first key first; by one number where all fit into 63 bits."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    whole = np.zeros(len(keys[0]), dtype=np.int64)
    for k, b in zip(keys, bits, strict=True):
        whole = whole << b | k
    return np.argsort(whole)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys start a new value."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


# ---- rows of the exchanges -----------------------------------------------------------------------------------------

#: kind 0: a block's documents (ids; sizes, known); 1: n-grams; 2: n-grams by their context, of hot words; 3: these by their last
#: words; 4: sums of a block's documents; 5: a block's words (codes, sizes, known, partitions of its vocabulary); 6: words asked
#: for, with their counts in the block; 7: their numbers and counts in all documents. ids are signed and packed as they are.
_ROW = "part int, kind int, block bigint, sizes binary, words binary, body binary, ids binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("sizes", pa.binary()), ("words", pa.binary()), ("body", pa.binary()), ("ids", pa.binary())])


def _table(rows: list[dict]) -> pa.Table:
    """Rows as a kernel's result; what Arrow holds of earlier groups goes back to the system."""
    pa.default_memory_pool().release_unused()
    return pa.Table.from_pylist(rows, _SCHEMA)


# ---- blocks and the unigram table ----------------------------------------------------------------------------------


def _blocks(parts: int, block_bytes: int):
    """Blocks of documents as rows of kind 5, and what they ask of the unigram table."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        size, made = 0, 0

        def out() -> pa.RecordBatch:
            block = task << 24 | made
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, texts = whole.column(0).combine_chunks(), whole.column(1).combine_chunks()
            vocabulary, codes, lens = tokens(texts)
            # Words in order, and where each of them goes.
            order = np.asarray(pa.compute.sort_indices(vocabulary))
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            codes, words = rank[codes], Words.of(vocabulary).taken(order)
            part = _spread(words.hashes(), 0, parts) if len(words) else np.zeros(0, np.int64)
            n = np.bincount(codes, minlength=len(words))
            ends = np.cumsum(lens)[lens > 0] - 1
            followed = n - np.bincount(codes[ends], minlength=len(words))
            known = np.asarray(ids.is_valid())
            rows = [{"part": 0, "kind": 5, "block": block, "body": _squeezed(codes, lens, known.astype(np.int64), part), "ids": np.asarray(ids.fill_null(0), dtype=np.int64).tobytes(), "n": len(codes)}]
            for p in np.unique(part).tolist():
                mine = np.flatnonzero(part == p)
                sizes, raw = words.taken(mine).packed()
                rows.append({"part": p, "kind": 6, "block": block, "sizes": sizes, "words": raw, "body": _squeezed(n[mine], followed[mine])})
            return pa.RecordBatch.from_pylist(rows, _SCHEMA.append(pa.field("n", pa.int64())))

        for batch in batches:
            texts = np.asarray(pa.compute.binary_length(batch.column(1)), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                # As many rows as fill the block, and one at least.
                room = int(np.searchsorted(np.cumsum(texts[at:]), block_bytes - size, side="right"))
                stop = min(batch.num_rows, at + max(1, room), at + BLOCK_DOCS - sum(b.num_rows for b in held))
                held.append(batch.slice(at, stop - at))
                size += int(texts[at:stop].sum())
                at = stop
                if size >= block_bytes or at < batch.num_rows or sum(b.num_rows for b in held) >= BLOCK_DOCS:
                    yield out()
                    held, size, made = [], 0, made + 1
        if held:
            yield out()

    return kernel


def _numbered(parts: int):
    """The unigram table of a partition, joined to the words that blocks ask for: a number and the counts of each."""

    def kernel(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = [Words.unpacked(r["sizes"], r["words"]).arrow() for r in rows]
        coded = pa.concat_arrays(lists).dictionary_encode()
        at = np.asarray(coded.indices)
        bodies = [_loosened(r["body"]) for r in rows]
        n, followed = (np.bincount(at, weights=np.concatenate([b[k] for b in bodies]), minlength=len(coded.dictionary)).astype(np.int64) for k in (0, 1))
        # Frequent words first, so that their numbers are small; no two partitions share a number, and 0 is no word.
        number = np.empty(len(n), dtype=np.int64)
        number[np.argsort(-n, kind="stable")] = np.arange(len(n)) * parts + table.column("part")[0].as_py() + 1
        ends = np.cumsum([len(x) for x in lists])
        out = []
        for r, x, e in zip(rows, lists, ends.tolist(), strict=True):
            mine = at[e - len(x) : e]
            out.append({"part": r["part"], "kind": 7, "block": r["block"], "body": _squeezed(number[mine], n[mine], followed[mine])})
        return _table(out)

    return kernel


# ---- n-grams -------------------------------------------------------------------------------------------------------


def _rows(kind: int, block: int, part: np.ndarray, grams: list[np.ndarray], doc: np.ndarray, number: np.ndarray, n: np.ndarray, followed: np.ndarray) -> Iterator[dict]:
    """One row a partition: its distinct n-grams (the word before, the word, those before), their documents, the counts of their
    words, and for hot words what follows them. grams: columns of ranks in `number`, which ascends; 0 is no word."""
    order = _order(part, *grams)
    part, grams, doc = part[order], [g[order] for g in grams], doc[order]
    cut = np.append(np.flatnonzero(_changes(part)), len(part))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = [g[a:b] for g in grams]
        at = np.flatnonzero(_changes(*own))
        own = [g[at] for g in own]
        words = np.unique(own[1])
        hot = [followed[own[0]]] if kind == 3 else []
        yield {"part": int(part[a]), "kind": kind, "block": block, "body": _squeezed(*(number[g] for g in own), _gaps(n[words]), np.diff(np.append(at, b - a)), doc[a:b], *hot, steps=1)}


def _exploded(parts: int, order: int, heavy: float):
    """A block's words with their numbers; every word with the words before it, as rows."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.to_pylist()
        if not own:
            return _table([])
        block = own[0]["block"]
        codes, lens, known, part_of = _loosened(own[0]["body"])
        number, n, followed = (np.zeros(len(part_of), dtype=np.int64) for _ in range(3))
        for r in right.to_pylist():
            mine = part_of == r["part"]
            number[mine], n[mine], followed[mine] = _loosened(r["body"])
        # Ranks by number, from 1; 0 is no word.
        by = np.argsort(number)
        rank = np.empty(len(by), dtype=np.int32)
        rank[by] = np.arange(1, len(by) + 1, dtype=np.int32)
        number, n, followed = (np.concatenate([[0], x[by]]) for x in (number, n, followed))
        w = rank[codes]
        doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        place = np.arange(len(w)) - np.repeat(np.cumsum(lens) - lens, lens)
        before = [np.where(place >= k, np.concatenate([np.zeros(k, np.int32), w])[: len(w)], np.int32(0)) for k in range(1, order)]
        is_hot = n > heavy
        is_hot[0] = True  # what begins a document is dealt out by the word itself
        c, grams = before[0], [before[0], w, *before[1:]]
        by_last = is_hot[c]
        by_context = by_last & (before[1] > 0) if order > 2 else np.zeros(len(w), dtype=bool)
        rows: list[dict] = []
        for kind, mine, second in ((1, ~by_last, None), (2, by_context, before[1] if order > 2 else w), (3, by_last, w)):
            if mine.any():
                other = np.uint64(kind) if second is None else number[second[mine]].astype(np.uint64) * np.uint64(4) + np.uint64(kind)
                rows += _rows(kind, block, _spread(number[c[mine]], other, parts), [g[mine] for g in grams], doc[mine], number, n, followed)
        rows.append({"part": block % parts, "kind": 0, "block": block, "ids": own[0]["ids"], "body": _squeezed(lens, known)})
        return _table(rows)

    return kernel


def _sums(block: int, doc: np.ndarray, value: np.ndarray, parts: int) -> dict:
    """The sums of a block's documents, on their way to the partition that gathers the block; no value is above 0."""
    total = np.zeros(int(doc.max()) + 1, dtype=np.int64)
    np.add.at(total, doc, -value)
    used = np.unique(doc)
    return {"part": block % parts, "kind": 4, "block": block, "body": _squeezed(used, total[used], steps=1)}


def _levels(order: np.ndarray, keys: list[np.ndarray], n: np.ndarray, least: int) -> list[np.ndarray]:
    """For rows in `order` by keys: by how many leading keys are compared, from `least` on, each row's sum of n over the rows
    that agree in them."""
    n = n[order].astype(np.int64)
    new, out = np.zeros(len(order), dtype=bool), []
    for depth, k in enumerate(keys, 1):
        new |= _changes(k[order])
        if depth >= least:
            at = np.flatnonzero(new)
            whole = np.empty(len(order), dtype=np.int32 if int(n.sum()) < 1 << 31 else np.int64)
            whole[order] = np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, len(n))))
            out.append(whole)
    return out


def _scored(parts: int, order: int, min_count: int, backoff: float, total_words: int):
    """A partition's counts of n-grams and contexts over all blocks, joined to its n-grams: sums of documents."""

    def kernel(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [r for r in rows if r["kind"] == 0]
        rows = [r for r in rows if r["kind"] != 0]
        if not rows:
            return _table(out)
        bodies = [_loosened(r["body"]) for r in rows]
        c, w, *more, _, n = (np.concatenate([b[k] for b in bodies]) for k in range(order + 2))
        size = [len(b[0]) for b in bodies]
        kind = np.repeat(np.array([r["kind"] for r in rows], dtype=np.int8), size)
        # Each row lists its distinct words' counts in the order of their numbers.
        single = np.concatenate([_from_gaps(b[order])[np.unique(b[1], return_inverse=True)[1]].astype(np.int32 if total_words < 1 << 31 else np.int64) for b in bodies])
        after = np.concatenate([b[order + 3] if r["kind"] == 3 else np.zeros(len(b[0]), np.int32) for r, b in zip(rows, bodies, strict=True)])
        where = [(r["block"], len(b[0]), b[order + 1], b[order + 2]) for r, b in zip(rows, bodies, strict=True)]
        del bodies, rows
        # n-grams by the word before, the word, and the words before these; contexts without the word.
        grams = _levels(_order(kind, c, w, *more), [kind, c, w, *more], n, 3)
        contexts = _levels(_order(kind, c, *more), [kind, c, *more], n, 2)
        contexts[0] = np.where(kind == 3, after, contexts[0])
        one = micro(backoff)
        value = micro(single) - micro(max(1, total_words))
        mine = kind != 2
        # From the shortest context to the longest: the last one with a frequent n-gram wins.
        for k, x in enumerate([c, *more]):
            has = x > 0
            seen = has & (grams[k] >= min_count)
            value = np.where(seen, micro(grams[k]) - micro(np.maximum(contexts[k], 1)), value + np.where(has, one, 0))
            if k == 1:
                # A hot word's n-grams are scored by their contexts where the trigram is frequent, else by their last words.
                mine = np.where(kind == 2, seen, (kind == 1) | ~seen)
        at = 0
        sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for block, count, runs, doc in where:
            use = np.repeat(mine[at : at + count], runs)
            if use.any():
                sums.setdefault(block, []).append((doc[use], np.repeat(value[at : at + count], runs)[use]))
            at += count
        out += [_sums(block, *map(np.concatenate, zip(*found)), parts) for block, found in sums.items()]
        return _table(out)

    return kernel


def _summed(table: pa.Table) -> pa.Table:
    """A block's documents with the sums of all partitions."""
    rows = table.to_pylist()
    names = next(r for r in rows if r["kind"] == 0)
    sizes, known = _loosened(names["body"])
    ids = np.frombuffer(names["ids"], np.int64)
    total = np.zeros(len(ids), dtype=np.int64)
    for r in rows:
        if r["kind"] == 4:
            doc, value = _loosened(r["body"])
            total[doc] -= value
    return pa.table({"doc_id": pa.array(ids, mask=known == 0), "n_words": pa.array(sizes, pa.int64()), "total": pa.array(total)})


@tidy
def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words and total (micro-nats, a sum over the words) for every row of docs, under n-grams of up to `order` words.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Null, empty and blank texts have no words and a total of 0; repeated rows
    are separate documents and count each time; null ids stay; no documents give no rows; other columns are ignored.
    """
    if order < 2:
        raise ValueError("the model has at least bigrams")
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text"))
    spread = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # vocabularies are a small part of the texts
    blocks = stored(slim.mapInArrow(_blocks(spread, BLOCK_BYTES), _ROW + ", n bigint"), "blocks")
    words = blocks.agg(F.sum("n")).first()[0] or 0
    blocks = blocks.drop("n")
    names = blocks.where("kind = 6").groupBy("part").applyInArrow(_numbered(spread), _ROW)
    parts = max(1, -(-words // PART_WORDS))
    rows = blocks.where("kind = 5").groupBy("block").cogroup(names.groupBy("block")).applyInArrow(_exploded(parts, order, HOT * PART_WORDS), _ROW)
    sums = rows.groupBy("part").applyInArrow(_scored(parts, order, min_count, backoff, words), _ROW)
    return sums.groupBy("block").applyInArrow(_summed, "doc_id bigint, n_words bigint, total bigint")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigram score of every document under the counts of all of them: the total in micro-nats and, as score, its mean a word."""
    mean = F.when(F.col("n_words") > 0, F.col("total") / F.col("n_words")).otherwise(F.lit(0.0))
    return score(documents(spark, sf_dir)).withColumn("score", mean.cast("double"))


OP5_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
t AS (SELECT r, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS c, CASE WHEN i > 2 THEN ws[i - 2] END AS e FROM (SELECT r, ws, unnest(generate_series(1, len(ws))) AS i FROM d)),
total AS (SELECT count(*) AS n FROM t),
u AS (SELECT w, count(*) AS n FROM t GROUP BY w),
b AS (SELECT c, w, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY c, w),
x AS (SELECT c, sum(n) AS n FROM b GROUP BY c),
g AS (SELECT e, c, w, count(*) AS n FROM t WHERE e IS NOT NULL GROUP BY e, c, w),
y AS (SELECT e, c, sum(n) AS n FROM g GROUP BY e, c),
s AS (
  SELECT r, CASE WHEN g.n >= {MIN_COUNT} THEN round(ln(g.n) * 1e6) - round(ln(y.n) * 1e6)
    ELSE CASE WHEN t.e IS NULL THEN 0 ELSE round(ln({BACKOFF}) * 1e6) END + CASE WHEN b.n >= {MIN_COUNT} THEN round(ln(b.n) * 1e6) - round(ln(x.n) * 1e6)
      ELSE CASE WHEN t.c IS NULL THEN 0 ELSE round(ln({BACKOFF}) * 1e6) END + round(ln(u.n) * 1e6) - round(ln(total.n) * 1e6) END END AS v
  FROM t CROSS JOIN total JOIN u ON t.w = u.w LEFT JOIN b ON t.c = b.c AND t.w = b.w LEFT JOIN x ON t.c = x.c
    LEFT JOIN g ON t.e = g.e AND t.c = g.c AND t.w = g.w LEFT JOIN y ON t.e = y.e AND t.c = y.c),
z AS (SELECT r, sum(v) AS v FROM s GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(v, 0)::BIGINT AS total, CASE WHEN len(ws) > 0 THEN coalesce(v, 0)::BIGINT::DOUBLE / len(ws) ELSE 0.0::DOUBLE END AS score FROM d LEFT JOIN z USING (r)
"""
