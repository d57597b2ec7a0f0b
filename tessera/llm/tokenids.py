"""Token ids in a compressed binary format (operator 4).

Texts become ids of a public byte-level tokenizer. Global counts of the ids give one canonical Huffman code whose words are
limited to LENGTH_LIMIT bits (package-merge). A file is a run of records in doc_id order, each one document's bit string,
with a checkpoint (bit offset) every BLOCK ids, so that blocks decode independently through one table.

Scale: texts are tokenized once, in the scan's tasks. Counts are added up in each task before the shuffle; the driver sees
one number an id of the vocabulary. Only encoded documents are sorted by id range, a fraction of the texts' size. Positions
in the whole sequence come from one sum a file.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, documents, dropped, rows_of, stored

LENGTH_LIMIT = 18
BLOCK = 512
#: Ids that a file holds at most, about, where there are more files than shuffle partitions.
FILE_IDS = 1 << 28
END_ID = 2
#: Entries kept by a worker's dictionary of pieces, which bounds its memory.
PIECES = 500_000
_loaded: dict[str, tuple] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts, equal to the tokenizer's own for the whole text.

    The tokenizer splits a text before its merges, and always in front of a single space, and on both sides of a single line
    feed, between two characters that are not white space. Pieces between such places, a line feed kept with what follows,
    are looked up in a dictionary; texts in which a piece starts or ends with other white space, or that hold one of the
    tokenizer's own added tokens, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.added = [x.content for x in self.t.get_added_tokens_decoder().values()]
        vocab = self.t.get_vocab()
        self.leads = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids whose token starts with the space
        self.leads[[i for w, i in vocab.items() if w.startswith("\u0120")]] = True
        self.feed = vocab["\u010a"]  # the line feed's own token
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)

    def raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, words: pa.Array, sep: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of sep + word for every word, one after another, and where each begins; sep is a space or nothing. The
        words hold no space, and a line feed only at their start, where all of them have one if sep is nothing."""
        flat, start, base = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)], 0
        cut = pa.array([*range(0, len(words), 5_000), len(words)], pa.int32())
        for joined in pa.compute.binary_join(pa.ListArray.from_arrays(cut, words), sep).to_pylist() if len(words) else ():
            ids = np.array(self.raw([sep + joined])[0], dtype=np.int32)
            flat.append(ids)
            start.append(np.flatnonzero(self.leads[ids] if sep else ids == self.feed) + base)
            base += len(ids)
        return np.concatenate(flat), np.append(np.concatenate(start), base)

    def __call__(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        n = len(texts)
        if not n:
            return []
        split = pa.compute.split_pattern(pa.compute.replace_substring(texts, "\n", " \n"), " ")
        bound = np.asarray(split.offsets, dtype=np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        word, words = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
        at = np.asarray(pa.compute.index_in(words, value_set=self.known).fill_null(-1), dtype=np.int64).copy()
        flat, start = self.flat, self.start
        used = np.zeros(len(words), dtype=bool)
        head = np.zeros(len(word), dtype=bool)
        head[bound[:-1]] = True
        used[word[~head]] = True
        new = np.flatnonzero(used & (at < 0))
        strings = words.take(pa.array(new))
        spaced = _plain(strings)
        fed = np.asarray(pa.compute.starts_with(strings, "\n"), dtype=bool)
        fed[fed] = _plain(pa.compute.utf8_slice_codeunits(strings.filter(pa.array(fed)), 1))
        new = np.concatenate([new[spaced], new[fed]])
        if len(new):
            (ids, begin), (more, after) = self.pieces(strings.filter(pa.array(spaced)), " "), self.pieces(strings.filter(pa.array(fed)), "")
            ids, begin = np.concatenate([ids, more]), np.concatenate([begin, after[1:] + begin[-1]])
            if len(begin) != len(new) + 1:
                raise AssertionError("pieces and their first tokens differ in number")
            at[new] = np.arange(len(new)) + len(start) - 1
            flat, start = np.concatenate([flat, ids]), np.concatenate([start, begin[1:] + start[-1]])
            room = max(0, PIECES - len(self.known))
            if room:
                # Entries are numbered as they come, so a word's place among the known ones is its entry.
                self.known = pa.concat_arrays([self.known, words.take(pa.array(new[:room]))])
                kept = len(self.known)
                self.flat, self.start = flat[: start[kept]], start[: kept + 1]
        entry = at[word]
        entry[head] = -1
        size = np.where(entry >= 0, np.diff(start)[entry] if len(start) > 1 else 0, 0)
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(start[np.maximum(entry, 0)] - ends[:-1], size) + np.arange(int(ends[-1]))]
        firsts = words.take(pa.array(word[bound[:-1]])).to_pylist()
        # Whole texts: those with an added token, and those with a piece that has white space or nothing at an end.
        odd = np.add.reduceat(((entry < 0) & ~head).astype(np.int64), bound[:-1]) > 0
        for a in self.added:
            odd |= np.asarray(pa.compute.match_substring(texts, a))
        many = np.diff(bound) > 1
        odd |= many & np.array([not f or f[-1].isspace() for f in firsts])
        begin_ids = self.raw(firsts)
        out = [np.concatenate([np.array(f, dtype=np.int32), ids[ends[p] : ends[q]]]) for f, p, q in zip(begin_ids, bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
        whole = np.flatnonzero(odd).tolist()
        for i, x in zip(whole, self.raw([texts[i].as_py() for i in whole]), strict=True):
            out[i] = np.array(x, dtype=np.int32)
        return out


def _plain(words: pa.Array) -> np.ndarray:
    """Which words have a character, and no white space at an end."""
    same = pa.compute.equal(pa.compute.utf8_trim_whitespace(words), words)
    return np.asarray(pa.compute.and_(same, pa.compute.not_equal(words, "")), dtype=bool)


def _encoder(path: str) -> Encoder:
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = (Encoder(path),)
    return _loaded[path][0]


def _packed(ids: np.ndarray) -> bytes:
    """Two bytes an id where they do, else four; told apart by the first byte."""
    small = not len(ids) or ids.max() < 65_536
    return (b"\x02" if small else b"\x04") + ids.astype("<u2" if small else "<u4").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u2" if b[0] == 2 else "<u4", offset=1)


def _texts(column: pa.Array) -> pa.Array:
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are not UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string())


_TOKENS = "doc_id bigint, ids binary, counts binary"


def _tokenize(path: str, end_id: int):
    """Documents' ids, and in a last row of its own the counts of a task's ids."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        total = np.zeros(0, dtype=np.int64)
        names = ["doc_id", "ids", "counts"]
        for batch in rows_of(batches, 12 << 20):
            if not batch.num_rows:
                continue
            ids = [np.append(x, end_id) for x in encode(_texts(batch.column(1)))]
            c = np.bincount(np.concatenate(ids), minlength=len(total))
            c[: len(total)] += total
            total = c
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_packed, ids), pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return kernel


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (packed, with the end id) of every row, and rows with counts alone; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text")).mapInArrow(_tokenize(path, end_id), _TOKENS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.column(0).to_pylist():
            total = np.frombuffer(b, np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


def code_lengths(counts: np.ndarray, limit: int = LENGTH_LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; a lone symbol has one bit."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if n == 1:
        return np.ones(1, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.int64)
    # Each level merges the leaves with the pairs of the level below; what counts is how many leaves are among its first items.
    weights, is_leaf = leaf, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        m = len(weights) // 2
        pairs = weights[0 : 2 * m : 2] + weights[1 : 2 * m : 2]
        both = np.concatenate([leaf, pairs])
        o = np.argsort(both, kind="stable")
        weights = both[o]
        is_leaf.append(o < n)
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * (n - 1)
    for level in reversed(is_leaf):
        leaves = int(level[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of symbols in ascending order: shorter words first, then by symbol."""
    codes, code, last = np.zeros(len(lengths), dtype=np.int64), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Code:
    """A canonical code: ids, their lengths and words; encodes and decodes sequences of ids."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.lengths = ids, lengths
        top = int(ids.max(initial=-1)) + 1
        self.length_of, self.word_of = np.zeros(top, dtype=np.int64), np.zeros(top, dtype=np.int64)
        words = canonical(lengths)
        self.length_of[ids], self.word_of[ids] = lengths, words
        self.width = int(lengths.max(initial=1))
        # The table: every value of the next `width` bits gives the id whose word starts it, and the word's length.
        self.symbol, self.size = np.zeros(1 << self.width, dtype=np.int32), np.ones(1 << self.width, dtype=np.int8)
        o = np.lexsort((ids, lengths))
        span = 1 << (self.width - lengths[o])
        self.symbol[: int(span.sum())] = np.repeat(ids[o], span)
        self.size[: int(span.sum())] = np.repeat(lengths[o], span)

    def encode(self, ids: list[np.ndarray], block: int = BLOCK) -> list[tuple[bytes, np.ndarray]]:
        """For each sequence its bit string (most significant bit first, padded to bytes) and the bit offset of every block."""
        n = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate(ids)
        size = self.length_of[flat]
        end = np.concatenate([[0], np.cumsum(size)])
        cut = np.concatenate([[0], np.cumsum(n)])
        bits = end[cut[1:]] - end[cut[:-1]]
        base = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
        within = end[:-1] - np.repeat(end[cut[:-1]], n)
        start = within + np.repeat(8 * base[:-1], n)
        buf = np.zeros(int(base[-1]) + 8, dtype=np.uint8)
        # A word of up to 24 bits at any bit offset touches four bytes at most.
        shifted = self.word_of[flat] << (32 - size - (start & 7))
        at = start >> 3
        for k in range(4):
            # Words don't overlap, so adding their bytes sets their bits.
            np.add.at(buf, at + k, ((shifted >> (24 - 8 * k)) & 255).astype(np.uint8))
        return [(buf[base[i] : base[i + 1]].tobytes(), within[cut[i] : cut[i + 1] : block]) for i in range(len(ids))]

    def decode(self, data: list[bytes], offsets: list[np.ndarray], n: list[int], block: int = BLOCK) -> list[np.ndarray]:
        """The ids of bit strings of n ids each: the blocks of all of them step together, each from its own offset."""
        raw = np.frombuffer(b"".join(data) + bytes(8), np.uint8).astype(np.int64)
        base = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        lanes = np.array([len(o) for o in offsets], dtype=np.int64)
        if not lanes.sum():
            return [np.zeros(0, dtype=np.int64) for _ in data]
        own = np.repeat(np.arange(len(data)), lanes)
        number = np.arange(len(own)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        left = np.minimum(block, np.array(n, dtype=np.int64)[own] - number * block)
        at = np.concatenate([np.asarray(o, dtype=np.int64) for o in offsets]) + 8 * base[own]
        order = np.argsort(-left, kind="stable")
        at, sizes = at[order], left[order]
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # lanes that have a k-th id
        out = np.zeros((int(sizes[0]), len(own)), dtype=np.int32)
        mask, shift = (1 << self.width) - 1, 32 - self.width
        word = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        for k in range(int(sizes[0])):
            m = live[k]
            p = at[:m]
            bits = word[p >> 3] >> (shift - (p & 7)) & mask
            out[k, :m] = self.symbol[bits]
            p += self.size[bits]
        back = np.empty(len(own), dtype=np.int64)
        back[order] = np.arange(len(own))
        grid = out.T[back]
        ids = grid[np.arange(grid.shape[1])[None, :] < left[:, None]]
        return np.split(ids, np.cumsum(n)[:-1])


def id_counts(ids: DataFrame) -> list[tuple[int, int]]:
    """Every id of the documents and how often it occurs, in ascending order: one row an id of the vocabulary."""
    rows = ids.select("counts").where("counts is not null").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return sorted((r["id"], r["n"]) for r in rows)


def fit_code(counts: list[tuple[int, int]], limit: int = LENGTH_LIMIT) -> Code:
    return Code(np.array([i for i, _ in counts], dtype=np.int64), code_lengths(np.array([n for _, n in counts], dtype=np.int64), limit))


def _encode(shared, block: int, bounds: list[float]):
    edges = np.array(bounds)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: Code = shared.value
        for part in rows_of(batches, 1 << 21):
            if part.num_rows:
                ids = [_unpacked(b) for b in part.column(1).to_pylist()]
                done = code.encode(ids, block)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, ids), pa.int64()), pa.array([d for d, _ in done], pa.binary()), pa.array([o.tolist() for _, o in done], pa.list_(pa.int64())), pa.array(_file_of(part.column(0), edges))],
                    ["doc_id", "n_tokens", "bits", "offsets", "file"],
                )

    return kernel


_RECORD = "doc_id bigint, n_tokens bigint, bits binary, offsets array<bigint>, file int"


def _file_of(doc_id: pa.Array, edges: np.ndarray) -> np.ndarray:
    """The file of each id: null ids are in the first, an id in the one after all edges below it."""
    k = np.searchsorted(edges, np.asarray(doc_id.fill_null(0), dtype=np.int64), side="left")
    return np.where(np.asarray(doc_id.is_valid()), k, 0).astype(np.int32)


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID, limit: int = LENGTH_LIMIT, block: int = BLOCK, files: int | None = None) -> None:
    """Writes docs to `path`: code/ (id, length), records/ (a file for each range of doc_id, in ascending order) and starts/ (ids before each file)."""
    spark = docs.sparkSession
    ids = stored(tokenize(docs, vocabulary_path, end_id), "ids")
    counts = id_counts(ids)
    code = fit_code(counts, limit)
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(code.ids, code.lengths, strict=True)], "id bigint, length int").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(code)  # a table of 2**limit entries
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(c for _, c in counts) // FILE_IDS))
    # Edges from the ids alone: a range exchange would run the encoding a second time to sample it.
    edges = sorted(set(ids.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    records = ids.where("ids is not null").select("doc_id", "ids").mapInArrow(_encode(shared, block, edges), _RECORD)
    # Rows that share an id follow each other by a hash of their bits.
    records.repartitionById(n, F.col("file")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("bits")).write.parquet(f"{path}/records")
    for f in ids.inputFiles()[:1]:
        dropped(spark, f.rsplit("/", 1)[0])
    sums = spark.read.parquet(f"{path}/records").groupBy("file").agg(F.sum("n_tokens").alias("n")).orderBy("file").collect()  # one row a file
    starts = list(itertools.accumulate((r["n"] for r in sums), initial=0))
    spark.createDataFrame([(r["file"], s) for r, s in zip(sums, starts)], "file int, before bigint").coalesce(1).write.parquet(f"{path}/starts")


def _decoded(code: Code, batch: pa.RecordBatch, block: int) -> Iterator[np.ndarray]:
    """The ids of a batch's records, about a million at a time."""
    n = batch.column("n_tokens").to_pylist()
    at = 0
    while at < len(n):
        end, held = at + 1, n[at]
        while end < len(n) and held + n[end] <= 1 << 20:
            held += n[end]
            end += 1
        part = batch.slice(at, end - at)
        yield from code.decode(part.column("bits").to_pylist(), [np.array(o, dtype=np.int64) for o in part.column("offsets").to_pylist()], n[at:end], block)
        at = end


def _digests(shared, block: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: Code = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in _decoded(code, batch, block)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), batch.column("file"), batch.column("row"), pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "file", "row", "ids_crc32"])

    return kernel


def read_code(spark: SparkSession, path: str) -> Code:
    rows = sorted((r["id"], r["length"]) for r in spark.read.parquet(f"{path}/code").collect())  # one row an id of the vocabulary
    return Code(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64))


def read_ids(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id and ids (array) of every document in the files."""
    shared = spark.sparkContext.broadcast(read_code(spark, path))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = [x.tolist() for x in _decoded(shared.value, batch, block)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spark.read.parquet(f"{path}/records").mapInArrow(kernel, "doc_id bigint, ids array<int>")


def read_digests(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from its decoded ids."""
    shared = spark.sparkContext.broadcast(read_code(spark, path))
    rows = spark.read.parquet(f"{path}/records").withColumn("row", F.xxhash64("bits"))
    out = rows.mapInArrow(_digests(shared, block), "doc_id bigint, n_tokens bigint, file int, row bigint, ids_crc32 bigint")
    w = Window.partitionBy("file").orderBy(F.asc_nulls_first("doc_id"), "row").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("within", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    return out.join(spark.read.parquet(f"{path}/starts"), "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, vocabulary_path: str | None = None, **options) -> DataFrame:
    """Writes docs to the shared folder, reads the files back and returns doc_id, start, n_tokens and ids_crc32 of every row.

    A null or empty text is the end id alone. A null doc_id comes before all others; rows that share an id follow each
    other in the order of a hash of their encoding. No documents give no rows. Other columns are ignored.
    """
    import uuid

    from .common import shared_dir

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, vocabulary_path or vocabulary(), **options)
    return read_digests(spark, path)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the binary format and back."""
    return encode_documents(documents(spark, sf_dir))


__all__ = ["Code", "Encoder", "canonical", "code_lengths", "encode_documents", "fit_code", "id_counts", "read_ids", "tokenize", "write"]
