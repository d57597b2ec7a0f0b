"""Documents of the model as arrays of a whole batch: steps over them that follow one another run as one Arrow kernel, so that
documents don't go through rows between the steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..schema import DOC, DOC_DDL, TOKEN_FIELDS
from .kernels import texts_of

Array = np.ndarray
#: Most tokens of a batch, but for a document of more.
MOST = 1 << 17


def _types(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def _arrow(ddl: str) -> pa.DataType:
    """The type of a column of the model, without a session, for workers."""
    if ddl.startswith("array<"):
        return pa.list_(_arrow(ddl[6:-1]))
    if ddl.startswith("struct<"):
        fields, depth, part = [], 0, ""
        for c in ddl[7:-1] + ",":
            depth += (c == "<") - (c == ">")
            if c == "," and not depth:
                name, _, kind = part.partition(":")
                fields.append((name, _arrow(kind)))
                part = ""
            else:
                part += c
        return pa.struct(fields)
    return {"bigint": pa.int64(), "int": pa.int32(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_()}[ddl]


SCHEMA = pa.schema([(k, _arrow(v)) for k, v in DOC.items()])
TOKEN_TYPE = SCHEMA.field("tokens").type.value_type
SPAN_TYPE = SCHEMA.field("entities").type.value_type


class Coded:
    """Strings as numbers of distinct values; -1 is null."""

    def __init__(self, values: list[str], codes: Array) -> None:
        self.values, self.codes = values, codes
        self.number = {v: k for k, v in enumerate(values)}

    @staticmethod
    def of(column: pa.Array) -> Coded:
        if column.null_count == len(column):
            return Coded([], np.full(len(column), -1, dtype=np.int64))
        d = column.dictionary_encode()
        return Coded(d.dictionary.to_pylist(), np.asarray(d.indices.fill_null(-1), dtype=np.int64))

    def code(self, value: str | None) -> int:
        """The number of a value, which becomes one if it was none."""
        if value is None:
            return -1
        if value not in self.number:
            self.number[value] = len(self.values)
            self.values.append(value)
        return self.number[value]

    def codes_of(self, column: pa.Array) -> Array:
        other = Coded.of(column)
        return np.array([*map(self.code, other.values), -1], dtype=np.int64)[other.codes]

    def array(self, codes: Array | None = None) -> pa.Array:
        codes = self.codes if codes is None else codes
        return pa.array(self.values, pa.string()).take(pa.array(codes, mask=codes < 0)) if self.values else pa.nulls(len(codes), pa.string())


def distinct(*columns: Coded) -> tuple[Array, Array]:
    """Where each distinct combination of columns first is, and the number of the one at each place."""
    key = np.zeros(len(columns[0].codes), dtype=np.int64)
    for k, c in enumerate(columns):
        if k > 1:  # keeps the key small enough for any number of columns
            key = np.unique(key, return_inverse=True)[1]
        key = key * (len(c.values) + 1) + c.codes + 1
    _, at, number = np.unique(key, return_index=True, return_inverse=True)
    return at, number


def ranges(start: Array, size: Array) -> tuple[Array, Array]:
    """For ranges of a start and a size: the number of its range, and each of its members."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size - start, size)


def list_sizes(lists: pa.Array) -> Array:
    return np.asarray(pc.list_value_length(lists).fill_null(0), dtype=np.int64)


def lists_of(sizes: Array, values: pa.Array, null: Array | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=None if null is None or not null.any() else pa.array(null))


def spans_of(doc: Array, n: int, start: Array, end: Array, label: pa.Array, ident: pa.Array, null: Array | None = None) -> pa.Array:
    """Lists of spans, one for each of n documents, of spans in the order of their documents (numbers)."""
    whole = lambda x: pa.array(x.astype(np.int32))
    return lists_of(np.bincount(doc, minlength=n), pa.StructArray.from_arrays([whole(start), whole(end), label, ident], fields=list(SPAN_TYPE)), null)


class Batch:
    """columns: all but the tokens, by name; sizes: tokens of each document; fields: those of all tokens, by name."""

    def __init__(self, columns: dict[str, pa.Array], sizes: Array, fields: dict[str, pa.Array], null: Array | None = None, words: pa.Array | None = None) -> None:
        self.columns, self.sizes, self.fields, self.null, self._words = columns, sizes, fields, null, words

    @property
    def first(self) -> Array:
        return np.cumsum(self.sizes) - self.sizes

    @property
    def doc(self) -> Array:
        """The number of each token's document."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @property
    def places(self) -> Array:
        """Each token's place in its document."""
        return np.arange(int(self.sizes.sum())) - np.repeat(self.first, self.sizes)

    @property
    def words(self) -> pa.Array:
        """The text of every token."""
        if self._words is None:
            tokens = pa.StructArray.from_arrays([self.fields["start"], self.fields["end"]], ["start", "end"]).to_pylist()
            at, out = self.first.tolist(), []
            for text, a, n in zip(self.columns["text"].to_pylist(), at, self.sizes.tolist()):
                out += texts_of(text or "", tokens[a : a + n])
            self._words = pa.array(out, pa.string())
        return self._words

    def changed(self, columns: Mapping[str, pa.Array] | None = None, fields: Mapping[str, pa.Array] | None = None) -> Batch:
        """The batch with other annotations; texts and tokens stay."""
        return Batch(self.columns | dict(columns or {}), self.sizes, self.fields | dict(fields or {}), self.null, self._words)

    @staticmethod
    def of(record: pa.RecordBatch) -> Batch:
        columns = dict(zip(record.schema.names, record.columns))
        lists = columns.pop("tokens")
        flat = lists.flatten()
        return Batch(columns, list_sizes(lists), dict(zip(TOKEN_FIELDS, flat.flatten())), np.asarray(lists.is_null()))

    def record(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = dict(self.columns)
        if "tokens" in schema.names:
            kind = schema.field("tokens").type
            flat = pa.StructArray.from_arrays([self.fields[f.name].cast(f.type) for f in kind.value_type], fields=list(kind.value_type))
            columns["tokens"] = lists_of(self.sizes, flat, self.null)
        n = len(self.sizes)
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def rows(self) -> list[dict]:
        """The documents as dicts, for what is done one by one."""
        return self.record(SCHEMA).to_pylist()


def from_rows(rows: Sequence[Mapping]) -> Batch:
    return Batch.of(pa.RecordBatch.from_pylist([{k: r.get(k) for k in DOC} for r in rows], schema=SCHEMA))


def of_words(record: pa.RecordBatch) -> Batch:
    """Documents from their words (array of strings), which follow one another without white space; other columns pass."""
    columns = dict(zip(record.schema.names, record.columns))
    lists = columns.pop("words")
    sizes, flat = list_sizes(lists), lists.flatten().cast(pa.string())
    n = len(flat)
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    first = np.cumsum(sizes) - sizes
    cut = ends[np.append(first, n)]
    data = flat.buffers()[2] if n else None
    text = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(cut.astype(np.int32)), data if data is not None else pa.py_buffer(b""))
    start = ends[:-1] - np.repeat(cut[:-1], sizes)
    coded = Coded.of(flat)
    chars = np.cumsum(np.array([*map(len, coded.values), 0], dtype=np.int64)[coded.codes])
    before = np.concatenate([[0], chars])
    idx = before[:-1] - np.repeat(before[first], sizes) if n else before[:0]
    whole = lambda x: pa.array(x.astype(np.int32))
    fields = {f.name: pa.nulls(n, f.type) for f in TOKEN_TYPE}
    fields |= {"start": whole(start), "end": whole(start + np.diff(ends)), "idx": whole(idx), "whitespace": pa.array(np.zeros(n, dtype=bool))}
    fields["norm"] = pa.array([w.lower() for w in coded.values], pa.string()).take(pa.array(coded.codes))
    empty = {"tensor": pa.array([[]] * len(sizes), pa.list_(pa.list_(pa.float32()))), "span_groups": pa.array([[]] * len(sizes), SCHEMA.field("span_groups").type)}
    return Batch({**columns, "text": text, **empty}, sizes, fields, words=flat)


def _cut(records: Iterator[pa.RecordBatch], lists: str, most: int) -> Iterator[pa.RecordBatch]:
    for record in records:
        size = np.cumsum(list_sizes(record.column(lists)))
        at = 0
        while at < record.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            yield record.slice(at, end - at)
            at = end


def _run(source: DataFrame, opened: Callable[[pa.RecordBatch], Batch], lists: str, steps: tuple, finish: Callable[[Batch], pa.RecordBatch], ddl: str) -> DataFrame:
    # A step whose cost is one for the whole batch asks for larger ones.
    most = max([MOST, *(getattr(step, "most", 0) for step in steps)])

    def kernel(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in _cut(records, lists, most):
            batch = opened(record)
            for step in steps:
                batch = step(batch)
            yield finish(batch)

    return source.mapInArrow(kernel, ddl)


def _chain(docs: DataFrame, more: Sequence[str] = ()) -> tuple:
    """What docs was made of, if it was made of steps; else the documents themselves, with the further columns."""
    held = docs.__dict__.get("_tessera_steps")
    return held or (docs.select(*DOC, *more), Batch.of, "tokens", ())


def _linked(chain: tuple, ddl: str) -> DataFrame:
    schema = _types(ddl)
    out = _run(*chain, lambda b: b.record(schema), ddl)
    out._tessera_steps = chain
    return out


def words_as_docs(words: DataFrame, fill: Callable[[Batch], None] = lambda _: None) -> DataFrame:
    """Documents of the model from doc_id and words, as fill sets them up; further columns are there for the next step."""

    def opened(record: pa.RecordBatch) -> Batch:
        batch = of_words(record)
        fill(batch)
        return batch

    return _linked((words, opened, "words", ()), DOC_DDL)


def stepped(docs: DataFrame, step: Callable[[Batch], Batch], more: Sequence[str] = (), ddl: str = DOC_DDL) -> DataFrame:
    """docs after a step, which reads the columns `more` besides the model's and gives those of ddl."""
    source, opened, lists, steps = _chain(docs, more)
    return _linked((source, opened, lists, (*steps, step)), ddl)


def only(docs: DataFrame, ddl: str) -> DataFrame:
    """Columns of docs; of documents made of steps no others become rows."""
    if "_tessera_steps" not in docs.__dict__:
        return docs.select(*_types(ddl).names)
    schema = _types(ddl)
    return _run(*_chain(docs), lambda b: b.record(schema), ddl)


def tokens_only(docs: DataFrame, ddl: str) -> DataFrame:
    """doc_id, i and the fields in ddl of every token; text is the token's."""
    schema = _types(f"doc_id bigint, i int, {ddl}")

    def finish(batch: Batch) -> pa.RecordBatch:
        own = {"doc_id": batch.columns["doc_id"].take(pa.array(batch.doc)), "i": pa.array(batch.places.astype(np.int32))}
        own |= {f: batch.words if f == "text" else batch.fields[f] for f in schema.names[2:]}
        return pa.RecordBatch.from_arrays([own[f.name].cast(f.type) for f in schema], schema=schema)

    return _run(*_chain(docs), finish, f"doc_id bigint, i int, {ddl}")
