"""Runs a Python function over whole documents, one Arrow batch at a time, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..errors import EngineError
from ..functions.lexical import Lexicon
from ..plans.predicates import TokenView


def texts_of(text: str, tokens: list[Mapping]) -> list[str]:
    if text.isascii():
        return [text[t["start"] : t["end"]] for t in tokens]
    raw = text.encode()
    return [raw[t["start"] : t["end"]].decode() for t in tokens]


def views(doc: Mapping, lexicon: Lexicon | None) -> list[TokenView]:
    tokens = doc["tokens"] or []
    return [TokenView(s, t, lexicon) for s, t in zip(texts_of(doc["text"] or "", tokens), tokens, strict=True)]


def per_document(docs: DataFrame, f: Callable[[dict], list[dict]], ddl: str, errors: bool = False) -> DataFrame:
    """Rows that f gives for each document. With errors, a failing document gives one row of doc_id, error and message
    (columns of ddl); without, it fails the job."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    schema = to_arrow_schema(StructType.fromDDL(ddl) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], ddl).schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[dict] = []
                for doc in batch.slice(at, 256).to_pylist():
                    try:
                        rows += f(doc)
                    except EngineError as e:
                        if not errors:
                            raise
                        rows.append({"doc_id": doc["doc_id"], "error": e.code, "message": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.mapInArrow(kernel, ddl)
