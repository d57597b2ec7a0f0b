"""Snapshots: the versioned JSON form of documents, with row-level validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, SnapshotError
from ..operators.entities import derived, tags_of
from ..operators.kernels import per_document
from ..schema import DOC, GROUP, POS_TAGS, with_doc_columns

VERSIONS = (1, 2, 3, 4)
_BODY = ", ".join(f"{k}: {v}" for k, v in DOC.items() if k != "doc_id")
SNAPSHOT_DDL = f"struct<format_version: int, document: struct<{_BODY}>>"


def version_column() -> F.Column:
    """The lowest version that can hold a document."""
    ids = F.exists(F.coalesce("tokens", F.array().cast(DOC["tokens"])), lambda t: t["entity_id"].isNotNull()) | F.exists(F.coalesce("entities", F.array().cast(DOC["entities"])), lambda s: s["id"].isNotNull())
    return F.when(F.size(F.coalesce("span_groups", F.array().cast(f"array<{GROUP}>"))) > 0, 4).when(ids, 3).when(F.size(F.coalesce("tensor", F.array().cast(DOC["tensor"]))) > 0, 2).otherwise(1)


def to_snapshot(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, snapshot: nulls inside are left out, as unavailable annotations are. Columns of the model in keep follow."""
    body = F.struct(*[F.col(c) for c in DOC if c != "doc_id"])
    made = F.to_json(F.struct(version_column().alias("format_version"), body.alias("document"))).alias("snapshot")
    return with_doc_columns(docs).select("doc_id", made, *keep)


def from_snapshot(rows: DataFrame, column: str = "snapshot", keep: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
    """Documents of a JSON column; a malformed one has a null text. Columns of rows follow under their names in keep."""
    parsed = F.from_json(F.col(column), SNAPSHOT_DDL)
    held = rows.select("doc_id", parsed.alias("s"), *[F.col(c).alias(n) for c, n in keep.items()])
    return held.select("doc_id", *[F.col(f"s.document.{c}").alias(c) for c in DOC if c != "doc_id"], *keep.values())


def validate(doc: Mapping, version: int | None = None) -> None:
    """Raises the first fault of a document, in the order of the format's rules."""
    text, tokens = doc["text"], doc["tokens"] or []

    def need(ok: bool, message: str) -> None:
        if not ok:
            raise SnapshotError(message)

    need(text is not None, "no text")
    if version is not None:
        need(version in VERSIONS, f"unknown version {version}")
        need(version >= 2 or not doc["tensor"], "a tensor needs version 2")
        need(version >= 4 or not doc["span_groups"], "span groups need version 4")
        has_ids = any(t["entity_id"] is not None for t in tokens) or any(s["id"] is not None for s in doc["entities"] or [])
        need(version >= 3 or not has_ids, "entity ids need version 3")
    need(all(t["entity_id"] != "" for t in tokens), "an entity id is not empty")
    rows = doc["tensor"] or []
    if rows:
        need(len(rows) == len(tokens) and len({len(r) for r in rows}) == 1 and 1 <= len(rows[0]) <= 4096, "the tensor has a row for each token, all of one width up to 4096")
        need(all(x is not None and abs(x) != float("inf") and x == x for r in rows for x in r), "the tensor is finite")
    for t in tokens:
        need((t["entity_iob"] or "") in ("", "B", "I", "O"), "unknown entity tag")
        need(not t["pos"] or t["pos"] in POS_TAGS, "unknown part of speech")
    raw, at, idx = text.encode(), 0, 0
    for t in tokens:
        a, b = t["start"], t["end"]
        need(a == at and a < b <= len(raw), "tokens tile the text")
        try:
            piece = raw[a:b].decode()
        except UnicodeDecodeError:
            raise SnapshotError("a token cuts a character") from None
        need(t["idx"] == idx, "idx counts code points")
        need(t["head"] is None or 0 <= t["head"] < len(tokens), "a head is a token")
        need(not t["whitespace"] or raw[b : b + 1] == b" ", "white space follows the token")
        at, idx = b + bool(t["whitespace"]), idx + len(piece) + bool(t["whitespace"])
    need(at == len(raw), "tokens tile the text")
    for kind in ("entities", "sentences", "noun_chunks"):
        last = 0
        for s in doc[kind] or []:
            need(last <= s["start"] < s["end"] <= len(tokens), f"{kind} are sorted, nonempty and disjoint")
            last = s["end"]
            label = {"entities": bool(s["label"]), "sentences": not s["label"], "noun_chunks": s["label"] == "NP"}[kind]
            need(label, f"label of {kind}")
            if kind == "entities":
                need((s["id"] or None) == (tokens[s["start"]]["entity_id"] or None), "an entity has its first token's id")
    spans = derived(tags_of(doc))
    plain = lambda x: None if x is None else [(s["start"], s["end"], s["label"]) for s in x]
    need(plain(doc["entities"]) == plain(spans) or not tokens and not doc["entities"], "entities are those of the tags")
    keys = [g["key"] for g in doc["span_groups"] or []]
    need(len(set(keys)) == len(keys), "group keys are unique")
    for g in doc["span_groups"] or []:
        need(all(0 <= s["start"] <= s["end"] <= len(tokens) and s["id"] != "" for s in g["spans"] or []), "group spans lie in the document")


def validate_docs(docs: DataFrame) -> DataFrame:
    """doc_id, error_code, message: one row for each faulty document."""

    def run(d: dict) -> list[dict]:
        try:
            validate(d)
        except EngineError as e:
            return [{"doc_id": d["doc_id"], "error_code": e.code, "message": str(e)}]
        return []

    return per_document(with_doc_columns(docs), run, "doc_id bigint, error_code string, message string")


def too_long(docs: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Documents over the length limit in code points."""
    return docs.where(F.length("text") > limit).select("doc_id", F.length("text").alias("length"))
