"""Entity tags and span groups: checked updates, repair, derivation and the group operations."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BoundsError, EngineError, PatternError, SnapshotError, UnsupportedError
from ..schema import DOC, DOC_DDL
from .batches import Batch, Coded, list_sizes, ranges, spans_of, stepped

DEFAULTS = ("outside", "missing", "blocked", "unmodified")
Tag = tuple[str | None, str | None, str | None]  # iob, type, id


def repaired(tags: Sequence[Tag]) -> list[Tag]:
    """Past the first token, an I that continues nothing of its type becomes a B. A repair never changes whether a tag is inside
    something, so the tags as they were say what each one follows. A leading I stays."""
    orphan = lambda before, tag: tag[0] == "I" and (before[0] not in ("B", "I") or (before[1] or "") != (tag[1] or ""))
    return [*tags[:1], *(("B", *tag[1:]) if orphan(before, tag) else tag for before, tag in zip(tags, tags[1:]))]


def derived(tags: Sequence[Tag]) -> list[dict] | None:
    """Entities of tags: B with a type opens, I continues whatever is open, all else closes; None if no token is annotated."""
    if tags and all(not t[0] for t in tags):
        return None
    out: list[dict] = []
    open_ = False
    for i, (iob, kind, ident) in enumerate(tags):
        if iob == "I":
            if not open_:
                raise UnsupportedError(f"I at token {i} continues no entity")
            out[-1]["end"] = i + 1
        else:
            open_ = iob == "B" and bool(kind)
            if open_:
                out.append({"start": i, "end": i + 1, "label": kind, "id": ident or None})
    return out


#: What the span lists of an update other than its entities write, and its default for tokens in none of them.
WRITES: dict[str, tuple[str | None, str | None]] = {"outside": ("O", ""), "missing": (None, None), "blocked": ("B", "")}


def _written(update: Mapping, n: int) -> list[tuple[int, int, str, Mapping]]:
    """The spans of an update that write tokens, with their list's name, in order; they must lie in the text and apart."""
    named = [(s["start"], s["end"], kind, s) for kind in ("entities", *WRITES) for s in update.get(kind) or ()]
    for a, b, *_ in named:
        if not 0 <= a <= b <= n:
            raise BoundsError(f"span {a}..{b} of {n} tokens")
    spans = sorted((x for x in named if x[0] < x[1] and (x[2] != "entities" or x[3].get("label"))), key=lambda x: x[:2])
    for x, y in zip(spans, spans[1:]):
        if y[0] < x[1]:
            raise BoundsError(f"spans {x[0]}..{x[1]} and {y[0]}..{y[1]} overlap")
    return spans


def set_entities(tags: Sequence[Tag], update: Mapping) -> list[Tag]:
    """Tags after an update of disjoint spans (entities, blocked, missing, outside) and a default for all other tokens. A token
    keeps its id unless an entity with one of its own is written over it; entities without a label write nothing."""
    default = update.get("default", "outside")
    if default not in DEFAULTS:
        raise PatternError(f"unknown default {default}")
    rest = lambda part: list(part) if default == "unmodified" else [(*WRITES[default], t[2]) for t in part]
    out: list[Tag] = []
    for a, b, kind, span in _written(update, len(tags)):
        out += rest(tags[len(out) : a])
        if kind == "entities":
            out += [("I" if i else "B", span["label"], span.get("id") or t[2]) for i, t in enumerate(tags[a:b])]
        else:
            out += [(*WRITES[kind], t[2]) for t in tags[a:b]]
    return repaired(out + rest(tags[len(out) :]))


def tags_of(doc: Mapping) -> list[Tag]:
    return [(t["entity_iob"] or None, t["entity_type"], t["entity_id"]) for t in doc["tokens"] or []]


def with_tags(doc: Mapping, tags: Sequence[Tag]) -> dict:
    tokens = [dict(t, entity_iob=iob, entity_type=kind, entity_id=ident) for t, (iob, kind, ident) in zip(doc["tokens"] or [], tags, strict=True)]
    return dict(doc, tokens=tokens, entities=derived(tags))


#: Spans of a batch, in any order: each one's document (its number), start and end, the list of the update it is in (a number in
#: LISTS), label and id.
Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]
LISTS = ("entities", *WRITES)


def write_tags(batch: Batch, spans: Spans, defaults: Sequence[str | None], errors: bool = False) -> Batch:
    """set_entities and derived for all documents of a batch. What is faulty is found for all at once, and the document's own update
    says what its error is."""
    doc, start, end, list_, label, ident = spans
    n, sizes, first, of = len(batch.sizes), batch.sizes, batch.first, batch.doc
    iob, kind, own = (Coded.of(batch.fields[f]) for f in ("entity_iob", "entity_type", "entity_id"))
    iob.codes = np.where(iob.codes == iob.code(""), -1, iob.codes)
    unnamed, inside, begin = kind.code(""), iob.code("I"), iob.code("B")
    labels, idents = kind.codes_of(label), own.codes_of(ident)
    idents = np.where(idents == own.code(""), -1, idents)
    bad = np.array([d not in DEFAULTS for d in defaults], dtype=bool)
    bad[doc[(start < 0) | (start > end) | (end > sizes[doc])]] = True
    writes = np.flatnonzero((start < end) & ((list_ > 0) | (labels >= 0) & (labels != unnamed)))
    writes = writes[np.lexsort((end[writes], start[writes], doc[writes]))]
    d, a, b = doc[writes], start[writes], end[writes]
    bad[d[1:][(d[1:] == d[:-1]) & (a[1:] < b[:-1])]] = True
    writes = writes[~bad[d]]
    d, a, b = doc[writes], start[writes], end[writes]

    # What the defaults and then the spans write.
    which, at = ranges(first[d] + a, b - a)
    fixed = {k: (iob.code(WRITES[k][0]), kind.code(WRITES[k][1])) for k in WRITES}
    pairs = np.array([fixed.get(x, (0, 0)) for x in defaults], dtype=np.int64).reshape(-1, 2)
    kept = np.array([x == "unmodified" for x in defaults], dtype=bool)[of]
    new_iob, new_kind = np.where(kept, iob.codes, pairs[of, 0]), np.where(kept, kind.codes, pairs[of, 1])
    ent = list_[writes] == 0
    table = np.array([(0, 0), *fixed.values()], dtype=np.int64)[list_[writes]]
    opens = np.zeros(len(at), dtype=bool)
    opens[np.cumsum(b - a) - (b - a)] = True
    new_iob[at] = np.where(ent[which], np.where(opens, begin, inside), table[which, 0])
    new_kind[at] = np.where(ent, labels[writes], table[:, 1])[which]
    given = np.where(ent, idents[writes], -1)[which]
    new_id = own.codes.copy()
    new_id[at] = np.where(given >= 0, given, new_id[at])

    # The repair, and the entities.
    heads = np.zeros(len(of) + 1, dtype=bool)
    heads[first] = True
    heads = heads[:-1]
    plain = np.where(new_kind == unnamed, -1, new_kind)
    goes_on = np.zeros(len(of), dtype=bool)
    goes_on[1:] = ((new_iob == begin) | (new_iob == inside))[:-1] & (plain[1:] == plain[:-1])
    new_iob[(new_iob == inside) & ~heads & ~goes_on] = begin
    stops = np.flatnonzero((new_iob != inside) | heads)
    open_ = (new_iob[stops] == begin) & (plain[stops] >= 0)
    until = np.append(stops[1:], len(of))
    loose = ~open_ & ((until - stops > 1) | (new_iob[stops] == inside))
    bad[of[stops[loose]]] = True
    stops, until = stops[open_], until[open_]
    annotated = np.bincount(of, weights=new_iob >= 0, minlength=n) > 0
    ids = np.where(new_id == own.code(""), -1, new_id)
    found = spans_of(of[stops], n, stops - first[of[stops]], until - first[of[stops]], kind.array(new_kind[stops]), own.array(ids[stops]), ~annotated & (sizes > 0))

    before = batch.fields
    out = Batch({k: c for k, c in batch.columns.items() if k in DOC} | {"entities": found}, sizes, before | {"entity_iob": iob.array(new_iob), "entity_type": kind.array(new_kind), "entity_id": own.array(new_id)}, batch.null, batch._words)
    if not bad.any() and not errors:
        return out

    def fault(k: int) -> EngineError:
        update: dict = {"default": defaults[k]}
        for j in np.flatnonzero(doc == k).tolist():
            update.setdefault(LISTS[list_[j]], []).append({"start": int(start[j]), "end": int(end[j]), "label": label[j].as_py(), "id": ident[j].as_py()})
        tags = zip(*(before[f].slice(first[k], sizes[k]).to_pylist() for f in ("entity_iob", "entity_type", "entity_id")))
        try:
            derived(set_entities([(t[0] or None, *t[1:]) for t in tags], update))
        except EngineError as e:
            return e
        raise AssertionError(f"document {k} of the batch has no fault")

    if not errors:
        raise fault(int(np.flatnonzero(bad)[0]))
    faults = {int(k): fault(int(k)) for k in np.flatnonzero(bad)}
    gone = pa.array(~bad[of])
    fields = {k: c.filter(gone) for k, c in out.fields.items()} if faults else out.fields
    columns = {k: c if k == "doc_id" or not faults else pc.if_else(pa.array(~bad), c, pa.nulls(n, c.type)) for k, c in out.columns.items()}
    columns |= {"error": pa.array([faults[k].code if k in faults else None for k in range(n)], pa.string()), "message": pa.array([str(faults[k]) if k in faults else None for k in range(n)], pa.string())}
    return Batch(columns, np.where(bad, 0, sizes), fields, bad if out.null is None else bad | out.null)


def update_spans(update: pa.Array) -> tuple[Spans, list[str | None]]:
    """The spans and defaults of a column of updates; a null one has no spans and the default outside."""
    names = [f.name for f in update.type]
    parts = []
    for k, name in enumerate(LISTS):
        if name in names:
            lists = pc.struct_field(update, name)
            doc, flat = np.repeat(np.arange(len(update)), list_sizes(lists)), lists.flatten()
            held = {f.name for f in flat.type}
            text = lambda f: flat.field(f).cast(pa.string()) if f in held else pa.nulls(len(flat), pa.string())  # noqa: E731, B023
            parts.append((doc, *(np.asarray(flat.field(f), dtype=np.int64) for f in ("start", "end")), np.full(len(doc), k), text("label"), text("id")))
    empty = (*(np.zeros(0, np.int64),) * 4, pa.array([], pa.string()), pa.array([], pa.string()))
    joined = tuple((np.concatenate if k < 4 else pa.concat_arrays)([p[k] for p in parts] or [empty[k]]) for k in range(6))
    # As in a dict of the fields: without the field the default is outside, and a null is unknown.
    default = pc.struct_field(update, "default").to_pylist() if "default" in names else ["outside"] * len(update)
    return joined, [x if ok else "outside" for x, ok in zip(default, update.is_valid().to_pylist(), strict=True)]


def update_entities(docs: DataFrame, update: str = "update", errors: bool = False) -> DataFrame:
    """Documents after the update in a column (struct of the span lists and default); with errors, also error and message, where a
    document that can't be updated has these alone."""
    step = lambda batch: write_tags(batch, *update_spans(batch.columns[update]), errors)
    return stepped(docs, step, [update], DOC_DDL + (", error string, message string" if errors else ""))


# ---- expressions over the token table ------------------------------------------------------------------------------


def repair_column(key: str = "doc_id", order: str = "i") -> Column:
    w = Window.partitionBy(key).orderBy(order)
    iob, kind = F.col("entity_iob"), F.coalesce(F.col("entity_type"), F.lit(""))
    before = F.lag(F.struct(F.coalesce(F.col("entity_iob"), F.lit("")).alias("iob"), kind.alias("kind"))).over(w)
    return F.when((iob == "I") & before.isNotNull() & (~before["iob"].isin("B", "I") | (before["kind"] != kind)), F.lit("B")).otherwise(iob)


def derive_entities(tokens: DataFrame, key: str = "doc_id", order: str = "i") -> DataFrame:
    """key, start, end, label, id of every entity: islands that a tag other than I starts, kept where it is B with a type."""
    w = Window.partitionBy(key).orderBy(order)
    island = F.sum((~F.coalesce(F.col("entity_iob"), F.lit("")).isin("I")).cast("int")).over(w)
    first = F.min_by(F.struct("entity_iob", "entity_type", "entity_id"), order)
    groups = tokens.withColumn("__g", island).groupBy(key, "__g").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), first.alias("f"))
    return groups.where("f.entity_iob = 'B' and coalesce(f.entity_type, '') <> ''").select(key, "start", "end", F.col("f.entity_type").alias("label"), F.col("f.entity_id").alias("id"))


def _previous(array: Column) -> Column:
    """The array's previous elements, null for the first. An expression over whole arrays costs the same when the optimizer puts
    the array's own expression in its place; an array looked up inside a lambda would not."""
    null = F.slice(F.transform(array, lambda x: F.when(F.lit(False), x)), F.lit(1), F.least(F.size(array), F.lit(1)))
    return F.concat(null, F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0))))


def repair_array(tags: Column) -> Column:
    """repair_column for a document's own array of (iob, kind, ...): no exchange and no sort."""
    none = F.lit("")

    def one(x: Column, i: Column) -> Column:
        t, before = x["t"], x["before"]
        orphan = (t["iob"] == "I") & (i > 0) & (~F.coalesce(before["iob"], none).isin("B", "I") | (F.coalesce(before["kind"], none) != F.coalesce(t["kind"], none)))
        return t.withField("iob", F.when(F.coalesce(orphan, F.lit(False)), F.lit("B")).otherwise(t["iob"]))

    return F.transform(F.arrays_zip(tags.alias("t"), _previous(tags).alias("before")), one)


def entity_array(tags: Column) -> Column:
    """derive_entities for a document's own array of (iob, kind, id): every tag but I ends what is open, so an entity reaches from
    a B with a type to the next such tag."""
    ends = F.filter(F.transform(tags, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: F.coalesce(x["t"]["iob"], F.lit("")) != "I")
    after = F.concat(F.transform(F.slice(ends, F.lit(2), F.greatest(F.size(ends) - 1, F.lit(0))), lambda x: x["i"]), F.array(F.size(tags)))
    spans = F.filter(F.arrays_zip(ends.alias("x"), after.alias("end")), lambda s: (s["x"]["t"]["iob"] == "B") & (F.coalesce(s["x"]["t"]["kind"], F.lit("")) != ""))
    return F.transform(spans, lambda s: F.struct(s["x"]["i"].alias("start"), s["end"].alias("end"), s["x"]["t"]["kind"].alias("label"), s["x"]["t"]["id"].alias("id")))


def entities_in_rows(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, label, id of every entity after the repair, from each document's own array (doc_id, tags: array of iob,
    kind, id), over arrays of a whole batch. Nothing is exchanged."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pc.list_value_length(lists).fill_null(0), dtype=np.int64)
            flat = lists.flatten()
            iob = flat.field("iob").fill_null("")
            inside, begin = (np.asarray(pc.equal(iob, x)) for x in ("I", "B"))
            named = flat.field("kind").fill_null("")
            kind = np.asarray(named.dictionary_encode().indices)
            first = np.zeros(len(kind) + 1, dtype=bool)
            first[np.cumsum(sizes) - sizes] = True
            first = first[:-1]
            goes_on = np.zeros(len(kind), dtype=bool)
            goes_on[1:] = (inside | begin)[:-1] & (kind[1:] == kind[:-1])
            orphan = inside & ~first & ~goes_on
            inside, begin = inside & ~orphan, begin | orphan
            at = np.flatnonzero(~inside | first)
            end = np.append(at[1:], len(kind))
            keep = begin[at] & np.asarray(pc.not_equal(named, ""))[at]
            at, end = at[keep], end[keep]
            doc = np.repeat(np.arange(len(sizes)), sizes)[at]
            base = (np.cumsum(sizes) - sizes)[doc]
            place = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array((at - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), named.take(place), flat.field("id").take(place)], ["doc_id", "start", "end", "label", "id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tags").mapInArrow(kernel, "doc_id bigint, start int, end int, label string, id string")


# ---- span groups ---------------------------------------------------------------------------------------------------


def has_overlap(spans: Sequence[Mapping]) -> bool:
    s = sorted((x["start"], x["end"]) for x in spans)
    return any(b[0] < a[1] for a, b in zip(s, s[1:]))


def has_overlap_col(spans: Column) -> Column:
    s = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    after = F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), after, lambda a, b: b["start"] < a["end"])
    return F.exists(pairs, lambda x: x)


def checked_spans(spans: Sequence[Mapping], n: int) -> list[dict]:
    for s in spans:
        if not 0 <= s["start"] <= s["end"] <= n:
            raise BoundsError(f"span {s['start']}..{s['end']} of {n} tokens")
    return [{"start": s["start"], "end": s["end"], "label": s.get("label") or "", "id": s.get("id") or None} for s in spans]


def set_group(groups: Sequence[Mapping], key: str, spans: Sequence[Mapping], n: int, name: str | None = None, attrs: Sequence[tuple[str, str]] = ()) -> list[dict]:
    """Groups with one set: a replaced key keeps its place, a new one comes last."""
    if len({k for k, _ in attrs}) != len(attrs):
        raise SnapshotError("an attribute is given twice")
    new = {"key": key, "name": key if name is None else name, "attrs": [{"key": k, "json": v} for k, v in attrs], "spans": checked_spans(spans, n)}
    if any(g["key"] == key for g in groups):
        return [new if g["key"] == key else dict(g) for g in groups]
    return [*map(dict, groups), new]


def remove_group(groups: Sequence[Mapping], key: str) -> list[dict]:
    return [dict(g) for g in groups if g["key"] != key]


def concat_groups(a: Mapping, b: Mapping) -> dict:
    """a with b's spans appended and those of b's attributes that a lacks."""
    have = {x["key"] for x in a["attrs"] or []}
    return dict(a, spans=[*(a["spans"] or []), *(b["spans"] or [])], attrs=[*(a["attrs"] or []), *(x for x in b["attrs"] or [] if x["key"] not in have)])


# Overlap filters -----------------------------------------------------------------------------------------------------


class Taken:
    """Tokens that accepted spans have taken, as spans in order, looked up by bisection."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> None:
        """Takes [a, b); spans that it meets become one with it, spans that only touch it stay apart."""
        if a >= b:
            return
        lo, hi = bisect_right(self.ends, a), bisect_left(self.starts, b)
        if lo < hi:
            a, b = min(a, self.starts[lo]), max(b, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [a], [b]

    def meets(self, a: int, b: int) -> bool:
        """Whether any token of [a, b) is taken."""
        return a < b and bisect_right(self.ends, a) < bisect_left(self.starts, b)

    def cuts(self, at: int) -> bool:
        """Whether the place between two tokens lies inside one span."""
        return bisect_right(self.ends, at) < bisect_left(self.starts, at)


def _ranked(spans: Iterable[Mapping]) -> list[Mapping]:
    """The longest first, of equal ones the earliest."""
    return sorted(spans, key=lambda s: (s["start"] - s["end"], s["start"]))


def first_longest(existing: Sequence[Mapping], new: Sequence[Mapping], n: int) -> list[Mapping]:
    """All spans by rank, existing ones before new ones; one whose first or last token is taken goes. The rest by start."""
    taken, kept = Taken(), []
    for s in _ranked([*existing, *new]):
        a, b = s["start"], s["end"]
        if not (taken.meets(a, a + 1) or taken.meets(b - 1, b)):
            taken.add(a, b)
            kept.append(s)
    return sorted(kept, key=lambda s: s["start"])


def prioritize_existing(existing: Sequence[Mapping], new: Sequence[Mapping], n: int) -> list[Mapping]:
    """All existing spans, and by rank the new ones that meet neither them nor one another."""
    return [*existing, *_apart(existing, new)[1]]


def prioritize_new(existing: Sequence[Mapping], new: Sequence[Mapping], n: int) -> list[Mapping]:
    """By rank the new spans that don't meet, after the existing ones that meet none of them. An empty span meets one that it
    lies inside of."""
    taken, accepted = _apart((), new)
    clear = lambda e: not (taken.meets(e["start"], e["end"]) if e["start"] < e["end"] else taken.cuts(e["start"]))
    return [*filter(clear, existing), *accepted]


def _apart(first: Sequence[Mapping], then: Sequence[Mapping]) -> tuple[Taken, list[Mapping]]:
    """The tokens that `first` and the accepted ones of `then` take, and these: by rank, those that meet nothing taken."""
    taken, accepted = Taken(), []
    for s in first:
        taken.add(s["start"], s["end"])
    for s in _ranked(then):
        if not taken.meets(s["start"], s["end"]):
            taken.add(s["start"], s["end"])
            accepted.append(s)
    return taken, accepted


FILTERS = {"first_longest": first_longest, "prioritize_new": prioritize_new, "prioritize_existing": prioritize_existing}
