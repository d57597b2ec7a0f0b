"""Phrase dictionaries: overlapping matches of key sequences, by a trie in a kernel or by one equi-join for each phrase length."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MissingAnnotationError, PatternError
from ..functions.hashing import string_id
from ..functions.lexical import FLAGS, Lexicon
from ..plans.predicates import ANNOTATIONS, check_document_morph
from .kernels import per_document, texts_of, views

ATTRIBUTES = ("orth", "text", "lower", "norm", "lemma", "pos", "tag", "dep", "morphology", *FLAGS, "length")


def key_of(attribute: str, token: Mapping) -> str:
    """A token's key: null is empty, an empty analysis is "_", flags are true or false, a length is its decimal form."""
    v = token["text" if attribute == "orth" else attribute]
    if isinstance(v, bool):
        return "true" if v else "false"
    if attribute == "morphology" and v == "":
        return "_"
    return "" if v is None else str(v)


#: Marks a cell whose key was removed.
GONE = -1


class KeyTable:
    """The rules that end at one phrase. Iteration follows an open-addressing table of unsigned keys: eight cells, linear probing,
    doubled when it is three fifths full; keys 0 and 1 come last. A removed key leaves its cell in use, and the last such cell
    that a later key passes is where that key goes."""

    def __init__(self, keys: Sequence[int] = ()) -> None:
        self.cells: list[int | None] = [None] * 8
        self.low: set[int] = set()
        for k in keys:
            self.insert(k)

    def passed(self, key: int) -> list[int]:
        """The places that a key passes, up to its own or a free one."""
        size, out = len(self.cells), []
        for step in range(size):
            out.append((key + step) % size)
            if self.cells[out[-1]] in (None, key):
                break
        return out

    def insert(self, key: int) -> None:
        if key < 2:
            self.low.add(key)
            return
        way = self.passed(key)
        reused = [p for p in way if self.cells[p] == GONE]
        if reused:
            if self.cells[way[-1]] == key:
                self.cells[way[-1]] = GONE
            way.append(reused[-1])
        self.cells[way[-1]] = key
        if 5 * (sum(c is not None for c in self.cells) + 1) >= 3 * len(self.cells):
            again = KeyTable.__new__(KeyTable)
            again.cells, again.low = [None] * (2 * len(self.cells)), self.low
            for k in self.cells:
                if k is not None and k != GONE:
                    again.insert(k)
            self.cells = again.cells

    def remove(self, key: int) -> None:
        if key < 2:
            self.low.discard(key)
        elif self.cells[at := self.passed(key)[-1]] == key:
            self.cells[at] = GONE

    def __iter__(self):
        return iter([*(c for c in self.cells if c is not None and c != GONE), *sorted(self.low)])


@dataclass(frozen=True)
class PhraseMatcher:
    """An immutable registry of phrases, each a sequence of token keys under one attribute."""

    attribute: str = "orth"
    lexicon: Lexicon | None = None
    symbols: Mapping[str, int] = field(default_factory=dict)
    rules: Mapping[str, tuple[tuple[str, ...], ...]] = field(default_factory=dict)
    #: What was added (name, phrases) and removed (name, None), in order: it decides the order of rules that end together.
    log: tuple[tuple[str, tuple | None], ...] = ()

    def __post_init__(self) -> None:
        if self.attribute not in ATTRIBUTES:
            raise PatternError(f"unknown attribute {self.attribute}")
        if self.attribute in FLAGS and self.lexicon is None:
            raise PatternError("flags need a matcher with a lexicon")

    def add(self, name: str, phrases: Sequence[Sequence[str]]) -> PhraseMatcher:
        """Adds key sequences; an empty one registers the rule alone, repeated ones count once."""
        key = string_id(name, self.symbols)
        if any(n != name and string_id(n, self.symbols) == key for n in self.rules):
            raise PatternError(f"the name {name} has the key of another rule")
        held = self.rules.get(name, ())
        new = tuple(dict.fromkeys(tuple(p) for p in phrases if len(p)))
        added = tuple(p for p in new if p not in held)
        return replace(self, rules={**self.rules, name: held + added}, log=(*self.log, (name, added)))

    def add_docs(self, name: str, docs: Sequence[Mapping]) -> PhraseMatcher:
        """Adds the key sequences of documents; annotations must be there for at least one token of each nonempty one."""
        phrases = []
        for d in docs:
            tokens = views(d, self.lexicon)
            if tokens and self.attribute in ANNOTATIONS and all(t[self.attribute] is None for t in tokens):
                raise MissingAnnotationError(f"no token has {self.attribute}")
            phrases.append([key_of(self.attribute, t) for t in tokens])
        return self.add(name, phrases)

    def remove(self, name: str) -> PhraseMatcher:
        if name not in self.rules:
            raise PatternError(f"no rule {name}")
        return replace(self, rules={k: v for k, v in self.rules.items() if k != name}, log=(*self.log, (name, None)))

    def __len__(self) -> int:
        return len(self.rules)

    def __contains__(self, name: str) -> bool:
        return name in self.rules

    def get(self, name: str) -> tuple[tuple[str, ...], ...] | None:
        return self.rules.get(name)

    def ends(self) -> dict[tuple[str, ...], list[str]]:
        """The rules that end at each phrase, in the order of its key table; a phrase that nothing ends at any more starts anew."""
        tables: dict[tuple[str, ...], KeyTable] = {}
        held: dict[str, list[tuple[str, ...]]] = {}
        names = {}
        for name, phrases in self.log:
            key = string_id(name, self.symbols)
            names[key] = name
            for p in phrases if phrases is not None else held.pop(name, ()):
                if phrases is not None:
                    tables.setdefault(p, KeyTable()).insert(key)
                    held.setdefault(name, []).append(p)
                else:
                    tables[p].remove(key)
                    if not list(tables[p]):
                        del tables[p]
        return {p: [names[k] for k in t] for p, t in tables.items()}

    def trie(self) -> dict:
        """Nested dictionaries by key; None holds the names that end there, in the key table's order."""
        root: dict = {}
        for phrase, names in self.ends().items():
            node = root
            for k in phrase:
                node = node.setdefault(k, {})
            node[None] = names
        return root

    def matches(self, doc: Mapping, trie: dict | None = None) -> list[tuple[str, int, int]]:
        root = self.trie() if trie is None else trie
        if self.attribute in ("orth", "text", "lower"):
            keys = texts_of(doc["text"] or "", doc["tokens"] or [])
            keys = [k.lower() for k in keys] if self.attribute == "lower" else keys
        else:
            tokens = views(doc, self.lexicon)
            if self.attribute == "morphology":
                for t in tokens:
                    check_document_morph(t["morphology"])
            keys = [key_of(self.attribute, t) for t in tokens]
        out = []
        for start in range(len(keys)):
            node = root
            for end in range(start, len(keys)):
                node = node.get(keys[end])
                if node is None:
                    break
                out += [(name, start, end + 1) for name in node.get(None, ())]
        return out

    def find(self, docs: DataFrame, errors: bool = False) -> DataFrame:
        """doc_id, ord, rule, start, end of every match, by start, then end, then the key table's order."""
        trie = self.trie()
        run = lambda d: [{"doc_id": d["doc_id"], "ord": i, "rule": r, "start": a, "end": b} for i, (r, a, b) in enumerate(self.matches(d, trie))]
        return per_document(docs.select("doc_id", "text", "tokens"), run, "doc_id bigint, ord int, rule string, start int, end int" + (", error string, message string" if errors else ""), errors)


def find_by_join(tokens: DataFrame, phrases: DataFrame, key: str, small: int = 8 << 20, ahead: Sequence[str] = (), look: int = 4) -> DataFrame:
    """doc_id, rule, start, end: phrases (rule, keys) of any length met by equi-joins on keys. `ahead` names the columns that hold
    the keys of the next tokens, null past a document's end; without them a window looks `look` - 1 tokens ahead.

    A phrase is looked up by as many of its keys as a row holds; of a longer one every further key is then joined to the token
    at its place, and the phrase is there if none is missing. Tokens that begin no phrase go first, by the two leading keys
    where all phrases have two, so that a frequent first word alone brings no row along. The phrase side is broadcast only when
    Catalyst's estimate of its size is below `small` bytes."""
    side = phrases.where((F.size("keys") > 0) & ~F.exists("keys", lambda k: k.isNull())).select("rule", "keys").distinct()
    shortest, longest = side.agg(F.min(F.size("keys")), F.max(F.size("keys"))).first()
    if shortest is None:
        return tokens.select("doc_id", F.lit(None).cast("string").alias("rule"), F.col("i").alias("start"), F.col("i").alias("end")).limit(0)
    if not ahead and longest > 1:
        w = Window.partitionBy("doc_id").orderBy("i")
        ahead = [f"__next{k}" for k in range(1, min(look, longest))]
        tokens = tokens.withColumns({c: F.lead(key, k).over(w) for k, c in enumerate(ahead, 1)})
    keys = [key, *ahead][:longest]
    side = side.withColumn("probe", F.slice("keys", 1, len(keys)))
    lead = keys[: min(2, shortest, len(keys))]
    first = side.select(*[F.col("keys")[k].alias(c) for k, c in enumerate(lead)]).distinct()
    lengths = sorted(r[0] for r in side.select(F.size("probe")).distinct().collect())  # numbers up to the columns of keys
    if int(side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= small:
        side, first = F.broadcast(side), F.broadcast(first)
    grams = F.array(*[F.when(F.col(keys[n - 1]).isNotNull(), F.array(*keys[:n])) for n in lengths])
    started = tokens.join(first, lead, "left_semi").select("doc_id", F.col("i").alias("start"), F.explode(F.array_compact(grams)).alias("probe"))
    met = started.join(side, "probe").select("doc_id", "rule", "start", "keys")
    done = met.where(F.size("keys") <= len(keys)).select("doc_id", "rule", "start", (F.col("start") + F.size("keys")).alias("end"))
    if longest <= len(keys):
        return done
    rest = met.where(F.size("keys") > len(keys)).select("doc_id", "rule", "start", (F.col("start") + F.size("keys")).alias("end"), F.posexplode("keys").alias("k", "want"))
    rest = rest.where(F.col("k") >= len(keys)).withColumn("i", F.col("start") + F.col("k"))
    # The token table is never the side that is broadcast, however small its files look.
    there = rest.join(tokens.select("doc_id", "i", F.col(key).alias("want")).hint("merge"), ["doc_id", "i", "want"])
    long = there.groupBy("doc_id", "rule", "start", "end").agg(F.count("*").alias("n")).where(F.col("n") == F.col("end") - F.col("start") - len(keys))
    return done.unionByName(long.drop("n"))


def find_in_rows(docs: DataFrame, phrases: DataFrame, small: int = 8 << 20) -> DataFrame | None:
    """doc_id, rule, start, end: phrases (rule, keys) of any length found in each document's own array (doc_id, keys) by a trie,
    which goes to all workers; None if the dictionary has more than `small` bytes, and find_by_join is the way to go. A null
    key equals none; repeated phrases of a rule count once; empty ones match nothing."""
    side = phrases.where((F.size("keys") > 0) & ~F.exists("keys", lambda k: k.isNull())).select("rule", "keys").distinct()
    weight = F.octet_length("rule") + F.aggregate("keys", F.lit(0), lambda a, k: a + F.octet_length(k) + 16)
    if (side.agg(F.sum(weight)).first()[0] or 0) > small:
        return None
    root: dict = {}
    for r in side.collect():  # up to `small` bytes
        node = root
        for k in r["keys"]:
            node = node.setdefault(k, {})
        node.setdefault(None, []).append(r["rule"])
    shared = docs.sparkSession.sparkContext.broadcast(root)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                doc: list[int] = []
                out: list[tuple[str, int, int]] = []
                for d, keys in enumerate(part.column(1).to_pylist()):
                    keys = keys or []
                    for start, node in enumerate(map(first.get, keys)):
                        end = start
                        while node:
                            end += 1
                            if names := node.get(None):
                                out += [(n, start, end) for n in names]
                            node = node.get(keys[end]) if end < len(keys) and keys[end] is not None else None
                    doc += [d] * (len(out) - len(doc))
                rule, start, end = zip(*out) if out else ((), (), ())
                ids = part.column(0).take(pa.array(doc, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(rule, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "rule", "start", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "keys").mapInArrow(kernel, "doc_id bigint, rule string, start int, end int")
