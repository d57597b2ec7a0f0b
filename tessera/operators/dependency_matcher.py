"""Dependency patterns: several token aliases of one tree, joined by relations."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PatternError
from ..functions.lexical import FLAGS, Lexicon
from ..plans.predicates import Constraint, all_of, check_document, columns_of, parsed, token_column
from .kernels import per_document, views
from .trees import RELATION_NAMES, RELATIONS, Forest, forests, graph


@dataclass(frozen=True)
class Node:
    id: str
    constraints: tuple[Constraint, ...]
    left: str | None = None
    relation: str | None = None


def pattern_of(spec: Mapping | Sequence) -> tuple[Node, ...]:
    """The first node has no link, every other one links to a node before it; ids are unique."""
    nodes: list[Node] = []
    for x in spec["nodes"] if isinstance(spec, Mapping) else spec:
        link = x.get("link")
        relation = RELATION_NAMES.get(link["relation"], link["relation"]) if link else None
        if bool(nodes) != bool(link) or link and link["left"] not in {n.id for n in nodes} or any(n.id == x["id"] for n in nodes):
            raise PatternError(f"node {x['id']} must have its own id and, unless it is the first, link to an earlier node")
        if link and relation not in RELATIONS:
            raise PatternError(f"unknown relation {relation}")
        nodes.append(Node(x["id"], parsed(x.get("constraints", ())), link["left"] if link else None, relation))
    if not nodes:
        raise PatternError("a pattern has at least one node")
    return tuple(nodes)


def related(relation: str, left: Mapping, right: Mapping) -> bool:
    """Whether the tokens (their index, head and graph columns) stand in the relation."""
    a, b = left["i"], right["i"]
    kind, side = relation.rstrip("+-"), relation.lstrip("<>$")
    if relation in ("<<", ">>"):
        up, down = (right, left) if relation == "<<" else (left, right)
        return a != b and up["entry"] <= down["entry"] < up["exit"]
    if relation[0] in ".;":
        gap = b - a if relation[0] == "." else a - b
        return gap >= 1 if relation[1:] else gap == 1
    near = {"": a != b, "+": b == a + 1, "-": b == a - 1, "++": b > a, "--": b < a}[side]
    if kind == "<":
        return near and b == left["head"]
    if kind == ">":
        return near and right["head"] == a
    return near and right["head"] == left["head"] and b != left["head"]


@dataclass(frozen=True)
class DependencyMatcher:
    lexicon: Lexicon | None = None
    rules: Mapping[str, tuple[tuple[Node, ...], ...]] = field(default_factory=dict)

    def add(self, name: str, patterns: Sequence) -> DependencyMatcher:
        new = tuple(pattern_of(p) for p in patterns)
        if self.lexicon is None and any(c.attribute in FLAGS for p in new for n in p for c in n.constraints):
            raise PatternError("flags need a matcher with a lexicon")
        return replace(self, rules={**self.rules, name: self.rules.get(name, ()) + new})

    def remove(self, name: str) -> DependencyMatcher:
        if name not in self.rules:
            raise PatternError(f"no rule {name}")
        return replace(self, rules={k: v for k, v in self.rules.items() if k != name})

    def __len__(self) -> int:
        return len(self.rules)

    def __contains__(self, name: str) -> bool:
        return name in self.rules

    def get(self, name: str) -> tuple[tuple[Node, ...], ...] | None:
        return self.rules.get(name)

    def matches(self, doc: Mapping) -> list[tuple[str, list[int]]]:
        """(rule, tokens in the order of the pattern's nodes): by rule, pattern, tree (by its first candidate), then tokens."""
        if not self.rules:
            return []
        tokens = views(doc, self.lexicon)
        check_document([c for r in self.rules.values() for p in r for n in p for c in n.constraints], tokens)
        for i, (t, g) in enumerate(zip(tokens, graph([t["head"] for t in tokens]), strict=True)):
            t.update(g, i=i)
        out: list[tuple[str, list[int]]] = []
        for name, patterns in self.rules.items():
            for nodes in patterns:
                tests = [all_of(n.constraints) for n in nodes]
                at = {n.id: k for k, n in enumerate(nodes)}
                by_tree: dict[int, list[list[Mapping]]] = {}
                for t in tokens:
                    for k, test in enumerate(tests):
                        if test(t):
                            by_tree.setdefault(t["root"], [[] for _ in nodes])[k].append(t)
                for candidates in by_tree.values():
                    bound = [[t] for t in candidates[0]]
                    for k in range(1, len(nodes)):
                        left = at[nodes[k].left]
                        bound = [[*b, t] for b in bound for t in candidates[k] if related(nodes[k].relation, b[left], t)]
                    out += [(name, [t["i"] for t in b]) for b in bound]
        return out

    def find(self, docs: DataFrame, errors: bool = False) -> DataFrame:
        """doc_id, ord, rule, tokens of every match."""
        run = lambda d: [{"doc_id": d["doc_id"], "ord": i, "rule": r, "tokens": t} for i, (r, t) in enumerate(self.matches(d))]
        return per_document(docs.select("doc_id", "text", "tokens"), run, "doc_id bigint, ord int, rule string, tokens array<int>" + (", error string, message string" if errors else ""), errors)


def find_by_join(graph_tokens: DataFrame, spec: Mapping | Sequence, lexicon: Lexicon = Lexicon()) -> DataFrame:  # noqa: B008
    """doc_id, tokens: the pattern as a chain of equi-joins on document and tree over the token table with graph columns
    (doc_id, i, text, head, root, entry, exit); constraints are pushed below the joins. Duplicates are kept."""
    nodes = pattern_of(spec)
    cols = ["i", "head", "entry", "exit"]
    out = None
    for n in nodes:
        side = graph_tokens.where(columns_of(n.constraints, lexicon=lexicon)).select("doc_id", "root", *[F.col(c).alias(f"{n.id}__{c}") for c in cols])
        if out is None:
            out = side
            continue
        condition = RELATIONS[n.relation].replace("L.", f"{n.left}__").replace("R.", f"{n.id}__")
        out = out.join(side, ["doc_id", "root"]).where(condition)
    return out.select("doc_id", F.array(*[f"{n.id}__i" for n in nodes]).alias("tokens"))


def find_in_rows(docs: DataFrame, spec: Mapping | Sequence, lexicon: Lexicon = Lexicon(), most: int = 1 << 16) -> DataFrame:  # noqa: B008
    """find_by_join within a document's own row: its trees are worked out once, and nothing is exchanged. Constraints over texts are
    expressions beside the tokens; aliases are bound one after another over arrays, `most` bound rows at a time. docs: doc_id,
    tokens (array of structs with text, head and the attributes of the constraints)."""
    nodes = pattern_of(spec)
    at = {n.id: k for k, n in enumerate(nodes)}

    def tested(t: F.Column) -> F.Column:
        return F.struct(t["head"].alias("head"), *[F.coalesce(token_column(n.constraints, t, lexicon), F.lit(False)).alias(f"t{k}") for k, n in enumerate(nodes)])

    def bound(f: Forest, masks: list[np.ndarray], rows: np.ndarray, k: int) -> Iterator[np.ndarray]:
        if k == len(nodes):
            yield rows
            return
        for x in range(0, max(1, len(rows)), most):
            part = rows[x : x + most]
            place, right = f.related(nodes[k].relation, part[:, at[nodes[k].left]], masks[k])
            yield from bound(f, masks, np.hstack([part[place], right[:, None]]), k + 1)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, f, doc in forests(batches):
            masks = [np.asarray(tokens.field(f"t{k}")) for k in range(len(nodes))]
            for rows in bound(f, masks, np.flatnonzero(masks[0])[:, None], 1):
                if len(rows):
                    ends = np.arange(0, rows.size + 1, len(nodes), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[rows[:, 0]])), pa.ListArray.from_arrays(pa.array(ends), pa.array(f.i[rows].reshape(-1).astype(np.int32)))], ["doc_id", "tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform("tokens", tested).alias("tokens"))
    return slim.mapInArrow(kernel, "doc_id bigint, tokens array<int>")
