"""Dependency trees: validation, traversal and the columns that turn tree relations into plain join predicates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DependencyError, InvalidSentenceError, MissingAnnotationError
from .kernels import per_document


def check_heads(heads: Sequence[int | None]) -> None:
    """The first missing or out-of-range head, else the first token on or above a cycle, is an error."""
    for i, h in enumerate(heads):
        if h is None:
            raise DependencyError("missing_head", i)
        if not 0 <= h < len(heads):
            raise DependencyError("head_out_of_bounds", i)
    state = [0] * len(heads)
    for i in range(len(heads)):
        path, at = [], i
        while state[at] == 0:
            state[at] = 1
            path.append(at)
            if heads[at] == at:
                break
            at = heads[at]
            if state[at] == 1:
                raise DependencyError("cycle", i)
        for x in path:
            state[x] = 2


def children_of(heads: Sequence[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in heads]
    for i, h in enumerate(heads):
        if h != i:
            out[h].append(i)
    return out


def ancestors(heads: Sequence[int], token: int) -> list[int]:
    out = []
    while heads[token] != token:
        token = heads[token]
        out.append(token)
    return out


def subtree(heads: Sequence[int], token: int, children: list[list[int]] | None = None) -> list[int]:
    """The subtrees of children to the left, the token, and those to the right; without recursion."""
    children = children_of(heads) if children is None else children
    out, stack = [], [(token, False)]
    while stack:
        t, ready = stack.pop()
        if ready:
            out.append(t)
        else:
            stack += [(c, False) for c in reversed([c for c in children[t] if c > t])]
            stack.append((t, True))
            stack += [(c, False) for c in reversed([c for c in children[t] if c < t])]
    return out


def sentence_of(sentences: Sequence[Mapping] | None, token: int) -> tuple[int, int]:
    if sentences is None:
        raise MissingAnnotationError("no sentences")
    for s in sentences:
        if s["start"] <= token < s["end"]:
            return s["start"], s["end"]
    raise InvalidSentenceError(f"token {token} is in no sentence")


def left_edges(heads: Sequence[int]) -> list[int]:
    """The least token of each token's subtree; tokens on cycles stop at what they have seen."""
    least = list(range(len(heads)))
    for i in range(len(heads)):
        at, seen = i, set()
        while at not in seen:
            seen.add(at)
            least[at] = min(least[at], i)
            if heads[at] == at:
                break
            at = heads[at]
    return least


GRAPH = ("root", "lo", "hi", "entry", "exit", "depth", "degree")


class Forest:
    """The trees of several documents, one after another: a token's number counts over all of them. All columns come from a few
    passes over whole arrays, one for each level of the deepest tree at most."""

    def __init__(self, heads: np.ndarray, sizes: np.ndarray) -> None:
        """heads: of each token within its document; sizes: tokens of each document."""
        n = len(heads)
        self.base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = np.arange(n)
        self.i = own - self.base
        self.head = heads.astype(np.int64) + self.base
        root, depth = self.head.copy(), (self.head != own).astype(np.int64)
        for _ in range(max(1, int(sizes.max(initial=1)).bit_length())):
            depth, root = depth + depth[root], root[root]
        self.root, self.depth = root, depth
        self.child = np.flatnonzero(self.head != own)
        self.child = self.child[np.lexsort((self.child, self.head[self.child]))]
        self.degree = np.bincount(self.head[self.child], minlength=n)
        self.first = np.cumsum(self.degree) - self.degree  # of a token's children in self.child
        level = np.argsort(depth[self.child], kind="stable")
        cuts = np.flatnonzero(np.diff(depth[self.child][level], prepend=-1, append=-1))
        levels = [self.child[level[x:y]] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        size = np.ones(n, dtype=np.int64)
        for members in reversed(levels):
            np.add.at(size, self.head[members], size[members])
        self.size = size
        # A token is entered after its head and the subtrees of its siblings to the left; trees follow each other in a document.
        before = np.cumsum(size[self.child]) - size[self.child]
        offset = np.zeros(n, dtype=np.int64)
        offset[self.child] = 1 + before - np.repeat(before[self.first[self.degree > 0]], self.degree[self.degree > 0])
        roots = np.flatnonzero(self.head == own)
        ahead = np.cumsum(size[roots]) - size[roots]
        entry = np.zeros(n, dtype=np.int64)
        entry[roots] = ahead - self.base[roots]
        for members in levels:
            entry[members] = entry[self.head[members]] + offset[members]
        self.entry = entry
        lo, hi = np.full(n, n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        np.minimum.at(lo, root, own)
        np.maximum.at(hi, root, own + 1)
        self.lo, self.hi = lo[root], hi[root]

    def columns(self) -> dict[str, np.ndarray]:
        """By name, for each token, within its document: its root, the bounds [lo, hi) of its tree, entry and exit of a depth-first
        walk, depth, degree."""
        return {"root": self.root - self.base, "lo": self.lo - self.base, "hi": self.hi - self.base, "entry": self.entry, "exit": self.entry + self.size, "depth": self.depth, "degree": self.degree}

    def above(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the places of tokens, one by one: the place and an ancestor, from the parent to the root."""
        place, at = np.arange(len(tokens)), tokens
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(place):
            up = self.head[at]
            on = up != at
            place, at = place[on], up[on]
            out.append((place, at))
        if not out:
            return place, at
        places, found = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(places, kind="stable")
        return places[order], found[order]

    def related(self, relation: str, left: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `left` and the candidates (a mask over all tokens) that stand in the relation to the token there, in the same
        tree, by place and then token."""
        if relation in ("<<", ">>", ".*", ";*"):
            if relation == "<<":
                place, right = self.above(left)
            else:
                # Descendants follow each other in the walk; what is after or before a token does so in the text.
                key = self.entry + self.base if relation == ">>" else self._tree_order()
                pool = np.flatnonzero(candidates)
                pool = pool[np.argsort(key[pool], kind="stable")]
                keys = key[pool]
                if relation == ">>":
                    lo, hi = key[left] + 1, key[left] + self.size[left]
                elif relation == ".*":
                    lo, hi = key[left] + 1, self._tree_end()[left]
                else:
                    lo, hi = self._tree_end()[left] - self.size[self.root[left]], key[left]
                place, at = _expanded(np.searchsorted(keys, lo), np.searchsorted(keys, hi))
                right = pool[at]
        elif relation[0] == ">":
            place, at = _expanded(self.first[left], self.first[left] + self.degree[left])
            right = self.child[at]
        elif relation[0] == "$":
            up = self.head[left]  # a root is its own head, and so its children are beside it
            place, at = _expanded(self.first[up], self.first[up] + self.degree[up])
            right = self.child[at]
        else:
            place = np.arange(len(left))
            right = self.head[left] if relation[0] == "<" else left + (1 if relation[0] == "." else -1)
            on = (right >= 0) & (right < len(self.head))
            place, right = place[on], right[on]
        l = left[place]  # noqa: E741
        keep = candidates[right] & (self.root[right] == self.root[l]) & (right != l)
        side = relation.lstrip("<>$") if relation[0] in "<>$" and relation not in ("<<", ">>") else ""
        if side:
            keep &= {"+": right == l + 1, "-": right == l - 1, "++": right > l, "--": right < l}[side]
        place, right = place[keep], right[keep]
        order = np.lexsort((right, place))
        return place[order], right[order]

    def _tree_order(self) -> np.ndarray:
        """A number for each token that orders tokens by tree and then by place in the text."""
        order = np.lexsort((np.arange(len(self.root)), self.root))
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.arange(len(order))
        return out

    def _tree_end(self) -> np.ndarray:
        """One past the largest of these numbers in a token's tree."""
        count = np.bincount(self.root, minlength=len(self.root))
        return np.cumsum(count)[self.root]


def _expanded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [lo, hi): the number of its range, and each of its members."""
    n = np.maximum(0, hi - lo)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def forest(heads: Sequence[int | None] | np.ndarray, sizes: np.ndarray) -> Forest:
    """The trees of documents whose heads are all there and lead to roots; else the error of the first document where not."""
    plain = np.array([-1 if h is None else h for h in heads], dtype=np.int64) if not isinstance(heads, np.ndarray) else heads
    ends = np.cumsum(sizes)
    good = bool(((plain >= 0) & (plain < np.repeat(sizes, sizes))).all())
    if good:
        f = Forest(plain, sizes)
        good = bool((f.head[f.root] == f.root).all())
    if not good:
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            check_heads([None if h < 0 and (isinstance(heads, np.ndarray) or heads[a + k] is None) else h for k, h in enumerate(plain[a:b].tolist())])
    return f


def graph_columns(heads: Sequence[int | None]) -> dict[str, list[int]]:
    """By name, for each token of one document, the columns of its trees."""
    return {k: v.tolist() for k, v in forest(list(heads), np.array([len(heads)])).columns().items()}


def graph(heads: Sequence[int | None]) -> list[dict]:
    columns = graph_columns(heads)
    return [dict(zip(GRAPH, row, strict=True)) for row in zip(*columns.values(), strict=True)]


#: Join predicates of the twenty relations between a bound token L and a new one R of the same tree.
RELATIONS: dict[str, str] = {
    "<": "R.i = L.head AND R.i <> L.i", ">": "R.head = L.i AND R.i <> L.i",
    "<<": "R.i <> L.i AND R.entry <= L.entry AND L.entry < R.exit", ">>": "R.i <> L.i AND L.entry <= R.entry AND R.entry < L.exit",
    ".": "R.i = L.i + 1", ".*": "R.i > L.i", ";": "R.i + 1 = L.i", ";*": "R.i < L.i",
    "$+": "R.head = L.head AND R.i <> L.head AND R.i <> R.head AND R.i = L.i + 1", "$-": "R.head = L.head AND R.i <> L.head AND R.i <> R.head AND R.i = L.i - 1",
    "$++": "R.head = L.head AND R.i <> L.head AND R.i <> R.head AND R.i > L.i", "$--": "R.head = L.head AND R.i <> L.head AND R.i <> R.head AND R.i < L.i",
    ">+": "R.head = L.i AND R.i = L.i + 1", ">-": "R.head = L.i AND R.i = L.i - 1", ">++": "R.head = L.i AND R.i > L.i", ">--": "R.head = L.i AND R.i < L.i",
    "<+": "R.i = L.head AND R.i = L.i + 1", "<-": "R.i = L.head AND R.i = L.i - 1", "<++": "R.i = L.head AND R.i > L.i", "<--": "R.i = L.head AND R.i < L.i",
}
RELATION_NAMES = {
    "parent": "<", "child": ">", "ancestor": "<<", "descendant": ">>", "immediately_precedes": ".", "precedes": ".*", "immediately_follows": ";", "follows": ";*",
    "immediate_right_sibling": "$+", "immediate_left_sibling": "$-", "right_sibling": "$++", "left_sibling": "$--", "immediate_right_child": ">+", "immediate_left_child": ">-",
    "right_child": ">++", "left_child": ">--", "immediate_right_parent": "<+", "immediate_left_parent": "<-", "right_parent": "<++", "left_parent": "<--",
}


def forests(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[tuple[pa.Array, pa.StructArray, Forest, np.ndarray]]:
    """For some documents at a time (id, tokens): ids, all their tokens, their trees, and each token's document."""
    for batch in batches:
        lists = batch.column(1)
        sizes = np.asarray(pa.compute.list_value_length(lists).fill_null(0), dtype=np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            part, own = batch.slice(at, stop - at), sizes[at:stop]
            tokens = part.column(1).flatten()
            head = tokens.field("head")
            heads = head.to_pylist() if head.null_count else np.asarray(head, dtype=np.int64)
            yield part.column(0), tokens, forest(heads, own), np.repeat(np.arange(len(own)), own)
            at = stop


def with_graph(docs: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """doc_id, i, head, root, lo, hi, entry, exit, depth, degree for every token, computed in one kernel pass, with the string
    `fields` of the tokens, so that no join is needed to get them back."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, f, doc in forests(batches):
            columns = f.columns()
            ints = [pa.array(x.astype(np.int32)) for x in (f.i, f.head - f.base, *(columns[g] for g in GRAPH))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), *ints, *(tokens.field(x) for x in fields)], ["doc_id", "i", "head", *GRAPH, *fields])

    more = "".join(f", {f} string" for f in fields)
    ddl = "doc_id bigint, i int, head int, " + ", ".join(f"{g} int" for g in GRAPH) + more
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(kernel, ddl)


def ancestor_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, i, level, ancestor: every ancestor of every token, from its parent (level 1) to its root."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, f, doc in forests(batches):
            place, up = f.above(np.arange(len(f.head)))
            level = f.depth[place] - f.depth[up]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[place])), *(pa.array(x.astype(np.int32)) for x in (f.i[place], level, f.i[up]))], ["doc_id", "i", "level", "ancestor"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(kernel, "doc_id bigint, i int, level int, ancestor int")


def related_pairs(docs: DataFrame, relation: str) -> DataFrame:
    """doc_id, l, r: the tokens of a document that stand in the relation, found within its row: no exchange."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, f, doc in forests(batches):
            left = np.arange(len(f.head))
            for at in range(0, len(left), 1 << 14):
                part = left[at : at + (1 << 14)]
                place, right = f.related(relation, part, np.ones(len(f.head), dtype=bool))
                l = part[place]  # noqa: E741
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[l])), pa.array(f.i[l].astype(np.int32)), pa.array(f.i[right].astype(np.int32))], ["doc_id", "l", "r"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(kernel, "doc_id bigint, l int, r int")


def join_relation(left: DataFrame, right: DataFrame, relation: str) -> DataFrame:
    """Pairs of tokens under a relation: an equi-join on document and tree, with the relation as the rest of the condition."""
    condition = F.expr("L.doc_id = R.doc_id AND L.root = R.root AND " + RELATIONS[relation])
    return left.alias("L").join(right.alias("R"), condition)


def children(tokens: DataFrame) -> DataFrame:
    return tokens.where("i <> head").groupBy("doc_id", F.col("head").alias("i")).agg(F.array_sort(F.collect_list("i")).alias("children"))


def traversal(docs: DataFrame, errors: bool = False) -> DataFrame:
    """doc_id, i, children, ancestors (parent to root), subtree (left, self, right) and sentence of every token."""

    def run(d: dict) -> list[dict]:
        heads = [t["head"] for t in d["tokens"] or []]
        check_heads(heads)
        kids = children_of(heads)
        out = []
        for i in range(len(heads)):
            s = sentence_of(d["sentences"], i) if d["sentences"] is not None else (None, None)
            out.append({"doc_id": d["doc_id"], "i": i, "children": kids[i], "ancestors": ancestors(heads, i), "subtree": subtree(heads, i, kids), "sentence_start": s[0], "sentence_end": s[1]})
        return out

    ddl = "doc_id bigint, i int, children array<int>, ancestors array<int>, subtree array<int>, sentence_start int, sentence_end int"
    return per_document(docs.select("doc_id", "tokens", "sentences"), run, ddl + (", error string, message string" if errors else ""), errors)
