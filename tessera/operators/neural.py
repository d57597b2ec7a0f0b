"""Neural stages over supplied tensors: hash embeddings, a window encoder, a tagger, and greedy transition parsing of
dependencies and entities. Arrays are float32; parity with trained models needs their weights, which are not here."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import ModelError
from ..functions.hashing import string_id, string_ids, table_keys
from ..functions.lexical import shape
from ..schema import DOC, DOC_DDL
from .annotators import sentences_of
from .batches import SCHEMA, Batch, Coded, distinct, list_sizes, lists_of, ranges, spans_of, stepped
from .entities import with_tags
from .kernels import per_document, texts_of

Array = np.ndarray


def feature_ids(texts: Sequence[str], norms: Sequence[str], symbols: Mapping[str, int] | None = None) -> Array:
    """Unsigned ids of norm, first character, last three characters and shape, one row a token."""
    columns = (norms, [t[:1] for t in texts], [t[-3:] for t in texts], list(map(shape, texts)))
    out = np.zeros((len(texts), 4), dtype=np.uint64)
    for k, column in enumerate(columns):
        number = {x: i for i, x in enumerate(dict.fromkeys(column))}
        out[:, k] = string_ids(list(number), symbols)[np.fromiter(map(number.__getitem__, column), dtype=np.int64, count=len(texts))]
    return out


FEATURES: dict[str, Callable[[str, str, bool], str | int]] = {
    "norm": lambda t, n, s: n, "prefix": lambda t, n, s: t[:1], "suffix": lambda t, n, s: t[-3:], "shape": lambda t, n, s: shape(t), "spacy": lambda t, n, s: int(s), "is_space": lambda t, n, s: int(t.isspace()),
}


def named_features(names: Sequence[str], texts: Sequence[str], norms: Sequence[str], blanks: Sequence[bool], symbols: Mapping[str, int] | None = None) -> Array:
    """Unsigned ids of the features of these names, one row a token: strings by their id, flags as they are. blanks: whether a
    blank follows the token."""
    rows = [[string_id(x, symbols) if isinstance(x := FEATURES[f.lower()](t, n, s), str) else x for f in names] for t, n, s in zip(texts, norms, blanks, strict=True)]
    return np.array(rows, dtype=np.uint64).reshape(-1, len(names))


def hash_embed(ids: Array, tables: Sequence[Array], seeds: Sequence[int]) -> Array:
    """Each feature's four table rows summed, features side by side."""
    return np.hstack([t[table_keys(ids[:, k], s).astype(np.int64) % len(t)].sum(axis=1) for k, (t, s) in enumerate(zip(tables, seeds, strict=True))])


def maxout(x: Array, w: Array, b: Array) -> Array:
    """w: (out, pieces, in); the best piece of each output."""
    out, pieces, width = w.shape
    return (x @ w.reshape(out * pieces, width).T + b.reshape(-1)).reshape(len(x), out, pieces).max(axis=2)


def layer_norm(x: Array, gain: Array, bias: Array) -> Array:
    centred = x - x.mean(axis=1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + np.float32(1e-8)) * gain + bias


@dataclass(frozen=True)
class EncoderLayer:
    w: Array
    b: Array
    gain: Array
    bias: Array
    window: int = 1


def encode(x: Array, layers: Sequence[EncoderLayer]) -> Array:
    """Residual blocks over windows of neighbours. Rows beyond the ends start at nought and go through the blocks as well."""
    pad = sum(layer.window for layer in layers)
    x = np.vstack([np.zeros((pad, x.shape[1]), x.dtype), x, np.zeros((pad, x.shape[1]), x.dtype)])
    for layer in layers:
        k = layer.window
        wide = np.vstack([np.zeros((k, x.shape[1]), x.dtype), x, np.zeros((k, x.shape[1]), x.dtype)])
        seen = np.hstack([wide[i : i + len(x)] for i in range(2 * k + 1)])
        x = x + layer_norm(maxout(seen, layer.w, layer.b), layer.gain, layer.bias)
    return x[pad : len(x) - pad]


def best_labels(x: Array, w: Array, b: Array) -> Array:
    """The number of the best label of each row; the first of equals."""
    scores = x @ w.T + b
    if not np.isfinite(scores).all():
        raise ModelError("a score is not finite")
    return scores.argmax(axis=1)


def tag(x: Array, w: Array, b: Array, labels: Sequence[str]) -> list[str]:
    return [labels[i] for i in best_labels(x, w, b)]


@dataclass(frozen=True)
class Scorer:
    """Scores of actions from context rows: each slot's lower layer is worked out once a token, with a learned row for none."""

    lower: Array  # (slots, hidden, pieces, width)
    pad: Array  # (slots, hidden, pieces)
    bias: Array  # (hidden, pieces)
    upper: Array  # (actions, hidden)
    upper_bias: Array
    reduce: Array | None = None  # (width, input)
    reduce_bias: Array | None = None

    def prepared(self, x: Array) -> Array:
        slots, hidden, pieces, width = self.lower.shape
        x = x if self.reduce is None else x @ self.reduce.T + self.reduce_bias
        rows = (x @ self.lower.reshape(-1, width).T).reshape(len(x), slots, hidden, pieces)
        return np.concatenate([rows, self.pad[None]])

    def __call__(self, rows: Array, context: Sequence[int]) -> Array:
        hidden = self.bias + sum(rows[c if c >= 0 else len(rows) - 1, k] for k, c in enumerate(context))
        return self.upper @ hidden.max(axis=1) + self.upper_bias


def _best(scores: Array, valid: Sequence[bool]) -> int:
    """The best valid action, the first of equals."""
    if not np.isfinite(scores).all():
        raise ModelError("a score is not finite")
    if not any(valid):
        raise ModelError("no action is valid")
    return int(np.where(valid, scores, -np.inf).argmax())


class Arcs:
    """A parse under way: a stack, the tokens that wait (those put back before the unread ones), and the arcs so far."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.stack: list[int] = []
        self.waiting: list[int] = list(range(n - 1, -1, -1))  # the next one last
        self.back: set[int] = set()  # put back and not yet given a child from the stack
        self.starts: set[int] = {0} if n else set()
        self.head: dict[int, int] = {}
        self.label = ["ROOT"] * n
        self.children: dict[tuple[int, bool], list[int]] = {}  # by head and whether to its left, in the order of their arcs

    def next(self, k: int = 0) -> int | None:
        return self.waiting[-1 - k] if k < len(self.waiting) else None

    def top(self, k: int = 0) -> int | None:
        return self.stack[-1 - k] if k < len(self.stack) else None

    def newest(self, head: int | None, left: bool) -> int | None:
        kids = self.children.get((head, left)) if head is not None else None
        return kids[-1] if kids else None

    def context(self) -> list[int]:
        b, s = self.next(), self.top()
        slots = (b, self.next(1), s, self.top(1), self.top(2), self.newest(b, True), self.newest(s, True), self.newest(s, False))
        return [-1 if x is None else x for x in slots]

    def valid(self, kind: str) -> bool:
        b, after, s = self.next(), self.next(1), self.top()
        if kind == "S":
            return s is None or after is not None and b not in self.starts and b not in self.back
        if kind == "D":
            return s is not None
        if kind == "B":
            return after is not None and after == b + 1 and after not in self.starts
        return kind in "LR" and s is not None and b is not None and b not in self.starts

    def attach(self, child: int, head: int, label: str) -> None:
        if child in self.head:
            old = self.head[child]
            self.children[old, child < old].remove(child)
        self.head[child], self.label[child] = head, label
        self.children.setdefault((head, child < head), []).append(child)

    def take(self, kind: str, label: str) -> None:
        if kind == "B":
            self.starts.add(self.next(1))
        elif kind == "S":
            self.stack.append(self.waiting.pop())
        elif kind == "D":
            v = self.stack.pop()
            if v not in self.head and self.stack:  # without a head it waits again
                self.waiting.append(v)
                self.back.add(v)
        elif kind == "L":
            self.attach(self.stack.pop(), self.next(), label)
            self.back.discard(self.next())
        else:
            self.attach(self.next(), self.top(), label)
            self.stack.append(self.waiting.pop())


def parse(x: Array, scorer: Scorer, actions: Sequence[str]) -> tuple[list[int], list[str], list[int]]:
    """Greedy arc-eager parsing that may put a token without a head back: actions S, D, L-label, R-label and B (the token after
    the next one starts a sentence). Heads, labels, starts."""
    state, rows = Arcs(len(x)), scorer.prepared(x)
    kinds = [a.partition("-")[::2] for a in actions]
    left = 4 * state.n * (state.n + 10)
    while state.stack or state.waiting:
        if not left:
            raise ModelError("too many transitions")
        left -= 1
        best = _best(scorer(rows, state.context()[: scorer.lower.shape[0]]), [state.valid(k) for k, _ in kinds])
        state.take(*kinds[best])
    return [state.head.get(i, i) for i in range(state.n)], state.label, sorted(state.starts)


class ArcsOfBatch:
    """Parses under way of many documents in step, by the rules of Arcs. Tokens are numbered over all documents; one more, the last
    number, stands for none. Stacks and waiting tokens are stretches of arrays, children are linked lists by head and side."""

    def __init__(self, sizes: Array) -> None:
        n = self.none = int(sizes.sum())
        self.first = np.cumsum(sizes) - sizes
        self.end = self.first + sizes
        full = lambda v, shape, t=np.int64: np.full(shape, v, dtype=t)
        self.stack, self.depth = full(n, n + 1), self.first.copy()  # the end of each document's stretch
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.waiting = np.append((self.first + self.end - 1)[doc] - np.arange(n), n)
        self.left = self.end.copy()
        self.back, self.starts = full(False, n + 1, bool), full(False, n + 1, bool)
        self.starts[self.first[sizes > 0]] = True
        self.starts[n] = True
        self.head, self.label = full(-1, n + 1), full(-1, n + 1)
        self.newest = full(n, (2, n + 1))  # by side (1 to the left of the head) and head
        self.older, self.younger = full(n, n + 1), full(n, n + 1)

    def at(self, array: Array, top: Array, low: Array, k: int) -> Array:
        """The k-th from the end of a stretch, or none."""
        i = top - 1 - k
        return np.where(i >= low, array[i], self.none)

    def attach(self, child: Array, head: Array, label: Array) -> None:
        none = self.none
        again = self.head[child] >= 0
        if again.any():
            c = child[again]
            old, older, younger = self.head[c], self.older[c], self.younger[c]
            side = (c < old).astype(np.int64)
            last = younger == none
            self.newest[side[last], old[last]] = older[last]
            self.older[younger[~last]] = older[~last]
            has = older != none
            self.younger[older[has]] = younger[has]
        side = (child < head).astype(np.int64)
        before = self.newest[side, head]
        self.older[child], self.younger[child] = before, none
        has = before != none
        self.younger[before[has]] = child[has]
        self.newest[side, head] = child
        self.head[child], self.label[child] = head, label


def parse_batch(xs: Sequence[Array], scorer: Scorer, actions: Sequence[str]) -> tuple[Array, Array, Array]:
    """parse() of many documents in step: heads (places in their documents), numbers of the actions that gave the labels (-1 for
    ROOT) and whether a sentence starts, for all tokens of all documents."""
    order = sorted(range(len(xs)), key=lambda k: -len(xs[k]))
    sizes = np.array([len(xs[k]) for k in order], dtype=np.int64)
    state, slots = ArcsOfBatch(sizes), scorer.lower.shape[0]
    none, first, end = state.none, state.first, state.end
    rows = np.concatenate([*(scorer.prepared(xs[k])[:-1] for k in order if len(xs[k])), scorer.pad[None]])
    kinds = [a.partition("-")[0] for a in actions]
    kind_of = np.array(["SDBLR".find(k) if len(k) == 1 else -1 for k in kinds], dtype=np.int64)
    steps = 4 * sizes * (sizes + 10)
    live = np.flatnonzero(sizes > 0)
    done = 0
    while len(live):
        if (steps[live] <= done).any():
            raise ModelError("too many transitions")
        done += 1
        low, depth, left = first[live], state.depth[live], state.left[live]
        b, after, s = state.at(state.waiting, left, low, 0), state.at(state.waiting, left, low, 1), state.at(state.stack, depth, low, 0)
        getters = (lambda: b, lambda: after, lambda: s, lambda: state.at(state.stack, depth, low, 1), lambda: state.at(state.stack, depth, low, 2),
                   lambda: state.newest[1, b], lambda: state.newest[1, s], lambda: state.newest[0, s])  # fmt: skip  # noqa: B023
        hidden = 0
        for k in range(min(slots, len(getters))):
            hidden = hidden + rows[getters[k](), k]
        hidden = (scorer.bias + hidden).max(axis=2)
        scores = np.matmul(scorer.upper, hidden[:, :, None])[:, :, 0] + scorer.upper_bias
        if not np.isfinite(scores).all():
            raise ModelError("a score is not finite")
        no_s, no_b, more = s == none, b == none, after != none
        free = ~state.starts[b]  # none counts as a start
        allowed = np.zeros((6, len(live)), dtype=bool)  # the last one for unknown kinds
        allowed[0] = no_s & ~no_b | ~no_s & more & free & ~state.back[b]
        allowed[1] = ~no_s
        allowed[2] = more & (after == b + 1) & ~state.starts[after]
        allowed[3] = allowed[4] = ~no_s & free
        valid = allowed[kind_of].T
        if not valid.any(axis=1).all():
            raise ModelError("no action is valid")
        best = np.where(valid, scores, -np.inf).argmax(axis=1)
        kind = kind_of[best]

        x = kind == 2
        if x.any():
            state.starts[after[x]] = True
        x = kind == 1
        if x.any():
            d, v = live[x], s[x]
            state.depth[d] -= 1
            again = (state.head[v] < 0) & (state.depth[d] > first[d])  # without a head it waits again
            if again.any():
                d, v = d[again], v[again]
                state.waiting[state.left[d]] = v
                state.left[d] += 1
                state.back[v] = True
        x = kind == 3
        if x.any():
            state.depth[live[x]] -= 1
            state.attach(s[x], b[x], best[x])
            state.back[b[x]] = False
        x = kind == 4
        if x.any():
            state.attach(b[x], s[x], best[x])
        x = (kind == 0) | (kind == 4)
        if x.any():
            d = live[x]
            state.left[d] -= 1
            state.stack[state.depth[d]] = b[x]
            state.depth[d] += 1
        over = (state.depth[live] == first[live]) & (state.left[live] == first[live])
        if over.any():
            live = live[~over]
    # Back to the order and the places of the documents.
    place = np.empty(len(xs), dtype=np.int64)
    place[order] = np.arange(len(xs))
    own = np.array([len(x) for x in xs], dtype=np.int64)
    _, at = ranges(first[place], own) if len(xs) else (None, np.zeros(0, np.int64))
    base = np.repeat(first[place], own) if len(xs) else at
    heads = np.where(state.head[at] >= 0, state.head[at], at) - base
    return heads, state.label[at], state.starts[at]


def deprojectivize(heads: Sequence[int], labels: Sequence[str], spaces: Sequence[bool]) -> tuple[list[int], list[str]]:
    """A label `dep||head label` moves its token to the first token below its head, breadth first, with that label; white space is
    passed over, and so is the token itself."""
    heads, labels = list(heads), list(labels)
    for i in range(len(heads)):
        dep, bar, wanted = labels[i].partition("||")
        if not bar:
            continue
        seen, level, found = set(), [heads[i]], None
        while level and found is None:
            fresh = [h for h in dict.fromkeys(level) if h not in seen]
            seen.update(fresh)
            level = [c for h in fresh for c, up in enumerate(heads) if up == h and c not in (h, i) and not spaces[c]]
            found = next((c for c in level if labels[c] == wanted), None)
        heads[i] = heads[i] if found is None else found
        labels[i] = dep
    return heads, labels


def recognise(x: Array, scorer: Scorer, actions: Sequence[str], sentence_starts: Sequence[int] = (), spaces: Sequence[bool] | None = None) -> list[tuple[str, str]]:
    """Greedy entity tagging with actions B-, I-, L-, U- and a label, and O: (iob, type) of each token; L gives I, U gives B. An
    entity ends with its sentence and doesn't begin at white space."""
    n, rows = len(x), scorer.prepared(x)
    kinds = [a.partition("-")[::2] for a in actions]
    ends = {s - 1 for s in sentence_starts} | {n - 1}
    out: list[tuple[str, str]] = []
    begin, held = -1, None  # the open entity's first token and label
    for i in range(n):
        goes_on, blank = i not in ends, bool(spaces and spaces[i])
        rules = {
            "B": lambda label: held is None and goes_on and not blank and label != "",  # noqa: B023
            "I": lambda label: held == label and goes_on,  # noqa: B023
            "L": lambda label: held == label,  # noqa: B023
            "U": lambda label: held is None and not blank and label != "",  # noqa: B023
            "O": lambda label: held is None,  # noqa: B023
        }
        context = [i, begin, i - 1 if held is not None else -1]
        kind, label = kinds[_best(scorer(rows, context[: scorer.lower.shape[0]]), [k in rules and rules[k](v) for k, v in kinds])]
        out.append(("O" if kind == "O" else "B" if kind in "BU" else "I", label))
        if kind == "B":
            begin, held = i, label
        elif kind != "I":
            begin, held = -1, None
    return out


# ---- stages over documents -----------------------------------------------------------------------------------------


def _staged(docs: DataFrame, f: Callable[[dict, Array, list[str]], dict]) -> DataFrame:
    """docs after f, which gets a document, its tensor and its token texts."""

    def run(d: dict) -> list[dict]:
        tokens = d["tokens"] or []
        tensor = np.array(d["tensor"] or [], dtype=np.float32).reshape(len(tokens), -1) if tokens else np.zeros((0, 1), dtype=np.float32)
        return [f(d, tensor, texts_of(d["text"] or "", tokens))]

    return per_document(docs.select(*DOC), run, DOC_DDL)


def _norms(batch: Batch) -> tuple[Coded, Coded]:
    """Texts and norms of all tokens; a missing norm is the lower-case text."""
    texts, norms = Coded.of(batch.words), Coded.of(batch.fields["norm"])
    lacks = np.flatnonzero((norms.codes < 0) | (norms.codes == norms.code("")))
    if len(lacks):
        lower = np.array([norms.code(t.lower()) for t in texts.values], dtype=np.int64)
        norms.codes[lacks] = lower[texts.codes[lacks]]
    return texts, norms


def _with_tensor(batch: Batch, x: Array) -> Batch:
    flat = lists_of(np.full(len(x), x.shape[1]), pa.array(np.ascontiguousarray(x, dtype=np.float32).reshape(-1)))
    return batch.changed({"tensor": lists_of(batch.sizes, flat)})


def _tensor(batch: Batch) -> Array | None:
    """The tensor's rows of all tokens; None where they aren't one row of one width for each."""
    lists = batch.columns["tensor"]
    rows = lists.flatten()
    width = list_sizes(rows)
    if not np.array_equal(list_sizes(lists), batch.sizes) or len(set(width.tolist())) != 1 or rows.null_count or rows.flatten().null_count:
        return None
    return np.asarray(rows.flatten(), dtype=np.float32).reshape(len(rows), -1)


def tok2vec_stage(tables: Sequence[Array], seeds: Sequence[int], layers: Sequence[EncoderLayer] = (), symbols: Mapping[str, int] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Fills the tensor: embedded features of every token, encoded in their windows. A distinct token is embedded once."""

    def step(batch: Batch) -> Batch:
        texts, norms = _norms(batch)
        at, number = distinct(texts, norms)
        ids = feature_ids([texts.values[k] for k in texts.codes[at].tolist()], [norms.values[k] for k in norms.codes[at].tolist()], symbols)
        x = hash_embed(ids, tables, seeds).astype(np.float32)[number]
        if layers and len(x):
            x = np.vstack([encode(x[a : a + n], layers) for a, n in zip(batch.first.tolist(), batch.sizes.tolist()) if n])
        return _with_tensor(batch, x)

    return lambda docs: stepped(docs, step)


#: Token texts, norms and whether a blank follows, to a row for each token.
Encoded = Callable[[Sequence[str], Sequence[str], Sequence[bool]], Array]


def _encoded(d: dict, texts: list[str], f: Encoded) -> Array:
    return f(texts, [t["norm"] or s.lower() for t, s in zip(d["tokens"], texts, strict=True)], [bool(t["whitespace"]) for t in d["tokens"]])


def encoder_stage(encoded: Encoded) -> Callable[[DataFrame], DataFrame]:
    """Fills the tensor by a function of the tokens."""
    return lambda docs: _staged(docs, lambda d, _, texts: dict(d, tensor=_encoded(d, texts, encoded).tolist() if texts else []))


def tagger_stage(w: Array, b: Array, labels: Sequence[str], field: str = "tag") -> Callable[[DataFrame], DataFrame]:
    """Sets the field of every token to its best label."""
    names = pa.array(list(labels), pa.string())

    def step(batch: Batch) -> Batch:
        x = _tensor(batch)
        if x is None:  # of each document by itself
            parts = [np.array(t or [], dtype=np.float32).reshape(n, -1) for t, n in zip(batch.columns["tensor"].to_pylist(), batch.sizes.tolist()) if n]
            best = [best_labels(p, w, b) for p in parts]
        else:
            best = [best_labels(x, w, b)]
        return batch.changed(fields={field: names.take(pa.array(np.concatenate([np.zeros(0, np.int64), *best])))})

    return lambda docs: stepped(docs, step)


def sentences_of_batch(heads: Array, sizes: Array) -> tuple[Array, pa.Array]:
    """sentences_of for heads (places in their documents) of many documents: whether a sentence starts at each token, and the
    spans. A token's root is found by doubling the way to it."""
    first, n = np.cumsum(sizes) - sizes, len(heads)
    of = np.repeat(np.arange(len(sizes)), sizes)
    root = head = heads + first[of]
    for _ in range(int(sizes.max(initial=1)).bit_length()):
        root = root[root]
    if not np.array_equal(head[root], root):  # a cycle, which is an error of its document
        for a, size in zip(first.tolist(), sizes.tolist()):
            sentences_of(heads[a : a + size].tolist())
    # The first token of each tree, the trees in the order of their roots.
    _, starts = np.unique(root, return_index=True)
    begins = np.zeros(n, dtype=bool)
    begins[starts] = True
    starts = np.flatnonzero(begins)
    doc = of[starts]
    ends = np.append(starts[1:], n)
    blank = pa.repeat(pa.scalar("", pa.string()), len(starts))
    return begins, spans_of(doc, len(sizes), starts - first[doc], ends - first[doc], blank, pa.nulls(len(starts), pa.string()))


def _rows_by_document(batch: Batch) -> list[Array]:
    x, sizes = _tensor(batch), batch.sizes.tolist()
    if x is None:
        return [np.array(t or [], dtype=np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32) for t, n in zip(batch.columns["tensor"].to_pylist(), sizes)]
    return [x[a : a + n] for a, n in zip(batch.first.tolist(), sizes)]


def parser_stage(scorer: Scorer, actions: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Sets heads, labels and sentences."""
    names = [*(a.partition("-")[2] for a in actions), "ROOT"]

    def step(batch: Batch) -> Batch:
        heads, numbers, _ = parse_batch(_rows_by_document(batch), scorer, actions)
        numbers = np.where(numbers < 0, len(actions), numbers)
        if any("||" in names[k] for k in np.unique(numbers).tolist()):
            return _projected(batch, heads, [names[k] for k in numbers.tolist()])
        begins, spans = sentences_of_batch(heads, batch.sizes)
        return batch.changed({"sentences": spans}, {"head": pa.array(heads.astype(np.int32)), "dep": pa.array(names, pa.string()).take(pa.array(numbers)), "sentence_start": pa.array(begins)})

    step.most = most_parsed(scorer)
    return lambda docs: stepped(docs, step)


def _projected(batch: Batch, heads: Array, labels: list[str]) -> Batch:
    """The batch with heads and labels after deprojectivize(), document by document."""
    words, spans, all_heads, all_labels, begins = batch.words.to_pylist(), [], [], [], []
    for a, n in zip(batch.first.tolist(), batch.sizes.tolist()):
        own, named = heads[a : a + n].tolist(), labels[a : a + n]
        if any("||" in v for v in named):
            own, named = deprojectivize(own, named, [s.isspace() for s in words[a : a + n]])
        spans.append(sentences_of(own))
        at = {s["start"] for s in spans[-1]}
        all_heads += own
        all_labels += named
        begins += [i in at for i in range(n)]
    fields = {"head": pa.array(all_heads, pa.int32()), "dep": pa.array(all_labels, pa.string()), "sentence_start": pa.array(begins, pa.bool_())}
    return batch.changed({"sentences": pa.array(spans, SCHEMA.field("sentences").type)}, fields)


#: Bytes of a batch's context rows and states in parse_batch, and of a token's state alone.
PARSED, STATE = 1 << 27, 250


def most_parsed(scorer: Scorer) -> int:
    """How many tokens parse_batch gets at once: many, since its steps are as many as those of the longest document."""
    return PARSED // (STATE + 4 * int(np.prod(scorer.lower.shape[:3])))


def arcs_stage(scorer: Scorer, actions: Sequence[str], rows: Callable[[Batch], Array]) -> Callable[[DataFrame], DataFrame]:
    """Sets heads and labels alone, from the rows of all tokens."""
    names = pa.array([*(a.partition("-")[2] for a in actions), "ROOT"], pa.string())

    def step(batch: Batch) -> Batch:
        x = rows(batch)
        heads, labels, _ = parse_batch([x[a : a + n] for a, n in zip(batch.first.tolist(), batch.sizes.tolist())], scorer, actions)
        return batch.changed(fields={"head": pa.array(heads.astype(np.int32)), "dep": names.take(pa.array(np.where(labels < 0, len(actions), labels)))})

    step.most = most_parsed(scorer)
    return lambda docs: stepped(docs, step)


def ner_stage(scorer: Scorer, actions: Sequence[str], encoded: Encoded | None = None) -> Callable[[DataFrame], DataFrame]:
    """Sets the entity tags and the entities, from the tensor or an encoding of its own; entities end with their sentence."""

    def one(d: dict, x: Array, texts: list[str]) -> dict:
        if encoded is not None and texts:
            x = _encoded(d, texts, encoded)
        starts = [s["start"] for s in d["sentences"] or []]
        tags = recognise(x, scorer, actions, starts, [s.isspace() for s in texts]) if texts else []
        return with_tags(d, [(iob, kind, None) for iob, kind in tags])

    return lambda docs: _staged(docs, one)


def check_tensors(encoder: Sequence[EncoderLayer], width: int) -> None:
    """Widths up to 4096, windows up to 16, at least two pieces, and shapes that fit together."""
    if not 1 <= width <= 4096:
        raise ModelError("width")
    for k, e in enumerate(encoder):
        if not 1 <= e.window <= 16 or e.w.ndim != 3 or e.w.shape[1] < 2 or e.w.shape != (width, e.w.shape[1], width * (2 * e.window + 1)) or e.b.shape != e.w.shape[:2]:
            raise ModelError(f"layer {k}")
        if not all(np.isfinite(a).all() for a in (e.w, e.b, e.gain, e.bias)):
            raise ModelError(f"layer {k} is not finite")
