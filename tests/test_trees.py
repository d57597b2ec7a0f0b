"""Trees over arrays against walks of one token at a time."""

import random

import numpy as np
import pytest

from tessera.errors import DependencyError
from tessera.operators import dependency_matcher, trees

r = random.Random(1)


def tree(n):
    order, heads = list(range(n)), [0] * n
    r.shuffle(order)
    for k, t in enumerate(order):
        heads[t] = t if k == 0 or r.random() < 0.2 else order[r.randrange(k)]
    return heads


def walked(heads):
    kids, out, clock = trees.children_of(heads), {g: [0] * len(heads) for g in trees.GRAPH}, 0

    def walk(t, root, depth, members):
        nonlocal clock
        out["root"][t], out["entry"][t], out["depth"][t] = root, clock, depth
        clock += 1
        members.append(t)
        for c in kids[t]:
            walk(c, root, depth + 1, members)
        out["exit"][t] = clock

    for q in (q for q, h in enumerate(heads) if h == q):
        members = []
        walk(q, q, 0, members)
        for t in members:
            out["lo"][t], out["hi"][t] = min(members), max(members) + 1
    out["degree"] = [len(k) for k in kids]
    return out


def test_columns():
    for _ in range(500):
        heads = tree(r.randint(0, 12))
        assert trees.graph_columns(heads) == walked(heads)
    deep = [max(0, i - 1) for i in range(3000)]
    assert trees.graph_columns(deep)["depth"] == list(range(3000))


def test_relations():
    for _ in range(300):
        docs = [tree(r.randint(0, 9)) for _ in range(r.randint(1, 4))]
        sizes = np.array([len(h) for h in docs])
        f, rows = trees.forest([x for h in docs for x in h], sizes), []
        for d, heads in enumerate(docs):
            rows += [dict(x, i=i, head=heads[i], doc=d) for i, x in enumerate(trees.graph(heads))]
        mask = np.array([r.random() < 0.7 for _ in rows], dtype=bool)
        for relation in trees.RELATIONS:
            left = np.array([k for k in range(len(rows)) if r.random() < 0.8], dtype=np.int64)
            same = lambda a, b: a["doc"] == b["doc"] and a["root"] == b["root"]
            want = [(p, k) for p, x in enumerate(left) for k in range(len(rows)) if mask[k] and same(rows[x], rows[k]) and dependency_matcher.related(relation, rows[x], rows[k])]
            place, right = f.related(relation, left, mask)
            assert list(zip(place.tolist(), right.tolist(), strict=True)) == want


def test_ancestors():
    for _ in range(200):
        heads = tree(r.randint(1, 12))
        place, up = trees.forest(heads, np.array([len(heads)])).above(np.arange(len(heads)))
        assert [(i, a) for i in range(len(heads)) for a in trees.ancestors(heads, i)] == list(zip(place.tolist(), up.tolist(), strict=True))


def test_bad_heads():
    for heads, kind, token in (([None], "missing_head", 0), ([0, 5], "head_out_of_bounds", 1), ([1, 0], "cycle", 0), ([0, 2, 1], "cycle", 1), ([0, -1], "head_out_of_bounds", 1)):
        with pytest.raises(DependencyError) as e:
            trees.graph_columns(heads)
        assert (e.value.kind, e.value.token) == (kind, token)


def test_matches_in_rows_equal_those_by_join(spark):
    word = lambda: r.choice(["a", "b", "c"])
    docs = []
    for k in range(30):
        heads = tree(r.randint(0, 12))
        docs.append((k, [(word(), h) for h in heads]))
    df = spark.createDataFrame(docs, "doc_id long, tokens array<struct<text:string,head:int>>")
    has = lambda *v: [{"attribute": "lower", "predicate": {"kind": "in", "values": list(v)}}]
    for one in ("<", ">>", "$--", ".*"):
        spec = [{"id": "x", "constraints": has("a", "b")}, {"id": "y", "constraints": has("b", "c"), "link": {"left": "x", "relation": one}}, {"id": "z", "constraints": [], "link": {"left": "x", "relation": ">"}}]
        rows = sorted(map(repr, dependency_matcher.find_in_rows(df, spec).collect()))
        assert rows == sorted(map(repr, dependency_matcher.find_by_join(trees.with_graph(df, ("text",)), spec).collect())) and rows
        assert rows == sorted(map(repr, dependency_matcher.find_in_rows(df, spec, most=2).collect()))
