"""Operators over batches of documents give what the functions of one document give, and steps run as one kernel."""

import random

import pyarrow as pa
import pytest
from conftest import SF

from tessera.errors import EngineError
from tessera.operators import batches, entities


def outcome(f):
    try:
        return f()
    except EngineError as e:
        return e.code, str(e)


def span(r, n, label="X"):
    a, b = sorted((r.randint(0, n), r.randint(0, n + (r.random() < 0.05))))
    return {"start": a, "end": b, "label": r.choice([label, "Y", "", None]), "id": r.choice([None, "", "new"])}


def random_docs(r, make_doc, count):
    """Documents with all kinds of tags, null and empty ones included."""
    for k in range(count):
        n = r.randint(0, 6)
        words = [r.choice(["the", "Éa", "of", "x"]) for _ in range(n)]
        tags = {"entity_iob": [r.choice(["B", "I", "O", "", None]) for _ in words], "entity_type": [r.choice(["X", "Y", "", None]) for _ in words], "entity_id": [r.choice([None, "", "q"]) for _ in words]}
        yield make_doc(words, **tags) | {"doc_id": k}


def test_updates_of_batches(make_doc):
    """Random updates against the update of one document: tags, entities and errors."""
    r = random.Random(8)
    kind = pa.struct([(k, pa.list_(batches.SPAN_TYPE)) for k in entities.LISTS] + [("default", pa.string())])
    seen = set()
    for _ in range(60):
        docs = list(random_docs(r, make_doc, 20))
        updates = []
        for d in docs:
            lists = {k: r.choice([None, [span(r, len(d["tokens"])) for _ in range(r.randint(0, 2))]]) for k in entities.LISTS}
            updates.append(None if r.random() < 0.1 else lists | {"default": r.choice([*entities.DEFAULTS, None, "odd"])})
        one = lambda d, u: entities.with_tags(d, entities.set_entities(entities.tags_of(d), u or {}))
        want = [outcome(lambda d=d, u=u: one(d, u)) for d, u in zip(docs, updates)]
        got = entities.write_tags(batches.from_rows(docs), *entities.update_spans(pa.array(updates, kind)), errors=True)
        for d, w, g, code, message in zip(docs, want, got.rows(), *(got.columns[c].to_pylist() for c in ("error", "message"))):
            seen.add(code)
            if code:
                assert (code, message) == w and g == dict.fromkeys(batches.DOC) | {"doc_id": d["doc_id"]}
            else:
                assert {k: g[k] for k in ("text", "tokens", "entities")} == {k: w[k] for k in ("text", "tokens", "entities")}
        first = next((w for w in want if isinstance(w, tuple)), None)
        assert first is None or outcome(lambda: entities.write_tags(batches.from_rows(docs), *entities.update_spans(pa.array(updates, kind)))) == first
    assert len(seen) >= 4 and None in seen


@pytest.mark.parametrize("name", ["ent_bounds", "ent_unmodified", "ent_ids"])
def test_one_kernel(spark, name):
    """Documents don't become rows between the steps, and only the columns that are asked for do."""
    from tessera.queries import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "tensor" not in plan


def test_words_as_docs(spark):
    """Offsets in bytes and code points, of odd words and of no words."""
    rows = [(1, ["Éa", "ß", "x"]), (2, []), (3, None), (4, ["a", "İ"])]
    got = {d.doc_id: d for d in batches.words_as_docs(spark.createDataFrame(rows, "doc_id long, words array<string>").coalesce(1)).collect()}
    assert [(d.text, len(d.tokens)) for _, d in sorted(got.items())] == [("Éaßx", 3), ("", 0), ("", 0), ("aİ", 2)]
    assert [(t.start, t.end, t.idx, t.norm) for t in got[1].tokens] == [(0, 3, 0, "éa"), (3, 5, 2, "ß"), (5, 6, 3, "x")]
    assert [t.norm for t in got[4].tokens] == ["a", "İ".lower()]


def ruler_cases():
    from tessera.operators.rulers import EntityRuler, SpanRuler

    low = lambda *v: {"constraints": [{"attribute": "lower", "predicate": {"kind": "in", "value": list(v)}}]}
    rules = [{"label": "A", "pattern": [low("the")]}, {"label": "B", "pattern": [low("of", "x")], "id": "b"}, {"label": "C", "pattern": [low("the"), low("of")]}]
    for some in (rules[:2], rules, [*rules, {"label": "P", "pattern": ["x", "x"]}]):
        yield from (EntityRuler(overwrite_entities=o).add(some) for o in (False, True))
        yield from (SpanRuler(spans_key=None, annotate_entities=True, entities_filter=f, overwrite=o).add(some) for f in entities.FILTERS for o in (False, True))


def test_rulers_of_batches(make_doc):
    """Random documents against one document at a time: entities apart and overlapping, with faults."""
    r = random.Random(9)
    for ruler in ruler_cases():
        run, step = ruler.compiled(), ruler.step()
        docs = list(random_docs(r, make_doc, 40))
        for d in docs:
            n = len(d["tokens"])
            apart = [(a, a + 1) for a in range(n) if r.random() < 0.4]
            d["entities"] = r.choice([None, [{"start": a, "end": b, "label": "OLD", "id": None} for a, b in apart], [span(r, n) for _ in range(2)]])
        want = [outcome(lambda d=d: ruler.annotated(d, run(d))) for d in docs]
        for d, w in zip(docs, want):
            got = outcome(lambda d=d: step(batches.from_rows([d])).rows()[0])
            assert got == w or {k: got[k] for k in ("tokens", "entities")} == {k: w[k] for k in ("tokens", "entities")}
        good = [(d, w) for d, w in zip(docs, want) if not isinstance(w, tuple)]
        assert [g["entities"] for g in step(batches.from_rows([d for d, _ in good])).rows()] == [w["entities"] for _, w in good]


@pytest.mark.parametrize("name", ["er_overwrites", "er_keeps_entities", "sr_entities"])
def test_rulers_in_one_kernel(spark, name):
    from tessera.queries import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "tensor" not in plan


def test_embedding_and_tags_of_batches(make_doc, monkeypatch):
    """Ids, tensors and tags of a batch against those of one document, token by token."""
    import numpy as np

    from tessera.functions.hashing import string_id, string_ids
    from tessera.functions.lexical import shape
    from tessera.operators import neural

    r, g = random.Random(4), np.random.default_rng(4)
    texts = ["", *("".join(r.choice("aZ9é߀-") for _ in range(r.randint(1, 40))) for _ in range(300)), "x" * 120]
    assert string_ids(texts, {"x": 3}).tolist() == [string_id(t, {"x": 3}) for t in texts]
    one = lambda t, n: [string_id(x) for x in (n, t[:1], t[-3:], shape(t))]
    assert neural.feature_ids(texts, [t.lower() for t in texts]).tolist() == [one(t, t.lower()) for t in texts]

    table, seeds = g.integers(-3, 4, (7, 2)).astype(np.float32), [3, 4, 5, 6]
    layer = neural.EncoderLayer(g.integers(-2, 3, (8, 2, 24)).astype(np.float32), np.zeros((8, 2), np.float32), np.ones(8, np.float32), np.zeros(8, np.float32))
    w, b = g.integers(-2, 3, (3, 8)).astype(np.float32), np.array([0, 1, -1], np.float32)
    docs = [make_doc([r.choice(texts[1:]) for _ in range(n)]) | {"doc_id": n} for n in (3, 0, 5, 1)]
    docs[0]["tokens"][0]["norm"], docs[0]["tokens"][1]["norm"] = None, "other"
    for layers in ((), (layer,)):
        steps = []
        monkeypatch.setattr(neural, "stepped", lambda _, step: steps.append(step))
        neural.tok2vec_stage([table] * 4, seeds, layers)(None)
        neural.tagger_stage(w, b, ["A", "B", "C"])(None)
        got = steps[1](steps[0](batches.from_rows(docs))).rows()
        for d, out in zip(docs, got):
            words = [d["text"].encode()[t["start"] : t["end"]].decode() for t in d["tokens"]]
            norms = [t["norm"] or x.lower() for t, x in zip(d["tokens"], words)]
            x = neural.encode(neural.hash_embed(neural.feature_ids(words, norms), [table] * 4, seeds).astype(np.float32), layers) if words else np.zeros((0, 8), np.float32)
            assert out["tensor"] == x.tolist() and [t["tag"] for t in out["tokens"]] == neural.tag(x, w, b, ["A", "B", "C"])


def test_parses_of_batches():
    """Many documents in step against one at a time, with all kinds of actions, re-attached and put back tokens."""
    import numpy as np

    from tessera.operators import neural

    g = np.random.default_rng(12)
    ended = 0
    for trial in range(40):
        slots, hidden, width = int(g.integers(1, 9)), 3, 4
        whole = lambda *shape: g.integers(-4, 5, shape).astype(np.float32)
        actions = ["S", "D", "L-a", "R-a", "L-b", "R-b", "B"]
        scorer = neural.Scorer(whole(slots, hidden, 2, width), whole(slots, hidden, 2), whole(hidden, 2), whole(7, hidden), whole(7))
        xs = [whole(int(n), width) for n in g.integers(0, 14, 12)]
        want = [outcome(lambda x=x: neural.parse(x, scorer, actions)) for x in xs]
        good = [k for k, w in enumerate(want) if len(w) == 3]
        heads, labels, starts = neural.parse_batch([xs[k] for k in good], scorer, actions)
        at = 0
        for k in good:
            n = len(xs[k])
            names = [actions[i].partition("-")[2] if i >= 0 else "ROOT" for i in labels[at : at + n].tolist()]
            assert (heads[at : at + n].tolist(), names, np.flatnonzero(starts[at : at + n]).tolist()) == want[k]
            at, ended = at + n, ended + 1
        for w in (w for w in want if len(w) == 2):
            assert outcome(lambda: neural.parse_batch(xs, scorer, actions))[0] == w[0]  # noqa: B023
    assert ended > 200


def test_parser_query_in_one_kernel(spark):
    from tessera.queries import QUERIES

    plan = QUERIES["neural_parser"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "tensor" not in plan


def test_stages_of_batches(make_doc, monkeypatch):
    """Sentences, attribute rules and lemmas of a batch against those of one document."""
    import numpy as np

    from tessera.errors import DependencyError
    from tessera.operators import annotators, neural, token_matcher

    r = random.Random(3)
    for _ in range(100):
        trees = [[r.choice([i, r.randint(0, i)]) for i in range(r.randint(0, 12))] for _ in range(6)]
        # Turned round, heads stand to the right as well.
        trees = [[len(t) - 1 - h for h in reversed(t)] if r.random() < 0.5 else t for t in trees]
        begins, spans = neural.sentences_of_batch(np.array(sum(trees, []), dtype=np.int64), np.array(list(map(len, trees))))
        want = [annotators.sentences_of(t) for t in trees]
        assert spans.to_pylist() == want and begins.sum() == sum(map(len, want))
    with pytest.raises(DependencyError):
        neural.sentences_of_batch(np.array([0, 1, 0]), np.array([1, 2]))

    steps = []
    monkeypatch.setattr(annotators, "stepped", lambda _, step: steps.append(step))
    item = lambda a, kind, v: {"constraints": [{"attribute": a, "predicate": {"kind": kind, "value": v}}]}
    rules = [
        annotators.AttributeRule(([item("tag", "equals", "BB")], [item("lower", "in", ["of"]), item("tag", "in", ["AA"])]), {"pos": "NOUN", "morphology": "_"}),
        annotators.AttributeRule(([item("lower", "in", ["the"]), item("lower", "in", ["of", "the"])],), {"pos": "DET", "lemma": "d"}, -1),
        annotators.AttributeRule(([item("text", "equals", "x")],), {"pos": "X", "morph": "Number=Sing"}),
    ]
    outside = annotators.AttributeRule(([item("lower", "in", ["x"])],), {"pos": "X"}, 2)
    tables = annotators.LemmaTables(index={"noun": frozenset(["x"])}, rules={"noun": (("e", ""), ("f", "v"))}, exceptions={"x": {"x": ("y",)}})
    for some in (rules, [*rules, outside]):
        annotators.attribute_ruler(None, some)
    annotators.lemmatize(None, tables)
    m = [token_matcher.TokenMatcher() for _ in range(2)]
    for k, some in enumerate((rules, [*rules, outside])):
        for i, rule in enumerate(some):
            m[k] = m[k].add(str(i), rule.patterns)
    for tagged in (True, False):
        docs = [d | {"tokens": [t | {"tag": r.choice(["AA", "BB", None]) if tagged else "AA", "morphology": r.choice([None, "Number=Plur"])} for t in d["tokens"]]} for d in random_docs(r, make_doc, 40)]
        for k, some in enumerate((rules, [*rules, outside])):
            search = m[k].compiled()
            want = [outcome(lambda d=d: annotators.apply_attribute_rules(d, some, search)) for d in docs]
            for d, w in zip(docs, want):
                got = outcome(lambda d=d: steps[k](batches.from_rows([d])).rows()[0])
                assert got == w or got["tokens"] == w["tokens"]
            good = [(d, w) for d, w in zip(docs, want) if not isinstance(w, tuple)]
            out = steps[2](steps[k](batches.from_rows([d for d, _ in good]))).rows()
            for (d, w), g in zip(good, out):
                words = [d["text"].encode()[t["start"] : t["end"]].decode() for t in d["tokens"]]
                assert g["tokens"] == [t | {"lemma": annotators.lemma(s, t["pos"], t["morphology"], tables)} for s, t in zip(words, w["tokens"])]


def test_whole_pipeline_in_one_kernel(spark):
    from tessera.queries import QUERIES

    plan = QUERIES["pipeline_whole"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "tensor" not in plan
