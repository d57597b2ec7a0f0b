"""Token, phrase and dependency patterns against worked vectors and brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from tessera.errors import DependencyError, MissingAnnotationError, PatternError, UnsupportedError
from tessera.functions.lexical import Lexicon
from tessera.operators.dependency_matcher import DependencyMatcher
from tessera.operators.phrase_matcher import KeyTable, PhraseMatcher
from tessera.operators.token_matcher import TokenMatcher, find_fixed, keep_greedy
from tessera.operators.trees import RELATIONS, ancestors, check_heads, left_edges, subtree
from tessera.plans.predicates import normalize_morph


def item(kind="once", constraints=(), **more):
    return {"constraints": list(constraints), "repetition": {"kind": kind, **more}}


def is_(attribute, kind, value):
    return {"attribute": attribute, "predicate": {"kind": kind, "values" if isinstance(value, list) else "value": value}}


def spans(matches):
    return [m[1:] for m in matches]


def test_order_of_discovery(make_doc):
    star = TokenMatcher().add("r", [[item("zero_or_more")]])
    assert spans(star.matches(make_doc("xxx"))) == [(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3)]
    assert spans(TokenMatcher().add("r", [[item("optional"), item("optional")]]).matches(make_doc("xx"))) == [(0, 1), (0, 2), (1, 2)]
    m = TokenMatcher().add("a", [[item(), item()]]).add("b", [[item()]]).add("a", [[item()], [item()]])
    assert m.matches(make_doc("xx")) == [("b", 0, 1), ("a", 0, 1), ("a", 0, 2), ("b", 1, 2), ("a", 1, 2)]


def test_all_short_patterns_against_regular_expressions(make_doc):
    forms = {"once": "a", "optional": "a?", "zero_or_more": "a*", "one_or_more": "a+", "negated": "[^a]"}
    texts = ["".join(t) for n in range(5) for t in itertools.product("ab", repeat=n)]
    docs = {t: make_doc(t) for t in texts}
    total = 0
    for n in (1, 2, 3):
        for kinds in itertools.product(forms, repeat=n):
            search = TokenMatcher().add("r", [[item(k, [is_("text", "equals", "a")]) for k in kinds]]).compiled()
            r = re.compile("".join(forms[k] for k in kinds))
            for t in texts:
                got = spans(search(docs[t]))
                assert sorted(got) == [(i, j) for i in range(len(t)) for j in range(i + 1, len(t) + 1) if r.fullmatch(t[i:j])]
                total += len(got)
    assert total == 6261


def test_greedy(make_doc):
    assert keep_greedy(np.array([3, 4]), np.array([5, 7]), "first").tolist() == [0]
    assert keep_greedy(np.array([3, 4]), np.array([5, 7]), "longest").tolist() == [1]
    m = TokenMatcher().add("g", [[item("one_or_more")]], "longest").add("n", [[item()]])
    assert m.matches(make_doc("xx")) == [("n", 0, 1), ("n", 1, 2), ("g", 0, 2)]
    assert ("g", 0, 1) in m.add("g", []).matches(make_doc("xx"))  # the latest call decides


def test_ranges_and_errors(make_doc):
    assert spans(TokenMatcher().add("r", [[item("range", min=2, max=3)]]).matches(make_doc("xxx"))) == [(0, 2), (0, 3), (1, 3)]
    assert spans(TokenMatcher().add("r", [[item("range", min=0, max=0), item()]]).matches(make_doc("x"))) == [(0, 1)]
    for bad in ([[item("range", min=5000)]], [[]], [[item("sometimes")]], [[item(constraints=[is_("is_alpha", "equals", "x")])]], [[item(constraints=[is_("length", "equals", "x")])]]):
        with pytest.raises(PatternError):
            TokenMatcher(Lexicon()).add("r", bad)
    with pytest.raises(PatternError):
        TokenMatcher().add("r", [[item(constraints=[is_("is_alpha", "flag", True)])]])
    with pytest.raises(PatternError):
        TokenMatcher().remove("r")


@pytest.mark.parametrize("attribute", ["lemma", "pos", "tag", "dep"])
@pytest.mark.parametrize(
    "kind,value,want",
    [("equals", "x", [0]), ("equals", "", [1, 2]), ("in", [""], [1, 2]), ("not_in", ["x"], [1, 2]), ("not_in", [""], [0]), ("is_subset", [""], [1, 2]), ("is_subset", ["x"], [0]), ("is_superset", [""], [1, 2]), ("is_superset", [], [0, 1, 2]), ("intersects", [""], [1, 2])],
)
def test_missing_annotations(make_doc, attribute, kind, value, want):
    doc = make_doc("abc", **{attribute: ["x", None, None]})
    m = TokenMatcher().add("r", [[item(constraints=[is_(attribute, kind, value)])]])
    assert [s for s, _ in spans(m.matches(doc))] == want


P = "Number=Plur"
MORPH = [
    ("equals", P, [0]), ("equals", "", [2]), ("equals", "_", [1]), ("in", [""], [1]), ("in", ["_"], [1]), ("not_in", [""], [0, 2]), ("not_in", [P], [1, 2]), ("is_subset", [], [1, 2]), ("is_subset", [P], [0, 1, 2]),
    ("is_superset", [], [0, 1, 2]), ("is_superset", [P], [0]), ("intersects", [], []), ("intersects", [P], [0]),
]


@pytest.mark.parametrize("kind,value,want", MORPH)
def test_morphology(spark, make_doc, kind, value, want):
    doc = make_doc("abc", morphology=[P, "", None])
    c = is_("morphology", kind, value)
    assert [s for s, _ in spans(TokenMatcher().add("r", [[item(constraints=[c])]]).matches(doc))] == want
    rows = spark.createDataFrame([(1, i, t, m) for i, (t, m) in enumerate(zip("abc", [P, "", None]))], "doc_id long, i int, text string, morphology string")
    assert sorted(r.start for r in find_fixed(rows, "r", [[item(constraints=[c])]]).collect()) == want


def test_morphology_forms():
    assert normalize_morph("Case=Nom|Case2=Acc") == "Case2=Acc|Case=Nom"
    assert normalize_morph("B=z,a|pos=noun|A=1|B=y") == "A=1|B=y|POS=NOUN"
    for bad in ("Number", "=x", "A=", "A=x,", "A =x", "A=x=y"):
        with pytest.raises(PatternError):
            normalize_morph(bad)


def test_what_documents_need(make_doc):
    m = TokenMatcher().add("r", [[item(constraints=[is_("lemma", "equals", "x")])]])
    with pytest.raises(MissingAnnotationError):
        m.matches(make_doc("ab"))
    assert m.matches(make_doc("")) == []
    with pytest.raises(UnsupportedError):
        TokenMatcher().add("r", [[item(constraints=[is_("morphology", "in", ["A=b"])])]]).matches(make_doc("a", morphology=["B=x|A=y"]))


def test_errors_become_rows(spark, make_doc):
    from tessera.schema import DOC_DDL

    docs = spark.createDataFrame([make_doc("ab"), make_doc("ab", lemma=["x", None])], DOC_DDL)
    rows = TokenMatcher().add("r", [[item(constraints=[is_("lemma", "equals", "x")])]]).find(docs, errors=True).collect()
    assert sorted((r.rule or "", r.error or "") for r in rows) == [("", "missing_annotation"), ("r", "")]


def test_phrases(make_doc):
    m = PhraseMatcher("lower").add("a", [["x", "y"], ["x", "y"], []]).add("b", [["y"]])
    assert m.matches(make_doc("XYy")) == [("a", 0, 2), ("b", 1, 2), ("b", 2, 3)]
    assert len(m) == 2 and "a" in m and m.remove("a").matches(make_doc("xy")) == [("b", 1, 2)]
    assert PhraseMatcher("length").add("n", [["1", "1"]]).matches(make_doc("xyz")) == [("n", 0, 2), ("n", 1, 3)]
    flags = PhraseMatcher("is_digit", Lexicon()).add("d", [["true", "false"]])
    assert flags.matches(make_doc("1a2")) == [("d", 0, 2)]
    with pytest.raises(MissingAnnotationError):
        PhraseMatcher("lemma").add_docs("r", [make_doc("a")])
    assert PhraseMatcher("orth").add_docs("r", [make_doc("ab")]).matches(make_doc("abab")) == [("r", 0, 2), ("r", 2, 4)]


def test_key_table_order():
    assert list(KeyTable([9, 1, 8, 16, 0])) == [8, 9, 16, 0, 1] or list(KeyTable([9, 1, 8, 16, 0]))[-2:] == [0, 1]
    keys = [17, 33, 5, 100, 64, 7, 1]
    assert sorted(KeyTable(keys)) == sorted(keys) and list(KeyTable(keys))[-1] == 1


PAIRS = {
    "<": "01 21 32", ">": "10 12 23", "<<": "01 21 31 32", ">>": "10 12 13 23", ".": "01 12 23", ".*": "01 02 03 12 13 23", ";": "10 21 32", ";*": "10 20 21 30 31 32", "$+": "12", "$-": "10", "$++": "02 12",
    "$--": "10 20", ">+": "12 23", ">-": "10", ">++": "12 23", ">--": "10", "<+": "01", "<-": "21 32", "<++": "01", "<--": "21 32",
}


def two(relation):
    return [{"id": "a"}, {"id": "b", "link": {"left": "a", "relation": relation}}]


@pytest.mark.parametrize("relation", sorted(RELATIONS))
def test_relations(spark, make_doc, relation):
    from tessera.operators import dependency_matcher as dm
    from tessera.operators.trees import with_graph
    from tessera.schema import DOC_DDL

    doc = make_doc("abcd", head=[1, 1, 1, 2])
    got = [f"{a}{b}" for _, (a, b) in DependencyMatcher().add("r", [two(relation)]).matches(doc)]
    assert " ".join(got) == PAIRS[relation]
    if relation in ("<<", "$+", ";*", ">"):
        graph = with_graph(spark.createDataFrame([doc], DOC_DDL))
        assert sorted("{}{}".format(*r.tokens) for r in dm.find_by_join(graph, two(relation)).collect()) == sorted(got)


def test_trees(make_doc):
    m = DependencyMatcher().add("r", [two(".*")])
    assert [t for _, t in m.matches(make_doc("abcd", head=[0, 0, 2, 2]))] == [[0, 1], [2, 3]]
    assert [t for _, t in m.matches(make_doc("abcd", head=[2, 1, 2, 1]))] == [[0, 2], [1, 3]]
    reuse = DependencyMatcher().add("r", [[*two(">"), {"id": "c", "link": {"left": "b", "relation": "<"}}]])
    assert reuse.matches(make_doc("ab", head=[0, 0]))[0] == ("r", [0, 1, 0])
    assert subtree([1, 1, 1, 2], 1) == [0, 1, 2, 3] and ancestors([1, 1, 1, 2], 3) == [2, 1] and subtree([2, 2, 2, 0], 2) == [0, 3, 1, 2]
    assert left_edges([1, 1, 1, 2]) == [0, 0, 2, 3]
    for heads, kind in (([None, 0], "missing_head"), ([5, 1], "head_out_of_bounds"), ([1, 0], "cycle")):
        with pytest.raises(DependencyError) as e:
            check_heads(heads)
        assert e.value.kind == kind
    for bad in ([{"id": "a"}, {"id": "a", "link": {"left": "a", "relation": ">"}}], [{"id": "a"}, {"id": "b"}], [], [{"id": "a", "link": {"left": "x", "relation": ">"}}]):
        with pytest.raises(PatternError):
            DependencyMatcher().add("r", [bad])


def test_the_array_plan_equals_the_search():
    """Patterns of all kinds by arrays and by states: the same matches in the same order, with and without greedy rules."""
    r = random.Random(11)
    words = ["a", "b", "A", "cc", "1"]

    def item(kinds):
        c = r.choice([{"attribute": "text", "predicate": {"kind": "equals", "value": r.choice(words)}}, {"attribute": "lower", "predicate": {"kind": "in", "values": r.sample(words, 2)}}, {"attribute": "is_digit", "predicate": {"kind": "flag", "value": r.random() < 0.5}}, {"attribute": "length", "predicate": {"kind": "compare", "operator": ">", "value": 1}}])
        more = [c, {"attribute": "is_alpha", "predicate": {"kind": "flag", "value": True}}] if r.random() < 0.3 else [c] if r.random() < 0.9 else []
        return {"constraints": more, "repetition": {"kind": r.choice(kinds)}}

    for _ in range(1500):
        m = TokenMatcher(Lexicon())
        for name in "pqr"[: r.randint(1, 3)]:
            patterns = [[item(r.choice([["once", "negated"], ["once", "optional", "zero_or_more", "one_or_more", "negated"]])) for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 3))]
            m = m.add(name, patterns, r.choice([None, None, "first", "longest"]))
        search, text = m.compiled(), [r.choice(words) for _ in range(r.randint(0, 14))]
        assert search.plan is not None
        fast = search.words(text)
        search.plan = None
        assert search.words(text) == fast


def test_find_words_equals_find(spark, make_doc):
    from tessera.schema import DOC_DDL

    m = TokenMatcher().add("r", [[{"constraints": [{"attribute": "lower", "predicate": {"kind": "in", "values": ["a", "b"]}}], "repetition": {"kind": "one_or_more"}}]], "longest")
    texts = [["a", "B", "c", "a"], [], ["c"]]
    docs = [make_doc(w) | {"doc_id": k} for k, w in enumerate(texts)]
    one = sorted(map(tuple, m.find(spark.createDataFrame(docs, DOC_DDL)).collect()))
    two = sorted(map(tuple, m.find_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, words array<string>")).collect()))
    assert one == two == [(0, 0, "r", 0, 2), (0, 1, "r", 3, 4)]
    # Documents of a batch don't run into each other.
    r = random.Random(19)
    rows = [(k, None if k % 17 == 3 else [r.choice("abAc") for _ in range(r.randint(0, 6))]) for k in range(200)]
    spec = lambda kind, **more: {"constraints": [{"attribute": "lower", "predicate": {"kind": "in", "values": ["a", "b"]}}], "repetition": {"kind": kind, **more}}
    m = TokenMatcher(Lexicon()).add("s", [[spec("one_or_more")]]).add("n", [[spec("negated")], [spec("zero_or_more"), spec("negated"), spec("optional")]]).add("g", [[spec("once"), spec("optional")]], "first").add("l", [[spec("one_or_more")]], "longest")
    search = m.compiled()
    want = [(k, i, n, a, b) for k, w in rows for i, (n, a, b) in enumerate(search.words(w or []))]
    got = m.find_words(spark.createDataFrame(rows, "doc_id long, words array<string>").coalesce(1)).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 300


def test_removed_keys_leave_their_cells():
    t = KeyTable([8, 16, 24])  # all begin at cell 0
    assert list(t) == [8, 16, 24]
    t.remove(8)
    t.insert(32)
    assert list(t) == [32, 16, 24]  # in the cell that 8 left
    t.remove(16)
    t.insert(24)
    assert list(t) == [32, 24]  # moved up
    t.insert(1)
    assert list(t) == [32, 24, 1]
    grown = KeyTable(range(2, 12))
    assert len(grown.cells) == 32 and list(grown) == list(range(2, 12))


def test_a_phrase_that_nothing_ends_at_starts_anew():
    m = PhraseMatcher().add("a", [["x"]]).add("b", [["x"], ["y"]]).remove("a").remove("b").add("c", [["x"]])
    assert m.ends() == {("x",): ["c"]} and m.trie() == {"x": {None: ["c"]}}


def test_phrases_of_any_length_in_rows_and_by_join(spark):
    from pyspark.sql import functions as F

    from tessera.operators.phrase_matcher import find_by_join, find_in_rows

    r = random.Random(17)
    docs = [(k, [r.choice("ab") for _ in range(r.randint(0, 40))]) for k in range(60)]
    long = docs[3][1][:25] or ["a"]
    phrases = [("long", long), ("one", ["a"]), ("two", ["b", "a"]), ("nine", list("abababab") + ["a"]), ("nine", list("abababab") + ["a"]), ("none", []), ("null", ["a", None])]
    want = sorted((k, n, i, i + len(p)) for k, w in docs for n, p in {(n, tuple(p)) for n, p in phrases if p} for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
    side = spark.createDataFrame(phrases, "rule string, keys array<string>")
    rows = spark.createDataFrame(docs, "doc_id long, keys array<string>")
    assert sorted(map(tuple, find_in_rows(rows, side).collect())) == want and find_in_rows(rows, side, small=10) is None
    tokens = rows.select("doc_id", F.posexplode("keys").alias("i", "key"))
    for small in (0, 8 << 20):
        assert sorted(map(tuple, find_by_join(tokens, side, "key", small=small).collect())) == want
    assert sorted(map(tuple, find_by_join(tokens, side.where("size(keys) > 1"), "key", look=2).collect())) == [x for x in want if x[1] != "one"]
