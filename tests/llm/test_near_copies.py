"""The pipeline's near-duplicates: all texts at a five-word Jaccard similarity of 0.8 or more, and no others."""

import re
from collections import defaultdict

import numpy as np

import corpus_pipeline as pipeline
from tessera.llm import shingles, simhash

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def brute_components(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having = defaultdict(list)
    for i, s in enumerate(sets):
        met = defaultdict(int)
        for x in s:
            for j in having[x]:
                met[j] += 1
            having[x].append(i)
        for j, n in met.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def edited(words, places):
    return " ".join(f"other{i}" if i in places else w for i, w in enumerate(words))


def test_near_copies_link(spark):
    """Copies with changed words, which 2 of 64 bits often miss; copies with too many changes stay apart."""
    r, rows = np.random.default_rng(3), []
    for k in range(20):
        words = [f"w{x}" for x in r.integers(0, 5000, 300)]
        for d, places in enumerate(({}, {20, 110, 250}, {5 + 60 * i for i in range(5)}, {10 + 20 * i for i in range(14)})):
            rows.append((4 * k + d, edited(words, places)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    roots = brute_components([t for _, t in rows])
    assert roots == [4 * (i // 4) + (3 if i % 4 == 3 else 0) for i in range(len(rows))]
    assert {x.doc_id: x.component_id for x in simhash.near_duplicates(docs).collect()} == dict(enumerate(roots))
    assert sorted(x.doc_id for x in pipeline.dedup_stage(spark, docs, "").collect()) == sorted(set(roots))


def test_stage_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    roots = brute_components([x.text for x in rows])
    assert {x.doc_id: x.component_id for x in simhash.near_duplicates(docs).collect()} == {x.doc_id: rows[q].doc_id for x, q in zip(rows, roots, strict=True)}


def test_blocks_dont_matter(spark):
    r, rows = np.random.default_rng(4), []
    words = [f"w{x}" for x in r.integers(0, 5000, 200)]
    for d in range(120):
        rows.append((d, edited(words, set(r.integers(0, 200, int(r.integers(0, 9))).tolist()))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = shingles.identities(docs).drop("doc_id").dropDuplicates(["fp"])
    coarse = simhash.components(shingles.candidates(nodes))
    group = lambda *block: {x.node: x.root for x in simhash.components(shingles.exact_links(docs, nodes, coarse, *block)).collect()}
    assert group(16) == group(256) == group(256, 3000) != {}


def test_fingerprints_bring_candidates(spark, monkeypatch):
    """Fingerprints within two bits by the grid are candidates by themselves, and the stage takes them."""
    r, rows = np.random.default_rng(6), []
    for k in range(30):
        words = [f"w{x}" for x in r.integers(0, 5000, 600)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, edited(words, {300} if k % 2 else {}) + (" again" if not k % 3 else ""))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = {i: (simhash.fingerprint(t.encode(), 5), shingles.set_id(shingles.shingle_set(t.encode()))) for i, t in rows}
    near = [(a, b) for a in of for b in of if a < b and (of[a][0] ^ of[b][0]).bit_count() <= 2 and of[a][1] != of[b][1]]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ids = shingles.identities(docs, lambda x: simhash.fingerprint(x, 5))
    root = {x.node: x.root for x in simhash.components(simhash.fingerprint_candidates(ids)).collect()}
    for a, b in near:
        x, y = (signed(of[i][1]) for i in (a, b))
        assert root.get(x, x) == root.get(y, y)
    assert len(near) > 3
    none = shingles.candidates
    monkeypatch.setattr(shingles, "candidates", lambda nodes: none(nodes).where("false"))
    group = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs).collect()}
    assert all(group[a] == group[b] for a, b in near)
