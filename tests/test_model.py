"""Models on disk: tensors, faults, and a whole pipeline from a directory."""

import copy
import hashlib
import json

import numpy as np
import pytest

from tessera.errors import ModelError, UnsupportedError
from tessera.functions.hashing import murmur64a
from tessera.operator_queries import sound_manifest
from tessera.operators import neural
from tessera.schema import explode_tokens
from tessera.sources import model

r = np.random.default_rng(2)


def block(name, width, source, tensors, pieces=2):
    tensors |= {f"{name}.w": r.normal(size=(width, pieces, source)), f"{name}.b": r.normal(size=(width, pieces)), f"{name}.g": np.ones(width), f"{name}.n": np.zeros(width)}
    return {"maxout": {"w": f"{name}.w", "b": f"{name}.b"}, "norm": {"g": f"{name}.g", "b": f"{name}.n"}}


def encoder(name, width, tensors, static):
    names = ["NORM", "PREFIX", "SUFFIX", "SHAPE", "SPACY", "IS_SPACE"]
    hashes = []
    for k, _ in enumerate(names):
        tensors[f"{name}.e{k}"] = r.normal(size=(11 + k, width))
        hashes.append({"params": {"e": f"{name}.e{k}"}, "seed": k})
    out = {"width": width, "attrs": names, "hashes": hashes, "mix": block(f"{name}.mix", width, width * (len(names) + static), tensors), "layers": [block(f"{name}.l0", width, 3 * width, tensors)], "windows": [1], "pad": 1}
    if static:
        tensors[f"{name}.static"] = r.normal(size=(width, 3))
        out["static_vectors"] = {"w": f"{name}.static"}
    return out


def transition(name, slots, source, actions, tensors, hidden=5, inner=4):
    shapes = {"lw": (slots, hidden, 2, inner), "lb": (hidden, 2), "pad": (1, slots, hidden, 2), "rw": (inner, source), "rb": (inner,), "uw": (len(actions), hidden), "ub": (len(actions),)}
    tensors |= {f"{name}.{k}": r.normal(size=s) for k, s in shapes.items()}
    return {"lower": {"w": f"{name}.lw", "b": f"{name}.lb", "pad": f"{name}.pad"}, "reduce": {"w": f"{name}.rw", "b": f"{name}.rb"}, "upper": {"w": f"{name}.uw", "b": f"{name}.ub"}, "actions": actions}


@pytest.fixture(scope="module")
def toy():
    tensors = {"vectors": r.normal(size=(2, 3)), "tag.w": r.normal(size=(3, 6)), "tag.b": r.normal(size=3)}
    m = sound_manifest() | {
        "tok2vec": encoder("tok2vec", 6, tensors, True),
        "tagger": {"labels": ["NN", "DT", "VB"], "params": {"w": "tag.w", "b": "tag.b"}},
        "vector_keys": {str(murmur64a("the")): 1},
        "symbols": {},
    }
    kinds = [{"kind": "shift", "label": ""}, {"kind": "reduce", "label": ""}, {"kind": "left", "label": "det"}, {"kind": "right", "label": "obj"}]
    m["parser"] = transition("parser", 8, 6, kinds, tensors)
    spans = [{"kind": "outside", "label": ""}, *({"kind": k, "label": "E"} for k in ("begin", "inside", "left", "unit"))]
    m["ner"] = {"tok2vec": encoder("ner", 5, tensors, False), "transition": transition("ner.t", 3, 5, spans, tensors)}
    m["tokenizer"] |= {"prefix": r"\(", "suffix": r"[.,)]", "infix": r"-", "url": "https?://\\S+"}
    return m, {k: v.astype(np.float32) for k, v in tensors.items()}


def saved(path, m, tensors):
    raw = model.write_tensors(tensors)
    m = m | {"weights_sha256": hashlib.sha256(raw).hexdigest(), "tensors": {k: {"shape": list(v.shape), "dtype": "F32"} for k, v in tensors.items()}}
    (path / "manifest.json").write_text(json.dumps(m))
    (path / "weights.safetensors").write_bytes(raw)
    return path


def test_tensors(toy):
    _, tensors = toy
    raw = model.write_tensors(tensors)
    assert all((tensors[k] == v).all() for k, v in model.read_tensors(raw).items())
    with pytest.raises(ModelError):
        model.read_tensors(raw[:-4])
    with pytest.raises(ModelError):
        model.read_tensors(model.write_tensors({"x": np.array([np.nan])}))


def test_a_pipeline_from_a_directory(spark, toy, tmp_path):
    loaded = model.Model.load(saved(tmp_path, *toy))
    docs = spark.createDataFrame([(1, "The cat (can't) see the cat-fish."), (2, ""), (3, None)], "doc_id long, text string")
    out = loaded.pipeline().process(docs)
    rows = explode_tokens(out).orderBy("doc_id", "i").collect()
    assert [x.text for x in rows] == ["The", "cat", "(", "ca", "n't", ")", "see", "the", "cat", "-", "fish", "."]
    texts, norms = [x.text for x in rows], [x.norm for x in rows]
    x = loaded.encoder(toy[0]["tok2vec"])(texts, norms, [bool(t.whitespace) for t in rows])
    assert [t.tag for t in rows] == neural.tag(x, toy[1]["tag.w"], toy[1]["tag.b"], ["NN", "DT", "VB"])
    heads, labels, _ = neural.parse(x, loaded.scorer(toy[0]["parser"]), ["S", "D", "L-det", "R-obj"])
    assert [(t.head, t.dep) for t in rows] == list(zip(heads, labels, strict=True))
    assert {t.entity_iob for t in rows} <= {"B", "I", "O"} and loaded.pipeline().process(docs, until="tagger").where("sentences is not null").isEmpty()
    assert (loaded.vectors(["the", "cat"]) == np.stack([toy[1]["vectors"][1], np.zeros(3)])).all()


def test_faults_are_found(toy, tmp_path):
    m, tensors = toy
    assert model.manifest_faults(m) == [] and model.tensor_faults(m, tensors) == []

    def faults(change, more=None):
        n = copy.deepcopy(m)
        change(n)
        return model.tensor_faults(n, tensors | (more or {}))

    def put(path, value):
        def change(n):
            *front, last = path
            for k in front:
                n = n[k]
            n[last] = value

        return change

    for path, value in ((("tok2vec", "width"), 0), (("tok2vec", "width"), 5000), (("tok2vec", "windows"), [17]), (("tok2vec", "pad"), 2), (("tagger", "labels"), []), (("tok2vec", "attrs"), ["NORM"]), (("vector_keys",), {"5": 9}), (("tagger", "params", "w"), "gone")):
        assert faults(put(path, value))
    assert faults(lambda n: None, {"tag.b": np.zeros(4, np.float32)}) == [("model", "shape of tag.b")]
    assert ("unsupported", "parser without maxout") in faults(lambda n: None, {"parser.lw": np.zeros((8, 5, 1, 4)), "parser.lb": np.zeros((5, 1)), "parser.pad": np.zeros((1, 8, 5, 1))})
    path = saved(tmp_path, m, tensors)
    (path / "weights.safetensors").write_bytes(model.write_tensors(tensors | {"tag.b": tensors["tag.b"] + 1}))
    with pytest.raises(ModelError):
        model.Model.load(path)
    with pytest.raises(UnsupportedError):
        model.Model.load(saved(tmp_path, m | {"pipeline": ["tagger"]}, tensors))
    with pytest.raises(ModelError):
        model.Model.load(tmp_path / "none")


def test_lookups():
    assert model.decoded_vector_keys({7: 0, "8": 1}, 2) == {7: 0, 8: 1}
    with pytest.raises(ModelError):
        model.decoded_vector_keys({7: 2}, 2)
    out = model.decoded_lemmas({"lemma_index": {5: ["a"]}, "lemma_exc": {5: {"b": ["c"]}}}, {"noun": 5, "verb": 6})
    assert out == {"lemma_index": {"noun": ["a"], "verb": []}, "lemma_exc": {"noun": {"b": ["c"]}, "verb": {}}, "lemma_rules": {"noun": [], "verb": []}}
