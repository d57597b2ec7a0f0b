"""Models on disk: a manifest (JSON) beside its tensors, checked as a whole before anything is built from it.

A manifest's faults are found by rules over its parts, each of which yields a code and a place; tensor shapes are given as
dimension names, which have to stand for one size each. What passes becomes pipeline stages."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from ..errors import ModelError, UnsupportedError
from ..operators import annotators, neural
from ..operators.kernels import per_document
from ..operators.tokenizer import TokenizerRules, tokenize
from ..plans.pipeline import Pipeline, batch_size, check_order
from ..schema import POS_TAGS

#: Fixed values of the format.
DIALECT = "fancy-regex-explicit-python-unicode-v1"
LEGACY = ("en_core_web_md", "3.8.0")
LEGACY_PIPELINE = ("tok2vec", "tagger", "parser", "attribute_ruler", "lemmatizer", "ner")
LEMMA_POS = ("noun", "verb", "adj", "adv", "punct")
RANGES = ("alpha", "digit", "lower", "upper", "title", "punct", "currency", "case_ignorable")
PARSER_ACTIONS = {"shift": False, "reduce": False, "left": True, "right": True, "begin": True}  # whether it has a label
NER_ACTIONS = {"begin": None, "inside": None, "left": None, "unit": None, "outside": False}

Fault = tuple[str, str]


# ---- manifests -----------------------------------------------------------------------------------------------------


def _identity(m: Mapping) -> Iterator[Fault]:
    version = m.get("format_version")
    if version not in (1, 2):
        yield "unsupported", "format_version"
    if version == 1:
        static = bool(m.get("tok2vec", {}).get("static_vectors")) and bool(m.get("ner", {}).get("tok2vec", {}).get("static_vectors"))
        if (m.get("model"), m.get("model_version")) != LEGACY or m.get("capabilities") is not None or not static:
            yield "unsupported", "version 1 is one model alone"
        if tuple(m.get("pipeline", ())) != LEGACY_PIPELINE:
            yield "unsupported", "pipeline"
    if version == 2:
        if not m.get("capabilities"):
            yield "unsupported", "capabilities"
        if not str(m.get("model", "")).strip() or not str(m.get("model_version", "")).strip():
            yield "model", "identity"


def _tokenizer(m: Mapping) -> Iterator[Fault]:
    t = m.get("tokenizer", {})
    if t.get("regex_dialect") != DIALECT:
        yield "unsupported", "regex dialect"
    if t.get("token_match") is not None:
        yield "unsupported", "token_match"
    if t.get("faster_heuristics") is False:
        yield "unsupported", "faster_heuristics"
    for word, pieces in t.get("rules", {}).items():
        if not makes_up(word, [p.get("orth", "") for p in pieces]):
            yield "model", f"exception {word!r}"


def makes_up(word: str, pieces: Sequence[str]) -> bool:
    """Whether the pieces, none empty, follow each other through the word; a blank between two of them may be left out."""
    rest = word
    for k, piece in enumerate(pieces):
        if k and rest.startswith(" ") and not piece.startswith(" "):
            rest = rest[1:]
        if not piece or not rest.startswith(piece):
            return False
        rest = rest.removeprefix(piece)
    return bool(word) and bool(pieces) and not rest


def _lexical(m: Mapping) -> Iterator[Fault]:
    for name in RANGES:
        flat = [x for pair in m.get("lexical", {}).get("ranges", {}).get(name, ()) for x in pair]
        pairs = list(zip(flat[::2], flat[1::2]))
        apart = all(b < c for (_, b), (c, _) in zip(pairs, pairs[1:]))
        if not apart or any(a > b or b > 0x10FFFF for a, b in pairs):
            yield "model", f"ranges of {name}"


def _attributes(m: Mapping) -> Iterator[Fault]:
    for k, rule in enumerate(m.get("attribute_rules", ())):
        if any(not -len(p) <= rule.get("index", 0) < len(p) for p in rule.get("patterns", ())):
            yield "model", f"index of attribute rule {k}"
        if (pos := rule.get("attrs", {}).get("pos")) and pos not in POS_TAGS:
            yield "model", f"part of speech of attribute rule {k}"


def _lemmas(m: Mapping) -> Iterator[Fault]:
    tables = m.get("lemmas", {})
    for pos in LEMMA_POS:
        if not all(pos in tables.get(t, {}) for t in ("lemma_index", "lemma_exc", "lemma_rules")):
            yield "model", f"lemma tables of {pos}"


def _actions(m: Mapping) -> Iterator[Fault]:
    for part, known in (("parser", PARSER_ACTIONS), ("ner", NER_ACTIONS)):
        for a in (m.get(part, {}) if part == "parser" else m.get(part, {}).get("transition", {})).get("actions", ()):
            labelled = known.get(a.get("kind"), "none")
            if labelled == "none" or labelled is not None and labelled != bool(a.get("label")):
                yield "unsupported", f"{part} action {a.get('kind')}"


def _order(m: Mapping) -> Iterator[Fault]:
    try:
        check_order(list(m.get("pipeline", ())))
        batch_size(m)
    except UnsupportedError as e:
        yield "unsupported", str(e)


RULES: tuple[Callable[[Mapping], Iterator[Fault]], ...] = (_identity, _tokenizer, _lexical, _attributes, _lemmas, _actions, _order)


def manifest_faults(m: Mapping) -> list[Fault]:
    """(code, place) of everything wrong with a manifest, rule by rule."""
    return [fault for rule in RULES for fault in rule(m)]


def check_manifests(rows: DataFrame) -> DataFrame:
    """name, code, place for every fault of manifests given as rows (name, manifest as JSON); a sound one has no row."""

    def run(r: dict) -> list[dict]:
        try:
            faults = manifest_faults(json.loads(r["manifest"]))
        except ValueError as e:
            faults = [("model", str(e))]
        return [{"name": r["name"], "code": c, "place": p} for c, p in faults]

    return per_document(rows.select("name", "manifest"), run, "name string, code string, place string")


# ---- tensors -------------------------------------------------------------------------------------------------------


def read_tensors(data: bytes) -> dict[str, np.ndarray]:
    """The F32 tensors of a file in the safetensors format: a little-endian size, a JSON header, the numbers."""
    size = int.from_bytes(data[:8], "little")
    try:
        header = json.loads(data[8 : 8 + size])
    except ValueError as e:
        raise ModelError(str(e)) from None
    out, body = {}, data[8 + size :]
    for name, spec in header.items():
        if name == "__metadata__":
            continue
        a, b = spec["data_offsets"]
        count = int(np.prod(spec["shape"], dtype=np.int64))
        if spec["dtype"] != "F32" or b - a != 4 * count or not 0 <= a <= b <= len(body):
            raise ModelError(f"tensor {name}")
        out[name] = np.frombuffer(body, "<f4", count, a).reshape(spec["shape"])
        if not np.isfinite(out[name]).all():
            raise ModelError(f"tensor {name} is not finite")
    return out


def write_tensors(tensors: Mapping[str, np.ndarray]) -> bytes:
    header, body = {}, b""
    for name, t in tensors.items():
        raw = np.ascontiguousarray(t, "<f4").tobytes()
        header[name] = {"dtype": "F32", "shape": list(t.shape), "data_offsets": [len(body), len(body) + len(raw)]}
        body += raw
    head = json.dumps(header).encode()
    return len(head).to_bytes(8, "little") + head + body


def expected_shapes(m: Mapping) -> Iterator[tuple[str, tuple]]:
    """Names of tensors with their dimensions, as sizes or as names that stand for one size each."""
    yield "vectors", ("vectors", "vector width")
    for part, encoder in (("tok2vec", m["tok2vec"]), ("ner", m["ner"]["tok2vec"])):
        width = encoder["width"]
        wide = width * (len(encoder["attrs"]) + bool(encoder.get("static_vectors")))
        for k, h in enumerate(encoder["hashes"]):
            yield h["params"]["e"], (f"{part} rows {k}", width)
        if encoder.get("static_vectors"):
            yield encoder["static_vectors"]["w"], (width, "vector width")
        for k, (block, source) in enumerate([(encoder["mix"], wide), *((b, width * (2 * w + 1)) for b, w in zip(encoder["layers"], encoder["windows"]))]):
            yield block["maxout"]["w"], (width, f"{part} pieces {k}", source)
            yield block["maxout"]["b"], (width, f"{part} pieces {k}")
            yield block["norm"]["g"], (width,)
            yield block["norm"]["b"], (width,)
    tagger = m["tagger"]
    yield tagger["params"]["w"], (len(tagger["labels"]), m["tok2vec"]["width"])
    yield tagger["params"]["b"], (len(tagger["labels"]),)
    for part, t, slots, source in (("parser", m["parser"], 8, m["tok2vec"]["width"]), ("ner", m["ner"]["transition"], 3, m["ner"]["tok2vec"]["width"])):
        hidden, pieces, inner = (f"{part} {x}" for x in ("hidden", "pieces", "inner"))
        yield t["lower"]["w"], (slots, hidden, pieces, inner)
        yield t["lower"]["b"], (hidden, pieces)
        yield t["lower"]["pad"], (1, slots, hidden, pieces)
        yield t["reduce"]["w"], (inner, source)
        yield t["reduce"]["b"], (inner,)
        yield t["upper"]["w"], (len(t["actions"]), hidden)
        yield t["upper"]["b"], (len(t["actions"]),)


def tensor_faults(m: Mapping, tensors: Mapping[str, np.ndarray]) -> list[Fault]:
    """What doesn't fit together between a manifest and its tensors."""
    out: list[Fault] = []
    for part, e in (("tok2vec", m["tok2vec"]), ("ner", m["ner"]["tok2vec"])):
        rules = {"width": 0 < e["width"] <= 4096, "features": 0 < len(e["attrs"]) == len(e["hashes"]), "windows": len(e["layers"]) == len(e["windows"]) and all(0 <= w <= 16 for w in e["windows"]), "padding": e["pad"] == sum(e["windows"])}
        out += [("model", f"{part} {name}") for name, sound in rules.items() if not sound]
    if not m["tagger"]["labels"] or not m["parser"]["actions"] or not m["ner"]["transition"]["actions"]:
        out.append(("model", "no labels or actions"))
    sizes: dict[str, int] = {}
    for name, dims in expected_shapes(m):
        t = tensors.get(name)
        if t is None or t.ndim != len(dims):
            out.append(("model", f"tensor {name}"))
            continue
        if any((sizes.setdefault(d, n) if isinstance(d, str) else d) != n for d, n in zip(dims, t.shape)):
            out.append(("model", f"shape of {name}"))
    out += [("unsupported", f"{p} without maxout") for p in ("parser", "ner") if sizes.get(f"{p} pieces", 2) < 2]
    if any(e.get("static_vectors") for e in (m["tok2vec"], m["ner"]["tok2vec"])) and not sizes.get("vector width"):
        out.append(("model", "static vectors"))
    if any(not 0 <= row < sizes.get("vectors", 0) for row in m.get("vector_keys", {}).values()):
        out.append(("model", "vector_keys"))
    declared = {k: tuple(v["shape"]) for k, v in m.get("tensors", {}).items() if v.get("dtype") == "F32"}
    empty = lambda k, s: 0 in s and not (m.get("format_version") == 2 and k == "vectors" and s == (0, 0))
    out += [("model", f"declared {k}") for k in m.get("tensors", {}) if k not in declared or k not in tensors or declared[k] != tensors[k].shape or empty(k, declared[k])]
    return out


# ---- models --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    manifest: Mapping
    tensors: Mapping[str, np.ndarray]

    @staticmethod
    def load(path: str | Path) -> Model:
        """A model's directory (manifest.json, weights.safetensors); the first fault is raised."""
        p = Path(path)
        try:
            m = json.loads((p / "manifest.json").read_text())
            raw = (p / "weights.safetensors").read_bytes()
        except (OSError, ValueError) as e:
            raise ModelError(str(e)) from None
        for code, place in manifest_faults(m):
            raise (UnsupportedError if code == "unsupported" else ModelError)(place)
        if hashlib.sha256(raw).hexdigest() != m.get("weights_sha256"):
            raise ModelError("checksum of the weights")
        tensors = read_tensors(raw)
        for code, place in tensor_faults(m, tensors):
            raise (UnsupportedError if code == "unsupported" else ModelError)(place)
        return Model(m, tensors)

    def block(self, spec: Mapping, window: int = 0) -> neural.EncoderLayer:
        t = self.tensors
        return neural.EncoderLayer(t[spec["maxout"]["w"]], t[spec["maxout"]["b"]], t[spec["norm"]["g"]], t[spec["norm"]["b"]], window)

    def encoder(self, spec: Mapping) -> neural.Encoded:
        """Tokens to the rows of their encoding."""
        tables, seeds = [self.tensors[h["params"]["e"]] for h in spec["hashes"]], [h["seed"] for h in spec["hashes"]]
        mix, layers = self.block(spec["mix"]), [self.block(b, w) for b, w in zip(spec["layers"], spec["windows"])]
        names, symbols = list(spec["attrs"]), self.manifest.get("symbols") or {}
        static = self.tensors[spec["static_vectors"]["w"]] if spec.get("static_vectors") else None

        def encoded(texts: Sequence[str], norms: Sequence[str], blanks: Sequence[bool]) -> np.ndarray:
            ids = neural.named_features(names, texts, norms, blanks, symbols)
            x = neural.hash_embed(ids, tables, seeds)
            if static is not None:
                x = np.hstack([x, self.vectors(texts) @ static.T])
            return neural.encode(neural.layer_norm(neural.maxout(x.astype(np.float32), mix.w, mix.b), mix.gain, mix.bias), layers)

        return encoded

    def vectors(self, texts: Sequence[str]) -> np.ndarray:
        """The static vector of every text, noughts for those without one."""
        from ..functions.hashing import string_id

        keys, table = self.manifest.get("vector_keys", {}), self.tensors["vectors"]
        rows = [keys.get(str(string_id(t, self.manifest.get("symbols") or {}))) for t in texts]
        return np.array([np.zeros(table.shape[1], np.float32) if r is None else table[r] for r in rows], dtype=np.float32).reshape(len(texts), -1)

    def scorer(self, spec: Mapping) -> neural.Scorer:
        t, low = self.tensors, spec["lower"]
        return neural.Scorer(t[low["w"]], t[low["pad"]][0], t[low["b"]], t[spec["upper"]["w"]], t[spec["upper"]["b"]], t[spec["reduce"]["w"]], t[spec["reduce"]["b"]])

    def pipeline(self) -> Pipeline:
        """The model's stages in order, from texts to documents."""
        m = self.manifest
        short = {"shift": "S", "reduce": "D", "left": "L", "right": "R", "begin": "B"}
        spans = {"begin": "B", "inside": "I", "left": "L", "unit": "U", "outside": "O"}
        named = lambda actions, kinds: [kinds[a["kind"]] + (f"-{a['label']}" if a.get("label") and kinds[a["kind"]] not in ("S", "D", "O") and not (kinds is short and a["kind"] == "begin") else "") for a in actions]
        tables = m["lemmas"]
        lemmas = annotators.LemmaTables(
            {k: frozenset(v) for k, v in tables["lemma_index"].items()}, {k: {w: tuple(f) for w, f in v.items()} for k, v in tables["lemma_exc"].items()}, {k: tuple(map(tuple, v)) for k, v in tables["lemma_rules"].items()}
        )
        t = m["tokenizer"]
        rules = TokenizerRules(t["prefix"], t["suffix"], t["infix"], t["url"], {w: tuple((p["orth"], p.get("norm")) for p in ps) for w, ps in t.get("rules", {}).items()})
        attributes = [annotators.AttributeRule(tuple(r["patterns"]), r["attrs"], r.get("index", 0)) for r in m.get("attribute_rules", ())]
        stages = {
            "tok2vec": lambda: neural.encoder_stage(self.encoder(m["tok2vec"])),
            "tagger": lambda: neural.tagger_stage(self.tensors[m["tagger"]["params"]["w"]], self.tensors[m["tagger"]["params"]["b"]], m["tagger"]["labels"]),
            "parser": lambda: neural.parser_stage(self.scorer(m["parser"]), named(m["parser"]["actions"], short)),
            "attribute_ruler": lambda: lambda docs: annotators.attribute_ruler(docs, attributes),
            "lemmatizer": lambda: lambda docs: annotators.lemmatize(docs, lemmas),
            "ner": lambda: neural.ner_stage(self.scorer(m["ner"]["transition"]), named(m["ner"]["transition"]["actions"], spans), self.encoder(m["ner"]["tok2vec"])),
        }
        return Pipeline({"tokenizer": lambda docs: tokenize(docs, rules), **{name: stages[name]() for name in m["pipeline"]}})


def decoded_lemmas(stored: Mapping, pos: Mapping[str, int]) -> dict[str, dict]:
    """Lemma tables by part of speech from tables by the id of its name; one that is not there is empty."""
    return {table: {name: stored.get(table, {}).get(key, stored.get(table, {}).get(str(key), {} if table == "lemma_exc" else [])) for name, key in pos.items()} for table in ("lemma_index", "lemma_exc", "lemma_rules")}


def decoded_vector_keys(keys: Mapping, rows: int) -> dict[int, int]:
    """Vector rows by key; every row is one of the table."""
    out = {int(k): int(v) for k, v in keys.items()}
    if any(not 0 <= v < rows for v in out.values()):
        raise ModelError("a vector row outside the table")
    return out
