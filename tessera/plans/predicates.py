"""Token predicates: a typed form parsed from JSON, compiled to Catalyst expressions or to Python tests for kernels.

A missing annotation (null) of a one-valued attribute counts as the empty string. Morphology tells missing from the known
empty analysis, which equality alone writes as "_". All constraints of an item hold together; none match any token.
"""

from __future__ import annotations

import json
import math
import operator
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

from ..errors import MissingAnnotationError, PatternError, UnsupportedError
from ..functions.lexical import FLAGS, Lexicon, attribute_col, flags
from ..schema import POS_TAGS

STRINGS = ("text", "lower", "norm", "lemma", "pos", "tag", "dep", "morphology")
ANNOTATIONS = ("tag", "pos", "morphology", "lemma", "dep")
COMPARISONS: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}
SETS = ("in", "not_in", "is_subset", "is_superset", "intersects")
INTEGER_SETS = ("in_integers", "not_in_integers", "is_subset_integers", "is_superset_integers", "intersects_integers")


@dataclass(frozen=True)
class Constraint:
    attribute: str
    kind: str
    value: object = None
    comparison: str | None = None

    def __post_init__(self) -> None:
        a, k, v = self.attribute, self.kind, self.value
        if a not in STRINGS and a not in FLAGS and a != "length":
            raise PatternError(f"unknown attribute {a}")
        allowed = {"flag"} if a in FLAGS else {"compare", *INTEGER_SETS} if a == "length" else {"equals", *SETS} | ({"morph_superset", "morph_intersects"} if a == "morphology" else set())
        if k not in allowed:
            raise PatternError(f"{k} does not apply to {a}")
        if k == "flag" and not isinstance(v, bool):
            raise PatternError("a flag is true or false")
        if k == "compare" and (self.comparison not in COMPARISONS or isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v)):
            raise PatternError("a comparison needs an operator and a finite number")
        if k in INTEGER_SETS and not all(isinstance(x, int) and not isinstance(x, bool) for x in v):
            raise PatternError("an integer set holds integers")
        if k == "equals" and not isinstance(v, str):
            raise PatternError("equality needs a string")
        if a == "morphology" and k != "equals":
            for x in v:
                normalize_morph(x)

    @staticmethod
    def of(spec: Mapping) -> Constraint:
        if set(spec) != {"attribute", "predicate"}:
            raise PatternError(f"a constraint has an attribute and a predicate, not {sorted(spec)}")
        p = spec["predicate"]
        extra = set(p) - {"kind", "value", "values", "operator"}
        if extra or "kind" not in p:
            raise PatternError(f"malformed predicate {sorted(p)}")
        v = p.get("values", p.get("value"))
        return Constraint(spec["attribute"], p["kind"], tuple(v) if isinstance(v, list) else v, p.get("operator"))


def parsed(constraints: Iterable[Mapping] | str) -> tuple[Constraint, ...]:
    return tuple(Constraint.of(c) for c in (json.loads(constraints) if isinstance(constraints, str) else constraints))


# ---- morphology ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Analysis:
    """The fields of a morphological analysis with their sorted values; of fields of one name the last counts."""

    fields: Mapping[str, tuple[str, ...]]

    @staticmethod
    def of(text: str) -> Analysis:
        """Parses Field=Value,Value|...; the empty analysis is "" or "_"."""
        parts = [] if text in ("", "_") else [p.split("=") for p in text.split("|")]
        for p in parts:
            if len(p) != 2 or not all((p[0], *p[1].split(","))) or any(c.isspace() for x in p for c in x):
                raise PatternError(f"malformed morphology {'='.join(p)!r}")
        return Analysis({name: tuple(sorted(values.split(","))) for name, values in parts})

    def folded(self) -> Analysis:
        """With the field of a part of speech, however it is spelled, under one name, and a lone known value in capitals."""
        upper = {v.upper(): v for v in POS_TAGS}
        capital = lambda v: (upper[v[0].upper()],) if len(v) == 1 and v[0].upper() in upper else v
        return Analysis(dict(("POS", capital(v)) if name.upper() == "POS" else (name, v) for name, v in self.fields.items()))

    def __str__(self) -> str:
        return "|".join(sorted(f"{name}={','.join(values)}" for name, values in self.fields.items()))


def normalize_morph(value: str) -> str:
    """A pattern's morphology in canonical form: values sorted, a later field replacing an earlier one of its name, the POS
    alias folded, and whole Field=Value strings sorted. Empty and "_" are the empty analysis."""
    return str(Analysis.of(value).folded())


def check_document_morph(value: str | None) -> None:
    """Matching needs a document's morphology in canonical form, that is, one that normalization leaves as it is."""
    try:
        canonical = not value or normalize_morph(value) == value
    except PatternError:
        canonical = False
    if not canonical:
        raise UnsupportedError("matching needs canonical morphology")


def features(value: str) -> frozenset[str]:
    """The single features k=v of an analysis."""
    return frozenset(f"{k}={x}" for part in value.split("|") if part for k, _, v in [part.partition("=")] for x in v.split(","))


def _morph_test(c: Constraint) -> Callable[[str | None], bool]:
    if c.kind == "equals":
        return lambda v: (v is None and c.value == "") or (v == "" and c.value == "_") or (bool(v) and v == c.value)
    if c.kind in ("in", "not_in"):
        entries = {normalize_morph(x) for x in c.value}
        return (lambda v: v is not None and v in entries) if c.kind == "in" else (lambda v: v is None or v not in entries)
    # An entry is one whole string: with several fields or values it equals no single feature.
    want = frozenset(map(normalize_morph, c.value))
    if c.kind == "is_subset":
        return lambda v: not v or features(v) <= want
    if c.kind in ("is_superset", "morph_superset"):
        return lambda v: want <= (features(v) if v else frozenset())
    return lambda v: bool(v) and bool(features(v) & want)


# ---- tests for kernels ---------------------------------------------------------------------------------------------


class TokenView(dict):
    """A token's attributes; lower, length and flags are worked out when first asked for."""

    def __init__(self, text: str, token: Mapping, lexicon: Lexicon | None) -> None:
        super().__init__(token, text=text)
        self.lexicon = lexicon

    def __missing__(self, key: str):
        if key == "lower":
            v: object = self["text"].lower()
        elif key == "length":
            v = len(self["text"])
        elif key in FLAGS:
            if self.lexicon is None:
                raise PatternError(f"{key} needs a lexicon")
            self.update(flags(self["text"], self.lexicon))
            return self[key]
        else:
            v = self["lower"] if key == "norm" else None
        self[key] = v
        return v


def test_of(c: Constraint) -> Callable[[Mapping], bool]:
    a, k, v = c.attribute, c.kind, c.value
    if k == "flag":
        return lambda t: t[a] == v
    if k == "compare":
        compare = COMPARISONS[c.comparison]
        return lambda t: compare(float(t[a]), float(v))
    if a == "morphology":
        inner = _morph_test(c)
        return lambda t: inner(t[a])
    if k == "equals":
        return lambda t: (t[a] or "") == v if a != "length" else t[a] == v
    values = frozenset(v)
    kind = k.removesuffix("_integers")
    if kind == "not_in":
        return lambda t: _one(t, a) not in values
    if kind == "is_superset":
        if not values:
            return lambda t: True
        only = next(iter(values))
        return (lambda t: _one(t, a) == only) if len(values) == 1 else (lambda t: False)
    return lambda t: _one(t, a) in values


def _one(t: Mapping, a: str) -> object:
    v = t[a]
    return "" if v is None else v


def all_of(constraints: Sequence[Constraint]) -> Callable[[Mapping], bool]:
    # Cheap tests first: flags and numbers before strings, morphology last.
    order = sorted(constraints, key=lambda c: (c.attribute == "morphology", c.attribute not in FLAGS, c.attribute != "length"))
    tests = [test_of(c) for c in order]
    return lambda t: all(f(t) for f in tests)


def check_document(constraints: Iterable[Constraint], tokens: Sequence[Mapping]) -> None:
    """What constraints need of a nonempty document: canonical morphology, and for equality at least one annotated token."""
    constraints = list(constraints)
    if any(c.attribute == "morphology" for c in constraints):
        for t in tokens:
            check_document_morph(t["morphology"])
    if tokens:
        for a in ANNOTATIONS:
            if any(c.attribute == a and c.kind == "equals" for c in constraints) and all(t[a] is None for t in tokens):
                raise MissingAnnotationError(f"no token has {a}")


# ---- expressions ---------------------------------------------------------------------------------------------------


def _features_col(m: F.Column) -> F.Column:
    parts = F.filter(F.split(m, r"\|"), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.transform(F.split(F.split_part(p, F.lit("="), F.lit(2)), ","), lambda x: F.concat(F.split_part(p, F.lit("="), F.lit(1)), F.lit("="), x))))


def column_of(c: Constraint, text: str = "text", lexicon: Lexicon = Lexicon(), prefix: str = "") -> F.Column:  # noqa: B008
    """The constraint over the exploded token table: never null, so it may be negated."""
    return _tested(c, lambda a: F.col(prefix + (text if a == "text" else a)), lexicon)


def token_column(constraints: Sequence[Constraint], token: F.Column, lexicon: Lexicon = Lexicon()) -> F.Column:  # noqa: B008
    """The constraints over a token struct, inside a document's array."""
    return reduce(operator.and_, [_tested(c, lambda a: token[a], lexicon) for c in constraints], F.lit(True))


def _tested(c: Constraint, field: Callable[[str], F.Column], lexicon: Lexicon) -> F.Column:
    a, k, v = c.attribute, c.kind, c.value
    lexical = a in FLAGS or a in ("text", "lower", "length")
    col = attribute_col(a, field("text"), lexicon) if lexical else field(a)
    if k == "flag":
        return F.coalesce(col, F.lit(False)) == F.lit(v)
    if k == "compare":
        return COMPARISONS[c.comparison](col.cast("double"), F.lit(float(v)))
    if a == "morphology":
        return _morph_col(c, col)
    col = col if a == "length" else F.coalesce(col, F.lit(""))
    if k == "equals":
        return col == v
    values = list(dict.fromkeys(v))
    kind = k.removesuffix("_integers")
    if kind == "is_superset":
        return F.lit(True) if not values else (col == values[0] if len(values) == 1 else F.lit(False))
    inside = col.isin(*values) if values else F.lit(False)
    return ~inside if kind == "not_in" else inside


def _morph_col(c: Constraint, m: F.Column) -> F.Column:
    missing = m.isNull()
    if c.kind == "equals":
        return F.coalesce(F.when(missing, F.lit(c.value == "")).when(m == "", F.lit(c.value == "_")).otherwise(m == c.value), F.lit(False))
    if c.kind in ("in", "not_in"):
        entries = sorted({normalize_morph(x) for x in c.value})
        inside = F.coalesce(m.isin(*entries), F.lit(False)) if entries else F.lit(False)
        return inside if c.kind == "in" else ~inside
    want = sorted(frozenset(map(normalize_morph, c.value)))
    have, listed = _features_col(F.coalesce(m, F.lit(""))), F.array(*map(F.lit, want)).cast("array<string>")
    if c.kind == "is_subset":
        return F.size(F.array_except(have, listed)) == 0
    if c.kind in ("is_superset", "morph_superset"):
        return F.size(F.array_except(listed, have)) == 0
    return F.size(F.array_intersect(have, listed)) > 0


def columns_of(constraints: Sequence[Constraint], text: str = "text", lexicon: Lexicon = Lexicon(), prefix: str = "") -> F.Column:  # noqa: B008
    return reduce(operator.and_, [column_of(c, text, lexicon, prefix) for c in constraints], F.lit(True))
