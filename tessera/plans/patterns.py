"""Token patterns: items of constraints with a repetition, compiled to a list of nodes for the search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from ..errors import PatternError
from .predicates import Constraint, parsed

MAX_NODES = 4096
ONE, OPTIONAL, STAR = "one", "optional", "star"
REPETITIONS = ("once", "optional", "zero_or_more", "one_or_more", "negated", "range")


@dataclass(frozen=True)
class Item:
    constraints: tuple[Constraint, ...]
    repetition: str = "once"
    least: int = 1
    most: int | None = 1

    @staticmethod
    def of(spec: Mapping) -> Item:
        if set(spec) - {"constraints", "repetition"}:
            raise PatternError(f"unknown keys in {sorted(spec)}")
        r = spec.get("repetition", {"kind": "once"})
        kind = r["kind"] if isinstance(r, Mapping) else r
        if kind not in REPETITIONS:
            raise PatternError(f"unknown repetition {kind}")
        least, most = 1, 1
        if kind == "range":
            least, most = r.get("min", 0), r.get("max")
            if least < 0 or most is not None and most < least:
                raise PatternError("a range needs min <= max")
        return Item(parsed(spec.get("constraints", ())), kind, least, most)


@dataclass(frozen=True)
class Pattern:
    items: tuple[Item, ...]
    #: (item, kind) in order; an item that may not occur at all has no node.
    nodes: tuple[tuple[int, str], ...]

    @staticmethod
    def of(spec: Mapping | Sequence) -> Pattern:
        items = tuple(Item.of(x) for x in (spec["tokens"] if isinstance(spec, Mapping) else spec))
        if not items:
            raise PatternError("a pattern has at least one item")
        nodes: list[tuple[int, str]] = []
        for i, item in enumerate(items):
            if item.repetition in ("once", "negated"):
                kinds = [ONE]
            elif item.repetition == "optional":
                kinds = [OPTIONAL]
            elif item.repetition == "zero_or_more":
                kinds = [STAR]
            elif item.repetition == "one_or_more":
                kinds = [ONE, STAR]
            else:
                rest = [STAR] if item.most is None else [OPTIONAL] * (item.most - item.least) if item.most - item.least <= MAX_NODES else [OPTIONAL] * (MAX_NODES + 1)
                kinds = [ONE] * min(item.least, MAX_NODES + 1) + rest
            nodes += [(i, k) for k in kinds]
            if len(nodes) > MAX_NODES:
                raise PatternError(f"more than {MAX_NODES} nodes")
        return Pattern(items, tuple(nodes))

    @property
    def fixed(self) -> bool:
        """Whether every match has as many tokens as the pattern has items."""
        return all(i.repetition in ("once", "negated") for i in self.items)

    def constraints(self) -> list[Constraint]:
        return [c for i in self.items for c in i.constraints]

    def first_values(self) -> tuple[str, tuple[str, ...]] | None:
        """(attribute, values) of which a match's first token must have one, for text, lower and norm."""
        if self.nodes and self.nodes[0][1] == ONE and self.items[self.nodes[0][0]].repetition != "negated":
            for c in self.items[self.nodes[0][0]].constraints:
                if c.attribute in ("text", "lower", "norm") and c.kind in ("equals", "in", "is_subset", "intersects"):
                    return c.attribute, (c.value,) if c.kind == "equals" else tuple(dict.fromkeys(c.value))
        return None
