"""Pipelines: stages from documents to documents, checked for order and composed as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from ..errors import UnsupportedError

STAGES = ("tokenizer", "tok2vec", "tagger", "parser", "attribute_ruler", "lemmatizer", "ner")
NEEDS: dict[str, tuple[str, ...]] = {"tagger": ("tok2vec",), "parser": ("tok2vec",), "attribute_ruler": ("tagger", "parser"), "lemmatizer": ("attribute_ruler",)}


def check_order(components: Sequence[str]) -> None:
    """Every component once, after those it needs."""
    for k, c in enumerate(components):
        if c not in STAGES or c in components[:k]:
            raise UnsupportedError(f"{c} is unknown or given twice")
        if missing := [n for n in NEEDS.get(c, ()) if n not in components[:k]]:
            raise UnsupportedError(f"{c} comes before {', '.join(missing)}")


class Pipeline:
    """Named transformations in order; a prefix of them is a shorter plan."""

    def __init__(self, components: Mapping[str, Callable[[DataFrame], DataFrame]], checked: bool = True) -> None:
        if checked:
            check_order([c for c in components if c != "tokenizer"])
        self.components = dict(components)

    def process(self, docs: DataFrame, until: str | None = None) -> DataFrame:
        if until is not None and until not in self.components:
            raise UnsupportedError(f"no stage {until}")
        for name, f in self.components.items():
            docs = docs.transform(f)
            if name == until:
                break
        return docs


def batch_size(config: Mapping) -> int:
    """[nlp] batch_size, 1000 by default: a positive integer."""
    size = config.get("nlp", {}).get("batch_size", 1000)
    if isinstance(size, bool) or not isinstance(size, int) or size < 1:
        raise UnsupportedError("batch_size is a positive integer")
    return size
