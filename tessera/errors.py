"""Errors of the engine, by kind; row-level forms are (doc_id, code, message) rows."""


class EngineError(Exception):
    code = "error"


class PatternError(EngineError):
    code = "pattern"


class BoundsError(EngineError):
    code = "bounds"


class UnsupportedError(EngineError):
    code = "unsupported"


class MissingAnnotationError(EngineError):
    code = "missing_annotation"


class DependencyError(EngineError):
    """kind: missing_head, head_out_of_bounds or cycle."""

    code = "dependency"

    def __init__(self, kind: str, token: int) -> None:
        super().__init__(f"{kind} at token {token}")
        self.kind, self.token = kind, token


class InvalidSentenceError(EngineError):
    code = "invalid_sentence"


class SnapshotError(EngineError):
    code = "json"


class ModelError(EngineError):
    code = "model"
