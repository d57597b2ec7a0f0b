"""A directory of installed resource bundles, by name."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from pathlib import Path

from ..errors import ModelError

NAME = re.compile(r"[a-z][a-z0-9_]{0,127}")
MAX_MANIFEST = 16 << 20


@dataclass(frozen=True)
class ModelStore:
    root: Path

    @staticmethod
    def discover(name: str = "TESSERA_MODELS") -> ModelStore:
        place = os.environ.get(name)
        return ModelStore(Path(place) if place else Path.home() / ".local/share/tessera/models")

    def path(self, name: str) -> Path:
        if not NAME.fullmatch(name):
            raise ModelError(f"{name!r} is no model name")
        return self.root / name

    def resolve(self, name_or_path: str) -> Path:
        p = self.path(name_or_path) if NAME.fullmatch(name_or_path) else Path(name_or_path)
        if p.is_symlink() or not (p / "manifest.json").is_file():
            raise ModelError(f"no model at {p}")
        return p

    def register(self, name: str, manifest: dict) -> Path:
        """Writes a manifest in one step: a reader sees the old one or the new one."""
        p = self.path(name)
        p.mkdir(parents=True, exist_ok=True)
        part = p / f".manifest-{os.getpid()}"
        part.write_text(json.dumps(manifest))
        os.replace(part, p / "manifest.json")
        return p

    def load(self, name_or_path: str) -> dict:
        f = self.resolve(name_or_path) / "manifest.json"
        if f.stat().st_size > MAX_MANIFEST:
            raise ModelError("the manifest is too large")
        try:
            return json.loads(f.read_text())
        except ValueError as e:
            raise ModelError(str(e)) from None

    def names(self) -> list[str]:
        return sorted(p.name for p in self.root.glob("*") if NAME.fullmatch(p.name) and (p / "manifest.json").is_file()) if self.root.is_dir() else []
