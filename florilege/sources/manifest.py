"""The manifest of a data set: which files of which version and licence an index is built from."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

#: The lists of a manifest, and how sources may be handed on.
LISTS = ("backbones", "trait_vocabularies", "xref_sources", "concept_sources", "name_spaces")
REDISTRIBUTION = ("allowed", "restricted", "unknown")
KEYS = {"id", "version", "path", "paths", "license", "source_url", "redistribution", "taxonomy"}


@dataclass(frozen=True)
class Manifest:
    sources: dict[str, list[dict]]
    sha256: str


def parse(path: str) -> Manifest:
    """Read and check a manifest (JSON, or YAML where a reader for it is installed). Unknown keys and missing ones are refused."""
    raw = Path(path).read_bytes()
    if path.endswith(".json"):
        data = json.loads(raw)
    else:
        import yaml

        data = yaml.safe_load(raw)
    return _checked(data, Path(path).resolve().parent, raw)


def parse_text(text: str, base: Path) -> Manifest:
    """A manifest as JSON text; relative paths are taken from base."""
    return _checked(json.loads(text), base, text.encode())


def _checked(data: object, base: Path, raw: bytes) -> Manifest:
    if not isinstance(data, dict) or not data.get("backbones"):
        raise ValueError("a manifest needs at least one backbone")
    if unknown := set(data) - set(LISTS):
        raise ValueError(f"unknown key: {sorted(unknown)[0]}")
    out: dict[str, list[dict]] = {}
    for name in LISTS:
        out[name] = []
        for entry in data.get(name) or []:
            if unknown := set(entry) - KEYS:
                raise ValueError(f"{name}: unknown key: {sorted(unknown)[0]}")
            for needed in ("id", "version", "redistribution"):
                if not entry.get(needed):
                    raise ValueError(f"{name}: {needed} is missing")
            if entry["redistribution"] not in REDISTRIBUTION:
                raise ValueError(f"{name}: redistribution is {entry['redistribution']!r}")
            paths = entry.get("paths") or ([entry["path"]] if entry.get("path") else [])
            if not paths:
                raise ValueError(f"{name}: path is missing")
            out[name].append({**entry, "paths": [p if "://" in p or p.startswith("/") else str(base / p) for p in paths]})
    return Manifest(out, hashlib.sha256(raw).hexdigest())
