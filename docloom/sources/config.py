"""Configuration files: JSON, and YAML where a YAML library is installed."""

from __future__ import annotations

import json
from pathlib import Path


def load_config(path: str | Path) -> dict:
    """The settings of a .json, .yaml or .yml file; an empty file has none, anything but a mapping is an error."""
    text, kind = Path(path).read_text(encoding="utf-8"), Path(path).suffix.lower()
    if kind == ".json":
        found = json.loads(text) if text.strip() else {}
    elif kind in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError(f"{path}: no YAML library is installed; use JSON") from missing
        found = yaml.safe_load(text) or {}
    else:
        raise ValueError(f"{path}: neither JSON nor YAML")
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a mapping is needed")
    return found
