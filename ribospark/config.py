"""Options: command line over configuration file over default."""

from __future__ import annotations

import json
from typing import Any


def load_config(path: str | None) -> dict[str, Any]:
    """A YAML or JSON file as a dictionary; no path gives an empty one."""
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def section(config: dict[str, Any], name: str) -> dict[str, Any]:
    """The options of a section, those of its inner tables beside its own; a file without sections is one section."""
    own = config.get(name, config if not any(isinstance(v, dict) for v in config.values()) else {}) or {}
    out: dict[str, Any] = {}
    for key, value in own.items():
        if isinstance(value, dict):
            out |= {k: v for k, v in section({key: value}, key).items() if k not in out}
        else:
            out[key] = value
    return out


def resolve(given: dict[str, Any], configured: dict[str, Any], defaults: dict[str, Any]) -> dict[str, Any]:
    """The defaults, overridden by the file and then by what was given (not None)."""
    return defaults | {k: v for k, v in configured.items() if k in defaults} | {k: v for k, v in given.items() if v is not None}
