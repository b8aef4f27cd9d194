"""Settings: environment before file before default; profiles and starters with a default where their file is missing or broken."""

from __future__ import annotations

import json
import os
from pathlib import Path

DEFAULTS: dict[str, str] = {"regs_key": "", "reqs_per_hour": "950", "model_triage": "triage", "model_deep": "deep"}
PREFIX = "ROSTRUM_"
PLACEHOLDERS = ("DEMO_KEY",)


def load_json(path: str | Path, default: object) -> object:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default


def save_json(path: str | Path, value: object) -> None:
    Path(path).write_text(json.dumps(value, indent=1), encoding="utf-8")


def get(name: str, path: str | Path = "settings.json") -> str:
    stored = load_json(path, {})
    found = os.environ.get(PREFIX + name.upper()) or (stored.get(name) if isinstance(stored, dict) else None) or DEFAULTS.get(name, "")
    return "" if found in PLACEHOLDERS else str(found)


def merged_prices(defaults: dict[str, tuple[float, float]], overrides: object) -> dict[str, tuple[float, float]]:
    """Defaults with overrides of the form {model: {in, out}} on top."""
    extra = {k: (float(v["in"]), float(v["out"])) for k, v in overrides.items()} if isinstance(overrides, dict) else {}
    return {**defaults, **extra}
