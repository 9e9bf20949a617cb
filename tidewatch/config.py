"""Settings of a run from a JSON or YAML file: known keys only, checked against each other."""

from __future__ import annotations

import json
from dataclasses import fields
from pathlib import Path

from tidewatch.operators import score
from tidewatch.plans.pipeline import Settings
from tidewatch.sources.reviews import check_category

#: Names for several categories at once.
ALIASES_KEY = "aliases"
FURTHER = {ALIASES_KEY, "overrides"}


def read(path: str) -> dict:
    """A mapping from a ``.json`` file, or a ``.yaml`` one where a parser is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        got = yaml.safe_load(text)
    else:
        got = json.loads(text)
    if not isinstance(got, dict):
        raise ValueError(f"{path}: a mapping is wanted")
    return got


def settings(values: dict) -> Settings:
    """``Settings`` of a mapping; unknown keys, thresholds out of order and unusable categories are errors."""
    known = {f.name for f in fields(Settings)}
    if unknown := set(values) - known - FURTHER:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    v = {k: tuple(x) if isinstance(x, list) else x for k, x in values.items() if k in known}
    check_category(v["category"])
    for tau in [v.get("tau", score.TAU), *map(tuple, values.get("overrides", {}).values())]:
        if not (len(tau) == 2 and 0 < tau[0] < tau[1] <= 1):
            raise ValueError(f"thresholds must rise within 0 and 1: {tau}")
    if v.get("start") and v.get("end") and v["start"] > v["end"]:
        raise ValueError("start lies behind end")
    return Settings(**v)


def categories_of(name: str, values: dict) -> list[str]:
    """The categories that a name stands for: those of an alias, or itself."""
    return [check_category(c) for c in values.get(ALIASES_KEY, {}).get(name, [name])]
