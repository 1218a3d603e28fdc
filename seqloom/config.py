"""Settings of a build: JSON bundles laid over each other, dotted overrides, and the names of functions."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any


def merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` laid over ``base``: mappings are merged, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load(paths: Iterable[str], overrides: Iterable[str] = ()) -> dict[str, Any]:
    """The bundles in ``paths``, later ones over earlier, then overrides ``a.b=value`` (JSON, else text); an override without '=' is an error."""
    out: dict[str, Any] = {}
    for p in paths:
        with open(p, encoding="utf-8") as f:
            out = merge(out, json.load(f))
    for o in overrides:
        name, eq, text = o.partition("=")
        if not eq:
            raise ValueError(f"override without '=': {o}")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        for part in reversed(name.split(".")):
            value = {part: value}
        out = merge(out, value)
    return out


def pick(config: Mapping[str, Any], dotted: str, default: Any = None) -> Any:
    """The setting at ``a.b.c``, or ``default``."""
    for part in dotted.split("."):
        if not isinstance(config, Mapping) or part not in config:
            return default
        config = config[part]
    return config


def function_names(config: Mapping[str, Any], selected: Iterable[str] | None = None) -> dict[str, str]:
    """DD9: short to full function names of the ``functions`` setting, in the selected order; unknown or repeated names are an error."""
    known = {short: v["name"] if isinstance(v, Mapping) else v for short, v in pick(config, "functions", {}).items()}
    if len(set(known.values())) != len(known):
        raise ValueError("two short names stand for one function")
    want = list(known) if selected is None else list(selected)
    lost = [s for s in want if s not in known]
    if lost:
        raise ValueError(f"unknown functions: {lost}")
    return {s: known[s] for s in want}
