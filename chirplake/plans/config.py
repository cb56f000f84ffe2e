"""Configurations: defaults by a schema, derived keys, and functions that users bring."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any


def with_defaults(given: Mapping[str, Any], schema: Mapping[str, Any]) -> dict[str, Any]:
    """A configuration with the defaults of a JSON-schema-like mapping (properties with type and default), checked.

    An unknown key, a missing required one and a value of another type are errors.
    """
    properties = schema.get("properties", {})
    unknown = set(given) - set(properties)
    if unknown and not schema.get("additionalProperties", False):
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    out = dict(given)
    for key, rule in properties.items():
        if key not in out:
            if "default" in rule:
                out[key] = rule["default"]
            elif key in schema.get("required", ()):
                raise ValueError(f"missing key: {key}")
            continue
        value = out[key]
        if rule.get("type") == "object" and isinstance(value, Mapping):
            out[key] = with_defaults(value, {"additionalProperties": True, **rule})
        elif not _fits(value, rule.get("type")):
            raise ValueError(f"{key}: {value!r} is no {rule['type']}")
    return out


def _fits(value: Any, kind: str | None) -> bool:
    match kind:
        case None:
            return True
        case "number":
            return isinstance(value, int | float) and not isinstance(value, bool)
        case "integer":
            return isinstance(value, int) and not isinstance(value, bool)
    return value is None or isinstance(value, {"string": str, "boolean": bool, "array": list | tuple, "object": Mapping}[kind])


def derived(config: Mapping[str, Any]) -> dict[str, Any]:
    """Keys that follow from others: number of detectors, analysis rate, range of decomposition levels."""
    out = dict(config)
    out["nIFO"] = len(out.get("ifo", ()))
    if "inRate" in out and "levelR" in out:
        out["rateANA"] = out["inRate"] >> out["levelR"]
    if "l_low" in out and "l_high" in out:
        out["nRES"] = out["l_high"] - out["l_low"] + 1
    return out


def capped(features: list[str], defaults: Mapping[str, float], caps: Mapping[str, float]) -> list[str]:
    """The feature list of a model with the names of capped features in place of the plain ones; the caller's caps come before the defaults."""
    every = {**defaults, **caps}
    return [f"{f}_cap{every[f]:g}" if every.get(f, 0) > 0 else f for f in features]


def hook(path: str, name: str) -> Callable[..., Any]:
    """A user's function from a Python file, such as a ranking of triggers (DataFrame to DataFrame)."""
    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    if spec is None or spec.loader is None or not Path(path).is_file():
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    found = getattr(module, name, None)
    if not callable(found):
        raise ValueError(f"{path} has no function {name}")
    return found
