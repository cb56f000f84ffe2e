"""Workflows: steps that name actions, run in order over lazy DataFrames.

A workflow is a mapping with ``vars``, ``runtime`` (tmp_dir, cleanup_tmp:
always, on_success or never) and ``steps``; YAML is read where its library is
there, JSON anywhere.  A step has ``action``, ``args`` (or ``inputs``) and may
keep its result: under ``id``, under ``output_alias`` (a name, or a list of
names for a result of several parts), or, for a mapping without either, spread
into the context.
"""

from __future__ import annotations

import importlib
import json
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

ACTIONS: dict[str, Action] = {}


@dataclass(frozen=True)
class Action:
    name: str
    run: Callable[..., Any]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    help: str = ""


def action(name: str, inputs: tuple[str, ...] = (), outputs: tuple[str, ...] = ()) -> Callable:
    """Registers a function of DataFrames and values as an action."""

    def add(f: Callable) -> Callable:
        ACTIONS[name] = Action(name, f, inputs, outputs, (f.__doc__ or "").strip())
        return f

    return add


def found(name: str) -> Callable[..., Any]:
    """The action of a name, or the function that a dotted name imports."""
    if name in ACTIONS:
        return ACTIONS[name].run
    module, _, attribute = name.rpartition(".")
    if not module:
        raise KeyError(f"unknown action: {name}")
    try:
        return getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError) as error:
        raise KeyError(f"unknown action: {name}") from error


@dataclass(frozen=True)
class Reference:
    """A place in the context: the steps from a name on, numbers being places in a list."""

    steps: tuple[str, ...]

    @classmethod
    def of(cls, text: str) -> Reference:
        return cls(tuple(text.strip().split(".")))

    def value(self, context: Any) -> Any:
        here = context
        for step in self.steps:
            try:
                here = here[step] if isinstance(here, Mapping) else here[int(step)] if step.lstrip("-").isdigit() else getattr(here, step)
            except (KeyError, IndexError, AttributeError, TypeError) as error:
                raise KeyError(f"{'.'.join(self.steps)}: no {step}") from error
        return here


@dataclass(frozen=True)
class Text:
    """Text with references in it: the pieces in order."""

    pieces: tuple[str | Reference, ...]

    @classmethod
    def of(cls, text: str) -> Text | Reference | str:
        """A Reference for "@a.b" or a lone "${a.b}", Text for text around some, else the text itself."""
        if text.startswith("@"):
            return Reference.of(text[1:])
        parts = re.split(r"\$\{([^}]+)\}", text)
        if len(parts) == 1:
            return text
        if len(parts) == 3 and not parts[0] and not parts[2]:
            return Reference.of(parts[1])
        return cls(tuple(Reference.of(p) if i % 2 else p for i, p in enumerate(parts) if p))

    def value(self, context: Any) -> str:
        return "".join(str(p.value(context)) if isinstance(p, Reference) else p for p in self.pieces)


def parsed(value: Any) -> Any:
    """A configured value with its references read."""
    match value:
        case str():
            return Text.of(value)
        case Mapping():
            return {k: parsed(v) for k, v in value.items()}
        case list() | tuple():
            return [parsed(v) for v in value]
    return value


def resolved(value: Any, context: Mapping[str, Any], folder: str = "") -> Any:
    """A read value with its references followed; tmp://x is a path in the run's folder."""
    match value:
        case Reference() | Text():
            value = value.value(context)
            return resolved(value, context, folder) if isinstance(value, str) else value
        case str():
            return f"{folder}/{value.removeprefix('tmp://').lstrip('/')}" if value.startswith("tmp://") else value
        case Mapping():
            return {k: resolved(v, context, folder) for k, v in value.items()}
        case list():
            return [resolved(v, context, folder) for v in value]
    return value


def references(value: Any) -> Iterator[Reference]:
    """All references of a read value."""
    match value:
        case Reference():
            yield value
        case Text():
            yield from (p for p in value.pieces if isinstance(p, Reference))
        case Mapping():
            for v in value.values():
                yield from references(v)
        case list():
            for v in value:
                yield from references(v)


@dataclass
class Workflow:
    """Steps and the context that they read and fill.  DataFrames stay lazy; only sinks execute."""

    steps: list[Mapping[str, Any]]
    context: dict[str, Any] = field(default_factory=dict)
    runtime: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, config: Mapping[str, Any]) -> Workflow:
        return cls(list(config.get("steps", [])), dict(config.get("vars", {})), dict(config.get("runtime", {})))

    @classmethod
    def read(cls, path: str) -> Workflow:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            return cls.of(json.loads(text))
        try:
            import yaml
        except ImportError as error:
            raise ImportError("reading YAML needs the yaml library; JSON does not") from error
        return cls.of(yaml.safe_load(text))

    def run(self) -> dict[str, Any]:
        given = self.runtime.get("tmp_dir")
        folder = given or tempfile.mkdtemp(prefix="workflow-")
        if given and "://" not in given:
            Path(given).mkdir(parents=True, exist_ok=True)
        cleanup, done = str(self.runtime.get("cleanup_tmp", "never")), False
        try:
            for step in self.steps:
                call = found(step["action"])
                args = resolved(parsed({**step.get("inputs", {}), **step.get("args", {})}), self.context, folder)
                self._keep(step, call(**args))
            done = True
        finally:
            if (cleanup == "always" or (cleanup == "on_success" and done)) and Path(folder).resolve() not in (Path.home(), Path("/"), Path.cwd()):
                shutil.rmtree(folder, ignore_errors=True)
        return self.context

    def _keep(self, step: Mapping[str, Any], result: Any) -> None:
        alias = step.get("output_alias")
        if "id" in step:
            self.context[step["id"]] = result
        if isinstance(alias, str):
            self.context[alias] = result
        elif alias:
            if not isinstance(result, list | tuple) or len(result) != len(alias):
                raise ValueError(f"{step['action']}: {len(alias)} names for another number of results")
            self.context.update(zip(alias, result, strict=True))
        elif "id" not in step and isinstance(result, Mapping):
            self.context.update(result)
        for name, path in step.get("outputs", {}).items():
            self.context[name] = Reference.of(path).value(result)

    def edges(self) -> list[tuple[str, str]]:
        """(source, step) of every reference between steps."""
        out = []
        for i, step in enumerate(self.steps):
            name = step.get("id") or step.get("output_alias") or f"{step['action']}-{i}"
            out += [(ref.steps[0], str(name)) for ref in references(parsed({**step.get("inputs", {}), **step.get("args", {})}))]
        return out
