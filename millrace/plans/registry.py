"""Named operators with checked parameters.

An operator is a function from DataFrames to a DataFrame, or to a dict of named
DataFrames. Its body is ordinary PySpark: ``df.transform``, a pandas UDF,
``applyInPandas`` for groups or ``mapInPandas`` for table functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from math import inf
from typing import Any

# Kinds of parameter.
KINDS = (
    "text",
    "textarea",
    "number",
    "slider",
    "boolean",
    "select",
    "color",
    "file",
    "regex",
    "column",
    "secret",
    "json",
    "expression",
)


@dataclass(frozen=True)
class Param:
    """A parameter: its kind, default and bounds."""

    kind: str
    default: Any = None
    required: bool = False
    min: float | None = None
    max: float | None = None
    options: tuple = ()
    help: str = ""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"Unknown parameter kind '{self.kind}', expected one of {KINDS}")

    def problem(self, name: str, value: Any) -> str | None:
        """What is wrong with a value, or None."""
        if value is None:
            missing = self.required and self.default is None
            return f"{name}: a value is needed" if missing else None
        fault = _FAULTS.get(self.kind, lambda *_: None)(self, value)
        return fault and f"{name}: {fault}"


def _number_fault(param: Param, value: Any) -> str | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f"{value!r} is no number"
    low, high = (-inf if param.min is None else param.min), (inf if param.max is None else param.max)
    return None if low <= value <= high else f"{value} lies outside {low} to {high}"


def _parse_fault(parse: Callable, what: str) -> Callable[[Param, Any], str | None]:
    def fault(param: Param, value: Any) -> str | None:
        try:
            parse(value)
        except ValueError as error:
            return f"no {what}: {error}"
        except re.error as error:
            return f"no {what}: {error}"
        return None

    return fault


# What can be wrong with a value, by the kind of its parameter.
_FAULTS: dict[str, Callable[[Param, Any], str | None]] = {
    "number": _number_fault,
    "slider": _number_fault,
    "boolean": lambda param, value: None if isinstance(value, bool) else f"{value!r} is neither true nor false",
    "select": lambda param, value: f"{value!r} is not among {list(param.options)}" if param.options and value not in param.options else None,
    "regex": _parse_fault(lambda value: re.compile(str(value)), "pattern"),
    "json": _parse_fault(lambda value: json.loads(value) if isinstance(value, str) else value, "JSON"),
}


@dataclass(frozen=True)
class Operator:
    """A named function with its inputs, outputs and parameters.

    ``kind`` is transform, source (gets the session) or sink (an action, skipped in a dry run).
    """

    name: str
    run: Callable
    params: Mapping[str, Param] = field(default_factory=dict)
    inputs: tuple[str, ...] = ("in",)
    outputs: tuple[str, ...] = ("out",)
    kind: str = "transform"
    help: str = ""

    def problems(self, values: Mapping[str, Any]) -> list[str]:
        unknown = [f"Parameter '{name}' is unknown" for name in values if name not in self.params]
        found = [param.problem(name, values.get(name)) for name, param in self.params.items()]
        return unknown + [text for text in found if text]

    def settings(self, values: Mapping[str, Any]) -> dict[str, Any]:
        """Checked values with defaults filled in; parsed where they are JSON text."""
        found = self.problems(values)
        if found:
            raise ValueError(f"{self.name}: " + "; ".join(found))
        out = {}
        for name, param in self.params.items():
            value = values.get(name)
            value = param.default if value is None else value
            out[name] = json.loads(value) if param.kind == "json" and isinstance(value, str) else value
        return out


_OPERATORS: dict[str, Operator] = {}


def operator(
    name: str,
    inputs: tuple[str, ...] = ("in",),
    outputs: tuple[str, ...] = ("out",),
    kind: str = "transform",
    replace: bool = False,
    **params: Param,
) -> Callable:
    """Registers a function under a name. Inputs are positional, parameters are by name."""

    def register(function: Callable) -> Callable:
        if name in _OPERATORS and not replace:
            raise ValueError(f"Operator '{name}' exists already")
        _OPERATORS[name] = Operator(name, function, params, inputs, outputs, kind, (function.__doc__ or "").strip())
        return function

    return register


def get_operator(name: str) -> Operator:
    if name not in _OPERATORS:
        raise KeyError(f"Unknown operator '{name}'")
    return _OPERATORS[name]


def operators() -> dict[str, Operator]:
    return dict(_OPERATORS)
