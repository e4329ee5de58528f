"""Typed pipeline parameters: defaults, a named instance, run-time overrides."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any, TypeVar

T = TypeVar("T")


@dataclass(frozen=True)
class ReformatConfig:
    # The defaults of the sample configuration.
    c_string: str = "string$$%^&*#@"
    c_int: int = 65530
    c_boolean: bool = True


def load_config(kind: type[T], *layers: Mapping[str, Any] | None) -> T:
    """Overlay ``layers`` on the defaults of a config dataclass, later ones winning.

    A key a layer leaves out keeps the earlier value. Unknown names and values of
    another type are errors.
    """
    merged: dict[str, Any] = {}
    for layer in layers:
        merged.update(layer or {})
    defaults = kind()
    known = {f.name: type(getattr(defaults, f.name)) for f in fields(kind)}
    for name, value in merged.items():
        if name not in known:
            raise KeyError(f"unknown parameter {name!r}")
        if type(value) is not known[name]:
            raise TypeError(f"parameter {name!r} must be {known[name].__name__}, not {type(value).__name__}")
    return kind(**merged)
