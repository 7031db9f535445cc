"""Registered scalar functions and aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from ..sql.parser import AGGREGATES
from .builtins import Typed

BUILT_IN = {"ABS", "ROUND", "UPPER", "LOWER", "COALESCE", "IF", "CAST", "TO_LONG", "TO_DOUBLE", "TO_BOOL", "TO_TIMESTAMP", "TO_STRING", *AGGREGATES}


@dataclass(frozen=True)
class Scalar:
    name: str
    arity: tuple[int, ...]
    kind: Callable[[list[str]], str]
    build: Callable[[list[Typed]], Column]


@dataclass(frozen=True)
class Aggregate:
    name: str
    kind: str
    build: Callable[[Column], Column]


class Registry:
    def __init__(self):
        self.scalars: dict[str, Scalar] = {}
        self.aggregates: dict[str, Aggregate] = {}

    def register(self, function: Scalar | Aggregate) -> None:
        """Adds or replaces a function; built-in names are taken."""
        name = function.name.upper()
        if name in BUILT_IN:
            raise ValueError(f"{name} is built in")
        (self.scalars if isinstance(function, Scalar) else self.aggregates)[name] = function

    def names(self) -> list[str]:
        return sorted([*self.scalars, *self.aggregates])
