"""Named functions that configurations refer to: features of columns, comparisons of two columns."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column


class Registry:
    def __init__(self, kind: str) -> None:
        self.kind = kind
        self._functions: dict[str, Callable[..., Column]] = {}

    def register(self, name: str | None = None) -> Callable:
        def add(f: Callable[..., Column]) -> Callable[..., Column]:
            self._functions[name or f.__name__] = f
            return f

        return add

    def names(self) -> list[str]:
        return sorted(self._functions)

    def get(self, name: str) -> Callable[..., Column]:
        if name not in self._functions:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(self.names())}")
        return self._functions[name]

    def call(self, name: str, *columns: Column, **params) -> Column:
        """The function on columns; parameters that it doesn't take are an error."""
        f = self.get(name)
        taken = inspect.signature(f).parameters
        if not any(p.kind is p.VAR_KEYWORD for p in taken.values()) and (extra := set(params) - set(taken)):
            raise TypeError(f"{self.kind} {name!r} takes no {', '.join(sorted(extra))}")
        return f(*columns, **params)


FEATURES = Registry("feature function")
COMPARISONS = Registry("comparison")
feature = FEATURES.register
comparison = COMPARISONS.register
