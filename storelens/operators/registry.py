"""Operator registry: look operators up by id and add your own."""

from __future__ import annotations

from collections.abc import Callable

OPERATORS: dict[str, Callable] = {}


def operator(name: str) -> Callable[[Callable], Callable]:
    """Register a function ``(DataFrame, ...) -> DataFrame`` under ``name``."""

    def register(function: Callable) -> Callable:
        OPERATORS[name] = function
        return function

    return register
