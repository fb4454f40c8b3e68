"""Detectors and embedders by name: callables that need decoders or model files that this library does not bring."""

from __future__ import annotations

from collections.abc import Callable

DETECTORS: dict[str, Callable] = {}
EMBEDDERS: dict[str, Callable] = {}


def registered(table: dict[str, Callable], name: str) -> Callable:
    if name not in table:
        raise ValueError(f"unknown: {name}; registered are {sorted(table)}")
    return table[name]
