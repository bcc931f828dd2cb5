"""Encoders by name: what turns texts and images into vectors is a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from hashlib import shake_128

import numpy as np

#: Texts or files of a batch to vectors of one width.
Encode = Callable[[Sequence], list[list[float]]]


@dataclass(frozen=True)
class Encoder:
    """``images`` and ``texts`` make a callable once in a process; scores are ``scale`` * s, or a sigmoid of that and ``bias``."""

    name: str
    dimensions: int
    images: Callable[[], Encode]
    texts: Callable[[], Encode]
    revision: str | None = None
    scale: float = 1.0
    bias: float | None = None


_known: dict[str, Callable[[], Encoder]] = {}


def register(kind: str, make: Callable[[], Encoder]) -> None:
    _known[kind.lower()] = make


def encoder(kind: str) -> Encoder:
    """The encoder of that kind; an unknown one is an error that names those there are."""
    if kind.lower() not in _known:
        raise ValueError(f"no encoder {kind!r}; there are {', '.join(map(repr, sorted(_known)))}")
    return _known[kind.lower()]()


def chosen(models: list[dict], asked: str | None = None, default: str | None = None) -> dict | None:
    """Of an index's models (key, name, revision) the one asked for by key or name, else its default, else the first; one that was asked for and isn't there is an error."""
    wanted = asked or default
    found = next((m for m in models if wanted in (m.get("key"), m.get("name"))), None)
    if found is None and asked:
        raise ValueError(f"the index has no vectors of {asked!r}")
    return found or next(iter(models), None)


def hashed(values: Sequence, dimensions: int) -> list[list[float]]:
    """Unit vectors that follow from the bytes alone, for tests."""
    out = []
    for value in values:
        raw = np.frombuffer(shake_128(value.encode() if isinstance(value, str) else value).digest(2 * dimensions), np.int16).astype(float)
        out.append((raw / (np.linalg.norm(raw) or 1)).tolist())
    return out


def hashing(dimensions: int = 64) -> Encoder:
    make = lambda: lambda values: hashed(values, dimensions)
    return Encoder("hash", dimensions, make, make)


register("hash", hashing)
