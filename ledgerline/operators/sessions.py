"""Session ids: drawn at random, never zero, never one that is live."""

from __future__ import annotations

import secrets
from collections.abc import Callable, Collection

from ..schema import unsigned_pattern

DRAWS = 8


def create(live: Collection[int], draw: Callable[[], int] = lambda: secrets.randbits(64)) -> int | None:
    """A new id as a bit pattern, or None if every draw was zero or live."""
    for _ in range(DRAWS):
        s = unsigned_pattern(draw())
        if s and s not in live:
            return s
    return None
