"""Calls that may fail: retries with jitter, and queries that end in time (STR-05, STR-08)."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

X = TypeVar("X")
ATTEMPTS, FIRST_S, MOST_S = 3, 0.5, 8.0


def waits(attempts: int = ATTEMPTS, first: float = FIRST_S, most: float = MOST_S, draw: Callable[[], float] = random.random) -> Iterator[float]:
    """Seconds to wait after each failure but the last: any time up to a bound that doubles."""
    for k in range(attempts - 1):
        yield draw() * min(most, first * 2**k)


def retry(call: Callable[[], X], attempts: int = ATTEMPTS, first: float = FIRST_S, on: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep) -> X:
    """What call() gives, tried again after failures of the kinds named."""
    pauses = waits(attempts, first)
    while True:
        try:
            return call()
        except on:
            pause = next(pauses, None)
            if pause is None:
                raise
            sleep(pause)


class Unfinished(RuntimeError):
    """A query that was stopped before its end: what it wrote is a part."""


def within(query, seconds: float) -> None:
    """Waits for a streaming query, and stops it after so many seconds; a part never passes for the whole."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise Unfinished(f"stopped after {seconds:g} s")
    if query.exception() is not None:
        raise Unfinished(str(query.exception()))
