"""Semantic versions in order, and delays between tries."""

from __future__ import annotations

import random
import re


def version_key(version: str) -> tuple:
    """Sorts as semantic versions do: a prerelease is before its release, numbers before words."""
    core, _, pre = version.strip().removeprefix("v").partition("+")[0].partition("-")
    numbers = [int(m[0]) if (m := re.match(r"\d+", x)) else 0 for x in core.split(".")][:3]
    parts = [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in pre.split(".")] if pre else []
    return (*numbers, *([0] * (3 - len(numbers))), not pre, parts)


def is_newer(candidate: str, current: str) -> bool:
    return version_key(candidate) > version_key(current)


RETRYABLE = frozenset({429, 500, 502, 503, 504})


def retry_delay(attempt: int, base: float, draw: random.Random | None = None) -> float:
    """The base itself first, then doubled each time and scaled by a uniform draw from a half to one."""
    return base if attempt <= 0 else base * 2**attempt * (draw or random.Random()).uniform(0.5, 1.0)
