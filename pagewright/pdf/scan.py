"""Which pages to look at, and what a look at their content counts; the same rules as the Columns of operators.detect."""

from __future__ import annotations

import re

_SHOW = re.compile(rb"T[jJ](?:[ \t\n\f\r]|\Z)")
_DRAW = re.compile(rb"Do(?:[ \t\n\f\r]|\Z)")


def sample(n: int, k: int) -> list[int]:
    if n <= k:
        return list(range(1, n + 1))
    step = (n - 2) // (k - 1) if k > 1 else 0
    return sorted({1, n, *(p for i in range(1, k - 1) if 1 < (p := 1 + step * i) < n)})


def count_operators(content: bytes) -> tuple[int, bool]:
    return len(_SHOW.findall(content)), _DRAW.search(content) is not None
