"""Items into lines in reading order, over one or several columns."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from itertools import accumulate, groupby

from .spacing import Item, Line

BIN = 2.0
_GAP, _MIN_WIDTH, _MIN_ITEMS, _SIDE = 8.0, 200.0, 20, 10


def is_page_number(item: Item) -> bool:
    t = item.text.strip()
    return 0 < len(t) <= 4 and t.isascii() and t.isdigit() and (item.y > 720 or item.y < 100)


def columns(items: list[Item]) -> list[tuple[float, float]]:
    """x ranges of a page's columns: cut in the middle of empty vertical strips with enough text on both sides."""
    if not items:
        return []
    low, high = min(i.x for i in items), max(i.x + i.span for i in items)
    if high - low < _MIN_WIDTH or len(items) < _MIN_ITEMS:
        return [(low, high)]
    n = math.ceil((high - low) / BIN) + 1
    edges: Counter[int] = Counter()  # ones added at left edges and taken back at right edges
    for i in items:
        a = max(0, math.floor((i.x - low) / BIN))
        b = min(n, math.ceil((i.x + i.span - low) / BIN))
        if a < b:
            edges[a] += 1
            edges[b] -= 1
    # Runs of bins between edges, of as many items each.
    at = sorted({0, n, *edges})
    counts = list(accumulate(edges[k] for k in at[:-1]))
    floor = int(max(counts) * 0.05)
    valleys = []
    for empty, run in groupby(zip(at[:-1], at[1:], counts, strict=True), key=lambda r: r[2] <= floor):
        if empty:
            bins = list(run)
            a, b = low + bins[0][0] * BIN, low + bins[-1][1] * BIN
            centre = (a + b) / 2
            if b - a >= _GAP and 0.05 < (centre - low) / (high - low) < 0.95 and _two_sided(items, centre):
                valleys.append((b - a, centre))
    widest = sorted(valleys, key=lambda v: -v[0])[:3]
    cuts = [low, *sorted(c for _, c in widest), high]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _two_sided(items: list[Item], x: float) -> bool:
    left, right = [i.y for i in items if i.x + i.span <= x], [i.y for i in items if i.x >= x]
    if len(left) < _SIDE or len(right) < _SIDE:
        return False
    ys = [i.y for i in items]
    whole = max(ys) - min(ys)
    return whole <= 0 or (min(max(left), max(right)) - max(min(left), min(right))) / whole >= 0.30


def spans_columns(item: Item, cols: list[tuple[float, float]]) -> bool:
    def covers(a: float, b: float) -> bool:
        over = max(0.0, min(item.x + item.span, b) - max(item.x, a))
        return over > (b - a) * 0.10 or over > 20

    return sum(covers(a, b) for a, b in cols) >= 2


def is_chaotic(items: list[Item]) -> bool:
    moves = [b.y - a.y for a, b in zip(items[:-1], items[1:], strict=True)]
    up, down = sum(m > 50 for m in moves), sum(m < -50 for m in moves)
    return len(items) >= 5 and up + down >= 3 and up / (up + down) > 0.4


def merge_lines(items: list[Item]) -> list[Line]:
    """Lines of one column: an item joins the line before it if it is as high as that line's first item."""
    if is_chaotic(items):
        items = sorted(items, key=lambda i: (-i.y, i.x))
    out: list[Line] = []
    for i in items:
        line = out[-1] if out else None
        if line and i.page == line.page and abs(i.y - line.y) < 3:
            back = i.x < line.items[-1].x - 10 or abs(i.x - line.items[0].x) < 5
            if not (abs(i.y - line.y) > 0.5 and back):
                line.items.append(i)
                continue
        out.append(Line([i], i.y, i.page))
    for line in out:
        line.items.sort(key=lambda i: i.x)
    return out


def _page_lines(items: list[Item]) -> list[Line]:
    cols = columns(items)
    if len(cols) <= 1:
        return merge_lines(items)
    wide, rest = [], []
    for i in items:
        (wide if spans_columns(i, cols) else rest).append(i)
    by_column: list[list[Item]] = [[] for _ in cols]
    starts = [a for a, _ in cols]
    for i in rest:
        centre = i.x + i.span / 2
        k = bisect_right(starts, centre) - 1
        if k >= 0 and centre < cols[k][1]:
            by_column[k].append(i)
    spans = sorted(merge_lines(wide), key=lambda s: -s.y)
    # A line's section: the first span that isn't above it, counting the lines before it in its column.
    placed = [((k, 1, 0, 0), s) for k, s in enumerate(spans)]
    for c, own in enumerate(map(merge_lines, by_column)):
        section = 0
        for n, line in enumerate(own):
            while section < len(spans) and line.y < spans[section].y:
                section += 1
            placed.append(((section, 0, c, n), line))
    return [line for _, line in sorted(placed, key=lambda p: p[0])]


def group_into_lines(items: list[Item]) -> list[Line]:
    """Lines of all pages in order, without page numbers."""
    kept = sorted((i for i in items if not is_page_number(i)), key=lambda i: i.page)
    return [line for _, own in groupby(kept, key=lambda i: i.page) for line in _page_lines(list(own))]
