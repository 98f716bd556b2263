"""Tables among the items of a page, and their Markdown."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations, groupby

from ..functions.textrules import UNIT_MARKS
from .spacing import Item

_NUMBER = re.compile(r"(?=.*[0-9])[0-9.,+-]+")
_FOOTNOTE = re.compile(r"\([0-9]*\)|[0-9]+\)|(?i:notes?:)")
_UNIT = re.compile("|".join(UNIT_MARKS))


@dataclass(frozen=True)
class Mode:
    """Thresholds of a pass over a page: small: tables set smaller than the body; body: in the body's size."""

    small: bool
    least_items: int
    columns: int
    rows: int
    aligned: float
    tolerance: float
    many_columns: int  # rows with several cells: at least one in so many
    filled: float
    data: float


SMALL = Mode(True, 6, 2, 2, 0.5, 40, 3, 1.5, 0.2)
BODY = Mode(False, 9, 3, 3, 0.7, 30, 2, 2.5, 0.3)


@dataclass
class Table:
    columns: list[float]
    rows: list[float]
    cells: list[list[str]]
    items: list[int]  # places in the list given to detect_tables


def looks_like_number(s: str) -> bool:
    return _NUMBER.fullmatch(s.strip()) is not None


def looks_like_data(s: str) -> bool:
    s = s.strip()
    digit, size = re.search("[0-9]", s) is not None, len(s.encode())
    date = size <= 10 and re.fullmatch("[0-9/-]+", s) and re.search("[/-]", s) and len(re.findall("[0-9]", s)) >= 4
    return bool(
        s and (looks_like_number(s) or date or (size <= 10 and s.isalnum() and digit) or (digit and _UNIT.search(s)) or (digit and "(" in s and ")" in s) or (re.search("°[CF]", s) and "to" in s))
    )


def regions(items: list[Item]) -> list[tuple[float, float]]:
    """y ranges of runs of at least four items without a gap of over 30."""
    ys = sorted(i.y for i in items)
    return [(r[0] - 5, r[-1] + 5) for r in _runs(ys, 30) if len(r) >= 4]


def _runs(values: list[float], gap: float) -> list[list[float]]:
    out: list[list[float]] = []
    for v in values:
        if out and abs(v - out[-1][-1]) <= gap:
            out[-1].append(v)
        else:
            out.append([v])
    return out


def strict_regions(items: list[Item]) -> list[tuple[float, float]]:
    """y ranges where at least three rows of three or more x clusters follow closely and share their x positions."""
    rows: list[tuple[float, list[float]]] = []
    for i in items:
        row = next((r for r in rows if abs(r[0] - i.y) < 8), None)
        if row:
            row[1].append(i.x)
        else:
            rows.append((i.y, [i.x]))
    several = []
    for y, xs in rows:
        starts: list[float] = []
        for x in sorted(xs):
            if not starts or x - starts[-1] > 20:
                starts.append(x)
        if len(starts) >= 3:
            several.append((y, starts))
    several.sort(key=lambda r: -r[0])
    found = []
    run: list[tuple[float, list[float]]] = []
    for r in [*several, None]:
        if r and (not run or run[-1][0] - r[0] <= 25):
            run.append(r)
            continue
        if len(run) >= 3 and _shared(run) >= 0.5:
            found.append((run[-1][0] - 5, run[0][0] + 5))
        run = [r] if r else []
    return found


def _shared(rows: list[tuple[float, list[float]]]) -> float:
    def score(a: list[float], b: list[float]) -> float:
        near = lambda p, q: sum(any(abs(x - z) < 10 for z in q) for x in p)
        return (near(a, b) + near(b, a)) / (2 * max(len(a), len(b)))

    scores = [score(a, b) for (_, a), (_, b) in combinations(rows, 2)]
    return sum(scores) / len(scores)


def column_positions(items: list[Item], mode: Mode) -> list[float]:
    """Means of clusters of x that enough items stand in; none if one of them holds most of a body-size region."""
    xs = sorted(i.x for i in items)
    if not xs:
        return []
    near = min(50.0, max(25.0, (xs[-1] - xs[0]) / (len(xs) - 1) if len(xs) > 1 else 25.0))
    clusters: list[list[float]] = []
    for x in xs:
        if clusters and x - sum(clusters[-1]) / len(clusters[-1]) <= near:
            clusters[-1].append(x)
        else:
            clusters.append([x])
    centres = [sum(c) / len(c) for c in clusters]
    counts = [sum(abs(x - c) < near for x in xs) for c in centres]
    least = max(2, len(xs) // len(centres) // 4)
    kept = [(c, n) for c, n in zip(centres, counts, strict=True) if n >= least]
    if not mode.small and any(n > 0.6 * len(xs) for _, n in kept):
        return []
    return [c for c, _ in kept]


def row_positions(items: list[Item]) -> list[float]:
    """Means of clusters of y from the top."""
    sizes = sorted(i.font_size for i in items)
    near = max(4.0, 0.8 * sizes[len(sizes) // 2])
    clusters: list[list[float]] = []
    for y in sorted((i.y for i in items), reverse=True):
        if clusters and sum(clusters[-1]) / len(clusters[-1]) - y < near:
            clusters[-1].append(y)
        else:
            clusters.append([y])
    return [sum(c) / len(c) for c in clusters]


def _nearest(centres: list[float], value: float, within: float) -> int | None:
    k = min(range(len(centres)), key=lambda i: abs(centres[i] - value))
    return k if abs(centres[k] - value) < within else None


def column_index(columns: list[float], x: float) -> int | None:
    gaps = [b - a for a, b in zip(columns[:-1], columns[1:], strict=True)]
    return _nearest(columns, x, min(50.0, max(25.0, min(gaps) / 2)) if gaps else 50.0)


def row_index(rows: list[float], y: float) -> int | None:
    return _nearest(rows, y, 15.0)


def cell_text(items: list[Item]) -> str:
    """Texts with a blank between them, but for hyphens, and for smaller ones set higher or lower than their neighbours."""
    out = ""
    for i, item in enumerate(items):
        text = item.text.strip()
        if not text:
            continue
        if out and not (out.endswith("-") or text.startswith("-") or _raised(items[i - 1], item)):
            out += " "
        out += text
    return out


def _raised(prev: Item, cur: Item) -> bool:
    small, large = sorted((prev.font_size, cur.font_size))
    return small < 0.85 * large and abs(prev.y - cur.y) > 1


def first_row(cells: list[list[list[Item]]]) -> int:
    """Where the table begins below the lines of a form that stand above it; 0 if nowhere."""

    def facts(row: list[list[Item]]) -> tuple[bool, int, float]:
        texts = [t for t in map(cell_text, row) if t]
        form = any((t.endswith(":") and len(t.encode()) > 1) or ": " in t for t in texts)
        return form, sum(map(looks_like_number, texts)), len(texts) / max(1, len(row))

    known = [facts(r) for r in cells]
    for k, (form, numbers, fill) in enumerate(known):
        if form:
            continue
        if numbers >= 2 or fill >= 0.4:
            return k
        if fill >= 0.3 and k + 1 < len(known) and not known[k + 1][0] and (known[k + 1][1] >= 2 or known[k + 1][2] >= 0.4):
            return k
    return 0


def is_key_value(cells: list[list[str]]) -> bool:
    filled = [sum(bool(c) for c in r) for r in cells]
    label = lambda s: s.endswith(":") or (len(s.encode()) > 3 and all(c.isupper() or c.isspace() or c in "()" for c in s))
    n = len(cells)
    return n > 0 and len(cells[0]) <= 6 and sum(f <= 2 for f in filled) > 0.7 * n and sum(label(r[0].strip()) for r in cells if r[0]) > 0.5 * n


def is_consistent(cells: list[list[str]]) -> bool:
    if len(cells) < 3:
        return True
    filled = [sum(bool(c) for c in r) for r in cells]
    counts = Counter(filled)
    mode = min(counts, key=lambda f: (-counts[f], f), default=0)
    return sum(abs(f - mode) <= 2 for f in filled) > 0.4 * len(cells)


def has_data(cells: list[list[str]], mode: Mode) -> bool:
    body = [c for r in cells[1:] for c in r if c.strip()]
    return bool(body) and ((mode.small and len(cells[0]) >= 5) or sum(map(looks_like_data, body)) / len(body) > mode.data)


def is_contents(cells: list[list[str]]) -> bool:
    """A table of contents: leaders of dots, and page numbers."""
    every = [c.strip() for r in cells for c in r if c.strip()]
    dots = sum(c.count(".") >= 3 and c.count(".") > len(c.encode()) / 2 for c in every)
    pages = sum(c.isascii() and c.isdigit() and len(c) <= 4 for c in every)
    n = len(every)
    return n > 0 and (dots > 0.15 * n or (dots > 0.05 * n and pages > 0.15 * n))


def _region_table(own: list[tuple[int, Item]], mode: Mode) -> Table | None:
    items = [i for _, i in own]
    columns = column_positions(items, mode)
    if not mode.columns <= len(columns) <= 15:
        return None
    rows = row_positions(items)
    if len(rows) < mode.rows or sum(any(abs(i.x - c) < mode.tolerance for c in columns) for i in items) < mode.aligned * len(items):
        return None
    grid: list[list[list[Item]]] = [[[] for _ in columns] for _ in rows]
    placed = []
    for at, i in own:
        r, c = row_index(rows, i.y), column_index(columns, i.x)
        if r is not None and c is not None:
            grid[r][c].append(i)
            placed.append((at, i))
    top = first_row(grid)
    claimed = [at for at, i in placed if not any(abs(i.y - y) < 15 for y in rows[:top])]
    grid, rows = grid[top:], rows[top:]
    cells = [[cell_text(sorted(c, key=lambda i: i.x)) for c in r] for r in grid]
    filled = [sum(bool(c) for c in r) for r in cells]
    n = len(cells)
    good = (
        sum(bool(r[0]) for r in cells) >= n // 2 and sum(f >= 2 for f in filled) >= max(1, n // mode.many_columns) and n <= 200 and sum(filled) / n >= mode.filled
        and not is_key_value(cells) and is_consistent(cells) and has_data(cells, mode) and not is_contents(cells)
    )
    return Table(columns, rows, cells, claimed) if good else None


def detect_tables(items: list[Item], base: float) -> list[Table]:
    """Tables of a page: first among items set smaller than the body, then among the rest in the body's size."""
    out: list[Table] = []
    claimed: set[int] = set()
    if len(items) < SMALL.least_items:
        return out
    for mode, low, high, find in ((SMALL, 6.0, base * 0.90, regions), (BODY, max(6.0, base * 0.85), base * 1.05, strict_regions)):
        some = [(k, i) for k, i in enumerate(items) if k not in claimed and low <= i.font_size <= high]
        if len(some) < mode.least_items:
            continue
        for a, b in find([i for _, i in some]):
            own = [(k, i) for k, i in some if a <= i.y <= b and k not in claimed]
            if len(own) >= mode.least_items and (table := _region_table(own, mode)):
                out.append(table)
                claimed.update(table.items)
    return out


def clean_cells(cells: list[list[str]]) -> tuple[list[list[str]], list[str]]:
    """Rows without empty ones; footnotes apart; a row without a first cell goes on in the row above."""
    rows: list[list[str]] = []
    notes: list[str] = []
    for r in cells:
        texts = [c.strip() for c in r]
        whole = " ".join(c for c in texts if c)
        if not whole:
            continue
        if _FOOTNOTE.match(texts[0]):
            notes.append(whole)
        elif not texts[0] and rows:
            rows[-1] = [f"{a} {b}".strip() if b else a for a, b in zip(rows[-1], texts, strict=True)]
        else:
            rows.append(texts)
    return rows, notes


def table_to_markdown(cells: list[list[str]]) -> str:
    rows, notes = clean_cells(cells)
    if not rows:
        return ""
    widths = [max(3, *(len(r[c].encode()) for r in rows)) for c in range(len(rows[0]))]
    shown = ["|" + "|".join(f" {x.ljust(w)} " for x, w in zip(r, widths, strict=True)) + "|" for r in rows]
    shown.insert(1, "|" + "|".join(f" {'-' * w} " for w in widths) + "|")
    return "\n".join(shown) + "\n" + ("\n" + "\n".join(notes) + "\n" if notes else "")


def merge_continuations(tables: dict[int, list[tuple[float, str]]], bare_pages: set[int]) -> dict[int, list[tuple[float, str]]]:
    """A page's only table goes on on the next page if that holds nothing but one table of as many columns."""
    out = {p: list(t) for p, t in tables.items()}
    width = lambda md: md.split("\n")[1].count("|") - 1 if md.count("\n") > 1 else 0
    chain = lambda p: p[1] - p[0]
    single = [p for p in sorted(tables) if len(tables[p]) == 1]
    for _, run in groupby(enumerate(single), key=chain):
        first = None
        for _, p in run:
            (y, md) = out[p][0]
            if first is not None and p in bare_pages and width(md) == width(out[first][0][1]):
                out[first][0] = (out[first][0][0], out[first][0][1] + "\n".join(md.split("\n")[2:]))
                out[p] = []
            else:
                first = p
    return {p: t for p, t in out.items() if t}
