"""Markdown of a document from its items or lines, before the cleaning that functions.markdown does as Columns."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import replace

from ..functions.markdown import MarkdownOptions
from ..functions.textrules import BULLETS, CAPTION_ANY_CASE, CAPTION_PREFIXES, MONOSPACE_NAMES
from .lines import group_into_lines
from .spacing import Item, Line
from .tables import detect_tables, merge_continuations, table_to_markdown

Objects = dict[int, list[tuple[float, str]]]
_BULLET = re.compile(rf"[-*{BULLETS}] |[A-Za-z][.)]|\(.\)", re.S)


def is_caption(text: str) -> bool:
    return text.startswith(CAPTION_PREFIXES) or text.lower().startswith(CAPTION_ANY_CASE)


def is_list_item(text: str) -> bool:
    t = text.lstrip()
    return _BULLET.match(t) is not None or (re.search("[0-9]", t[:5]) is not None and re.match(r"[0-9]*[.)]", t[:5]) is not None)


def format_list_item(text: str) -> str:
    t = text.lstrip()
    return "- " + t[1:].lstrip() if t[:1] and t[0] in BULLETS else t


def is_monospace(font: str) -> bool:
    return any(n in font.lower() for n in MONOSPACE_NAMES)


def base_size(sizes: list[float]) -> float:
    """The commonest size from 9 up, in tenths; the smaller of equally common ones; 12 without any."""
    counts = Counter(int(s * 10) for s in sizes if s >= 9)
    return min(counts, key=lambda k: (-counts[k], k)) / 10 if counts else 12.0


def _size(line: Line, base: float) -> float:
    return line.items[0].font_size if line.items else base


def heading_tiers(lines: list[Line], base: float) -> list[float]:
    tiers: list[float] = []
    for s in sorted({_size(x, base) for x in lines}, reverse=True):
        if base and s / base >= 1.2 and (not tiers or tiers[-1] - s > 0.5):
            tiers.append(s)
    return tiers[:4]


def header_level(size: float, base: float, tiers: list[float]) -> int | None:
    ratio = size / base if base else 0.0
    if ratio < 1.2:
        return None
    if not tiers:
        return 1 if ratio >= 2 else 2 if ratio >= 1.5 else 3 if ratio >= 1.25 else 4
    near = next((k for k, t in enumerate(tiers, 1) if abs(t - size) <= 0.5), None)
    return near or (min(len(tiers) + 1, 4) if ratio >= 1.5 else None)


def paragraph_threshold(lines: list[Line], base: float) -> float:
    gaps = sorted(g for a, b in zip(lines[:-1], lines[1:], strict=True) if a.page == b.page and 0 < (g := a.y - b.y) < base * 10)
    return base * 1.8 if len(gaps) < 5 else max(gaps[len(gaps) // 2] * 1.3, base * 1.5)


def merge_drop_caps(lines: list[Line], base: float) -> list[Line]:
    """A large initial goes to the first line of its page so far that begins a paragraph in lower case; it goes in any case."""
    out: list[Line] = []
    lower = lambda line: line.text().strip()[:1].islower()
    for line in lines:
        text = line.text().strip()
        if not (0 < len(text.encode()) <= 2 and text[0].isupper() and _size(line, 0.0) >= base * 2.5):
            out.append(line)
            continue
        for k, target in enumerate(out):
            starts = k == 0 or (out[k - 1].text().strip() and not lower(out[k - 1]))
            if target.page == line.page and lower(target) and starts:
                first = target.items[0]
                out[k] = replace(target, items=[replace(first, text=text[0] + first.text.strip()), *target.items[1:]])
                break
    return out


def merge_headings(lines: list[Line], base: float, tiers: list[float]) -> list[Line]:
    """Lines of one heading, measured from its first line, become one."""
    out: list[Line] = []
    for line in lines:
        size = _size(line, base)
        level, prev = header_level(size, base, tiers), out[-1] if out else None
        if prev and level and prev.page == line.page and header_level(_size(prev, base), base, tiers) == level and 0 < prev.y - line.y < size * 2:
            first = line.items[0]
            prev.items = [*prev.items, replace(first, text=" " + first.text.lstrip()), *line.items[1:]]
        else:
            out.append(Line(list(line.items), line.y, line.page))
    return out


class _Writer:
    """Text pieces in order, and whether a paragraph is open."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.paragraph = False

    def close(self) -> None:
        if self.paragraph:
            self.out.append("\n\n")
        self.paragraph = False

    def block(self, text: str) -> None:
        self.close()
        self.out.append(text)

    def flow(self, text: str) -> None:
        self.out.append((" " if self.paragraph else "") + text)
        self.paragraph = True

    def goes_on(self, text: str) -> None:
        if self.out and self.out[-1].endswith("\n"):
            self.out[-1] = self.out[-1][:-1] + " "
        self.out.append(text + "\n")


class _Placed:
    """Tables and images of all pages, each put out once: before the first line below its top, or at its page's end."""

    def __init__(self, kinds: list[Objects], writer: _Writer):
        self.left = {p: [list(k.get(p, [])) for k in kinds] for p in sorted(set().union(*kinds))}
        self.writer = writer

    def above(self, page: int, y: float) -> None:
        for kind in self.left.get(page, []):
            self._put(kind, lambda top: top > y)

    def rest(self, page: int) -> None:
        for kind in self.left.get(page, []):
            self._put(kind, lambda _: True)

    def between(self, after: int, before: float) -> list[int]:
        return [p for p in self.left if after < p < before]

    def _put(self, kind: list[tuple[float, str]], due) -> None:
        for top, text in [x for x in kind if due(x[0])]:
            self.writer.block("\n" + text + "\n")
        kind[:] = [x for x in kind if not due(x[0])]


def lines_to_markdown(lines: list[Line], options: MarkdownOptions = MarkdownOptions(), tables: Objects | None = None, images: Objects | None = None) -> str:
    """Raw Markdown; lines without objects end their lists at a page's end, those with objects go on."""
    with_objects = tables is not None or images is not None
    base = options.base_font_size or base_size([x.items[0].font_size for x in lines if x.items])
    lines = merge_drop_caps(lines, base)
    tiers = heading_tiers(lines, base)
    lines = merge_headings(lines, base, tiers)
    threshold = paragraph_threshold(lines, base)
    w = _Writer()
    objects = _Placed([tables or {}, images or {}], w)
    page, above, list_x = 0, float("inf"), None
    for line in lines:
        if line.page != page:
            for p in ([page] if page else []) + objects.between(page, line.page):
                objects.rest(p)
                w.block("\n\n")
            page, above = line.page, float("inf")
            list_x = list_x if with_objects else None
        objects.above(page, line.y)
        gap, above = above - line.y, line.y
        if gap > threshold:
            w.close()
        shown, plain = line.text(options.detect_bold, options.detect_italic).strip(), line.text().strip()
        if not shown:
            continue
        if is_caption(plain):
            w.block(shown + "\n\n")
            continue
        level = header_level(_size(line, base), base, tiers) if options.detect_headers and len(plain.encode()) > 3 and len(plain.split()) <= 15 else None
        if level:
            w.block("#" * level + " " + plain + "\n\n")
            list_x = None
            continue
        x = line.items[0].x
        if options.detect_lists and is_list_item(plain):
            w.block(format_list_item(shown) + "\n")
            list_x = x
        elif list_x is not None and list_x - 5 <= x <= list_x + 50 and gap < base * 7 and not is_list_item(plain):
            w.goes_on(shown)
        else:
            list_x = None
            if options.detect_code and any(is_monospace(i.font) for i in line.items):
                w.block(f"```\n{plain}\n```\n")
            else:
                w.flow(shown)
    for p in [page, *objects.between(page, float("inf"))]:
        objects.rest(p)
    return "".join(w.out) + "\n" * w.paragraph


def items_to_markdown(items: list[Item], options: MarkdownOptions = MarkdownOptions()) -> str:
    """Raw Markdown of a document's items: tables first, what they leave as lines. Links aren't put out."""
    text = [i for i in items if i.item_type == "text"]
    base = options.base_font_size or base_size([i.font_size for i in text])
    images: Objects = defaultdict(list)
    if options.include_images:
        for i in items:
            if i.item_type == "image":
                images[i.page].append((i.y, f"![{i.text.strip('[]')}](image)"))
    by_page: dict[int, list[Item]] = defaultdict(list)
    for i in text:
        by_page[i.page].append(i)
    tables: Objects = {}
    rest: list[Item] = []
    for page in sorted(by_page):
        own = by_page[page]
        found = detect_tables(own, base)
        if found:
            tables[page] = [(t.rows[0] if t.rows else 0.0, table_to_markdown(t.cells)) for t in found]
        gone = {k for t in found for k in t.items}
        rest += [i for k, i in enumerate(own) if k not in gone]
    bare = set(tables) - {i.page for i in rest}
    return lines_to_markdown(group_into_lines(rest), options if options.base_font_size else replace(options, base_font_size=base), merge_continuations(tables, bare), dict(images))
