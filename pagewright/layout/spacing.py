"""Whether neighbouring items of a line belong to one word."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

_SINGLE = struct.Struct("5f")
_CJK = re.compile("[　-ヿ一-鿿豈-﫿＀-￯]")
#: Characters that never have a blank before them.
_CLOSING = ".,;!?)]}'"


@dataclass(slots=True)
class Item:
    text: str
    x: float
    y: float
    width: float = 0.0
    height: float = 0.0
    font: str = ""
    font_size: float = 12.0
    page: int = 1
    is_bold: bool = False
    is_italic: bool = False
    item_type: str = "text"
    seq: int = 0

    @classmethod
    def of(cls, row: dict, seq: int) -> Item:
        """From a row of a content stream; coordinates have 24 bits, as items in tables have."""
        x, y, width, height, size = _SINGLE.unpack(_SINGLE.pack(*(row[k] for k in ("x", "y", "width", "height", "font_size"))))
        return cls(row["text"], x, y, width, height, row["font"], size, row["page"], row["is_bold"], row["is_italic"], row["item_type"], seq)

    @property
    def span(self) -> float:
        """Width, or a guess where it isn't known."""
        return self.width if self.width > 0 else len(self.text) * self.font_size * 0.5


@dataclass(slots=True)
class Line:
    items: list[Item]
    y: float
    page: int

    def text(self, bold: bool = False, italic: bool = False) -> str:
        return line_text(self.items, bold, italic)


def has_cjk(text: str) -> bool:
    return _CJK.search(text) is not None


def _numeric_pair(a: str, b: str) -> bool:
    return (a in "0123456789,." and b in "0123456789%.,") or (a in "+-" and b.isascii() and b.isdigit())


def joins(prev: Item, cur: Item) -> bool:
    """Whether cur goes on in the word that prev ends with; the first rule that applies decides."""
    a, b = prev.text, cur.text
    if not a or not b or a[-1] == " " or b[0] == " ":
        return False
    if b[0] in _CLOSING:
        return True
    if a[-1] == ":" and b[0].isalnum():
        return False
    cjk = has_cjk(a[-1]) or has_cjk(b[0])
    if prev.width > 0:
        return _by_gap(prev, cur, cur.x - (prev.x + prev.width), prev.font_size, cjk)
    glyph = prev.font_size * 0.45
    gap = cur.x - (prev.x + len(a) * glyph)
    if cjk:
        return gap < glyph * 0.8
    if a[-1].isalpha() and b[0].isalpha():
        if a[-1].islower() and b[0].isupper():
            return False
        same = a[-1].islower() == b[0].islower() and a[-1].isupper() == b[0].isupper() and (a[-1].islower() or a[-1].isupper())
        return gap < glyph * (0.8 if same else 0.3)
    return gap < glyph * 0.5


def _by_gap(prev: Item, cur: Item, gap: float, size: float, cjk: bool) -> bool:
    a, b = prev.text, cur.text
    if not cjk and 0 <= gap < size * 0.01 and len(a) >= 3 and len(b) >= 2:
        words = a.split()
        if len(words) >= 3:  # a run of text, cut anywhere
            return gap < size * 0.15
        if len(words[-1] if words else "") > 2 and len((b.split() or [""])[0]) > 2:
            return False  # whole words, set without their blank
    if _numeric_pair(a[-1], b[0]):
        return gap < size * 0.3
    if (len(a) == 1) != (len(b) == 1) or (len(a) == 1 and len(b) == 1 and a.isdigit() and b.isdigit()):
        return gap < size * 0.25
    return gap < size * 0.15


def needs_blank(before: str, prev: Item, cur: Item) -> bool:
    if before.endswith(("-", " ")) or cur.text.startswith((" ", "-")) or cur.text.strip() == "-":
        return False
    ratio = cur.font_size / prev.font_size if prev.font_size else 1.0
    raised = (ratio < 0.85 or ratio > 1 / 0.85) and abs(prev.y - cur.y) > 1
    return not raised and not joins(prev, cur)


def line_text(items: list[Item], bold: bool = False, italic: bool = False) -> str:
    """The items' texts with blanks between words; runs of bold and italic items in Markdown's marks."""
    if not bold and not italic:
        out = ""
        for i, item in enumerate(items):
            if i and needs_blank(out, items[i - 1], item):
                out += " "
            out += item.text
        return out
    out, is_bold, is_italic = "", False, False
    for i, item in enumerate(items):
        text = item.text.strip()
        if not text:
            continue
        blank = bool(out) and (needs_blank(out, items[i - 1], item) if i else False) or (bool(out) and item.text[0] == " " and not out.endswith(" "))
        want_bold, want_italic = bold and item.is_bold, italic and item.is_italic
        if is_italic and not want_italic:
            out, is_italic = out + "*", False
        if is_bold and not want_bold:
            out, is_bold = out + "**", False
        out += " " if blank else ""
        if want_bold and not is_bold:
            out, is_bold = out + "**", True
        if want_italic and not is_italic:
            out, is_italic = out + "*", True
        out += text
    return out + ("*" if is_italic else "") + ("**" if is_bold else "")
