"""Content streams: what is shown where.

Deliberately kept habits: leading is 1.2 times the font size, Td moves by text space units without the text
matrix, blank text neither shows nor advances, q and Q save the matrix alone, and a form's own matrix doesn't
count.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from ..functions.textrules import BOLD_NAMES, ITALIC_NAMES, LIGATURES
from .fonts import Font, load_fonts
from .objects import Document, Lexer, Name, Op, Ref, Stream

_LIGATURES = str.maketrans(LIGATURES)
_ANY_LIGATURE = re.compile("[" + "".join(LIGATURES) + "]")
_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_INLINE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


@lru_cache(1024)
def is_bold(name: str) -> bool:
    n = name.lower()
    return any(x in n for x in BOLD_NAMES) or ("medium" in n and "mediumitalic" not in n)


@lru_cache(1024)
def is_italic(name: str) -> bool:
    return any(x in name.lower() for x in ITALIC_NAMES)


def times(m: Matrix, n: Matrix) -> Matrix:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def operations(data: bytes):
    """(operator, operands); inline images are stepped over, operands without an operator dropped."""
    lex, operands = Lexer(data), []
    while True:
        try:
            x = lex.next()
        except EOFError:
            return
        if not isinstance(x, Op):
            operands.append(x)
            continue
        if x == "BI":
            m = _INLINE_END.search(data, lex.at)
            lex.at = m.end() if m else len(data)
        else:
            yield x, operands
        operands = []


def _numbers(operands: list, default: tuple) -> tuple:
    values = [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None for v in operands[: len(default)]]
    values += [None] * (len(default) - len(values))
    return tuple(d if v is None else v for v, d in zip(values, default, strict=True))


@dataclass
class Interpreter:
    """Runs the content of a page, or of one of its forms, which run no forms of their own."""

    doc: Document
    page: int
    fonts: dict[str, Font]
    xobjects: dict[str, tuple[str, Any]]
    ctm: Matrix = IDENTITY
    form: bool = False
    items: list[dict] = field(default_factory=list)

    def run(self, data: bytes) -> list[dict]:
        tm = line = IDENTITY
        saved: list[Matrix] = []
        in_text, font, size = False, None, 12.0
        for op, args in operations(data):
            if op == "q" and not self.form:
                saved.append(self.ctm)
            elif op == "Q" and not self.form:
                self.ctm = saved.pop() if saved else self.ctm
            elif op == "cm" and not self.form:
                self.ctm = times(_numbers(args, IDENTITY), self.ctm)
            elif op == "BT":
                tm = line = IDENTITY
                in_text = True
            elif op == "ET":
                in_text = False
            elif op == "Tf" and len(args) >= 2:
                font = self.fonts.get(str(args[0])) or Font(str(args[0]), str(args[0]), "", named=self.doc.font_maps.named(str(args[0])))
                size = float(args[1]) if isinstance(args[1], (int, float)) else size
            elif op in ("Td", "TD"):
                dx, dy = _numbers(args, (0.0, 0.0))
                at = tm if self.form else line
                tm = line = (*at[:4], at[4] + dx, at[5] + dy)
            elif op == "Tm":
                tm = line = _numbers(args, IDENTITY)
            elif op == "T*" and not self.form:
                tm = line = (*line[:4], line[4], line[5] - 1.2 * size)
            elif op == "Tj" and in_text and args and isinstance(args[0], bytes):
                tm = self._show(args[0] and [args[0]] or [], font, size, tm)
            elif op == "TJ" and in_text and args and isinstance(args[0], list):
                tm = self._show(args[0], font, size, tm)
            elif op == "'" and not self.form and args and isinstance(args[0], bytes):
                tm = line = (*line[:4], line[4], line[5] - 1.2 * size)
                self._show([args[0]], font, size, tm, measured=False)
            elif op == "Do" and not self.form and args:
                self._do(str(args[0]))
        return self.items

    def _show(self, parts: list, font: Font | None, size: float, tm: Matrix, measured: bool = True) -> Matrix:
        """One item for all parts; numbers among them move back, and by enough of a move a blank is meant."""
        font = font or Font("", "", "")
        limit = 120.0 if font.widths is None else min(200.0, max(80.0, font.space_width * font.scale * 1000 * 0.4))
        text, width = "", 0.0
        for p in parts:
            if isinstance(p, bytes):
                text += font.decode(p)
                width += font.width(p, size)
            elif isinstance(p, (int, float)):
                width -= p / 1000 * size
                if p < -limit and text and not text.endswith(" "):
                    text += " "
        text = _CONTROLS.sub("", text)
        if not text.isascii() and _ANY_LIGATURE.search(text):
            text = text.translate(_LIGATURES)
        if not text.strip():
            return tm
        at = times(tm, self.ctm)
        known = measured and font.widths is not None
        shown = size * max(math.hypot(tm[0], tm[1]), math.hypot(tm[2], tm[3]))
        self._item(text, at[4], at[5], abs(width * at[0]) if known else 0.0, shown, shown, font.resource, font.base_name or font.resource)
        return times((1.0, 0.0, 0.0, 1.0, width, 0.0), tm) if known else tm

    def _item(self, text: str, x: float, y: float, width: float, height: float, size: float, font: str = "", style: str = "", kind: str = "text", url: str | None = None) -> None:
        self.items.append({
            "page": self.page, "text": text, "x": x, "y": y, "width": width, "height": height, "font": font, "font_size": size, "is_bold": is_bold(style),
            "is_italic": is_italic(style), "item_type": kind, "url": url,
        })

    def _do(self, name: str) -> None:
        kind, stream = self.xobjects.get(name, (None, None))
        if kind == "Image":
            self._item(f"[Image: {name}]", self.ctm[4], self.ctm[5], abs(self.ctm[0]), abs(self.ctm[3]), 0.0, kind="image")
        elif kind == "Form":
            own = load_fonts(self.doc, stream.dict.get("Resources"), by_reference=True)
            self.items += Interpreter(self.doc, self.page, own, {}, self.ctm, form=True).run(self.doc.decoded(stream))


def page_xobjects(doc: Document, page: dict) -> dict[str, tuple[str, Stream]]:
    """Images and forms that the page's own resources refer to."""
    found = {}
    for name, ref in doc.dict_of(doc.dict_of(page.get("Resources")).get("XObject")).items():
        stream = doc.resolve(ref)
        if isinstance(ref, Ref) and isinstance(stream, Stream):
            found[name] = (str(doc.resolve(stream.dict.get("Subtype"))), stream)
    return found


def page_links(doc: Document, page: dict, number: int) -> list[dict]:
    """Link annotations that have a rectangle and a URI, as items."""
    box = Interpreter(doc, number, {}, {})
    for a in map(doc.dict_of, doc.list_of(page.get("Annots"))):
        if doc.resolve(a.get("Subtype", Name("Link"))) != "Link":
            continue
        r = [doc.number_of(x) for x in doc.list_of(a.get("Rect"))]
        uri = doc.resolve(doc.dict_of(a.get("A")).get("URI"))
        if len(r) >= 4 and isinstance(uri, bytes):
            url = uri.decode("utf-8", "replace")
            box._item(url, r[0], r[1], r[2] - r[0], r[3] - r[1], 0.0, kind="link", url=url)
    return box.items


def page_items(doc: Document, page: dict, number: int) -> list[dict]:
    """Text, images and then links of a page, in the order of its streams."""
    it = Interpreter(doc, number, load_fonts(doc, page.get("_Resources")), page_xobjects(doc, page))
    return it.run(b"\n".join(doc.contents(page))) + page_links(doc, page, number)


def page_images(doc: Document, page: dict) -> list[tuple[int, int]]:
    """(width, height) of the page's images, in pixels; 0 where unknown."""
    return [(int(doc.number_of(s.dict.get("Width"))), int(doc.number_of(s.dict.get("Height")))) for kind, s in page_xobjects(doc, page).values() if kind == "Image"]
