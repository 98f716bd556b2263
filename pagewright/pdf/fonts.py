"""Glyph names, ToUnicode maps, encodings and widths of fonts."""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass, field
from functools import cache

from .objects import Document, Name, Ref, Stream

# Glyph names that no rule below gives. Typographic double quotes are given as the plain one.
_NAMED = {
    "exclam": "!", "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*",
    "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "greater": ">", "question": "?", "at": "@", "bracketleft": "[",
    "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblbase": "„", "guilsinglleft": "‹", "guilsinglright": "›", "guillemotleft": "«",
    "guillemotright": "»", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "fraction": "⁄",
    "florin": "ƒ", "Euro": "€", "cent": "¢", "sterling": "£", "yen": "¥", "currency": "¤", "section": "§", "paragraph": "¶", "copyright": "©", "registered": "®",
    "trademark": "™", "degree": "°", "plusminus": "±", "multiply": "×", "divide": "÷", "minus": "−", "periodcentered": "·", "exclamdown": "¡", "questiondown": "¿",
    "ordfeminine": "ª", "ordmasculine": "º", "mu": "µ", "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "onesuperior": "¹", "twosuperior": "²",
    "threesuperior": "³", "brokenbar": "¦", "logicalnot": "¬", "macron": "¯", "dieresis": "¨", "acute": "´", "cedilla": "¸", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ",
    "Oslash": "Ø", "oslash": "ø", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß", "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "Aring": "Å",
    "aring": "å", "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ", "infinity": "∞", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "space": " ",
    "nbspace": "\u00a0", "quotedbl": "\"", "quotedblleft": "\"", "quotedblright": "\"", "equal": "=", "f_i": "ﬁ", "f_l": "ﬂ", "f_f": "ﬀ", "f_f_i": "ﬃ", "f_f_l": "ﬄ",
    "partialdiff": "∂", "summation": "∑", "product": "∏", "radical": "√", "approxequal": "≈", "lozenge": "◊", "Lambda": "Λ", "lambda": "λ",
}
_MARKS = {
    "grave": "\u0300", "acute": "\u0301", "circumflex": "\u0302", "tilde": "\u0303", "macron": "\u0304", "breve": "\u0306", "dotaccent": "\u0307", "dieresis": "\u0308",
    "ring": "\u030a", "hungarumlaut": "\u030b", "caron": "\u030c", "cedilla": "\u0327", "ogonek": "\u0328",
}


@cache
def glyph_to_char(name: str) -> str | None:
    """Letters by themselves, letters with an accent by composition, Greek by Unicode's names, uniXXXX and uXXXX (at
    least four digits)."""
    if len(name) == 1 and name.isascii() and name.isalpha():
        return name
    if name in _NAMED:
        return _NAMED[name]
    accent = name[1:]
    if accent in _MARKS and name[0].isascii() and name[0].isalpha():
        one = unicodedata.normalize("NFC", name[0] + _MARKS[accent])
        return one if len(one) == 1 else None
    try:
        if name.isalpha() and name[:1].isupper() and name[1:].islower():
            return unicodedata.lookup(f"GREEK CAPITAL LETTER {name}")
        if name.isalpha() and name.islower():
            return unicodedata.lookup(f"GREEK SMALL LETTER {name}")
    except KeyError:
        pass
    m = re.match(r"uni([0-9A-Fa-f]{4})", name) or re.fullmatch(r"u([0-9A-Fa-f]{4,6})", name)
    code = int(m[1], 16) if m else 0
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _unicode(digits: str) -> str | None:
    """Text of a target in UTF-16, four digits at a time; halves of surrogate pairs go, fewer than four digits give none."""
    out = "".join(chr(c) for i in range(0, len(digits) - 3, 4) if not 0xD800 <= (c := int(digits[i : i + 4], 16)) < 0xE000)
    return out or None


@dataclass
class ToUnicode:
    """Codes to text: single codes, then ranges in their order."""

    width: int = 2
    chars: dict[int, str] = field(default_factory=dict)
    ranges: list[tuple[int, int, int]] = field(default_factory=list)

    @classmethod
    def parse(cls, content: bytes) -> ToUnicode | None:
        """None if nothing is mapped. Codes are one byte if the code space says so, or if all sources are as short."""
        text = content.decode("utf-8", "replace")
        section = lambda kind: re.findall(f"begin{kind}(.*?)end{kind}", text, re.S)
        out, lengths = cls(), []
        for part in section("bfchar"):
            for src, dst in re.findall(r"<\s*([0-9A-Fa-f\s]+)>\s*<\s*([0-9A-Fa-f\s]*)>", part):
                src, dst = re.sub(r"\s", "", src), re.sub(r"\s", "", dst)
                lengths.append(len(src))
                if (value := _unicode(dst)) is not None and int(src, 16) < 65536:
                    out.chars[int(src, 16)] = value
        for part in section("bfrange"):
            for a, b, one, many in re.findall(r"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]+)\s*>\s*(?:<\s*([0-9A-Fa-f]+)\s*>|\[([^\]]*)\])", part):
                low, high = int(a, 16), int(b, 16)
                lengths.append(len(a))
                if one:
                    out.ranges.append((low, high, int(one, 16)))
                else:
                    for code, dst in zip(range(low, high + 1), re.findall(r"<\s*([0-9A-Fa-f]+)\s*>", many), strict=False):
                        if (value := _unicode(dst)) is not None:
                            out.chars[code] = value
        if not out.chars and not out.ranges:
            return None
        space = [len(re.sub(r"\s", "", x)) for s in section("codespacerange")[:1] for x in re.findall(r"<([0-9A-Fa-f\s]+)>", s)]
        short = all(n <= 2 for n in lengths)
        out.width = 1 if short or (space and (space[-1] + 1) // 2 == 1) else 2
        return out

    def lookup(self, code: int) -> str | None:
        if code in self.chars:
            return self.chars[code]
        for low, high, base in self.ranges:
            if low <= code <= high:
                c = base + code - low
                return chr(c) if c < 0x110000 and not 0xD800 <= c < 0xE000 else None
        return None

    def decode(self, raw: bytes) -> str:
        """Empty if more than half of the codes (rounded down) aren't mapped, so that another way is tried. Single
        bytes from a blank up that aren't mapped stand for themselves; a last, half code doesn't count."""
        codes = list(raw) if self.width == 1 else [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw) - 1, 2)]
        out, unmapped = [], 0
        for c in codes:
            value = self.lookup(c)
            if value is None:
                unmapped += 1
                value = chr(c) if self.width == 1 and c >= 32 else ""
            out.append(value)
        return "" if unmapped > len(codes) // 2 else "".join(out)


@dataclass
class Font:
    """What showing text needs: decoders, and widths in thousandths of the font size (or the font's own units)."""

    resource: str
    base_name: str
    subtype: str
    cmap: ToUnicode | None = None
    differences: dict[int, str] = field(default_factory=dict)
    codec: str | None = None
    widths: dict[int, float] | None = None
    default_width: float = 0.0
    space_width: float = 250.0
    scale: float = 0.001
    named: list[ToUnicode] = field(default_factory=list)  # maps found by the font's names

    @property
    def wide(self) -> bool:
        return self.subtype == "Type0"

    def width(self, raw: bytes, size: float) -> float:
        if self.widths is None:
            return 0.0
        codes = [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw) - 1, 2)] if self.wide else raw
        return sum(self.widths.get(c, self.default_width) for c in codes) * self.scale * size

    def decode(self, raw: bytes) -> str:
        """The first way that gives text: the font's own ToUnicode map, maps found by its names, Differences, the base
        encoding, UTF-16 with its mark, Latin-1."""
        for cmap in [self.cmap] * (self.cmap is not None) + self.named:
            if text := cmap.decode(raw):
                return text
        if self.differences and any(c in self.differences for c in raw):
            return "".join(self.differences.get(c) or (chr(c) if c >= 32 else "") for c in raw)
        if self.codec and not self.wide:
            return raw.decode(self.codec, "replace").replace("�", "")
        if raw.startswith(b"\xfe\xff"):
            return raw[2:].decode("utf-16-be", "replace")
        return raw.decode("latin-1")


_CODECS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}


class FontMaps:
    """ToUnicode maps of a file's raw bytes, by the numbers of their objects and by the names of their fonts.

    A look at the bytes finds what references in a damaged or linearized file don't. by_name holds names of base
    fonts (of several maps the last one's) and those names with the number of the map's object.
    """

    def __init__(self, data: bytes):
        numbers = dict.fromkeys(int(n) for n in re.findall(rb"/ToUnicode[ \r\n]*([0-9]{1,9})", data))
        found = {n: ToUnicode.parse(raw) for n in numbers if (raw := raw_stream(data, n)) is not None}
        self.by_number = {n: cmap for n, cmap in found.items() if cmap}
        self.by_name: dict[str, ToUnicode] = {}
        for m in re.finditer(rb"/Type /Font", data):
            start, end = data.rfind(b"<<", 0, m.start()), data.find(b">>", m.start())
            if start < 0 or end < 0:
                continue
            name = re.search(rb"/BaseFont[ \r\n]*/([^ \t\n\x0c\r/>]+)", data[start:end])
            number = re.search(rb"/ToUnicode[ \r\n]*([0-9]{1,9})", data[start:end])
            cmap = self.by_number.get(int(number[1])) if number else None
            if name and cmap:
                base = name[1].decode("latin-1")
                self.by_name[f"{base}_{int(number[1])}"] = self.by_name[base] = cmap

    def get(self, name: str) -> ToUnicode | None:
        """By the name, else by the first name, in their order, that holds it or that it holds; a leading F and names of
        fewer than four characters don't count there."""
        if name in self.by_name:
            return self.by_name[name]
        bare = name.removeprefix("F")
        near = (n for n in sorted(self.by_name) if bare in n or n in bare) if len(bare.encode()) >= 4 else ()
        return next((self.by_name[n] for n in near), None)

    def named(self, *names: str) -> list[ToUnicode]:
        return [cmap for n in names if (cmap := self.get(n))]


def raw_stream(data: bytes, number: int) -> bytes | None:
    """The stream of an object by a look at the bytes alone; as it stands where it can't be inflated."""
    at = data.find(b"%d 0 obj" % number)
    m = re.compile(rb"stream\r?\n?").search(data, at) if at >= 0 else None
    end = data.find(b"endstream", m.end()) if m else -1
    if end < 0:
        return None
    raw = re.sub(rb"\r?\n?\Z", b"", data[m.end() : end], count=1)
    if b"FlateDecode" in data[at : m.start()]:
        try:
            return zlib.decompress(raw)
        except zlib.error:
            return raw
    return raw


def load_fonts(doc: Document, resources: object, by_reference: bool = False) -> dict[str, Font]:
    """Fonts of a resource dictionary by their names there; by_reference: those alone that it refers to."""
    known = doc.dict_of(doc.dict_of(resources).get("Font")).items()
    return {name: load_font(doc, name, doc.dict_of(f)) for name, f in known if isinstance(f, Ref) or not by_reference}


def load_font(doc: Document, name: str, d: dict) -> Font:
    base = doc.resolve(d.get("BaseFont"))
    font = Font(name, str(base or name), str(doc.resolve(d.get("Subtype")) or ""), named=doc.font_maps.named(*([str(base)] if base else []), name))
    stream = doc.resolve(d.get("ToUnicode"))
    if isinstance(stream, Stream):
        font.cmap = ToUnicode.parse(doc.decoded(stream))
    encoding = doc.resolve(d.get("Encoding"))
    if isinstance(encoding, Name):
        font.codec = _CODECS.get(encoding)
    elif isinstance(encoding, dict):
        font.codec = _CODECS.get(doc.resolve(encoding.get("BaseEncoding")))
        code = 0
        for x in map(doc.resolve, doc.list_of(encoding.get("Differences"))):
            if isinstance(x, Name):
                if (c := glyph_to_char(str(x))) is not None:
                    font.differences[code & 255] = c
                code += 1
            elif isinstance(x, (int, float)):
                code = int(x)
    if font.wide:
        _wide_widths(doc, font, doc.dict_of(next(iter(doc.list_of(d.get("DescendantFonts"))), None)))
    elif font.subtype in ("Type1", "TrueType", "MMType1", "Type3"):
        _simple_widths(doc, font, d)
    return font


def _simple_widths(doc: Document, font: Font, d: dict) -> None:
    if any(k not in d for k in ("FirstChar", "LastChar", "Widths")):
        return
    first = int(doc.number_of(d["FirstChar"]))
    values = [doc.resolve(w) for w in doc.list_of(d["Widths"])]
    font.widths = {first + i: w for i, w in enumerate(values) if isinstance(w, (int, float))}
    font.space_width = font.widths.get(32, 250.0)
    matrix = doc.list_of(d.get("FontMatrix"))
    if matrix:
        font.scale = abs(doc.number_of(matrix[0], 0.001))


def _wide_widths(doc: Document, font: Font, d: dict) -> None:
    font.widths, font.default_width = {}, doc.number_of(d.get("DW"), 1000)
    w = [doc.resolve(x) for x in doc.list_of(d.get("W"))]
    i = 0
    while i + 1 < len(w):
        if isinstance(w[i + 1], list):
            font.widths.update({int(w[i]) + k: doc.number_of(x) for k, x in enumerate(w[i + 1])})
            i += 2
        elif i + 2 < len(w):
            font.widths.update(dict.fromkeys(range(int(w[i]), min(int(w[i + 1]), 65535) + 1), doc.number_of(w[i + 2])))
            i += 3
        else:
            break
    font.space_width = font.widths.get(32) or font.widths.get(3) or (font.default_width / 4 or 250.0)


