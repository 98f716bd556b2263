"""Rules on one line of text, one font name or one table cell, as Columns.

All stay in generated code: regular expressions and string functions, no Python on the workers. Null in,
null out. White space is Unicode's, as WS spells it for Java's and RE2's regular expressions alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, running

#: The code points of Unicode White_Space, for a character class.
WS = r"\x{9}-\x{D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The characters of WS.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# What a line must begin with, or hold, to count as a caption, a bullet, code, a font style.
CAPTION_PREFIXES = ("Figure ", "Figura ", "Fig. ", "Fig ", "Table ", "Tabela ", "Source:", "Fonte:", "Source ", "Fonte ", "Note:", "Nota:", "Chart ", "Gráfico ", "Graph ", "Diagram ", "Image ", "Imagem ", "Photo ", "Foto ")
CAPTION_ANY_CASE = ("figure ", "table ", "source:")
BULLETS = "•○●◦"
CODE_PREFIXES = ("import ", "export ", "from ", "const ", "let ", "var ", "function ", "class ", "def ", "pub fn ", "fn ", "async fn ", "impl ", "=> ", "-> ", ":: ", ":= ")
MONOSPACE_NAMES = ("courier", "consolas", "monaco", "menlo", "mono", "fixed", "terminal", "typewriter", "source code", "fira code", "jetbrains", "inconsolata")
BOLD_NAMES = ("bold", "-bd", "_bd", "black", "heavy", "demibold", "semibold", "extrabold", "ultrabold")
ITALIC_NAMES = ("italic", "oblique", "-it", "_it", "slant", "inclined", "kursiv")
HYPHEN_LETTERS = "a-zA-ZáàâãéèêíïóôõöúçñÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ"
UNIT_MARKS = ("°", "V", "A", "Hz", "µ", "pin")
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
CJK = r"[\x{3000}-\x{30FF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"


def _starts(words: tuple[str, ...]) -> str:
    """A pattern for texts that begin with one of the words."""
    special = {c: "\\" + c for c in ".()[]{}*+?|^$\\"}
    return "^(" + "|".join("".join(special.get(c, c) for c in w) for w in words) + ")"


PAGE_NUMBER = (
    r"^[0-9]{1,4}$",
    f"^page[{WS}]*(of( (?s:.)*)?|[0-9](?s:.)*)?$",
    f"^page[{WS}]*((of|[0-9]+)([{WS}]+(of|[0-9]+))*)?$",
    f"^-[{WS}]*[0-9]+[{WS}]*-$",
)
URL = f"https?://[^{WS}<>)\\]]+[^{WS}<>)\\].,;]"


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def trim_start(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+", "")


def is_caption(line: Column) -> Column:
    t = trim(line)
    return t.rlike(_starts(CAPTION_PREFIXES)) | F.lower(t).rlike(_starts(CAPTION_ANY_CASE))


def is_list_item(line: Column) -> Column:
    """A bullet, a letter or a single character in parentheses; or a digit among the first five characters
    whose first point or parenthesis has nothing but digits (even none) before it."""
    t = trim_start(line)
    return t.rlike(r"^([•\-*○●◦] |[A-Za-z][.)]|\((?s:.)\))") | (F.substring(t, 1, 5).rlike("[0-9]") & F.substring(t, 1, 5).rlike(r"^[0-9]*[.)]"))


def format_list_item(line: Column) -> Column:
    t = trim_start(line)
    return F.when(t.rlike(f"^[{BULLETS}]"), F.concat(F.lit("- "), trim_start(F.substr(t, F.lit(2))))).otherwise(t)


def is_code_like(line: Column) -> Column:
    t = trim(line)
    marks = F.char_length(F.regexp_replace(t, r"[^{}()\[\];=<>]", ""))
    return t.rlike(_starts(CODE_PREFIXES)) | ((marks >= 3) & (F.octet_length(t) < 200)) | t.rlike(r"[;{}]$")


def collapse_dot_leaders(text: Column) -> Column:
    return F.regexp_replace(text, r"\.{4,}", " ... ")


def join_spaced_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, f"([{HYPHEN_LETTERS}]) - ([{HYPHEN_LETTERS}])", "$1-$2")


def is_page_number_line(line: Column) -> Column:
    """Of a trimmed line: up to four digits, "Page 3 of 9" and its like, "3 of 9", or "- 3 -"."""
    of = F.instr(line, " of ")
    before, after = trim(F.substring(line, F.lit(1), of - 1)), trim(F.substr(line, of + 4))
    x_of_y = (of > 0) & before.rlike("^[0-9]+$") & after.rlike("^[0-9]+$")
    other = F.lit(False)
    for p in PAGE_NUMBER:
        other = other | F.lower(line).rlike(p)
    return (line != "") & (other | x_of_y)


def is_page_number_item(text: Column, y: Column) -> Column:
    return trim(text).rlike("^[0-9]{1,4}$") & ((y > 720) | (y < 100))


def link_urls(text: Column) -> Column:
    """Markdown links for URLs, but not for the target or the text of a link: not after "](", and not where
    more "[" than "]" stand before. Any characters may stand in the text."""
    count = lambda c, x: F.char_length(c) - F.char_length(F.replace(c, F.lit(x), F.lit("")))
    net = lambda c: count(c, "[") - count(c, "]")

    def shown(cut: Column) -> Column:
        plain, urls = cut["plain"], cut["urls"]
        depths = running(F.zip_with(plain, urls, lambda p, u: net(p) + net(F.coalesce(u, F.lit("")))), F.lit(0), F.lit(0), lambda a, b: a + b)

        def piece(p: Column, i: Column, before: Column) -> Column:
            url = F.get(urls, i)
            linked = (F.get(before, i) + net(p) > 0) | p.endswith("](")
            return F.concat(p, F.when(url.isNull(), "").when(linked, url).otherwise(F.concat(F.lit("["), url, F.lit("]("), url, F.lit(")"))))

        return let(depths, lambda before: F.array_join(F.transform(plain, lambda p, i: piece(p, i, before)), ""))

    def build(x: Column) -> Column:
        cut = F.struct(F.split(x, URL, -1).alias("plain"), F.regexp_extract_all(x, F.lit(f"({URL})"), F.lit(1)).alias("urls"))
        return F.when(x.contains("http"), let(cut, shown)).otherwise(x)

    return let(text, build)


def looks_like_number(cell: Column) -> Column:
    t = trim(cell)
    return t.rlike("^[0-9.,+-]+$") & t.rlike("[0-9]")


def looks_like_table_data(cell: Column) -> Column:
    t = trim(cell)
    digit, short = t.rlike("[0-9]"), F.octet_length(t) <= 10
    date = short & t.rlike("^[0-9/-]+$") & t.rlike("[/-]") & t.rlike("([0-9][/-]*){4}")
    code = short & t.rlike(r"^[\p{IsAlphabetic}\p{N}]+$") & digit
    unit = digit & t.rlike("|".join(UNIT_MARKS))
    in_parens = t.contains("(") & t.contains(")") & digit
    degrees = t.rlike("°[CF]") & t.contains("to")
    return (t != "") & (looks_like_number(t) | date | code | unit | in_parens | degrees)


def is_footnote_row(row: Column) -> Column:
    t = trim(row)
    return t.rlike(r"^\([0-9]*\)|^[0-9]+\)") | F.lower(t).rlike("^notes?:")


def is_bold_font(name: Column) -> Column:
    n = F.lower(name)
    return n.rlike("|".join(BOLD_NAMES)) | (n.contains("medium") & ~n.contains("mediumitalic"))


def is_italic_font(name: Column) -> Column:
    return F.lower(name).rlike("|".join(ITALIC_NAMES))


def is_monospace_font(name: Column) -> Column:
    return F.lower(name).rlike("|".join(MONOSPACE_NAMES))


def expand_ligatures(text: Column) -> Column:
    """Controls below U+0020 go, but for line breaks and tabs; Latin ligatures become letters."""
    out = F.regexp_replace(text, r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}]", "")
    for one, letters in LIGATURES.items():
        out = F.replace(out, F.lit(one), F.lit(letters))
    return out


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)
