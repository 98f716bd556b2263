"""Queries over PDF files and items made for the rules of fonts, content streams, layout, tables and Markdown, and what they
have to give, written out in SQL.

Each supplier is a document; its texts and places depend on n (the supplier's number), a (10 to 59) and b (1 to 7).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textrules
from ..operators import documents, items, reports
from ..sources import pdf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_NUMBERS = "s_suppkey AS doc_id, s_suppkey AS n, s_suppkey % 50 + 10 AS a, s_suppkey % 7 + 1 AS b"
_SQL = f"WITH s AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, n, a, b FROM (SELECT {_NUMBERS} FROM supplier) t)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(*_NUMBERS.split(", ")).withColumn("doc_id", F.col("doc_id").cast("long"))


def _rows(columns: str, rows: list[tuple], where: str = "true") -> str:
    """SQL of a row for each tuple of expressions in n, a and b, for each document."""
    names = columns.split(", ")
    selects = (f"SELECT doc_id, {', '.join(f'{v} AS {c}' for c, v in zip(names, row, strict=True))} FROM s WHERE {where}" for row in rows)
    return f"{_SQL} " + " UNION ALL ".join(selects)


def _pdfs(spark: SparkSession, sf_dir: str, objects: dict[int, str | tuple[str, str]], info: str = "") -> DataFrame:
    """(doc_id, content): a file of objects, (dictionary, content) for streams, in which {n}, {a} and {b} are filled in."""

    def filled(template: str) -> Column:
        out = F.lit(template)
        for x in "nab":
            out = F.replace(out, F.lit("{" + x + "}"), F.col(x).cast("string"))
        return out

    parts = [F.lit("%PDF-1.4\n")]
    for number, body in objects.items():
        if isinstance(body, tuple):
            stream = filled(body[1])
            parts += [F.lit(f"{number} 0 obj\n<<{body[0]} /Length "), F.octet_length(stream).cast("string"), F.lit(">>\nstream\n"), stream, F.lit("\nendstream\nendobj\n")]
        else:
            parts += [F.lit(f"{number} 0 obj\n"), filled(body), F.lit("\nendobj\n")]
    return _documents(spark, sf_dir).select("doc_id", F.concat(*parts, F.lit(f"trailer\n<</Root 1 0 R {info}>>\n%%EOF\n")).cast("binary").alias("content"))


def _page(content: str, fonts: str, more: str = "", extra: dict | None = None) -> dict[int, str | tuple[str, str]]:
    """A document of one page."""
    return {
        1: "<</Type /Catalog /Pages 2 0 R>>", 2: "<</Type /Pages /Count 1 /Kids [3 0 R]>>",
        3: f"<</Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources <</Font <<{fonts}>> {more}>>>>", 4: ("", content), **(extra or {}),
    }


_PLACED = "seq, text, x, y, width, font_size, item_type"


def _placed(name: str, objects: dict, rows: list[tuple]) -> None:
    """Items of a file: (doc_id, seq, text, x, y, width, font_size, item_type)."""
    number = lambda c: F.round(F.col(c).cast("double"), 3).alias(c)
    QUERIES[name] = lambda spark, d: pdf.text_items(_pdfs(spark, d, objects)).where("error IS NULL").select("doc_id", "seq", "text", *map(number, ("x", "y", "width", "font_size")), "item_type")
    double = lambda v: f"CAST({v} AS DOUBLE)"
    ORACLE_SQL[name] = _rows(_PLACED, [(f"CAST({k} AS BIGINT)", text, *map(double, (x, y, w, size)), f"'{kind}'") for k, (text, x, y, w, size, kind) in enumerate(rows)])


# Widths: every character of F1 is half an em wide.
_EVEN = "/F1 <</Type /Font /Subtype /TrueType /BaseFont /Arial /FirstChar 32 /LastChar 126 /Widths [" + "500 " * 95 + "]>>"
_PLAIN = "/F1 <</Type /Font /Subtype /Type1 /BaseFont /Helvetica>>"

_placed(
    "cs_state_and_moves",
    _page(
        "Q q 2 0 0 2 {a} 20 cm BT /F1 10 Tf 1 0 0 1 5 6 Tm (one) Tj ET Q\n"
        "BT /F1 10 Tf 50 700 Td (two) Tj 0 -{a} TD (three) Tj T* (four) Tj (five) ' ET\n"
        "BT /F1 10 Tf 3 0 0 2 {a} 400 Tm (  ) Tj (wide) Tj ET (lost) Tj\n"
        "q 1 0 0 1 7 8 cm q 1 0 0 1 {b} 0 cm BT /F1 10 Tf (six) Tj ET Q BT (seven) Tj ET Q\n"
        "BT 1 0 0 1 9 9 Tm 5 5 Td 2 Tr 0.5 g /GS1 gs (eight) Tj (nine) Tj ET",
        _EVEN,
    ),
    [
        ("'one'", "a + 10", "32", "30", "10", "text"), ("'two'", "50", "700", "15", "10", "text"), ("'three'", "50", "700 - a", "25", "10", "text"), ("'four'", "50", "688 - a", "20", "10", "text"),
        ("'five'", "50", "676 - a", "0", "10", "text"), ("'wide'", "a", "400", "60", "30", "text"), ("'six'", "7 + b", "8", "15", "10", "text"), ("'seven'", "7", "8", "25", "10", "text"),
        ("'eight'", "14", "14", "25", "10", "text"), ("'nine'", "39", "14", "20", "10", "text"),
    ],
)

_placed(
    "cs_tj_arrays",
    _page(
        "BT /F1 10 Tf {a} 500 Td [(Wo) 10 (r) -300 (ld)] TJ (x) Tj ET\n"
        "BT /F1 10 Tf {a} 480 Td [-900 (a) -150 (b) -200.5 (c)] TJ ET\n"
        "BT /H1 10 Tf {a} 460 Td [(a) -119 (b) -121 (c) -500 ( d)] TJ (e) Tj ET\n"
        "BT /F1 10 Tf {a} 440 Td [( ) -500 ( )] TJ [() 20 <41>] TJ ET",
        _EVEN + " /H1 <</Type /Font /Subtype /Type1 /BaseFont /Helvetica>>",
    ),
    [
        ("'Wor ld'", "a", "500", "27.9", "10", "text"), ("'x'", "a + 27.9", "500", "5", "10", "text"), ("'ab c'", "a", "480", "27.505", "10", "text"),
        ("'ab c  d'", "a", "460", "0", "10", "text"), ("'e'", "a", "460", "0", "10", "text"), ("'A'", "a", "440", "4.8", "10", "text"),
    ],
)

_placed(
    "src_objects_and_links",
    {
        **_page(
            "q 50 0 0 -60 {a} 8 cm /Im1 Do Q q 1 0 0 1 {b} 0 cm /Fm1 Do Q /Im2 Do /None Do BT /F1 10 Tf (end) Tj ET", _EVEN,
            "/XObject <</Im1 10 0 R /Fm1 11 0 R /Im2 <</Subtype /Image>>>>",
            {
                10: ("/Type /XObject /Subtype /Image /Width 3 /Height 4", "x"),
                11: ("/Type /XObject /Subtype /Form /Resources <</Font <</D1 12 0 R /D2 <</Subtype /Type1 /BaseFont /X /Encoding <</Differences [65 /Z]>>>>>>>>", "BT /D1 8 Tf 1 2 Td (AB) Tj 5 5 Td (C) Tj /D2 8 Tf (A) Tj ET q"),
                12: "<</Type /Font /Subtype /Type1 /BaseFont /Y /Encoding <</Differences [65 /eacute]>>>>",
                13: "[14 0 R <</Subtype /Text /Rect [0 0 9 9] /A <</URI (no)>>>> <</Rect [1 2 3 {b}] /A 15 0 R>> <</Subtype /Link /Rect [1 2 3 4] /Dest /Top>>]",
                14: "<</Subtype /Link /Rect [10 20 {n} 40] /A <</S /URI /URI (https://a.b/{n})>>>>",
                15: "<</S /URI /URI (mailto:{b})>>",
            },
        ),
        3: "<</Type /Page /Parent 2 0 R /Contents 4 0 R /Annots 13 0 R /Resources <</Font <<" + _EVEN + ">> /XObject <</Im1 10 0 R /Fm1 11 0 R /Im2 <</Subtype /Image>>>>>>>>",
    },
    [
        ("'[Image: Im1]'", "a", "8", "50", "0", "image"), ("'éB'", "1 + b", "2", "0", "8", "text"), ("'C'", "6 + b", "7", "0", "8", "text"), ("'A'", "6 + b", "7", "0", "8", "text"),
        ("'end'", "0", "0", "15", "10", "text"), ("'https://a.b/' || n", "10", "20", "n - 10", "0", "link"), ("'mailto:' || b", "1", "2", "2", "0", "link"),
    ],
)

_CMAP = "begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0046> <0002> <FB01> endbfchar 2 beginbfrange <0005> <0007> <0061> <0009> <000A> [<0078> <00790079>] endbfrange"
_CID = "/C1 <</Type /Font /Subtype /Type0 /BaseFont /Wide{n} /ToUnicode 20 0 R /DescendantFonts [<</DW 800 /W [1 [400 600] 5 7 300]>>]>>"

_placed(
    "fnt_widths",
    _page(
        "BT /C1 10 Tf {a} 700 Td <00010002> Tj <000500060009> Tj ET BT /M1 10 Tf {a} 680 Td (AB) Tj (C!) Tj ET BT /T3 10 Tf {a} 660 Td (AB) Tj ET\n"
        "BT /N1 10 Tf {a} 640 Td (AB) Tj (C) Tj ET BT /C2 20 Tf {a} 620 Td (a) Tj <0041> Tj ET",
        _CID + " /M1 <</Subtype /MMType1 /BaseFont /M /FirstChar 65 /LastChar 67 /Widths [700 300 21 0 R]>> /T3 <</Subtype /Type3 /FirstChar 65 /LastChar 66 /Widths [3 5] /FontMatrix [0.1 0 0 0.1 0 0]>>"
        " /N1 <</Subtype /Type1 /BaseFont /N /FirstChar 65 /Widths [1 2]>> /C2 <</Subtype /Type0 /BaseFont /Other /DescendantFonts [22 0 R]>>",
        extra={20: ("", _CMAP), 21: "250", 22: "<</Subtype /CIDFontType2>>"},
    ),
    [
        ("'Ffi'", "a", "700", "10", "10", "text"), ("'abx'", "a + 10", "700", "14", "10", "text"), ("'AB'", "a", "680", "10", "10", "text"), ("'C!'", "a + 10", "680", "2.5", "10", "text"),
        ("'AB'", "a", "660", "8", "10", "text"), ("'AB'", "a", "640", "0", "10", "text"), ("'C'", "a", "640", "0", "10", "text"), ("'a'", "a", "620", "0", "20", "text"), ("'A'", "a", "620", "20", "20", "text"),
    ],
)

# What glyph names stand for.
_GLYPHS = {
    "A": "A", "f_f_i": "ffi", "f_l": "fl", "fi": "fi", "eacute": "é", "Ccedilla": "Ç", "scaron": "š", "Lambda": "Λ", "omega": "ω", "Delta": "Δ", "partialdiff": "∂", "summation": "∑", "radical": "√",
    "approxequal": "≈", "lozenge": "◊", "quotedblleft": '"', "quoteright": "’", "Euro": "€", "uni20AC": "€", "u20AC": "€", "germandbls": "ß", "dotlessi": "ı", "bullet": "•", "nine": "9", "ampersand": "&",
}
_GLYPH_NAMES = " ".join(f"/{g}" for g in _GLYPHS)
_GLYPH_CODES = "".join(f"{65 + k:02X}" for k in range(len(_GLYPHS)))
_placed(
    "fnt_encodings",
    _page(
        f"BT /D1 10 Tf {{a}} 700 Td <{_GLYPH_CODES}> Tj (!$) Tj ET BT /D2 10 Tf (ABC\\003) Tj (xyz) Tj ET\n"
        "BT /W1 10 Tf (\\223{n}\\224) Tj <FEFF0041> Tj ET BT /R1 10 Tf (\\212) Tj ET BT /P1 10 Tf (\\351) Tj <FEFF20AC0041> Tj ET BT /Nowhere 10 Tf (\\351t\\351) Tj ET",
        f"/D1 <</Subtype /Type1 /BaseFont /Y /Encoding <</Differences [65 {_GLYPH_NAMES}]>>>> /D2 <</Subtype /Type1 /BaseFont /Y2 /Encoding 20 0 R>> /W1 <</Subtype /Type1 /BaseFont /Z /Encoding /WinAnsiEncoding>>"
        " /R1 <</Subtype /Type1 /BaseFont /R /Encoding /MacRomanEncoding>> /P1 <</Subtype /Type1 /BaseFont /P>>",
        extra={20: "<</Differences [66 /eacute /nothing 65 /uni00E7]>>"},
    ),
    [
        ("'" + "".join(_GLYPHS.values()) + "'", "a", "700", "0", "10", "text"), ("'!$'", "a", "700", "0", "10", "text"), ("'çéC'", "0", "0", "0", "10", "text"), ("'xyz'", "0", "0", "0", "10", "text"),
        ("'“' || n || '”'", "0", "0", "0", "10", "text"), ("'þÿA'", "0", "0", "0", "10", "text"), ("'ä'", "0", "0", "0", "10", "text"), ("'é'", "0", "0", "0", "10", "text"),
        ("'€A'", "0", "0", "0", "10", "text"), ("'été'", "0", "0", "0", "10", "text"),
    ],
)

_NAMED_FONT = "<</Type /Font /Subtype /Type0 /BaseFont /NamedMap /ToUnicode 20 0 R /DescendantFonts [<</DW 500>>]>>"
_MAPS = _page(
    "BT /B1 10 Tf (Aabcde) Tj (A~) Tj (~~z) Tj ET BT /N1 10 Tf <00010005> Tj ET BT /FNamedMapped 10 Tf <00020006> Tj ET BT /N2 10 Tf <00010005> Tj ET BT /F12 10 Tf (ab) Tj ET",
    "/B1 <</Subtype /Type1 /BaseFont /Bytes /ToUnicode 21 0 R>> /N1 <</Subtype /Type1 /BaseFont /NamedMap>> /N2 <</Subtype /Type1 /BaseFont /ABCDEF+NamedMap>> /F12 <</Subtype /Type1 /BaseFont /Map>>",
    extra={
        20: ("", _CMAP), 22: _NAMED_FONT,
        21: ("", "begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <41> <0042> endbfchar beginbfrange <61> <63> <0078> <64> <65> [<0031> <0032>] endbfrange"),
    },
)
_placed(
    "cmp_decoding", _MAPS,
    [(text, "0", "0", "0", "10", "text") for text in ("'Bxyz12'", "'B~'", "'~~z'", "'Fa'", "'fib'", "'Fa'", "'ab'")],
)
QUERIES["cmp_maps"] = lambda spark, d: pdf.unicode_maps(_pdfs(spark, d, _MAPS)).select(
    "doc_id", "object", F.array_join("names", ",").alias("names"), "code_bytes", F.array_join(F.transform(F.array_sort(F.map_entries("chars")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), " ").alias("chars"),
    F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", *(r[k].cast("string") for k in ("low", "high", "base")))), " ").alias("ranges"),
)
ORACLE_SQL["cmp_maps"] = _rows("object, names, code_bytes, chars, ranges", [("21", "''", "1", "'65=B 100=1 101=2'", "'97-99-120'"), ("20", "'NamedMap,NamedMap_20'", "2", "'1=F 2=ﬁ 9=x 10=yy'", "'5-7-97'")])

# Font names, and whether they are bold and italic.
_STYLES = {"Foo-MediumItalic": (0, 1), "Foo-Medium": (1, 0), "Arial-BoldItalic": (1, 1), "Bar_Bd": (1, 0), "X-DemiBold": (1, 0), "Baz-It": (0, 1), "Heavy": (1, 0), "Helvetica": (0, 0), "KursivBlack": (1, 1)}
QUERIES["cs_font_styles"] = lambda spark, d: pdf.text_items(
    _pdfs(spark, d, _page(" ".join(f"BT /F{k} 10 Tf ({name}) Tj ET" for k, name in enumerate(_STYLES)), " ".join(f"/F{k} <</Subtype /Type1 /BaseFont /{name}>>" for k, name in enumerate(_STYLES))))
).select("doc_id", "text", "font", "is_bold", "is_italic")
ORACLE_SQL["cs_font_styles"] = _rows("text, font, is_bold, is_italic", [(f"'{name}'", f"'F{k}'", str(bool(b)), str(bool(i))) for k, (name, (b, i)) in enumerate(_STYLES.items())])

QUERIES["api4_plain_text"] = lambda spark, d: pdf.extract_text(_pdfs(spark, d, _page("BT /F1 10 Tf (first {n}) Tj [(sec) 5 (ond)] TJ ET BT (  ) Tj (third) ' ET", _PLAIN))).select("doc_id", "text")
ORACLE_SQL["api4_plain_text"] = f"{_SQL} SELECT doc_id, 'first ' || n || chr(10) || 'second' || chr(10) || 'third' AS text FROM s"

QUERIES["api10_links"] = lambda spark, d: pdf.links(_pdfs(spark, d, {**_page("", _PLAIN), 3: "<</Type /Page /Parent 2 0 R /Contents 4 0 R /Annots [<</Subtype /Link /Rect [{a} 20 {n} 40] /A <</URI (https://a.b/{n})>>>>]>>"})).select(
    "doc_id", "page", "url", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height"))
)
ORACLE_SQL["api10_links"] = f"{_SQL} SELECT doc_id, CAST(1 AS INTEGER) AS page, 'https://a.b/' || n AS url, CAST(a AS DOUBLE) AS x, 20.0::DOUBLE AS y, CAST(n - a AS DOUBLE) AS width, 20.0::DOUBLE AS height FROM s"

# Items.
_DEFAULTS = {"text": "''", "x": "72", "y": "700", "width": "0", "height": "10", "font": "'F1'", "font_size": "10", "page": "1", "is_bold": "false", "is_italic": "false", "item_type": "'text'"}
_KINDS = {"text": "string", "x": "double", "y": "double", "width": "double", "height": "double", "font": "string", "font_size": "double", "page": "int", "is_bold": "boolean", "is_italic": "boolean", "item_type": "string"}


def _items(spark: SparkSession, sf_dir: str, rows: list[dict], where: str = "true", first: int = 0) -> DataFrame:
    """Items whose fields are expressions in n, a and b, in the order of rows."""
    one = lambda k, row: F.struct(F.lit(k + first).cast("long").alias("seq"), *(F.expr(f"cast({row.get(c, v)} as {_KINDS[c]})").alias(c) for c, v in _DEFAULTS.items()))
    return _documents(spark, sf_dir).where(where).select("doc_id", F.explode(F.array(*(one(k, row) for k, row in enumerate(rows)))).alias("i")).select("doc_id", "i.*")


# Items of a line as (text, x, width[, size, rise]) and the text that they make.
_LINES = [
    ([("Hello", 100, 50), ("World", 160, 50)], "Hello World"), ([("であ", 100, 24), ("履行", 124, 32), ("を", 156, 16)], "であ履行を"), ([("N", 100, 8), ("A", 108, 8), ("V", 116, 8)], "NAV"),
    ([("1", 100, 6), (",", 106, 3), ("234", 110, 18)], "1,234"), ([("well", 100, 20), ("-known", 130, 30)], "well-known"), ([("end", 100, 15), (".", 140, 3)], "end."),
    ([("Total:", 100, 30), ("5", 130, 5)], "Total: 5"), ([("x", 100, 6), ("2", 120, 4, 6, 2)], "x2"), ([("the", 100, 19.5), ("Prague", 119.5, 42), ("Rules", 161.5, 35)], "the Prague Rules"),
    ([("ab", 100, 0), ("cd", 109, 0)], "abcd"), ([("ab", 100, 0), ("Cd", 109, 0)], "ab Cd"), ([("word ", 100, 30), ("next", 135, 20)], "word next"), ([("right", 200, 30), ("left", 100, 30)], "left right"),
]


def _line_rows() -> list[dict]:
    return [
        {"text": f"'{i[0]}'", "x": f"{i[1]} + b", "y": f"{700 - 20 * k + (i[4] if len(i) > 4 else 0)}", "width": str(i[2]), "font_size": str(i[3] if len(i) > 3 else 10)} for k, (row, _) in enumerate(_LINES) for i in row
    ]


QUERIES["spc_line_text"] = lambda spark, d: documents.lines(_items(spark, d, _line_rows())).select("doc_id", "line_no", "text")
ORACLE_SQL["spc_line_text"] = _rows("line_no, text", [(str(k), f"'{text}'") for k, (_, text) in enumerate(_LINES, 1)])


def _columns(spark: SparkSession, d: str) -> DataFrame:
    """22 rows in two columns, left and right in turn, and a heading over both below the seventh; the right half of page 2
    in a stream order that jumps."""
    rows = _documents(spark, d).select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.lit(21))).alias("k"))
    place = lambda text, x, y, width, seq, page=1: (F.expr(text).alias("text"), F.lit(float(x)).alias("x"), F.expr(y).cast("double").alias("y"), F.lit(float(width)).alias("width"), F.expr(seq).cast("long").alias("seq"), F.lit(page).alias("page"))
    left = rows.select("doc_id", *place("concat('left ', k, ' ', n)", 72, "700 - 14 * k", 180, "2 * k"))
    right = rows.select("doc_id", *place("concat('right ', k, ' ', n)", 330, "700 - 14 * k", 180, "2 * k + 1"))
    wide = rows.where("k = 0").select("doc_id", *place("'a wide heading'", 72, "607", 440, "100"))
    jumpy = rows.where("k < 12").select("doc_id", *place("concat('jump ', k)", 72, "700 - 40 * k", 60, "200 + k % 6 * 2 + floor(k / 6)", 2))
    more = {"height": F.lit(10.0), "font": F.lit("F1"), "font_size": F.lit(10.0), "is_bold": F.lit(False), "is_italic": F.lit(False), "item_type": F.lit("text")}
    return left.unionByName(right).unionByName(wide).unionByName(jumpy).withColumns(more)


QUERIES["lay_spanning_columns"] = lambda spark, d: documents.lines(_columns(spark, d)).select("doc_id", "page", "line_no", "text")
ORACLE_SQL["lay_spanning_columns"] = f"""
    {_SQL}, k AS (SELECT CAST(range AS INTEGER) AS k FROM range(22)),
    p AS (
        SELECT doc_id, 1 AS page, CASE WHEN k < 7 THEN 0 ELSE 2 END AS part, 0 AS side, k, 'left ' || k || ' ' || n AS text FROM s, k
        UNION ALL SELECT doc_id, 1, CASE WHEN k < 7 THEN 0 ELSE 2 END, 1, k, 'right ' || k || ' ' || n FROM s, k
        UNION ALL SELECT doc_id, 1, 1, 0, 0, 'a wide heading' FROM s
        UNION ALL SELECT doc_id, 2, 0, 0, k, 'jump ' || k FROM s, k WHERE k < 12)
    SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, part, side, k) AS INTEGER) AS line_no, text FROM p"""

# Tables: what stands in which column of which row, by the kind of document (n % 6).
_X = (100, 200, 300, 400)
_BODY_LINES = [{"text": "'Words of the body text'", "y": str(y), "width": "110"} for y in (700, 688)]


def _grid(rows: list[list[str]], top: int = 500) -> list[dict]:
    return [{"text": v, "x": f"{x} + b", "y": str(top - 20 * r), "width": "20", "font_size": "8"} for r, row in enumerate(rows) for x, v in zip(_X, row, strict=False) if v]


_HEAD = ["'Item'", "'Qty'", "'Price'", "'Total'"]
_PARTS = [[f"'Part {r}'", f"'{2 * r}'", "'1.5'", "cast(n as string)"] for r in (1, 2, 3)]
_TABLES = [
    _grid([_HEAD, *_PARTS]),
    _grid([_HEAD, ["'Bolt'", "'2'", "'1.5'", "cast(n as string)"], ["", "", "'more'", ""], ["'(1) see note'"], ["'Nut'", "'4'", "'2.5'", "cast(n as string)"]]),
    _grid([["'Name:'", "'Acme'"], ["'Date:'", "'May'"], _HEAD, *_PARTS], 540),
    [
        *_grid([["'Item'", "'m'", "'Price'", "'Total'"], *(["'Part'", *row[1:]] for row in _PARTS)]),
        {"text": "'2'", "x": "206 + b", "y": "502", "width": "3", "font_size": "6"},
        *({"text": v, "x": f"{x} + b", "y": str(480 - 20 * r), "width": "5", "font_size": "8"} for r in range(3) for x, v in ((112, "'A-'"), (118, "'B1'"))),
    ],
    _grid([["'NAME:'", "'one'"], ["'DATE:'", "'two'"], ["'PLACE:'", "'three'"], ["'SIZE:'", "'4'"]]),
    _grid([[f"'Chapter {r}'", "'......'", f"'{r}0'"] for r in range(1, 5)]),
]


def _table_documents(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for k, rows in enumerate(_TABLES):
        one = _items(spark, d, [*_BODY_LINES, *rows], f"n % 6 = {k}")
        out = one if out is None else out.unionByName(one)
    return out


def _shown(rows: list[list[str]], widths: tuple[int, ...]) -> str:
    """SQL of a table's Markdown from cells in SQL."""
    line = lambda row: "'| ' || " + " || ' | ' || ".join(f"rpad({v}, {w}, ' ')" for v, w in zip(row, widths, strict=True)) + " || ' |' || chr(10)"
    rule = "'| " + " | ".join("-" * w for w in widths) + " |' || chr(10)"
    return " || ".join([line(rows[0]), rule, *map(line, rows[1:])])


_N = "CAST(n AS VARCHAR)"
_SQL_PARTS = [[f"'Part {r}'", f"'{2 * r}'", "'1.5'", _N] for r in (1, 2, 3)]
_SHOWN = [
    (4, 4, _shown([_HEAD, *_SQL_PARTS], (6, 3, 5, 5))),
    (4, 5, _shown([_HEAD, ["'Bolt'", "'2'", "'1.5 more'", _N], ["'Nut'", "'4'", "'2.5'", _N]], (4, 3, 8, 5)) + " || chr(10) || '(1) see note' || chr(10)"),
    (4, 4, _shown([_HEAD, *_SQL_PARTS], (6, 3, 5, 5))),
    (4, 4, _shown([["'Item'", "'m2'", "'Price'", "'Total'"], *(["'Part A-B1'", *row[1:]] for row in _SQL_PARTS)], (9, 3, 5, 5))),
]
QUERIES["tab_markdown"] = lambda spark, d: documents.tables(_table_documents(spark, d)).select("doc_id", "page", "table_no", F.size("columns").alias("n_columns"), F.size("rows").alias("n_rows"), "markdown")
ORACLE_SQL["tab_markdown"] = f"{_SQL} " + " UNION ALL ".join(
    f"SELECT doc_id, CAST(1 AS INTEGER) AS page, CAST(0 AS INTEGER) AS table_no, CAST({c} AS INTEGER) AS n_columns, CAST({r} AS INTEGER) AS n_rows, {md} AS markdown FROM s WHERE n % 6 = {k}" for k, (c, r, md) in enumerate(_SHOWN)
)

# Tables in the body's size need rows that share their columns; a table goes on on a page that holds nothing else.
_BODY_TABLE = [["'Year'", "'North'", "'South'"], *([f"'{2000 + r}'", f"'{r}.5'", "cast(a as string)"] for r in range(1, 5))]
_TWO_PAGES = [
    *({"text": f"'Line {k} of the text'", "y": str(760 - 12 * k), "width": "90"} for k in range(6)),
    *({**i, "font_size": "10"} for i in _grid(_BODY_TABLE, 600)),
    *({**i, "font_size": "10", "page": "2"} for i in _grid(_BODY_TABLE, 700)),
]
QUERIES["md_tables_over_pages"] = lambda spark, d: documents.markdown(_items(spark, d, _TWO_PAGES))
_BODY_ROWS = [[f"'{2000 + r}'", f"'{r}.5'", "CAST(a AS VARCHAR)"] for r in range(1, 5)]
ORACLE_SQL["md_tables_over_pages"] = (
    f"{_SQL} SELECT doc_id, '" + " ".join(f"Line {k} of the text" for k in range(6)) + "' || chr(10) || chr(10) || "
    + _shown([["'Year'", "'North'", "'South'"], *_BODY_ROWS, *_BODY_ROWS], (4, 5, 5)) + " AS markdown FROM s"
)

# A document of everything: (page, y, size, [(text, x, font, bold)]).
_REPORT = [
    (1, 760, 24, [("Annual Report", 72, "F1", 0)]), (1, 720, 15, [("Part one of", 72, "F1", 0)]), (1, 702, 15, [("the story {n}", 72, "F1", 0)]),
    *((1, 670 - 12 * k, 10, [(t, 72, "F1", 0)]) for k, t in enumerate(("The body begins here", "and it goes on", "for well - known", "reasons, see", "https://a.b/{n} for", "more of them."))),
    (1, 580, 10, [("New words after a gap", 72, "F1", 0)]), (1, 568, 10, [("with", 72, "F1", 0), ("bold words", 150, "F2", 1), ("in them", 250, "F1", 0)]),
    (1, 540, 10, [("• first point", 72, "F1", 0)]), (1, 528, 10, [("wrapped over", 82, "F1", 0)]), (1, 516, 10, [("2. second point", 72, "F1", 0)]),
    (1, 480, 10, [("Figure 1: a chart", 72, "F1", 0)]), (1, 450, 10, [("let x = {b};", 300, "Courier", 0)]),
    (1, 40, 10, [("7", 300, "F1", 0)]), (2, 760, 10, [("A page of its own....... {a}", 72, "F1", 0)]),
    (2, 730, 10, [("nce upon a time", 72, "F1", 0)]), (2, 722, 30, [("O", 40, "F1", 0)]), (2, 718, 10, [("there was more", 72, "F1", 0)]),
]


def _filled(text: str, concat: str) -> str:
    """An expression from a text with {n}, {a} and {b}."""
    for x in "nab":
        text = text.replace("{" + x + "}", f"' {concat} cast({x} as varchar(9)) {concat} '")
    return f"'{text}'"


def _report_items(spark: SparkSession, d: str) -> DataFrame:
    rows = [
        {"text": _filled(t, "||"), "x": str(x), "y": str(y), "font": f"'{font}'", "font_size": str(size), "height": str(size), "page": str(page), "is_bold": str(bool(bold)).lower()}
        for page, y, size, own in _REPORT for t, x, font, bold in own
    ]
    return _items(spark, d, rows)


def _report_pdfs(spark: SparkSession, d: str) -> DataFrame:
    def shown(page: int) -> str:
        hexed = lambda t: "".join(f"({p})" if p.startswith("{") else f"<{p.encode('cp1252').hex()}>" for p in re.split(r"(\{[nab]\})", t) if p)
        return "\n".join(f"BT /{font} {size} Tf {x} {y} Td [{hexed(t)}] TJ ET" for p, y, size, own in _REPORT if p == page for t, x, font, _ in own)

    fonts = " ".join(f"/{name} <</Type /Font /Subtype /Type1 /BaseFont /{base} /Encoding /WinAnsiEncoding>>" for name, base in (("F1", "Helvetica"), ("F2", "Helvetica-Bold"), ("Courier", "Courier")))
    objects = {
        1: "<</Type /Catalog /Pages 2 0 R>>", 2: f"<</Type /Pages /Count 2 /Kids [3 0 R 5 0 R] /Resources <</Font <<{fonts}>>>>>>", 3: "<</Type /Page /Parent 2 0 R /Contents 4 0 R>>", 4: ("", shown(1)),
        5: "<</Type /Page /Parent 2 0 R /Contents 6 0 R>>", 6: ("", shown(2)), 7: "<</Title <FEFF00C90074>>>",
    }
    return _pdfs(spark, d, objects, "/Info 7 0 R")


_REPORT_TEXT = (
    "# Annual Report\n\n## Part one of the story {n}\n\nThe body begins here and it goes on for well-known reasons, see [https://a.b/{n}](https://a.b/{n}) for more of them.\n\n"
    "New words after a gap with **bold words** in them\n\n- first point wrapped over\n2. second point\nFigure 1: a chart\n\n```\nlet x = {b};\n```\n\n"
    "A page of its own ...  {a}\n\nOnce upon a time there was more\n"
)
_REPORT_SQL = _filled(_REPORT_TEXT.replace("\n", "' || chr(10) || '"), "||")
QUERIES["md_report"] = lambda spark, d: documents.markdown(_report_items(spark, d))
ORACLE_SQL["md_report"] = f"{_SQL} SELECT doc_id, {_REPORT_SQL} AS markdown FROM s"

QUERIES["api1_report_pdfs"] = lambda spark, d: documents.process_pdfs(_report_pdfs(spark, d)).select("doc_id", "pdf_type", "page_count", "pages_sampled", "pages_with_text", "confidence", "title", "ocr_recommended", "markdown")
ORACLE_SQL["api1_report_pdfs"] = (
    f"{_SQL} SELECT doc_id, 'text_based' AS pdf_type, CAST(2 AS INTEGER) AS page_count, CAST(2 AS INTEGER) AS pages_sampled, CAST(2 AS INTEGER) AS pages_with_text, 1.0::DOUBLE AS confidence, 'Ét' AS title, false AS ocr_recommended, "
    f"{_REPORT_SQL} AS markdown FROM s"
)

QUERIES["snk2_processing_json"] = lambda spark, d: documents.processing_json(documents.process_pdfs(_pdfs(spark, d, _page("BT /F1 10 Tf 72 700 Td (say \\\"{n}\\\") Tj (a) Tj (b) Tj ET", _EVEN))))
ORACLE_SQL["snk2_processing_json"] = (
    f"{_SQL} SELECT doc_id, '{{\"pdf_type\":\"text_based\",\"page_count\":1,\"has_text\":false,\"markdown_length\":' || (9 + length(CAST(n AS VARCHAR))) || ',\"markdown\":\"say \\\"' || n || '\\\"ab\\n\"}}' AS value FROM s"
)

_SCAN = "/XObject <</Im1 10 0 R>>"
_SCANNED = _page("q 600 0 0 700 0 0 cm /Im1 Do Q", _PLAIN, _SCAN, {10: ("/Subtype /Image /Width {n}00 /Height 500", "x")})
QUERIES["snk3_recommendation"] = lambda spark, d: (
    lambda kinds: documents.recommendation(kinds).join(documents.detection_json(kinds), "doc_id").select("doc_id", "pdf_type", "recommendation", "exit_status", "value")
)(pdf.detect_pdf_types(_pdfs(spark, d, _SCANNED).where("doc_id % 3 > 0").unionByName(_pdfs(spark, d, _page("BT /F1 9 Tf (a) Tj (b) Tj ET /Im1 Do", _PLAIN, _SCAN, {10: ("/Subtype /Image /Width 9 /Height 9", "x")})).where("doc_id % 3 = 0"))))
ORACLE_SQL["snk3_recommendation"] = f"""
    {_SQL}, k AS (SELECT doc_id, CASE WHEN n % 3 > 0 THEN 'scanned' ELSE 'image_based' END AS pdf_type, CASE WHEN n % 3 > 0 THEN '0.95' ELSE '0.8' END AS confidence FROM s)
    SELECT doc_id, pdf_type, CASE pdf_type WHEN 'scanned' THEN 'Recommendation: Use OCR (MinerU or similar)' ELSE 'Recommendation: Use OCR for best results' END AS recommendation, CAST(2 AS INTEGER) AS exit_status,
           '{{"pdf_type":"' || pdf_type || '","page_count":1,"pages_sampled":1,"pages_with_text":0,"confidence":' || confidence || ',"title":null,"ocr_recommended":true}}' AS value FROM k"""

QUERIES["snk4_page_dump"] = lambda spark, d: reports.page_dump(_report_items(spark, d), 2, 3).select("doc_id", "page", "y", "text")
ORACLE_SQL["snk4_page_dump"] = _rows("page, y, text", [("2", f"{y}.0::DOUBLE", _filled(t, "||")) for page, y, _, own in _REPORT if page == 2 for t, *_ in own])

QUERIES["snk6_order_facts"] = lambda spark, d: reports.order_facts(_items(spark, d, _line_rows()), 1, 110, 200)
ORACLE_SQL["snk6_order_facts"] = f"""
    {_SQL}, i AS (SELECT * FROM (VALUES {', '.join(f'({i[1]}.0::DOUBLE, {700 - 20 * k + (i[4] if len(i) > 4 else 0)}.0::DOUBLE)' for k, (row, _) in enumerate(_LINES) for i in row if isinstance(i[1], int))}{''.join(f', ({x}::DOUBLE, 540.0::DOUBLE)' for x in (119.5, 161.5))}) v(x, y))
    SELECT doc_id, count(*) AS n, min(y) AS y_least, max(y) AS y_most FROM s, i WHERE x + b > 110 AND x + b < 200 GROUP BY doc_id"""

QUERIES["snk6_items_with"] = lambda spark, d: reports.items_with(_report_items(spark, d), ("body", "wide", "story")).select("doc_id", "seq", "text")
ORACLE_SQL["snk6_items_with"] = _rows("seq, text", [("CAST(2 AS BIGINT)", _filled("the story {n}", "||")), ("CAST(3 AS BIGINT)", "'The body begins here'")])

QUERIES["snk7_ligatures"] = lambda spark, d: reports.ligature_items(_items(spark, d, [{"text": "'eﬁx'"}, {"text": "'plain'"}, {"text": "concat('ﬂ', n)"}]))[1]
ORACLE_SQL["snk7_ligatures"] = f"{_SQL} SELECT doc_id, CAST(2 AS BIGINT) AS n FROM s"

QUERIES["snk7_fonts"] = lambda spark, d: reports.fonts(_pdfs(spark, d, _MAPS)).select("doc_id", "page", "font", "base_font", "codes", "ranges", "code_bytes", "differences", "ligatures", "has_a", "has_space")
ORACLE_SQL["snk7_fonts"] = _rows(
    "page, font, base_font, codes, ranges, code_bytes, differences, ligatures, has_a, has_space",
    [("1", "'B1'", "'Bytes'", "3", "1", "1", "0", "0", "false", "false")] + [("1", f"'{f}'", f"'{b}'", "0", "0", "CAST(NULL AS INTEGER)", "0", "0", "false", "false") for f, b in (("N1", "NamedMap"), ("N2", "ABCDEF+NamedMap"), ("F12", "Map"))],
)

_GAPS = [{"y": str(y), "font_size": "8", "page": p} for y, p in ((700, "1"), (688, "1"), (668, "1"), (700, "2"), (682, "2"))]
QUERIES["snk5_gap_lines"] = lambda spark, d: (lambda i: items.gap_lines(i.withColumn("line_no", F.col("seq")), items.modal_sizes(i.select("doc_id", "font_size"), default=items.GAP_BASE)))(_items(spark, d, _GAPS)).select(
    "doc_id", "page", "line_no", "gap", F.round("ratio", 6).alias("ratio"), "paragraph"
)
ORACLE_SQL["snk5_gap_lines"] = _rows(
    "page, line_no, gap, ratio, paragraph",
    [(p, f"CAST({k} AS BIGINT)", g and f"{g}.0::DOUBLE" or "CAST(NULL AS DOUBLE)", g and f"{g / 10}::DOUBLE" or "CAST(NULL AS DOUBLE)", str(g > 18)) for k, (p, g) in enumerate((("1", 0), ("1", 12), ("1", 20), ("2", 0), ("2", 18)))],
)

_PREPARED = [("Title", 700, 20), ("Two", 650, 10), ("three {n}", 638, 10), ("Four", 600, 10)]
QUERIES["api8_lines_markdown"] = lambda spark, d: documents.lines_markdown(
    _items(spark, d, [{"text": _filled(t, "||"), "y": str(y), "font_size": str(s)} for t, y, s in _PREPARED]).withColumn("line_no", F.col("seq") + 1)
)
ORACLE_SQL["api8_lines_markdown"] = f"{_SQL} SELECT doc_id, '# Title' || chr(10) || chr(10) || 'Two three ' || n || chr(10) || chr(10) || 'Four' || chr(10) AS markdown FROM s"

# Tables and images between lines, on pages of their own, and after the last line.
_PICTURE = lambda name, y, page: {"text": f"'[Image: {name}]'", "y": str(y), "page": str(page), "font_size": "0", "item_type": "'image'"}
_OBJECTS = [
    {"text": "'above'", "y": "700"}, _PICTURE("Im1", 650, 1), {"text": "concat('below ', n)", "y": "600"}, *_grid([_HEAD, *_PARTS], 540), {"text": "'after'", "y": "400"},
    _PICTURE("Im2", 500, 2), {"text": "'last'", "y": "700", "page": "3"}, _PICTURE("Im3", 100, 3), _PICTURE("Im4", 300, 4),
]
QUERIES["md_objects"] = lambda spark, d: documents.markdown(_items(spark, d, _OBJECTS))
_BREAK = " || chr(10) || chr(10) || "
ORACLE_SQL["md_objects"] = (
    f"{_SQL} SELECT doc_id, 'above'{_BREAK}'![Image: Im1](image)' || chr(10) || 'below ' || n{_BREAK}{_shown([_HEAD, *_SQL_PARTS], (6, 3, 5, 5))} || chr(10) || 'after'{_BREAK}'![Image: Im2](image)'{_BREAK}'last'{_BREAK}"
    f"'![Image: Im3](image)'{_BREAK}'![Image: Im4](image)' || chr(10) AS markdown FROM s"
)

# URLs beside and within brackets, and control characters.
_BRACKETS = "[ https://a.b/{n} ] https://c.d/{n} [t](https://e.f/{a}) (https://g.h/i). \x01https://j.k/[x https://l.m/"
_LINKED = "[ https://a.b/{n} ] [https://c.d/{n}](https://c.d/{n}) [t](https://e.f/{a}) ([https://g.h/i](https://g.h/i)). \x01[https://j.k/[x](https://j.k/[x) https://l.m/"
QUERIES["md26_link_brackets"] = lambda spark, d: _documents(spark, d).select("doc_id", textrules.link_urls(F.expr(_filled(_BRACKETS.replace("\x01", "' || char(1) || '"), "||"))).alias("linked"))
ORACLE_SQL["md26_link_brackets"] = f"{_SQL} SELECT doc_id, {_filled(_LINKED.replace(chr(1), chr(39) + ' || chr(1) || ' + chr(39)), '||')} AS linked FROM s"
