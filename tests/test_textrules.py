import pytest
from pyspark.sql import functions as F

from pagewright.functions import markdown as md
from pagewright.functions import textrules as t


def apply(spark, fn, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", fn(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


RULES = [
    (t.is_list_item, {"• a": True, "- a": True, "1. a": True, "12) a": True, "(1) a": True, "a. b": True, "(x) y": True, ".5 x": True, "3.14 x": True, "abc": False, "-a": False, "12345. x": False, ". no digit here": False}),
    (t.format_list_item, {"•  a": "- a", "  ● b": "- b", "* c": "* c", "1. d": "1. d"}),
    (t.is_code_like, {"const x = 5;": True, "fn main": True, "a (b) [c": True, "a (b) c": False, "x;": True, "plain words": False, "(" * 3 + "x" * 200: False}),
    (t.is_caption, {"Figure 2: a": True, "TABLE 3": True, "source: x": True, "Gráfico 1": True, "figures": False, "note: x": False}),
    (t.is_page_number_line, {"7": True, "12345": False, "Page 3 of 9": True, "PAGE OF": True, "page": True, "3 of 9": True, "- 7 -": True, "pages": False, "page ofof": False, "": False, "a of 3": False}),
    (t.collapse_dot_leaders, {"a....b": "a ... b", "a...b": "a...b"}),
    (t.join_spaced_hyphens, {"well - known": "well-known", "a - b - c": "a-b - c", "1 - 2": "1 - 2"}),
    (t.link_urls, {"see https://a.b/c. x": "see [https://a.b/c](https://a.b/c). x", "[t](https://a.b/c)": "[t](https://a.b/c)", "[https://a.b/c] https://d.e/f": "[https://a.b/c] [https://d.e/f](https://d.e/f)", "[ https://a.b/c": "[ https://a.b/c", "none": "none", "see \x01 https://a.b/c ok": "see \x01 [https://a.b/c](https://a.b/c) ok", "\x00https://a.b/c": "\x00[https://a.b/c](https://a.b/c)", "https://a.b/[x https://c.d/e": "[https://a.b/[x](https://a.b/[x) https://c.d/e", "": ""}),
    (t.looks_like_number, {"1,234.5": True, "-7": True, "+": False, "1a": False, "": False}),
    (t.looks_like_table_data, {"12/03/2024": True, "NE555": True, "5 V": True, "D (SOIC, 8)": True, "°C to": True, "word": False, "12 words": False}),
    (t.is_footnote_row, {"(1) x": True, "() x": True, "2) x": True, "Notes: x": True, "note x": False, ") x": False}),
    (t.is_bold_font, {"Arial-Bold": True, "X-Medium": True, "X-MediumItalic": False, "Arial": False}),
    (t.is_italic_font, {"Foo-It": True, "Kursiv": True, "Arial": False}),
    (t.is_monospace_font, {"Courier New": True, "DejaVu Sans Mono": True, "F1": False}),
    (t.expand_ligatures, {"eﬁx\x01\t": "efix\t", "ﬄ": "ffl", "ﬅ": "ﬅ"}),
    (t.has_cjk, {"である": True, "abc": False}),
    (md.to_markdown, {"": "", "Content": "Content\n", "• First\n• Second": "- First\n- Second\n", "const x = 5;\nlet y = 10;": "```\nconst x = 5;\nlet y = 10;\n```\n", "let a\n- b\ntext": "```\nlet a\n- b\n```\ntext\n", "let a\n\nb\r\n": "```\nlet a\n```\n\nb\n"}),
    (md.remove_page_numbers, {"a\n\n7\n\nb": "a\n\n\nb", "a\n7\nb": "a\n7\nb", "7": "", "a\n7\n---": "a\n---", "a\n7\n\n---": "a\n\n---"}),
    (md.clean_markdown, {"  a\n\n\n\nb....c \n": "a\n\nb ... c\n"}),
]


@pytest.mark.parametrize(("rule", "cases"), RULES, ids=[r.__name__ for r, _ in RULES])
def test_rule(spark, rule, cases):
    assert dict(zip(cases, apply(spark, rule, cases), strict=True)) == cases


def test_many_urls_and_lines(spark):
    """States run on over stretches of the arrays that hold them."""
    text = "".join(f"[ https://a.b/{k} ] https://c.d/{k}\n" for k in range(700)) + "[" + "https://e.f/g " * 3
    want = "".join(f"[ https://a.b/{k} ] [https://c.d/{k}](https://c.d/{k})\n" for k in range(700)) + "[" + "https://e.f/g " * 3
    assert apply(spark, t.link_urls, [text, None]) == [want, None]
    lines = ["let a = 1;"] + ["- item"] * 600 + ["let b = 2;", "plain"] + ["- item"] * 300
    assert apply(spark, md.to_markdown, ["\n".join(lines)]) == ["```\nlet a = 1;\n" + "- item\n" * 600 + "let b = 2;\n```\nplain\n" + "- item\n" * 300]


def test_options(spark):
    off = md.MarkdownOptions(detect_lists=False, detect_code=False)
    assert apply(spark, lambda c: md.to_markdown(c, off), ["• Item\nconst x = 5;"]) == ["• Item\nconst x = 5;\n"]
    assert apply(spark, md.to_markdown, [None]) == [None]


def test_nulls_and_empty(spark):
    """Null in, null out, for every rule; an empty text is no error."""
    df = spark.createDataFrame([(0, None), (1, "")], "i int, x string")
    rules = [r for r, _ in RULES] + [t.has_cjk]
    rows = sorted(df.select("i", *(r(F.col("x")).alias(f"r{k}") for k, r in enumerate(rules))).collect(), key=lambda r: r["i"])
    assert [rules[k].__name__ for k in range(len(rules)) if rows[0][f"r{k}"] is not None] == []
    assert all(rows[1][f"r{k}"] is not None for k in range(len(rules)))


def test_trim_and_lines_of_every_blank(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    texts = [b + "a" + b + "ä" + b + "\n" + b for b in blanks] + ["\x1ca\x1c", "​a​", "", "".join(blanks), "a\r\nb\r\r\n\rc\n", "\r", "\n", "\n\n", "a\r \nb"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    got = [tuple(r) for r in rows.select("x", t.trim(F.col("x")), md.lines(F.col("x"))).collect()]
    by_regex = F.regexp_replace("x", f"^[{t.WS}]+|[{t.WS}]+$", "")
    cut = F.transform(F.split("x", "\n", -1), lambda y: F.regexp_replace(y, r"\r$", ""))
    of = F.when(F.col("x") == "", F.array().cast("array<string>")).when(F.col("x").endswith("\n"), F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    assert got == [tuple(r) for r in rows.select("x", by_regex, of).collect()]


def test_page_lines_without_digits_go(spark):
    texts = ["a\n\nPAGE\n\nb", "a\n\npage of x\n\nb", "Page 3 of 9\n\nb", "a\n\n- 7 -", "a\n\nPages\n\nb", "a\nPage 3\nb", "12\n---\nb"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(md.remove_page_numbers(F.col("x"))).collect()]
    assert got == ["a\n\n\nb", "a\n\n\nb", "\nb", "a\n", "a\n\nPages\n\nb", "a\nPage 3\nb", "---\nb"]
