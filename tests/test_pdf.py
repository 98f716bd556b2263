import pytest
from pdf_writer import build, simple, stream

from pagewright.pdf.content import page_items
from pagewright.pdf.fonts import ToUnicode, glyph_to_char
from pagewright.pdf.objects import Document, Lexer, Name, PdfError, Ref
from pagewright.sources import pdf

HELLO = b"BT /F1 12 Tf 100 700 Td (Hello) Tj 0 -20 Td [(W) 10 (or) -300 (ld)] TJ ET"


def items(data, n=1):
    d = Document(data)
    return page_items(d, d.pages()[n - 1], n)


def test_lexer():
    lex = Lexer(rb"<</A [1 -2.5 (a\(b\)\101\n) <48 6> 3 0 R true null] /B#20C /D>> % note" + b"\n(x(y)z)")
    assert lex.next() == {"A": [1, -2.5, b"a(b)A\n", b"H`", Ref(3, 0), True, None], "B C": Name("D")}
    assert lex.next() == b"x(y)z"


@pytest.mark.parametrize("packed", [False, True])
def test_text_and_title(packed):
    data = simple([HELLO, b"BT /F1 10 Tf (two) Tj ET"], more={5: {"Title": b"(A title)"}}, info=5, packed=packed)
    got = items(data)
    assert [(i["text"], i["x"], i["y"], i["font_size"], i["page"]) for i in got] == [("Hello", 100, 700, 12, 1), ("Wor ld", 100, 680, 12, 1)]
    assert Document(data).title() == "A title" and len(Document(data).pages()) == 2


def test_state_and_widths():
    font = {"Subtype": b"/TrueType", "BaseFont": b"/Arial-BoldItalic", "FirstChar": 32, "LastChar": 66, "Widths": [250] + [500] * 34}
    got = items(simple([b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 1 0 0 1 5 6 Tm (AB) Tj (A) Tj T* (B) Tj ET Q BT /F1 10 Tf (A) Tj (  ) Tj (B) ' ET"], {"F1": font}))
    assert [(i["text"], i["x"], i["y"], i["width"]) for i in got] == [("AB", 20, 32, 20), ("A", 40, 32, 10), ("B", 20, 8, 10), ("A", 0, 0, 5), ("B", 0, -12, 0)]
    assert got[0]["is_bold"] and got[0]["is_italic"] and got[0]["font"] == "F1"


def test_blank_and_size():
    got = items(simple([b"BT /F1 10 Tf 3 0 0 2 0 0 Tm ( ) Tj (A) Tj ET (B) Tj"]))
    assert [(i["text"], i["font_size"]) for i in got] == [("A", 30)]


def test_cmaps():
    two = ToUnicode.parse(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0041> <0042> endbfchar 1 beginbfrange <0003> <0005> [<0041> <0042> <0043>] <0010> <0012> <0061> endbfrange")
    assert two.width == 2 and [two.lookup(c) for c in (0x41, 3, 4, 5, 0x11, 99)] == ["B", "A", "B", "C", "b", None]
    assert two.decode(b"\x00\x41\x00\x63") == "B" and two.decode(b"\x42\x79") == ""
    one = ToUnicode.parse(b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfchar <42> <0042> <79> <0079> endbfchar")
    assert one.width == 1 and one.decode(b"\x42\x79") == "By" and one.decode(b"\x42a\x79") == "Bay"
    assert ToUnicode.parse(b"nothing") is None


def test_type0_font_and_differences():
    cmap = stream(b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfchar <0001> <0046> <0002> <FB01> endbfchar")
    fonts = {
        "C1": {"Subtype": b"/Type0", "BaseFont": b"/X", "ToUnicode": b"70 0 R", "DescendantFonts": [{"DW": 800, "W": [1, [400, 600], 5, 7, 300]}]},
        "D1": {"Subtype": b"/Type1", "BaseFont": b"/Y", "Encoding": {"Differences": [65, b"/eacute", b"/nothing", b"/uni00E7"]}},
        "W1": {"Subtype": b"/Type1", "BaseFont": b"/Z", "Encoding": b"/WinAnsiEncoding"},
    }
    got = items(simple([b"BT /C1 10 Tf <00010002> Tj /D1 10 Tf (ABC) Tj /W1 10 Tf (\x93a\x94) Tj ET"], fonts, more={70: cmap}))
    assert [i["text"] for i in got] == ["Ffi", "éBç", "“a”"]
    assert got[0]["width"] == pytest.approx(10)


def test_glyph_names():
    cases = {"A": "A", "eacute": "é", "Ccedilla": "Ç", "scaron": "š", "alpha": "α", "Omega": "Ω", "quotedblleft": '"', "quoteright": "’", "fi": "ﬁ", "uni20AC": "€", "u1F600": "😀", "nonsense": None, "space": " ", "Euro": "€", "uniD800": None}
    assert {n: glyph_to_char(n) for n in cases} == cases


def test_objects_images_links():
    form = stream(b"BT /F1 8 Tf 1 2 Td (inner) Tj ET", Type=b"/XObject", Subtype=b"/Form")
    image = stream(b"\0", Type=b"/XObject", Subtype=b"/Image", Width=1000, Height=600)
    link = {"Subtype": b"/Link", "Rect": [10, 20, 110, 40], "A": {"S": b"/URI", "URI": b"(https://a.b)"}}
    page = {"Resources": {"XObject": {"Im1": b"81 0 R", "Fm1": b"80 0 R"}, "Font": {"F1": {"Subtype": b"/Type1", "BaseFont": b"/Helvetica"}}}, "Annots": [link, {"Subtype": b"/Text", "Rect": [0, 0, 1, 1]}]}
    got = items(simple([b"q 50 0 0 60 7 8 cm /Im1 Do Q /Fm1 Do"], page=page, more={80: form, 81: image}))
    assert [(i["item_type"], i["text"], i["x"], i["y"], i["width"], i["height"]) for i in got] == [("image", "[Image: Im1]", 7, 8, 50, 60), ("text", "inner", 1, 2, 0, 8), ("link", "https://a.b", 10, 20, 100, 20)]


def test_errors():
    with pytest.raises(PdfError):
        Document(b"no file")
    with pytest.raises(PdfError) as e:
        Document(simple([HELLO], trailer={"Encrypt": {"V": 1}}))
    assert e.value.kind == "encrypted"


def test_update_and_damage():
    data = simple([HELLO]) + b"\n50 0 obj\n<</Length 31>>\nstream\nBT /F1 9 Tf (updated text) Tj ET\nendstream\nendobj\n"
    assert [i["text"] for i in items(data)] == ["updated text"]
    assert [i["text"] for i in items(simple([HELLO])[:-40])] == ["Hello", "Wor ld"]


def test_spark(spark, tmp_path):
    scan = {"Resources": {"XObject": {"Im1": b"81 0 R"}}}
    files = {
        "text.pdf": simple([HELLO * 3] * 7, more={5: {"Title": b"(T)"}}, info=5), "scan.pdf": simple([b"/Im1 Do"], page=scan, more={81: stream(b"", Subtype=b"/Image", Width=10, Height=10)}),
        "bad.pdf": b"junk", "locked.pdf": simple([HELLO], trailer={"Encrypt": {"V": 1}}), "none.pdf": build({1: {"Type": b"/Catalog", "Pages": b"2 0 R"}, 2: {"Type": b"/Pages", "Kids": []}}), "other.txt": b"x",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    docs = pdf.read_pdfs(spark, str(tmp_path))
    names = {r["doc_id"]: r["path"].rsplit("/", 1)[1] for r in docs.collect()}
    got = {names[r["doc_id"]]: r for r in pdf.detect_pdf_types(docs).collect()}
    assert len(got) == 5 and {n: r["pdf_type"] for n, r in got.items()} == {"text.pdf": "text_based", "scan.pdf": "scanned", "bad.pdf": None, "locked.pdf": None, "none.pdf": None}
    assert (got["text.pdf"]["page_count"], got["text.pdf"]["pages_sampled"], got["text.pdf"]["title"]) == (7, 5, "T")
    assert got["bad.pdf"]["error"]["kind"] == "parse" and got["locked.pdf"]["error"]["kind"] == "encrypted"
    text = {names[r["doc_id"]]: r["text"] for r in pdf.extract_text(docs).collect()}
    assert text["text.pdf"].startswith("Hello\nWor ld\nHello")
    assert pdf.text_items(docs).where("error IS NULL").count() == 43


def test_maps_by_names():
    cmap = stream(b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfchar <0001> <0046> endbfchar")
    named = {"Type": b"/Font", "Subtype": b"/Type0", "BaseFont": b"/Sans", "ToUnicode": b"70 0 R"}
    fonts = {"N1": {"Subtype": b"/Type1", "BaseFont": b"/ABCDEF+Sans"}, "E1": {"Subtype": b"/Type1", "BaseFont": b"/E", "Encoding": b"/WinAnsiEncoding"}}
    data = simple([b"BT /N1 9 Tf <0001> Tj /FSans 9 Tf <0001> Tj /E1 9 Tf <FEFF0041> Tj ET"], fonts, more={70: cmap, 71: named})
    d = Document(data)
    assert [i["text"] for i in items(data)] == ["F", "F", "þÿA"]
    maps = d.font_maps
    assert set(maps.by_number) == {70} and set(maps.by_name) == {"Sans", "Sans_70"} and maps.get("FSa") is None and maps.get("XSansX") is maps.by_number[70]
    assert raw_stream(data, 70).startswith(b"begincode") and raw_stream(data, 999) is None and raw_stream(b"1 0 obj stream\nx\r\nendstream", 1) == b"x"


def test_styles():
    names = {"foo-mediumitalic": (False, True), "Foo-Medium": (True, False), "A-Bd": (True, False), "SemiBoldOblique": (True, True), "Plain": (False, False)}
    assert {n: (is_bold(n), is_italic(n)) for n in names} == names
    wanted = {"f_i": "ﬁ", "f_l": "ﬂ", "f_f": "ﬀ", "f_f_i": "ﬃ", "f_f_l": "ﬄ", "partialdiff": "∂", "summation": "∑", "product": "∏", "radical": "√", "approxequal": "≈", "lozenge": "◊", "Lambda": "Λ", "lambda": "λ"}
    assert {n: glyph_to_char(n) for n in wanted} == wanted and glyph_to_char("u41") is None


from pagewright.pdf.content import is_bold, is_italic  # noqa: E402
from pagewright.pdf.fonts import raw_stream  # noqa: E402


def test_tokens_and_comments_at_the_end():
    from pagewright.pdf.objects import Lexer, Op

    def every(data):
        lex, out = Lexer(data), []
        while True:
            try:
                out.append(lex.next())
            except EOFError:
                return out

    assert every(b" 12 -3.5 +4 .5 1. /A#42 /  <4 1 4> <414> <> (a\\(b) [1 2 R /x] <</K 3>> true null q % no (tokens\n T* ]>>} %%EOF") == [
        12, -3.5, 4, 0.5, 1.0, "AB", "", b"A@", b"A@", b"", b"a(b", [Ref(1, 2), "x"], {"K": 3}, True, None, "q", "T*", "]", ">>", "}",
    ]
    assert every(b"%%EOF") == [] and every(b"  ") == [] and isinstance(every(b"1-2")[0], Op)


def test_a_wide_line_costs_no_bins():
    from pagewright.layout.lines import columns
    from pagewright.layout.spacing import Item

    items = [Item("w" * 5, 72.0, 700.0 - 12 * k, 1e12) for k in range(20)]  # before: 5e11 bins
    assert columns(items) == [(72.0, 72.0 + 1e12)]


def test_files_are_spread_over_the_tasks_of_shuffles(spark):
    from oracle import SF_DIR

    from pagewright.plans.queries import QUERIES

    for name in ("md17_document_markdown", "api1_process_pdf"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange") > 0  # adaptive execution leaves these as they are
