from pdf_writer import simple

from pagewright.functions.markdown import MarkdownOptions
from pagewright.layout.assemble import base_size, header_level, items_to_markdown, lines_to_markdown, merge_drop_caps
from pagewright.layout.lines import group_into_lines
from pagewright.layout.spacing import Item
from pagewright.operators import documents


def it(text, y, size=12.0, x=72.0, page=1, font="F1", **kw):
    return Item(text, x, y, len(text.encode()) * size * 0.5, size, font, size, page, **kw)


def test_headings():
    items = [it("Title here", 740, 24), it("Chapter one", 700, 18), it("Section one", 660, 15), it("Part of it", 620, 14.4)] + [it("Body text goes on", 590 - 14 * k) for k in range(6)]
    md = items_to_markdown(items)
    assert [line for line in md.split("\n") if line.startswith("#")] == ["# Title here", "## Chapter one", "### Section one", "#### Part of it"]
    assert "Body text goes on Body text goes on" in md
    assert "#" not in items_to_markdown(items, MarkdownOptions(detect_headers=False))
    assert [header_level(s, 10, []) for s in (20, 15, 12.5, 12, 11)] == [1, 2, 3, 4, None]
    assert base_size([12, 12, 10, 10, 8, 8, 8]) == 10 and base_size([]) == 12


def test_blocks():
    items = [it("First line", 700), it("goes on", 686), it("• point", 660), it("wrapped", 646, x=80), it("Figure 1: x", 560), it("let x = 1", 540, x=200, font="Courier"), it("Last words", 500), it("Next page", 700, page=2)]
    assert items_to_markdown(items).split("\n") == ["First line goes on", "", "- point wrapped", "Figure 1: x", "", "```", "let x = 1", "```", "Last words", "", "", "", "Next page", ""]


def test_wrapped_heading_and_drop_cap():
    lines = group_into_lines([it("A heading", 700, 20), it("in two lines", 678, 20)] + [it("body", 640 - 14 * k) for k in range(4)])
    assert lines_to_markdown(lines).startswith("# A heading in two lines\n")
    caps = group_into_lines([it("nce upon a time", 700), it("there was", 686), it("O", 690, 40, x=40)])
    merged = merge_drop_caps(caps, 12)
    assert [x.text() for x in merged][0] == "Once upon a time" and len(merged) == 2


def test_objects():
    image = Item("[Image: Im1]", 0, 650, 10, 10, "", 0, 1, item_type="image")
    items = [it("above", 700), it("below", 600), image]
    assert items_to_markdown(items) == "above\n\n\n![Image: Im1](image)\nbelow\n"
    cells = [Item(f"{r}.{c}", 100 + 100 * c, 500 - 20 * r, 10, 8, "F1", 8.0) for r in range(4) for c in range(4)]
    md = items_to_markdown([it("Words before it", 600, 10.0), *cells, it("Words after it", 300, 10.0)])
    assert md.index("Words before") < md.index("| 0.0 | 0.1 |") < md.index("Words after")


def test_process(spark, tmp_path):
    text = b"BT /F1 24 Tf 72 740 Td (A Title) Tj ET " + b" ".join(b"BT /F1 12 Tf 72 %d Td (Body words number %d) Tj ET" % (700 - 14 * k, k) for k in range(8))
    docs = spark.createDataFrame([(1, bytearray(simple([text, text]))), (2, bytearray(b"junk")), (3, bytearray(simple([b"q Q"])))], "doc_id long, content binary")
    got = {r["doc_id"]: r for r in documents.process_pdfs(docs).collect()}
    assert got[1]["pdf_type"] == "text_based" and got[1]["markdown"].startswith("# A Title\n\nBody words number 0 Body words number 1")
    assert got[2]["error"]["kind"] == "parse" and got[2]["markdown"] is None and got[3]["pdf_type"] == "scanned" and got[3]["markdown"] is None
    status = {r["doc_id"]: r["exit_status"] for r in documents.recommendation(documents.detect_pdf_types(docs)).collect()}
    assert status == {1: 0, 2: 1, 3: 2}
    found = documents.lines(documents.text_items(docs)).where("doc_id = 1 AND page = 2").orderBy("line_no").collect()
    assert [r["text"] for r in found][:2] == ["A Title", "Body words number 0"]
    json = documents.processing_json(documents.process_pdfs(docs)).where("doc_id = 2").first()["value"]
    assert json == '{"pdf_type":null,"page_count":null,"has_text":false,"markdown_length":0,"markdown":null}'
