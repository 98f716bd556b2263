import json

from pdf_writer import simple, stream

from pagewright import cli
from pagewright.operators import documents
from pagewright.sources import pdf

TEXT = b"BT /F1 12 Tf 72 700 Td (one of them) Tj 0 -14 Td (two of them) Tj 0 -14 Td (three) Tj ET"
SCAN = {"Resources": {"XObject": {"Im1": b"81 0 R"}}}


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.pdf").write_bytes(simple([TEXT], more={5: {"Title": b"(A title)"}}, info=5))
    one = str(tmp_path / "a.pdf")
    assert cli.main(["pdf2md", one, "--raw"], spark) == 0
    assert capsys.readouterr().out == "one of them two of them three\n\n"
    assert cli.main(["detect", one], spark) == 0
    shown = capsys.readouterr().out
    assert "Type: TEXT-BASED (extractable text)\nConfidence: 100%" in shown and "Title: A title" in shown and "Recommendation: Use direct text extraction (fast)" in shown
    assert cli.main(["pdf2md", one, str(tmp_path / "out")], spark) == 0
    assert "Pages: 1" in capsys.readouterr().out and "one of them two" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    (tmp_path / "b.pdf").write_bytes(simple([b"/Im1 Do"], page=SCAN, more={81: stream(b"", Subtype=b"/Image", Width=10, Height=10)}))
    assert cli.main(["pdf2md", str(tmp_path)], spark) == 2 and cli.main(["pdf2md", str(tmp_path), "--json"], spark) == 0
    records = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [(r["pdf_type"], r["markdown"]) for r in records] == [("text_based", "one of them two of them three\n"), ("scanned", None)]
    (tmp_path / "c.pdf").write_bytes(b"junk")
    assert cli.main(["detect", str(tmp_path), "--json"], spark) == 1
    records = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [r.get("pdf_type") for r in records] == ["text_based", "scanned", None] and "error" in records[2]


def test_one_parse_and_no_shuffle(spark):
    rows = [(1, bytearray(simple([TEXT])), "x"), (1, bytearray(simple([TEXT])), "y"), (2, None, "z"), (None, bytearray(simple([TEXT])), None)]
    docs = spark.createDataFrame(rows, "doc_id long, content binary, pdf_type string")
    results = documents.process_pdfs(docs)
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    got = sorted(((r["doc_id"], r["pdf_type"], r["error"] and r["error"]["kind"], r["markdown"]) for r in results.collect()), key=repr)
    text = "one of them two of them three\n"
    assert got == sorted([(1, "text_based", None, text), (1, "text_based", None, text), (2, None, "parse", None), (None, "text_based", None, text)], key=repr)
    assert documents.process_pdfs(docs.limit(0)).count() == 0
    assert pdf.links(docs).count() == 0 and {r["error"]["kind"] for r in pdf.unicode_maps(docs).collect()} == {"parse"}
