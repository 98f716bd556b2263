from pdf_writer import simple

from pagewright.operators import reports
from pagewright.sources import pdf
from pagewright.streaming import ingest

TEXT = b"BT /F1 12 Tf 72 700 Td (one of them) Tj 0 -14 Td (two of them) Tj 0 -14 Td (three) Tj ET"


def test_stream(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n in range(2):
        (files / f"{n}.pdf").write_bytes(simple([TEXT]))
        ingest.stream_markdown(spark, str(files), out, state).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert len(got) == 2 and {r["markdown"] for r in got} == {"one of them two of them three\n"} and {r["batch"] for r in got} == {0, 1}
    items = ingest.stream_items(spark, str(files))
    assert items.isStreaming and "text" in items.columns


def test_reports(spark):
    fonts = {"D1": {"Subtype": b"/Type1", "BaseFont": b"/Y", "Encoding": {"Differences": [97, b"/a", b"/fi"]}}}
    docs = spark.createDataFrame([(1, bytearray(simple([TEXT, TEXT], fonts)))], "doc_id long, content binary")
    items = pdf.text_items(docs)
    assert reports.page_dump(items, 2, 2).count() == 3 and reports.items_at(items, 1, 690).count() == 1
    assert tuple(reports.order_facts(items, 1, 0, 100).first()) == (1, 3, 672, 700)
    assert reports.ligature_items(items)[1].count() == 0
    row = reports.fonts(docs).where("page = 1").first()
    assert (row["base_font"], row["differences"], row["ligatures"], row["has_a"], row["has_space"]) == ("Y", 2, 1, True, False)
