import pytest
from pyspark.sql import functions as F

from pagewright.operators import detect


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8])
def test_sampled_pages(spark, k):
    got = {r["n"]: r["s"] for r in spark.range(1, 120).select(F.col("id").cast("int").alias("n")).select("n", detect.sampled_pages(F.col("n"), k).alias("s")).collect()}
    for n, pages in got.items():
        if n <= k:
            want = list(range(1, n + 1))
        else:
            step = (n - 2) // (k - 1) if k > 1 else 0
            want = sorted({1, n} | {p for p in (1 + step * i for i in range(1, max(1, k - 1))) if 1 < p < n})
        assert pages == want, (n, k)


def test_scan(spark):
    cases = {b"BT (Hello World) Tj ET": (1, False), b"[(H) 10 (ello)] TJ": (1, False), b"q 1 0 0 1 0 0 cm /Img1 Do Q": (0, True), b"(a) Tjx Dot": (0, False), b"": (0, False)}
    df = spark.createDataFrame([(bytearray(c),) for c in cases], "content binary")
    got = {bytes(r["content"]): (r["n"], r["d"]) for r in df.select("content", detect.text_operators(F.col("content")).alias("n"), detect.draws_objects(F.col("content")).alias("d")).collect()}
    assert got == cases


def test_classify(spark):
    pages = [
        ("template", 9, True, True), ("template", 0, True, False), ("text", 5, False, False), ("text", 9, False, False), ("scan", 0, True, False), ("image", 2, True, False),
        ("mixed", 5, True, False), ("mixed", 0, True, False), ("blank", 0, False, False), ("few", 1, False, False),
    ]
    df = spark.createDataFrame([(d, 1, o, i, x) for d, o, i, x in pages], "doc_id string, page_count int, text_ops int, has_images boolean, has_template_image boolean")
    got = {r["doc_id"]: (r["pdf_type"], r["confidence"], r["ocr_recommended"]) for r in detect.classify(df).collect()}
    assert got == {
        "template": ("mixed", 0.65, True), "text": ("text_based", 1.0, False), "scan": ("scanned", 0.95, True), "image": ("image_based", 0.8, True), "mixed": ("mixed", 0.7, True),
        "blank": ("scanned", 0.9, True), "few": ("text_based", 0.5, False),
    }
