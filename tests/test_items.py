from pyspark.sql import functions as F

from pagewright.operators import detect, items

SCHEMA = "doc_id long, page int, seq long, line_no int, y double, font_size double, base_size string, gap string, region string, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def test_sizes_with_nulls_ties_and_repeats(spark):
    df = table(spark, [(1, 1, 1, 1, 0.0, None), (1, 1, 2, 2, 0.0, 8.0), *[(2, 1, 1, 1, 0.0, 12.0)] * 2, *[(2, 1, 2, 2, 0.0, 10.0)] * 2, (None, 1, 1, 1, 0.0, 11.0)])
    bases = items.modal_sizes(df.select("doc_id", "font_size"))
    assert {r["doc_id"]: r["base_size"] for r in bases.collect()} == {1: 12.0, 2: 10.0, None: 11.0}
    assert {r["doc_id"]: r["base_size"] for r in items.modal_sizes(df.select("doc_id", "font_size"), default=10.0).collect()}[1] == 10.0
    level = spark.range(1).select(items.header_level(F.lit(None).cast("double"), F.lit(10.0), F.array(F.lit(20.0))).alias("a"), items.header_level(F.lit(20.0), F.lit(0.0), F.array(F.lit(20.0))).alias("b")).first()
    assert tuple(level) == (None, None)


def test_order_with_nulls(spark):
    rows = [(1, 1, k, k, None, 9.0) for k in range(6)] + [(2, 1, k, k, 100.0 + 300 * (k % 2) + k, 9.0) for k in range(8)] + [(2, 1, 7, 7, 407.0, 9.0)]
    got = {r["doc_id"]: r["chaotic"] for r in items.chaotic_order(table(spark, rows)).collect()}
    assert got == {1: None, 2: True} or got == {1: False, 2: True}
    regions = items.table_regions(table(spark, [(1, 1, k, k, y, 9.0) for k, y in enumerate((10.0, 20.0, 30.0, 40.0, 90.0, 90.0))])).collect()
    assert [(r["region"], r["y_min"], r["y_max"], r["n"]) for r in regions] == [(0, 5.0, 45.0, 4)]


def test_empty_tables(spark):
    df = table(spark, [])
    plain = df.select("doc_id", "page", "seq", "line_no", "y", "font_size")
    bases = items.modal_sizes(plain.select("doc_id", "font_size"))
    for result in (bases, items.heading_tiers(plain, bases), items.paragraph_thresholds(plain, bases), items.chaotic_order(df), items.table_regions(df), items.gap_statistics(plain), items.gap_histogram(plain, bases), items.gap_lines(plain, bases)):
        assert result.count() == 0
    facts = spark.createDataFrame([], "doc_id long, page_count int, text_ops int, has_images boolean, has_template_image boolean")
    assert detect.classify(facts).count() == 0


def test_classify_with_nulls_and_repeats(spark):
    rows = [(1, 2, None, None, None), (2, 1, 5, False, False), (2, 1, 5, False, False), (None, 1, 0, True, False)]
    got = {r["doc_id"]: (r["pdf_type"], r["pages_sampled"]) for r in detect.classify(spark.createDataFrame(rows, "doc_id long, page_count int, text_ops int, has_images boolean, has_template_image boolean")).collect()}
    assert got[2] == ("text_based", 2) and got[None] == ("scanned", 1) and got[1][1] == 1
