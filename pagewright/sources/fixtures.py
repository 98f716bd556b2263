"""Lines, page facts, items and content streams worked out from the driver's tables, in portable arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: k of a line -> its text in SQL (Spark and DuckDB); `line` is the raw line, `line_no` its number from 1.
MARKERS = {
    0: "concat('• ', line)", 1: "concat('- ', line)", 2: "''", 3: "concat('(a) ', line)", 4: "concat('Figure 1: ', line)", 5: "concat('const ', line)", 6: "concat(line, ';')",
    7: "cast(line_no % 1000 as varchar(10))", 8: "'Page 3 of 9'", 9: "'Intro........12'", 10: "concat('well - known ', line)", 11: "concat('see https://example.com/x. ', line)", 12: "''",
    13: "concat('.5 ', line)", 14: "'fn x() { y[0]; }'", 15: "concat('nota ', line)", 16: "'- 7 -'", 17: "concat('e', 'ﬁ', 'x ', line)", 18: "concat(' ', line)", 19: "concat('12. ', line)",
    20: "concat('Source: ', line)", 21: "'---'",
}
MARKED = "CASE (doc_id * 7 + line_no * 5) % 24 " + " ".join(f"WHEN {k} THEN {v}" for k, v in MARKERS.items()) + " ELSE line END"

#: The same table for DuckDB, as a common table expression.
FX_LINES_SQL = f"""
    raw AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, string_split(coalesce(text, ''), chr(10))[i] AS line
            FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
    fx_lines AS (SELECT doc_id, line_no, {MARKED} AS line FROM raw)"""

FX_PAGES_SQL = """
    fx_pages AS (
        SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS page,
               CAST((l_orderkey % 3) * (CAST(l_quantity AS INTEGER) % 5) AS INTEGER) AS text_ops, l_returnflag = 'R' AS has_images,
               CASE WHEN l_returnflag = 'R' AND l_partkey % 11 = 0 THEN 600000 ELSE 1000 END AS image_area
        FROM lineitem)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_lines(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """(doc_id, line_no, line): every line of documents with a marker that some rule looks for; tasks: by document in so many."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = (docs.repartition(tasks, "doc_id") if tasks else docs).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line"))
    return raw.select("doc_id", (F.col("at") + 1).alias("line_no"), "line").select("doc_id", "line_no", F.expr(MARKED).alias("line"))


def fx_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the lines of fx_lines joined again, without a shuffle."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("raw"))
    marked = F.expr("transform(raw, (l, i) -> " + MARKED.replace("line_no", "(i + 1)").replace("line", "l") + ")")
    return docs.select("doc_id", F.array_join(marked, "\n").alias("text"))


def fx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, text_ops, has_images, image_area): page facts from lineitem, an order being a document."""
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("fx_lineitem")
    return spark.sql("WITH " + FX_PAGES_SQL.replace("FROM lineitem", "FROM fx_lineitem") + " SELECT * FROM fx_pages")


def fx_content(pages: DataFrame) -> DataFrame:
    """(doc_id, page, content): content streams with as many text operators as the page facts say."""
    ops = F.concat(F.repeat(F.lit("(a) Tj "), F.col("text_ops")), F.when(F.col("has_images"), "/Im1 Do").otherwise(""))
    return pages.select("doc_id", "page", ops.cast("binary").alias("content"))


#: Lines on a page grid: 55 to a page, 12 points apart; some lines are headings by size.
FX_GRID = """
    SELECT doc_id, CAST(floor((line_no - 1) / 55) AS INTEGER) + 1 AS page, line_no, line, CAST(760 - 12 * ((line_no - 1) % 55) - CASE WHEN line_no % 9 = 0 THEN 6 ELSE 0 END AS DOUBLE) AS y,
           CASE (doc_id * 7 + line_no * 5) % 24 WHEN 9 THEN 24.0 WHEN 19 THEN 18.0 WHEN 4 THEN 15.0 WHEN 8 THEN 8.0 ELSE CASE WHEN doc_id % 5 = 0 THEN 10.0 ELSE 12.0 END END AS font_size
    FROM fx_lines"""
FX_GRID_SQL = f"{FX_LINES_SQL}, fx_grid AS ({FX_GRID.replace('/ 55', '// 55')})"

#: Cells of tables: an order is a document, its lines are rows, four columns 100 points apart.
FX_CELLS = """
    SELECT l_orderkey AS doc_id, 1 AS page, row_no * 4 + c AS seq, CAST(72 + 100 * c + (l_partkey % 5) AS DOUBLE) AS x,
           CAST(700 - 12 * row_no - CASE WHEN row_no >= 4 AND l_orderkey % 3 = 0 THEN 40 ELSE 0 END AS DOUBLE) AS y
    FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no FROM lineitem) r
    CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k"""
FX_CELLS_SQL = f"fx_cells AS ({FX_CELLS})"


def fx_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, line_no, line, y, font_size): fx_lines placed on pages."""
    return _placed(spark, fx_lines(spark, sf_dir))


def _placed(spark: SparkSession, lines: DataFrame) -> DataFrame:
    lines.createOrReplaceTempView("fx_lines")
    return spark.sql(FX_GRID).withColumn("font_size", F.col("font_size").cast("double"))


def fx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, seq, x, y): table cells from lineitem."""
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("fx_lineitem")
    return spark.sql(FX_CELLS.replace("FROM lineitem", "FROM fx_lineitem"))


def fx_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): a PDF of each document's fx_grid, every line shown at its place, in UTF-16. Texts move once, to as
    many tasks as set for shuffles, as what is done with files takes longer than their bytes tell."""
    grid = _placed(spark, fx_lines(spark, sf_dir, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shown = F.concat(
        F.lit("BT /F1 "), F.col("font_size").cast("int").cast("string"), F.lit(" Tf 72 "), F.col("y").cast("int").cast("string"),
        F.lit(" Td <FEFF"), F.hex(F.encode("line", "UTF-16BE")), F.lit("> Tj ET\n"),
    )
    joined = lambda c, key: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, c))), lambda t: t["x"]), "")
    pages = grid.groupBy("doc_id", "page").agg(joined(shown.alias("x"), "line_no").alias("text"))
    number = lambda k: (F.col("page") * 2 + k).cast("string")
    page = F.concat(
        number(10), F.lit(" 0 obj\n<</Type /Page /Parent 2 0 R /Contents "), number(11), F.lit(" 0 R>>\nendobj\n"),
        number(11), F.lit(" 0 obj\n<</Length "), F.octet_length("text").cast("string"), F.lit(">>\nstream\n"), F.col("text"), F.lit("\nendstream\nendobj\n"),
    )
    docs = pages.groupBy("doc_id").agg(joined(page.alias("x"), "page").alias("body"), joined(F.concat(number(10), F.lit(" 0 R ")).alias("x"), "page").alias("kids"), F.count(F.lit(1)).alias("n"))
    content = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<</Type /Catalog /Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type /Pages /Count "), F.col("n").cast("string"), F.lit(" /Kids ["), F.col("kids"),
        F.lit("] /Resources <</Font <</F1 <</Type /Font /Subtype /Type1 /BaseFont /Helvetica>>>>>>>>\nendobj\n3 0 obj\n<</Title (Document "), F.col("doc_id").cast("string"),
        F.lit(")>>\nendobj\n"), F.col("body"), F.lit("trailer\n<</Root 1 0 R /Info 3 0 R>>\n%%EOF\n"),
    )
    return docs.select("doc_id", content.cast("binary").alias("content"))
