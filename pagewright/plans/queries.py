"""Queries over the driver's tables for the library's operators, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import textrules as t
from ..operators import detect, documents, items
from ..sources import pdf
from . import document_queries
from ..sources.fixtures import FX_CELLS_SQL, FX_GRID_SQL, FX_LINES_SQL, FX_PAGES_SQL, fx_cells, fx_content, fx_grid, fx_lines, fx_pages, fx_pdfs, fx_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(document_queries.QUERIES)
ORACLE_SQL: dict[str, str] = dict(document_queries.ORACLE_SQL)


# Fixed values, written out here once more, so that a wrong one in the rules doesn't go unseen.
_WS = r"\t\n\x0B\x0C\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CAPTIONS = (
    "['Figure ', 'Figura ', 'Fig. ', 'Fig ', 'Table ', 'Tabela ', 'Source:', 'Fonte:', 'Source ', 'Fonte ', 'Note:', 'Nota:', 'Chart ', 'Gráfico ', 'Graph ', 'Diagram ', 'Image ', 'Imagem ',"
    " 'Photo ', 'Foto ']"
)
_CODE = "['import ', 'export ', 'from ', 'const ', 'let ', 'var ', 'function ', 'class ', 'def ', 'pub fn ', 'fn ', 'async fn ', 'impl ', '=> ', '-> ', ':: ', ':= ']"
_LETTERS = "a-zA-ZáàâãéèêíïóôõöúçñÁÀÂÃÉÈÊÍÏÓÔÕÖÚÇÑ"
_BOLD_PARTS = "['bold', '-bd', '_bd', 'black', 'heavy', 'demibold', 'semibold', 'demi-bold', 'semi-bold', 'extrabold', 'ultrabold']"
_ITALIC_PARTS = "['italic', 'oblique', '-it', '_it', 'slant', 'inclined', 'kursiv']"
_MONO_PARTS = "['courier', 'consolas', 'monaco', 'menlo', 'mono', 'fixed', 'terminal', 'typewriter', 'source code', 'fira code', 'jetbrains', 'inconsolata']"


def _any(test: str, words: str, x: str) -> str:
    return f"len(list_filter({words}, lambda w: {test}({x}, w))) > 0"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {_lit(f'^[{_WS}]+|[{_WS}]+$')}, '', 'g')"


def _trim_start(x: str) -> str:
    return f"regexp_replace({x}, {_lit(f'^[{_WS}]+')}, '')"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_lit(pattern)})"


def _caption(x: str) -> str:
    return f"({_any('starts_with', _CAPTIONS, _trim(x))} OR {_has(f'lower({_trim(x)})', '^(figure |table |source:)')})"


def _list(x: str) -> str:
    s, five = _trim_start(x), f"substring({_trim_start(x)}, 1, 5)"
    bullets = r"^([•\-*○●◦] |[A-Za-z][.)]|\((?s:.)\))"
    return f"({_has(s, bullets)} OR ({_has(five, '[0-9]')} AND {_has(five, '^[0-9]*[.)]')}))"


def _list_format(x: str) -> str:
    s = _trim_start(x)
    bullet = _has(s, "^[•○●◦]")
    return f"CASE WHEN {bullet} THEN concat('- ', {_trim_start(f'substring({s}, 2)')}) ELSE {s} END"


def _code(x: str) -> str:
    s = _trim(x)
    marks = f"length(regexp_replace({s}, {_lit(r'[^{}()\[\];=<>]')}, '', 'g'))"
    return f"({_any('starts_with', _CODE, s)} OR ({marks} >= 3 AND strlen({s}) < 200) OR {_has(s, '[;{}]$')})"


def _page_number(x: str) -> str:
    of = f"instr({x}, ' of ')"
    before, after = _trim(f"substring({x}, 1, {of} - 1)"), _trim(f"substring({x}, {of} + 4)")
    numbers = (r"^\d{1,4}$", f"^page[{_WS}]*($|of|[0-9])", f"^-[{_WS}]*[0-9]+[{_WS}]*-$")
    some = " OR ".join(_has(f"lower({x})", p) for p in numbers)
    return f"({x} <> '' AND ({some} OR ({of} > 0 AND {_has(before, '^[0-9]+$')} AND {_has(after, '^[0-9]+$')})))"


def _dots(x: str) -> str:
    return f"regexp_replace({x}, {_lit(r'\.{4,}')}, ' ... ', 'g')"


def _hyphens(x: str) -> str:
    return f"regexp_replace({x}, {_lit(f'([{_LETTERS}]) - ([{_LETTERS}])')}, '\\1-\\2', 'g')"


def _urls(x: str) -> str:
    return f"regexp_replace({x}, {_lit(f'(https?://[^{_WS}<>)\\]]+[^{_WS}<>)\\].,;])')}, '[\\1](\\1)', 'g')"


def _ligatures(x: str) -> str:
    out = f"regexp_replace({x}, {_lit(r'[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}]')}, '', 'g')"
    for one, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = f"replace({out}, '{one}', '{letters}')"
    return out


def _number(x: str) -> str:
    return f"({_has(_trim(x), '^[0-9.,+-]+$')} AND {_has(_trim(x), '[0-9]')})"


def _table_data(x: str) -> str:
    s = _trim(x)
    digit, short = _has(s, "[0-9]"), f"strlen({s}) <= 10"
    return (
        f"({s} <> '' AND ({_number(x)} OR ({short} AND {_has(s, '^[0-9/-]+$')} AND {_has(s, '[/-]')} AND {_has(s, '([0-9][/-]*){4}')})"
        f" OR ({short} AND {_has(s, r'^[\pL\pN]+$')} AND {digit}) OR ({digit} AND {_has(s, '°|V|A|Hz|µ|pin')})"
        f" OR (contains({s}, '(') AND contains({s}, ')') AND {digit}) OR ({_has(s, '°[CF]')} AND contains({s}, 'to'))))"
    )


def _footnote(x: str) -> str:
    return f"({_has(_trim(x), r'^\([0-9]*\)|^[0-9]+\)')} OR {_has(f'lower({_trim(x)})', '^notes?:')})"


def _on_lines(name: str, column: str, rule: Callable, sql: Callable[[str], str]) -> None:
    """A rule on every line of fx_lines: (doc_id, line_no, column)."""
    QUERIES[name] = lambda spark, d: fx_lines(spark, d).select("doc_id", "line_no", rule(F.col("line")).alias(column))
    ORACLE_SQL[name] = f"WITH {FX_LINES_SQL} SELECT doc_id, line_no, {sql('line')} AS {column} FROM fx_lines"


_on_lines("md13_captions", "is_caption", t.is_caption, _caption)
_on_lines("md14_list_items", "is_list_item", t.is_list_item, _list)
_on_lines("md15_list_format", "formatted", t.format_list_item, _list_format)
_on_lines("md16_code_like", "is_code", t.is_code_like, _code)
_on_lines("md22_dot_leaders", "collapsed", t.collapse_dot_leaders, _dots)
_on_lines("md23_spaced_hyphens", "joined", t.join_spaced_hyphens, _hyphens)
_on_lines("md25_page_number_lines", "is_page_number", lambda c: t.is_page_number_line(t.trim(c)), lambda x: _page_number(_trim(x)))
_on_lines("md26_url_links", "linked", t.link_urls, _urls)
_on_lines("dec2_ligatures", "expanded", t.expand_ligatures, _ligatures)
_on_lines("tab17_numbers", "is_number", t.looks_like_number, _number)
_on_lines("tab18_table_data", "is_data", t.looks_like_table_data, _table_data)
#: Markers of the fixture, turned into those of footnotes.
_NOTES = {"(a) ": "(1) ", "12. ": "12) ", "nota ": "Notes: "}
_on_lines(
    "tab20_footnotes", "is_footnote",
    lambda c: t.is_footnote_row(reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), _NOTES.items(), c)),
    lambda x: _footnote(reduce(lambda y, kv: f"replace({y}, '{kv[0]}', '{kv[1]}')", _NOTES.items(), x)),
)

# Lines without a last, empty one.
_REAL_LINES = f"""
    {FX_LINES_SQL},
    ends AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last_no FROM fx_lines),
    real_lines AS (SELECT doc_id, line_no, line, {_trim('line')} AS trimmed FROM ends WHERE NOT (line_no = last_no AND line = ''))"""

_REMOVED = f"""
    around AS (
        SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id) AS n,
               lag(trimmed) OVER w AS p1, lead(trimmed) OVER w AS n1, lead(trimmed, 2) OVER w AS n2
        FROM real_lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    marked AS (
        SELECT *, {_page_number('trimmed')} AND (
                   ((i = 1 OR p1 IN ('', '---')) AND (i = n OR n1 IN ('', '---')))
                   OR coalesce(n1 = '---', false) OR coalesce(n1 = '' AND n2 = '---', false)) AS gone
        FROM around),
    removed AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)"""

QUERIES["md30_plain_markdown"] = lambda spark, d: fx_texts(spark, d).select("doc_id", md.to_markdown(F.col("text")).alias("markdown"))
ORACLE_SQL["md30_plain_markdown"] = f"""
    WITH {_REAL_LINES},
    classed AS (SELECT *, CASE WHEN trimmed = '' THEN 'b' WHEN {_list('trimmed')} THEN 'l' WHEN {_code('trimmed')} THEN 'c' ELSE 't' END AS k FROM real_lines),
    fenced AS (
        SELECT *, coalesce(last_value(CASE WHEN k <> 'l' THEN k END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'b') = 'c' AS open
        FROM classed),
    shown AS (
        SELECT doc_id, line_no, k,
               CASE WHEN k <> 'l' AND open <> (k = 'c') THEN '```' || chr(10) ELSE '' END || CASE WHEN k = 'l' THEN {_list_format('trimmed')} ELSE trimmed END || chr(10) AS piece
        FROM fenced),
    docs AS (SELECT doc_id, string_agg(piece, '' ORDER BY line_no) || CASE WHEN coalesce(arg_max(k, line_no) FILTER (k <> 'l'), 'b') = 'c' THEN '```' || chr(10) ELSE '' END AS markdown FROM shown GROUP BY doc_id)
    SELECT d.doc_id, coalesce(markdown, '') AS markdown FROM documents d LEFT JOIN docs USING (doc_id)"""

QUERIES["md24_remove_page_numbers"] = lambda spark, d: fx_texts(spark, d).select("doc_id", md.remove_page_numbers(F.col("text")).alias("cleaned"))
ORACLE_SQL["md24_remove_page_numbers"] = f"WITH {_REAL_LINES}, {_REMOVED} SELECT d.doc_id, coalesce(r.text, '') AS cleaned FROM documents d LEFT JOIN removed r USING (doc_id)"

QUERIES["md21_clean_markdown"] = lambda spark, d: fx_texts(spark, d).select("doc_id", md.clean_markdown(F.col("text")).alias("cleaned"))
ORACLE_SQL["md21_clean_markdown"] = f"""
    WITH {FX_LINES_SQL}, first_pass AS (SELECT doc_id, line_no, {_hyphens(_dots('line'))} AS line FROM fx_lines),
    ends AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last_no FROM first_pass),
    real_lines AS (SELECT doc_id, line_no, line, {_trim('line')} AS trimmed FROM ends WHERE NOT (line_no = last_no AND line = '')),
    {_REMOVED}
    SELECT d.doc_id, {_trim(f"regexp_replace({_urls("coalesce(r.text, '')")}, '\n{{3,}}', chr(10) || chr(10), 'g')")} || chr(10) AS cleaned
    FROM documents d LEFT JOIN removed r USING (doc_id)"""

# Names of fonts that the rules tell apart.
FONT_NAMES = ("Helvetica", "Helvetica-Bold", "Times-BoldItalic", "Arial-Black", "Foo-Medium", "Foo-MediumItalic", "Bar_Bd", "Baz-It", "Courier", "Consolas-Oblique", "Fira Code", "DejaVu Sans Mono", "Kursiv", "F1", "Slanted", "SourceHeavy")


def _fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, FONT_NAMES)), (F.col("p_partkey") % len(FONT_NAMES) + 1).cast("int"))
    fonts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(name, F.lit("-"), (F.col("p_partkey") % 7).cast("string")).alias("font"))
    c = F.col("font")
    return fonts.select("p_partkey", "font", t.is_bold_font(c).alias("is_bold"), t.is_italic_font(c).alias("is_italic"), t.is_monospace_font(c).alias("is_monospace"))


QUERIES["fnt8_font_styles"] = _fonts
_BOLD, _ITALIC, _MONO = (_any("contains", x, "lower(font)") for x in (_BOLD_PARTS, _ITALIC_PARTS, _MONO_PARTS))
ORACLE_SQL["fnt8_font_styles"] = f"""
    WITH f AS (SELECT p_partkey, [{', '.join(map(_lit, FONT_NAMES))}][CAST(p_partkey % {len(FONT_NAMES)} + 1 AS INTEGER)] || '-' || (p_partkey % 7) AS font FROM part)
    SELECT p_partkey, font, {_BOLD} OR (contains(lower(font), 'medium') AND NOT contains(lower(font), 'mediumitalic')) AS is_bold,
           {_ITALIC} AS is_italic, {_MONO} AS is_monospace FROM f"""

# A sample of k pages: 1, n and 1 + i * ((n - 2) div (k - 1)) between them.
_SAMPLED = f"""
    {FX_PAGES_SQL},
    counts AS (SELECT doc_id, max(page) AS page_count FROM fx_pages GROUP BY doc_id),
    sampled AS (
        SELECT p.*, page_count FROM fx_pages p JOIN counts USING (doc_id)
        WHERE page_count <= 5 OR page IN (1, page_count) OR page IN (1 + (page_count - 2) // 4, 1 + 2 * ((page_count - 2) // 4), 1 + 3 * ((page_count - 2) // 4)))"""


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.sample(fx_pages(spark, sf_dir))


QUERIES["det1_page_sample"] = lambda spark, d: _sample(spark, d).select("doc_id", "page", "page_count")
ORACLE_SQL["det1_page_sample"] = f"WITH {_SAMPLED} SELECT doc_id, page, page_count FROM sampled"

QUERIES["det2_scan"] = lambda spark, d: fx_content(fx_pages(spark, d)).select("doc_id", "page", detect.text_operators(F.col("content")).alias("text_ops"), detect.draws_objects(F.col("content")).alias("has_images"))
ORACLE_SQL["det2_scan"] = f"WITH {FX_PAGES_SQL} SELECT doc_id, page, text_ops, has_images FROM fx_pages"

QUERIES["det3_page_analysis"] = lambda spark, d: detect.analyze_pages(fx_content(fx_pages(spark, d)).withColumn("page", (F.col("page") + 1).cast("int").bitwiseAND(F.lit(-2))))
ORACLE_SQL["det3_page_analysis"] = f"""
    WITH {FX_PAGES_SQL}
    SELECT doc_id, CAST((page + 1) // 2 * 2 AS INTEGER) AS page, CAST(sum(text_ops) AS INTEGER) AS text_ops, bool_or(has_images) AS has_images FROM fx_pages GROUP BY ALL"""

QUERIES["det4_image_analysis"] = lambda spark, d: detect.analyze_images(fx_pages(spark, d).where("has_images").select("doc_id", "page", F.lit(100).alias("width"), F.when(F.col("page") % 3 > 0, F.col("image_area") / 100).cast("int").alias("height")))
ORACLE_SQL["det4_image_analysis"] = f"""
    WITH {FX_PAGES_SQL}
    SELECT doc_id, page, CAST(CASE WHEN page % 3 > 0 THEN image_area ELSE 0 END AS BIGINT) AS image_area, page % 3 > 0 AND image_area >= 500000 AS has_template_image FROM fx_pages WHERE has_images"""

QUERIES["det5_classify"] = lambda spark, d: detect.classify(_sample(spark, d).withColumn("has_template_image", F.col("image_area") >= detect.TEMPLATE_AREA))
ORACLE_SQL["det5_classify"] = f"""
    WITH {_SAMPLED},
    f AS (SELECT doc_id, max(page_count) AS page_count, CAST(count(*) AS INTEGER) AS s, CAST(count(*) FILTER (text_ops >= 3) AS INTEGER) AS x, count(*) FILTER (has_images) AS im,
                 count(*) FILTER (image_area >= 500000) AS te, sum(text_ops) AS ops FROM sampled GROUP BY doc_id),
    r AS (SELECT *, CASE WHEN te > 0 AND x > 0 THEN 1 WHEN x / s >= 0.6 THEN 2 WHEN x = 0 AND im > 0 AND ops = 0 THEN 3 WHEN x = 0 AND im > 0 THEN 4 WHEN x > 0 AND im > 0 THEN 5 WHEN ops = 0 THEN 6 ELSE 7 END AS rule FROM f)
    SELECT doc_id, ['mixed', 'text_based', 'scanned', 'image_based', 'mixed', 'scanned', 'text_based'][rule] AS pdf_type, page_count, s AS pages_sampled, x AS pages_with_text,
           round(CASE rule WHEN 1 THEN 0.5 + 0.3 * (1 - te / s) WHEN 2 THEN x / s WHEN 3 THEN 0.95 WHEN 4 THEN 0.8 WHEN 5 THEN 0.7 WHEN 6 THEN 0.9 ELSE greatest(x / s, 0.5) END, 6) AS confidence,
           rule NOT IN (2, 7) AS ocr_recommended
    FROM r"""

# Facts of items and lines.
_BASE = "base AS (SELECT doc_id, coalesce((SELECT tenths FROM (SELECT CAST(floor(font_size * 10) AS INTEGER) AS tenths, count(*) AS n FROM fx_grid g WHERE g.doc_id = d.doc_id AND font_size >= 9 GROUP BY 1) ORDER BY n DESC, tenths LIMIT 1), 120) / 10 AS base_size FROM (SELECT DISTINCT doc_id FROM fx_grid) d)"
_TIERS = "tiers AS (SELECT b.doc_id, base_size, coalesce(list_sort(list(DISTINCT font_size) FILTER (font_size >= base_size * 1.2), 'DESC'), []) AS tiers FROM base b JOIN fx_grid USING (doc_id) GROUP BY ALL)"


def _bases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    grid = fx_grid(spark, d)
    return grid, items.modal_sizes(grid.select("doc_id", "font_size"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    grid, bases = _bases(spark, d)
    known = grid.join(bases, "doc_id").join(items.heading_tiers(grid, bases), "doc_id")
    return known.select("doc_id", "line_no", items.header_level(F.col("font_size"), F.col("base_size"), F.col("tiers")).alias("level"))


QUERIES["md2_base_font"] = lambda spark, d: _bases(spark, d)[1]
ORACLE_SQL["md2_base_font"] = f"WITH {FX_GRID_SQL}, {_BASE} SELECT doc_id, CAST(base_size AS DOUBLE) AS base_size FROM base"

QUERIES["md9_heading_tiers"] = lambda spark, d: (lambda g, b: items.heading_tiers(g, b).select("doc_id", F.array_join(F.transform("tiers", lambda x: x.cast("int").cast("string")), ",").alias("tiers")))(*_bases(spark, d))
ORACLE_SQL["md9_heading_tiers"] = f"WITH {FX_GRID_SQL}, {_BASE}, {_TIERS} SELECT doc_id, array_to_string(list_transform(tiers, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',') AS tiers FROM tiers"

QUERIES["md10_header_level"] = _levels
ORACLE_SQL["md10_header_level"] = f"""
    WITH {FX_GRID_SQL}, {_BASE}, {_TIERS}
    SELECT g.doc_id, line_no, CAST(CASE WHEN font_size / base_size < 1.2 THEN NULL WHEN list_contains(tiers, font_size) THEN list_position(tiers, font_size) END AS INTEGER) AS level
    FROM fx_grid g JOIN tiers USING (doc_id)"""

QUERIES["md12_para_threshold"] = lambda spark, d: items.paragraph_thresholds(*_bases(spark, d)).withColumn("threshold", F.round("threshold", 6))
ORACLE_SQL["md12_para_threshold"] = f"""
    WITH {FX_GRID_SQL}, {_BASE},
    g AS (SELECT doc_id, CASE WHEN lag(page) OVER w = page THEN lag(y) OVER w - y END AS gap FROM fx_grid WINDOW w AS (PARTITION BY doc_id ORDER BY page, line_no)),
    m AS (SELECT b.doc_id, base_size, list_sort(list(gap) FILTER (gap > 0 AND gap < base_size * 10)) AS gaps FROM base b JOIN g USING (doc_id) GROUP BY ALL)
    SELECT doc_id, round(CASE WHEN coalesce(len(gaps), 0) < 5 THEN base_size * 1.8 ELSE greatest(gaps[len(gaps) // 2 + 1] * 1.3, base_size * 1.5) END, 6) AS threshold FROM m"""

QUERIES["lay1_page_number_items"] = lambda spark, d: items.body_items(fx_grid(spark, d).withColumnRenamed("line", "text")).select("doc_id", "line_no", "text")
ORACLE_SQL["lay1_page_number_items"] = f"WITH {FX_GRID_SQL} SELECT doc_id, line_no, line AS text FROM fx_grid WHERE NOT ({_has(_trim('line'), '^[0-9]{1,4}$')} AND (y > 720 OR y < 100))"

# Every third line of a third of the documents goes to the top of the page, as a stream out of order would.
_JUMPY = "CASE WHEN doc_id % 3 = 0 AND line_no % 3 = 0 THEN 790 ELSE y END"
QUERIES["lay6_chaos"] = lambda spark, d: items.chaotic_order(fx_grid(spark, d).selectExpr("doc_id", "page", "line_no AS seq", f"CAST({_JUMPY} AS DOUBLE) AS y"))
ORACLE_SQL["lay6_chaos"] = f"""
    WITH {FX_GRID_SQL}, j AS (SELECT doc_id, page, line_no, {_JUMPY} AS y FROM fx_grid),
    g AS (SELECT doc_id, page, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS delta FROM j),
    f AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (delta > 50) AS up, count(*) FILTER (delta < -50) AS down FROM g GROUP BY ALL)
    SELECT doc_id, page, n >= 5 AND up + down >= 3 AND coalesce(up / nullif(up + down, 0) > 0.4, false) AS chaotic FROM f"""

QUERIES["tab2_regions"] = lambda spark, d: items.table_regions(fx_cells(spark, d))
ORACLE_SQL["tab2_regions"] = f"""
    WITH {FX_CELLS_SQL},
    s AS (SELECT *, coalesce(y - lag(y) OVER w > 30, false) AS starts FROM fx_cells WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, seq)),
    r AS (SELECT *, CAST(sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id, page ORDER BY y, seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS region FROM s)
    SELECT doc_id, page, region, min(y) - 5 AS y_min, max(y) + 5 AS y_max, count(*) AS n FROM r GROUP BY doc_id, page, region HAVING count(*) >= 4"""

_CENTRES = (74.0, 174.0, 268.0, 400.0)
QUERIES["tab7_cell_assign"] = lambda spark, d: (lambda c: fx_cells(spark, d).select("doc_id", "seq", items.nearest(c, F.col("x"), items.column_tolerance(c)).alias("column")))(F.array(*map(F.lit, _CENTRES)))
ORACLE_SQL["tab7_cell_assign"] = f"""
    WITH {FX_CELLS_SQL}, c AS (SELECT i, [{', '.join(map(str, _CENTRES))}][i + 1] AS centre FROM range(4) r(i)),
    d AS (SELECT doc_id, seq, CAST(i AS INTEGER) AS i, abs(x - centre) AS d, row_number() OVER (PARTITION BY doc_id, seq ORDER BY abs(x - centre), i) AS r FROM fx_cells, c)
    SELECT doc_id, seq, CASE WHEN d < 47 THEN i END AS "column" FROM d WHERE r = 1"""

QUERIES["snk5_gap_stats"] = lambda spark, d: items.gap_statistics(fx_grid(spark, d))
_GAPS = "gaps AS (SELECT * FROM (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY line_no) - y AS gap FROM fx_grid) WHERE gap > 0 AND gap < 200)"
ORACLE_SQL["snk5_gap_stats"] = f"""
    WITH {FX_GRID_SQL}, {_GAPS}
    SELECT doc_id, page, count(*) AS n, min(gap) AS least, max(gap) AS most, list_sort(list(gap))[count(*) // 2 + 1] AS median, round(avg(gap), 6) AS mean FROM gaps GROUP BY doc_id, page"""

QUERIES["snk5_gap_histogram"] = lambda spark, d: items.gap_histogram(*_bases(spark, d))
ORACLE_SQL["snk5_gap_histogram"] = f"""
    WITH {FX_GRID_SQL}, {_BASE}, {_GAPS}
    SELECT doc_id, CAST(len(list_filter([{', '.join(map(str, items.GAP_EDGES))}], lambda e: e <= gap / base_size)) - 1 AS INTEGER) AS bucket, count(*) AS n FROM gaps JOIN base USING (doc_id) GROUP BY ALL"""

# Whole documents, from PDF files made of the same grid.
_SHOWN = f"fx_shown AS (SELECT doc_id, page, line_no, y, font_size, {_ligatures('line')} AS text FROM fx_grid WHERE {_trim(_ligatures('line'))} <> '')"

QUERIES["cs_text_items"] = lambda spark, d: pdf.text_items(fx_pdfs(spark, d)).where("error IS NULL").select("doc_id", "page", F.col("y").cast("double").alias("y"), F.col("font_size").cast("double").alias("font_size"), "text")
ORACLE_SQL["cs_text_items"] = f"WITH {FX_GRID_SQL}, {_SHOWN} SELECT doc_id, page, y, CAST(font_size AS DOUBLE) AS font_size, text FROM fx_shown"

QUERIES["lay8_lines"] = lambda spark, d: documents.lines(pdf.text_items(fx_pdfs(spark, d))).select("doc_id", "page", "line_no", "y", "text")
ORACLE_SQL["lay8_lines"] = f"""
    WITH {FX_GRID_SQL}, {_SHOWN}
    SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS line_no, y, text FROM fx_shown
    WHERE NOT ({_has(_trim('text'), '^[0-9]{1,4}$')} AND (y > 720 OR y < 100))"""

QUERIES["api3_detect_pdf"] = lambda spark, d: pdf.detect_pdf_types(fx_pdfs(spark, d)).drop("error")
ORACLE_SQL["api3_detect_pdf"] = f"""
    WITH {FX_GRID_SQL},
    p AS (SELECT doc_id, page, count(*) AS ops, max(page) OVER (PARTITION BY doc_id) AS n FROM fx_grid GROUP BY doc_id, page),
    s AS (SELECT * FROM p WHERE n <= 5 OR page IN (1, n, 1 + (n - 2) // 4, 1 + 2 * ((n - 2) // 4), 1 + 3 * ((n - 2) // 4))),
    f AS (SELECT doc_id, CAST(max(n) AS INTEGER) AS page_count, CAST(count(*) AS INTEGER) AS k, CAST(count(*) FILTER (ops >= 3) AS INTEGER) AS x FROM s GROUP BY doc_id)
    SELECT doc_id, 'text_based' AS pdf_type, page_count, k AS pages_sampled, x AS pages_with_text, round(CASE WHEN x / k >= 0.6 THEN x / k ELSE greatest(x / k, 0.5) END, 6) AS confidence,
           'Document ' || doc_id AS title, false AS ocr_recommended FROM f"""

QUERIES["api1_process_pdf"] = lambda spark, d: documents.process_pdfs(fx_pdfs(spark, d)).select("doc_id", "pdf_type", "page_count", "markdown")
QUERIES["md17_document_markdown"] = lambda spark, d: documents.markdown(pdf.text_items(fx_pdfs(spark, d)))


def _table_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of two pages: the cells of fx_cells in small print; at the first cell of each row, body text on the other page."""
    cells = fx_cells(spark, d).drop("page").join(F.broadcast(spark.range(1, 3).select(F.col("id").cast("int").alias("page"))), F.expr("page = 1 OR seq % 4 = 0"))
    first = lambda a, b: F.when(F.col("page") == 1, a).otherwise(b)
    text = first(F.concat((F.col("seq") % 4).cast("string"), F.lit("."), F.col("seq").cast("string")), F.lit("Body words in the text"))
    return cells.select("doc_id", "page", "seq", text.alias("text"), "x", "y", first(10.0, 100.0).alias("width"), first(8.0, 10.0).alias("height"), first(8.0, 10.0).alias("font_size"), F.lit("text").alias("item_type"))


QUERIES["tab12_tables"] = lambda spark, d: documents.tables(_table_items(spark, d)).select("doc_id", "page", "table_no", F.size("columns").alias("n_columns"), F.size("rows").alias("n_rows"), "markdown")


def _two_columns(spark: SparkSession, d: str) -> DataFrame:
    """Lines of fx_grid as two columns of short words, left and right in turn."""
    grid = fx_grid(spark, d).withColumn("k", ((F.col("line_no") - 1) % 55).cast("int"))
    return grid.selectExpr(
        "doc_id", "page", "CAST(line_no AS BIGINT) AS seq", "concat(CASE WHEN k % 2 = 0 THEN 'L' ELSE 'R' END, k) AS text", "CASE WHEN k % 2 = 0 THEN 72.0D ELSE 330.0D END AS x", "760.0D - 12 * floor(k / 2) AS y",
        "18.0D AS width", "12.0D AS height", "'F1' AS font", "12.0D AS font_size", "false AS is_bold", "false AS is_italic", "'text' AS item_type",
    )


QUERIES["lay10_sections"] = lambda spark, d: documents.lines(_two_columns(spark, d)).select("doc_id", "page", "line_no", "y", "text")
ORACLE_SQL["lay10_sections"] = f"""
    WITH {FX_GRID_SQL},
    k AS (SELECT doc_id, page, CAST((line_no - 1) % 55 AS INTEGER) AS k, count(*) OVER (PARTITION BY doc_id, page) AS n FROM fx_grid),
    c AS (SELECT doc_id, page, n >= 20 AS two, CASE WHEN n >= 20 THEN k % 2 ELSE 0 END AS side, k // 2 AS row_no, k, CASE WHEN k % 2 = 0 THEN 'L' ELSE 'R' END || k AS word FROM k),
    l AS (SELECT doc_id, page, side, row_no, string_agg(word, ' ' ORDER BY k) AS text FROM c GROUP BY doc_id, page, two, side, row_no)
    SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, side, row_no) AS INTEGER) AS line_no, CAST(760 - 12 * row_no AS DOUBLE) AS y, text FROM l"""
