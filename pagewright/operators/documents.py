"""Documents from items, and Markdown from PDF files: one shuffle by document, then folds in Arrow batches.

A document's items are folded in one task, as reading order runs through all its pages; documents are spread
by hash. Items are small (a few hundred bytes); a document of a million items is a few hundred MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, repeat
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.markdown import MarkdownOptions, clean_markdown
from .detect import DetectionConfig
from ..sources.pdf import detect_pdf_types, inspect, text_items  # noqa: F401  two are called by these names, too

_FIELDS = ("text", "x", "y", "width", "height", "font", "font_size", "page", "is_bold", "is_italic", "item_type", "seq")


def _known(items: DataFrame) -> DataFrame:
    return items.where("page IS NOT NULL").select("doc_id", *(c for c in _FIELDS if c in items.columns))


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count or not pa.types.is_floating(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _fold(items: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(doc_id, Items in order) -> rows, for each document. Its rows come to one task in order of page and seq, and a task
    folds one document at a time. There are as many tasks as set for shuffles: folds take longer than their bytes tell."""
    names = [f for f in _FIELDS if f in items.columns]
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..layout.spacing import Item

        out_schema = to_arrow_schema(kind)
        blank = Item("", 0.0, 0.0)
        out: list[dict] = []
        key, own = None, []
        for batch in batches:
            known = {n: _values(batch.column(n)) for n in names}
            found = map(Item, *(known.get(f) or repeat(getattr(blank, f), batch.num_rows) for f in _FIELDS))
            for doc_id, rows in groupby(zip(batch.column("key_doc_id").to_pylist(), found, strict=True), key=itemgetter(0)):
                if doc_id != key:
                    if own:
                        out += work(key, own)
                    key, own = doc_id, []
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema=out_schema)
                        out = []
                own += [i for _, i in rows]
        if own:
            out += work(key, own)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = items.select(F.col("doc_id").alias("key_doc_id"), *names)
    return keyed.repartition(tasks, "key_doc_id").sortWithinPartitions("key_doc_id", "page", "seq").mapInArrow(run, kind)


def lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, y, font_size, text) in reading order, without page numbers."""

    def work(doc_id, own):
        from ..layout.lines import group_into_lines

        found = group_into_lines([i for i in own if i.item_type == "text"])
        return [{"doc_id": doc_id, "page": x.page, "line_no": n, "y": x.y, "font_size": x.items[0].font_size, "text": x.text()} for n, x in enumerate(found, 1)]

    return _fold(_known(items), work, "doc_id long, page int, line_no int, y double, font_size double, text string")


def tables(items: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, columns, rows, cells, markdown): tables of each page. Items meet by document, for its base
    size; many documents are looked at together."""
    exact = items.schema["font_size"].dataType.typeName() in ("float", "double")
    size = F.col("font_size") if exact else F.col("font_size").cast("double")
    own = items.where("page IS NOT NULL AND doc_id IS NOT NULL AND item_type = 'text'")
    columns = [F.col("doc_id").cast("long"), F.col("page").cast("int"), F.col("seq").cast("long"), "text", *(F.col(c).cast("double") for c in "xy"), size.alias("font_size")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..layout.table_batches import tables_of, whole_documents

        for batch in whole_documents(batches):
            yield tables_of(batch)

    schema = "doc_id long, page int, table_no int, columns array<double>, rows array<double>, cells array<array<string>>, markdown string"
    return own.select(*columns).repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, schema)


def markdown(items: DataFrame, options: MarkdownOptions = MarkdownOptions()) -> DataFrame:
    """(doc_id, markdown) from items: the fold in Python, the cleaning in generated code. Documents without an item have
    no row."""
    raw = _fold(_known(items), lambda doc_id, own: [{"doc_id": doc_id, "raw": _markdown(own, options)}], "doc_id long, raw string")
    return raw.select("doc_id", clean_markdown(F.col("raw"), options).alias("markdown"))


def _markdown(own: list, options: MarkdownOptions) -> str:
    from ..layout.assemble import items_to_markdown

    return items_to_markdown(own, options)


def process_pdfs(docs: DataFrame, config: DetectionConfig = DetectionConfig(), options: MarkdownOptions = MarkdownOptions()) -> DataFrame:
    """(doc_id, pdf_type, page_count, pages_sampled, pages_with_text, confidence, title, ocr_recommended, error, markdown)
    for (doc_id, content), in one parse of each file and without a shuffle. Scanned and image-based documents aren't read
    beyond the sample; a document that can't be read in full keeps its type and has no Markdown."""
    return inspect(docs, config, options).withColumn("markdown", clean_markdown(F.col("raw"), options)).drop("raw")


def detection_json(kinds: DataFrame) -> DataFrame:
    """(doc_id, value): a JSON record for each document, for df.write.text."""
    record = F.struct("pdf_type", "page_count", "pages_sampled", "pages_with_text", F.round("confidence", 2).alias("confidence"), "title", "ocr_recommended")
    return kinds.select("doc_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def processing_json(results: DataFrame) -> DataFrame:
    """(doc_id, value): type, pages and Markdown with its length in bytes; has_text is always false, as texts aren't kept."""
    record = F.struct("pdf_type", "page_count", F.lit(False).alias("has_text"), F.coalesce(F.octet_length("markdown"), F.lit(0)).alias("markdown_length"), "markdown")
    return results.select("doc_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


#: What a command recommends.
ADVICE = {
    "mixed": "Recommendation: Use OCR - images provide essential context (template PDF)",
    "scanned": "Recommendation: Use OCR (MinerU or similar)",
    "image_based": "Recommendation: Use OCR for best results",
    "other": "Recommendation: Use OCR for complete extraction",
    "none": "Recommendation: Use direct text extraction (fast)",
}


def recommendation(kinds: DataFrame) -> DataFrame:
    """kinds with recommendation (null on errors) and exit_status, 0, 1 (error) or 2 (OCR needed), as a command would end."""
    of = F.when(F.col("error").isNotNull(), None).when(~F.col("ocr_recommended"), ADVICE["none"])
    for kind in ("mixed", "scanned", "image_based"):
        of = of.when(F.col("pdf_type") == kind, ADVICE[kind])
    status = F.when(F.col("error").isNotNull(), 1).when(F.col("ocr_recommended"), 2).otherwise(0)
    return kinds.withColumns({"recommendation": of.when(F.col("ocr_recommended"), ADVICE["other"]), "exit_status": status})


def lines_markdown(lines: DataFrame, options: MarkdownOptions = MarkdownOptions()) -> DataFrame:
    """(doc_id, markdown) from prepared lines: items with the line_no of their line in the document and their seq in it.
    No tables or images are looked for; a line's height is that of its first item."""

    def work(doc_id, own):
        from ..layout.assemble import lines_to_markdown
        from ..layout.spacing import Line

        found: list[Line] = []
        for number, items in groupby(own, key=lambda i: i.seq >> 32):
            row = list(items)
            found.append(Line(row, row[0].y, row[0].page))
        return [{"doc_id": doc_id, "raw": lines_to_markdown(found, options)}]

    numbered = lines.where("page IS NOT NULL AND line_no IS NOT NULL").withColumn("seq", F.shiftleft(F.col("line_no").cast("long"), 32) + F.coalesce("seq", F.lit(0)))
    ordered = _fold(_known(numbered), work, "doc_id long, raw string")
    return ordered.select("doc_id", clean_markdown(F.col("raw"), options).alias("markdown"))
