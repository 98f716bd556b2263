"""PDF files as DataFrames. A file that can't be read gives a row with its error; it never fails the job. doc_id is a long, or
can be cast to one; null and repeated ids give rows like any other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markdown import MarkdownOptions
from ..operators import detect
from ..operators.detect import DetectionConfig

ITEM_SCHEMA = (
    "doc_id long, page int, seq long, text string, x float, y float, width float, height float, font string, font_size float, is_bold boolean, is_italic boolean, item_type string, url string"
)
_ROWS = 5000  # of a batch at most
ERROR = "struct<kind: string, message: string>"


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, content) of the .pdf files of a folder; doc_id: a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def each_document(docs: DataFrame, work, schema: str) -> DataFrame:
    """work(doc_id, Document) -> rows; schema: of those rows and, at its end, `error`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..pdf.objects import Document, PdfError

        out = to_arrow_schema(kind)
        held: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    rows = work(doc_id, Document(content or b""))
                except PdfError as e:
                    rows = [{"doc_id": doc_id, "error": {"kind": e.kind, "message": str(e)}}]
                except Exception as e:  # noqa: BLE001  damaged files fail in any way
                    rows = [{"doc_id": doc_id, "error": {"kind": "parse", "message": f"{type(e).__name__}: {e}"}}]
                held += rows
                while len(held) >= _ROWS or (held and i % 64 == 63):
                    yield pa.RecordBatch.from_pylist(held[:_ROWS], schema=out)
                    held = held[_ROWS:]
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=out)
                held = []

    return docs.select(F.col("doc_id").cast("long"), "content").mapInArrow(run, kind)


_FACTS = "page_count int, title string, facts array<struct<page int, text_ops int, has_images boolean, image_area long, has_template_image boolean>>"


def _look(doc, config: DetectionConfig) -> dict:
    """page_count, title and the facts of sampled pages; pages outside the sample aren't decoded."""
    from ..pdf.content import page_images
    from ..pdf.scan import count_operators, sample

    pages, facts = doc.pages(), []
    for n in sample(len(pages), config.max_pages_to_sample) if pages else []:
        found = [count_operators(c) for c in doc.contents(pages[n - 1])]
        areas = [w * h for w, h in page_images(doc, pages[n - 1])]
        facts.append({"page": n, "text_ops": sum(a for a, _ in found), "has_images": any(b for _, b in found) or bool(areas), "image_area": sum(areas), "has_template_image": max(areas, default=0) >= detect.TEMPLATE_AREA})
    return {"page_count": len(pages), "title": doc.title(), "facts": facts}


def inspect(docs: DataFrame, config: DetectionConfig = DetectionConfig(), options: MarkdownOptions | None = None) -> DataFrame:
    """(doc_id, pdf_type, page_count, pages_sampled, pages_with_text, confidence, title, ocr_recommended, error[, raw]) for
    (doc_id, content): a file is parsed once and nothing is shuffled.

    options: also writes the document's raw Markdown, null where the type is neither text_based nor mixed, which the
    sample says, or where a page can't be read. Repeated rows give repeated results, null content an error.
    """

    def work(doc_id, doc):
        row = {"doc_id": doc_id, **_look(doc, config)}
        if options is not None and (config.text_page_ratio_threshold <= 0 or any(f["text_ops"] for f in row["facts"])):
            try:
                row["raw"] = _raw_markdown(doc, options)
            except Exception:  # noqa: BLE001  damaged pages fail in any way; the type is known all the same
                row["raw"] = None
        return [row]

    rows = each_document(docs, work, f"doc_id long, {_FACTS}, raw string, error {ERROR}")
    count = lambda rule: F.size(F.filter("facts", rule))
    n = F.size("facts")
    with_text = count(lambda p: p["text_ops"] >= config.min_text_ops_per_page)
    ops = F.aggregate("facts", F.lit(0).cast("long"), lambda s, p: s + p["text_ops"])
    kinds = detect.verdict(n, with_text, count(lambda p: p["has_images"]), count(lambda p: p["has_template_image"]), ops, config)
    known = [F.when(n > 0, c) for c in (*kinds, n, with_text)]
    pdf_type, confidence, ocr, sampled, texts = known
    out = rows.select(
        "doc_id", pdf_type.alias("pdf_type"), "page_count", sampled.alias("pages_sampled"), texts.alias("pages_with_text"), confidence.alias("confidence"), "title", ocr.alias("ocr_recommended"), "error", "raw"
    )
    return out.withColumn("raw", F.when(F.col("pdf_type").isin("text_based", "mixed"), F.col("raw"))) if options is not None else out.drop("raw")


def _raw_markdown(doc, options: MarkdownOptions) -> str:
    from ..layout.assemble import items_to_markdown
    from ..layout.spacing import Item
    from ..pdf.content import page_items

    rows = (i for n, page in enumerate(doc.pages(), 1) for i in page_items(doc, page, n))
    return items_to_markdown([Item.of(r, k) for k, r in enumerate(rows)], options)


def sampled_page_facts(docs: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """(doc_id, page_count, title, error, page, text_ops, has_images, image_area, has_template_image): a row for each
    sampled page; a document without pages has one row without a page."""
    rows = each_document(docs, lambda doc_id, doc: [{"doc_id": doc_id, **_look(doc, config)}], f"doc_id long, {_FACTS}, error {ERROR}")
    return rows.select("doc_id", "page_count", "title", "error", F.explode_outer("facts").alias("f")).select("doc_id", "page_count", "title", "error", "f.*")


def detect_pdf_types(docs: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """(doc_id, pdf_type, page_count, pages_sampled, pages_with_text, confidence, title, ocr_recommended, error) for
    (doc_id, content)."""
    return inspect(docs, config)


def text_items(docs: DataFrame) -> DataFrame:
    """Positioned items of (doc_id, content), in stream order of each page with its links last; error rows have no item."""

    def work(doc_id, doc):
        from ..pdf.content import page_items

        every = (i for n, page in enumerate(doc.pages(), 1) for i in page_items(doc, page, n))
        return [i | {"doc_id": doc_id, "seq": k} for k, i in enumerate(every)]

    return each_document(docs, work, f"{ITEM_SCHEMA}, error {ERROR}")


def links(docs: DataFrame) -> DataFrame:
    """(doc_id, page, seq, url, x, y, width, height): link annotations that have a rectangle and a URI."""
    return text_items(docs).where("item_type = 'link'").select("doc_id", "page", "seq", "url", "x", "y", "width", "height")


def unicode_maps(docs: DataFrame) -> DataFrame:
    """(doc_id, object, names, code_bytes, chars, ranges, error): the ToUnicode maps that a file's bytes refer to, each with
    the names of fonts that find it."""

    def work(doc_id, doc):
        maps = doc.font_maps
        return [
            {"doc_id": doc_id, "object": n, "names": sorted(k for k, v in maps.by_name.items() if v is m), "code_bytes": m.width, "chars": m.chars, "ranges": [dict(zip(("low", "high", "base"), r, strict=True)) for r in m.ranges]}
            for n, m in maps.by_number.items()
        ]

    ranges = "array<struct<low: int, high: int, base: long>>"
    return each_document(docs, work, f"doc_id long, object int, names array<string>, code_bytes int, chars map<int, string>, ranges {ranges}, error {ERROR}")


def extract_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, error): the plain text of all pages, a line for each show operation."""
    items = text_items(docs).where("error IS NOT NULL OR item_type = 'text'")
    shown = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"])
    return docs.select(F.col("doc_id").cast("long")).join(items.groupBy("doc_id").agg(F.array_join(shown, "\n").alias("text"), F.first("error", ignorenulls=True).alias("error")), "doc_id", "left")
