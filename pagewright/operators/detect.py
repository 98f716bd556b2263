"""What kind of document a PDF is, from facts of some of its pages: two hash aggregates and a CASE."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of one image from which a page counts as made from a template.
TEMPLATE_AREA = 500_000


@dataclass(frozen=True)
class DetectionConfig:
    max_pages_to_sample: int = 5
    min_text_ops_per_page: int = 3
    text_page_ratio_threshold: float = 0.6


def sampled_pages(page_count: Column, k: int = 5) -> Column:
    """array<int>: all pages of up to k; else the first, the last and evenly spaced ones between, ascending."""
    if k < 2:
        some = F.array(F.lit(1), page_count)
    else:
        step = F.floor((page_count - 2) / (k - 1)).cast("int")
        inner = F.sequence(F.lit(1), F.lit(k - 2)) if k > 2 else F.array().cast("array<int>")
        between = F.filter(F.transform(inner, lambda i: (i * step + 1).cast("int")), lambda p: (p > 1) & (p < page_count))
        some = F.concat(F.array(F.lit(1), page_count), between)
    return F.when(page_count <= k, F.sequence(F.lit(1), F.greatest(F.lit(1), page_count))).otherwise(F.array_sort(F.array_distinct(some)))


def sample(pages: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """pages (doc_id, page, ...) that the sample takes, with page_count: a semi-join before any content is read."""
    counts = pages.groupBy("doc_id").agg(F.max("page").cast("int").alias("page_count"))
    wanted = counts.select("doc_id", "page_count", F.explode(sampled_pages(F.col("page_count"), config.max_pages_to_sample)).alias("page"))
    return pages.join(wanted, ["doc_id", "page"])


def text_operators(content: Column) -> Column:
    """Operators Tj and TJ in a content stream, before ASCII white space or its end."""
    return F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"T[jJ]([ \t\n\f\r]|\z)")).cast("int")


def draws_objects(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1").rlike(r"Do([ \t\n\f\r]|\z)")


def analyze_pages(streams: DataFrame) -> DataFrame:
    """(doc_id, page, text_ops, has_images) from content streams (doc_id, page, content), several a page or one."""
    return streams.groupBy("doc_id", "page").agg(F.sum(text_operators(F.col("content"))).cast("int").alias("text_ops"), F.bool_or(draws_objects(F.col("content"))).alias("has_images"))


def analyze_images(images: DataFrame) -> DataFrame:
    """(doc_id, page, image_area, has_template_image) from images (doc_id, page, width, height); missing sizes are 0."""
    area = F.coalesce(F.col("width"), F.lit(0)).cast("long") * F.coalesce(F.col("height"), F.lit(0))
    return images.groupBy("doc_id", "page").agg(F.sum(area).alias("image_area"), (F.max(area) >= TEMPLATE_AREA).alias("has_template_image"))


def classify(pages: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """(doc_id, pdf_type, page_count, pages_sampled, pages_with_text, confidence, ocr_recommended) from sampled
    pages (doc_id, page_count, text_ops, has_images, has_template_image)."""
    facts = pages.groupBy("doc_id").agg(
        F.max("page_count").alias("page_count"), F.count(F.lit(1)).cast("int").alias("pages_sampled"),
        F.count_if(F.col("text_ops") >= config.min_text_ops_per_page).cast("int").alias("pages_with_text"),
        F.count_if("has_images").alias("images"), F.count_if("has_template_image").alias("templates"), F.sum("text_ops").alias("ops"),
    )
    pdf_type, confidence, ocr = verdict(*map(F.col, ("pages_sampled", "pages_with_text", "images", "templates", "ops")), config)
    return facts.select("doc_id", pdf_type.alias("pdf_type"), "page_count", "pages_sampled", "pages_with_text", confidence.alias("confidence"), ocr.alias("ocr_recommended"))


def verdict(sampled: Column, with_text: Column, images: Column, templates: Column, ops: Column, config: DetectionConfig = DetectionConfig()) -> tuple[Column, Column, Column]:
    """Type, confidence and whether OCR is recommended, from counts over a document's sampled pages."""
    ratio, template = F.try_divide(with_text, sampled), F.try_divide(templates, sampled)
    rules = [
        ((templates > 0) & (with_text > 0), "mixed", 0.5 + 0.3 * (1 - template), True),
        (ratio >= config.text_page_ratio_threshold, "text_based", ratio, False),
        ((with_text == 0) & (images > 0) & (ops == 0), "scanned", F.lit(0.95), True),
        ((with_text == 0) & (images > 0), "image_based", F.lit(0.8), True),
        ((with_text > 0) & (images > 0), "mixed", F.lit(0.7), True),
        (ops == 0, "scanned", F.lit(0.9), True),
        (F.lit(True), "text_based", F.greatest(ratio, F.lit(0.5)), False),
    ]
    pick = lambda k: F.coalesce(*(F.when(r[0], F.lit(r[k]) if k != 2 else r[2]) for r in rules))
    return pick(1), F.round(pick(2), 6), pick(3)
