"""Looks at items for people: pages, orders, ligatures and fonts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.pdf import each_document

#: First and last of the Latin ligatures that texts may still hold.
LIGATURES = "[ﬁﬂ]"


def page_dump(items: DataFrame, first: int = 1, last: int = 3) -> DataFrame:
    """Items of pages first to last, in stream order."""
    return items.where(F.col("page").between(first, last)).orderBy("doc_id", "page", "seq")


def order_facts(items: DataFrame, page: int, x_low: float, x_high: float) -> DataFrame:
    """(doc_id, n, y_least, y_most): items of a page in a vertical strip."""
    own = items.where((F.col("page") == page) & (F.col("x") > x_low) & (F.col("x") < x_high))
    return own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y_least"), F.max("y").alias("y_most"))


def items_with(items: DataFrame, words: tuple[str, ...], page: int = 1) -> DataFrame:
    """Items of a page whose text holds one of the words, in stream order."""
    holds = F.lit(False)
    for w in words:
        holds = holds | F.col("text").contains(w)
    return items.where((F.col("page") == page) & holds).orderBy("doc_id", "seq")


def items_at(items: DataFrame, page: int, y: float, within: float = 10.0) -> DataFrame:
    return items.where((F.col("page") == page) & (F.abs(F.col("y") - y) < within)).orderBy("doc_id", "seq")


def ligature_items(items: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """The first items that hold ligatures, and how many each document has."""
    found = items.where(F.col("text").rlike(LIGATURES))
    return found.orderBy("doc_id", "page", "seq").limit(most), found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def fonts(docs: DataFrame) -> DataFrame:
    """(doc_id, page, font, base_font, subtype, codes, ranges, code_bytes, differences, ligatures, has_a, has_space, has_period,
    error): the fonts of each page and what their maps cover."""

    def work(doc_id, doc):
        from ..pdf.fonts import load_fonts

        rows = []
        for n, page in enumerate(doc.pages(), 1):
            for name, f in load_fonts(doc, page.get("_Resources")).items():
                texts = set(f.differences.values()) | (set(f.cmap.chars.values()) if f.cmap else set())
                covers = lambda c, f=f, texts=texts: c in texts or bool(f.cmap and any(low <= ord(c) - base + low <= high for low, high, base in f.cmap.ranges))
                rows.append({
                    "doc_id": doc_id, "page": n, "font": name, "base_font": f.base_name, "subtype": f.subtype, "codes": len(f.cmap.chars) if f.cmap else 0, "ranges": len(f.cmap.ranges) if f.cmap else 0,
                    "code_bytes": f.cmap.width if f.cmap else None, "differences": len(f.differences), "ligatures": sum(t in "ﬀﬁﬂﬃﬄ" for t in texts if len(t) == 1),
                    "has_a": covers("a"), "has_space": covers(" "), "has_period": covers("."),
                })
        return rows

    flags = "has_a boolean, has_space boolean, has_period boolean"
    return each_document(docs, work, f"doc_id long, page int, font string, base_font string, subtype string, codes int, ranges int, code_bytes int, differences int, ligatures int, {flags}, error struct<kind: string, message: string>")
