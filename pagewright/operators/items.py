"""Facts of documents from positioned text items and lines, by aggregates and windows.

Items: (doc_id, page, seq, text, x, y, width, height, font_size, ...); y grows upward, seq is the order of
the content stream and settles ties. Lines: (doc_id, page, line_no, y, font_size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import textrules as t

DEFAULT_SIZE = 12.0


def effective_width(item_width: Column, text: Column, size: Column) -> Column:
    return F.when(item_width > 0, item_width).otherwise(F.char_length(text) * size * F.lit(0.5))


def body_items(items: DataFrame) -> DataFrame:
    """items without page numbers at the top or the bottom of a page."""
    return items.where(~t.is_page_number_item(F.col("text"), F.col("y")))


def modal_sizes(sizes: DataFrame, least: float = 9.0, default: float = DEFAULT_SIZE) -> DataFrame:
    """(doc_id, base_size): the commonest font size in tenths from `least` up, the smaller of equally common
    ones; `default` for documents without any. sizes: (doc_id, font_size)."""
    key = F.when(F.col("font_size") >= least, F.floor(F.col("font_size") * 10).cast("int"))
    counts = sizes.groupBy("doc_id", key.alias("tenths")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.col("tenths"), F.struct(F.when(F.col("tenths").isNotNull(), F.col("n")).otherwise(F.lit(0)).alias("n"), (-F.col("tenths")).alias("small")))
    return counts.groupBy("doc_id").agg((F.coalesce(best, F.lit(int(default * 10))) / 10).alias("base_size"))


def heading_tiers(lines: DataFrame, bases: DataFrame) -> DataFrame:
    """(doc_id, tiers array<double>): sizes of at least 1.2 times the base, largest first; a size within 0.5 of
    the tier before belongs to it; four at most."""
    large = F.collect_set(F.when(F.col("font_size") >= F.col("base_size") * 1.2, F.col("font_size").cast("double")))
    sizes = lines.join(bases, "doc_id").groupBy("doc_id").agg(F.sort_array(large, False).alias("sizes"))
    tiers = F.aggregate("sizes", F.array().cast("array<double>"), lambda acc, s: F.when((F.size(acc) == 0) | (F.get(acc, F.size(acc) - 1) - s > 0.5), F.concat(acc, F.array(s))).otherwise(acc))
    return sizes.select("doc_id", F.slice(tiers, 1, 4).alias("tiers"))


def header_level(size: Column, base: Column, tiers: Column) -> Column:
    """1 to 4, null for body text: the tier within 0.5 of the size, else by the ratio to the base."""
    ratio = F.try_divide(size, base)
    near = F.array_position(F.transform(tiers, lambda x: F.abs(x - size) <= 0.5), True).cast("int")
    by_ratio = F.when(ratio >= 2.0, 1).when(ratio >= 1.5, 2).when(ratio >= 1.25, 3).otherwise(4)
    of_tiers = F.when(near > 0, near).when(ratio >= 1.5, F.least(F.size(tiers) + 1, F.lit(4)))
    return F.when(ratio >= 1.2, F.when(F.size(tiers) > 0, of_tiers).otherwise(by_ratio)).cast("int")


def paragraph_thresholds(lines: DataFrame, bases: DataFrame) -> DataFrame:
    """(doc_id, threshold): gaps between lines from which a paragraph begins. Of gaps within a page, over 0 and
    under 10 times the base: 1.3 times their upper median, at least 1.5 times the base; with fewer than five
    gaps 1.8 times the base."""
    order = W.partitionBy("doc_id").orderBy("page", "line_no")
    gap = F.when(F.lag("page").over(order) == F.col("page"), F.lag("y").over(order) - F.col("y"))
    gaps = lines.select("doc_id", "page", "line_no", "y").withColumn("gap", gap).join(bases, "doc_id")
    used = F.sort_array(F.collect_list(F.when((F.col("gap") > 0) & (F.col("gap") < F.col("base_size") * 10), F.col("gap"))))
    by_doc = gaps.groupBy("doc_id", "base_size").agg(used.alias("gaps"))
    median = F.get("gaps", F.floor(F.size("gaps") / 2).cast("int"))
    return by_doc.select("doc_id", F.when(F.size("gaps") < 5, F.col("base_size") * 1.8).otherwise(F.greatest(median * 1.3, F.col("base_size") * 1.5)).alias("threshold"))


def chaotic_order(items: DataFrame, by: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(by..., chaotic): whether the stream jumps up too often for its order to be reading order. Of jumps of
    over 50 points, three at least, more than 0.4 go up; groups of fewer than five items are never chaotic."""
    delta = F.col("y") - F.lag("y").over(W.partitionBy(*by).orderBy("seq"))
    moved = items.select(*by, "seq", "y").withColumn("delta", delta)
    up, down = F.count_if(F.col("delta") > 50), F.count_if(F.col("delta") < -50)
    facts = moved.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), up.alias("up"), down.alias("down"))
    jumps = F.col("up") + F.col("down")
    return facts.select(*by, ((F.col("n") >= 5) & (jumps >= 3) & (F.try_divide(F.col("up"), jumps) > 0.4)).alias("chaotic"))


def table_regions(items: DataFrame, gap: float = 30.0, least: int = 4, margin: float = 5.0) -> DataFrame:
    """(doc_id, page, region, y_min, y_max, n): runs of items whose y are at most `gap` apart, of `least` items."""
    order = W.partitionBy("doc_id", "page").orderBy("y", "seq")
    starts = F.coalesce(F.col("y") - F.lag("y").over(order) > gap, F.lit(False)).cast("int")
    island = F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0))
    runs = items.select("doc_id", "page", "seq", "y").withColumn("starts", starts).withColumn("region", island.cast("int"))
    found = runs.groupBy("doc_id", "page", "region").agg((F.min("y") - margin).alias("y_min"), (F.max("y") + margin).alias("y_max"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= least)


def nearest(centres: Column, value: Column, within: Column) -> Column:
    """Index from 0 of the first centre nearest to a value, null if none is nearer than `within`."""
    off = F.transform(centres, lambda c, i: F.struct(F.abs(c - value).alias("d"), i.alias("i")))
    best = F.array_min(off)
    return F.when(best["d"] < within, best["i"])


def column_tolerance(columns: Column) -> Column:
    """Half the least distance between columns, 25 to 50; 50 for a single one."""
    gaps = F.transform(F.slice(columns, 2, F.size(columns)), lambda c, i: c - F.get(columns, i))
    return F.when(F.size(columns) < 2, 50.0).otherwise(F.greatest(F.lit(25.0), F.least(F.lit(50.0), F.array_min(gaps) / 2)))


#: A report on gaps takes this base for documents whose sizes say nothing, and marks paragraphs from this ratio on.
GAP_BASE, GAP_PARAGRAPH = 10.0, 1.8


def gap_lines(lines: DataFrame, bases: DataFrame) -> DataFrame:
    """lines with gap (to the line above on its page, null for a page's first), ratio to the document's base size and
    whether a paragraph begins there. bases: modal_sizes of the items with the default GAP_BASE."""
    above = F.lag("y").over(W.partitionBy("doc_id", "page").orderBy("line_no"))
    known = lines.join(bases, "doc_id").withColumn("gap", above - F.col("y")).withColumn("ratio", F.try_divide(F.col("gap"), F.col("base_size")))
    return known.withColumn("paragraph", F.coalesce(F.col("gap") > F.col("base_size") * GAP_PARAGRAPH, F.lit(False)))


def gap_statistics(lines: DataFrame) -> DataFrame:
    """(doc_id, page, n, least, most, median, mean) of gaps between lines over 0 and under 200 points."""
    gaps = _gaps(lines)
    used = F.sort_array(F.collect_list("gap"))
    by_page = gaps.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.avg("gap").alias("mean"), used.alias("gaps"))
    return by_page.select("doc_id", "page", "n", "least", "most", F.get("gaps", F.floor(F.col("n") / 2).cast("int")).alias("median"), F.round("mean", 6).alias("mean"))


#: Lower edges of the histogram of gaps over the base size; the last bucket is open.
GAP_EDGES = (0.0, 0.5, 1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0, 5.0, 10.0)


def gap_histogram(lines: DataFrame, bases: DataFrame) -> DataFrame:
    """(doc_id, bucket, n): gaps between lines by their ratio to the base size; bucket: index in GAP_EDGES."""
    ratio = F.try_divide(F.col("gap"), F.col("base_size"))
    bucket = F.size(F.filter(F.array(*map(F.lit, GAP_EDGES)), lambda e: e <= ratio)) - 1
    return _gaps(lines).join(bases, "doc_id").select("doc_id", bucket.cast("int").alias("bucket")).groupBy("doc_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _gaps(lines: DataFrame) -> DataFrame:
    order = W.partitionBy("doc_id", "page").orderBy("line_no")
    return lines.withColumn("gap", F.lag("y").over(order) - F.col("y")).where("gap > 0 AND gap < 200")
