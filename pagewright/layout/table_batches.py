"""Tables of many pages at once: what layout.tables finds among items smaller than the body, by numpy over all pages of a batch.

Pages that hold more than that (items in the body's size that may be a table, several items in a cell, values that aren't
finite, hundreds of items) go through detect_tables one by one. Sums are compensated as Python's sum() is, so that both ways
give the same numbers.
"""

from __future__ import annotations

import sys
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .spacing import Item
from .tables import _FOOTNOTE, SMALL, detect_tables, looks_like_data, looks_like_number, table_to_markdown

_LARGEST = 1e6  # coordinates and sizes from here on go one by one
_MOST_ITEMS, _MOST_CLUSTERS = 400, 40
_COMPENSATED = sys.version_info >= (3, 12)
SCHEMA = pa.schema({
    "doc_id": pa.int64(), "page": pa.int32(), "table_no": pa.int32(), "columns": pa.list_(pa.float64()), "rows": pa.list_(pa.float64()),
    "cells": pa.list_(pa.list_(pa.string())), "markdown": pa.string(),
})
_FACTS = ("number", "data", "form", "label", "dots", "page", "footnote", "filled")


@lru_cache(1 << 16)
def _facts(text: str) -> tuple:
    """The text of a cell of its own, its lengths in characters and bytes, and what the rules of tables ask of it."""
    t = text.strip()
    size, dots = len(t.encode()), t.count(".")
    label = t.endswith(":") or (size > 3 and all(c.isupper() or c.isspace() or c in "()" for c in t))
    return (
        t, len(t), size, looks_like_number(t), looks_like_data(t), (t.endswith(":") and size > 1) or ": " in t, label, dots >= 3 and dots > size / 2, t.isascii() and t.isdigit() and size <= 4,
        _FOOTNOTE.match(t) is not None, bool(t),
    )


def base_sizes(doc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each document (numbered from 0, in order) what operators.items.modal_sizes gives, in the arithmetic of sizes."""
    out = np.full(int(doc[-1]) + 1, 12.0)
    counted = ~(sizes < 9)
    tenths = np.nan_to_num(np.floor(sizes[counted] * sizes.dtype.type(10))).astype(np.int64)
    order = np.lexsort((tenths, doc[counted]))
    d, t = doc[counted][order], tenths[order]
    if len(d):
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
        n = np.diff(np.r_[first, len(d)])
        d, t = d[first], t[first]
        best = np.lexsort((t, -n, d))
        best = best[np.r_[True, d[best][1:] != d[best][:-1]]]
        out[d[best]] = t[best] / 10
    return out


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ... counts[1] - 1, ..."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _clusters(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, joins) -> tuple[np.ndarray, np.ndarray]:
    """Of each group's values in their order: the cluster of each (numbered in its group from 0), and the mean of its cluster up
    to it. joins(groups, mean, value): whether a value goes to the cluster before it."""
    number, means = np.zeros(len(values), np.int64), np.zeros(len(values))
    by_size = np.argsort(-counts, kind="stable")
    starts, sizes = starts[by_size], counts[by_size]
    total, lost, n, cluster, mean = (np.zeros(len(counts)) for _ in range(5))
    for k in range(int(sizes[0])):
        g = int(np.searchsorted(-sizes, -k))  # groups of more than k values
        at = starts[:g] + k
        v = values[at]
        fresh = ~joins(by_size[:g], mean[:g], v) if k else np.ones(g, bool)
        cluster[:g] += fresh & (k > 0)
        s, c = np.where(fresh, 0.0, total[:g]), np.where(fresh, 0.0, lost[:g])
        t = s + v
        if _COMPENSATED:
            c = c + np.where(np.abs(s) >= np.abs(v), (s - t) + v, (v - t) + s)
        n[:g] = np.where(fresh, 1, n[:g] + 1)
        total[:g], lost[:g] = t, c
        mean[:g] = (t + c) / n[:g]
        number[at], means[at] = cluster[:g], mean[:g]
    return number, means


def _centres(number: np.ndarray, means: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the clusters, and the group of each."""
    last = np.r_[(group[1:] != group[:-1]) | (number[1:] != number[:-1]), True]
    return means[last], group[last]


def _padded(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row for each group, filled up with infinities."""
    out = np.full((len(counts), int(counts.max(initial=1))), np.inf)
    out[np.repeat(np.arange(len(counts)), counts), _ragged(counts)] = values
    return out


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, values, n).astype(np.int64)


def tables_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of SCHEMA for the items (doc_id, page, seq, text, x, y, font_size) of whole documents, of which each is in one piece."""
    column = {name: batch.column(name) for name in batch.schema.names}
    ints = lambda name: column[name].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc_id, pages, seq = map(ints, ("doc_id", "page", "seq"))
    raw_size = column["font_size"].to_numpy(zero_copy_only=False)
    doc = np.cumsum(np.r_[0, doc_id[1:] != doc_id[:-1]])
    same = np.r_[False, doc[1:] == doc[:-1]]
    known_seq = column["seq"].is_valid().to_numpy(zero_copy_only=False)  # nulls come first
    if not (~same[1:] | (pages[1:] > pages[:-1]) | ((pages[1:] == pages[:-1]) & known_seq[:-1] & known_seq[1:] & (seq[1:] >= seq[:-1]))).all():
        order = np.lexsort((seq, known_seq, pages, doc))
        batch = batch.take(pa.array(order))
        column = {name: batch.column(name) for name in batch.schema.names}
        doc_id, pages, raw_size, doc = doc_id[order], pages[order], raw_size[order], doc[order]
    base = base_sizes(doc, raw_size)
    x, y, size = (column[name].to_numpy(zero_copy_only=False).astype(np.float64) for name in ("x", "y", "font_size"))
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pages[1:] != pages[:-1])])
    counts = np.diff(np.r_[starts, len(doc)])
    page = np.repeat(np.arange(len(starts)), counts)
    base = base[doc[starts]]
    texts = column["text"].dictionary_encode()

    # Pages that go one by one.
    plain = (np.abs(x) < _LARGEST) & (np.abs(y) < _LARGEST) & (np.abs(size) < _LARGEST) & column["text"].is_valid().to_numpy(zero_copy_only=False)
    slow = (_sums(~plain, page, len(starts)) > 0) | (counts > _MOST_ITEMS)
    body = (size >= np.maximum(6.0, base * 0.85)[page]) & (size <= (base * 1.05)[page])
    low, high = (reduce.reduceat(np.where(body, x, empty), starts) for reduce, empty in ((np.minimum, np.inf), (np.maximum, -np.inf)))
    slow |= (_sums(body, page, len(starts)) >= 9) & (high - low > 40)
    slow &= counts >= SMALL.least_items

    found = None
    small = plain & (size >= 6.0) & (size <= (base * 0.90)[page]) & (~slow & (counts >= SMALL.least_items))[page]
    small &= (_sums(small, page, len(starts)) >= SMALL.least_items)[page]
    if small.any():
        found, odd = _small_tables(np.flatnonzero(small), page, x, y, size, texts)
        slow[odd] = True
        if found is not None:
            found = found.filter(pa.array(~slow[found.column("at").to_numpy()]))
    out = []
    if found is not None and found.num_rows:
        at = found.column("at").to_numpy()
        first = np.r_[True, at[1:] != at[:-1]]
        ids = starts[at]
        number = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        rest = [found.column(n) for n in SCHEMA.names[3:]]
        out.append(pa.RecordBatch.from_arrays([pa.array(doc_id[ids]), pa.array(pages[ids], pa.int32()), pa.array(number, pa.int32()), *rest], schema=SCHEMA))
    rows = []
    for p in np.flatnonzero(slow):
        a, n = int(starts[p]), int(counts[p])
        own = zip(*(column[name].slice(a, n).to_pylist() for name in ("text", "x", "y", "font_size")), strict=True)
        tables = detect_tables([Item(text=t, x=i, y=j, font_size=s) for t, i, j, s in own], float(base[p]))
        rows += [
            {"doc_id": int(doc_id[a]), "page": int(pages[a]), "table_no": k, "columns": t.columns, "rows": t.rows, "cells": t.cells, "markdown": table_to_markdown(t.cells)}
            for k, t in enumerate(tables)
        ]
    if rows:
        out.append(pa.RecordBatch.from_pylist(rows, schema=SCHEMA))
    return pa.Table.from_batches(out, SCHEMA).combine_chunks().to_batches()[0] if out else pa.RecordBatch.from_pylist([], schema=SCHEMA)


def _small_tables(own: np.ndarray, page: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, texts: pa.DictionaryArray) -> tuple[pa.RecordBatch | None, np.ndarray]:
    """(at, columns, rows, cells, markdown) of the tables among items `own`, at: their page; and pages that have to go one by
    one. As regions stand more than 30 apart, an item belongs to one region alone."""
    none = np.zeros(0, np.int64)
    own = own[np.lexsort((y[own], page[own]))]
    run = np.cumsum(np.r_[0, (page[own][1:] != page[own][:-1]) | (np.abs(np.diff(y[own])) > 30)])
    own = own[(np.bincount(run) >= SMALL.least_items)[run]]
    if not len(own):
        return None, none
    region = np.cumsum(np.r_[0, (page[own][1:] != page[own][:-1]) | (np.abs(np.diff(y[own])) > 30)])
    n_regions = int(region[-1]) + 1
    count = np.bincount(region)
    start = np.cumsum(count) - count
    at = page[own[start]]

    # Columns: clusters of x that enough items stand in.
    by_x = own[np.lexsort((x[own], region))]
    xs = x[by_x]
    near = np.minimum(50.0, np.maximum(25.0, (xs[start + count - 1] - xs[start]) / (count - 1)))
    centre, of = _centres(*_clusters(xs, start, count, lambda g, mean, v: v - mean <= near[g]), region)
    clusters = np.bincount(of, minlength=n_regions)
    many = clusters > _MOST_CLUSTERS
    padded = _padded(centre[~many[of]], np.where(many, 0, clusters))
    inside = np.stack([np.add.reduceat((np.abs(xs - padded[region, k]) < near[region]).astype(np.int64), start) for k in range(padded.shape[1])], 1)
    kept = np.isfinite(padded) & (inside >= np.maximum(2, count // clusters // 4)[:, None])
    n_columns = kept.sum(1)
    columns = _padded(padded[kept], n_columns)

    # Rows: clusters of y from the top.
    by_y = own[np.lexsort((-y[own], region))]
    sizes = size[own][np.lexsort((size[own], region))]
    near = np.maximum(4.0, 0.8 * sizes[start + count // 2])
    number, means = _clusters(y[by_y], start, count, lambda g, mean, v: mean - v < near[g])
    row, row_region = _centres(number, means, region)
    n_rows = np.bincount(row_region, minlength=n_regions)
    row_start = np.cumsum(n_rows) - n_rows

    # Places of the items, in the order of by_y.
    xs, ys = x[by_y], y[by_y]
    distance = np.abs(columns[region] - xs[:, None])
    aligned = _sums((distance < SMALL.tolerance).any(1), region, n_regions)
    good = (n_columns >= SMALL.columns) & (n_columns <= 15) & (n_rows >= SMALL.rows) & (aligned >= SMALL.aligned * count) & ~many
    with np.errstate(invalid="ignore"):
        gap = np.where(np.isfinite(columns[:, 1:]), columns[:, 1:] - columns[:, :-1], np.inf).min(1, initial=np.inf)
    within = np.minimum(50.0, np.maximum(25.0, gap / 2))
    c = distance.argmin(1)
    # The nearest row is that of the item's cluster or one beside it.
    r = row_start[region] + number
    around = np.stack([np.where((k >= row_start[region]) & (k < (row_start + n_rows)[region]), np.abs(row[np.clip(k, 0, len(row) - 1)] - ys), np.inf) for k in (r - 1, r, r + 1)], 1)
    r = r - 1 + around.argmin(1)
    placed = good[region] & (distance[np.arange(len(c)), c] < within[region]) & (around.min(1) < 15.0)

    # Cells of the regions that are still there, row by row.
    width = np.where(good, n_columns, 0)[row_region]
    cell_start = np.cumsum(width) - width
    cell = (cell_start[r] + c)[placed]
    full = np.bincount(cell, minlength=int(width.sum()))
    odd = many.copy()
    odd[row_region[np.repeat(np.arange(len(row)), width)[full > 1]]] = True
    codes = np.full(int(width.sum()), -1, np.int64)
    codes[cell] = texts.indices.to_numpy(zero_copy_only=False)[by_y[placed]]
    used, codes = np.unique(codes, return_inverse=True)
    facts = [_facts("" if k < 0 else texts.dictionary[k].as_py()) for k in used.tolist()]
    words, chars, octets = pa.array([f[0] for f in facts], pa.string()), *(np.array([f[k] for f in facts], np.int64) for k in (1, 2))
    fact = {name: np.array([f[k] for f in facts], bool)[codes] for k, name in enumerate(_FACTS, 3)}
    cell_row = np.repeat(np.arange(len(row)), width)
    per_row = lambda what: _sums(what, cell_row, len(row))
    leads = width > 0
    first = np.minimum(cell_start, max(0, len(codes) - 1))
    if not len(codes):
        return None, at[odd]

    # The table begins below the lines of a form.
    filled, form, numbers = per_row(fact["filled"]), per_row(fact["filled"] & fact["form"]) > 0, per_row(fact["filled"] & fact["number"])
    fill = filled / np.maximum(1, width)
    begins = ~form & ((numbers >= 2) | (fill >= 0.4))
    follows = np.r_[row_region[1:] == row_region[:-1], False] & np.r_[begins[1:], False]
    begins |= ~form & (fill >= 0.3) & follows
    k = np.arange(len(row))
    top = np.minimum.reduceat(np.where(begins, k, len(row)), row_start)
    top = np.where(top == len(row), row_start, top)
    inside_rows = leads & (k >= top[row_region])

    # Whether it is a table.
    live = lambda what: _sums(what & inside_rows, row_region, n_regions)
    total = lambda what: np.bincount(row_region, np.where(inside_rows, what, 0), n_regions)
    n = np.maximum(1, live(leads))
    with_first = fact["filled"][first] & leads
    good &= (live(with_first) >= n // 2) & (live(filled >= 2) >= np.maximum(1, n // SMALL.many_columns)) & (n <= 200) & (total(filled) / n >= SMALL.filled)
    good &= ~((n_columns <= 6) & (live(filled <= 2) > 0.7 * n) & (live(with_first & fact["label"][first]) > 0.5 * n))
    fills = np.bincount((row_region * 16 + filled.clip(0, 15))[inside_rows], minlength=n_regions * 16).reshape(-1, 16)
    good &= (n < 3) | (live(np.abs(filled - fills.argmax(1)[row_region]) <= 2) > 0.4 * n)
    below = inside_rows & (k > top[row_region])
    cells_below = np.bincount(row_region, np.where(below, filled, 0), n_regions)
    data = np.bincount(row_region, np.where(below, per_row(fact["filled"] & fact["data"]), 0), n_regions)
    good &= (cells_below > 0) & ((n_columns >= 5) | (data / np.maximum(1, cells_below) > SMALL.data))
    every, dots, numbered = total(filled), total(per_row(fact["filled"] & fact["dots"])), total(per_row(fact["filled"] & fact["page"]))
    good &= ~((every > 0) & ((dots > 0.15 * every) | ((dots > 0.05 * every) & (numbered > 0.15 * every))))
    good &= ~odd
    if not good.any():
        return None, at[odd]

    rows = inside_rows & good[row_region]
    cells = rows[cell_row]
    codes = codes[cells]
    widths, per_table, cell_counts = width[rows], live(leads)[good], n_columns[good]
    simple = (_sums((~with_first | fact["footnote"][first]) & rows, row_region, n_regions) == 0)[good]
    values = words.take(pa.array(codes))
    listed = lambda counts, of: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), of)
    grid = listed(per_table, listed(widths, values))
    shown = _markdown(codes, words, chars, octets, per_table, cell_counts)
    if not simple.all():
        shown = pa.array([s if ok else table_to_markdown(t) for s, ok, t in zip(shown.to_pylist(), simple.tolist(), grid.to_pylist(), strict=True)], pa.string())
    found = pa.RecordBatch.from_arrays(
        [pa.array(at[good]), listed(cell_counts, pa.array(columns[good][np.isfinite(columns[good])])), listed(per_table, pa.array(row[rows])), grid, shown],
        ["at", "columns", "rows", "cells", "markdown"],
    )
    return found, at[odd]


def _markdown(codes: np.ndarray, words: pa.StringArray, chars: np.ndarray, octets: np.ndarray, n_rows: np.ndarray, n_columns: np.ndarray) -> pa.StringArray:
    """What table_to_markdown gives for tables whose rows all stay rows, written into one buffer of blanks."""
    n_cells = n_rows * n_columns
    table = np.repeat(np.arange(len(n_rows)), n_cells)
    place = _ragged(n_cells)
    column = (np.cumsum(n_columns) - n_columns)[table] + place % n_columns[table]
    longest = np.full(int(n_columns.sum()), 3, np.int64)
    np.maximum.at(longest, column, octets[codes])
    # Segments: the cells, with a rule's behind those of each first row.
    long = 3 + octets[codes] + np.maximum(0, longest[column] - chars[codes])
    ends = place % n_columns[table] == n_columns[table] - 1
    head = place < n_columns[table]
    rule_table = table[head]
    rule = 3 + longest
    rule_ends = _ragged(n_columns) == n_columns[rule_table] - 1
    key = np.r_[np.where(head, 0, 2), np.ones(len(rule), np.int64)]
    whose = np.r_[table, rule_table]
    order = np.lexsort((np.r_[place, _ragged(n_columns)], key, whose))
    length, last = np.r_[long, rule][order], np.r_[ends, rule_ends][order]
    segment = length + 2 * last
    begin = np.empty(len(order), np.int64)
    begin[order] = np.cumsum(segment) - segment
    total = int(segment.sum())
    buffer = np.full(total, 32, np.uint8)
    buffer[begin] = 124
    stop = begin[order][last] + length[last]
    buffer[stop], buffer[stop + 1] = 124, 10
    dashes = begin[len(table) :] + 2
    buffer[np.repeat(dashes, longest) + _ragged(longest)] = 45
    offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
    source = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = octets[codes]
    step = _ragged(size)
    buffer[np.repeat(begin[: len(table)] + 2, size) + step] = source[np.repeat(offsets[codes], size) + step]
    bounds = np.r_[0, np.cumsum(np.bincount(whose[order], segment, len(n_rows)).astype(np.int64))]
    return pa.StringArray.from_buffers(len(n_rows), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(buffer))


def whole_documents(batches, rows: int = 1 << 16):
    """Batches, by doc_id, put together again so that each document is in one of them, of `rows` rows or little more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        ids = batch.column("doc_id")
        cut = pc.index(ids, ids[-1]).as_py()
        if cut == 0 and held[:-1] and held[-2].column("doc_id")[-1].equals(ids[0]):
            continue  # one document, so far
        ready = [*held[:-1], batch.slice(0, cut)] if cut else held[:-1]
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
        held, n = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
