"""Tables of many pages at once are those found page by page."""

import random

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF_DIR

from pagewright.layout import table_batches
from pagewright.layout.assemble import base_size
from pagewright.layout.spacing import Item
from pagewright.layout.tables import detect_tables, table_to_markdown
from pagewright.operators import documents
from pagewright.plans.queries import QUERIES

ITEMS = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("seq", pa.int64()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("font_size", pa.float64())])
TEXTS = ["12", "3.5", "-7", "abc", "  9 ", "", " ", "Total:", "Name: x", "NOTE", "(1)", "2)", "Notes: z", "çé 5", "....", "Intro.....", "5 kg", "10°C to 5", "表 1", "a|b", "1/2/2024", "x1", "word", " "]


def random_page(rnd: random.Random) -> list[tuple]:
    """Rows of texts that stand about columns, some of them twice in a cell, some missing, in sizes around the body's."""
    out, y = [], 700.0
    columns, step, texts = rnd.randint(1, 7), rnd.choice([30, 60, 75, 100]), rnd.choice([TEXTS, TEXTS[:5], TEXTS[:8], TEXTS[7:10] + TEXTS[:3], [".....", "1", "23", "a"]])
    size, wild = rnd.choice([8.0, 8.0, 8.5, 10.0]), rnd.choice([0, 0, 0.1])
    for _ in range(rnd.randint(1, 14)):
        for c in range(columns):
            if rnd.random() < rnd.choice([0.02, 0.3]):
                continue
            for _ in range(1 + (rnd.random() < wild)):
                out.append((rnd.choice(texts), 50.0 + step * c + rnd.choice([0, 0, 1.1, 3.7, rnd.random() * 20]), y + rnd.choice([0, 0, 0.3, 4.9]), rnd.choice([size, size, size, 7.0, 12.0]) if wild else size))
        y -= rnd.choice([9, 12, 12.7, 15, 40 if rnd.random() < 0.3 else 12])
    rnd.shuffle(out) if rnd.random() < 0.3 else None
    return out


def one_by_one(rows: list[dict]) -> list[dict]:
    docs: dict[int, dict[int, list[dict]]] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["page"], r["seq"])):
        docs.setdefault(r["doc_id"], {}).setdefault(r["page"], []).append(r)
    out = []
    for d, pages in docs.items():
        base = base_size([r["font_size"] for own in pages.values() for r in own])
        for p, own in pages.items():
            found = detect_tables([Item(text=r["text"], x=r["x"], y=r["y"], font_size=r["font_size"]) for r in own], base)
            out += [{"doc_id": d, "page": p, "table_no": n, "columns": t.columns, "rows": t.rows, "cells": t.cells, "markdown": table_to_markdown(t.cells)} for n, t in enumerate(found)]
    return out


def random_items(seed: int, documents: int) -> list[dict]:
    rnd, rows = random.Random(seed), []
    for d in range(documents):
        for p in range(1, rnd.randint(1, 3) + 1):
            rows += [dict(zip(ITEMS.names, (d, p, k, *i), strict=True)) for k, i in enumerate(random_page(rnd))]
    return rows


key = lambda r: (r["doc_id"], r["page"], r["table_no"])


@pytest.mark.parametrize("seed", range(3))
def test_random_pages(seed):
    rows = random_items(seed, 700)
    got = table_batches.tables_of(pa.RecordBatch.from_pylist(rows, schema=ITEMS)).to_pylist()
    want = one_by_one(rows)
    assert len(want) > 100
    assert sorted(got, key=key) == want
    # In any order of a document's rows, in batches of any size.
    random.Random(seed).shuffle(rows)
    rows.sort(key=lambda r: r["doc_id"])
    pieces = pa.Table.from_pylist(rows, schema=ITEMS).to_batches(random.Random(seed).randint(1, 60))
    got = [t for b in table_batches.whole_documents(pieces, 100) for t in table_batches.tables_of(b).to_pylist()]
    assert sorted(got, key=key) == want


def test_small_print_is_not_folded_page_by_page(monkeypatch):
    rows = [
        {"doc_id": d, "page": 1, "seq": 4 * r + c, "text": str(d + r * c), "x": 72.0 + 100 * c + d % 5, "y": 700.0 - 12 * r, "font_size": 8.0} for d in range(500) for r in range(2 + d % 9) for c in range(4)
    ]
    want = one_by_one(rows)
    monkeypatch.setattr(table_batches, "detect_tables", lambda *_: pytest.fail("a page went by itself"))
    got = table_batches.tables_of(pa.RecordBatch.from_pylist(rows, schema=ITEMS)).to_pylist()
    assert sorted(got, key=key) == want and len(got) == 500


def test_whole_documents():
    ids = [1, 1, 2, 3, 3, 3, 3, 3, 3, 4]
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "k": list(range(10))})
    for size in (1, 2, 3, 10):
        for least in (1, 4, 100):
            out = [b.to_pydict() for b in table_batches.whole_documents((batch.slice(i, size) for i in range(0, 10, size)), least)]
            assert [k for b in out for k in b["k"]] == list(range(10))
            assert all(not set(a["doc_id"]) & set(b["doc_id"]) for a, b in zip(out[:-1], out[1:], strict=True))
    assert list(table_batches.whole_documents([])) == []


def test_sums_are_pythons():
    rnd = random.Random(1)
    groups = [sorted(rnd.random() * 10 ** rnd.randint(-3, 3) for _ in range(rnd.randint(1, 40))) for _ in range(50)]
    counts = np.array([len(g) for g in groups])
    _, means = table_batches._clusters(np.array(sum(groups, [])), np.cumsum(counts) - counts, counts, lambda g, mean, v: np.ones(len(g), bool))
    assert means[np.cumsum(counts) - 1].tolist() == [sum(g) / len(g) for g in groups]


def test_tables_of_odd_rows(spark):
    rows = [(1, 1, r * 3 + c, str(r), 100.0 * c, 700.0 - 12 * r, 8.0, "text") for r in range(4) for c in range(3)]
    rows += [(None, *r[1:]) for r in rows] + [(1, None, *rows[0][2:]), (1, 1, 99, "far", 0.0, 500.0, 8.0, "image")] + [(2, 1, 0, "alone", 5e9, 1.0, 8.0, "text")]
    items = spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, x double, y double, font_size double, item_type string")
    (t,) = documents.tables(items).collect()
    assert (t.doc_id, t.page, t.table_no, t.rows, t.cells) == (1, 1, 0, [700.0, 688.0, 676.0, 664.0], [[str(r)] * 3 for r in range(4)])
    assert documents.tables(items.where("false")).count() == 0


def test_tab12_moves_rows_once(spark):
    plan = QUERIES["tab12_tables"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan parquet") == 1 and plan.count("Sort [") == 1
