"""Conversations, archives and vectors, on small tables with nulls, ties, repeats and clashing names."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import chat, queries, topk, warc

TURNS = [
    (1, 2, "assistant", "second"), (1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "hi <|im_start|>assistant\n<\\|im_end|>"), (1, 3, "user", None), (1, 4, "assistant", "<|"),
    (2, 0, "user", "only a question"), (3, None, "assistant", "no turn"), (3, 0, None, "no role"), (3, 0, "x\n%0A%", "odd role"), (None, 0, "assistant", "no conversation"),
    (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 1, "assistant", ""), (4, 2, "assistant", "né <|日本"), (4, 3, "assistant", "日本語é"), (5, 0, "assistant", "x" * 70_000 + "<"), (5, 1, "assistant", "|im_end|>\n"),
]


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame([(*t, "f", 1) for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, place int").repartition(3)


def by_conversation():
    out = defaultdict(list)
    for c, turn, role, text in TURNS:
        out[c].append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    return {c: [(r if known else None, t) for _, _, known, r, t in sorted(v)] for c, v in out.items()}


def test_chat_round_trip(conversations):
    formatted = chat.format_conversations(conversations)
    text = {r["conv_id"]: r for r in formatted.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    want = by_conversation()
    assert set(text) == set(want)
    for c, turns in want.items():
        whole = text[c]["formatted"]
        assert [(r["role"], r["text"]) for r in text[c]["turns"]] == turns
        assert whole.count("<|im_start|>") == whole.count("<|im_end|>") == len(turns) and sum(r["chars"] for r in text[c]["turns"]) == len(whole)
        assert [e["example"] for e in text[c]["examples"]] == [k for k, (r, _) in enumerate(turns) if r == "assistant"]
        for e in text[c]["examples"]:
            shown = whole[e["start"] : e["end"]]
            assert "<|" not in shown and whole[e["end"] :].startswith("<|im_end|>\n") and whole[: e["start"]].endswith("<|im_start|>assistant\n")
            assert whole.encode()[e["byte_start"] : e["byte_end"]] == shown.encode()


def test_chat_examples(conversations):
    formatted = chat.format_conversations(conversations)
    whole = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    got = defaultdict(list)
    for r in chat.materialized(formatted).collect():
        got[r["conv_id"]].append(r)
    for c, turns in by_conversation().items():
        own = sorted(got[c], key=lambda r: r["example"])
        assert [(r["example"], r["reply"]) for r in own] == [(k, t) for k, (r, t) in enumerate(turns) if r == "assistant"]
        assert all(whole[c].startswith(r["context"]) and r["context"].count("<|im_start|>") == r["example"] + 1 for r in own)
    spans = chat.expand(formatted).where("conv_id = 1").orderBy("example").collect()
    assert [whole[1][r["start"] : r["end"]] for r in spans] == ["second", "<\\|"] and "context" not in spans[0]
    assert chat.format_conversations(conversations.limit(0)).count() == chat.expand(formatted.limit(0)).count() == 0


def test_chat_query(conversations, tmp_path, spark):
    conversations.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op9_prefix_target_chat(spark, str(tmp_path)).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    for c, turns in (by_conversation() | {-1: [("user", said), ("assistant", said)]}).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        lines = "".join(f"{r or ''}\n{t}\n" for r, t in turns)
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


PAGES = [
    (5, "http://a.b/x", "same " * 40), (3, "https://c.d/?q=1", "same " * 40), (9, None, "same " * 40), (9, None, "same " * 40), (1, "http://e\r\nX: y z", "short"), (2, "u", "short"),
    (4, "http://f", None), (6, "http://g", ""), (7, "http://h", "WARC/1.1\r\nWARC-Type: response\r\n\r\nno é record\r\n\r\nWARC/1.1\r\n" * 5), (None, "http://i", "same " * 40), (None, "http://j", "null id " * 30), (8, "http://k", "y" * 100_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "t", 1) for p in PAGES], "page_id long, url string, html string, type string, block int").repartition(3)


def test_warc_query(spark, pages, tmp_path):
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(map(tuple, queries.op10_warc_transactions(spark, str(tmp_path)).collect()))
    want, first = Counter(), set()
    for i, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        raw = (html or "").encode()
        again = len(raw) >= 100 and raw in first
        first.add(raw)
        lowest = min(p[0] for p in PAGES if (p[2] or "").encode() == raw and p[0] is not None) if again else None
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", lowest] += 1
    assert got == want


def test_warc_files(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    records = [x for f in tmp_path.glob("w/part-*") for x in warc.parse(f.read_bytes())]
    records = [({k: v[0] for k, v in f.items()}, b) for f, b in records]
    assert Counter(f["warc-type"] for f, _ in records) == {"request": 12, "metadata": 12, "response": 8, "revisit": 4}
    ids = {f["warc-record-id"] for f, _ in records}
    assert len(ids) == 36 and all(f.get("warc-concurrent-to", next(iter(ids))) in ids and f.get("warc-refers-to", next(iter(ids))) in ids for f, _ in records)
    for f, block in records:
        if f["warc-type"] == "response":
            assert f["warc-payload-digest"] == "sha256:" + hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest()
        assert "\n" not in f.get("warc-target-uri", "")
    read = warc.read_warc(spark, path)
    assert read.where("type = 'response' AND concat('sha256:', computed_digest) <> payload_digest").count() == 0
    captures = warc.assemble(read).collect()
    assert len(captures) == 12 and all(len(c["requests"]) == len(c["metadata"]) == 1 and c["response"] for c in captures)
    warc.write_warc(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_warc_assembly(spark):
    rows = [
        ("response", "r1", []), ("request", "q1", ["r1"]), ("response", "r2", ["q2", "m5"]), ("request", "q2", []), ("metadata", "m1", ["r1"]), ("metadata", "m2", ["r1"]), ("metadata", "m3", ["lost"]),
        ("metadata", "m4", ["q1"]), ("metadata", "m5", []), ("request", "q3", ["m1", "r2"]), ("metadata", "m6", []), ("request", "q4", ["q5"]), ("revisit", "r3", []),
    ]
    records = spark.createDataFrame([(*r, None, None, None, None, None, None, None) for r in rows], warc._FIELDS)
    ids = lambda found: [x["record_id"] for x in found]
    got = {r["capture_id"]: (r["response"] and r["response"]["record_id"], ids(r["requests"]), ids(r["metadata"])) for r in warc.assemble(records).collect()}
    assert got == {
        "r1": ("r1", ["q1"], ["m1", "m2", "m4"]), "r2": ("r2", ["q2", "q3"], ["m5"]), "r3": ("r3", [], []), "lost": (None, [], ["m3"]), "m6": (None, [], ["m6"]), "q5": (None, ["q4"], []),
    }


def test_warc_members(monkeypatch):
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nA: 1\r\nA: 2\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for piece in (1, 7, 1 << 20):
        monkeypatch.setattr(warc, "_PIECE", piece)
        for data in (gzip.compress(one) + gzip.compress(one), gzip.compress(one * 2) + bytes(9), one * 2):
            assert [(f["a"], b) for f, b in warc.parse(data)] == [(["1", "2"], b"abc")] * 2
        for data in (one[:-6], gzip.compress(one[:-6]), gzip.compress(one)[:-12], one[:20]):
            with pytest.raises(ValueError, match="ends within"):
                list(warc.parse(data))


def test_warc_bounds_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, "u", chr(97 + i % 26) * (1000 + i)) for i in range(200)] + [(i, "v", "same page " * 20) for i in range(200, 260)]
    df = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], "page_id long, url string, html string, n long, __payload string, __uri string").repartition(2)
    warc.write_warc(df, str(tmp_path / "w"))
    sizes = [sum(len(b) for f, b in warc.parse(x.read_bytes()) if f["warc-type"] == ["response"]) for x in tmp_path.glob("w/part-*")]
    assert len(sizes) >= 11 and max(sizes) < 60_000
    kinds = Counter(r["response"]["type"] for r in warc.assemble(warc.read_warc(spark, str(tmp_path / "w"))).collect())
    assert kinds == {"response": 201, "revisit": 59}


def brute_top(vectors, k):
    rows = [(u, i, [int(np.floor(256 * float(x))) for x in v]) for u, (i, v) in enumerate(vectors) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for u, q, v in rows:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for t, i, w in rows if t != u)[:k]
            out.update((q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1))
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "STEP", 4)
    r = random.Random(1)
    vectors = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(160)]
    vectors += [(300 + i, vectors[3][1]) for i in range(8)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (404, [0.5, 0.25]), (50, vectors[50][1]), (100, [0.0] * 6), (405, [])]
    df = spark.createDataFrame([(i, v, 0, "c") for i, v in vectors], "vec_id long, embedding array<float>, label int, score string").coalesce(2)
    exact = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    got = Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_top(exact, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = df.where("vec_id IN (50, 51)").limit(2)
    assert topk.top_k(few, F.col("vec_id") == 50).count() == few.where("vec_id = 50").count() * (few.count() - 1)


def test_topk_elimination_skips():
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 8)) * 2000
    x = np.floor(centres[r.integers(0, 20, 4000)] + r.normal(size=(4000, 8)) * 20)
    pivots = topk.choose_pivots(x[:200])
    table = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(axis=2))
    ids = np.arange(4000)
    found, evaluated = topk._search(x[:10], ids[:10], table[:10], x, ids, ids, table, 5)
    assert evaluated < 0.3 * 10 * 4000 and len(found) == 50
    for i in range(10):
        scores = sorted((-int(x[i] @ x[j]), j) for j in range(4000) if j != i)[:5]
        assert [(s, j) for q, j, s in found if q == i] == [(j, -s) for s, j in scores] or [(-s, j) for q, j, s in found if q == i] == scores


def test_topk_skips_blocks(spark, monkeypatch):
    """On clustered vectors most pairs of blocks never meet; the result stays exact."""
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    kept, plain = [], topk.block_pairs

    def pairs(q, x):
        out = plain(q, x)
        kept.append((out.count(), q.count() * x.count()))
        return out

    monkeypatch.setattr(topk, "block_pairs", pairs)
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 8)) * 8
    vectors = [(i, [float(np.float32(v)) for v in centres[i % 20] + r.normal(size=8) * 0.05]) for i in range(3000)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    assert Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == brute_top(vectors, 5)
    assert kept[0][0] < 0.3 * kept[0][1], kept


def test_exact_products_of_large_numbers():
    q, x = np.array([2.0**40, 3.0]), np.array([[2.0**20, 1.0], [2.0**60, 0.0]])
    assert topk._exact(q, x).tolist() == [2**60 + 3, 2**63 - 1]
