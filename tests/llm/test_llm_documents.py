"""Operators over documents against brute force on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
import resource
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from oracle import SF_DIR
from pagewright.llm import dac, mixing, neardup, ordermin, packing, queries, sharding, toxicity
from pagewright.llm import common
from pagewright.llm.common import join_counted, ordered
from pagewright.llm.tokens import PieceEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, shard string, key string, label string, copies string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def words(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    r = random.Random(5)
    out = []
    for i in range(60):
        out.append((i * 3, words(r, r.randint(1, 80)), f"s{i % 4}"))
    base = words(r, 120).split()
    for i in range(40):  # a family of near copies
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = "edit" + str(r.randint(0, 99))
        out.append((500 + i, " ".join(w), "s1"))
    out += [(900 + i, "The same text, five words and MORE in it.", "s0") for i in range(30)]
    out += [(1000, None, "s2"), (1001, "", None), (1002, " \n\t ", "s3"), (1003, "one", None), (1004, "one two three four", "s2"), (1005, "ONE two three four", "s2")]
    out += [(1006, words(r, 3000), "s3"), (None, "no id here but some words to tell", "s0"), (2, out[4][1], "s0"), (2, out[4][1], "s0"), (1007, "né 日本語のテキスト  two  blanks\n\n<|endoftext|> end ", "s1")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", "k", "l", "c") for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return (i is None, i or 0)


def test_ordered(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id", F.lit(2).alias("v"))
    got = ordered(df, ["k", "id"], {"before": "v"}).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1000)) and [r["before"] for r in got] == [2 * i for i in range(1000)]
    assert [(r["k"], r["id"]) for r in got] == sorted((i % 7, i) for i in range(1000))


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_join_counted(spark, monkeypatch, kind):
    """Heavy keys, keys of one row, null keys and keys that groups don't have."""
    monkeypatch.setattr(common, "HEAVY", 4)
    df = spark.range(100).select(F.when(F.col("id") % 10 < 9, F.least(F.col("id") % 10, F.lit(4)) + F.when(F.col("id") > 90, 50).otherwise(0)).cast("string").cast(kind).alias("k"), "id", F.lit("x").alias("heavy_key"))
    groups = df.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", F.lit(None).cast("string").alias("z"))).alias("first")).where("n > 1")
    rows = [(r["k"], r["id"]) for r in df.collect()]
    counts = Counter(k and bytes(k) if kind == "binary" else k for k, _ in rows)
    low = {}
    for k, i in rows:
        k = k and bytes(k) if kind == "binary" else k
        low[k] = min(low.get(k, i), i)
    for how in ("left", "inner"):
        got = join_counted(df, groups, "k", "n", 100, how).collect()
        want = Counter()
        for k, i in rows:
            k = k and bytes(k) if kind == "binary" else k
            met = k is not None and counts[k] > 1
            if met or how == "left":
                want[k, i, "x", counts[k] if met else None, low[k] if met else None] += 1
        assert Counter((r["k"] and bytes(r["k"]) if kind == "binary" else r["k"], r["id"], r["heavy_key"], r["n"], r["first"] and r["first"]["id"]) for r in got) == want


def test_op1_texts(docs, rows, empty):
    got = ordermin.fingerprints(docs).collect()
    assert len(got) == len(rows) and ordermin.fingerprints(empty).count() == 0
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: key(x[0]))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_text = defaultdict(set)
    text = dict((i, t or "") for i, t, _ in rows)
    for r in got:
        by_text[text[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by_text.values())
    long = next(r for r in got if r["doc_id"] == 1006)
    assert long["near_edited"] > 0.2 > long["near_next"]


def spark_hash(*values):
    """xxhash64 of strings, and of ints as 4 or (longs, given as a tuple) 8 bytes."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v[0] % 2**64).to_bytes(8, "little") if isinstance(v, tuple) else v.to_bytes(4, "little")
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h


def brute_sketch(text):
    """Order MinHash of a text, k-mer by k-mer."""
    found = [w for w in re.split("[ \t-\r]+", re.sub("([\u3040-\u30ff\u4e00-\u9fff])", r" \1 ", text or "")) if w]
    found = [x for w in found for x in (w[:40], *w[40:])]
    mask = (1 << 33) - 1
    mers = [spark_hash(*p) & mask for p in zip(found[:-1], found[1:], strict=True)] if len(found) > 1 else [spark_hash(w) & mask for w in found]
    seen, own = Counter(), []
    for place, h in enumerate(mers):
        own.append((h if not seen[h] else spark_hash((h,), seen[h]) & mask, place))
        seen[h] += 1
    own.sort()
    out = []
    for bucket in range(64) if own else ():
        first = [x for x in own if x[0] >= bucket << 27] + own
        pair = [(h,) for h, _ in sorted(first[:2] if len(own) > 1 else own, key=lambda x: x[1])]
        out.append(bucket << 24 | spark_hash(*pair) & (1 << 24) - 1)
    return out


def test_op1_against_brute_force(spark, docs, rows):
    texts = [None, "", " ", "one", "one two", "a " * 300, "b a " * 77, "x" * 41, "x" * 90 + " y", "日本語の text", *(t for _, t, _ in rows[:70]), rows[-1][1]]
    got = ordermin.with_sketch(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "s").collect()
    for r in got:
        assert r["s"] == brute_sketch(r["t"]), r["t"]
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: key(x[0]))
    like = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 64 if a and b else float(not a and not b)
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 4
        own, other = brute_sketch(t), brute_sketch(t[: len(t) - cut] + after[:cut])
        want[i, "".join(f"{x:08x}" for x in own), "".join(f"{x:08x}" for x in other), like(own, other), like(own, brute_sketch(after))] += 1
    fields = ("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert Counter(tuple(r[f] for f in fields) for r in ordermin.fingerprints(docs).collect()) == want


def test_op1_order_counts(spark):
    r = random.Random(1)
    texts = []
    for n in (10, 20, 40, 80, 150, 400):
        for _ in range(8):
            w = [f"w{r.randrange(10**6)}" for _ in range(n)]
            texts += [(n, " ".join(w)), (n, " ".join(w[n // 2 :] + w[: n // 2])), (n, " ".join(reversed(w)))]
    texts += [(0, "a " * 500), (0, "a " * 501), (0, "a " * 30)]
    got = ordermin.with_sketch(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "i int, t string"), "t", "s")
    s = [x["s"] for x in sorted(got.collect(), key=lambda x: x["i"])]
    like = lambda a, b: len(set(s[a]) & set(s[b])) / 64
    swapped = defaultdict(list)
    for i in range(0, len(texts) - 3, 3):
        swapped[texts[i][0]].append(like(i, i + 1))
        assert like(i, i) == 1 and like(i, i + 2) < 0.2
    assert all(0.2 < np.mean(v) < 0.65 for v in swapped.values()), swapped  # whatever the length
    n = len(texts) - 3
    assert like(n, n + 1) > 0.8 > like(n, n + 2)  # repeats count


def test_op2(spark, empty):
    r = random.Random(3)
    data = []
    for i in range(1500):
        toxic = i % 5 == 0
        w = words(r, r.randint(5, 60)).split()
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vile", "foul", "nasty"]))
        data.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(5000, None), (5001, ""), (0, "twice vile vile foul")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(None, 1, 1), (3, 0, None), (4, 0, 7), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert 0 < len(model.places) < 2000
    got = {(x["doc_id"], x["text"]): x["score"] for x in toxicity.score(docs, model).collect()}
    assert len(got) == 1503 and got[5000, None] == got[5001, ""] < 0.3
    held = [(i, t, y) for i, t, y in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i, t] >= 0.3) == bool(y) for i, t, y in held]) > 0.97
    again = {(x["doc_id"], x["text"]): x["score"] for x in toxicity.score(docs.repartition(7), toxicity.train(docs.repartition(5), labels)).collect()}
    assert again == got
    none = toxicity.train(empty.select("doc_id", "text"), labels.limit(0))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] < 0.01
    assert toxicity.score(empty, model).count() == 0
    assert set(docs.join(labels, "doc_id").select(toxicity.held_out()).distinct().toPandas().iloc[:, 0]) == {True, False}


def test_op2_long_texts(spark):
    """A score depends on what a text says, not on its length."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    some = lambda n: r.choices(vocabulary, k=n)
    rows = [(i, " ".join(some(40) + ["vile", "foul", "nasty"] * (i % 4 == 0) + some(20)), int(i % 4 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert len(model.places) and (np.diff(model.places.astype(np.int64)) > 0).all()
    clean = some(500_000)
    bad = [*clean[:250_000], "vile", "foul", "nasty", *clean[250_000:]]
    texts = [clean[:60], clean[:513], clean[:90_000], clean, bad, clean + bad[250_000:250_003], bad[250_000:250_003] + clean]
    long = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = [x["score"] for x in toxicity.score(long, model).orderBy("doc_id").collect()]
    assert max(got[:4]) < toxicity.THRESHOLD <= min(got[4:]), got
    others = np.unique(np.concatenate([toxicity.features(f"other{i}") for i in range(2000)]))
    crowded = toxicity.Model(others, np.full(len(others), 0.1), -2.0)  # none of its grams occurs
    assert max(x["score"] for x in toxicity.score(long.limit(4), crowded).collect()) < 0.2


@pytest.mark.parametrize(("name", "separator"), [("byte_bpe_50k.json", "\n"), ("word_bpe_49k.json", " \x01 ")])
def test_pieces_give_the_librarys_ids(name, separator):
    r = random.Random(2)
    abc = "ab  \n\t.'sSİiıÀǅtτςΣé́ \x1c\x1f<|>end\x01 　中1_9,A "
    texts = ["".join(r.choice(abc) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "a ", " a", "İ.", "aİ, İİ!", "".join(map(chr, range(0xC0, 0x250))), *(chr(c) + "." for c in range(0xC0, 0x250)), "<|endoftext|> a <|startoftext|>", "one two.\nthree, four's 'five' 3.14 a_b", "x!.y é.", "it's we'll I'd."]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    enc = PieceEncoder(public_tokenizers.path(name), separator, memory=500)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == want


@pytest.mark.parametrize(("name", "separator"), [("byte_bpe_50k.json", "\n"), ("word_bpe_49k.json", " \x01 ")])
def test_pieces_go_to_the_library_once(name, separator):
    """A word is one piece (or two, after a blank and without), whatever stands beside it; pieces used last are kept."""
    r = random.Random(9)
    words = sorted({"".join(r.choice("abcdefgàéжß") for _ in range(8)) + r.choice("xyz") for _ in range(200)})
    texts = [f'{w} ({w}) "{w}" {w}-{w}, {w}/{w}: {w}1 {w}=2;\n{w}\n\n{w}\t{w}  {w}' for w in words if w[0].isascii()]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    enc = PieceEncoder(public_tokenizers.path(name), separator)
    assert enc.ids(texts) == want
    assert len(enc.known) <= 2 * len(texts) + 40
    assert enc.ids(pa.array([None, "x", *texts]).slice(2)) == want and enc.ids(pa.array([None, *texts])) == [b"", *want]
    enc = PieceEncoder(public_tokenizers.path(name), separator, memory=100)
    for _ in range(2):
        for part in (words[:60], words[60:120]):
            line = " ".join(part)
            assert enc.ids([line]) == [np.array(t.encode(line, add_special_tokens=False).ids, dtype="<u4").tobytes()]
            assert len(enc.known) <= 50 + 61
    assert sum(f" {w}" in enc.known for w in words[:60]) >= 45


def test_dac_segments():
    r = random.Random(4)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = np.array([r.choice([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1, r.randint(0, 60000)]) for _ in range(n)], dtype="<u4")
        s = dac.Segment(dac.encode([None, 7], [ids[: n // 3].tobytes(), ids[n // 3 :].tobytes()]))
        assert len(s) == n and s.doc_ids == [None, 7] and s.first.tolist() == [0, n // 3, n]
        assert s.slice(0, n).tolist() == ids.tolist()
        for _ in range(20):
            a = r.randint(0, n)
            b = r.randint(a, n)
            assert s.slice(a, b).tolist() == ids[a:b].tolist()
        assert all(s[i] == ids[i] for i in range(0, n, 37))
        reads = []
        data = dac.encode([None, 7], [ids[: n // 3].tobytes(), ids[n // 3 :].tobytes()])

        def read(at, size, data=data, reads=reads):
            reads.append(size)
            return data[at : at + size]

        for i in range(0, n, 41):
            assert dac.read_id(read, i) == ids[i]
            assert sum(reads) < 500  # of thousands of bytes
            reads.clear()


def _ids(text, name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("name", ["0a1b2c3d-c123-4abc-8def-0123456789ab", "0a1b2c3d-4567-4abc-8def-c12345678901", "2c6154ff-117f-4377-94be-ac92dc655d5e"])
def test_op3_numbers_of_segments(spark, tmp_path, name):
    """Segments of one task keep their own numbers, whatever random id is in the names of their files."""
    for part in range(2):
        for k in range(3):
            (tmp_path / f"part-0000{part}-{name}-c00{k}.txt").write_bytes(b"x")
    found = dac._files(spark, str(tmp_path)).select("part", "segment").collect()
    assert sorted(map(tuple, found)) == [(part, k) for part in range(2) for k in range(3)]


def test_op3(spark, docs, rows, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT", 500)
    dac.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(dac.read_documents(spark, str(tmp_path / "t"), ids=True).collect(), key=lambda r: r["start"])
    assert [key(r["doc_id"]) for r in got] == sorted(key(i) for i, _, _ in rows)
    at, text = 0, {i: t for i, t, _ in rows}
    for r in got:
        ids = _ids(text[r["doc_id"]], "byte_bpe_50k.json")
        raw = np.array(ids, dtype="<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids), zlib.crc32(raw), raw)
        at += len(ids)
    every = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    store = dac.TokenStore(spark, str(tmp_path / "t"))
    assert store.index.count() > 4 and all(store[i] == every[i] for i in (0, 1, 501, 1234, len(every) - 1))
    with pytest.raises(IndexError):
        store[len(every)]
    dac.write_tokens(empty, str(tmp_path / "e"), public_tokenizers.path("byte_bpe_50k.json"))
    assert dac.read_documents(spark, str(tmp_path / "e")).count() == 0


def brute_components(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    low = {}
    for a, (i, _, _) in enumerate(rows):
        low[find(a)] = min(low.get(find(a), i), i, key=key)
    return Counter((i, len(sets[a]), low[find(a)]) for a, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("small", [32, 2])
def test_op4(docs, rows, empty, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    got = neardup.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    if small == 32:
        assert neardup.near_duplicates(empty).count() == 0
        left = [r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()]
        assert Counter(left) == Counter({i for i, _, low in brute_components(rows) if i == low})


def test_op4_drops_rows(spark):
    """Rows that share a key, or have none, stay or go one by one."""
    r = random.Random(9)
    a, b, c, d, e = (words(r, 40) for _ in range(5))
    near = e + " end"  # 36 of 37 shingles
    rows = [(5, a), (None, a), (None, b), (3, c), (7, c), (7, d), (None, e), (None, near), (9, b.upper()), (8, None), (8, ""), (11, near + " x"), (11, near)]
    got = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    left = Counter((x["doc_id"], x["text"]) for x in got)
    family = [x for x in left if x[0] == 11]
    assert len(family) == 1 and family[0] in rows
    assert left == Counter([(5, a), (3, c), (7, d), (9, b.upper()), (8, None), (8, ""), family[0]])
    alone = neardup.drop_near_duplicates(spark.createDataFrame([(None, a), (None, a + " x"), (None, b)], "doc_id long, text string")).collect()
    assert len(alone) == 2 and b in [x["text"] for x in alone]


def test_op4_similarity_estimate(spark):
    a, b = [0x1111, -1], [0x1010, 0]
    got = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(neardup.similarity(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx((1 - (2 + 16) / 240 - 1 / 16) / (15 / 16))


def check_pieces(got, rows, name, limit, limits):
    text = {i: t for i, t, _ in rows}
    seqs, per_doc = defaultdict(list), defaultdict(list)
    for r in got:
        ids = _ids(text[r["doc_id"]], name)
        piece = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(piece) and len(piece) == 4 * r["length"] > 0
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]].append((r["start"], r["length"], len(ids)))
    copies = Counter(i for i, _, _ in rows)
    for i, pieces in per_doc.items():
        covered = Counter(k for s, n, _ in pieces for k in range(s, s + n))
        assert covered == Counter({k: copies[i] for k in range(pieces[0][2])})
    assert set(per_doc) == set(copies)
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= limit and at & (at - 1) == 0 and len(pieces) <= limits.segments


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 5, 50), packing.Limits(256, 2, 256)])
def test_op5(docs, rows, empty, limits):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, limits=limits, loss_from=3).collect()
    check_pieces(got, rows, "word_bpe_49k.json", limits.tokens, limits)
    loss = defaultdict(int)
    for r in got:
        loss[r["sequence_id"]] += max(0, r["length"] - max(0, 3 - r["start"]))
    assert max(loss.values()) <= limits.loss
    assert packing.pack_documents(empty, path).count() == 0


def test_op5_encodes_whole_batches(monkeypatch):
    """Arrow's texts go to the encoder as they are, a batch at a time, and every id comes out once."""
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    r = random.Random(11)
    texts = [r.choice([None, "", words(r, r.randint(1, 90)), "<|endoftext|> (A) b's"]) for _ in range(1000)]
    enc, calls = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), " \x01 "), []

    def ids_of(part):
        calls.append((isinstance(part, pa.Array), len(part)))
        return enc.ids(part)

    end = np.array([2], dtype="<u4").tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["key", "text"])
    out = [x for b in packing._batches(ids_of, end, packing.Limits(), 0, pa.int64())(iter([batch])) for x in b.to_pylist()]
    assert calls == [(True, 1000)]
    whole = defaultdict(bytes)
    for x in sorted(out, key=lambda x: (x["key"], x["start"])):
        assert x["start"] == len(whole[x["key"]]) // 4
        whole[x["key"]] += x["ids"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert whole == {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes() for i, x in enumerate(texts)}


def test_op6(docs, rows, empty):
    prepared = docs.withColumn("link", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    got = sharding.shard_rows(prepared, "link", "doc_id").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    groups = defaultdict(lambda: [0, set()])
    for r in got:
        groups[r["link"]][0] += 1
        groups[r["link"]][1].add(r["shard"])
    assert all(len(s) <= max(1, -(-n // min(sizes)) + 1) for n, s in groups.values())
    assert sharding.shard_rows(empty.withColumn("link", F.lit("a")), "link", "doc_id").count() == 0


def brute_targets(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    whole, target, open_ = sum(size.values()), {s: 0.0 for s in order}, set(order)
    excess = float(whole)
    while excess > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / w
        excess = 0.0
        for s in list(open_):
            if target[s] >= 3 * size[s]:
                excess += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
                open_.remove(s)
    return size, target


def test_op7(docs, rows, empty):
    got = mixing.entropy_balance(docs).collect()
    size, target = brute_targets(rows)
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), max(size.values())
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    for s in size:
        most = max([r["size"] for r in got if r["source"] == s])
        assert abs(taken[s] - target[s]) <= most, (s, taken[s], target[s], largest)
    again = Counter((r["doc_id"], r["size"], r["copies"]) for r in mixing.entropy_balance(docs.repartition(5)).collect())
    assert again == Counter((r["doc_id"], r["size"], r["copies"]) for r in got)
    assert mixing.entropy_balance(empty).count() == 0
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    mixed = mixing.apply_mix(docs, mixing.entropy_balance(docs))
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == +want


def test_op7_margins(spark):
    """Newton's multipliers of sources and margins against a plain optimizer's rates: token constraints hold."""
    r = random.Random(4)
    langs = {"a": "eedf", "b": "edf", "c": "ffde"}
    rows = [(i, words(r, r.randint(1, 60)), s, r.choice(langs[s])) for i, s in enumerate("aaabbbbccc" * 60)] + [(900, None, "a", None), (901, "some words", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    plain, got = (mixing.entropy_balance(docs, margins=m).collect() for m in ((), ("lang",)))
    lang = {i: x for i, _, _, x in rows}
    whole = sum(x["size"] for x in got)
    share = lambda rates: {v: sum(x["size"] * x["rate"] for x in rates if lang[x["doc_id"]] == v) / whole for v in "edf"}
    want = {v: sum(x["size"] for x in got if lang[x["doc_id"]] == v) / whole for v in "edf"}
    assert max(abs(share(plain)[v] - want[v]) for v in want) > 0.05 and max(abs(share(got)[v] - want[v]) for v in want) < 0.002
    for s in "abc":
        own = [x for x in got if x["source"] == s]
        assert sum(x["size"] * x["rate"] for x in own) == pytest.approx(own[0]["target"], rel=1e-9)
        assert abs(sum(x["size"] * x["copies"] for x in own) - own[0]["target"]) <= max(x["size"] for x in own)
    assert all(0 <= x["copies"] <= 3 for x in got) and len({round(x["rate"], 6) for x in got if x["source"] == "a"}) >= 3
    # The optimum's form: log rates are a sum of a source's and a language's multiplier.
    rate = {(x["source"], lang[x["doc_id"]]): x["rate"] for x in got if x["size"] and x["rate"] < 2.999}
    if {("a", "e"), ("a", "d"), ("b", "e"), ("b", "d")} <= set(rate):
        assert rate["a", "e"] / rate["a", "d"] == pytest.approx(rate["b", "e"] / rate["b", "d"], rel=1e-6)
    with pytest.raises(ValueError, match="margins"):
        mixing.entropy_balance(docs, margins=("doc_id",))


def test_apply_mix_of_equal_keys(spark):
    """A source's words come near its target although all keys are null."""
    r = random.Random(7)
    docs = spark.createDataFrame([(None, words(r, r.randint(1, 50)), "ab"[i % 5 == 0]) for i in range(400)], "doc_id long, text string, source string")
    mix = mixing.entropy_balance(docs).collect()
    taken = defaultdict(int)
    for x in mixing.apply_mix(docs, mixing.entropy_balance(docs)).collect():
        taken[x["source"]] += len(x["text"].split())
    for s in "ab":
        assert taken[s] == sum(x["size"] * x["copies"] for x in mix if x["source"] == s)


def test_pipeline(spark, docs, rows, tmp_path):
    r = random.Random(8)
    bad = [(3000 + i, words(r, 30) + " vile foul nasty " + words(r, 5), "s1") for i in range(60)]
    every = [x for x in rows if x[0] is not None and x[0] != 2] + bad
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in every], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 3000)) for i, _, _ in every], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = kept.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, kept, str(tmp_path))
    left = {x["doc_id"] for x in clean.collect()}
    assert clean.columns == names and len(left & {x[0] for x in bad}) <= 20 and len(left) >= len(every) - 65
    one = stages["near_dedup"](spark, clean, str(tmp_path))
    lows = brute_components([x for x in every if x[0] in left])
    assert one.columns == names and {x["doc_id"] for x in one.collect()} == {i for i, _, low in lows if i == low}
    mixed = stages["mixing"](spark, one, str(tmp_path))
    copies = Counter(x["doc_id"] for x in mixed.collect())
    assert mixed.columns == names
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {i: t for i, t, _ in every}
    check_pieces(pieces, [(i, text[i], None) for i, n in copies.items() for _ in range(n)], "word_bpe_49k.json", 4096, packing.Limits())


def test_op2_gives_the_drivers_memory_back(spark, monkeypatch):
    """What training took is not held by the driver through the stages that follow."""
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize() / 1e6
    pinned = []

    def fit(known, examples):
        some = [bytearray(1000) for _ in range(200_000)]
        pinned.append(some[-1])  # above all the others, so that they go back only if asked to
        return toxicity.Model()

    monkeypatch.setattr(toxicity, "fit", fit)
    docs = spark.createDataFrame([(k, "some words") for k in range(20)], "doc_id long, text string")
    before = resident()
    toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int"))
    assert len(pinned) == 1 and resident() - before < 100


def test_op2_ftrl_by_hand():
    """Weights against FTRL-proximal written out place by place."""
    r = random.Random(3)
    examples = [(np.array(sorted(r.sample(range(30), r.randint(0, 8))), dtype=np.int32), int(r.random() < 0.4)) for _ in range(200)]
    alpha, beta, l1, l2, epochs, positive = 0.3, 1.5, 0.7, 0.5, 2, 3.0
    z, n, bias = defaultdict(float), defaultdict(float), [0.0, 0.0]
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)
    for _ in range(epochs):
        for f, y in examples:
            w, b = {int(i): weight(int(i)) for i in f}, -bias[0] * alpha / (beta + bias[1] ** 0.5)
            g = (1 / (1 + np.exp(-(sum(w.values()) + b))) - y) * (positive if y else 1)
            for i, v in w.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * v
                n[i] += g * g
            bias[0] += g - ((bias[1] + g * g) ** 0.5 - bias[1] ** 0.5) / alpha * b
            bias[1] += g * g
    known = np.arange(100, 130, dtype=np.uint32)
    model = toxicity.fit(known, examples, alpha, beta, l1, l2, epochs, positive)
    want = {100 + i: weight(i) for i in range(30) if weight(i)}
    assert dict(zip(model.places.tolist(), model.weights, strict=True)) == pytest.approx(want) and 0 < len(want) < 30
    assert model.bias == pytest.approx(-bias[0] * alpha / (beta + bias[1] ** 0.5))


def test_queries_over_documents(spark):
    """The registered queries without SQL, on a whole table."""
    rows = [(r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    text = {i: t or "" for i, t, _ in rows}
    ids = {i: np.array(_ids(t, "byte_bpe_50k.json"), dtype="<u4").tobytes() for i, t in text.items()}
    run = lambda name: queries.QUERIES[name](spark, SF_DIR).collect()
    order = sorted(text)
    start = dict(zip(order, np.cumsum([0] + [len(ids[i]) // 4 for i in order]).tolist(), strict=False))
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run("op3_dac_tokens")) == [(i, start[i], len(ids[i]) // 4, zlib.crc32(ids[i])) for i in order]
    check_pieces(run("op5_vector_packing"), rows, "word_bpe_49k.json", 4096, packing.Limits())
    scored = run("op2_ftrl_toxicity")
    assert sorted(r["doc_id"] for r in scored) == order
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    sharded = run("op6_label_propagation_shards")
    for r in sharded:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    slots = defaultdict(list)
    for r in sharded:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(16)]
    assert sum(sizes) == len(order) and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    of = defaultdict(Counter)
    for r in sharded:
        of[text[r["doc_id"]]][r["shard"]] += 1
    held, groups = sum(max(c.values()) for c in of.values() if c.total() > 1), sum(c.total() for c in of.values() if c.total() > 1)
    assert held >= 0.9 * groups  # equal texts stay together: by chance a sixteenth or so of them would
    for r in run("op1_order_minhash"):
        k = order.index(r["doc_id"])
        after, own = text[order[(k + 1) % len(order)]], text[r["doc_id"]]
        cut = len(own) // 4
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256((own[: len(own) - cut] + after[:cut]).encode()).hexdigest())
