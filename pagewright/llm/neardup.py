"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

Texts of equal shingle sets form a class, and one text stands for it. Its MinHash minima, in bands, give
candidates; their low bits, packed, give an estimate of the similarity by counts of unlike bits, corrected
for chance collisions, which drops hopeless candidates; what stays is confirmed on the full sets. A bucket
of n texts isn't expanded into n * n pairs: each text is first compared with one other of its bucket, and
only texts of buckets that still hold several components are compared with those of other components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, hold, join_counted, stored

WORDS_PER_SHINGLE = 5
#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 75
BITS = 4
#: Buckets up to this size are compared by a join, larger ones in blocks of so many texts, or bytes of their full sets.
SMALL_BUCKET, BLOCK, BLOCK_BYTES = 32, 4000, 16_000_000
#: Bits of the bitmap of the texts to confirm.
_BITMAP = 1 << 22
_U = np.uint64


@dataclass(frozen=True)
class Plan:
    """At the similarity 0.75 a pair shares no band with a probability of (1 - 0.75**rows)**bands, 2.3e-6 here; more
    bands make that smaller. Estimates of pairs at 0.75 have a deviation of 0.029; below least_estimate (4.5
    deviations) a candidate is dropped: minus infinity confirms every candidate on the full sets."""

    bands: int = 48
    rows: int = 5
    least_estimate: float = 0.62

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


@cache
def _multipliers(plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    some = lambda seed, shape: np.random.default_rng(seed).integers(0, 2**64, shape, dtype=np.uint64) | _U(1)
    return some(20240917, plan.hashes), some(20240918, (plan.bands, plan.rows))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def _hold() -> None:
    hold("neardup", _WORDS.clear)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text in UTF-8: five words each, A-Z lower-cased;
    with fewer words the whole sequence is one."""
    words = (text or b"").lower().split()
    if len(words) < WORDS_PER_SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))][: len(words)], dtype=np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(w) - WORDS_PER_SHINGLE + 1
    h = w[:n].copy()
    for j in range(1, WORDS_PER_SHINGLE):
        h *= _U(0x9E3779B97F4A7C15)
        h += w[j : n + j]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return np.unique(h)


def minima(found: np.ndarray, plan: Plan) -> np.ndarray:
    factors, _ = _multipliers(plan)
    out = np.full(plan.hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(out, (found[at : at + 1024, None] * factors).min(axis=0), out=out)
    return out >> _U(32)


def _signer(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold()
        _, factors = _multipliers(plan)
        fixed = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).view(np.int64).reshape(-1)), m.shape[1]).cast(pa.list_(pa.int64()))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, hashes, rows = [], [], []
                for t in part.column(1):
                    own = shingles(t.as_py())
                    sizes.append(len(own))
                    hashes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    rows.append(minima(own, plan))
                low = np.stack(rows)
                bands = (low.reshape(-1, plan.bands, plan.rows) * factors).sum(axis=2, dtype=np.uint64)
                bands ^= bands >> _U(29)
                packed = np.zeros((len(low), -(-plan.hashes // 16)), dtype=np.uint64)
                for j in range(16):
                    here = low[:, j::16] & _U(15)
                    packed[:, : here.shape[1]] |= here << _U(4 * j)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), fixed(bands), fixed(packed)],
                    ["key", "th1", "th2", "n", "set_hash", "bands", "sig"],
                )

    return run


def similarity(a: Column, b: Column, hashes: int = Plan().hashes) -> Column:
    """Estimate from two packed signatures: places whose low bits differ, corrected for equality by chance."""
    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(_any_bit(x.bitwiseXOR(y)))), F.lit(0), lambda s, x: s + x)
    chance = 1 / 2**BITS
    return (1 - unlike / hashes - chance) / (1 - chance)


def _any_bit(x: Column) -> Column:
    """A one for each group of four bits that isn't zero."""
    some = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    return some.bitwiseAND(F.lit(0x1111111111111111))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches.

    Labels go along the edges and then jump to the label's own label, until nothing changes.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("low"))
        met = labels.join(near, F.col("node") == F.col("at")).select("node", F.col("label").alias("old"), F.least("label", "low").alias("new"))
        jump = labels.select(F.col("node").alias("by"), F.col("label").alias("far"))
        after = stored(met.join(jump, F.col("new") == F.col("by"), "left").select("node", "old", F.least("new", "far").alias("label")), "labels", labels)
        labels = after
        if not after.where("old <> label").limit(1).count():
            return after.select("node", "label")


def _full_sets(nodes: DataFrame, docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(uid, found): shingle hashes of the texts of nodes (uid), as bytes."""
    needed = stored(nodes.join(signed.select("uid", "key", "th1", "th2"), "uid"), "needed")
    # A bitmap of fixed size drops most other texts before the shuffle; the join that follows is exact.
    slot = lambda: F.pmod(F.col("th1"), F.lit(_BITMAP))
    bits = needed.select(slot().alias("s")).groupBy(F.floor(F.col("s") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    some = docs.withColumn("s", slot()).join(F.broadcast(bits), F.floor(F.col("s") / 64) == F.col("word"))  # at most _BITMAP / 64 rows
    some = some.where(F.expr("(shiftrightunsigned(bits, cast(s % 64 as int)) & 1) = 1")).select("key", "text", "th1", "th2")
    own = some.alias("d").join(needed.alias("w"), F.expr("d.th1 = w.th1 AND d.th2 = w.th2 AND d.key <=> w.key")).select("w.uid", "d.text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["uid", "found"])

    return stored(own.mapInArrow(sets, "uid long, found binary"), "sets", needed)


def _is_link(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those that are links, worked out on the full sets of the two texts."""
    nodes = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    full = _full_sets(nodes, docs, signed)
    left, right = full.select(F.col("uid").alias("a"), F.col("found").alias("fa")), full.select(F.col("uid").alias("b"), F.col("found").alias("fb"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_is_link(*(np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "fa", "fb").mapInArrow(links, "a long, b long").distinct(), "links", full)


def _likely(pairs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) with their estimate, where sizes and estimate allow a link."""
    a = nodes.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = nodes.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    near = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return near.select("a", "b", similarity(F.col("sa"), F.col("sb"), plan.hashes).alias("estimate")).where(F.col("estimate") >= plan.least_estimate)


def _crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, estimate) whose ends have different labels la and lb; a node without one is its own."""
    la, lb = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    named = pairs.select("a", "b", "estimate").join(la, "a", "left").join(lb, "b", "left")
    return named.withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).where("la <> lb")


def _across_small(members: DataFrame, plan: Plan) -> DataFrame:
    """(a, b) of all likely pairs of different components in buckets up to SMALL_BUCKET, from members (bucket, uid,
    label, size, n, sig)."""
    small = members.where(F.col("size") <= SMALL_BUCKET)
    x, y = small.alias("x"), small.alias("y")
    sizes = 100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") < F.col("y.label")) & sizes)
    likely = pairs.where(similarity(F.col("x.sig"), F.col("y.sig"), plan.hashes) >= plan.least_estimate)
    return likely.select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b")).distinct()


def _dealt(marked: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of marked (bucket, band, uid, label, main, n) in blocks: those outside their bucket's main component (side
    0) meet all its rows (side 1), a block of the ones with a block of the others in each group (bucket, p, q)."""
    minor = F.col("label") != F.col("main")
    blocks = lambda rows, sizes: F.greatest(F.ceil(rows / F.lit(BLOCK)), F.ceil(sizes * 8 / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")
    totals = marked.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), blocks(F.count_if(minor), F.coalesce(F.sum(F.when(minor, F.col("n"))), F.lit(0))).alias("ps"), blocks(F.count(F.lit(1)), F.sum("n")).alias("qs")
    )
    every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    some = lambda k, of: F.pmod(F.xxhash64("uid", F.lit(k)), of).cast("int")
    known = join_counted(marked, totals, "bucket", "rows", marked.count(), "inner")
    left = known.where(minor).withColumns({"p": some(1, F.col("ps")), "side": F.lit(0)}).withColumn("q", every(F.col("qs")))
    right = known.withColumns({"q": some(2, F.col("qs")), "side": F.lit(1)}).withColumn("p", every(F.col("ps")))
    return left.unionByName(right).select("bucket", "band", "p", "q", "side", "uid", "label").join(facts, "uid")


def _likely_in_block(t: pa.Table, plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of side 0 that has any: its place, and places and estimates of those rows of side 1 in other
    components that may be linked with it and share no earlier bucket."""
    get = lambda c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
    matrix = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    label, n, side, band = (get(c) for c in ("label", "n", "side", "band"))
    sig, bands = matrix("sig").view(np.uint64), matrix("bands")
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        j = right[label[right] != label[i]]
        j = j[100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])]
        d = sig[j] ^ sig[i]
        d |= d >> _U(1)
        d |= d >> _U(2)
        unlike = np.bitwise_count(d & _U(0x1111111111111111)).sum(axis=1)
        est = (1 - unlike / plan.hashes - 1 / 2**BITS) / (1 - 1 / 2**BITS)
        ok = est >= plan.least_estimate
        j, est = j[ok], est[ok]
        first = (bands[j] == bands[i]).argmax(axis=1) == band[i]
        if first.any():
            yield int(i), j[first], est[first]


def _links_of_large(members: DataFrame, docs: DataFrame, signed: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between different components in buckets over SMALL_BUCKET: enough of them to join whatever is linked.

    Members outside a bucket's largest component meet all members, in pairs of blocks; a pair is looked at in the
    first bucket that it shares. Blocks of packed bits tell which texts have a likely partner at all; only those
    are dealt out again, with their full sets, and compared unless links found before in the task have joined
    their components. So a task gives fewer links than it has members.
    """
    large = members.where(F.col("size") > SMALL_BUCKET).select("bucket", "band", "uid", "label", "size")
    by_label = large.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    main = by_label.groupBy("bucket").agg(F.max_by("label", "k").alias("main"), F.sum("k").alias("rows"))
    marked = join_counted(large, main, "bucket", "rows", large.count(), "inner").drop("rows", "size")
    marked = stored(marked.join(nodes.select("uid", "n"), "uid"), "large")
    if not marked.limit(1).count():
        return marked.select(F.col("uid").alias("a"), F.col("uid").alias("b")).limit(0)

    def likely(t: pa.Table) -> pa.Table:
        uid, bucket = (t[c].combine_chunks().to_numpy() for c in ("uid", "bucket"))
        hit = np.zeros(t.num_rows, bool)
        for i, j, _ in _likely_in_block(t, plan):
            hit[i] = True
            hit[j] = True
        return pa.table({"at": pa.array(bucket[hit]), "of": pa.array(uid[hit])})

    light = _dealt(marked, nodes.select("uid", "n", "sig", "bands"))
    hits = light.groupBy("bucket", "p", "q").applyInArrow(likely, "at long, of long").distinct()
    left = stored(marked.join(hits, (F.col("bucket") == F.col("at")) & (F.col("uid") == F.col("of")), "left_semi"), "hits", marked)
    found = _full_sets(left.select("uid").distinct(), docs, signed)

    def compare(t: pa.Table) -> pa.Table:
        uid, label = (t[c].combine_chunks().to_numpy() for c in ("uid", "label"))
        sets = t["found"].combine_chunks()
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out: list[tuple[int, int]] = []
        for i, j, est in _likely_in_block(t, plan):
            x = np.frombuffer(sets[i].as_buffer(), np.uint64)
            for k in j[np.argsort(-est, kind="stable")]:
                a, b = find(int(label[i])), find(int(label[k]))
                if a != b and _is_link(x, np.frombuffer(sets[int(k)].as_buffer(), np.uint64)):
                    parent[max(a, b)] = min(a, b)
                    out.append((int(uid[i]), int(uid[k])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    full = _dealt(left, nodes.select("uid", "n", "sig", "bands").join(found, "uid"))
    return stored(full.groupBy("bucket", "p", "q").applyInArrow(compare, "a long, b long").distinct(), "links", found, left)


def _labelled(docs: DataFrame, key: str, text: str, plan: Plan) -> DataFrame:
    """(key, th1, th2, n, set_hash, first) for each row of docs: two hashes of its text and the first row (no, key, th1,
    th2) of its component, in order of keys with nulls last; null for a row without shingles."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    own = own.withColumns({"th1": F.xxhash64("text"), "th2": F.xxhash64(F.lit(1), "text")})
    kind = docs.schema[key].dataType.simpleString()
    signed = own.select("key", "text", "th1", "th2").mapInArrow(_signer(plan), f"key {kind}, th1 long, th2 long, n long, set_hash binary, bands array<long>, sig array<long>")
    signed = stored(signed.withColumn("uid", F.monotonically_increasing_id()), "signed")
    row = F.struct(F.col("key").isNull().alias("no"), "key", "th1", "th2")
    classes = stored(signed.where("n > 0").groupBy("set_hash").agg(F.min("uid").alias("rep"), F.min(row).alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
    nodes = stored(signed.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi").select("uid", "n", "sig", "bands"), "nodes")

    # Bucket: a band's number and hash. Only buckets of several texts matter.
    buckets = nodes.select("uid", F.posexplode("bands").alias("band", "hash")).select("uid", "band", F.xxhash64("band", "hash").alias("bucket"))
    # Its centre is any of them, another one in each bucket, so that a text meets many of its like.
    mask = F.col("bucket").bitwiseAND(F.lit((1 << 62) - 1))
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("uid").bitwiseXOR(mask)).alias("low")).where("size > 1")
    full = stored(full, "full")
    met = join_counted(buckets, full, "bucket", "size", nodes.count() * plan.bands, "inner")
    members = stored(met.select("bucket", "band", "uid", "size", F.col("low").bitwiseXOR(mask).alias("centre")), "members")
    stars = members.where("uid <> centre").select(F.least("centre", "uid").alias("a"), F.greatest("centre", "uid").alias("b")).distinct()
    likely = stored(_likely(stars, nodes, plan), "likely")
    likeliest = W.partitionBy("b").orderBy(F.desc("estimate"), "a")
    tested = stored(likely.withColumn("r", F.row_number().over(likeliest)).where("r = 1").select("a", "b"), "tested")
    links = _confirmed(tested, own, signed)
    labels = components(links)
    again = _crossing(likely.join(tested, ["a", "b"], "left_anti"), labels).withColumn("r", F.row_number().over(likeliest)).where("r <= 4")
    more = stored(again.select("a", "b"), "more", likely)
    links = stored(links.unionByName(_confirmed(more, own, signed)), "links", links)
    labels = components(links)
    tested = tested.unionByName(more)

    # What is left: buckets that still hold several components.
    of = members.join(labels, F.col("uid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "uid")).select("bucket", "band", "uid", "size", "label")
    several = of.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("several"), F.count(F.lit(1)).alias("rows")).where("several").drop("several")
    mixed = stored(join_counted(of, several, "bucket", "rows", members.count(), "inner").drop("rows"), "mixed", members)
    waiting = stored(_across_small(mixed.join(nodes.select("uid", "n", "sig"), "uid"), plan).join(tested, ["a", "b"], "left_anti"), "waiting")
    new = _confirmed(waiting, own, signed).unionByName(_links_of_large(mixed, own, signed, nodes, plan))
    if new.limit(1).count():
        labels = components(links.unionByName(new))

    named = classes.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep"))
    lowest = named.groupBy("label").agg(F.min("least").alias("first"))
    of = stored(named.join(lowest, "label").select("set_hash", "rows", "first"), "components", classes, nodes, mixed)
    return join_counted(signed.select("key", "th1", "th2", "n", "set_hash"), of, "set_hash", "rows", signed.count()).drop("rows")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """A row for each row of docs: (key, n_shingles, component_id, kept).

    component_id: the smallest key that is reachable over links; kept: the row's key is that key. Links hold
    between texts of which 100 * intersection >= 75 * union of the shingle sets. Null and empty texts, and
    texts of white space, have no shingle and no link. Null keys come after all others: a row without a key
    gets its component's id, null if that has none. Rows that repeat are linked with each other. Other
    columns of docs play no part. An empty table gives no rows.
    """
    joined = _labelled(docs, key, text, plan)
    component = F.when(F.col("set_hash").isNull(), F.col("key")).otherwise(F.col("first.key"))
    return joined.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One row of each component of docs: that of the smallest key (nulls last), of several the one whose text has the
    smallest hash. Rows without shingles are their own components; of rows equal in key and text one stays."""
    rows = stored(_labelled(docs, key, text, plan).select("key", "th1", "th2", "first"), "rows")
    here = F.struct(F.col("key").isNull().alias("no"), "key", "th1", "th2")
    gone = rows.where(F.col("first").isNotNull() & ~here.eqNullSafe(F.col("first"))).select("key", "th1", "th2").distinct()
    own = F.coalesce(F.col(f"d.`{text}`"), F.lit("")).cast("binary")
    same = F.col(f"d.`{key}`").eqNullSafe(F.col("g.key")) & (F.xxhash64(own) == F.col("g.th1")) & (F.xxhash64(F.lit(1), own) == F.col("g.th2"))
    left = docs.alias("d").join(gone.alias("g"), same, "left_anti")
    repeats = rows.groupBy("key", "th1", "th2").count().where("count > 1").limit(1).count()
    return left.dropDuplicates([key, text]) if repeats else left
