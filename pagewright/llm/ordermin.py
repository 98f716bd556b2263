"""Document fingerprints by Order MinHash, in DataFrame functions alone.

A text's k-mers are numbered by occurrence, so that repeats count, and hashed. The hash range is cut into
BUCKETS parts; of each part the two smallest k-mers are selected, put back into the order they have in the
text, and hashed as a tuple. Texts that share words but not their order share few tuples, so the share of
equal tuples goes with edit distance. One hash of each k-mer serves all buckets: a bucket selects the two smallest
from its own start on, around the end of the range where need be, so that short texts, whose buckets are mostly
empty, have a tuple of two in each bucket, too, and keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, ordered, stored

BUCKETS_LOG2 = 6
#: Words of a k-mer.
K = 2
#: Bits of a k-mer's hash and of its place. Places of 30 bits hold the words of any Spark string.
_HASH, _PLACE = 33, 30
_HASH_MASK, _PLACE_MASK = (1 << _HASH) - 1, (1 << _PLACE) - 1
#: Scripts without blanks between words: each of their characters is a word.
_SINGLE = "[\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\uF900-\\uFAFF\\x{20000}-\\x{3FFFF}]"
#: A word goes on character by character after so many, so that a run without blanks is more than one k-mer.
LONG = 40
_SPACE = r"\x20\x09-\x0D"
_LATER = f"(?<=[^{_SPACE}]{{{LONG}}})(?=[^{_SPACE}])"


def _shift(x: Column, n: int) -> Column:
    return F.shiftright(x, n)


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`: array<int>, one number for each bucket: bucket and 24 bits of its tuple's hash. Null and empty
    texts: an empty array. A text with fewer words than K is one k-mer, and its tuples have one.

    Each step is a column of its own, so that sorts of longs run in generated code.
    """
    w, s, g = (free_name(df, f"{name}_{x}") for x in "wsg")
    plain = F.coalesce(F.col(text), F.lit(""))
    cut = F.regexp_replace(F.regexp_replace(plain, f"({_SINGLE})", " $1 "), _LATER, " ")
    spaced = F.when(plain.rlike(f"{_SINGLE}|[^{_SPACE}]{{{LONG + 1}}}"), cut).otherwise(plain)
    words = F.filter(F.split(spaced, f"[{_SPACE}]+"), lambda x: x != "")
    df = df.withColumn(w, words)

    place = lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(_HASH_MASK)), _PLACE).bitwiseOR(i.cast("long"))
    mers = F.transform(F.slice(F.col(w), 1, F.greatest(F.lit(0), F.size(w) - (K - 1))), lambda x, i: place(F.xxhash64(x, *(F.get(F.col(w), i + j) for j in range(1, K))), i))
    few = F.when(F.size(w) > 0, F.array(place(F.xxhash64(F.array_join(F.col(w), " ")), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(s, F.sort_array(F.when(F.size(w) >= K, mers).otherwise(few))).drop(w)

    # Equal k-mers now stand together in text order; a k-mer's number is how far back its like reach. Number 0 keeps the
    # k-mer's own hash, so most of the order stays.
    def numbered(x: Column, j: Column) -> Column:
        same = lambda back: (j >= back) & (_shift(F.get(F.col(s), (j - back).cast("int")), _PLACE) == _shift(x, _PLACE))
        bits = F.sequence(F.floor(F.log2(j + 1)).cast("int"), F.lit(0), F.lit(-1))
        far = F.aggregate(bits, F.lit(0), lambda acc, b: F.when(same(acc + F.pow(F.lit(2), b).cast("int")), acc + F.pow(F.lit(2), b).cast("int")).otherwise(acc))
        number = F.when(~same(F.lit(2)), 1).when(~same(F.lit(3)), 2).when(~same(F.lit(4)), 3).otherwise(far)
        return F.when(~same(F.lit(1)), x).otherwise(place(F.xxhash64(_shift(x, _PLACE), number), x.bitwiseAND(F.lit(_PLACE_MASK))))

    df = df.withColumn(g, F.sort_array(F.transform(F.col(s), numbered))).drop(s)

    n = F.size(g)
    steps = F.transform(F.sequence(F.floor(F.log2(n)).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2), b).cast("int"))

    def entry(bucket: Column) -> Column:
        # How many k-mers lie before the bucket, by halves.
        low = F.shiftleft(bucket.cast("long"), _HASH + _PLACE - BUCKETS_LOG2)
        before = F.aggregate(steps, F.lit(0), lambda acc, step: F.when(F.get(F.col(g), acc + step - 1) < low, acc + step).otherwise(acc))
        return let(F.struct(*(F.get(F.col(g), F.pmod(before + k, n)).alias(f"x{k}") for k in (0, 1))), lambda p: one(bucket, p["x0"], p["x1"]))

    def one(bucket: Column, x: Column, y: Column) -> Column:
        a, b = _shift(x, _PLACE), _shift(y, _PLACE)
        earlier = x.bitwiseAND(F.lit(_PLACE_MASK)) < y.bitwiseAND(F.lit(_PLACE_MASK))
        hashed = F.when(n == 1, F.xxhash64(a)).when(earlier, F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
        return F.shiftleft(bucket, 24).bitwiseOR(hashed.bitwiseAND(F.lit((1 << 24) - 1)).cast("int"))

    every = F.transform(F.sequence(F.lit(0), F.lit((1 << BUCKETS_LOG2) - 1)), entry)
    return df.withColumn(name, F.when(n > 0, every).otherwise(F.array().cast("array<int>"))).drop(g)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: equal tuples among the buckets that either sketch has; 1 for two empty sketches."""
    buckets = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 24)), F.transform(b, lambda x: F.shiftright(x, 24))))
    return F.when(buckets == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / buckets)


def as_text(sketch: Column) -> Column:
    """Eight hexadecimal digits for each number of a sketch."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(rank, key, text, n, edited) and the number of rows: rows in ascending order of key, each with its
    number of code points and its edited text, whose last n div 4 code points give way to the first as many
    of the next row's text (all, if it has fewer; the last row is followed by the first).

    Null text is empty. Null keys come last; rows of one key go by a hash of their text, rows that repeat
    follow each other. Texts are known by two hashes of key and text, and move in one shuffle.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = F.xxhash64("key", "text").alias("ia"), F.xxhash64(F.lit(1), "key", "text").alias("ib")
    light = stored(own.select(*known, "key", F.char_length("text").alias("n")), "light")
    ranked = stored(ordered(light, ["key", "ia", "ib"]), "ranked")
    total = ranked.count()
    own = own.select(*known, "text")  # the same on both sides below, so one shuffle serves both
    if light.groupBy("ia", "ib").count().where("count > 1").limit(1).count():
        own = own.dropDuplicates(["ia", "ib"])
    before = ranked.select(F.pmod(F.col("rank") + 1, F.lit(max(1, total))).alias("rank"), F.col("ia").alias("pa"), F.col("ib").alias("pb"), F.floor(F.col("n") / 4).cast("int").alias("cut"), F.col("rank").alias("prank"), "key")
    giving = ranked.select("rank", "ia", "ib").join(before, "rank").select("ia", "ib", "pa", "pb", "prank", "cut", "key")
    given = own.join(giving, ["ia", "ib"]).select(F.col("pa").alias("ia"), F.col("pb").alias("ib"), F.col("prank").alias("rank"), "key", "cut", F.substring(F.col("text"), F.lit(1), F.col("cut")).alias("tail"))
    met = own.join(given, ["ia", "ib"])
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.col("cut")), F.col("tail"))
    return met.select("rank", "key", "text", n.cast("long").alias("n"), edited.alias("edited")), total


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    Equal texts have equal fingerprints; texts without a word have the empty one, which is like itself. In a
    table of one row the next row is the row itself. Other columns of docs play no part. An empty table
    gives no rows.
    """
    rows, total = with_next(docs, key, text)
    both = with_sketch(with_sketch(rows, "text", "own"), "edited", "other")
    sketched = stored(both.select("rank", "key", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "other"), "sketches")
    after = sketched.select(F.pmod(F.col("rank") - 1, F.lit(max(1, total))).alias("rank"), F.col("own").alias("next"))
    return sketched.join(after, "rank").select(
        F.col("key").alias(key), F.col("n").alias("n_chars"), "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
