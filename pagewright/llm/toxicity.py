"""Toxicity by logistic regression over hashed word n-grams and skip-grams, fitted with FTRL-proximal.

Features of a text (all of it): which words, pairs of neighbours and pairs with one word between occur,
lower-cased, each hashed to one of 2**BITS places. FTRL-proximal learns with a rate for each coordinate,
and its L1 term keeps all but a few thousand weights at exactly zero, so the model is a short list of
places and weights that goes to every task. A text is as toxic as the most toxic of its overlapping
windows, so that a score depends on what a text says and not on how many grams it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, hold, release, stored

BITS = 32
#: Words of a window; the next one starts half of it later. A text of up to so many words is one window.
WINDOW = 512
#: Labelled rows to learn from, at most (about; a hash of doc_id selects them). Documents to score have no bound.
TRAIN_ROWS = 18_000
#: Distinct grams of those rows, counted row by row, at most (in order of a hash, whole rows): what the driver holds is
#: at most four bytes of each. Grams of fewer rows than LEAST_ROWS keep the weight zero.
TRAIN_GRAMS, LEAST_ROWS = 24_000_000, 3
THRESHOLD = 0.3
_U = np.uint64


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_WORDS = _Words()


def _hold() -> None:
    hold("toxicity", _WORDS.clear)


def features(text: str | None) -> np.ndarray:
    """Places of all grams of a text, with repeats."""
    words = (text or "").lower().split()
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    pairs = w[:-1] * _U(0x9E3779B97F4A7C15) + w[1:] * _U(0xC2B2AE3D27D4EB4F) + _U(1)
    skips = w[:-2] * _U(0xD6E8FEB86659FD93) + w[2:] * _U(0xA0761D6478BD642F) + _U(2)
    x = np.concatenate([w, pairs, skips])
    x ^= x >> _U(31)
    x *= _U(0xFF51AFD7ED558CCD)
    return (x >> _U(64 - BITS)).astype(np.uint32)


@dataclass(frozen=True)
class Model:
    """Weights that aren't zero, in ascending order of places. A model that saw no example scores 0."""

    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf


def fit(known: np.ndarray, examples: list[tuple[np.ndarray, int]], alpha: float = 0.5, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 3, positive: float = 2.0) -> Model:
    """FTRL-proximal over (numbers of distinct places in `known`, label 0 or 1) in the order given; an example of label
    1 counts `positive` times."""
    if not examples:
        return Model()
    z, n = np.zeros(len(known)), np.zeros(len(known))
    bz = bn = 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for f, y in examples:
            zf, nf = z[f], n[f]
            w, bw = weights(zf, nf), -bz * alpha / (beta + np.sqrt(bn))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bw, -35, 35)))
            g = (p - y) * (positive if y else 1.0)
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha * w
            n[f] = nf + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * bw
            bn += g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return Model(known[at], w[at], float(-bz * alpha / (beta + np.sqrt(bn))))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, grams: int = TRAIN_GRAMS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from at most about `rows` labelled documents that aren't held out, chosen by a hash of the key, of at most
    `grams` distinct grams in all.

    Labels other than 0 and 1 and null keys don't count; of labels that repeat for a key the largest does. Texts are
    learnt from as a whole. Only numbers of grams that LEAST_ROWS rows have come to the driver, which gives their memory
    back once it has learnt.
    """
    model = _learnt(docs, labels, rows, grams, key, text, label)
    release()
    return model


def _learnt(docs: DataFrame, labels: DataFrame, rows: int, grams: int, key: str, text: str, label: str) -> Model:
    bounded_batches(docs.sparkSession)
    own = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, rows / max(1, own.count()))
    chosen = own.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold()
        for b in batches:
            for k, y, t in zip(*(b.column(c) for c in range(3)), strict=True):
                found = np.unique(features(t.as_py()))
                rank = [xxhash.xxh3_64_intdigest(x) >> 1 for x in (str(k.as_py()), found.tobytes())]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*rank, len(found))), pa.array([y.as_py()], pa.int32()), pa.array([found.view(np.int32)], pa.list_(pa.int32()))], ["rank", "tie", "n", "y", "found"])

    table = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("key", "y", "text")  # chosen: bounded by rows
    found = stored(table.mapInArrow(grams_of, "rank long, tie long, n long, y int, found array<int>"), "grams")
    order = sorted(map(tuple, found.select("rank", "tie", "n").collect()))  # bounded by rows: three numbers each
    upto = np.cumsum([n for _, _, n in order])
    last = next((order[i - 1][:2] if i else (-1, -1) for i in np.flatnonzero(upto > grams)[:1]), None)
    if last:
        found = found.where((F.col("rank") < last[0]) | ((F.col("rank") == last[0]) & (F.col("tie") <= last[1])))
    often = found.select(F.explode("found").alias("place")).groupBy("place").count().where(F.col("count") >= LEAST_ROWS)
    known = np.sort(often.select("place").toArrow()["place"].to_numpy().view(np.uint32))  # at most grams / LEAST_ROWS

    def numbers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = []
            for x in b.column(3):
                f = x.values.to_numpy().view(np.uint32)
                at = np.searchsorted(known, f)
                numbers.append(at[known.take(at, mode="clip") == f].astype(np.int32).tobytes() if len(known) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(numbers, pa.binary())], ["rank", "tie", "y", "numbers"])

    got = found.select("rank", "tie", "y", "found").mapInArrow(numbers_of, "rank long, tie long, y int, numbers binary").toArrow()
    rank = np.lexsort((got["tie"].to_numpy(), got["rank"].to_numpy()))
    return fit(known, [(np.frombuffer(got["numbers"][int(i)].as_buffer(), np.int32), got["y"][int(i)].as_py()) for i in rank])


def logit(text: str | None, model: Model, some: np.ndarray) -> float:
    """The bias and the weights of the distinct grams of a window, for the window where that is most. `some`: which
    upper halves of 32 bits begin a place of the model."""
    x = features(text)
    hits = np.flatnonzero(some[x >> np.uint32(BITS - 16)])
    at = np.searchsorted(model.places, x[hits])
    real = model.places.take(at, mode="clip") == x[hits] if len(hits) else np.zeros(0, bool)
    hits, at = hits[real], at[real]
    n = len((text or "").split()) if len(x) > 3 * WINDOW - 3 else 0
    if n <= WINDOW:
        return float(model.weights[np.unique(at)].sum() + model.bias)
    span = 1 + (hits >= n) + (hits >= 2 * n - 1)  # words, then pairs, then pairs with one between
    start = hits - np.choose(span - 1, [0, n, 2 * n - 1])
    order = np.argsort(start, kind="stable")
    start, stop, at = start[order], (start + span)[order], at[order]
    most = -np.inf
    for a in range(0, n - WINDOW // 2, WINDOW // 2):
        here = slice(*np.searchsorted(start, (a, a + WINDOW)))
        most = max(most, model.weights[np.unique(at[here][stop[here] <= a + WINDOW])].sum())
    return float(most + model.bias)


def score(docs: DataFrame, model: Model, text: str = "text", score_column: str = "score") -> DataFrame:
    """docs with the score of each text, the highest of its windows over all of it (0 to 1; null and empty texts: the model's bias alone).

    Every row gets its score, repeats too. The score column goes last; a column of docs by that name is
    replaced. An empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    name = free_name(docs, "toxicity_score")

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        _hold()
        some = np.zeros(1 << 16, bool)
        some[model.places >> np.uint32(BITS - 16)] = True
        out = np.array([logit(t, model, some) for t in texts], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -700, 700))))

    keep = [c for c in docs.columns if c.lower() != score_column.lower()]
    return docs.withColumn(name, scored(F.col(f"`{text}`"))).select(*(F.col(f"`{c}`") for c in keep), F.col(name).alias(score_column))
