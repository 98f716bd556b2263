"""Mixing sources to target weights by entropy balancing.

Every document is tilted by exp(lambda_source + mu . z), where z says which values it has of some margins (its
language, say; none by default). The multipliers are the optimum of the convex dual
sum(size * exp(lambda + mu . z)) - sum(target * lambda) - goal . mu, with a token constraint for each source and,
softly, for each margin value. Newton iterations find it: each is one distributed aggregate over cells of documents
(of one source and the same margins), which gives gradient and Hessian source by source. The Hessian is an arrow: its
source block is diagonal and stays in the table of sources, and only the Schur complement, of the margins' size, goes
to the driver. The tilt is a rate of copies for each document, rounded systematically along the documents of a source
in order of size, so that rounding errors cancel between neighbours; the shortest documents make up for what remains.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, free_name, ordered, stored

#: Weights that sources take in turn, in code point order.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's target is at most so many times its size.
MOST = 3.0
#: Newton iterations at most: about ten serve targets between a thousandth and three times the size, as each can lower
#: a rate by a factor of e. They end when no source is off its target by more than this share of it.
STEPS, CLOSE, NEAR = 64, 1e-13, 0.01
#: Values of all margins at most; their sums go to the driver. Weight of the squared multipliers of margins.
MARGINS, RIDGE = 64, 1e-4
#: Rates are rounded to so many parts of a copy, and summed as whole numbers.
_UNIT = 1 << 24


def words(text):
    """Number of [^\\x20\\x09-\\x0D]+ in a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order, null last, take the weights in turn and share all sizes by them. A
    target stops at `most` times its source's size; the excess goes to the others by weight, until none is
    above. A source without words has the target 0.
    """
    totals = stored(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ordered(totals, ["source"]).select("source", "source_size", turn.alias("weight"), (F.col("source_size") * most).alias("top")), "ranked")
    level = None  # words for a unit of weight: targets are least(top, level * weight)
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    while True:
        stopped = F.lit(False) if level is None else F.col("top") <= F.col("weight") * level
        row = ranked.agg(F.sum(F.when(~stopped, F.col("weight"))), F.sum(F.when(stopped, F.col("top")))).first()
        new = (whole - (row[1] or 0.0)) / row[0] if row[0] else level
        if new == level or not row[0]:
            break
        level = new
    target = F.least(F.col("top"), F.col("weight") * F.lit(float(level or 0.0)))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def solve(cells: DataFrame, targets: DataFrame, goals: np.ndarray, most: float = MOST) -> DataFrame:
    """cells (source, z array<double>, size, ...) with the rate of each, by Newton iterations on the dual.

    targets: (source, target). goals: words that the mix is to have of each component of z. A rate stops at `most`: such
    cells count for the gradient alone. Cells without words and sources without a target have the rate 0.
    """
    m = len(goals)
    state = stored(targets.where("target > 0").select(F.col("source").alias("of"), "target", F.lit(0.0).alias("lam")), "multipliers")
    mu, part, last = np.zeros(m), 1.0, np.inf
    ridge = RIDGE * max(1.0, float(goals.sum()))

    def tilted() -> DataFrame:
        tilt = F.exp(sum((F.get("z", F.lit(j)) * float(mu[j]) for j in range(m)), F.col("lam")))
        return cells.where("size > 0").join(state, F.expr("source <=> of")).withColumn("rate", F.least(tilt, F.lit(float(most)))).withColumn("free", tilt < most)

    z = lambda j: F.get("z", F.lit(j))
    places = [(j, k) for j in range(m) for k in range(j, m)]
    for _ in range(STEPS):
        w = F.col("size") * F.col("rate")
        h = F.when(F.col("free"), w).otherwise(0.0)
        sums = [F.sum(w).alias("s"), F.sum(h).alias("h")]
        sums += [x for j in range(m) for x in (F.sum(w * z(j)).alias(f"g{j}"), F.sum(h * z(j)).alias(f"b{j}"))] + [F.sum(h * z(j) * z(k)).alias(f"c{j}_{k}") for j, k in places]
        per = stored(tilted().groupBy("of", "target", "lam").agg(*sums), "newton")
        # One row: how far the worst source is off, and the margins' gradient and Schur complement.
        gap = F.col("target") - F.col("s")
        share = lambda x: F.sum(F.when(F.col("h") > 0, x).otherwise(0.0))
        row = per.agg(
            F.max(F.abs(gap) / F.col("target")).alias("off"),
            *(F.sum(f"g{j}").alias(f"g{j}") for j in range(m)), *(share(F.col(f"b{j}") * gap / F.col("h")).alias(f"r{j}") for j in range(m)),
            *((F.sum(f"c{j}_{k}") - share(F.col(f"b{j}") * F.col(f"b{k}") / F.col("h"))).alias(f"c{j}_{k}") for j, k in places),
        ).first()
        if row["off"] is None:
            break
        # Margins move only once the sources are near their targets, and by less after a step that made things worse.
        step, miss = np.zeros(m), np.array([goals[j] - row[f"g{j}"] for j in range(m)]) - ridge * mu
        far = np.abs(miss).max(initial=0)
        if m and row["off"] <= NEAR:
            schur = np.zeros((m, m))
            for j, k in places:
                schur[j, k] = schur[k, j] = row[f"c{j}_{k}"] or 0.0
            part, last = (max(part / 2, 1 / 64) if far > last else min(1.0, 2 * part)), far
            step = part * np.clip(np.linalg.solve(schur + ridge * np.eye(m), miss - [row[f"r{j}"] for j in range(m)]), -1.0, 1.0)
        if row["off"] <= CLOSE and far <= 1e-9 * goals.sum():
            break
        move = (gap - sum((F.col(f"b{j}") * float(step[j]) for j in range(m)), F.lit(0.0))) / F.col("h")
        move = F.when(F.col("h") > 0, F.greatest(F.lit(-1.0), F.least(move, F.lit(2.0)))).when(gap < 0, -0.5).otherwise(0.0)
        state = stored(per.select("of", "target", (F.col("lam") + move).alias("lam")), "multipliers", state)
        forget(per)
        mu = mu + step
    rates = tilted().select(F.struct("source", "z").alias("cell"), "rate")
    own = cells.alias("c").join(rates.alias("r"), F.struct("c.source", "c.z").eqNullSafe(F.col("r.cell")), "left")
    return own.select("c.*", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def entropy_balance(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, most: float = MOST, margins: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: (key, source, size, source_size, target, rate, copies).

    copies is the number of times (0 to ceil(most)) that the mix takes the document. margins: columns whose values,
    MARGINS of them at most, are to keep their shares of all words as far as the sources' targets allow. Null text: no
    words. Null source: a source of its own, last in order; a null margin is a value. Rows that repeat count as often
    as they occur. Within a source ties of size are ordered by key and by a hash of the text; full ties may swap their
    copies, which leaves the result the same. An empty table gives an empty result.
    """
    marked = F.array(*(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in margins)).cast("array<string>")
    light = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("tie"), marked.alias("marks")), "sizes")
    targets = stored(source_targets(light.select("source", "size"), weights, most), "targets")
    sums = stored(light.groupBy("source", "marks").agg(F.sum("size").alias("size")), "cells")
    values = sums.select(F.posexplode("marks").alias("place", "value"), "size").groupBy("place", "value").agg(F.sum("size").alias("n")).orderBy("place", "value").limit(MARGINS + 1).collect() if margins else []
    if len(values) > MARGINS:
        raise ValueError(f"margins have more than {MARGINS} values")
    z = F.array(*(F.when(F.get("marks", F.lit(v["place"])) == v["value"], 1.0).otherwise(0.0) for v in values)).cast("array<double>")
    whole = targets.agg(F.sum("target"), F.sum("source_size")).first()
    share = (whole[0] or 0.0) / (whole[1] or 1)
    rates = stored(solve(sums.withColumn("z", z), targets, np.array([v["n"] * share for v in values]), most), "rates")
    of = rates.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source")).select(F.struct("r.source", "r.marks").alias("cell"), "t.source_size", "t.target", "r.rate")
    known = light.withColumn("cell", F.struct("source", "marks")).alias("d").join(of.alias("t"), F.expr("d.cell <=> t.cell"))
    known = known.select("d.key", "d.source", "d.size", "d.tie", "source_size", "target", "rate", F.round(F.col("rate") * _UNIT).cast("long").alias("units"))
    order = ["source", "size", "key", "tie"]
    ranked = ordered(known, order, {"before": "units"})
    starts = ordered(known.groupBy("source").agg(F.sum("units").alias("n")), ["source"], {"start": "n"})
    at = F.col("before") - F.col("start")
    upto = lambda n: F.floor(n / _UNIT + 0.5)
    least = F.floor(F.col("units") / _UNIT).cast("int")
    dealt = stored(
        ranked.alias("d").join(starts.select(F.col("source").alias("of"), "start"), F.expr("d.source <=> of"))
        .select("key", "source", "tie", "size", "source_size", "target", "rate", "units", (upto(at + F.col("units")) - upto(at)).cast("int").alias("copies"))
        .withColumn("up", F.when(F.col("copies") > least, F.col("size")).otherwise(F.lit(0)))
        .withColumn("down", F.when((F.col("copies") <= least) & (F.col("units") > least * _UNIT), F.col("size")).otherwise(F.lit(0))),
        "dealt",
    )
    # What is over or under a source's target is made up by its shortest documents that went the other way.
    summed = ordered(dealt, order, {"up_before": "up", "down_before": "down"})
    over = dealt.groupBy("source").agg((F.sum(F.col("size") * F.col("copies")) - F.max("target")).alias("over"))
    first = summed.groupBy("source").agg(F.min("up_before").alias("up_first"), F.min("down_before").alias("down_first"))
    fix = over.alias("o").join(first.alias("f"), F.expr("o.source <=> f.source")).select("o.*", "up_first", "down_first")
    less = (F.col("up") > 0) & (F.col("up_before") - F.col("up_first") + F.col("up") <= F.col("over"))
    more = (F.col("down") > 0) & (F.col("down_before") - F.col("down_first") + F.col("down") <= -F.col("over"))
    return summed.alias("d").join(fix.alias("x"), F.expr("d.source <=> x.source")).select(
        F.col("d.key").alias(key), F.col("d.source").alias("source"), "size", "source_size", "target", "rate",
        (F.col("copies") - less.cast("int") + more.cast("int")).alias("copies"),
    )


def apply_mix(docs: DataFrame, mix: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with each document as often as its copies say (none for 0).

    Rows are told apart by key, source and size; rows equal in all of these are dealt the copies of all of them, so a
    source's words come near its target whatever keys repeat. `mix` and `docs` agree in number.
    """
    n, r, at = free_name(docs, "mix_copies"), free_name(docs, "mix_rows"), free_name(docs, "mix_row")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{source}`"), words(F.col(f"`{text}`")))
    per = mix.groupBy(F.xxhash64(F.col(key), F.col("source"), F.col("size")).alias("mixed")).agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("rows"))
    per = stored(per, "copies")
    joined = docs.withColumn(at, row).alias("d").join(per.select("mixed", F.col("copies").alias(n), F.col("rows").alias(r)).alias("m"), F.col(f"d.{at}") == F.col("m.mixed")).select("d.*", n, r)
    repeat = lambda df, times: df.withColumn(n, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*columns)
    single = repeat(joined.where(F.col(r) == 1), F.col(n))
    if not per.where("rows > 1").limit(1).count():
        return single
    # Rows alike are numbered on hashes alone; each takes its part of their copies.
    number = free_name(joined, "mix_number")
    shared = joined.where(F.col(r) > 1).withColumn(number, F.row_number().over(W.partitionBy(at).orderBy(F.xxhash64(*columns))))
    upto = lambda k: F.floor(k * F.col(n) / F.col(r))
    return single.unionByName(repeat(shared, upto(F.col(number)) - upto(F.col(number) - 1)))
