"""Mixing sources to target weights by cube-method balanced sampling.

A source's target divided by its size is the number of times that each of its documents is expected to be taken: a
whole part, taken for certain, and a fraction. The fractions are rounded by the cube method. A flight moves three
fractions at a time along the null space of the two balancing equations (tokens and documents) until one of them is 0
or 1, so that both totals stay exactly as they were; it ends when two or fewer fractions are left, and the landing
rounds those to the choice nearest the totals.

Flights run in blocks of ``BLOCK`` documents of one source, in any number of tasks; what a block leaves over (two
documents at most) flies again with what others left, level by level, until a source fits one block. A source with a
third of all rows is thereby spread over as many blocks as it fills, and the landing of a source moves its total by
less than the size of its largest document.

Targets. Sources may be as many as rows: their totals are a table in the shared folder, numbered in order of their names by
a range sort, and the excess is reshared by passes over that table. A pass sums, for each weight, sources and sizes as whole
numbers, so targets are the same however the sums are taken; a pass stops at least one more source, or is the last. Rows
meet their source in a join that deals the rows of hot sources to several tasks (``common.hot_join``).

Defined results: null text has size 0; null is a source of its own, after all others; a source of size 0 has target 0
and none of its documents is taken; an empty table gives an empty result; other columns of the input are kept. Repeated
rows (of one source, doc_id and size) fly as one row that stands for what their whole number leaves, and the first of them
in that table take the copies; so the choice depends on the rows and ``seed`` alone, not on their order or place, but for which
of repeated rows is taken.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from . import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2.0
BLOCK = 4096
_EPS = 1e-9


def word_count(name: str = "text") -> Column:
    return F.regexp_count(common.text_or_empty(name), F.lit(rf"[^{common.SPACE}]+")).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """sources with no: their numbers from 0 by code point, null last. Only one number a partition reaches the driver."""
    order = F.asc_nulls_last("source")
    sorted_ = common.materialize(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id()), "mix-sorted")
    part, first, at = F.shiftright("place", 33), {}, 0
    for r in sorted(sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.part):
        first[r.part], at = at, at + r.n
    starts = sources.sparkSession.createDataFrame(list(first.items()), "part long, first long")
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("no", F.col("first") + inside).drop("part", "first", "place")


def share_out(sources: DataFrame, weights: Sequence[float], share: float, limit: float = LIMIT) -> DataFrame:
    """sources (no, source_size, ...) with target: share of all sizes by weight; a target stops at limit times its size,
    and the excess goes to the rest by weight. The k-th source has the weight k modulo their number."""
    kind = F.pmod("no", F.lit(len(weights))).cast("int")
    weight = F.array(*map(F.lit, map(float, weights)))[kind]
    exact, unit = [Fraction(w) for w in weights], None
    while True:
        full = F.lit(False) if unit is None else F.lit(unit) * weight > F.lit(float(limit)) * F.col("source_size")
        sums = sources.filter("source_size > 0").groupBy(kind.alias("kind"), full.alias("full")).agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("size")).collect()
        left = Fraction(share) * sum(r.size for r in sums) - Fraction(limit) * sum(r.size for r in sums if r.full)
        open_ = sum(exact[r.kind] * r.n for r in sums if not r.full)
        now = float(left / open_) if open_ else unit
        if now is None or now == unit or not open_:
            break
        unit = now
    of = F.least(F.lit(unit) * weight, F.lit(float(limit)) * F.col("source_size")) if unit is not None else F.lit(0.0)
    return sources.withColumn("target", F.when(F.col("source_size") > 0, of).otherwise(0.0))


def flight(p: list[float], sizes: list[float], rng: random.Random) -> list[int]:
    """Moves p in place, keeping sum(p) and sum(p * sizes); returns the places (two at most) still between 0 and 1."""
    held: list[int] = []
    for i in range(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            held.append(i)
        else:
            p[i] = float(round(p[i]))
        if len(held) < 3:
            continue
        a, b, c = held
        u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])  # (1, 1, 1) x (sizes): the null space
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[k]) / v if v > 0 else p[k] / -v) for k, v in zip(held, u) if v)
        down = min((p[k] / v if v > 0 else (1 - p[k]) / -v) for k, v in zip(held, u) if v)
        step = up if rng.random() * (up + down) < down else -down  # a martingale: the mean step is 0
        for k, v in zip(held, u):
            p[k] += step * v
            if not _EPS < p[k] < 1 - _EPS:
                p[k] = float(round(p[k]))
        held = [k for k in held if 0.0 < p[k] < 1.0]
    return held


def land(p: list[float], sizes: list[float], held: list[int]) -> None:
    """Rounds what the flight left to the choice whose token total, then document total, is nearest."""
    if not held:
        return
    want, docs = sum(p[k] * sizes[k] for k in held), sum(p[k] for k in held)
    choices = [[(m >> j) & 1 for j in range(len(held))] for m in range(1 << len(held))]
    best = min(choices, key=lambda c: (abs(sum(x * sizes[k] for x, k in zip(c, held)) - want), abs(sum(c) - docs), c))
    for k, x in zip(held, best):
        p[k] = float(x)


def _fly(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "size"], kind="stable", na_position="last")  # no two rows of a source have both
    key = f"{seed}/{pdf['source_no'].iat[0]}/{pdf['block'].iat[0]}/{pdf['level'].iat[0]}"
    rng = random.Random(hashlib.blake2b(key.encode(), digest_size=8).digest())
    order = list(range(len(pdf)))
    rng.shuffle(order)
    pdf = pdf.iloc[order]
    p, sizes = pdf["frac"].tolist(), pdf["size"].astype("float64").tolist()
    held = flight(p, sizes, rng)
    if pdf["last"].iat[0]:
        land(p, sizes, held)
    return pdf.assign(frac=p, level=pdf["level"] + 1)


def _round(rows: DataFrame, seed: int) -> DataFrame:
    return rows.groupBy("source_no", "block").applyInPandas(lambda pdf: _fly(pdf, seed), rows.schema)


def _deal(rows: DataFrame, counts: DataFrame, level: int) -> DataFrame:
    """Deals each source's open rows to ceil(count / BLOCK) blocks by a hash of the row."""
    met = common.hot_join(rows.drop("block", "last"), counts.withColumnRenamed("n", "open"), "source_no", counts, "uid")
    n = F.ceil(F.col("open") / F.lit(BLOCK)).cast("long")
    return met.withColumns({"block": F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), n), "last": n <= 1}).drop("open")


_ROW = ["source_no", "doc_id", "size"]


def _numbered_alike(rows: DataFrame, several: DataFrame) -> DataFrame:
    """(uid, source_no, doc_id, size, nth) of the rows that several has, numbered from 0 among those that are alike: in
    their partition of the scan first, then over partitions, so no task gathers more than a partition's rows."""
    same = [rows[c].eqNullSafe(several[c]) for c in _ROW]
    again = rows.join(several.hint("merge"), same, "left_semi").withColumn("part", F.shiftright("uid", 33))
    counts = again.groupBy(*_ROW, "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*_ROW).orderBy("part")) - F.col("n")).drop("n")
    place = again.withColumn("inside", F.row_number().over(Window.partitionBy(*_ROW, "part").orderBy("uid")) - 1)
    met = place.alias("p").join(before.alias("b").hint("merge"), [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*_ROW, "part"]])
    return met.select("p.uid", *(f"p.{c}" for c in _ROW), (F.col("inside") + F.col("before")).alias("nth"))


def mix(
    docs: DataFrame, source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 8
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, uid), one row for each row of docs; uid is its place in them."""
    ship(docs.sparkSession)
    docs, place = common.placed(docs, "mix-input")
    return _mix(docs, place, source, text, weights, share, limit, seed)


def _mix(docs: DataFrame, place: str, source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 8) -> DataFrame:
    # numbers of rows are written with the places that they stand for, so both are the same whenever they are read
    sized = common.materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(place).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size")), "mix-sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = share_out(numbered(per), weights, share, limit).withColumnRenamed("no", "source_no")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(limit)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    # null as a name of its own, for joins by name
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name")
    plan = common.materialize(plan.select("source_no", name, "source_size", "target", rate.alias("rate"), "n"), "mix-targets")
    rows = common.hot_join(sized.select("uid", "place", "doc_id", "size", name), plan.drop("n"), "name", plan.select("name", "n"), "uid")
    rows = common.materialize(rows.drop("name"), "mix-rows")
    groups = rows.groupBy(*_ROW).agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("m"), F.first("rate").alias("rate"))
    want = F.col("m") * F.col("rate")
    base = F.floor(want + _EPS).cast("long")
    groups = common.materialize(groups.select(*_ROW, "uid", "m", base.alias("base"), F.greatest(F.lit(0.0), want - base).alias("frac"), F.lit(0).alias("level")), "mix-groups")
    columns = ["uid", "doc_id", "size", "source_no", "m", "base", "frac", "level"]
    done, open_rows, level = [groups.filter(F.col("frac") <= _EPS).withColumn("frac", F.lit(0.0)).select(columns)], groups.filter(F.col("frac") > _EPS).select(columns), 0
    while True:
        counts = common.materialize(open_rows.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")), f"mix-open{level}")
        most = counts.agg(F.max("n")).first()[0]
        if not most:
            break
        flown = common.materialize(_round(_deal(open_rows, counts, level), seed), f"mix-level{level}").select(columns)
        is_open = (F.col("frac") > 0) & (F.col("frac") < 1)
        done.append(flown.filter(~is_open))
        if most <= BLOCK:
            break
        open_rows, level = flown.filter(is_open), level + 1
    flat = done[0]
    for d in done[1:]:
        flat = flat.unionByName(d)
    total = flat.select("uid", *_ROW, "m", (F.col("base") + F.round("frac").cast("long")).alias("total"))
    one = total.filter("m = 1").select("uid", F.col("total").alias("copies"))
    if not groups.filter("m > 1").isEmpty():
        # of m rows that are alike each takes the whole part of total / m, and the first ones one more
        several = _numbered_alike(rows, groups.filter("m > 1").select(*_ROW))
        some = total.filter("m > 1").alias("t").join(several.alias("s").hint("merge"), [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in _ROW])
        copies = F.expr("total div m") + (F.col("nth") < F.expr("total % m")).cast("long")
        one = one.unionByName(some.select(F.col("s.uid").alias("uid"), copies.alias("copies")))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return rows.join(one.hint("merge"), "uid").select("doc_id", "size", "source_size", "target", "copies", taken, F.col("place").alias("uid"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns."""
    ship(docs.sparkSession)
    docs, place = common.placed(docs, "mix-input")
    copies = common.fresh(docs, "copies")
    taken = _mix(docs, place, **options).filter("copies > 0").select(F.col("uid").alias(place), F.col("copies").cast("int").alias(copies))
    rows = docs.join(taken.hint("merge"), place).drop(place)
    copy = common.fresh(rows, "copy")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).drop(copies, copy)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read_table(spark, sf_dir, "documents")).drop("uid")
