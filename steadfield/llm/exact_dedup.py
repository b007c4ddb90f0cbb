"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive runs of bytes of their folded text. Level 0 groups by the first ``WIDTHS[0]``
bytes; each later level splits every group that is left by the next, wider digit. A group leaves the recursion when
it has one member or when its members have ended; members of one ended group have passed through equal digits from
the first byte to the last, so they are equal without any digest.

A level is one partial/final aggregation by (group, digit, ended) and one join of its result to the members, so that a
group with a third of all rows is summed up in each task before it is shuffled, and the join is one that adaptive
execution can split. Only members of groups with two or more rows are carried on, and only they have their text read
again. Joins are always sort-merge joins, so that the plan at a small size is the plan at a large one. Level results are written to the shared folder, so a lost executor costs one level.

Defined results: null text counts as empty; all empty texts form one group; of rows that tie on ``doc_id`` and text,
one stays; a null ``doc_id`` sorts after all others; an empty table gives an empty result; other columns are ignored.
Rows are told apart by file and number in the file (``common.placed``), so that a change of cores between two readings
of the input changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of the first digit, the factor from one digit to the next, and the widest digit.
FIRST_WIDTH, GROWTH, WIDEST = 64, 8, 1 << 20


def _widths() -> Iterator[tuple[int, int]]:
    start, width = 0, FIRST_WIDTH
    while True:
        yield start, width
        start, width = start + width, min(width * GROWTH, WIDEST)


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")


def _split(rows: DataFrame, by: list[str], level: int) -> DataFrame:
    """Members (uid, doc_id, n_bytes, ended) of groups with two rows or more, with grp (its first row) and group_size."""
    groups = common.materialize(
        rows.groupBy(*by, "ended").agg(F.count(F.lit(1)).alias("group_size"), F.min(_order()).alias("head")).filter("group_size > 1"),
        f"radix{level}-groups",
    )
    on = [rows[c].eqNullSafe(groups[c]) if c == "grp" else rows[c] == groups[c] for c in [*by, "ended"]]
    kept = rows.join(groups.hint("merge"), on).select(
        rows.uid, rows.doc_id, rows.n_bytes, rows.ended, groups["head.uid"].alias("grp"), groups["head.doc_id"].alias("keep_id"), groups.group_size
    )
    return common.materialize(kept, f"radix{level}-members")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, uid), one row for each row of ``docs``; uid is the row's place."""
    docs, place = common.placed(docs, "radix-input")
    return _groups(docs, place)


def _groups(docs: DataFrame, place: str) -> DataFrame:
    base = docs.select(F.col(place).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), common.folded().cast("binary").alias("b"))
    widths = _widths()
    start, width = next(widths)
    rows = common.materialize(
        base.select("uid", "doc_id", F.octet_length("b").alias("n_bytes"), F.sha2("b", 256).alias("text_sha256"), F.substring("b", 1, width).alias("digit")),
        "radix-rows",
    )
    live = _split(rows.withColumn("ended", F.col("n_bytes") <= width), ["digit"], 0)
    found, level, text = live.filter("ended"), 0, None
    live = live.filter("not ended")
    while not live.isEmpty():
        level += 1
        if text is None:
            text = common.materialize(base.select("uid", "b").join(live.select("uid").hint("merge"), "uid", "left_semi"), "radix-text")
        start, width = next(widths)
        digits = text.select("uid", F.substring("b", start + 1, width).alias("digit"))
        rows_now = live.select("uid", "doc_id", "n_bytes", "grp").join(digits.hint("merge"), "uid")
        live = _split(rows_now.withColumn("ended", F.col("n_bytes") <= start + width), ["grp", "digit"], level)
        found = found.unionByName(live.filter("ended"))
        live = live.filter("not ended")
    found = found.select("uid", F.col("grp").alias("f_uid"), F.col("keep_id").alias("f_id"), F.col("group_size").alias("f_size"))
    return rows.join(found.hint("merge"), "uid", "left").select(
        "doc_id",
        F.when(F.col("f_uid").isNull(), F.col("doc_id")).otherwise(F.col("f_id")).alias("keep_id"),
        F.coalesce("f_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("f_uid").isNull() | (F.col("f_uid") == F.col("uid"))).alias("kept"),
        "text_sha256",
        "uid",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs, place = common.placed(docs, "radix-input")
    dropped = _groups(docs, place).filter("not kept").select(F.col("uid").alias(place))
    return docs.join(dropped.hint("merge"), place, "left_anti").drop(place)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.read_table(spark, sf_dir, "documents")).drop("uid")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
