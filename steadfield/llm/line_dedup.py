"""Cross-site boilerplate removal by the spread of each line over distinct sites.

A HyperLogLog sketch of the sites is kept for each line hash; sketches are merged by aggregation (each task sums up its
own lines first), so a line that stands in a third of all documents is one small sketch from each task. Lines whose
estimate is clear of the threshold by ``MARGIN`` standard errors are decided by the sketch; the lines between get an
exact distinct count. Lines on ``min_sites`` sites or more are removed from every document that holds them.

All of it is DataFrame functions; no Python runs on the executors.

Defined results: a line is what stands between newline characters, compared after trimming white space at its ends; a
line that is then empty is never removed; sites are the values of ``site`` and null counts as one more site; null text
gives no lines and stays null; repeated rows are treated alike; an empty table gives an empty result; other columns of
the input are kept by ``remove_boilerplate``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Lines on so many distinct sites are boilerplate. Few enough that a passage or licence that is copied between a handful
#: of sites goes, while exact copies of one document, which stay within two or three, don't make all its lines boilerplate.
MIN_SITES = 4
#: log2 of the sketch's buckets; the relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 11
#: Standard errors between an estimate and the threshold within which a line is counted exactly.
MARGIN = 6


def _lines(name: str) -> Column:
    return F.split(F.col(name), "\n", -1)


def _hash(line: Column) -> Column:
    """128 bits of the trimmed line; null if nothing is left of it."""
    bare = F.regexp_replace(line, rf"^[{common.SPACE}]+|[{common.SPACE}]+$", "")
    return F.when(bare != "", F.unhex(F.md5(bare.cast("binary"))))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """lines: (h, site). The hashes on min_sites sites or more."""
    # a sketch can't hold a null; the site's presence bit keeps null apart from every string
    site = F.concat(F.when(F.col("site").isNull(), "0").otherwise("1"), F.coalesce("site", F.lit("")))
    spread = lines.select("h", site.alias("site"))
    sketches = common.materialize(
        spread.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sk"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites)
        .select("h", F.hll_sketch_estimate("sk").alias("estimate")),
        "line-spread",
    )
    band = max(1.0, MARGIN * 1.04 / math.sqrt(2**LG_K) * min_sites)
    sure = sketches.filter(F.col("estimate") >= min_sites + band).select("h")
    near = sketches.filter((F.col("estimate") < min_sites + band) & (F.col("estimate") > min_sites - band)).select("h")
    counted = spread.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites"))
    return sure.unionByName(counted.filter(F.col("sites") >= min_sites).select("h"))


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, text: str = "text") -> DataFrame:
    """``docs`` with the boilerplate lines gone from ``text``, and n_lines, n_removed (which replace columns so named)."""
    rows, place = common.placed(docs, "line-input")
    gone = common.fresh(rows, "gone")
    # the number of a row is written with its place, so both are the same whenever the table is read
    hashes = rows.select(F.monotonically_increasing_id().alias("uid"), F.col(place).alias("place"), F.col(site).cast("string").alias("site"), F.transform(_lines(text), _hash).alias("hs"))
    hashes = common.materialize(hashes, "line-hashes")
    once = hashes.select("uid", "site", F.posexplode("hs").alias("pos", "h")).filter("h is not null")
    bad = common.materialize(boilerplate(once.select("h", "site"), min_sites), "line-boilerplate")
    places = once.select("uid", "pos", "h").join(bad, "h").groupBy("uid").agg(F.collect_set("pos").alias(gone))
    places = places.join(hashes.select("uid", F.col("place").alias(place)), "uid").drop("uid")
    keep = F.filter(F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: ~F.array_contains(gone, p["i"]))
    out = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.transform(keep, lambda p: p["x"]), "\n"))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return rows.join(places, place, "left").withColumns({"n_lines": count(_lines(text)), "n_removed": count(F.col(gone)), text: out}).drop(place, gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    done = remove_boilerplate(docs)
    return done.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
        F.sha2(common.text_or_empty().cast("binary"), 256).alias("kept_sha256"),
    )


SQL = rf"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL
), b AS (SELECT doc_id, source, i, x, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM l),
bad AS (SELECT t FROM b WHERE t <> '' GROUP BY t HAVING count(DISTINCT coalesce('1' || source, '0')) >= {MIN_SITES}),
r AS (
  SELECT b.doc_id, count(*) AS n_lines, count(bad.t) AS n_removed, string_agg(CASE WHEN bad.t IS NULL THEN x END, chr(10) ORDER BY i) AS kept
  FROM b LEFT JOIN bad ON b.t = bad.t GROUP BY b.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""
