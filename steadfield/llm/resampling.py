"""Importance resampling towards a target text collection, by hashed n-grams, in DataFrame functions alone.

Features of a text are its runs of 1 to ``N`` consecutive words, repeats counted; each falls into one of ``BUCKETS`` buckets
by crc32. A bucket's gain is the scaled, floored logarithm of how much commoner it is in the target than in the documents;
a document's weight is the sum of its features' gains. A Gumbel term drawn from a hash of ``doc_id`` is added, and the
documents with the highest sums are the sample: drawing without replacement by weights exp(weight / 1000).

Plan. Words are cut into blocks of ``BLOCK`` (with the words that the last n-grams of a block run into), so that a very long
text never stands as one array of n-grams; each block's n-gram array is hashed to an array of bucket numbers, which is
written once. Exploded bucket numbers are counted by bucket, each task summing its own first, so a shuffle moves at most
``BUCKETS`` rows a task however common a word is. The gain table has ``BUCKETS`` rows, a bound that does not grow, and is
broadcast; the sum for a document is begun in the task that explodes it. Ranks come from a range sort whose sorted partitions
are written with their places; the number of rows before a partition (one row a partition) gives the offset of its ranks.

Defined results: null and empty texts and texts without words have no features and weight 0; a null doc_id counts as the
empty text in the hash and comes after all others in ties; repeated rows are drawn each for itself; of rows that tie on
score and doc_id the one with fewer features, then less weight comes first; with fewer than 20 eligible documents none is
drawn at 5%; an empty table gives an empty result, an empty target leaves all t at 0; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

N, BUCKETS, SEED = 3, 10_000, 42
PERCENT, LEAST_WORDS = 5, 20
#: Words whose n-grams stand in one array.
BLOCK = 4_096
#: What stands between words, after A-Z were lowered.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z lowered, nothing else. A text of ASCII alone, which has as many bytes as code points, takes the faster way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def _grams(block: Column, n: int, most: int) -> Column:
    """All runs of 1 to n words that begin at the first most words of a block."""
    count = lambda k: F.greatest(F.least(F.size(block) - (k - 1), F.lit(most)), F.lit(0))
    runs = [F.slice(block, F.lit(1), count(1))]
    for k in range(2, n + 1):
        shorter = F.slice(runs[-1], F.lit(1), count(k))
        runs.append(F.zip_with(shorter, F.slice(block, F.lit(k), count(k)), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(*runs)


def hashed(rows: DataFrame, keep: list[str], text: str = "text", n: int = N, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """(*keep, n_words, buckets): a row for each block of a text, one at least, with the bucket of each of its features."""
    found = rows.select(*keep, words(F.col(text)).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(block))
    blocks = F.transform(starts, lambda i: F.slice(F.col("words"), i + 1, F.lit(block + n - 1)))
    cut = found.select(*keep, F.size("words").cast("long").alias("n_words"), F.explode(blocks).alias("block"))
    bucket = F.transform(_grams(F.col("block"), n, block), lambda g: (F.crc32(g.cast("binary")) % buckets).cast("int"))
    return cut.select(*keep, "n_words", bucket.alias("buckets"))


def _counts(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets; documents and target: tables of ``hashed``."""
    every = documents.sparkSession.range(0, buckets, numPartitions=1).select(F.col("id").cast("int").alias("bucket"))
    met = every.join(_counts(documents, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    met = common.materialize(met, "resampling-counts")
    total = met.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    more = (F.col("t") + 1).cast("double") * F.lit(float(total.s + buckets))
    less = (F.col("s") + 1).cast("double") * F.lit(float(total.t + buckets))
    return met.select("bucket", F.floor(F.lit(1000.0) * F.log(more / less)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A draw from a hash of the seed and doc_id, in thousandths, floored."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank (from 1) in that order, by a range sort; only one number a partition is summed in one place."""
    sorted_ = common.materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "resampling-sorted")
    part = F.shiftright("place", 33)
    held = sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = held.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    met = sorted_.withColumn("part", part).join(F.broadcast(before), "part")
    return met.withColumn("rank", F.col("before") + inside + 1).drop("part", "before", "place")


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", n: int = N, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for each row of docs; rank is null where a document is not drawn."""
    # the number of a row is written with its features, so it is the same whenever that table is read
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = common.materialize(hashed(base, ["uid", "doc_id"], "text", n, buckets, block), "resampling-features")
    goal = common.materialize(hashed(target.select(F.col(target_text).alias("text")), [], "text", n, buckets, block), "resampling-target")
    gain = F.broadcast(gains(own, goal, buckets))  # as many rows as there are buckets
    each = own.select("uid", "doc_id", "n_words", F.explode_outer("buckets").alias("bucket")).join(gain, "bucket", "left")
    sums = each.groupBy("uid", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = common.materialize(sums.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resampling-scores")
    open_ = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * open_.count() // 100
    ranks = ranked(open_.select("uid", "doc_id", "score", "n_features", "weight"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("uid"))
    ranks = ranks.filter(F.col("rank") <= drawn).select("uid", "rank")
    return scored.join(ranks.hint("merge"), "uid", "left").select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), own AS MATERIALIZED (
  SELECT doc_id, len(w) AS n_words, unnest(w) AS g FROM d
  UNION ALL SELECT doc_id, len(w), unnest(list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1])) FROM d
  UNION ALL SELECT doc_id, len(w), unnest(list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM d
), goal AS MATERIALIZED (
  SELECT unnest(w) AS g FROM b
  UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1])) FROM b
  UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM b
), crc_in AS MATERIALIZED (SELECT g AS x FROM own UNION SELECT g FROM goal),
{common.CRC_SQL},
ob AS MATERIALIZED (SELECT doc_id, n_words, crc % {BUCKETS} AS k FROM own JOIN crc_out ON x = g),
s AS (SELECT k, count(*) AS s FROM ob GROUP BY k),
t AS (SELECT crc % {BUCKETS} AS k, count(*) AS t FROM goal JOIN crc_out ON x = g GROUP BY 1),
total AS (SELECT (SELECT count(*) FROM own) AS s_all, (SELECT count(*) FROM goal) AS t_all),
gain AS (
  SELECT s.k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t ON s.k = t.k, total
), f AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM ob JOIN gain USING (k) GROUP BY doc_id),
a AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{SEED}:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM d LEFT JOIN f USING (doc_id)
), c AS (
  SELECT doc_id, n_features, weight, weight + noise AS score, n_words >= {LEAST_WORDS} AS open_,
    row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS n
  FROM a
)
SELECT doc_id, n_features, weight, score, CASE WHEN open_ AND r <= {PERCENT} * n // 100 THEN r END AS rank FROM c
"""
