"""Spelling variants: words one letter apart, found by anagram hashing, and the commoner form that each points to.

Keys. A word's key is the sum of the fifth powers of its letters' code points, so words of the same letters have one key
whatever their order. One letter removed or added moves the key by that letter's power, one exchanged by the difference
of two; no two such differences of the alphabet are the same (tested), so a difference names its letters. Two words
differ by an exchange value just when they meet after each has given up its letter; so a word of n letters is written once
under its own key, for words with one letter more, and once under each key that is left without one of its different
letters. That is some n rows a word instead of one for each value of exchange of the alphabet.

Order. Both words also share what stands before or after the change, so a row carries half of the word: the letters
before the middle, or those after it. A group is then the words of one half whose other half is made of the same letters
but one; its size is bound by the arrangements of half a word, not by how often words stand in the texts. Each pair is kept
once, after a comparison of the letters in order (at most one edit).

Counts. Each task sums up its own words before the shuffle, so a word with a third of all places is one row a task.
Forms are followed to the last by doubling: a form is at least twice as common as the word, so a chain has at most as many
steps as its last count has bits, and the rounds are the logarithm of that.

Defined results: null and empty texts have no words; a null doc_id counts as the empty text in the hash; repeated rows
count each time; of near words with the same count the first in code-point order is the form; letters are A-Z, a-z and
U+00C0 to U+00FF, of which only A-Z are lowered; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .resampling import lowered

#: A run whose hash with its document is divisible by this loses a letter.
ERROR_RATE = 97
SHORTEST, LEAST_COUNT, FACTOR = 5, 3, 2
POWER = 5
_BETWEEN = "[^a-zÀ-ÿ]+"


def words(docs: DataFrame, error_rate: int | None = ERROR_RATE, shortest: int = SHORTEST, least_count: int = LEAST_COUNT, text: str = "text") -> DataFrame:
    """(word, n): words of so many letters and places at least, over all texts. error_rate: a run whose crc32 with its
    doc_id is divisible by it loses one letter, as a planted error; None plants none."""
    runs = docs.select("doc_id", F.explode(F.split(lowered(F.coalesce(F.col(text), F.lit(""))), _BETWEEN)).alias("run"))
    runs = runs.filter(F.length("run") >= shortest)
    word = F.col("run")
    if error_rate:
        key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
        runs = runs.withColumn("h", F.crc32(key.cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % error_rate == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= shortest) & (F.col("n") >= least_count))


def _value(letter: Column) -> Column:
    x = F.ascii(letter).cast("long")  # the code point
    out = x
    for _ in range(POWER - 1):
        out = out * x
    return out


def keys(table: DataFrame) -> DataFrame:
    """(word, n, gave, size, key, side, half): the rows that a word is written as. size: letters that the key is made of."""
    letters = F.split("word", "")
    own = F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: s + _value(c))
    base = table.select("word", "n", F.length("word").alias("length"), F.array_distinct(letters).alias("letters"), own.alias("own"))
    entry = lambda size, key, gave: F.struct(size.alias("size"), key.alias("key"), F.lit(gave).alias("gave"))
    given = F.transform("letters", lambda c: entry(F.col("length") - 1, F.col("own") - _value(c), True))
    rows = base.select("word", "n", F.explode(F.concat(given, F.array(entry(F.col("length"), F.col("own"), False)))).alias("e")).select("word", "n", "e.*")
    before = F.expr("size div 2").cast("int")
    halves = F.array(
        F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), before).alias("half")),
        F.struct(F.lit(1).alias("side"), F.right("word", F.col("size") - before).alias("half")),
    )
    return rows.select("word", "n", "gave", "size", "key", F.explode(halves).alias("h")).select("word", "n", "gave", "size", "key", "h.*")


def near(table: DataFrame) -> DataFrame:
    """table: (word, n), each word once. (word, other, n_other) of all words that are one letter apart, both ways."""
    rows = keys(table)
    on = ["size", "key", "side", "half"]
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b.hint("merge"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on])
    # a pair that shares both halves meets on either side: it is taken from the first
    front = lambda w: F.substring(F.col(w), F.lit(1), F.expr("a.size div 2").cast("int"))
    once = (F.col("a.side") == 0) | (front("a.word") != front("b.word"))
    pairs = met.filter((F.col("a.word") < F.col("b.word")) & (F.col("a.gave") | F.col("b.gave")) & once & (F.levenshtein("a.word", "b.word", 1) == 1))
    both = F.array(F.struct(F.col("a.word").alias("word"), F.col("b.word").alias("other"), F.col("b.n").alias("n_other")),
                   F.struct(F.col("b.word").alias("word"), F.col("a.word").alias("other"), F.col("a.n").alias("n_other")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def _last(forms: DataFrame) -> DataFrame:
    """forms: (word, form), no null. (word, root): the end of each word's chain."""
    now = common.materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not now.filter("moved").isEmpty():
        a, b = now.alias("a"), now.alias("b")
        met = a.join(b.hint("merge"), F.col("a.root") == F.col("b.word"), "left")
        now = common.materialize(met.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "spelling-roots")
    return now.drop("moved")


def variants(table: DataFrame, factor: int = FACTOR) -> DataFrame:
    """table: (word, n), each word once. (word, form, root, n, n_near, form_n): the commonest near word, if it is factor times as common."""
    table = common.materialize(table, "spelling-words")
    best = F.min(F.struct((-F.col("n_other")).alias("minus"), F.col("other").alias("other")))
    found = near(table).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = table.join(found.hint("merge"), "word", "left").withColumn("form_n", -F.col("best.minus"))
    is_form = F.col("form_n") >= factor * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    found = common.materialize(found, "spelling-forms")
    roots = _last(found.filter("form is not null"))
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(common.read_table(spark, sf_dir, "documents")))


SQL = rf"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT x, run, count(*) AS n FROM (
    SELECT doc_id || ':' || run AS x, run FROM (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
    WHERE length(run) >= {SHORTEST}) GROUP BY ALL
), crc_in AS (SELECT x FROM runs),
{common.CRC_SQL},
made AS (
  SELECT CASE WHEN crc % {ERROR_RATE} = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM runs JOIN crc_out USING (x)
), w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS n_other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN w b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, min(ROW(-n_other, other)) AS best FROM near GROUP BY word),
f AS MATERIALIZED (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {FACTOR} * n THEN best[2] END AS form, CASE WHEN -best[1] >= {FACTOR} * n THEN -best[1] END AS form_n
  FROM w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN f ON f.word = c.next
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
