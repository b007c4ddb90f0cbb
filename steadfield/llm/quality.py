"""Quality scores from zstandard dictionaries of good and bad text.

One raw-content dictionary is cut from texts labelled good and one from texts labelled bad. A text is compressed whole
with either; how many bytes fewer the good dictionary needs, for each byte of text, says how good it is. That
difference becomes a probability by a logistic calibration on labelled rows that are in neither dictionary; its terms
are the normalised difference, the normalised smaller size and the logarithm of the length with their second-order terms,
so that short texts and texts that compress to nothing by repeating themselves are judged as such. The difference has no
square: a text that is in a dictionary lies beyond all calibrated differences, and has to score further on its side.

Only rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from: mods 1 to 3 fill the dictionaries, mod 4
calibrates. The samples are bounded: ``DICTIONARY_BYTES`` for each dictionary, from ``DICTIONARY_ROWS`` rows of each
class at most, and ``CALIBRATION_ROWS`` rows of each class; they are drawn by a hash of doc_id. Every document is scored.

Defined results: null and empty texts get the score of an empty text; with no labels at all the score is 0.5, with one
class only near that class; a doc_id labelled more than once counts as bad if any label says so; null labels are
ignored; of rows with one labelled doc_id the first text is learnt from; repeated rows are scored alike; an empty table gives an empty result; other columns are kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import common

DICTIONARY_BYTES, DICTIONARY_ROWS, CALIBRATION_ROWS = 1_000_000, 4_000, 4_000
#: Lengths in bytes of the texts that a dictionary takes, whole.
SHORTEST, LONGEST = 100, 8_000
LEVEL = 6
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
THRESHOLD = 0.3
_PRIOR_BYTES = 32
#: The ridge on standardised terms is this by the number of calibration rows.
_RIDGE = 50.0


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


class Compressors:
    def __init__(self, bad: bytes, good: bytes) -> None:
        self.both = [self._of(b) for b in (bad, good)]

    @staticmethod
    def _of(content: bytes) -> zstandard.ZstdCompressor:
        if len(content) < 8:
            return zstandard.ZstdCompressor(level=LEVEL)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)

    def sizes(self, text: str | None) -> tuple[int, int, int]:
        """Compressed with the bad and the good dictionary, and as it is."""
        b = (text or "").encode("utf-8", "surrogatepass")
        return len(self.both[0].compress(b)), len(self.both[1].compress(b)), len(b)

    def all_sizes(self, batch: pa.RecordBatch, column: int) -> np.ndarray:
        return np.array([self.sizes(t) for part in common.slices(batch, column) for t in part.column(column).to_pylist()], dtype=np.int64).reshape(-1, 3)


def features(sizes: np.ndarray) -> np.ndarray:
    """The normalised difference, the normalised smaller size, the logarithm of the length."""
    bad, good, n = np.asarray(sizes, dtype=np.float64).reshape(-1, 3).T
    return np.stack([(bad - good) / (n + _PRIOR_BYTES), np.minimum(bad, good) / (n + _PRIOR_BYTES), np.log(n + _PRIOR_BYTES)], axis=1)


def terms(f: np.ndarray) -> np.ndarray:
    d, r, length = f.T
    return np.stack([np.ones_like(d), d, r, length, r * r, r * length, length * length, d * length], axis=1)


class Calibration:
    """A ridge logistic regression by Newton's method on standardised terms."""

    def __init__(self, sizes: np.ndarray, labels: np.ndarray) -> None:
        f, y = features(sizes), np.asarray(labels, dtype=np.float64)
        # beyond the sizes and lengths that it has seen, a text is judged as at their edge
        self.low, self.high = (f.min(axis=0), f.max(axis=0)) if len(f) else (np.zeros(3), np.zeros(3))
        self.low[0], self.high[0] = -np.inf, np.inf
        x = terms(f)
        self.mean, self.scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
        if len(x):
            self.mean[1:] = x.mean(axis=0)[1:]
            spread = x.std(axis=0)
            self.scale[1:] = np.where(spread[1:] > 1e-12, spread[1:], 1.0)
        z, self.weights = (x - self.mean) / self.scale, np.zeros(x.shape[1])
        self.ridge = _RIDGE / max(1, len(x))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            gradient = z.T @ (y - p) - self.ridge * self.weights
            hessian = (z * (p * (1 - p))[:, None]).T @ z + self.ridge * np.eye(len(self.weights))
            step = np.linalg.solve(hessian, gradient)
            loss, size = self._loss(z, y, self.weights), 1.0
            while size > 1e-6 and self._loss(z, y, self.weights + size * step) > loss - 1e-4 * size * float(gradient @ step):
                size /= 2
            self.weights += size * step
            if np.abs(size * step).max() < 1e-8:
                break

    def _loss(self, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
        m = z @ w
        return float((np.logaddexp(0, m) - y * m).sum() + self.ridge / 2 * (w @ w))

    def score(self, sizes: np.ndarray) -> np.ndarray:
        z = (terms(np.clip(features(sizes), self.low, self.high)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def _draw(labels: DataFrame, quality: int, folds: Column, n: int) -> DataFrame:
    """The n labelled ids of a class that come first by hash."""
    order = F.xxhash64(F.lit("draw"), "doc_id")
    return labels.filter((F.col("quality") == quality) & folds).orderBy(order, "doc_id").limit(n).withColumn("order", order)


def _sizes(rows: DataFrame, columns: list[str], dictionaries: tuple[bytes, bytes], out: str, finish) -> DataFrame:
    """rows (*columns, text) with what finish makes of the sizes of a batch."""
    held = rows.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(*held.value)
        for batch in batches:
            new = finish(compressors.all_sizes(batch, len(columns)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *new.values()], names=[*columns, *new])

    return rows.select(*columns, "text").mapInArrow(common.lean(run), out)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[tuple[bytes, bytes], Calibration]:
    """Dictionaries (bad, good) and the calibration, from docs (doc_id, text) and labels (doc_id, quality)."""
    ship(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = known.withColumn("fold", fold()).filter(F.col("fold") != HELD_OUT)
    drawn = None
    for q in (0, 1):
        for folds, n in ((F.col("fold") != CALIBRATE, DICTIONARY_ROWS), (F.col("fold") == CALIBRATE, CALIBRATION_ROWS)):
            part = _draw(known, q, folds, n)
            drawn = part if drawn is None else drawn.unionByName(part)
    # at most 2 * (DICTIONARY_ROWS + CALIBRATION_ROWS) rows of four numbers, so this side is broadcast
    drawn = common.materialize(drawn, "quality-drawn")
    # of rows with one doc_id the first text, so that the sample is bounded however often a drawn id stands in docs
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    sample = common.materialize(found.groupBy("doc_id", "quality", "fold", "order").agg(F.min("text").alias("text")), "quality-sample")
    dictionaries = []
    fits = F.octet_length(common.text_or_empty()).between(SHORTEST, LONGEST)
    for q in (0, 1):
        w = F.sum(F.octet_length("text") + 1).over(_first_by_hash())
        rows = sample.filter((F.col("fold") != CALIBRATE) & (F.col("quality") == q) & fits).withColumn("so_far", w)
        texts = [r.text for r in rows.filter(F.col("so_far") <= DICTIONARY_BYTES).orderBy("order", "doc_id", "text").select("text").collect()]
        dictionaries.append("\n".join(texts).encode("utf-8", "surrogatepass"))
    pair = (dictionaries[0], dictionaries[1])
    measured = _sizes(
        sample.filter(F.col("fold") == CALIBRATE), ["doc_id", "quality"], pair, "doc_id long, quality int, bad long, good long, n long",
        lambda s: dict(zip(("bad", "good", "n"), map(pa.array, s.T))),
    )
    found = measured.orderBy("doc_id", "n", "bad", "good").collect()
    return pair, Calibration(np.array([(r.bad, r.good, r.n) for r in found]), np.array([r.quality for r in found]))


def _first_by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("quality").orderBy("order", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionaries, calibration = fit(docs, labels)
    held_out = F.coalesce(fold() == HELD_OUT, F.lit(False))
    scored = _sizes(docs, ["doc_id"], dictionaries, "doc_id long, score double", lambda s: {"score": pa.array(calibration.score(s))})
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns."""
    dictionaries, calibration = fit(docs, labels)
    schema = docs.schema
    names, held = docs.columns, docs.sparkSession.sparkContext.broadcast(dictionaries)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(*held.value)
        for batch in batches:
            yield batch.filter(pa.array(calibration.score(compressors.all_sizes(batch, at)) >= THRESHOLD, pa.bool_()))

    return docs.mapInArrow(common.lean(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))
