"""Language identification by error-correcting output codes over binary n-gram classifiers.

Each learned language has a codeword of bits; each bit is a logistic classifier of the texts of the languages that have it
set against those that have not. Up to ``EXHAUSTIVE`` languages the code has every split of the languages once; beyond, it
is the random code with the greatest least distance among ``CODES`` drawn ones, ``PER_DOUBLING`` bits for each doubling of
their number. A text gets the language whose codeword is nearest by loss: the sum over bits of log(1 + exp(-bit * margin)),
each bit weighted by the log-odds of its accuracy on texts it was not fitted to. A text is ambiguous when the
second-nearest codeword is less than ``AMBIGUOUS`` of loss further away. The score is the language's share of
exp(-sharpness * loss) over all languages, with the sharpness that makes the calibration texts likeliest.

Features are byte n-grams of 1 to ``LONGEST_GRAM`` bytes of the text in lower case with everything of ASCII but letters taken
as space, hashed to ``BUCKETS``; a feature is the square root of its share, so texts of all lengths have length 1.

Bounds. Rows of folds 1 to 4 (crc32(doc_id as text) mod 5) are learnt from: of each language the ``ROWS`` first by a hash of
doc_id among texts of ``LONGEST_TEXT`` bytes or fewer, whole; fold 4 calibrates. A bit is fitted in a task of its own. The
``LANGUAGES`` commonest languages are learned. Every document is scored, whole, in batches cut by bytes.

Defined results: null texts and texts without a letter give ``und`` with score 0 and are ambiguous; ties go to the name that
comes first; with one learned language every text with letters is that one with score 1; with none all are ``und``; of rows
with one doc_id and language the least text is learnt from; null doc_id rows are neither learnt from nor held out; repeated rows are
scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from . import common

BUCKETS, LONGEST_GRAM = 1 << 15, 4
ROWS, LONGEST_TEXT, LANGUAGES = 1_000, 20_000, 1_000
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
EXHAUSTIVE, CODES, PER_DOUBLING = 6, 200, 10
AMBIGUOUS, NONE = 0.1, "und"
_STEPS, _RATE, _RIDGE, _SLACK = 120, 0.5, 1e-4, 0.01
#: Texts whose features stand as dense rows at a time, and bytes of text that are taken up at a time.
_ROWS, SLICE = 32, 1 << 18
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Odd multipliers, one for each length of gram.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def cleaned(text: str | None) -> bytes:
    """Letters in lower case with one space between, before and after runs of them; empty if there is no letter."""
    b = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    if not b or not (any(97 <= x <= 122 for x in b[:64]) or any(c.isalpha() for c in text)):
        return b""
    return b" " + b + b" "


def features(parts: list[bytes]) -> np.ndarray:
    """A row of BUCKETS values for each cleaned text: the square root of each bucket's share of its n-grams."""
    b = np.frombuffer(b"".join(parts), dtype=np.uint8)
    row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    out = np.zeros(len(parts) * BUCKETS)
    gram, shift = np.zeros(len(b), dtype=np.uint32), np.uint32(32 - BUCKETS.bit_length() + 1)
    for k in range(min(LONGEST_GRAM, len(b))):
        gram = gram[: len(b) - k] | (b[k:].astype(np.uint32) << np.uint32(8 * k))
        whole = row[: len(b) - k] == row[k:]
        x = (gram + np.uint32(k)) * _MIX[k]
        x = ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
        out += np.bincount(row[k:][whole] * BUCKETS + x[whole], minlength=len(out))
    out = out.reshape(len(parts), BUCKETS)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def _batched(parts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(parts), _ROWS):
        yield at, features(parts[at : at + _ROWS])


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and 1 for each language; no column is the same for all, no two columns split them alike."""
    if languages < 2:
        return np.ones((languages, 0), dtype=np.int8)
    if languages <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (languages - 1))
        return np.array([[1 if not lang or not s >> (lang - 1) & 1 else -1 for s in splits] for lang in range(languages)], dtype=np.int8)
    rng, best, most = np.random.default_rng(languages), None, -1
    for _ in range(CODES):
        code = rng.integers(0, 2, (languages, math.ceil(PER_DOUBLING * math.log2(languages)))).astype(np.int8) * 2 - 1
        code *= code[0]
        code = np.unique(code[:, (code != code[0]).any(axis=0)], axis=1)
        same = code.astype(np.int32) @ code.T.astype(np.int32)
        least = int((code.shape[1] - same + 2 * code.shape[1] * np.eye(languages, dtype=np.int32)).min()) // 2
        if least > most:
            best, most = code, least
    return best


#: Sparse rows of one block of texts: bucket and value of each feature, where each row begins, and the rows' places.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, slice]


def sparse(parts: list[bytes]) -> list[Block]:
    out = []
    for at, x in _batched(parts):
        row, index = np.nonzero(x)
        length = np.bincount(row, minlength=len(x))
        out.append((index.astype(np.int32), x[row, index], np.concatenate(([0], np.cumsum(length)[:-1])), slice(at, at + len(x))))
    return out


def fit_bit(blocks: list[Block], sign: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier, its constant last, on blocks of sparse rows, none of them empty; either side counts as
    much as the other. Full steps with a running scale for each weight, summed up block by block."""
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    w, first, second = (np.zeros(BUCKETS + 1) for _ in range(3))
    for step in range(1, _STEPS + 1):
        gradient = np.append(_RIDGE * w[:-1], 0.0)
        for index, value, start, rows in blocks:
            z = np.add.reduceat(w[index] * value, start) + w[-1]
            pull = -sign[rows] * weight[rows] / (1 + np.exp(np.clip(sign[rows] * z, -30, 30)))
            gradient[:-1] += np.bincount(index, np.repeat(pull, np.diff(np.append(start, len(index)))) * value, BUCKETS)
            gradient[-1] += pull.sum()
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w -= _RATE / math.sqrt(step) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w


class Model:
    """Names, codewords, weights of bits (columns), how much each bit counts, the sharpness of scores."""

    def __init__(self, names: list[str], code: np.ndarray, weights: np.ndarray) -> None:
        self.names, self.code, self.weights = names, code.astype(np.float64), weights
        self.counts, self.sharpness = np.full(code.shape[1], 1 / max(1, code.shape[1])), 1.0

    def margins(self, parts: list[bytes]) -> np.ndarray:
        z = [x.astype(np.float64) @ self.weights[:-1] + self.weights[-1] for _, x in _batched(parts)]
        return np.concatenate(z) if z else np.zeros((0, self.code.shape[1]))

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """(texts, languages), a mean over bits by what they count."""
        near, far = np.logaddexp(0, -margins) * self.counts, np.logaddexp(0, margins) * self.counts
        return near @ (self.code.T > 0) + far @ (self.code.T < 0)

    def calibrate(self, parts: list[bytes], langs: np.ndarray) -> None:
        if not len(parts) or not self.code.shape[1]:
            return
        z = self.margins(parts)
        wrong = ((z > 0) != (self.code[langs] > 0)).sum(axis=0)
        odds = np.log((len(parts) - wrong + 1) / (wrong + 1))
        self.counts = np.maximum(odds, 1e-3) / np.maximum(odds, 1e-3).sum()
        loss = self.losses(z)
        away = loss - loss[np.arange(len(parts)), langs][:, None]
        sharp = [2.0**k for k in range(-2, 9)]
        cost = [float(np.log(np.exp(np.clip(-s * away, -700, 700)).sum(axis=1)).mean()) for s in sharp]
        self.sharpness = next(s for s, c in zip(sharp, cost) if c <= min(cost) + _SLACK)  # no sharper than the texts ask for

    def decode(self, parts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Name, score and whether it is ambiguous, for each cleaned text."""
        some = np.array([bool(p) for p in parts], dtype=bool)
        names, score, ambiguous = [NONE] * len(parts), np.zeros(len(parts)), np.ones(len(parts), dtype=bool)
        if self.names and some.any():
            loss = self.losses(self.margins([p for p in parts if p])).round(12)  # so that ties are ties
            best = loss.argmin(axis=1)
            share = np.exp(-self.sharpness * (loss - loss.min(axis=1, keepdims=True)))
            for i, k in zip(np.flatnonzero(some), best):
                names[i] = self.names[k]
            score[some] = 1 / share.sum(axis=1)
            ambiguous[some] = np.partition(loss, 1, axis=1)[:, 1] - loss.min(axis=1) < AMBIGUOUS if len(self.names) > 1 else False
        return names, score, ambiguous


def _sample(docs: DataFrame, rows: int) -> list:
    """(lang, fold, text) of so many rows of each language at most, in order."""
    fit = docs.filter("doc_id is not null and lang is not null").withColumn("fold", fold()).filter(F.col("fold") != HELD_OUT)
    common_ = fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # a row for each learned language, LANGUAGES at most
    rate = common.materialize(common_.select("lang", (F.lit(4.0 * rows) / F.col("n")).alias("rate")), "language-rates")
    draw = F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = fit.withColumn("draw", draw).join(F.broadcast(rate), "lang").filter((F.col("draw") < F.col("rate")) & (F.octet_length("text") <= LONGEST_TEXT))
    once = drawn.groupBy("lang", "doc_id", "fold", "draw").agg(F.min("text").alias("text"))
    w = Window.partitionBy("lang").orderBy("draw", "doc_id")
    return once.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= rows).orderBy("lang", "k").select("lang", "fold", "text").collect()


def learn(docs: DataFrame, rows: int = ROWS) -> Model:
    """docs: (doc_id, lang, text)."""
    spark = docs.sparkSession
    ship(spark)
    sample = [(r.lang, r.fold, p) for r in _sample(docs, rows) if (p := cleaned(r.text))]
    names = sorted({lang for lang, *_ in sample}, key=lambda x: x.encode("utf-8", "surrogatepass"))
    code, number = codewords(len(names)), {lang: k for k, lang in enumerate(names)}
    weights = np.zeros((BUCKETS + 1, code.shape[1]))
    if code.shape[1]:
        # with no calibration rows of their own, small tables are fitted to all
        fitted = [(number[lang], p) for lang, f, p in sample if f != CALIBRATE] or [(number[lang], p) for lang, _, p in sample]
        held = spark.sparkContext.broadcast((code, fitted))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            code, fitted = held.value
            blocks, langs = sparse([p for _, p in fitted]), np.array([k for k, _ in fitted])
            for frame in frames:
                for bit in frame["id"]:
                    yield pd.DataFrame({"bit": [bit], "weights": [fit_bit(blocks, code[langs, bit].astype(np.float64)).tobytes()]})
            del blocks
            common.give_back()

        bits = code.shape[1]
        for r in spark.range(0, bits, numPartitions=bits).mapInPandas(run, "bit long, weights binary").collect():
            weights[:, r.bit] = np.frombuffer(r.weights)
        held.unpersist()
    model = Model(names, code, weights)
    kept = [(number[lang], p) for lang, f, p in sample if f == CALIBRATE]
    model.calibrate([p for _, p in kept], np.array([k for k, _ in kept], dtype=np.int64))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row for each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part in common.slices(batch, 1, SLICE):
                names, score, ambiguous = model.decode([cleaned(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(common.lean(run), "doc_id long, lang_pred string, score double, ambiguous boolean")
    held_out = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
