"""Near-duplicate classes: BagMinHash signatures of word-shingle multisets, banding, and exact multiset overlap.

Signatures. A shingle that stands w times in a text has weight w. The levels 1, 2, 3 ... of a weight are cut into dyadic
ranges [2^k, 2^(k+1)); each (shingle, k) is one Poisson process of rate 2^k whose points fall on the levels of the range,
and points above w are thinned out. So texts that share a shingle share the points of the levels they share, an element
of any weight costs a few points, and the first point in each of the signature's ``SIZE`` slots is a weighted-Jaccard
sample without bias. Points are made in growing time order until none can be first in its slot.

Pairs. Texts of equal words (by SHA-256 of the words' bytes) are one class from the start and go on as one. ``BANDS``
bands of ``ROWS`` slots make buckets; at similarity 0.8 a pair misses all of them with probability 6e-5. In a bucket all
are compared with its first member, and what similarity 0.8 or more links becomes one component. Where a bucket still
holds several components, its members are compared by their signatures alone, in cells of two blocks: those outside the
bucket's largest component with each other and with the members of that one, which are not compared among themselves.
Members of pairs of different components that look alike meet in the same cells once more with their texts, where such
pairs are verified, the most alike first, as long as their components have not met; so no group's pairs are written out.

What is missed. Signatures are estimates: a pair at 0.8 is dropped before its texts are read if fewer than ``ESTIMATE``
of its slots agree (over four standard errors below 0.8, probability below 1e-4) or, in cells, if fewer than five
standard errors below 0.8 agree of the first third; the README has the measured recall. What is found is exact: each
link is verified on the two multisets of word shingles, the words themselves and not their hashes, of the whole texts.

Hot keys. Joins on a bucket or on its first member deal the rows of hot ones to several tasks (``common.hot_join``);
a leader's text travels once for each ``SALT_ROWS`` of its pairs.

Defined results: null and empty texts have no words and form one class; texts of fewer than five words are in a class
with their equals only; words are what stands between white space; the class is named by its smallest doc_id, a null
doc_id being smallest; repeated rows are one class; an empty table gives an empty result; other columns are ignored by
``near_classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import common
from .components import components
from .hashing import mix as _mix
from .hashing import string_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
SIZE = BANDS * ROWS
ESTIMATE, BLOCK, SALT_ROWS = 0.68, 512, 256
#: Members of a bucket's largest component that one cell holds.
LARGEST_BLOCK = 512
_U = np.uint64


_PLACES = _mix(np.arange(1, WORDS + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03)) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # at the six characters of ASCII white space


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, which only proposes that words are equal."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(b):
        return np.empty(0, dtype=np.uint64)
    edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return _mix(string_hashes(b, start, end) + (end - start).astype(np.uint64))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each stands."""
    n = len(words) - WORDS + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        s += words[k : k + n] * _PLACES[k]
    return np.unique(_mix(s), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset Jaccard of hashed shingles. Where hashes meet it can only be too high, as the least of two sums is no less
    than the sum of the least of their terms."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common_ = int(np.minimum(a[1][i], b[1][j]).sum())
    return common_ / (total - common_)


def exact_similarity(a: list[bytes], b: list[bytes]) -> float:
    """Multiset Jaccard of the shingles of two texts, given as their words."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in a + b], dtype=np.int64)
    x, y = np.split(ids, [len(a)])
    n, base = max(0, len(a) - WORDS + 1), len(number)
    m = max(0, len(b) - WORDS + 1)
    if not n or not m:
        return 0.0
    gram = np.concatenate((x[:n], y[:m]))
    for k in range(1, WORDS):  # gram numbers stay below the number of words, so the products are exact
        gram = np.unique(gram * base + np.concatenate((x[k : k + n], y[k : k + m])), return_inverse=True)[1]
    p, q = (np.bincount(g, minlength=int(gram.max()) + 1) for g in (gram[:n], gram[n:]))
    common_ = int(np.minimum(p, q).sum())
    return common_ / (n + m - common_)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signature(elements: np.ndarray, weights: np.ndarray, size: int = SIZE) -> np.ndarray:
    """For each slot the identity of its first point."""
    octave = np.frexp(weights)[1].astype(np.int64) - 1  # of the highest range that a weight reaches
    top = int(octave.max())
    who = np.concatenate([np.flatnonzero(octave >= k) for k in range(top + 1)])
    k = np.repeat(np.arange(top + 1), [int((octave >= j).sum()) for j in range(top + 1)])
    seed = _mix(elements[who] + _mix((k + 1).astype(np.uint64)))
    low, weight = (1 << k).astype(np.int64), weights[who]
    rate, when = low.astype(np.float64), np.zeros(len(who))
    first, name = np.full(size, np.inf), np.zeros(size, dtype=np.uint64)
    step = 0
    while len(seed):
        n = max(1, min(256, 7 * size // len(seed)))  # about as many points as fill all slots
        point = _mix(seed[:, None] + _mix(np.arange(step + 1, step + n + 1, dtype=np.uint64)))
        times = when[:, None] + np.cumsum(-np.log(_uniform(point)) / rate[:, None], axis=1)
        more = _mix(point)
        slot = ((more >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
        level = low[:, None] + ((more & _U(0xFFFFFFFF)).astype(np.int64) * low[:, None] >> 32)
        ok = (level <= weight[:, None]) & (times < first[slot])
        t, s, p = times[ok], slot[ok], (point ^ _mix(level.astype(np.uint64)))[ok]
        order = np.argsort(-t, kind="stable")  # of points in one slot the first is written last
        first[s[order]], name[s[order]] = t[order], p[order]
        alive = times[:, -1] < first.max()
        seed, low, weight, rate, when = seed[alive], low[alive], weight[alive], rate[alive], times[alive, -1]
        step += n
    return name


def bands(names: np.ndarray) -> np.ndarray:
    h = np.zeros(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + names.reshape(BANDS, ROWS)[:, k])
    return _mix(h + np.arange(1, BANDS + 1, dtype=np.uint64)).astype(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, place, doc_id, text) to (uid, place, doc_id, words, sig, bands); sig and bands null for texts without shingles."""
    for batch in batches:
        words_, sigs, bands_ = [], [], []
        for text in (t for part in common.slices(batch, 3) for t in part.column(3).to_pylist()):
            words_.append(hashlib.sha256(b" ".join(words(text or ""))).digest())
            e, n = shingles(word_hashes(text or ""))
            if len(e):
                s = signature(e, n)
                sigs.append((s & _U(0xFF)).astype(np.uint8).tobytes())
                bands_.append(bands(s))
            else:
                sigs.append(None)
                bands_.append(None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(words_, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands_, pa.list_(pa.int64()))],
            names=["uid", "place", "doc_id", "words", "sig", "bands"],
        )


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sig_a, sig_b) to the (a, b) whose signatures agree in enough slots."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SIZE) for c in (2, 3))
            batch = batch.filter(pa.array((x == y).mean(axis=1) >= ESTIMATE))
        yield batch.select([0, 1])


def _look_alike(sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of left and right whose signatures agree in enough slots, and in how many: first by a third of the slots."""
    head, enough = SIZE // 3, int((SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / (SIZE // 3)) ** 0.5) * (SIZE // 3))
    short = np.ascontiguousarray(sig[right][:, :head])
    for at in range(0, len(left), 64):
        i = left[at : at + 64]
        p, q = np.nonzero(np.count_nonzero(sig[i][:, None, :head] == short[None, :, :], axis=2) >= enough)
        a, b = i[p], right[q]
        agree = np.count_nonzero(sig[a] == sig[b], axis=1)
        ok = agree >= ESTIMATE * SIZE
        yield a[ok], b[ok], agree[ok]


def _candidates(pdf: pd.DataFrame) -> np.ndarray:
    """Members of a cell, sorted by uid: rows (slots that agree, a, b) of the pairs that look alike and are of different
    components. Pairs that share an earlier band as well are left to that band's bucket."""
    sig, key = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(-1, SIZE), pdf["key"].iat[0]
    comp, side, bands_ = pdf["component"].to_numpy(), pdf["side"].to_numpy(), np.stack(pdf["bands"].to_list())
    own_band, found = np.argmax(bands_ == key, axis=1), []
    for a, b, agree in _look_alike(sig, np.flatnonzero(side != 1), np.flatnonzero(side != 0)):
        ok = (comp[a] != comp[b]) & ((side[a] != 2) | (a < b))
        a, b, agree = a[ok], b[ok], agree[ok]
        before = (bands_[a] == bands_[b]) & (np.arange(BANDS) < own_band[a][:, None])
        ok = ~before.any(axis=1)
        found.append(np.stack((agree[ok], a[ok], b[ok])))
    return np.concatenate(found, axis=1) if found else np.empty((3, 0), dtype=np.int64)


def _looked(pdf: pd.DataFrame) -> pd.DataFrame:
    """The members of a cell that are in a pair worth verifying."""
    pdf = pdf.sort_values("uid", kind="stable")
    return pdf.iloc[np.unique(_candidates(pdf)[1:])]


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Members of a cell, with their texts: links that join different components, verified on whole texts. The most alike
    pairs come first, and a pair whose components have met meanwhile needs no look; so the links are a forest."""
    pdf = pdf.sort_values("uid", kind="stable")
    uid, comp, text = pdf["uid"].to_numpy(), pdf["component"].to_numpy(), pdf["text"].tolist()
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    agree, a, b = _candidates(pdf)
    sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out = []
    for k in np.argsort(-agree, kind="stable").tolist():
        x, y = int(a[k]), int(b[k])
        cx, cy = root(int(comp[x])), root(int(comp[y]))
        if cx == cy:
            continue
        for z in (x, y):
            if z not in sets:
                sets[z] = shingles(word_hashes(text[z] or ""))
        if similarity(sets[x], sets[y]) >= SIMILARITY and (j := exact_similarity(words(text[x] or ""), words(text[y] or ""))) >= SIMILARITY:
            parent[max(cx, cy)] = min(cx, cy)
            out.append((int(uid[x]), int(uid[y]), j))
    return pd.DataFrame(out, columns=["u", "v", "similarity"]).astype({"u": "int64", "v": "int64", "similarity": "float64"})


def _verified(members: pd.DataFrame, leader: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(leader):
        at, first = int(leader["leader"].iat[0]), leader["leader_text"].iat[0] or ""
        own, own_words = shingles(word_hashes(first)), words(first)
        for b, text in zip(members["b"], members["text"]):
            if similarity(own, shingles(word_hashes(text or ""))) >= SIMILARITY and (j := exact_similarity(own_words, words(text or ""))) >= SIMILARITY:
                out.append((at, int(b), j))
    return pd.DataFrame(out, columns=["u", "v", "similarity"]).astype({"u": "int64", "v": "int64", "similarity": "float64"})


def _verify(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more, as (u, v, similarity). A member's text travels once for each pair;
    a leader's once for each SALT_ROWS of its members."""
    counts = common.materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), f"{name}-counts")
    salts = counts.select("a", F.ceil(F.col("n") / SALT_ROWS).cast("long").alias("salts"))
    dealt = common.hot_join(pairs, salts, "a", counts, "b").withColumn("salt", F.pmod(F.xxhash64("b"), "salts"))
    members = dealt.join(texts.withColumnRenamed("uid", "b").hint("merge"), "b").select(F.col("a").alias("a"), F.col("salt").alias("salt"), F.col("b").alias("b"), F.col("text").alias("text"))
    leaders = salts.join(texts.withColumnRenamed("uid", "a").hint("merge"), "a")
    # names of their own: both sides come from the same tables
    leaders = leaders.select(F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("part"), F.col("text").alias("leader_text"))
    met = members.groupBy("a", "salt").cogroup(leaders.groupBy("leader", "part")).applyInPandas(_verified, "u long, v long, similarity double")
    return common.materialize(met, name)


def _links(docs: DataFrame, place: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed rows, first row of each class of equal words, verified links between those)."""
    # the number of a row is written with its place, so both are the same whenever the table is read
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(place).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = common.materialize(base.mapInArrow(common.lean(_signed), "uid long, place struct<file: string, row: long>, doc_id long, words binary, sig binary, bands array<long>"), "minhash-signatures")
    firsts = common.materialize(signed.groupBy("words").agg(F.min(F.struct("doc_id", "uid")).alias("f")).select("words", F.col("f.uid").alias("rep"), F.col("f.doc_id").alias("rep_doc")), "minhash-firsts")
    reps = signed.join(firsts.select(F.col("rep").alias("uid")).hint("merge"), "uid", "left_semi").filter("sig is not null")
    banded = reps.select("uid", F.explode("bands").alias("key"))
    buckets = common.materialize(banded.groupBy("key").agg(F.min("uid").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "minhash-buckets")
    sizes = buckets.select("key", "n")
    held = common.materialize(common.hot_join(banded, buckets.select("key", "leader"), "key", sizes, "uid").select("key", "uid", "leader"), "minhash-members")
    wanted = signed.select("uid", "place").join(held.select("uid").distinct().hint("merge"), "uid", "left_semi")
    texts = common.materialize(base.select("place", "text").join(wanted.hint("merge"), "place").select("uid", "text"), "minhash-texts")
    sig = reps.select("uid", "sig")
    stars = common.materialize(held.filter("uid <> leader").select(F.col("leader").alias("a"), F.col("uid").alias("b")).distinct(), "minhash-stars")
    near = common.hot_join(stars, sig.select(F.col("uid").alias("a"), F.col("sig").alias("sig_a")), "a", common.materialize(stars.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "minhash-leaders"), "b")
    near = near.join(sig.select(F.col("uid").alias("b"), F.col("sig").alias("sig_b")).hint("merge"), "b")
    near = common.materialize(near.select("a", "b", "sig_a", "sig_b").mapInArrow(_alike, "a long, b long"), "minhash-alike")
    links = _verify(near, texts, "minhash-links")
    return signed, firsts, links.unionByName(_between(held, reps, texts, sizes, components(links.select("u", "v"))))


def _between(held: DataFrame, reps: DataFrame, texts: DataFrame, sizes: DataFrame, comp: DataFrame) -> DataFrame:
    """Verified links between the components that a bucket still holds."""
    named = held.join(comp.withColumnRenamed("node", "uid").hint("merge"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    named = common.materialize(named, "minhash-named")
    # the first member was compared with all others
    parts = named.filter("uid <> leader").groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    most = F.max(F.struct("m", "component"))
    mixed = parts.groupBy("key").agg(most.alias("most"), F.sum("m").alias("others"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    mixed = mixed.filter("c0 <> c1").select(
        "key", F.col("most.component").alias("largest"), F.ceil((F.col("others") - F.col("most.m")) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.col("most.m") / LARGEST_BLOCK).cast("int").alias("largest_blocks"),
    )
    mixed = common.materialize(mixed, "minhash-mixed")
    of_mixed = common.materialize(sizes.join(mixed.select("key").hint("merge"), "key", "left_semi"), "minhash-mixed-sizes")
    left = common.hot_join(named.filter("uid <> leader").select("key", "uid", "component"), mixed, "key", of_mixed, "uid")
    left = left.join(reps.select("uid", "sig", "bands").hint("merge"), "uid")
    # cells (i, j) of two blocks outside the largest component, and (i, -1 - j) of one outside and one of its blocks
    is_largest = F.col("component") == F.col("largest")
    own = F.pmod(F.xxhash64("uid"), F.when(is_largest, F.col("largest_blocks")).otherwise(F.col("blocks"))).cast("int")
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.cast("int").alias("side"))
    outside = F.transform(blocks, lambda o: cell(F.least(o, F.col("own")), F.greatest(o, F.col("own")), F.when(o == F.col("own"), 2).when(o > F.col("own"), 0).otherwise(1)))
    across = F.transform(F.sequence(F.lit(0), F.col("largest_blocks") - 1), lambda o: cell(F.col("own"), -1 - o, 0))
    inside = F.transform(blocks, lambda o: cell(o, -1 - F.col("own"), 1))
    spread = left.withColumn("own", own).withColumn("cell", F.explode(F.when(is_largest, inside).otherwise(F.concat(outside, across))))
    spread = spread.select("key", "cell.i", "cell.j", "uid", "component", "sig", "bands", "cell.side")
    looked = common.materialize(spread.groupBy("key", "i", "j").applyInPandas(_looked, spread.schema), "minhash-looked")
    rest = looked.join(texts.hint("merge"), "uid").groupBy("key", "i", "j").applyInPandas(_joined, "u long, v long, similarity double")
    return common.materialize(rest, "minhash-rest")


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, copy_of, uid, class_uid, place), one row for each row of docs. class_id is the smallest
    doc_id of the class, copy_of that of the rows with equal words."""
    return _classes(*common.placed(docs, "minhash-input"))


def _classes(docs: DataFrame, place: str) -> DataFrame:
    ship(docs.sparkSession)
    signed, firsts, links = _links(docs, place)
    comp = components(links.select("u", "v"))
    classes = firsts.join(comp.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    classes = common.materialize(classes, "minhash-classes")
    rows = signed.select("uid", "place", "doc_id", "words").join(classes.hint("merge"), "words")
    names = rows.groupBy("component").agg(F.min(F.struct("doc_id", "uid")).alias("f"), F.count(F.lit(1)).alias("class_size"))
    names = common.materialize(names.select("component", F.col("f.doc_id").alias("class_id"), F.col("f.uid").alias("class_uid"), "class_size"), "minhash-names")
    return rows.join(names.hint("merge"), "component").select(
        "doc_id", "class_id", "class_size", F.col("rep_doc").alias("copy_of"), "uid", "class_uid", "place"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The first row of each class, with all columns of docs."""
    docs, place = common.placed(docs, "minhash-input")
    dropped = _classes(docs, place).filter("uid <> class_uid").select(F.col("place").alias(place))
    return docs.join(dropped.hint("merge"), place, "left_anti").drop(place)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(common.read_table(spark, sf_dir, "documents")).drop("uid", "class_uid", "place")
