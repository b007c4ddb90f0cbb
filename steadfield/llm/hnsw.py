"""Approximate nearest neighbours by largest inner product: one hierarchical navigable small-world graph per shard.

Equal vectors are indexed once, with the smallest ids that carry them, so that a vector with a third of all rows is one
node. Distinct vectors are dealt by length to bands, within each of which lengths differ by a factor of 2 ** ``BAND_BITS``
at most, and in a band to shards of about ``SHARD_ROWS`` by a hash; vectors of different numbers of components are in different shards. Each shard becomes a graph in flat
arrays: for each layer the node numbers and an array of neighbours of fixed width, padded with -1. Vectors are divided by
the longest of their shard and get one more component, which makes their lengths equal, so that the nearest by distance is
the largest by inner product. In a band the added component leaves the others their digits, however long the vectors of
other bands are.

Nodes are inserted in batches: a batch is searched together in the graph so far, step by step, as arrays of beams; each
node keeps those neighbours that are nearer to it than to a neighbour already kept, and links back are trimmed likewise.
Graphs are files in the shared folder, one a shard. Queries are dealt to blocks of ``QUERY_BLOCK``, and a block goes once to
each group of ``GROUP_SHARDS`` shards, whose files its task reads one after another; so no graph is shuffled, and a query
is once for each group. A task keeps the k best of its group for each query, and a window merges the groups' results.

Defined results: vectors that are null, empty or all zeros, or hold null or non-finite components, take no part; vectors
are compared with those of as many components, as there is no inner product with others; a score beyond the range of doubles is given
as infinite, but ranked by its value; ties go to the smaller id; a query that has fewer than
k candidates gets them all; repeated rows are one vector; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from . import common

K, QUERY_STEP = 20, 20
SHARD_ROWS, QUERY_BLOCK, GROUP_SHARDS = 8_192, 4_096, 64
#: Neighbours of a node above the lowest layer (twice that below), and widths of the beam.
M, BUILD_BEAM, SEARCH_BEAM = 16, 64, 192
BATCH = 256
#: log2 of the greatest ratio of lengths in a band.
BAND_BITS = 3
#: near is the score in a scale of its query's own, which can't overflow.
_SCHEMA = "query_id long, vec_id long, score double, near double"


class Graph:
    """Nodes are rows of points (float32, with the added component). layers[l] is an (n, width) int32 array."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray], entry: int) -> None:
        self.points, self.layers, self.entry = points, layers, entry

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 1) -> Graph:
        n = len(points)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 8)
        if n:
            level[0] = max(int(level.max()), 1)
        layers = [np.full((n, 2 * M if k == 0 else M), -1, dtype=np.int32) for k in range(int(level.max()) + 1 if n else 1)]
        g = cls(points, layers, 0)
        order = np.arange(1, n)
        at, size = 0, 1
        while at < len(order):  # the first batches are small, as they see few nodes
            batch = order[at : at + min(BATCH, size)]
            g._insert(batch, level[batch])
            at += len(batch)
            size += len(batch)
        return g

    def _insert(self, batch: np.ndarray, level: np.ndarray) -> None:
        q = self.points[batch]
        entry = np.full((len(batch), 1), self.entry)
        for k in range(len(self.layers) - 1, -1, -1):
            here = level >= k
            beam = 1 if not here.any() else BUILD_BEAM
            ids, sims = self._search(q, entry, k, beam)
            entry = ids[:, :1] if beam == 1 else np.where(ids[:, :4] >= 0, ids[:, :4], ids[:, :1])
            if here.any():
                self._link(batch[here], ids[here], sims[here], k)

    def _link(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> None:
        width = self.layers[k].shape[1]
        # nodes of one batch don't see each other in the graph; they are offered to each other here
        among = self.points[nodes] @ self.points[nodes].T
        np.fill_diagonal(among, -np.inf)
        near = np.argsort(-among, axis=1, kind="stable")[:, : min(M, len(nodes) - 1)]
        ids = np.concatenate((ids, nodes[near]), axis=1)
        sims = np.concatenate((sims, np.take_along_axis(among, near, axis=1)), axis=1)
        kept = self._diverse(ids, sims, M)
        self.layers[k][nodes, : kept.shape[1]] = kept
        # links back
        target, source = kept.ravel(), np.repeat(nodes, kept.shape[1])
        ok = target >= 0
        target, source = target[ok], source[ok]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        owners, start, count = np.unique(target, return_index=True, return_counts=True)
        most = int(count.max()) if len(count) else 0
        if not most:
            return
        incoming = np.full((len(owners), most), -1, dtype=np.int64)
        incoming[np.repeat(np.arange(len(owners)), count), np.arange(len(target)) - np.repeat(start, count)] = source
        pool = np.concatenate((self.layers[k][owners].astype(np.int64), incoming), axis=1)
        pool_sims = np.einsum("nd,nmd->nm", self.points[owners], self.points[np.maximum(pool, 0)])
        pool_sims[pool < 0] = -np.inf
        crowded = (pool >= 0).sum(axis=1) > width
        order = np.argsort(-pool_sims, axis=1, kind="stable")[:, : max(width, pool.shape[1] if crowded.any() else width)]
        pool, pool_sims = np.take_along_axis(pool, order, axis=1), np.take_along_axis(pool_sims, order, axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1  # a node linked from both sides stands twice, side by side
        out = np.full((len(owners), width), -1, dtype=np.int32)
        plain = pool[~crowded][:, :width]
        out[~crowded, : plain.shape[1]] = plain
        if crowded.any():
            chosen = self._diverse(pool[crowded], pool_sims[crowded], width)
            out[np.flatnonzero(crowded)[:, None], np.arange(chosen.shape[1])] = chosen
        self.layers[k][owners] = out

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, nearest first, those nearer to the node than to a candidate kept before; then the rest."""
        sims = np.where(ids >= 0, sims, -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        p = self.points[np.maximum(ids, 0)]
        between = np.einsum("nid,njd->nij", p, p)
        n, c = ids.shape
        kept = np.zeros((n, c), dtype=bool)
        for j in range(c):
            shadowed = ((between[:, :, j] > sims[:, j, None]) & kept).any(axis=1)
            kept[:, j] = ~shadowed & (ids[:, j] >= 0) & (kept.sum(axis=1) < most)
        rank = np.where(kept, 0, 1) * c + np.arange(c)
        rank[ids < 0] = 3 * c
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, axis=1)

    def _search(self, q: np.ndarray, entry: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams (ids, similarities), nearest first, of all queries at once."""
        n, links = len(q), self.layers[k]
        ids = np.full((n, beam), -1, dtype=np.int64)
        sims = np.full((n, beam), -np.inf, dtype=np.float32)
        done = np.zeros((n, beam), dtype=bool)
        seen = np.zeros((n, len(self.points) + 1), dtype=bool)  # the last column stands for -1
        seen[:, -1] = True
        rows = np.arange(n)
        fresh = entry.astype(np.int64)
        live = rows
        while len(live):
            # of equal candidates of a row the first counts
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh[np.take_along_axis(seen[live], fresh, axis=1)] = -1
            seen[live[:, None], fresh] = True
            s = np.einsum("nd,nmd->nm", q[live], self.points[np.maximum(fresh, 0)])
            s[fresh < 0] = -np.inf
            all_ids, all_sims = np.concatenate((ids[live], fresh), axis=1), np.concatenate((sims[live], s), axis=1)
            all_done = np.concatenate((done[live], np.zeros(fresh.shape, dtype=bool)), axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(all_sims, order, axis=1)
            done[live] = np.take_along_axis(all_done, order, axis=1)
            open_ = ~done[live] & (ids[live] >= 0)
            live = live[open_.any(axis=1)]
            if not len(live):
                break
            at = np.argmax(~done[live] & (ids[live] >= 0), axis=1)
            done[live, at] = True
            fresh = links[ids[live, at]].astype(np.int64)
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(q), 1), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self._search(q, entry, k, 1)[0]
        return self._search(q, entry, 0, beam)


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def usable(column: str) -> Column:
    """Whether a vector has finite components, not all of them zero."""
    v = F.col(column)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def _scaled(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by powers of two, so that their largest components are between 1/2 and 1, and the exponents."""
    e = np.frexp(np.abs(a).max(axis=1, initial=0.0))[1]
    return np.ldexp(a, -e[:, None]), e


def _bands(a: np.ndarray) -> np.ndarray:
    part, e = _scaled(a)
    return np.floor((np.log2((part * part).sum(axis=1)) / 2 + e) / BAND_BITS).astype(np.int32)


_FIELDS = ("vectors", "points", "members", "member_counts", "entry")


def _build(pdf: pd.DataFrame, folder: str) -> pd.DataFrame:
    """Writes a shard: its vectors as they are, the ids of each, and the graph in flat arrays."""
    pdf = pdf.sort_values("first_id", kind="stable")
    dim, shard = int(pdf["dim"].iat[0]), int(pdf["shard"].iat[0])
    raw = np.frombuffer(b"".join(pdf["v"]), dtype="<f8").reshape(-1, dim)
    unit = np.ldexp(raw, -int(np.frexp(np.abs(raw).max())[1]))
    unit = unit / np.sqrt((unit * unit).sum(axis=1)).max()
    points = np.concatenate((unit, np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))[:, None]), axis=1).astype(np.float32)
    g = Graph.build(points)
    members = [np.asarray(m, dtype="<i8") for m in pdf["members"]]
    arrays = dict(zip(_FIELDS, (raw, points, np.concatenate(members), np.array([len(m) for m in members], dtype="<i4"), np.array([g.entry]))))
    out = io.BytesIO()
    np.savez(out, **arrays, **{f"layer{j}": x for j, x in enumerate(g.layers)})
    files, base = common.file_system(folder)
    # an attempt that runs twice writes the same bytes
    with files.open_output_stream(f"{base}/shard-{shard:09d}.npz") as h:
        h.write(out.getbuffer())
    return pd.DataFrame({"shard": [shard], "dim": [dim], "nodes": [len(raw)]})


def _read(folder: str, shard: int) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    files, base = common.file_system(folder)
    with files.open_input_stream(f"{base}/shard-{shard:09d}.npz") as h:
        z = np.load(io.BytesIO(h.read()), allow_pickle=False)
    layers = [z[f"layer{j}"] for j in range(sum(n.startswith("layer") for n in z.files))]
    return Graph(z["points"], layers, int(z["entry"][0])), z["vectors"], z["members"], z["member_counts"]


_NOTHING = {"query_id": "int64", "vec_id": "int64", "score": "float64", "near": "float64"}


def _best(t: pd.DataFrame, k: int) -> pd.DataFrame:
    t = t.drop_duplicates().sort_values(["query_id", "near", "vec_id"], ascending=[True, False, True], kind="stable")
    return t.groupby("query_id", sort=False).head(k)


def _ask(queries: pd.DataFrame, folder: str, shards: Sequence[int], k: int) -> pd.DataFrame:
    """The k best of a group of shards for each query of a block."""
    found = pd.DataFrame(columns=list(_NOTHING)).astype(_NOTHING)
    for shard in shards:
        found = _best(pd.concat((found, _ask_shard(queries, *_read(folder, shard), k)), ignore_index=True), k)
    return found


def _ask_shard(queries: pd.DataFrame, g: Graph, raw: np.ndarray, members: np.ndarray, counts: np.ndarray, k: int) -> pd.DataFrame:
    dim = raw.shape[1]
    start = np.concatenate(([0], np.cumsum(counts)))
    out: list[pd.DataFrame] = []
    part, exponent = _scaled(raw)
    room = dim.bit_length() + 1
    vectors = np.frombuffer(b"".join(queries["v"]), dtype="<f8").reshape(-1, dim)
    ids = queries["query_id"].to_numpy()
    for at in range(0, len(ids), 512):
        v, own = vectors[at : at + 512], ids[at : at + 512]
        v, own_exponent = _scaled(v)
        length = np.sqrt((v * v).sum(axis=1))
        q = np.concatenate((v / length[:, None], np.zeros((len(v), 1))), axis=1).astype(np.float32)
        found, _ = g.search(q, max(SEARCH_BEAM, 2 * k))
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        product = (v[r] * part[node]).sum(axis=1)
        near = np.ldexp(product, exponent[node] - room)
        with np.errstate(over="ignore"):
            score = np.ldexp(product, exponent[node] + own_exponent[r])
        n = counts[node]
        rr = np.repeat(np.arange(len(r)), n)
        member = members[np.repeat(start[node], n) + np.arange(len(rr)) - np.repeat(np.cumsum(n) - n, n)]
        t = pd.DataFrame({"query_id": own[r[rr]], "vec_id": member, "score": score[rr], "near": near[rr]})
        out.append(_best(t[t["query_id"] != t["vec_id"]], k))
    return pd.concat(out, ignore_index=True)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vectors (vec_id long, v array<double>), queries (query_id long, v array<double>): (query_id, rank, vec_id, score).
    A row is no candidate of a query with its own id."""
    spark = vectors.sparkSession
    ship(spark)
    # the k + 1 smallest ids of a vector are all that k places beside the query itself can take
    distinct = common.materialize(_smallest_ids(vectors.filter(usable("v")), k + 1), "hnsw-distinct")
    # one row for each number of components and band; doubles have 2,100 exponents, so 700 bands at most
    per = distinct.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_ROWS)).cast("int").alias("shards"))
    per = common.materialize(per.withColumn("first", (F.sum("shards").over(Window.orderBy("dim", "band")) - F.col("shards")).cast("int")), "hnsw-bands")
    folder = common.new_path(spark, "hnsw-graphs")
    files, base = common.file_system(folder)
    files.create_dir(base, recursive=True)
    dealt = distinct.join(per.hint("merge"), ["dim", "band"]).withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("v"), F.col("shards"))).cast("int"))
    built = dealt.select("shard", "dim", "v", "members", "first_id").groupBy("shard").applyInPandas(lambda pdf: _build(pdf, folder), "shard int, dim int, nodes int")
    built = common.materialize(built, "hnsw-shards")
    # shards of one number of components follow each other; a group is a run of those that hold vectors
    groups = built.groupBy("dim", F.floor(F.col("shard") / GROUP_SHARDS).alias("group")).agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    asked = common.materialize(_packed(queries.filter(usable("v")), "query_id"), "hnsw-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    met = asked.withColumn("dim", (F.octet_length("v") / 8).cast("int")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).join(groups, "dim")
    found = met.select("query_id", "v", "dim", "block", "group", "shards").groupBy("dim", "group", "block").applyInPandas(lambda pdf: _ask(pdf, folder, pdf["shards"].iat[0], k), _SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """(key, v binary): components as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_doubles(batch.column(1)), pa.binary())], names=[key, "v"])

    return rows.select(F.col(key).cast("long").alias(key), "v").mapInArrow(run, f"{key} long, v binary")


def _doubles(column: pa.Array) -> list[bytes]:
    return [(np.asarray(x, dtype="<f8") + 0.0).tobytes() for x in column.to_pylist()]  # -0.0 becomes 0.0


def _smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """(v binary, dim, band, members, first_id): the n smallest ids of each distinct vector. A task hands on n ids of a vector at most, so
    that a hot vector's ids are never gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            bands, sizes = np.zeros(len(held), dtype=np.int32), np.array([len(v) for v in held])
            for size in np.unique(sizes):
                bands[sizes == size] = _bands(np.frombuffer(b"".join(v for v in held if len(v) == size), dtype="<f8").reshape(-1, size // 8))
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(bands, pa.int32()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["v", "band", "ids"])
            held.clear()
            return out

        for batch in batches:
            for v, i in zip(_doubles(batch.column(1)), batch.column(0).to_pylist()):
                ids = held.setdefault(v, [])
                if i not in ids:
                    ids.append(i)
                if len(ids) > 2 * n:
                    ids.sort()
                    del ids[n:]
            for ids in held.values():
                ids.sort()
                del ids[n:]
            if len(held) > 100_000:
                yield flush()
        yield flush()

    some = rows.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(run, "v binary, band int, ids array<long>")
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
    return some.groupBy("v").agg((F.octet_length("v") / 8).cast("int").alias("dim"), F.min("band").alias("band"), F.slice(every, 1, n).alias("members")).withColumn("first_id", F.element_at("members", 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = common.read_table(spark, sf_dir, "embeddings")
    vectors = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return nearest(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0).withColumnRenamed("vec_id", "query_id"))
