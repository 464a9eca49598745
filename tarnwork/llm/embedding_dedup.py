"""Near-duplicate vectors by product quantisation: coarse inverted lists, residual codes, table-lookup distances, exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, written
from .graphs import components

#: vectors that the lists and codes are fitted on at most, those with the least hashes
SAMPLE = 20_000
#: components of a vector that one code stands for, and codes of each such subspace
WIDTH, CODES = 4, 256
#: vectors of a shard: whole short lists, or a piece of a long one
SHARD = 8_192
#: queries that are looked up at once
QUERIES = 512
#: cells of distances, and pairs of vectors, that are held at once
CELLS, PAIRS = 1 << 20, 1 << 15
#: slack of distances in single precision
SLACK = 1e-3
#: rows of a table that is sent to every task
MOST_SENT = 100_000
ROUNDS = 8


class Model(NamedTuple):
    """Coarse centroids, and for each subspace of residuals its codebook."""

    centroids: np.ndarray
    books: np.ndarray


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means from k of the rows; a centre that loses all rows stays where it was."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = np.concatenate([_squares(x[at : at + 2048], centres).argmin(1) for at in range(0, len(x), 2048)])
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(n) - n, len(x) - 1), axis=0)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :], 0)


def fitted(sample: np.ndarray, lists: int) -> Model:
    """Lists in the order of their centroids along the widest axis, so that those next to each other tend to share a shard."""
    rng = np.random.default_rng(11)
    centroids = _means(sample, min(lists, len(sample)), rng)
    middle = centroids - centroids.mean(0)
    axis = np.linalg.eigh(middle.T @ middle)[1][:, -1]
    centroids = centroids[np.argsort(middle @ axis, kind="stable")]
    rest = (sample - centroids[_squares(sample, centroids).argmin(1)]).reshape(len(sample), -1, WIDTH)
    return Model(centroids, np.stack([_means(rest[:, m], min(CODES, len(sample)), rng) for m in range(rest.shape[1])]))


def coded(model: Model, units: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each vector: its list, the codes of its residual, the length that these miss it by, and the lists that can hold a vector within reach.

    What is nearer to centroid c than to the own c0 lies beyond the plane halfway between both. So c is left out only if that plane is
    farther away than reach: the probes are sufficient, not a fixed number.
    """
    square = _squares(units, model.centroids)
    own = square.argmin(1)
    apart = np.sqrt(_squares(model.centroids, model.centroids))[own]
    probes = square - square[np.arange(len(own)), own][:, None] <= 2 * apart * reach + SLACK
    rest = (units - model.centroids[own]).reshape(len(own), -1, WIDTH)
    codes = np.stack([_squares(rest[:, m], book).argmin(1) for m, book in enumerate(model.books)], 1)
    missed = rest - model.books[np.arange(len(model.books)), codes]
    return own, codes.astype(np.uint8), np.sqrt((missed * missed).sum((1, 2))), [np.flatnonzero(p) for p in probes]


class Shard:
    """The coded vectors of some lists; queries find those within reach, and shards say which of their vectors hang together."""

    def __init__(self, model: Model, cosine: float, nodes: np.ndarray, sizes: np.ndarray, lists: np.ndarray, codes: np.ndarray, missed: np.ndarray, units: np.ndarray) -> None:
        order = np.argsort(lists, kind="stable")
        self.model, self.cosine = model, cosine
        self.nodes, self.sizes, self.codes, self.units = nodes[order], sizes[order], codes[order], units[order]
        lists = lists[order]
        self.ids, first = np.unique(lists, return_index=True)
        self.first = np.append(first, len(lists))
        again = model.centroids[lists] + model.books[np.arange(len(model.books)), self.codes].reshape(len(lists), -1)
        self.square = (again * again).sum(1).astype(np.float32)
        self.most = ((np.sqrt(2 - 2 * cosine) + missed[order] + SLACK) ** 2 + SLACK).astype(np.float32)
        self.up = np.arange(len(lists))

    def _root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def _within(self, units: np.ndarray, probed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, vector) whose distance by table lookup may be within reach; probed: for each query and list of the shard."""
        tables = [(units[:, m * WIDTH : (m + 1) * WIDTH] @ book.T).astype(np.float32) for m, book in enumerate(self.model.books)]
        middles = (units @ self.model.centroids[self.ids].T).astype(np.float32)
        for k in range(len(self.ids)):
            asked = np.flatnonzero(probed[:, k])
            for at in range(self.first[k], self.first[k + 1], step := max(1, CELLS // max(len(asked), 1))):
                to = min(at + step, self.first[k + 1])
                product = np.repeat(middles[asked, k][:, None], to - at, axis=1)
                for m, table in enumerate(tables):
                    product += table[asked][:, self.codes[at:to, m]]
                q, y = np.nonzero(1 + self.square[None, at:to] - 2 * product <= self.most[None, at:to])
                yield asked[q], y + at

    def links(self, nodes: np.ndarray, units: np.ndarray, probed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the queries with links here: their nodes, the vectors that they link with, and one node of those."""
        count, some = np.zeros(len(nodes), np.int64), np.full(len(nodes), -1)
        for q, y in self._within(units, probed):
            for at in range(0, len(q), PAIRS):
                a, b = q[at : at + PAIRS], y[at : at + PAIRS]
                real = (np.einsum("ij,ij->i", units[a], self.units[b]) >= self.cosine) & (nodes[a] != self.nodes[b])
                a, b = a[real], b[real]
                count += np.bincount(a, weights=self.sizes[b], minlength=len(nodes)).astype(np.int64)
                new, where = np.unique(a, return_index=True)
                unlinked = some[new] < 0
                some[new[unlinked]] = b[where[unlinked]]
                for x, z in np.unique(np.stack([some[a], b], 1), axis=0).tolist():
                    x, z = self._root(x), self._root(z)
                    self.up[max(x, z)] = min(x, z)
        out = np.flatnonzero(some >= 0)
        return nodes[out], count[out], self.nodes[some[out]]

    def unions(self) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([self._root(i) for i in range(len(self.up))], np.int64)
        tied = np.flatnonzero(roots != np.arange(len(roots)))
        return self.nodes[tied], self.nodes[roots[tied]]


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; null where they link with nothing."""
    for batch in batches:
        out = []
        for label, v in zip(batch.column(1).is_valid().to_pylist(), batch.column(2).to_pylist(), strict=True):
            x = np.array([np.nan if c is None else c for c in v or []], np.float64) + 0.0  # no negative zeros
            out.append(x.tobytes() if label and len(x) and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vector"])


def _units(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of length 1, with zeros up to width."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors.to_pylist()):
        x = np.frombuffer(v)
        out[k, : len(x)] = x / np.abs(x).max()
    return out / np.sqrt((out * out).sum(1))[:, None]


def _model(nodes: DataFrame, n: int, width: int) -> Model:
    """About as many lists as the root of the number of vectors, but no more than one for eight of the sample."""
    sample = nodes.select("vector").orderBy(F.xxhash64("vector"), "node").limit(SAMPLE).toArrow().column(0).combine_chunks()
    return fitted(_units(sample, width), max(1, min(int(n**0.5), len(sample) // 8)))


def _searched(model: Model, cosine: float, width: int):
    """Rows (label, dims, shard, node, size, list, codes, missed, vector, probes) of a task, sorted so that a shard's own rows, which have a list, come
    before its queries, which have probes: to (node, n, other)."""

    def rows(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "n", "other"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, shard = None, [], None
        for batch in batches:
            label, dims, number = (batch.column(k).to_numpy() for k in range(3))
            query = batch.column("list").is_null().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((label[1:] != label[:-1]) | (dims[1:] != dims[:-1]) | (number[1:] != number[:-1]) | (query[1:] != query[:-1])) + 1
            edges = [0, *cut.tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part, now = batch.slice(a, b - a), (label[a], dims[a], number[a])
                if now != key:
                    if shard:
                        yield rows([*_with_zero(*shard.unions())])
                    key, own, shard = now, [], None
                if not query[a]:
                    own.append(_Rows(part, width))
                    continue
                if own:
                    shard, own = Shard(model, cosine, *(np.concatenate(c) for c in zip(*(r.indexed() for r in own), strict=True))), []
                for at in range(0, part.num_rows, QUERIES):
                    if shard:
                        asked = _Rows(part.slice(at, QUERIES), width)
                        node, n, other = shard.links(asked.nodes, asked.units, asked.probed(shard.ids))
                        yield rows([node, n, other])
        if shard:
            yield rows([*_with_zero(*shard.unions())])

    return search


def _with_zero(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return a, np.zeros(len(a), np.int64), b


class _Rows:
    def __init__(self, batch: pa.RecordBatch, width: int) -> None:
        self.batch = batch
        self.nodes, self.units = batch.column("node").to_numpy(), _units(batch.column("vector"), width)

    def indexed(self) -> tuple[np.ndarray, ...]:
        codes = np.frombuffer(b"".join(self.batch.column("codes").to_pylist()), np.uint8).reshape(len(self.nodes), -1)
        return self.nodes, self.batch.column("size").to_numpy(), self.batch.column("list").to_numpy(), codes, self.batch.column("missed").to_numpy(), self.units

    def probed(self, lists: np.ndarray) -> np.ndarray:
        """For each query and list whether it is probed."""
        out = np.zeros((len(self.nodes), len(lists)), bool)
        probes = self.batch.column("probes")
        flat = probes.flatten().to_numpy()
        row = np.repeat(np.arange(len(self.nodes)), np.fromiter((len(p) for p in probes.to_pylist()), np.int64, len(self.nodes)))
        at = np.minimum(np.searchsorted(lists, flat), len(lists) - 1)
        here = lists[at] == flat
        out[row[here], at[here]] = True
        return out


def _coded_rows(model: Model, reach: float, width: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                own, codes, missed, probes = coded(model, _units(batch.column("vector"), width), reach)
                more = [pa.array(own, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed), pa.array([p.tolist() for p in probes], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "list", "codes", "missed", "probes"])

    return code


def _links(nodes: DataFrame, cosine: float) -> DataFrame:
    """(node, n, other): node links with n vectors of a shard, of which other is one; n is 0 where two vectors of a shard hang together otherwise."""
    spark = nodes.sparkSession
    seen = nodes.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    width = -(-(seen["dims"] or 1) // WIDTH) * WIDTH
    if not seen["n"]:
        return spark.createDataFrame([], "node long, n long, other long")
    model = _model(nodes, seen["n"], width)
    reach = float(np.sqrt(2 - 2 * cosine))
    rows, _ = written(nodes.mapInArrow(_coded_rows(model, reach, width), "label long, dims int, vector binary, first long, size long, node long, list long, codes binary, missed double, probes array<long>"), "coded")
    sizes = rows.groupBy("label", "dims", "list").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("label", "dims").orderBy("list"))
    sizes = sizes.select("label", "dims", F.col("list").alias("_list"), F.floor((upto - F.col("_n")) / SHARD).cast("long").alias("_from"), F.floor((upto - 1) / SHARD).cast("long").alias("_to"))
    sizes, _ = written(sizes, "lists")
    sizes = few(sizes, MOST_SENT)
    here = rows.withColumn("_list", F.col("list")).join(sizes, ["label", "dims", "_list"])
    own = here.select("label", "dims", (F.col("_from") + F.pmod(F.xxhash64("node"), F.col("_to") - F.col("_from") + 1)).alias("shard"), "node", "size", "list", "codes", "missed", "vector", F.lit(None).cast("array<long>").alias("probes"))
    asks = rows.select("label", "dims", "node", F.explode("probes").alias("_list")).join(sizes, ["label", "dims", "_list"])
    asks = asks.select("label", "dims", "node", "_list", F.explode(F.sequence("_from", "_to")).alias("shard")).groupBy("label", "dims", "node", "shard").agg(F.collect_list("_list").alias("_probes"))
    asks = asks.join(rows.select("node", "vector"), "node").select("label", "dims", "shard", "node", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("list"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("missed"), "vector", F.col("_probes").alias("probes"))
    dealt = own.union(asks).repartition("label", "dims", "shard").sortWithinPartitions("label", "dims", "shard", F.col("list").isNull())
    return dealt.mapInArrow(_searched(model, cosine, width), "node long, n long, other long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, they have equally many components, and their cosine in double precision is `cosine` or more
    (0 < cosine < 1). n_links: other rows linked with; component_id: the smallest vec_id that links reach, the own one included; kept: vec_id equals it.
    Null vectors, those with null, infinite or undefined components, and zero vectors link with nothing.

    Equal vectors of a label are one node, so copies are never compared. Lists and codes are fitted on a sample of at most SAMPLE nodes; every node
    is indexed. Vectors of a label are sharded by lists; a query goes once to each shard with a list that it probes, and is compared there by table
    lookups with the codes of those lists. What a lookup says can be wrong by no more than the codes miss the vector by, a number that is stored with
    them: only what is farther even then is left out, and the rest gets its cosine. So no link is lost, in expectation or otherwise. A shard sends a count and a
    link for each query, and the unions of its own vectors, never all pairs. Rows that repeat a vec_id, or have none, are rows like others; component_id
    is null if all ids of a component are. An empty table gives no rows. Other columns are ignored.
    """
    raw = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_raw, "vec_id long, label long, vector binary")
    raw = raw.withColumn("_hash", F.sha2("vector", 256))
    nodes = raw.filter(F.col("vector").isNotNull()).groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
    nodes, _ = written(nodes.select("label", F.expr("CAST(octet_length(vector) / 8 AS INT)").alias("dims"), "vector", "first", "size", F.monotonically_increasing_id().alias("node")), "vectors")
    links, _ = written(_links(nodes, cosine), "links")
    joined = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    found = nodes.select("label", "node", F.sha2("vector", 256).alias("_hash"), "first", "size").join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("first").alias("component_id"))
    found = found.join(least, "component").select("label", "_hash", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("_links"), "component_id", F.lit(True).alias("_found"))
    out = raw.select("vec_id", "label", "_hash").join(found, ["label", "_hash"], "left")
    out = out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
