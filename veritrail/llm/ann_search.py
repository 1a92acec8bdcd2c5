"""Approximate nearest neighbours by balanced posting lists.

Vectors are clustered in two steps, into coarse cells and these into lists, by halving groups of rows into even parts;
there are about `LISTS_PER_ROOT` lists for the root of the number of rows, so both the lists and their rows grow with
the root. Every vector goes to the list of its nearest centroid and, near a boundary, to further ones. A query walks
an in-memory neighbour graph of the centroids, keeps the lists whose distance is within a ratio of that of its nearest
lists, and compares itself with these lists' vectors exactly. The ratio is the smallest that reaches the recall aimed
at for sampled queries, whose true neighbours are found among all rows; queries near to and far from their nearest
lists have ratios of their own.

Inner products become distances by one more component: sqrt(M^2 - |x|^2) for a vector, 0 for a query, where M is the
largest length; all vectors then lie on one sphere, and the nearest one has the largest inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialize, release, table

K = 20
#: Lists for the root of the number of rows, and at most (what a worker holds of centroids is bounded by this).
LISTS_PER_ROOT = 2.0
MOST_LISTS = 1 << 18
#: Sampled rows on which the coarse cells are fitted, about, and those on which each list is.
COARSE_ROWS = 8192
ROWS_A_LIST = 8
#: Cells in which a vector looks for its lists, and from which a centroid takes its neighbours in the graph.
PROBED_CELLS = 8
#: A vector joins up to REPLICAS lists: those within 1 + BOUNDARY of its nearest one's distance, but none that one of
#: its other lists is nearer to than the vector is.
REPLICAS = 3
BOUNDARY = 0.005
#: Recall aimed at, queries on which the ratios are set, lists whose mean distance a ratio refers to, and ratios.
RECALL = 0.95
CALIBRATION_QUERIES = 256
NEAREST = 8
BANDS = 4
#: Neighbours of a centroid in the graph, and candidates that the walk holds, at least.
GRAPH_DEGREE = 24
BEAM = 48
#: Vectors and queries of one block of comparisons, about.
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 1024


@dataclass
class Lists:
    longest: float
    cells: np.ndarray  # coarse centroids
    first: np.ndarray  # of each cell, its first list; and the number of lists
    centroids: np.ndarray  # lists of one cell follow one another
    graph: np.ndarray
    entries: np.ndarray
    edges: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ratios: np.ndarray = field(default_factory=lambda: np.full(1, np.inf))

    def ratio(self, base: float) -> float:
        return float(self.ratios[np.searchsorted(self.edges, base)])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def on_sphere(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1) / longest


def query_point(q: np.ndarray) -> np.ndarray:
    return np.concatenate([_unit(q), np.zeros((len(q), 1))], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between points of the unit sphere."""
    return np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of `lists` groups of even sizes: each split sends half of a group's rows to either centre."""
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(x))]
    while len(groups) < lists:
        k = max(range(len(groups)), key=lambda g: len(groups[g]))
        rows = groups[k]
        if len(rows) < 2:
            break
        a, b = x[rows[rng.choice(len(rows), 2, replace=False)]]
        for _ in range(6):
            order = np.argsort(x[rows] @ (a - b), kind="stable")
            near_b, near_a = rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]
            a, b = x[near_a].mean(axis=0), x[near_b].mean(axis=0)
        groups[k : k + 1] = [near_a, near_b]  # halves stay side by side
    return _unit(np.stack([x[g].mean(axis=0) for g in groups]))


def neighbour_graph(cells: np.ndarray, first: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each centroid's nearest others among the lists of the cells next to its own, and entry points spread over all."""
    degree = max(1, min(GRAPH_DEGREE, len(c) - 1))
    graph = np.zeros((len(c), degree), np.int64)
    near = np.argsort(_distances(cells, cells), axis=1)[:, :PROBED_CELLS] if len(cells) else np.zeros((0, 0), int)
    for k in range(len(cells)):
        own = np.arange(first[k], first[k + 1])
        around = np.concatenate([np.arange(first[j], first[j + 1]) for j in near[k]])
        if not len(own) or len(around) < 2:
            continue
        d = _distances(c[own], c[around])
        d[own[:, None] == around[None]] = np.inf
        n = min(degree, len(around) - 1)
        found = around[np.argpartition(d, n - 1, axis=1)[:, :n]]
        graph[own] = found[:, np.arange(degree) % n]
    return graph, np.linspace(0, max(len(c) - 1, 0), min(len(c), 16)).astype(np.int64)


def graph_search(q: np.ndarray, m: Lists, seen: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(lists, distances, base) met by best-first walks from the entry points, nearest first. base: the mean distance
    of the nearest ones. A list is expanded if it is in the beam or within the ratio. seen, mark: scratch memory."""
    ids = m.entries
    seen[ids] = mark
    dist = np.sqrt(np.maximum(2 - 2 * m.centroids[ids] @ q, 0))
    todo = np.ones(len(ids), bool)
    while True:
        beam = np.partition(dist, min(BEAM, len(dist)) - 1)[: min(BEAM, len(dist))]
        base = float(np.sort(beam)[:NEAREST].mean())
        go = np.flatnonzero(todo & (dist <= max(beam[-1], base * m.ratio(base))))
        if not len(go):
            break
        todo[go] = False
        fresh = np.unique(m.graph[ids[go]])
        fresh = fresh[seen[fresh] != mark]
        seen[fresh] = mark
        ids = np.concatenate((ids, fresh))
        dist = np.concatenate((dist, np.sqrt(np.maximum(2 - 2 * m.centroids[fresh] @ q, 0))))
        todo = np.concatenate((todo, np.ones(len(fresh), bool)))
    order = np.argsort(dist, kind="stable")
    return ids[order], dist[order], base


def homes(x: np.ndarray, m: Lists) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for each list that a row of x, points of the sphere, joins. Lists are looked for in the cells next to
    the row."""
    probes = min(PROBED_CELLS, len(m.cells))
    near = np.argpartition(_distances(x, m.cells), probes - 1, axis=1)[:, :probes]
    best = np.full((len(x), REPLICAS), -1, np.int64)
    dist = np.full((len(x), REPLICAS), np.inf)
    for k in np.unique(near):
        rows = np.flatnonzero((near == k).any(axis=1))
        lists = np.arange(m.first[k], m.first[k + 1])
        if not len(lists):
            continue
        d = np.concatenate([dist[rows], _distances(x[rows], m.centroids[lists])], axis=1)
        ids = np.concatenate([best[rows], np.broadcast_to(lists, (len(rows), len(lists)))], axis=1)
        top = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
        best[rows], dist[rows] = np.take_along_axis(ids, top, axis=1), np.take_along_axis(d, top, axis=1)
    keep = dist <= dist[:, :1] * (1 + BOUNDARY)
    keep[:, 0] = True
    for b in range(1, REPLICAS):
        for a in range(b):
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", m.centroids[best[:, a]], m.centroids[best[:, b]]), 0))
            keep[:, b] &= ~keep[:, a] | (between > dist[:, b])
    row, nth = np.nonzero(keep)
    return row, best[row, nth]


def set_ratios(m: Lists, queries: np.ndarray, which: np.ndarray, neighbours: np.ndarray) -> None:
    """Sets the ratios from true neighbours: neighbours[i] (a point of the sphere) is one of query which[i]."""
    if len(m.centroids) < 2 or not len(which):
        return
    d = _distances(queries, m.centroids)
    base = np.sort(d, axis=1)[:, :NEAREST].mean(axis=1)
    row, home = homes(neighbours, m)
    need = np.full(len(which), np.inf)
    np.minimum.at(need, row, d[which[row], home] / base[which[row]])
    bands = max(1, min(BANDS, len(queries) // 16))
    m.edges = np.quantile(base, np.linspace(0, 1, bands + 1)[1:-1])
    of = np.searchsorted(m.edges, base)[which]
    overall = float(np.quantile(need, RECALL))
    m.ratios = np.array([np.quantile(need[of == k], RECALL) if (of == k).any() else overall for k in range(bands)]) * 1.0001


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) float64 of list values; rows are valid here."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def _sampled(rows: DataFrame, seed: int, part: float) -> DataFrame:
    """Rows with a hash of their own below a bound; rows alike in id and vector, of which few are left, go together."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id", "vec"), F.lit(1 << 40)) < int(part * (1 << 40)) + 1)


def fit_lists(rows: DataFrame, total: int, longest: float, dims: int, k: int) -> Lists:
    """rows: row, vec_id, vec. The driver holds about COARSE_ROWS vectors, and the centroids."""
    spark = rows.sparkSession
    count = int(np.clip(np.ceil(LISTS_PER_ROOT * np.sqrt(total)), 1, min(MOST_LISTS, max(1, total // ROWS_A_LIST))))
    sample = _sampled(rows, 9, COARSE_ROWS / total).toArrow()
    if not sample.num_rows:
        sample = rows.limit(1).toArrow()
    x = on_sphere(_vectors(sample.column("vec"), dims), longest)
    cells = balanced_centroids(x, int(np.ceil(np.sqrt(count))))
    coarse = spark.sparkContext.broadcast(cells)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = _distances(on_sphere(_vectors(batch.column("vec"), dims), longest), coarse.value).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("vec")], names=["cell", "vec"])

    def halved(group: pa.Table) -> pa.Table:
        points = on_sphere(_vectors(group.column("vec"), dims), longest)
        c = balanced_centroids(points, max(1, round(len(points) / ROWS_A_LIST)))
        return pa.table({"cell": pa.array(np.full(len(c), group.column("cell")[0].as_py(), np.int32)), "centroid": pa.array(list(c), pa.list_(pa.float64()))})

    fine = _sampled(rows, 10, min(1.0, ROWS_A_LIST * count / total)).select("vec").mapInArrow(celled, f"cell int, vec {dict(rows.dtypes)['vec']}")
    found = fine.groupBy("cell").applyInArrow(halved, "cell int, centroid array<double>").toArrow()  # the centroids, MOST_LISTS about
    cell = found.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    c = _vectors(found.column("centroid"), dims + 1)[order] if len(order) else cells
    cell = cell[order] if len(order) else np.arange(len(cells))
    first = np.searchsorted(cell, np.arange(len(cells) + 1))
    m = Lists(longest, cells, first, c, *neighbour_graph(cells, first, c))
    asked = sample.slice(0, CALIBRATION_QUERIES)
    set_ratios(m, *_true_neighbours(rows, _vectors(asked.column("vec"), dims), asked.column("row").to_numpy(), longest, dims, k))
    return m


def _true_neighbours(rows: DataFrame, q: np.ndarray, own: np.ndarray, longest: float, dims: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, which, neighbours), as set_ratios takes them: one pass over all rows, the k best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = np.full((len(q), k), -np.inf), np.zeros((len(q), k, dims))
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = _vectors(part.column("vec"), dims)
                near = q @ x.T
                near[own[:, None] == part.column("row").to_numpy()[None]] = -np.inf
                both = np.concatenate([best, near], axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                old = top < k
                vecs = np.where(old[..., None], np.take_along_axis(held, np.where(old, top, 0)[..., None], axis=1), x[np.where(old, 0, top - k)])
                best, held = np.take_along_axis(both, top, axis=1), vecs
        a, b = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(best[a, b]), pa.array(list(held[a, b]), pa.list_(pa.float64()))], names=["q", "score", "vec"])

    met = rows.select("row", "vec").mapInArrow(run, "q long, score double, vec array<double>")
    nth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
    top = met.withColumn("nth", nth).where(F.col("nth") <= k).toArrow()  # CALIBRATION_QUERIES * k rows
    return query_point(q), top.column("q").to_numpy(), on_sphere(_vectors(top.column("vec"), dims), longest)


def _compared(dims: int, k: int):
    """One region's vectors against the queries that ask for some of its lists: the k best of each query that are not
    below its floor."""
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def compare(vec: pa.Table, ask: pa.Table) -> pa.Table:
        if not vec.num_rows or not ask.num_rows:
            return schema.empty_table()
        vec = vec.sort_by("list")
        x, q = _vectors(vec.column("vec"), dims), _vectors(ask.column("qvec"), dims)
        lists, row, ids = (vec.column(c).to_numpy() for c in ("list", "row", "vec_id"))
        query, query_id, floor = (ask.column(c).to_numpy() for c in ("query", "query_id", "floor"))
        wanted = ask.column("lists").combine_chunks()
        who, want = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy())), wanted.flatten().to_numpy()
        order = np.argsort(want, kind="stable")
        who, want = who[order], want[order]
        near = np.full((len(q), len(x)), -np.inf)
        for at in np.unique(lists):
            s, e = np.searchsorted(lists, [at, at + 1])
            some = who[slice(*np.searchsorted(want, [at, at + 1]))]
            near[some, s:e] = q[some] @ x[s:e].T
        near[query[:, None] == row[None]] = -np.inf
        # a row may stand in REPLICAS lists of the region; sums in any order differ by less than the slack
        n = min(REPLICAS * k, len(x))
        cut = np.maximum(-np.partition(-near, n - 1, axis=1)[:, n - 1], floor)
        with np.errstate(invalid="ignore"):
            a, b = np.nonzero((near >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None]) & (near > -np.inf))
        score = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 50_000]], x[b[i : i + 50_000]]) for i in range(0, len(a), 50_000)] or [np.zeros(0)])
        order = np.lexsort((row[b], ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (row[b[1:]] != row[b[:-1]])
        a, b, score = a[new], b[new], score[new]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, b, score = a[keep], b[keep], score[keep]
        return pa.table([pa.array(query[a]), pa.array(query_id[a]), pa.array(row[b]), pa.array(ids[b]), pa.array(score)], schema=schema)

    return compare


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found, by inner product, ties to the smaller id.

    Queries are the rows whose id is divisible by query_every; the candidates of each are all other rows, those that
    repeat its id or vector too. Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part. Vectors of different lengths have no inner product: each length is searched on its own.
    An empty table gives an empty result; other columns are not read. A query goes on to further lists until these hold
    4 * k rows, so that it finds all candidates where there are few. Of rows with one and the same vector, only the
    k + 1 with the smallest ids can be among a query's k nearest; these stand for the others in the lists.
    """
    spark = vectors.sparkSession
    held = dict(vectors.dtypes)[vector_col]
    v = F.col(vector_col) if held in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    sound = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).where("vec_id is not null and vec is not null").where(sound)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec", F.size("vec").alias("dims"), norm.alias("norm")), "ann-rows")
    found = None
    for dims, longest in rows.groupBy("dims").agg(F.max("norm")).orderBy("dims").collect():
        one = _of_one_length(rows.where(F.col("dims") == dims).select("row", "vec_id", "vec"), int(dims), longest, query_every, k)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_one_length(rows: DataFrame, dims: int, longest: float, query_every: int, k: int) -> DataFrame:
    spark = rows.sparkSession
    nth = F.row_number().over(W.partitionBy("vec").orderBy("vec_id", "row"))
    indexed = materialize(rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "ann-indexed")
    m = fit_lists(indexed, indexed.count(), longest, dims, k)
    shared = spark.sparkContext.broadcast(m)  # MOST_LISTS centroids at most, about
    kind = dict(rows.dtypes)["vec"]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                at, home = homes(on_sphere(_vectors(part.column("vec"), dims), longest), shared.value)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("row", "vec_id", "vec")), pa.array(home.astype(np.int32))], names=["row", "vec_id", "vec", "list"])

    postings = materialize(indexed.mapInArrow(post, f"row long, vec_id long, vec {kind}, list int"), "ann-postings")
    release(indexed)
    sizes = postings.groupBy("list").count().toArrow()  # a row for each list
    size = np.zeros(len(m.centroids), np.int64)
    size[sizes.column("list").to_numpy()] = sizes.column("count").to_numpy()
    # lists that follow one another make a region of about BLOCK_VECTORS rows, whose queries are sent once
    region = np.cumsum(size) // BLOCK_VECTORS
    where = spark.sparkContext.broadcast((size, region))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, region_of = where.value
        seen, mark = np.zeros(len(n), np.int64), 0
        for batch in batches:
            at, to, first, lists = [], [], [], []
            for r, q in enumerate(query_point(_vectors(batch.column("vec"), dims)) if batch.num_rows else ()):
                mark += 1
                ids, dist, base = graph_search(q, shared.value, seen, mark)
                some = int(np.searchsorted(dist, base * shared.value.ratio(base), "right"))
                if n[ids[:some]].sum() < 4 * k:
                    if n[ids].sum() < 4 * k:  # the walk met few rows: all lists, by distance
                        ids = np.argsort(-(shared.value.centroids @ q), kind="stable")
                    some = max(some, int(np.searchsorted(np.cumsum(n[ids]), 4 * k)) + 1)
                ids = ids[:some][n[ids[:some]] > 0]
                near = list(dict.fromkeys(region_of[ids].tolist()))  # the nearest first
                soon = set(near[: int(np.ceil(np.sqrt(len(near))))])
                ids = np.sort(ids)
                for part in np.split(ids, np.flatnonzero(np.diff(region_of[ids])) + 1):
                    at.append(r)
                    to.append(int(region_of[part[0]]))
                    first.append(to[-1] in soon)
                    lists.append(part)
            if at:
                row = pa.array(np.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(row) for c in ("row", "vec_id", "vec")), pa.array(to, pa.int64()), pa.array(first, pa.bool_()), pa.array(lists, pa.list_(pa.int32()))],
                    names=["query", "query_id", "qvec", "region", "first", "lists"],
                )

    asked = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0).mapInArrow(route, f"query long, query_id long, qvec {kind}, region long, first boolean, lists array<int>")
    asked = materialize(asked, "ann-asked")
    numbered = spark.createDataFrame(pa.table({"list": pa.array(np.arange(len(region), dtype=np.int32)), "region": pa.array(region)}))
    posted = postings.join(F.broadcast(numbered), "list")  # a row for each list
    # the root of a query's regions, the nearest, give it k rows; of the others only rows that are no worse count
    near = materialize(_best(_met(posted, asked.where("first").withColumn("floor", F.lit(float("-inf"))), dims, k), k), "ann-near")
    floors = near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("query", "floor")
    later = asked.where("not first").join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = _best(near.drop("rank").unionByName(_met(posted, later, dims, k)), k)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _met(posted: DataFrame, asked: DataFrame, dims: int, k: int) -> DataFrame:
    """query, query_id, row, vec_id, score: blocks of a region's vectors meet blocks of the queries that ask for its lists."""
    asks = asked.groupBy("region").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("q_blocks"))
    counts = posted.groupBy("region").agg(F.ceil(F.count("*") / (2 * BLOCK_VECTORS)).cast("int").alias("v_blocks")).join(asks, "region")
    counts = F.broadcast(materialize(counts, "ann-blocks"))  # fewer rows than lists
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posted.join(counts, "region").withColumn("vb", F.pmod(F.xxhash64("row"), F.col("v_blocks")).cast("int")).withColumn("qb", each("q_blocks"))
    right = asked.join(counts, "region").withColumn("qb", F.pmod(F.xxhash64("query"), F.col("q_blocks")).cast("int")).withColumn("vb", each("v_blocks"))
    keys = ["region", "vb", "qb"]
    met = left.select(*keys, "list", "row", "vec_id", "vec").groupBy(*keys).cogroup(right.select(*keys, "query", "query_id", "qvec", "lists", "floor").groupBy(*keys))
    return met.applyInArrow(_compared(dims, k), "query long, query_id long, row long, vec_id long, score double")


def _best(met: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with rank."""
    one = met.groupBy("query", "row").agg(F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return one.withColumn("rank", nth).where(F.col("rank") <= k)


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
