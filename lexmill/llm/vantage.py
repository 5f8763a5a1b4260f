"""Approximate nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt to regions by the upper levels of one vantage-point tree, fitted on a bounded sample: at each node
those within the median distance of its vantage point go one way, the others the other way. A region of more rows than a
shard takes is dealt on by a hash. A tree is built once per shard: inner nodes hold a vantage point and the median
distance to it, leaves hold small blocks. It is written to the shared folder as flat arrays, under a name of the task's
own attempt, and the table of trees names the files that count.

The queries, the stated set against all rows, are first sent to the shards of their own region, which gives each the
distance of its k-th neighbour so far. Then they are sent to the regions that the triangle inequality leaves open within
that distance, and only there. A task opens a shard's tree and takes its queries in blocks; a window by query joins the
lists. A region or a subtree is skipped if it lies ``factor`` times beyond a query's reach: with factor 1 that is the exact
bound, above 1 the reach is the k-th distance divided by the factor, so more is skipped and far neighbours may be missed.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import new_path, written


class VantageTree:
    """A vantage-point tree over rows of float64 vectors."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = 64, seed: int = 0):
        self.ids, self.points, self.leaf = ids, points, leaf
        self.random = np.random.default_rng(seed)
        self.root = self._node(np.arange(len(ids)))

    def packed(self) -> bytes:
        """The tree as flat arrays: rows in the order of the leaves, and a row per inner node, children after it."""
        order, inner, bounds = [], [], []

        def add(node) -> int:
            """The place of an inner node, or of a leaf as -1 - its place among the leaves."""
            if isinstance(node, np.ndarray):
                order.append(node)
                return -len(order)
            vantage, middle, one, two, most, least = node
            at = len(inner)
            inner.append([vantage, 0, 0])
            bounds.append([middle, most, least])
            inner[at][1], inner[at][2] = add(one), add(two)
            return at

        add(self.root)
        out = io.BytesIO()
        sizes = np.array([len(x) for x in order], np.int64)
        np.savez(out, ids=self.ids, points=self.points, rows=np.concatenate(order), sizes=sizes, inner=np.array(inner, np.int64).reshape(-1, 3), bounds=np.array(bounds, float).reshape(-1, 3))
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> VantageTree:
        """The tree that ``packed`` gave."""
        held, tree = np.load(io.BytesIO(data)), cls.__new__(cls)
        tree.ids, tree.points = held["ids"], held["points"]
        leaves = np.split(held["rows"], np.cumsum(held["sizes"])[:-1])
        inner, bounds = held["inner"].tolist(), held["bounds"].tolist()
        made: list = [None] * len(inner)

        def child(i: int):
            return made[i] if i >= 0 else leaves[-i - 1]

        for i in range(len(inner) - 1, -1, -1):
            (vantage, one, two), (middle, most, least) = inner[i], bounds[i]
            made[i] = (vantage, middle, child(one), child(two), most, least)
        tree.root = child(0 if inner else -1)
        return tree

    def _node(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        pick = int(self.random.integers(len(rows)))
        rows[[0, pick]] = rows[[pick, 0]]
        far = np.sqrt(((self.points[rows[1:]] - self.points[rows[0]]) ** 2).sum(1))
        middle = float(np.median(far))
        inner = far <= middle
        if inner.all():  # equal distances: any cut serves, the bound stays the distance
            inner = np.arange(len(far)) < len(far) // 2
        return rows[0], middle, self._node(rows[1:][inner]), self._node(rows[1:][~inner]), float(far[inner].max()), float(far[~inner].min())

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest of each query, without its own id; ties to smaller ids; inf where none.
        Those beyond ``within`` may be left out.

        Queries go down together: first each to the leaf that it belongs in, whose k-th distance bounds its reach,
        then to every subtree that is not out of reach, so that a node is met twice, whatever the number of queries.
        """
        best = np.full((len(queries), k), np.inf)
        names = np.full((len(queries), k), np.iinfo(np.int64).max)
        reach = np.full(len(queries), np.inf) if within is None else within.copy()

        def apart(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
            d = np.zeros((len(who), len(rows)))
            for j in range(queries.shape[1]):  # in the order of components, so that sums are those of any plain loop
                d += (queries[who, j, None] - self.points[rows, j]) ** 2
            d = np.sqrt(d)
            d[own[who, None] == self.ids[rows]] = np.inf
            return d

        repeats = len(np.unique(self.ids)) < len(self.ids)  # then a leaf may hold fewer than its rows' number of ids

        def home(node, who: np.ndarray) -> None:
            if not len(who) or repeats:
                return
            if isinstance(node, np.ndarray):
                if len(node) >= k:
                    reach[who] = np.minimum(reach[who], np.partition(apart(who, node), k - 1, axis=1)[:, k - 1])
                return
            vantage, middle, inner, outer, _, _ = node
            near = np.sqrt(((queries[who] - self.points[vantage]) ** 2).sum(1)) <= middle
            home(inner, who[near])
            home(outer, who[~near])

        def offer(who: np.ndarray, rows: np.ndarray) -> None:
            d = apart(who, rows)
            all_d = np.hstack([best[who], d])
            all_n = np.hstack([names[who], np.broadcast_to(self.ids[rows], d.shape)])
            all_n[np.isinf(all_d)] = np.iinfo(np.int64).max
            if repeats:  # of an id's vectors only the nearest counts
                order = np.lexsort((all_d, all_n), axis=1)
                all_d, all_n = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_n, order, 1)
                again = np.c_[np.zeros(len(all_n), bool), all_n[:, 1:] == all_n[:, :-1]]
                all_d[again], all_n[again] = np.inf, np.iinfo(np.int64).max
            order = np.lexsort((all_n, all_d), axis=1)[:, :k]
            best[who] = np.take_along_axis(all_d, order, 1)
            names[who] = np.take_along_axis(all_n, order, 1)
            reach[who] = np.minimum(reach[who], best[who, -1])

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if isinstance(node, np.ndarray):
                if len(node):
                    offer(who, node)
                return
            vantage, _, inner, outer, most, least = node
            d = np.sqrt(((queries[who] - self.points[vantage]) ** 2).sum(1))
            slack = 1e-9 * (1 + d)
            offer(who, np.array([vantage]))
            visit(inner, who[d - most - slack <= reach[who] / factor])
            visit(outer, who[least - d - slack <= reach[who] / factor])

        home(self.root, np.arange(len(queries)))
        visit(self.root, np.arange(len(queries)))
        return best, names


#: Regions at most, whatever the number of shards, and bytes of vectors in the sample that they are fitted on.
MOST_REGIONS, SAMPLE_BYTES = 4096, 16 << 20


class Regions:
    """The upper levels of a vantage-point tree: nodes (vantage point, median, two children), regions as numbers."""

    def __init__(self, points: np.ndarray, regions: int, seed: int = 0):
        self.random, self.size = np.random.default_rng(seed), 0
        self.root = self._node(points, regions)

    def _node(self, points: np.ndarray, regions: int):
        if regions > 1 and len(points) > 3:
            vantage = points[int(self.random.integers(len(points)))]
            far = np.sqrt(((points - vantage) ** 2).sum(1))
            middle = float(np.median(far))
            if 0 < (far <= middle).sum() < len(points):
                return vantage, middle, self._node(points[far <= middle], regions // 2), self._node(points[far > middle], regions - regions // 2)
        self.size += 1
        return self.size - 1

    def of(self, points: np.ndarray) -> np.ndarray:
        """The region that each point belongs in."""
        out = np.zeros(len(points), np.int32)

        def down(node, who: np.ndarray) -> None:
            if isinstance(node, int):
                out[who] = node
            elif len(who):
                near = np.sqrt(((points[who] - node[0]) ** 2).sum(1)) <= node[1]
                down(node[2], who[near])
                down(node[3], who[~near])

        down(self.root, np.arange(len(points)))
        return out

    def open(self, points: np.ndarray, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(point, region) of the regions that may hold something within ``reach / factor`` of a point."""
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def down(node, who: np.ndarray) -> None:
            if isinstance(node, int):
                found.append((who, np.full(len(who), node, np.int32)))
            elif len(who):
                d = np.sqrt(((points[who] - node[0]) ** 2).sum(1))
                slack = 1e-9 * (1 + d)
                down(node[2], who[d - node[1] - slack <= reach[who] / factor])
                down(node[3], who[node[1] - d - slack <= reach[who] / factor])

        down(self.root, np.arange(len(points)))
        who, region = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        return who, region


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of rows with an id and a finite vector that is not zero."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def fitted(rows: DataFrame, shards: int) -> dict[int, Regions]:
    """Regions of each length of vectors in a sample of SAMPLE_BYTES, the first rows in the order of a hash; vectors of
    lengths that are not in it are one region."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    sample = rows.orderBy(F.xxhash64("vec_id", "v")).limit(max(64, SAMPLE_BYTES // (8 * width))).select("v").toPandas()["v"]
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    return {n: Regions(np.array(vs, float), min(MOST_REGIONS, shards)) for n, vs in by.items()}


def placed(rows: DataFrame, held) -> DataFrame:
    """``rows`` with ``width`` and ``region``."""

    @F.pandas_udf("int")
    def region(vectors: pd.Series) -> pd.Series:
        out, sizes = np.zeros(len(vectors), np.int32), vectors.map(len).to_numpy()
        for width in np.unique(sizes):
            if width in held.value:
                out[sizes == width] = held.value[width].of(np.array(vectors[sizes == width].tolist(), float))
        return pd.Series(out)

    return rows.withColumn("width", F.size("v")).withColumn("region", region("v"))


def trees(rows: DataFrame, shard_rows: int) -> DataFrame:
    """(width, region, shard, path): a tree per shard of rows (vec_id, v, width, region), in a file of the shared folder."""
    folder = new_path(rows.sparkSession, "trees")

    def build(points: pd.DataFrame) -> pd.DataFrame:
        where, top = opened(folder)
        where.create_dir(top, recursive=True)
        p, name = points.sort_values("vec_id", kind="stable"), f"{uuid.uuid4().hex}.npz"
        with where.open_output_stream(f"{top}/{name}") as sink:
            sink.write(VantageTree(p["vec_id"].to_numpy(), np.array(p["v"].tolist(), float)).packed())
        return p[["width", "region", "shard"]].head(1).assign(path=f"{folder}/{name}")

    sizes = rows.groupBy("width", "region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int").alias("shard")
    dealt = rows.join(sizes, ["width", "region"]).select("vec_id", "v", "width", "region", shard)
    return written(dealt.groupBy("width", "region", "shard").applyInPandas(build, "width int, region int, shard int, path string"), "trees")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16384, block_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``.

    Defined cases: rows with a null id, and vectors that are null, zero or hold null or non-finite components, take no
    part; vectors only meet vectors of their own length; rows repeating an id and vector count once, and an id with
    several vectors has each of them as a candidate and asks with each, a candidate's distance being the least; fewer
    candidates than k give fewer rows; an empty table gives an empty table; other columns play no part.
    """
    rows = written(usable(vectors, id_col, vector_col).distinct(), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    held = rows.sparkSession.sparkContext.broadcast(fitted(rows, shards))  # MOST_REGIONS vectors for each length, of SAMPLE_BYTES in all
    here = placed(rows, held)
    made = trees(here, shard_rows)
    asked = here.filter(F.col("vec_id") % every == 0)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, tree = None, None
        for batch in batches:
            for path, part in batch.groupby("path", sort=False):
                if path != name:
                    where, file = opened(path)
                    with where.open_input_file(file) as source:
                        name, tree = path, VantageTree.unpacked(source.read())
                for at in range(0, len(part), block_rows):
                    block = part.iloc[at : at + block_rows]
                    own = block["vec_id"].to_numpy()
                    best, names = tree.search(np.array(block["v"].tolist(), float), own, k, factor, block["reach"].to_numpy(float))
                    found = pd.DataFrame({"query_id": np.repeat(own, k), "vec_id": names.ravel(), "score": best.ravel()})
                    yield found[np.isfinite(found["score"])]

    def searched(queries: DataFrame) -> DataFrame:
        # a shard's queries are dealt in runs by a hash, so that few shards still keep many tasks busy
        sent = queries.join(made, ["width", "region"]).withColumn("run", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, 64 // shards))))
        sent = sent.select("path", "run", "vec_id", "v", "reach").repartition("path", "run").sortWithinPartitions("path")
        found = sent.mapInPandas(search, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = ranked(searched(asked.withColumn("reach", F.lit(float("inf")))))
    if all(regions.size == 1 for regions in held.value.values()):
        return first
    first = written(first, "nearest-at-home")
    reach = first.groupBy("query_id").agg(F.count("*").alias("_n"), F.max("score").alias("_far")).filter(F.col("_n") == k).select("query_id", "_far")
    told = asked.join(reach, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "width", "region", F.coalesce("_far", F.lit(float("inf"))).alias("reach"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part in batch.groupby("width"):
                if width in held.value:
                    part = part.reset_index(drop=True)
                    who, region = held.value[width].open(np.array(part["v"].tolist(), float), part["reach"].to_numpy(float), factor)
                    out = part.iloc[who].assign(home=part["region"].to_numpy()[who], region=region)
                    yield out[out["home"] != out["region"]].drop(columns="home")

    second = searched(told.mapInPandas(others, "vec_id long, v array<double>, width int, region int, reach double"))
    both = first.select("query_id", "vec_id", "score").union(second).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return ranked(both)


ORACLE = """
with v as (select vec_id, embedding::double[] as e from embeddings),
d as (select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""
