"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned so that their coordinates come in
the order of variance. A k-d tree over the leading coordinates, fitted on a
bounded sample (SAMPLE rows), cuts the space into leaves; every vector has a
home leaf and is a guest in each leaf whose box is nearer than the chord of the
threshold, so that no pair within reach is missed. The home rows of a leaf are
split into tiles of TILE rows, all its rows, home and guest, into tiles of
OTHER_TILE rows, and each of the former meets each of the latter in a task of its
own: a hot leaf becomes more tasks, not a larger one. Within a task, leading coordinates are multiplied first; the rest of
a product is bounded by the norms of the suffixes, and pairs that cannot reach
the threshold any more are dropped, blocks without such a pair at once. What
remains is decided by the cosine of the vectors as given, in double precision.

Equal vectors are compared once, with their number as weight. Tasks report how
many vectors each home row is linked to, and edges that span the pairs they
found, so nothing of the size of all pairs leaves them.

Defined results: vectors that are null or empty, have length zero, or hold null
or non-finite components link with nothing; vectors of different lengths do not
link; repeated rows link as any others; a null vec_id counts as a vector and is
never a component's smallest id unless all its ids are null (then null, and not
kept). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import store
from tidemark.llm.components import components

THRESHOLD = 0.9
SAMPLE = 50_000
TILE = 16_384
OTHER_TILE = 16_384
LEADING = 8
#: Share of the squared length that is left to the suffixes where the bound is first tried.
REST = 0.62
#: A block whose share of pairs within reach is below 1 / FEW is decided pair by pair, DECIDED pairs at a time.
FEW = 2_000
DECIDED = 1 << 15
SLACK = 1e-9


def _units(rows: np.ndarray) -> np.ndarray:
    scaled = _level(rows)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _level(rows: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which changes no digit, so that their squares neither overflow nor vanish."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _turn(distinct: DataFrame, dim: int) -> np.ndarray:
    """The principal axes of the unit vectors of length ``dim``, by falling variance, from sums over all rows."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            if len(batch):
                unit = np.hstack([np.ones((len(batch), 1)), _units(_matrix(batch["vector"]))])
                total += unit.T @ unit
        yield pd.DataFrame({"i": np.arange(total.size), "x": total.ravel()})

    rows = distinct.where(F.size("vector") == dim).select("vector").mapInPandas(sums, "i int, x double")
    total = np.zeros((dim + 1) ** 2)
    for i, x in rows.groupBy("i").agg(F.sum("x")).collect():  # (dim + 1)**2 numbers
        total[i] = x
    total = total.reshape(dim + 1, dim + 1) / max(total[0], 1)
    mean = total[0, 1:]
    values, axes = np.linalg.eigh(total[1:, 1:] - np.outer(mean, mean))
    return axes[:, np.argsort(-values)]


def _tree(sample: np.ndarray, leaf: int, deep: int) -> list:
    """Nodes (axis, value, left, right); leaves (-1, number, 0, 0)."""
    nodes: list = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        axis = int(np.argmax(spread))
        value = float(np.median(rows[:, axis])) if len(rows) > 1 else 0.0
        low = rows[:, axis] < value if len(rows) else np.zeros(0, bool)
        if depth == deep or len(rows) <= leaf or not low.any():
            nodes[at] = (-1, at, 0, 0)
        else:
            nodes[at] = (axis, value, grow(rows[low], depth + 1), grow(rows[~low], depth + 1))
        return at

    grow(sample, 0)
    return nodes


def _reached(nodes: list, points: np.ndarray, reach: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indices, home): the points whose distance to the leaf's box is ``reach`` or less."""
    todo = [(0, np.arange(len(points)), np.zeros(points.shape), np.ones(len(points), bool))]
    while todo:
        at, index, gap, home = todo.pop()
        axis, value, left, right = nodes[at]
        if axis < 0:
            if len(index):
                yield at, index, home
            continue
        x = points[index, axis]
        for child, inside in ((left, x < value), (right, x >= value)):
            far = gap.copy()
            far[:, axis] = np.where(inside, gap[:, axis], np.maximum(gap[:, axis], np.abs(x - value)))
            near = (far * far).sum(axis=1) <= reach * reach
            todo.append((child, index[near], far[near], (home & inside)[near]))


def _placed(distinct: DataFrame, dim: int, axes: np.ndarray, nodes: list, reach: float) -> DataFrame:
    """row, vector, weight, leaf, home: each vector once for every leaf it belongs to."""
    shared = distinct.sparkSession.sparkContext.broadcast((axes, nodes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        axes, nodes = shared.value
        for batch in batches:
            same = (batch["vector"].map(len) == dim).to_numpy()
            other = batch[~same]
            if len(other):
                yield other.assign(leaf=-other["vector"].map(len), home=True)
            batch = batch[same]
            if len(batch):
                points = _units(_matrix(batch["vector"])) @ axes[:, :LEADING]
                for leaf, index, home in _reached(nodes, points, reach):
                    yield batch.iloc[index].assign(leaf=leaf, home=home)

    return distinct.select("row", "vector", "weight").mapInPandas(run, "row bigint, vector array<double>, weight bigint, leaf int, home boolean")


def _stops(unit: np.ndarray, dim: int) -> list[int]:
    """After how many coordinates the bound is tried: where REST of the squared length is left, and at doubled numbers."""
    left = 1 - np.cumsum((unit * unit).mean(axis=0))
    first = int(np.argmax(left <= REST)) + 1
    return [*(s for s in (first << k for k in range(dim.bit_length())) if s < dim), dim]


def _parts(unit: np.ndarray, stops: list[int], sign: int) -> list[np.ndarray]:
    """The coordinates before each stop, beside the norm of the suffix there and, signed, of the suffix they take the place of.

    A product of two such rows, summed up to a stop, bounds the whole product.
    """
    norm = lambda at: np.sqrt((unit[:, at:] ** 2).sum(axis=1, keepdims=True))
    out = []
    for first, last in zip([0, *stops[:-1]], stops, strict=True):
        part = [unit[:, first:last], norm(last), *([sign * norm(first)] if first else [])]
        out.append(np.hstack(part).astype(np.float32))
    return out


def _close(a: list[np.ndarray], b: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose product may reach ``least``, from the parts of both sides; few pairs left end the sum early."""
    bound = np.zeros((1, 1), np.float32)
    for x, y in zip(a, b, strict=True):
        bound = bound + x @ y.T
        alive = bound >= least
        if np.count_nonzero(alive) * FEW < alive.size:
            break
    return np.nonzero(alive)


def _hooked(top: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The forest ``top`` (roots of all nodes) with the pairs (p, q) joined, and the (root, smaller root) edges that did it."""
    edges = []
    while True:
        p, q = top[p], top[q]
        apart = p != q
        p, q = p[apart], q[apart]
        if not len(p):
            return top, edges
        high = np.maximum(p, q)
        np.minimum.at(top, high, np.minimum(p, q))
        high = np.unique(high)
        edges.append(np.stack([high, top[high]]))
        while not np.array_equal(top, up := top[top]):
            top = up


def _compare(home: pd.DataFrame, other: pd.DataFrame, axes: np.ndarray | None, threshold: float) -> Iterator[pd.DataFrame]:
    """Links of the home rows of one tile with the rows of another: (row, n) counts, and edges (row, to) that span them."""
    given_a, given_b = _level(_matrix(home["vector"])), _level(_matrix(other["vector"]))
    a, b = (_units(x) if axes is None else _units(x) @ axes for x in (given_a, given_b))
    dim = a.shape[1]
    stops = _stops(a, dim)
    a, b = _parts(a, stops, -1), _parts(b, stops, 1)
    least = threshold - SLACK - (dim + 3 * len(stops)) * 2.0**-22  # of the rounding to single precision
    size_a, size_b = (np.sqrt((x * x).sum(axis=1)) for x in (given_a, given_b))
    weight, ids_a, ids_b = other["weight"].to_numpy(), home["row"].to_numpy(), other["row"].to_numpy()
    ids, node = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    node_a, node_b = node[: len(ids_a)], node[len(ids_a) :]
    counts = np.zeros(len(ids_a), np.int64)
    top, edges = np.arange(len(ids)), []
    for i in range(0, len(ids_a), 1024):
        for j in range(0, len(ids_b), 1024):
            left, right = _close([x[i : i + 1024] for x in a], [x[j : j + 1024] for x in b], least)
            for at in range(0, len(left), DECIDED):
                x, y = left[at : at + DECIDED] + i, right[at : at + DECIDED] + j
                cosine = (given_a[x] * given_b[y]).sum(axis=1) / (size_a[x] * size_b[y])
                keep = (cosine >= threshold) & (node_a[x] != node_b[y])
                x, y = x[keep], y[keep]
                np.add.at(counts, x, weight[y])
                top, new = _hooked(top, node_a[x], node_b[y])
                edges += new
    hit = np.flatnonzero(counts)
    yield pd.DataFrame({"row": ids_a[hit], "n": counts[hit], "to": np.full(len(hit), -1)})
    if edges:
        rows, to = ids[np.concatenate(edges, axis=1)]
        yield pd.DataFrame({"row": rows, "n": np.zeros(len(rows), np.int64), "to": to})


def _links(placed: DataFrame, dim: int, axes: np.ndarray, threshold: float) -> DataFrame:
    shared = placed.sparkSession.sparkContext.broadcast(axes)
    # A leaf's home rows and all its rows are cut apart from each other: a row moves once for every tile of the other side.
    tiles = lambda rows, size: F.greatest(F.ceil(rows / size), F.lit(1)).cast("int")
    sizes = placed.groupBy("leaf").agg(tiles(F.count_if("home"), TILE).alias("homes"), tiles(F.count("*"), OTHER_TILE).alias("others"))
    tiled = placed.join(sizes, "leaf")
    home, other = (F.pmod(F.hash("row"), F.col(n)) for n in ("homes", "others"))
    each_home, each_other = (F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("homes", "others"))
    left = tiled.where("home").select("leaf", home.alias("tile"), each_other.alias("with"), "row", "vector", "weight", F.lit(True).alias("home"))
    right = tiled.select("leaf", each_home.alias("tile"), other.alias("with"), "row", "vector", "weight", F.lit(False).alias("home"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        home, other = rows[rows["home"]], rows[~rows["home"]]
        found = [pd.DataFrame({"row": [], "n": [], "to": []}, dtype="int64")]
        if len(home) and len(other):
            found += _compare(home, other, shared.value if key[0] >= 0 else None, threshold)
        return pd.concat(found)

    return left.unionAll(right).groupBy("leaf", "tile", "with").applyInPandas(run, "row bigint, n bigint, to bigint")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    # -0.0 equals 0.0 as a component
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    able = F.coalesce(finite & F.exists("vector", lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))
    distinct = store(
        rows.where(able)
        .groupBy("vector")
        .agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
        .withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    )
    dims = distinct.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dim, n = dims
    axes = _turn(distinct, dim)
    share = min(1.0, SAMPLE / n)
    picked = distinct.where((F.size("vector") == dim) & (F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < share * (1 << 20)))
    leading = axes[:, :LEADING]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"x": list(_units(_matrix(batch["vector"])) @ leading)})

    sample = picked.select("vector").mapInPandas(project, "x array<double>").toPandas()  # SAMPLE rows of LEADING numbers
    points = np.array(sample["x"].tolist()).reshape(len(sample), -1) if len(sample) else np.zeros((0, leading.shape[1]))
    deep = max(0, int(np.ceil(np.log2(n / TILE)))) if n > TILE else 0
    nodes = _tree(points, 16, deep)
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    found = store(_links(_placed(distinct, dim, axes, nodes, reach), dim, axes, threshold), "links")
    roots = components(found.where("to >= 0").select(F.col("row").alias("a"), F.col("to").alias("b")))
    counts = found.where("to < 0").groupBy("row").agg(F.sum("n").alias("n"))
    members = store(
        distinct.join(roots.withColumnRenamed("node", "row"), "row", "left")
        .join(counts, "row", "left")
        .select("vector", "low", F.coalesce("root", "row").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")),
        "members",
    )
    lowest = members.groupBy("root").agg(F.min("low").alias("component_id"))
    named = members.join(lowest, "root").select("vector", "n_links", "component_id", F.lit(True).alias("known"))
    out = rows.join(named, "vector", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.cast("bigint").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
