"""Vectors: normalisation, clustering, quality of clusterings, projections."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operators on all pairs hold a distance matrix of so many points at most; more
#: go ways whose memory grows with the points, all of them still.
MAX_POINTS = 5_000
#: Distances of a block of such ways.
BLOCK = 4_000_000
#: The exact Euclidean silhouette compares each block with so many points at most.
MAX_SILHOUETTE = 20_000


def norm(v: Column, p: int) -> Column:
    if p == 1:
        return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalize(df: DataFrame, p: int, vector: str = "features") -> DataFrame:
    """Rows over their L1 or L2 norm; zero rows stay. The norm is bound once for
    each row, as it would be worked out for every element otherwise."""
    v = F.col(vector)
    scaled = F.transform(F.array(norm(v, p)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))
    return df.withColumn(vector, F.element_at(scaled, 1))


def moments(df: DataFrame, vector: str = "features") -> DataFrame:
    """dim, mean, std (of the population), a row per dimension."""
    return df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def standardize(df: DataFrame, vector: str = "features") -> DataFrame:
    """Mean 0 and variance 1 (over n) in each dimension; constant ones become 0."""
    found = {r["dim"]: (r["mean"], r["std"]) for r in moments(df, vector).collect()}  # one row per dimension
    if not found:
        return df
    mean = F.array(*(F.lit(float(found[k][0])) for k in range(len(found))))
    scale = F.array(*(F.lit(float(found[k][1] or 1.0)) for k in range(len(found))))
    centred = F.zip_with(vector, mean, lambda x, m: x - m)
    return df.withColumn(vector, F.zip_with(centred, scale, lambda x, s: x / s))


def squared_distance(v: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(v, w, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)


def constant(rows: list[list[float]]) -> Column:
    """Rows of numbers as one literal, so that plans don't grow with them."""
    return F.from_json(F.lit(json.dumps(rows)), "array<array<double>>")


def nearest(df: DataFrame, centroids: list[list[float]], vector: str = "features") -> DataFrame:
    """Adds cluster and dist2: the nearest centroid, the first of equals."""
    rows = constant([[float(x) for x in c] for c in centroids])
    best = F.array_min(F.transform(rows, lambda c, k: F.struct(squared_distance(F.col(vector), c).alias("dist2"), k.alias("cluster"))))
    return df.withColumn("__best", best).withColumn("cluster", F.col("__best.cluster")).withColumn("dist2", F.col("__best.dist2")).drop("__best")


def centroids_of(assigned: DataFrame, vector: str = "features") -> DataFrame:
    """cluster, centroid: per-dimension means, combined before the shuffle."""
    tall = assigned.select("cluster", F.posexplode(vector).alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("x"))
    return tall.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"))


def lloyd(df: DataFrame, centroids: list[list[float]], steps: int, vector: str = "features") -> tuple[DataFrame, list[list[float]]]:
    """Assignments and centroids after ``steps`` updates from given centroids;
    an empty cluster keeps its centroid. Only centroids reach the driver."""
    for _ in range(steps):
        found = {r["cluster"]: list(r["centroid"]) for r in centroids_of(nearest(df, centroids, vector), vector).collect()}
        centroids = [found.get(k, c) for k, c in enumerate(centroids)]
    return nearest(df, centroids, vector), centroids


def kmeans(df: DataFrame, k: int = 8, restarts: int = 10, max_iter: int = 100, seed: int = 104, vector: str = "features") -> tuple[DataFrame, list[list[float]], float]:
    """Best of several starts by inertia: assignments (cluster), centroids, inertia.
    Clusters are numbered in the order of their centroids."""
    rows = df.withColumn("__vec", array_to_vector(vector)).persist()
    try:
        best = None
        for s in range(seed, seed + restarts):
            model = KMeans(k=k, maxIter=max_iter, initMode="k-means||", seed=s, featuresCol="__vec", predictionCol="__cluster").fit(rows)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
    finally:
        rows.unpersist()
    centers = sorted([float(x) for x in c] for c in best.clusterCenters())
    assigned = nearest(df, centers, vector)
    return assigned, centers, float(best.summary.trainingCost)


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("dist2").alias("inertia"))


def cluster_sizes(df: DataFrame, label: str) -> list[tuple[int, int]]:
    return [(r[label], r["n"]) for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()]


def silhouette_cosine(df: DataFrame, key: str, label: str, vector: str = "features") -> DataFrame:
    """key, silhouette under cosine distance, exactly and without pairs: the
    mean cosine to a cluster is the product with its mean unit vector."""
    unit = normalize(df.select(key, F.col(label).alias("cluster"), vector), 2, vector)
    sizes = dict(cluster_sizes(unit, "cluster"))
    if not 2 <= len(sizes) <= sum(sizes.values()) - 1:
        raise ValueError("a silhouette needs two clusters at least, and fewer than points")
    means = {r["cluster"]: [float(x) for x in r["centroid"]] for r in centroids_of(unit, vector).collect()}
    labels, dot = list(sizes), lambda v, w: F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    number = F.array_position(F.lit(labels), F.col("cluster")).cast("int") - 1
    scored = unit.select(key, number.alias("own"), F.transform(constant([means[c] for c in labels]), lambda w: dot(F.col(vector), w)).alias("dots"), dot(F.col(vector), F.col(vector)).alias("self"))
    size = F.get(F.lit([float(n) for n in sizes.values()]), F.col("own"))
    mean_own = (size - F.get("dots", F.col("own")) * size - (1 - F.col("self"))) / F.greatest(size - 1, F.lit(1.0))
    others = F.transform("dots", lambda d, k: F.when(k != F.col("own"), 1 - d))
    a, b = F.col("a"), F.col("b")
    return scored.select(key, mean_own.alias("a"), F.array_min(others).alias("b"), (size == 1).alias("alone")).select(key, F.when(F.col("alone"), 0.0).otherwise((b - a) / F.greatest(a, b)).alias("silhouette"))


def silhouette_euclidean(df: DataFrame, key: str, label: str, vector: str = "features", most: int = MAX_SILHOUETTE) -> DataFrame:
    """key, silhouette under Euclidean distance, exactly: rows in Arrow batches
    against the whole set, which is held by every worker and so is bounded."""
    sizes = cluster_sizes(df, label)
    n = sum(c for _, c in sizes)
    if n > most:
        raise ValueError(f"{n} points; the exact silhouette takes {most} at most")
    if not 2 <= len(sizes) <= n - 1:
        raise ValueError("a silhouette needs two clusters at least, and fewer than points")
    number = {c: k for k, (c, _) in enumerate(sizes)}
    rows = df.select(F.col(label).alias("c"), F.col(vector).alias("v")).toPandas()
    points, of = np.array(rows["v"].tolist(), float), rows["c"].map(number).to_numpy()
    shared = df.sparkSession.sparkContext.broadcast((points, of))
    count = np.array([c for _, c in sizes], float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, of = shared.value
        squares = (points * points).sum(1)
        member = np.eye(len(count))[of]
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                x = np.array(part["v"].tolist(), float)
                mine = part["c"].map(number).to_numpy()
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + squares[None] - 2 * x @ points.T, 0.0))
                d[d < 1e-7] = 0.0  # what is left of a point's distance to itself
                total = d @ member
                i = np.arange(len(part))
                a = total[i, mine] / np.maximum(count[mine] - 1, 1)
                mean = total / count
                mean[i, mine] = np.inf
                b = mean.min(1)
                yield pd.DataFrame({"key": part["key"], "silhouette": np.where(count[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)})

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType().add("key", df.schema[key].dataType).add("silhouette", DoubleType())
    return df.select(F.col(key).alias("key"), F.col(label).alias("c"), F.col(vector).alias("v")).mapInPandas(run, schema).withColumnRenamed("key", key)


def pca(df: DataFrame, k: int, vector: str = "features", extra: list[list[float]] | None = None) -> tuple[DataFrame, list[list[float]], np.ndarray]:
    """Adds ``pcs`` (k coordinates) to the rows; those of ``extra`` points under
    the same mean; and the components [k, d], each with its largest loading
    positive."""
    vec = df.withColumn("__vec", array_to_vector(vector))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="__vec", outputCol="__mid").fit(vec)
    model = PCA(k=k, inputCol="__mid", outputCol="__pcs").fit(scaler.transform(vec))
    axes = model.pc.toArray().T
    sign = np.sign(axes[np.arange(k), np.abs(axes).argmax(1)])
    axes = axes * sign[:, None]
    flip = F.array(*(F.lit(float(s)) for s in sign))
    out = model.transform(scaler.transform(vec)).withColumn("pcs", F.zip_with(vector_to_array("__pcs"), flip, lambda x, s: x * s)).drop("__vec", "__mid", "__pcs")
    mean = scaler.mean.toArray()
    return out, [((np.asarray(e, float) - mean) @ axes.T).tolist() for e in extra or []], axes


def members(df: DataFrame, label: str, name: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("cluster")).agg(F.array_sort(F.collect_list(name)).alias("members"))


def sample_members(df: DataFrame, label: str, name: str, n: int, seed: int = 104, draw: Column | None = None) -> DataFrame:
    """Up to n members of each cluster, without replacement, the same each time;
    in the order of ``draw``, a hash of the name unless given."""
    turn = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.col(name), F.lit(seed)) if draw is None else draw, name))
    return df.withColumn("__turn", turn).filter(F.col("__turn") <= n).drop("__turn")


def extremes(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.agg(F.min_by(name, F.struct(value, name)).alias("lowest"), F.max_by(name, F.struct(F.col(value), -F.col(name))).alias("highest"))


def _one_group(df: DataFrame, key: str, vector: str, fn, schema: str) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", ignore_index=True)
        return fn(frame["key"], np.array(frame["v"].tolist(), float))

    return df.select(F.col(key).alias("key"), F.col(vector).alias("v")).groupBy().applyInPandas(run, schema).withColumnRenamed("key", key)


def upgma(d: np.ndarray, k: int) -> np.ndarray:
    """Average-linkage clusters of a distance matrix, numbered by first member."""
    d = d.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, of, live = np.ones(n), np.arange(n), n
    while live > max(1, k):
        i, j = np.unravel_index(int(np.argmin(d)), d.shape)
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        of[of == j] = i
        live -= 1
    return np.unique(of, return_inverse=True)[1]


def upgma_cosine(u: np.ndarray, k: int) -> np.ndarray:
    """As :func:`upgma` of the cosine distances of unit (or zero) rows, without
    their matrix: the mean distance of two clusters is one less the product of
    their means. Clusters that are each other's nearest are joined, all such
    pairs at once, as that gives the same tree; its lowest joins are kept."""
    n = len(u)
    joins: list[tuple[float, int, int]] = []
    _, first, of = np.unique(u, axis=0, return_index=True, return_inverse=True)
    lead = first[of.ravel()]
    lead = np.where(u.any(1), lead, np.arange(n))  # zero rows are at distance 1 of each other
    joins += [(0.0, int(i), int(j)) for j, i in enumerate(lead) if i != j]
    size = np.bincount(lead, minlength=n).astype(float)
    mean, near, gap, top = u.astype(float), np.full(n, -1), np.full(n, np.inf), np.zeros(n)
    live = np.unique(lead)
    stale = live
    while len(live) > 1:
        others, step = mean[live], max(1, BLOCK // len(live))
        for at in range(0, len(stale), step):
            part = stale[at : at + step]
            d = 1 - mean[part] @ others.T
            d[np.arange(len(part)), np.searchsorted(live, part)] = np.inf
            j = d.argmin(1)
            near[part], gap[part] = live[j], d[np.arange(len(part)), j]
        i = live[(near[near[live]] == live) & (live < near[live])]
        if not len(i):  # rounding parted a tie
            i = live[[gap[live].argmin()]]
        j = near[i]
        i, j, height = np.minimum(i, j), np.maximum(i, j), gap[i]
        top[i] = np.maximum(height, np.maximum(top[i], top[j]))
        joins += zip(top[i].tolist(), i.tolist(), j.tolist(), strict=True)
        both = size[i] + size[j]
        mean[i] = (mean[i] * size[i][:, None] + mean[j] * size[j][:, None]) / both[:, None]
        size[i], size[j] = both, 0
        changed = np.zeros(n, bool)
        changed[i] = changed[j] = True
        live = live[size[live] > 0]
        stale = live[changed[live] | changed[near[live]]]
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for _, i, j in sorted(joins, key=lambda x: x[0])[: max(0, n - max(1, k))]:
        i, j = sorted((find(i), find(j)))
        root[j] = i
    return np.unique([find(x) for x in range(n)], return_inverse=True)[1]


def agglomerative(df: DataFrame, k: int, key: str, vector: str = "features", metric: str = "cosine") -> DataFrame:
    """Average linkage, in one task. Beyond ``MAX_POINTS`` the cosine needs no
    matrix; for the Euclidean distance it is made all the same."""
    most = MAX_POINTS

    def fn(keys: pd.Series, x: np.ndarray) -> pd.DataFrame:
        if metric == "cosine":
            length = np.linalg.norm(x, axis=1, keepdims=True)
            u = x / np.where(length > 0, length, 1)
            if len(x) > most:
                return pd.DataFrame({"key": keys, "cluster": upgma_cosine(u, k).astype("int32")})
            d = 1 - u @ u.T
        else:
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
        return pd.DataFrame({"key": keys, "cluster": upgma(d, k).astype("int32")})

    return _one_group(df, key, vector, fn, "key long, cluster int")


def affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Shares of the neighbours in each row of squared distances (infinite: none),
    with bandwidths of that perplexity."""
    n = len(d)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    d = d - d.min(1)[:, None]
    for _ in range(64):  # bandwidths, all points at once
        e = np.exp(-d * beta[:, None])
        p = e / e.sum(1, keepdims=True)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return p


def neighbours(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m nearest others of each row, and their squared distances, exactly."""
    n, squares = len(x), (x * x).sum(1)
    at, gap = np.empty((n, m), np.int64), np.empty((n, m))
    step = max(1, BLOCK // n)
    for a in range(0, n, step):
        part = np.arange(a, min(n, a + step))
        d = np.maximum(squares[part][:, None] + squares[None] - 2 * x[part] @ x.T, 0)
        d[np.arange(len(part)), part] = np.inf
        at[part] = np.argpartition(d, m - 1, axis=1)[:, :m]
        gap[part] = np.take_along_axis(d, at[part], 1)
    return at, gap


#: Grid sizes of :func:`repulsion`, and its spacing while the largest suffices.
GRIDS, SPACING = (64, 96, 128, 192, 256, 320, 384, 432, 512, 640, 768, 1024), 0.4


def repulsion(y: np.ndarray, kernels: dict) -> tuple[np.ndarray, float]:
    """Sums over all others of q * q * (y - other) and of q, 1 / (1 + distance**2),
    by cubic interpolation on a grid and its Fourier transform."""
    low = y.min(0)
    span, h = float((y - low).max()), SPACING
    while span / h + 4 > GRIDS[-1]:
        h *= 1.1
    size = next(g for g in GRIDS if span / h + 4 <= g)
    if (size, h) not in kernels:
        kernels.clear()
        away = h * np.minimum(np.arange(2 * size), 2 * size - np.arange(2 * size))
        q = (1 / (1 + away[:, None] ** 2 + away[None] ** 2)).astype(np.float32)
        kernels[size, h] = np.fft.rfft2(q), np.fft.rfft2(q * q)
    place = (y - low) / h
    cell = np.floor(place).astype(np.int64)
    t = (place - cell).T
    w = np.stack([-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6], 2)
    weight = (w[0][:, :, None] * w[1][:, None, :]).reshape(len(y), 16)
    node = ((cell[:, 0, None] + np.arange(4))[:, :, None] * size + (cell[:, 1, None] + np.arange(4))[:, None, :]).reshape(len(y), 16)

    def spectrum(charge: np.ndarray) -> np.ndarray:
        held = np.bincount(node.ravel(), (weight * charge[:, None]).ravel(), size * size)
        return np.fft.rfft2(held.reshape(size, size).astype(np.float32), (2 * size, 2 * size))

    def potential(f: np.ndarray) -> np.ndarray:
        return (np.fft.irfft2(f, (2 * size, 2 * size))[:size, :size].ravel()[node] * weight).sum(1)

    one, two = kernels[size, h]
    mid = y - y.mean(0)
    count = spectrum(np.ones(len(y)))
    moved = np.stack([potential(spectrum(mid[:, c]) * two) for c in (0, 1)], 1)
    return mid * potential(count * two)[:, None] - moved, float(potential(count * one).sum() - len(y))


def embed_many(x: np.ndarray, perplexity: float = 30.0, iterations: int = 1000) -> np.ndarray:
    """As :func:`embed` for many points: affinities of the 3 * perplexity nearest
    neighbours, found exactly, and the repulsion of all points by a grid, so that
    memory and the time of a step grow with the points, not their pairs."""
    n = len(x)
    at, d = neighbours(x, min(n - 1, int(3 * perplexity) + 1))
    p = affinities(d, perplexity) / (2 * n)
    y, kernels, flat = started(x), {}, at.ravel()
    rate, move, gain = max(n / 12.0 / 4, 50.0), np.zeros_like(y), np.ones_like(y)
    for t in range(iterations):
        away, total = repulsion(y, kernels)
        dx, dy = y[:, 0, None] - y[:, 0][at], y[:, 1, None] - y[:, 1][at]
        w = (12.0 if t < 250 else 1.0) * p / (1 + dx * dx + dy * dy)
        pull = np.stack([(f := w * c).sum(1) - np.bincount(flat, f.ravel(), n) for c in (dx, dy)], 1)
        g = 4 * (pull - away / max(total, 1e-12))
        gain = np.maximum(np.where(np.sign(g) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if t < 250 else 0.8) * move - rate * gain * g
        y = y + move
    return y - y.mean(0)


def started(x: np.ndarray) -> np.ndarray:
    """The first two principal components, very small."""
    mid = x - x.mean(0)
    u, s, vt = np.linalg.svd(mid, full_matrices=False)
    sign = np.sign(vt[:2][np.arange(2), np.abs(vt[:2]).argmax(1)])
    y = u[:, :2] * s[:2] * sign
    return y / y[:, 0].std() * 1e-4


def embed(x: np.ndarray, perplexity: float = 30.0, iterations: int = 1000) -> np.ndarray:
    """t-SNE in two dimensions, started from the principal components."""
    n = len(x)
    if not n > perplexity:
        raise ValueError("t-SNE needs more points than its perplexity")
    squares = (x * x).sum(1)
    d = np.maximum(squares[:, None] + squares[None] - 2 * x @ x.T, 0)
    p = affinities(np.where(np.eye(n, dtype=bool), np.inf, d), perplexity)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = started(x)
    rate, move, gain = max(n / 12.0 / 4, 50.0), np.zeros_like(y), np.ones_like(y)
    for t in range(iterations):
        squares = (y * y).sum(1)
        q = 1 / (1 + np.maximum(squares[:, None] + squares[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0.0)
        w = ((12.0 if t < 250 else 1.0) * p - np.maximum(q / q.sum(), 1e-12)) * q
        g = 4 * (w.sum(1)[:, None] * y - w @ y)
        gain = np.maximum(np.where(np.sign(g) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if t < 250 else 0.8) * move - rate * gain * g
        y = y + move
    return y - y.mean(0)


def tsne(df: DataFrame, key: str, vector: str = "features", perplexity: float = 30.0, iterations: int = 1000) -> DataFrame:
    most = MAX_POINTS

    def fn(keys: pd.Series, x: np.ndarray) -> pd.DataFrame:
        y = (embed if len(x) <= most else embed_many)(x, perplexity, iterations)
        return pd.DataFrame({"key": keys, "x": y[:, 0], "y": y[:, 1]})

    return _one_group(df, key, vector, fn, "key long, x double, y double")
