"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with a cosine of at least ``COSINE`` are at most epsilon = sqrt(2 - 2 * COSINE) apart, and no projection moves them
further apart.  Distinct vectors of one label are sorted by the cells, epsilon wide, of their leading principal coordinates
and cut into runs of bounded size.  Intervals of runs are joined recursively: a pair of intervals whose boxes are more than
epsilon apart can't hold a link and is dropped with all below it; others are divided by ``FAN``, level by level as joins of
small tables of boxes, down to pairs of runs.  A task gets the vectors of two runs and goes on in the same way, by halves,
down to ``LEAF`` vectors, which are multiplied.

Equal vectors are collapsed first, so links of copies are counted, not listed.  A task adds the number of links to each vector and
emits a spanning forest of the links that it found, so what leaves it is linear in its vectors however many links there are.
Components of the forests are those of all links.

The principal directions come from a sample of at most 2 * ``SAMPLE`` distinct vectors; any orthonormal directions give the same
result, so the sample decides the cost only.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing
and stand for themselves; vectors of different lengths don't link; a component is named by its smallest vec_id, null if none of
its rows has one; rows that share a vec_id are told apart, and repeated rows link with each other; other columns, whatever
their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import forget, numbered, settle, table

COSINE = 0.93
#: Principal directions, sampled vectors, intervals that an interval is divided into, vectors of a leaf.
DIRECTIONS, SAMPLE, FAN, LEAF = 8, 2048, 8, 128
#: Numbers in the vectors of a run, which has 64 to 4096 vectors.
RUN_NUMBERS = 1 << 17
#: Room for rounding: boxes are dropped only beyond it, and cosines nearer to the threshold are computed from the vectors themselves.
SLACK = 1e-9
_KEY = ["label", "size"]


def usable(v: Column) -> Column:
    """Whether a vector has finite components only, not all of them zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows, scaled to a largest component of 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return x / np.abs(x).max(1, keepdims=True)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def directions(distinct: DataFrame, n: int, size: int, count: int = DIRECTIONS) -> np.ndarray:
    """The leading principal directions (columns) of a sample; shorter vectors count as filled up with zeros."""
    most = max(64, min(SAMPLE, (1 << 20) // max(size, 1)))
    rows = distinct.where(F.pmod("h", F.lit(max(1, n // most))) == 0).limit(2 * most).select("vector").toArrow().column(0)
    x = np.zeros((len(rows), size))
    for i, v in enumerate(rows.to_pylist()):
        v = np.array(v)
        x[i, : len(v)] = v / np.abs(v).max()
    x = _units(x) if len(x) else x
    x = x - x.mean(0) if len(x) else x
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :count].copy()


def _projected(batches, basis: np.ndarray, epsilon: float):
    for b in batches:
        sizes = b.column("size").to_numpy()
        p = np.zeros((b.num_rows, basis.shape[1]))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            p[at] = _units(_matrix(b.column("vector").take(pa.array(at)))) @ basis[:size]
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))
        yield pa.RecordBatch.from_arrays([*b.columns, lists(p, pa.float64()), lists(np.floor(p / epsilon).astype(np.int64), pa.int64())], [*b.schema.names, "p", "cell"])


def _gap(a: str, b: str, k: int) -> Column:
    """The squared distance of two boxes."""
    total = F.lit(0.0)
    for i in range(k):
        d = F.greatest(F.lit(0.0), F.col(f"{b}.lo{i}") - F.col(f"{a}.hi{i}"), F.col(f"{a}.lo{i}") - F.col(f"{b}.hi{i}"))
        total = total + d * d
    return total


def near_intervals(placed: DataFrame, n: int, k: int, epsilon: float) -> DataFrame:
    """(label, size, i, j): pairs of runs (i <= j) whose boxes are at most epsilon apart, found from the whole sequence downwards."""
    spark = placed.sparkSession
    edges = [f(F.col("p")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("lo", F.min), ("hi", F.max))]
    levels = [settle(placed.groupBy(*_KEY, F.col("run").alias("node")).agg(*edges), "boxes")]
    wide = F.max("run").alias("run")
    last = placed.agg(wide).collect()[0]["run"] or 0
    while FAN ** (len(levels) - 1) <= last:
        up = [f(f"{name}{i}").alias(f"{name}{i}") for i in range(k) for name, f in (("lo", F.min), ("hi", F.max))]
        levels.append(settle(levels[-1].groupBy(*_KEY, F.floor(F.col("node") / FAN).alias("node")).agg(*up), "boxes"))
    top = levels[-1].select(*_KEY, F.col("node").alias("i"))
    pairs = top.join(top.withColumnRenamed("i", "j"), _KEY).where("i <= j")
    for below in levels[-2::-1]:
        a = below.withColumn("up", F.floor(F.col("node") / FAN)).alias("a")
        b = below.withColumn("up", F.floor(F.col("node") / FAN)).alias("b")
        x = pairs.alias("x")
        same = lambda side: [F.col(f"x.{c}") == F.col(f"{side}.{c}") for c in _KEY]
        both = x.join(a, [*same("a"), F.col("x.i") == F.col("a.up")]).join(b, [*same("b"), F.col("x.j") == F.col("b.up")])
        near = both.where((F.col("a.node") <= F.col("b.node")) & (_gap("a", "b", k) <= epsilon * epsilon + SLACK))
        pairs = settle(near.select(*[F.col(f"x.{c}") for c in _KEY], F.col("a.node").alias("i"), F.col("b.node").alias("j")), "intervals")
    pairs = pairs if len(levels) > 1 else settle(pairs, "intervals")
    forget(spark, *levels)
    return pairs


def join_runs(t: pa.Table, cosine: float, epsilon: float) -> pa.Table:
    """(a, b, n): how many links each vector ``a`` has between two runs (b null), and links (a, b) that span what they connect."""
    t = t.sort_by("place")
    place, copies, own = (t.column(c).to_numpy() for c in ("place", "copies", "run"))
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    raw, p = _matrix(t.column("vector")), np.array(t.column("p").to_pylist())
    unit = _units(raw)
    links, label, forest = np.zeros(len(place)), np.arange(len(place)), []
    cut = int(np.searchsorted(own, j))
    todo = [(0, len(place), 0, len(place))] if i == j else [(0, cut, cut, len(place))]
    while todo:
        a, b, c, d = todo.pop()
        if b <= a or d <= c:
            continue
        if a != c:
            gap = np.maximum(0, np.maximum(p[c:d].min(0) - p[a:b].max(0), p[a:b].min(0) - p[c:d].max(0)))
            if (gap * gap).sum() > epsilon * epsilon + SLACK:
                continue
        if max(b - a, d - c) > LEAF:
            m, o = (a + b) // 2, (c + d) // 2
            if a == c:
                todo += [(m, b, m, b), (a, m, m, b), (a, m, a, m)]
            elif b - a >= d - c:
                todo += [(m, b, c, d), (a, m, c, d)]
            else:
                todo += [(a, b, o, d), (a, b, c, o)]
            continue
        near = unit[a:b] @ unit[c:d].T
        hit = near >= cosine
        for x, y in zip(*np.nonzero(np.abs(near - cosine) <= SLACK), strict=True):
            u, v = raw[a + x], raw[c + y]
            hit[x, y] = u @ v / math.sqrt((u @ u) * (v @ v)) >= cosine
        if a == c:
            hit = np.triu(hit, 1)
        if not hit.any():
            continue
        links[a:b] += hit @ copies[c:d]
        links[c:d] += copies[a:b] @ hit
        x, y = np.nonzero(hit)
        x, y = x + a, y + c
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        for at in np.unique(label[x] * len(place) + label[y], return_index=True)[1]:
            p1, p2 = label[x[at]], label[y[at]]
            if p1 != p2:
                label[label == p2] = p1
                forest.append((place[x[at]], place[y[at]]))
    some = np.flatnonzero(links)
    first = np.concatenate([place[some], np.array([f[0] for f in forest], np.int64)])
    second = pa.array([None] * len(some) + [int(f[1]) for f in forest], pa.int64())
    return pa.table({"a": pa.array(first, pa.int64()), "b": second, "n": pa.array(np.concatenate([links[some], np.zeros(len(forest))]).astype(np.int64))})


def near_vectors(rows: DataFrame, cosine: float = COSINE, run_rows: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row (vec_id, embedding, label)."""
    spark, made = rows.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(settle(df, name))
        return made[-1]

    v = F.col("embedding").cast("array<double>")
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("vector"))
    fine = F.col("label").isNotNull() & usable(F.col("vector"))
    good = base.where(fine).withColumn("h", F.xxhash64("vector"))
    distinct = kept(good.groupBy("label", "h", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")), "distinct")
    distinct = distinct.withColumn("size", F.size("vector"))
    n, size = distinct.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).collect()[0]
    alone = base.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not n:
        forget(spark, *made)
        return alone.withColumn("kept", F.lit(True))
    epsilon = math.sqrt(2 - 2 * cosine)
    basis = directions(distinct, n, size)
    k = basis.shape[1]
    run_rows = run_rows or max(64, min(4096, RUN_NUMBERS // max(size, 1)))
    projected = distinct.mapInArrow(lambda it: _projected(it, basis, epsilon), "label string, h long, vector array<double>, copies long, least long, size int, p array<double>, cell array<long>")
    order = [*[F.col(c) for c in _KEY], *[F.col("cell")[i] for i in range(k)], F.col("h"), F.col("least")]
    placed = numbered(projected, order, "place").withColumn("run", F.floor(F.col("place") / run_rows)).drop("cell")
    placed = kept(placed, "placed")
    pairs = near_intervals(placed, n, k, epsilon)
    made.append(pairs)
    sent = pairs.withColumn("run", F.explode(F.array_distinct(F.array("i", "j"))))
    sent = placed.select(*_KEY, "run", "place", "copies", "vector", "p").join(sent, [*_KEY, "run"])
    found = kept(sent.groupBy(*_KEY, "i", "j").applyInArrow(lambda t: join_runs(t, cosine, epsilon), "a long, b long, n long"), "found")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("place")).agg(F.sum("n").alias("n"))
    named = components(found.where("b IS NOT NULL").select("a", "b"))
    made.append(named)
    nodes = placed.select("place", "label", "h", "vector", "copies", "least").join(links, "place", "left").join(named.select(F.col("id").alias("place"), F.col("label").alias("root")), "place", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "place"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "root").select("label", "h", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(nodes, ["label", "h", "vector"]).select("vec_id", "n_links", "component_id")
    out = settle(linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "near")
    forget(spark, *made)
    return out


def op12_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of each embedding."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.n AS a, b.n AS b FROM ok a JOIN ok b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
r(a, b) AS (SELECT n, n FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS n, min(v.vec_id) AS component_id FROM r JOIN v ON v.n = r.b GROUP BY r.a),
k AS (SELECT a AS n, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (n) LEFT JOIN k USING (n)"""
