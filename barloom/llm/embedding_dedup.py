"""Embedding near-duplicates: an epsilon grid order join of unit vectors.

Two unit vectors have a cosine of c or more if and only if they are sqrt(2 - 2c)
apart or less, epsilon. The vectors are sorted by the cells of a grid of that width
on their leading principal dimensions and cut into pages, intervals of the
sequence. Intervals are joined recursively: two whose boxes or balls are farther
apart than epsilon are skipped, two that lie within epsilon altogether are linked
as wholes, others are halved. Down to pages the recursion is a join of a table of
pairs with a tree of intervals, level by level; a task then goes on within two pages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, written
from .components import connected

COSINE = 0.9
#: Leading principal dimensions; the length of what they leave is one more.
LEADING = 16
#: Vectors of a page at most, bytes of its vectors at most, and intervals that one of the next level joins.
PAGE, PAGE_BYTES, FAN = 8192, 1 << 22, 8
#: Vectors of an interval that is not halved again.
LEAF = 256
#: Room for rounding where intervals are compared, and where single-precision products decide nothing.
SLACK, CLOSE = 1e-6, 1e-4
#: Tasks whose sums are added up before they reach the driver.
SUMS = 32


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of doubles, shorter ones filled up with zeros."""
    rows = column.to_pylist() if column.null_count else None
    if rows is None:
        ends = column.offsets.to_numpy()
        if len(column) and (np.diff(ends) == width).all():
            return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), width)
        rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest part first, so no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(x: Column) -> Column:
    """Whether a vector can link: not null, finite and not zero throughout."""
    there = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    return F.coalesce(there & F.exists(x, lambda v: v != 0), F.lit(False))


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                u = unit(_matrix(batch.slice(start, 1024).column(0), width))
                total += np.concatenate([[len(u)], u.sum(axis=0), (u.T @ u).ravel()])
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"sums": [np.sum(np.stack(rows["sums"].to_list()), axis=0)]})


def principal(vectors: DataFrame, width: int, leading: int = LEADING) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal directions (in columns) of all unit vectors: sums of each task, added up in a few tasks, width squared numbers each."""
    parts = vectors.select("vec").mapInArrow(_moments(width), "sums array<double>")
    parts = parts.withColumn("_g", F.spark_partition_id() % SUMS).groupBy("_g").applyInPandas(_added, "sums array<double>")
    found = [np.asarray(r["sums"]) for r in parts.collect()]
    total = np.sum(found, axis=0) if found else np.zeros(1 + width + width * width)
    n = max(total[0], 1.0)
    mean = total[1 : 1 + width] / n
    _, directions = np.linalg.eigh(total[1 + width :].reshape(width, width) / n - np.outer(mean, mean))
    return mean, np.ascontiguousarray(directions[:, ::-1][:, : min(leading, width)])


def places(u: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Coordinates that never lie farther apart than the vectors do: on the leading directions, and the length of what these leave."""
    centred = u - mean
    led = centred @ directions
    rest = np.sqrt(np.maximum(np.einsum("ij,ij->i", centred, centred) - np.einsum("ij,ij->i", led, led), 0.0))
    return np.concatenate([led, rest[:, None]], axis=1)


def _cells(width: int, mean: np.ndarray, directions: np.ndarray, epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                at = places(unit(_matrix(part.column(2), width)), mean, directions)
                cells = np.floor(at[:, :-1] / epsilon).astype(np.int32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), cells.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists, pa.array(at[:, 0])], names=["id", "n", "vec", "cell", "first"])

    return run


def summary(at: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Box on the leading dimensions, and ball on all, of some vectors."""
    centre = u.mean(axis=0)
    gone = u - centre
    return at.min(axis=0), at.max(axis=0), centre, float(np.sqrt(np.einsum("ij,ij->i", gone, gone).max()))


def apart(a: tuple, b: tuple, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of intervals (low, high, centre, radius; rows of arrays): whether they are farther apart than ``epsilon``, and whether they lie within it altogether."""
    gap = np.maximum(np.maximum(a[0] - b[1], b[0] - a[1]), 0.0)
    between = a[2] - b[2]
    centres = np.sqrt(np.einsum("ij,ij->i", between, between))
    reach = a[3] + b[3]
    far = (np.sqrt(np.einsum("ij,ij->i", gap, gap)) > epsilon + SLACK) | (centres - reach > epsilon + SLACK)
    return far, centres + reach <= epsilon - SLACK


def _pages(width: int, mean: np.ndarray, directions: np.ndarray, page: int, stored: str):
    kind = pa.schema([("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("vecs", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ns, rows, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            x = np.concatenate(rows)
            u = unit(x)
            low, high, centre, radius = summary(places(u, mean, directions), u)
            values = [np.concatenate(ids).tolist(), np.concatenate(ns).tolist(), x.astype(stored).tobytes(), low.tolist(), high.tolist(), centre.tolist(), radius]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kind, strict=True)], schema=kind)

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, page - size)
                ids.append(np.asarray(part.column(0)))
                ns.append(np.asarray(part.column(1)))
                rows.append(_matrix(part.column(2), width))
                size += part.num_rows
                start += part.num_rows
                if size == page:
                    yield made()
                    ids, ns, rows, size = [], [], [], 0
        if size:
            yield made()

    return run


def _over(rows: pd.DataFrame) -> pd.DataFrame:
    """One interval of some neighbouring ones."""
    held = rows.sort_values("node")
    low, high, centres = (np.stack(held[c].to_list()) for c in ("low", "high", "centre"))
    centre = centres.mean(axis=0)
    gone = centres - centre
    radius = float((np.sqrt(np.einsum("ij,ij->i", gone, gone)) + held["radius"].to_numpy()).max())
    return pd.DataFrame([[held["parent"].iloc[0], int(held["vectors"].sum()), low.min(axis=0).tolist(), high.max(axis=0).tolist(), centre.tolist(), radius]], columns=["node", "vectors", "low", "high", "centre", "radius"])


NODE = "node long, vectors long, low array<double>, high array<double>, centre array<double>, radius double"


def _judged(epsilon: float):
    """Pairs of intervals that are not provably apart, with whether they are linked as wholes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                sides = [[np.stack(rows.column(f"{s}_{c}").to_pylist()) for c in ("low", "high", "centre")] + [np.asarray(rows.column(f"{s}_radius"))] for s in "ab"]
                far, whole = apart(*sides, epsilon)
                kept = rows.append_column("whole", pa.array(whole)).filter(pa.array(~far))
                yield kept.select(["a", "b", "whole"])

    return run


def _expanded(pairs: DataFrame, nodes: DataFrame, epsilon: float) -> DataFrame:
    """Pairs ``a, b, whole`` of ``nodes`` under ``pairs`` of their parents, each once (a <= b)."""
    side = lambda s: nodes.select(F.col("parent").alias(f"{s}_parent"), F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("low", "high", "centre", "radius")])
    met = pairs.withColumnsRenamed({"a": "pa", "b": "pb"}).join(side("a"), F.col("pa") == F.col("a_parent")).join(side("b"), F.col("pb") == F.col("b_parent")).where("a <= b")
    columns = ["a", "b", *[f"{s}_{c}" for s in "ab" for c in ("low", "high", "centre", "radius")]]
    return met.select(*columns).mapInArrow(_judged(epsilon), "a long, b long, whole boolean")


class _Intervals:
    """A page's vectors with boxes and balls of its halves, made when they are asked for."""

    def __init__(self, vecs: bytes, ns: np.ndarray, ids: np.ndarray, width: int, mean: np.ndarray, directions: np.ndarray, stored: str):
        self.u = unit(np.frombuffer(vecs, stored).astype(np.float64).reshape(-1, width))
        self.at = places(self.u, mean, directions)
        self.single = self.u.astype(np.float32)
        self.ns, self.ids = ns, ids
        self.found = np.zeros(len(ids), np.int64)
        self._held: dict[tuple[int, int], tuple] = {}

    def summary(self, lo: int, hi: int) -> tuple:
        if (lo, hi) not in self._held:
            low, high, centre, radius = summary(self.at[lo:hi], self.u[lo:hi])
            self._held[lo, hi] = low[None], high[None], centre[None], np.array([radius])
        return self._held[lo, hi]


def linked(a: np.ndarray, b: np.ndarray, single_a: np.ndarray, single_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of unit vectors with a cosine of ``cosine`` or more; single precision leaves out only what is clear."""
    product = single_a @ single_b.T
    i, j = np.nonzero(product >= cosine - CLOSE)
    sure = product[i, j] >= cosine + CLOSE
    for start in range(0, len(i), 1 << 14):
        part = np.flatnonzero(~sure[start : start + (1 << 14)]) + start
        sure[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= cosine
    return i[sure], j[sure]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as hold together what the links ``a, b`` (numbers) hold together: each number with the least one it reaches."""
    nodes, held = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = held[: len(a)], held[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[i], root[j])
        now = root.copy()
        np.minimum.at(now, root[i], least)
        np.minimum.at(now, root[j], least)
        now = now[now]
        if (now == root).all():
            break
        root = now
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def join_pages(a: _Intervals, b: _Intervals, epsilon: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold the pages' classes together; how many vectors each one links is added to ``found`` of both. ``a`` may be ``b``."""
    same = a is b
    heads: list[np.ndarray] = []
    tails: list[np.ndarray] = []
    todo = [(0, len(a.ids), 0, len(b.ids))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        own = same and alo == blo
        far, whole = apart(a.summary(alo, ahi), b.summary(blo, bhi), epsilon)
        if far[0]:
            continue
        if whole[0]:
            a.found[alo:ahi] += b.ns[blo:bhi].sum()
            if own:
                a.found[alo:ahi] -= a.ns[alo:ahi]
            else:
                b.found[blo:bhi] += a.ns[alo:ahi].sum()
            members = np.concatenate([a.ids[alo:ahi], b.ids[blo:bhi]])
            heads.append(np.full(len(members), members[0]))
            tails.append(members)
        elif max(ahi - alo, bhi - blo) <= LEAF:
            i, j = linked(a.u[alo:ahi], b.u[blo:bhi], a.single[alo:ahi], b.single[blo:bhi], cosine)
            if own:
                i, j = i[i != j], j[i != j]
            a.found[alo:ahi] += np.bincount(i, b.ns[blo:bhi][j], ahi - alo).astype(np.int64)
            if not own:
                b.found[blo:bhi] += np.bincount(j, a.ns[alo:ahi][i], bhi - blo).astype(np.int64)
            if len(i):
                head, tail = spanning(a.ids[alo:ahi][i], b.ids[blo:bhi][j])
                heads.append(head)
                tails.append(tail)
        else:
            halves = lambda lo, hi: [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)] if hi - lo > LEAF else [(lo, hi)]
            left, right = halves(alo, ahi), halves(blo, bhi)
            todo += [(*p, *q) for p in left for q in right if not own or p[0] <= q[0]]
    if not heads:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return spanning(np.concatenate(heads), np.concatenate(tails))


def _met(width: int, mean: np.ndarray, directions: np.ndarray, epsilon: float, cosine: float, stored: str):
    """Two pages of a pair to ``id, to, n``: counts of links (``to`` null) and links that hold classes together (``n`` null)."""

    def page(rows: pa.Table) -> _Intervals:
        ids, ns = (np.asarray(rows.column(c)[0].values).astype(np.int64) for c in ("ids", "ns"))
        return _Intervals(rows.column("vecs")[0].as_buffer(), ns, ids, width, mean, directions, stored)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a = page(left)
        b = a if left.column("same")[0].as_py() else page(right)
        head, tail = join_pages(a, b, epsilon, cosine)
        held = [a] if a is b else [a, b]
        ids, found = (np.concatenate([getattr(x, c) for x in held]) for c in ("ids", "found"))
        ids, found = ids[found > 0], found[found > 0]
        return pa.table(
            {
                "id": pa.array(np.concatenate([ids, head])),
                "to": pa.array(np.concatenate([np.zeros(len(ids), np.int64), tail]), mask=np.arange(len(ids) + len(head)) < len(ids)),
                "n": pa.array(np.concatenate([found, np.zeros(len(head), np.int64)]), mask=np.arange(len(ids) + len(head)) >= len(ids)),
            }
        )

    return run


def links(vectors: DataFrame, width: int, cosine: float = COSINE, page: int | None = None, fan: int = FAN, stored: str = "f8") -> tuple[DataFrame, DataFrame]:
    """``id, n_links`` and links ``a, b`` that hold the classes together, for vectors ``id, n, vec`` (different ids, n rows each, all usable).

    ``n_links`` counts the rows of all other vectors with the cosine; a vector with none has no row.
    Pages hold numbers as ``stored``, f4 where they came as floats.
    """
    epsilon = math.sqrt(2 - 2 * cosine)
    page = page or max(1, min(PAGE, PAGE_BYTES // (8 * width)))
    mean, directions = principal(vectors, width)
    celled = vectors.select("id", "n", "vec").mapInArrow(_cells(width, mean, directions, epsilon), "id long, n long, vec array<double>, cell array<int>, first double")
    order = ["cell", "first", "id"]
    paged = celled.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "n", "vec")
    kind = "ids array<long>, ns array<long>, vecs binary, low array<double>, high array<double>, centre array<double>, radius double"
    # the order of the pages is that of the sequence: partitions in turn, pages of each in turn
    pages = written(paged.mapInArrow(_pages(width, mean, directions, page, stored), kind).withColumn("node", F.monotonically_increasing_id()), "pages")
    ends = pages.select(F.shiftright("node", 33).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("c")).orderBy("part").collect()  # a row a partition
    before = np.cumsum([0] + [r["c"] for r in ends]).tolist()
    if not before[-1]:
        spark = vectors.sparkSession
        return spark.createDataFrame([], "id long, n_links long"), spark.createDataFrame([], "a long, b long")
    starts = vectors.sparkSession.createDataFrame([(r["part"], at) for r, at in zip(ends, before, strict=False)], "part long, start long")
    rank = F.col("start") + F.col("node").bitwiseAND(F.lit((1 << 33) - 1))
    pages = pages.join(F.broadcast(starts), F.shiftright("node", 33) == F.col("part")).withColumn("node", rank).drop("part", "start")
    pages = written(pages.withColumn("parent", F.floor(F.col("node") / fan).cast("long")), "pages")
    levels = [written(pages.select("node", "parent", F.size("ids").cast("long").alias("vectors"), "low", "high", "centre", "radius"), "level")]
    n = before[-1]
    while n > 1:
        n = -(-n // fan)
        over = levels[-1].groupBy("parent").applyInPandas(_over, NODE)
        levels.append(written(over.withColumn("parent", F.floor(F.col("node") / fan).cast("long")), "level"))
    pairs = vectors.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    wholes = []
    for level in range(len(levels) - 1, -1, -1):
        found = written(_expanded(pairs, levels[level], epsilon), "pairs")
        if level:
            wholes.append((level, found.where("whole").select("a", "b")))
            found = found.where("NOT whole")
        pairs = found.select("a", "b")

    def side(s: str) -> DataFrame:
        rows = pairs.join(pages.select(F.col("node").alias(s), "ids", "ns", "vecs"), s).withColumn("same", F.col("a") == F.col("b"))
        return rows.select(*[F.col(c).alias(c) for c in ("a", "b", "same", "ids", "ns", "vecs")])  # columns of their own for each side

    met = side("a").groupBy("a", "b").cogroup(side("b").groupBy("a", "b")).applyInArrow(_met(width, mean, directions, epsilon, cosine, stored), "id long, to long, n long")
    met = written(met, "met")
    counts = met.where("to IS NULL").select("id", "n")
    edges = met.where("to IS NOT NULL").select(F.col("id").alias("a"), F.col("to").alias("b"))
    for level, whole in wholes:
        if whole.isEmpty():
            continue
        more, held = _wholes(whole, pages, level, fan)
        counts, edges = counts.unionByName(more), edges.unionByName(held)
    return counts.groupBy("id").agg(F.sum("n").alias("n_links")), edges


def _wholes(whole: DataFrame, pages: DataFrame, level: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Counts and links of pairs of intervals (``a, b`` at ``level``) that lie within epsilon altogether: rows in proportion to the intervals' vectors, whatever their pairs."""
    up = F.floor(F.col("node") / F.lit(fan**level)).cast("long")
    rows = pages.select(up.alias("_i"), "ids", "ns")
    sizes = written(rows.groupBy("_i").agg(F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda s, x: s + x)).alias("_s"), F.min(F.get("ids", F.lit(0))).alias("_head")), "sizes")
    both = whole.select(F.col("a").alias("_i"), F.col("b").alias("_j")).unionByName(whole.where("a <> b").select(F.col("b").alias("_i"), F.col("a").alias("_j")))
    gained = both.join(sizes.select(F.col("_i").alias("_j"), "_s"), "_j").groupBy("_i").agg(F.sum("_s").alias("_s"), F.max((F.col("_i") == F.col("_j")).cast("int")).alias("_own"))
    members = rows.join(gained, "_i").select("_i", "_s", "_own", F.explode(F.arrays_zip("ids", "ns")).alias("_m"))
    members = written(members.select("_i", F.col("_m.ids").alias("id"), (F.col("_s") - F.col("_own") * F.col("_m.ns")).alias("n")), "whole")
    head = lambda s: sizes.select(F.col("_i").alias(s), F.col("_head").alias(f"_{s}"))
    # whatever an interval is linked with as a whole, that holds all its vectors together
    inside = members.join(head("_i"), "_i").select(F.col("__i").alias("a"), F.col("id").alias("b"))
    across = whole.join(head("a"), "a").join(head("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return members.select("id", "n"), inside.unionByName(across)


def embedding_dedup(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, page: int | None = None, fan: int = FAN) -> DataFrame:
    """One row per row: ``vec_id, n_links`` (other rows linked directly), ``component_id`` (least id reachable), ``kept`` (that is its own).

    Rows link at a cosine of ``cosine`` or more, in double precision. A vector that
    is null, empty, zero throughout or holds a null or a number that is not finite
    links with nothing; a shorter vector counts as if it ended in zeros. Equal
    vectors enter the join once, as many rows as they are; repeated rows stay. A
    null id is the least only of a class without another, and its row is kept if
    it is alone. Other columns are not read; an empty table gives an empty result.
    Memory of a task is bounded by two pages of vectors.
    """
    vec = named(vec_col).cast("array<double>")
    rows = table.select(named(id_col).cast("long").alias("vec_id"), vec.alias("vec")).withColumn("_ok", usable(F.col("vec")))
    keyed = rows.select("vec_id", "vec", F.when(F.col("_ok"), F.sha2(F.to_json(F.struct("vec")), 256)).alias("_key"))
    keyed = written(keyed, "vectors")
    distinct = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("_least"), F.first("vec").alias("vec"))
    distinct = written(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    width = distinct.agg(F.max(F.size("vec"))).first()[0] or 1
    single = table.schema[vec_col].dataType.simpleString() == "array<float>"
    counts, edges = links(distinct, width, cosine, page, fan, "f4" if single else "f8")
    roots = connected(edges).withColumnRenamed("node", "id")
    known = distinct.select("_key", "id", "n", "_least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = written(known.join(counts, "id", "left"), "known")
    least = known.groupBy("root").agg(F.min("_least").alias("component_id"))
    known = written(known.join(least, "root").select("_key", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "classes")
    out = keyed.select("vec_id", "_key").join(known, "_key", "left")
    component = F.when(F.col("_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
