import math

import numpy as np
import pytest

from barloom.llm import embedding_dedup as ed
from barloom.llm import queries

SCHEMA = "label string, vec_id long, embedding array<float>, id string, n string, a string"


def plain(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector) by every pair."""
    width = max((len(v) for _, v in rows if v), default=1)
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.zeros((len(good), width))
    for k, at in enumerate(good):
        x[k, : len(rows[at][1])] = np.array(rows[at][1], np.float32)
    u = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    u = u / np.linalg.norm(u, axis=1, keepdims=True) if len(x) else u
    near = u @ u.T >= cosine
    out, done = [], set()
    for k, at in enumerate(good):
        if k in done:
            continue
        todo, seen = [k], {k}
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        done |= seen
        ids = [rows[good[j]][0] for j in seen]
        least = min((i for i in ids if i is not None), default=None)
        out += [(rows[good[j]][0], int(near[j].sum()) - 1, least, rows[good[j]][0] == least) for j in seen]
    out += [(i, 0, i, True) for k, (i, _) in enumerate(rows) if k not in set(good)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([("x", i, v, "c", "c", "c") for i, v in rows], SCHEMA)


def clusters(n, width, sizes, seed, noise=0.15):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=width) for _ in range(n)]
    for k, size in enumerate(sizes):
        centre = rng.normal(size=width)
        centre /= np.linalg.norm(centre)
        x += [(centre + rng.normal(size=width) * noise * (1 + k % 2) / math.sqrt(width)) * rng.uniform(0.1, 9) for _ in range(size)]
    order = rng.permutation(len(x))
    return [(int(i), [float(v) for v in x[i].astype(np.float32)]) for i in order]


def test_query_equals_every_pair(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.op13_embedding_dedup(spark, sf_dir)) == plain(rows)


@pytest.mark.parametrize("page, fan", [(None, 8), (16, 2), (40, 3)])
def test_clusters_however_the_sequence_is_cut(spark, page, fan):
    rows = clusters(120, 12, [90, 40, 40, 7, 3], 5) + [(1000 + k, [1.0, 2.0, 3.0]) for k in range(20)]
    assert got(ed.embedding_dedup(frame(spark, rows), page=page, fan=fan)) == plain(rows)


def test_tight_groups_are_linked_as_wholes(spark):
    rows = clusters(10, 8, [150, 60], 7, 0.02)
    want = plain(rows)
    assert got(ed.embedding_dedup(frame(spark, rows), page=8, fan=2)) == want and max(r[1] for r in want) == 149


def test_links_near_the_bound_in_three_dimensions(spark):
    rng = np.random.default_rng(3)
    angles = rng.uniform(0, 2 * math.pi, 400)
    rows = [(k, [math.cos(a), math.sin(a), float(rng.uniform(-0.4, 0.4))]) for k, a in enumerate(angles)]
    for cosine in (0.9, 0.99):
        assert got(ed.embedding_dedup(frame(spark, rows), cosine=cosine, page=20, fan=2)) == plain(rows, cosine)


def test_vectors_that_link_with_nothing_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [3.0, 0.1]), (None, None), (9, [1.0]), (10, [-1.0, 0.0]), (11, [1e-30, 1e-32]), (12, [-0.0, 5.0]), (13, [0.0, 5.0])]
    want = plain(odd)
    assert got(ed.embedding_dedup(frame(spark, odd))) == want
    assert got(ed.embedding_dedup(frame(spark, odd), page=2, fan=2)) == want
    for rows in ([(1, None), (2, [0.0])], [(None, [1.0, 2.0])]):
        found = got(ed.embedding_dedup(frame(spark, rows)))
        assert [r[1] for r in found] == [0] * len(rows) and all(r[3] for r in found)
    assert ed.embedding_dedup(frame(spark, odd).limit(0)).count() == 0


def test_places_never_lie_farther_apart_than_the_vectors():
    rng = np.random.default_rng(1)
    u = ed.unit(rng.normal(size=(60, 20)))
    _, directions = np.linalg.eigh(np.cov(u.T))
    at = ed.places(u, u.mean(axis=0), directions[:, -5:])
    for k in range(60):
        assert (np.linalg.norm(at - at[k], axis=1) <= np.linalg.norm(u - u[k], axis=1) + 1e-9).all()
