import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from barloom.llm import common, near_copies, simhash

from .test_near_copies import SCHEMA, edited, plain_classes


def firsts_of(spark, rows):
    """(sets by number, ``firsts`` with fingerprints and parity bits, ``sets_of``)."""
    sets = {near_copies.mark(s): s for s in (near_copies.shingles(t) for t, _ in rows)}
    held = [(u, len(s), simhash._signed(simhash.majority(s)), near_copies.parity(s).tolist(), near_copies._prefix(s, 0.8).tolist()) for u, s in sets.items()]
    firsts = spark.createDataFrame(held, "_u long, _n int, sim long, bits array<long>, first array<long>")
    whole = spark.createDataFrame([(u, s.tolist()) for u, s in sets.items()], "_u long, set array<long>")
    return sets, firsts, lambda wanted: whole.join(wanted, "_u")


def test_stage_takes_its_first_links_from_the_simhash_index(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(near_copies, "alike", lambda fps, f=near_copies.alike: asked.append(fps.count()) or f(fps))
    rows = edited(30, seed=5)
    kept = near_copies.drop_near_copies(spark.createDataFrame([(t, i, "x") for t, i in rows], SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == plain_classes(rows)
    assert len(asked) == 1 and asked[0] > 4


def test_simhash_pairs_are_all_within_two_bits(spark):
    rows = edited(60, seed=6, size=400, most=3)
    sets, firsts, _ = firsts_of(spark, rows)
    sims = {u: simhash.majority(s) for u, s in sets.items()}
    found = {(r.a, r.b) for r in near_copies.fingerprint_pairs(firsts).collect()}
    near = {(a, b) for a in sets for b in sets if a < b and (sims[a] ^ sims[b]).bit_count() <= 2}
    assert found and found <= near
    assert {s for s in sims.values() if list(sims.values()).count(s) > 1} == {sims[a] for a, b in found if sims[a] == sims[b]}


def test_what_simhash_linked_is_not_paired_again(spark, monkeypatch):
    """The tally emits no pair within a class that the fingerprints found."""
    rows = edited(40, seed=9, size=300, most=4)
    _, firsts, sets_of = firsts_of(spark, rows)
    wanted = []
    whole = lambda ids: wanted.append(ids.count()) or sets_of(ids)
    with_bits = near_copies.connected(near_copies.links(firsts, whole)).collect()
    plain = near_copies.connected(near_copies.links(firsts.drop("sim", "bits"), sets_of)).collect()
    assert sorted(with_bits) == sorted(plain)
    monkeypatch.setattr(near_copies, "fingerprint_pairs", lambda f: f.select(near_copies.F.col("_u").alias("a"), near_copies.F.col("_u").alias("b")).limit(0))
    near_copies.links(firsts, whole)
    assert wanted[0] > 0 and wanted[1] < wanted[3]


@pytest.mark.parametrize("size", [3, 40, 900])
def test_parity_bits_bound_the_difference(size):
    rng = np.random.default_rng(size)
    a = rng.integers(-(1 << 62), 1 << 62, size)
    b = np.concatenate([a[size // 4 :], rng.integers(-(1 << 62), 1 << 62, size // 3)])
    differ = int(np.bitwise_count((near_copies.parity(a) ^ near_copies.parity(b)).view(np.uint64)).sum())
    assert 0 <= differ <= len(np.setxor1d(a, b))


def test_verification_compares_few_whole_sets(spark):
    """Pairs that share a few rare shingles never have their whole sets read."""
    words = [f"w{k}" for k in range(6000)]
    rows = [(" ".join([*words[:60], *words[100 * k : 100 * k + 90]]), k) for k in range(1, 50)]
    _, firsts, sets_of = firsts_of(spark, rows)
    wanted = []
    whole = lambda ids: wanted.append(ids.count()) or sets_of(ids)
    assert near_copies.links(firsts, whole, most=1000).count() == 0
    assert max(wanted) <= 4


def test_the_sample_grows_with_the_table(spark, monkeypatch):
    """A shingle in some texts of a hundred is known as common, whatever the size of the table."""
    monkeypatch.setattr(near_copies, "SAMPLE_DOCS", 40)
    rows = [(f"{k} a b c d e f {k}" if k % 50 == 0 else f"u{k} v{k} w{k} x{k} y{k} z{k}", k) for k in range(20_000)]
    held = near_copies._held(spark.createDataFrame(rows, "text string, doc_id long"), "doc_id", "text")
    common_, counts = near_copies._common(held, 5)
    shared = near_copies.shingles("a b c d e f")
    assert set(shared.tolist()) == set(common_.tolist()) and counts.min() >= 25 and (np.diff(common_) > 0).all()


def test_pipeline_stages_hand_small_batches_to_workers(spark, sf_dir):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(name), spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    try:
        for _, stage in corpus_pipeline.STAGES[1:]:
            spark.conf.set(name, 10_000)
            stage(spark, docs, sf_dir)
            assert spark.conf.get(name) == "1000"
        spark.conf.set(name, 10)
        common.small_batches(spark)
        assert spark.conf.get(name) == "10"
    finally:
        spark.conf.set(name, before)


def test_workers_drop_what_other_stages_keep():
    kept = common.worker_cache("language")
    kept["field"] = object()
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    assert list(common.trimmed(iter, "language")([batch])) == [batch] and kept
    assert list(common.trimmed(iter)([batch])) == [batch] and not kept


def template_pages(n, own, seed=1):
    """Pages of 22 words in common, with some of their own in between."""
    rng = np.random.default_rng(seed)
    common = [f"common{k}" for k in range(22)]
    return [(" ".join([*common[:11], *(f"own{rng.integers(1 << 40)}" for _ in range(own)), *common[11:]]), k) for k in range(n)]


@pytest.mark.parametrize("own", [1, 2, 4, 6])
def test_pages_of_one_template_cost_no_pairs(spark, monkeypatch, own):
    rows = template_pages(300, own) + template_pages(80, 1, seed=2) + edited(20, seed=3)
    sets, _, sets_of = firsts_of(spark, rows)
    held = near_copies._held(spark.createDataFrame([(t, i, "x") for t, i in rows], SCHEMA), "doc_id", "text")
    firsts = near_copies.prefixes(held, 5, 0.8).select(near_copies.F.col("fp").alias("_u"), "_n", "sim", "bits", "first").dropDuplicates(["_u"])
    found, written = {}, near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, name="t": found.setdefault(name, []).append(out := written(df, name)) or out)
    roots = {r.node: r.root for r in near_copies.connected(near_copies.links(firsts, sets_of)).collect()}
    classes = {}
    for u in sets:
        classes.setdefault(roots.get(u, u), set()).add(u)
    todo, want = set(sets), set()
    while todo:
        seen, now = set(), [todo.pop()]
        while now:
            a = now.pop()
            seen.add(a)
            near = {b for b in todo if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9}
            todo -= near
            now += near
        want.add(frozenset(seen))
    assert {frozenset(c) for c in classes.values()} == want
    assert all(df.count() <= 40 * len(rows) for df in found["pairs"])


def test_pairs_of_a_template_grow_with_the_rows(spark, monkeypatch):
    found, written = {}, near_copies.written
    monkeypatch.setattr(near_copies, "written", lambda df, name="t": found.setdefault(name, []).append(out := written(df, name)) or out)
    sizes = []
    for n in (500, 2000):
        found.clear()
        df = spark.createDataFrame([(t, i, "x") for t, i in template_pages(n, 4)], SCHEMA)
        assert near_copies.drop_near_copies(df).count() == n
        sizes.append(sum(t.count() for t in found["pairs"]))
    assert sizes[1] <= 5 * sizes[0] + 2000
