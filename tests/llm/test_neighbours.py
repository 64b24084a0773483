from __future__ import annotations

import numpy as np

from loamdex.llm import neighbours
from loamdex.llm.neighbours import Index, nearest, neighbour_pairs

SCHEMA = "id long, embedding array<float>, similarity string, rank int"


def run(spark, vectors: dict[int, list[float] | None], dim: int, **kw):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in vectors.items()], SCHEMA)
    out: dict[int, list[int]] = {}
    for r in sorted(nearest(df, dim=dim, parts=4, **kw).collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append(r["other"])
    return out


def brute(vectors: dict[int, list[float]], k: int):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    return {a: [ids[j] for j in np.argsort(-s[n], kind="stable")[:k]] for n, a in enumerate(ids)}


def clustered(n: int, dim: int, seed: int = 1) -> dict[int, list[float]]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 20), dim))
    return {i: (centres[i % len(centres)] + 0.5 * rng.normal(size=dim)).astype(np.float32).tolist() for i in range(n)}


def test_recall_against_brute_force(spark):
    v = clustered(1200, 16)
    want, got = brute(v, 10), run(spark, v, 16, lists=30, probes=8)
    hits = sum(len(set(want[i]) & set(got[i])) for i in v)
    assert hits >= 0.95 * 10 * len(v)


def test_small_blocks_and_slices_give_the_same(spark, monkeypatch):
    v = clustered(400, 16, 3)
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "SLICE", 50)
    want, got = brute(v, 5), run(spark, v, 16, k=5, lists=8, probes=8)
    assert sum(len(set(want[i]) & set(got[i])) for i in v) >= 0.99 * 5 * len(v)
    assert all(len(x) == 5 for x in got.values())


def test_unusable_vectors_take_no_part(spark):
    v = {i: x for i, x in clustered(40, 8).items()}
    bad = {100: None, 101: [0.0] * 8, 102: [1.0] * 7, 103: [float("nan")] + [1.0] * 7, 104: [float("inf")] + [1.0] * 7}
    got = run(spark, v | bad, 8, k=3)
    assert set(got) == set(v) and not {j for x in got.values() for j in x} & set(bad)
    huge = {1: [3e38] * 8, 2: [1e-38] * 8, 3: [1.0] * 4 + [-1.0] * 4}
    assert run(spark, huge, 8)[1] == [2, 3]


def test_copies_come_first_and_a_hot_vector_does_not_matter(spark):
    v = clustered(60, 8, 5)
    hot = {1000 + i: v[0] for i in range(300)}
    got = run(spark, v | hot, 8, k=10)
    assert got[0] == list(range(1000, 1010))
    assert got[1000] == [0, *range(1001, 1010)] and got[1299] == [0, *range(1000, 1009)]
    assert all(len(x) == 10 for x in got.values())


def test_few_vectors_none_and_pairs(spark):
    two = run(spark, {5: [1.0, 0.0, 0.0, 0.0], 9: [0.0, 1.0, 0.0, 0.0]}, 4)
    assert two == {5: [9], 9: [5]}
    assert run(spark, {}, 4) == {}
    df = spark.createDataFrame([(2, 1, 0.5, 1), (1, 2, 0.5, 1)], "id long, other long, similarity double, rank int")
    assert [tuple(r) for r in neighbour_pairs(df).collect()] == [(1, 2)]


def test_codes_approximate_inner_products():
    x = np.array(list(clustered(500, 16).values()), np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = Index.fit(x, 16, 8, 4)
    home, codes = index.encode(x)
    made = index.decode(home, codes)
    got = np.concatenate([index.scores(x[:20], index.tables(x[:20]), codes[i : i + 1], home[i]) for i in range(500)]).T
    assert np.allclose(got, x[:20] @ made.T, atol=1e-5)
    assert np.abs(got - x[:20] @ x.T).mean() < 0.05 and 0 < index.error < 0.2


def test_each_query_keeps_its_best_codes():
    x = np.array(list(clustered(600, 16).values()), np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = Index.fit(x, 12, 8, 12)
    home, codes = index.encode(x)
    order = np.argsort(home, kind="stable")
    q, c = index.best(x[:50], order, codes[order], home[order], 12, 10, 600)
    score = x[:50] @ index.decode(home, codes).T
    wrong = 2 * index.error * index.scale[home]
    for i in range(50):
        least = np.sort(score[i] - wrong)[-11]
        got = set(c[q == i].tolist())
        assert set(np.flatnonzero(score[i] + wrong > least + 1e-4)) <= got <= set(np.flatnonzero(score[i] + wrong > least - 1e-4))


def test_lists_are_the_nearest_and_probe_themselves_first():
    x = np.array(list(clustered(3000, 16).values()), np.float32)
    index = Index.fit(x, 60, 4, 9)
    assert 50 <= len(index.centres) <= 75
    apart = ((x[:, None] - index.centres[None]) ** 2).sum(2)
    assert (index.home(x) == apart.argmin(1)).mean() > 0.95
    assert (index.probes[:, 0] == np.arange(len(index.centres))).all()
    assert all(len(set(row)) == 9 for row in index.probes.tolist())


def test_units_hold_every_list_once_and_visit_all_probes():
    x = np.array(list(clustered(3000, 16).values()), np.float32)
    index = Index.fit(x, 60, 4, 9)
    sizes = np.bincount(index.home(x), minlength=len(index.centres))
    sizes[3] = 5 * neighbours.BLOCK
    plan = neighbours._plan(index, sizes)
    assert sorted(a for a, *_ in plan.homes) == np.flatnonzero(sizes).tolist()
    visited = {(b, u) for b, u, _ in plan.visits}
    for a, first, blocks, _ in plan.homes:
        assert blocks >= sizes[a] / neighbours.BLOCK
        assert all((b, u) in visited for b in index.probes[a].tolist() if sizes[b] for u in range(first, first + blocks))


def test_recall_on_the_small_table(spark, tiny):
    df = spark.read.parquet(f"{tiny}/vector_documents.parquet")
    good = {r["id"]: r["embedding"] for r in df.collect() if r["embedding"] and len(r["embedding"]) == 384 and np.isfinite(r["embedding"]).all() and any(r["embedding"])}
    want = {(min(a, b), max(a, b)) for a, x in brute(good, 10).items() for b in x}
    got = {tuple(r) for r in neighbour_pairs(nearest(df)).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got)
