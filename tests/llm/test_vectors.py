import numpy as np
import pytest

from ripplegraph.llm import embedding_dedup, prefix_forest

SCHEMA = "vec_id long, embedding array<float>, key string, n int"


def rows(seed=0, n=300, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[50:90] = x[0] + rng.standard_normal((40, dim)) * 0.05
    x[90:100] = x[1]
    x[100:110] *= 30
    data = [(i, [float(v) for v in np.float32(r)], "clash", 1) for i, r in enumerate(x)]
    return data + [(900, None, None, None), (901, [0.0] * dim, "z", 1), (902, [float("nan")] * dim, "z", 1), (903, [1.0], "z", 1), (904, [None] * dim, "z", 1), data[95]]


def expected(data, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v, *_ in data if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= threshold
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return ids, x, near, ids[label]


@pytest.mark.parametrize("chunk_rows", [16, 1024])
def test_near_duplicates(spark, chunk_rows):
    data = rows()
    ids, _, near, label = expected(data)
    found = {}
    for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, SCHEMA), chunk_rows=chunk_rows, rows_per_cell=8, recall=1).collect():
        found.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert sum(map(len, found.values())) == len(data)
    for i, n, c in zip(ids.tolist(), near.sum(1).tolist(), label.tolist()):
        assert (n - 1, c, i == c) in found[i]
    for i in (900, 901, 902, 903, 904):
        assert found[i] == [(0, i, True)]


def test_no_link_is_missed_where_components_differ_in_scale(stored):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    scale = np.tile(1 / np.arange(1, 33), 2)
    a, b = rng.standard_normal((2, 2000, 64)) * scale
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = rng.uniform(0.95, 0.96, (2000, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    data = stored({"vec_id": list(range(4000)), "embedding": x.tolist()}, [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(data, rows_per_cell=64).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert [found[i] for i in range(4000)] == ((x @ x.T >= 0.95).sum(1) - 1).tolist()


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_duplicates(none).count() == 0
    assert prefix_forest.search(none, "id % 20 = 0").count() == 0


def test_forest_finds_all_when_it_may_look_at_all(spark):
    data = rows()
    ids, x, _, _ = expected(data)
    found = {}
    for r in prefix_forest.search(spark.createDataFrame(data, SCHEMA), "id % 20 = 0", k=5, chunk_rows=64, share=5.0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        at = list(ids).index(q)
        score = (x * x[at]).sum(1)
        order = [j for j in np.lexsort((ids, -np.round(score, 9))) if ids[j] != q][:5]
        assert [v for v, _ in found[q]] == ids[order].tolist()
        assert np.allclose([s for _, s in found[q]], score[order])


@pytest.mark.parametrize(("kind", "share"), [("clusters", 0.5), ("anywhere", 0.8)])
def test_forest_recall(stored, kind, share):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    if kind == "clusters":
        x = np.repeat(rng.standard_normal((40, 64)), 50, axis=0) + 0.3 * x
    data = stored({"vec_id": list(range(2000)), "embedding": x.tolist()}, [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])
    found = prefix_forest.search(data, "id % 20 = 0", k=10, share=share, chunk_rows=512).collect()
    best = {q: np.partition(np.delete(x @ x[q], q), -10)[-10] for q in range(0, 2000, 20)}
    assert len(found) == 1000 and np.mean([r.score >= best[r.query_id] - 1e-9 for r in found]) >= 0.9


def test_forest_gives_k_results_however_small_the_share(stored):
    import pyarrow as pa

    x = np.random.default_rng(6).standard_normal((400, 8))
    data = stored({"vec_id": list(range(400)), "embedding": x.tolist()}, [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])
    found = prefix_forest.search(data, "id % 20 = 0", share=0.0).collect()
    assert len(found) == 400 and all(r.vec_id != r.query_id for r in found)
    few = prefix_forest.search(data.where("vec_id < 7"), "id = 0").collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4, 5, 6]


def test_cells_are_visited_in_the_order_of_their_bounds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        left, right, reach = rng.random(7), rng.random(7), rng.random()
        want = [i * 7 + j for i in range(7) for j in range(7) if left[i] + right[j] <= reach]
        assert sorted(embedding_dedup.visited(left, right, reach).tolist()) == want


def test_rows_of_one_id(stored):
    import pyarrow as pa

    data = stored({"vec_id": [5, 5, 7, 9], "embedding": [[1.0, 0.0], [0.0, 1.0], [1.0, 0.01], [0.01, 1.0]]}, [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(data).collect())
    assert found == [(5, 1, 5), (5, 1, 5), (7, 1, 5), (9, 1, 5)]


def test_waves_bound_what_is_dealt_at_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8))
    data = spark.createDataFrame([(i, [float(c) for c in v], "", 0) for i, v in enumerate(np.concatenate([x, x[:200] + rng.normal(size=(200, 8)) * 0.05]))], SCHEMA)
    compared, dealt = embedding_dedup.compared, []
    monkeypatch.setattr(embedding_dedup, "compared", lambda df, *args: (dealt.append(df.count()), compared(df, *args))[1])
    runs = [sorted(tuple(r) for r in embedding_dedup.near_duplicates(data, rows_per_cell=8, chunk_rows=16, wave_rows=w).collect()) for w in (1, 10**9)]
    assert runs[0] == runs[1] and dealt.pop() == sum(dealt) > 4 * 800
    n, m = np.array([3, 0, 20, 900]), np.array([5, 7, 0, 100])
    assert embedding_dedup.waves(n, m, 16, 800) == [(0, 3), (3, 4)] and len(dealt) > 2
    unit = np.array([r.embedding for r in data.orderBy("vec_id").collect()])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert [r[1] for r in runs[0]] == ((unit @ unit.T >= 0.95).sum(1) - 1).tolist()
