"""Embedding near-dedup and nearest neighbours against brute force, with odd rows."""

import numpy as np
import pytest

from matchloom.llm import embedding_dedup, hamming_search, hnsw

SCHEMA = "vec_id long, embedding array<double>, label int, cls string, v string"


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1, "c", "v"), (901, [], 1, "c", "v"), (902, [0.0] * 8, 1, "c", "v"), (903, [1.0, None] + [0.0] * 6, 1, "c", "v"), (904, [nan] + [1.0] * 7, 1, "c", "v"), (905, [inf] + [1.0] * 7, None, "c", "v"), (906, [1.0, 2.0, 3.0], 1, "c", "v"), (907, [-0.0, 2.0, 3.0], 1, None, None)]


def vectors(spark, n=400, seed=0, spread=0.05):
    """Random vectors, chains and groups of near copies, exact copies, and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.standard_normal(8) * spread * (rng.random() < 0.8)
        else:
            v = rng.standard_normal(8)
        rows.append((i, [float(x) for x in v], int(i % 10), "c", "v"))
    return spark.createDataFrame(rows + odd_rows(), SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


@pytest.mark.parametrize("shard", [10_000, 60])
def test_links_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    df = vectors(spark)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, 0.95).collect()}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = dict.fromkeys(parent, 0)
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if usable(v)]
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y >= 0.95:
                count[i] += 1
                count[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], find(i), find(i) == i)


def test_links_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_widened_beams_hold_large_groups():
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(32)
    x = np.concatenate([rng.standard_normal((600, 32)), centre + rng.standard_normal((900, 32)) * 0.02])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = hnsw.build(x)
    s = embedding_dedup.Shard.__new__(embedding_dedup.Shard)
    s.ids, s.weights, s.unit, s.graph, s.beam = np.arange(len(x)), np.ones(len(x), int), x.astype(float), g, hnsw.audited_beam(g, 0.95, 0.998)
    found = embedding_dedup.links(s, s, 0.95, True)
    true = x @ x.T >= 0.95
    np.fill_diagonal(true, False)
    n = sum(len(r) for r, _ in found.chunks())
    assert true.sum() > 800_000 and abs(n - true.sum()) <= 1e-4 * true.sum()


def test_search_recall_and_order(spark):
    df = vectors(spark, 600, 3, 0.3)
    rows = {r.vec_id: r.embedding for r in df.collect() if usable(r.embedding)}
    got = hamming_search.search(df, df.where("vec_id % 20 = 0"), 10).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    asked = [i for i in rows if i % 20 == 0]
    hits = total = 0
    for q in asked:
        others = sorted((float(np.sqrt(((np.array(v) - rows[q]) ** 2).sum())), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
        mine = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, min(10, len(others)) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - dict((i, d) for d, i in others)[r.vec_id]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & {i for _, i in others[:10]})
        total += min(10, len(others))
    assert hits / total >= 0.95


def test_search_few_rows_ties_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in hamming_search.search(df, df.where("vec_id = 0"), 10).collect())
    assert got == [(0, 1, 2, 0.0), (0, 2, 3, 0.0), (0, 3, 1, 1.414214)]
    assert hamming_search.search(df.limit(0), df.limit(0)).collect() == []


def test_pigeonhole_probing_is_complete():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 1 << 63, (3000, hamming_search.SUBSTRINGS)).astype(np.uint64)
    code[1000:2000] = code[:1000] ^ ((rng.random((1000, hamming_search.SUBSTRINGS)) < 0.5) * 3).astype(np.uint64)
    index = hamming_search.Index(code)
    for q in code[:20]:
        for r in (0, 5, 17, 40, 200, 260):
            assert set(index.within(q, r)) == set(np.flatnonzero(np.bitwise_count(code ^ q).sum(1) <= r))


def test_search_of_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.9, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    ask = lambda k: [(r.rank, r.vec_id) for r in hamming_search.search(df, df.where("vec_id = 0"), k).orderBy("rank").collect()]
    assert ask(3) == [(1, 1), (2, 1), (3, 2)] and ask(10) == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_query_op9_recall_and_share_probed(spark):
    df = hamming_search.op9_hamming(spark, "/root/testdata/sf0.1").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    v, ids = np.stack(rows.embedding.to_list()).astype(float), rows.vec_id.to_numpy()
    hits = 0
    asked = sorted(ids[ids % 100 == 0])
    model = hamming_search.Codes(v, 10)
    code = model.encode(v)
    index, near = hamming_search.Index(code), 0
    for q in asked:
        at = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((v - v[at]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = df[df.query_id == q].sort_values("rank")
        assert np.allclose(mine.score, [d[int(np.flatnonzero(ids == x)[0])] for x in mine.vec_id], rtol=0, atol=1e-12)
        hits += len(set(mine.vec_id) & set(ids[order]))
        near += len(index.within(code[at], int(model.radii(code[at : at + 1])[0])))
    probed, ranked = index.probed / (len(asked) * len(v)), near / (len(asked) * len(v))
    print(f"recall {hits / (10 * len(asked)):.3f}, probed {probed:.3f}, ranked {ranked:.3f}")
    assert hits >= 0.95 * 10 * len(asked) and probed < 0.5 and ranked < 0.15


def test_query_op1_links_planted_copies_of_real_dimension(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1500, 64))
    near = base[:400] + rng.standard_normal((400, 64)) * np.repeat([0.1, 0.2, 0.3, 0.34], 100)[:, None]
    v = np.concatenate((base, near, base[:50])).astype(np.float32)
    spark.createDataFrame([(i, [float(y) for y in x], i % 7) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    got = embedding_dedup.op1_hnsw(spark, str(tmp_path)).toPandas().set_index("vec_id").sort_index()
    assert links.sum() > 500 and (got.n_links.to_numpy() <= links.sum(1)).all() and got.n_links.sum() >= 0.99 * links.sum()
