"""Matchers and studies without SQL, against dense numpy over the whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import sparse
from matchloom.plans import registry, variants
from matchloom.plans import tables as T
from matchloom.plans.kernels import local_patterns


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = T.feat(spark, sf_dir).orderBy("vec_id").collect()
    return {k: np.array([r[k] for r in rows]) for k in ("vec_id", "person", "known", "probe")} | {"v": np.array([r.v for r in rows])}


def dense_fisher(x, y):
    mean = x.mean(0)
    between, within = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for c in np.unique(y):
        rows = x[y == c]
        between += len(rows) * (rows.mean(0) - mean) ** 2
        within += ((rows - rows.mean(0)) ** 2).sum(0)
    return between / (within + 1e-9)


def test_local_pattern_forms_match_dense_vectors(spark, sf_dir, vectors):
    place = {v: i for i, v in enumerate(vectors["vec_id"].tolist())}
    x = np.zeros((len(place), 16384))
    for r in local_patterns(spark, sf_dir).collect():
        x[place[r.vec_id], int(r.cell) * 256 + r.code] = r.share
    assert np.allclose(x.sum(1), 64) and (x > 0).sum(1).max() <= 256
    member, probe = ~vectors["probe"] & vectors["known"], vectors["probe"]
    names, score = vectors["person"][member], dense_fisher(x[member], vectors["person"][member])
    got = {}
    for r in variants.lbph_matched(spark, sf_dir).collect():
        got.setdefault(r.form, {})[r.vec_id] = (r.name, r.d)
    assert len(got) == 18
    cells = [(r, c) for r in range(8) for c in range(8) if r in (2, 3) and 1 <= c <= 6 or r in (4, 5, 6) and 2 <= c <= 5]
    assert len(cells) == 24
    for form in variants.lbph_forms(spark).collect():
        bins = [i for i in range(16384) if not form.landmarks or (i // 2048, i // 256 % 8) in cells]
        order = sorted(bins, key=lambda i: (-round(score[i], 9), i))
        filled = x[member].any(0)
        chosen = [i for i in order if filled[i]][: form.k]  # bins that no member fills change no choice: they score least
        z = x[:, chosen]
        if form.bytes:
            z = np.clip(np.rint(z * (255 / z[member].max())), 0, 255)
        t, label = z[member], names
        if form.centroid:
            label = np.unique(names)
            t = np.array([z[member][names == c].mean(0) for c in label])
        assert set(got[form.form]) == set(vectors["vec_id"][probe].tolist())
        for v, q in zip(vectors["vec_id"][probe].tolist(), z[probe]):
            d = (0.5 * (t - q) ** 2 / (t + q + 1e-10)).sum(1)
            name, near = got[form.form][v]
            assert abs(near - d.min()) < 2e-6 and name in label[np.abs(d - d.min()) < 2e-6]


def test_sparse_neighbours_without_common_bins(spark):
    """A probe or template without any bin, and ones that share none, are matched as dense vectors would be."""
    p = {1: {0: 1.0}, 2: {}, 3: {5: 2.0, 6: 1.0}}
    t = {("a", 10): {1: 3.0}, ("b", 11): {5: 2.0}, ("c", 12): {2: 0.5}, ("d", 13): {2: 0.5}, ("e", 14): {0: 9.0}}
    rows = lambda x: [("f", *k, b, v) for k, bins in x.items() for b, v in bins.items()]
    probes = spark.createDataFrame(rows({(k,): v for k, v in p.items()}), "form string, id long, bin int, x double")
    gallery = spark.createDataFrame(rows(t), "form string, name string, template long, bin int, x double")
    got = {r.id: (r.name, r.d) for r in sparse.nearest(probes, spark.createDataFrame([("f", k) for k in p], "form string, id long"), gallery, spark.createDataFrame([("f", *k) for k in t], "form string, name string, template long")).collect()}
    assert got == {1: ("c", 0.75), 2: ("c", 0.25), 3: ("b", 0.5)}


def test_fisher_scores_with_implicit_zeros(spark):
    rng = np.random.default_rng(3)
    x = rng.random((60, 12)) * (rng.random((60, 12)) < 0.3)
    y = np.arange(60) % 5
    features = spark.createDataFrame([(int(i), int(b), float(x[i, b])) for i, b in zip(*np.nonzero(x))], "id long, bin int, x double")
    rows = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "id long, name int")
    got = {r.bin: r.score for r in sparse.fisher(features, rows, "name").collect()}
    assert np.allclose([got[b] for b in range(12)], dense_fisher(x, y))


def test_subspace_matchers_match_numpy(spark, sf_dir, vectors):
    member, probe = ~vectors["probe"] & vectors["known"], vectors["probe"]
    x, names = vectors["v"], vectors["person"][member]
    mean = x[member].mean(0)
    values, axes = np.linalg.eigh(np.cov(x[member].T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    got = {}
    for r in variants.subspace_matched(spark, sf_dir).collect():
        got.setdefault((r.family, r.variant), {})[r.vec_id] = (r.name, r.d)
    assert len(got) == 2 * 24 + 16
    for family, k in (("eigenfaces", 64), ("eigenfaces-capped", variants.CAPPED)):
        for drop in (0, 1, 2):
            for distance in ("l2", "cosine", "whiten-l2", "whiten-cosine"):
                z = ((x - mean) @ axes[:, :k])[:, drop:]
                z = z / np.sqrt(values[drop:k]) if distance.startswith("whiten") else z
                z = z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-12) if distance.endswith("cosine") else z
                for gallery in ("nn", "centroid"):
                    t, label = z[member], names
                    if gallery == "centroid":
                        label = np.unique(names)
                        t = np.array([z[member][names == c].mean(0) for c in label])
                    for v, q in zip(vectors["vec_id"][probe].tolist(), z[probe]):
                        d = np.sqrt(((t - q) ** 2).sum(1))
                        name, near = got[family, f"{k - drop}c-drop{drop}-{distance}-{gallery}"][v]
                        assert abs(near - d.min()) < 2e-6 and name in label[np.abs(d - d.min()) < 2e-6]


def test_variant_report(spark, sf_dir):
    rows = registry.queries()["q15_variant_report"](spark, sf_dir).collect()
    assert len(rows) == 18 + 64
    for family in ("lbph", "eigenfaces", "fisherfaces"):
        own = sorted((r for r in rows if r.family == family), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and [r.unedited for r in own].count(True) == 1 and own[0].unedited
        assert [r.tar_percent for r in own[1:]] == sorted((r.tar_percent for r in own[1:]), reverse=True)
    scores = variants.as_scores(variants.lbph_matched(spark, sf_dir), ["form"]).toPandas()
    for r in rows:
        if r.family == "lbph":
            s = scores[scores.form == r.variant]
            imp, gen = np.sort(s[s.kind == "impostor"].d), s[s.kind == "genuine"]
            k = 1058 * len(imp) // 100_000
            t = imp[k - 1] if k >= 1 else imp[0] - 1e-9
            assert abs(r.tar_percent - 100 * (gen.ok & (gen.d <= t)).mean()) < 1e-5 and abs(r.rank1_percent - 100 * gen.ok.mean()) < 1e-5
            assert r.spec_resolvable == (10 * len(imp) >= 100_000) and r.n_impostor == len(imp)


def test_fisher_basis_of_pairs(spark, sf_dir, vectors):
    from test_operators import numpy_lda

    x, person = vectors["v"], vectors["person"]
    fit = [i for c in sorted(set(person.tolist()))[:500] for i in np.flatnonzero(person == c)[:2] if (person == c).sum() >= 2]
    axes = numpy_lda(x[fit], person[fit], min(49, len(set(person[fit].tolist())) - 1))
    want = (x - x[fit].mean(0)) @ axes
    got = {r.vec_id: r.p for r in registry.queries()["l5_fisher_basis"](spark, sf_dir).collect()}
    assert np.allclose(np.abs([got[v] for v in vectors["vec_id"].tolist()]), np.abs(want), atol=1e-3)


def test_discriminant_study(spark, sf_dir, vectors):
    member = ~vectors["probe"] & vectors["known"]
    people = np.unique(vectors["person"][member])
    got = {(r.one, r.two, r.images, r.run): r.distance for r in registry.queries()["l12_discriminant_study"](spark, sf_dir).collect()}
    assert set(got) == {(a, b, n, run) for a, b in zip(people, people[1:]) for n in (1, 3, 5, 7, 10) for run in range(1, 11)}
    for (a, b, n, _), distance in got.items():
        x, y = (vectors["v"][member & (vectors["person"] == c)] for c in (a, b))
        n = min(n, len(x), len(y))
        x, y = x[:n], y[:n]
        rows = np.concatenate([x, y])
        if n == 1:
            assert abs(distance - np.linalg.norm(x[0] - y[0])) < 2e-6
            continue
        basis = np.linalg.eigh(np.cov(rows.T, bias=True))[1][:, ::-1][:, : 2 * n - 2]
        p, q = x @ basis, y @ basis
        within = len(p) * (np.cov(p.T, bias=True) + np.cov(q.T, bias=True))
        axis = np.linalg.solve(np.atleast_2d(within), p.mean(0) - q.mean(0))
        assert abs(distance - abs((p[0] - q[0]) @ axis) / np.linalg.norm(axis)) < 1e-4


def test_two_class_distance_of_equal_rows():
    x = np.ones((3, 4))
    assert variants.two_class_distance(x, x) == 0.0 and variants.two_class_distance(x[:1], x[:1] + 1) == 2.0


def test_landmark_cells_are_the_mask_of_the_vectors(spark):
    on = {r.id for r in spark.range(16384).where(variants.at_landmark(F.col("id"))).collect()}
    assert len(on) == 24 * 256 and min(on) == 17 * 256


def test_config_sweep_matches_numpy(spark, sf_dir, vectors):
    from matchloom.functions import grids as G
    from matchloom.plans.kernels import tiles

    on = {"equalize": G.equalized(F.col("tile")), "clahe": G.clahe(F.col("tile"), 8), "tan-triggs": G.tan_triggs(F.col("tile"), 8)}
    images = {r.vec_id: r for r in tiles(spark, sf_dir).select("vec_id", *[x.alias(e) for e, x in on.items()]).collect()}
    member, probe = ~vectors["probe"] & vectors["known"], vectors["probe"]
    names, ids = vectors["person"][member], vectors["vec_id"][probe].tolist()
    got = {(r.family, r.equalization, r.num_components): r for r in registry.queries()["l10_published_sweep"](spark, sf_dir).collect()}
    assert len(got) == 3 * (8 + 3)
    for e in on:
        x = np.array([images[v][e] for v in vectors["vec_id"].tolist()], float)
        mean = x[member].mean(0)
        axes = np.linalg.eigh(np.cov(x[member].T, bias=True))[1][:, ::-1]
        for n in (0, 20, 40, 60, 80, 100, 150, 200):
            z = (x - mean) @ axes[:, : n or 64]
            d = np.sqrt(((z[probe][:, None] - z[member][None]) ** 2).sum(-1))
            near, name = d.min(1).round(6), names[d.argmin(1)]
            known, ok = vectors["known"][probe], name == vectors["person"][probe]
            imp = np.sort(near[~known])
            k = 1058 * len(imp) // 100_000
            t = imp[k - 1] if k >= 1 else imp[0] - 1e-9
            r = got["eigenfaces", e, n]
            assert r.n_impostor == len(imp) and r.feature_bytes == 4 * z.shape[1] and len(ids) == len(near)
            assert abs(r.rank1_percent - 100 * ok[known].mean()) < 1e-5 and abs(r.threshold - t) < 2e-6 * max(1, t)
            assert abs(r.far_percent - 100 * (imp <= t).mean()) < 1e-5 and abs(r.frr_percent + r.tar_percent - 100) < 1e-6


def test_recipes_hold_what_they_say(spark, sf_dir, vectors):
    got = {(r.recipe, r.family, r.testset): r for r in registry.queries()["l13_augmented_recipes"](spark, sf_dir).collect()}
    assert len(got) == 5 * 2 * 3
    member, light = ~vectors["probe"] & vectors["known"], vectors["vec_id"] % 3 != 2
    want = {"clean": member.sum(), "aug_light": 2 * member.sum(), "aug_light_medium": 3 * member.sum(), "light_only": (member & light).sum(), "dark_only": (member & ~light).sum()}
    asked = {"full": vectors["probe"] & vectors["known"], "light": vectors["probe"] & vectors["known"] & light, "dark": vectors["probe"] & vectors["known"] & ~light}
    assert all(r.train_images == want[recipe] and r.n == asked[testset].sum() and 0 <= r.rank1_percent <= 100 for (recipe, _, testset), r in got.items())


def nearest_rows(x, names, ids, member, probe, project):
    z = project(x)
    d = np.sqrt(((z[probe][:, None] - z[member][None]) ** 2).sum(-1))
    return {v: (set(names[member][np.abs(row - row.min()) < 2e-6]), row.min()) for v, row in zip(ids[probe].tolist(), d)}


def test_subspace_queries_match_numpy(spark, sf_dir, vectors):
    from test_operators import numpy_lda

    x, names, ids = vectors["v"], vectors["person"], vectors["vec_id"]
    member, probe = ~vectors["probe"] & vectors["known"], vectors["probe"]
    mean = x[member].mean(0)
    axes = np.linalg.eigh(np.cov(x[member].T, bias=True))[1][:, ::-1]
    run = lambda name: registry.queries()[name](spark, sf_dir).collect()
    for name, basis in (("l1_eigen_subspace", axes[:, :50]), ("l2_fisher_subspace", numpy_lda(x[member], names[member], len(set(names[member].tolist())) - 2))):
        want, got = nearest_rows(x, names, ids, member, probe, lambda v, b=basis: (v - mean) @ b), run(name)
        assert len(got) == len(want)
        for r in got:
            close, d = want[r.vec_id]
            assert r.name in close and abs(r.distance - d) < 1e-3
    squares = ((x - mean) @ axes[:, :4]) ** 2
    got = {r.vec_id: r.squares for r in run("i11_projection")}
    assert np.allclose([got[v] for v in ids.tolist()], squares, atol=2e-6)
    chosen = {r.vec_id for r in T.members(spark, sf_dir).orderBy(F.xxhash64("vec_id")).limit(200).select("vec_id").collect()}
    some = np.isin(ids, list(chosen))
    own = np.linalg.eigh(np.cov(x[some].T, bias=True))[1][:, ::-1][:, :20]
    z = (x - x[some].mean(0)) @ own
    got = {r.vec_id: r.length for r in run("l4_basis_on_sample")}
    assert np.allclose([got[v] for v in ids.tolist()], np.linalg.norm(z, axis=1), atol=1e-3)
    d = np.sort(np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))[np.triu_indices(len(z), 1)])
    for r in run("q6_subspace_independence"):
        assert abs(r.d - d[(r.k + 1) // 2 - 1]) < 1e-3
