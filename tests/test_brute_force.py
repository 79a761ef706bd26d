"""Operators against straightforward numpy on small random data."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phenogrid.operators import anova, distance, multiple, pca, permanova, posthoc, regression, relate, scale, summarize
from phenogrid.operators.ordering import group_quantiles, quantile_points, running_counts


def design(pdf, term):
    if not term:
        return np.ones((len(pdf), 1))
    return pd.get_dummies(pdf[list(term)].agg("|".join, axis=1)).to_numpy(float)


def fitted(pdf, terms, y):
    x = np.hstack([design(pdf, t) for t in terms])
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=1e-9)
    return x @ beta, rank


def random_trial(seed, n_factors, drop=()):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "t"][:n_factors]
    rows = []
    for feature in ("f1", "f2"):
        for _ in range(90):
            cell = [str(rng.choice(["x", "y", "z"][: 3 if c == "a" else 2])) for c in names]
            if tuple(cell) in drop:
                continue
            rows.append((feature, *cell, float(rng.normal(100, 1) + (cell[0] == "x"))))
    return pd.DataFrame(rows, columns=["feature", *names, "value"]), names


@pytest.mark.parametrize("n_factors,drop", [(2, ()), (3, ()), (3, (("x", "x", "y"), ("z", "y", "x"))), (2, (("y", "x"),))])
def test_factorial_is_nested_least_squares(spark, n_factors, drop):
    pdf, names = random_trial(n_factors, n_factors, drop)
    out = anova.anova_factorial(spark.createDataFrame(pdf), "feature", "value", names)
    got = {(r["feature"], r["term"]): r for r in out.collect()}
    terms = [tuple(c) for k in range(1, n_factors + 1) for c in combinations(names, k)]
    for feature, part in pdf.groupby("feature"):
        y = part["value"].to_numpy() - part["value"].mean()
        used, before, rank0 = [()], np.zeros(len(y)), 1
        full, rank_full = fitted(part, [(), *terms], y)
        resid = len(y) - rank_full
        for term in terms:
            used.append(term)
            now, rank = fitted(part, used, y)
            r = got[feature, ":".join(term)]
            assert r["ss"] == pytest.approx(np.sum((now - before) ** 2), abs=1e-8)
            assert r["df"] == rank - rank0 and r["df_resid"] == resid
            before, rank0 = now, rank
        assert r["rss"] == pytest.approx(np.sum((y - full) ** 2))


def test_tukey_means_of_three_factors(spark):
    pdf, names = random_trial(5, 3)
    out = posthoc.tukey_hsd(spark.createDataFrame(pdf), "feature", "value", names, p=False)
    got = {(r["feature"], r["term"], r["contrast"]): r["diff"] for r in out.collect()}
    terms = [tuple(c) for k in range(1, 4) for c in combinations(names, k)]
    for feature, part in pdf.groupby("feature"):
        y = part["value"].to_numpy() - part["value"].mean()
        effects, used, before = {}, [()], np.zeros(len(y))
        for term in terms:
            used.append(term)
            now, _ = fitted(part, used, y)
            effects[term], before = now - before, now
        for term in terms:
            whole = sum(e for t, e in effects.items() if set(t) <= set(term))
            means = pd.Series(whole).groupby(part[list(term)].agg(":".join, axis=1).to_numpy()).mean()
            order = sorted(means.index, key=lambda s: s.split(":")[::-1])
            for i, j in combinations(range(len(order)), 2):
                d = got[feature, ":".join(term), f"{order[j]}-{order[i]}"]
                assert d == pytest.approx(means[order[j]] - means[order[i]], abs=1e-9)


def test_two_levels_give_pooled_t(spark, tumor):
    f = anova.anova_oneway(tumor, "feature", "value", "a").first()
    t = posthoc.pairwise_contrasts(tumor, "feature", "value", "a").first()
    assert t["t"] ** 2 == pytest.approx(f["f"]) and t["p"] == pytest.approx(f["p"], abs=1e-10)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, values tie heavily, and some are zero, negative or missing."""
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.integers(-3, 4, 3000) * rng.choice([1.0, 1e-9, 1e6, 0.37], 3000)]
    rows += [("cold", float(v)) for v in rng.normal(0, 1, 37)] + [("one", 5.0), ("hot", None), ("hot", float("nan"))]
    rows += [(None, 1.0), (None, 2.0)]
    return rows, spark.createDataFrame(rows, "g string, v double")


def clean_groups(rows):
    out = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            out.setdefault(g, []).append(v)
    return out


def test_quantiles_of_skewed_groups(skewed):
    rows, df = skewed
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p999": 0.999, "p1": 1.0}
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "v", probs).collect()}
    groups = clean_groups(rows)
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)
    whole = sorted(quantile_points(df, [], "v", [0.25, 0.75]).collect(), key=lambda r: r["i"])
    every = sum(groups.values(), [])
    assert [r["q"] for r in whole] == pytest.approx([np.quantile(every, 0.25), np.quantile(every, 0.75)])


def test_running_counts(skewed):
    rows, df = skewed
    got = running_counts(df, ["g"], "v").collect()
    for g, values in clean_groups(rows).items():
        mine = [r for r in got if r["_key"]["g"] == g]
        assert {r["_v"]: (r["w"], r["upto"], r["total"]) for r in mine} == {
            v: (values.count(v), sum(x <= v for x in values), len(values)) for v in set(values)
        }


def adjust(p, method):
    p = np.asarray(p)
    order, n = np.argsort(p, kind="stable"), len(p)
    rank = np.arange(1, n + 1)
    if method == "fdr":
        s = np.minimum.accumulate((n / rank * p[order])[::-1])[::-1]
    else:
        s = np.maximum.accumulate((n - rank + 1) * p[order])
    out = np.empty(n)
    out[order] = np.minimum(s, 1)
    return out


@pytest.mark.parametrize("method", ["fdr", "holm"])
def test_adjustment_with_a_hot_family_and_ties(spark, method):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(2500) ** 3, 3)
    p[:800] = 1.0
    family = np.where(rng.random(2500) < 0.9, "big", "small")
    df = spark.createDataFrame([(i, f, float(x)) for i, (f, x) in enumerate(zip(family, p))], "i int, f string, p double")
    df = df.unionByName(spark.createDataFrame([(-1, "big", None)], "i int, f string, p double"))
    got = {r["i"]: r["p_adj"] for r in multiple.p_adjust(df, "p", method, within=("f",)).collect()}
    assert len(got) == 2501 and got[-1] is None
    for f in ("big", "small"):
        at = np.flatnonzero(family == f)
        np.testing.assert_allclose([got[int(i)] for i in at], adjust(p[at], method), rtol=1e-12)


def test_adjustments_are_ordered(spark):
    df = spark.range(200).select(((F.col("id") * 37 % 200 + 1) / 2000).alias("p"))
    for m in ("fdr", "holm", "bonferroni"):
        df = multiple.p_adjust(df, "p", m, out=m)
    assert df.where("fdr > holm OR holm > bonferroni OR p > fdr").count() == 0


def test_five_number_and_whiskers(skewed):
    rows, df = skewed
    exact = {r["g"]: r for r in summarize.five_number(df, ["g"], "v").collect()}
    for g, values in clean_groups(rows).items():
        q1, q3 = np.quantile(values, [0.25, 0.75])
        near = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
        assert (exact[g]["lo_whisker"], exact[g]["hi_whisker"]) == (min(near), max(near))
    rough = {r["g"]: r for r in summarize.five_number(df, ["g"], "v", exact=False).collect()}
    assert set(rough) == set(exact) and all(rough[g]["max"] == exact[g]["max"] for g in exact)


def test_qq_points(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(3, 2, 500)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = sorted(summarize.qq_points(df, "v", 9).collect(), key=lambda r: r["point"])
    at = (np.arange(1, 10) - 0.5) / 9
    assert [r["sample_quantile"] for r in rows] == pytest.approx(list(np.quantile(values, at)))
    assert rows[4]["theoretical"] == pytest.approx(0, abs=1e-12)
    assert rows[8]["theoretical"] == pytest.approx(1.5932188180, abs=1e-8)


def test_quantile_normalisation_shares_one_distribution(spark):
    rng = np.random.default_rng(5)
    wide = rng.normal(size=(4, 30))
    wide[1, :6] = 0.5
    rows = [(s, j, float(wide[s, j])) for s in range(4) for j in range(30)]
    df = spark.createDataFrame(rows, "s int, f int, v double")
    got = {(r["s"], r["f"]): r["scaled"] for r in scale.quantile_normalise(df, "s", "v").collect()}
    goal = np.sort(wide, axis=1).mean(axis=0)
    for s in range(4):
        rank = pd.Series(wide[s]).rank().to_numpy() - 1
        want = (goal[np.floor(rank).astype(int)] + goal[np.ceil(rank).astype(int)]) / 2
        np.testing.assert_allclose([got[s, j] for j in range(30)], want)


def test_quantile_normalisation_of_unequal_samples(spark):
    rng = np.random.default_rng(6)
    samples = {s: np.round(rng.normal(size=n) * 3, 1) for s, n in enumerate([10, 5, 5, 1, 33, 2, 1000])}
    samples["none"], samples["same"] = np.array([]), np.full(4, 2.5)
    rows = [(str(s), j, float(v)) for s, x in samples.items() for j, v in enumerate(x)] + [("0", 10, None), ("none", 0, None), ("4", 99, float("nan"))]
    df = spark.createDataFrame(rows, "s string, f int, v double")
    got = {(r["s"], r["f"]): r["scaled"] for r in scale.quantile_normalise(df, "s", "v").collect()}
    assert len(got) == len(rows) and [got[k] for k in (("0", 10), ("none", 0), ("4", 99))] == [None] * 3
    lines = [(np.linspace(0, 1, len(x)), np.sort(x)) for x in samples.values() if len(x) > 1]
    alone = [x[0] for x in samples.values() if len(x) == 1]
    common = lambda u: (sum(np.interp(u, *line) for line in lines) + sum(alone)) / (len(lines) + len(alone))
    for s, x in samples.items():
        goals = common(np.linspace(0, 1, len(x)) if len(x) > 1 else np.full(len(x), 0.5))
        rank = pd.Series(x).rank().to_numpy() - 1
        have = np.array([got[str(s), j] for j in range(len(x))])
        if len(x):
            np.testing.assert_allclose(have, (goals[np.floor(rank).astype(int)] + goals[np.ceil(rank).astype(int)]) / 2, atol=1e-9)
        assert (np.diff(have[np.argsort(x, kind="stable")]) >= -1e-9).all()
    ends = [(min(v), max(v)) for v in ([got[str(s), j] for j in range(n)] for s, n in ((1, 5), (2, 5)))]
    assert ends[0] == pytest.approx(ends[1], abs=1e-9)


def test_swept_lines_in_many_ranges(spark):
    rng = np.random.default_rng(8)
    u = np.append(np.round(rng.random(300), 2), [0.0, 1.0])
    bend = rng.normal(size=len(u))
    made = scale._swept(spark.createDataFrame(list(zip(u.tolist(), bend.tolist())), "u double, bend double"), 5.0, most=7)
    got = {r["u"]: r["total"] for r in made.collect()}
    assert set(got) == set(u)
    for at in got:
        assert got[at] == pytest.approx(5.0 + (bend * np.maximum(at - u, 0)).sum(), abs=1e-9)


def test_pca_of_correlations(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    x = np.hstack([x, np.full((60, 1), 7.0)])  # a constant feature carries no variance
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "s int, v array<double>")
    out = pca.pca(df, ["s"], "v", 5, list("abcdef"))
    values, vectors = np.linalg.eigh(np.corrcoef(x[:, :5].T))
    values, vectors = values[::-1], vectors[:, ::-1]
    eigen = sorted(out.eigen.collect())
    np.testing.assert_allclose([r["eigenvalue"] for r in eigen], values)
    assert eigen[-1]["cum_pct"] == pytest.approx(100) and sum(r["eigenvalue"] for r in eigen) == pytest.approx(5)
    z = (x[:, :5] - x[:, :5].mean(0)) / x[:, :5].std(0)
    turn = np.sign(vectors[np.abs(vectors).argmax(0), range(5)])
    scores = {r["s"]: [r[f"pc{i}"] for i in range(1, 6)] for r in out.scores.collect()}
    np.testing.assert_allclose([scores[i] for i in range(60)], z @ (vectors * turn), atol=1e-8)
    share = (values[0] * vectors[:, 0] ** 2 + values[1] * vectors[:, 1] ** 2) * 100 / (values[0] + values[1])
    top = pca.pca_contributions(out, 3).collect()
    assert [r["contrib"] for r in top] == pytest.approx(sorted(share, reverse=True)[:3])
    groups = out.scores.withColumn("g", F.col("s") % 2)
    e = {r["g"]: r for r in pca.group_ellipse(groups, "g").collect()}
    assert e[0]["vxy"] == pytest.approx(np.cov(np.array([scores[i] for i in range(0, 60, 2)])[:, :2].T)[0, 1])


def test_packing_fills_and_averages(spark):
    rows = [("s1", "a", 1.0), ("s1", "a", 3.0), ("s1", "c", 5.0), ("s2", "b", 2.0), ("s2", "other", 9.0), ("s2", "c", None)]
    df = spark.createDataFrame(rows, "s string, f string, v double")
    got = {r["s"]: r["vector"] for r in scale.pack_vectors(df, ["s"], "f", "v", ["a", "b", "c"]).collect()}
    assert got == {"s1": [2.0, 0.0, 5.0], "s2": [0.0, 2.0, 0.0]}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    groups = rng.choice(["u", "v", "w"], 700, p=[0.7, 0.2, 0.1])
    x = rng.random((700, 4)) + 0.05 * (groups == "w")[:, None]
    df = spark.createDataFrame([(i, str(g), [float(v) for v in r]) for i, (g, r) in enumerate(zip(groups, x))], "s int, g string, v array<double>")
    return x, groups, df.cache()


def full_distances(x, metric):
    gap = x[:, None] - x[None]
    if metric == "euclidean":
        return np.sqrt((gap**2).sum(2))
    return np.abs(gap).sum(2) / (x[:, None] + x[None]).sum(2)


@pytest.mark.parametrize("metric", ["euclidean", "bray"])
def test_distances_over_several_blocks(cloud, metric):
    x, _, df = cloud
    got = distance.pairwise_distance(df, "s", "v", metric).toPandas()
    assert len(got) == 700 * 699 // 2 and (got["i"] < got["j"]).all() and not got.duplicated(["i", "j"]).any()
    np.testing.assert_allclose(got["d"], full_distances(x, metric)[got["i"], got["j"]], rtol=1e-9)


def plain_test(d, groups):
    levels, n = np.unique(groups), len(groups)
    sst = np.triu(d**2, 1).sum() / n
    ssw = sum(np.triu(d[np.ix_(groups == g, groups == g)] ** 2, 1).sum() / (groups == g).sum() for g in levels)
    k = len(levels)
    return ((sst - ssw) / (k - 1)) / (ssw / (n - k)), (sst - ssw) / sst


def test_permanova_forms_agree(cloud):
    x, groups, df = cloud
    f, r2 = plain_test(full_distances(x, "euclidean"), groups)
    pairs = distance.pairwise_distance(df, "s", "v")
    outs = [
        permanova.permanova(df, "s", "v", "g", "euclidean", 99, seed=3),
        permanova.permanova_euclidean(df, "s", "v", "g", 99, seed=3),
        permanova.permanova_from_distances(pairs, df.select("s", "g"), "s", "g", 99, seed=3),
    ]
    rows = [o.where("term = 'group'").first() for o in outs]
    for r in rows:
        assert r["f"] == pytest.approx(f) and r["r2"] == pytest.approx(r2)
    assert len({r["p"] for r in rows}) == 1  # the same permutations in all three


def test_large_blocks_and_small_steps_change_nothing(cloud, monkeypatch):
    """Memory limits decide how the work is cut, not what comes out; samples are read once."""
    _, _, df = cloud
    run = lambda: (
        permanova.permanova(df, "s", "v", "g", "bray", 49, seed=5),
        permanova.permanova_euclidean(df, "s", "v", "g", 49, seed=5),
    )
    rows = [[tuple(r) for r in o.collect()] for o in run()]
    for cells in (64, 4096, 1 << 30):
        monkeypatch.setattr(distance, "CELLS", cells)
        monkeypatch.setattr(permanova, "CELLS", cells)
        for made, want in zip(run(), rows):
            for r, w in zip(made.collect(), want):
                assert tuple(r) == pytest.approx(w)
    text = run()[1]._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("_cells") and text.count("Relation") == 1


def test_blocks_move_once_for_each_large_block(spark):
    rng = np.random.default_rng(9)
    shuffled = {}
    for n in (2000, 8000):
        rows = pd.DataFrame({"_r": range(n), "_x": rng.random((n, 8)).tolist()})
        placed = spark.createDataFrame(rows, "_r long, _x array<double>").withColumn("_blk", F.floor(F.col("_r") / distance.BLOCK).cast("int"))
        blocks = distance.packed(placed)
        total, g = distance.grid(blocks)
        tiles = distance.large_tiles(blocks, total, g)
        assert total == -(-n // distance.BLOCK) and tiles.count() == total * g
        assert tiles.select("_lo", "_hi").distinct().count() == g * (g + 1) // 2
        shuffled[n] = tiles.agg(F.sum(F.length("_cells"))).first()[0] / g
        assert distance.grid(blocks, 1)[1] == total
    assert shuffled[8000] == 4 * shuffled[2000]  # bytes in proportion to samples x large blocks
    with pytest.raises(Exception, match="shape|size"):
        distance.pairwise_distance(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "s int, v array<double>"), "s", "v").collect()


def test_pairwise_permanova(cloud):
    x, groups, df = cloud
    d = full_distances(x, "bray")
    out = permanova.permanova_pairwise(df, "s", "v", "g", "bray", 49)
    got = {r["pair"]: r for r in out.where("term = 'group'").collect()}
    for g, h in combinations("uvw", 2):
        keep = (groups == g) | (groups == h)
        f, r2 = plain_test(d[np.ix_(keep, keep)], groups[keep])
        assert got[f"{g} vs {h}"]["f"] == pytest.approx(f) and got[f"{g} vs {h}"]["r2"] == pytest.approx(r2)


def test_permutation_p_is_near_the_exact_one(spark):
    values = [0.0, 0.3, 0.9, 1.1, 1.2, 2.0, 0.2]
    groups = np.array(list("uuuvvvu"))
    df = spark.createDataFrame([(i, str(g), [v]) for i, (g, v) in enumerate(zip(groups, values))], "s int, g string, v array<double>")
    d = np.abs(np.subtract.outer(values, values))
    f0 = plain_test(d, groups)[0]
    every = []
    for pick in combinations(range(7), 3):
        g = np.array(["u"] * 7)
        g[list(pick)] = "v"
        every.append(plain_test(d, g)[0] >= f0 - 1e-9)
    p = permanova.permanova(df, "s", "v", "g", "euclidean", 1999, seed=11).where("term = 'group'").first()["p"]
    assert p == pytest.approx(np.mean(every), abs=0.03)


def test_gate(cloud):
    _, _, df = cloud
    whole, pairs = permanova.permanova_gated(df, "s", "v", "g", "bray", 49, alpha=1.01)
    assert pairs is not None and pairs.where("term = 'group'").count() == 3
    _, none = permanova.permanova_gated(df, "s", "v", "g", "bray", 49, alpha=0.0)
    assert none is None


@pytest.mark.parametrize("n", [2, 5, 300, 513, 1000])
def test_permuted_numbers_are_bijections(n):
    perms = np.arange(20)
    image = permanova.permuted_numbers(np.arange(n), n, perms, seed=9)
    assert (np.sort(image, axis=1) == np.arange(n)).all() and (image[0] == np.arange(n)).all()
    part = permanova.permuted_numbers(np.arange(n)[1::2], n, perms, seed=9)
    assert (part == image[:, 1::2]).all()
    other = permanova.permuted_numbers(np.arange(n), n, perms, seed=10)
    assert n == 2 or (other != image).any()


@pytest.mark.parametrize("n", [1, 3, 511, 512])
def test_every_permutation_is_one(n):
    perms = np.arange(40)
    image = permanova.permuted_numbers(np.arange(n), n, perms, seed=4)
    assert (np.sort(image, axis=1) == np.arange(n)).all() and (image[0] == np.arange(n)).all()
    some = np.arange(n)[::3]
    assert (permanova.permuted_numbers(some, n, perms, seed=4) == image[:, some]).all()


def test_all_permutations_are_equally_likely():
    for n in (3, 4, 5):
        images = permanova.permuted_numbers(np.arange(n), n, np.arange(1, 24001), seed=2)
        codes = images @ (n ** np.arange(n))
        _, seen = np.unique(codes, return_counts=True)
        kinds = math.factorial(n)
        assert len(seen) == kinds
        chance = 24000 / kinds
        assert ((seen - chance) ** 2 / chance).sum() < kinds - 1 + 4 * math.sqrt(2 * (kinds - 1))
    for n in (511, 512, 513):
        images = permanova.permuted_numbers(np.array([0, 1, n // 2, n - 1]), n, np.arange(1, 40001), seed=3)
        inside = np.bincount(np.arange(n) * 8 // n)
        likely = (np.outer(inside, inside) - np.diag(inside)) / (n * (n - 1)) * 40000
        for i, j in combinations(range(4), 2):  # pairs of images over a grid of 8 x 8
            seen = np.bincount(images[:, i] * 8 // n * 8 + images[:, j] * 8 // n, minlength=64).reshape(8, 8)
            assert ((seen - likely) ** 2 / likely).sum() < 63 + 4 * math.sqrt(2 * 63)


def test_fitted_line_has_the_limits_of_a_textbook(spark):
    rng = np.random.default_rng(12)
    x = rng.random(15) * 10
    y = 3 - 2 * x + rng.normal(size=15)
    rows = [("f", float(a), float(b)) for a, b in zip(x, y)] + [("f", None, 1.0), ("f", 50.0, None)]
    rows += [("two", 0.0, 1.0), ("two", 1.0, 2.0), ("flat", 2.0, 1.0), ("flat", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "f string, x double, y double")
    got = regression.fitted_line(df, "f", "x", "y", points=4).toPandas().sort_values(["f", "point"])
    line = got[got["f"] == "f"]
    slope, intercept = np.polyfit(x, y, 1)
    at = np.linspace(x.min(), x.max(), 4)
    s = math.sqrt(((y - slope * x - intercept) ** 2).sum() / 13)
    half = 2.160368656 * s * np.sqrt(1 / 15 + (at - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())  # t of 13, 95 %
    for column, want in (("x", at), ("fit", slope * at + intercept), ("lwr", slope * at + intercept - half), ("upr", slope * at + intercept + half)):
        np.testing.assert_allclose(line[column], want, rtol=1e-8)
    two = got[got["f"] == "two"]
    np.testing.assert_allclose(two["fit"], [1, 4 / 3, 5 / 3, 2])
    assert two["lwr"].isna().all() and not (got["f"] == "flat").any()


def test_ellipse_axes_are_those_of_the_covariance(spark):
    rng = np.random.default_rng(13)
    xy = rng.normal(size=(40, 2)) @ np.array([[3.0, 1.0], [0.0, 0.5]])
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in xy] + [("one", 1.0, 2.0)], "g string, pc1 double, pc2 double")
    e = {r["g"]: r for r in pca.group_ellipse(df, "g").collect()}
    values, vectors = np.linalg.eigh(np.cov(xy.T))
    radius = math.sqrt(39 * math.expm1(-2 / 39 * math.log(0.05)))
    assert e["g"]["radius"] == pytest.approx(radius)
    assert e["g"]["major"] == pytest.approx(radius * math.sqrt(values[1])) and e["g"]["minor"] == pytest.approx(radius * math.sqrt(values[0]))
    assert abs(math.cos(e["g"]["angle"]) * vectors[0, 1] + math.sin(e["g"]["angle"]) * vectors[1, 1]) == pytest.approx(1)
    assert e["one"]["radius"] is None


def test_keys_of_other_names(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "key int, w string")
    rows = lambda how: sorted(map(tuple, relate.attach_keys(left, right, {"id": "key"}, how).collect()), key=str)
    assert relate.attach_keys(left, right, {"id": "key"}, "left").columns == ["id", "v", "w"]
    assert rows("inner") == [(1, "a", "x"), (1, "a", "y")]
    assert rows("left") == [(1, "a", "x"), (1, "a", "y"), (2, "b", None), (None, "c", None)]
    assert rows("right") == [(1, "a", "x"), (1, "a", "y"), (3, None, "z")]
    with pytest.raises(ValueError, match="id"):
        relate.attach_keys(left, right.withColumn("id", F.lit(1)), {"id": "key"})


@pytest.mark.parametrize("fall", [0.5, 0.97, 1.0])
def test_leading_axes_of_a_wide_matrix(fall):
    """Also where eigenvalues lie close together, and far more columns than the basis holds."""
    rng = np.random.default_rng(14)
    width, k = 600, 3
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    true = 10 * fall ** np.arange(width) + np.linspace(1, 0, width)
    matrix = (turn * true) @ turn.T
    seen = []
    values, vectors = pca.leading_axes(lambda basis: seen.append(basis.shape) or matrix @ basis, width, k)
    np.testing.assert_allclose(values, true[:k], rtol=1e-9)
    np.testing.assert_allclose(matrix @ vectors, vectors * values, atol=1e-8)
    assert all(w == width and c <= k + pca.EXTRA for w, c in seen)  # all that a round sends
    with pytest.raises(ArithmeticError):
        pca.leading_axes(lambda basis: matrix @ basis, width, k, rounds=1)


def test_axes_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(200, 40)) @ rng.normal(size=(40, 40))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "s int, v array<double>").repartition(7)
    whole = pca.pca(df, ["s"], "v", 3)
    monkeypatch.setattr(pca, "CELLS", 100)
    monkeypatch.setattr(pca, "_PART", 7)
    cut = pca.pca(df, ["s"], "v", 3)
    for a, b in zip(whole, cut):
        for r, w in zip(sorted(a.collect()), sorted(b.collect())):
            assert tuple(r) == pytest.approx(tuple(w), abs=1e-7)
    np.testing.assert_allclose([r["eigenvalue"] for r in sorted(whole.eigen.collect())], np.linalg.eigvalsh(np.corrcoef(x.T))[::-1][:3])
    with pytest.raises(ValueError):
        pca.pca(df, ["s"], "v", 41)


def test_sparse_packing_holds_the_known_values_only(spark):
    rng = np.random.default_rng(16)
    width, rows = 400, []
    for s in range(50):
        for at in rng.choice(width, 8, replace=False):  # 2 %
            rows.append((f"s{s}", f"f{at}", float(rng.integers(-3, 4))))
    rows += [("s0", "f0", None), ("none", "f1", None), ("s1", "other", 5.0), ("ends", "f0", 1.0), ("ends", f"f{width - 1}", 0.0)]
    df = spark.createDataFrame(rows, "s string, f string, v double")
    names = [f"f{i}" for i in range(width)]
    sparse = {r["s"]: r for r in scale.pack_sparse(df, ["s"], "f", "v", names).collect()}
    known = {(s, f): v for s, f, v in rows if v is not None and f in names}
    assert sum(len(r["positions"]) for r in sparse.values()) == len(known) and "none" not in sparse
    assert sparse["ends"]["positions"] == [0, width - 1] and sparse["ends"]["values"] == [1.0, 0.0]
    dense = scale.pack_vectors(df, ["s"], "f", "v", names, missing=9.5)
    for r in dense.collect():
        assert list(r["vector"]) == [known.get((r["s"], f), 9.5) for f in names]
    text = dense._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text
