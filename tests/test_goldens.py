"""Published results of one tumour feature, and published adjusted p-values."""

import pytest
from pyspark.sql import functions as F

from phenogrid.operators import anova, baseline, multiple, permanova, posthoc, regression, reshape, summarize


def by(df, *cols):
    return {tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]: r for r in df.collect()}


def test_mean_and_standard_error(tumor):
    got = by(summarize.summarize(tumor, ["treatment"], "value"), "treatment")
    want = {
        "EX_AL": (-0.487732, 0.802663),
        "EX_ER": (-1.694592, 0.689348),
        "SED_AL": (1.350476, 0.478774),
        "SED_ER": (-0.698838, 0.213700),
    }
    for level, (mean, se) in want.items():
        assert got[level]["mean"] == pytest.approx(mean, abs=1e-6)
        assert got[level]["se"] == pytest.approx(se, abs=1e-6)


@pytest.mark.parametrize("zero,f", [(True, 8.272840), (False, 6.040278)])
def test_change_from_control(tumor, zero, f):
    deltas = baseline.delta_from_baseline(tumor, ["feature"], "value", F.col("treatment") == "SED_AL", zero)
    levels = ["EX_AL", "EX_ER", "SED_AL", "SED_ER"]
    row = baseline.delta_table(deltas, "feature", ["treatment"], levels).first()
    assert round(row["avgchange_EX_AL"], 3) == -1.838 and round(row["sechange_EX_AL"], 3) == 0.803
    assert round(row["avgchange_EX_ER"], 3) == -3.045 and round(row["sechange_EX_ER"], 3) == 0.689
    assert round(row["avgchange_SED_ER"], 3) == -2.049 and round(row["sechange_SED_ER"], 3) == 0.214
    assert row["avgchange_SED_AL"] == pytest.approx(0, abs=1e-12)
    assert (row["sechange_SED_AL"] == 0) == zero
    assert anova.anova_oneway(deltas, "feature", "delta", "treatment").first()["f"] == pytest.approx(f, abs=1e-6)


def test_oneway(tumor):
    row = anova.anova_oneway(tumor, "feature", "value", "treatment").first()
    assert (row["df1"], row["df2"]) == (3, 17)
    assert row["ssw"] / 17 == pytest.approx(1.498942, abs=1e-6)
    assert row["f"] == pytest.approx(6.040278, abs=1e-6)


def test_twoway_as_printed(tumor):
    table = anova.anova_factorial(tumor, "feature", "value", ["a", "b"])
    wide = anova.factorial_wide(table, ["feature"], ["a", "b"], {"a": "Ex", "b": "Wt", "a:b": "Int"})
    assert wide.columns == ["feature", "fStatEx", "pvalEx", "fStatWt", "pvalWt", "fStatInt", "pvalInt"]
    assert tuple(wide.first())[1:] == (7.556, 0.014, 9.960, 0.006, 0.604, 0.448)


def test_tukey_twoway(tumor):
    got = by(posthoc.tukey_hsd(tumor, "feature", "value", ["a", "b"]), "term", "contrast")
    want = {
        ("a", "SED-EX"): (1.484028497, 0.344999707, 2.623057288, 0.013700808),
        ("b", "ER-AL"): (-1.685699433, -2.814325916, -0.557072949, 0.005828096),
        ("a:b", "EX:ER-SED:AL"): (-3.045067901, -5.152422281, -0.937713521, 0.003710350),
        ("a:b", "SED:ER-SED:AL"): (-2.049314306, -4.058597869, -0.040030742, 0.044744733),
    }
    assert len(got) == 8
    for key, (diff, lwr, upr, p) in want.items():
        r = got[key]
        assert r["diff"] == pytest.approx(diff, abs=1e-8)
        assert (r["lwr"], r["upr"]) == (pytest.approx(lwr, abs=2e-7), pytest.approx(upr, abs=2e-7))
        assert r["p_adj"] == pytest.approx(p, abs=2e-9)


def test_pairwise_contrasts(tumor):
    got = by(posthoc.pairwise_contrasts(tumor, "feature", "value", "treatment"), "contrast")
    r = got["EX_ER - SED_AL"]
    assert r["estimate"] == pytest.approx(-3.0450679, abs=1e-7)
    assert (round(r["se"], 3), r["df"], round(r["t"], 3), round(r["p"], 3)) == (0.741, 17, -4.107, 0.004)
    r = got["SED_AL - SED_ER"]
    assert (round(r["se"], 3), r["df"], round(r["t"], 3), round(r["p"], 3)) == (0.707, 17, 2.899, 0.045)


def test_welch(tumor):
    r = posthoc.welch_t_test(tumor, "feature", "value", "treatment", levels=["EX_ER", "SED_AL"]).first()
    assert r["t"] == pytest.approx(-3.628100, abs=1e-6)
    assert r["df"] == pytest.approx(7.410318, abs=1e-6)
    assert r["p"] == pytest.approx(0.007635895, abs=1e-9)


def test_regression(tumor):
    r = regression.slope_sign(regression.linear_regression(tumor, "feature", "cm3", "value")).first()
    assert r["slope"] == pytest.approx(4.079696, abs=1e-6)
    assert r["r2"] == pytest.approx(0.199294, abs=1e-6)
    assert r["adj_r2"] == pytest.approx(0.157151, abs=1e-6)
    assert r["t"] == pytest.approx(2.174638, abs=1e-6)
    assert r["p"] == pytest.approx(0.0424949303, abs=1e-10)
    assert r["sign"] == "pos"
    c = regression.pearson(tumor, "feature", "cm3", "value").first()
    assert c["r"] ** 2 == pytest.approx(r["r2"]) and c["p"] == pytest.approx(r["p"])


@pytest.mark.parametrize("fast", [True, False])
def test_permanova(tumor, fast):
    two = tumor.where("treatment in ('EX_ER', 'SED_AL')").withColumn("v", F.array("value"))
    if fast:
        out = permanova.permanova_euclidean(two, "subject", "v", "treatment", 199)
    else:
        out = permanova.permanova(two, "subject", "v", "treatment", "euclidean", 199)
    r = by(out, "term")["group"]
    assert r["f"] == pytest.approx(13.894111, abs=1e-6) and r["r2"] == pytest.approx(0.606886, abs=1e-6)
    assert 0.005 <= r["p"] <= 0.05


RAW = """0.0051105 0.016631 0.090296 0.18193 0.18686 0.27064 0.28977 0.29554 0.34804 0.34883
0.35431 0.37906 0.37927 0.38012 0.38249 0.38928 0.39953 0.39994 0.40523 0.41473
0.42037 0.42573 0.42804 0.44263 0.46233 0.46572 0.48066 0.50074 0.51469 0.52422
0.52456 0.53658 0.53994 0.54218 0.55969 0.5671 0.57809 0.58637 0.63117 0.64069
0.68521 0.69354 0.70163 0.74106 0.75361 0.85716 0.90026 0.90026 0.96702 0.98206"""


def test_adjusted_p(spark):
    raw = [float(x) for x in RAW.split()]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, p double")
    out = multiple.p_adjust(multiple.p_adjust(df, "p", "holm", out="holm"), "p", "fdr", out="fdr")
    rows = out.orderBy("i").collect()
    holm, fdr = [r["holm"] for r in rows], [r["fdr"] for r in rows]
    assert holm[:2] == pytest.approx([0.25553, 0.8149], abs=2e-5) and set(holm[2:]) == {1.0}
    assert fdr[:2] == pytest.approx([0.25553, 0.41577], abs=2e-5)
    # From the third on one value carries back, up to the ends of the list.
    assert fdr[2:20] == pytest.approx([0.77154] * 18, abs=2e-5)


def test_key_cell_with_two_runs(spark):
    df = spark.createDataFrame([("M1", "98, 100"), ("M2", "7")], "m string, run string")
    assert sorted(tuple(r) for r in reshape.explode_keys(df, "run").collect()) == [("M1", "100"), ("M1", "98"), ("M2", "7")]
