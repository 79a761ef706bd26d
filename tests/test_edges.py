"""Missing values, constant features, empty cells, names and label order."""

import pytest
from pyspark.sql import functions as F

from phenogrid.functions import columns as C
from phenogrid.operators import anova, baseline, cells, clean, posthoc, regression, relate, reshape, scale, summarize


@pytest.fixture(scope="module")
def odd(spark):
    rows = [("const", g, 3.0, 1.0) for g in "xxyy"]
    rows += [("gap", "x", None, 1.0), ("gap", "x", 1.0, None), ("gap", "x", 2.0, 2.0), ("gap", "y", float("nan"), 3.0),
             ("gap", "y", 4.0, 4.0), ("gap", "y", 7.0, 9.0)]
    rows += [("lone", "x", 1.0, 1.0)]
    return spark.createDataFrame(rows, "feature string, g string, value double, cov double").cache()


def one(df, feature):
    return df.where(F.col("feature") == feature).first()


def test_constant_feature_keeps_its_row(odd):
    for out in (
        anova.anova_oneway(odd, "feature", "value", "g"),
        posthoc.welch_t_test(odd, "feature", "value", "g"),
        posthoc.pairwise_contrasts(odd, "feature", "value", "g"),
        regression.linear_regression(odd, "feature", "cov", "value"),
    ):
        r = one(out, "const").asDict()
        assert r["p"] is None and r.get("f") is None and r.get("t") is None
    assert one(anova.anova_factorial(odd, "feature", "value", ["g"]), "const")["f"] is None


def test_missing_values_are_left_out_of_tests_but_counted(odd):
    r = one(summarize.summarize(odd, ["feature"], "value", ("rows", "n", "mean")), "gap")
    assert (r["rows"], r["n"], r["mean"]) == (6, 4, 3.5)
    assert one(anova.anova_oneway(odd, "feature", "value", "g"), "gap")["df2"] == 2
    assert one(regression.linear_regression(odd, "feature", "cov", "value"), "gap")["n"] == 3


def test_one_row_cells(odd):
    r = one(cells.cell_stats(odd, ["feature"], ["g"], "value"), "lone")
    assert (r["n"], r["m2"]) == (1, 0.0)
    r = one(summarize.summarize(odd, ["feature"], "value"), "lone")
    assert r["sd"] is None and r["se"] is None
    r = one(anova.anova_oneway(odd, "feature", "value", "g"), "lone")
    assert r is not None and r["f"] is None and r["p"] is None


def test_absent_combination(spark):
    rows = [("f", a, b, float(i % 5)) for i, (a, b) in enumerate([("x", "u"), ("x", "v"), ("y", "u")] * 6)]
    df = spark.createDataFrame(rows, "feature string, a string, b string, value double")
    got = {r["term"]: r for r in anova.anova_factorial(df, "feature", "value", ["a", "b"]).collect()}
    assert (got["a"]["df"], got["b"]["df"], got["a:b"]["df"], got["a"]["df_resid"]) == (1, 1, 0, 15)
    assert got["a:b"]["f"] is None and got["a:b"]["p"] is None
    contrasts = [r["contrast"] for r in posthoc.tukey_hsd(df, "feature", "value", ["a", "b"]).where("term = 'a:b'").collect()]
    assert sorted(contrasts) == ["x:v-x:u", "x:v-y:u", "y:u-x:u"]


def test_label_order(spark):
    rows = [("f", d, float(i)) for i, d in enumerate(["Day 7", "Day 21", "Day 35"] * 4)]
    df = spark.createDataFrame(rows, "feature string, day string, value double")
    text = {r["contrast"] for r in posthoc.tukey_hsd(df, "feature", "value", ["day"]).collect()}
    assert text == {"Day 35-Day 21", "Day 7-Day 21", "Day 7-Day 35"}
    days = ["Day 7", "Day 21", "Day 35"]
    given = {r["contrast"] for r in posthoc.tukey_hsd(df, "feature", "value", ["day"], levels={"day": days}).collect()}
    assert given == {"Day 21-Day 7", "Day 35-Day 7", "Day 35-Day 21"}
    emm = {r["contrast"] for r in posthoc.pairwise_contrasts(df, "feature", "value", "day", levels=days).collect()}
    assert emm == {"Day 7 - Day 21", "Day 7 - Day 35", "Day 21 - Day 35"}


def test_names_and_ids(spark):
    df = spark.createDataFrame(
        [("Xanthine",), ("X2.Oxobutanoate",), ("Acetyl.glycine.",), (None,)], "name string"
    )
    got = [r["name"] for r in clean.clean_feature_name(df, "name").collect()]
    assert got == ["Xanthine", "2-Oxobutanoate", "Acetyl-glycine", None]
    ids = spark.createDataFrame([("15-02-M20_plasmaD35",), ("15-02-M3_tumor",), ("blank",)], "id string")
    parsed = [tuple(r)[1:] for r in clean.parse_sample_id(ids, "id", tumor_time="D35").collect()]
    assert parsed == [("15-02-M20", "plasma", "D35"), ("15-02-M3", "tumor", "D35"), (None, None, None)]
    assert ids.select(clean.relabel_treatment(F.lit("EX_ER"))).first()[0] == "PA+ER"


def test_column_helpers(spark):
    df = spark.createDataFrame([("a1b22", None, 2.5)], "s string, n string, x double")
    r = df.select(
        C.replace_first("s", "[0-9]+", "#").alias("first"),
        C.replace_all("s", "[0-9]+", "#").alias("every"),
        C.extract_all("s", "[0-9]+").alias("found"),
        C.extract_first("s", "z").alias("none"),
        C.is_member("n", ["q"]).alias("member"),
        C.paste("s", "n", sep="_").alias("paste"),
        C.to_number("s").alias("bad"),
        C.round_half_even("x", 0).alias("even"),
        C.piece("s", "b", 9).alias("far"),
        C.level_rank("s", ["z", "a1b22"]).alias("place"),
        C.level_rank("n", ["z"]).alias("unknown"),
    ).first()
    assert tuple(r) == ("a#b22", "a#b#", ["1", "22"], None, False, "a1b22", None, 2.0, None, 2, 2)


def test_baseline_without_control_rows(spark):
    df = spark.createDataFrame([("f", "c", 1.0), ("f", "t", 4.0), ("g", "t", 2.0), (None, "c", 1.0), (None, "t", 3.0)], "feature string, t string, v double")
    got = {(r["feature"], r["t"]): r["delta"] for r in baseline.delta_from_baseline(df, ["feature"], "v", F.col("t") == "c").collect()}
    assert got == {("f", "c"): 0.0, ("f", "t"): 3.0, ("g", "t"): None, (None, "c"): 0.0, (None, "t"): 2.0}


def test_scaling_of_constant_features(odd):
    assert {r["scaled"] for r in scale.range_scale(odd, "feature", "value").where("feature = 'const'").collect()} == {0.0}
    assert {r["scaled"] for r in scale.zscore(odd, "feature", "value").where("feature = 'const'").collect()} == {None}
    gap = scale.range_scale(odd, "feature", "value").where("feature = 'gap'").collect()
    assert sorted((r["scaled"] for r in gap), key=str) == sorted([None, None, 0.0, 1 / 6, 0.5, 1.0], key=str)


def test_vector_and_long_range_scaling_agree(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0, 2.0]), (2, [3.0, 5.0, 4.0]), (3, [2.0, 5.0, 8.0])], "s int, v array<double>")
    packed = {r["s"]: r["scaled"] for r in scale.range_scale_vectors(df, "v").collect()}
    assert packed[3] == pytest.approx([0.5, 0.0, 1.0]) and packed[2] == pytest.approx([1.0, 0.0, 1 / 3])


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 9.99, 10)] + [(None,)], "v double")
    assert {r["bin"]: r["n"] for r in summarize.histogram(df, "v", 10).collect()} == {1: 1, 2: 1, 6: 1, 10: 2}
    assert {r["bin"]: r["n"] for r in summarize.histogram(df, "v", 2, lo=1, hi=9).collect()} == {0: 1, 1: 1, 2: 1, 3: 2}


def test_ties_at_the_cut_are_kept(spark):
    df = spark.createDataFrame([("g", v) for v in (5.0, 4.0, 4.0, 4.0, 1.0)], "g string, v double")
    assert reshape.top_in_group(df, ["g"], "v", 2).count() == 4


def test_semi_join_keeps_rows_once(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    wanted = spark.createDataFrame([("a",), ("a",)], "k string")
    assert [tuple(r) for r in relate.keep_features(df, wanted, ["k"]).collect()] == [("a", 1)]


def test_filters_on_p(spark):
    df = spark.createDataFrame([(0.0496, None), (0.051, 0.2), (None, None), (0.9, 0.01)], "p double, q double")
    assert anova.significant(df, "p", 0.05).count() == 1
    assert anova.significant(df, "p", 0.05, digits=3).count() == 0  # 0.0496 prints as 0.050
    assert anova.any_significant(df, ["p", "q"], 0.05).count() == 2
