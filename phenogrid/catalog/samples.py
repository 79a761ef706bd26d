"""Reading, cleaning, recoding and joining."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import clean, relate, reshape
from ..plans.staging import scratch_path
from ..sources import cached_dataset, drop_label_records, read_measurements, write_table
from .registry import EV, LI, TIMES, Data, query, rnd, rounded

_ITEM = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_extendedprice", T.DoubleType()),
    ]
)


@query(
    "io1_typed_scan",
    "SELECT l_returnflag, count(*) AS n, round(max(l_extendedprice), 6) AS top FROM lineitem GROUP BY 1",
)
def io1(d: Data):
    rows = read_measurements(d.spark, f"{d.folder}/lineitem.parquet", _ITEM)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), rnd(F.max("l_extendedprice")).alias("top"))


@query(
    "io1_delimited_text",
    """WITH k AS (SELECT o_custkey AS subject, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) AS runs, count(*) AS n,
 CASE WHEN o_custkey % 7 <> 0 THEN round(max(o_totalprice), 2) END AS top FROM orders GROUP BY 1)
 SELECT subject, CAST(unnest(string_split(runs, ', ')) AS BIGINT) AS run, 'a "quoted", tabbed	 name ' || subject AS name, top FROM k""",
)
def io1t(d: Data):
    """A key table as instruments export it: tabs, quoted text, NA, and several runs in one cell."""
    orders = d.table("orders").groupBy(F.col("o_custkey").alias("subject")).agg(
        F.sort_array(F.collect_list("o_orderkey")).alias("runs"), F.round(F.max("o_totalprice"), 2).alias("top")
    )
    table = orders.select(
        "subject",
        F.array_join(F.col("runs").cast("array<string>"), ", ").alias("runs"),
        F.concat(F.lit('a "quoted", tabbed\t name '), F.col("subject").cast("string")).alias("name"),
        F.when(F.col("subject") % 7 != 0, F.col("top")).alias("top"),
    )
    path = scratch_path(d.spark)
    write_table(table, path, fmt="csv")
    kinds = {"subject": T.LongType(), "runs": T.StringType(), "name": T.StringType(), "top": T.DoubleType()}
    schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()])
    back = read_measurements(d.spark, path, schema, fmt="csv", sep="\t")
    return reshape.explode_keys(back, "runs").select("subject", F.col("runs").cast("long").alias("run"), "name", "top")


@query("io2_drop_label_records", "SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def io2(d: Data):
    return drop_label_records(d.table("events").select("event_id", "event_type"), "event_type", ["error"])


@query("io3_write_table", f"WITH {EV} SELECT event_id, feature, time, value FROM ev")
def io3(d: Data):
    path = scratch_path(d.spark)
    write_table(d.ev().select("event_id", "feature", "time", "value"), path, partition_by=("time",))
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("feature", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("time", T.StringType()),
        ]
    )
    return read_measurements(d.spark, path, schema, fmt="parquet")


@query("io4_cached_dataset", f"WITH {LI} SELECT feature, count(*) AS n FROM li GROUP BY 1")
def io4(d: Data):
    return cached_dataset(d.li().select("feature", "value")).groupBy("feature").agg(F.count("*").alias("n"))


@query("p1_select_drop", "SELECT p_partkey, p_brand, p_size FROM part")
def p1(d: Data):
    return d.table("part").drop("p_name", "p_type", "p_retailprice")


@query("p2_rename", "SELECT vec_id AS id, label AS grp FROM embeddings")
def p2(d: Data):
    return d.table("embeddings").select("vec_id", "label").withColumnsRenamed({"vec_id": "id", "label": "grp"})


@query("p3_derive", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS doubled, year(o_orderdate)::INT AS yr FROM orders")
def p3(d: Data):
    o = d.table("orders").withColumns({"doubled": F.round(F.col("o_totalprice") * 2, 2), "yr": F.year("o_orderdate")})
    return o.select("o_orderkey", "doubled", "yr")


@query(
    "p4_case_recode",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'plasma' WHEN event_type = 'error' THEN 'tumor' END
 AS tissue FROM events""",
)
def p4(d: Data):
    tissue = F.when(C.is_member("event_type", ["view", "click"]), "plasma").when(F.col("event_type") == "error", "tumor")
    return d.table("events").select("event_id", tissue.alias("tissue"))


@query(
    "p5_coalesce_recode",
    """SELECT p_partkey, coalesce(nullif(regexp_extract(p_name, '^red.*'), ''), p_brand) AS label FROM part""",
)
def p5(d: Data):
    return d.table("part").select("p_partkey", F.coalesce(C.extract_first("p_name", "^red.*"), "p_brand").alias("label"))


@query(
    "p6_predicates",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'F'
 AND l_quantity BETWEEN 10 AND 20 AND l_linenumber IN (1, 3, 5)""",
)
def p6(d: Data):
    keep = (
        (F.col("l_returnflag") == "R")
        & (F.col("l_linestatus") != "F")
        & F.col("l_quantity").between(10, 20)
        & F.col("l_linenumber").isin(1, 3, 5)
    )
    return d.table("lineitem").where(keep).select("l_orderkey", "l_linenumber")


@query(
    "p7_membership",
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def p7(d: Data):
    big = d.table("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return relate.keep_features(d.table("customer").select("c_custkey"), big, ["c_custkey"])


@query(
    "p8_drop_nulls",
    """SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL""",
)
def p8(d: Data):
    both = d.table("documents").select("doc_id").join(d.table("labels"), "doc_id", "left")
    return both.select("doc_id", "quality").dropna("any", subset=["quality"])


@query("p9_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def p9(d: Data):
    return d.table("part").select("p_brand", "p_type").distinct()


@query(
    "p10_ordered_levels",
    f"""WITH {EV} SELECT event_id, time, list_position(['D7', 'D21', 'D35'], time)::BIGINT AS place FROM ev""",
)
def p10(d: Data):
    return d.ev().select("event_id", "time", C.level_rank("time", TIMES).cast("long").alias("place"))


@query(
    "p11_parse_sample_id",
    f"""WITH {EV} SELECT event_id, subject AS subject_id, CASE WHEN feature = 'purchase' THEN 'tumor' ELSE 'plasma' END
 AS tissue, CASE WHEN feature <> 'purchase' THEN time END AS time FROM ev""",
)
def p11(d: Data):
    parsed = clean.parse_sample_id(d.ev().select("event_id", "id"), "id")
    return parsed.select("event_id", "subject_id", "tissue", "time")


@query(
    "p12_clean_feature_name",
    """SELECT p_partkey, p_size || '-' || replace(p_name, ' ', '-') AS feature FROM part""",
)
def p12(d: Data):
    # Names as a text reader leaves them: X before a digit, dots for other signs.
    raw = F.concat(F.lit("X"), F.col("p_size").cast("string"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."))
    return clean.clean_feature_name(d.table("part").select("p_partkey", raw.alias("feature")), "feature")


@query(
    "p13_split_treatment",
    f"""WITH {EV} SELECT event_id, a AS factor_a, b AS factor_b,
 CASE WHEN a = 'EX' THEN 'PA' ELSE a END || '+' || b AS printed FROM ev""",
)
def p13(d: Data):
    parts = clean.split_treatment(d.ev().select("event_id", "treatment"), "treatment")
    return parts.select("event_id", "factor_a", "factor_b", clean.relabel_treatment("treatment").alias("printed"))


@query("f1_split_piece", "SELECT p_partkey, nullif(split_part(p_name, ' ', 2), '') AS piece FROM part")
def f1(d: Data):
    return d.table("part").select("p_partkey", C.piece("p_name", " ", 2).alias("piece"))


@query("f2_first_word", "SELECT doc_id, nullif(split_part(text, ' ', 1), '') AS word FROM documents")
def f2(d: Data):
    return d.table("documents").select("doc_id", C.first_word("text").alias("word"))


@query("f3_extract_first", "SELECT event_id, nullif(regexp_extract(props, '[0-9]+'), '') AS number FROM events")
def f3(d: Data):
    return d.table("events").select("event_id", C.extract_first("props", "[0-9]+").alias("number"))


@query(
    "f4_extract_all",
    "SELECT page_id, len(regexp_extract_all(url, '[0-9]+')) AS n, array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS found FROM pages",
)
def f4(d: Data):
    found = C.extract_all("url", "[0-9]+")
    return d.table("pages").select("page_id", F.size(found).cast("long").alias("n"), F.array_join(found, ",").alias("found"))


@query("f5_detect", "SELECT source, count(*) AS n FROM documents WHERE regexp_matches(text, '[0-9]{3}') GROUP BY 1")
def f5(d: Data):
    return d.table("documents").where(C.detect("text", "[0-9]{3}")).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "f6_replace",
    """SELECT page_id, regexp_replace(url, '[0-9]', '') AS first_out, regexp_replace(url, '[0-9]', '', 'g') AS all_out
 FROM pages""",
)
def f6(d: Data):
    return d.table("pages").select(
        "page_id", C.replace_first("url", "[0-9]").alias("first_out"), C.replace_all("url", "[0-9]").alias("all_out")
    )


@query("f7_paste", "SELECT l_orderkey, l_linenumber, concat_ws('-', l_orderkey, l_linenumber) AS run FROM lineitem")
def f7(d: Data):
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber")]
    return d.table("lineitem").select("l_orderkey", "l_linenumber", C.paste(*parts, sep="-").alias("run"))


@query("f8_to_number", "SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS number, TRY_CAST(p_name AS DOUBLE) AS none FROM part")
def f8(d: Data):
    return d.table("part").select("p_partkey", C.to_number(C.piece("p_brand", "#", 2)).alias("number"), C.to_number("p_name").alias("none"))


@query("f9_round", "SELECT p_partkey, round_even(p_size / 4.0, 0) AS even, round(p_size / 4.0, 0) AS up FROM part")
def f9(d: Data):
    quarter = F.col("p_size") / 4.0
    return d.table("part").select("p_partkey", C.round_half_even(quarter, 0).alias("even"), F.round(quarter, 0).alias("up"))


@query(
    "f10_arithmetic",
    """SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS root, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS pos FROM customer""",
)
def f10(d: Data):
    bal = F.col("c_acctbal")
    return d.table("customer").select("c_custkey", rnd(F.sqrt(F.abs(bal))).alias("root"), F.when(bal > 0, 1).otherwise(0).alias("pos"))


@query(
    "j1_inner_join",
    """SELECT l_orderkey, l_linenumber, s_name, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey""",
)
def j1(d: Data):
    keys = d.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", F.col("s_nationkey").alias("n_nationkey"))
    named = relate.attach_keys(keys, d.table("nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    rows = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return relate.attach_keys(rows, named, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "s_name", "n_name")


@query(
    "j2_left_join",
    f"""WITH {EV}, vol AS (SELECT subject, time, avg(value) AS cm3 FROM ev WHERE feature = 'view' GROUP BY 1, 2)
 SELECT event_id, round(cm3, 6) AS cm3 FROM ev LEFT JOIN vol USING (subject, time)""",
)
def j2(d: Data):
    ev = d.ev()
    vol = ev.where("feature = 'view'").groupBy("subject", "time").agg(F.avg("value").alias("cm3"))
    joined = relate.attach_keys(ev.select("event_id", "subject", "time"), vol, ["subject", "time"], "left")
    return joined.select("event_id", rnd("cm3").alias("cm3"))


@query(
    "j2_left_join_other_names",
    """SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey""",
)
def j2n(d: Data):
    pending = d.table("orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", "o_orderstatus")
    return relate.attach_keys(d.table("customer").select("c_custkey"), pending, {"c_custkey": "o_custkey"}, "left")


@query(
    "j3_right_join",
    """SELECT c_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P') o
 RIGHT JOIN customer ON o_custkey = c_custkey""",
)
def j3(d: Data):
    open_orders = d.table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return relate.attach_keys(open_orders, d.table("customer").select("c_custkey"), ["c_custkey"], "right")


@query(
    "j4_semi_join",
    f"""WITH {LI}, sig AS (SELECT feature, a FROM li GROUP BY 1, 2 HAVING avg(value) > 51000)
 SELECT sample, feature, a, count(*) AS n FROM li WHERE EXISTS (SELECT 1 FROM sig WHERE sig.feature = li.feature AND sig.a = li.a)
 GROUP BY 1, 2, 3""",
)
def j4(d: Data):
    li = d.li()
    sig = li.groupBy("feature", "a").agg(F.avg("value").alias("m")).where("m > 51000")
    return relate.keep_features(li, sig, ["feature", "a"]).groupBy("sample", "feature", "a").agg(F.count("*").alias("n"))


@query(
    "j5_semi_join_filtered",
    f"""WITH {LI} SELECT feature, count(*) AS n, round(avg(value), 4) AS mean FROM li
 WHERE feature IN (SELECT p_brand FROM part WHERE p_type = 'PROMO' AND p_size > 48) GROUP BY 1""",
)
def j5(d: Data):
    wanted = d.table("part").where("p_type = 'PROMO' AND p_size > 48").select(F.col("p_brand").alias("feature"))
    kept = relate.keep_features(d.li(), wanted, ["feature"])
    return kept.groupBy("feature").agg(F.count("*").alias("n"), rnd(F.avg("value"), 4).alias("mean"))


@query(
    "j6_level_pairs",
    f"""WITH {EV}, c AS (SELECT feature, treatment, count(*) AS n FROM ev GROUP BY 1, 2)
 SELECT x.feature, x.treatment AS treatment_1, y.treatment AS treatment_2, x.n AS n_1, y.n AS n_2
 FROM c x JOIN c y ON x.feature = y.feature AND x.treatment < y.treatment""",
)
def j6(d: Data):
    cells = d.ev().groupBy("feature", "treatment").agg(F.count("*").alias("n"))
    return relate.level_pairs(cells, ["feature"], "treatment", "treatment", ["n"])


@query(
    "j7_lookup_known",
    """SELECT l_orderkey, l_linenumber, p_type FROM lineitem JOIN part ON l_partkey = p_partkey
 WHERE p_type IS NOT NULL AND p_size <= 25""",
)
def j7(d: Data):
    dim = d.table("part").select(
        F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") <= 25, F.col("p_type")).alias("p_type")
    )
    rows = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return clean.assign_class(rows, dim, "l_partkey", "p_type").drop("l_partkey")


@query(
    "g1_annotate_features",
    """SELECT p_partkey, clean_feature, coalesce(found, clean_feature) AS feature_name FROM
 (SELECT p_partkey, p_size || '-' || split_part(p_name, ' ', 1) AS clean_feature FROM part)
 LEFT JOIN (SELECT DISTINCT p_size || '-' || split_part(p_name, ' ', 1) AS q, 'known ' || split_part(p_name, ' ', 1) AS found
 FROM part WHERE p_type = 'PROMO') ON q = clean_feature""",
)
def g1(d: Data):
    part = d.table("part")
    word, size = C.first_word("p_name"), F.col("p_size").cast("string")
    dim = (
        part.where("p_type = 'PROMO'")
        .select(F.concat(size, F.lit("-"), word).alias("q"), F.concat(F.lit("known "), word).alias("found"))
        .distinct()
    )
    raw = part.select("p_partkey", F.concat(F.lit("X"), size, F.lit("."), word, F.lit(".")).alias("raw"))
    return clean.annotate(raw, dim, "raw", "q", "found").select("p_partkey", "clean_feature", "feature_name")


@query(
    "g2_class_as_feature",
    f"""WITH k AS (SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN p_type END AS class FROM part)
 SELECT class, l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem JOIN k ON l_partkey = p_partkey
 WHERE class IS NOT NULL GROUP BY 1, 2""",
)
def g2(d: Data):
    dim = d.table("part").select(
        F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("class")
    )
    known = clean.assign_class(d.table("lineitem"), dim, "l_partkey", "class")
    return known.groupBy("class", "l_returnflag").agg(F.count("*").alias("n"), rnd(F.avg("l_extendedprice"), 4).alias("mean"))


@query(
    "g3_lipid_class",
    """SELECT feature_class, count(*) AS n FROM (SELECT split_part(CASE WHEN p_type = 'PROMO' THEN 'w/o ' ELSE '' END || p_name, ' ', 1)
 AS feature_class FROM part) WHERE feature_class <> 'w/o' GROUP BY 1""",
)
def g3(d: Data):
    name = F.concat(F.when(F.col("p_type") == "PROMO", "w/o ").otherwise(""), "p_name")
    return clean.lipid_class(d.table("part").select(name.alias("lipid")), "lipid").groupBy("feature_class").agg(F.count("*").alias("n"))


@query(
    "g4_instrument_sample",
    f"""WITH {EV} SELECT event_id, CASE WHEN feature = 'purchase' THEN 'tumor' ELSE 'plasma' END AS tissue, 'M' || user_id AS subject_id,
 CASE WHEN feature <> 'purchase' THEN time END AS time, CASE WHEN a = 'EX' THEN 'POS' ELSE 'NEG' END AS ion,
 CASE WHEN a = 'EX' THEN 'POS_' ELSE 'NEG_' END || event_id AS short_id FROM ev""",
)
def g4(d: Data):
    mouse = F.concat(F.lit("M"), F.col("user_id").cast("string"))
    name = F.when(F.col("feature") == "purchase", mouse).otherwise(F.concat_ws("_", "time", mouse))
    run = F.concat(F.when(F.col("a") == "EX", "POS_").otherwise("NEG_"), F.col("event_id").cast("string"), F.lit(".wiff "))
    named = d.ev().select("event_id", name.alias("sample_name"), run.alias("run_file"))
    parsed = clean.parse_instrument_sample(named, "sample_name", "run_file")
    return parsed.select("event_id", "tissue", "subject_id", "time", "ion", "short_id")


@query(
    "r5_attach_covariate",
    f"""WITH {EV}, vol AS (SELECT subject, time, avg(value) AS cm3 FROM ev WHERE feature = 'signup' GROUP BY 1, 2),
 s AS (SELECT event_id, subject, CASE WHEN feature = 'purchase' THEN 'D35' ELSE time END AS time FROM ev)
 SELECT event_id, s.time, round(cm3, 6) AS cm3 FROM s LEFT JOIN vol ON s.subject = vol.subject AND s.time = vol.time""",
)
def r5(d: Data):
    ev = d.ev()
    vol = ev.where("feature = 'signup'").groupBy(F.col("subject").alias("mouse"), F.col("time").alias("day")).agg(
        F.avg("value").alias("cm3")
    )
    out = relate.attach_covariate(ev.select("event_id", "id"), vol, "id", "mouse", "day")
    return rounded(out.select("event_id", "time", "cm3"), "cm3")
