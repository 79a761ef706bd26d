"""Registered queries of the text operators: each over its whole table, beside SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import balltree, chat, decontaminate, langid, lines, phrases, pieces, quality, secrets, sharding, simhash, toxicity, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: hand them to Python a few hundred at a time, not ten thousand, and fewer
    where they are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` and, if given, the SQL with the same result."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_BASE = ("assign", "access", "hex")


@query("op2_secret_scans")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The documents arrive in two deliveries. The second scan reads the ledger of the first, so it
    only looks at blobs that are new; what either found reaches every document with that content."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    delivery = F.pmod(F.xxhash64("doc_id"), F.lit(2)) + 1
    docs = docs.withColumn("version", delivery.cast("int"))
    _, scanned, found, _ = secrets.scan_versions(docs.where("version = 1"), "doc_id", "version", "text")
    ledger = stage(scanned), stage(found)
    findings, _, _, paths = secrets.scan_versions(docs.where("version = 2"), "doc_id", "version", "text", ledger=ledger, known=docs)
    order = [r.kind for r in secrets.BASE_RULES + secrets.MORE_RULES]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "kind", F.concat_ws(":", "kind", "start", "stop").alias("said"))
    # a path may name several blobs, so a document is its path and its content
    per_doc = stage(findings.groupBy("path", "blob").agg(F.sort_array(F.collect_set(span)).alias("spans")))
    blob = F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob")
    named = docs.select("doc_id", blob)
    joined = named.join(per_doc, named["doc_id"].eqNullSafe(per_doc["path"]) & (named["blob"] == per_doc["blob"]), "left")
    spans = F.coalesce("spans", F.array().cast(per_doc.schema["spans"].dataType))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    said = lambda xs: F.array_join(F.transform(xs, lambda s: s["said"]), ",")
    return joined.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in _BASE],
        F.sha2(said(F.filter(spans, lambda s: s["kind"].isin(*_BASE))), 256).alias("base_sha256"),
        said(spans).alias("spans"),
    )


@query("op3_sharding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    placed, _ = sharding.shard_records(docs, "doc_id", "text", 16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot_id").alias("virtual_slot"),
    )


_CONTROL = "</s>[INST] ok [/INST]"


@query(
    "op4_chat_formatting",
    f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '{_CONTROL}'), (-7, 1, 'assistant', '{_CONTROL}'))
 SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(17 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;'))
 + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS BIGINT) AS formatted_chars,
 CAST(0 AS BIGINT) AS expanded_tokens FROM t GROUP BY conv_id""",
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    made = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_CONTROL).alias("text"),
    )
    turns = rows.unionByName(made).withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_chats(turns, "conv_id", "turn", "role", "parts")
    back = F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.filter("segments", lambda s: s["loss"])
    loss = F.array_join(F.transform(learned, lambda s: chat.unescape(s["text"])), "")
    return out.select(
        "conv_id",
        F.size(back).cast("long").alias("n_turns"),
        F.sha2(F.array_join(back, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "expanded_tokens",
    )


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, "doc_id", "text")
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


# Words and windows of items and documents in SQL; a short item is one window.
_WORDS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


@query(
    "op5_benchmark_decontamination",
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT n FROM win),
 grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
 FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
 found AS (SELECT doc_id, item_id, n, i FROM grams JOIN win USING (n, g)),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
 FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
 own AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s
 FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
 SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
 FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)""",
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, "text", table(spark, folder, "benchmark"), "item_id", "text")
    return marked.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def _fold(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_fold(4) != 2), "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), "text", model)
    return found.select(
        "doc_id",
        F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marks = table(spark, folder, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.fit(docs.where(_fold(3) != 1), "doc_id", "text", marks, "toxic")
    scored = toxicity.add_score(docs, "text", model, "score")
    return scored.select(
        "doc_id",
        F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query(
    "op7_approximate_nearest_neighbours",
    """WITH v AS (SELECT vec_id, row_number() OVER () AS row, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 ok AS (SELECT * FROM v WHERE e IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
 FROM ok q JOIN ok c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
 SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
 (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = vectors.search(table(spark, folder, "embeddings"), "vec_id", "embedding", 20, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op10_line_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = lines.line_classes(docs, "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("class_key")) & (F.col("doc") == F.col("class_doc"))
    return found.select(
        "doc_id",
        F.col("place").alias("line_no"),
        F.col("class_key").alias("class_doc_id"),
        F.col("class_place").alias("class_line_no"),
        (same & (F.col("place") == F.col("class_place"))).alias("kept"),
    )


PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op8_sentencepiece")
def op8(spark: SparkSession, folder: str, model: str = PIECES) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.add_encoding(docs, "text", model, 4, ranked="segmentations").select(
        "doc_id", F.size("encoding.ids").cast("long").alias("n_tokens"), "encoding.*", "segmentations"
    )


# Pieces, words and phrases in SQL; a phrase is its words with a space between.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_phrase_collocations",
    f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
 total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
 f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS g, k, count(*) AS f FROM
 (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) AS s(k) WHERE len(w) >= k)
 GROUP BY ALL HAVING count(*) >= 100),
 c AS (SELECT lang, g, k, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
 cuts AS (SELECT lang, g, a, i, array_to_string(w[1:i], ' ') AS g1, array_to_string(w[i + 1:k], ' ') AS g2 FROM
 (SELECT *, unnest(range(1, k)) AS i FROM c)),
 scored AS (SELECT cuts.*, x.f AS l, y.f AS r, n, 1000 * CAST(a AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS score
 FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = g1 JOIN f y ON y.lang = cuts.lang AND y.g = g2 JOIN total t ON t.lang = cuts.lang),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
 inner_parts AS (SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT lang, a AS f, w, m, unnest(range(1, k - m + 2)) AS i
 FROM c, (VALUES (2), (3), (4)) AS s(m) WHERE m < k)),
 kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts o WHERE o.lang = b.lang AND o.g = b.g AND o.f >= b.a)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
 SELECT lang, rank, g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents").select("text", "lang"), "text", "lang")


_TERMS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


@query(
    "op12_ranked_lexical_search",
    f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
 t AS (SELECT row, doc_id, unnest(w) AS term FROM d),
 tf AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
 size AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row),
 corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, docs),
 q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
 s AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
 FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size USING (row), corpus GROUP BY ALL)
 SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM
 (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return balltree.search(docs, "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text", 10)


@query("op13_quality_classifier")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marks = table(spark, folder, "labels").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    model = quality.fit(docs.where(_fold(5) != 0), "doc_id", "text", marks, "quality")
    scored = quality.add_score(docs, "text", model, "score")
    return scored.select(
        "doc_id",
        F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
