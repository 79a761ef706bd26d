"""Secret scans over a ledger of text blobs.

Every version of every file is known by the SHA-256 of its content. A blob is scanned once per
rule version: the ledger holds the pairs already done and what they found, a scan reads only the
pairs that are missing, and findings are joined back to every path and version with that content.
All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage

BLOB_SCHEMA = "blob string, kind string, version int"
FOUND_SCHEMA = "blob string, kind string, version int, start long, stop long, value string"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are findings. ``group`` is the part whose length must reach
    ``least``; a match that fails is dropped, and the text it covers is not searched again.
    A change of the pattern must raise ``version``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


# The patterns of the three base kinds. Letters of the keywords in either case.
BASE_RULES = (
    Rule(
        "assign",
        r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    # a run that is too short fails as a whole, so the least length can stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Kinds beside the base ones.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)


def matches(text: Column, rule: Rule) -> Column:
    """Array of (start, stop, value): code points, stop exclusive, in order. ``text`` may be NULL (none).

    The pieces between matches come from ``split``; both it and ``regexp_extract_all`` walk the
    text from match to match, so adding up lengths of pieces and matches gives each place.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:long,stop:long,value:string>>").alias("out"),
    )
    rows = F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), part.alias("part"))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + F.length(row["gap"])
        end = begin + F.length(row["hit"])
        kept = F.length(row["part"]) >= rule.least
        found = F.array(F.struct(begin.alias("start"), end.alias("stop"), row["part"].alias("value")))
        # the last gap has no match after it
        return F.struct(
            F.coalesce(end, begin).alias("at"),
            F.when(F.coalesce(kept, F.lit(False)), F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"),
        )

    none = F.array().cast("array<struct<start:long,stop:long,value:string>>")
    # most texts have no match at all: look once before taking them apart
    return F.when(text.rlike(rule.pattern), F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(none)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def scan_versions(
    files: DataFrame,
    path: str,
    version: str,
    text: str,
    rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES,
    ledger: tuple[DataFrame, DataFrame] | None = None,
    known: DataFrame | None = None,
):
    """Scan the blobs of ``files`` that ``ledger`` does not know yet.

    Returns ``(findings, scanned, found, paths)``. ``findings`` has one row per path, version and
    match of any blob, old or new: ``path, version, blob, kind, rule_version, start, stop, value``.
    ``scanned`` (blob, kind, version) and ``found`` are the new ledger, to be written by the
    caller; ``paths`` is the blob of every path and version. ``known`` (columns as ``files``) names all
    files that findings go to, where they are more than the delivery that is scanned.

    NULL text is a blob like the empty text. NULL paths and versions are kept as they are. Rows
    that repeat a path and version with the same text count once; with different texts each text
    is a blob of that path. Empty tables give empty results. Other columns are ignored.
    """
    spark = files.sparkSession
    old_scanned, old_found = ledger or (
        spark.createDataFrame([], BLOB_SCHEMA),
        spark.createDataFrame([], FOUND_SCHEMA),
    )
    body = F.coalesce(files[text], F.lit(""))
    named = files.select(
        files[path].alias("path"), files[version].alias("version"), body.alias("body"), F.sha2(body, 256).alias("blob")
    )
    paths = fresh_paths = stage(named.select("path", "version", "blob").distinct())
    if known is not None:
        content = F.sha2(F.coalesce(known[text], F.lit("")), 256)
        paths = stage(known.select(known[path].alias("path"), known[version].alias("version"), content.alias("blob")).distinct())
    # one path and version stands for each blob; its text is the one that gets scanned
    blobs = fresh_paths.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    asked = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    pairs = blobs.select("blob", "at", F.explode(asked).alias("r"))
    todo = pairs.select("blob", "at", "r.kind", "r.version").join(old_scanned, ["blob", "kind", "version"], "left_anti")
    todo = todo.groupBy("blob", "at").agg(F.collect_set("kind").alias("kinds"))
    todo = stage(todo.select("blob", F.col("at.path").alias("p"), F.col("at.version").alias("v"), "kinds"))
    keyed = named.withColumnRenamed("blob", "b")
    fresh = keyed.join(
        todo,
        (keyed["b"] == todo["blob"]) & _same(keyed["path"], todo["p"]) & _same(keyed["version"], todo["v"]),
    )
    def found_by(r: Rule) -> Column:
        place = F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")
        asked = F.when(F.array_contains("kinds", r.kind), matches(F.col("body"), r))
        return F.transform(asked, lambda m: F.struct(*place, m["start"], m["stop"], m["value"]))

    each = F.array(*[found_by(r) for r in rules])
    hits = fresh.select("blob", F.explode(F.flatten(F.filter(each, lambda x: x.isNotNull()))).alias("m"))
    new_found = stage(hits.select("blob", "m.*").distinct())
    done = todo.select("blob", F.explode("kinds").alias("kind")).join(F.broadcast(wanted), "kind")
    scanned = old_scanned.unionByName(done)
    found = old_found.unionByName(new_found)
    now = found.join(F.broadcast(wanted), ["kind", "version"], "left_semi").withColumnRenamed("version", "rule_version")
    # staged: a blob of very many paths can then be split
    findings = paths.join(stage(now), "blob").select(
        "path", "version", "blob", "kind", "rule_version", "start", "stop", "value"
    )
    return findings, scanned, found, paths
