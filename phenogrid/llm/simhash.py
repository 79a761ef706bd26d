"""Near-duplicates by SimHash fingerprints and pigeonhole blocks.

A fingerprint is cut into blocks. Two fingerprints that differ in at most ``bits`` bits agree in
all but ``bits`` blocks, so they share the value of some choice of the other blocks. Fingerprints
meet on each such choice and are verified by Hamming distance.

Groups that share a key are compared pair by pair only up to ``most`` members. In a larger group,
which already agrees in the key's bits, the rest of the fingerprint is compared without pairs:
every member stands for the balls of radius ``bits // 2`` and the rest around it. Two members are
within ``bits`` exactly if some word lies within half the distance of either (flip half of the
differing bits), so members are linked to such words instead of to one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_POWERS = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of word shingles, repeats included. Words are runs of characters other
    than ASCII white space, A-Z in lower case; a text of fewer words is one shingle; none gives 0."""
    words = [] if text is None else text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 65536):  # bounded memory for very long texts
        stop = min(count, at + 65536)
        pairs = zip(starts[at:stop].tolist(), ends[at + shingle - 1 : stop + shingle - 1].tolist())
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, stop - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(_POWERS[2 * ones > count].sum(dtype=np.uint64))


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, len(texts))
            yield pd.Series(found.view(np.int64))

    return F.pandas_udf(run, "long")


def add_fingerprint(df: DataFrame, text: str, shingle: int = 3, seed: int = 42, into: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of ``text`` as a signed long; NULL and empty texts have 0."""
    return df.withColumn(into, _fingerprints(shingle, seed)(F.col(text)))


def _blocks(count: int) -> list[int]:
    """Masks of ``count`` blocks of nearly equal width."""
    edges = [round(i * 64 / count) for i in range(count + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _node(kind: int, fp: Column, c: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), fp.alias("fp"), c.alias("c"))


def links(prints: DataFrame, bits: int = 2, most: int = 32) -> DataFrame:
    """Links between the distinct values of ``prints(fp)``: ``(a, b)`` structs of (kind, fp, c),
    where a node of kind 0 is a fingerprint and one of kind 1 a word between fingerprints that
    agree on choice ``c``. Fingerprints are in one component of these links exactly if a chain of
    steps of at most ``bits`` differing bits joins them. ``bits`` is even.
    """
    if bits % 2:
        raise ValueError("the distance must be even")
    choices = [_signed(sum(c)) for c in combinations(_blocks(bits + 2), 2)]  # 2 of bits + 2 blocks agree
    cuts = [F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(choices)]
    keyed = prints.select("fp", F.explode(F.array(*cuts)).alias("k")).select("fp", "k.c", "k.v")
    shared = keyed.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")  # one alone links nothing
    keyed = stage(keyed.join(stage(shared), ["c", "v"]))
    few, many = keyed.where(F.col("n") <= most), keyed.where(F.col("n") > most)

    left, right = few.select("c", "v", F.col("fp").alias("x")), few.select("c", "v", F.col("fp").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= bits
    pairs = left.join(right, ["c", "v"]).where((F.col("x") < F.col("y")) & near)
    none = F.lit(-1)
    direct = pairs.select(_node(0, F.col("x"), none).alias("a"), _node(0, F.col("y"), none).alias("b")).distinct()

    mask = F.element_at(F.array(*map(F.lit, choices)), F.col("c") + 1)
    single = F.array(*[F.lit(_signed(1 << i)) for i in range(64)])
    words = F.array("fp")
    for _ in range(bits // 2):
        flips = F.transform(words, lambda w: F.concat(F.array(w), F.transform("free", lambda b: w.bitwiseXOR(b))))
        words = F.array_distinct(F.flatten(flips))
    spread = many.withColumn("free", F.filter(single, lambda b: mask.bitwiseAND(b) == 0))
    spread = spread.select("fp", "c", F.explode(words).alias("w"))
    met = spread.groupBy("c", "w").agg(F.count("*").alias("m")).where("m > 1").select("c", "w")
    around = spread.join(met, ["c", "w"]).select(
        _node(0, F.col("fp"), none).alias("a"), _node(1, F.col("w"), F.col("c")).alias("b")
    )
    return direct.union(around)


def near_duplicates(df: DataFrame, key: str, text: str, shingle: int = 3, bits: int = 2, seed: int = 42) -> DataFrame:
    """``(key, fingerprint, component)`` for every row: texts whose fingerprints are joined by steps
    of at most ``bits`` differing bits share a component, named by the smallest key in it.

    NULL and empty texts have fingerprint 0 and are linked like any other; NULL keys take part but
    name a component only if it holds no other key; repeated rows each keep their row; an empty
    table gives no rows; other columns are ignored. Copies are merged by fingerprint before any
    comparison, so a group of copies costs one fingerprint.
    """
    named = df.select(df[key].alias("_key"), df[text].alias("_text"))
    rows = stage(add_fingerprint(named, "_text", shingle, seed, "fp").drop("_text"))
    prints = stage(rows.groupBy("fp").agg(F.min("_key").alias("first")))
    roots = components(links(prints.select("fp"), bits))
    named = roots.where("node.kind = 0").select(F.col("node.fp").alias("fp"), "root")
    groups = prints.join(named, "fp", "left")
    lowest = groups.where("root is not null").groupBy("root").agg(F.min("first").alias("low"))
    homes = groups.join(lowest, "root", "left").select("fp", F.coalesce("low", "first").alias("component"))
    return rows.join(stage(homes), "fp").select(F.col("_key").alias(key), F.col("fp").alias("fingerprint"), "component")
