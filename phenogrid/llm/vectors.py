"""Nearest neighbours by a block matrix join.

Rows are numbered without gaps and packed into full blocks, however the table was cut. Every query
block meets every candidate block in one tile. A tile multiplies int8 images of the vectors; the norms of what rounding left
out bound the error of each product, so all candidates whose upper bound reaches the k-th best
lower bound are multiplied again in double precision. Tiles of a query block are merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

QUERY_ROWS, ROWS = 1024, 8192


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, norms of the rounded rows, norms of the rounding errors."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top / 127, 1.0)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    image = q * scale[:, None]
    return q, scale, np.linalg.norm(image, axis=1), np.linalg.norm(x - image, axis=1)


def tile(queries: np.ndarray, query_rows: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, numbers: np.ndarray | None = None):
    """(query row, id, score) of the k largest inner products of each query with all rows but its
    own; exact, ties to smaller ids. ``numbers`` are the row numbers of ``rows``, ``ids`` by default.
    Scores add products from the first component to the last."""
    numbers = ids if numbers is None else numbers
    qa, sa, na, ea = _quantise(queries)
    qb, sb, nb, eb = _quantise(rows)
    # products of int8 rows are whole numbers, exact in float32 up to 1040 components
    kind = np.float32 if queries.shape[1] <= 1040 else np.float64
    near = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    full = np.linalg.norm(rows, axis=1)
    # x.y - x'.y' = x'.(y - y') + (x - x').y; a little more for the rounding of the sums themselves
    slack = na[:, None] * eb[None, :] + ea[:, None] * full[None, :]
    slack += 1e-9 * (na + ea)[:, None] * (nb + eb)[None, :]
    other = query_rows[:, None] != numbers[None, :]
    low = np.where(other, near - slack, -np.inf)
    high = np.where(other, near + slack, -np.inf)
    if k < len(ids):
        limit = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
    else:
        limit = np.full(len(queries), -np.inf)
    keep = other & (high >= limit[:, None])
    for i in range(len(queries)):
        at = np.flatnonzero(keep[i])
        exact = np.cumsum(queries[i] * rows[at], axis=1)[:, -1] if len(at) else np.zeros(0)
        for j in np.lexsort((ids[at], -exact))[:k]:
            yield int(query_rows[i]), int(ids[at[j]]), float(exact[j])


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(row, id, v)``: vectors of double without NULL or non-finite components and not all zero, with
    a number for every row; staged, so the numbers stay."""
    v = F.col("v")
    plain = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("v"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = plain.where(v.isNotNull() & F.col("id").isNotNull() & good)
    return stage(kept.select(F.monotonically_increasing_id().alias("row"), "id", "v"))


def _packed(vectors: DataFrame, most: int, name: str) -> DataFrame:
    """Rows of (row, id, v) as blocks of ``most``: ``dim``, ``name`` (number of the block among those of its
    dim, from 0), ``rows, ids, cells``; staged. Rows are numbered within the parts of the table and
    the parts' starts carried, so no task sees more than a part or a block."""
    placed = vectors.withColumns({"dim": F.size("v"), "part": F.shiftright("row", 33)})
    starts = placed.groupBy("dim", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(starts.select("dim", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    local = F.row_number().over(Window.partitionBy("dim", "part").orderBy("row")) - 1
    numbered = placed.withColumn("at", local).join(starts, ["dim", "part"])
    blocked = numbered.select("dim", ((F.col("start") + F.col("at")) / most).cast("int").alias(name), "row", "id", "v")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        ints = [[pdf[c].to_numpy(np.int64).tobytes()] for c in ("row", "id")]
        first = pdf.iloc[0]
        return pd.DataFrame({"dim": first["dim"], name: first[name], "rows": ints[0], "ids": ints[1], "cells": [cells.tobytes()]})

    return stage(blocked.groupBy("dim", name).applyInPandas(pack, f"dim int, {name} int, rows binary, ids binary, cells binary"))


def search(df: DataFrame, key: str, vector: str, every: int, k: int = 20) -> DataFrame:
    """``(query_id, rank, id, score)``: for every row whose id is divisible by ``every`` the ``k`` other
    rows with the largest inner product, or all if there are fewer; ranks from 1, ties to the smaller id.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components take no part, nor do
    NULL ids. A vector is compared with those of its own length. Every row counts: rows that
    repeat an id are candidates of their own, also for each other, and if the id is a query each of
    them has its own ranking under that id. An empty table gives no rows; other columns are ignored.
    The answer is exact.

    The number of tiles is the number of query blocks times that of candidate blocks, and blocks are
    full whatever the partitions of the table. Candidates move once per query block; a query block
    keeps ``k`` rows per query and tile.
    """
    all_rows = usable(df, key, vector)
    queries = _packed(all_rows.where(F.col("id") % every == 0), QUERY_ROWS, "q")
    blocks = _packed(all_rows, ROWS, "c")
    counts = stage(blocks.groupBy("dim").agg(F.max("c").alias("last")))  # one row per length of vectors
    asked = queries.withColumnsRenamed({"rows": "qr", "ids": "qi", "cells": "qv"}).join(counts, "dim")
    pairs = asked.select("dim", "q", F.explode(F.sequence(F.lit(0), "last")).alias("c"))  # numbers only
    tiles = pairs.join(asked.drop("last"), ["dim", "q"]).join(blocks, ["dim", "c"])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                left = np.frombuffer(t.qv).reshape(-1, t.dim)
                right = np.frombuffer(t.cells).reshape(-1, t.dim)
                own = np.frombuffer(t.qr, np.int64)
                found = tile(left, own, right, np.frombuffer(t.ids, np.int64), k, np.frombuffer(t.rows, np.int64))
                made = pd.DataFrame(found, columns=["query", "id", "score"])
                names = dict(zip(own.tolist(), np.frombuffer(t.qi, np.int64).tolist()))
                yield made.assign(query_id=made["query"].map(names).astype("int64"))[["query", "query_id", "id", "score"]]

    columns = ["dim", "qr", "qi", "qv", "rows", "ids", "cells"]
    best = tiles.select(*columns).mapInPandas(products, "query long, query_id long, id long, score double")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        heaps: dict[tuple[int, int], list] = {}
        queries = zip(rows["query"].tolist(), rows["query_id"].tolist())
        for query, other, score in zip(queries, rows["id"].tolist(), rows["score"].tolist()):
            heap = heaps.setdefault(query, [])
            if len(heap) < k:
                heapq.heappush(heap, (score, -other))
            elif (score, -other) > heap[0]:
                heapq.heapreplace(heap, (score, -other))
        out = [(q, i, -o, s) for (_, q), h in heaps.items() for i, (s, o) in enumerate(sorted(h, reverse=True), 1)]
        return pd.DataFrame(out, columns=["query_id", "rank", "id", "score"])

    # a query's candidates: k rows of each tile
    salted = best.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(1 << 16)))
    return salted.groupBy("part").applyInPandas(
        lambda rows: merge(rows), "query_id long, rank int, id long, score double"
    )
