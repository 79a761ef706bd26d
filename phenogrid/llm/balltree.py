"""Ranked lexical search by exact inner products in sparse ball trees.

A document is a vector with one whole number per term, its weighted impact; an item is the vector
that is 1 at its terms. The score is their inner product. Documents become blocks, and each block a
ball tree: a node knows the centroid of its documents and the radii around it. Space is cut into
groups of terms, each with a radius of its own, as one radius over all terms would say little about
the few of an item. No document of a node can score more than the item's product with the centroid
plus, for every group, the item's length in it times the radius, where the length counts only
terms that occur in the node. Nodes are opened best bound first, and a subtree goes unseen once its
bound is below the k-th best score so far. Bounds are in floating point, rounded up by more than
their error; scores at the leaves are exact.

Only terms of the items matter, so vectors are cut down to those. Items are taken in blocks of
bounded size; a block's vocabulary and weights are broadcast.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage
from .decontaminate import words_of

ITEM_BYTES = 1 << 19  # text of the items of one block
BLOCK_ROWS, LEAF = 4096, 32
GROUPS = 256  # of terms; the more frequent half of them holds one term each
_SAFE = 1e-9  # far above the relative error of sums of a few million doubles


class Rows:
    """Sparse rows: entries of row i at ``start[i]`` to ``start[i + 1]``."""

    def __init__(self, start: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.start, self.terms, self.values = start, terms, values

    def __len__(self) -> int:
        return len(self.start) - 1

    def sums(self, entries: np.ndarray) -> np.ndarray:
        """Sums of an array of entries by row; rows are never empty."""
        return np.add.reduceat(entries, self.start[:-1])

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.start)[rows]
        start = np.append(0, np.cumsum(sizes))
        at = np.repeat(self.start[rows] - start[:-1], sizes) + np.arange(start[-1])
        return Rows(start, self.terms[at], self.values[at])


class Tree:
    """Ball tree over sparse rows of whole numbers. ``order`` holds the rows, leaf by leaf; node i
    covers ``order[lows[i]:highs[i]]`` and has the children ``kids[i]``, or none."""

    def __init__(self, rows: Rows, leaf: int = LEAF):
        self.terms, compact = np.unique(rows.terms, return_inverse=True)
        self.leaf = leaf
        rank = np.argsort(np.argsort(-np.bincount(compact, minlength=len(self.terms)), kind="stable"))
        alone = GROUPS // 2
        self.group = np.where(rank < alone, rank, alone + rank % (GROUPS - alone))
        self.lows, self.highs, self.kids, self.radius, centres = [], [], [], [], []
        self.order: list[np.ndarray] = []
        self._done = 0
        self._build(Rows(rows.start, compact, rows.values.astype(float)), np.arange(len(rows)), centres)
        self.order = np.concatenate(self.order)
        self.centres = np.array(centres)
        self.radius = np.array(self.radius)
        self.rows = rows.take(self.order)

    def _build(self, rows: Rows, names: np.ndarray, centres: list) -> int:
        node, width = len(centres), len(self.terms)
        squares = rows.sums(rows.values**2)
        centre = np.bincount(rows.terms, rows.values, minlength=width) / len(rows)

        def distances(point: np.ndarray, square: float) -> np.ndarray:
            return squares - 2 * rows.sums(rows.values * point[rows.terms]) + square

        square = float(centre @ centre)
        far = distances(centre, square)
        self.radius.append(self._radii(rows, centre))
        centres.append(centre)
        self.lows.append(self._done)
        self.highs.append(0)
        self.kids.append(())
        if len(rows) <= self.leaf:
            self.order.append(names)
            self._done += len(rows)
        else:
            def dense(row: int) -> np.ndarray:
                a, b = rows.start[row], rows.start[row + 1]
                return np.bincount(rows.terms[a:b], rows.values[a:b], minlength=width)

            one = int(far.argmax())
            from_one = distances(dense(one), squares[one])
            two = int(from_one.argmax())
            lean = from_one - distances(dense(two), squares[two])
            halves = np.argsort(lean, kind="stable")
            middle = len(halves) // 2
            self.kids[node] = tuple(
                self._build(rows.take(half), names[half], centres) for half in (halves[:middle], halves[middle:])
            )
        self.highs[node] = self._done
        return node

    def _radii(self, rows: Rows, centre: np.ndarray) -> np.ndarray:
        """Largest distance from the centre in the space of each group."""
        own = np.repeat(np.arange(len(rows)), np.diff(rows.start)) * GROUPS + self.group[rows.terms]
        add = lambda x: np.bincount(own, x, minlength=len(rows) * GROUPS).reshape(-1, GROUPS)
        v, c = rows.values, centre[rows.terms]
        squares = np.bincount(self.group, centre**2, minlength=GROUPS)
        # the centre's own square, less what the row's entries take from it
        far = (add(v * (v - 2 * c)) + squares).max(axis=0)
        # what cancels in the subtraction is bounded by the size of its parts
        return np.sqrt(np.maximum(far, 0) + _SAFE * (add(v * v).max(axis=0) + squares)) * (1 + _SAFE)

    def bounds(self, items: list[np.ndarray]) -> np.ndarray:
        """(nodes, items): no row of the node has a larger product with the item."""
        out = np.zeros((len(self.centres), len(items)))
        place = {t: i for i, t in enumerate(self.terms.tolist())}
        for j, terms in enumerate(items):
            at = [place[t] for t in terms.tolist() if t in place]
            if at:
                found = self.centres[:, at]
                groups, column = np.unique(self.group[at], return_inverse=True)
                inside = np.zeros((len(at), len(groups)))
                inside[np.arange(len(at)), column] = 1
                length = np.sqrt((found > 0) @ inside)
                out[:, j] = (found.sum(axis=1) + (length * self.radius[:, groups]).sum(axis=1)) * (1 + _SAFE) + 1
        return out

    def search(self, bounds: np.ndarray, wanted: np.ndarray, offer) -> int:
        """Best-first search for one item: ``bounds`` of the nodes, ``wanted`` marks its terms. Calls
        ``offer(row, score)`` and keeps on while bounds reach what it returns. Gives the rows scored."""
        heap, scored, least = [(-bounds[0], 0)], 0, offer(None, 0)
        while heap and -heap[0][0] >= max(least, 1):
            _, node = heapq.heappop(heap)
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(heap, (-bounds[kid], kid))
                continue
            low, high = self.lows[node], self.highs[node]
            a, b = self.rows.start[low], self.rows.start[high]
            parts = np.where(wanted[self.rows.terms[a:b]], self.rows.values[a:b], 0)
            scores = np.add.reduceat(parts, self.rows.start[low:high] - a)
            scored += high - low
            for i in np.flatnonzero(scores >= max(least, 1)).tolist():
                least = offer(int(self.order[low + i]), int(scores[i]))
        return scored


class Best:
    """The k best (score, id), larger scores first, then smaller ids, then no id."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def offer(self, key: int | None, score: int) -> int:
        """Take in a row; the score that others must reach."""
        entry = (score, key is not None, -key if key is not None else 0)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)
        return self.least()

    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.k else 0


def _reduced(docs: DataFrame, key: str, text: str, vocab) -> DataFrame:
    """``id, n, terms, tf`` of every document with a term: all its terms with repeats, and the
    numbers and occurrences of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocab.value.get
        for batch in batches:
            keys, sizes, terms, times, ends = [], [], [], [], [0]
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                if not words:
                    continue
                ids = np.fromiter(map(get, words, [-1] * len(words)), np.int32, len(words))
                found, tf = np.unique(ids[ids >= 0], return_counts=True)
                keys.append(name)
                sizes.append(len(words))
                terms.append(found)
                times.append(tf)
                ends.append(ends[-1] + len(found))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.zeros(0)]).astype(np.int32))) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "tf"])

    told = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text")).where("text is not null")
    return told.mapInArrow(run, "id long, n long, terms array<int>, tf array<int>")


def _impacts(n: np.ndarray, start: np.ndarray, tf: np.ndarray, documents: int, words: int) -> np.ndarray:
    m = np.array([10 + (90 * size * documents) // words for size in n.tolist()], np.int64)
    each = np.repeat(m, np.diff(start))
    return (1_000_000_000 * tf) // (1000 * tf + 8 * each)


def _found(docs: DataFrame, key: str, text: str, items: list[list[bytes]], k: int) -> DataFrame:
    """``item, id, score``: the k best of every task for each item, by its place in ``items``."""
    spark = docs.sparkSession
    vocab: dict[bytes, int] = {}
    asked = [np.array(sorted({vocab.setdefault(w, len(vocab)) for w in words}), np.int64) for words in items]
    reduced = stage(_reduced(docs, key, text, spark.sparkContext.broadcast(vocab)))
    documents, words = reduced.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(vocab), np.int64)
    for row in reduced.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[row["t"]] = row["count"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    held = spark.sparkContext.broadcast((asked, weight, documents, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight, documents, words = held.value
        best = [Best(k) for _ in asked]

        def block(parts: list) -> None:
            ids, n, sizes, terms, tf = (np.concatenate(x) for x in zip(*parts))
            start = np.append(0, np.cumsum(sizes))
            values = weight[terms] * _impacts(n, start, tf.astype(np.int64), documents, words)
            tree = Tree(Rows(start, terms, values))
            bounds = tree.bounds(asked)
            wanted = np.zeros(len(weight), bool)
            for j, own in enumerate(asked):
                wanted[own] = True

                def offer(row: int | None, score: int, top=best[j]) -> int:
                    return top.least() if row is None else top.offer(ids[row], score)

                tree.search(bounds[:, j], wanted, offer)
                wanted[own] = False

        parts, rows = [], 0
        for batch in batches:
            keys, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            kept = np.flatnonzero(sizes)  # the others have no term of any item
            names = np.array(keys, object)
            parts.append((names[kept], n[kept], sizes[kept], batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()))
            rows += len(kept)
            if rows >= BLOCK_ROWS:
                block(parts)
                parts, rows = [], 0
        if rows:
            block(parts)
        out = [(j, -e[2] if e[1] else None, e[0]) for j, top in enumerate(best) for e in top.heap if e[0] > 0]
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "id", "score"])

    return reduced.mapInArrow(run, "item int, id long, score long")


def search(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str, item_text: str, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: for every item the ``k`` documents with the highest scores
    above 0, or all if there are fewer; equal scores by ascending key.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z as a-z. With N documents that
    have a term, L terms in them with repeats, n in the document and m = 10 + 90 n N / L rounded
    down, the score adds up, for each term of the item once, ``w (10^9 tf) / (1000 tf + 8 m)`` (rounded
    down before it is weighted), where w is ``1000 ln((2 N + 2) / (2 df + 1))`` rounded down.

    NULL, empty and term-less texts are in no result and not counted in N; rows that repeat a key are
    documents of their own; a NULL key comes after all others of its score. Rows that repeat an item
    id are one item with the terms of all; items without a known term have no rows; a NULL item id
    is an item. Empty tables give no rows. Other columns are ignored. Keys are whole numbers. Whole
    texts count. The answer is exact.

    Items go in blocks of about ``item_bytes`` bytes of text (or one longer item) through the driver;
    each block reads the documents once. What a task holds is a block of items, its vocabulary, and
    a block of documents cut down to that vocabulary.
    """
    spark = docs.sparkSession
    told = benchmark.select(benchmark[item].alias("item"), benchmark[item_text].alias("text")).where("text is not null")
    size = told.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // item_bytes + 1
    kind = benchmark.schema[item].dataType
    made = []
    for block in range(blocks):
        mine = told.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else told
        terms: dict[object, list[bytes]] = {}
        for row in mine.collect():
            terms.setdefault(row["item"], []).extend(words_of(row["text"]))
        if not any(terms.values()):
            continue
        named = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)])
        names = spark.createDataFrame(list(enumerate(terms)), named)
        found = _found(docs, key, text, list(terms.values()), k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        made.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    if not made:
        fields = [("item_id", kind), ("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType())]
        return spark.createDataFrame([], T.StructType([T.StructField(c, t) for c, t in fields]))
    return reduce(DataFrame.unionByName, made)
