"""Collocations by SON partitioning.

1. Texts become chunks: some ten thousand words of one language, numbered by the chunk's own
   vocabulary. Every later pass reads numbers, not text. The chunks of every ``shards``-th task are
   a shard, so a shard is a fixed part of the data, however large that is.
2. Level by level (phrases of 1, 2, ... words) every shard is mined completely at the support
   lowered in proportion, ``ceil(least * words of the shard / words of the language)``. Tasks add up
   what they hold and send their sums as sorted lists of 40-bit hashes, of which only the gaps are
   stored; lists of one range of hashes meet in a task. A phrase that reaches ``least`` overall
   reaches its share in one shard at least, so the union of the locally frequent phrases misses none.
3. All candidates of the union are then counted in all chunks, exactly, and their counts added up.

A phrase is only looked at where both phrases one word shorter are frequent overall. Tasks learn
of the frequent phrases and of the candidates through Bloom filters of a fixed size. Two phrases of
one hash, or a false positive, cost a count that is dropped later; no phrase is lost and no count
changes, since counts are kept by the words themselves, never by hashes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage, unstage

SHARDS, TASK_WORDS, CHUNK_WORDS = 4, 2_000_000, 1 << 18
BLOOM_BITS, HASH_BITS = 1 << 26, 40
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
UNKNOWN = "und"
# A-Z to lower case, ends of pieces to line feed, tab to space
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256)
)
# rows are large: without these settings Parquet would first look at the size of a page after a hundred
_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": "8388608"}
_PAGES["compression"] = "zstd"
_CHUNKS = "lang string, shard int, n long, ids binary, hashes binary, words array<string>"


def _kind(words: int):
    return np.uint16 if words < 1 << 16 else np.uint32


class _Chunk:
    """Words of one language as numbers from 1; 0 ends a piece. Two bytes a number where they do."""

    def __init__(self):
        self.numbers: defaultdict = defaultdict(count().__next__)
        self.parts: list[np.ndarray] = []
        self.held = 0  # entries, ends of pieces included
        self.end, self.gap = self.numbers[b"\n"], self.numbers[b""]

    def add(self, text: bytes) -> None:
        tokens = text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
        ids = np.append(ids[ids != self.gap], np.int32(self.end))
        # of several ends in a row one says as much
        ids = ids[np.append(True, (ids[1:] != self.end) | (ids[:-1] != self.end))]
        self.parts.append(ids)
        self.held += len(ids)

    def row(self, lang: str, shard: int) -> pa.RecordBatch:
        ids = np.maximum(np.concatenate(self.parts) - 1, 0)  # the two signs had the first numbers
        words = list(self.numbers)[2:]
        seed = _seed(lang)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) or 1 for w in words), np.uint64, len(words))
        texts = pa.array(words, pa.binary()).cast(pa.string())
        columns = [
            pa.array([lang]),
            pa.array([shard], pa.int32()),
            pa.array([int(np.count_nonzero(ids))], pa.int64()),
            pa.array([ids.astype(_kind(len(words))).tobytes()], pa.binary()),
            pa.array([hashes.tobytes()], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), texts),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "shard", "n", "ids", "hashes", "words"])


def chunks_of(docs: DataFrame, text: str, lang: str, shards: int = SHARDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Rows ``lang, shard, n, ids, hashes, words`` of about ``chunk_words`` words of one language, or the
    words of one longer text. A task holds at most sixteen times that many, over all languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Chunk] = {}
        total, shard = 0, TaskContext.get().partitionId() % shards
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunk = held.setdefault(name, _Chunk())
                before = chunk.held
                chunk.add(body)
                total += chunk.held - before
                while total >= 16 * chunk_words or (name in held and held[name].held >= chunk_words):
                    full = max(held, key=lambda k: held[k].held)
                    total -= held[full].held
                    yield held.pop(full).row(full, shard)
        for name in list(held):
            yield held.pop(name).row(name, shard)

    told = docs.select(F.coalesce(docs[lang], F.lit(UNKNOWN)), docs[text].cast("binary")).toDF("lang", "body")
    return told.where(F.length("body") > 0).mapInArrow(run, _CHUNKS).where("n > 0")


def _places(hashes: Column) -> Column:
    """The two bits of a hash in a Bloom filter."""
    mask = F.lit(BLOOM_BITS - 1)
    return F.array(hashes.bitwiseAND(mask), F.shiftrightunsigned(hashes, 32).bitwiseAND(mask))


def bloom(hashes: DataFrame) -> np.ndarray:
    """Bloom filter of the column ``h``: set in Spark, at most BLOOM_BITS / 64 numbers reach the driver."""
    bits = hashes.select(F.explode(_places(F.col("h"))).alias("p"))
    cells = bits.groupBy(F.shiftright("p", 6).alias("cell")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")
    )
    rows = cells.toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[rows["cell"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _key(narrow: np.ndarray) -> np.ndarray:
    """The number by which a filter knows a hash of HASH_BITS bits."""
    mixed = narrow * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(31))


def _narrow(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - HASH_BITS)


def _inside(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return holds(bits, _key(_narrow(hashes)))


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the numbers a filter may hold."""
    out = np.ones(len(keys), bool)
    for shift in (0, 32):
        p = (keys >> np.uint64(shift)) & np.uint64(BLOOM_BITS - 1)
        out &= ((bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def _numbers(batch: pa.RecordBatch, column: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of a chunk, and the word hash at every place (0 ends a piece)."""
    hashes = np.frombuffer(batch.column(column + 1)[row].as_buffer(), np.uint64)
    ids = np.frombuffer(batch.column(column)[row].as_buffer(), _kind(len(hashes)))
    return ids, np.append(np.uint64(0), hashes)[ids]


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word."""
    mixed = (h ^ (word * _MIX[0])) * _MIX[1]
    return mixed ^ (mixed >> np.uint64(29))


def _starts(words: np.ndarray, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where a phrase of ``len(known) + 1`` words starts whose shorter phrases pass the filters of
    ``known`` (by number of words), and the hashes of these phrases. ``words`` are word hashes."""
    at = np.flatnonzero(words).astype(np.int32)
    h = words[at]
    for size, bits in enumerate([*known, None], 1):
        if size > 1:
            follows = np.flatnonzero(at[1:] == at[:-1] + 1)
            at, h = at[follows], h[follows]
            h = _longer(h, words[at + (size - 1)])
        if bits is not None:
            found = _inside(bits, h)
            at, h = at[found], h[found]
    return at, h


def _groups(ids: np.ndarray, at: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, count) of every different phrase, by its words, among those that start at ``at``."""
    if size == 1:  # the number of a word says it all
        word = ids[at]
        first = np.zeros(int(word.max(initial=0)) + 1, np.int32)
        first[word[::-1]] = at[::-1]
        times = np.bincount(word)
        found = np.flatnonzero(times)
        return first[found], times[found]
    order = np.argsort(h, kind="stable")
    for exact in (False, True):
        if exact:  # different phrases of one hash
            order = np.lexsort([ids[at + j] for j in range(size)])
        place, key = at[order], h[order]
        other = np.zeros(max(len(at) - 1, 0), bool)
        for j in range(size):
            word = ids[place + j]
            other |= word[1:] != word[:-1]
        if not (other & (key[1:] == key[:-1])).any():
            break
    first = np.flatnonzero(np.append(True, other)) if len(at) else np.zeros(0, np.int64)
    return place[first], np.diff(np.append(first, len(at)))


_SUMS = "lang string, shard int, bucket int, width int, gaps binary, times binary"


def _packed(h: np.ndarray, times: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(bucket, bytes a gap, gaps, counts) of sorted hashes, cut into 2 ** ``bits`` equal ranges."""
    low = np.uint64(HASH_BITS - bits)
    buckets = (h >> low).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])[: len(h)])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]):
        inside = h[a:b] & np.uint64((1 << int(low)) - 1)
        gaps = np.diff(inside, prepend=np.uint64(0))
        width = max(1, -(-int(gaps.max()).bit_length() // 8))
        yield int(buckets[a]), width, gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), times[a:b].astype("<u4").tobytes()


def _unpacked(bucket: int, width: int, gaps: bytes, times: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(gaps) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(gaps, np.uint8).reshape(-1, width)
    inside = np.cumsum(wide.view("<u8")[:, 0])
    return inside + np.uint64(bucket << (HASH_BITS - bits)), np.frombuffer(times, "<u4").astype(np.int64)


def _mined(chunks: DataFrame, known: list, supports: DataFrame, bits: int, task_words: int) -> DataFrame:
    """Keys ``h`` of the phrases that reach the support of some shard. A task adds up its phrases
    over at most twice ``task_words`` words at a time; 2 ** ``bits`` tasks share those of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [b.value for b in known]
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        size: Counter = Counter()  # words of each part of a shard

        def summed(key: tuple[str, int]) -> Iterator[pa.RecordBatch]:
            _, h = _starts(np.concatenate(held.pop(key)), filters)
            del size[key]
            h = _narrow(h)
            h.sort()
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            for row in _packed(h[first], np.diff(np.append(first, len(h))), bits):
                yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, *row)))], made)

        made = pa.schema([("lang", pa.string()), *[(c, pa.int32()) for c in ("shard", "bucket", "width")], ("gaps", pa.binary()), ("times", pa.binary())])
        names = made.names
        for batch in batches:
            for row, (lang, shard, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                held.setdefault((lang, shard), []).append(_numbers(batch, 3, row)[1])
                size[lang, shard] += n
                while size.total() >= 2 * task_words:
                    yield from summed(max(size, key=size.__getitem__))
        for key in list(held):
            yield from summed(key)

    def frequent(rows: pa.Table) -> pa.Table:
        parts = [_unpacked(*(r[c] for c in ("bucket", "width", "gaps", "times")), bits) for r in rows.to_pylist()]
        h, times = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(h)
        h, times = h[order], times[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        kept = np.add.reduceat(times, first) >= rows["support"][0].as_py()
        return pa.table({"h": _key(h[first[kept]]).view(np.int64)})

    sums = chunks.select("lang", "shard", "n", "ids", "hashes").mapInArrow(run, _SUMS).join(supports.drop("part"), ["lang", "shard"])
    return sums.groupBy("lang", "shard", "bucket").applyInArrow(frequent, "h long")


def _counted(chunks: DataFrame, known: list, wanted, least: int) -> DataFrame:
    """``(lang, phrase, f)`` of all phrases of the filter ``wanted`` that occur ``least`` times overall."""
    size = len(known) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [b.value for b in known]
        for batch in batches:
            texts = batch.column(3)
            for row, lang in enumerate(batch.column(0).to_pylist()):
                ids, words = _numbers(batch, 1, row)
                at, h = _starts(words, filters)
                kept = _inside(wanted.value, h)
                place, times = _groups(ids, at[kept], h[kept], size)
                spelled = [texts[row].values.take(pa.array(ids[place + j].astype(np.int64) - 1)) for j in range(size)]
                phrase = pc.binary_join_element_wise(*spelled, " ") if size > 1 else spelled[0]
                columns = [pa.array([lang] * len(place), pa.string()), phrase, pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

    each = chunks.select("lang", "ids", "hashes", "words").mapInArrow(run, "lang string, phrase string, f long")
    return each.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _keys(found: DataFrame) -> DataFrame:
    """Keys ``h`` of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first, *rest = (np.array([xxhash.xxh64_intdigest(w, _seed(lang)) or 1], np.uint64) for w in phrase.split(" "))
                for word in rest:
                    first = _longer(first, word)
                made.append(_key(_narrow(first)).view(np.int64)[0])
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64())], ["h"])

    return found.select("lang", "phrase").mapInArrow(run, "h long")


def frequent_phrases(docs: DataFrame, text: str, lang: str, least: int, longest: int, shards: int = SHARDS, task_words: int = TASK_WORDS):
    """``(frequent, totals)``: ``lang, phrase, size, f`` of all phrases of up to ``longest`` words that
    occur at least ``least`` times, and ``lang, n``, all words of a language. Both are staged."""
    context = docs.sparkSession.sparkContext
    chunks = stage(chunks_of(docs, text, lang, shards), **_PAGES)
    totals = stage(chunks.groupBy("lang").agg(F.sum("n").alias("n")))
    parts = chunks.groupBy("lang", "shard").agg(F.sum("n").cast("decimal(20,0)").alias("part")).join(totals, "lang")
    supports = stage(parts.select("lang", "shard", "part", F.ceil(F.lit(least) * F.col("part") / F.col("n")).cast("long").alias("support")))
    largest = int(supports.agg(F.max("part")).first()[0] or 0)
    bits = min(24, (largest // task_words).bit_length())
    known, levels = [], []
    for size in range(1, longest + 1):
        wanted = context.broadcast(bloom(_mined(chunks, known, supports, bits, task_words)))
        found = stage(_counted(chunks, known, wanted, least).withColumn("size", F.lit(size)))
        wanted.unpersist()
        levels.append(found)
        if size == longest or found.isEmpty():
            break
        known.append(context.broadcast(bloom(_keys(found))))
    frequent = levels[0]
    for found in levels[1:]:
        frequent = frequent.unionByName(found)
    frequent = stage(frequent.select("lang", "phrase", "size", "f"))
    for table in [chunks, supports, *levels]:
        unstage(table)
    for held in known:
        held.unpersist()
    return frequent, totals


def _inner(size: Column, least: int) -> Column:
    """(from, words) of all contiguous parts of a phrase with at least ``least`` and fewer than ``size`` words."""
    lengths = F.when(size > least, F.sequence(F.lit(least), size - 1)).otherwise(F.array().cast("array<int>"))
    each = lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.struct(i.alias("at"), m.alias("m")))
    return F.flatten(F.transform(lengths, each))


def collocations(
    docs: DataFrame, text: str, lang: str, least: int = 100, longest: int = 5, top: int = 2000, shards: int = SHARDS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: of each language the first ``top`` phrases of 2 to
    ``longest`` words that occur ``a >= least`` times, by score, ``a`` (both falling) and phrase.

    A-Z count as a-z. Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    spaces and tabs; phrases lie within a piece. Cutting a phrase in two gives ``l`` and ``r``, the
    counts of its parts, and ``1000 a n / (l r)``, rounded down, ``n`` being all words of the
    language; the cut of the lowest score counts, the earliest of equal ones. A phrase inside a
    longer one that occurs as often is left out.

    NULL texts are empty, a NULL language is ``und``; empty texts and empty tables give no rows;
    repeated rows count each time; whole texts count, however long; equal scores and counts go by
    the bytes of the phrase; other columns are ignored, whatever their names. Arithmetic is in
    whole numbers of 38 digits, and running out of them is an error.
    """
    frequent, totals = frequent_phrases(docs, text, lang, least, longest, shards)
    words = F.split("phrase", " ")
    phrases = frequent.where("size > 1")
    # parts of frequent phrases are frequent: both joins find every part
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    parts = cuts.select(
        "lang",
        "phrase",
        "a",
        "cut",
        F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("rest"),
    )
    known = frequent.select("lang", F.col("phrase").alias("part"), F.col("f").alias("times"))
    left = known.withColumnsRenamed({"part": "first", "times": "l"})
    right = known.withColumnsRenamed({"part": "rest", "times": "r"})
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    product = (F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n")).cast("decimal(38,0)")
    valued = parts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang").withColumn("product", product)
    score = F.expr("product div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = valued.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    # the most frequent longer phrase around each phrase
    part = _inner(F.col("size"), 2)
    around = phrases.where("size > 2").select("lang", "f", words.alias("words"), F.explode(part).alias("p"))
    around = around.select("lang", F.array_join(F.slice("words", F.col("p.at"), F.col("p.m")), " ").alias("phrase"), "f")
    outer = around.groupBy("lang", "phrase").agg(F.max("f").alias("outer"))
    kept = best.join(outer, ["lang", "phrase"], "left").where("outer is null or outer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
