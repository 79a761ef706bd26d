"""Toxicity by class-conditional Kneser-Ney models.

An expression (a word) is scored by two character models, one of toxic and one of ordinary texts.
Only the highest order, five letters, holds counts of a class. It is discounted and backs off to
orders of fewer letters that both classes share: there a gram counts by the number of different
letters that stand before it in any word of either class, so a rare expression leans on how freely its
parts combine, and one that neither class knows gives no evidence. (A gram that begins the word has
no letter before it; it is a highest order, too.) The difference of the two log-likelihoods, divided
by the length, is the evidence of an expression and of a text: :meth:`Model.rate` is that comparison
alone. The score puts it, the strongest words and the strongest run of words on a logistic curve
fitted on texts held back from the counts.

Counts come from all labelled texts, and the tables grow with them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage, unstage
from .phrases import bloom, holds
from .sampling import labelled_sample

SAMPLE_ROWS = 6000  # per class, for the curve
LEAST_BUCKETS, MOST_BUCKETS = 1 << 18, 1 << 22
ORDER = 5
DISCOUNT = 0.75
LETTERS = 1 << 12  # a letter never seen has one chance in so many
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CACHE = 100_000


def words_of(text: str | None) -> list[str]:
    return [] if not text else _WORD.findall(text.lower())


def _grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Letters of all words with both ends, hashes of the grams of orders 1 to ORDER that end at
    each letter (shorter at the start of a word), and the word of each letter. The opening end is
    context only and has no row."""
    text = "".join([f"\x02{w}\x03" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    opens = codes == 2
    owner = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)[owner]
    depth = np.arange(len(codes)) - first  # letters before this one in its word, the opening included
    hashes = []
    mixed = np.zeros(len(codes), np.uint64)
    for n in range(ORDER):
        # add the letter n places back, where the word reaches that far
        back = np.zeros(len(codes), np.uint64)
        if n:
            back[n:] = codes[:-n]
        else:
            back = codes
        reach = depth >= n
        grown = (mixed ^ (back + np.uint64(n * 7919 + 1))) * _MIX
        grown ^= grown >> np.uint64(31)
        mixed = np.where(reach, grown, mixed)
        hashes.append(mixed.copy())
    keep = ~opens
    return codes[keep], [h[keep] for h in hashes], owner[keep], depth[keep]


def _contexts(words: list[str]) -> list[np.ndarray]:
    """Hashes of the n letters before each letter, n from 1 to ORDER - 1."""
    text = "".join([f"\x02{w}\x03" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    opens = codes == 2
    depth = np.arange(len(codes)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
    mixed = np.full(len(codes), 0x5851F42D4C957F2D, np.uint64)
    out = []
    for n in range(1, ORDER):
        back = np.zeros(len(codes), np.uint64)
        back[n:] = codes[:-n]
        grown = (mixed ^ (back + np.uint64(n * 104729 + 3))) * _MIX
        grown ^= grown >> np.uint64(31)
        mixed = np.where(depth >= n, grown, mixed)
        out.append(mixed.copy())
    return [h[~opens] for h in out]


@dataclass
class Model:
    """Tables by hash. ``gram`` and ``context`` hold counts of the highest order per class, ``kinds`` the
    number of different letters after a context, per class. ``lower[k]`` holds the same three for the
    shared order of k + 1 letters, in numbers of different letters before."""

    gram: np.ndarray  # (2, buckets)
    context: np.ndarray
    kinds: np.ndarray
    lower: np.ndarray  # (ORDER - 1, 3, buckets)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(5))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scale: np.ndarray = field(default_factory=lambda: np.ones(4))
    cache: dict = field(default_factory=dict)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"} | {"cache": {}}

    def evidence(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        buckets = np.uint64(self.gram.shape[1])
        codes, hashes, owner, depth = _grams(words)
        contexts = [np.zeros(len(codes), np.uint64), *_contexts(words)]
        places = lambda h: ((h >> np.uint64(20)) % buckets).astype(np.int64)
        smooth = lambda grams, total, kinds, p: np.where(
            total > 0, (np.maximum(grams - DISCOUNT, 0.0) + DISCOUNT * kinds * p) / np.maximum(total, 1), p
        )
        p = np.full(len(codes), 1.0 / LETTERS)
        for k in range(ORDER - 1):
            grams, total, kinds = self.lower[k]
            at, over = places(hashes[k]), places(contexts[k])
            # an order counts where the word has a letter before its gram
            p = np.where(depth > k, smooth(grams[at], total[over], kinds[over], p), p)
        at, over = places(hashes[-1]), places(contexts[-1])
        toxic, ordinary = (smooth(self.gram[c][at], self.context[c][over], self.kinds[c][over], p) for c in (1, 0))
        return np.bincount(owner, np.log(toxic) - np.log(ordinary), minlength=len(words))

    def rate(self, text: str | None) -> float:
        """The comparison alone: log-likelihood of the toxic less that of the ordinary model, per letter."""
        return float(self.features(text)[0])

    def of_words(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        if len(self.cache) > _CACHE:
            self.cache.clear()
            new = list(dict.fromkeys(words))
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            self.cache.update(zip(part, self.evidence(part).tolist()))
        return np.fromiter(map(self.cache.__getitem__, words), float, len(words))

    def features(self, text: str | None) -> np.ndarray:
        """Per-letter evidence of the text, the strongest expression, the strongest run of five
        words, and the amount of strong evidence, on a log scale."""
        words = words_of(text)
        if not words:
            return np.zeros(4)
        gain = self.of_words(words)
        letters = np.fromiter(map(len, words), float, len(words)) + 1
        rate = gain / letters
        sums, sizes = np.cumsum(np.append(0, gain)), np.cumsum(np.append(0, letters))
        n = min(5, len(words))
        run = ((sums[n:] - sums[:-n]) / (sizes[n:] - sizes[:-n])).max()
        strong = np.sort(gain[gain > 3.0])[::-1]
        return np.array([gain.sum() / letters.sum(), rate.max(), run, np.log1p(strong.sum())])

    def score(self, text: str | None) -> float:
        x = (self.features(text) - self.shift) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.curve[:4] + self.curve[4], -30, 30))))


_SEEN = "k int, c int, context long, gram long, before long, n double"


def _counts(words: list[str], times: np.ndarray, toxic: np.ndarray) -> pd.DataFrame:
    """Rows of _SEEN: for the highest order (k = ORDER - 1) counts of each class; for the shared orders
    one row for every gram with a different letter before it, class and count 0."""
    _, hashes, owner, depth = _grams(words)
    contexts = [np.zeros(len(owner), np.uint64), *_contexts(words)]
    parts = [pd.DataFrame({"k": ORDER - 1, "c": toxic[owner], "context": contexts[-1].view(np.int64), "gram": hashes[-1].view(np.int64), "before": 0, "n": times[owner]})]
    for k in range(ORDER - 1):
        at = depth > k
        longer = hashes[k + 1][at].view(np.int64)  # stands for the letter before
        parts.append(pd.DataFrame({"k": k, "c": 0, "context": contexts[k][at].view(np.int64), "gram": hashes[k][at].view(np.int64), "before": longer, "n": 0.0}))
    return pd.concat(parts).groupby(["k", "c", "context", "gram", "before"], as_index=False).sum()


def _tables(words: DataFrame) -> Model:
    """Counts from ``words(word, toxic, n)``. Each task emits its sparse counts; Spark adds them up by
    gram, and their sums by bucket go to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield _counts(list(rows["word"]), rows["n"].to_numpy(float), rows["toxic"].to_numpy(int))

    seen = words.mapInPandas(run, _SEEN).groupBy("k", "c", "context", "gram", "before").agg(F.sum("n").alias("n"))
    seen = stage(seen)
    top = F.col("k") == ORDER - 1
    # by gram: occurrences, or different letters before
    grams = stage(seen.groupBy("k", "c", "context", "gram").agg(F.when(F.max(top), F.sum("n")).otherwise(F.count("*")).cast("double").alias("n")))
    unstage(seen)
    different = grams.count()
    buckets = min(max(LEAST_BUCKETS, 1 << (2 * different).bit_length()), MOST_BUCKETS)
    model = Model(*[np.zeros((2, buckets), np.float32) for _ in range(3)], np.zeros((ORDER - 1, 3, buckets), np.float32))
    bucket = lambda c: F.pmod(F.shiftrightunsigned(c, 20), F.lit(buckets)).cast("int")
    tables = (("gram", F.sum("n")), ("context", F.sum("n")), ("context", F.count("*")))
    for i, (key, value) in enumerate(tables):
        sums = grams.groupBy("k", "c", bucket(key).alias("at")).agg(value.cast("float").alias("v")).toArrow()
        k, c, at, v = (sums.column(n).to_numpy() for n in ("k", "c", "at", "v"))
        highest = k == ORDER - 1
        (model.gram, model.context, model.kinds)[i][c[highest], at[highest]] = v[highest]
        model.lower[k[~highest], i, at[~highest]] = v[~highest]
    unstage(grams)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    penalty = np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + penalty @ w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame, key: str, text: str, marks: DataFrame, toxic: str, sample_rows: int = SAMPLE_ROWS
) -> Model:
    """Fit on the texts of ``docs`` that ``marks(key, toxic)`` labels 0 or 1, one label per key.

    Four fifths of all of them, chosen by the hash of the text, are counted. Of the rest at most
    ``sample_rows`` different texts per class fit the curve. Rows with NULL text, key or label are not
    used. Without both classes every score is 0.5.
    """
    named = marks.select(F.col(key), F.col(toxic).cast("int").alias("toxic")).where("toxic in (0, 1)")
    back = F.pmod(F.shiftright(F.xxhash64(text), 9), F.lit(5)) == 0
    known = docs.select(key, text).where(F.col(text).isNotNull())
    sample = stage(labelled_sample(known.where(back), key, text, named, "toxic", sample_rows))
    # texts without a label stay where they are: a filter of fixed size lets few of them into the join
    labelled = known.sparkSession.sparkContext.broadcast(bloom(named.select(F.xxhash64(key).alias("h"))))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(2).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(holds(labelled.value, h)))

    hashed = known.where(~back).select(key, text, F.xxhash64(key).alias("_h"))
    learned = hashed.mapInArrow(some, hashed.schema).join(named, key).select(F.col(text).alias("text"), "toxic")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, str], int] = Counter()
        for batch in batches:
            for t, c in zip(batch["text"], batch["toxic"]):
                for w in words_of(t):
                    found[c, w] += 1
            if len(found) > _CACHE:
                yield counted(found)
                found.clear()
        if found:
            yield counted(found)

    def counted(found: Counter) -> pd.DataFrame:
        toxic, word = zip(*found)
        # plain strings: one Arrow array, however many
        return pd.DataFrame({"word": pd.Series(word, dtype=object), "toxic": toxic, "n": pd.Series(list(found.values()), dtype=int)})

    words = learned.mapInPandas(count, "word string, toxic int, n long")
    model = _tables(words.groupBy("word", "toxic").agg(F.sum("n").alias("n")))
    held = sample.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([held.value.features(t) for t in texts], columns=list("abcd"))

    marked = sample.select("toxic", F.pandas_udf(features, "a double, b double, c double, d double")("text").alias("f"))
    points = marked.select("toxic", "f.*").toPandas()
    unstage(sample)
    held.unpersist()
    if points["toxic"].nunique() == 2:
        x = points[list("abcd")].to_numpy()
        model.shift, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        model.curve = _logistic((x - model.shift) / model.scale, points["toxic"].to_numpy(float))
    return model


def add_score(df: DataFrame, text: str, model: Model, into: str = "toxicity") -> DataFrame:
    """``df`` with the probability that a text is toxic.

    NULL, empty and wordless texts carry no evidence and get the score of zero evidence. Whole texts
    count. Repeated rows get equal scores. A column of that name is replaced. The model's tables
    grow with the letter grams of the labelled texts, to MOST_BUCKETS entries each, and are broadcast.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([held.value.score(t) for t in texts], dtype=float)

    return df.withColumn(into, F.pandas_udf(run, "double")(F.col(text)))
