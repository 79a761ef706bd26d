"""Text quality by a generalised additive model with pairwise interactions.

A text becomes a few numbers about its characters, words and lines. Every number is cut into bins,
and the log odds of a good text are a sum of lookup tables: one per number, and one per chosen pair
of numbers. The tables are learned by boosting: round after round, every number in turn gets a
shallow tree fitted to the current gradient, and the tree's leaves are added to its table, damped.
Going round in turn lets numbers that say the same share the work, so each table can be read by
itself. Afterwards the pairs that explain most of what is left are boosted in the same way. A
held-back fifth of the sample says when to stop.

Scoring looks bins up and adds: no tree is walked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage, unstage
from .sampling import labelled_sample

SAMPLE_ROWS = 6000  # per class
BINS, PAIR_BINS, PAIRS = 32, 8, 12
ROUNDS, PAIR_ROUNDS, RATE, PATIENCE = 400, 150, 0.1, 25
FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "ends", "spaces", "other_letters",
    "char_entropy", "char_runs", "distinct_words", "top_word", "same_word", "distinct_pairs", "upper_words",
    "symbol_words", "title_words", "log_lines", "distinct_lines", "line_words", "sentence_words", "ended_lines",
)
_ENDS = np.array([ord(c) for c in ".,;:?"])
_SYMBOL = re.compile(r"[^\w\s.,;:?'\"()-]")
_kinds: list[np.ndarray] = []


def _kind() -> np.ndarray:
    """By code point: 1 space, 2 digit, 3 lower or caseless letter, 4 upper-case letter, 0 anything else."""
    if not _kinds:
        signs = map(chr, range(0x110000))
        _kinds.append(
            np.fromiter((1 if c.isspace() else 2 if c.isdigit() else 4 if c.isupper() else 3 if c.isalpha() else 0 for c in signs), np.int8, 0x110000)
        )
    return _kinds[0]


def features_of(text: str | None) -> np.ndarray:
    """The numbers of FEATURES for a whole text; all 0 for NULL, empty and blank texts."""
    out = np.zeros(len(FEATURES))
    words = text.split() if text else []
    if not words:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = len(codes)
    kinds = np.bincount(_kind()[codes], minlength=5)
    letters = max(int(kinds[3] + kinds[4]), 1)
    ends = int(np.isin(codes, _ENDS).sum())
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    times = np.bincount(ids)
    share = np.bincount(codes[codes < 0x3000]) / size
    share = share[share > 0]
    different = list(numbers)
    uppers = np.fromiter((len(w) > 1 and w.isupper() for w in different), bool, len(different))
    marked = np.fromiter((_SYMBOL.search(w) is not None for w in different), bool, len(different))
    titles = np.fromiter((w.istitle() for w in different), bool, len(different))
    lines = [line for line in text.split("\n") if line.strip()]
    count = len(words)
    pairs = len(np.unique(ids[1:] * len(numbers) + ids[:-1])) / (count - 1) if count > 1 else 1.0
    sentences = max(sum(text.count(c) for c in ".!?"), 1)
    out[:] = (
        np.log1p(size), np.log1p(count), (size - kinds[1]) / count, kinds[4] / letters, kinds[2] / size, (kinds[0] - ends) / size,
        ends / size, kinds[1] / size, float((codes > 127).sum()) / size, float(-(share * np.log2(share)).sum()),
        float((codes[1:] == codes[:-1]).mean()) if size > 1 else 0.0, len(numbers) / count, times.max() / count,
        float((ids[1:] == ids[:-1]).mean()) if count > 1 else 0.0, pairs, times[uppers].sum() / count,
        times[marked].sum() / count, times[titles].sum() / count, np.log1p(len(lines)), len(set(lines)) / len(lines),
        np.log1p(count / len(lines)), np.log1p(count / sentences), sum(line.rstrip()[-1] in ".!?" for line in lines) / len(lines),
    )
    return out


@dataclass
class Model:
    """``cuts[f]`` are the inner limits of the bins of number f; ``tables[f]`` its log odds by bin;
    ``pairs`` holds (f, g, limits of f, limits of g, table)."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of FEATURES."""
        total = np.full(len(x), self.bias)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, f], side="right")]
        for f, g, cuts_f, cuts_g, table in self.pairs:
            total += table[np.searchsorted(cuts_f, x[:, f], side="right"), np.searchsorted(cuts_g, x[:, g], side="right")]
        return _odds(total)


def _odds(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _limits(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner limits of at most ``bins`` bins of about equally many rows; equal values share a bin."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _cut(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, int]:
    """(gain, place) of the best cut of a row of bins into two."""
    if len(grad) < 2:
        return 0.0, 0
    g, h = np.cumsum(grad), np.cumsum(hess)
    left, right = g[:-1] ** 2 / (h[:-1] + ridge), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
    gain = left + right - g[-1] ** 2 / (h[-1] + ridge)
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of the tree that grows, cut by cut, where it gains most."""
    parts = [(0, len(grad), *_cut(grad, hess, ridge))]
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda k: parts[k][2])
        a, b, gain, at = parts[i]
        if gain <= 1e-12:
            break
        parts[i : i + 1] = [(s, e, *_cut(grad[s:e], hess[s:e], ridge)) for s, e in ((a, a + at), (a + at, b))]
    out = np.empty(len(grad))
    for a, b, *_ in parts:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + ridge)
    return out


def _plane(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree on a grid of bins that cuts one way, then each side the other.
    All first cuts are tried with the best second ones: where only both numbers together say
    something, no first cut gains by itself."""
    whole = grad.sum() ** 2 / (hess.sum() + ridge)
    best = (0.0, np.full(grad.shape, grad.sum() / (hess.sum() + ridge)))
    for g, h, turn in ((grad, hess, False), (grad.T, hess.T, True)):
        if min(g.shape) < 2:
            continue
        over_g, over_h = np.cumsum(g, axis=0)[:-1], np.cumsum(h, axis=0)[:-1]
        gain, second = -whole, []
        for a, b in ((over_g, over_h), (g.sum(axis=0) - over_g, h.sum(axis=0) - over_h)):
            left, under = np.cumsum(a, axis=1)[:, :-1], np.cumsum(b, axis=1)[:, :-1]
            right, above = a.sum(axis=1)[:, None] - left, b.sum(axis=1)[:, None] - under
            each = left**2 / (under + ridge) + right**2 / (above + ridge)
            at = each.argmax(axis=1)
            gain = gain + each[np.arange(len(at)), at]
            second.append(at + 1)
        first = int(gain.argmax())
        if gain[first] > best[0]:
            values = np.empty(g.shape)
            for rows, at in zip((slice(0, first + 1), slice(first + 1, None)), (int(s[first]) for s in second)):
                for columns in (slice(0, at), slice(at, None)):
                    values[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + ridge)
            best = (float(gain[first]), values.T if turn else values)
    return best


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, held_back: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS, ridge: float = 1.0) -> Model:
    """Boost on the rows that are not held back; the held-back ones choose the number of rounds."""
    if not len(x) or y.min() == y.max():
        return Model(0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    fit = ~held_back if (~held_back).any() and held_back.any() else np.ones(len(x), bool)
    check = held_back if held_back.any() else fit
    share = np.average(y, weights=weight)
    bias = float(np.log(share / (1 - share)))
    cuts = [_limits(x[fit, f], bins) for f in range(x.shape[1])]
    where = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    total = np.full(len(x), bias)

    def boosted(places: list[np.ndarray], sizes: list[int], tree, most: int) -> list[np.ndarray]:
        """Tables, one for each of ``places``, after the best number of rounds; adds them to ``total``."""
        tables, now = [np.zeros(n) for n in sizes], total.copy()
        best, kept, since = np.inf, [t.copy() for t in tables], 0
        for _ in range(most):
            for i, place in enumerate(places):
                p = _odds(now)
                grad = np.bincount(place[fit], (weight * (y - p))[fit], minlength=sizes[i])
                hess = np.bincount(place[fit], (weight * p * (1 - p))[fit], minlength=sizes[i])
                step = RATE * tree(i, grad, hess)
                tables[i] += step
                now += step[place]
            p = np.clip(_odds(now[check]), 1e-9, 1 - 1e-9)
            loss = -np.average(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p), weights=weight[check])
            since += 1
            if loss < best - 1e-6:
                best, kept, since = loss, [t.copy() for t in tables], 0
            if since >= PATIENCE:
                break
        for table, place in zip(kept, places):
            total[:] += table[place]
        return kept

    tables = boosted(where, [len(c) + 1 for c in cuts], lambda i, g, h: _tree(g, h, 3, ridge), rounds)
    # pairs by what a tree on their grid would gain now
    coarse = [_limits(x[fit, f], PAIR_BINS) for f in range(x.shape[1])]
    rough = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]
    p = _odds(total)
    shape = lambda f, g: (len(coarse[f]) + 1, len(coarse[g]) + 1)
    flat = lambda f, g: rough[f] * shape(f, g)[1] + rough[g]
    gains = []
    for f, g in combinations(range(x.shape[1]), 2):
        n = shape(f, g)[0] * shape(f, g)[1]
        grids = [np.bincount(flat(f, g)[fit], v[fit], minlength=n).reshape(shape(f, g)) for v in (weight * (y - p), weight * p * (1 - p))]
        gains.append((_plane(*grids, ridge)[0], f, g))
    chosen = [(f, g) for gain, f, g in sorted(gains, reverse=True)[:pairs] if gain > 0]
    shapes = [shape(f, g) for f, g in chosen]
    grid = lambda i, a, b: _plane(a.reshape(shapes[i]), b.reshape(shapes[i]), ridge)[1].ravel()
    planes = boosted([flat(f, g) for f, g in chosen], [a * b for a, b in shapes], grid, PAIR_ROUNDS) if chosen else []
    made = [(f, g, coarse[f], coarse[g], table.reshape(s)) for (f, g), s, table in zip(chosen, shapes, planes)]
    return Model(bias, cuts, tables, made)


def fit(docs: DataFrame, key: str, text: str, marks: DataFrame, label: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` different texts of ``docs`` for each class (0, 1), as
    ``marks(key, label)`` labels them, one label per key.

    Rows are weighted so that the classes have the shares they have among all labelled rows, however
    many of each the sample holds. Rows with NULL text, key or label are not used. Without both
    classes every score is 0.5. The driver gets the numbers of the sample, not its texts.
    """
    named = marks.withColumnRenamed(label, "label")
    counts = docs.select(F.col(key)).join(named, key).where("label in (0, 1)").groupBy("label").count().collect()
    total = {r["label"]: r["count"] for r in counts}
    sample = stage(labelled_sample(docs, key, text, named, "label", sample_rows))

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"h": rows["_h"], "y": rows["label"], "x": [features_of(t) for t in rows["text"]]})

    # one row of each text and label, in an order of its own: the model depends on the rows alone
    found = sample.mapInPandas(numbers, "h long, y int, x array<double>").orderBy("h", "y").toPandas()
    unstage(sample)
    if found["y"].nunique() < 2:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0), np.zeros(0, bool))
    x, y = np.array(found["x"].tolist(), float), found["y"].to_numpy(float)
    share = {c: total[c] / sum(total.values()) / (y == c).mean() for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    return train(x, y, weight, ((found["h"].to_numpy() >> 9) % 5) == 0)


def add_score(df: DataFrame, text: str, model: Model, into: str = "quality") -> DataFrame:
    """``df`` with the probability that a text is of label 1.

    NULL, empty and blank texts get the score of a text whose numbers are all 0. Whole texts count.
    Repeated rows get equal scores. A column of that name is replaced. The model is a few tables of
    fixed size and is broadcast.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features_of(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(held.value.score(x), dtype=float)

    return df.withColumn(into, F.pandas_udf(run, "double")(F.col(text)))
