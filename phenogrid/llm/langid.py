"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its character 1- to 4-grams within words (word ends
included), hashed into a fixed number of buckets. Embeddings and softmax are trained together by
stochastic gradient descent in numpy, on a bounded sample. A held-back part of that sample sets the
temperature of the probabilities and the confidence below which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import hash_sample

BUCKETS = 1 << 16
ORDERS = 4
SAMPLE_ROWS = 4000
UNKNOWN = "und"
_CHUNK = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; everything but letters is 0, never twice in a row."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, 0)
    codes = np.concatenate(([0], codes, [0])).astype(np.uint32)
    return codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]


def subwords(text: str | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords, in pieces of bounded size. Nothing for a text without letters."""
    if not text:
        return
    codes = _codes(text)
    if not codes.any():
        return
    for at in range(0, len(codes), _CHUNK):
        piece = codes[at : at + _CHUNK + ORDERS - 1].astype(np.uint64)
        count = min(_CHUNK, len(codes) - at)
        end = piece == 0
        mixed = np.full(len(piece), 1, np.uint64)
        inside = np.zeros(len(piece), bool)  # a word end strictly within the gram
        out = []
        for n in range(ORDERS):
            size = len(piece) - n
            if size <= 0:
                break
            mixed = (mixed[:size] ^ piece[n:]) * _MIX
            mixed ^= mixed >> np.uint64(29)
            if n >= 2:
                inside = inside[:size] | end[n - 1 : n - 1 + size]
            keep = ~inside[:size] if n >= 2 else (~end[:size] if n == 0 else np.ones(size, bool))
            keep = keep[:count]
            out.append((mixed[:count][keep] >> np.uint64(13)) % np.uint64(buckets))
        yield np.concatenate(out).astype(np.int32)


def sparse_counts(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of a text and how often each occurs."""
    total = np.zeros(buckets, np.int64)
    for piece in subwords(text, buckets):
        total += np.bincount(piece, minlength=buckets)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # buckets x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float
    familiar: np.ndarray  # buckets seen in training

    def logits(self, text: str | None) -> tuple[np.ndarray, int]:
        total, n = np.zeros(len(self.langs)), 0
        for piece in subwords(text, len(self.weight)):
            total += self.weight[piece].sum(axis=0, dtype=np.float64)
            n += len(piece)
        return (total / n + self.bias if n else total), n

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        logits, n = self.logits(text)
        if not n or not self.langs:
            return UNKNOWN, 0.0, True
        p = _softmax(logits[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.reject_below)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], held_back: np.ndarray, buckets: int = BUCKETS, dim: int = 16,
          epochs: int = 12, rate: float = 0.5, reject_rate: float = 0.001, seed: int = 7) -> Model:
    """Fit on ``rows`` of (bucket numbers, counts, language). Rows marked in ``held_back`` only
    calibrate: the temperature minimises their log loss, and at most ``reject_rate`` of them fall
    below the rejection limit, which never exceeds one half."""
    langs = sorted({r[2] for r in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    label = np.array([place[r[2]] for r in rows], np.int64)
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    soft, bias = draw.normal(0, 0.1, (dim, len(langs))), np.zeros(len(langs))
    share = [(b, (c / c.sum()).astype(np.float32)) for b, c, _ in rows]
    fit = np.flatnonzero(~held_back) if (~held_back).any() else np.arange(len(rows))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in draw.permutation(fit):
            b, s = share[i]
            mean = s @ embed[b]
            grad = _softmax((mean @ soft + bias)[None, :])[0]
            grad[label[i]] -= 1
            back = soft @ grad
            soft -= step * np.outer(mean, grad)
            bias -= step * grad
            embed[b] -= (step * 20 * s[:, None] * back[None, :]).astype(np.float32)
    weight = (embed @ soft).astype(np.float32)
    seen = np.zeros(buckets, bool)
    for i in fit:
        seen[share[i][0]] = True
    check = np.flatnonzero(held_back) if held_back.any() else fit
    if not len(check):
        return Model(langs, weight, bias, 1.0, 0.0, seen)
    logits = np.array([share[i][1] @ weight[share[i][0]] + bias for i in check])
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(check)), label[check]] + 1e-12).mean()
    temperature = min(np.geomspace(0.1, 10, 41), key=loss)
    best = np.sort(_softmax(logits / temperature).max(axis=1))
    limit = min(0.5, float(best[int(reject_rate * len(best))]))
    return Model(langs, weight, bias, float(temperature), limit, seen)


def fit(labelled: DataFrame, text: str, lang: str, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> Model:
    """Train on at most ``sample_rows`` rows of different texts with a language and a letter.

    Tasks turn texts into bucket counts, so the driver gets at most ``sample_rows`` sparse rows of
    ``buckets`` numbers. No usable rows give a model that rejects everything.
    """
    usable = labelled.select(labelled[text].alias("text"), labelled[lang].alias("lang")).where("lang is not null")
    sample = hash_sample(usable, "text", sample_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [sparse_counts(t, buckets) for t in rows["text"]]
            b, c = ([m[i] for m in made] for i in (0, 1))
            yield pd.DataFrame({"h": rows["_h"], "lang": rows["lang"].astype(object), "b": b, "c": c})

    made = sample.mapInPandas(run, "h long, lang string, b array<int>, c array<long>")
    # of a text with several languages the most frequent one counts, the first of equals
    votes = made.where(F.size("b") > 0).groupBy("h", "lang").agg(F.count("*").alias("n"), F.first("b").alias("b"), F.first("c").alias("c"))
    best = votes.groupBy("h").agg(F.min(F.struct(-F.col("n"), "lang", "b", "c")).alias("best"))
    rows = best.select("h", "best.lang", "best.b", "best.c").orderBy("h").toLocalIterator()
    kept = [(r["h"], np.array(r["b"]), np.array(r["c"]), r["lang"]) for r in rows]
    held_back = np.array([(h >> 7) % 5 == 0 for h, *_ in kept], bool)
    return train([r[1:] for r in kept], held_back, buckets)


def identify(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``df`` with ``language`` (struct ``lang, score, rejected``).

    NULL, empty and letterless texts are ``und`` with score 0 and rejected. Whole texts count,
    however long. Repeated rows get equal answers. A column already called ``language`` is replaced.
    The model has a fixed size (buckets times languages) and is broadcast.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [held.value.predict(t) for t in texts]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            lang = pd.Series(lang, dtype=object)
            yield pd.DataFrame({"lang": lang, "score": np.array(score, float), "rejected": np.array(rejected, bool)})

    return df.withColumn("language", F.pandas_udf(run, "lang string, score double, rejected boolean")(F.col(text)))
