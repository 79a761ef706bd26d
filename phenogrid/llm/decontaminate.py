"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items go into one automaton (items separated by starting again at the root). Each
document's words are streamed through it; the longest suffix of what was read that occurs in an
item gives its length at every word. A length of ``window`` or more marks the last ``window`` words
as hit; items shorter than a window are one window of their own length.

The automaton holds at most two states per item word. Items are therefore split into parts of at
most ``part_words`` words, one automaton each; tasks hold one automaton at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_WORDS = 1_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case; words are runs of digits, letters a-z and characters beyond ASCII."""
    return [] if text is None else text.encode().translate(_TABLE).split()


def word_places(text: str) -> list[tuple[int, int]]:
    """(start, stop) of every word of :func:`words_of`, in characters."""
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [m.span() for m in _WORD.finditer(small)]


class Automaton:
    """Generalised suffix automaton over word numbers, with the items that own each window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = []
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if ids:
                numbered.append((item, ids))
                self._insert(ids)
        # window ends: for full windows the state whose substrings include the last `window` words
        self.owners: dict[int, set[str]] = {}
        self.short: dict[tuple[int, int], set[str]] = {}
        for item, ids in numbered:
            state = 0
            if len(ids) < window:
                for w in ids:
                    state = self.next[state][w]
                self.short.setdefault((state, len(ids)), set()).add(item)
                continue
            for i, w in enumerate(ids):
                state = self._up(self.next[state][w], window)
                if i + 1 >= window:
                    self.owners.setdefault(state, set()).add(item)
        self.short_lengths = sorted({n for _, n in self.short})
        # a stretch shorter than this cannot hold any window
        self.least = min([window, *self.short_lengths]) if numbered else 0
        pairs = {a * len(self.vocab) + b for _, ids in numbered for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _insert(self, ids: list[int]) -> None:
        last = 0
        for w in ids:
            last = self._extend(last, w)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, parent: int, child: int, w: int) -> int:
        """State for the strings of ``child`` that end right after those of ``parent``."""
        if self.length[child] == self.length[parent] + 1:
            return child
        twin = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = twin
        while parent >= 0 and self.next[parent].get(w) == child:
            self.next[parent][w] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # an earlier item has this string already
            return self._split(last, self.next[last][w], w)
        made = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = made
            at = self.link[at]
        if at >= 0:
            self.link[made] = self._split(at, self.next[at][w], w)
        return made

    def _up(self, state: int, most: int) -> int:
        """Shortest suffix state that still holds suffixes of ``most`` items."""
        while self.length[self.link[state]] >= most and self.link[state] > 0:
            state = self.link[state]
        return state

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs in which every word, and every two words in a row, occur in some item; all
        matches of two or more words lie inside one."""
        if not self.least or not len(ids):
            return
        known = ids >= 0
        joined = np.zeros(len(ids), bool)  # joined[i]: words i - 1 and i occur in a row
        if len(self.pairs) and len(ids) > 1:
            both = known[1:] & known[:-1]
            at = np.flatnonzero(both)
            keys = ids[at] * len(self.vocab) + ids[at + 1]
            spot = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[at[self.pairs[spot] == keys] + 1] = True
        first = np.flatnonzero(known & ~joined)
        follows = np.append(joined[1:], False)
        last = np.flatnonzero(known & ~follows)
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a + 1 >= self.least:
                yield a, b + 1

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str], np.ndarray]:
        """Which words are hit, the items with a window in the document, and which words are hit by
        an item shorter than a window, whole."""
        hit, short = np.zeros((2, len(words) + 1), np.int32)  # +1 where a hit range starts, -1 after it
        items: set[str] = set()
        ids = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int64, len(words))
        step, link, length, window = self.next, self.link, self.length, self.window
        for a, b in self.stretches(ids):
            state = size = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while state and w not in step[state]:
                    state = link[state]
                    size = length[state]
                if w in step[state]:
                    state = step[state][w]
                    size += 1
                else:
                    state = size = 0
                    continue
                if size >= window:
                    hit[i + 1 - window] += 1
                    hit[i + 1] -= 1
                    items |= self.owners.get(self._up(state, window), set())
                for n in self.short_lengths:
                    if n > size:
                        break
                    found = self.short.get((self._up(state, n), n))
                    if found:
                        for marks in (hit, short):
                            marks[i + 1 - n] += 1
                            marks[i + 1] -= 1
                        items |= found
        return np.cumsum(hit[:-1]) > 0, items, np.cumsum(short[:-1]) > 0


def automata(told: DataFrame, window: int, part_words: int = PART_WORDS) -> list:
    """Broadcast automata of all items of ``told(item, text)``, each of at most ``part_words`` words (or of one longer item).

    Parts are made one after the other: the driver holds the items of one part. The number of
    words is summed in Spark first.
    """
    spark = told.sparkSession
    told = told.where("text is not null")
    size = told.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    parts = size // part_words + 1
    made = []
    for part in range(parts):
        mine = told.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) if parts > 1 else told
        rows = ((r["item"], words_of(r["text"])) for r in mine.toLocalIterator())
        made.append(spark.sparkContext.broadcast(Automaton(rows, window)))
    return made


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def mark(
    docs: DataFrame,
    text: str,
    benchmark: DataFrame,
    item: str,
    item_text: str,
    window: int = 10,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """``docs`` with a column ``hits``: ``n_words``, ``n_hit``, ``items`` (item ids as strings, sorted)
    and ``spans``, the (start, stop) in characters and number of words of every run
    of hit words, and whether it holds a ``whole`` item of fewer words than a window.

    NULL, empty and word-less texts have no words and no hits; items without words have no windows;
    a NULL item id is the string ``null``; items of equal text all count; an empty benchmark hits
    nothing; repeated rows are marked alike. A column already called ``hits`` is replaced.
    """
    named = F.coalesce(benchmark[item].cast("string"), F.lit("null"))
    told = benchmark.select(named.alias("item"), benchmark[item_text].alias("text"))
    held = automata(told, window, part_words)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            split = [words_of(t) for t in texts]
            hits = [np.zeros(len(w), bool) for w in split]
            items: list[set[str]] = [set() for _ in split]
            whole = [np.zeros(len(w), bool) for w in split]
            for part in held:
                automaton = part.value
                for i, words in enumerate(split):
                    found, owners, short = automaton.scan(words)
                    hits[i] |= found
                    whole[i] |= short
                    items[i] |= owners
                if len(held) > 1:
                    part.__dict__.pop("_value", None)  # the next part takes its place in memory
            spans = []
            for t, h, w in zip(texts, hits, whole):
                places = word_places(t) if h.any() else []
                made = [{"start": places[a][0], "stop": places[b - 1][1], "n": b - a, "whole": bool(w[a:b].any())} for a, b in _runs(h)]
                spans.append(made)
            yield pd.DataFrame(
                {
                    "n_words": [len(w) for w in split],
                    "n_hit": [int(h.sum()) for h in hits],
                    "items": [sorted(s) for s in items],
                    "spans": spans,
                }
            )

    schema = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long,n:long,whole:boolean>>"
    return docs.withColumn("hits", F.pandas_udf(run, schema)(F.col(text)))


def remove(marked: DataFrame, text: str, longest: int = 9, coverage: float = 0.5) -> DataFrame:
    """Act on :func:`mark`. Where more than ``coverage`` of the words is hit, the text goes as a whole
    (NULL). From the others every span of more than ``longest`` words is cut, and every span that
    holds a whole item shorter than a window. Other spans are at least one window long, so
    a larger ``longest`` spares the shorter of them. Texts without hits stay as they are."""
    spans = F.filter("hits.spans", lambda s: (s["n"] > longest) | s["whole"])
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substring(F.col(text), a.cast("int") + 1, (b - a).cast("int")))
    much = F.col("hits.n_hit") > coverage * F.col("hits.n_words")
    cut = F.when(F.size(spans) == 0, F.col(text)).otherwise(F.array_join(pieces, ""))
    return marked.withColumn(text, F.when(much, F.lit(None).cast("string")).otherwise(cut))
