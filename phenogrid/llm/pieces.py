"""SentencePiece encoding and decoding with n-best segmentations.

A text is normalised as the vocabulary asks (a space in front, spaces as U+2581) and every way of
cutting it into pieces is a path through a lattice. Piece scores add up along a path. A forward
Viterbi pass gives the best score from the start to every place; those scores are the exact cost
to go for an A* search from the end back to the start, which therefore brings out complete
segmentations best first.

No piece holds the space sign after another character, so a text falls apart before every run of
space signs. Each part has a lattice of its own. Short parts are searched many at a time in numpy.
The best segmentation, and how much worse the second best is, are kept for the next time the part occurs;
the search goes on to the n best in those parts that can differ among the n best of the text. These are
searched best first over the choices of its parts.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, count, islice, repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_PART = re.compile(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_CACHE_BYTES = 48 << 20  # of segmentations that a worker keeps for the next time a part occurs
_TOGETHER = 60_000  # parts searched together
_SHORT, _BLOCK = 32, 16_384  # characters of a part that is searched in numpy, and how many such parts at a time
_loaded: dict[str, Pieces] = {}  # of this worker, by the vocabulary's place


class _Ends:
    """The ends of pieces as a tree, read from the last character to the first: node 0 is the empty end. Steps
    lie in a table of open addressing, by node and character."""

    def __init__(self, ends: dict[str, tuple], miss: float):
        node = {end: i for i, end in enumerate(filter(None, ends), 1)}
        chars = sorted({end[0] for end in node})
        kind = {c: i for i, c in enumerate(chars, 1)}
        self.kinds = np.zeros(ord(chars[-1]) + 2 if chars else 1, np.int64)  # of characters; 0: in no piece
        self.kinds[[ord(c) for c in chars]] = range(1, len(chars) + 1)
        self.width = len(chars) + 1
        pieces = [ends[end] for end in node]
        # one node more stands for a character without a piece
        self.score = np.array([-math.inf, *[p[0] if p else -math.inf for p in pieces], miss])
        self.id = np.array([-1, *[p[1][0] if p else -1 for p in pieces], -1], np.int32)
        self.missed = len(pieces) + 1
        self.alone = np.zeros(self.width, bool)  # kinds of characters that are pieces
        self.alone[[kind[end] for end, p in zip(node, pieces) if p and len(end) == 1]] = True
        self.first = np.zeros(self.width, np.int64)  # the node of a last character
        self.first[[kind[end] for end in node if len(end) == 1]] = [i for end, i in node.items() if len(end) == 1]
        longer = {node[end[1:]] * self.width + kind[end[0]]: i for end, i in node.items() if len(end) > 1}
        self.bits = max(4, (4 * len(longer)).bit_length())
        keys, nodes = [-1] * (1 << self.bits), [0] * (1 << self.bits)
        for slot, (key, i) in zip(self._slots(np.fromiter(longer, np.int64, len(longer))).tolist(), longer.items()):
            while keys[slot] >= 0:
                slot = (slot + 1) % len(keys)
            keys[slot], nodes[slot] = key, i
        self.keys, self.nodes = np.array(keys), np.array(nodes)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def kinds_of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.kinds[np.minimum(codes, len(self.kinds) - 1)]

    def step(self, nodes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The ends longer by a character in front, 0 where there is none."""
        keys = nodes * self.width + kinds
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.nodes[slots], 0)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) % len(self.keys)
            there = self.keys[slots[left]]
            found = there == keys[left]
            out[left[found]] = self.nodes[slots[left[found]]]
            left = left[~found & (there >= 0)]
        return out


class Pieces:
    """Vocabulary and lattice search. ``table`` holds (piece, score, kind) by id, kind one of
    ``normal, byte, control, unknown``."""

    def __init__(self, table: list[tuple[str, float, str]]):
        self.table = table
        self.ids = {p: (i, s) for i, (p, s, kind) in enumerate(table) if kind == "normal"}
        # ends of pieces; those that are pieces have a score and ids
        self.ends: dict[str, tuple] = {p[i:]: () for p in self.ids for i in range(len(p))}
        self.ends.update((p, (score, (i,))) for p, (i, score) in self.ids.items())
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(table) if kind == "byte"}
        self.unknown = next((i for i, t in enumerate(table) if t[2] == "unknown"), 0)
        # characters without a piece are worse than any piece
        self.miss = min((s for _, s in self.ids.values()), default=0.0) - 10.0
        whole = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.cut = (lambda t: [t] if t else []) if whole else _PART.findall
        self._forget()
        # what an id stands for; bytes that are no character by themselves stand as lone surrogates
        says = {"control": "", "unknown": " ⁇ "}
        self.says = [says.get(kind, p) if kind != "byte" else bytes([int(p[3:5], 16)]).decode("ascii", "surrogateescape") for p, _, kind in table]

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Read the vocabulary of a model file; ``path`` must exist wherever this runs."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: (
            "byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i) or m.is_unused(i) else "normal"
        )
        return cls([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])

    @staticmethod
    def normalise(text: str) -> str:
        return (SPACE + text.replace(" ", SPACE)) if text else ""

    def _spell(self, char: str) -> tuple[int, ...]:
        """Ids of a character without a piece: its bytes, or the unknown id."""
        raw = char.encode("utf-8", "replace")
        return tuple(self.bytes[b] for b in raw) if all(b in self.bytes for b in raw) else (self.unknown,)

    def lattice(self, part: str) -> list[list[tuple]]:
        """Forward pass: for every place the edges into it as (best score from the start through the
        edge, start, score, ids), best first."""
        get, into = self.ends.get, [[(0.0, 0, 0.0, ())]]
        for b in range(1, len(part) + 1):
            a = b - 1
            found = get(part[a])
            edges = [] if found else [(into[a][0][0] + self.miss, a, self.miss, self._spell(part[a]))]
            while found is not None:  # else no piece ends like this
                if found:
                    edges.append((into[a][0][0] + found[0], a, *found))
                if not a:
                    break
                a -= 1
                found = get(part[a:b])
            edges.sort(reverse=True)
            into.append(edges)
        return into

    def firsts(self, parts: Iterable[str]) -> Iterator[tuple[str, tuple[float, float, tuple[int, ...]]]]:
        """For every part how much worse the second best segmentation is than the best (infinite if there is
        none), and the best as score and ids: the search as far as its first result.

        The forward pass keeps the best edge into a place and the value of the second best. Places
        of a beginning that a part shares with the one before are taken over, so parts come sorted.
        """
        get, miss, none = self.ends.get, self.miss, -math.inf
        before, best, second, edge = "", [0.0], [none], [(0, 0.0, ())]
        for part in parts:
            same = 0
            for x, y in zip(before, part):
                if x != y:
                    break
                same += 1
            same += 1
            del best[same:], second[same:], edge[same:]
            for b in range(same, len(part) + 1):
                a = b - 1
                found = get(part[a])
                high = low = none
                if not found:
                    at, score, ids = a, miss, self._spell(part[a])
                    high = best[a] + miss
                while found is not None:
                    if found:
                        through = best[a] + found[0]
                        if through > high:
                            high, low, at = through, high, a
                            score, ids = found
                        elif through > low:
                            low = through
                    if not a:
                        break
                    a -= 1
                    found = get(part[a:b])
                best.append(high)
                second.append(low)
                edge.append((at, score, ids))
            before = part
            at, gone, near, path = len(part), 0.0, none, []
            while at:
                if second[at] + gone > near:
                    near = second[at] + gone
                at, score, ids = edge[at]
                gone += score
                path.append(ids)
            path.reverse()
            yield part, (best[-1] - near, best[-1], tuple(chain.from_iterable(path)))

    @cached_property
    def tree(self) -> _Ends:
        return _Ends(self.ends, self.miss)

    def firsts_together(self, parts: Iterable[str]) -> Iterator[tuple[list[str], tuple[np.ndarray, ...]]]:
        """``firsts`` of parts in any order, some parts at a time: how much worse the second is, scores, numbers of
        ids, ids. Short ones are searched in numpy, place by place over many parts, the others one by one."""
        long: list[str] = []
        short = sorted((p for p in parts if len(p) <= _SHORT or long.append(p)), key=len, reverse=True)
        for i in range(0, len(short), _BLOCK):
            block = short[i : i + _BLOCK]
            yield block, self._block(block)
        for part, (loss, score, ids) in self.firsts(sorted(long)):
            yield [part], (np.array([loss]), np.array([score]), np.array([len(ids)]), np.array(ids, np.int32))

    def _block(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """``firsts`` of parts, longest first."""
        tree, n, longest = self.tree, len(parts), len(parts[0])
        kinds, every = tree.kinds_of("".join(parts)), np.arange(n)
        sizes = np.fromiter(map(len, parts), np.int64, n)
        begins = np.cumsum(sizes) - sizes
        best, second = np.zeros((longest + 1, n)), np.full((longest + 1, n), -math.inf)
        start, via = np.zeros((longest + 1, n), np.int16), np.zeros((longest + 1, n), np.int32)
        for b in range(1, longest + 1):
            at = every[: np.searchsorted(-sizes, -b, "right")]  # parts that are so long
            last = kinds[begins[at] + b - 1]
            nodes = tree.first[last]
            # a character without a piece, or one that is a piece
            via[b, at] = np.where(tree.alone[last], nodes, tree.missed)
            best[b, at] = best[b - 1, at] + tree.score[via[b, at]]
            start[b, at] = b - 1
            for a in range(b - 2, -1, -1):
                some = np.flatnonzero(nodes)
                at, nodes = at[some], nodes[some]
                if not len(at):
                    break
                nodes = tree.step(nodes, kinds[begins[at] + a])
                through, high = best[a, at] + tree.score[nodes], best[b, at]
                second[b, at] = np.maximum(second[b, at], np.minimum(high, through))
                better = np.flatnonzero(through > high)
                won = at[better]
                best[b, won], start[b, won], via[b, won] = through[better], a, nodes[better]
        ids, gone, near = np.full((longest, n), -1, np.int32), np.zeros(n), np.full(n, -math.inf)
        at, part, total = sizes, every, best[sizes, every]
        for k in range(longest - 1, -1, -1):
            near[part] = np.maximum(near[part], second[at, part] + gone[part])
            through = via[at, part]
            gone[part] += tree.score[through]
            # for a miss its place: -2, -3, ... for the first, second, ... character
            ids[k, part] = np.where(through == tree.missed, -1 - at, tree.id[through])
            at = start[at, part]
            part, at = part[at > 0], at[at > 0]
            if not len(part):
                break
        ids = ids.T
        owner, step = np.nonzero(ids != -1)
        ids, times = ids[owner, step], np.ones(len(owner), np.int64)
        missed = np.flatnonzero(ids < 0)
        spelled = [self._spell(parts[i][-2 - x]) for i, x in zip(owner[missed].tolist(), ids[missed].tolist())]
        times[missed] = np.fromiter(map(len, spelled), np.int64, len(spelled))
        at = np.repeat(ids < 0, times)
        ids = np.repeat(ids, times)
        ids[at] = list(chain.from_iterable(spelled))
        return total - near, total, np.bincount(owner, times, n).astype(np.int64), ids

    def search(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a part as (score, ids), best first.

        A state of the search is a place and what lies behind it; its value is exact, so following
        the best edge keeps it, and the next best edge of every place on the way waits. Every state
        that waits ends in a segmentation of its own, so no more wait than are still wanted.
        Equal values come out in a fixed order.
        """
        into = self.lattice(part)
        waiting: list[tuple] = [(-into[-1][0][0], 0, len(part), 0, 0.0, None)]
        turn, out = 0, []
        while waiting and len(out) < n:
            value, _, at, k, gone, tail = waiting.pop(0)
            wanted = n - len(out) - 1
            while at:
                edges = into[at]
                if wanted and k + 1 < len(edges):
                    turn += 1
                    waiting.append((-(edges[k + 1][0] + gone), turn, at, k + 1, gone, tail))
                _, at, score, ids = edges[k]
                k, gone, tail = 0, gone + score, (ids, tail)
            waiting.sort(key=itemgetter(0, 1))
            del waiting[wanted:]
            found: list[int] = []
            while tail:
                found.extend(tail[0])
                tail = tail[1]
            out.append((-value, tuple(found)))
        return out

    def _rows(self, group: list[list[str]]) -> list[np.ndarray]:
        """The rows of the parts of some texts in the table, which gets the ``firsts`` of new parts."""
        # after an error numbers may lack their rows
        if self.held > _CACHE_BYTES or len(self.number) != len(self.columns[0]):
            self._forget()
        before = len(self.number)
        rows = [np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts)) for parts in group]
        new = list(islice(self.number, before, None))
        losses, scores, begins, sizes = (np.zeros(len(new), column.dtype) for column in self.columns)
        every, end = [self.every_id], len(self.every_id)
        for some, (loss, score, size, ids) in self.firsts_together(new):
            at = np.fromiter(map(self.number.__getitem__, some), np.int64, len(some)) - before
            losses[at], scores[at], begins[at], sizes[at] = loss, score, end + np.cumsum(size) - size, size
            every.append(ids)
            end += len(ids)
        if new:
            self.every_id = np.concatenate(every)
            self.columns = tuple(np.concatenate(x) for x in zip(self.columns, (losses, scores, begins, sizes)))
            # sizes of Python objects: what stands around a part and its row
            self.chars += sum(map(len, new))
            self.held = 240 * len(self.number) + 4 * (self.chars + len(self.every_id))
        return rows

    def _forget(self) -> None:
        """Empty the table: rows of parts, the columns how much worse the second segmentation is, score, place of
        the first id and number of ids, and the ids."""
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.columns = (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.every_id = np.zeros(0, np.int32)
        self.chars, self.held = 0, 0  # characters of the parts; bytes of all, about

    def _joined(self, parts: list[str], rows: np.ndarray, deep: dict[str, list], n: int) -> list[tuple[float, array]]:
        """The ``n`` best segmentations of a text from those of its parts, which the table holds."""
        losses, scores, begins, sizes = (column[rows] for column in self.columns)
        ends = np.cumsum(sizes)
        best = array("i")
        best.frombytes(self.every_id[np.repeat(begins - ends + sizes, sizes) + np.arange(sizes.sum())].tobytes())
        total = math.fsum(scores.tolist())
        # only the n - 1 parts with the smallest losses can differ in the n best
        at = np.argsort(losses, kind="stable")[: n - 1]
        at = sorted(at[losses[at] < math.inf].tolist())
        starts, sizes = (ends - sizes)[at].tolist(), sizes[at].tolist()
        for i in at:
            if parts[i] not in deep:
                deep[parts[i]] = self.search(parts[i], n)
        choices = {i: deep[parts[i]] for i in at}
        worse = {i: [c[0][0] - s for s, _ in c] for i, c in choices.items()}
        heap, seen, out = [(0.0, (0,) * len(at))], {(0,) * len(at)}, []
        while heap and len(out) < n:
            loss, pick = heapq.heappop(heap)
            ids, done = array("i"), 0
            for i, k, begin, size in zip(at, pick, starts, sizes):
                if k:
                    ids += best[done:begin]
                    ids.extend(choices[i][k][1])
                    done = begin + size
            ids += best[done:]
            out.append((total - loss, ids))
            for j, i in enumerate(at):
                more = (*pick[:j], pick[j] + 1, *pick[j + 1 :])
                if more[j] < len(choices[i]) and more not in seen:
                    seen.add(more)
                    heapq.heappush(heap, (sum(worse[x][k] for x, k in zip(at, more)), more))
        return out

    def encode_all(self, texts: Iterable[str | None], n: int) -> Iterator[list[tuple[float, array]]]:
        """``encode`` of every text, with ids as arrays. The parts of some texts are searched together, a
        few tens of thousands at a time (or those of one longer text)."""
        group: list[list[str]] = []
        size = 0
        for last, text in chain(zip(repeat(False), texts), [(True, None)]):
            if not last:
                group.append(self.cut(self.normalise(text or "")))
                size += len(group[-1])
            if last or size > _TOGETHER:
                deep: dict[str, list] = {}
                for parts, rows in zip(group, self._rows(group)):
                    yield self._joined(parts, rows, deep, n)
                if self.held > _CACHE_BYTES:
                    self._forget()
                group, size = [], 0

    def scores(self, text: str | None, n: int) -> tuple[list[float], list[int]]:
        """Scores of the ``n`` best segmentations of a text, or of all if there are fewer, and the ids of the best."""
        found = self.encode(text, n)
        return [s for s, _ in found], found[0][1]

    def encode(self, text: str | None, n: int = 1) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a text as (score, ids), or all if there are fewer."""
        return [(score, ids.tolist()) for score, ids in next(self.encode_all([text], n))]

    def decode(self, ids: Iterable[int]) -> str:
        text = "".join(map(self.says.__getitem__, ids))
        # bytes in a row become characters together
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def add_encoding(
    df: DataFrame, text: str, model: str, n: int = 4, into: str = "encoding", ranked: str | None = None
) -> DataFrame:
    """``df`` with ``encoding``: ``ids`` of the best segmentation, ``score``, ``nbest`` (scores of the
    ``n`` best, best first; fewer if there are fewer) and ``exact``, whether decoding the ids gives
    the text back. ``ranked`` names a column for the ``n`` best segmentations themselves, an array of
    (score, ids), best first.

    Texts that hold the space sign U+2581 decode with spaces in its place, so ``exact`` is false
    for them. NULL and empty texts have no ids and score 0; repeated rows are encoded alike. Columns
    of those names are replaced. The vocabulary is read once from ``model`` on the driver and
    broadcast; its size does not depend on the data.
    """
    held = df.sparkSession.sparkContext.broadcast(Pieces.load(model).table)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if model not in _loaded:  # a worker keeps its cache from task to task
            _loaded[model] = Pieces(held.value)
        pieces = _loaded[model]
        for texts in batches:
            # numbers of all rows one behind the other, and where each list ends
            first, first_ends, every, every_ends = array("i"), [0], array("i"), [0]
            scores, score_ends, exact = array("d"), [0], []
            told = texts.to_pylist()
            for t, found in zip(told, pieces.encode_all(told, n)):
                for rank, (score, ids) in enumerate(found):
                    scores.append(score)
                    if rank == 0:
                        first.extend(ids)
                        exact.append(pieces.decode(ids) == (t or ""))
                    if ranked:
                        every.extend(ids)
                        every_ends.append(len(every))
                first_ends.append(len(first))
                score_ends.append(len(scores))
            ends = pa.array(score_ends, pa.int32())
            numbers = pa.array(np.frombuffer(scores)) if scores else pa.array([], pa.float64())
            ints = lambda x: pa.array(np.frombuffer(x, np.int32)) if len(x) else pa.array([], pa.int32())
            best = numbers.take(ends.slice(0, len(exact)))
            columns = {"ids": pa.ListArray.from_arrays(pa.array(first_ends, pa.int32()), ints(first)), "score": best}
            columns |= {"nbest": pa.ListArray.from_arrays(ends, numbers), "exact": pa.array(exact, pa.bool_())}
            if ranked:
                lists = pa.ListArray.from_arrays(pa.array(every_ends, pa.int32()), ints(every))
                pairs = pa.StructArray.from_arrays([numbers, lists], ["score", "ids"])
                columns["ranked"] = pa.ListArray.from_arrays(ends, pairs)
            yield pa.StructArray.from_arrays(list(columns.values()), list(columns))

    schema = "ids array<int>, score double, nbest array<double>, exact boolean"
    if ranked:
        schema += ", ranked array<struct<score: double, ids: array<int>>>"
    made = df.withColumn(into, F.arrow_udf(run, schema)(F.col(text)))
    if ranked:
        made = made.withColumn(ranked, F.col(f"{into}.ranked"))
    return made.withColumn(into, F.struct(*[F.col(f"{into}.{c}") for c in ("ids", "score", "nbest", "exact")]))


def decode(df: DataFrame, ids: str, model: str, into: str = "text") -> DataFrame:
    """``df`` with the text of an array of ids; NULL stays NULL."""
    held = df.sparkSession.sparkContext.broadcast(Pieces.load(model).table)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(held.value)
        for rows in batches:
            yield pd.Series([None if r is None else pieces.decode(list(r)) for r in rows], dtype=object)

    return df.withColumn(into, F.pandas_udf(run, "string")(F.col(ids)))
