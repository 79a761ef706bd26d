"""Components, fingerprints and near-duplicate lines against brute force."""

import random
from itertools import combinations
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from phenogrid.llm import lines, simhash
from phenogrid.llm.components import components
from phenogrid.plans import staging


def union_find(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    draw = random.Random(3)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)]
    pairs += [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 60)] + [(5, 5), (5, 5)]
    rows = [(int(a), int(b)) for a, b in pairs] + [(None, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a != b]
    assert got == union_find({n for p in real for n in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    words = []
    word = ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \n\t", "One", "one TWO", "a b c", "a b c a b c a b c", "Äpfel Öl x y \x0b z", "w " * 70_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_shingle_hash_is_sparks(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first()
    assert row.h % 2**64 == simhash.fingerprint("One two THREE")


@pytest.mark.parametrize("most", [1, 32])
def test_links_find_exactly_the_close_ones(spark, most):
    draw = random.Random(1)
    values = set()
    for c in range(20):
        base = draw.getrandbits(64)
        for _ in range(50 if c < 3 else 4):
            x = base
            for _ in range(draw.randint(0, 4)):
                x ^= 1 << draw.randrange(64)
            values.add(x)
    base = draw.getrandbits(64)
    values |= {base ^ sum(1 << b for b in draw.sample(range(30), 3)) for _ in range(80)}  # all share a block
    values = sorted(v - 2**64 if v >> 63 else v for v in values)
    close = [p for p in combinations(values, 2) if bin((p[0] ^ p[1]) % 2**64).count("1") <= 2]
    want = {}
    for v, r in union_find(values, close).items():
        want.setdefault(r, set()).add(v)
    found = components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, most))
    got = {}
    for r in found.where("node.kind = 0").collect():
        got.setdefault(r.root, set()).add(r.node.fp)
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in want.values() if len(s) > 1}
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_near_duplicates_odd_rows(spark):
    rows = [(5, "a b c d"), (3, "A b  c d"), (3, "A b  c d"), (9, None), (8, ""), (None, "a b c d"), (7, "x y z q")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, fp string, component int")
    got = sorted(
        ((r[0], r[2]) for r in simhash.near_duplicates(df, "doc_id", "text").collect()), key=lambda r: (r[0] or 0, r[1])
    )
    assert got == [(None, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    assert simhash.near_duplicates(df.where("false"), "doc_id", "text").count() == 0


def line_fixture():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeouäß") for _ in range(draw.randint(2, 8)))
    base = [" ".join(word() for _ in range(draw.randint(4, 30))) for _ in range(40)]
    docs = []
    for i in range(120):
        own = []
        for _ in range(draw.randint(0, 6)):
            line = draw.choice(base)
            for _ in range(draw.randint(0, 2)):
                at = draw.randrange(len(line))
                line = line[:at] + draw.choice("xyz") + line[at + draw.randint(0, 1) :]
            own.append(line.upper() if draw.random() < 0.1 else line)
        docs.append((i, "\n".join([*own, "short", ""])))
    return docs


def test_line_classes(spark):
    docs = line_fixture()
    found = {}
    for k, t in docs:
        for i, raw in enumerate(t.split("\n")):
            line = raw.strip(" ").lower()
            if len(line) >= lines.LEAST_CHARS:
                found[(k, i)] = line
    texts = sorted(set(found.values()))
    sets = [{t[i : i + 7] for i in range(max(1, len(t) - 6))} for t in texts]
    pairs = [
        (i, j) for i, j in combinations(range(len(texts)), 2)
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    ]
    root = union_find(range(len(texts)), pairs)
    number = {t: i for i, t in enumerate(texts)}
    first = {}
    for at, line in sorted(found.items()):
        first.setdefault(root[number[line]], at)
    rows = lines.line_classes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    got = {(r.doc_id, r.place): (r.class_key, r.class_place) for r in rows}
    assert got == {at: first[root[number[line]]] for at, line in found.items()}
    assert len(set(got.values())) < len(texts)


def test_drop_repeats_odd_rows(spark):
    long = "the very same line of text in many places"
    rows = [(2, f"{long}\nown words that no other text has\nx"), (1, f"x\n{long}"), (3, long), (4, None), (5, ""), (3, long)]
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in rows], "doc_id long, text string, k1 int, _gone string")
    got = sorted((r[0], r[1]) for r in lines.drop_repeats(df, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("-"))).collect())
    assert got == [(1, f"x\n{long}"), (2, "own words that no other text has\nx"), (3, ""), (3, ""), (4, "-"), (5, "")]
    assert lines.drop_repeats(df, "doc_id", "text").columns == df.columns
    assert lines.line_classes(df.where("false"), "doc_id", "text").count() == 0


def test_long_lines_that_repeat_themselves(spark):
    draw = random.Random(8)
    phrases = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(9, 40))).strip() + ", " for _ in range(12)]
    docs = [(3 * i + j, phrase * times + "x") for i, phrase in enumerate(phrases) for j, times in enumerate((300, 120, 45))]
    rows = lines.line_classes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.doc_id: r.class_key for r in rows} == {k: k - k % 3 for k, _ in docs}


def test_clusters_in_large_bands(spark):
    draw = random.Random(9)
    letters = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template = letters(406)
    fillings = [letters(58) for _ in range(400)]
    # two fillings share 400 of 516 shingles, two lines of one filling 457 of 459
    docs = [(2 * i + j, template + f[:-1] + end) for i, f in enumerate(fillings) for j, end in enumerate("01")]
    rows = lines.line_classes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.doc_id: r.class_key for r in rows} == {k: k - k % 2 for k, _ in docs}


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_near_copies_meet_where_they_differ(spark, similarity):
    """Links between components of a block are found from a few of the pairs of its lines."""
    draw = random.Random(12)
    source = list(range(200))
    sets = {}
    for k in range(160):
        changed = draw.sample(source, draw.randint(0, 45))
        sets[k] = sorted(set(source) - set(changed) | {1000 * (k + 1) + i if draw.random() < 0.8 else 500 + i for i in changed})
    # components as they may stand before: some similar lines linked already
    alike = lambda a, b: len(set(a) & set(b)) >= similarity * len(set(a) | set(b))
    links = {(x, y) for x in sets for y in sets if x < y and alike(sets[x], sets[y])}
    root = {k: k for k in sets}
    for x, y in sorted(draw.sample(sorted(links), len(links) // 40)):
        low, high = sorted((root[x], root[y]))
        root = {k: low if r == high else r for k, r in root.items()}
    rows = [(k, root[k], draw.randint(1, 12), root[0], sets[k], len(sets[k])) for k in sets]
    frame = spark.createDataFrame(rows, "k1 long, root long, bands long, block long, set array<long>, n int")
    met = {tuple(r) for r in lines._differing_pairs(frame, similarity).collect()}
    assert all(x < y and root[x] != root[y] for x, y in met)

    def joined(pairs):
        of = dict(root)
        for x, y in pairs:
            low, high = sorted((of[x], of[y]))
            of = {k: low if r == high else r for k, r in of.items()}
        return of

    assert joined(p for p in met if p in links) == joined(links)
    if similarity == 0.8:  # at 0.6 most of the pairs are links
        assert len(met) < sum(root[x] != root[y] for x in sets for y in sets if x < y) / 2


def test_line_dedup_leaves_two_tables(spark):
    docs = spark.createDataFrame(line_fixture(), "doc_id long, text string")
    staging.stage(spark.range(1))
    folder = Path(staging.scratch_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    found = lines.line_classes(docs, "doc_id", "text")
    assert len(set(folder.iterdir()) - before) == 2 and found.count()  # places and classes, which the result reads
    lines.drop_repeats(docs, "doc_id", "text")
    assert len(set(folder.iterdir()) - before) == 3
