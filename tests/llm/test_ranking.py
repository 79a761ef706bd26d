"""Collocations, ball-tree search and the quality model against slow versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenogrid.llm import balltree, langid, phrases, quality, toxicity

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_phrases(rows, least, longest, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, p), a in found.items():
        around = [b for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 100 * a for b in around):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        for i, r in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            ranked.append((lang, i, r[3].decode(), *r[4:]))
    return sorted(ranked)


def texts(seed, count=160):
    rng = random.Random(seed)
    words = ["Ab", "b", "é", "c d", "zz", "the", "Of", "x-1", "日本"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "!\n", "\r\n", "\x0b"]
    made = []
    for _ in range(count):
        made.append("".join(rng.choice(words[: rng.choice((3, 9))]) + rng.choice(ends) for _ in range(rng.randint(0, 60))))
    return [(t, rng.choice(["en", "fr", None])) for t in made]


def test_phrases_match_counting_by_hand(spark):
    rows = [*texts(1), (None, "en"), ("", "fr"), (" . ;", None), ("same thing here " * 400, "en"), ("same thing here " * 400, "en"), ("only once", "xx")]
    df = spark.createDataFrame(rows, "body string, lang string").repartition(5).withColumns({"phrase": F.lit(1), "n": F.lit("x")})
    for least, top in ((5, 2000), (1, 7), (100, 2000)):
        got = phrases.collocations(df, "body", "lang", least, 5, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == slow_phrases(rows, least, 5, top)
    assert phrases.collocations(df.where("false"), "body", "lang").count() == 0
    assert phrases.collocations(df.where("body = ''"), "body", "lang").count() == 0


def test_phrases_do_not_depend_on_chunks_and_shards(spark):
    rows = texts(2)
    df = spark.createDataFrame(rows, "body string, lang string").repartition(7)
    want = slow_phrases(rows, 8, 5, 2000)
    for shards, task_words in ((1, 1), (3, 50), (64, 500)):
        frequent, _ = phrases.frequent_phrases(df, "body", "lang", 8, 5, shards, task_words)
        f = {(r.lang, r.phrase): r.f for r in frequent.collect()}
        assert all(f[lang, p] == a for lang, _, p, a, *_ in want)
        assert sum(x >= 8 for x in f.values()) == len(f)
    small = phrases.chunks_of(df, "body", "lang", 2, 20)
    assert small.count() > 10 and small.agg(F.sum("n")).first()[0] == sum(n for n in total_words(rows).values())


def total_words(rows):
    n = Counter()
    for text, lang in rows:
        n[lang] += len(re.findall(r"[^\x20\x09\x0a-\x0d.,;:!?]+", text))
    return n


def test_phrases_of_one_hash_are_told_apart():
    ids = np.array([1, 2, 1, 3, 0, 1, 2, 0, 1, 3, 0, 1, 2], np.uint16)
    at = np.array([0, 2, 5, 8, 11], np.int32)
    place, times = phrases._groups(ids, at, np.zeros(5, np.uint64), 2)
    assert {tuple(ids[p : p + 2]): t for p, t in zip(place, times)} == {(1, 2): 3, (1, 3): 2}


@pytest.mark.parametrize("bits", [0, 3, 24])
def test_packed_sums_come_back(bits):
    rng = np.random.default_rng(bits)
    h = np.unique(rng.integers(0, 1 << phrases.HASH_BITS, 5000, dtype=np.uint64))
    h = np.append(h, np.uint64((1 << phrases.HASH_BITS) - 1))
    times = rng.integers(1, 9, len(h))
    back = [phrases._unpacked(*row, bits) for row in phrases._packed(h, times, bits)]
    assert (np.concatenate([b[0] for b in back]) == h).all() and (np.concatenate([b[1] for b in back]) == times).all()
    assert list(phrases._packed(h[:0], times[:0], bits)) == []


def test_scores_beyond_64_bits(spark):
    a, n, l, r = 9 * 10**15, 9 * 10**17, 10**16, 3 * 10**16
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    product = (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(20,0)") * F.col("n").cast("decimal(20,0)")).cast("decimal(38,0)")
    score = F.expr("product div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    assert df.withColumn("product", product).select(score).first()[0] == 1000 * a * n // (l * r)


def slow_ranking(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = [(i, Counter(t.translate(UPPER) for t in term.findall(text or ""))) for i, text in docs]
    words = [(i, w) for i, w in words if w]
    count, total = len(words), sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(t.translate(UPPER) for t in term.findall(text or ""))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, w in words:
            m = 100 - 90 + 90 * sum(w.values()) * count // total
            weight = lambda t: math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * (1000000000 * w[t] // (1000 * w[t] + 8 * m)) for t in terms if t in w)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_ball_tree_ranks_like_a_full_scan(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["É", "x9", "THE", "the"]
    text = lambda n: "-".join(rng.choices(vocab, [1 / (i + 1) for i in range(len(vocab))], k=n))
    docs = [(i, text(rng.choice((1, 5, 30, 200)))) for i in range(700)]
    docs += [(700, docs[3][1]), (3, docs[3][1]), (3, text(9)), (None, docs[3][1]), (701, None), (702, ""), (703, "... !"), (704, "alone " * 9000)]
    items = [(i, text(12)) for i in range(15)] + [(3, "w250 w251"), (None, text(5)), (20, None), (21, "?"), (22, "unseen"), (23, "alone"), (24, docs[3][1])]
    df = spark.createDataFrame(docs, "key long, body string").repartition(3).withColumns({"score": F.lit(1), "item": F.lit(2)})
    bench = spark.createDataFrame(items, "item int, body string").withColumn("text", F.lit("w1"))
    for k, item_bytes in ((10, 1 << 19), (3, 200), (2000, 1 << 19)):
        got = balltree.search(df, "key", "body", bench, "item", "body", k, item_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == slow_ranking(docs, items, k)
    assert balltree.search(df.where("false"), "key", "body", bench, "item", "body").count() == 0
    assert balltree.search(df, "key", "body", bench.where("false"), "item", "body").count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    n, width = 3000, 200
    groups = rng.integers(0, 12, n)  # documents of a few topics
    sizes = rng.integers(1, 15, n)
    terms = np.concatenate([np.sort(rng.choice(np.arange(g * 15, g * 15 + 20), s, replace=False)) for g, s in zip(groups, sizes)])
    values = rng.integers(1, 10**9, len(terms))
    tree = balltree.Tree(balltree.Rows(np.append(0, np.cumsum(sizes)), terms, values))
    assert sorted(tree.order.tolist()) == list(range(n))
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(np.arange(n), sizes), terms] = values
    items = [np.sort(rng.choice(width, 8, replace=False)) for _ in range(20)] + [np.zeros(0, np.int64)]
    bounds = tree.bounds(items)
    seen = 0
    for j, own in enumerate(items):
        scores = dense[:, own].sum(axis=1)
        for node in range(len(tree.centres)):
            assert scores[tree.order[tree.lows[node] : tree.highs[node]]].max() <= bounds[node, j] + 1
        wanted, best = np.isin(np.arange(width), own), balltree.Best(5)
        seen += tree.search(bounds[:, j], wanted, lambda row, score, best=best: best.least() if row is None else best.offer(row, score))
        assert [s for s, *_ in sorted(best.heap, reverse=True)] == sorted(scores[scores > 0].tolist(), reverse=True)[:5]
    assert seen < 0.7 * n * len(items)


def noisy(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(quality.FEATURES)))
    # one number alone, and a pair of which neither says anything alone
    y = rng.random(n) < quality._odds(3 * np.abs(x[:, 0]) - 2 + 3 * np.sign(x[:, 1] * x[:, 2]))
    return x, y.astype(float)


def test_tables_learn_curves_and_pairs():
    x, y = noisy(1, 2 * quality.SAMPLE_ROWS)
    model = quality.train(x, y, np.ones(len(y)), np.arange(len(y)) % 5 == 0)
    alone = quality.Model(model.bias, model.cuts, model.tables, [])
    fresh, truth = noisy(2, 4000)
    accuracy = ((model.score(fresh) > 0.5) == truth).mean()
    best = (((3 * np.abs(fresh[:, 0]) - 2 + 3 * np.sign(fresh[:, 1] * fresh[:, 2])) > 0) == truth).mean()
    assert accuracy > best - 0.03 and accuracy > ((alone.score(fresh) > 0.5) == truth).mean() + 0.1
    assert model.pairs[0][:2] == (1, 2)
    # bins looked up by hand
    row = fresh[:1]
    by_hand = model.bias + sum(t[(c <= row[0, f]).sum()] for f, (c, t) in enumerate(zip(model.cuts, model.tables)))
    by_hand += sum(t[(cf <= row[0, f]).sum(), (cg <= row[0, g]).sum()] for f, g, cf, cg, t in model.pairs)
    assert model.score(row)[0] == pytest.approx(1 / (1 + math.exp(-by_hand)))


def test_trees_take_the_best_cuts():
    rng = np.random.default_rng(0)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        score = lambda part: g[part].sum() ** 2 / (h[part].sum() + 1.0)
        best = max(range(1, 9), key=lambda c: score(slice(0, c)) + score(slice(c, None)))
        tree = quality._tree(g, h, 2, 1.0)
        assert len(set(tree)) == 2 and np.flatnonzero(np.diff(tree))[0] + 1 == best
        assert tree[0] == pytest.approx(g[:best].sum() / (h[:best].sum() + 1.0))
        assert len(set(quality._tree(g, h, 3, 1.0))) <= 3


def test_planes_take_the_best_cuts():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g, h = rng.normal(size=(5, 4)), rng.random((5, 4)) + 0.1
        score = lambda a, b: a.sum() ** 2 / (b.sum() + 1.0)
        best = 0
        for x, w in ((g, h), (g.T, h.T)):
            for i in range(1, len(x)):
                for j in range(1, x.shape[1]):
                    for k in range(1, x.shape[1]):
                        parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, k)), (slice(i, None), slice(k, None))]
                        best = max(best, sum(score(x[p], w[p]) for p in parts) - score(g, h))
        gain, values = quality._plane(g, h, 1.0)
        assert gain == pytest.approx(best) and len(np.unique(values.round(12))) <= 4
    assert quality._plane(g[:1], h[:1], 1.0)[0] == 0


def test_numbers_of_a_text():
    f = dict(zip(quality.FEATURES, quality.features_of("Ab cd cd\nEF!! 12.\n\nab")))
    assert f["distinct_words"] == 5 / 6 and f["top_word"] == 2 / 6 and f["same_word"] == 1 / 5
    assert f["upper_words"] == 1 / 6 and f["symbol_words"] == 1 / 6 and f["log_lines"] == pytest.approx(math.log(4))
    assert f["ended_lines"] == 1 / 3 and f["upper"] == 3 / 10
    for text in (None, "", " \n"):
        assert not quality.features_of(text).any()
    assert np.isfinite(quality.features_of("\ud800" + "x" * 300_000)).all()


def test_quality_of_documents(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["tree", "house", "seen", "by", "a", "river", "low"]) + rng.choice(["", "", "."]) for _ in range(60))
    bad = lambda: rng.choice(["buy!! ", "CLICK## now!! "]) * rng.randint(5, 40)
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(400)]
    rows += [(400, None, 0), (401, "", 0), (None, good(), 0), (402, bad(), None), (403, good() * 500, 1), *rows[:3]]
    df = spark.createDataFrame([r[:2] + ("x",) for r in rows], "doc_id long, text string, label string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, mark int").where("mark is not null").distinct()
    model = quality.fit(df.where("doc_id % 3 != 0 or doc_id is null"), "doc_id", "text", marks, "mark")
    got = quality.add_score(df, "text", model, "label").collect()
    assert len(got) == len(rows) and all(0 <= r.label <= 1 for r in got)
    truth = {r[0]: r[2] for r in rows}
    fresh = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3 == 0]
    assert sum((r.label >= 0.3) == truth[r.doc_id] for r in fresh) >= 0.98 * len(fresh)
    again = quality.fit(df.repartition(3).where("doc_id % 3 != 0 or doc_id is null"), "doc_id", "text", marks, "mark")
    assert all((a == b).all() for a, b in zip(model.tables, again.tables))
    none = quality.fit(df, "doc_id", "text", marks.where("mark = 1"), "mark")
    assert {r.q for r in quality.add_score(df, "text", none, "q").collect()} == {0.5}
    assert quality.add_score(df.where("false"), "text", model).count() == 0


def slow_kneser_ney(counts, words):
    """log P(word | 1) - log P(word | 0) by the book, over dictionaries of letter tuples."""
    top, after, before = [Counter(), Counter()], [{}, {}], {}
    for (word, c), n in counts.items():
        letters = "\x02" + word + "\x03"
        for i in range(1, len(letters)):
            gram = letters[max(0, i - 4) : i + 1]
            top[c][gram] += n
            after[c].setdefault(gram[:-1], set()).add(gram[-1])
            for k in range(4):
                if i > k:
                    before.setdefault(letters[i - k : i + 1], set()).add(letters[i - k - 1])
    kinds, total = Counter(), Counter()
    for gram, left in before.items():
        kinds[gram[:-1], len(gram)] += 1
        total[gram[:-1], len(gram)] += len(left)
    context = [Counter(), Counter()]
    for c in (0, 1):
        for gram, n in top[c].items():
            context[c][gram[:-1]] += n
    out = []
    for word in words:
        letters, gain = "\x02" + word + "\x03", 0.0
        for i in range(1, len(letters)):
            p = 1 / toxicity.LETTERS
            for k in range(4):
                if i > k and total[letters[i - k : i], k + 1]:
                    gram = letters[i - k : i + 1]
                    whole = total[gram[:-1], k + 1]
                    p = max(len(before.get(gram, ())) - 0.75, 0) / whole + 0.75 * kinds[gram[:-1], k + 1] / whole * p
            gram = letters[max(0, i - 4) : i + 1]
            each = []
            for c in (0, 1):
                whole = context[c][gram[:-1]]
                each.append(max(top[c][gram] - 0.75, 0) / whole + 0.75 * len(after[c][gram[:-1]]) / whole * p if whole else p)
            gain += math.log(each[1]) - math.log(each[0])
        out.append(gain)
    return out


def test_kneser_ney_by_the_book(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 8))) for _ in range(30)]
    counts = Counter()
    for _ in range(200):
        counts[rng.choice(vocab[:20]), 0] += 1
        counts[rng.choice(vocab[10:]), 1] += 1
    rows = [(w, c, n) for (w, c), n in counts.items()]
    model = toxicity._tables(spark.createDataFrame(rows, "word string, toxic int, n long").repartition(3))
    asked = vocab + ["zzz", "a", "bbbbbbbbbb", "éa"]
    np.testing.assert_allclose(model.evidence(asked), slow_kneser_ney(counts, asked), rtol=1e-4, atol=1e-4)
    assert model.evidence(["zqx"])[0] == pytest.approx(slow_kneser_ney(counts, ["zqx"])[0], abs=1e-4)
    letters = len(asked[0]) + 1
    assert model.rate(asked[0]) == pytest.approx(slow_kneser_ney(counts, asked[:1])[0] / letters, abs=1e-4)


def test_language_probabilities_from_subwords(spark):
    """The softmax again, from the text's own 1- to 4-grams and the model's weights."""
    rng = random.Random(3)
    sample = {"xx": "the house by the sea", "yy": "das haus an der see"}
    rows = [(" ".join(rng.choices(t.split(), k=12)), lang) for lang, t in sample.items() for _ in range(60)]
    rows += [(rows[0][0], "yy"), (rows[0][0], "xx"), (rows[0][0], "xx")]  # one text, several languages: the most frequent counts
    df = spark.createDataFrame(rows, "text string, lang string")
    models = [langid.fit(df.repartition(p), "text", "lang") for p in (1, 5)]
    assert all((m.weight == models[0].weight).all() for m in models)
    model = models[0]
    for text in ("the sea", "haus, 12 SEE", "a"):
        grams = []
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            marked = [0, *map(ord, word), 0]
            grams += [marked[i : i + n] for n in range(1, 5) for i in range(len(marked) - n + 1) if n > 1 or marked[i]]
        assert sum(len(p) for p in langid.subwords(text)) == len(grams)
        seen = []
        for g in grams:
            mixed = 1
            for c in g:
                mixed = (mixed ^ c) * 0x9E3779B97F4A7C15 % 2**64
                mixed ^= mixed >> 29
            seen.append((mixed >> 13) % len(model.weight))
        logits = model.weight[seen].sum(axis=0, dtype=float) / len(seen) + model.bias
        p = np.exp(logits / model.temperature)
        lang, score, _ = model.predict(text)
        assert score == pytest.approx((p / p.sum()).max(), abs=1e-6) and lang == model.langs[int(p.argmax())]
