"""Ranked lexical search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from attesto.llm import lexical
from tests.llm.data import SCHEMA, documents

TERM = re.compile(lexical.TERM)


def lowered(text):
    return text.translate({a: a + 32 for a in range(65, 91)})


def scored(items, docs, k):
    texts = [(i, TERM.findall(lowered(t or ""))) for i, t in docs]
    texts = [(i, ts) for i, ts in texts if ts]
    n_docs, total = len(texts), sum(len(ts) for _, ts in texts)
    df = Counter(t for _, ts in texts for t in set(ts))
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall(lowered(t or "")))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, ts in texts:
            tf, m = Counter(ts), 50 + 50 * len(ts) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


ITEMS = [(1, "alpha1 beta2 Gamma3, the alpha1"), (2, None), (3, ""), (4, "?! \x00"), (5, "ünïcödé two WORDS x"), (6, "edit1 ab end"), (6, "iota5"), (None, "alpha1"), (7, documents()[24][1])]


def test_operator_is_the_full_scan(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x") for i, t in documents()], SCHEMA + ", _text string").repartition(5)
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, rank int")
    want = scored(ITEMS, documents(), 9)
    assert [tuple(r) for r in lexical.ranked(items, docs, 9).orderBy("item_id", "rank").collect()] == want
    monkeypatch.setattr(lexical, "TERMS", 20)  # several blocks of items
    assert [tuple(r) for r in lexical.ranked(items, docs, 9).orderBy("item_id", "rank").collect()] == want
    assert lexical.ranked(items, docs.limit(0)).count() == 0 and lexical.ranked(items.limit(0), docs).count() == 0


def test_stretches_hold_whole_terms(monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 10)
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("abZ9 .é\n_") for _ in range(r.randrange(80))) + "x" * r.choice([0, 9000])
        assert [t.decode() for part in lexical.terms_of(text.encode()) for t in part] == TERM.findall(lowered(text))


def _shard(r, n, vocabulary):
    rows = [np.sort(r.choice(vocabulary, r.integers(1, 8), replace=False)) for _ in range(n)]
    bounds = np.cumsum([0, *map(len, rows)])
    terms = np.concatenate(rows)
    return lexical.Shard(r.permutation(n) * 3, bounds, terms, r.integers(0, 6, len(terms)) ** 4)


def test_threshold_stops_early_and_loses_nothing():
    r = np.random.default_rng(8)
    early = 0
    for trial in range(150):
        n, k = int(r.integers(1, 900)), int(r.integers(1, 12))
        shard = _shard(r, n, 30)
        item = np.sort(r.choice(30, r.integers(1, 6), replace=False))
        asked = np.zeros(30, bool)
        asked[item] = True
        full = [(-sum(int(x) for t, x in zip(shard.terms[a:b], shard.impacts[a:b]) if asked[t]), int(d)) for d, a, b in zip(shard.docs, shard.bounds, shard.bounds[1:])]
        want = sorted(x for x in full if x[0] < 0)[:k]
        rows, scores, read = shard.best(item, asked, k, 0)
        assert [(-int(s), int(shard.docs[i])) for i, s in zip(rows, scores)] == want
        kth = -want[-1][0] if want else 0
        rows, scores, less = shard.best(item, asked, k, kth + 1)  # a kth score from elsewhere
        assert [(-int(s), int(shard.docs[i])) for i, s in zip(rows, scores)] == [x for x in want if -x[0] >= kth + 1] and less <= read
        early += read < sum(int((shard.terms == t).sum()) for t in item)
    assert early > 20
