"""The other operators: packing, licences, top-k, quality, language ID; and the pipeline."""

import hashlib
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from attesto.llm import langid, licenses, packing, quality, topk

from .data import SCHEMA, documents, prose


def check_packing(rows, lengths, capacities):
    by_bin, by_doc = defaultdict(list), defaultdict(int)
    for r in rows:
        by_bin[r.shard, r.bin].append(r)
        by_doc[r.doc_id] += r.n_tokens
    assert by_doc == lengths
    for parts in by_bin.values():
        parts.sort(key=lambda r: r.slot)
        used = sum(r.n_tokens for r in parts)
        assert [r.offset for r in parts] == [sum(x.n_tokens for x in parts[:i]) for i in range(len(parts))]
        assert {r.used for r in parts} == {used} and {r.capacity for r in parts} == {min(c for c in capacities if c >= used)}
    return by_bin


def test_packing_places_every_token_once(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", bin int, used string")
    out = packing.packed(df, capacities=(64, 256, 1024), shard=20).collect()
    want = Counter()
    for d, t in rows:
        want[d] += len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
    check_packing(out, want, (64, 256, 1024))
    assert all(r.start == r.piece * 1024 for r in out)
    assert packing.packed(df.limit(0)).count() == 0
    bins = packing.bins(packing.packed(df, capacities=(64, 256, 1024))).collect()
    assert sum(sum(b.lengths) for b in bins) == sum(want.values())


def test_one_id_is_dealt_to_many_shards(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-(2**63))).when(F.col("id") % 3 == 1, 7).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    out = packing.packed(df, shard=100).collect()
    sizes = Counter(r.shard for r in out)
    assert len(sizes) == 30 and max(sizes.values()) < 200
    assert Counter(r.doc_id for r in out) == {-(2**63): 1000, 7: 1000, None: 1000}


def simulated(lengths, sizes, opening):
    """Best fit the plain way: look at every open bin, take the one with the least room that holds the piece."""
    bins, left = [], sum(lengths)
    for n in lengths:
        room = [(c - u, i) for i, (c, u) in enumerate(bins) if c - u >= n]
        if room:
            i = min(room)[1]
            bins[i] = (bins[i][0], bins[i][1] + n)
        else:
            bins.append((opening(n, left), n))
        left -= n
    return [u for _, u in bins]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_best_fit_equals_a_plain_simulation(lengths):
    sizes, lengths = (16, 32, 64), sorted(lengths, reverse=True)
    smallest = lambda n: min(c for c in sizes if c >= n)
    price = lambda c: c + c * c / 65536 + 8
    rules = [lambda n, left, c=c: max(c, smallest(n)) for c in sizes] + [lambda n, left: min((c for c in sizes if c >= n), key=lambda c: price(c) / min(c, left))]
    cheapest = min(sum(price(smallest(u)) for u in simulated(lengths, sizes, r)) for r in rules)
    bins, used, final = packing.best_fit(np.array(lengths), sizes)
    assert sum(price(c) for c in final) == pytest.approx(cheapest)
    assert sorted(final) == sorted(smallest(u) for u in used)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_best_fit(lengths):
    lengths = np.array(sorted(lengths, reverse=True))
    bins, used, final = packing.best_fit(lengths, (16, 32, 64))
    assert np.bincount(bins, weights=lengths).tolist() == used
    assert all(f == min(c for c in (16, 32, 64) if c >= u) for u, f in zip(used, final))
    # No single-size rule is cheaper.
    costs = sum(packing.cost(f) for f in final)
    for size in (16, 32, 64):
        b, u = packing._fit(lengths.tolist(), (16, 32, 64), lambda n, left, size=size: max(size, min(c for c in (16, 32, 64) if c >= n)))
        assert costs <= sum(packing.cost(min(c for c in (16, 32, 64) if c >= x)) for x in u)


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    other = "  mit LICENCE!!\n Copyright (c) 2024 Someone\n" + mit.split("\n", 1)[1].replace("NONINFRINGEMENT", "NON INFRINGEMENT") + "\nAll rights reserved."
    inside = "Prose.\nReleased under the MIT Licence.\nlicensed under CC BY-NC 4.0\nCopyright 2020 X"
    after = "Prose\n# Copyright (c) 2020 Acme. Licensed under the MIT License.\n\nSPDX-License-Identifier: ISC\n"
    rows = [(1, mit), (2, other), (3, mit + " more"), (4, inside), (5, None), (6, ""), (1, mit), (None, mit), (7, "word " * 60000), (8, after)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", license string, row string")
    got = [(r.doc_id, r.license, r.n_copyright_lines, r.notices) for r in licenses.license_scan(df).collect()]
    want = [(1, "MIT", 0, ""), (2, "MIT", 2, ""), (3, None, 0, ""), (4, None, 1, "CC-BY-NC-4.0,MIT"), (5, None, 0, ""), (6, None, 0, ""), (1, "MIT", 0, ""), (None, "MIT", 0, ""), (7, None, 0, ""), (8, None, 1, "ISC,MIT")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_every_known_text_at_every_wrap(spark):
    """Wherever lines break, also before "copyright notice", and behind comment marks."""
    rows = []
    for name, text in licenses.KNOWN:
        for width in (30, 52, 64, 70, 72, 76, 79, 100):
            for head, mark in (("", ""), ("Copyright (c) 2020, Jane Doe <jane@example.org>\nCopyright Acme Widgets Inc.\nAll rights reserved.\n\n", "# ")):
                lines = [line for part in text.split("\n") for line in (textwrap.wrap(part, width, break_on_hyphens=False, break_long_words=False) or [""])]
                rows.append((len(rows), "\n".join(mark + line for line in [*head.split("\n"), *lines]), name))
    got = {r.doc_id: r.license for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()}
    assert [(i, got[i], n) for i, _, n in rows if got[i] != n] == []


@pytest.mark.parametrize(
    "line", ["copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS AND CONTRIBUTORS", "copyright notice, this list of conditions", "(c) You must retain the notices", "copyright owner that is granting", "Copyright law applies"]
)
def test_lines_that_are_no_copyright_statement(spark, line):
    assert spark.createDataFrame([(f"a\n{line}\nb",)], "t string").select(licenses.canonical(F.col("t")).alias("c")).first().c.startswith("a " + line.lower().strip("(").split(" ")[0].strip("()"))


def test_a_table_of_ones_own(spark):
    df = spark.createDataFrame([(1, "House   Rules!"), (2, "x\nhouse rules\ny")], SCHEMA)
    own = spark.createDataFrame([("House", "house rules"), ("None", "")], "license string, text string")
    for table in (own, [("House", "house rules")]):
        assert sorted((r.doc_id, r.license, r.notices) for r in licenses.license_scan(df, table=table).collect()) == [(1, "House", "House"), (2, None, "House")]


@pytest.mark.parametrize("scale", [1, 2.0**20])
def test_top_k_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "BOXES", 3)
    monkeypatch.setattr(topk, "LEAF", 4)
    rng = np.random.default_rng(4)
    vectors = {i: (np.round(rng.standard_normal(6), 1) * scale).tolist() for i in range(200)} | {i: [float(scale)] * 6 for i in range(200, 300)}  # one vector a third of all
    rows = list(vectors.items()) + [(500, None), (520, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (540, [float("nan")] * 6), (560, [float("inf")] + [0.0] * 5), (None, [0.0] * 6), (3, vectors[3]), (580, []), (600, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, vector string, shard int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, 5).collect())
    ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors.items()}
    want = []
    for q in (i for i in ints if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0, 5).count() == 0


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [3e12, 1.0]), (1, [3e12, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_k(df, F.col("id") == 0, 1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 9), st.integers(0, 10**6), st.sampled_from([2, 9, 10**8]))
def test_a_tree_finds_what_a_scan_finds(n, k, seed, reach):
    rng = np.random.default_rng(seed)
    points, ids = rng.integers(-reach, reach, (n, 3)), rng.permutation(n).astype(np.int64)
    leaf, topk.LEAF = topk.LEAF, 4
    tree = topk.Tree.unpacked(topk.Tree(points, ids, k).packed())
    topk.LEAF = leaf
    least = np.where(rng.random(n) < 0.5, topk.NONE, 0)
    row, found, score = tree.search(points, ids, k, least)
    got = [[(int(s), int(i)) for r, i, s in zip(row, found, score) if r == q and s >= least[q]] for q in range(n)]
    scores = points @ points.T
    want = [[(-s, i) for s, i in sorted((-int(scores[q, j]), int(ids[j])) for j in range(n) if j != q)[:k] if -s >= least[q]] for q in range(n)]
    assert got == want


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    repeat = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


def test_quality_measures_equal_brute_force(spark):
    texts = [t for _, t in documents()] + ["a b c a b c", "x\nx\n x\n\n\nx", "one#two *$%&|<>", "\n", "a\n\na", "é é é é", "l1\r\nl1\r\n", "#" * 9]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = quality.quality_rules(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept <= (not r.base_failed)
    assert quality.quality_rules(df.limit(0)).count() == 0


@pytest.mark.parametrize("segment", [5, 64])
def test_texts_longer_than_a_segment_are_measured_alike(monkeypatch, segment):
    from attesto.llm import hashing

    texts = [t or "" for _, t in documents() if not t or len(t) < 6000] + ["a b c a b c", "x\nx\n x\n\n\nx", "é" * 200 + "\n" + "é" * 200]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    whole = quality.measured(data, offsets)
    assert [tuple(r[:5]) for r in whole.tolist()] == [brute_quality(t) for t in texts]
    monkeypatch.setattr(hashing, "SEGMENT", segment)
    assert (quality.measured(data, offsets) == whole).all()


def test_policies_and_ablation_read_the_ledger(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(documents())] + [(900, prose(5, 80).replace(" ", " #"))], "doc_id long, text string")
    ledger = quality.ledger(df).cache()
    one, two = (quality.decided(ledger, v).where("kept").count() for v in (1, 2))
    assert one > two
    bits = [r.fail_bits & quality.POLICIES[2] for r in ledger.collect()]
    for r in quality.ablation(ledger, 2).collect():
        bit = 1 << [n for n, _ in quality.RULES].index(r.rule)
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), sum(not b & ~bit for b in bits))
    assert {r.n_failed for r in quality.ablation(ledger.limit(0)).collect()} == {0}


def tongues(n=240):
    import random

    parts = {"en": "the of and ing tion er", "de": "der und sch ung ein zu", "fr": "le de que eau ment ai"}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        r = random.Random(i)
        rows.append((i, " ".join("".join(r.choices(parts[lang].split(), k=2)) for _ in range(40 + i % 50)), lang))
    return rows


def test_language_id_on_held_out_texts(spark):
    rows = tongues() + [(900, None, "en"), (901, "", "en"), (902, "123 !? 456", "de"), (903, "é" * 10, None), (None, "the of and", None), (904, "the of and ing " * 20000, None), (0, tongues()[0][1], "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    out = langid.language_id(df).collect()
    assert len(out) == len(rows)
    want = {d: x for d, _, x in rows}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 50 and sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.95
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert und == {900, 901, 902} and all(0 <= r.score <= 1 for r in out)
    assert next(r for r in out if r.doc_id == 904).lang_pred == "en"
    swapped = langid.language_id(df.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))).collect()
    assert sorted(map(repr, swapped)) == sorted(map(repr, out))


def _small_net(dtype=np.float64):
    net = langid.ByteNet(["a", "b", "c"], seed=3)
    rng = np.random.default_rng(8)
    net.tables = [rng.standard_normal(t.shape).astype(dtype) for t in net.tables]
    net.bias, net.dense, net.shift = (rng.standard_normal(p.shape).astype(dtype) for p in (net.bias, net.dense, net.shift))
    return net, rng.integers(0, 256, (5, langid.WINDOW), dtype=np.uint8), np.array([0, 2, 1, 1, 0])


def test_prediction_equals_a_plain_convolution():
    net, x, _ = _small_net(np.float32)
    for i, p in enumerate(net.predict(x)):
        tops = []
        for w, table in zip(langid.WIDTHS, net.tables):
            for f in range(langid.FILTERS):
                tops.append(max(sum(float(table[j, x[i, at + j], f]) for j in range(w)) for at in range(langid.WINDOW - w + 1)))
        hidden = [max(0.0, t + float(b)) for t, b in zip(tops, net.bias)]
        out = [sum(h * float(net.dense[k, c]) for k, h in enumerate(hidden)) + float(net.shift[c]) for c in range(3)]
        e = np.exp(np.array(out) - max(out))
        assert np.allclose(p, e / e.sum(), atol=1e-3)


def test_gradients_equal_finite_differences():
    net, x, y = _small_net()
    net.dense, net.shift = net.dense * 0.1, net.shift * 0.1
    _, grads = net.gradients(x, y)
    rng = np.random.default_rng(1)
    for p, g in zip(net._parameters(), grads):
        flat, slope = p.reshape(-1), np.asarray(g).reshape(-1)
        for i in {*rng.integers(0, len(flat), 4).tolist(), int(np.abs(slope).argmax())}:
            old = flat[i]
            flat[i] = old + 1e-6
            up = net.gradients(x, y)[0]
            flat[i] = old - 1e-6
            down = net.gradients(x, y)[0]
            flat[i] = old
            assert abs((up - down) / 2e-6 - slope[i]) < 1e-5


def test_an_id_that_repeats_is_learned_from_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    seen = []
    monkeypatch.setattr(langid.ByteNet, "fit", lambda self, windows, labels, seed=12: seen.append((len(windows), sorted(set(labels.tolist())))) or self)
    rows = [(3, f"text number {i} with letters", "en") for i in range(2000)] + [(i, f"ein text {i}", "de") for i in range(100, 200)]
    langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen == [(1 + 20, [0, 1])]
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="labels"):
        langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_stages_take_nothing_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __lang string, __score double, copies int, found string, h long, component_id long"
    rows = [(i, f"{prose(i, 30)} token=abcdefgh{i}", "en", f"s{i % 3}", 5, "x", 0.5, 7, "f", 9, 1) for i in range(12)] + [(20, None, None, None, None, None, None, None, None, None, None)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == df.columns and docs.schema.simpleString() == df.schema.simpleString()
        out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert bool(out) == bool(df.count())


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.language_id(df).collect()} == {("und", 0.0)}
    assert langid.language_id(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    rows = [(d, t, "en", f"s{d % 3}", len(t)) for d, t, _ in tongues(120)]
    rows += [(500 + i, rows[i][1] + " end", "en", "s1", 1) for i in range(5)] + [(600, None, "en", "s1", 0), (601, "12 34", "en", "s1", 5), (602, prose(3, 50) + " password=abcdef123456", "en", "s2", 9)]
    path = f"{tmp_path}/t"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
    ids = [{d for d, _ in k} for k in kept]
    assert ids[0] == {r[0] for r in rows} - {600, 601}
    assert not ids[1] & set(range(500, 505)) and ids[2] == ids[1]
    assert dict(kept[2])[602].endswith("[secret]") and ids[3] <= ids[2]
    bins = corpus_pipeline.run(spark, path).collect()
    assert Counter(d for b in bins for d in b.doc_ids) == Counter(d for d, _ in kept[3])
    assert hashlib.sha256 and all(sum(b.lengths) == b.used <= b.capacity for b in bins)


def test_equal_scores_take_the_first_language_by_name(spark):
    class Undecided:
        languages = ["de", "en", "fr"]

        def predict(self, windows):
            import numpy as np

            return np.tile([0.2, 0.4, 0.4], (len(windows), 1))

    rows = spark.createDataFrame([(1, "some words"), (2, "12 34"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.identify(rows, Undecided()).collect()} == {1: ("en", 0.4), 2: ("und", 0.0), 3: ("und", 0.0)}
