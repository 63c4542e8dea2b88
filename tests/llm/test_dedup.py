import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from attesto.llm import hashing, near_dedup, suffix_dedup
from attesto.llm.components import components

from .data import SCHEMA, documents


def word_shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(rows, percent=85):
    sets = [word_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None:
            continue
        same = rows[i][0] == rows[j][0]
        if same or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        peers = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(peers) if d is not None else None, d is None or d == min(peers)))
    return out


def key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    rows = documents()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", root string, count int")
    assert key(tuple(r) for r in near_dedup.near_duplicates(df, percent=percent).collect()) == key(brute_components(rows, percent))


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(near_dedup, "STAR", 2)
    monkeypatch.setattr("attesto.llm.components.HOT", 3)
    monkeypatch.setattr("attesto.llm.components.FEW", 1)
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    assert key(tuple(r) for r in near_dedup.near_duplicates(df, percent=85).collect()) == key(brute_components(rows))


@pytest.mark.parametrize("block", [3_000, 4])
def test_chains_that_stars_leave_out(spark, monkeypatch, block):
    """Each text is like the next only, so most links are not with a bucket's centre."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", block)
    words = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 150])) for i in range(30)] + [(100 + i, " ".join(words[13 * i : 13 * i + 100])) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_components(rows, 80)
    assert {c for d, _, c, _ in want if d < 100} == {0}
    assert key(tuple(r) for r in near_dedup.near_duplicates(df, percent=80).collect()) == key(want)


def test_recall_of_links(spark):
    """All links of pairs that nothing else joins, from just above the threshold."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for g in range(120):
        base = [f"g{g}{w}" for w in words]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base[: 91 + g % 8], *(f"e{g}{i}" for i in range(9 - g % 8))]))]
    want = brute_components(rows, 80)
    assert sum(d != c for d, _, c, _ in want) == 120
    assert key(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) == key(want)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deduplicated_keeps_one_of_each_group(spark):
    rows = documents()
    kept = near_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA), percent=85).collect()
    want = {d for d, _, _, k in brute_components(rows) if k}
    assert {r.doc_id for r in kept} == want
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids))


def test_pipeline_stage_links_from_80_hundredths(spark):
    words = [f"w{i}" for i in range(100)]
    near, far = ([*words[:n], *(f"x{i}" for i in range(n, 100))] for n in (91, 89))  # 87 and 85 of 105 and 107 shingles are common
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(f"y{w}" for w in words)), (4, " ".join(f"y{w}" for w in far))]
    both = [len(word_shingles(a) & word_shingles(b)) / len(word_shingles(a) | word_shingles(b)) for (_, a), (_, b) in (rows[:2], rows[2:])]
    assert 0.80 <= both[0] < 0.85 and both[1] < 0.80
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4]
    assert 2 * (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS < 3e-5


@pytest.mark.parametrize("segment", [7, 64, 1 << 19])
def test_shingles_match_words(monkeypatch, segment):
    monkeypatch.setattr(hashing, "SEGMENT", segment)
    texts = [t or "" for _, t in documents()]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = hashing.shingles(data, offsets)
    assert [len(x) for x in got] == [len(word_shingles(t)) for t in texts]
    monkeypatch.setattr(hashing, "SEGMENT", 1 << 19)
    assert all((a == b).all() for a, b in zip(got, hashing.shingles(data, offsets)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 9), min_size=1), min_size=1, max_size=12))
def test_linked_finds_components(groups):
    sets = [np.array(sorted(g), np.uint64) for g in groups]
    root = list(range(len(groups)))
    for _ in groups:
        for i, j in itertools.combinations(range(len(groups)), 2):
            if 100 * len(groups[i] & groups[j]) >= 60 * len(groups[i] | groups[j]):
                root[i] = root[j] = min(root[i], root[j])
    out = dict(near_dedup.linked([10 + i for i in range(len(groups))], sets, 60))
    assert {10 + i: out.get(10 + i, 10 + i) for i in range(len(groups))} == {10 + i: 10 + r for i, r in enumerate(root)}


def test_components(spark):
    edges = [(5, 3), (3, 1), (9, 8), (8, 9), (4, 4), (10, 9), (20, 21), (21, 22), (22, 23), (23, 24)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {3: 1, 5: 1, 9: 8, 10: 8, 21: 20, 22: 20, 23: 20, 24: 20}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removed(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(cover))]
        rest = bytes(x for x, c in zip(t, cover) if not c)
        out.append((d, len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(rest).hexdigest()))
    return out


def removed(spark, rows, shortcuts=True):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", pos string")
    return key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeats_removed(df, shortcuts=shortcuts).collect())


def small(rows):
    return [(d, t if t is None else t[:4000]) for d, t in rows]


@pytest.mark.parametrize("shortcuts", [True, False])
def test_repeats_removed_equal_brute_force(spark, shortcuts, monkeypatch):
    """Also where the merge alone decides, and with many ranges."""
    monkeypatch.setattr(suffix_dedup, "RANGE_KEYS", 40)
    rows = small(documents()) + [(0, "another text under a repeated id " * 9), (90, "é" * 150 + "q"), (91, "z" + "é" * 150)]
    assert removed(spark, rows, shortcuts) == key(brute_removed(rows))


@pytest.mark.parametrize("period", [1, 3, 9, 31, 32, 33, 40])
def test_periodic_stretches(spark, period):
    unit = "".join(chr(97 + (7 * i + i * i) % 26) for i in range(period))
    body = unit * (900 // period)
    rows = [(1, "start of one " + body + " end of one"), (2, "other " + body[: 200 + period // 2] + "!"), (3, body[1:201]), (4, body[:199] + "~" + body[:230]), (5, "clean text " * 3)]
    assert removed(spark, rows) == removed(spark, rows, shortcuts=False) == key(brute_removed(rows))


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 512)
    rows = small(documents())
    assert removed(spark, rows) == key(brute_removed(rows))


def test_repeats_of_nothing(spark):
    assert removed(spark, []) == []


def text_with_hits(texts):
    """A batch as the run makers get it: every 40th place of each text as an anchor."""
    places = [list(range(0, max(0, len(t) - suffix_dedup.K), 40)) for t in texts]
    hits = [[{"pos": p, "gram": int(zlib.crc32(t[p : p + suffix_dedup.K])) << 31} for p in ps] for t, ps in zip(texts, places)]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("gram", pa.int64())]))
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, pa.array([t.decode() for t in texts]), pa.array(hits, kind)], ["d", "p", "text", "hits"]), places


def test_runs_are_sent_together_and_bounded(monkeypatch):
    """One Arrow batch for the runs of all ranges, and a long text's keys in runs of RUN_KEYS, not in one of its own length."""
    monkeypatch.setattr(suffix_dedup, "RUN_KEYS", 50)
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, n, np.uint8).tobytes() for n in (300, 90, 0, 12_000, 33, 500)]
    batch, places = text_with_hits(texts)
    sent = list(suffix_dedup._runs(16)([batch]))
    total = sum(map(len, places))
    assert len(sent) == -(-total // 50)
    sizes = [sum(len(suffix_dedup.Reader(x.as_py()).pos) for x in b.column("run")) for b in sent]
    assert sum(sizes) == total and max(sizes) <= 50
    # A key holds its own text's bytes only.
    found = {}
    for b in sent:
        for x in b.column("run"):
            r = suffix_dedup.Reader(x.as_py())
            while r.step() >= 0:
                i = int(r.counts[: r.i].sum())
                found[int(r.docs["d"][i]), int(r.pos[i])] = r.key
    for d, (t, ps) in enumerate(zip(texts, places)):
        for p in ps:
            right, left = t[p : p + 200], t[max(0, p - 168) : p][::-1]
            assert found[d, p][8:] == right.ljust(200, b"\0") + left.ljust(168, b"\0") + bytes([len(right), len(left)])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 40), st.integers(1, 4))
def test_windows_equal_brute_force(seed, n, grams):
    """The stretch of each key, where contexts branch at random places on both sides."""
    rng = np.random.default_rng(seed)
    rows = np.zeros((n, suffix_dedup.WIDTH), np.uint8)
    for i in range(n):
        rows[i, :8] = rng.integers(grams)
        for a, size in ((8, 200), (208, 168)):
            rows[i, a : a + size] = 97
            if a == 8:
                rows[i, 8:40] = rows[i, 0]
            cut = rng.integers(40 if a == 8 else 0, size + 1)
            rows[i, a + cut : a + size] = rng.integers(97, 100)
        rows[i, -2] = rng.choice([200, 200, rng.integers(32, 201)])
        rows[i, -1] = rng.choice([168, 168, rng.integers(0, 169)])
        rows[i, 8 + int(rows[i, -2]) : 208] = 0
        rows[i, 208 + int(rows[i, -1]) : 376] = 0
    keys, counts = unique_rows(rows)
    shared = np.append(0, suffix_dedup.common(keys[:-1], keys[1:]))
    least, most = suffix_dedup.windows(keys, shared, counts)
    for i, k in enumerate(keys):
        held = []
        for j, other in enumerate(keys):
            if (i == j and counts[i] < 2) or bytes(k[:8]) != bytes(other[:8]):
                continue
            right = min(suffix_dedup.common(k[None, 8:208], other[None, 8:208])[0], k[-2], other[-2])
            left = min(suffix_dedup.common(k[None, 208:376], other[None, 208:376])[0], k[-1], other[-1])
            held += range(200 - int(right), int(left) + 1)
        assert (least[i], most[i]) == ((min(held), max(held)) if held else (200, -1))


def unique_rows(rows):
    found = sorted(r.tobytes() for r in rows)
    keys = sorted(set(found))
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, rows.shape[1]), np.array([found.count(k) for k in keys])


def test_runs_that_touch_are_joined():
    doc, starts, ends = (np.array(x) for x in ([0, 0, 0, 2, 2, 2], [0, 5, 30, 0, 3, 12], [10, 8, 40, 4, 12, 15]))
    assert [x.tolist() for x in suffix_dedup.joined(doc, starts, ends)] == [[0, 0, 2], [0, 30, 0], [10, 40, 15]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=3, max_size=3), max_size=20), min_size=1, max_size=6))
def test_loser_tree_merges(runs):
    width = suffix_dedup.WIDTH
    blobs, every = [], []
    for r in runs:
        if not r:
            continue
        keys = np.zeros((len(r), width), np.uint8)
        keys[:, :3] = np.array([list(x) for x in r])
        every += [k.tobytes() for k in keys]
        blobs += [b for _, b in suffix_dedup.run(keys, np.zeros(len(r), suffix_dedup.ID), np.zeros(len(r), np.int64), 1)]
    if not blobs:
        return
    out, last = [], b""
    for shared, reader in suffix_dedup.merged([suffix_dedup.Reader(b) for b in blobs]):
        n = next((i for i in range(width) if i >= len(last) or last[i] != reader.key[i]), width)
        assert not last or shared == n
        out += [reader.key] * int(reader.counts[reader.i])
        last = reader.key
    assert out == sorted(every)
