"""Hashes of words and lines: equal where the bytes are, and nowhere else."""

import random

import numpy as np

from attesto.llm import hashing, near_dedup, quality


def thue_morse(n):
    """Two strings, each other's complement, on which polynomials modulo 2**64 collide."""
    a = "a"
    while len(a) < n:
        a += a.translate({97: 98, 98: 97})
    return a, a.translate({97: 98, 98: 97})


def test_spans_agree_with_their_bytes(monkeypatch):
    r = random.Random(3)
    for segment in (1 << 19, 300):
        monkeypatch.setattr(hashing, "SEGMENT", segment)
        words = [bytes(r.choice(b"abAB\xc3") for _ in range(r.choice([0, 1, 2, 7, 8, 9, 16, 17, 40, 511, 512, 513, 700]))) for _ in range(400)]
        words += [b"x" * n for n in range(1, 30)] + [b"\x00" * n for n in range(1, 30)] + words[:50]
        ends = np.cumsum([len(w) for w in words])
        starts = ends - [len(w) for w in words]
        data = np.frombuffer(b"".join(words), np.uint8)
        for lower in (False, True):
            seen = {}
            for w, h in zip(words, hashing.spans(data, starts, ends, lower).tolist()):
                assert seen.setdefault(w.lower() if lower else w, h) == h
            assert len(set(seen.values())) == len(seen)


def test_structured_lines_and_words_do_not_collide(spark):
    a, b = thue_morse(1024)
    got = {x.doc_id: x.n_dup_lines for x in quality.quality_rules(spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{a}\n{a}")], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1}
    texts = [a, b, f"w {a} x y z q", f"w {b} x y z q", f"w {a} x y z q"]
    found = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent=85).collect()
    assert {x.doc_id: x.component_id for x in found} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}
