"""Small documents with nulls, empty, long and repeated rows, near copies and shared passages."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def changed(text: str, seed: int, edits: int) -> str:
    words, r = text.split(" "), random.Random(seed)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


def documents() -> list[tuple]:
    base, passage = prose(1, 120), prose(2, 60)
    rows: list[tuple] = [(i, prose(100 + i, 80)) for i in range(12)]
    rows += [(20 + i, base) for i in range(4)]
    rows += [(30 + i, changed(base, i, 1 + i % 4)) for i in range(12)]
    rows += [(50 + i, f"{prose(200 + i, 20)}\n{passage}\n{prose(300 + i, 30)}") for i in range(4)]
    rows += [(60, None), (61, ""), (62, "   \n\t "), (63, "two words"), (64, "Two WORDS"), (65, "x" * 5000), (66, "ab " * 400), (67, "ab " * 500 + "end")]
    rows += [(70, prose(7, 30_000)), (71, "ünïcödé " * 60 + prose(9, 10)), (72, "ünïcödé " * 60 + prose(10, 10))]
    rows += [(0, prose(100, 80)), (None, prose(101, 80)), (None, None), (80, "\x00" * 300 + "a"), (81, "b" + "\x00" * 300)]
    return rows


SCHEMA = "doc_id long, text string"
