"""SentencePiece encoding and decoding against the library itself."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesto.llm import pieces, registry
from tests.llm.data import SCHEMA, documents

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Encoder(pieces.Vocabulary.load(PATH))


def same(library, own, text):
    ids = library.encode(text)
    assert own.encode(text).tolist() == ids, text[:200]
    assert own.decode(np.array(ids, np.int32)) == library.decode(ids), text[:200]


@pytest.mark.parametrize("text", ["", " ", " " * 57, "a" * 3000, "ab" * 700, "</s> <unk><0x41>", "\x00a", "▁ ▁", "\U0001f9ff é́", "\n\n \n\t", "=-" * 300, "x" * 20_000 + " end"])
def test_odd_texts(library, own, text):
    same(library, own, text)


def test_joined_pieces(library, own):
    """Whatever pieces stand beside each other, the places that merging chooses are found."""
    r, known = random.Random(4), [p for p, k in zip(own.vocabulary.pieces, own.vocabulary.kinds) if k == pieces.NORMAL]
    for _ in range(1500):
        same(library, own, "".join(r.choice(known) for _ in range(r.randint(1, 7))).replace(pieces.SPACE, " "))
        same(library, own, r.choice(known) * r.randint(1, 12))


@settings(max_examples=40, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60) | st.text(" ▁ab\né.,1", max_size=80))
def test_any_text(text):
    same(_library(), _own(), text)


_kept = {}


def _library():
    return _kept.setdefault("library", sentencepiece.SentencePieceProcessor(model_file=PATH))


def _own():
    return _kept.setdefault("own", pieces.Encoder(pieces.Vocabulary.load(PATH)))


def test_decoding_of_any_ids(library, own):
    r = random.Random(5)
    for _ in range(2000):
        ids = [r.randrange(3, 259) if r.random() < 0.6 else r.randrange(len(own.vocabulary.pieces)) for _ in range(r.randint(1, 9))]
        assert own.decode(np.array(ids)) == library.decode(ids), ids


def test_failed_places_and_small_memory(library, monkeypatch):
    """The memory's bound and the window change no result."""
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    monkeypatch.setattr(pieces, "WINDOW", 7)
    own = pieces.Encoder(pieces.Vocabulary.load(PATH))
    r = random.Random(6)
    for _ in range(300):
        same(library, own, "".join(r.choice("abehint. \n") for _ in range(r.randint(1, 200))))


def test_operator_keeps_rows_and_columns(spark, library):
    rows = [(i, t, "x") for i, t in documents()]
    docs = spark.createDataFrame(rows, SCHEMA + ", ids string")
    out = pieces.encoded(docs, pieces.Vocabulary.load(PATH)).collect()
    assert len(out) == len(rows)
    for x in out:
        assert x["ids"] == library.encode(x["text"] or "") and x["decoded"] == library.decode(x["ids"])
    assert pieces.encoded(docs.limit(0), pieces.Vocabulary.load(PATH)).count() == 0


def test_query(spark, library, tmp_path):
    import hashlib

    spark.createDataFrame(documents(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in registry.op12_sentencepiece(spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(len(i), digest(",".join(map(str, i))), digest(library.decode(i))) for i in (library.encode(t or "") for _, t in documents())}
