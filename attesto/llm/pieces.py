"""SentencePiece BPE: exact encoding by backtracking, and decoding.

A merge-type model glues the adjacent pair whose joined piece scores highest, leftmost first, until no pair is a
piece. Its result is the only sequence of pieces of which every neighbouring two are what merging their joined text
gives. So the encoder walks from left to right: at each place it takes the longest piece that Aho-Corasick finds
there, asks whether merging it with its left neighbour again gives these two, and falls back to the longest shorter
piece, or to the place before, if not. A bit for each place remembers that no way leads on from it: what lies before a
place is encoded in one way only, so a place that failed once has failed for good, and the walk is linear.

Segments that no piece crosses are encoded apart, and what a worker has encoded lately is remembered. The bound of this
memory changes the speed alone.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import in_arrow

SPACE = "▁"
#: Kinds of pieces, as the library tells them apart.
NORMAL, UNKNOWN, CONTROL, BYTE, UNUSED = range(5)
#: Words, and pairs of pieces, that a worker remembers in each of two generations.
REMEMBERED = 400_000
#: Characters of a segment that is remembered, and places whose longest pieces are in memory at once.
SHORT, WINDOW = 32, 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model: some MB at most, whatever the corpus."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: bytes

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a model file on the driver; models with options that this encoder does not know are refused."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = bytes(UNKNOWN if model.is_unknown(i) else CONTROL if model.is_control(i) else BYTE if model.is_byte(i) else UNUSED if model.is_unused(i) else NORMAL for i in ids)
        found = cls(tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids), kinds)
        if kinds.count(BYTE) != 256 or UNUSED in kinds:
            raise ValueError("a model with all 256 byte pieces and no unused ones is needed")
        for text, pieces in (("  ", 3), ("ａ́", 2)):  # a space is put before, none is lost; characters stay as they are
            if model.normalize(text).replace(SPACE, " ") != (" " + text) or len(model.normalize(text)) != pieces + (text != "  "):
                raise ValueError("a model that only puts a space before the text is needed")
        return found


class _Recent(dict):
    """What was computed lately: two generations, of which the older goes when the younger is full."""

    def __init__(self, compute, worth=None):
        super().__init__()
        self.compute, self.worth, self.old = compute, worth, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if self.worth and not self.worth(key):
                return value
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@dataclass
class Encoder:
    vocabulary: Vocabulary
    ids: dict[str, int] = field(init=False)
    shorter: dict[str, str] = field(init=False)

    def __post_init__(self) -> None:
        import ahocorasick

        v = self.vocabulary
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == NORMAL}
        self._score = {p: v.scores[i] for p, i in self.ids.items()}
        self._bytes = [i for i, k in enumerate(v.kinds) if k == BYTE]
        self._bytes.sort(key=lambda i: int(v.pieces[i][3:5], 16))
        # A piece that merging never makes is never part of a result.
        made = [p for p in self.ids if len(p) == 1 or self.merged(p) == [p]]
        self._machine = ahocorasick.Automaton()
        for p in made:
            self._machine.add_word(p, len(p))
        self._machine.make_automaton()
        known = set(made)
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in known), p[0]) for p in made if len(p) > 1}
        self._ahead = max(map(len, made), default=1)
        # Where a piece may go on: inside no piece does a space follow another character, or a line end stand.
        self._free = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._lines = self._free and not any("\n" in p for p in self.ids)
        self._segments = re.compile(rf"\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self._lines else rf"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if self._free else lambda s: [s] if s else []
        self._fits = _Recent(lambda pair: self.merged(pair[0] + pair[1]) == [*pair])
        self._encoded = _Recent(lambda s: array("i", self.segment(s)).tobytes(), lambda s: len(s) <= SHORT)
        # The bytes that each id stands for.
        texts = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds)]
        self._ends = np.cumsum([0, *map(len, texts)])
        self._flat = np.frombuffer(b"".join(texts), np.uint8)
        self._spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(v.pieces, v.kinds)])
        self._kinds = np.frombuffer(v.kinds, np.uint8)

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text, pair by pair."""
        parts, score = [*text], self._score
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _longest(self, s: str, start: int) -> list[int]:
        """The longest piece's length at each of the next WINDOW places from start; 1 where there is none."""
        out = [1] * min(WINDOW, len(s) - start)
        end = min(len(s), start + len(out) + self._ahead)
        last = start + len(out)
        for stop, n in self._machine.iter(s, start, end):
            at = stop - n + 1
            if at < last:  # ends come in order, so the last match of a place is its longest
                out[at - start] = n
        return out

    def segment(self, s: str) -> list[int]:
        """Ids of a text whose spaces are marks, by backtracking."""
        n, at, taken = len(s), 0, []
        failed = bytearray((n >> 3) + 1)
        longest, window = self._longest(s, 0), 0
        fits, shorter = self._fits, self.shorter
        token: str | None = s[: longest[0]] if n else None
        while at < n:
            while token is not None:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1 and (not taken or fits[taken[-1], token]):
                    break
                token = shorter.get(token)
            if token is not None:
                taken.append(token)
                at += len(token)
                if at < n:
                    if not window <= at < window + len(longest):
                        window = at
                        longest = self._longest(s, at)
                    token = s[at : at + longest[at - window]]
            else:  # no way on from here
                failed[at >> 3] |= 1 << (at & 7)
                last = taken.pop()
                at -= len(last)
                token = shorter.get(last)
        ids, out = self.ids, []
        for t in taken:
            i = ids.get(t)
            if i is None:
                out += [self._bytes[b] for b in t.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        marked = SPACE + text.replace(" ", SPACE)
        return np.frombuffer(b"".join(map(self._encoded.__getitem__, self._segments(marked))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for; bytes that are no text become U+FFFD one by one, and the first mark of a space goes."""
        if len(ids) == 0:
            return ""
        starts, sizes = self._ends[ids], self._ends[np.asarray(ids) + 1] - self._ends[ids]
        ends = np.cumsum(sizes)
        raw = self._flat[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)].tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._mended(ids)
        first = np.flatnonzero(self._kinds[ids] != CONTROL)[:1]
        return text[1:] if len(first) and self._spaced[ids[first[0]]] else text

    def _mended(self, ids: np.ndarray) -> str:
        """As decode, run by run of byte pieces: what is no character in a run is so byte by byte."""
        is_byte = self._kinds[ids] == BYTE
        out, i = [], 0
        while i < len(ids):
            j = i + 1
            while j < len(ids) and is_byte[j] == is_byte[i]:
                j += 1
            raw = b"".join(self._flat[self._ends[k] : self._ends[k + 1]].tobytes() for k in ids[i:j])
            while raw:
                try:
                    out.append(raw.decode())
                    break
                except UnicodeDecodeError as error:
                    out.append(raw[: error.start].decode() + "�")
                    raw = raw[error.start + 1 :]
            i = j
        return "".join(out)


_encoders: dict[int, tuple[Vocabulary, Encoder]] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder a worker and vocabulary."""
    key = hash(vocabulary.kinds) ^ hash(vocabulary.pieces)
    if key not in _encoders or _encoders[key][0] != vocabulary:
        _encoders.clear()
        _encoders[key] = vocabulary, Encoder(vocabulary)
    return _encoders[key][1]


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the ids of each text, and the text that these ids stand for; without their own columns of these two names.

    A null or empty text has no ids and the empty text. Whole texts are encoded, also those of one endless word: the
    walk keeps the ids and a bit for each character of one text. Rows stay rows: copies, ties and nulls in other
    columns pass as they are.
    """
    kept = [c for c in docs.columns if c not in (ids, decoded) or c == text]
    if text in (ids, decoded):
        raise ValueError("the results need names of their own")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a model's vocabulary, however large the corpus
    source = docs.select(*[docs[f"`{c}`"] for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = encoder(shared.value)
        for batch in batches:
            found, texts, offsets = [], [], [0]
            for value in batch.column(text):
                one = at.encode(value.as_py())
                found.append(one)
                texts.append(at.decode(one))
                offsets.append(offsets[-1] + len(one))
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(texts, pa.string())], [*batch.schema.names, ids, decoded])

    schema = T.StructType([*source.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    return in_arrow(source, run, schema)
