"""Exact removal of repeated byte strings by a distributed merge sort of sampled suffixes.

A byte goes when a string of LENGTH bytes that covers it also starts elsewhere. Not every
suffix is sorted. Of each window of LENGTH bytes, the K-gram with the least hash is the
window's anchor; equal windows have their anchors at the same place in them, so two equal
windows show as two anchors whose suffixes agree to the right and whose contexts agree to
the left. About two in LENGTH - K positions are anchors.

Sort key of an anchor: hash of its K-gram, the LENGTH bytes from the anchor, the bytes
before it in reverse, and how many of each exist. Leading with the hash deals ranges of
keys evenly without sampling splitters, and keeps equal K-grams in one range. Each map
task sorts its keys, merges equal ones and sends each range as one front-coded run (common
prefix with the key before, then the rest, deflated). A range's task merges its runs with a loser
tree whose nodes hold the length of the prefix shared with the last winner: keys with
different lengths are ordered by these alone, and equal ones are compared from there on.

In the merged order, common prefixes give for each offset o the sets of anchors that agree
in the LENGTH - o bytes to the right; with the agreement in o bytes to the left they give
the windows that occur twice, exactly and without comparing pairs.

Three things shorten the sort, and none decides what it does not prove:
- Only anchors whose K-gram occurs twice are sorted; the others have no equal window.
- Texts that have an exact copy of LENGTH bytes or more go whole, as all their windows
  recur, and one of them is sorted for the others' sake.
- A stretch of short period has an anchor each period. All windows within it recur a period
  on, so it goes without a search, and of its anchors only the first, one from its inside
  and those near its end are sorted: every window that holds it in part has one of these as
  its anchor, and every window within it equals one at the anchor from its inside.
The last two are shortcuts of repeats_removed(); without them the merge alone decides, with
the same result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from ._common import blocks, in_arrow, partitions, utf8, written

LENGTH, K = 200, 32
LEFT = LENGTH - K
#: Bytes of a key: hash, right, left, the lengths of both.
WIDTH = 8 + LENGTH + LEFT + 2
#: Keys that a map task holds before it sends a run.
RUN_KEYS = 50_000
#: Places of keys that a merge task gathers before it looks for windows, if the K-gram ends there.
FLUSH = 20_000
#: Bytes of a long text whose hashes are in memory at once.
SEGMENT = 1 << 20
#: Bits of a position among the bytes hashed at once.
BITS = 22
NO_ID = -(2**63)
#: Start of a run that says that a text has an exact copy; runs are in order, so it comes first.
COPY = -1
#: What names a row: its id and a hash of its text.
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
ID = np.dtype([("d", "<i8"), ("p", "<i8")])
#: Anchors of a range of keys, about; a merge task holds the runs of one range.
RANGE_KEYS = 150_000


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all texts' anchors, in order, and the hashes of their K-grams."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = hashing.prefix(data)
    grams = sums[K:] - sums[:-K]
    grams *= hashing.powers(n + 1)[1][: len(grams)]
    grams = hashing.mix(grams)
    # The least of each window's LEFT + 1 hashes; the upper bits decide, then the position.
    bits = np.uint64(BITS)
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= LEFT + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = LEFT + 1 - span
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    inside = np.zeros(n + 1, bool)  # windows that end within their text
    sizes = np.diff(offsets)
    reach = np.repeat(offsets[1:], sizes)
    inside[:n] = np.arange(n) + LENGTH <= reach
    found = (least[inside[: len(least)]] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.unique(found)
    return at, hashing.mix(grams[at])  # mixed again: least hashes alone would crowd in the first range


def thinned(at: np.ndarray, grams: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which anchors to keep, and (doc, start, end) of the stretches that repeat in themselves."""
    keep = np.ones(len(at), bool)
    if len(at) < 3:
        return keep, []
    step = np.diff(at, prepend=at[:1])
    linked = np.zeros(len(at), bool)
    linked[1:] = (grams[1:] == grams[:-1]) & (doc[1:] == doc[:-1]) & (step[1:] <= K)
    fresh = ~linked
    fresh[1:] |= linked[:-1] & (step[1:] != step[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    found = []
    for a, b in zip(first[last - first > 8].tolist(), last[last - first > 8].tolist(), strict=True):
        period, end = int(step[a + 1]), int(at[b]) + K
        inner = a - (-LEFT // period)
        if inner < b and at[inner] + LENGTH <= end:
            keep[a + 1 : b + 1] = at[a + 1 : b + 1] + LENGTH + period > end
            keep[inner] = True
            found.append((int(doc[a]), int(at[a]), end))
    return keep, found


def _anchor_rows(shortcuts: bool):
    return lambda batches: _sampled(batches, shortcuts)


def _sampled(batches, shortcuts: bool):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in blocks(offsets, SEGMENT):
            own, size = offsets[a : b + 1] - offsets[a], offsets[b] - offsets[a]
            part = data[offsets[a] : offsets[b]]
            if size <= 2 * SEGMENT:
                at, grams = anchors(part, own)
            else:  # one long text: segments that share LENGTH - 1 bytes have all its windows
                found = [(s, *anchors(part[s : s + SEGMENT + LENGTH - 1], np.array([0, min(size, s + SEGMENT + LENGTH - 1) - s]))) for s in range(0, size, SEGMENT)]
                at, where = np.unique(np.concatenate([s + x for s, x, _ in found]), return_index=True)
                grams = np.concatenate([x for *_, x in found])[where]
            doc = np.searchsorted(own, at, "right") - 1
            keep, stretches = thinned(at, grams, doc) if shortcuts else (np.ones(len(at), bool), [])
            at, grams, doc = at[keep], grams[keep], doc[keep]
            bounds = np.searchsorted(at, own)
            stretched: list[list[dict]] = [[] for _ in range(b - a)]
            for i, start, end in stretches:
                stretched[i].append({"start": start - own[i], "end": end - own[i]})
            lists = pa.array(bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x).slice(a, b - a) for x in ("d", "p", "sha")), pa.array(np.diff(own), pa.int64()), pa.ListArray.from_arrays(lists, pa.array((at - own[doc]).astype(np.int32))), pa.ListArray.from_arrays(lists, pa.array(grams.view(np.int64))), pa.array(stretched, _SPANS)],
                ["d", "p", "sha", "n_bytes", "pos", "gram", "stretches"],
            )


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes with room around them for what the keys of the first and last anchors hold."""
    out = np.zeros(LEFT + len(data) + LENGTH, np.uint8)
    out[LEFT : LEFT + len(data)] = data
    return out


def keys_of(wide: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """A row of WIDTH bytes for each anchor: its place among the padded bytes, and where its text begins and ends there."""
    right, left = np.minimum(LENGTH, end - at), np.minimum(LEFT, at - begin)
    around = np.lib.stride_tricks.sliding_window_view(wide, LEFT + LENGTH)[at]
    short = np.flatnonzero(right < LENGTH)  # what another text holds is not read
    around[short, LEFT:] *= np.arange(LENGTH) < right[short, None]
    short = np.flatnonzero(left < LEFT)
    around[short, :LEFT] *= np.arange(LEFT, 0, -1) <= left[short, None]
    out = np.empty((len(at), WIDTH), np.uint8)
    out[:, :8] = grams.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8 : 8 + LENGTH] = around[:, LEFT:]
    out[:, 8 + LENGTH : -2] = around[:, LEFT - 1 :: -1]
    out[:, -2] = right
    out[:, -1] = left
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = a != b
    first = differ.argmax(1)
    return np.where(differ[np.arange(len(a)), first], first, a.shape[1]) if len(a) else np.zeros(0, np.int64)


def run(keys: np.ndarray, docs: np.ndarray, at: np.ndarray, ranges: int):
    """(range, front-coded run) of keys and the (doc, position) pairs that have them."""
    order = np.argsort(keys.view(f"S{WIDTH}").ravel(), kind="stable")
    keys, docs, at = keys[order], docs[order], at[order]
    shared = np.zeros(len(keys), np.int64)
    shared[1:] = common(keys[:-1], keys[1:])
    new = shared < WIDTH
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(keys)))
    heads = keys[first]
    where = (heads[:, :8].copy().view(">u8").ravel() >> np.uint64(32)).astype(np.int64) * ranges >> 32
    cuts = np.flatnonzero(np.diff(where, prepend=-1))
    member = np.concatenate(([0], np.cumsum(counts)))
    lcp = shared[first]
    lcp[cuts] = 0
    tails = heads[np.arange(WIDTH) >= lcp[:, None]]
    tail = np.concatenate(([0], np.cumsum(WIDTH - lcp)))
    lcp, counts, at = lcp.astype(np.uint16), counts.astype(np.int32), at.astype(np.int32)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(where)], strict=True):
        m = slice(member[a], member[b])
        yield int(where[a]), b"".join((np.int64(b - a).tobytes(), lcp[a:b].tobytes(), counts[a:b].tobytes(), docs[m].tobytes(), at[m].tobytes(), zlib.compress(tails[tail[a] : tail[b]], 1)))


def _runs(ranges: int):
    def send(held):
        if held:
            wheres, blobs = zip(*run(*(np.concatenate(x) for x in zip(*held, strict=True)), ranges), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(wheres, pa.int32()), pa.array(blobs, pa.binary())], ["range", "run"])

    def make(batches):
        held, count = [], 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            wide = padded(data)
            hits = batch.column("hits")
            bounds, both = hits.offsets.to_numpy(), hits.values
            every = slice(bounds[0], bounds[-1])
            pos, gram = both.field(0).to_numpy()[every].astype(np.int64), both.field(1).to_numpy()[every].view(np.uint64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            ids = np.empty(batch.num_rows, ID)
            ids["d"], ids["p"] = batch.column("d").to_numpy(), batch.column("p").to_numpy()
            a = 0
            while a < len(pos):
                part = slice(a, min(len(pos), a + RUN_KEYS - count))
                i = doc[part]
                held.append((keys_of(wide, offsets[i], offsets[i + 1], offsets[i] + pos[part], gram[part]), ids[i], pos[part]))
                count += part.stop - a
                a = part.stop
                if count >= RUN_KEYS:
                    yield from send(held)
                    held, count = [], 0
        yield from send(held)

    return make


class Reader:
    """A front-coded run: its keys one by one, each with the prefix shared with the one before."""

    def __init__(self, blob: bytes):
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        self.lcps = np.frombuffer(blob, np.uint16, n, 8).tolist()
        self.counts = np.frombuffer(blob, np.int32, n, 8 + 2 * n)
        m, at = int(self.counts.sum()), 8 + 6 * n
        self.docs, self.pos = np.frombuffer(blob, ID, m, at), np.frombuffer(blob, np.int32, m, at + ID.itemsize * m)
        self.blob = zlib.decompress(memoryview(blob)[at + (ID.itemsize + 4) * m :])
        self.at, self.i, self.n, self.key = 0, -1, n, b""

    def step(self) -> int:
        """Goes on by a key; the prefix that it shares with the last key, or -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            return -1
        shared = self.lcps[self.i]
        end = self.at + WIDTH - shared
        self.key = self.key[:shared] + self.blob[self.at : end]
        self.at = end
        return shared


def _beats(a: list, b: list) -> bool:
    """Whether a = [shared, reader] is the lesser; the loser's shared becomes that with the winner.

    Both shared values refer to the last winner, so if they differ the longer is lesser
    and the loser keeps its value; if not, bytes up to it are known to be equal.
    """
    x, y = a[0], b[0]
    if x != y:
        return x > y
    if x < 0:
        return True
    p, q = a[1].key, b[1].key
    if p == q:
        b[0] = WIDTH
        return True
    i, step = x, 32
    while p[i : i + step] == q[i : i + step]:
        i += step
    while p[i] == q[i]:
        i += 1
    if p[i] < q[i]:
        b[0] = i
        return True
    a[0] = i
    return False


def merged(readers: list[Reader]):
    """(shared with the key before, reader) in key order, by a loser tree."""
    size = 1
    while size < len(readers):
        size *= 2
    entries: list[list] = []
    for r in readers:
        entries.append([0 if r.step() >= 0 else -1, r, size + len(entries)])
    entries += [[-1, None, 2 * size - 1 - i] for i in range(size - len(readers))]
    losers: list[list] = [[]] * size
    winners: list[list] = [[]] * size + entries
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if _beats(a, b):
            winners[node], losers[node] = a, b
        else:
            winners[node], losers[node] = b, a
    top = winners[1] if size > 1 else entries[0]
    while top[0] >= 0:
        yield top[0], top[1]
        x = top[0] = top[1].step()
        node = top[2] >> 1
        while node:
            other = losers[node]
            y = other[0]
            if x < y or (x == y and not _beats(top, other)):  # unequal prefixes decide alone
                losers[node], top, x = top, other, y
            node >>= 1


def windows(keys: np.ndarray, shared: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per merged key the least and the greatest offset o for which the window from anchor - o occurs twice; LENGTH and -1 if none does.

    All windows of a key hold its anchor, so what goes is one stretch, between these two.
    """
    n = len(keys)
    right, left = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64)
    least, most = np.full(n, LENGTH), np.full(n, -1)
    whole = (counts > 1) & (LENGTH - right <= left)
    least[whole], most[whole] = LENGTH - right[whole], left[whole]
    near = np.zeros(n, bool)
    near[1:] = shared[1:] >= 8 + K
    group = np.flatnonzero(near | np.append(near[1:], False))  # keys with a neighbour of the same K-gram
    if not len(group):
        return least, most
    within = np.where(near[group], shared[group], 0)
    gram = np.cumsum(within < 8 + K)
    # In order of their left contexts, K-gram by K-gram.
    before = np.empty((len(group), 4 + LEFT), np.uint8)
    before[:, :4] = gram.astype(">u4").view(np.uint8).reshape(-1, 4)
    before[:, 4:] = keys[group, 8 + LENGTH : -2]
    order = np.argsort(before.view(f"S{4 + LEFT}").ravel(), kind="stable")
    agree = np.zeros(len(group), np.int64)
    agree[1:] = np.maximum(common(before[order[:-1]], before[order[1:]]) - 4, 0)
    # No key agrees further with any other than with its neighbours in each of the two orders.
    low = LENGTH - np.minimum(right[group], np.maximum(within, np.append(within[1:], 0)) - 8)
    high = np.empty(len(group), np.int64)
    high[order] = np.maximum(agree, np.append(agree[1:], 0))
    high = np.minimum(high, left[group])
    # What neighbours in either order say of each other; most keys need no more.
    a, b = np.flatnonzero(gram[1:] == gram[:-1]), np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    for i, j, forth, back in (
        (a, a + 1, within[a + 1] - 8, common(before[a, 4:], before[a + 1, 4:])),
        (order[b], order[b + 1], common(keys[group[order[b]], 8 : 8 + LENGTH], keys[group[order[b + 1]], 8 : 8 + LENGTH]), agree[b + 1]),
    ):
        first = LENGTH - np.minimum(forth, np.minimum(right[group[i]], right[group[j]]))
        last = np.minimum(back, np.minimum(left[group[i]], left[group[j]]))
        met = first <= last
        for x in (i, j):
            np.minimum.at(least, group[x[met]], first[met])
            np.maximum.at(most, group[x[met]], last[met])
    able = low <= high
    open_ = able & ((least[group] > low) | (most[group] < high))
    asked = np.zeros(gram[-1] + 1, bool)
    asked[gram[open_]] = True
    able &= asked[gram]
    some = np.flatnonzero(able)
    if not open_.any():
        return least, most
    many = counts[group]
    for o in range(low[open_].min(), high[open_].max() + 1):
        part = some[(low[some] <= o) & (o <= high[some])]
        if not open_[part].any():
            continue
        a = np.cumsum(within < 8 + LENGTH - o)
        b = np.empty(len(group), np.int64)
        b[order] = np.cumsum(agree < o)
        _, inverse = np.unique(a[part] * (len(group) + 1) + b[part], return_inverse=True)
        met = group[part[np.bincount(inverse, weights=many[part])[inverse] > 1]]
        least[met], most[met] = np.minimum(least[met], o), np.maximum(most[met], o)
    return least, most


def _flush(keys, shared, of, starts, counts, ids, pos):
    """(d, p, start, end) of what goes, for each place that has one of the keys.

    A stretch of places in ids and pos, from starts and of so many as counts says, has the key that of names.
    """
    rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, WIDTH)
    of, starts, counts = np.array(of), np.array(starts), np.array(counts)
    least, most = windows(rows, np.array(shared), np.bincount(of, counts).astype(np.int64))
    met = most[of] >= 0
    of, starts, counts = of[met], starts[met], counts[met]
    key = np.repeat(of, counts)
    place = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(len(key))
    ids, at = ids[place], pos[place]
    columns = [np.ascontiguousarray(ids["d"]), np.ascontiguousarray(ids["p"]), at - most[key].astype(np.int32), at + (LENGTH - least[key]).astype(np.int32)]
    for i in range(0, len(key), FLUSH):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + FLUSH]) for x in columns], ["d", "p", "start", "end"])


def _merge(batches):
    """Merges the runs of each range; the ranges arrive in order."""

    def one(blobs):
        readers = [Reader(x) for x in blobs]
        ids, pos = np.concatenate([r.docs for r in readers]), np.concatenate([r.pos for r in readers])
        base, place = 0, {}
        for r in readers:  # where the places of each of its keys begin, and how many they are
            place[id(r)] = ((base + np.cumsum(r.counts) - r.counts).tolist(), r.counts.tolist())
            base += len(r.pos)
            r.docs = r.pos = None
        keys, shared, of, starts, counts, fresh = [], [], [], [], [], 0
        for lcp, r in merged(readers):
            begin, many = place[id(r)]
            fresh += many[r.i]
            if lcp < WIDTH:
                if lcp < 8 + K and keys and fresh >= FLUSH:  # a block ends where another K-gram begins
                    yield from _flush(keys, shared, of, starts, counts, ids, pos)
                    keys, shared, of, starts, counts, fresh = [], [], [], [], [], 0
                keys.append(r.key)
                shared.append(lcp)
            of.append(len(keys) - 1)
            starts.append(begin[r.i])
            counts.append(many[r.i])
        if keys:
            yield from _flush(keys, shared, of, starts, counts, ids, pos)

    now, blobs = None, []
    for batch in batches:
        for where, blob in zip(batch.column("range").to_pylist(), batch.column("run"), strict=True):
            if where != now:
                if blobs:
                    yield from one(blobs)
                now, blobs = where, []
            blobs.append(blob.as_py())
    if blobs:
        yield from one(blobs)


def joined(doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that are in order of doc and start, those joined that touch or overlap."""
    if not len(doc):
        return doc, starts, ends
    far = doc * (int(ends.max()) + 2)
    reach = np.maximum.accumulate(far + ends)
    fresh = np.append(True, far[1:] + starts[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    return doc[first], starts[first], (reach - far)[np.append(first[1:], len(doc)) - 1]


def _clean(batches):
    """Removes each text's runs; without a list of runs nothing goes, whole copies go whole."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for first, last in blocks(offsets):
            part, n = batch.slice(first, last - first), last - first
            begin, size = offsets[first:last] - offsets[first], np.diff(offsets[first : last + 1])
            text = data[offsets[first] : offsets[last]]
            runs = part.column("runs")
            each = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
            doc, found = np.repeat(np.arange(n), each), runs.flatten()  # without those of null lists
            starts, ends = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in found.flatten())
            copy = starts == COPY
            starts, ends = np.where(copy, 0, starts), np.where(copy, size[doc], ends)
            real = ~copy | (ends >= LENGTH)
            doc, starts, ends = joined(doc[real], starts[real], ends[real])
            edge = np.zeros(len(text) + 1, np.int8)
            edge[begin[doc] + starts] += 1
            edge[begin[doc] + ends] -= 1
            rest = text[np.cumsum(edge[:-1], dtype=np.int8) == 0]
            gone = np.bincount(doc, ends - starts, n).astype(np.int64)
            cuts = np.concatenate(([0], np.cumsum(size - gone)))
            digests = [hashlib.sha256(rest[a:b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(rest)])
            columns = [size, gone, np.bincount(doc, minlength=n)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns), pa.array(digests, pa.string()), kept], names)


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortcuts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) per row of docs.

    Null texts are empty. Texts under LENGTH bytes lose nothing. Removed runs that touch
    or overlap are one span. Very long texts are whole, in segments of bounded memory.
    Rows that repeat are copies of each other; rows that share an id, null included, and
    differ in their texts are judged each by its text. Other columns are ignored. The id
    -2**63 stands for null. Without shortcuts every text and stretch goes through the merge.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("p"), "text")
    sampled = written(
        in_arrow(
            docs.select("d", "p", "text", F.unhex(F.sha2("text", 256)).alias("sha")), _anchor_rows(shortcuts),
            "d long, p long, sha binary, n_bytes long, pos array<int>, gram array<long>, stretches array<struct<start:int,end:int>>",
        )
    )
    anchored = sampled.agg(F.sum(F.size("pos"))).first()[0] or 0
    ranges = n * max(1, -(-anchored // (n * RANGE_KEYS)))  # as many for each merge task
    classes = sampled.groupBy("sha").agg(F.min(F.struct("d", "p")).alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    copied = sampled.select("d", "p", "sha").join(classes, "sha")
    copied = copied if shortcuts else copied.limit(0)
    second = copied.where((F.col("d") != F.col("rep.d")) | (F.col("p") != F.col("rep.p"))).select("d", "p")
    points = (
        sampled.join(second, ["d", "p"], "left_anti")
        .select("d", "p", F.explode(F.arrays_zip("pos", "gram")).alias("x")).select("d", "p", "x.pos", "x.gram")
    )
    twice = points.groupBy("gram").count().where("count > 1").select("gram")
    hits = points.join(twice, "gram").groupBy("d", "p").agg(F.array_sort(F.collect_set(F.struct("pos", "gram"))).alias("hits"))
    texts = docs.repartition(n, "d", "p")  # both uses read the same three columns, so Spark moves the texts once
    # The small sides are hashed and the texts stream by: sorting them for a merge would hold them in memory.
    runs = texts.join(hits.hint("shuffle_hash"), ["d", "p"]).select("d", "p", "text", "hits")
    runs = in_arrow(runs, _runs(ranges), "range int, run binary")
    found = in_arrow(runs.repartitionById(n, F.col("range")).sortWithinPartitions("range"), _merge, "d long, p long, start int, end int")
    within = sampled.where(F.size("stretches") > 0).select("d", "p", F.explode("stretches").alias("x")).select("d", "p", "x.start", "x.end")
    copies = copied.select("d", "p", F.lit(COPY).alias("start"), F.lit(0).alias("end"))
    found = found.unionByName(within).unionByName(copies).groupBy("d", "p").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"))
    joined = texts.join(found.hint("shuffle_hash"), ["d", "p"], "left")
    done = joined.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "text", "p", "runs")
    return in_arrow(done, _clean, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
