"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted, each with a cost. Texts longer than the largest
are cut into full pieces and a rest. Pieces are packed longest first: a piece goes to the
open bin, of whatever capacity, with the least room that holds it; if none does, the bin
size of least cost is opened. What that is depends on what is still to come, so each
shard is packed under several opening rules and the cheapest packing is kept. At last
each bin is downsized to the least permitted length that holds its contents.

Shards are a hash of a row's number and piece, so no id, source or length is a task of its
own, however often it occurs; rows are numbered when their lengths are written, so a task
that runs again deals them as before. The number of shards follows the number of pieces,
and a shard is one task's work in memory of a few bytes a piece. Only ids and lengths are
packed and moved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_arrow, partitions, written
from .mixing import words

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin of capacity c: c + c * c / ATTENTION + FIXED.
ATTENTION, FIXED = 65_536, 8
#: Pieces of a shard, about.
SHARD = 20_000


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION + FIXED


def _fit(lengths: list[int], sizes: tuple[int, ...], choose) -> tuple[list[int], list[int]]:
    """Bin of each length (longest first) and each bin's used tokens. choose(length, tokens left) opens a size."""
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    used: list[int] = []
    bins: list[int] = []
    left = sum(lengths)
    for n in lengths:
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms ^= 1 << room
        else:
            b, room = len(used), choose(n, left)
            used.append(0)
        used[b] += n
        bins.append(b)
        left -= n
        room -= n
        if room:
            rooms |= 1 << room
            by_room.setdefault(room, []).append(b)
    return bins, used


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin of each of the lengths, which are sorted downwards; used tokens and capacity of each bin.

    The rules that compete: open the least size that holds the piece; for each size, open
    it if the piece fits, else the next larger; and open the size of least cost for each
    token that it can still get, given the tokens left.
    """
    sizes = tuple(sorted(capacities))
    costs = {c: cost(c) for c in sizes}
    fitting = [next((c for c in sizes if c >= n), sizes[-1]) for n in range(sizes[-1] + 1)]
    rules = [lambda n, left, c=c: max(c, fitting[n]) for c in sizes]
    rules.append(lambda n, left: min((c for c in sizes if c >= n), key=lambda c: costs[c] / min(c, left)))
    lengths = lengths.tolist()
    best = None
    for rule in rules:
        bins, used = _fit(lengths, sizes, rule)
        final = [fitting[u] for u in used]
        total = sum(costs[c] for c in final)
        if best is None or total < best[0]:
            best = total, bins, used, final
    return best[1:]


def _pack(capacities: tuple[int, ...]):
    def one(shard, known, ids, pieces, lengths):
        order = np.lexsort((pieces, ids, known, -lengths))
        known, ids, pieces, lengths = known[order], ids[order], pieces[order], lengths[order]
        bins, used, final = best_fit(lengths, capacities)
        bins = np.array(bins)
        by_bin = np.argsort(bins, kind="stable")
        b, n = bins[by_bin], lengths[by_bin]
        first = np.flatnonzero(np.diff(b, prepend=-1))
        before = np.cumsum(n) - n
        counts = np.diff(np.append(first, len(b)))
        offset = before - np.repeat(before[first], counts)
        slot = np.arange(len(b)) - np.repeat(first, counts)
        names = ["shard", "bin", "capacity", "used", "slot", "offset", "piece", "n_tokens"]
        columns = [np.full(len(b), shard), b, np.array(final)[b], np.array(used)[b], slot, offset, pieces[by_bin], n]
        arrays = [pa.array(c, pa.int32()) for c in columns] + [pa.array(ids[by_bin], pa.int64(), mask=~known[by_bin])]
        return pa.RecordBatch.from_arrays(arrays, [*names, "id"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            shard, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "known", "id", "piece", "n"))
            cuts = np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1)) if len(shard) else []
            for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                if shard[a] != now:
                    if held:
                        yield one(now, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    now, held = shard[a], []
                held.append([x[a:b] for x in rest])
        if held:
            yield one(now, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def packed(docs: DataFrame, tokens=None, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", extra: int = 1, shard: int = SHARD) -> DataFrame:
    """A row for each piece: shard, bin, capacity, used, slot, offset, doc_id, piece, start, n_tokens.

    Every token of every row is in one piece: piece p starts at token p * max(capacities).
    A row has its tokens (by default its words) and extra, an end mark, so null and empty
    texts have extra tokens. Rows that repeat are packed each, and dealt to shards each by
    itself. A null id is packed and comes back null. With no rows there are no bins.
    """
    tokens = words() if tokens is None else tokens
    largest = max(capacities)
    own = F.col(id_col).cast("long")
    rows = written(docs.select(own.alias("id"), (tokens + extra).cast("long").alias("n"), F.monotonically_increasing_id().alias("at")))
    count = rows.agg(F.sum(F.ceil(F.col("n") / largest))).first()[0] or 0
    shards = max(1, -(-int(count) // shard))
    pieces = rows.where("n > 0").select(
        "at", "n", F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"),
        F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / largest) - 1).cast("int"))).alias("piece"),
    )
    pieces = pieces.select(
        F.pmod(F.xxhash64("at", "piece"), F.lit(shards)).cast("int").alias("shard"), "known", "id", "piece", F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("long").alias("n")
    )
    done = in_arrow(
        pieces.repartition(partitions(docs.sparkSession), "shard").sortWithinPartitions("shard"), _pack(tuple(capacities)),
        "shard int, bin int, capacity int, used int, slot int, offset int, piece int, n_tokens int, id long",
    )
    return done.select("shard", "bin", "capacity", "used", "slot", "offset", F.col("id").alias("doc_id"), "piece", (F.col("piece").cast("long") * largest).alias("start"), "n_tokens")


def bins(placed: DataFrame) -> DataFrame:
    """A row for each bin of packed(): shard, bin, capacity, used, doc_ids and starts in order of their slots."""
    parts = F.array_sort(F.collect_list(F.struct("slot", "doc_id", "start", "n_tokens")))
    rows = placed.groupBy("shard", "bin", "capacity", "used").agg(parts.alias("parts"))
    return rows.select("shard", "bin", "capacity", "used", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("starts"), F.col("parts.n_tokens").alias("lengths"))
