"""Numbered changes of many clients, applied in order by a stateful stream with a timing wheel.

A client's changes carry numbers; they may come late, twice or not at all. A change that comes before its turn is held.
If the earliest of the held ones is too old, the missing numbers are given up and the client goes on with the next one
that it holds.

The state is kept by bucket of clients. A bucket has a wheel, which maps each expiry day to the clients whose earliest
held change expires then, and its clients' records. A tick, one row for each bucket and batch, visits only the slots
that are due, jumps the clients in them and puts each into the slot of its new earliest day. Records stay packed until
their client is due or has a change.

Beforehand, and in parallel whatever the clients' sizes, changes get their dense numbers: distinct (client, number)
pairs are dealt by range, and each range is counted on from those before it. The first change of each number is marked
there; all others can only be rejected, so they need no state and are dealt over all buckets.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.udf import reachable
from ..operators.tables import delete, renamed
from ._common import cleared, shared_dir, written

if TYPE_CHECKING:
    import pandas as pd

#: Days that a held change waits after its own day, batches, and clients of a bucket on average.
WAIT, BATCHES, CLIENTS = 3, 12, 256
#: Files of a batch at least, rows of a file beyond that, and rows of a frame that a bucket gives.
FILES, FILE_ROWS, FRAME_ROWS = 8, 250_000, 50_000
_ROWS = "bucket long, batch int, high int, first boolean, client string, change_id long, n long, day int, op string, city string, balance double"
_OUT = "change_id long, client string, status string, batch int, missed long, city string, balance double, current boolean"
_STATE = "wheel binary, clients binary"
_Held = tuple[int, int, str | None, str | None, float | None]


class _Client:
    """What a bucket knows of a client: the next number, values, held changes by number, its slot, and its last change, not yet given out."""

    __slots__ = ("next", "city", "balance", "held", "slot", "last")

    def __init__(self, packed: bytes | None = None):
        self.next, self.city, self.balance, self.held, self.slot, self.last = pickle.loads(packed) if packed else (1, None, None, {}, None, None)

    def packed(self) -> bytes:
        return pickle.dumps((self.next, self.city, self.balance, self.held, self.slot, self.last), 5)

    def run(self, batch: int, missed: int = 0) -> Iterator[tuple]:
        """Applies what is held from the next number on; gives out what is thereby no longer the last."""
        while (change := self.held.pop(self.next, None)) is not None:
            _, change_id, op, city, balance = change
            if op == "D":
                self.city = self.balance = None
            elif op == "I":
                self.city, self.balance = city, balance
            elif op == "U":
                self.city, self.balance = self.city if city is None else city, self.balance if balance is None else balance
            if self.last:
                yield (*self.last[:-1], False)
            self.last = (change_id, batch, missed, self.city, self.balance, op != "D")
            self.next += 1
            missed = 0

    def jump(self, batch: int, high: int | None) -> Iterator[tuple]:
        """Gives missing numbers up while the earliest held day is due; high None: until nothing is held."""
        by_day, by_number, a, b = sorted((x[0], n) for n, x in self.held.items()), sorted(self.held), 0, 0
        while self.held:
            while by_day[a][1] not in self.held:
                a += 1
            if high is not None and by_day[a][0] + WAIT > high:
                break
            while by_number[b] not in self.held:
                b += 1
            missed, self.next = by_number[b] - self.next, by_number[b]
            yield from self.run(batch, missed)


def _frame(client_rows: list[tuple[str | None, tuple]], status: str) -> pd.DataFrame:
    import pandas as pd

    names = ("change_id", "batch", "missed", "city", "balance", "current")
    columns: dict[str, Any] = {c: [r[i] for _, r in client_rows] for i, c in enumerate(names)}
    columns["client"] = [c for c, _ in client_rows]
    columns["status"] = status
    columns["balance"] = pd.array([float("nan") if x is None else x for x in columns["balance"]], "float64")
    return pd.DataFrame(columns)[["change_id", "client", "status", "batch", "missed", "city", "balance", "current"]]


def advanced(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One batch of one bucket: the tick, then the changes; statuses and values go out."""
    wheel: dict[int, set[str | None]]
    packed: dict[str | None, bytes]
    wheel, packed = map(pickle.loads, state.get) if state.exists else ({}, {})
    at: dict[str | None, _Client] = {}
    out: list[tuple[str | None, tuple]] = []

    def client(name: str | None) -> _Client:
        if name not in at:
            at[name] = _Client(packed.get(name))
        return at[name]

    def scheduled(name: str | None, one: _Client) -> None:
        slot = min((x[0] for x in one.held.values()), default=None)
        slot = None if slot is None else slot + WAIT
        if slot != one.slot:
            if one.slot is not None and one.slot in wheel:
                wheel[one.slot].discard(name)
                if not wheel[one.slot]:
                    del wheel[one.slot]
            if slot is not None:
                wheel.setdefault(slot, set()).add(name)
            one.slot = slot

    def tick(batch: int, high: int | None) -> None:
        for slot in sorted(s for s in wheel if high is None or s <= high):
            for name in wheel.pop(slot):
                one = client(name)
                one.slot = None
                out.extend((name, x) for x in one.jump(batch, high))
                scheduled(name, one)

    batch: int | None = None
    touched: set[str | None] = set()
    for frame in frames:
        if not len(frame):
            continue
        if batch is None:
            batch = int(frame["batch"].iloc[0])
            tick(batch, None if batch > BATCHES else int(frame["high"].iloc[0]))
        frame = frame[frame["n"] > 0]  # the tick's own row has no number
        rejected: list[tuple[str | None, tuple]] = []
        columns = [frame[c].tolist() for c in ("client", "change_id", "n", "day", "op", "city", "balance", "first")]
        for name, change_id, n, day, op, city, balance, first in zip(*columns):
            one = client(name) if first else None
            if one is None or n < one.next or n in one.held:
                rejected.append((name, (change_id, batch, 0, None, None, False)))
            else:
                one.held[n] = (day, change_id, op, city, None if balance != balance else balance)
                touched.add(name)
        if rejected:
            yield _frame(rejected, "rejected")
    for name in touched:
        one = client(name)
        out.extend((name, x) for x in one.run(batch))
        scheduled(name, one)
        if len(out) >= FRAME_ROWS:
            yield _frame(out, "applied")
            out.clear()
    if batch is not None and batch > BATCHES:
        for name in {*packed, *at}:
            one = client(name)
            if one.last:
                out.append((name, one.last))
                one.last = None
    packed.update((name, one.packed()) for name, one in at.items())
    for i in range(0, len(out), FRAME_ROWS):
        yield _frame(out[i : i + FRAME_ROWS], "applied")
    state.update((pickle.dumps(wheel, 5), pickle.dumps(packed, 5)))


def _numbered(base: DataFrame) -> DataFrame:
    """Dense numbers of (client_id, seq), and the first of the changes that stay, by day and change_id; no client's pairs meet in one task."""
    pairs = base.groupBy("client_id", "seq").agg(F.min(F.when(F.col("stays"), F.struct("day", "change_id"))).alias("head"))
    ranges = written(pairs.repartitionByRange(F.col("client_id"), F.col("seq")).withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("range", "client_id").count()
    before = F.sum("count").over(Window.partitionBy("client_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("range").alias("_range"), F.col("client_id").alias("_client"), F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("range", "client_id").orderBy("seq"))
    placed = ranges.withColumn("within", within).join(counts, (F.col("range") == F.col("_range")) & F.col("client_id").eqNullSafe(F.col("_client")))
    return placed.select(F.col("client_id").alias("_client"), F.col("seq").alias("_seq"), "head", (F.col("before") + F.col("within")).alias("n"))


def applied(changes: DataFrame, day: Column, stays: Column, first_day: int, days: int) -> DataFrame:
    """Every change that stays, with what became of it: change_id, client_id, status, batch, missed, city, balance, current.

    changes has change_id, client_id, seq, op (I sets city and balance, U what is not null, D nulls both; any other, or
    null, sets nothing), city and balance; day is an int column of it, stays a condition. Repeated rows count once, also
    with regard to further columns, which are not read otherwise. Numbers are dense ranks of seq in a client, nulls
    first, before rows go; a null client_id is one client. Rows without change_id, or whose day or condition is null, go.
    The days from first_day on, days of them, are cut into BATCHES equal batches; earlier days are in the first, later
    ones in the last. Each batch is a start of one streaming query on one checkpoint; a last start gives all else up,
    as batch BATCHES + 1. A balance of NaN counts as null. An empty table gives an empty one.

    The stream's folder is new at each call. A client's own sequence is one key's work, without the repeats of a number;
    nothing else is bound to one task.
    """
    spark = changes.sparkSession
    reachable(spark)
    root = f"{shared_dir(spark)}/sequenced-{uuid.uuid4().hex}"
    with cleared():
        base = changes.distinct().select(
            "change_id", "client_id", "seq", F.col("op").cast("string").alias("op"), F.col("city").cast("string").alias("city"), F.col("balance").cast("double").alias("balance"),
            day.cast("int").alias("day"), F.coalesce(stays & day.isNotNull() & F.col("change_id").isNotNull(), F.lit(False)).alias("stays"),
        )
        batch = F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((F.col("day") - first_day) * BATCHES / days))).cast("int")
        base = written(base.withColumn("batch", batch))
        known = {r["batch"]: (r["day"], r["rows"], r["clients"]) for r in base.where("stays").groupBy("batch").agg(F.max("day").alias("day"), F.count("*").alias("rows"), F.approx_count_distinct("client_id").alias("clients")).collect()}  # a row a batch
        rows = sum(x[1] for x in known.values())
        buckets = max(1, -(-max((x[2] for x in known.values()), default=1) // CLIENTS))
        files = max(FILES, rows // (BATCHES * FILE_ROWS))
        highs = {b: max((known[x][0] for x in known if x < b), default=-(2**31)) for b in range(1, BATCHES + 2)}
        high = F.element_at(F.create_map(*[F.lit(x) for pair in highs.items() for x in pair]), F.col("batch"))

        ranked = base.where("stays").join(_numbered(base), F.col("client_id").eqNullSafe(F.col("_client")) & F.col("seq").eqNullSafe(F.col("_seq")))
        first = F.col("head") == F.struct("day", "change_id")
        bucket = F.pmod(F.when(first, F.xxhash64("client_id")).otherwise(F.xxhash64("change_id")), F.lit(buckets))
        fed = ranked.select(
            bucket.alias("bucket"), "batch", high.alias("high"), first.alias("first"), F.col("client_id").cast("string").alias("client"), "change_id", "n", "day", "op", "city", "balance"
        )
        ticks = spark.range(buckets * (BATCHES + 1)).select((F.col("id") % buckets).alias("bucket"), (1 + F.floor(F.col("id") / buckets)).cast("int").alias("batch"))
        ticks = ticks.select("bucket", "batch", high.alias("high"), F.lit(False).alias("first"), F.lit(None).cast("string").alias("client"), F.lit(0).cast("long").alias("change_id"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("day"), *[F.lit(None).cast(t).alias(c) for c, t in (("op", "string"), ("city", "string"), ("balance", "double"))])
        share = F.pmod(F.xxhash64("change_id", "bucket"), F.lit(files))
        both = fed.unionByName(ticks).withColumns({"lot": F.col("batch"), "share": share})
        both.repartition(files * (BATCHES + 1), "lot", "share").drop("share").write.partitionBy("lot").parquet(f"{root}/batches")

    for at in range(1, BATCHES + 2):  # each start sees one batch more
        renamed(spark, f"{root}/batches/lot={at}", f"{root}/feed/lot={at}")
        stream = spark.readStream.schema(_ROWS).parquet(f"{root}/feed").drop("lot")
        given = stream.groupBy("bucket").applyInPandasWithState(advanced, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
        query = given.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    delete(spark, f"{root}/feed")
    delete(spark, f"{root}/state")
    out = spark.read.schema(_OUT).parquet(f"{root}/out")
    key = dict(changes.dtypes)["client_id"]
    return out.select("change_id", F.col("client").cast(key).alias("client_id"), "status", "batch", "missed", "city", F.when(~F.isnan("balance"), F.col("balance")).alias("balance"), "current")
