"""The applier of numbered changes against a plain simulation, change by change."""

import datetime
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attesto.llm import oracles, registry, sequenced

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def simulated(rows):
    """rows: distinct (change_id, client_id, seq, op, valid_at, ..., city, balance)."""
    seqs, batches = defaultdict(set), defaultdict(list)
    for r in rows:
        seqs[r[1]].add(r[2])
    for change_id, client, seq, op, valid_at, _, _, city, balance in rows:
        h = zlib.crc32(str(change_id).encode())
        if valid_at is None or h % 11 == 0 or change_id is None:
            continue
        day = (valid_at.date() - datetime.date(1970, 1, 1)).days + 9 * (h % 4)
        n = 1 + sorted(seqs[client], key=lambda s: (s is not None, s or 0)).index(seq)
        batches[max(1, min(12, 1 + (day - 19723) * 12 // 160))].append((day, change_id, client, n, op, city, None if balance != balance else balance))
    following, held, values, last, out = defaultdict(lambda: 1), defaultdict(dict), {}, {}, {}

    def run(client, batch, missed=0):
        while following[client] in held[client]:
            _, change_id, op, city, balance = held[client].pop(following[client])
            old = values.get(client, (None, None))
            values[client] = (city, balance) if op == "I" else (old[0] if city is None else city, old[1] if balance is None else balance) if op == "U" else (None, None) if op == "D" else old
            c, b = values[client]
            out[change_id] = [client, "applied", batch, missed, c, None if b is None else math.floor(100 * b + 0.5), False]
            last[client], missed = (change_id, op), 0
            following[client] += 1

    high = None
    for batch in range(1, 14):
        for client in [*held]:
            while held[client] and (batch == 13 or high is not None and min(x[0] for x in held[client].values()) + 3 <= high):
                n = min(held[client])
                missed, following[client] = n - following[client], n
                run(client, batch, missed)
        for day, change_id, client, n, op, city, balance in sorted(batches[batch], key=lambda r: r[:2]):
            if n < following[client] or n in held[client]:
                out[change_id] = [client, "rejected", batch, 0, None, None, False]
            else:
                held[client][n] = (day, change_id, op, city, balance)
                run(client, batch)
            high = day if high is None else max(high, day)
    for change_id, op in last.values():
        out[change_id][6] = op != "D"
    return out


def changes(seed, n, clients, spread):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        client = r.choice([0, 0, r.randrange(clients), None if r.random() < 0.1 else r.randrange(clients)])
        seq = None if r.random() < 0.01 else r.randrange(spread)
        at = None if r.random() < 0.03 else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=r.randrange(-3, 130) if r.random() < 0.1 else min(129, (seq or 0) * 130 // spread + r.randrange(8)), hours=r.randrange(24))
        op = r.choice("IUUUUUUDX") if r.random() < 0.97 else None
        rows.append((i * 7 - 50, client, seq, op, at, r.choice("ab"), None, r.choice(["Ur", "Uruk", None, ""]), r.choice([None, 1.005, -3.5, 0.0, 99.994, float("nan"), 1e9])))
    return rows


def test_operator_is_the_simulation(spark, tmp_path, monkeypatch):
    """Nulls anywhere, ties, repeated rows, a hot client, unknown operations, dates before the first batch."""
    monkeypatch.setattr(sequenced, "CLIENTS", 8)  # several buckets
    rows = changes(3, 1500, 40, 300)
    spark.createDataFrame([*rows, *rows[:200]], SCHEMA).write.parquet(str(tmp_path / "client_changes.parquet"))
    want = simulated(rows)
    got = {r.change_id: [r.client_id, r.status, r.batch, r.missed, r.city, r.cents, r.current] for r in registry.op11_change_applier(spark, str(tmp_path)).collect()}
    assert got == want
    assert {x[1] for x in want.values()} == {"applied", "rejected"} and any(x[3] for x in want.values()) and any(x[2] == 13 for x in want.values())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW client_changes AS SELECT * FROM '{tmp_path}/client_changes.parquet/*.parquet' WHERE valid_at IS NULL OR valid_at >= '2024-01-01'")
    early = [r for r in rows if r[4] is None or r[4] >= datetime.datetime(2024, 1, 1)]
    assert {r[0]: [r[1], *r[2:]] for r in db.execute(oracles.CHANGE_APPLIER).fetchall()} == simulated(early)


def test_extra_columns_and_an_empty_table(spark):
    rows = [(1, 5, 1, "I", 10, "A", 1.0, 0), (1, 5, 1, "I", 10, "A", 1.0, 0), (2, 5, 3, "U", 11, None, 2.0, 0), (None, 5, 2, "U", 11, "B", 2.0, 0)]
    frame = spark.createDataFrame(rows, "change_id long, client_id long, seq long, op string, day int, city string, balance double, bucket int")
    got = sequenced.applied(frame, F.col("day"), F.lit(True), 0, 160).orderBy("change_id").collect()
    assert [tuple(r) for r in got] == [(1, 5, "applied", 1, 0, "A", 1.0, False), (2, 5, "applied", 13, 1, "A", 2.0, True)]
    assert sequenced.applied(frame.limit(0), F.col("day"), F.lit(True), 0, 160).count() == 0


class _State:
    """What a bucket's function sees of Spark's state."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_a_tick_opens_only_clients_that_are_due(monkeypatch):
    import pickle

    opened = []
    real = sequenced._Client.__init__
    monkeypatch.setattr(sequenced._Client, "__init__", lambda self, packed=None: (opened.append(packed), real(self, packed))[1])
    state = _State()
    names = ["batch", "high", "first", "client", "change_id", "n", "day", "op", "city", "balance"]
    rows = [(1, 0, True, str(c), c, 2, 10 + c, "I", "x", 1.0) for c in range(50)]
    assert not [*sequenced.advanced((0,), iter([pd.DataFrame(rows, columns=names)]), state)]
    wheel = pickle.loads(state.get[0])
    assert sorted(wheel) == [13 + c for c in range(50)]
    opened.clear()
    tick = pd.DataFrame([(2, 15, False, None, 0, 0, 0, None, None, None)], columns=names)
    out = [*sequenced.advanced((0,), iter([tick]), state)]
    assert len(opened) == 3 and not out  # three slots are due; each client's last change is still kept back
    assert sorted(pickle.loads(state.get[0])) == [16 + c for c in range(47)]


@pytest.mark.parametrize("high", [None, 40])
def test_jumps_are_those_of_a_plain_loop(high):
    r = random.Random(9)
    for _ in range(200):
        one = sequenced._Client()
        one.held = {n: (r.randrange(60), n, "U", None, float(n)) for n in r.sample(range(2, 40), r.randrange(1, 12))}
        held, following, want = dict(one.held), 1, []
        while held and (high is None or min(x[0] for x in held.values()) + 3 <= high):
            n = min(held)
            missed, following = n - following, n
            while following in held:
                held.pop(following)
                want.append((following, missed))
                missed, following = 0, following + 1
        got = [*one.jump(4, high)]
        assert [(x[0], x[2]) for x in got] + ([(one.last[0], one.last[2])] if one.last else []) == want and one.held == held and one.next == following
