import random
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from quire.operators.scan import Skew
from quire.streaming import settle as st

SCHEMA = "key string, ts timestamp, seq bigint, kind string, state string, disk_mtime bigint, disk_size bigint"
T0 = datetime(2024, 1, 1)


def rows(n, seed):
    r = random.Random(seed)
    return [
        (f"k{r.randrange(4)}", T0 + timedelta(minutes=7 * i), i, st.OBSERVE, r.choice(["current", "changed", "missing", None]), r.randrange(2), 1)
        for i in range(n)
    ]


def replay(data):
    states, out = {}, []
    for row in data:
        o = SimpleNamespace(**dict(zip(["key", "ts", "seq", "kind", "state", "disk_mtime", "disk_size"], row)))
        states[o.key], emitted = st.advance(states.get(o.key, st._START), o)
        if emitted:
            out.append((o.key, o.seq))
    return sorted(out)


def test_batch_form_equals_the_sequential_rule(spark):
    data = rows(600, 3)
    df = spark.createDataFrame(data, SCHEMA)
    for skew in (Skew(), Skew(max_group_rows=1)):
        got = sorted((r.key, r.seq) for r in st.settle_batch(df, skew).collect())
        assert got == replay(data) and len(got) > 30


def test_resync_forget_and_stale_rows():
    def feed(*steps):
        state, out = st._START, []
        for seq, kind, s, m in steps:
            state, hit = st.advance(state, SimpleNamespace(seq=seq, kind=kind, state=s, disk_mtime=m, disk_size=0))
            out.append(hit)
        return out

    o = st.OBSERVE
    assert feed((1, o, "changed", 1), (2, o, "changed", 2), (3, o, "changed", 3), (4, o, "changed", 3), (5, o, "changed", 3)) == [False, True, False, True, False]
    assert feed((1, o, "current", 0), (2, o, "current", 0), (3, st.RECORD, "current", 0), (4, o, "current", 0), (5, o, "current", 0)) == [False] * 4 + [True]
    assert feed((1, o, "missing", 0), (2, o, None, 0), (3, o, "missing", 0), (4, o, "missing", 0)) == [False, False, False, True]
    assert feed((5, o, "missing", 0), (6, st.FORGET, None, 0), (4, o, "missing", 0), (7, o, "missing", 0), (8, o, "missing", 0)) == [False] * 4 + [True]


def test_stale_and_current(spark):
    df = spark.createDataFrame([("a", 1, 5, "changed"), ("a", 2, 5, "missing"), ("a", 3, 7, "current"), ("b", 4, 1, "missing")],
                               "key string, arrival bigint, seq bigint, state string")
    kept = st.drop_stale(df)
    assert sorted((r.key, r.arrival) for r in kept.collect()) == [("a", 1), ("a", 3), ("b", 4)]
    status = st.current_status(kept.withColumns({"disk_mtime": F.lit(0), "disk_size": F.lit(0)}))
    assert [(r.key, r.state) for r in status.collect()] == [("b", "missing")]


def test_crossed_times_and_sequences_agree(spark):
    import datetime as dt
    import random

    rng = random.Random(5)
    at = dt.datetime(2024, 1, 1)
    rows = []
    for seq in range(60):
        state = rng.choice(["current", "changed", "missing", None])
        # Times fall now and then while the sequence rises; some rows come twice.
        row = ("a", at + dt.timedelta(seconds=rng.randrange(600)), seq, "observe", state, rng.randrange(2), 0)
        rows += [row, (*row[:1], row[1] + dt.timedelta(seconds=1), *row[2:])] if rng.random() < 0.2 else [row]
    state, want = st._START, []
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        o = SimpleNamespace(**dict(zip(["key", "ts", "seq", "kind", "state", "disk_mtime", "disk_size"], row)))
        state, hit = st.advance(state, o)
        if hit:
            want.append(o.seq)
    got = sorted(r.seq for r in st.settle_batch(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == want


def test_controls_in_batch_equal_the_sequential_rule(spark):
    r = random.Random(9)
    data = [
        (f"k{r.randrange(3)}", T0 + timedelta(minutes=i), i, r.choice([st.OBSERVE] * 8 + [st.RECORD, st.FORGET]),
         r.choice(["current", "changed", "missing", None]), r.randrange(2), 1)
        for i in range(500)
    ]
    df = spark.createDataFrame(data, SCHEMA)
    for skew in (Skew(), Skew(max_group_rows=1, chunk_rows=40)):
        got = sorted((x.key, x.seq) for x in st.settle_batch(df, skew).collect())
        assert got == replay(data) and len(got) > 20


def test_status_table_and_repeated_epochs(spark, tmp_path):
    table = st.StatusTable(str(tmp_path / "status"), buckets=4)
    frame = lambda *rows: spark.createDataFrame([(k, s, 0, 0, n) for k, s, n in rows], "key string, state string, disk_mtime bigint, disk_size bigint, seq bigint")
    shown = lambda: sorted((r.key, r.state, r.seq) for r in table.read(spark).collect())
    assert shown() == []
    table.upsert(frame(("a", "missing", 1), ("b", "changed", 2), ("c", "missing", 3)), 0)
    second = frame(("a", "current", 4), ("b", "missing", 1), ("d", "changed", 5))
    table.upsert(second, 1)
    want = [("b", "changed", 2), ("c", "missing", 3), ("d", "changed", 5)]
    assert shown() == want
    files = sorted(str(p) for p in (tmp_path / "status").rglob("bucket=*/epoch=*"))
    table.upsert(second, 1)
    assert shown() == want and files == sorted(str(p) for p in (tmp_path / "status").rglob("bucket=*/epoch=*"))
    table.upsert(frame(("a", "missing", 9)), 2)
    # Only the bucket of the one key has a third version.
    assert shown() == [("a", "missing", 9), *want] and len(list((tmp_path / "status").rglob("epoch=2"))) == 1


def test_a_key_asks_its_state_once():
    from pyspark.sql import Row

    from quire.streaming.settle import DropStale

    class Held:
        def __init__(self):
            self.value, self.calls = None, []

        def exists(self):
            self.calls.append("exists")
            return self.value is not None

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    drop = DropStale()
    drop._most = held = Held()
    rows = [Row(key="k", arrival=2, seq=1), Row(key="k", arrival=1, seq=5), Row(key="k", arrival=3, seq=6)]
    assert [tuple(r) for r in drop.handleInputRows(("k",), iter(rows), None)] == [("k", 1, 5), ("k", 3, 6)]
    assert list(drop.handleInputRows(("k",), iter([Row(key="k", arrival=4, seq=6)]), None)) == []
    assert held.calls == ["get", "update", "get"] and held.value == (6,)
    drop._most = Held()
    rows = [Row(key="k", arrival=1, seq=None), Row(key="k", arrival=2, seq=3), Row(key="k", arrival=4, seq=None), Row(key="k", arrival=5, seq=4)]
    assert [r.arrival for r in drop.handleInputRows(("k",), iter(rows), None)] == [1, 2, 5]
