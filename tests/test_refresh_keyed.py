"""Upserts into the keyed result table, and the dashboard refresh by month."""

import os
import random
import shutil

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kpiframe.plans import incremental as N
from kpiframe.plans import report as R
from kpiframe.streaming import read_current, refresh_every, refresh_once
from kpiframe.streaming import keyed as keyed_module
from kpiframe.streaming.keyed import KeyedTable
from tests.conftest import SF_SMALL

KIND = "k string, j int, n long, s double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder)
               for f in names if f.endswith(".parquet"))


def test_upserts_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(4)
    table = KeyedTable(spark, str(tmp_path / "t"), ["k", "j"], buckets=5)
    want = {}
    for seq in range(9):
        batch = {(rng.choice(["a", "b", None]), rng.choice([None, *range(30)])):
                 (seq * 100 + i, rng.choice([None, 0.5 * i])) for i in range(rng.choice([0, 2, 40]))}
        rows = [(*k, *v) for k, v in batch.items()]
        assert table.upsert(spark.createDataFrame(rows, KIND), seq, "s")
        want.update(batch)
        assert rows_of(table.read()) == sorted(((*k, *v) for k, v in want.items()), key=str)


def test_an_upsert_played_again_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k", "j"])
    table.upsert(spark.createDataFrame([("a", 1, 1, 1.0)], KIND), 0, "s")
    table.upsert(spark.createDataFrame([("a", 1, 2, 2.0), ("b", 1, 1, 1.0)], KIND), 1, "s")
    before = table.manifest()
    assert not table.upsert(spark.createDataFrame([("a", 1, 9, 9.0)], KIND), 1, "s")
    assert not table.upsert(spark.createDataFrame([("a", 1, 9, 9.0)], KIND), 0, "s")
    assert table.manifest() == before
    assert rows_of(table.read()) == [("a", 1, 2, 2.0), ("b", 1, 1, 1.0)]
    # a stream that starts afresh starts from nothing
    assert table.upsert(spark.createDataFrame([("c", 1, 1, 1.0)], KIND), 0, "another")
    assert rows_of(table.read()) == [("c", 1, 1, 1.0)]


def test_a_failed_upsert_leaves_the_table(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k", "j"])
    table.upsert(spark.createDataFrame([("a", 1, 1, 1.0)], KIND), 0, "s")

    def fails(*_):
        raise OSError("no space")

    with monkeypatch.context() as patch:
        patch.setattr(keyed_module, "replace_text", fails)
        with pytest.raises(OSError):
            table.upsert(spark.createDataFrame([("a", 1, 2, 2.0)], KIND), 1, "s")
    assert rows_of(table.read()) == [("a", 1, 1, 1.0)]
    assert table.upsert(spark.createDataFrame([("a", 1, 2, 2.0)], KIND), 1, "s")
    assert rows_of(table.read()) == [("a", 1, 2, 2.0)]


def test_bytes_written_follow_the_new_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, "k", buckets=4)

    def batch(lo, hi, n):
        return spark.range(lo, hi).select(F.concat(F.lit("key-"), "id").alias("k"),
                                          F.lit(n).alias("n"), F.rand(1).alias("s"))

    table.upsert(batch(0, 40000, 1), 0)
    whole = size_of(path)
    written = []
    for seq in range(1, 5):
        before = size_of(path)
        table.upsert(batch(0, 20, seq + 1), seq)
        written.append(size_of(path) - before)
    assert max(written) < whole / 10                      # 20 rows, not 40,000
    got = {r.n: r.c for r in table.read().groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert got == {1: 39980, 5: 20}
    # many small upserts are folded, and what they replaced is deleted
    for seq in range(5, 40):
        table.upsert(batch(0, 4000, seq), seq)
    assert size_of(path) < 4 * whole
    assert all(len(p) < keyed_module.MOST_PARTS for p in table.manifest()["parts"].values())
    assert table.read().count() == 40000


def test_a_reader_keeps_its_state_for_one_upsert(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=1)
    table.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, n long"), 0)
    open_reader = table.read()
    table.upsert(spark.createDataFrame([("a", 2), ("c", 2)], "k string, n long"), 1)   # compacts
    assert rows_of(open_reader) == [("a", 1), ("b", 1)]
    assert rows_of(table.read()) == [("a", 2), ("b", 1), ("c", 2)]


def _write(folder, name, rows):
    pq.write_table(pa.table({"district": [r[0] for r in rows], "n": [r[1] for r in rows]}),
                   os.path.join(folder, name))


def test_keyed_refresh_once_and_every(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()
    kind = "district string, n long"

    def agg(stream):
        return stream.groupBy("district").agg(F.sum("n").alias("n"))

    def once():
        return rows_of(refresh_once(spark, str(src), kind, agg, out, ckpt, keys="district",
                                    max_files=1))

    _write(src, "a.parquet", [("K", 1), ("C", 2)])
    _write(src, "b.parquet", [("K", 3), (None, 7)])
    assert once() == sorted([("K", 4), ("C", 2), (None, 7)], key=str)
    done = KeyedTable(spark, out).manifest()["seq"]
    assert once() == sorted([("K", 4), ("C", 2), (None, 7)], key=str)     # nothing new
    _write(src, "c.parquet", [("N", 5), ("K", 1)])
    assert once() == sorted([("K", 5), ("C", 2), ("N", 5), (None, 7)], key=str)
    now = KeyedTable(spark, out).manifest()
    assert now["seq"] > done
    running = refresh_every(spark, str(src), kind, agg, out, ckpt, "1 second", keys="district")
    try:
        _write(src, "d.parquet", [("C", 1)])
        running.processAllAvailable()
    finally:
        running.stop()
    assert rows_of(read_current(spark, out)) == sorted(
        [("K", 5), ("C", 3), ("N", 5), (None, 7)], key=str)


# ------------------------------------------------------------------ refresh by month

TABLES = ["supplier", "nation", "region", "customer"]


def month_of(column):
    return pc.strftime(column, format="%Y-%m")


@pytest.fixture()
def growing(tmp_path):
    """Source tables with a file of line items per year and of events per ten days."""
    src = tmp_path / "src"
    src.mkdir()
    for t in TABLES:
        shutil.copyfile(f"{SF_SMALL}/{t}.parquet", src / f"{t}.parquet")
    items = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    events = pq.read_table(f"{SF_SMALL}/events.parquet")
    (src / "lineitem.parquet").mkdir()
    (src / "events.parquet").mkdir()
    pieces = {}
    for year in sorted(set(pc.year(items["l_shipdate"]).to_pylist())):
        pieces[f"lineitem.parquet/{year}.parquet"] = items.filter(
            pc.equal(pc.year(items["l_shipdate"]), year))
    # events over three months instead of one
    days = pc.day(events["ts"])
    for k in range(3):
        some = events.filter(pc.equal(pc.bit_wise_and(days, 3), k))
        shifted = pc.add(some["ts"], pa.scalar(31 * 24 * 3600 * 10 ** 9 * k, pa.int64())
                         .cast(pa.duration("ns")).cast(pa.duration(some["ts"].type.unit)))
        pieces[f"events.parquet/{k}.parquet"] = some.set_column(
            some.schema.get_field_index("ts"), "ts", shifted)
    return src, pieces


def add(src, pieces, *names):
    for n in names:
        pq.write_table(pieces[n], src / n)


def check_equals_full(spark, src, out, tmp_path, names=None):
    full = R.refresh(spark, str(src), str(tmp_path / f"full-{random.random()}"))
    for name in names or R.KPIS:
        got, want = N.read_output(spark, out, name), spark.read.parquet(full[name])
        assert sorted(got.columns) == sorted(want.columns)
        got = got.select(*want.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, name


def test_refresh_by_month(spark, tmp_path, growing):
    src, pieces = growing
    out = str(tmp_path / "out")
    years = sorted(n for n in pieces if n.startswith("lineitem"))
    add(src, pieces, *years[:-1], "events.parquet/0.parquet", "events.parquet/2.parquet")
    first = N.refresh_months(spark, str(src), out)
    assert set(first) == {*R.KPIS, "views/facility_month", "views/kpi_panel", "views/training"}
    # nothing new: nothing is written
    assert N.refresh_months(spark, str(src), out) == {}

    # a file of later line items rewrites its own months only
    add(src, pieces, years[-1])
    months = {f"{m}-01" for m in month_of(pieces[years[-1]]["l_shipdate"]).to_pylist()}
    done = N.refresh_months(spark, str(src), out)
    assert set(done) == {"views/facility_month"} | {n for n, v in N.MONTHLY.items()
                                                    if v == "facility_month"}
    assert set(done["views/facility_month"]) == months and set(done["completeness"]) == months
    check_equals_full(spark, src, out, tmp_path, ["referral", "completeness", "stockout_by_item"])

    # events of the month between: it is written, and later surveys are numbered anew
    add(src, pieces, "events.parquet/1.parquet")
    done = N.refresh_months(spark, str(src), out)
    middle = {f"{m}-01" for m in month_of(pieces["events.parquet/1.parquet"]["ts"]).to_pylist()}
    assert set(done["views/kpi_panel"]) == middle and "completeness" not in done
    assert middle < set(done["surveys"])
    check_equals_full(spark, src, out, tmp_path)

    # a file that goes takes its months along
    os.remove(src / years[0])
    N.refresh_months(spark, str(src), out)
    # and a changed dimension concerns every month
    suppliers = pq.read_table(src / "supplier.parquet")
    pq.write_table(suppliers.set_column(suppliers.schema.get_field_index("s_name"), "s_name",
                                        pc.utf8_upper(suppliers["s_name"])), src / "supplier.parquet")
    os.utime(src / "supplier.parquet", (1, 1))
    N.refresh_months(spark, str(src), out)
    check_equals_full(spark, src, out, tmp_path)


def test_rows_without_a_date_are_a_month(spark, tmp_path, growing):
    src, pieces = growing
    out = str(tmp_path / "out")
    name = sorted(n for n in pieces if n.startswith("lineitem"))[0]
    add(src, pieces, name, "events.parquet/0.parquet")
    N.refresh_months(spark, str(src), out)
    some = pieces[name].slice(0, 40)
    none = pa.nulls(len(some), some.schema.field("l_shipdate").type)
    pq.write_table(some.set_column(some.schema.get_field_index("l_shipdate"), "l_shipdate", none),
                   src / "lineitem.parquet" / "undated.parquet")
    done = N.refresh_months(spark, str(src), out)
    assert done["completeness"] == [N.NO_MONTH]
    check_equals_full(spark, src, out, tmp_path, ["completeness", "referral"])


def test_a_failed_refresh_is_done_again(spark, tmp_path, growing, monkeypatch):
    src, pieces = growing
    out = str(tmp_path / "out")
    name = sorted(n for n in pieces if n.startswith("lineitem"))[0]
    add(src, pieces, name, "events.parquet/0.parquet")

    def fails(_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setitem(N.KPIS, "completeness", fails)
        with pytest.raises(RuntimeError):
            N.refresh_months(spark, str(src), out)
    N.refresh_months(spark, str(src), out)
    check_equals_full(spark, src, out, tmp_path, ["completeness", "series"])


def test_month_filter_reaches_the_scan(spark):
    import datetime as dt

    rows = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    some = rows.filter(N.in_months(F.col("l_shipdate"), [dt.date(1996, 1, 1), dt.date(1996, 2, 1)]))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = some._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01" in plan
    assert "LessThan(l_shipdate,1996-03-01" in plan
