"""Sources, sinks, generators and the incremental refresh."""

import datetime as dt
import os

import pytest
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from kpiframe.session import scratch_path, shared_dir
from kpiframe.sources import files as S
from kpiframe.sources import generators as G
from kpiframe.sources.literals import KPI_DICTIONARY_ROWS, kpi_dictionary
from kpiframe.streaming import read_current, refresh_once

SCHEMA = "district string, facility string, amoxyl double"


def test_csv_write_if_absent_and_read(spark):
    path = scratch_path(spark, "t_csv")
    df = spark.createDataFrame([("Kasama", "F1", 3.0), ("Kasama", "F2", None)], SCHEMA)
    S.write_if_absent(df, path)
    S.write_if_absent(df.limit(0), path)           # second call must not replace the data
    back = S.read_table(spark, path, SCHEMA)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_read_many_remembers_file(spark):
    base = scratch_path(spark, "t_many")
    for name in ["Chisamba", "Ngabwe"]:
        S.write_csv(spark.createDataFrame([(name, "F", 1.0)], SCHEMA).coalesce(1), f"{base}/{name}")
    many = S.read_many(spark, f"{base}/*/*.csv", SCHEMA)
    got = {(r.district, r.source_file.split("/")[-2]) for r in many.collect()}
    assert got == {("Chisamba", "Chisamba"), ("Ngabwe", "Ngabwe")}


def test_shared_dir_reads_session_setting(spark):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None)
                                 or spark.sparkContext.getCheckpointDir()).rstrip("/")


def test_kpi_dictionary(spark):
    d = kpi_dictionary(spark)
    assert d.count() == 20 == len(KPI_DICTIONARY_ROWS)
    dis = {r.kpi: r.disaggregation for r in d.collect()}
    assert dis["RHCC2"] == "disease" and dis["RHCC3"] == "cadre" and dis["RHCC15"] == ""
    main = {r.kpi: r for r in kpi_dictionary(spark, "main").collect()}
    assert len(main) == 19 and "RHCC1.1" not in main
    assert main["RHCC2"].disaggregation == "" and main["RHCC12"].disaggregation == "disease"
    assert "commodities" in main["RHCC12"].description


def test_panel_grid_explodes_without_join(spark):
    ents = spark.createDataFrame([("DRC",), ("MOZ",)], "adm0 string")
    grid = G.panel_grid(ents, "2020-01-01", "2020-04-01")
    assert grid.count() == 8
    assert {r.period for r in grid.collect()} == {dt.date(2020, m, 1) for m in range(1, 5)}
    assert "CartesianProduct" not in grid._jdf.queryExecution().executedPlan().toString()


def test_demo_sample_moments_and_partition_invariance(spark):
    keys = spark.range(200000).select(F.col("id").alias("k"))
    s = G.demo_sample(keys, ["k"], seed=123, lam=5.0)
    m = s.agg(F.avg("x"), F.stddev("x"), F.avg("y"), F.avg("z"), F.variance("z"), F.min("z")).first()
    assert abs(m[0]) < 0.02 and abs(m[1] - 1) < 0.02 and abs(m[2]) < 0.02
    assert abs(m[3] - 5) < 0.05 and abs(m[4] - 5) < 0.1 and m[5] >= 0
    a = {r.k: (r.x, r.z) for r in G.demo_sample(keys.limit(1000), ["k"]).collect()}
    b = {r.k: (r.x, r.z) for r in G.demo_sample(keys.limit(1000).repartition(7), ["k"]).collect()}
    assert a == b


def _write(folder, name, rows):
    tbl = pa.table({"district": [r[0] for r in rows], "facility": [r[1] for r in rows],
                    "amoxyl": [r[2] for r in rows]})
    pq.write_table(tbl, os.path.join(folder, name))


def test_refresh_once_is_incremental(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def agg(stream):
        return stream.groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.sum("amoxyl").alias("s"))

    _write(src, "a.parquet", [("K", "F1", 1.0), ("K", "F2", 2.0), ("C", "F3", None)])
    r1 = {r.district: (r.n, r.s) for r in refresh_once(spark, str(src), SCHEMA, agg, out, ckpt).collect()}
    assert r1 == {"K": (2, 3.0), "C": (1, None)}
    _write(src, "b.parquet", [("K", "F4", 4.0), ("N", "F5", 5.0)])
    r2 = {r.district: (r.n, r.s) for r in refresh_once(spark, str(src), SCHEMA, agg, out, ckpt).collect()}
    assert r2 == {"K": (3, 7.0), "C": (1, None), "N": (1, 5.0)}
    # nothing new: the result stays the same
    r3 = {r.district: (r.n, r.s) for r in refresh_once(spark, str(src), SCHEMA, agg, out, ckpt).collect()}
    assert r3 == r2


def test_ingest_facility_reports(spark):
    from kpiframe.plans.ingest import facility_reports
    from kpiframe.sources.literals import AGGREGATE_UNIT_NAMES

    base = scratch_path(spark, "t_ingest")
    raw = "`Organisation unit name` string, `Period Name` string, `Zinc` double, `ORS` double"
    files = {
        "Chisamba": [("ce Chisamba District", "July 2025", 9.0, 9.0), ("Fac A", "July 2025", 0.0, 2.0)],
        "Ngabwe": [("Fac B", "August 2025", None, 1.0), ("ce Ngabwe District", "August 2025", 1.0, 1.0)],
        "Kasama": [("Fac C", "September 2025", 3.0, None), (None, "July 2025", 1.0, 1.0)],
    }
    for district, rows in files.items():
        S.write_csv(spark.createDataFrame(rows, raw).coalesce(1), f"{base}/{district}")
    out = facility_reports(spark, f"{base}/*/*.csv", raw, exclude=AGGREGATE_UNIT_NAMES)
    assert out.columns == ["district", "facility", "period", "periodname", "zinc", "ors"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == [
        ("Chisamba", "Fac A", dt.date(2025, 7, 1), "July 2025", 0.0, 2.0),
        ("Kasama", "Fac C", dt.date(2025, 9, 1), "September 2025", 3.0, None),
        ("Ngabwe", "Fac B", dt.date(2025, 8, 1), "August 2025", None, 1.0),
    ]


def test_refresh_every_polls(spark, tmp_path):
    from kpiframe.streaming import refresh_every

    src = tmp_path / "in"
    src.mkdir()
    _write(src, "a.parquet", [("K", "F1", 1.0), ("K", "F2", 2.0)])
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = refresh_every(spark, str(src), SCHEMA,
                      lambda s: s.groupBy("district").agg(F.count(F.lit(1)).alias("n")),
                      out, ckpt, interval="1 second")
    try:
        q.processAllAvailable()
        _write(src, "b.parquet", [("K", "F3", 3.0)])
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.district: r.n for r in read_current(spark, out).collect()} == {"K": 3}


def test_scale_conf_sizes_partitions():
    from kpiframe.session import scale_conf

    big = scale_conf(100 * 1024 ** 4, cores=8000)           # 100 TB on 8,000 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (128 * 1024 ** 2)
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 ** 2)
    small = scale_conf(10 * 1024 ** 2, cores=8)              # 10 MB locally
    assert int(small["spark.sql.shuffle.partitions"]) == 24


def test_refresh_once_in_several_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(4):
        _write(src, f"p{i}.parquet", [("K", f"F{i}", float(i)), ("C", f"G{i}", 1.0)])
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def agg(stream):
        return stream.groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.sum("amoxyl").alias("s"))

    # one file per micro-batch: the running aggregate must still cover all four
    got = {r.district: (r.n, r.s) for r in
           refresh_once(spark, str(src), SCHEMA, agg, out, ckpt, max_files=1).collect()}
    assert got == {"K": (4, 6.0), "C": (4, 4.0)}


def test_read_table_parquet(spark):
    path = scratch_path(spark, "t_parquet")
    spark.createDataFrame([("a", 1.0)], SCHEMA.replace("facility string, ", "")).write.parquet(path)
    back = S.read_table(spark, path, fmt="parquet")
    assert [tuple(r) for r in back.collect()] == [("a", 1.0)]


def test_scale_conf_keys_are_spark_settings(spark):
    from kpiframe.session import scale_conf

    conf = scale_conf(10 * 1024 ** 4, cores=800)
    defined = {r[0] for r in spark.sql("SET -v").collect()}   # every defined SQL setting
    assert set(conf) <= defined, set(conf) - defined


def test_session_conf_layers():
    from kpiframe.session import DEFAULT_CONF, session_conf

    assert session_conf() == DEFAULT_CONF
    c = session_conf(shuffle_partitions=16, input_bytes=1024 ** 4, cores=100,
                     extra={"spark.sql.adaptive.skewJoin.skewedPartitionFactor": "8"})
    assert c["spark.sql.shuffle.partitions"] == "16"                 # explicit width wins
    assert c["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(128 * 1024 ** 2)
    assert c["spark.sql.adaptive.skewJoin.skewedPartitionFactor"] == "8"  # extra wins
    assert c["spark.sql.adaptive.enabled"] == "true"


def _csv(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_csv_columns_in_another_order_are_refused(spark, tmp_path):
    _csv(tmp_path, "a.csv", "unit,zinc,ors\nA,1,2\n")
    _csv(tmp_path, "b.csv", "unit,ors,zinc\nB,20,10\n")
    schema = "unit string, zinc double, ors double"
    good = S.read_table(spark, str(tmp_path / "a.csv"), schema).collect()
    assert [tuple(r) for r in good] == [("A", 1.0, 2.0)]
    with pytest.raises(Exception, match="(?i)header"):
        S.read_many(spark, str(tmp_path / "*.csv"), schema).collect()


def test_csv_bad_number_is_an_error(spark, tmp_path):
    _csv(tmp_path, "a.csv", "unit,zinc\nA,abc\nB,\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_table(spark, str(tmp_path / "a.csv"), "unit string, zinc double").collect()
    lenient = S.read_table(spark, str(tmp_path / "a.csv"), "unit string, zinc double",
                           mode="PERMISSIVE").collect()
    assert [tuple(r) for r in lenient] == [("A", None), ("B", None)]


def test_ingest_district_from_file_name(spark, tmp_path):
    from kpiframe.plans.ingest import facility_reports

    for district, unit in (("Chisamba", "Fac A"), ("North Kasama", "Fac B")):
        _csv(tmp_path / "csv", f"{district}_data_sept25.csv",
             f"organisationunitname,periodname,Zinc\n{unit},July 2025,1\n,July 2025,2\n")
    raw = "organisationunitname string, periodname string, Zinc double"
    out = facility_reports(spark, str(tmp_path / "csv" / "*.csv"), raw, district_from="file")
    assert sorted(map(tuple, out.collect())) == [
        ("Chisamba", "Fac A", dt.date(2025, 7, 1), "July 2025", 1.0),
        ("North Kasama", "Fac B", dt.date(2025, 7, 1), "July 2025", 1.0)]


def test_ingest_district_from_folder_with_blank_and_missing(spark, tmp_path):
    from kpiframe.plans.ingest import facility_reports

    head = "Organisation unit name,Period Name,Zinc\n"
    _csv(tmp_path / "North Kasama", "a.csv", head + "Fac A,July 2025,1\n")
    _csv(tmp_path / "District=__HIVE_DEFAULT_PARTITION__", "a.csv", head + "Fac B,July 2025,2\n")
    raw = "`Organisation unit name` string, `Period Name` string, Zinc double"
    out = facility_reports(spark, str(tmp_path / "*" / "*.csv"), raw)
    assert {(r.district, r.facility) for r in out.collect()} == {("North Kasama", "Fac A"),
                                                                 (None, "Fac B")}


def test_poisson_any_lam_in_range(spark):
    keys = spark.range(20000).select(F.col("id").alias("k"))
    for lam in (0.0, 0.5, 150.0):
        m = G.demo_sample(keys, ["k"], lam=lam).agg(F.avg("z"), F.variance("z")).first()
        assert abs(m[0] - lam) < 0.05 + lam / 100 and abs(m[1] - lam) < 0.05 + lam / 15
    with pytest.raises(ValueError):
        G.poisson_thresholds(800.0)


def test_shared_dir_refuses_a_cluster_without_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from kpiframe import session

    class Conf:
        def get(self, key, default=None):
            return default

    def fake(master):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None,
                             setCheckpointDir=lambda path: None)
        return SimpleNamespace(conf=Conf(), sparkContext=sc)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: "/tmp/unused")
    assert session.shared_dir(fake("local[2]")) == "/tmp/unused"
    session._scratch.remove("/tmp/unused")


def test_scratch_is_removed(spark):
    from kpiframe import session

    mine, session._scratch[:] = list(session._scratch), []
    path = scratch_path(spark, "t_gone")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path.removeprefix("file:"))
    session.remove_scratch()
    assert not os.path.exists(path.removeprefix("file:"))
    session._scratch[:] = mine


def test_reader_sees_a_whole_result_during_a_refresh(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def agg(stream):
        return stream.groupBy("district").agg(F.count(F.lit(1)).alias("n"))

    _write(src, "a.parquet", [("K", "F1", 1.0)])
    before = refresh_once(spark, str(src), SCHEMA, agg, out, ckpt)   # a reader that is still open
    _write(src, "b.parquet", [("K", "F2", 1.0), ("C", "F3", 1.0)])
    after = refresh_once(spark, str(src), SCHEMA, agg, out, ckpt)
    assert {r.district: r.n for r in before.collect()} == {"K": 1}
    assert {r.district: r.n for r in after.collect()} == {"K": 2, "C": 1}
    assert {r.district: r.n for r in read_current(spark, out).collect()} == {"K": 2, "C": 1}
