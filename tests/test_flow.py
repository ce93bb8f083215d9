"""Registry, flagship, sources, streams."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidegrid.sources import files as sf
from tidegrid.sources import tables as st

SF = "/root/testdata/sf0.001"
SAMPLE = ["clean_parse", "impute_linear", "segment_runs", "join_asof", "agg_hourly", "rolling_time", "window_sliding", "growth_dli",
          "stress_windows", "energy_features_p75", "spectral_features", "pareto_hypervolume", "source_csv", "source_upsert", "stream_hourly"]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "click_mean" in df.columns


def test_registry_is_complete():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 250 and set(o) <= set(q) and len(o) > 0.9 * len(q)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=str)
    assert sorted(names) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want


def test_flow_shuffles_data_twice(spark):
    """Readings are shuffled by (entity, hour) and by entity, nothing else; no nested-loop join."""
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity") == 2
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_multiline_json_and_specs(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"uuid": "u1", "Readings": [[1390518000000, 1.5], [1390518060000, 2]]},
                                                 {"uuid": "zz", "Readings": [[1, 2]]}], indent=1))
    (tmp_path / "w.csv").write_text("timestamp;temperature\n1390518000000;-4.250\nbad;1\n1390518060000;-999\n")
    specs = sf.load_specs(json.dumps([
        {"path": str(tmp_path / "s.json"), "format": "stream_json", "streams": {"u1": "temp"}},
        {"path": str(tmp_path / "w.csv"), "delimiter": ";", "unix_ms": "timestamp", "null_markers": ["", "-999"], "columns": [{"source": "temperature", "target": "temp"}]}]))
    got = sf.ingest(spark, specs)
    assert not got.failed
    found = sorted(((str(r.ts), r.temp) for r in got.rows.collect()), key=str)
    assert found == sorted([("2014-01-23 23:00:00", 1.5), ("2014-01-23 23:01:00", 2.0), ("2014-01-23 23:00:00", -4.25),
                            ("2014-01-23 23:01:00", None)], key=str)
    assert [r.raw for r in got.rejects.collect()] == ["bad;1"]


def test_headerless_and_preamble(spark, tmp_path):
    (tmp_path / "a.csv").write_text("made by x\nDate,Time,T\n01-02-2014,10:00:00,\"1,5\"\n")
    C = sf.ColumnSpec
    spec = sf.FileSpec(str(tmp_path / "a.csv"), date="Date", time="Time", fmt="%d-%m-%Y %H:%M:%S", header_rows=2, columns=(C("T", "t"),))
    p = sf.read_csv(spark, spec)
    assert [(str(r.ts), r.t) for r in p.rows.collect()] == [("2014-02-01 10:00:00", 1.5)] and p.rejects.count() == 0
    (tmp_path / "b.csv").write_text("2014-02-01 10:00:00,7\n")
    p = sf.read_csv(spark, sf.FileSpec(str(tmp_path / "b.csv"), datetime=0, header_rows=0, columns=(C(1, "n", "int"),)))
    assert p.rows.collect()[0].n == 7


def test_options_of_a_partitioned_jdbc_read():
    """No database runs here: only the options are looked at."""
    got = st.jdbc_options({"url": "jdbc:x", "dbtable": "weather", "numPartitions": "3"}, "2024-01-01", "2024-02-01", "time", 8, ["time", "temp"])
    assert got == {"url": "jdbc:x", "partitionColumn": "time", "lowerBound": "2024-01-01", "upperBound": "2024-02-01", "numPartitions": "3", "fetchsize": "10000",
                   "dbtable": "(SELECT time, temp FROM weather WHERE time >= '2024-01-01' AND time <= '2024-02-01') AS part"}
    assert st.jdbc_options({"url": "jdbc:x", "query": "SELECT 1"}, "a", "b", "t", 8) == {"url": "jdbc:x", "query": "SELECT 1"}
    with pytest.raises(ValueError, match="part"):
        st.jdbc_options({"dbtable": "w"}, "a", "b", "t", 0)


def test_files_that_cannot_be_read(spark, tmp_path):
    """Files cut short, no archives and without a line end fail as a whole; several headers, empty files and a broken document beside them."""
    import gzip

    (tmp_path / "csv").mkdir()
    rows = "".join(f"2014-02-01 10:00:{i % 60:02d},{i}\n" for i in range(20_000))
    whole = gzip.compress(("when,n\n" + rows).encode())
    (tmp_path / "csv" / "a.csv.gz").write_bytes(whole)
    (tmp_path / "csv" / "b.csv.gz").write_bytes(whole[:len(whole) // 2])
    (tmp_path / "csv" / "c.csv.gz").write_bytes(b"when,n\n2014-02-01 10:00:00,1\n")
    (tmp_path / "csv" / "d.csv").write_text("n,other,when\r\n7,x,2014-02-01 11:00:00\r\n8,y,bad\r\n")
    (tmp_path / "csv" / "e.csv").write_bytes(b"x" * (5 << 20))
    (tmp_path / "csv" / "f.csv").write_text("")
    C = sf.ColumnSpec
    spec = sf.FileSpec(str(tmp_path / "csv"), datetime="when", columns=(C("n", "n", "int"),))
    p = sf.read_csv(spark, spec)
    assert sorted(r.source_file.rsplit("/")[-1] for r in p.failed.collect()) == ["b.csv.gz", "c.csv.gz", "e.csv"]
    assert p.rows.count() == 20_001 and {r.n for r in p.rows.collect()} == {*range(20_000)}
    assert [r.raw for r in p.rejects.collect()] == ["8,y,bad"]
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text(json.dumps([{"uuid": "u", "Readings": [[1390518000000, 1.5]]}], indent=1))
    (tmp_path / "json" / "b.json").write_text('[{"uuid": "u", "Readings": [[139')
    got = sf.ingest(spark, [spec, sf.FileSpec(str(tmp_path / "json"), format="stream_json", streams={"u": "t"}), sf.FileSpec(str(tmp_path / "none"), datetime=0)])
    assert got.rows.count() == 20_002 and len(got.failed) == 1
    assert sorted(r.source_file.rsplit("/")[-1] for r in got.files.collect()) == ["b.csv.gz", "b.json", "c.csv.gz", "e.csv"]


def test_planning_reads_the_beginning_of_plain_files(tmp_path):
    """Of a file of 60 MB a few kilobytes."""
    (tmp_path / "big.csv").write_text("when,n\n" + "2014-02-01 10:00:00,1\n" * 2_800_000)
    read = []
    real = sf.opened

    class Counted:
        def __enter__(self):
            self.s = real(str(tmp_path / "big.csv")).__enter__()
            return self

        def __exit__(self, *e):
            self.s.close()

        def read(self, n):
            read.append(n)
            return self.s.read(n)

    sf.opened = lambda uri: Counted()
    try:
        assert sf.first_lines(str(tmp_path / "big.csv"), 1) == ["when,n"]
    finally:
        sf.opened = real
    assert sum(read) <= 1 << 17


def test_scan_range_prunes_partitions(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/events.parquet").select("ts", "value")
    path = st.save(st.with_date(df), str(tmp_path / "t"), ["date"])
    got = st.scan_range(spark, path, "2024-01-05 00:00:00", "2024-01-06 00:00:00", ["value"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and got.columns == ["ts", "value"]
    assert got.count() == df.where("ts >= timestamp_ntz'2024-01-05 00:00:00' AND ts < timestamp_ntz'2024-01-06 00:00:00'").count()


def test_models(spark):
    from tidegrid.operators import model as om

    rows = [(float(i % 17), float(i % 5), 2.0 * (i % 17) - (i % 5), i) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, z double, i int").withColumn("ts", F.timestamp_seconds("i").cast("timestamp_ntz"))
    d = om.time_split(df)
    assert {r.part: r["count"] for r in d.groupBy("part").count().collect()} == {"train": 210, "valid": 45, "test": 45}
    m = om.train_regressor(d, ["x", "y"], "z", part="part", rounds=10, depth=4)
    r = om.metrics(om.score(m, d.where("part = 'test'")), "z", "prediction").collect()[0]
    assert r.r2 > 0.9 and r.p_value < 1e-6
    assert om.importances(m, ["x", "y"])[0][0] == "x"


def test_stream_batch_agree(spark, tmp_path):
    """Hourly stream output equals the batch aggregate for closed windows."""
    from tidegrid.streaming import live

    src = spark.read.parquet(f"{SF}/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    d = live.timed(live.read_files(spark, str(tmp_path / "in"), src.schema), "ts", "40 days")
    out = live.run_available(live.hourly(d, "value", "event_type"), str(tmp_path / "o"))
    assert out.count() == 0  # nothing is older than the watermark yet
    d = live.timed(live.read_files(spark, str(tmp_path / "in"), src.schema, max_files=1), "ts", "40 days")
    ids = live.run_available(live.distinct_events(d, "event_id").select("event_id"), str(tmp_path / "p"))
    assert ids.distinct().count() == src.count() == ids.count()
