import pytest
from pyspark.sql import functions as F

from riskloom.plans.pipeline import Failures, Pipeline, RunParameters, audited, publish
from riskloom.sources.landing import Manifest, build_manifest, ingestion_plan, land, numbered, one_snapshot, prepare, read_landed, reconcile, with_lineage
from riskloom.sources.store import SnapshotStore


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("id,name\n" + "".join(f"{i},n{i}\n" for i in range(50)))
    return path


def test_landing_round_trip(spark, csv_file, tmp_path):
    m = land(str(csv_file), str(tmp_path / "landed"), "rows", "SRC", "1.0.0")
    assert land(str(csv_file), str(tmp_path / "landed"), "rows", "SRC", "1.0.0") == m and Manifest.from_json(m.to_json()) == m
    data = csv_file.read_bytes()
    assert reconcile(m, data, ["id", "name"], 50) == [] and reconcile(m, data + b"x", ["id"], 49) == ["RECORD_COUNT", "SOURCE_COLUMNS", "SOURCE_SHA256", "SOURCE_SIZE"]
    rows = read_landed(spark, m)
    assert rows.count() == 50 and {t for _, t in rows.dtypes} == {"string"}
    lined = with_lineage(rows, ["id", "name"], ["id"], "b1", "SRC", str(csv_file), m.source_sha256, "1.0.0", "2024-01-01 00:00:00")
    assert sorted(r.source_row_number for r in lined.collect()) == list(range(1, 51))
    assert prepare([m], {"rows": "SUCCEEDED"})[0]["publication_status"] == "APPROVED"
    with pytest.raises(ValueError):
        prepare([m], {"rows": "PARTIAL"})


def test_bad_files(tmp_path):
    for text in ("", "a,a\n1,2\n", "a,b\n1\n", "a,\n1,2\n"):
        path = tmp_path / "bad.csv"
        path.write_text(text)
        with pytest.raises(ValueError):
            build_manifest(str(path), "d", "s", "1.0.0")
    assert one_snapshot([{"snapshot_sha256": "a"}, {"snapshot_sha256": "a"}]) == "a"
    with pytest.raises(ValueError):
        one_snapshot([{"snapshot_sha256": "a"}, {"snapshot_sha256": "b"}])


def test_numbering_is_gapless_and_in_order(spark):
    rows = numbered(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(9), ["k", "id"], "n").collect()
    assert [(r.k, r.id) for r in sorted(rows, key=lambda r: r.n)] == sorted((i % 7, i) for i in range(1000)) and sorted(r.n for r in rows) == list(range(1, 1001))


def test_ingestion_plan(spark):
    request = spark.createDataFrame([("a", "s", "x", "r1"), ("b", "s", "x", "r2"), ("c", "s", "x", "r3")], "dataset_name string, source_id string, source_sha256 string, request_id string")
    log = spark.createDataFrame([("a", "s", "x", "b1", "SUCCEEDED"), ("b", "s", "x", "b2", "FAILED"), ("c", "s", "x", "b3", "SUCCEEDED"), ("c", "s", "x", "b4", "SUCCEEDED")], "dataset_name string, source_id string, source_sha256 string, batch_id string, status string")
    got = {r.dataset_name: (r.decision, r.effective_batch_id) for r in ingestion_plan(request, log).collect()}
    assert got == {"a": ("SKIPPED_DUPLICATE", "b1"), "b": ("WRITE", "r2"), "c": ("ERROR", None)}


def test_store_commits_tables_together(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.versions() == {} and not store.exists("a")
    store.commit({"a": spark.range(3), "b": spark.range(5)})
    store.append("a", spark.range(3, 4))
    assert store.read("a").count() == 4 and store.read("b").count() == 5
    assert [len(store.versions()[t]) for t in "ab"] == [2, 1]
    store.compact("a")
    assert store.read("a").count() == 4 and len(store.versions()["a"]) == 1 and store.prune() == [] and len(store.prune(older_than=0)) == 2
    (tmp_path / "store" / "lock").touch()
    with pytest.raises(RuntimeError):
        store.commit({"a": spark.range(1)})
    assert store.read("a").count() == 4
    late = SnapshotStore(spark, str(tmp_path / "store"), timeout=-1)  # any lock counts as left behind
    late.commit({"a": spark.range(1)})
    assert store.read("a").count() == 1 and not (tmp_path / "store" / "lock").exists()


def test_publication_is_idempotent_and_audited(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert publish(store, "t", rows, ["k"], Failures(), "run-1", "2024-01-01")["published"]
    again = publish(store, "t", rows.repartition(3), ["k"], Failures(), "run-2", "2024-01-02")
    assert not again["published"] and again["status"] == "SUCCEEDED" and again["attempt"] == 2 and again["before_digest"] == again["after_digest"]
    failed = publish(store, "t", rows.unionByName(rows), ["k"], Failures({"Z", "A"}), "run-3", "2024-01-03")
    assert failed["status"] == "FAILED" and failed["failed_rule_ids"] == ["A", "BUSINESS_KEY_UNIQUE", "Z"] and store.read("t").count() == 2

    def boom():
        raise KeyError("x")

    with pytest.raises(KeyError):
        audited(store, "t", "run-4", "2024-01-04", boom)
    assert [(r.status, r.attempt) for r in store.read("runs").orderBy("run_id").collect()] == [("SUCCEEDED", 1), ("SUCCEEDED", 2), ("FAILED", 3), ("FAILED", 4)]
    short = publish(store, "t", rows, ["k"], Failures(), "run-5", "2024-01-05", expected_rows=3, checks=lambda staged: ["GRID"] if staged.count() else [])
    assert short["failed_rule_ids"] == ["EXPECTED_ROW_COUNT", "GRID"] and not short["published"]


def test_raw_records_tell_rows_apart(spark):
    rows = spark.createDataFrame([(1, "a,b", "c"), (2, "a", "b,c"), (3, None, ""), (4, "", None), (5, 'x"y', "z")], "id int, a string, b string")
    got = {r.id: r.raw_record for r in with_lineage(rows, ["a", "b"], ["id"], "b", "s", "p", "h", "1.0.0", "2024-01-01 00:00:00").collect()}
    assert got == {1: '"a,b",c', 2: 'a,"b,c"', 3: ',""', 4: '"",', 5: '"x""y",z'}


def test_pipeline_and_parameters(spark):
    assert Pipeline([("a", lambda s, done: 1), ("b", lambda s, done: done["a"] + 1)]).run(spark) == {"a": 1, "b": 2}
    RunParameters("CORE_15", "2016-12-30", "abcdef1")
    for bad in (("core", "2016-12-30", "abcdef1"), ("CORE", "2016-2-30", "abcdef1"), ("CORE", "2016-12-30", "xyz"), ("CORE", "2016-12-30", "abcdef1", "NOW")):
        with pytest.raises(ValueError):
            RunParameters(*bad)


def test_tables_are_created_once_and_listed(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    store = SnapshotStore(spark, str(tmp_path / "store"))
    schema = StructType([StructField("k", LongType()), StructField("v", StringType())])
    assert store.create("t", schema) and not store.create("t", schema) and store.read("t").count() == 0
    with pytest.raises(ValueError):
        store.create("t", StructType([StructField("k", StringType())]))
    store.append("t", spark.createDataFrame([(1, "a")], schema))
    (row,) = store.catalog().collect()
    assert (row.table_name, row.folders, row["columns"]) == ("t", 2, ["k bigint", "v string"]) and row.bytes > 0
    store.compact("t")
    assert [r.is_current for r in store.history("t").collect()].count(True) == 1 and store.history("t").count() == 3 and store.history("none").count() == 0


def test_scenario_actions(spark):
    from riskloom.sources.synthetic import scenario_actions

    rows = scenario_actions(spark, [{"instrument_id": "B", "effective_date": "2016-01-07", "symbol": "b", "split": "2"}, {"instrument_id": "A", "effective_date": "2016-01-06", "symbol": "a", "dividend": "1.5"}])
    assert sorted((r.instrument_id, r.action_type, r.dividend_currency) for r in rows.collect()) == [("A", "CASH_DIVIDEND", "USD"), ("B", "STOCK_SPLIT", None)] and len({r.record_hash for r in rows.collect()}) == 2
    for bad in ({"dividend": "1", "split": "2"}, {}, {"split": "1"}, {"dividend": "0"}):
        with pytest.raises(ValueError):
            scenario_actions(spark, [{"instrument_id": "A", "effective_date": "2016-01-06", "symbol": "a", **bad}])


def test_guards_and_settings(spark, tmp_path, monkeypatch, capsys):
    from riskloom.operators.guards import Overflow, bounded, none_of, single_batch, value_or
    from riskloom.plans.extension_queries import import_view, register_views
    from riskloom.plans.settings import Settings, diagnose, main, session_smoke

    rows = spark.range(10)
    assert len(bounded(rows, 10)[0]) == 10 and bounded(rows, 9, strict=False)[1] is False and len(bounded(rows, 9, strict=False)[0]) == 9
    with pytest.raises(Overflow):
        bounded(rows, 9)
    empty = none_of(rows)
    assert empty.count() == 0 and "LocalRelation <empty>" in empty._jdf.queryExecution().optimizedPlan().toString()
    assert value_or(empty, F.sum("id"), 7).first().value == 7 and value_or(rows, F.sum("id"), 7).first().value == 45
    log = spark.createDataFrame([("b", "SUCCEEDED", 2), ("c", "SUCCEEDED", 1), ("d", "FAILED", 1)], "batch_id string, status string, row_count long")
    found = single_batch(spark.createDataFrame([("b",), ("b",), ("d",)], "batch_id string"), log)
    assert {r.batch_id: r.is_reconciled for r in found.collect()} == {"b": True, "c": False, "d": False}
    monkeypatch.setenv("RISKLOOM_STORE", "s3a://bucket/x")
    assert Settings.from_environment(tmp_path) == Settings("local", "s3a://bucket/x")
    monkeypatch.delenv("RISKLOOM_STORE")
    assert Settings.from_environment(tmp_path).store == str((tmp_path / "store").resolve()) and all(c.passed for c in diagnose(tmp_path))
    assert session_smoke(spark).first().two == 2 and main(["--spark"]) == 0 and "[PASS] Session" in capsys.readouterr().out
    store = SnapshotStore(spark, str(tmp_path / "views"))
    store.commit({"t": spark.range(3)})
    assert register_views(spark, store) == ["v_t"] and import_view(spark, "v_t", ["id"]).count() == 3
    with pytest.raises(ValueError):
        import_view(spark, "v_none")
