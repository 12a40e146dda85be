"""Scans and sinks on files like the real inputs."""

import json

import pytest
from pyspark.sql import functions as F

from cadenza.sources import scans, sinks, snapshots


def test_scan_behaviour(spark, tmp_path):
    (tmp_path / "26ByLab_behaviour.csv").write_text("ID, Trial_Num,laser_power,Painrating\n1,1,2.5,NaN\n2,1,x,4\n")
    found = sorted(map(tuple, scans.scan_behaviour(spark, str(tmp_path), ["26ByLab", "30By"]).collect()))
    assert found == [("26ByLab", 1, 1, 2.5, None), ("26ByLab", 2, 1, None, 4.0)]
    (tmp_path / "30By_behaviour.csv").write_text("foo\n1\n")
    with pytest.raises(ValueError):
        scans.scan_behaviour(spark, str(tmp_path / "30By_behaviour.csv"), ["30By"])


def test_scan_participants_channels_montage(spark, tmp_path):
    (tmp_path / "participants.tsv").write_text("participant_id\tAge\nsub-003\t31\nsub-004\tn/a\n")
    assert sorted((r.subject, r.age, r.sex) for r in scans.scan_participants(spark, str(tmp_path)).collect()) == [(3, 31.0, None), (4, None, None)]
    (tmp_path / "channels.tsv").write_text("name\nFz\nCz\n")
    assert [r.name for r in scans.scan_channels_tsv(spark, str(tmp_path / "channels.tsv"), 2).collect()] == ["Fz", "Cz"]
    with pytest.raises(ValueError):
        scans.scan_channels_tsv(spark, str(tmp_path / "channels.tsv"), 3)


def test_scan_long_forms(spark, tmp_path):
    (tmp_path / "sub-1_spectral_chan_by_trial.csv").write_text("subjid,trial,chan_idx,chan_label,PAF,pow\n1,1,1,Cz,9.5,NaN\n")
    assert [tuple(r) for r in scans.scan_spectral_long(spark, str(tmp_path)).select("chan_label", "metric_name", "metric_value").collect()] == [("Cz", "paf", 9.5)]
    (tmp_path / "sub-12_source_ga.csv").write_text("roi,itc\nA,0.5\n")
    assert scans.scan_source_ga(spark, str(tmp_path)).first().subject == 12


def test_scan_config_and_fits(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"exp": {"id": "e1"}, "psd": {"win": 2.0}}))
    row = scans.scan_config(spark, str(tmp_path / "c.json"), {"exp.id": "none", "psd.win": 1.0, "psd.overlap": 0.5, "bands": [8, 12]}).first()
    assert (row.exp_id, row.psd_win, row.psd_overlap, row.bands) == ("e1", 2.0, 0.5, "[8, 12]")
    (tmp_path / "f.json").write_text('{"summary": {}, "trials": [{"trial": 1, "aperiodic_offset": NaN, "r2": 0.9}, {"trial": 2, "fail_reason": "x"}]}')
    found = sorted((r.trial, r.aperiodic_offset, r.r2, r.fail_reason) for r in scans.scan_fits_json(spark, str(tmp_path / "f.json")).collect())
    assert found == [(1, None, 0.9, None), (2, None, None, "x")]


def test_latest_files_and_sessions(spark, tmp_path):
    for name in ("sub-1_clean.set", "sub-1_raw.set", "sub-2_raw.set", "other.txt"):
        (tmp_path / name).write_text("x")
    found = {r.subject: r.path.rsplit("/", 1)[1] for r in scans.latest_file_per_subject(spark, str(tmp_path), "_clean", "_raw").collect()}
    assert found == {1: "sub-1_clean.set", 2: "sub-2_raw.set"}
    files = spark.createDataFrame([(1, "b_ses-02.bdf"), (1, "a_ses-01.bdf"), (2, "x.bdf"), (2, "y.bdf"), (2, "z.bdf")], "subject int, name string")
    assert sorted(map(tuple, scans.session_files(files, 2).select("subject", "session", "name").collect())) == [(1, 1, "a_ses-01.bdf"), (1, 2, "b_ses-02.bdf"), (2, 1, "x.bdf"), (2, 2, "y.bdf")]


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "db")
    assert set(sinks.init_schema(spark, root)) == set(sinks.SCHEMAS) and sinks.init_schema(spark, root) == []
    assert scans.read_table(spark, str(tmp_path), "db/trials") is not None if (tmp_path / "db/trials.parquet").exists() else True
    wide = spark.createDataFrame([(1, 1, "Cz", 2.0, "text", 1.0)], "subject int, trial int, unit string, z double, note string, a double")
    assert sinks.unit_trial_table(wide, ["subject", "trial", "unit"]).columns == ["subject", "trial", "unit", "a", "z"]
    results = spark.createDataFrame([("s", "g", "m", 1.0), ("s", "g", "k", 2.0)], "level string, group_value string, model_name string, aic double")
    sinks.write_result_rows(results, f"{root}/fits")
    sinks.write_result_rows(results.where("model_name = 'm'").withColumn("aic", F.lit(9.0)), f"{root}/fits")
    assert sorted(r.aic for r in snapshots.read_snapshot(spark, f"{root}/fits").collect()) == [2.0, 9.0]
    sinks.append_cv_rows(results, f"{root}/cv")
    sinks.append_cv_rows(results, f"{root}/cv")
    assert spark.read.parquet(f"{root}/cv").count() == 4


def test_stream_remembers_subjects(spark, tmp_path):
    from cadenza.streaming import incremental

    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = [(i, f"c{i % 2}") for i in range(20)] + [(3, "c1"), (4, "c1"), (None, "c0")]
    second = [(i, "c1") for i in range(5)] + [(i, f"c{i % 2}") for i in range(20, 31)] + [(25, "c1"), (99, None)]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", incremental.STORE)
    try:
        kept = []
        for rows in (first, second):
            spark.createDataFrame(rows, "subject long, cap_size string").coalesce(1).write.mode("append").parquet(source)
            stream = incremental.assign_stream(spark.readStream.schema("subject long, cap_size string").parquet(source))
            stream.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).format("parquet").option("path", target).outputMode("append").start().awaitTermination()
            kept.append({r.subject: (r.cap_size, r.split_group) for r in spark.read.parquet(target).collect()})
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert spark.read.parquet(target).count() == 32 == len(kept[1])
    assert all(kept[1][k] == v for k, v in kept[0].items())
    for cap in ("c0", "c1"):
        groups = [g for c, g in kept[1].values() if c == cap]
        assert abs(groups.count("train") - 0.75 * len(groups)) <= 1


def test_stratum_state_is_read_once_for_many_subjects():
    import pandas as pd

    from cadenza.streaming import incremental

    class State:
        value, calls = None, 0

        def exists(self):
            self.calls += 1
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    state = State()
    assigner = incremental._Assigner("subject", "cap_size", 0.75)
    assigner.init(type("Handle", (), {"getValueState": lambda self, *a: state})())
    groups = []
    for part in range(2):
        batches = (pd.DataFrame({"subject": range(at, at + 500), "cap_size": "c"}) for at in range(part * 1000, part * 1000 + 1000, 500))
        groups += [g for out in assigner.handleInputRows(("c", 0), batches, None) for g in out["split_group"]]
    assert state.calls == 5 and state.value == (1500, 2000) and len(groups) == 2000
    for n in range(1, 2000):
        assert abs(groups[:n].count("train") - 0.75 * n) <= 1


TABLE = "k int, v string"


def held(spark, root, version=None):
    return sorted((r.k, r.v) for r in snapshots.read_snapshot(spark, root, version).collect())


def test_lost_writers_leave_a_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(rows, TABLE)
    assert snapshots.upsert_snapshot(frame((1, "a"), (2, "b"), (3, "c")), root, ["k"], 4) == 1
    assert snapshots.upsert_snapshot(frame((2, "B"), (4, "d")), root, ["k"]) == 2
    assert held(spark, root) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")] and held(spark, root, 1) == [(1, "a"), (2, "b"), (3, "c")]
    # Lost after its folder was written, before the commit.
    monkeypatch.setattr(snapshots, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        snapshots.upsert_snapshot(frame((1, "lost")), root, ["k"])
    monkeypatch.undo()
    assert held(spark, root)[0] == (1, "a")
    # Lost amid its manifest: readers wait a while, then pass over it, and the next writer takes the number after.
    (tmp_path / "t/versions" / f"{3:020d}").write_text('{"schema": "k int')
    monkeypatch.setattr(snapshots, "GRACE", 0.5)
    assert held(spark, root)[0] == (1, "a")
    assert snapshots.upsert_snapshot(frame((1, "A")), root, ["k"]) == 4
    assert held(spark, root) == [(1, "A"), (2, "B"), (3, "c"), (4, "d")]
    # What no version names goes, but not yet what is young.
    assert snapshots.vacuum(spark, root) == 0 and snapshots.vacuum(spark, root, older_than=0) >= 1
    assert held(spark, root) == [(1, "A"), (2, "B"), (3, "c"), (4, "d")]


def test_two_writers_do_not_mix(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(rows, TABLE)
    snapshots.upsert_snapshot(frame((1, "a"), (2, "b")), root, ["k"], 1)
    own, first = snapshots.commit, []

    def late(*args):
        if not first:
            first.append(1)
            snapshots.upsert_snapshot(frame((2, "other"), (5, "e")), root, ["k"])  # comes between this writer's read and its commit
        own(*args)

    monkeypatch.setattr(snapshots, "commit", late)
    assert snapshots.upsert_snapshot(frame((1, "mine")), root, ["k"]) == 3
    assert held(spark, root) == [(1, "mine"), (2, "other"), (5, "e")]
    wider = spark.createDataFrame([(7, "g", 1.5)], f"{TABLE}, extra double")
    snapshots.upsert_snapshot(wider, root, ["k"])
    assert {r.k: r.extra for r in snapshots.read_snapshot(spark, root).collect()} == {1: None, 2: None, 5: None, 7: 1.5}
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, str(tmp_path / "none"))
