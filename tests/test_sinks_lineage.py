import hashlib
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from cohortica.operators import lineage as L
from cohortica.operators.contracts import ContractViolation
from cohortica.plans.q_lineage import verify_files
from cohortica.sources import readers as R
from cohortica.sources import sinks as K


def test_panel_csv_with_bool_literals(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("mes,id_cliente,objetivo,ingresos\n202601,1,True,10.5\n202602,1,False,11\n")
    schema = R.schema_from_dictionary([("id_cliente", "id", "int"), ("mes", "month", "int"),
                                       ("ingresos", "income", "float"), ("objetivo", "label", "boolean")])
    assert schema["mes"].metadata == {"comment": "month"}
    out = R.read_panel_csv(spark, str(path), schema).orderBy("mes").collect()
    assert [tuple(r) for r in out] == [(1, 202601, 10.5, 1), (1, 202602, 11.0, 0)]
    with pytest.raises(ValueError, match="missing"):
        R.read_panel_csv(spark, str(path), R.panel_schema())
    assert len(R.panel_schema().fields) == 25


def test_submission_files_keep_the_contract_order(spark, tmp_path):
    n = 500
    df = spark.range(n).select(F.col("id").alias("row_ord"), ((F.col("id") * 7) % n).alias("id_cliente"),
                               (F.col("id") / n).alias("prediccion"))
    out = str(tmp_path / "sub")
    K.write_submission(df.repartition(5), df.select("row_ord", "id_cliente"), out, files=3)
    ids = []
    for f in sorted(Path(out).glob("part-*.csv")):
        lines = f.read_text().split()
        assert lines[0] == "id_cliente,prediccion"
        ids += [int(x.split(",")[0]) for x in lines[1:]]
    assert ids == [(i * 7) % n for i in range(n)]
    with pytest.raises(ContractViolation):
        K.write_submission(df.withColumn("prediccion", F.lit(2.0)), df.select("row_ord", "id_cliente"), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_fold_sink_replaces_only_its_partition(spark, tmp_path):
    path = str(tmp_path / "folds")
    df = spark.createDataFrame([(1, 0.5)], "id_cliente long, prediccion double")
    K.write_fold(df, path, "r1", 202609)
    K.write_fold(df, path, "r1", 202610)
    K.write_fold(df.withColumn("prediccion", F.lit(0.9)), path, "r1", 202609)
    got = {(r.fold, r.prediccion) for r in spark.read.parquet(path).collect()}
    assert got == {(202609, 0.9), (202610, 0.5)}


def test_feature_sink_and_fingerprint(spark, tmp_path):
    df = spark.range(100).select("id", (F.lit(202600) + F.col("id") % 3).alias("mes"), (F.col("id") * 2).alias("x"))
    path = str(tmp_path / "features")
    K.write_features(df, path)
    back = spark.read.parquet(path).select("id", "mes", "x")
    a, b = (L.table_fingerprint(d, ["id", "mes", "x"]).first() for d in (df, back))
    assert a == b and a.n_rows == 100
    changed = L.table_fingerprint(df.withColumn("x", F.when(F.col("id") == 5, 0).otherwise(F.col("x"))), ["id", "mes", "x"]).first()
    assert changed.content_hash != a.content_hash
    assert L.table_fingerprint(df.unionByName(df), ["id", "mes", "x"]).first().content_hash != a.content_hash


def test_manifest_detects_tampering(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    for name, text in (("a.txt", "aaa"), ("b.txt", "bbb"), ("c.txt", "ccc")):
        (folder / name).write_text(text)
    manifest = L.build_manifest(spark, "run", {"inputs": str(folder)}).cache()
    rows = {Path(r.path).name: r for r in manifest.collect()}
    assert rows["a.txt"].sha256 == hashlib.sha256(b"aaa").hexdigest() and rows["a.txt"].bytes == 3
    L.require_intact(manifest, R.file_records(spark, str(folder)))
    (folder / "a.txt").unlink()
    (folder / "b.txt").write_text("bbbb")
    (folder / "c.txt").write_text("ccd")
    got = {Path(r.path).name: r.status for r in L.verify_files(manifest, R.file_records(spark, str(folder))).collect()}
    assert got == {"a.txt": "missing", "b.txt": "size mismatch", "c.txt": "checksum mismatch"}
    with pytest.raises(ContractViolation):
        L.require_intact(manifest, R.file_records(spark, str(folder)))


def test_tables_of_many_files_are_verified_by_name(spark, tmp_path):
    for table in ("orders", "part", "nation", "region"):
        spark.range(9).repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    (tmp_path / "about.txt").write_text("no table")
    spark.range(3).toPandas().to_parquet(tmp_path / "events.parquet")
    got = [tuple(r) for r in verify_files(spark, str(tmp_path)).select("file", "status").orderBy("file").collect()]
    assert got == [("events.parquet", "ok"), ("nation.parquet", "size mismatch"), ("orders.parquet", "ok"),
                   ("part.parquet.gone", "missing"), ("region.parquet", "checksum mismatch")]


def test_resume_runs_only_pending_folds(spark):
    wanted = spark.createDataFrame([("m", 1, "x"), ("m", 2, "x"), ("m", 3, "x")], "model string, fold int, identity string")
    state = spark.createDataFrame(
        [("m", 1, "complete", "x", 5, 1.0, None, 0.2), ("m", 2, "failed", "x", None, 2.0, "timeout", None)], L.STATE_SCHEMA)
    assert sorted(r.fold for r in L.resume(wanted, state).collect()) == [2, 3]
    with pytest.raises(ContractViolation):
        L.resume(wanted.withColumn("identity", F.lit("y")), state)
    expected = spark.createDataFrame([("m", 1), ("m", 2), ("m", 3), ("never", 1)], "model string, fold int")
    status = {(r.model, r.fold): r.status for r in L.fold_status(state, expected).collect()}
    assert status == {("m", 1): "complete", ("m", 2): "failed", ("m", 3): "not_started", ("never", 1): "not_started"}
    assert {r.status for r in L.status_rollup(L.fold_status(state, expected)).collect()} == {"incomplete"}


def test_hashes_tell_null_and_borders_apart(spark):
    rows = [("a|b", "c", None), ("a", "b|c", None), ("a", None, "b"), ("a", "b", None), (None, "a", "b"), ("", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, y string, z string")
    assert L.with_identity(df, ["x", "y", "z"]).select("identity").distinct().count() == len(rows)
    hashes = {L.table_fingerprint(df.where(f"i = {i}"), ["x", "y", "z"]).first().content_hash for i in range(len(rows))}
    assert len(hashes) == len(rows)
    assert len({L.identity_key("a", "b"), L.identity_key("ab"), L.identity_key("a", None, "b"), L.identity_key("a", "b", None)}) == 4


def test_run_records_append(spark, tmp_path):
    path = str(tmp_path / "index")
    for run in ("r1", "r2"):
        L.append_index(L.run_record(spark, run, {"depth": 3}, {"gini": 0.2}, {}, True), path)
    assert spark.read.parquet(path).count() == 2
    assert L.identity_key("a", "b") != L.identity_key("a", "c")


def test_wide_oof_and_seed_means(spark, rows):
    long = spark.createDataFrame([(1, 2, 0, "a", 0.123456789), (1, 2, 0, "b", 0.5)],
                                 "id_cliente long, mes int, objetivo int, model string, score double")
    assert rows(K.wide_oof(long, ["a", "b"]), "id_cliente", "a", "b") == [(1, 0.1234568, 0.5)]
    seeds = spark.createDataFrame([(1, 0.2), (1, 0.4)], "id long, score double")
    assert rows(R.mean_over_seeds(seeds, ["id"]), "id", "n_seeds") == [(1, 2)]


def test_report_and_run_table_round_trip(spark, tmp_path):
    metrics = spark.createDataFrame([("a", 0.2)], "model string, gini double")
    K.write_report(metrics, str(tmp_path / "report"))
    again = R.read_run_table(spark, str(tmp_path / "report"), metrics.schema, "json")
    assert [tuple(r) for r in again.collect()] == [("a", 0.2)]


def test_large_files_are_digested_in_chunks(spark, tmp_path):
    """A sparse file of 3 GB, beyond what one value can hold, and names with blanks and signs."""
    size = 3 * 2**30 + 5
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "a b%20c#d.txt").write_bytes(b"abc")
    want, zeros = hashlib.sha256(), bytes(1 << 24)
    for at in range(0, size, len(zeros)):
        want.update(zeros[:size - at])
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in R.file_records(spark, str(tmp_path)).collect()}
    assert got["large.bin"] == (size, want.hexdigest())
    assert got["a b%20c#d.txt"] == (3, hashlib.sha256(b"abc").hexdigest())


def test_failed_publication_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    read = lambda: sorted(r.id for r in spark.read.parquet(path).collect())
    K.publish(spark, path, spark.range(3).write.parquet)
    assert read() == [0, 1, 2]
    failing = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        K.publish(spark, path, failing.write.parquet)

    def refuse(staged):
        raise ContractViolation("not like this")
    with pytest.raises(ContractViolation):
        K.publish(spark, path, spark.range(5).write.parquet, refuse)
    assert read() == [0, 1, 2] and [p.name for p in tmp_path.iterdir()] == ["t"]
    K.publish(spark, path, spark.range(5).write.parquet)
    assert read() == [0, 1, 2, 3, 4] and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_submission_order_is_read_back(spark, tmp_path):
    ids = [(i, (i * 7919) % 1000, i / 1000) for i in range(1000)]
    df = spark.createDataFrame(ids, "row_ord long, id_cliente long, prediccion double").repartition(6)
    path = str(tmp_path / "s")
    K.write_submission(df, df.select("row_ord", "id_cliente"), path, files=5)
    back = R.read_in_order(spark, path, "id_cliente long, prediccion double")
    assert sorted((r.row_ord, r.id_cliente) for r in back.collect()) == [(i, k) for i, k, _ in ids]


def test_resume_trusts_only_intact_artifacts(spark):
    wanted = spark.createDataFrame([("m", f, "x", 5) for f in range(7)], "model string, fold int, identity string, n_rows long")
    state = spark.createDataFrame([("m", f, "complete" if f else "failed", "y" if f == 1 else "x", 6 if f == 2 else 5, 1.0, None, None)
                                   for f in range(6)], L.STATE_SCHEMA)
    listed = spark.createDataFrame([("m", f, f"p{f}", 1, "s") for f in (1, 2, 4, 5)], "model string, fold int, path string, bytes long, sha256 string")
    actual = spark.createDataFrame([("p4", 1, "s"), ("p5", 1, "t")], "path string, bytes long, sha256 string")
    got = {r.fold: r.status for r in L.resume_status(wanted, state, listed, actual).collect()}
    assert got == {0: "run", 1: "other identity", 2: "row count", 3: "missing", 4: "reuse", 5: "checksum mismatch", 6: "run"}
    with pytest.raises(ContractViolation, match="checksum"):
        L.resume_verified(wanted, state, listed, actual)
    good = wanted.where("fold in (0, 4, 6)")
    assert sorted(r.fold for r in L.resume_verified(good, state, listed, actual).collect()) == [0, 6]


def test_a_run_is_indexed_once(spark, tmp_path):
    record = L.run_record(spark, "r1", {"a": 1}, {}, {}, True)
    L.append_index(record, str(tmp_path / "index"))
    with pytest.raises(ContractViolation, match="r1"):
        L.append_index(record, str(tmp_path / "index"))
    L.append_index(L.run_record(spark, "r2", {}, {}, {}, False), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 2
