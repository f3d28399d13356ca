"""Sources, sinks, resume-safe writes, ranks and streams."""

from __future__ import annotations

import glob
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborlift.functions import scalar
from arborlift.functions.stats import quantiles, value_bucket, with_rank
from arborlift.operators import registry
from arborlift.sources import shared_tables as T, tables, vectors
from arborlift.streaming import feeds


def fc(features):
    return json.dumps({"type": "FeatureCollection", "features": features})


def feature(sid, kind="Polygon", date="2005-02-03", end=None, side=0.3, x=10.0):
    ring = [[x, 0], [x + side, 0], [x + side, side], [x, side], [x, 0]]
    coords = [ring] if kind == "Polygon" else [[ring]] if kind == "MultiPolygon" else ring
    geometry = {"type": kind, "coordinates": coords}
    if kind == "GeometryCollection":
        geometry = {"type": kind, "geometries": [
            {"type": "Polygon", "coordinates": [ring]}, {"type": "Point", "coordinates": [x, 0]}]}
    return {"type": "Feature", "geometry": geometry, "properties": {
        "site_id": sid, "site_name": f"Site {sid}", "start_date": date, "end_date": end}}


def test_sites_from_geojson(spark, tmp_path):
    path = tmp_path / "s.geojson"
    path.write_text(fc([feature("b"), feature("tiny", side=0.001), feature("a", "MultiPolygon", end="2010-01-01")]))
    got = vectors.read_sites(spark, str(path), 100).orderBy("id_numeric").collect()
    # ids are given before the area filter, so there is a gap
    assert [(r.id_numeric, r.site_id, r.start_year, r.end_year) for r in got] == [
        (1, "b", 2005, 2099), (3, "a", 2005, 2010)]
    assert got[0].area_ha == pytest.approx(33.4 * 33.2 * 100, rel=0.01)


def test_bad_sites_are_rejected(spark, tmp_path):
    for name, features in (("line", [feature("a", "LineString")]), ("twice", [feature("a"), feature("a")]),
                           ("small", [feature("a", side=0.0001)])):
        path = tmp_path / f"{name}.json"
        path.write_text(fc(features))
        with pytest.raises(ValueError):
            vectors.read_sites(spark, str(path), 100)
    path = tmp_path / "missing.json"
    path.write_text(fc([{**feature("a"), "properties": {"site_id": "a", "site_name": "x"}}]))
    with pytest.raises(ValueError, match="start_date"):
        vectors.read_sites(spark, str(path), 0)


def test_reference_import(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(fc([feature("p"), feature("c", "GeometryCollection", x=20.0), feature("l", "LineString")]))
    features = vectors.read_features(spark, str(path), {"site_id": "string"})
    got = vectors.import_reference(features, {"SITE_ID": "code", "absent": "x"}).orderBy("code").collect()
    assert [(r.code, r.xmin) for r in got] == [("c", 20.0), ("p", 10.0)]


def read_text(path):
    return "".join(open(p).read().replace("\n", "") for p in sorted(glob.glob(f"{path}/part-*")))


def test_documents_are_valid_json(spark, sf, tmp_path):
    from arborlift.plans import source_queries
    from arborlift.plans.aggregate_queries import totals, yearly

    path = str(tmp_path / "fc")
    tables.write_document(tables.feature_collection(source_queries.dated_sites(spark, sf)), path)
    doc = json.loads(read_text(path))
    ids = [f["properties"]["site_id"] for f in doc["features"]]
    assert ids == sorted(ids) and len(ids) == T.sites(spark, sf).count()
    assert "end_date" in doc["features"][0]["properties"]
    path = str(tmp_path / "empty")
    tables.write_document(tables.feature_collection(source_queries.dated_sites(spark, sf).limit(0)), path)
    assert json.loads(read_text(path))["features"] == []

    y, t = yearly(spark, sf), totals(spark, sf)
    path = str(tmp_path / "payload")
    tables.write_document(tables.analysis_payload(y, t, '{"n_sites":3}'), path)
    text = read_text(path)
    doc = json.loads(text)
    assert len(doc["time_series"]) == y.count() and len(doc["records"]) == t.count()
    back, total = tables.parse_payloads(spark.createDataFrame([("t", text)], "task_id string, payload string"))
    pd.testing.assert_frame_equal(
        back.select("site_id", "year", "emissions_avoided_mgco2e").toPandas().sort_values(["site_id", "year"]).reset_index(drop=True),
        y.select("site_id", "year", "emissions_avoided_mgco2e").toPandas().sort_values(["site_id", "year"]).reset_index(drop=True))
    assert total.filter("n_years IS NULL").isEmpty()
    path = str(tmp_path / "summary")
    tables.write_document(source_queries.summary_lines(spark, sf), path)
    doc = json.loads(read_text(path))
    assert doc["n_sites"] == len(doc["sites"]) and doc["task_id"] == "run"


def test_results_are_replaced_per_task(spark, tmp_path):
    path = str(tmp_path / "res")
    rows = lambda task, v: spark.createDataFrame([(task, "A", v)], "task_id string, site_id string, v int")
    tables.replace_task(rows("t1", 1), path)
    tables.replace_task(rows("t2", 2), path)
    tables.replace_task(rows("t1", 3), path)
    assert {(r.task_id, r.v) for r in spark.read.parquet(path).collect()} == {("t1", 3), ("t2", 2)}


def test_rows_are_replaced_in_a_fixed_number_of_folders(spark, tmp_path):
    path = str(tmp_path / "rows")
    schema = "k string, v int"
    first = [(str(i), i) for i in range(300)] + [("hot", i) for i in range(150)] + [(None, 1), (None, 2), ("7", 7)]
    tables.replace_rows(spark.createDataFrame(first[:0], schema), path, "k", 8)
    tables.replace_rows(spark.createDataFrame(first, schema), path, "k", 8)
    assert len(glob.glob(f"{path}/key_bucket=*")) == 8

    def rows():
        return sorted(((r.k or "", r.v) for r in spark.read.parquet(path).collect()))

    assert rows() == sorted((k or "", v) for k, v in first)
    new = [("7", 70), ("hot", -1), (None, 3), ("new", 4)]
    tables.replace_rows(spark.createDataFrame(new, schema), path, "k", 8)
    left = [(k, v) for k, v in first if k not in ("7", "hot", None)]
    assert rows() == sorted((k or "", v) for k, v in left + new)
    tables.replace_rows(spark.createDataFrame(new, schema).limit(0), path, "k", 8)
    assert rows() == sorted((k or "", v) for k, v in left + new)
    wider = spark.createDataFrame([("7", 71, "x")], schema + ", extra string")
    tables.replace_rows(wider, path, "k", 8)
    back = spark.read.option("mergeSchema", True).parquet(path).filter("k IN ('7', 'new')").collect()
    assert {(r.k, r.v, r.extra) for r in back} == {("7", 71, "x"), ("new", 4, None)}


def test_markers_keep_their_file(spark, tmp_path):
    (tmp_path / "failed_3.json").write_text('{\n "id_numeric": 3,\n "error": "no cells"\n}')
    (tmp_path / "failed_4.json").write_text('{"id_numeric": 4}')
    got = {r.id_numeric: (r.error, r.failure_marker_file) for r in tables.read_failures(spark, str(tmp_path)).collect()}
    assert got == {3: ("no cells", "failed_3.json"), 4: (None, "failed_4.json")}


def test_quantiles_of_any_scale(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 5000), "v": np.concatenate([
        rng.lognormal(0, 4, 2500), -rng.lognormal(0, 3, 1500), np.zeros(1000)])})
    probs = [0, 0.01, 0.3, 0.5, 0.77, 1]
    got = quantiles(spark.createDataFrame(pdf), ["k"], "v", probs).collect()
    assert len(got) == 18
    for r in got:
        assert r["quantile"] == pytest.approx(np.quantile(pdf[pdf.k == r.k].v, r.p), rel=1e-9, abs=1e-12)


def test_bucket_order_and_rank(spark):
    values = [-1e9, -8.0, -7.999, -1e-9, 0.0, 1e-300, 1e-9, 0.999999, 1.0, 2.0, 3.9999, 4.0, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r.b for r in df.orderBy("v").select(value_bucket(F.col("v")).alias("b")).collect()]
    assert buckets == sorted(buckets)
    ranked = with_rank(df.withColumn("k", F.lit(1)), ["k"], ["v"], value_bucket(F.col("v")))
    assert [r["rank"] for r in ranked.orderBy("v").collect()] == list(range(len(values)))


def test_longest_name(spark):
    files = spark.createDataFrame([("fc_2000.tif",), ("fc_20000000-01.tif",), ("pop.tif",), ("popx.tif",), ("fc_2.tif",)], "file string")
    names = spark.createDataFrame([("fc_2000",), ("fc_200",), ("pop",), ("fc_",)], "name string")
    got = {r.file: r.name for r in registry.longest_name(files, names).collect()}
    assert got == {"fc_2000.tif": "fc_2000", "fc_20000000-01.tif": "fc_2000", "pop.tif": "pop", "fc_2.tif": "fc_"}


def test_stale_reset(spark):
    rows = spark.createDataFrame([("a", "merging", "2024-01-01 00:00:00"), ("b", "merging", "2024-01-01 00:50:00"), ("c", "merged", "2024-01-01 00:00:00")],
                                 "covariate_name string, status string, t string").withColumn("started_at", F.to_timestamp("t"))
    rows = rows.withColumn("error_message", F.concat(F.lit("old "), "covariate_name"))
    out = registry.reset_stale(rows, F.lit("2024-01-01 01:00:00").cast("timestamp"))
    assert {r.covariate_name: r.status for r in out.collect()} == {"a": "failed", "b": "merging", "c": "merged"}
    messages = {r.covariate_name: r.error_message for r in out.collect()}
    assert messages == {"a": registry.STALE_MESSAGE, "b": "old b", "c": "old c"}


def test_stale_reset_reaches_open_snapshots(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    rows = spark.createDataFrame(
        [(1, "merging", "2024-01-01 00:00:00"), (1, "pending_merge", "2024-01-01 00:10:00"), (2, "merging", "2024-01-01 00:50:00"),
         (3, "merged", "2024-01-01 00:00:00"), (4, "merging", None)], "id int, status string, t string",
    ).withColumn("started_at", F.to_timestamp("t"))
    ended = {(r.id, r.status): r.completed_at is not None for r in registry.reset_stale(rows, now).collect()}
    assert ended == {(1, "failed"): True, (2, "merging"): False, (3, "merged"): False, (4, "merging"): False}
    snapshots = spark.createDataFrame(
        [(10, 1, "merging", "x"), (11, 1, "merged", "y"), (12, 2, "merging", None), (13, None, "merging", None), (14, 1, None, None)],
        "id int, covariate_id int, status string, error_message string")
    got = {r.id: (r.status, r.error_message, r.merge_completed_at is not None)
           for r in registry.reset_snapshots(snapshots, rows, now).collect()}
    assert got == {10: ("failed", registry.SNAPSHOT_MESSAGE, True), 11: ("merged", "y", False),
                   12: ("merging", None, False), 13: ("merging", None, False), 14: (None, None, False)}
    assert registry.reset_snapshots(snapshots.limit(0), rows, now).isEmpty()


def test_fingerprint_tree(spark):
    tiles = [("l", f"t{i}", f"e{i}", i) for i in range(50)] + [("m", "t0", None, 1), (None, "t", "e", 1)]
    schema = "covariate_name string, name string, etag string, size_bytes bigint"

    def prints(rows):
        return {r[0]: r[1] for r in registry.tile_fingerprint(spark.createDataFrame(rows, schema)).collect()}

    before = prints(tiles)
    buckets = {}
    for _, name, etag, size in tiles[:50]:
        buckets.setdefault(hashlib.md5(name.encode()).hexdigest()[:3], []).append(f"{name}:{etag}:{size}")
    leaves = sorted(b + hashlib.sha256("|".join(sorted(e)).encode()).hexdigest() for b, e in buckets.items())
    assert before["l"] == hashlib.sha256("|".join(leaves).encode()).hexdigest()[:16]
    assert prints(tiles[::-1] + tiles[:7]) == before
    changed = prints([("l", "t7", "new", 7) if t[1] == "t7" else t for t in tiles])
    assert {k for k in before if before[k] != changed[k]} == {"l"}
    assert set(before) == {"l", "m", None}


def test_written_document_is_read_back(spark, tmp_path):
    rows = [("a", '{"id":"a","n":1}'), ("a", '{"id":"a","n":1}'), ("b", '{"id":"b],[","n":2}'), ("c", '{"id":"{c}"}')]
    items = spark.createDataFrame(rows, "key string, entry string")
    errors = spark.createDataFrame([("z", '{"error":"line\\nbreak"}')], "key string, entry string")
    path = str(tmp_path / "doc")
    lines = tables.document(spark, ['{"name":"x","items":[', items, '],"errors":[', errors, "]}"])
    tables.write_document(lines.repartition(3), path)
    got = tables.document_members(spark, path, "id string, n int, error string").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        ("a", 1, None), ("a", 1, None), ("b],[", 2, None), ("{c}", None, None), (None, None, "line\nbreak")]))
    assert tables.document_head(spark, path, "name string").first().name == "x"
    empty = str(tmp_path / "none")
    tables.write_document(tables.document(spark, ['{"name":"y","items":[', items.limit(0), "]}"]), empty)
    assert tables.document_members(spark, empty, "id string").isEmpty()


def test_lists_with_null_and_repeated_keys_are_valid(spark, tmp_path):
    rows = [("b", '{"n":1}'), ("a", '{"n":2}'), ("a", '{"n":3}'), ("a", '{"n":3}'), (None, '{"n":4}'), (None, '{"n":4}')]
    items = spark.createDataFrame(rows, "key string, entry string")
    path = str(tmp_path / "list")
    tables.write_document(tables.document(spark, ["[", items, "]"]), path)
    assert [x["n"] for x in json.loads(read_text(path))] == [4, 4, 2, 3, 3, 1]


def test_quantiles_with_infinite_values(spark):
    values = [float("-inf"), -1.0, 0.0, 2.0, float("inf")]
    df = spark.createDataFrame([("k", v) for v in values], "key string, x double")
    got = {r.p: r.quantile for r in quantiles(df, ["key"], "x", [0.25, 0.5, 0.75]).collect()}
    assert got == {0.25: -1.0, 0.5: 0.0, 0.75: 2.0}


def test_lists_of_any_shape(spark):
    texts = ['[{"k":1},{"k":2}]', '{"1":{"k":1},"2":{"k":2}}', '{"k":7}', "[]", "null", "3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.l for r in df.orderBy("i").select(scalar.normalised_list(F.col("t"), "struct<k:int>").alias("l")).collect()]
    assert [[x.k for x in l] for l in got] == [[1, 2], [1, 2], [7], [], [], []]


def test_status_stream_over_batches(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "key string, status string, ts timestamp, id bigint"
    def push(rows):
        spark.createDataFrame(rows, "key string, status string, t string, id bigint").select(
            "key", "status", F.to_timestamp("t").alias("ts"), "id").coalesce(1).write.mode("append").parquet(source)
        feeds.run_status_stream(spark.readStream.schema(schema).parquet(source), table, checkpoint)
    push([("a", "exporting", "2024-01-01 00:00:00", 1), ("b", "exporting", "2024-01-01 00:00:00", 2)])
    push([("a", "merged", "2024-01-02 00:00:00", 3)])
    got = {r.key: (r.status, r.n_changes, r.completed_at is not None) for r in feeds.read_status(spark, table).collect()}
    assert got == {"a": ("merged", 2, True), "b": ("exporting", 1, False)}


def test_status_table_does_not_grow_with_batches(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "key string, status string, ts timestamp, id bigint"
    for i in range(10):
        spark.createDataFrame([(f"k{i % 3}", f"s{i}", i)], "key string, status string, id bigint").select(
            "key", "status", F.timestamp_seconds("id").alias("ts"), "id").coalesce(1).write.mode("append").parquet(source)
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    feeds.run_status_stream(raw, table, checkpoint, every=2)
    got = {r.key: (r.status, r.n_changes) for r in feeds.read_status(spark, table).collect()}
    assert got == {"k0": ("s9", 4), "k1": ("s7", 3), "k2": ("s8", 3)}
    assert len(glob.glob(f"{table}/slot=*")) <= 6
    feeds._keep_status(table, 2)(spark.createDataFrame([("k0", "s9", 4)], "key string, status string, n_changes bigint"), 9)
    assert feeds.read_status(spark, table).count() == 3  # a repeated batch replaces itself


def test_manifest_stream_records_changes_only(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    def push(*rows):
        spark.createDataFrame(rows, feeds.LISTING).coalesce(1).write.mode("append").parquet(source)
        feeds.run_manifest_stream(spark.readStream.schema(feeds.LISTING).parquet(source), table, checkpoint)
    def log():
        return sorted((r.listing, r.covariate_name, r.change) for r in feeds.read_changes(spark, table).collect())
    push((1, 4, "a1.tif", "a", "x", 1), (1, 4, "b1.tif", "b", "y", 1), (1, 4, "b.txt", "b", "q", 1), (1, 4, "c1.tif", "c", "r", 1))
    first = [(1, "a", "new"), (1, "b", "new"), (1, "c", "new")]
    assert log() == first
    push((2, 2, "a1.tif", "a", "x", 1))  # half a listing changes nothing yet
    assert log() == first
    push((2, 2, "b1.tif", "b", "z", 1), (3, 1, "b1.tif", "b", "z", 1))  # the rest, and the next one
    later = [(2, "b", "changed"), (2, "c", "removed"), (3, "a", "removed")]
    assert log() == sorted(first + later)
    push((2, 1, "d1.tif", "d", "z", 1))  # older than what was compared last
    push((4, 1, "b1.tif", "b", "z", 1))
    assert log() == sorted(first + later)
    push((5, 2, "b1.tif", "b", "z", 1), (5, 2, "c1.tif", "c", "r", 1))
    assert log() == sorted([*first, *later, (5, "c", "new")])
    assert len(glob.glob(f"{table}/current/*")) == 2
