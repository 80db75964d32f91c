import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import readers, sinks
from plumbline.streaming import windows


def test_shards_and_caps(spark, tmp_path):
    rows = [("a", b"\xff\xd8\xff\xe0" + b"0" * 9, 0), (None, b"\x89PNG\r\n\x1a\n0000", 1), ("c", b"zzz", 1), ("d", b"\xff\xd8\xff\xe0", 7)]
    spark.createDataFrame(rows, "img_id string, image binary, label int").coalesce(1).write.parquet(str(tmp_path / "x"))
    out = readers.labelled(readers.shards(spark, str(tmp_path)))
    got = {r["format"]: r["img_id"] for r in out.collect()}
    assert set(got) == {"JPEG", "PNG"} and got["JPEG"] == "a" and got["PNG"].endswith(":1")
    assert readers.capped(out, 1, 1).count() == 1


def test_cells_without_bytes_are_read_from_their_path(spark, tmp_path):
    spark.createDataFrame([("a", (b"\xff\xd8\xff\xe0", "p0")), ("b", (None, "p1")), ("c", (None, "p2"))], "img_id string, image struct<bytes: binary, path: string>").selectExpr("*", "1 AS label").write.parquet(str(tmp_path / "x"))
    files = spark.createDataFrame([("p0", b"no"), ("p1", b"\x89PNG\r\n\x1a\n")], "path string, content binary")
    rows = readers.shards(spark, str(tmp_path))
    assert {r["img_id"]: r["format"] for r in readers.labelled(rows, files=files).collect()} == {"a": "JPEG", "b": "PNG"}
    assert [r["img_id"] for r in readers.labelled(rows).collect()] == ["a"]


def test_image_listing_and_labels(spark, tmp_path):
    root = tmp_path / "real" / "set"  # folders above the root tell nothing
    for name in ("Camera/a.JPG", "fake/x/b.png", "fake/.hidden.png", "other/c.txt", "other/d.png", "positive/genuine/e.webp", "1/f.jpeg", "other/real.png", "fake/g.bmp"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"1")
    found = {r["path"].split("/")[-1]: r["label"] for r in readers.images(spark, str(root)).collect()}
    assert found == {"a.JPG": 0, "b.png": 1, "d.png": None, "e.webp": 0, "f.jpeg": 1, "real.png": None}


def test_score_cache_and_log(spark, tmp_path):
    doc = {"records": [{"img_id": "i", "binary_label": 1, "chain_scores": {"clean": 0.5, "x": 0.25}}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=2))
    assert {(r["condition"], r["score"]) for r in readers.score_cache(spark, str(tmp_path / "c.json")).collect()} == {("clean", 0.5), ("x", 0.25)}
    lines = [json.dumps({"image_path": f"p{k % 300}", "pred": k / 7000}) for k in range(7000)] + ["", '{"image_path": "p5", "pred": 0.125}', '{"image_path": "p6", "pr']
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    expected = {f"p{k % 300}": k / 7000 for k in range(7000)} | {"p5": 0.125}
    for size in ("128m", "20k"):  # in one part, and in several
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = readers.score_log(spark, str(tmp_path / "l.jsonl"), "image_path string, pred double").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert {r["image_path"]: r["pred"] for r in rows} == expected and rows[0].asDict().keys() == {"image_path", "pred"}


def test_cache_provenance(spark, tmp_path):
    path = str(tmp_path / "cache")
    sinks.cache(spark.range(3), path, {"model": "m1"})
    assert readers.checked_cache(spark, path, {"model": "m1"}).count() == 3
    with pytest.raises(ValueError):
        readers.checked_cache(spark, path, {"model": "m2"})


def test_csv_and_export(spark, tmp_path):
    sinks.csv_table(spark.createDataFrame([(1, 2)], "a int, b int"), str(tmp_path / "t"), ["b", "a"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "t")).columns == ["b", "a"]
    rows = spark.createDataFrame([("a/b", "PNG", b"xy")], "img_id string, format string, content binary")
    sinks.export(sinks.manifest(rows), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a_b.png").read_bytes() == b"xy"
    both = sinks.relation_folders(spark.createDataFrame([(b"s", b"e1", 0), (b"s", b"e2", 1)], "source binary, edited binary, row int"))
    assert both.groupBy("name").count().count() == 3


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "error" if i % 2 else "ok", 60.0) for i in range(10)], "event_id long, ts string, event_type string, value double")
    events = events.withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    run = lambda: windows.append_scores(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    query = windows.stream_metrics(spark, str(tmp_path / "in"), events.schema).writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(r["count"] for r in spark.table("w").collect()) == 10
