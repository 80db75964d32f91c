"""Early stop, the record source and the idempotent log."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import growing, readers, records
from plumbline.streaming import log

IMAGE = b"\xff\xd8\xff\xe0" + b"x" * 30
SCHEMA = "img_id string, image binary, label int"


def test_scan_stops_before_a_broken_shard(spark, tmp_path):
    for k, labels in enumerate([[0, 0, 1, 5], [1, 0], [2, 1, 1], [2, 0, 2], [0, 1, 2], [0]]):
        rows = [(None if j == 0 else f"i{k}-{j}", bytearray(IMAGE if j != 1 or k else b"junk"), y) for j, y in enumerate(labels)]
        folder = tmp_path / f"part{k}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder))
        next(folder.glob("*.parquet")).rename(tmp_path / f"train-{k:02}.parquet")
        for f in folder.iterdir():
            f.unlink()
        folder.rmdir()
    every = readers.capped(readers.labelled(readers.shards(spark, str(tmp_path), "train")), 2)
    assert sorted(map(tuple, growing.first_of_each(spark, str(tmp_path), 2, "train").collect())) == sorted(map(tuple, every.collect()))
    more = readers.capped(readers.labelled(readers.shards(spark, str(tmp_path), "train")), 100)
    assert growing.first_of_each(spark, str(tmp_path), 100, "train").count() == more.count()
    want = sorted(map(tuple, every.collect()))
    for name in ("train-04.parquet", "train-05.parquet"):  # jobs are of one, two and four shards
        (tmp_path / name).rename(tmp_path / f"gone-{name[-10:]}")
    (tmp_path / "train-90.parquet").write_bytes(b"not a table")
    (tmp_path / "train-91.parquet").write_bytes(b"not a table")
    found = growing.first_of_each(spark, str(tmp_path), 1, "train", schema=SCHEMA)
    assert {r["label"] for r in found.collect()} == {0, 1, 2} and found.count() == 3
    assert all(x in want for x in map(tuple, found.collect()))
    with pytest.raises(Exception):
        growing.first_of_each(spark, str(tmp_path), 50, "train", schema=SCHEMA).count()
    with pytest.raises(FileNotFoundError):
        growing.shard_paths(spark, str(tmp_path), "test")


def lines(rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


@pytest.mark.parametrize("block", [7, 64, 1 << 24])
def test_records_as_a_table(spark, tmp_path, block):
    records.register(spark)
    (tmp_path / "a.jsonl").write_text(lines([{"image_path": "p", "s": 1}, {"image_path": "q", "s": 2}]) + "\n{broken\n[1]\n" + lines([{"s": 3}, {"image_path": "p", "s": "é" * 50}]))
    (tmp_path / "b.jsonl").write_text(lines([{"image_path": "q", "s": 9}])[:-1])  # no line break at the end
    (tmp_path / "c.jsonl").write_text("")
    rows = spark.read.format("record_lines").option("path", str(tmp_path)).option("block", block).load()
    found = [(r["key"], json.loads(r["record"])["s"]) for r in sorted(rows.collect(), key=lambda r: (r["file"], r["at"]))]
    assert found == [("p", 1), ("q", 2), ("p", "é" * 50), ("q", 9)]
    assert {(r["key"], json.loads(r["record"])["s"]) for r in records.last_of_each(rows).collect()} == {("p", "é" * 50), ("q", 9)}


def test_a_stream_goes_on_in_the_middle_of_a_file(spark, tmp_path):
    records.register(spark)
    folder, path, mark = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "mark")
    folder.mkdir()
    made = {"model": "m1"}

    def run():
        rows = spark.readStream.format("record_lines").option("path", str(folder)).option("block", 40).load()
        rows = rows.select("key", "at", F.get_json_object("record", "$.s").cast("double").alias("score"))
        log.append(rows, path, mark, made, "key", "at")
        return {r["key"]: r["score"] for r in log.latest(spark, path, made, "key", "at").collect()}

    one = folder / "a.jsonl"
    one.write_text(lines([{"image_path": "p", "s": 1}, {"image_path": "q", "s": 2}]) + '{"image_path": "r", ')
    assert run() == {"p": 1.0, "q": 2.0}  # the last line is still being written
    with one.open("a") as more:
        more.write('"s": 3}\n' + lines([{"image_path": "p", "s": 4}]))
    assert run() == {"p": 4.0, "q": 2.0, "r": 3.0}
    assert run() == {"p": 4.0, "q": 2.0, "r": 3.0}  # nothing new
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    assert rows.count() == 4  # no line was read twice

    batch = spark.createDataFrame([("p", 900, 5.0), ("p", 901, 6.0), ("z", 1, 7.0)], "key string, at long, score double")
    commit = log.committer(path, made, "key", "at")
    commit(batch, 77)
    before = sorted(map(tuple, log.latest(spark, path, made, "key", "at").collect()))
    commit(batch, 77)  # the same batch again, as after a failure
    assert sorted(map(tuple, log.latest(spark, path, made, "key", "at").collect())) == before
    assert ("p", 901, 6.0) in before and len(before) == 4
    with pytest.raises(ValueError):
        log.committer(path, {"model": "m2"}, "key", "at")(batch, 78)
    with pytest.raises(ValueError):
        log.latest(spark, path, {"model": "m2"}, "key", "at")
