import pytest
from pyspark.sql import functions as F

from plumbline.operators import dataset, metrics

PNG = b"\x89PNG\r\n\x1a\n0000"


def files(spark, names, root="/data"):
    rows = [(f"file:{root}/{n}", b"broken" if "corrupt" in n else PNG) for n in names]
    return spark.createDataFrame(rows, "path string, content binary")


LAYOUT = [
    "train/authentic/g1/source.png", "train/ai_edited/g1/edit_0.png", "train/synthetic/x_AI-Edited.png", "train/authentic/y_v3.JPG", "train/authentic/g2/corrupt.png",
    "train/other/z.png", "train/authentic/notes.txt", "validation/authentic/g3/a.png", "test/moderate_edit/h/b_real.webp", "train/loose.png",
]


def test_discovery(spark):
    masks = spark.createDataFrame([(f"file:/masks/{n}",) for n in (
        "train/ai_edited/g1/edit_0_mask.png", "train/ai_edited/g1/edit_0.webp", "train/synthetic/x_AI-Edited_mask.jpg", "validation/authentic/g3/a_mask.png", "other/a.png",
    )], "path string")
    found = {r["image_path"].split("/data/")[1]: r for r in dataset.discover(files(spark, LAYOUT), "/data/train", "train", masks=masks, mask_root="/masks").collect()}
    assert set(found) == {LAYOUT[k] for k in (0, 1, 2, 3, 4)}
    about = {k: (r["label"], r["subgroup"], r["group_id"], r["readable"]) for k, r in found.items()}
    assert about[LAYOUT[0]] == (0, "authentic", "g1", True) and about[LAYOUT[1]] == (1, "minor_edit", "g1", True)
    # a folder that is no class folder is part of the group
    assert about[LAYOUT[2]] == (1, "synthetic", "synthetic", True) and about[LAYOUT[3]] == (0, "authentic", "y", True) and not about[LAYOUT[4]][3]
    assert {k: r["mask_path"] and r["mask_path"].split("/masks/")[1] for k, r in found.items()} == {
        LAYOUT[0]: None, LAYOUT[1]: "train/ai_edited/g1/edit_0.webp", LAYOUT[2]: "train/synthetic/x_AI-Edited_mask.jpg", LAYOUT[3]: None, LAYOUT[4]: None}
    row = dataset.summary(dataset.discover(files(spark, LAYOUT), "/data/train", "train")).first()
    assert (row["total"], row["valid"], row["corrupt"], row["authentic"], row["edited"], row["groups"], row["missing_masks"]) == (5, 4, 1, 2, 2, 3, 4)


def test_group_maps_and_prefixes(spark):
    names = spark.createDataFrame([("authentic/y_v3.JPG", "by path"), ("y_v3.JPG", "by name"), ("edit_0.png", "e")], "name string, group string")
    found = dataset.discover(files(spark, LAYOUT), "/data/train", "train", group_map=names, prefix="p").collect()
    assert {r["image_path"].split("/")[-1]: r["group_id"] for r in found} == {
        "source.png": "p:g1", "edit_0.png": "p:e", "x_AI-Edited.png": "p:synthetic", "y_v3.JPG": "p:by path", "corrupt.png": "p:g2"}
    with pytest.raises(ValueError):
        dataset.discover(files(spark, LAYOUT), "/data/train", "train", folders={"strange": "x"})
    with pytest.raises(ValueError):
        dataset.discover(files(spark, LAYOUT), "/data/train", "train", folders={"synthetic": "authentic"})


def test_all_splits(spark):
    assert {r["split"]: r["n"] for r in dataset.discover_all(files(spark, LAYOUT), "/data").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()} == {"train": 4, "validation": 1, "test": 1}
    with pytest.raises(ValueError):
        dataset.discover_all(files(spark, [*LAYOUT, "test/authentic/g1/again.png"]), "/data")


def records(spark):
    rows = [(f"t{k}", k % 2, "train", f"g{k // 2}", f"h{k}") for k in range(40)] + [(f"v{k}", k % 2, "validation", f"v{k // 2}", f"vh{k}") for k in range(10)]
    rows += [("c1", 0, "train", "g50", "same"), ("c2", 1, "validation", "v50", "same")]
    return spark.createDataFrame(rows, "path string, label int, split string, group_id string, hash string")


def test_assembly(spark):
    pool = spark.createDataFrame([(f"s{k}", 1, "pool", f"q{k % 3}", f"ph{k}") for k in range(30)], "path string, label int, split string, group_id string, hash string")
    out = dataset.assemble(records(spark), pool, 0.2, group_limit=8).collect()
    train = [r for r in out if r["split"] == "train"]
    mixed = [r for r in train if r["group_id"].startswith("synthetic_mixture:q")]
    assert len(train) - len(mixed) == 16 and len(mixed) == 4 and len([r for r in out if r["split"] == "validation"]) == 10
    assert not {"c1", "c2"} & {r["path"] for r in out}
    assert sorted(map(tuple, out)) == sorted(map(tuple, dataset.assemble(records(spark).repartition(5), pool.repartition(3), 0.2, group_limit=8).collect()))
    assert dataset.assemble(records(spark)).count() == 50
    assert len([r for r in dataset.assemble(records(spark), pool, 0.9).collect() if r["path"].startswith("s")]) == 30
    with pytest.raises(ValueError):
        dataset.assemble(records(spark).union(records(spark).where("path = 't0'").withColumn("split", F.lit("test"))))
    with pytest.raises(ValueError):
        dataset.assemble(records(spark), pool, 1.0)


def test_holdout_gate():
    dataset.check_holdout(["a", "b"], ["c"], ["a", "b", "c"])
    for trained, held in ((["a"], ["a"]), (["a"], ["x"]), (["a"], [])):
        with pytest.raises(ValueError):
            dataset.check_holdout(trained, held, ["a", "b"])


def test_frozen_threshold_guards(spark):
    one = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7)], "doc_id long, binary_label int, score double")
    with pytest.raises(ValueError):
        metrics.frozen_threshold(one)
    with pytest.raises(ValueError, match="7"):
        metrics.frozen_threshold(one.union(spark.createDataFrame([(7, 0, None)], one.schema)))
    assert metrics.frozen_threshold(one.union(spark.createDataFrame([(3, 0, 0.2)], one.schema))).first()["balanced"] == 0.5
    row = metrics.metrics_or_null(one.withColumn("k", F.lit(1)), ["k"], 0.6).first()
    assert row["tp"] == 1 and row["accuracy"] is None and row["auc"] is None and row["fpr"] is None
