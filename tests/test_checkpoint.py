"""Checkpoints: round trip, changed bytes, stale parts, unknown versions, broken trees."""

import json
from pathlib import Path

import pytest

from loomspark.operators.taxonomy import NODES
from loomspark.sources import checkpoint as C

TREE = [("f", "r", None, 0, "all"), ("f", "a", "r", 1, "A"), ("f", "b", "r", 1, "B"), ("f", "c", "a", 2, "C")]


def nodes(spark, rows=TREE):
    return spark.createDataFrame(rows, NODES)


def saved(spark, root, **how):
    strategy = spark.createDataFrame([("s1", 1.0)], "name string, weight double")
    return C.save(spark, root, {"taxonomy": nodes(spark).repartition(3), "strategy": strategy}, {"instruction": "write é\n", "run": '{"name": "x"}'}, **how)


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/run"


def local(root):
    return Path(root.removeprefix("file://"))


def test_round_trip(spark, root):
    assert saved(spark, root) == 1
    c = C.load(spark, root)
    assert c.version == 1 and sorted(map(tuple, c.tables["taxonomy"].collect())) == sorted(TREE)
    assert [tuple(r) for r in c.tables["strategy"].collect()] == [("s1", 1.0)] and c.texts == {"instruction": "write é\n", "run": '{"name": "x"}'}
    assert C.differences(spark, root, 1).count() == 0


def test_what_a_later_save_leaves_out_does_not_come_back(spark, root):
    saved(spark, root)
    assert C.save(spark, root, {"taxonomy": nodes(spark)}) == 2
    c = C.load(spark, root)
    assert c.version == 2 and list(c.tables) == ["taxonomy"] and c.texts == {}
    assert C.load(spark, root, version=1).texts["run"] == '{"name": "x"}'
    saved(spark, root)
    assert C.versions(spark, root) == [2, 3]  # two are kept
    with pytest.raises(FileNotFoundError, match="version 1"):
        C.load(spark, root, version=1)


def test_changes_are_found(spark, root):
    saved(spark, root)
    part = next((local(root) / "version=1/data/taxonomy").glob("part-*"))
    (part.parent / f".{part.name}.crc").unlink()
    whole = part.read_bytes()
    part.write_bytes(whole[:40] + bytes([whole[40] ^ 1]) + whole[41:])
    with pytest.raises(C.CheckpointError, match="digest mismatch"):
        C.load(spark, root)
    assert C.load(spark, root, verify=False).version == 1
    part.write_bytes(whole)
    assert C.load(spark, root).version == 1
    extra = part.with_name("part-99999.parquet")
    extra.write_bytes(whole)
    with pytest.raises(C.CheckpointError, match="not in the manifest"):
        C.load(spark, root)
    extra.unlink()
    part.unlink()
    with pytest.raises(C.CheckpointError, match="missing"):
        C.load(spark, root)


def change_manifest(root, change):
    folder = local(root) / "version=1/manifest"
    part = next(folder.glob("part-*"))
    (folder / f".{part.name}.crc").unlink(missing_ok=True)
    rows = [change(json.loads(x)) for x in part.read_text().splitlines()]
    part.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


@pytest.mark.parametrize("key,value,what", [("format_version", "99.0", "unsupported format_version '99.0'"), ("producer", "other", "unexpected producer"), ("format", None, "unexpected producer")])
def test_unknown_manifests(spark, root, key, value, what):
    saved(spark, root)
    change_manifest(root, lambda r: r | {key: value} if r["kind"] == "header" else r)
    with pytest.raises(C.CheckpointError, match=what):
        C.load(spark, root, verify=False)


def test_changed_texts(spark, root):
    saved(spark, root)
    change_manifest(root, lambda r: r | {"body": "other"} if r.get("name") == "instruction" else r)
    with pytest.raises(C.CheckpointError, match="instruction"):
        C.load(spark, root)


def test_a_save_that_broke_off_does_not_count(spark, root):
    with pytest.raises(FileNotFoundError):
        C.load(spark, root)
    saved(spark, root)
    nodes(spark).write.parquet(f"{root}/version=2/data/taxonomy")
    assert C.load(spark, root).version == 1 and saved(spark, root) == 3 and C.load(spark, root).version == 3
    assert C.versions(spark, root) == [1, 3]


def test_only_trees(spark, root):
    for rows in (TREE[1:], [*TREE, ("f", "x", "nobody", 1, "X")], [*TREE, ("f", "y", "r", 2, "Y")], [*TREE, ("f", "z", None, 0, "Z")]):
        with pytest.raises(C.CheckpointError, match="no tree"):
            C.save(spark, root, {"taxonomy": nodes(spark, rows)})
    C.save(spark, root, {"taxonomy": nodes(spark, TREE[1:])}, taxonomy=None)
    with pytest.raises(C.CheckpointError, match="no parent"):
        C.load(spark, root)


def test_empty_tables(spark, root):
    C.save(spark, root, {"taxonomy": nodes(spark, []), "other": spark.createDataFrame([], "x int")})
    assert {n: t.count() for n, t in C.load(spark, root).tables.items()} == {"taxonomy": 0, "other": 0}
