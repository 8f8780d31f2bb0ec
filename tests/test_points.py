"""The scan of a vector store: every point once, filters in the store."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.sources import points as P

SCHEMA = "id long, label int, text string"


@pytest.fixture(scope="module")
def collection(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('points')}/c"
    rows = [(i * 3 - 500, i % 7, None if i % 5 == 0 else f" text {i} " if i % 11 else "  ") for i in range(1000)]
    P.index_points(spark.createDataFrame(rows + [(None, 1, "x")], SCHEMA), path, files=4, row_group=1024)
    return path, rows


@pytest.mark.parametrize("page", [1, 2, 7, 250, 333, 999, 1000, 1001, 5000])
@pytest.mark.parametrize("parts", [1, 3, 100])
def test_every_point_once(collection, page, parts):
    """Without Spark: all ranges, page by page, also where a page ends at the border of a range or of the table."""
    path, rows = collection
    schema = StructType.fromDDL(SCHEMA)
    if page < 7 and parts > 1:
        pytest.skip("slow and nothing new")
    reader = P.PointReader({"collection": path, "page": str(page), "parts": str(parts)}, schema)
    got = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert [(r["id"], r["label"], r["text"]) for r in got] == rows
    assert parts == 1 or len(reader.partitions()) > 1


def test_scan_with_filters_in_the_store(spark, collection):
    path, rows = collection
    key = lambda r: (r[0], r[1], r[2] or "")
    got = lambda df: sorted((tuple(r) for r in df.collect()), key=key)
    assert got(P.scan_points(spark, path, SCHEMA, page=10, parts=5)) == rows
    cut = P.scan_points(spark, path, SCHEMA, {"label": 3}, -100, 999, page=10, parts=5)
    want = [r for r in rows if r[1] == 3 and -100 <= r[0] < 1000]
    assert got(cut) == want
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan points" in plan and "Filter [" not in plan and "Filter (" not in plan  # nothing is left to Spark
    other = P.scan_points(spark, path, SCHEMA, {"label": 2, "text": " text 2 "})
    assert got(cut.union(other)) == sorted([*want, (-494, 2, " text 2 ")], key=key)
    assert got(cut.where("id > 50").union(cut.where("id < 0"))) == [r for r in want if r[0] > 50 or r[0] < 0]
    assert P.scan_points(spark, path, SCHEMA, low=-500, high=-500).count() == 1 and P.scan_points(spark, path, SCHEMA, low=6, high=5).count() == 0
    for bad in ({"other": 1}, {"label": None}):
        with pytest.raises(ValueError, match="filter by"):
            P.scan_points(spark, path, SCHEMA, bad)


def test_only_what_passes_leaves_the_store(collection):
    path, rows = collection
    reader = P.PointReader({"collection": path, "page": "9", "low": "11", "high": "1200", "equal": '{"label": 3}'}, StructType.fromDDL(SCHEMA))
    got = [r["id"] for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert got == [r[0] for r in rows if 11 <= r[0] <= 1200 and r[1] == 3]


def test_documents_of_points(spark, collection):
    path, rows = collection
    got = {r.doc_id: r.text for r in P.point_documents(P.scan_points(spark, path, SCHEMA)).collect()}
    assert got == {str(i): t.strip() for i, _, t in rows if t and t.strip()}


def test_empty_collection(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    P.index_points(spark.createDataFrame([], SCHEMA), path)
    assert P.scan_points(spark, path, SCHEMA).count() == 0
    assert P.scan_points(spark, path, SCHEMA).select(F.sum("id")).first()[0] is None
