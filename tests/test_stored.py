"""JSON paths and digests, numbered lines, merged files, databases."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import json as J
from loomspark.sources import database as D
from loomspark.sources import readers

# ---- JSON


def test_equal_objects_share_a_digest(spark):
    a = {"b": [1, {"y": 1, "x": "é"}], "a": None, "c": {"z": True, "a.b": 2.5}}
    texts = [json.dumps(a), json.dumps(a, sort_keys=True, indent=2), '{"c":{"a.b":2.5,"z":true},"a":null,"b":[1,{"x":"\\u00e9","y":1}]}', '{"a": 1}', "{broken", None, "[1, 2]", '"t"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.c, r.d) for r in df.select("i", J.canonical(F.col("t")).alias("c"), J.object_digest(F.col("t")).alias("d")).collect()}
    assert got[0] == got[1] == got[2] and got[0][0] == json.dumps(a, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[3][0] == '{"a":1}' and got[4] == got[5] == (None, None) and got[6][0] == "[1,2]" and got[7][0] == '"t"'


def test_paths(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, {"c": "x"}]}, "d.e": true, "f": null}',), ("no",), (None,)], "t string")
    for key, want in (("a.b[1].c", "x"), ("a.b[0]", "1"), ('"d.e"', "true"), ("f", None), ("g.h", None)):
        assert [r[0] for r in df.select(J.at_path(F.col("t"), key)).collect()] == [want, None, None]
    assert [r[0] for r in df.select(J.at_path(F.col("t"), "a.b[1].c", "int")).collect()] == [None] * 3
    rows = spark.createDataFrame([(1, '{"k": {"x": 5}, "s": "y", "on": true}'), (2, '{"k": {"x": "5"}}'), (3, "bad"), (4, None)], "id int, metadata string")
    page = lambda **equal: sorted(r.id for r in readers.page(rows, {k.replace("__", "."): v for k, v in equal.items()}).collect())
    assert page(metadata__k__x=5) == [1, 2] and page(metadata__s="y") == [1] and page(metadata__on=True) == [1] and page(metadata__none=1) == []


def test_document_digests(spark):
    texts = ["plain", 'q"\\u0041\\ \\\\ / \n\t\b\f\r\x01\x1f\x7f', "é ß 漢字 🙂  ", "", "\\", "\\u00E9 É"]
    df = spark.createDataFrame([(f"id{i}é", t) for i, t in enumerate(texts)], "i string, t string")
    got = df.select("i", "t", J.quoted(F.col("t")).alias("q"), J.document_digest(F.col("i"), F.col("t")).alias("d")).collect()
    for r in got:
        assert r.q == json.dumps(r.t)
        assert r.d == hashlib.sha256(json.dumps({"id": r.i, "excerpt": r.t}, sort_keys=True).encode()).hexdigest()


# ---- lines


@pytest.fixture
def files(tmp_path):
    r = random.Random(0)
    for name in ("a", "b", "c"):
        rows = [json.dumps({"text": f" {name}{i} " + "x" * r.randrange(60)}) if i % 7 else ("", "{bad", "[1]", '{"text": 5}', '{"text": "  "}', '{"other": "x"}')[i // 7 % 6] for i in range(400)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + ("\n" if name != "b" else ""))
    return tmp_path


@pytest.mark.parametrize("split", [None, "1000b", "137b"])
def test_numbered_lines(spark, files, split):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = readers.numbered_lines(spark, str(files / "*.jsonl"))
        assert not split or lines.rdd.getNumPartitions() >= 4 or spark.read.text(str(files)).rdd.getNumPartitions() > 10
        got = {(r.file, r.line): r.value for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == {(str(f), i): x for f in files.glob("*.jsonl") for i, x in enumerate(f.read_text().splitlines(), 1)}


def test_documents_of_files(spark, files):
    want = {}
    for f in files.glob("*.jsonl"):
        for i, x in enumerate(f.read_text().splitlines(), 1):
            try:
                t = json.loads(x)["text"].strip()
            except (ValueError, KeyError, TypeError, AttributeError):
                continue
            if t:
                want[f"{f}:{i}"] = t
    got = readers.document_jsonl(spark, str(files / "a.jsonl"), str(files / "[bc].jsonl"))
    assert {r.doc_id: r.text for r in got.collect()} == want and got.count() == len(want)
    first = readers.document_jsonl(spark, str(files / "*.jsonl"), most=5)
    assert [r.doc_id for r in first.collect()] == [f"{files}/a.jsonl:{i}" for i in range(2, 7)]
    bad = readers.malformed_lines(readers.numbered_lines(spark, str(files / "*.jsonl")))
    assert {r.value for r in bad.collect()} == {"{bad", "[1]"} and bad.count() == 3 * 20


def test_ids_and_metadata(spark, tmp_path):
    rows = [{"id": "k", "text": "a", "metadata": {"context_id": "c", "x": 1}, "x": 2, "y": [1, 2]}, {"text": "a", "metadata": {"context_id": "c"}}, {"text": "a"}, {"id": "", "text": "a", "metadata": "no"}, {"body": "b", "text": "t"}]
    f = tmp_path / "m.jsonl"
    f.write_text("\n".join(json.dumps(r) for r in rows))
    ids = lambda **how: [r.doc_id for r in readers.document_jsonl(spark, str(f), **how).orderBy("text").collect()]
    assert ids() == ["k", "c", f"{f}:3", f"{f}:4", f"{f}:5"] and ids(preserve_ids=False) == [f"{f}:{i}" for i in range(1, 6)]
    assert [r.text for r in readers.document_jsonl(spark, str(f), content_key="body").collect()] == ["b"]
    meta = {r.doc_id: r.metadata for r in readers.document_jsonl(spark, str(f), include_metadata=True).collect()}
    assert meta["k"] == {"context_id": "c", "x": "1", "y": "[1,2]"} and meta[f"{f}:3"] == {} and meta[f"{f}:5"] == {"body": "b"}


def test_merged_files(spark, tmp_path):
    for name, rows in (("z", [{"a": 1}, {"a": 2}]), ("y", [{"b": "x"}]), ("x", [{"a": 3, "b": "y"}])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    df = readers.merge_lines(spark, [str(tmp_path / f"{n}.jsonl") for n in "zyx"], str(tmp_path / "out"))
    assert sorted(df.columns) == ["a", "b"]
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == ['{"a": 1}', '{"a": 2}', '{"b": "x"}', '{"a": 3, "b": "y"}']


# ---- a database


@pytest.fixture
def url(tmp_path):
    return f"jdbc:derby:{tmp_path}/db;create=true"


ROWS = "id long, doc string, lang string, score double"


def rows(spark, a, b):
    return spark.createDataFrame([(i, f"text '{i}' é", "en" if i % 3 else "de", i / 4) for i in range(a, b)], ROWS).repartition(3)


def test_inserts_are_idempotent(spark, url):
    assert D.insert(rows(spark, 0, 250), url, "docs", "id") == 250
    assert D.insert(rows(spark, 0, 250), url, "docs", "id") == 0
    more = rows(spark, 200, 300).union(rows(spark, 290, 300)).union(spark.createDataFrame([(None, "x", "y", 1.0)], ROWS))
    assert D.insert(more, url, "docs", "id") == 50
    got = D.stored(spark, url, "docs")
    assert got.count() == 300 and sorted(r.id for r in got.collect()) == list(range(300))
    with pytest.raises(ValueError, match="cannot be a name"):
        D.insert(more, url, "docs; drop table docs", "id")
    assert D.insert(spark.createDataFrame([("k1", "a"), ("k2", None)], "name string, body string"), url, "named", "name") == 2
    assert D.insert(spark.createDataFrame([("k2", "z"), ("k3", "c")], "name string, body string"), url, "named", "name") == 1
    assert {r[0]: r[1] for r in D.stored(spark, url, "named").collect()} == {"k1": "a", "k2": None, "k3": "c"}


def test_a_failed_write_adds_nothing(spark, url):
    D.insert(rows(spark, 0, 10), url, "docs", "id")
    broken = rows(spark, 10, 500).withColumn("score", F.when(F.col("id") == 400, F.raise_error("no")).otherwise(F.col("score")).cast("double"))
    with pytest.raises(Exception, match="no"):
        D.insert(broken, url, "docs", "id")
    assert D.count_matching(spark, url, "docs") == 10
    assert D.insert(rows(spark, 0, 500), url, "docs", "id") == 490


def test_pages_and_filters_are_the_databases_work(spark, url):
    D.insert(rows(spark, 0, 100), url, "docs", "id", short=("doc", "lang"))
    page = D.stored_page(spark, url, "docs", {"lang": "en"}, [("score", -1), ("id", 1)], limit=5, offset=3)
    assert [r[0] for r in page.collect()] == [i for i in range(99, -1, -1) if i % 3][3:8]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "\"lang\" = 'en'" in plan and 'ORDER BY "score" DESC, "id"' in plan and "OFFSET 3 ROWS" in plan and "FETCH NEXT 5 ROWS ONLY" in plan and "Sort" not in plan
    assert D.count_matching(spark, url, "docs", {"lang": "de"}) == 34 and D.stored_page(spark, url, "docs", {"doc": "text '7' é"}).count() == 1
    by_range = D.stored(spark, url, "docs", "id", 4)
    assert by_range.rdd.getNumPartitions() == 4 and by_range.count() == 100
    cut = by_range.where("lang = 'en' AND id > 90")
    assert "PushedFilters: [" in (p := cut._jdf.queryExecution().executedPlan().toString()) and "*EqualTo" in p and "*GreaterThan" in p
    assert cut.count() == len([i for i in range(91, 100) if i % 3])
    with pytest.raises(ValueError):
        D.stored_page(spark, url, "docs", {"lang": None})
