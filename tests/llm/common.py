"""Plain forms of the shared definitions, and the rows that every operator must stand."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, component_id string, weight string, p string, bucket string, Slot string, n string, __source string, __row string, __leak string, __n_words long, SHARD string, host string, verdict string"


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def rest(i, m):
    return zlib.crc32(str(i).encode()) % m


def awkward(spark, extra=()):
    """Nulls in every column, empty, blank and very long texts, ties, and columns with clashing names, some in another case."""
    base = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", "  \t\n", "one", "one", base, base, base + " tail", "É ß 漢字 🙂\x0bx\x85y z", "long " * 20000, "a" * 70000, "x\n\nx\ny\nx", *extra]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 2}", None, None, "c", "w", "q", "b", "s", "m", "a", "r", "l", 1, "S", None, "v") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def without_ids(spark):
    """The same, then rows with null ids and rows that repeat an id, with the same text and with another."""
    df = awkward(spark)
    more = df.where("doc_id in (1, 5, 7, 9)").drop("doc_id").selectExpr("cast(null as bigint) as doc_id", "*")
    return df.union(more).union(df.where("doc_id in (5, 8)")).union(df.where("doc_id = 7").drop("doc_id").selectExpr("cast(3 as bigint) as doc_id", "*"))
