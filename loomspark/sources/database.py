"""Conversations and documents in a database, over JDBC.

Filters reach the database as Spark pushes them; a page (order, offset, limit) is stated in the query itself, in standard
SQL, so that only its rows travel. Inserts go to a table of their own first, in batches and from all tasks, and are
taken over by one statement that leaves out keys that are already there: a write that is repeated adds nothing.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 100


def _name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", name):
        raise ValueError(f"{name!r} cannot be a name")
    return name


def _column(name: str) -> str:
    """Quoted, as Spark writes column names; case counts."""
    return f'"{_name(name)}"'


def _value(v) -> str:
    """A literal in standard SQL."""
    if v is None:
        raise ValueError("a filter by null is no equality")
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def stored(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, **properties: str) -> DataFrame:
    """A table; with ``key`` (a whole number) read by ranges between its least and greatest value, one a task."""
    reader = spark.read.format("jdbc").option("url", url).options(**properties)
    table = _name(table)
    if key:
        low, high = reader.option("query", f"SELECT MIN({_column(key)}) AS lo, MAX({_column(key)}) AS hi FROM {table}").load().first()
        if low is not None and high > low:
            reader = spark.read.format("jdbc").option("url", url).options(**properties)
            return reader.option("dbtable", table).option("partitionColumn", key).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", parts).load()
    return spark.read.format("jdbc").option("url", url).options(**properties).option("dbtable", table).load()


def stored_page(spark: SparkSession, url: str, table: str, equal: dict | None = None, order: list[tuple[str, int]] | None = None, limit: int = 0, offset: int = 0, **properties: str) -> DataFrame:
    """Rows that equal ``equal``, by ``order`` (name, +1 or -1), a page of them; all done by the database. 0 is no limit."""
    where = " AND ".join(f"{_column(k)} = {_value(v)}" for k, v in (equal or {}).items())
    by = ", ".join(f"{_column(k)}{' DESC' if s < 0 else ''}" for k, s in order or [])
    query = f"SELECT * FROM {_name(table)}" + (f" WHERE {where}" if where else "") + (f" ORDER BY {by}" if by else "")
    query += (f" OFFSET {int(offset)} ROWS" if offset else "") + (f" FETCH NEXT {int(limit)} ROWS ONLY" if limit else "")
    return spark.read.format("jdbc").option("url", url).options(**properties).option("query", query).load()


def count_matching(spark: SparkSession, url: str, table: str, equal: dict | None = None, **properties: str) -> int:
    """How many rows a page is cut from."""
    where = " AND ".join(f"{_column(k)} = {_value(v)}" for k, v in (equal or {}).items())
    query = f"SELECT COUNT(*) AS n FROM {_name(table)}" + (f" WHERE {where}" if where else "")
    return int(spark.read.format("jdbc").option("url", url).options(**properties).option("query", query).load().first()[0])


def execute(spark: SparkSession, url: str, *statements: str, **properties: str) -> int:
    """Runs statements in one transaction, from the driver; gives the rows that the last one changed."""
    jvm = spark._jvm
    p = jvm.java.util.Properties()
    for k, v in properties.items():
        p.setProperty(k, v)
    con = jvm.java.sql.DriverManager.getConnection(url, p)
    changed = 0
    try:
        con.setAutoCommit(False)
        for s in statements:
            st = con.createStatement()
            changed = st.executeUpdate(s)
            st.close()
        con.commit()
    except Exception:
        con.rollback()
        raise
    finally:
        con.close()
    return changed


def insert(rows: DataFrame, url: str, table: str, key: str, short: tuple[str, ...] = (), batch: int = BATCH, **properties: str) -> int:
    """Adds ``rows`` whose ``key`` is not in ``table`` yet, and gives their number; of rows that share a key one is
    taken, rows without a key are left out. The table is made if it is missing, with an index that holds the key unique; texts named in ``short`` (and a key) get at most 255 characters, so that
    databases can compare them.

    A unique index on the rows' own table lets a task that is run again after it had committed fail rather than add its
    rows twice; calling this again is always safe.
    """
    spark, key, table = rows.sparkSession, _name(key), _name(table)
    names = ", ".join(_column(c) for c in rows.columns)
    types = ", ".join(f"{f.name} VARCHAR(255)" for f in rows.schema if f.name in (key, *short) and f.dataType.simpleString() == "string")
    own = f"incoming_{uuid.uuid4().hex[:16]}"
    rows = rows.where(F.col(key).isNotNull()).dropDuplicates([key])

    def write(df: DataFrame, to: str, mode: str) -> None:
        w = df.write.format("jdbc").option("url", url).options(**properties).option("dbtable", to).option("batchsize", batch).option("isolationLevel", "READ_COMMITTED")
        (w.option("createTableColumnTypes", types) if types and mode == "error" else w).mode(mode).save()

    try:
        stored(spark, url, table, **properties).schema  # noqa: B018
    except Exception:  # no such table yet
        write(rows.limit(0), table, "error")
        execute(spark, url, f"CREATE UNIQUE INDEX {table.replace('.', '_')}_{key} ON {table} ({_column(key)})", **properties)
    write(rows.limit(0), own, "error")
    try:
        execute(spark, url, f"CREATE UNIQUE INDEX {own}_{key} ON {own} ({_column(key)})", **properties)
        write(rows, own, "append")
        return execute(spark, url, f"INSERT INTO {table} ({names}) SELECT {names} FROM {own} i WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE t.{_column(key)} = i.{_column(key)})", **properties)
    finally:
        execute(spark, url, f"DROP TABLE {own}", **properties)
