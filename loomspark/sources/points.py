"""Points of a vector store as a table: a Python data source that scrolls by key.

The keys are split into ranges, one for each partition of the scan; inside a range pages follow one another by key
(``id`` greater than the last one seen), so that every point comes once, whatever the page size and whatever is added
behind the scan. What the store shall filter (payload fields that equal a value, bounds of the key) is stated in the
scan. Spark can push filters into a Python source by itself, but in 4.1 it keeps them with the table and not with the
scan: two differently filtered scans of one table in one query would both get the rows of the last one. So
the source takes none of them, and what a query filters besides is done by Spark.

A store is reached through a client with ``splits`` and ``scroll``; vendors' clients are not part of the library. The
one here keeps a collection as Parquet files in a folder that all executors reach.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import strip

PAGE, ROW_GROUP = 500, 1 << 20
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Client(Protocol):
    """What the scan asks of a store; ids are integers, ranges are closed."""

    def splits(self, low: int, high: int, parts: int) -> list[tuple[int, int]]:
        """Ranges that together hold all ids from ``low`` to ``high``."""

    def scroll(self, low: int, high: int, limit: int, equal: dict, fields: list[str]) -> pa.Table:
        """The first ``limit`` points by id in the range whose payload fields equal ``equal``."""


class FolderClient:
    """A collection in a folder of Parquet files whose row groups are sorted by id; see ``index_points``."""

    def __init__(self, uri: str):
        self.fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        files = [f.path for f in self.fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".parquet")]
        self.groups = []  # least id, greatest id, file, number: from the footers only
        for f in files:
            footer = pq.read_metadata(f, filesystem=self.fs)
            at = footer.schema.to_arrow_schema().get_field_index("id")
            for g in range(footer.num_row_groups):
                known = footer.row_group(g).column(at).statistics
                if known is not None and known.has_min_max:
                    self.groups.append((known.min, known.max, f, g))
        self.groups.sort()

    def splits(self, low, high, parts):
        starts = sorted({max(low, a) for a, b, *_ in self.groups if b >= low and a <= high})
        starts = [low, *starts[1:][:: max(1, -(-len(starts) // parts))]] if starts else []
        return [(a, b - 1) for a, b in zip(starts, [*starts[1:], high + 1])]

    def scroll(self, low, high, limit, equal, fields):
        found, have = [], 0
        for least, most, file, group in self.groups:
            if have >= limit and least > found[-1]["id"][-1].as_py():  # all that follows is behind the page
                break
            if most < low or least > high:
                continue
            wanted = list(dict.fromkeys(["id", *fields, *equal]))
            t = pq.ParquetFile(file, filesystem=self.fs).read_row_group(group, columns=wanted)
            keep = pc.and_(pc.greater_equal(t["id"], low), pc.less_equal(t["id"], high))
            for k, v in equal.items():
                keep = pc.and_(keep, pc.equal(t[k], pa.scalar(v, t[k].type)))
            t = t.filter(pc.fill_null(keep, False))
            if t.num_rows:
                found = [pa.concat_tables([*found, t]).sort_by("id").slice(0, limit)]
                have = found[0].num_rows
        return found[0].select(["id", *[c for c in fields if c != "id"]]) if found else None


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class PointReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = dict(options), schema
        self.low, self.high = int(options.get("low", LEAST)), int(options.get("high", MOST))
        self.equal = json.loads(options.get("equal", "{}"))

    def client(self) -> Client:
        """Made anew where it is used: on the driver for the ranges, in every task for the pages."""
        module, _, name = self.options.get("client", f"{__name__}:FolderClient").partition(":")
        return getattr(importlib.import_module(module), name)(self.options["collection"])

    def partitions(self) -> list[Range]:
        parts = int(self.options.get("parts", "8"))
        return [Range(a, b) for a, b in (self.client().splits(self.low, self.high, parts) if self.low <= self.high else [])]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        client, low, page = self.client(), partition.low, int(self.options.get("page", str(PAGE)))
        fields = self.schema.fieldNames()
        while low <= partition.high:
            points = client.scroll(low, partition.high, page, self.equal, fields)
            if points is None or not points.num_rows:
                return
            yield from points.select(fields).cast(to_arrow_schema(self.schema)).to_batches()
            if points.num_rows < page:
                return
            low = points["id"][-1].as_py() + 1


class PointSource(DataSource):
    """Format ``points``; options ``collection``, ``client`` (``module:class``), ``page``, ``parts``, ``low``, ``high``
    and ``equal`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "points"

    def schema(self) -> str:
        return "id long"

    def reader(self, schema: StructType) -> PointReader:
        return PointReader(self.options, schema)


def scan_points(spark: SparkSession, collection: str, schema: str, equal: dict | None = None, low: int = LEAST, high: int = MOST, page: int = PAGE, parts: int = 8, client: str | None = None) -> DataFrame:
    """The points of a collection with ``id`` and the payload fields of ``schema``: of ids from ``low`` to ``high``,
    and with the payload values of ``equal`` (fields of ``schema``; null is no value)."""
    kind = StructType.fromDDL(schema)
    if unknown := {*(equal or {})} - {*kind.fieldNames()} or {k for k, v in (equal or {}).items() if v is None}:
        raise ValueError(f"no field to filter by, or no value: {sorted(unknown)}")
    spark.dataSource.register(PointSource)
    given = {"collection": collection, "page": str(page), "parts": str(parts), "low": str(low), "high": str(high), "equal": json.dumps(equal or {})}
    return spark.read.format("points").schema(kind).options(**given, **({"client": client} if client else {})).load()


def point_documents(points: DataFrame, content: str = "text") -> DataFrame:
    """``doc_id, text`` of points that have a text: stripped, blank ones dropped."""
    text = strip(F.col(content))
    return points.where(F.col(content).isNotNull()).select(F.col("id").cast("string").alias("doc_id"), text.alias("text")).where("text <> ''")


def index_points(rows: DataFrame, path: str, files: int = 8, row_group: int = ROW_GROUP) -> None:
    """Writes ``rows(id, ...)`` as a collection for ``FolderClient``: ranges of ids, sorted, row groups of about
    ``row_group`` bytes; rows without an id are left out."""
    rows.where("id IS NOT NULL").repartitionByRange(files, "id").sortWithinPartitions("id").write.mode("overwrite").option("parquet.block.size", row_group).parquet(path)
