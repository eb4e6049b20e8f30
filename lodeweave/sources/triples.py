"""Facts out of another tool's SQLite file, as a Python data source."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "sqlite_triples"
SCHEMA = "row long, subject string, predicate string, object string, valid_from string, valid_to string, source string"
#: The table, its columns (of the last two either), and the versions of user_version that have this shape.
TABLE = "triples"
REQUIRED = ("subject", "predicate", "object", "valid_from", "valid_to")
SOURCES = ("source_file", "source")
VERSIONS = (0, 1)
#: Row ids that one task reads.
ROWS = 200_000


class SchemaMismatch(RuntimeError):
    """The file has not the shape that is read here."""


class SqliteTriples(DataSource):
    """Rows of the table triples of a SQLite file, empty ones too.

    Options: path (a file that the driver and every executor reach under this name, as on a shared mount; it is opened read-only), rows (of row ids a task). The
    version and the columns are looked at when the read is planned; what does not fit raises SchemaMismatch.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], int(self.options.get("rows", ROWS)))


class Rows(InputPartition):
    def __init__(self, low: int, high: int, source: str):
        self.low, self.high, self.source = low, high, source


class Reader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids from the smallest to the largest, by the index that the file keeps of them."""
        with closing(_opened(self.path)) as con:
            source = checked(con, self.path)
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {TABLE}").fetchone()
        if low is None:
            return [Rows(0, 0, source)]
        return [Rows(at, min(at + self.rows, high + 1), source) for at in range(low, high + 1, self.rows)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        text = lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else v if v is None else str(v)
        with closing(_opened(self.path)) as con:
            for row, *values in con.execute(f"SELECT rowid, {', '.join(REQUIRED)}, {partition.source} FROM {TABLE} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (partition.low, partition.high)):
                yield (row, *map(text, values))


def checked(con: sqlite3.Connection, path: str) -> str:
    """The column of sources, if version and columns are known ones."""
    version = con.execute("PRAGMA user_version").fetchone()[0]
    if version not in VERSIONS:
        raise SchemaMismatch(f"{path}: schema version {version}, known are {', '.join(map(str, VERSIONS))}")
    columns = {str(r[1], "utf-8") for r in con.execute(f"PRAGMA table_info({TABLE})")}
    if not columns:
        raise SchemaMismatch(f"{path}: no table {TABLE}")
    source = next((c for c in SOURCES if c in columns), None)
    missing = [c for c in REQUIRED if c not in columns] + ([] if source else [SOURCES[0]])
    if missing:
        raise SchemaMismatch(f"{path}: no column {', '.join(missing)}; there are {', '.join(sorted(columns))}")
    return source


def _opened(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro", uri=True)
    con.text_factory = bytes  # bytes that are no UTF-8 become U+FFFD, as in files
    return con


def triples(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """(id, subject, predicate, object, valid_from, valid_to, source) of the file: rows without a subject, predicate or object, or with an empty one, are left out.

    A fact's id is a hash of all it says, so that reading a file again gives the same ids; of rows that say the same the first stays.
    """
    spark.dataSource.register(SqliteTriples)
    with closing(_opened(path)) as con:  # where the plan is made, with the error as it is
        checked(con, path)
    every = spark.read.format(FORMAT).option("rows", rows).load(path)
    said = ["subject", "predicate", "object", "valid_from", "valid_to", "source"]
    whole = every.filter(" AND ".join(f"coalesce({c}, '') <> ''" for c in said[:3]))
    name = F.substring(F.sha2(F.to_json(F.struct(*said)), 256), 1, 16)
    return whole.withColumn("id", name).groupBy("id", *said).agg(F.min("row")).select("id", *said)
