"""Sources that come in pages or from a database file: harvesting with tokens, cursors, and SQLite tables."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def cursor_pages(fetch: Callable[[str], dict], most: int, first: str = "*") -> Iterator[dict]:
    """Records of pages {results, meta: {next_cursor}} until the cursor is missing or repeats, or ``most`` records are there.
    Records without title or abstract are dropped, an id counts once."""
    cursor, seen = first, set()
    while cursor:
        page = fetch(cursor)
        for r in page.get("results") or []:
            if r.get("title") and r.get("abstract") and r.get("id") not in seen:
                seen.add(r.get("id"))
                yield r
                if len(seen) >= most:
                    return
        following = (page.get("meta") or {}).get("next_cursor")
        if following == cursor:
            return
        cursor = following


def token_pages(fetch: Callable[[str | None], dict], categories: set[str] | None, most: int) -> Iterator[dict]:
    """Records of pages {records, resumption_token}: deleted ones and those of other categories are left out, an id counts once;
    the first page is asked for with None, the last one has no token."""
    token, seen, begun = None, set(), False
    while token or not begun:
        begun = True
        page = fetch(token)
        for r in page.get("records") or []:
            wanted = categories is None or categories & set(r.get("categories") or [])
            if not r.get("deleted") and wanted and r.get("id") not in seen:
                seen.add(r.get("id"))
                yield r
                if len(seen) >= most:
                    return
        token = page.get("resumption_token")


def land_pages(spark: SparkSession, records: Iterator[dict], path: str, schema: str, batch: int = 1000) -> DataFrame:
    """Write records as they come, in JSON-lines files of ``batch`` under ``path``, and read them by ``schema``; the driver holds
    one batch at a time."""
    held, n = [], 0

    def put() -> None:
        nonlocal held, n
        if held:
            spark.createDataFrame([(x,) for x in held], "value string").coalesce(1).write.mode("append" if n else "overwrite").text(path)
            held, n = [], n + 1

    for r in records:
        held.append(json.dumps(r, ensure_ascii=False))
        if len(held) >= batch:
            put()
    put()
    return spark.read.schema(schema).json(path) if n else spark.createDataFrame([], schema)


class SqliteSource(DataSource):
    """Rows of a table in a SQLite file that all executors can reach, read in ranges of its row numbers. Options: path, table,
    partitions. The schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "quill_sqlite"

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, [f.name for f in schema.fields])


class SqliteReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.table, self.parts, self.columns = options["path"], options["table"], int(options.get("partitions", "4")), columns

    def _ask(self, sql: str, *values) -> Iterator[tuple]:
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from con.execute(sql, values)
        finally:
            con.close()

    def partitions(self) -> list[InputPartition]:
        lo, hi = next(self._ask(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"'))
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [InputPartition((a, min(a + step - 1, hi))) for a in range(lo, max(hi, lo) + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cols = ", ".join(f'"{c}"' for c in self.columns)
        yield from self._ask(f'SELECT {cols} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', *partition.value)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 4) -> DataFrame:
    """A SQLite table as rows of ``schema``."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("quill_sqlite").schema(schema).option("path", path).option("table", table).option("partitions", str(partitions)).load()


def read_database(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int = 8) -> DataFrame:
    """A table of a database that has a JDBC driver on the class path, read in ranges of a numeric key; filters and columns are
    pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions)).load()
