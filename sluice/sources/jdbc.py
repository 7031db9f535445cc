"""Database sources and sinks over JDBC.

Reads are partitioned scans or polled pages behind a cursor column.  Writes go
from the executors; an upsert stages its batch in a table beside the target and
applies it by one MERGE and one DELETE in one transaction, so a lost executor
repeats the staging only."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import upsert_plan

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


def checked(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"not a plain name: {name}")
    return name


def literal(value) -> str:
    if isinstance(value, bool) or value is None:
        raise ValueError("a cursor is a number, text or time")
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def scan(spark: SparkSession, url: str, table: str, column: str | None = None, partitions: int = 1, **options) -> DataFrame:
    """A whole table, read by ``partitions`` tasks over equal ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if column is None or partitions < 2:
        return reader.option("dbtable", checked(table)).load()
    span = reader.option("query", f"SELECT MIN({checked(column)}) AS lo, MAX({column}) AS hi FROM {checked(table)}").load().first()
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if span[0] is None:
        return reader.load()
    return reader.options(partitionColumn=column, lowerBound=int(span[0]), upperBound=int(span[1]) + 1, numPartitions=partitions).load()


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    cursor: object
    has_more: bool


def poll(spark: SparkSession, url: str, cursor: str, since=None, table: str | None = None, query: str | None = None, page: int = 1000, inclusive: bool = False, **options) -> Page:
    """The next page behind ``since``, in the cursor's order.

    ``query`` may name the last cursor as ``@cursor``.  With ``inclusive`` rows at the cursor come
    again, for sources whose cursors repeat; the reader then drops known keys (``formats.dedup``).
    There is more if a page is full and the cursor has moved.  A page has at most ``page`` rows; a
    ``query`` of one's own bounds itself."""
    checked(cursor)
    if query is None:
        query = f"SELECT * FROM {checked(table)}"
        if since is not None:
            query += f" WHERE {cursor} {'>=' if inclusive else '>'} {literal(since)}"
        query += f" ORDER BY {cursor} FETCH FIRST {int(page)} ROWS ONLY"
    elif "@cursor" in query:
        if since is None:
            raise ValueError("this query needs a cursor to start from")
        query = query.replace("@cursor", literal(since))
    rows = spark.read.format("jdbc").options(url=url, query=query, **options).load().cache()
    found = rows.agg(F.count("*").alias("n"), F.max(cursor).alias("c")).first()
    last = since if found["c"] is None else found["c"]
    return Page(rows, last, found["n"] >= page and last != since)


def append(df: DataFrame, url: str, table: str, batch: int = 1000, **options) -> None:
    """Inserts in chunks of ``batch`` rows; creates the table if there is none."""
    df.write.format("jdbc").mode("append").options(url=url, dbtable=checked(table), batchsize=batch, **options).save()


def execute(spark: SparkSession, url: str, statements: list[str]) -> None:
    """Runs statements in one transaction."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        try:
            for s in statements:
                connection.createStatement().execute(s)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
    finally:
        connection.close()


def like(url: str, name: str, table: str, columns: list[str]) -> str:
    """Makes an empty table with the column types of another."""
    columns = ", ".join(map(checked, columns))
    if url.startswith("jdbc:sqlserver"):
        return f"SELECT {columns} INTO {checked(name)} FROM {checked(table)} WHERE 1 = 0"
    return f"CREATE TABLE {checked(name)} AS SELECT {columns} FROM {checked(table)} WITH NO DATA"


def upsert(deltas: DataFrame, url: str, table: str, keys: list[str], **options) -> None:
    """Applies a batch of deltas (``_weight``, ``_seq``) to a table that has its columns: per key the
    last delta counts, writes come before deletions, rows with a null key are skipped."""
    spark = deltas.sparkSession
    writes, deletes = upsert_plan(deltas, keys)
    columns = [checked(c) for c in writes.columns]
    mark = uuid.uuid4().hex[:12]
    staged = {f"{table}_w{mark}": writes, f"{table}_d{mark}": deletes}
    same = " AND ".join(f"t.{checked(k)} = s.{k}" for k in keys)
    rest = [c for c in columns if c not in keys]
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f't.{c} = s.{c}' for c in rest)}" if rest else ""
    write, delete = staged
    merge = (
        f"MERGE INTO {checked(table)} t USING {write} s ON {same}{update} "
        f"WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({', '.join('s.' + c for c in columns)})"
    )
    gone = f"DELETE FROM {table} t WHERE EXISTS (SELECT 1 FROM {delete} s WHERE {same})"
    made = []
    try:
        for name, rows in staged.items():
            execute(spark, url, [like(url, name, table, rows.columns)])
            made.append(name)
            rows.write.format("jdbc").mode("append").options(url=url, dbtable=name, **options).save()
        execute(spark, url, [merge, gone])
    finally:
        for name in made:
            execute(spark, url, [f"DROP TABLE {name}"])
