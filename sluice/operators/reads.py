"""Reading tables from outside: pages of rows, CSV exports, and readers that follow changes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame

PAGE = 100
EXPORT, EXPORT_MOST = 10_000, 100_000


def page(rows: DataFrame, order: list[Column | str], limit: int = PAGE, offset: int = 0) -> DataFrame:
    """The rows from ``offset`` on, ``limit`` of them, in a stated order; only what is skipped and shown is sorted to the end."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def export_csv(rows: DataFrame, path: str, order: list[Column | str], limit: int = EXPORT, offset: int = 0) -> DataFrame:
    """Writes a page as one CSV file with a header, 1 to EXPORT_MOST rows, and gives the rows."""
    out = page(rows, order, min(max(limit, 1), EXPORT_MOST), offset)
    out.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
    return out


class Reader:
    """The rows that a client of a table holds, from a page of rows and the batches of changes around it.

    A change is ``(row, weight)``, a row a dictionary.  ``keys``: the columns of which the table has one row per
    value; none of them makes the table one row, and None takes the whole row for its identity.  What a
    reader holds is what it asked for; it lives on the client, not on the cluster."""

    def __init__(self, keys: Iterable[str] | None = None):
        self.keys = None if keys is None else tuple(keys)
        self.weights: dict[tuple, int] = {}
        self.held: dict[tuple, dict] = {}
        self.current: dict[tuple, tuple] = {}

    @staticmethod
    def identity(row: dict) -> tuple:
        return tuple(sorted((k, repr(v)) for k, v in row.items()))

    def _key(self, row: dict) -> tuple | None:
        return None if self.keys is None else tuple(repr(row.get(k)) for k in self.keys)

    def seed(self, rows: Iterable[tuple[dict, int]]) -> "Reader":
        """The state that a page of rows shows; of several rows of a key the last one."""
        self.weights, self.held, self.current = {}, {}, {}
        for row, weight in rows:
            if weight > 0:
                self._add(row, weight)
        return self

    def _add(self, row: dict, weight: int) -> None:
        name, key = self.identity(row), self._key(row)
        if key is not None and weight > 0:
            before = self.current.get(key)
            if before is not None and before != name:
                self.weights.pop(before, None)
                self.held.pop(before, None)
            self.current[key] = name
        total = self.weights.get(name, 0) + weight
        if total > 0:
            self.weights[name], self.held[name] = total, row
            return
        self.weights.pop(name, None)
        self.held.pop(name, None)
        if key is not None and self.current.get(key) == name:
            del self.current[key]

    def reflects(self, batch: Iterable[tuple[dict, int]]) -> bool:
        """Whether the state already shows a batch that came before its page: it takes back a row that isn't there."""
        gone = [row for row, weight in batch if weight < 0]
        return bool(gone) and any(self.identity(row) not in self.weights for row in gone)

    def apply(self, batch: Iterable[tuple[dict, int]]) -> "Reader":
        """Retractions first, so that a row that takes a key over isn't lost to the one that leaves it."""
        batch = list(batch)
        for row, weight in sorted(batch, key=lambda x: x[1] > 0):
            self._add(row, weight)
        return self

    def catch_up(self, page_: Iterable[tuple[dict, int]], buffered: Iterable[Iterable[tuple[dict, int]]]) -> "Reader":
        """The page, and the batches that came while it was on its way."""
        self.seed(page_)
        for batch in buffered:
            batch = list(batch)
            if not self.reflects(batch):
                self.apply(batch)
        return self

    def rows(self) -> list[dict]:
        return [row for name, row in self.held.items() for _ in range(self.weights[name] if self.keys is None else 1)]
