"""Pages by the last row seen: a page is found by a condition on its sort keys, not by counting rows before it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as J

#: A sort key, and whether it descends. Nulls come first in ascending order and last in descending, as Spark sorts.
Key = tuple[Column, bool]


def seek(rows: DataFrame, keys: list[Key], after: str | None = None, limit: int = 100) -> DataFrame:
    """The first limit rows behind the one whose cursor is after, in the order of keys; each with its own cursor.

    The last key must tell all rows apart. A cursor is the row's keys as JSON
    text, so it stays valid when rows before it come or go. The first key's
    bound is a condition of its own, which the scan takes if the key is a
    column: with files sorted by it a late page reads no more than the first.
    Each task keeps its limit least rows; nothing is sorted as a whole.
    """
    names = [f"key_{i}_" for i in range(len(keys))]
    found = rows.withColumns({n: k for n, (k, _) in zip(names, keys, strict=True)})
    if after is not None:
        said = json.loads(after)
        if not isinstance(said, dict) or not set(said) <= set(names):
            raise ValueError("no cursor of this order")
        values = [F.lit(said.get(n)).cast(found.schema[n].dataType) for n in names]
        nulls = [said.get(n) is None for n in names]
        behind, same = [], []
        for n, v, null, (_, down) in zip(names, values, nulls, keys, strict=True):
            behind.append(J.all_of([*same, _behind(F.col(n), v, null, down)]))
            same.append(F.col(n).isNull() if null else F.col(n) == v)
        reached = F.lit(False)
        for c in behind:
            reached = reached | c
        first = _behind(F.col(names[0]), values[0], nulls[0], keys[0][1]) | same[0]
        found = found.where(first).where(reached)
    page = found.orderBy(*[F.col(n).desc() if down else F.col(n).asc() for n, (_, down) in zip(names, keys, strict=True)]).limit(limit)
    return page.withColumn("cursor", F.to_json(F.struct(*names))).drop(*names)


def _behind(key: Column, value: Column, null: bool, down: bool) -> Column:
    """Whether a key sorts strictly behind a value."""
    if down:
        return F.lit(False) if null else (key < value) | key.isNull()
    return key.isNotNull() if null else key > value


def last_cursor(page: DataFrame) -> str | None:
    """The cursor of a page's last row, null for an empty page. A page has few rows."""
    rows = page.select("cursor").collect()
    return rows[-1][0] if rows else None
