"""Columns over the JSON text of an event: loosely typed text, numbers and kinds.

Values are compared as text. JSON booleans have the text forms 1 and 0, as
stores without a boolean type keep them; numbers are as JSON writes them.

Operators that read several fields of an event parse it once, into a map of
its top-level texts, and look up each field once (with_texts). Only values whose
form the map can't tell (nested ones, fractions, true and false) are read from
the text again, one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The column of with_fields().
PARSED = "fields_"
#: Texts that may be of another form than the value is shown in: nested values and fractions.
_ODD = r"^[{\[]|^-?[0-9]+(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+)$"
#: Texts of empty values, if they aren't strings.
_EMPTY = r"^(?:false|\[\s*\]|\{\s*\}|-?0+(?:\.0+)?(?:[eE][+-]?[0-9]+)?)$"
#: What the text of a number or boolean looks like.
_LIKE_NUMBER = r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
_NUMBER = r"^[ \t\n\r\f\x0B]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def name_of(field: str) -> str:
    """The name of a top-level field; a dot in it is part of it."""
    name = field.replace('"', "").replace("'", "")
    return "EventID" if name.lower() == "eventid" else name


def path(field: str) -> str:
    """The JSON path of a top-level field."""
    return "$['" + name_of(field) + "']"


def with_fields(events: DataFrame, raw: str = "raw") -> DataFrame:
    """events with each one's top-level texts by name, in one parse."""
    return events.withColumn(PARSED, F.from_json(F.col(raw), "map<string,string>"))


def with_texts(events: DataFrame, fields: Iterable[str], raw: str = "raw") -> tuple[DataFrame, dict[str, Column]]:
    """events with a column for the text of each field, and these by field; to be given to text() and present(). Each event is parsed once, each field looked up once."""
    names = list(dict.fromkeys(fields))
    kept = [F.col(f"`{c}`") for c in events.columns]
    made = [F.try_element_at(PARSED, F.lit(name_of(f))).alias(f"field_{i}_") for i, f in enumerate(names)]
    return with_fields(events, raw).select(*kept, *made), {f: F.col(f"field_{i}_") for i, f in enumerate(names)}


def _found(raw: Column, field: str, looked_up: Column | None) -> Column:
    """A field's text as JSON shows it, booleans as true and false."""
    if looked_up is None:
        return F.get_json_object(raw, path(field))
    return F.when(looked_up.rlike(_ODD), F.get_json_object(raw, path(field))).otherwise(looked_up)


def sanitised(name: str) -> str:
    """A field name as stores keep it that drop all but letters and digits from unmapped names: src_ip is srcip there. For rules written against such stores; nothing here does it by default."""
    return "".join(ch for ch in name if ch.isalnum())


def kind(raw: Column, field: str) -> Column:
    """VOID, BOOLEAN, BIGINT, DECIMAL(..), DOUBLE, STRING, OBJECT<..> or ARRAY<..>; null if missing."""
    p = path(field)
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), p, "variant"))


def text(raw: Column, field: str, looked_up: Column | None = None) -> Column:
    """A field's text form; JSON null and a missing field are null."""
    t = _found(raw, field, looked_up)
    bare = t if looked_up is None else looked_up
    return _boolean_as_digit(raw, field, bare, t)


def _boolean_as_digit(raw: Column, field: str, bare: Column, t: Column) -> Column:
    return F.when(bare.isin("true", "false") & (kind(raw, field) == "BOOLEAN"), F.when(bare == "true", "1").otherwise("0")).otherwise(t)


def with_looked_up(raw: Column, fields: list[str], condition: Callable[[dict[str, Column]], Column]) -> Column:
    """A condition on the texts of fields, each of which is looked up once an event.

    The texts are bound as the one element of an array, so the condition stays
    one expression wherever the optimizer moves it. Had they columns of their
    own, a filter that is pushed below these would look them up at each use.
    """
    names = {f: f"f{i}" for i, f in enumerate(fields)}
    bare = F.array(F.struct(*[F.get_json_object(raw, path(f)).alias(n) for f, n in names.items()]))

    def shown(x: Column) -> Column:
        return F.struct(*[_boolean_as_digit(raw, f, x[n], x[n]).alias(n) for f, n in names.items()])

    return F.exists(F.transform(bare, shown), lambda x: condition({f: x[n] for f, n in names.items()}))


def number(t: Column) -> Column:
    """The number that a text begins with, 0 if none, null for null. Never an error."""
    return F.when(t.isNotNull(), F.coalesce(F.regexp_extract(t, _NUMBER, 1).try_cast("double"), F.lit(0.0)))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; all else as it is, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def contains(c: Column, part: str) -> Column:
    """Whether part is in c; ASCII letters match in either case."""
    low = part.translate(str.maketrans(UPPER, LOWER))
    return F.contains(ascii_lower(c), F.lit(low))


def present(raw: Column, field: str, looked_up: Column | None = None) -> Column:
    """A field's text if it is neither empty, zero, false nor null; a string "0" is present."""
    t = F.get_json_object(raw, path(field)) if looked_up is None else looked_up
    bare = t.rlike(_EMPTY) & (kind(raw, field) != "STRING")
    true = (t == "true") & (kind(raw, field) == "BOOLEAN")
    return F.when((t == "") | bare, None).when(true, "True").otherwise(_found(raw, field, looked_up))


def first_present(raw: Column, fields: Iterable[str], looked_up: dict[str, Column] | None = None) -> Column:
    """The first of several fields that is present."""
    return F.coalesce(*[present(raw, f, (looked_up or {}).get(f)) for f in fields])


def order_rank(raw: Column, field: str) -> list[Column]:
    """Sort keys of a loosely typed field, as with_order() has them, as expressions: for few rows."""
    t = text(raw, field)
    numeric = t.rlike(_LIKE_NUMBER) & kind(raw, field).rlike("^(BIGINT|DECIMAL|DOUBLE|BOOLEAN)")
    rank = F.when(t.isNull(), 0).when(numeric, 1).otherwise(2)
    return [rank, F.when(numeric, t.try_cast("double")), F.when(~numeric, t)]


def _kinds(rows: DataFrame, field: str, raw: str) -> DataFrame:
    """rows with bare_, a field's text as JSON shows it, and kind_, the value's kind if that text leaves it open. Each is made once a row: an optimizer doesn't move what stands on the elements of an array, so a filter or an order makes neither again."""
    r = F.col(raw)
    rows = rows.withColumn("bare_", F.explode(F.array(F.get_json_object(r, path(field)))))
    return rows.withColumn("kind_", F.explode(F.array(F.when(F.col("bare_").rlike(_LIKE_NUMBER) | F.col("bare_").isin("true", "false"), kind(r, field)))))


def _told() -> tuple[Column, Column]:
    """The text form of a value by bare_ and kind_, and whether it is a number or boolean."""
    boolean = F.col("kind_") == "BOOLEAN"
    numeric = F.coalesce(F.col("kind_").rlike("^(BIGINT|DECIMAL|DOUBLE|BOOLEAN)"), F.lit(False))
    return F.when(boolean, F.when(F.col("bare_") == "true", "1").otherwise("0")).otherwise(F.col("bare_")), numeric


#: The columns of with_order().
ORDER = ("rank_", "number_", "text_")


def with_order(rows: DataFrame, field: str, raw: str = "raw") -> DataFrame:
    """rows with the sort keys of a loosely typed field: null, then numbers by value, then text. An order that held these as expressions would read the event again for each comparison."""
    t, numeric = _told()
    rank = F.when(t.isNull(), 0).when(numeric, 1).otherwise(2)
    keys = dict(zip(ORDER, (rank, F.when(numeric, t.try_cast("double")), F.when(~numeric, t)), strict=True))
    return _kinds(rows, field, raw).withColumns(keys).drop("bare_", "kind_")


def grouped(events: DataFrame, field: str, raw: str = "raw") -> DataFrame:
    """value and is_number of each event, which a facet groups by: 1 and 1.0 are one group, 1 and "1" are two. A value is looked up once, and its kind asked for once, if its text leaves it open."""
    t, numeric = _told()
    kinds = _kinds(events.select(raw), field, raw)
    return kinds.select(F.when(numeric, F.regexp_replace(t, r"\.0+$|(\.[0-9]*?)0+$", "$1")).otherwise(t).alias("value"), numeric.alias("is_number"))


def normal_time(t: Column) -> Column:
    """One layout for event times: T for the space, no Z."""
    return F.replace(F.replace(t, F.lit(" "), F.lit("T")), F.lit("Z"), F.lit(""))


def timestamp(t: Column) -> Column:
    """A comparable timestamp of an event time; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(normal_time(t), r"\.(\d{6})\d+", ".$1")).cast("timestamp_ntz")


def in_pieces(c: Column) -> Column:
    """c itself. A projection that holds it is compiled in pieces.

    Spark compiles a stage to one method; one of so many expressions is too
    large for the JVM's compiler and is interpreted, at three times the time.
    A higher-order function keeps its projection out of that method.
    """
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
