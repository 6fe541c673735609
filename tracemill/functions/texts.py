"""CSV and JSON texts to records and fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.records import LIST_KEYS, normalize_column
from tracemill.functions.timestamps import bind

ENTRIES = "array<struct<key:string,value:string>>"
# A quote counts only at the start of a field; behind the closing one the rest is taken as it is.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+(?:"[^,\r\n]*+|\z)|[^,\r\n"][^,\r\n]*+)?+'
_RECORD = rf"{_FIELD}(?:,{_FIELD})*+"
_LINE = rf"({_RECORD})(?:\r\n|[\r\n]|\z)"
_QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)\z'
_WIDE = r"\s\x1c-\x1f\x85\p{Z}"
_NO_CELL = rf'(?:"[{_WIDE}]*+(?:"[{_WIDE}]*+|\z)|[{_WIDE}]*+)'


def strip_wide(c: Column) -> Column:
    """Both-ended trim of all Unicode white space."""
    return F.when(c.rlike(rf"^[{_WIDE}]|[{_WIDE}]\z"), F.regexp_replace(c, rf"^[{_WIDE}]+|[{_WIDE}]+\z", "")).otherwise(c)


def csv_header(text: Column) -> Column:
    """The first record's text, null where there is no text at all."""
    return F.when(F.length(text) > 0, F.regexp_extract(text, _LINE, 1))


def csv_records(text: Column) -> Column:
    """The texts of the records behind the header; a line break inside quotes belongs to its field, blank records do not count."""
    every = F.regexp_extract_all(text, F.lit(_LINE), F.lit(1))
    return F.filter(F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0))), lambda r: ~r.rlike(rf"^{_NO_CELL}(?:,{_NO_CELL})*+\z"))


def csv_cells(record: Column) -> Column:
    """The values of a record's fields, untrimmed."""
    return F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(rf",({_FIELD})"), F.lit(1)),
        lambda c: F.when(c.startswith('"'), F.concat(
            F.replace(F.regexp_extract(c, _QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, _QUOTED, 2))).otherwise(c))


def field_names(columns: Column) -> Column:
    """Column names; one without a name is called by its number."""
    return F.transform(columns, lambda c, i: F.when(c == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(c))


def paired(keys: Column, values: Column) -> Column:
    return F.transform(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda e: F.struct(
        e.getField("key").alias("key"), e.getField("value").alias("value")))


def last_values(entries: Column) -> Column:
    """One entry a key, in order of first appearance; the last value of a repeated key stands."""

    def folded(all_: Column) -> Column:
        keys = F.transform(all_, lambda e: e["key"])
        once = F.array_distinct(keys)
        return F.when(F.size(once) == F.size(keys), all_).otherwise(F.transform(
            once, lambda k: F.element_at(F.filter(all_, lambda e: e["key"] == k), -1)))

    return bind(entries, folded)


def quoted(c: Column) -> Column:
    """A JSON string."""
    return F.trim(F.to_json(F.array(c)), F.lit("[]"))


def json_object_text(entries: Column) -> Column:
    """An object's text; the keys of ``entries`` are JSON strings already."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), quoted(e["value"]))), ", "), F.lit("}"))


def json_array_text(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, quoted), ", "), F.lit("]"))


def _kind(value: Column, text: Column) -> Column:
    """The JSON type of a value; where it is no VARIANT (a repeated key inside), its text tells."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0),
                      F.when(text.isNull(), "VOID").when(text.startswith("{"), "OBJECT").when(text.startswith("["), "ARRAY").otherwise("STRING"))


def _kinds(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<variant>"))


def _typed(text: Column) -> Column:
    """Struct (kind, text) of each item of an array, read once as text and once as VARIANT."""
    return F.zip_with(F.from_json(text, "array<string>"), _kinds(F.from_json(text, "array<variant>")),
                      lambda t, v: F.struct(_kind(v, t).alias("kind"), t.alias("text")))


def _members(text: Column) -> Column:
    """Struct (key, kind, text) of an object's members in source order."""
    return F.zip_with(F.map_entries(F.from_json(text, "map<string,string>")), _kinds(F.map_values(F.from_json(text, "map<string,variant>"))),
                      lambda e, v: F.struct(e["key"].alias("key"), _kind(v, e["value"]).alias("kind"), e["value"].alias("text")))


def json_items(text: Column) -> Column:
    """Struct (kind, text) of each record of a JSON text; null where it is not JSON.

    A record is an item of the array that the text is, or that the object
    under one of the list names is; or the object itself; or one of two or
    more lines that are each JSON.
    """
    lines = F.filter(F.split(text, r"\R"), lambda line: F.trim(line) != "")
    by_line = F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))
    whole = F.concat(F.lit("["), text, F.lit("]"))
    count = lambda t: F.size(F.from_json(t, "array<string>"))

    def inside(members: Column) -> Column:
        listed = lambda name: F.filter(members, lambda m: (m["key"] == name) & (m["kind"] == "ARRAY"))
        return F.coalesce(*[F.get(listed(name), F.lit(0))["text"] for name in LIST_KEYS], whole)

    chosen = (F.when(count(whole) == 1, F.when(F.ltrim(text).startswith("["), text).otherwise(bind(_members(text), inside)))
              .when((F.size(lines) > 1) & (count(by_line) == F.size(lines)), by_line))
    return bind(chosen, _typed)


def json_fields(record: Column) -> Column:
    """An object's (key, value) entries: objects open one level (``a_b``), lists join with ", ", null is empty."""

    def word(kind: Column, text: Column) -> Column:
        return F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)

    def opened(m: Column) -> Column:
        name = normalize_column(m["key"])
        entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
        listed = F.transform(_typed(m["text"]), lambda x: F.coalesce(word(x["kind"], x["text"]), F.lit("None")))
        return (F.when(m["kind"] == "OBJECT", F.transform(_members(m["text"]), lambda x: entry(
                    F.concat(name, F.lit("_"), normalize_column(x["key"])), F.coalesce(word(x["kind"], x["text"]), F.lit("")))))
                .when(m["kind"] == "ARRAY", F.array(entry(name, F.array_join(listed, ", "))))
                .otherwise(F.array(entry(name, F.coalesce(m["text"], F.lit(""))))))

    return last_values(F.flatten(F.transform(_members(record), opened)))


def json_text(kind: Column, text: Column) -> Column:
    """A value as JSON again."""
    return F.when(kind == "STRING", quoted(text)).otherwise(F.coalesce(text, F.lit("null")))
