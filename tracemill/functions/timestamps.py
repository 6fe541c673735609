"""Timestamp text to naive UTC with a zone note or a reject reason (P10).

Every accepted form is rewritten to ``y|m|d|h|mi|s|fraction|offset`` by one
full-match pattern, so nothing depends on a parser's leniency or on the
session zone. Basic and week-date ISO forms are not accepted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: notes, reasons and accepted forms ------------------------------
TZ_ASSUMED = "assumed UTC (no timezone in source)"
TZ_EPOCH = "UTC (epoch value)"
TZ_ZERO = "UTC (source offset +0000)"
TZ_CONVERTED = "UTC (source offset converted) from "
MISSING = "missing timestamp value"

_CLOCK = r"(\d{1,2}):(\d{1,2}):(\d{1,2})"
_OFFSET = r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)"
PLAIN_FORMS = (
    # 06/Oct/2026:10:00:00 +0530
    (r"^(\d{2})/([A-Za-z]{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2})\s*([+-]\d{4})$", "$3|$2|$1|$4|$5|$6||$7"),
    (r"^(\d{2})/([A-Za-z]{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2})$", "$3|$2|$1|$4|$5|$6||+0000"),
    # 2026-10-06 10:00:00[.123456]
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})\s+{_CLOCK}(?:\.(\d{{1,6}}))?$", "$1|$2|$3|$4|$5|$6|$7|"),
    # 2026/10/06 10:00:00[.123456]
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})\s+{_CLOCK}(?:\.(\d{{1,6}}))?$", "$1|$2|$3|$4|$5|$6|$7|"),
    # 10/06/2026 10:00:00
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s+{_CLOCK}$", "$3|$1|$2|$4|$5|$6||"),
    # 2026-10-06
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1|$2|$3|0|0|0||"),
)
ISO_FORMS = (
    # ISO 8601 extended, any fraction length, optional offset
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:T| )(\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?(?:(?<=\d)\s*{_OFFSET})?$",
     "$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})T(\d{{2}})(?:{_OFFSET})?$", "$1|$2|$3|$4|0|0||$5"),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# -----------------------------------------------------------------------------------

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
_SPACE = " \t\n\r\u000b\u000c"


def strip(c: Column) -> Column:
    """Both-ended whitespace trim."""
    return F.trim(c, F.lit(_SPACE))


def _fields(text: Column) -> Column:
    bracketed = text.startswith("[") & text.endswith("]")
    candidate = F.when(bracketed, F.trim(text, F.lit("[]"))).otherwise(text)
    hits = [
        F.when(source.rlike(pattern), F.regexp_replace(source, pattern, order))
        for source, forms in ((candidate, PLAIN_FORMS), (text, ISO_FORMS))
        for pattern, order in forms
    ]
    return F.split(F.coalesce(*hits), r"\|")


def bind(c: Column, fn) -> Column:
    """Evaluate ``c`` once and hand it to ``fn``, however often ``fn`` reads it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def _number(part: Column) -> Column:
    return F.coalesce(F.nullif(part, F.lit("")), F.lit("0")).cast("int")


def _read_fields(p: Column) -> Column:
    """Fields ``y m d h mi s fraction offset`` to a value and the zone note."""
    months = F.array(*[F.lit(m) for m in MONTHS])
    month = F.when(p[1].rlike(r"^\d+$"), p[1].cast("int")).otherwise(
        F.nullif(F.array_position(months, F.lower(p[1])), F.lit(0)).cast("int")
    )
    second = F.when(_number(p[5]) < 60, _number(p[5]))
    year = F.when(_number(p[0]) >= 1, _number(p[0]))
    whole = F.try_make_timestamp_ntz(
        year, month, _number(p[2]), _number(p[3]), _number(p[4]), second.cast("decimal(8,6)")
    )
    fraction_us = F.coalesce(F.rpad(F.substring(p[6], 1, 6), 6, "0").cast("int"), F.lit(0))
    digits = F.rpad(F.regexp_replace(p[7], "[^0-9]", ""), 6, "0")

    def finish(d: Column) -> Column:
        seconds = (
            F.substring(d, 1, 2).cast("int") * 3600
            + F.substring(d, 3, 2).cast("int") * 60
            + F.substring(d, 5, 2).cast("int")
        )
        east = F.when(p[7].startswith("-"), -1).otherwise(1)
        shift_us = fraction_us - (east * seconds).cast("long") * 1_000_000
        shown = F.concat(
            F.when(east < 0, "-").otherwise("+"), F.substring(d, 1, 4),
            F.when(F.substring(d, 5, 2) != "00", F.substring(d, 5, 2)).otherwise(""),
        )
        note = (
            F.when(p[7] == "", TZ_ASSUMED)
            .when(seconds == 0, TZ_ZERO)
            .otherwise(F.concat(F.lit(TZ_CONVERTED), shown))
        )
        value = F.when(seconds < 86_400, F.timestamp_add("MICROSECOND", shift_us, whole))
        return F.struct(value.alias("value"), note.alias("tz_note"))

    return bind(digits, finish)


def _reason(text: Column) -> Column:
    head = F.replace(F.substring(text, 1, 64), F.lit("\\"), F.lit("\\\\"))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), head, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(head, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def parse_timestamp(raw: Column) -> Column:
    """Struct of ``value`` (timestamp_ntz), ``tz_note`` and ``reason``."""

    def read(text: Column) -> Column:
        epoch_us = F.when(text.rlike(r"^\d{10}$"), text.cast("long") * 1_000_000).when(
            text.rlike(r"^\d{13}$"), text.cast("long") * 1_000
        )
        epoch = F.struct(
            F.timestamp_add("MICROSECOND", epoch_us, F.expr(_EPOCH)).alias("value"),
            F.lit(TZ_EPOCH).alias("tz_note"),
        )
        found = F.when(epoch_us.isNotNull(), epoch).otherwise(bind(_fields(text), _read_fields))
        return bind(
            found,
            lambda f: F.struct(
                f["value"].alias("value"),
                F.when(f["value"].isNotNull(), f["tz_note"]).alias("tz_note"),
                F.when(text == "", MISSING)
                .when(f["value"].isNull(), F.concat(F.lit("invalid timestamp format: "), _reason(text)))
                .alias("reason"),
            ),
        )

    return bind(F.coalesce(strip(raw), F.lit("")), read)
