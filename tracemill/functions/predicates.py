"""Row predicates and small lookups shared by rules, links and views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
STATUS_SUCCESS = ("success", "ok", "succeeded", "allowed", "yes")
STATUS_FAILURE = ("failure", "fail", "failed", "denied", "locked", "no", "error")
SCRIPTING_PROCESSES = (
    "powershell.exe", "powershell", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe",
    "mshta.exe", "regsvr32.exe", "rundll32.exe", "powershell_ise.exe", "bitsadmin.exe",
    "certutil.exe", "msbuild.exe",
)
INTERPRETER_PROCESSES = ("python.exe", "python3", "perl.exe", "ruby.exe", "csharp")
COMMAND_TOKENS = (
    "-nop", "-w hidden", "enc", "encodedcommand", "frombase64", "downloadstring",
    "iex(", "invoke-expression",
)
MODIFY_ACTIONS = ("write", "delete", "create", "modify", "copy", "append", "truncate")
RENAME_ACTIONS = ("rename", "rename_file", "move")
RULE_CONFIDENCE = {"Low": 0.4, "Medium": 0.6, "High": 0.8, "Critical": 0.95}
SEVERITY_RANK = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}
# -------------------------------------------------------------------------------


def uid(prefix: str, number: Column, width: int = 6) -> Column:
    """``prefix`` and the number, padded to ``width`` digits; longer numbers keep all of theirs."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def lookup(c: Column, table: dict, default=None) -> Column:
    """A dict as a CASE expression."""
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def is_login() -> Column:
    return (F.lower("event_type") == "login") | (
        F.lower(F.coalesce("action", F.lit(""))) == "login"
    )


def status_value() -> Column:
    return F.lower(F.trim(F.try_element_at("metadata", F.lit("status"))))


def is_success() -> Column:
    return F.coalesce(status_value().isin(*STATUS_SUCCESS), F.lit(False))


def is_failure() -> Column:
    return F.coalesce(status_value().isin(*STATUS_FAILURE), F.lit(False))


def is_script_host(process: Column) -> Column:
    return F.lower(F.trim(process)).isin(*SCRIPTING_PROCESSES, *INTERPRETER_PROCESSES)


def command_tokens(command_line: Column) -> Column:
    """Array of indicator tokens found in a command line."""
    low = F.lower(F.coalesce(command_line, F.lit("")))
    return F.array_compact(
        F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in COMMAND_TOKENS])
    )


def is_modify() -> Column:
    return F.lower("action").isin(*MODIFY_ACTIONS)


def is_rename() -> Column:
    return F.lower("action").isin(*RENAME_ACTIONS)


def rule_confidence(severity: Column) -> Column:
    return lookup(severity, RULE_CONFIDENCE, 0.6)


def severity_rank(severity: Column) -> Column:
    return lookup(severity, SEVERITY_RANK, 0)


def severity_of_rank(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in SEVERITY_RANK.items()}, "Low")


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.85, "High").when(confidence >= 0.65, "Medium").otherwise("Low")
    )


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a naive timestamp.

    Built from the date and clock fields, so the session zone (and its clock
    changes) has no part in it.
    """
    seconds = F.unix_date(ts.cast("date")) * F.lit(86_400).cast("long") + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def stamp(ts: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a naive timestamp."""
    return F.substring(_text(ts), 1, 19)


def clock(ts: Column | str) -> Column:
    """``HH:mm`` of a naive timestamp."""
    return F.substring(_text(ts), 12, 5)


def _text(ts: Column | str) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts).cast("string")
