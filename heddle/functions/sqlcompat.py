"""Functions that other SQL dialects have and Spark lacks or defines otherwise, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date pattern letters of the other dialect and Spark's, longest first.
PATTERNS = (
    ("HH24", "HH"),
    ("HH12", "hh"),
    ("YYYY", "yyyy"),
    ("Month", "MMMM"),
    ("Mon", "MMM"),
    ("DDD", "DDD"),
    ("Day", "EEEE"),
    ("Dy", "EEE"),
    ("MI", "mm"),
    ("SS", "ss"),
    ("MS", "SSS"),
    ("MM", "MM"),
    ("DD", "dd"),
    ("YY", "yy"),
    ("AM", "a"),
    ("PM", "a"),
)


def pattern(text: str) -> str:
    """A to_char pattern as Spark writes it."""
    out, i = [], 0
    while i < len(text):
        name, spark = next(((a, b) for a, b in PATTERNS if text.startswith(a, i)), (text[i], text[i] if not text[i].isalpha() else f"'{text[i]}'"))
        out.append(spark)
        i += len(name)
    return "".join(out)


def to_char(value: Column, text: str) -> Column:
    return F.date_format(value, pattern(text))


def initcap(text: Column) -> Column:
    """Upper case after anything that is no letter or digit, lower case elsewhere."""
    marked = F.regexp_replace(F.lower(text), r"([\p{L}\p{N}]+)", "\x01$1\x01")
    return F.array_join(F.transform(F.split(marked, "\x01"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def trunc(value: Column, digits: int = 0) -> Column:
    """A number cut toward zero."""
    scale = F.lit(10.0**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale) / scale


def rounded(value: Column, digits: int) -> Column:
    """A double scaled, rounded half away from zero and scaled back, all in doubles (Spark rounds the shortest decimal that names it)."""
    scale = F.lit(10.0**digits)
    near = F.round(value * scale, 0) / scale
    return F.when(F.abs(near) < F.lit(float("inf")), near).otherwise(value)


def divide(a: Column, b: Column) -> Column:
    """The quotient of doubles; by zero it is an infinity, zero by zero is not a number."""
    inf = F.lit(float("inf"))
    return F.when(b == 0, F.when(a > 0, inf).when(a < 0, -inf).when(a.isNotNull(), F.lit(float("nan")))).otherwise(F.try_divide(a, b))


def regexp_match(text: Column, regexp: str, groups: int) -> Column:
    """The groups of the first match as an array (the whole match for none), null where nothing matches."""
    parts = [F.regexp_extract(text, regexp, i) for i in (range(1, groups + 1) if groups else (0,))]
    return F.when(text.rlike(regexp), F.array(*parts))


def regexp_replace_first(text: Column, regexp: str, to: str) -> Column:
    """Only the first match is replaced."""
    return F.regexp_replace(text, rf"(?s)\A(.*?)(?:{regexp})", "$1" + to.replace("\\", "\\\\").replace("$", "\\$"))


def generate_series(start: Column, stop: Column, step: Column) -> Column:
    """The rows from start to stop; none where the step leads away."""
    return F.explode(
        F.when((step > 0) & (start <= stop) | (step < 0) & (start >= stop), F.sequence(start, stop, step)).otherwise(F.array().cast("array<bigint>"))
    )


def age(later: Column, earlier: Column) -> Column:
    """(months, days) between two dates by calendar fields: months first; missing days are borrowed from the earlier date's month."""
    days = F.day(later) - F.day(earlier)
    months = 12 * (F.year(later) - F.year(earlier)) + F.month(later) - F.month(earlier)
    return F.struct(
        F.when(days < 0, months - 1).otherwise(months).cast("int").alias("months"),
        F.when(days < 0, days + F.day(F.last_day(earlier))).otherwise(days).cast("int").alias("days"),
    )


def justify_days(days: Column) -> Column:
    """Thirty days as a month."""
    return F.struct(F.floor(days / 30).cast("int").alias("months"), (days % 30).cast("int").alias("days"))


#: Functions that guarded SQL may call, and the helpers that stand for them.
HELPERS = {"age": "heddle_age", "justify_interval": "heddle_justify"}

_PARTS = """concat_ws(' ', CASE WHEN months div 12 <> 0 THEN concat(months div 12, CASE WHEN abs(months div 12) = 1 THEN ' year' ELSE ' years' END) END,
  CASE WHEN months % 12 <> 0 THEN concat(months % 12, CASE WHEN abs(months % 12) = 1 THEN ' mon' ELSE ' mons' END) END,
  CASE WHEN days <> 0 THEN concat(days, CASE WHEN abs(days) = 1 THEN ' day' ELSE ' days' END) END,
  CASE WHEN us <> 0 OR months = 0 AND days = 0 THEN concat(CASE WHEN us < 0 THEN '-' ELSE '' END, lpad(abs(us) div 3600000000, greatest(2, length(string(abs(us) div 3600000000))), '0'), ':', lpad(abs(us) div 60000000 % 60, 2, '0'), ':',
    lpad(abs(us) div 1000000 % 60, 2, '0'), CASE WHEN us % 1000000 <> 0 THEN concat('.', regexp_replace(lpad(abs(us) % 1000000, 6, '0'), '0+$', '')) ELSE '' END) END)"""


def series(start: str, stop: str, step: str = "1") -> str:
    """SQL that gives the rows from start to stop; none where the step leads away."""
    ends = f"bigint({start}), bigint({stop}), bigint({step})"
    return f"explode(CASE WHEN ({step}) > 0 AND ({start}) <= ({stop}) OR ({step}) < 0 AND ({start}) >= ({stop}) THEN sequence({ends}) ELSE cast(array() AS array<bigint>) END)"


def definition(helper: str) -> str:
    """The statement that makes a helper: an SQL function of the session, which the planner inlines."""
    head = f"CREATE OR REPLACE TEMPORARY FUNCTION {helper}"
    if helper == "heddle_age":
        # fields of the later minus those of the earlier time, borrowing a day, then the days of the earlier time's month
        return f"""{head}(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ) RETURNS STRING RETURN
          (SELECT {_PARTS} FROM (SELECT sign * (m - int(d < 0)) AS months, sign * (d + CASE WHEN d < 0 THEN day(last_day(early)) ELSE 0 END) AS days, sign * us AS us
            FROM (SELECT sign, early, 12 * (year(late) - year(early)) + month(late) - month(early) AS m, day(late) - day(early) - int(t < 0) AS d, t + CASE WHEN t < 0 THEN 86400000000 ELSE 0 END AS us
              FROM (SELECT CASE WHEN a < b THEN -1 ELSE 1 END AS sign, greatest(a, b) AS late, least(a, b) AS early,
                bigint((extract(hour FROM greatest(a, b)) * 3600 + extract(minute FROM greatest(a, b)) * 60 + extract(second FROM greatest(a, b)) - extract(hour FROM least(a, b)) * 3600 - extract(minute FROM least(a, b)) * 60 - extract(second FROM least(a, b))) * 1000000) AS t)))
          WHERE a IS NOT NULL AND b IS NOT NULL)"""
    if helper == "heddle_justify":  # days become months of thirty
        return f"""{head}(i INTERVAL DAY TO SECOND) RETURNS STRING RETURN
          (SELECT {_PARTS} FROM (SELECT int(total div 2592000000000) AS months, int(total div 86400000000 % 30) AS days, total % 86400000000 AS us
            FROM (SELECT bigint(extract(day FROM i)) * 86400000000 + bigint(extract(hour FROM i)) * 3600000000 + bigint(extract(minute FROM i)) * 60000000 + bigint(extract(second FROM i) * 1000000) AS total)) WHERE i IS NOT NULL)"""
    if helper == "heddle_series_table":
        return f"{head}(start BIGINT, stop BIGINT, step BIGINT DEFAULT 1) RETURNS TABLE(generate_series BIGINT) RETURN SELECT {series('start', 'stop', 'step')}"
    groups = int(helper.removeprefix("heddle_match_"))
    found = ", ".join(f"regexp_extract(t, r, {i})" for i in (range(1, groups + 1) if groups else (0,)))
    return f"{head}(t STRING, r STRING) RETURNS ARRAY<STRING> RETURN CASE WHEN t RLIKE r THEN array({found}) END"


def as_json(value: Column) -> Column:
    """A result's value as JSON readers take it: numbers as doubles, non-finite ones and times as text."""
    number = value.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), number.cast("string")).otherwise(value.cast("string"))
