"""Scalar expressions the engine shares: times, hashes, labels, texts, encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(c: Column | str) -> Column:
    """Whole Unix seconds of a timestamp (without a zone: as UTC, the session's zone)."""
    return F.call_function("div", F.unix_micros(col(c).cast("timestamp")), F.lit(1_000_000))


def utc(c: Column | str, zone: str) -> Column:
    """A wall time of ``zone`` as UTC."""
    return F.to_utc_timestamp(col(c), zone)


def parse_time(c: Column | str) -> Column:
    """ISO text as a timestamp, null where it is none."""
    return F.try_to_timestamp(col(c))


#: The Julian day of midnight, 1970-01-01.
JULIAN_EPOCH = 2440587.5


def instant(c: Column | str) -> Column:
    """The moment that a text names, as a timestamp: ISO dates and times in any of their forms, with and without a zone
    (then UTC), or a Julian day number.  Text that is none of these is null."""
    x = F.trim(col(c))
    day = F.when(x.rlike(r"^\d{7}(\.\d+)?$"), x.try_cast("double"))
    julian = F.timestamp_micros(F.round((day - JULIAN_EPOCH) * 86_400_000).cast("bigint") * 1000)
    zone = F.regexp_replace(x, r"([+-]\d{2})(\d{2})$", "$1:$2")  # +0200 is +02:00
    return F.coalesce(julian, F.when(x.rlike("^[0-9]{4}-"), zone.try_cast("timestamp")))


def julian_day(c: Column | str) -> Column:
    """The Julian day of a timestamp, a double."""
    return F.unix_micros(col(c).cast("timestamp")) / F.lit(86_400e6) + F.lit(JULIAN_EPOCH)


def iso(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def time_parts(c: Column | str) -> list[tuple[str, Column]]:
    """Year, month and day from 0, weekday from Monday 0, hour, minute, second."""
    t = col(c)
    return [("year", F.year(t)), ("month", F.month(t) - 1), ("day", F.dayofmonth(t) - 1), ("weekday", F.weekday(t)), ("hour", F.hour(t)), ("minute", F.minute(t)), ("second", F.second(t))]


def order_key(*parts: Column | str | int) -> Column:
    """A hash that orders rows at random but always alike; the same text in any engine with md5."""
    return F.md5(F.concat_ws("|", *[(F.lit(str(p)) if isinstance(p, int) else col(p).cast("string")) for p in parts]))


def hash_below(n: Column | int, *parts: Column | str | int) -> Column:
    """A hashed integer from 0 to n - 1."""
    head = F.conv(F.substring(order_key(*parts), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, n if isinstance(n, Column) else F.lit(n).cast("bigint"))


def number(c: Column | str) -> Column:
    """A finite double, or null: text that is no number, NaN and infinities count as missing."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


# Spellings of binary labels.
TRUE, FALSE = ("t", "true", "1", "yes"), ("f", "false", "0", "no")


def binary_label(c: Column | str, *, strict: bool = True) -> Column:
    """1.0 or 0.0 for the spellings above, whatever case and blanks; anything else raises, or is null."""
    x = F.lower(F.trim(col(c).cast("string")))
    other = F.raise_error(F.concat(F.lit("no binary label: "), F.coalesce(x, F.lit("null")))).cast("double") if strict else F.lit(None).cast("double")
    return F.when(x.isin(*TRUE), 1.0).when(x.isin(*FALSE), 0.0).otherwise(other)


def text_value(c: Column | str) -> Column:
    """Text of a value: empty for null, and for a number that is none; the text NaN stays."""
    x = col(c)
    nan = F.typeof(x).isin("double", "float") & (x.cast("string") == "NaN")
    return F.when(x.isNull() | nan, F.lit("")).otherwise(x.cast("string"))


def slug(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col(c), "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))


def bucket(c: Column | str, edges: tuple[int, ...]) -> Column:
    """Place among edges: the label of the half-open range below the first edge above the value."""
    x, out, low = col(c), None, 0
    for high in edges:
        test, label = x < high, F.lit(f"{low}-{high - 1}")
        out = F.when(test, label) if out is None else out.when(test, label)
        low = high
    return out.otherwise(F.lit(f"{low}+"))


def encode_value(kind: str, c: Column | str) -> Column:
    """A value in the stored form of its encoding."""
    x = col(c)
    return {
        "datetime": lambda: F.when(x.isNotNull(), iso(x)),
        "timedelta_ns": lambda: x.cast("bigint"),
        "json": lambda: F.to_json(x),
        "decimal": lambda: x.cast("string"),
        "category": lambda: x.cast("string"),
        "bytes": lambda: x.cast("binary"),
        "scalar": lambda: x,
    }[kind]()


def decode_value(kind: str, c: Column | str, to: str) -> Column:
    """A stored value back as Spark type ``to``."""
    x = col(c)
    if kind == "json":
        return F.from_json(x, to)
    if kind == "datetime":
        return F.try_to_timestamp(x).cast(to)
    return x.cast(to)


def encoding_of(kind: str) -> str:
    """The encoding of a Spark type, by its simple string."""
    if kind.startswith(("array", "map", "struct", "variant")):
        return "json"
    if kind.startswith("decimal"):
        return "decimal"
    return {"timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime", "binary": "bytes"}.get(kind, "timedelta_ns" if kind.startswith("interval day") else "scalar")
