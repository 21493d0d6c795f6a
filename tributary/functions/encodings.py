"""What the texts of a column stand for, told from all of its values, and their exact decoding."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.scalars import decode_value, encode_value, encoding_of, instant

# The written forms that each encoding has.
TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?( ?(Z|[+-]\d{2}:?\d{2}))?$"
ZONE = r"(Z|\d{2}:\d{2}[^Z]*[+-]\d{2}:?\d{2})$"
DECIMAL = r"^-?(0|[1-9]\d*)(\.\d+)?$"
SPAN = r"^INTERVAL '-?\d+ \d{2}:\d{2}:\d{2}(\.\d+)?' DAY TO SECOND$"
JSON = r"(?s)^\s*[\[{].*[\]}]\s*$"
HEX = r"^0x([0-9a-f]{2})*$"
#: A text column of at most so many different values, and of a twentieth of its rows, is one of categories.
MOST_CATEGORIES, CATEGORY_SHARE = 100, 0.05
DIGITS = 38


@dataclass(frozen=True)
class Encoding:
    """``kind`` is one of the seven encodings; ``type`` the Spark type decoded to; ``categories`` those of a category."""

    kind: str
    type: str
    categories: tuple[str, ...] = ()


def infer_encodings(df: DataFrame) -> dict[str, Encoding]:
    """The encoding of every column.

    Columns of other types than text have that of their type.  All text columns are tested by one
    aggregation: an encoding holds if every value that is not null has its form.  Columns
    without values, or of mixed forms, are scalars.
    """
    out = {f.name: Encoding(encoding_of(f.dataType.simpleString()), f.dataType.simpleString()) for f in df.schema.fields}
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not texts:
        return out
    tests = []
    for i, c in enumerate(texts):
        x = F.col(c)
        number, json = x.rlike(DECIMAL), F.when(x.rlike(JSON), F.try_parse_json(x))
        parts = F.split(F.regexp_replace(F.when(number, x), "-", ""), r"\.")
        tests += [
            F.count(x).alias(f"n{i}"),
            F.count_if(json.isNotNull()).alias(f"json{i}"),
            F.schema_of_variant_agg(json).alias(f"shape{i}"),
            F.count_if(x.rlike(TIME) & instant(x).isNotNull()).alias(f"datetime{i}"),
            F.count_if(x.rlike(ZONE)).alias(f"zone{i}"),
            F.count_if(x.rlike(SPAN)).alias(f"timedelta_ns{i}"),
            F.count_if(number).alias(f"decimal{i}"),
            F.max(F.length(F.get(parts, F.lit(0)))).alias(f"whole{i}"),
            F.max(F.length(F.get(parts, F.lit(1)))).alias(f"scale{i}"),
            F.count_if(x.rlike(HEX)).alias(f"bytes{i}"),
            F.approx_count_distinct(x).alias(f"distinct{i}"),
        ]
    row = df.agg(*tests).first()
    for i, c in enumerate(texts):
        n = row[f"n{i}"]
        kind = next((k for k in ("json", "datetime", "timedelta_ns", "decimal", "bytes") if n and row[f"{k}{i}"] == n), "scalar")
        scale = row[f"scale{i}"] or 0
        if kind == "decimal" and row[f"whole{i}"] + scale > DIGITS:
            kind = "scalar"
        if kind == "scalar" and n and row[f"distinct{i}"] <= min(MOST_CATEGORIES, CATEGORY_SHARE * n):
            found = [r[0] for r in df.select(c).distinct().filter(F.col(c).isNotNull()).orderBy(c).limit(2 * MOST_CATEGORIES).collect()]
            out[c] = Encoding("category", "string", tuple(found))
            continue
        types = {
            "json": _spark_type(row[f"shape{i}"]) if kind == "json" else "",
            "datetime": "timestamp" if row[f"zone{i}"] else "timestamp_ntz",
            "timedelta_ns": "interval day to second",
            "decimal": f"decimal({max((row[f'whole{i}'] or 0) + scale, 1)},{scale})",
            "bytes": "binary",
            "scalar": "string",
        }
        out[c] = Encoding(kind, types[kind])
    return out


def _spark_type(shape: str) -> str:
    """A type that ``from_json`` takes, of the shape all variants of a column share; what they don't share stays text."""
    return shape.replace("OBJECT<", "STRUCT<").replace("VARIANT", "STRING").replace("VOID", "STRING")


def decode_column(x: Column, encoding: Encoding) -> Column:
    """A stored value as what it stands for; a category that is not known is null."""
    if encoding.kind == "bytes":
        return F.unhex(F.substring(x, 3, 1 << 30))
    if encoding.kind == "category":
        return F.when(x.isin(*encoding.categories), x) if encoding.categories else x
    if encoding.kind == "datetime":
        return instant(x).cast(encoding.type)
    return decode_value(encoding.kind, x, encoding.type)


def decode_frame(df: DataFrame, encodings: Mapping[str, Encoding]) -> DataFrame:
    """``df`` with its text columns decoded; the order of columns stays, columns that lack an encoding too."""
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(*[decode_column(F.col(c), encodings[c]).alias(c) if c in texts and c in encodings else F.col(c) for c in df.columns])


def encode_frame(df: DataFrame) -> tuple[DataFrame, dict[str, Encoding]]:
    """(``df`` in the stored form of each column's type, the encodings that bring it back)."""
    out = {f.name: Encoding(encoding_of(f.dataType.simpleString()), f.dataType.simpleString()) for f in df.schema.fields}

    def stored(name: str, e: Encoding) -> Column:
        x = F.col(name)
        if e.kind == "bytes":
            return F.concat(F.lit("0x"), F.lower(F.hex(x)))
        if e.kind == "timedelta_ns":
            return x.cast("string")
        return encode_value(e.kind, x)

    return df.select(*[stored(c, e).alias(c) for c, e in out.items()]), out
