"""Checks of tasks and data, as DataFrames of problems; nothing is collected but counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.scalars import number
from tributary.operators.keys import null_keys, orphans
from tributary.schema import Database


class TaskError(ValueError):
    pass


def safe_select(query: str) -> str:
    """The query, if it is one SELECT or WITH statement."""
    if ";" in query or not re.match(r"\s*(SELECT|WITH)\b", query, re.IGNORECASE):
        raise TaskError("only one SELECT or WITH query is allowed")
    return query


def violations(db: Database) -> DataFrame:
    """(child, fk, parent, n): rows of each foreign key whose parent is missing."""
    out = None
    for x in db.links:
        bad = orphans(db[x.child], list(x.columns), db[x.parent], list(x.key))
        row = bad.agg(F.count("*").alias("n")).select(F.lit(x.child).alias("child"), F.lit(x.name).alias("fk"), F.lit(x.parent).alias("parent"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def key_problems(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: keys that repeat, and rows with a null in the key."""
    null = F.lit(False)
    for k in key:
        null |= F.col(k).isNull()
    per = df.groupBy(*key).agg(F.count("*").alias("n")).select("n", null.alias("null"))
    return per.agg(F.count(F.when(F.col("n") > 1, 1)).alias("n_duplicate"), F.coalesce(F.sum(F.when(F.col("null"), F.col("n"))), F.lit(0)).alias("n_null"))


def label_report(rows: DataFrame, label: str, split: str = "split") -> DataFrame:
    """(split, n, n_labelled, n_classes, n_unseen): n_unseen counts the split's classes that train does not have."""
    seen = rows.filter(F.col(split) == "train").select(F.col(label).alias("__seen")).filter("__seen IS NOT NULL").distinct()
    classes = rows.select(split, label).filter(F.col(label).isNotNull()).distinct()
    unseen = classes.join(seen, classes[label] == seen["__seen"], "left_anti").groupBy(split).agg(F.count("*").alias("n_unseen"))
    own = rows.groupBy(split).agg(F.count("*").alias("n"), F.count(label).alias("n_labelled"), F.countDistinct(label).alias("n_classes"))
    return own.join(unseen, split, "left").select(F.col(split).alias("split"), "n", "n_labelled", "n_classes", F.coalesce("n_unseen", F.lit(0)).alias("n_unseen"))


def check_entity(entity: DataFrame, key: list[str]) -> None:
    """Raises where the entity table's own key has nulls or repeats."""
    problem = key_problems(entity, key).first()
    if problem["n_duplicate"] or problem["n_null"]:
        raise TaskError(f"entity: {problem['n_duplicate']} keys repeat, {problem['n_null']} are null")


def check_list_labels(rows: DataFrame, label: str, split: str = "split") -> None:
    """Raises where lists of labels are missing, repeat an element or hold a null; test rows may have none."""
    x = F.col(label)
    bad = rows.filter(F.col(split) != "test").filter(x.isNull())
    odd = rows.filter((F.size(F.array_distinct(x)) < F.size(x)) | F.exists(x, lambda e: e.isNull()))
    if bad.limit(1).count() or odd.limit(1).count():
        raise TaskError("a list of labels is missing, repeats an element or holds a null")


def check_labels(rows: DataFrame, label: str, task_type: str, split: str = "split") -> None:
    """Raises where labels do not fit the type of task or the splits are not usable."""
    if rows.schema[label].dataType.simpleString().startswith("array"):
        return check_list_labels(rows, label, split)
    report = {r["split"]: r for r in label_report(rows, label, split).collect()}
    for name in ("train", "validation"):
        if name not in report or not report[name]["n_labelled"]:
            raise TaskError(f"no labelled {name} rows")
        if report[name]["n_labelled"] < report[name]["n"]:
            raise TaskError(f"{name} rows without a label")
    test = report.get("test")
    if test and 0 < test["n_labelled"] < test["n"]:
        raise TaskError("test rows with and without a label")
    n = report["train"]["n_classes"]
    if task_type == "binary_classification" and n != 2:
        raise TaskError(f"a binary task has two classes in train, not {n}")
    if task_type == "multiclass_classification" and n < 2:
        raise TaskError("a multiclass task has two classes in train or more")
    if task_type.endswith("classification") and report["validation"]["n_unseen"]:
        raise TaskError("validation has classes that train does not have")
    if task_type == "regression" and rows.filter(F.col(label).isNotNull() & number(label).isNull()).limit(1).count():
        raise TaskError("a label is no finite number")


def bad_times(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose prediction time is null or can't be read."""
    return rows.filter(F.try_to_timestamp(F.col(column).cast("string")).isNull())


def unknown_destinations(rows: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Elements of the array ``column`` that are no key of the destination table."""
    items = rows.select(F.explode(column).alias("item")).distinct()
    return items.join(parent, items["item"] == parent[key], "left_anti")


def out_of_range(encoded: DataFrame, index: str, size: int) -> DataFrame:
    """Rows whose category index is not from -1 to size - 1."""
    return encoded.filter(~F.col(index).between(-1, size - 1) | F.col(index).isNull())


def differences(left: DataFrame, right: DataFrame, key: list[str], tolerance: float = 1e-7) -> DataFrame:
    """(key, column) where two results differ: missing rows, other values, numbers further apart than the tolerance."""
    values = [c for c in left.columns if c not in key]
    b = right.select(*[F.col(c).alias(f"__r_{c}") for c in right.columns])
    same = F.lit(True)
    for k in key:
        same &= left[k].eqNullSafe(b[f"__r_{k}"])
    joined = left.withColumn("__l", F.lit(1)).join(b.withColumn("__r", F.lit(1)), same, "full_outer")
    kinds = dict(left.dtypes)
    tests = [F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.lit("missing"))]
    for c in values:
        a, r = F.col(c), F.col(f"__r_{c}")
        ok = a.eqNullSafe(r) | (F.abs(a - r) <= tolerance) if kinds[c] in ("double", "float") else a.eqNullSafe(r)
        tests.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)))
    found = joined.select(*[F.coalesce(F.col(k), F.col(f"__r_{k}")).alias(k) for k in key], F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("column"))
    return found


def check_task(task_rows: DataFrame, key: list[str], entity_columns: list[str], entity: DataFrame, entity_key: list[str], label: str, task_type: str, time: str | None = None) -> DataFrame:
    """The checks together; returns (key, split) of rows that already have ``split``.  Raises at the first problem."""
    problem = key_problems(task_rows, key).first()
    if problem["n_duplicate"] or problem["n_null"]:
        raise TaskError(f"{problem['n_duplicate']} keys repeat, {problem['n_null']} are null")
    if orphans(task_rows, entity_columns, entity, entity_key).limit(1).count() or null_keys(task_rows, entity_columns).limit(1).count():
        raise TaskError("rows without their entity")
    if time and bad_times(task_rows, time).limit(1).count():
        raise TaskError("a prediction time is null or can't be read")
    check_labels(task_rows, label, task_type)
    return task_rows.select(*key, "split")
