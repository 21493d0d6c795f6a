"""Session settings the engine relies on, and reliable cuts of long plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tributary", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine counts on: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder all executors share, and read back.

    For values that must not be computed twice and for plans that grow with every
    step.  The folder is the one ``spark.checkpoint.dir`` names; a temporary one is
    set only where none is and the master is local, as other machines would not see it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tributary-"))
    return df.checkpoint()


#: Bytes of a shuffle that one task reads, about, and the partitions they are put together from (up to 200, Spark writes without sorting).
TASK_BYTES, MOST_TASKS = 8 << 20, 200


def small_tasks(spark: SparkSession) -> None:
    """Let joins and sorts of narrow rows be many tasks' work, so that the memory of one does not grow with the tables.

    Columns of ids shrink to a few bytes a row in a shuffle, so the default size of a task's
    share is millions of rows.  Spark reads the sizes when the plan runs, so they are
    session settings; a tighter bound of the user's own stays.
    """
    size, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > TASK_BYTES:
        spark.conf.set(size, f"{TASK_BYTES}b")
    if int(spark.conf.get(parts, None) or spark.conf.get("spark.sql.shuffle.partitions")) < MOST_TASKS:
        spark.conf.set(parts, str(MOST_TASKS))


def together[T, R](fn: Callable[[T], R], items: Iterable[T], most: int = 8) -> list[R]:
    """``fn`` of each item, in order.  Their Spark jobs run side by side, so small tables don't wait for one another's tails."""
    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(fn, items))


def sql_over(spark: SparkSession, frames: Mapping[str, DataFrame], sql: str, params: Mapping[str, object] | None = None) -> DataFrame:
    """A query over frames by name, which shadow tables and views of those names.

    The names are of the query alone: it is put under a WITH over views that are gone
    when this returns, so nothing of the session's is overwritten or left behind.
    """
    views = {name: f"__{uuid.uuid4().hex}" for name in frames}
    try:
        for name, view in views.items():
            frames[name].createTempView(view)
        named = ", ".join(f"`{name.replace('`', '``')}` AS (SELECT * FROM `{view}`)" for name, view in views.items())
        return spark.sql(f"WITH {named} SELECT * FROM ({sql.strip().rstrip(';')}\n)" if views else sql, args=dict(params or {}))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
