"""Session helpers: recommended settings, shared checkpoint folder, size-checked joins."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if a count proves it to be within both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Rows of one key that a task takes in a join beyond the bounds; keys with more are spread over as many tasks as that makes.
TASK_ROWS = 2_000_000


def session(app: str = "chronoloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Puts this package on the executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_chronoloom_shipped", False):
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="chronoloom-")) / "chronoloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(target))  # served by the driver; the folder is not read by executors
    sc._chronoloom_shipped = True


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; a folder of this machine only on a local master (tests), else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="chronoloom-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, with its lineage cut."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def width(df: DataFrame) -> Column:
    """Bytes of a row, near enough for a bound."""
    parts = [
        F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) if kind not in ("bigint", "int", "double") else F.lit(8)
        for c, kind in df.dtypes
    ]
    total = F.lit(0).cast("long")
    for p in parts:
        total = total + p
    return total


def is_bounded(df: DataFrame, rows: int = BROADCAST_ROWS, nbytes: int = BROADCAST_BYTES) -> bool:
    """True if `df` has at most `rows` rows and `nbytes` bytes; reads no more than `rows` + 1 rows."""
    n, size = df.limit(rows + 1).select(width(df).alias("w")).agg(F.count("*"), F.sum("w")).first()
    return n <= rows and (size or 0) <= nbytes


def sized_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    rows: int = BROADCAST_ROWS,
    nbytes: int = BROADCAST_BYTES,
    task_rows: int = TASK_ROWS,
    salt_of: list[str] | None = None,
    once: bool = False,
) -> DataFrame:
    """Join of a large skewed side with a small one (`how`: inner, left or left_semi).

    The small side is broadcast only after its size was checked. Beyond the bound both sides are shuffled by the key.
    There a count by key finds keys with more than `task_rows` rows of the large side; the rows of such a key get a salt (a
    hash of `salt_of`, by default of all other columns) of as many values as its rows need tasks, and the small side's
    rows of that key are repeated once per salt. Other keys are not repeated. With `once` the small side is
    checkpointed first: for sides that take a pass over large tables, which the check of their size would repeat.
    """
    if once:
        small = checkpointed(small)
    if is_bounded(small, rows, nbytes):
        return big.join(F.broadcast(small), on, how)
    hot = big.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > task_rows)
    hot = checkpointed(hot.select(*on, F.ceil(F.col("_n") / F.lit(task_rows)).cast("int").alias("_salts")))
    if not is_bounded(hot) or hot.isEmpty():  # so many hot keys balance each other
        return big.join(small, on, how)
    names = salt_of or [c for c in big.columns if c not in on] or on
    hot, salts = F.broadcast(hot), F.coalesce("_salts", F.lit(1))
    salted = big.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), salts).cast("int")).drop("_salts")
    spread = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")
