"""The shared folder for tables between jobs, stable pseudo-random order, exact global ranks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this process only where that is unset and Spark is local, as in tests."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="skyloom-jobs-")
        atexit.register(shutil.rmtree, _own, True)
    return _own


def tables_dir(spark: SparkSession) -> str:
    """Where this application's tables between jobs stand."""
    return f"{shared_dir(spark)}/skyloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{tables_dir(spark)}/{uuid.uuid4().hex}"


def clear_tables(spark: SparkSession) -> None:
    """Delete this application's tables between jobs; results that still stand on them must have been written or read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def binary_round(x: Column, digits: int) -> Column:
    """x rounded half away from zero as a binary number: -2.135, which is a little less than that, becomes -2.13, and -0.00003 at 4 digits -0.0, as in
    most engines. Spark's own round goes by the decimal text and drops the sign of zero; it serves where a double has hardly such digits, and for NaN."""
    near = F.signum(x) * F.floor(F.abs(x) * 10.0**digits + 0.5) / 10.0**digits
    return F.when(F.abs(x) * 10.0**digits < 2.0**52, near).otherwise(F.round(x, digits))


def draw(keys: list[str], seed: int) -> Column:
    """A pseudo-random order of rows by their keys, the same in any partitioning and any engine with md5."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def exact_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Global 0-based rank by the columns `order`: a range exchange, a sort inside partitions, one count per partition to offset them."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    runs = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(runs), "_part").withColumn(out, at + F.col("_before")).drop("_at", "_part", "_before")


def running_sums(df: DataFrame, order: str, sums: list[str], descending: bool = True) -> DataFrame:
    """Inclusive running sums of `sums` over the whole table in the order of a numeric column, without a one-task window."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = F.col(order).desc() if descending else F.col(order).asc()
    placed = stored(df.repartitionByRange(n, by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums])
    local = placed.select("*", *[F.sum(s).over(inside).alias(f"_r_{s}") for s in sums])
    out = local.join(F.broadcast(totals), "_part")
    return out.select(*[c for c in df.columns], *[(F.col(f"_r_{s}") + F.col(f"_b_{s}")).alias(f"cum_{s}") for s in sums])


def join_channels(df: DataFrame, per: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of `per`, a row for each value of keys; a missing key meets a missing key. Rows without a partner go, but for a left join."""
    named = per.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in per.columns if c not in keys])
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], how).drop(*[f"_of_{k}" for k in keys])


#: Shares in which the rows of one key meet what belongs to the key, and the rows of a key that one task can take.
SALTS, SHARE = 32, 100_000


def join_spread(df: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """join_channels for keys that may hold most of the rows: `per`, small beside df, stands SALTS times, and a key's rows meet any of these copies.
    Where `per` tells how many rows df has of a key, in `_rows`, only the keys of more than SHARE, as few as rows / SHARE, are spread so."""
    if "_rows" in per.columns:
        many = per.where(F.col("_rows") > SHARE).select(*keys, F.lit(True).alias("_many"))
        salts = F.when(F.col("_rows") > SHARE, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        salt = F.when(F.col("_many"), (F.monotonically_increasing_id() % SALTS).cast("int")).otherwise(0)
        rows = join_channels(df, F.broadcast(many), keys, "left").withColumn("_salt", salt).drop("_many")
        return join_channels(rows, per.withColumn("_salt", F.explode(salts)).drop("_rows"), [*keys, "_salt"]).drop("_salt")
    copies = per.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_channels(df.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")), copies, [*keys, "_salt"]).drop("_salt")


def by_rows(df: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys of `most` rows at most, which a task can hold and finish alone, and those of the others, as few as rows / most, if there are any."""
    long = stored(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys, F.lit(True).alias("_long")))
    if long.isEmpty():
        return df, None
    marked = join_channels(df, F.broadcast(long), keys, "left")
    return marked.where("_long is null").drop("_long"), marked.where("_long").drop("_long")


def key_hash(keys: list[str]) -> Column:
    """A number for each key, to sort by before the key where rows of a key need only stand together: names that begin alike are slow to compare."""
    return F.xxhash64(*keys)


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df stored in the order of keys and `order`, with `_at`, which ascends in it, and `_part`: a range partition holds a fragment of a key, so
    that a key of any size is spread over tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    return stored(placed.withColumn("_part", F.shiftright("_at", 33)))


def carried(placed: DataFrame, keys: list[str], within: dict[str, Column], before: dict[str, tuple[str, str]] | None = None, after: dict[str, tuple[str, str]] | None = None, whole: dict[str, tuple[str, str]] | None = None, part: str = "_part", cut: Column | None = None, order: str | None = None) -> DataFrame:
    """placed with what fragments hand on. `within` names aggregates of a fragment; the others are name: (min, max or sum, one of these) over the
    fragments of the key that come before, after, or over all. A row for each fragment is all that windows see. Only keys of several fragments have
    anything to hand on: at most two of their fragments end or begin in a range partition, or one stands for each segment of positions, so those are
    broadcast and the rows stay where they are. Where a column tells which rows are of keys that may be cut, in `cut`, fragments of the others are not
    even counted. `whole` takes its place in the sort by `order` that a caller's own windows need."""
    own = (placed if cut is None else placed.where(cut)).groupBy(*keys, part).agg(*[c.alias(n) for n, c in within.items()])
    w = Window.partitionBy(*keys).orderBy(part)
    frames = [(before, w.rowsBetween(Window.unboundedPreceding, -1)), (after, w.rowsBetween(1, Window.unboundedFollowing)), (whole, Window.partitionBy(*keys))]
    handed = [F.expr(f"{f}({c})").over(frame).alias(n) for cols, frame in frames for n, (f, c) in (cols or {}).items()]
    several = own.select(*keys, part, *handed, F.count("*").over(Window.partitionBy(*keys)).alias("_of")).where("_of > 1").drop("_of")
    out = join_channels(placed, F.broadcast(several), [*keys, part], "left")
    alone = Window.partitionBy(*keys, part)
    if order:
        alone = alone.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumns({n: F.coalesce(F.col(n), within[c].over(alone)) for n, (_, c) in (whole or {}).items()})


def numbered_groups(placed: DataFrame, keys: list[str], new: Column, out: str = "_g", part: str = "_part", at: str = "_at", cut: Column | None = None) -> DataFrame:
    """placed with `out`: the `at` of the last row for which `new` held, within a fragment or before it; `cut` as in `carried`."""
    inside = Window.partitionBy(*keys, part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("_new", F.when(new, F.col(at)))
    rows = carried(rows, keys, {"_top": F.max("_new")}, before={"_held": ("max", "_top")}, part=part, cut=cut)
    return rows.withColumn(out, F.coalesce(F.max("_new").over(inside), F.col("_held"))).drop("_new", "_held")
