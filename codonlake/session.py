"""Session helpers: building a session, cutting lineage, size-checked broadcasts and distributed ranks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a side may have at most to be broadcast; the count is taken before the hint is given.
BROADCAST_ROWS = 20_000

_own_dirs: dict[str, str] = {}
#: Tables written by ``cut`` in this process that are still there.
_tables: list[tuple[SparkSession, str]] = []
#: Java functions of each application, by source file.
_java: dict[tuple[str, Path], JavaObject] = {}


def build_session(app: str = "codonlake", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for tests and benchmarks. A cluster brings its own session and settings."""
    builder = SparkSession.builder.master(master).appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a folder of our own only where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="codonlake-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


@atexit.register
def remove_tables() -> None:
    """Remove the tables ``cut`` wrote so far, through the file system each lies in. A process that lives long calls this
    when the results that read them are done with; it is called at the end in any case."""
    while _tables:
        spark, path = _tables.pop()
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session is gone: only a local folder can still be removed
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: the lineage ends there and no executor holds
    the only copy."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _tables.append((df.sparkSession, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where it comes in fewer parts than there are cores; for steps that make many rows of one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def java_function(spark: SparkSession, source: Path, returns: T.DataType) -> str:
    """The name under which the session has the function (a ``UDF`` class of the package ``codonlake``, named as its file)
    of a Java source. Spark's own compiler compiles it, once an application, and the executors get it as a jar."""
    name, key = f"codonlake_{source.stem}", (spark.sparkContext.applicationId, source)
    if key not in _java:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jsparkSession.getClass().getClassLoader())
        compiler.cook(source.read_text())
        folder = tempfile.mkdtemp(prefix="codonlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/{name}-{uuid.uuid4().hex}.jar", "w") as jar:
            for c, code in compiler.getBytecodes().items():
                jar.writestr(c.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(jar.filename)
        _java[key] = compiler.getClassLoader().loadClass(f"codonlake.{source.stem}").newInstance()
    if not spark.catalog.functionExists(name):
        spark._jsparkSession.udf().register(name, _java[key], spark._jsparkSession.parseDataType(returns.json()))
    return name


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows it, else as it is."""
    return F.broadcast(df) if small_enough(df, rows) else df


def rank_within(df: DataFrame, keys: list[str], order: list[Column], total_rows: int, out: str, rows_per_task: int = 1 << 20) -> DataFrame:
    """Rank the rows of each key group from 0 without putting a group into one task.

    Rows are spread over slices by a hash of their order columns; a slice is ranked on its own and starts at the number
    of rows in the slices before it. The order is by slice, then by ``order``: fixed for given data and slice number,
    but not the plain order of ``order``. Groups of any size are fine, as a slice holds about ``rows_per_task`` rows.
    """
    slices = max(1, -(-total_rows // rows_per_task))
    if slices == 1:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*order)) - 1
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__slice") == F.col("__s")]
    joined = sliced.withColumn("__own", own).join(counts, same)
    return joined.withColumn(out, (F.col("__own") + F.col("__before")).cast("bigint")).drop("__slice", "__s", "__own", "__before", *[f"__k_{k}" for k in keys])


def running_totals(df: DataFrame, by: list[str], key: str, values: dict[str, str], descending: bool = False, parts: int = 64, how: str = "sum") -> DataFrame:
    """Add running sums (with ``how="max"`` running maxima) over each group in the order of ``key``: ``values`` maps columns
    to the names of their sums.

    ``key`` is unique within a group. A group is cut into ranges at about ``parts`` quantiles of its keys; rows are summed
    within their range and start from the sum of the ranges before, so no task holds a group.
    """
    ranks = [i / parts for i in range(1, parts)]
    groups = [F.col(c).alias(f"__g_{c}") for c in by]
    cuts = df.groupBy(*by).agg(F.percentile_approx(key, ranks).alias("__q")).select(*groups, "__q")
    same = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in by]
    cut_rows = df.join(cuts, same) if by else df.crossJoin(F.broadcast(cuts))
    ranged = cut_rows.withColumn("__part", F.size(F.filter("__q", lambda q: q < F.col(key)))).drop("__q", *[f"__g_{c}" for c in by])
    order = F.desc if descending else F.asc
    of = {"sum": F.sum, "max": F.max}[how]
    start = lambda c: F.coalesce(c, F.lit(0)) if how == "sum" else c
    both_of = lambda a, b: a + b if how == "sum" else F.greatest(a, b)
    sums = ranged.groupBy(*by, "__part").agg(*[of(v).alias(f"__t_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy(order("__part")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*groups, F.col("__part").alias("__p"), *[start(of(f"__t_{v}").over(before)).alias(f"__b_{v}") for v in values])
    within = Window.partitionBy(*by, "__part").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.select("*", *[of(v).over(within).alias(f"__o_{v}") for v in values])
    both = own.join(starts, [*same, F.col("__part") == F.col("__p")])
    return both.select(*df.columns, *[both_of(F.col(f"__o_{v}"), F.col(f"__b_{v}")).alias(out) for v, out in values.items()])
