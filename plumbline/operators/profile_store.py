"""Column profiles that grow with a table: sketches per file, kept as a table.

``update`` reads the files it has not seen and appends one row per file and column: counts,
moments, a distinct-count sketch (HyperLogLog) and a quantile sketch (KLL).  ``profile``
merges those rows; it reads no data.  Counts, extremes, means and deviations are exact;
distinct counts are off by 1.6 % or so, quantiles by 1.3 % of the ranks or so.

Files are known by name, as Spark writes a new one for new rows; a file that is rewritten
in place keeps its old figures.  Rows of a file that is gone are left out by ``profile``
if the present files are given.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import NUMERIC, as_double, as_text, col, kinds
from plumbline.operators.profile import QUARTILES, STATS_SCHEMA

_STORE = (
    "file string, column string, place int, kind string, physical_type string, rows bigint, nulls bigint, min double, max double,"
    " mean double, m2 double, distinct binary, quantiles binary"
)


def update(spark: SparkSession, store: str, path: str) -> int:
    """Sketch the Parquet files below ``path`` that ``store`` does not hold; how many there were."""
    df = spark.read.parquet(path)
    present = spark.createDataFrame([(f,) for f in df.inputFiles()], "name string")
    known = _read(spark, store).select(F.col("file").alias("seen")).distinct()
    new = [r.name for r in present.join(known, _plain(F.col("name")) == F.col("seen"), "left_anti").collect()]
    if new:
        # Escaped characters of a path come as such in a list of files.
        sketched(spark.read.schema(df.schema).parquet(*map(unquote, new)), df).write.mode("append").parquet(store)
    return len(new)


def sketched(rows: DataFrame, like: DataFrame) -> DataFrame:
    """One row per file and column."""
    kind = kinds(like)
    measures: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(like.columns):
        value = as_double(name)
        measures += [F.count_if(col(name).isNull()).alias(f"nulls{i}"), F.hll_sketch_agg(_key(like, name)).alias(f"distinct{i}")]
        if kind[name] == NUMERIC:
            number = F.when(~F.isnan(value), value)
            measures += [f(value).alias(f"{n}{i}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
            measures += [(F.var_pop(value) * F.count(value)).alias(f"m2{i}"), F.kll_sketch_agg_double(number).alias(f"quantiles{i}")]
    each = rows.groupBy(_plain(F.col("_metadata.file_path")).alias("file")).agg(*measures)
    null = F.lit(None)

    def cell(i: int, name: str) -> Column:
        numeric = kind[name] == NUMERIC
        own = lambda n, type_: (F.col(f"{n}{i}") if numeric else null).cast(type_).alias(n)
        return F.struct(
            F.lit(name).alias("column"),
            F.lit(i).alias("place"),
            F.lit(kind[name]).alias("kind"),
            F.lit(like.schema[name].dataType.simpleString()).alias("physical_type"),
            F.col(f"nulls{i}").alias("nulls"),
            *[own(n, "double") for n in ("min", "max", "mean", "m2")],
            F.col(f"distinct{i}").alias("distinct"),
            own("quantiles", "binary"),
        )

    cells = F.array(*[cell(i, n) for i, n in enumerate(like.columns)])
    names = [f.name for f in T.StructType.fromDDL(_STORE)]
    return each.select("file", "rows", F.inline(cells)).select(*names)


def profile(spark: SparkSession, store: str, files: list[str] | None = None) -> DataFrame:
    """The columns of ``column_stats``, from sketches alone."""
    rows = _read(spark, store)
    if files is not None:
        rows = rows.join(F.broadcast(spark.createDataFrame([(f,) for f in files], "name string")), F.col("file") == _plain(F.col("name")), "left_semi")
    rows = rows.withColumn("n", F.col("rows") - F.col("nulls"))
    n, mean = F.col("n"), F.col("mean")
    merged = rows.groupBy("column").agg(
        F.max_by(F.struct("kind", "physical_type", "place"), "file").alias("last"),
        F.sum("rows").alias("row_count"),
        F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        (F.sum(mean * n) / F.nullif(F.sum(F.when(mean.isNotNull(), n)), F.lit(0))).alias("mean"),
        F.kll_merge_agg_double(F.when(mean.isNotNull() & (n > 0), F.col("quantiles"))).alias("quantiles"),
    )
    # One row per column.
    centres = F.broadcast(merged.select(F.col("column").alias("of"), F.col("mean").alias("centre")))
    around = F.sum(F.col("m2") + n * (mean - F.col("centre")) * (mean - F.col("centre")))
    values = F.sum(F.when(mean.isNotNull(), n))
    spread = rows.join(centres, F.col("column") == F.col("of")).groupBy("of").agg(
        F.when(values > 1, F.sqrt(around / (values - 1))).alias("std")
    )
    filled = F.col("mean").isNotNull() & ~F.isnan("mean")
    quartiles = [F.when(filled, F.kll_sketch_get_quantile_double("quantiles", F.lit(q))) for q in QUARTILES]
    share = F.when(F.col("row_count") > 0, 100.0 * F.col("nulls") / F.col("row_count")).otherwise(0.0)
    shown = merged.join(F.broadcast(spread), F.col("column") == F.col("of")).select(
        "column", "last.*", "row_count", "nulls", share.alias("null_pct"), "distinct", "min", "max", "mean", "std",
        *[q.alias(n) for q, n in zip(quartiles, ("p25", "p50", "p75"))],
    )
    return shown.orderBy("place").select(*[f.name for f in T.StructType.fromDDL(STATS_SCHEMA)])


def _plain(name: Column) -> Column:
    """One spelling of a file's name: some lists write ``file:///``, some ``file:/``."""
    return F.regexp_replace(name, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def _key(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return col(name).cast("bigint")
    return col(name) if isinstance(kind, (T.StringType, T.BinaryType)) else as_text(df, name)


def _read(spark: SparkSession, store: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _STORE)
    return spark.read.schema(_STORE).parquet(store)
