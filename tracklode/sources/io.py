"""Scans and sinks: delimited points, hotspot points, sequences, JDBC tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"L": T.LongType(), "D": T.DoubleType(), "S": T.StringType()}


def point_schema(types: list[str]) -> T.StructType:
    """d_0 … d_n of the types L, D or S; another letter is a ValueError."""
    if bad := [t for t in types if t not in TYPES]:
        raise ValueError(f"unknown dimension types {bad}; L, D or S")
    return T.StructType([T.StructField(f"d_{i}", TYPES[t]) for i, t in enumerate(types)])


def read_points(spark: SparkSession, path: str, types: list[str], delimiter: str = ",") -> DataFrame:
    """Delimited text without header; a directory or glob reads all its files. Malformed values are
    null; rows without a trajectory or a tick (the first two columns) are left out."""
    df = spark.read.schema(point_schema(types)).option("sep", delimiter).option("mode", "PERMISSIVE").csv(path)
    return df.dropna(subset=["d_0", "d_1"][: len(types)])


def existing(spark: SparkSession, path: str) -> str:
    """The path, or a PathError if nothing is there; a glob must match something."""
    from tracklode.operators.hotspot import PathError

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        raise PathError(f"{path} doesn't exist")
    return path


def nominal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def selected_columns(df: DataFrame, mask: list[int]) -> list[str]:
    """The columns whose mask is 1."""
    return [c for c, m in zip(df.columns, mask) if m]


def read_hotspot_points(spark: SparkSession, path: str) -> DataFrame:
    """id, seconds, lat, lon per line; lines that start with `m` or don't have four fields are
    skipped. (vessel_id, ts in ms, lat, lon); rows whose numbers can't be read are left out."""
    f = F.split("value", ",")
    lines = spark.read.text(path).where(~F.col("value").startswith("m") & (F.size(f) == 4))
    cols = [F.trim(f[0]).alias("vessel_id"), (F.trim(f[1]).try_cast("bigint") * 1000).alias("ts"), F.trim(f[2]).try_cast("double").alias("lat"), F.trim(f[3]).try_cast("double").alias("lon")]
    return lines.select(*cols).dropna()


def read_numeric_points(spark: SparkSession, path: str, dims: int, delimiter: str = ",") -> DataFrame:
    """One array<double> per line of numbers; lines with a missing number are left out."""
    df = spark.read.schema(T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(dims)])).option("sep", delimiter).csv(path)
    return df.dropna().select(F.array(*df.columns).alias("features"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """`time,area;time,area;…`, one sequence per line: (seq_id, items array<struct<time,area_id>>)."""
    item = lambda x: F.struct(F.split(x, ",")[0].try_cast("bigint").alias("time"), F.split(x, ",")[1].try_cast("int").alias("area_id"))
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.monotonically_increasing_id().alias("seq_id"), F.transform(F.filter(F.split("value", ";"), lambda x: F.length(x) > 0), item).alias("items"))


# ---- JDBC: every credential comes from the caller ----


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None, schema: str | None = None, **parallel) -> DataFrame:
    """parallel: column, lowerBound, upperBound, numPartitions for a partitioned read."""
    return spark.read.jdbc(url, f"{schema}.{table}" if schema else table, properties=properties or {}, **parallel)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str, properties: dict | None = None, schema: str | None = None) -> None:
    """mode append or overwrite; arrays and maps are written as JSON text, as tables have no such types."""
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in df.columns]
    df.select(*flat).write.jdbc(url, f"{schema}.{table}" if schema else table, mode=mode, properties=properties or {})


def flat_rows(df: DataFrame) -> DataFrame:
    """Nested columns as rows, outermost first: a map gives <name>_key and <name>, an array <name>_pos (from
    0) and <name>, a struct one column a field (<name>_<field>), until no column is nested. Rows whose
    array or map is null or empty drop out, as tables have no row for them; several nested columns of
    a row give all their combinations, so keep the one that is wanted."""
    while True:
        nested = next((f for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))), None)
        if nested is None:
            return df
        n, rest = nested.name, [c for c in df.columns if c != nested.name]
        if isinstance(nested.dataType, T.StructType):
            df = df.select(*rest, *(F.col(n)[f.name].alias(f"{n}_{f.name}") for f in nested.dataType.fields))
        elif isinstance(nested.dataType, T.MapType):
            df = df.select(*rest, F.explode(n).alias(f"{n}_key", n))
        else:
            df = df.select(*rest, F.posexplode(n).alias(f"{n}_pos", n))


def write_jdbc_rows(df: DataFrame, url: str, table: str, mode: str, properties: dict | None = None, schema: str | None = None) -> None:
    """write_jdbc with nested columns as rows."""
    write_jdbc(flat_rows(df), url, table, mode, properties, schema)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


# ---- text reports ----


def write_hotspots(df: DataFrame, path: str, header: list[str], k: int) -> None:
    """Header lines, then `cell,  z,` of the k highest scores, as one text file: k rows at most."""
    top = df.orderBy(F.desc("z"), "cell_id").limit(k).select(F.concat(F.col("cell_id").cast("string"), F.lit(",  "), F.col("z").cast("string"), F.lit(",")).alias("value"), F.row_number().over(_by_score()).alias("_n"))
    head = df.sparkSession.createDataFrame([(h, i - len(header)) for i, h in enumerate(header)], "value string, _n int")
    head.unionByName(top).coalesce(1).sortWithinPartitions("_n").select("value").write.mode("overwrite").text(path)


def _by_score():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("z"), "cell_id")  # over the k rows that limit left


def write_labels(df: DataFrame, path: str, *order: str) -> None:
    """Comma-joined columns as text, sorted: cluster labels, cluster info or histogram triples.
    Array columns are joined with commas as well."""
    cols = [F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",") if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c).cast("string") for c in df.columns]
    t = df.orderBy(*order) if order else df
    t.select(F.concat_ws(",", *cols).alias("value")).write.mode("overwrite").text(path)


def write_debug(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the folder in tracklode.debug.dir, if that is set, and returns it."""
    folder = df.sparkSession.conf.get("tracklode.debug.dir", None)
    if folder:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df
