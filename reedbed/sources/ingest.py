"""Reading, checking and writing of tables."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reedbed.functions.indices import BANDS
from reedbed.functions.labels import scope_token, source_tag
from reedbed.operators.skew import with_block

#: Fixed values, which the files of users follow: column names that mean the same; patterns that tell the coordinate and groundwater columns; metric columns taken and refused, in their order; order of result columns.
RENAMES = {"vegetation": "veg", "Veg": "veg", "Blue": "blue", "NIR": "nir", "Red": "red", "Green": "green", "SWIR1": "swir1", "SWIR2": "swir2", "target_lon": "lon", "target_lat": "lat"}
LON_NAME, LAT_NAME = r"(^|_)(lon|longitude|x)(_|$)", r"(^|_)(lat|latitude|y)(_|$)"
WATER_NAMES = {"date": "date|day|time", "year": "year|yr", "depth": "depth|gwd|groundwater|waterlevel|wl|gw|level", "lat": "lat", "lon": "lon"}
METRICS, REJECTED = ("coef_ppi_norm", "coef_abs", "ppi_norm_coef", "coef"), ("coef_raw", "coef_rel", "rel_coef", "raw_coef", "unnormalized_coef")
RESULT_ORDER = ("location_id", "pheno_year", "lat", "lon", "veg", "variant_id", "coef", "rmse", "coef_median", "coef_025", "coef_975", "coef_sd", "coef_interval", "n_obs", "n_summer_obs", "low_data_flag")

OBSERVATION = T.StructType(
    [T.StructField("location_id", T.StringType()), T.StructField("date", T.DateType()), T.StructField("satellite", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("lat", "lon", *BANDS)]
    + [T.StructField("vegetation", T.StringType())]
)


def scan_csv(spark: SparkSession, paths: list[str] | str, schema: T.StructType = OBSERVATION) -> DataFrame:
    """CSV with a header under an explicit schema: no inference, no second pass. Column order in the file does not matter."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("nullValue", "NA").csv(paths)


def scan_files(spark: SparkSession, paths: list[str], provenance: bool = False) -> DataFrame:
    """CSV files united by (trimmed) column name, absent columns null; on request with source_csv, scope and trend_location_id."""
    frames = []
    for path in paths:
        df = spark.read.option("header", True).option("nullValue", "NA").csv(path)
        frames.append(df.toDF(*[c.strip() for c in df.columns]).withColumn("source_csv", F.input_file_name()))
    united = unite(frames)
    if not provenance:
        return united.drop("source_csv")
    stem = source_tag(F.col("source_csv"))
    return united.withColumns({"scope": scope_token(F.col("source_csv")), "trend_location_id": F.when(F.coalesce(stem, F.lit("")) == "", "unknown_source").otherwise(stem)})


def unite(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_sheet(spark: SparkSession, folder: str, sheet: str) -> DataFrame:
    """A sheet kept as parquet or CSV under its name; else the only file whose name holds the sheet's name."""
    there = _names(spark, folder)
    for name in (f"{sheet}.parquet", f"{sheet}.csv", *[n for n in there if sheet in n]):
        if name in there:
            reader = spark.read.option("header", True).option("inferSchema", True)
            return spark.read.parquet(f"{folder}/{name}") if name.endswith(".parquet") else reader.csv(f"{folder}/{name}")
    raise FileNotFoundError(f"no sheet {sheet} in {folder}")


def _storage(spark: SparkSession, path: str) -> tuple:
    """Path and file system of any storage that the cluster can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    path, fs = _storage(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def normalise_bands(df: DataFrame, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """For each band without a column of its name, the first present of its spellings is renamed to it."""
    have, renames = set(df.columns), {}
    for band in bands:
        spellings = (band.upper(), band.title(), f"band_{band}", f"BAND_{band.upper()}", f"Band_{band}")
        if band not in have and (hit := next((s for s in spellings if s in have), None)):
            renames[hit] = band
    return df.withColumnsRenamed(renames)


def rename_fixed(df: DataFrame) -> DataFrame:
    """The fixed renames, where the new name is free."""
    have = set(df.columns)
    return df.withColumnsRenamed({a: b for a, b in RENAMES.items() if a in have and b not in have})


def find_coordinates(columns: list[str]) -> tuple[str | None, str | None]:
    """Names of the longitude and latitude column; the first match wins."""
    first = lambda pattern: next((c for c in columns if re.search(pattern, c, re.I)), None)
    return first(LON_NAME), first(LAT_NAME)


def find_water_columns(columns: list[str]) -> dict[str, str | None]:
    """Names of the date, year, depth, lat and lon column of a groundwater sheet; None where there is none."""
    return {k: next((c for c in columns if re.search(p, c, re.I)), None) for k, p in WATER_NAMES.items()}


def find_date_column(df: DataFrame) -> str | None:
    """prediction_date, date, else the first date column, else the first text column whose values look like ISO dates."""
    for name in ("prediction_date", "date"):
        if name in df.columns:
            return name
    for name, kind in df.dtypes:
        if kind == "date":
            return name
    text = [n for n, k in df.dtypes if k == "string"]
    if not text:
        return None
    looks = df.agg(*[F.min(F.col(n).rlike(r"^\d{4}-\d{2}-\d{2}").cast("int")).alias(n) for n in text]).first()
    return next((n for n in text if looks[n] == 1), None)


def metric_column(df: DataFrame, preferred: str | None = None) -> str:
    """The first of the preferred and the known metric columns with any finite value; unnormalised ones are refused."""
    if preferred in REJECTED:
        raise ValueError(f"{preferred} is not normalised")
    names = [n for n in dict.fromkeys((preferred, *METRICS)) if n in df.columns]
    counts = df.agg(*[F.count(F.when(~F.isnan(F.col(n).cast("double")), 1)).alias(n) for n in names]).first() if names else {}
    hit = next((n for n in names if counts[n] > 0), None)
    if hit is None:
        raise ValueError("no metric column with a finite value")
    return hit


def require_columns(df: DataFrame, required: list[str], optional: list[str] = (), context: str = "table") -> DataFrame:
    """Fails if a required column is absent; absent optional ones become null doubles."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"{context}: missing {', '.join(absent)}")
    return df.withColumns({c: F.lit(None).cast("double") for c in optional if c not in df.columns})


def finite_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Number of non-null values of each index; fails on an absent or wholly empty one."""
    require_columns(df, names, context="indices")
    row = df.agg(*[F.count(n).alias(n) for n in names]).first().asDict()
    empty = [n for n, k in row.items() if not k]
    if empty:
        raise ValueError(f"no finite value in {', '.join(empty)}")
    return row


def sensor_bias(df: DataFrame) -> DataFrame:
    """band, slope, intercept, significant (true where missing) of a sensor-bias table."""
    require_columns(df, ["band", "ols_slope", "ols_intercept"], context="sensor bias")
    significant = F.coalesce("ols_significant", F.lit(True)) if "ols_significant" in df.columns else F.lit(True)
    return df.select("band", F.col("ols_slope").alias("slope"), F.col("ols_intercept").alias("intercept"), significant.alias("significant"))


def canonical_result(df: DataFrame) -> DataFrame:
    """Result columns in their order, then all others; rows by location, season, class."""
    first = [c for c in RESULT_ORDER if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first]).orderBy("location_id", "pheno_year", "veg")


def write_result(df: DataFrame, path: str, tag: str | None = None) -> list[str]:
    """CSV in canonical form with NA for null, and a second copy under the source tag."""
    out = canonical_result(df)
    paths = [path] + ([f"{path}_{tag}"] if tag else [])
    for p in paths:
        out.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(p)
    return paths


def write_by_location(df: DataFrame, path: str) -> None:
    """One folder for each location; what was there before is replaced. A location with more than a million rows is written by several tasks."""
    placed = with_block(df, ["location_id"], F.xxhash64(*df.columns), 1_000_000).repartition("location_id", "_block").drop("_block", "_many")
    placed.write.mode("overwrite").partitionBy("location_id").option("header", True).csv(path)


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """One parquet table for each sheet name."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def save_params(params: dict, path: str) -> None:
    """Small model parameters as JSON, on any storage that the session can reach; what was there before is replaced."""
    target, fs = _storage(SparkSession.active(), path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(json.dumps(params, sort_keys=True).encode()))
    finally:
        out.close()


def load_params(path: str) -> dict:
    return json.loads(SparkSession.active().read.text(path, wholetext=True).first()[0])


def sibling_scopes(path: str) -> list[str]:
    """Existing files of the sequence mid, low, kon that differ from ``path`` in that token only."""
    made = [re.sub(r"(?<![A-Za-z0-9])mid(?![A-Za-z0-9])", scope, path) for scope in ("mid", "low", "kon")]
    found = ((p, *_storage(SparkSession.active(), p)) for p in dict.fromkeys(made))
    return [p for p, at, fs in found if fs.exists(at)]
