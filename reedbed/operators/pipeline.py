"""Compositions: readings to prepared rows, prepared rows to class fractions, trends by source."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reedbed.functions.indices import with_indices
from reedbed.functions.labels import CLASSES, location_code
from reedbed.operators import filters, harmonise, relational as rel, soil, stats, traces, unmix
from reedbed.session import materialise

METHODS = ("linear", "whittaker", "none")


def interpolation_method(option: bool | str | None) -> str:
    """linear, whittaker or none: true means linear, false and nothing mean none; an unknown name is an error."""
    if isinstance(option, bool) or option is None:
        return "linear" if option else "none"
    name = option.strip().lower()
    if name in ("true", "false"):
        return "linear" if name == "true" else "none"
    if name not in METHODS:
        raise ValueError(f"unknown interpolation {option}")
    return name


def recycled(a: Column, b: Column) -> Column:
    """Products of two arrays, the shorter one repeated; null if either is empty."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.get(a, i % F.size(a)) * F.get(b, i % F.size(b))))


def weighted_means(df: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """One row: mean of each column weighted over the rows that have it."""
    w = F.col(weight)
    return df.agg(*[(F.sum(F.col(c) * w) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0.0))).alias(c) for c in columns])


def known_positions(keys: DataFrame, *sources: DataFrame) -> DataFrame:
    """location_id, lat, lon of each key from the first source that has both."""
    out = keys.select("location_id").distinct()
    for i, source in enumerate(sources):
        out = out.join(rel.one_position(source.select("location_id", "lat", "lon")).select("location_id", F.col("lat").alias(f"a{i}"), F.col("lon").alias(f"o{i}")), "location_id", "left")
    both = [F.when(F.col(f"a{i}").isNotNull() & F.col(f"o{i}").isNotNull(), F.struct(F.col(f"a{i}").alias("lat"), F.col(f"o{i}").alias("lon"))) for i in range(len(sources))]
    return out.select("location_id", F.coalesce(*both).alias("p")).select("location_id", "p.lat", "p.lon")


def prepare(readings: DataFrame, bias: DataFrame | None, places: DataFrame | None, outlier_columns: list[str], training: bool = True) -> DataFrame:
    """Readings (see plans.views.obs) with one sensor scale, indices, no dust, no outliers, class filled, phenology index; known classes only for training."""
    rows = readings.where(filters.first_season(F.col("py")))
    if bias is not None:
        rows = harmonise.affine(rows, bias)
    rows = with_indices(rows.where(filters.not_dusty()))
    rows = filters.without_mad_outliers(rows, ["location_id", "py"], outlier_columns)
    if places is not None:
        rows = rel.fill_class(rows, places)
    rows = soil.with_ppi(rows)
    return filters.known_class(rows) if training else rows


def prepare_inference(readings: DataFrame, bias: DataFrame | None, outlier_columns: list[str], cap: int | None = None, seed: int = 42) -> DataFrame:
    """Readings for the model: location_id is dropped and made again from the coordinates, then as ``prepare``, classes kept as they are.

    Readings without a position are left out. ``cap``: so many locations at most, by a seeded hash (default: all); the model's own normalisation is applied later, by ``FractionModel.represent``.
    """
    rows = readings.drop("location_id").withColumn("location_id", location_code(F.col("lat"), F.col("lon"))).where("location_id is not null")
    if cap is not None:
        rows = filters.capped_locations(rows, "location_id", F.pmod(F.xxhash64("location_id"), F.lit(10007)), cap, seed)
    return prepare(rows, bias, None, outlier_columns, training=False)


def season_vectors(rows: DataFrame, indices: list[str], at_least: int = 8, interpolate: bool = True) -> DataFrame:
    """location_id, py, x of seasons with enough readings: bins x indices, indices in order of their names; gaps filled linearly, or left null."""
    enough = filters.at_least(rows, ["location_id", "py"], at_least)
    filled = rel.fill_bins(rel.bin_means(enough, indices), enough.select("location_id", "py").distinct(), indices)
    if not interpolate:
        filled = filled.withColumn("value", F.when(F.col("observed"), F.col("value")))
    return traces.trace_vectors(filled)


@dataclass
class FractionModel:
    """What a fit keeps: the representation (scales of the indices, kept features, axes) and the library in it."""

    indices: list[str]
    means: list[float]
    sds: list[float]
    kept: list[int]
    basis: np.ndarray | None
    axis_weights: np.ndarray | None
    feature_weights: list[float]
    library: unmix.Library
    samples: dict[str, int]

    def represent(self, vectors: DataFrame, missing_as_zero: bool = True) -> DataFrame:
        """Vectors of season_vectors as the model sees them: unit length, z-scores of their index, features without weight pruned. The same for endmembers and observations."""
        return vectors.withColumn("x", traces.pruned(_scores(F.col("x"), self.means, self.sds, missing_as_zero), self.kept))

    def fractions(self, vectors: DataFrame, solver: str = "sparse", **options) -> DataFrame:
        """unmix of vectors of season_vectors, projected if the model has axes."""
        return unmix.unmix(self.represent(vectors), self.library, "location_id string, py int", basis=self.basis, weights=self.axis_weights, solver=solver, **options)

    def params(self) -> dict:
        """Plain values, for save_params."""
        plain = lambda a: None if a is None else np.asarray(a).tolist()
        out = {f.name: getattr(self, f.name) for f in fields(self)}
        return out | {"basis": plain(self.basis), "axis_weights": plain(self.axis_weights), "library": [[c, v, plain(x)] for c, v, x in self.library]}

    @classmethod
    def from_params(cls, stored: dict) -> FractionModel:
        array = lambda a: None if a is None else np.array(a, float)
        return cls(**(stored | {"basis": array(stored["basis"]), "axis_weights": array(stored["axis_weights"]), "library": [(c, v, array(x)) for c, v, x in stored["library"]]}))

    def prototypes(self, spark: SparkSession, last_bin: int = 36) -> DataFrame:
        """cls, variant_id, n_samples, index_name, bin, value, weight: the library in long form; pruned features are absent."""
        names = sorted(self.indices)
        rows = [(c, v, self.samples.get(c, 0), names[i // last_bin], i % last_bin + 1, float(x[j]), self.feature_weights[i]) for c, v, x in self.library for j, i in enumerate(self.kept)]
        return spark.createDataFrame(rows, "cls string, variant_id string, n_samples bigint, index_name string, bin int, value double, weight double")


def _scores(x: Column, means: list[float], sds: list[float], missing_as_zero: bool = True, last_bin: int = 36) -> Column:
    by_feature = lambda values: F.lit([v for v in values for _ in range(last_bin)])
    z = F.zip_with(F.zip_with(traces.unit(x), by_feature(means), lambda v, m: v - m), by_feature(sds), lambda v, s: v / s)
    return F.transform(z, lambda v: F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0))) if missing_as_zero else z


def fit_fractions(rows: DataFrame, indices: list[str], classes: tuple[str, ...] = CLASSES, project: bool = True, k_max: int = 1, at_least: int = 10) -> FractionModel:
    """Model of the seasons of labelled, prepared rows: unit vectors, z-scores, feature weights and axes, library.

    A season has its most frequent class (of equal ones the first); fewer than ``at_least`` such seasons are an error. With k_max above 1 half of the locations (by hash) are held out to choose
    the number of endmembers of each class (library_size); the library is then extracted from all seasons.
    """
    names = sorted(indices)
    labels = traces.trace_class(rows.where(F.col("veg").isin(*classes)), ["location_id", "py"])
    labelled = materialise(season_vectors(rows, names).join(labels, ["location_id", "py"]).withColumn("x", traces.unit(F.col("x"))), "traces")
    if labelled.limit(at_least).count() < at_least:
        raise ValueError(f"fewer than {at_least} labelled seasons")
    long = labelled.select(F.posexplode("x").alias("i", "v")).groupBy((F.col("i") / 36).cast("int").alias("i")).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    scales = {r["i"]: (r["m"], max(r["s"], 1e-8) if r["s"] else 1.0) for r in long.collect()}  # a row an index
    means, sds = ([float(scales[i][k]) for i in range(len(names))] for k in (0, 1))
    width = 36 * len(names)
    z = materialise(labelled.withColumn("x", _scores(F.col("x"), means, sds)).withColumn("key", F.concat_ws("/", "location_id", "py")), "scores")
    model = FractionModel(names, means, sds, list(range(width)), None, None, [1.0] * width, [], {})
    if project:
        axes = traces.feature_model(z, "cls")
        model.feature_weights = [float(w) for w in axes["weights"]]
        model.kept = [i for i, w in enumerate(model.feature_weights) if w > 0]
        model.basis, model.axis_weights = axes["basis"][model.kept], axes["axis_share"]
        z = z.withColumn("x", traces.pruned(F.col("x"), model.kept))
    counts = dict.fromkeys(classes, 1)
    if k_max > 1:
        split = z.select("cls", "key", "x", (F.pmod(F.xxhash64("location_id"), F.lit(2)) == 1).alias("held"))
        counts = unmix.library_size(split, k_max, unmix.BARE)
    chosen = materialise(unmix.endmember_library(z, counts, "key"), "library")
    found = chosen.join(z.select("key", "x"), "key").dropDuplicates(["variant_id"]).orderBy("cls", "variant_id").collect()  # a few endmembers a class
    model.library = [(r["cls"], r["variant_id"], np.array(r["x"], float)) for r in found]
    model.samples = {r["cls"]: int(r["n_samples"]) for r in found}
    return model


def held_out_residuals(model: FractionModel, vectors: DataFrame, labels: DataFrame, solver: str = "sparse", bound: int = 500) -> dict[str, np.ndarray]:
    """By class the predicted less the true fractions of labelled seasons, classes in sorted order: at most ``bound`` seasons a class, in hash order."""
    order = Window.partitionBy("cls").orderBy(F.xxhash64("location_id", "py"), "location_id", "py")
    some = labels.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= bound).drop("_r")
    got = model.fractions(vectors.join(some.select("location_id", "py"), ["location_id", "py"], "left_semi"), solver).groupBy("location_id", "py").pivot("cls", sorted({c for c, _, _ in model.library})).agg(F.sum("coef"))
    rows = got.join(some, ["location_id", "py"]).toPandas()  # at most bound rows a class
    classes = [c for c in rows.columns if c not in ("location_id", "py", "cls")]
    x = rows[classes].to_numpy(float) - (rows["cls"].to_numpy()[:, None] == np.array(classes, dtype=object)).astype(float)
    return {c: x[(rows["cls"] == c).to_numpy()] for c in classes}


def class_fractions(prepared: DataFrame, model: FractionModel, solver: str = "sparse", **options) -> DataFrame:
    """location_id, py, veg, coef, capped: fractions of each season with enough readings; bare ground is capped by the summer peak of the phenology index.

    options: those of unmix (draws, bundles, oob, ...)."""
    coefs = model.fractions(season_vectors(prepared, model.indices), solver, **options)
    summed = coefs.groupBy("location_id", "py", F.col("cls").alias("veg")).agg(F.sum("coef").alias("coef"))
    peaks = prepared.groupBy("location_id", "py").agg(F.max(F.when(filters.in_months((6, 7, 8, 9)), F.col("ppi"))).alias("peak"))
    return unmix.barren_cap(summed, peaks, ["location_id", "py"])


def scope_trends(df: DataFrame, scope: str, index: str, months: tuple[int, ...] = (7, 8, 9), at_least: int = 500) -> DataFrame:
    """scope, py, n_locations, mean, se of the detrended summer index by source, of seasons with enough locations."""
    summer = df.where(filters.in_months(months)).select(scope, "location_id", "py", "doy_cal", index)
    flat = stats.detrend_cubic(summer, [scope], "doy_cal", index)
    per = flat.groupBy(scope, "py", "location_id").agg(F.avg("detrended").alias("v"))
    trend = per.groupBy(scope, "py").agg(F.count("v").alias("n_locations"), F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("se"))
    return trend.where(F.col("n_locations") >= at_least)


def overlay(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Each column scaled to 0 to 1 by the smallest and largest value of its group."""
    ends = df.groupBy(*groups).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = df.join(ends, groups)
    return joined.select(*groups, *[c for c in df.columns if c not in (*groups, *columns)], *[((F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0))).alias(c) for c in columns])
