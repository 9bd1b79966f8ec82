"""Points within a great-circle distance of each other.

Voronoi partition around pivots with triangle-inequality replication, then a vantage-point tree in each cell. Pivots form a tree: cells with many points are split by
pivots of their own, level by level, so a point is compared with FAN pivots a level however many cells there are.

A point lives in the cell of its nearest pivot and is also copied to every cell whose pivot is at most 2r farther away
than the nearest one: if d(x, y) <= r and x lives with pivot p, then d(y, p) <= d(x, p) + r <= d(x, q) + r <= d(y, q) + 2r for
any pivot q. So every partner of x is present in x's own cell, and a pair is reported in the cell of its smaller id. The same holds for the points of a cell and its own pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbed.operators.skew import is_short
from reedbed.session import materialise

EARTH_M = 6_371_000.0
#: Pivots of a cell, and points of a task that deals them out to the cell's pivots.
FAN, DEAL = 64, 50_000
#: Added to bounds so that rounding cannot lose a pair; the final comparison is exact.
SLACK_M = 1e-3


def great_circle(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Haversine distance in metres; arguments in radians."""
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


class VantageTree:
    """Vantage-point tree over points in radians, built and searched with whole arrays."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, leaf: int = 48):
        self.lat, self.lon, self.leaf = lat, lon, leaf
        self.root = self._build(np.arange(len(lat)))

    def _build(self, idx: np.ndarray):
        if len(idx) <= self.leaf:
            return idx
        centre = idx[len(idx) // 2]
        d = great_circle(self.lat[centre], self.lon[centre], self.lat[idx], self.lon[idx])
        half = np.median(d)
        inside = d <= half
        if inside.all():  # most points are copies of one position: no ball separates them
            inside = np.arange(len(idx)) < len(idx) // 2
            return (centre, np.inf, -np.inf, self._build(idx[inside]), self._build(idx[~inside]))
        return (centre, d[inside].max(), d[~inside].min(), self._build(idx[inside]), self._build(idx[~inside]))

    def within(self, lat: np.ndarray, lon: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (query number, point number) of all pairs within ``radius``, leaf by leaf."""
        stack = [(self.root, np.arange(len(lat)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if isinstance(node, np.ndarray):
                for part in np.array_split(q, max(1, len(q) * len(node) // 2_000_000)):
                    d = great_circle(lat[part][:, None], lon[part][:, None], self.lat[node][None, :], self.lon[node][None, :])
                    a, b = np.nonzero(d <= radius)
                    yield part[a], node[b]
                continue
            centre, most_inside, least_outside, inner, outer = node
            d = great_circle(self.lat[centre], self.lon[centre], lat[q], lon[q])
            stack.append((inner, q[d - radius - SLACK_M <= most_inside]))
            stack.append((outer, q[d + radius + SLACK_M >= least_outside]))


def spaced(lat: np.ndarray, lon: np.ndarray, wanted: int, radius_m: float) -> np.ndarray:
    """Numbers of at most ``wanted`` positions (radians), each at least 6 radii from the others, in order."""
    chosen: list[int] = []
    for i in range(len(lat)):
        if len(chosen) == wanted:
            break
        if not chosen or great_circle(lat[chosen], lon[chosen], lat[i], lon[i]).min() >= 6 * radius_m:
            chosen.append(i)
    return np.array(chosen, dtype=int)


def _dealt(pdf: pd.DataFrame, lat: np.ndarray, lon: np.ndarray, radius_m: float) -> pd.DataFrame:
    """Rows of pdf (id, lat, lon, home) in the cell of their nearest pivot and in all cells that may need them; child: number of the pivot."""
    a, o = np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lon"].to_numpy())
    d = great_circle(a[:, None], o[:, None], lat[None, :], lon[None, :])
    nearest = d.argmin(axis=1)
    i, child = np.nonzero(d <= (d[np.arange(len(pdf)), nearest] + 2 * radius_m + SLACK_M)[:, None])
    rows = pdf.iloc[i]
    return rows.assign(home=rows["home"].to_numpy() & (nearest[i] == child), child=child)


def voronoi_cells(points: DataFrame, radius_m: float, points_per_cell: int, block: int, fan: int = FAN) -> DataFrame:
    """id, lat, lon, home, cell: every point in its own cell (home) and copies in the cells that may need it.

    The first pivots come from a sample of at most 4 x ``fan`` points and are the only ones sent to all tasks. A cell with more than ``block`` points is split by up to ``fan`` pivots from a sample of its own points
    (about 4 x ``fan``), as long as two of them are 6 radii apart; its points are dealt out in tasks of DEAL. Pivots steer the split of work only: every point is joined, whatever they are.
    """
    wanted = int(min(fan, max(1, points.count() // points_per_cell)))
    first = points.select("lat", "lon").orderBy(F.xxhash64("lat", "lon", F.lit(17)), "lat", "lon").limit(4 * wanted).toPandas()
    lat, lon = np.radians(first["lat"].to_numpy(float)), np.radians(first["lon"].to_numpy(float))
    at = spaced(lat, lon, wanted, radius_m)
    lat, lon = lat[at], lon[at]

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                out = _dealt(pdf.assign(home=True), lat, lon, radius_m)
                yield out.assign(cell=1 + out["child"])[["id", "lat", "lon", "home", "cell"]]

    schema = "id string, lat double, lon double, home boolean, cell bigint"
    placed, level = materialise(points.mapInPandas(to_cells, schema), "cells"), 0
    whole: list[DataFrame] = []
    while True:
        counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        big = materialise(counts.where(F.col("n") > block), "big")
        if big.isEmpty() or level == 9:  # numbers of cells have room for ten levels, 64 ** 10 cells
            whole.append(placed)
            break
        hint = lambda d: F.broadcast(d) if is_short(d) else d
        joined = placed.join(hint(big), "cell")
        some = joined.where(F.pmod(F.xxhash64("id", F.lit(17 + level)), F.col("n")) < 4 * fan)

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id").drop_duplicates(["lat", "lon"])
            chosen = pdf.iloc[spaced(np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lon"].to_numpy()), fan, radius_m)]
            return chosen[["cell", "n", "lat", "lon"]] if len(chosen) > 1 else chosen[["cell", "n", "lat", "lon"]].iloc[:0]

        pivots = materialise(some.groupBy("cell").applyInPandas(pick, "cell bigint, n bigint, lat double, lon double"), "pivots")
        split = pivots.select("cell").distinct()
        whole.append(placed.join(hint(split), "cell", "left_anti"))
        if split.isEmpty():
            break
        tasks = F.ceil(F.col("n") / DEAL).cast("int")
        inside = joined.join(hint(split), "cell", "left_semi").withColumn("deal", F.pmod(F.xxhash64("id"), tasks).cast("int")).drop("n")
        guides = pivots.select(F.lit(None).cast("string").alias("id"), "lat", "lon", F.lit(False).alias("home"), "cell", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("deal"))

        def deal(pdf: pd.DataFrame) -> pd.DataFrame:
            guide = pdf["id"].isna().to_numpy()
            p = pdf[guide].sort_values(["lat", "lon"])
            out = [_dealt(part, np.radians(p["lat"].to_numpy()), np.radians(p["lon"].to_numpy()), radius_m) for part in np.array_split(pdf[~guide], max(1, int((~guide).sum()) // 20_000))] if not guide.all() else []
            if not out:
                return pdf.iloc[:0][["id", "lat", "lon", "home", "cell"]]
            made = pd.concat(out)
            return made.assign(cell=made["cell"] * FAN + made["child"])[["id", "lat", "lon", "home", "cell"]]

        placed, level = materialise(inside.unionByName(guides).groupBy("cell", "deal").applyInPandas(deal, schema), "cells"), level + 1
    out = whole[0]
    for part in whole[1:]:
        out = out.unionByName(part)
    return out


def radius_pairs(
    df: DataFrame, key: str, radius_m: float, lat: str = "lat", lon: str = "lon", points_per_cell: int = 200, block: int = 4_000
) -> DataFrame:
    """All pairs of different keys at most ``radius_m`` apart, each once: ``key``_1 < ``key``_2 (byte order), distance_m.

    A key in several rows counts once (its smallest position; where positions are given they agree in this data). Rows with a null
    key, a null or NaN coordinate, an impossible one or both 0 have no position. Keys at the same position are a pair; an empty
    table gives no rows. Cells of more than ``block`` points that no further pivots split, because all lie within a few radii, are worked off in blocks of queries against blocks of points.
    """
    points = df.select(F.col(key).cast("string").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    points = points.where("id is not null and lat between -90 and 90 and lon between -180 and 360 and not (lat = 0 and lon = 0)")
    points = materialise(points.groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("id", "p.lat", "p.lon"), "points")
    placed = voronoi_cells(points, radius_m, points_per_cell, block)

    # Cells over the block size: queries (home points) and points in blocks, every block of one against every block of the other.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).where("parts > 1")
    placed = placed.join(F.broadcast(sizes) if is_short(sizes) else sizes, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    asking = placed.where("home").select("cell", part.alias("qb"), F.explode(every).alias("pb"), "id", "lat", "lon", F.lit(True).alias("asks"))
    asked = placed.select("cell", F.explode(every).alias("qb"), part.alias("pb"), "id", "lat", "lon", F.lit(False).alias("asks"))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, asks = pdf["id"].to_numpy(object), pdf["asks"].to_numpy(bool)
        a, o = np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lon"].to_numpy())
        order = np.argsort(np.array([x.encode() for x in ids], dtype=object), kind="stable")
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        q, p = np.flatnonzero(asks), np.flatnonzero(~asks)
        left, right, dist = [], [], []
        if len(q) and len(p):
            tree = VantageTree(a[p], o[p])
            for i, j in tree.within(a[q], o[q], radius_m):
                i, j = q[i], p[j]
                keep = (rank[i] < rank[j]) & (ids[i] != ids[j])
                i, j = i[keep], j[keep]
                left.append(ids[i])
                right.append(ids[j])
                dist.append(great_circle(a[i], o[i], a[j], o[j]))
        cat = lambda x, kind: np.concatenate(x) if x else np.array([], dtype=kind)
        return pd.DataFrame({f"{key}_1": cat(left, object), f"{key}_2": cat(right, object), "distance_m": cat(dist, float)})

    return asking.unionByName(asked).groupBy("cell", "qb", "pb").applyInPandas(pairs, f"{key}_1 string, {key}_2 string, distance_m double")
