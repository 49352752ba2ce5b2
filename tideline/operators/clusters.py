"""Clusters of reports on the map, with centres that move and an identity from run to run.

Reports are counted by grid cells so small that any two reports of a cell are within `radius` of each other; occupied cells
whose mean places are within the radius are linked, and linked cells are one cluster. So clusters cross the borders of
cells, and work goes with the number of occupied cells - which the size of the globe bounds - not with pairs of reports.
A cluster counts if it has enough reports of enough outlets. It keeps the id of the open cluster that is nearest to its
centre, within twice the radius; each open cluster goes to one new one. Open clusters without reports stay where they are
until nothing has been told of them for `retire` seconds.

Defined results: reports without a place or time are left out; of equal distances the lesser id goes first; the centre is
the mean of the reports of the window, the name the most common place name (the lesser of equals); an empty window retires
only; cells are counted in turns around the globe, so clusters over the date line are found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.lineage import cut
from tideline.operators.joins import near

OPEN = "id string, lat double, lon double, name string, opened long, active long"


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable by links (a, b; both directions given), by least labels of neighbours and
    jumps to the label's own label; rounds grow with the logarithm of a component's length."""
    labels = cut(nodes.select("node", F.col("node").alias("root")))
    links = cut(links.select("a", "b"))
    while True:
        around = links.join(labels.toDF("b", "root"), "b").groupBy("a").agg(F.min("root").alias("least"))
        once = labels.join(around, labels["node"] == around["a"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("least", "root")).alias("root"))
        jump = once.join(labels.toDF("r", "next"), F.col("root") == F.col("r"), "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root"))
        fresh = cut(jump)
        labels = fresh.select("node", "root")
        if fresh.filter("root <> old").isEmpty():
            return labels


def cells_of(reports: DataFrame, radius: float) -> DataFrame:
    """(node, lat, lon, n, outlets, names, active) of occupied cells: sums first, so that a busy cell is counted where it is."""
    step = radius / 160.0  # degrees of latitude: a cell's diagonal is under the radius
    y = F.floor(F.col("lat") / step)
    # Narrow enough at the cell's end nearer to the equator, where it is widest.
    turns = F.greatest(F.lit(1.0), F.floor(360 * F.cos(F.radians(F.least(F.abs(y), F.abs(y + 1)) * step)) / step))
    x = F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) * turns / 360)
    own = reports.filter("lat is not null and lon is not null and t is not null").select(F.concat_ws(":", y, x).alias("node"), "lat", "lon", "source", "name", "t")
    names = own.filter("name is not null").groupBy("node", "name").agg(F.count("*").alias("k")).groupBy("node").agg(F.collect_list(F.struct("name", "k")).alias("names"))
    sums = own.groupBy("node").agg(F.sum("lat").alias("slat"), F.sum("lon").alias("slon"), F.count("*").alias("n"), F.collect_set("source").alias("outlets"), F.max("t").alias("active"))
    return sums.join(names, "node", "left").select("node", (F.col("slat") / F.col("n")).alias("lat"), (F.col("slon") / F.col("n")).alias("lon"), "slat", "slon", "n", "outlets", "names", "active")


def clusters(reports: DataFrame, *, radius: float = 35.0, least_reports: int = 4, least_outlets: int = 2) -> DataFrame:
    """(root, lat, lon, name, n, outlets, active) of the clusters of reports (lat, lon, t, source, name)."""
    cells = cut(cells_of(reports, radius))
    close = near(cells.select("node", "lat", "lon"), cells.select("node", "lat", "lon"), radius).filter("node <> node_r")
    found = cells.join(components(cells.select("node"), close.select(F.col("node").alias("a"), F.col("node_r").alias("b"))), "node")
    tellers = found.select("root", F.explode("outlets").alias("o")).groupBy("root").agg(F.count_distinct("o").alias("outlets"))
    names = found.select("root", F.explode("names").alias("x")).groupBy("root", "x.name").agg(F.sum("x.k").alias("k")).groupBy("root").agg(F.min(F.struct((-F.col("k")).alias("less"), "name")).alias("m"))
    sums = found.groupBy("root").agg(F.sum("slat").alias("slat"), F.sum("slon").alias("slon"), F.sum("n").alias("n"), F.max("active").alias("active"))
    out = sums.join(tellers, "root").join(names, "root", "left").filter((F.col("n") >= least_reports) & (F.col("outlets") >= least_outlets))
    return out.select("root", F.round(F.col("slat") / F.col("n"), 3).alias("lat"), F.round(F.col("slon") / F.col("n"), 3).alias("lon"), F.col("m.name").alias("name"), "n", "outlets", "active")


def move_clusters(open_: DataFrame, reports: DataFrame, now: int, *, radius: float = 35.0, window: int = 48 * 3600, retire: int = 7 * 86400, least_reports: int = 4, least_outlets: int = 2) -> DataFrame:
    """Open clusters after the reports of the last `window` seconds up to now."""
    recent = reports.filter((F.col("t") > now - window) & (F.col("t") <= now))
    new = cut(clusters(recent, radius=radius, least_reports=least_reports, least_outlets=least_outlets))
    # Mutual nearest: a new cluster and an open one that are each other's nearest keep together.
    pairs = near(new.select("root", "lat", "lon"), open_.select("id", "lat", "lon"), 2 * radius).select("root", F.col("id_r").alias("id"), F.round("km", 6).alias("km"))
    best_old = pairs.groupBy("root").agg(F.min(F.struct("km", "id")).alias("m")).select("root", F.col("m.id").alias("id"), F.col("m.km").alias("km"))
    best_new = best_old.groupBy("id").agg(F.min(F.struct("km", "root")).alias("m")).select("id", F.col("m.root").alias("root"))
    kept = new.join(best_new, "root", "left").join(open_.select("id", "opened"), "id", "left")
    moved = kept.select(F.coalesce("id", F.concat(F.lit(f"c{now}-"), "root")).alias("id"), "lat", "lon", "name", F.coalesce("opened", F.lit(now).cast("long")).alias("opened"), "active")
    quiet = open_.join(best_new.select("id"), "id", "left_anti").filter(F.lit(now) - F.col("active") <= retire)
    return moved.unionByName(quiet.select("id", "lat", "lon", "name", "opened", "active"))
