"""Fires on a stream: components that grow with each batch, and identities that outlive a hash.

The state is a set of append-only tables, a folder per batch. A batch reads folders of
earlier batches only and overwrites its own, so a replay changes nothing.

* ``points``: the batch's new detections with their cube and the label it had then, by day;
* ``merges``: labels that were joined to another one, each with its present root;
* ``sums``: per label what the batch adds to count, coordinate sums and times;
* ``lives``: the identity of every component that the batch touched, and what it absorbed.

A batch looks at stored detections only in the cubes round its own, of the days in reach.
Links among these and the new ones are contracted over *labels*; the labels of all other
cubes stay as they are written, whatever they were merged into. Cubes are linked inside
blocks, as in one clustering, and tables as long as the batch are never broadcast: the
planner's estimate stays that of the files they come from.

An identity is the hash of a fire at its birth. A component that holds cubes of one earlier
component keeps its identity wherever it grows; when several meet, the oldest one lives on
and the others end in it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import domain
from firespark.operators import cluster
from firespark.operators.clean import DETECTION_KEY
from firespark.operators.components import connected_components
from firespark.session import materialise, path_exists, shuffled
from firespark.session import stored as keep

CUBE = ["area_key", "cx", "cy", "ct", "cell"]
AXES = ["x", "y", "t"]
MERGES = "label string, root string"
SUMS = "label string, n long, lat_e7 long, lon_e7 long, start timestamp, last timestamp"
LIVES = "root string, stable_id string, born long, absorbed array<string>"


class IncrementalFires:
    """Connected fires of all detections that came so far, kept from batch to batch under ``root``.

    With ``window_days``, detections whose day is older than that many days before the
    batch's last one are no longer met, and fires that ended before are left out.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str] | None = None, eps: float = C.EPS_M, window_days: int | None = None):
        self.spark, self.root, self.eps, self.window_days = spark, root, eps, window_days
        self.key = key or list(DETECTION_KEY)
        self.side = eps / math.sqrt(3.0) * (1.0 - 1e-12)

    # --- Stored tables ---------------------------------------------------------

    def _write(self, df: DataFrame, name: str, batch: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}/batch={batch}")

    def _read(self, name: str, before: int | None, layout: str | None = None) -> DataFrame | None:
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, path):
            return None if layout is None else self.spark.createDataFrame([], f"{layout}, batch long")
        reader = self.spark.read if layout is None else self.spark.read.schema(f"{layout}, batch long")
        rows = reader.option("basePath", path).parquet(path)
        return rows if before is None else rows.where(F.col("batch") < before)

    def merges(self, before: int | None = None) -> DataFrame:
        """(label, root) of the labels that are no roots: the newest batch has the whole map."""
        held = self._read("merges", before, MERGES)
        newest = held.agg(F.max("batch")).first()[0]
        return held.where(F.col("batch") == newest).select("label", "root") if newest is not None else held.select("label", "root")

    def _rooted(self, rows: DataFrame, before: int | None) -> DataFrame:
        """``rows`` with the present ``root`` of their ``label``."""
        merged = self.merges(before).withColumnRenamed("root", "_root")
        return rows.join(merged, "label", "left").withColumn("root", F.coalesce("_root", "label")).drop("_root")

    # --- One batch -------------------------------------------------------------

    def update(self, batch: DataFrame, number: int) -> None:
        """Take in a batch of clean detections; those that are stored already are passed over."""
        placed = cluster._with_cells(cluster.metric_points(batch.dropDuplicates(self.key)), self.side)
        placed = materialise(placed.withColumn("day", F.to_date("acq_dt")))
        days = placed.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
        if days.low is None:
            return
        stored = self._read("points", number)
        if stored is None:
            fresh, near = placed, None
        else:
            # A neighbourhood reaches 18 hours, so a day to either side holds all of it.
            stored = stored.where(F.col("day").between(F.date_sub(F.lit(days.low), 1), F.date_add(F.lit(days.high), 1)))
            if self.window_days is not None:
                stored = stored.where(F.col("day") >= F.date_sub(F.lit(days.high), self.window_days))
            fresh = materialise(placed.join(shuffled(stored.select(*self.key)), self.key, "left_anti"))
            near = materialise(self._near(stored, fresh, number))
        spots = fresh.select(*CUBE, *AXES)
        both = keep(spots if near is None else spots.unionByName(near.select(*CUBE, *AXES)), "spots")
        cubes = both.groupBy(*cluster.CUBE).agg(F.count("*").alias("n"), *cluster._bounds(), *cluster._witnesses())
        edges = cluster._cell_links(cubes, both, self.side, self.eps + cluster.TIE_M, cluster.DIRECT_PAIRS)
        cells = fresh.select("cell").distinct()
        if near is None:
            named = cells.withColumn("root", F.col("cell")).withColumn("old", F.lit(False))
        else:
            known = near.select("cell", F.col("root").alias("_root")).distinct()
            named = cells.join(known, "cell", "full").select(
                "cell", F.coalesce("_root", "cell").alias("root"), F.col("_root").isNotNull().alias("old")
            )
        named = materialise(named)
        groups = materialise(self._groups(named, edges))
        self._keep(fresh, named, groups, number)

    def _near(self, stored: DataFrame, fresh: DataFrame, number: int) -> DataFrame:
        """Stored positions in the cubes of the new detections and those round them, with their present root."""
        keys = ["area_key", "cx", "cy", "ct"]
        own = fresh.select(*keys).distinct()
        shifted = [(F.col(f"c{a}") + F.col(f"o.d{a}")).alias(f"c{a}") for a in "xyt"]
        around = own.withColumn("o", F.explode(cluster._offsets(half=False))).select("area_key", *shifted).unionByName(own).distinct()
        return self._rooted(stored.select(*CUBE, *AXES, "label").distinct().join(shuffled(around), keys, "left_semi"), number)

    @staticmethod
    def _groups(named: DataFrame, edges: DataFrame) -> DataFrame:
        """(root, target, old): roots and new cubes with the root of their group: an old one if there is one."""
        of = lambda side: shuffled(named.select(F.col("cell").alias(side), F.col("root").alias(f"_{side}")))
        links = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct()
        roots = named.groupBy("root").agg(F.max("old").alias("old"))
        joined = roots.join(shuffled(connected_components(links, forest=True).withColumnRenamed("id", "root")), "root", "left")
        joined = joined.withColumn("component", F.coalesce("component", "root"))
        best = joined.groupBy("component").agg(F.min(F.struct((~F.col("old")).alias("new"), "root"))["root"].alias("target"))
        return joined.join(best, "component").select("root", "target", "old")

    def _keep(self, fresh: DataFrame, named: DataFrame, groups: DataFrame, number: int) -> None:
        # Labels go to the points by cube, never by the label.
        labels = named.join(shuffled(groups.select("root", "target")), "root").select("cell", F.col("target").alias("label"))
        points = fresh.join(shuffled(labels), "cell")
        self._write(points, "points", number, "day")
        points = self.spark.read.parquet(f"{self.root}/points/batch={number}")
        sums = points.groupBy("label").agg(
            F.count("*").alias("n"), F.sum(F.round(F.col("latitude") * 1e7).cast("long")).alias("lat_e7"),
            F.sum(F.round(F.col("longitude") * 1e7).cast("long")).alias("lon_e7"), F.min("acq_dt").alias("start"), F.max("acq_dt").alias("last"),
        )
        self._write(sums, "sums", number)
        moved = groups.where("old and root <> target").select(F.col("root").alias("label"), F.col("target").alias("root"))
        before = self.merges(number)
        onward = moved.select(F.col("label").alias("root"), F.col("root").alias("_to"))
        kept = before.join(onward, "root", "left").select("label", F.coalesce("_to", "root").alias("root"))
        self._write(kept.unionByName(moved), "merges", number)
        self._live(groups, number)

    def _live(self, groups: DataFrame, number: int) -> None:
        """Identities of the components that new detections came to."""
        # Stored cubes near by that nothing new touches are groups of their own: not news.
        grown = self.spark.read.parquet(f"{self.root}/sums/batch={number}").select(F.col("label").alias("target")).distinct()
        lives = self._read("lives", number, LIVES)
        latest = lives.groupBy("root").agg(F.max_by(F.struct("stable_id", "born"), "batch").alias("life"))
        joined = groups.where("old").join(grown, "target").join(latest, "root")
        past = joined.groupBy("target").agg(F.sort_array(F.collect_set(F.struct("life.born", "life.stable_id"))).alias("past"))
        newborn = self.components(number + 1).join(grown.withColumnRenamed("target", "root"), "root", "left_semi")
        told = newborn.join(past.withColumnRenamed("target", "root"), "root", "left")
        kept = F.get("past", F.lit(0))
        self._write(
            told.select(
                "root", F.coalesce(kept["stable_id"], F.col("fire_id")).alias("stable_id"),
                F.coalesce(kept["born"], F.lit(number).cast("long")).alias("born"),
                F.coalesce(F.transform(F.slice("past", 2, F.greatest(F.size("past") - 1, F.lit(0))), lambda p: p["stable_id"]), F.array().cast("array<string>")).alias("absorbed"),
            ), "lives", number,
        )

    # --- Results ---------------------------------------------------------------

    def components(self, before: int | None = None) -> DataFrame:
        """(root, n, lat, lon, start, last, fire_id) of every component, from the sums alone."""
        rooted = self._rooted(self._read("sums", before, SUMS), before)
        total = rooted.groupBy("root").agg(
            F.sum("n").alias("n"), (F.sum("lat_e7") / (F.sum("n") * F.lit(1e7))).alias("lat"),
            (F.sum("lon_e7") / (F.sum("n") * F.lit(1e7))).alias("lon"), F.min("start").alias("start"), F.max("last").alias("last"),
        )
        if self.window_days is not None:
            newest = total.agg(F.max("last").alias("m")).select(F.date_sub(F.to_date("m"), self.window_days)).scalar()
            total = total.where(F.to_date("last") >= newest)
        return total.withColumn("fire_id", domain.fire_id(F.col("lat"), F.col("lon"), F.col("start")))

    def detections(self) -> DataFrame:
        """The stored detections with their present ``fire_id``: joined by label as written, not by the final one."""
        ids = self._rooted(self._read("sums", None, SUMS).select("label").distinct(), None).join(self.components().select("root", "fire_id"), "root")
        points = self._read("points", None)
        return points.join(ids.select("label", "fire_id"), "label").drop("label", "batch", "day", *CUBE[1:], *AXES)

    def identities(self) -> DataFrame:
        """(stable_id, born, root, fire_id, n) of the components that live, under their first name."""
        lives = self._read("lives", None, LIVES).groupBy("root").agg(F.max_by(F.struct("stable_id", "born"), "batch").alias("life"))
        return self.components().join(lives, "root").select("life.stable_id", "life.born", "root", "fire_id", "n")

    def ends(self) -> DataFrame:
        """(stable_id, into, batch) of the identities that ended in another one."""
        return self._read("lives", None, LIVES).select(F.explode("absorbed").alias("stable_id"), F.col("stable_id").alias("into"), "batch")


def fires_writer(fires: IncrementalFires) -> Callable[[DataFrame, int], None]:
    """Micro-batch sink that keeps the fires of a stream of clean detections."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fires.update(batch, batch_id)

    return write
