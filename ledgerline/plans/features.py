"""Transactions to features, and features to windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import community, graph, neighbourhood, snapshots, windows
from ..operators.pin import pinned
from ..sources import loaders
from ..sources.tables import exists, some


def daily_features(tx: DataFrame, step: float = 1, unit: str = "days", width: float | None = None, echo_days: float | None = None, method: str = "none") -> DataFrame:
    """The 90 features of every node of every snapshot; edges are pruned by community, nodes are all kept."""
    tx = pinned(tx)  # read for the grid and for the edges
    edges = pinned(snapshots.snapshot_edges(tx, snapshots.make_grid(tx, step, unit, width), echo_days))
    return neighbourhood.features(community.prune(edges, method), graph.nodes(edges))


def extract(spark: SparkSession, settings: Settings, folder: str, out: str, method: str = "louvain") -> DataFrame:
    """Computes and stores features and labels of the snapshots that ``out`` does not hold both of yet.

    A snapshot's partitions replace those that an earlier run left, so a run that failed between its two
    writes, or within one, is made good by the next.
    """
    tx = pinned(loaders.load(spark, settings.dataset, folder, settings.kind or None))  # raw files are parsed once
    grid = snapshots.make_grid(tx, settings.step, settings.step_unit, settings.width)
    todo = grid.frame(spark)
    if all(some(spark, f"{out}/{t}/snapshot_id=*") for t in ("features", "labels")):  # partitions appear whole
        done = spark.read.parquet(f"{out}/features").select("snapshot_id").distinct().join(spark.read.parquet(f"{out}/labels").select("snapshot_id").distinct(), "snapshot_id")
        todo = snapshots.pending(todo, done)
    ids = [(r.snapshot_id,) for r in todo.select("snapshot_id").collect()]  # a row a snapshot; the tables read are replaced below
    wanted = F.broadcast(spark.createDataFrame(ids, "snapshot_id int"))
    edges = snapshots.snapshot_edges(tx, grid, settings.days_echo if settings.echo else None).join(wanted, "snapshot_id")
    edges = pinned(edges)
    wide = snapshots.Grid(grid.first, grid.last, grid.step, int(settings.days_echo * 86_400_000_000)) if settings.echo else grid
    labels = snapshots.node_labels(snapshots.assign(tx, wide).join(wanted, "snapshot_id"), "snapshot_id")
    found = neighbourhood.features(community.prune(edges, method), graph.nodes(edges))
    for df, name in ((labels, "labels"), (found, "features")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("snapshot_id").parquet(f"{out}/{name}")
    return spark.read.parquet(f"{out}/features")


def build_windows(spark: SparkSession, settings: Settings, out: str) -> DataFrame:
    """Banded windows over the stored features, through the row store."""
    folder = settings.store or f"{out}/store"
    if not exists(spark, f"{folder}/meta/_SUCCESS"):
        if settings.require_store:
            raise FileNotFoundError(f"no store in {folder}")
        labelled = windows.label_rows(spark.read.parquet(f"{out}/features"), spark.read.parquet(f"{out}/labels"))
        top = labelled.agg(F.max("snapshot_id")).first()[0]
        windows.write_store(windows.store_rows(labelled), folder, (top if top is not None else -1) + 1)
    rows, _, meta = windows.read_store(spark, folder)
    cut = windows.bands(windows.windows(rows, settings.K, settings.task, meta["snapshots"]), settings.n_val, settings.n_test)
    return windows.with_history(cut)
