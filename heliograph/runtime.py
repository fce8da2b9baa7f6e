"""Session helpers: table access, lineage cuts, and size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side table may be broadcast by hand; beyond it Spark chooses the join itself.
BROADCAST_ROWS = 20_000
#: Bytes up to which it may, by the lengths of its texts and arrays.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, else an error.

    Checkpoints are deleted when nothing refers to them any more.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    path = context.getConf().get("spark.checkpoint.dir")
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="heliograph-checkpoint-")
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable shared storage and continue from there, so a lost executor costs no replay of the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _size(df: DataFrame) -> tuple[Column, Column]:
    """Aggregates over ``df``: its rows, and their bytes by the lengths of texts and arrays."""
    length = F.lit(16 * len(df.columns))
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            length = length + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            length = length + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(length.cast("bigint")), F.lit(0)).alias("size")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of at most ``BROADCAST_BYTES`` in all, otherwise ``df`` as it is."""
    n, size = df.limit(rows + 1).agg(*_size(df)).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def release(spark: SparkSession) -> None:
    """Let the session's cleaner delete the shuffles and checkpoints of rounds that are over.

    It learns of them when the driver's garbage is collected, which many small rounds on a large driver may never cause.
    """
    gc.collect()
    spark._jvm.System.gc()


def seen_by(observation: Observation) -> dict[str, int]:
    """What an observation saw; nothing where the plan was found to be empty before it ran."""
    return observation.get if observation._jo.getRow().length() else {}


def cut_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small(cut(df))`` in one job: the rows are counted while they are written."""
    observation = Observation()
    held = cut(df.observe(observation, *_size(df)))
    seen = seen_by(observation)
    return F.broadcast(held) if seen.get("n", 0) <= rows and seen.get("size", 0) <= BROADCAST_BYTES else held


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once, here.

    The optimiser copies a deterministic expression into every later use and into every pushed filter, which grows
    exponentially over several steps. A condition on the partition's number, always true, keeps it from doing so.
    """
    here = F.spark_partition_id() >= 0
    return df.withColumns({name: F.when(here, column) for name, column in columns.items()})
