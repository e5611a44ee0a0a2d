"""What operators need from the session: a shared folder, materialised tables, size-checked broadcasts."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its rows and bytes were counted and it holds at most this many bytes.
BROADCAST_BYTES = 48 << 20
#: Arrow batches end at so many bytes where the session sets no limit: 10,000 long texts at once would be far more.
ARROW_BYTES = 4 << 20

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only where all runs on one machine, one of our own if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        found = f"file://{tempfile.gettempdir()}/quillon-shared"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside goes when it ends: intermediate tables, and what failed attempts of tasks left there. Nothing that
    was read from it may be used afterwards, but for what was written to a path that was made before."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.pop()
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> int:
    """Bytes that df holds as a hash table, about: 16 for a row, 8 for a column, and the length of strings, arrays and the like."""
    long = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
    sizes = [F.octet_length(f"`{c}`") for c in long] + [F.octet_length(F.to_json(f"`{c}`")) for c in nested]
    rows, extra = df.agg(F.count("*"), F.coalesce(sum((F.coalesce(F.sum(n), F.lit(0)) for n in sizes), F.lit(0)), F.lit(0))).first()
    return rows * (16 + 8 * len(df.columns)) + extra


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it was measured to be small; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if measured(df) <= limit else df


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once for each application, and bound the batches that go to Python.

    Where the session has no limit of its own on the bytes of an Arrow batch, its setting spark.sql.execution.arrow.maxBytesPerBatch is ARROW_BYTES
    from then on: plans are lazy, so it has to hold until they run.
    """
    unlimited = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if unlimited is None or int(unlimited) >= 1 << 31:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    out = os.path.join(tempfile.mkdtemp(prefix="quillon-"), "quillon.zip")
    Path(out).write_bytes(packed.getvalue())
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)
