"""Session factory and the settings every operator relies on."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the engine's defaults; keyword values win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, as a URI or path.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests, one machine) a local folder is made, and only in local mode.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"marlstone-checkpoint-{os.getuid()}")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_ROOTS: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables; it goes when Python ends."""
    application = spark.sparkContext.applicationId
    if application not in _ROOTS:
        _ROOTS[application] = f"{ensure_checkpoint_dir(spark)}/tables-{application}-{uuid.uuid4().hex[:8]}"

        def clean(path: str = _ROOTS[application]) -> None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001 - the session has ended already
                pass

        atexit.register(clean)
    return _ROOTS[application]


def materialize(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage of df: write it as a table in the shared folder, in folders of the columns ``by``, and read that.

    Unlike a checkpoint the table has sizes of its own. Estimates that are
    carried through a loop of joins multiply in every round.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    return out


_WRITTEN: set[str] = set()


def scratch(spark: SparkSession, name: str, write) -> str:
    """A named folder of this application in the shared folder; write(path) fills it once."""
    path = f"{_root(spark)}/{name}"
    if path not in _WRITTEN:
        write(path)
        _WRITTEN.add(path)
    return path


def discard(df: DataFrame) -> None:
    """Delete a table that materialize made, once nothing reads it any more."""
    path = getattr(df, "_marlstone_path", None)
    if path:
        _delete(df.sparkSession, path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    place = tempfile.mkdtemp(prefix="marlstone-")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    target = os.path.join(place, "marlstone.zip")
    Path(target).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(application)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one table of a data folder.

    Timestamps without a zone are UTC; in a session of another zone they are
    turned into instants here, since a plain cast would read them as local time.
    """
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        return df
    plain = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")) for c in plain}) if plain else df
