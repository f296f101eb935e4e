"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "agrolens") -> SparkSession:
    """Session tuned for the library: AQE on, UTC clock, ANSI kept on, UI off.

    On a cluster the master and sizing come from spark-submit; the
    defaults here only matter for local runs and tests.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("AGROLENS_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, sub: str) -> str:
    """A folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session.  Where it is unset, a local master
    (tests) gets a temporary folder; anything else is an error, as executors on
    other machines would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="agrolens-ckpt-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    path = os.path.join(base, sub) if "://" not in base else base.rstrip("/") + "/" + sub
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``agrolens`` importable in Python workers (``addPyFile`` of a zip).

    Needed only by the few Arrow-batched Python kernels; the zip is written
    once per application into the shared folder and distributed by Spark.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import io
    import zipfile
    pkg_root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_root)))
    target = shared_dir(spark, f"pyfiles-{app}")
    if "://" not in target:
        os.makedirs(target, exist_ok=True)
        path = os.path.join(target, "agrolens.zip")
        with open(path, "wb") as fh:
            fh.write(buf.getvalue())
    else:  # shared file system URI: write through Hadoop's FileSystem
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(target + "/agrolens.zip")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(p, True)
        out.write(bytearray(buf.getvalue()))
        out.close()
        path = target + "/agrolens.zip"
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
