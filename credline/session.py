"""Session helpers: builder defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # delete checkpoint files of RDDs that are no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "credline",
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULT_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions),
                 **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be present (a machine-local folder would not
    survive the loss of an executor). Only a local-mode session without the
    setting gets a fresh private folder, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[|$)", sc.master):  # local-cluster has executors of its own
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="credline-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_RUN = f"credline-run-{uuid.uuid4().hex[:12]}"


def scratch_root(spark: SparkSession) -> str:
    """The one folder below the checkpoint folder that holds everything this process writes
    for its own use."""
    return f"{checkpoint_dir(spark)}/{_RUN}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the run's scratch root."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete the run's scratch tables through Hadoop's file system. Results that still read
    them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_run(spark: SparkSession):
    """``with scratch_run(spark): ...`` deletes the run's scratch tables at its end."""
    try:
        yield scratch_root(spark)
    finally:
        clean_scratch(spark)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a local-mode session
    (``mapInPandas``, ``applyInPandasWithState``): a zip of the package is added with
    ``addPyFile``. Done once per context. On a cluster the package is expected to be
    installed on the executors or submitted with ``--py-files``; nothing is written to a
    machine-local folder there."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED or not re.match(r"local(\[|$)", sc.master):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="credline-pyfiles-")
    zpath = os.path.join(out_dir, "credline.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(pkg_dir):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
