"""Make the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Needed where it isn't installed on them; harmless where it is.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    if here.parent.as_posix().endswith(".zip"):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "plantpulse.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent).as_posix())
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


_SIZED = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


@contextmanager
def sized_caches(*sessions: SparkSession) -> Iterator[None]:
    """Tables persisted within have the partitions that their rows fill.

    Else each that comes from a shuffle has ``spark.sql.shuffle.partitions`` of
    them, and every job that reads it as many tasks, however few its rows.
    """
    before = []
    for s in sessions:
        given = s.conf.get(_SIZED, None)
        if given != "true":
            s.conf.set(_SIZED, "true")
            before.append((s, given))
    try:
        yield
    finally:
        for s, given in before:
            if given is None:
                s.conf.unset(_SIZED)
            else:
                s.conf.set(_SIZED, given)


_OWN: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder in ``spark.checkpoint.dir``, which the cluster shares.

    Only where that is unset (tests, one machine) a temporary one stands in.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        top = _OWN[0]
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"
