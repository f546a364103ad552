"""Arrow-batched Python functions, and this package on the executors that run them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, so that Python workers anywhere can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        home = Path(__file__).parent.parent
        with tempfile.TemporaryDirectory() as d:
            tree = Path(d, "tree", home.name)
            shutil.copytree(home, tree, ignore=shutil.ignore_patterns("__pycache__"))
            place = tempfile.mkdtemp(prefix="inkwell-package-")  # served from here while the application runs
            atexit.register(shutil.rmtree, place, ignore_errors=True)
            sc.addPyFile(shutil.make_archive(f"{place}/{home.name}", "zip", tree.parent))


def arrow_udf(f, kind):
    """f from pandas Series to Series, as a column function."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
    return F.pandas_udf(f, kind)
