"""Session settings and shared scratch space.

Intermediate tables that cut lineage are Parquet in the folder named by
``spark.checkpoint.dir``, which driver and executors share. A local session
(tests, a laptop) that names none gets a folder under the temp folder, which
goes with the process; on a cluster such a session is refused.
"""

import atexit
import contextlib
import contextvars
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def get_session(app: str = "notelake", master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder, or a local one when the session names none."""
    shared = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError(f"{_KEY} is not set: a cluster needs a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = folder = tempfile.mkdtemp(prefix="notelake-")
        atexit.register(shutil.rmtree, folder, True)
    return "file://" + _own[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _recorders.get():
        made.append(path)
    return path


#: The lists that record paths in this thread of work: two runs in one driver do not see each other's.
_recorders: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("recorders", default=())


@contextlib.contextmanager
def recording(made: list[str]) -> Iterator[None]:
    """Add the scratch paths that are made meanwhile to ``made``, so that they can be dropped once what reads them has run."""
    token = _recorders.set((*_recorders.get(), made))
    try:
        yield
    finally:
        _recorders.reset(token)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch paths and empty the list."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    paths.clear()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to shared scratch space and read it back: the lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
