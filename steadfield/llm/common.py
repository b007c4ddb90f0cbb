"""What the operators share: reading tables, the shared folder, tables that cut lineage, joins on hot keys, batches.

Defined results: ``text_or_empty`` and ``folded`` give the empty text for null; ``hot_join`` drops null keys, as an inner
join does, and keeps repeated rows; ``slices`` of an empty batch are none; a single text longer than a slice is a slice.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the text operators fold and split at.
SPACE = r"\x20\x09-\x0D"
#: Used only where the session names no shared folder and runs in one process, as in local tests.
DEFAULT_SHARED_DIR = "file:///tmp/checkpoints/steadfield"

#: Spark's setting that removes a plan's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key is hot with more than 1 / HOT_PARTS of all rows (so no more than HOT_PARTS keys are), and HOT_ROWS at least.
HOT_PARTS, HOT_ROWS = 1_000, 256
#: Text of a batch that a Python function handles at a time.
SLICE_BYTES = 2 << 20

_made: set[str] = set()
#: Tables and folders made within a ``scratch``.
_scratch: list[list[str]] = []

#: For SQL without a crc32: of the strings x of a table crc_in, crc_out has (x, crc). crc_tail has what byte b contributes
#: with k bytes after it, and crc_zero the sum of k zero bytes. Needs WITH RECURSIVE.
CRC_SQL = """
crc_most AS (SELECT coalesce(max(octet_length(encode(x))), 0) AS n FROM crc_in),
crc_bits AS (
  SELECT b, 0 AS i, b AS v FROM range(256) AS r(b)
  UNION ALL SELECT b, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE i < 8
), crc_byte AS MATERIALIZED (SELECT b, v FROM crc_bits WHERE i = 8),
crc_tail AS (
  SELECT 0 AS k, b, v FROM crc_byte
  UNION ALL SELECT t.k + 1, t.b, xor(c.v, t.v >> 8) FROM crc_tail t JOIN crc_byte c ON c.b = t.v & 255 WHERE t.k < (SELECT n FROM crc_most)
), crc_zero AS (
  SELECT 0 AS k, 4294967295 AS v
  UNION ALL SELECT z.k + 1, xor(c.v, z.v >> 8) FROM crc_zero z JOIN crc_byte c ON c.b = z.v & 255 WHERE z.k < (SELECT n FROM crc_most)
), crc_hex AS (SELECT x, octet_length(encode(x)) AS n, hex(encode(x)) AS h FROM crc_in),
crc_parts AS (SELECT x, n, h, unnest(range(n)) AS i FROM crc_hex),
crc_out AS MATERIALIZED (
  SELECT x, xor(xor(bit_xor(t.v), any_value(z.v)), 4294967295) AS crc
  FROM crc_parts p JOIN crc_tail t ON t.k = p.n - 1 - p.i AND t.b = ('0x' || substr(h, 2 * i + 1, 2))::BIGINT JOIN crc_zero z ON z.k = p.n GROUP BY x
)"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder for this application below the one that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = DEFAULT_SHARED_DIR
        spark.conf.set("spark.checkpoint.dir", root)
    context = spark.sparkContext
    if "://" not in root:  # the cluster's own file system, as Spark would take it
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(context._jsc.hadoopConfiguration())
        root = fs.getUri().resolve(fs.makeQualified(path).toUri()).toString()
        root = root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file:///") else root
    own = f"{root.rstrip('/')}/steadfield-{context.applicationId}"
    if own not in _made:
        _made.add(own)
        atexit.register(_remove, context._jvm, context._jsc.hadoopConfiguration(), own)
    return own


def _remove(jvm, configuration, path: str) -> None:
    """Deletes a folder through the JVM; if that has gone before, the folder is left."""
    from py4j.protocol import Py4JError

    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(configuration).delete(target, True)
    except (Py4JError, OSError):
        return


def file_system(uri: str):
    """(file system, path) of an address of the shared folder, for reading and writing files in a task. Local, HDFS and
    S3 addresses are known; Spark's name for the last is another than Arrow's."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3://" + uri.removeprefix("s3a://") if uri.startswith("s3a://") else uri)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _scratch:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is made in the shared folder within this block goes at its end; what is to stay is written to a path from outside."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        for path in made:
            _remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a table to the shared folder (or to path) and reads it back: what follows survives the loss of executors
    without the work before it, and the optimizer knows the table's size."""
    spark = df.sparkSession
    path, before = path or new_path(spark, name), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # nothing reads this plan's shuffle files once the table is there
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df with one more column, whose name is the other result: what tells its rows apart in every plan and after any
    change of cores or executors, as it stands in the data: the file of a row and its number in that file. df is written
    to the shared folder first unless it does no more than read Parquet files."""
    plan = df._jdf.queryExecution().optimizedPlan()
    fixed = plan.deterministic()
    while fixed and plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    fixed = fixed and plan.children().isEmpty() and plan.nodeName().startswith("Relation") and plan.nodeName().endswith("parquet")
    if not fixed:
        df = materialize(df, name)
    place = fresh(df, "place")
    of = df.metadataColumn("_metadata")
    return df.withColumn(place, F.struct(of["file_path"].alias("file"), of["row_index"].alias("row"))), place


def hot_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, by: str) -> DataFrame:
    """rows joined with table (one row for each key) on key. counts: (key, n) of the rows, a table that can be read again.
    Rows of a hot key are dealt by a hash of the column by, and its row of the table goes to each part; the list of hot
    keys is the only thing that is broadcast, and it has HOT_PARTS rows at most."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    share = max(HOT_ROWS, (total or 0) // HOT_PARTS)
    if (most or 0) <= share:
        return rows.join(table.hint("merge"), key)
    part, parts = (fresh(rows.join(table.limit(0), key), n) for n in ("part", "parts"))
    hot = F.broadcast(counts.filter(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias(parts)))
    dealt = rows.join(hot, key, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(by), F.col(parts)).cast("int"), F.lit(0))).drop(parts)
    spread = table.join(hot, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return dealt.join(spread.hint("merge"), [key, part]).drop(part)


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text, so that what is made of a part stays small."""
    size = np.cumsum([0] + [n or 0 for n in pc.binary_length(batch.column(text)).to_pylist()])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose freed memory goes back to the system when it ends: an idle Python worker stays beside the executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def folded(name: str = "text") -> Column:
    """Each run of white space as one space; null as the empty text. A single space, by far the commonest run,
    is not a match, which saves most of the replacing."""
    return F.regexp_replace(text_or_empty(name), rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+", " ")


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of a table; file sizes for a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
