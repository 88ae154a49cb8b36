"""A named store of block matrices: Parquet in buckets of one block index, with a manifest that any session can open it by.

A store is a folder with the blocks under `blocks` and one row about them under
`manifest`. Buckets need an entry in Spark's catalog, which lives no longer
than its session, so opening a store makes that entry anew from the manifest.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, size int, inner string, buckets int, n_blocks long, n_rows long, n_columns long, version string"
COLUMNS = "bi BIGINT, bj BIGINT, x ARRAY<DOUBLE>"
#: Size of a row group, which Parquet looks at every 100 rows.
GROUP_BYTES = 16 << 20


def _entry(path: str, version: str) -> str:
    """The catalog's name of a version of a store."""
    return f"blocks_{hashlib.md5(f'{path} {version}'.encode()).hexdigest()}"


def save(blocks: DataFrame, path: str, name: str, size: int, *, inner: str, buckets: int = 64) -> None:
    """Write blocks (bi, bj, x) of side `size`, in buckets of `inner` (bi or bj) and sorted inside them.

    Two stores with equal `buckets` that meet on their inner index are joined
    without an exchange. The manifest is written last and names the folder of
    this version, so a reader finds a whole store or the one before, and a
    retried task replaces its own file. Equal (bi, bj) are kept apart, as they
    add up. A reader takes up to 4,096 rows of one row group at once, so groups are kept small.
    """
    if inner not in ("bi", "bj"):
        raise ValueError(f"blocks are stored by bi or bj, not {inner}")
    spark = blocks.sparkSession
    before = manifest(spark, path, name)
    version = str(int(before["version"]) + 1) if before else "0"
    folder = f"{path}/{name}/blocks_{version}"
    # a task of each bucket, so that a bucket is one file
    dealt = blocks.select("bi", "bj", "x").repartition(buckets, inner)
    other = "bj" if inner == "bi" else "bi"
    dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, inner).sortBy(inner, other).option("parquet.block.size", GROUP_BYTES).option("path", folder).saveAsTable(_entry(folder, version))
    told = spark.read.schema(COLUMNS).parquet(folder).agg(F.count(F.lit(1)).alias("n"), F.max("bi").alias("i"), F.max("bj").alias("j")).first()
    row = (name, size, inner, buckets, told["n"], (told["i"] + 1 if told["n"] else 0), (told["j"] + 1 if told["n"] else 0), version)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/{name}/manifest")


def manifest(spark: SparkSession, path: str, name: str) -> dict | None:
    """The row about the last version of a store; None if there is none."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/{name}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    row = rows.orderBy(F.col("version").cast("int").desc()).first()
    return row.asDict() if row else None


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The blocks of a store with its buckets known to Spark, so that filters on the inner index read one bucket and joins on it need no exchange."""
    told = manifest(spark, path, name)
    if told is None:
        raise FileNotFoundError(f"no block store {name} in {path}")
    folder = f"{path}/{name}/blocks_{told['version']}"
    entry = _entry(folder, told["version"])
    if not spark.catalog.tableExists(entry):
        other = "bj" if told["inner"] == "bi" else "bi"
        where = folder.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {entry} ({COLUMNS}) USING parquet CLUSTERED BY ({told['inner']}) SORTED BY ({told['inner']}, {other}) INTO {told['buckets']} BUCKETS LOCATION '{where}'")
    return spark.table(entry)


def line(store: DataFrame, inner: str, at: int) -> DataFrame:
    """One block row (inner bi) or block column (bj) of a store: its bucket alone is read, and in that the row groups that may hold it."""
    return store.filter(F.col(inner) == F.lit(at).cast("long"))
