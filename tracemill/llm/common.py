"""Shared pieces of the text operators: stage tables, row keys, hash draws, running offsets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master (tests)
    may go without; then a temporary folder is chosen once and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracemill-stages-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts lineage: a lost executor costs a re-read. ``release_stages`` removes
    the tables once the results that read them are written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_stages(spark: SparkSession) -> None:
    """Deletes this application's stage tables."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def sheltered(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with room for helper columns, the present name of a column, and a way back to the caller's names.

    Helper columns begin with two underscores. A caller's columns that do so
    are renamed meanwhile; where a result adds a column that the caller has
    already, the new one gets a further underscore.
    """
    hidden = {c: f"own{i}_{c}" for i, c in enumerate(docs.columns) if c.startswith("__")}
    own = {c.lower() for c in docs.columns}

    def restored(df: DataFrame) -> DataFrame:
        if not hidden:
            return df
        back, names = {v: k for k, v in hidden.items()}, []
        for c in df.columns:
            name = back.get(c, c)
            while c not in back and c.startswith("__") and name.lower() in own:
                name += "_"
            names.append(name)
        return df.toDF(*names)

    return docs.withColumnsRenamed(hidden) if hidden else docs, lambda c: hidden.get(c, c), restored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_column: Column, text: Column) -> Column:
    """A long that equal (id, text) rows share: id and text may be null or repeat."""
    return F.xxhash64(id_column.isNull(), id_column, text.isNull(), text)


def row_hash(id_column: Column, text: Column) -> Column:
    """128 bits that equal (id, text) rows share: id and text may be null or repeat."""
    own = id_column.cast("string")
    return F.unhex(F.md5(F.concat(
        F.coalesce(F.concat(F.length(own).cast("string"), F.lit(":"), own), F.lit("-")),
        F.coalesce(F.concat(F.lit("+"), text.cast("string")), F.lit("-")))))


def uniform(*parts: Column) -> Column:
    """A double in (0, 1] drawn from the md5 of the parts; the same everywhere and in every run."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 1) / F.lit(2.0**52)


def extended(schema: T.StructType, fields: str) -> T.StructType:
    """``schema`` with more fields, given as "name type, ..."."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(fields).fields])
