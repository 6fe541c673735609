"""A commit log over Parquet folders: runs appear whole or not at all, replays change nothing.

``<folder>/<table>/commit=<key>/`` holds what a run wrote and
``<folder>/_replaced/commit=<key>/`` the evidence that it wrote anew. The row in
``<folder>/_commits`` comes last, as one file, so readers see all of a run or
nothing of it. Folders of a run that died are overwritten when it is repeated.
Nothing is ever changed in place: an evidence's rows are those of the newest
commit that wrote it, and history tables keep the rows of every commit.
One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMITS = "key string, seq bigint"
_EVIDENCE = ["case_id", "evidence_id"]


@dataclass(frozen=True)
class CommitLog:
    spark: SparkSession
    folder: str

    def _read(self, table: str, schema: T.StructType | str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        except AnalysisException:  # nothing written yet
            return None

    def commits(self) -> DataFrame:
        """(key, seq) of the runs that are complete, one row a run."""
        known = self._read("_commits", _COMMITS)
        return self.spark.createDataFrame([], _COMMITS) if known is None else known

    def has(self, key: str) -> bool:
        return not self.commits().filter(F.col("key") == key).isEmpty()

    def commit(self, key: str, replaced: dict[str, DataFrame], appended: dict[str, DataFrame], evidence: DataFrame | None = None) -> bool:
        """Writes a run; False, and nothing changes, if ``key`` is committed already.

        ``evidence`` (case_id, evidence_id) names what the run replaces; without
        it, what the ``replaced`` tables hold. An evidence listed there without
        rows is empty from now on.
        """
        if self.has(key):
            return False
        for name, df in replaced.items():
            (df.repartition(*_EVIDENCE).sortWithinPartitions(*_EVIDENCE)
             .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*_EVIDENCE).parquet(f"{self.folder}/{name}/commit={key}"))
        for name, df in appended.items():
            df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.folder}/{name}/commit={key}")
        if evidence is None:
            for df in replaced.values():
                evidence = df.select(*_EVIDENCE) if evidence is None else evidence.unionByName(df.select(*_EVIDENCE))
        if evidence is not None:
            evidence.select(*_EVIDENCE).distinct().write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
                f"{self.folder}/_replaced/commit={key}")
        number = self.commits().agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
        self.spark.createDataFrame([(key, number)], _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/_commits")
        return True

    def history(self, table: str, schema: T.StructType) -> DataFrame:
        """Rows of every committed run, with its key as ``commit``."""
        stored = self._read(table, _with_commit(schema))
        if stored is None:
            return self.spark.createDataFrame([], _with_commit(schema))
        return stored.join(self.commits().select(F.col("key").alias("commit")), "commit", "left_semi")

    def current(self, table: str, schema: T.StructType) -> DataFrame:
        """Rows of each evidence as its newest commit wrote them, with that commit's key."""
        fields = [f for f in schema.fields if f.name in _EVIDENCE]
        stored, listed = self._read(table, _with_commit(schema)), self._read("_replaced", _with_commit(T.StructType(fields)))
        if stored is None or listed is None:
            return self.spark.createDataFrame([], _with_commit(schema))
        newest = listed.join(self.commits(), F.col("commit") == F.col("key")).groupBy(*_EVIDENCE).agg(F.max_by("commit", "seq").alias("commit"))
        return stored.join(newest, [*_EVIDENCE, "commit"], "left_semi").select(*schema.names, "commit")


def _with_commit(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
