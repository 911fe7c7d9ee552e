"""A stored table of vectors, upserted by id.

Rows are dealt to buckets by a hash of the id.  An upsert writes anew the buckets that it touches, in a folder of its own, and then one small file that tells
in which folder each bucket is; readers see a whole upsert or none of it, and a failed one leaves files that nothing reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gneiss.operators import retrieval


class VectorTable:
    """Rows ``id, embedding`` and further columns; ids are unique, vectors have ``dim`` finite components.

    ``create`` makes one below a path that all executors share; the constructor opens it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        told = self._text("table.json")
        self.schema, self.dim, self.buckets = StructType.fromJson(told["schema"]), told["dim"], told["buckets"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, dim: int, buckets: int = 64) -> VectorTable:
        """``schema``: the columns, id and embedding among them; a bucket is what one upsert rewrites at least."""
        kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        if not {"id", "embedding"} <= set(kind.names):
            raise ValueError("the table has an id and an embedding")
        table = cls.__new__(cls)
        table.spark, table.path = spark, path
        table._put("table.json", {"schema": kind.jsonValue(), "dim": dim, "buckets": buckets})
        table._put("commits/0.json", {})
        return cls(spark, path)

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those with the same id.  Null ids, ids that repeat, and vectors of another length or with components that are null or not finite refuse the whole batch."""
        new = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).withColumn("bucket", self._bucket())
        bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        wrong = F.col("id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != self.dim) | bad
        told = new.groupBy("bucket", "id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(wrong, F.lit(True))).alias("wrong"))
        # One row for each bucket.
        touched = told.groupBy("bucket").agg(F.max("n").alias("n"), F.bool_or("wrong").alias("wrong")).collect()
        if any(r["wrong"] for r in touched):
            raise ValueError(f"every row has an id and {self.dim} finite components")
        if any(r["n"] > 1 for r in touched):
            raise ValueError("ids repeat")
        if not touched:
            return
        version, places = self._latest()
        here = [r["bucket"] for r in touched]
        old = self._read({b: p for b, p in places.items() if int(b) in here}).withColumn("bucket", self._bucket())
        folder = f"data/{uuid.uuid4().hex}"
        merged = old.join(new.select("id"), "id", "left_anti").select(new.columns).unionByName(new)
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        # Whoever commits a version first has it.
        self._put(f"commits/{version + 1}.json", places | {str(b): folder for b in here})

    def read(self) -> DataFrame:
        """All rows of the last commit."""
        return self._read(self._latest()[1])

    def nearest(self, queries: DataFrame, k: int, where: str | None = None) -> DataFrame:
        """``query_id, id, rank, score``: the k nearest rows by cosine, of those that meet ``where``; ``queries``: query_id, v."""
        if not queries.filter(F.coalesce(F.size("v") != self.dim, F.lit(True))).isEmpty():
            raise ValueError(f"queries have {self.dim} components")
        rows = self.read().filter(where or "true").select(F.col("id").alias("doc_id"), F.col("embedding").alias("v"))
        # A query's id is no row's id.
        apart = queries.select((-1 - F.col("query_id")).alias("query_id"), "v")
        return retrieval.nearest(rows, apart, k).select((-1 - F.col("query_id")).alias("query_id"), F.col("doc_id").alias("id"), "rank", "score")

    def _bucket(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _read(self, places: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/{folder}/bucket={bucket}" for bucket, folder in places.items()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _latest(self) -> tuple[int, dict[str, str]]:
        fs, path = self._at("commits")
        version = max(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(path))
        return version, self._text(f"commits/{version}.json")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _text(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def _put(self, name: str, value: dict) -> None:
        """A file that must not be there yet."""
        fs, path = self._at(name)
        out = fs.create(path, False)
        try:
            out.write(json.dumps(value).encode())
        finally:
            out.close()
