"""Tables bucketed by a key, appended by the epochs of streams.

A table is a folder of Parquet files, ``run=<r>/epoch=<n>/`` for what one epoch
of one stream wrote, whose names carry the bucket of the key; ``_buckets`` holds
the number of buckets, the key and the schema.  Any session can open it: it is registered in the
catalog under a passing name, and with it Spark knows how the stored rows are
partitioned.  A join on the key then moves the other side alone, however large the table has become.
Readers that don't know of buckets can read the folder as plain Parquet.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = "spark.quarry.store.buckets"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class BucketedTable:
    """``with BucketedTable(spark, folder, "chunk_hash") as t: ...``; the catalog name goes at the end, the files stay.

    A new table takes its bucket count from ``buckets``, else from the session's
    ``spark.quarry.store.buckets``, else from ``spark.sql.shuffle.partitions``;
    an old one keeps its own.  About 128 MB of keys a bucket is a good size for
    what the table is to become.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int | None = None):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.name = f"quarry_{uuid.uuid4().hex[:12]}"
        self.buckets, self.schema = buckets, None
        fs, note = _file_system(spark, f"{self.folder}/_buckets")
        if fs.exists(note):
            text = fs.open(note)  # Spark's readers skip names with an underscore
            made = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(text, "UTF-8"))
            text.close()
            if made["key"] != key:
                raise ValueError(f"{folder} is bucketed by {made['key']}, not by {key}")
            self.buckets, self.schema = made["buckets"], T.StructType.fromJson(made["schema"])
            self._register()
            spark.sql(f"MSCK REPAIR TABLE {self.name}")
        elif fs.globStatus(_file_system(spark, f"{self.folder}/run=*/epoch=*/*.parquet")[1]):
            raise ValueError(f"{folder} holds files that aren't bucketed")

    def __enter__(self) -> BucketedTable:
        return self

    def __exit__(self, *failure) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _register(self) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        place = self.folder.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {self.name} ({columns}, run STRING, epoch BIGINT) USING parquet PARTITIONED BY (run, epoch) "
            f"CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )

    def _create(self, schema: T.StructType) -> None:
        """The note is written under another name and renamed, so that it is there whole or not at all."""
        conf = self.spark.conf
        self.buckets = int(self.buckets or conf.get(BUCKETS, None) or conf.get("spark.sql.shuffle.partitions"))
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        fs, note = _file_system(self.spark, f"{self.folder}/_buckets")
        _, draft = _file_system(self.spark, f"{self.folder}/_buckets-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"key": self.key, "buckets": self.buckets, "schema": self.schema.jsonValue()}).encode()))
        out.close()
        if fs.exists(note) or not fs.rename(draft, note):
            fs.delete(draft, False)
            raise RuntimeError(f"another stream has made {self.folder}; start this one again")
        self._register()

    def rows(self, without: tuple[str, int] | None = None) -> DataFrame | None:
        """The stored rows, but for those of one (run, epoch); None for a table that has none yet."""
        if self.schema is None:
            return None
        self.spark.catalog.refreshTable(self.name)
        rows = self.spark.table(self.name)
        if without is not None:
            run, epoch = without
            rows = rows.where((F.col("run") != run) | (F.col("epoch") != epoch))
        return rows.drop("run", "epoch")

    def put(self, df: DataFrame, run: str, epoch: int) -> None:
        """Write the rows of an epoch in place of what it wrote before."""
        if self.schema is None:
            self._create(df.schema)
        # a batch of a stream belongs to a session of its own, whose catalog is this one's
        df.sparkSession.sql(
            f"INSERT OVERWRITE TABLE {self.name} PARTITION (run = '{run}', epoch = {int(epoch)}) SELECT * FROM {{new}}",
            new=df.select(*self.schema.names).repartition(self.buckets, self.key),
        )
