"""Tables written once by buckets of their id, so that joins on it move nothing.

Prompts, predictions and results are joined on the same id again and again. Stored in
the same number of buckets, each bucket of one table meets the same bucket of the other where it is
read: the plans of such joins, anti-joins and groupings have no exchange.

Ids should be near unique: a bucket is never parted, so an id with a large share of all rows belongs
into a skew join instead. Rows with a null id match nothing and would share a bucket; they are stored apart
and come back as rows of no bucket by `with_null_ids`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.session import MIB

#: Aimed size of a bucket.
BUCKET_BYTES = 256 * MIB


def bucket_count(input_bytes: int) -> int:
    """A power of two, so that tables of different sizes have counts that divide each other."""
    return 1 << max(0, -(-input_bytes // BUCKET_BYTES) - 1).bit_length()


def write_buckets(rows: DataFrame, path: str, buckets: int, key: str = "instance_id") -> None:
    """Store rows in `buckets` sorted files below `path`, those without an id in a folder of their own."""
    known = F.col(key).isNotNull()
    named = f"_buckets_{uuid.uuid4().hex}"
    spread = rows.where(known).repartition(buckets, key).sortWithinPartitions(key)
    spread.write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/known").saveAsTable(named)
    rows.sparkSession.sql(f"drop table {named}")  # the files stay: the table is external
    rows.where(~known).write.parquet(f"{path}/null")


def read_buckets(
    spark: SparkSession, path: str, buckets: int, schema: T.StructType, key: str = "instance_id"
) -> DataFrame:
    """The rows with an id; the plan knows their buckets."""
    named = f"_buckets_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"create table {named} ({columns}) using parquet location '{path}/known' "
        f"clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets"
    )
    found = spark.table(named)
    found.schema  # resolved now; the entry is not needed any more
    spark.sql(f"drop table {named}")
    return found


def with_null_ids(known: DataFrame, path: str) -> DataFrame:
    """Rows of `read_buckets` and those without an id."""
    return known.unionByName(known.sparkSession.read.schema(known.schema).parquet(f"{path}/null"))
