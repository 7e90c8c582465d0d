"""Tables laid out by a key, so that joins and look-ups on it need no exchange and read the key's files alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def keyed(rows: DataFrame, name: str, key: Sequence[str], buckets: int, replace: bool = False) -> DataFrame:
    """rows as a table of the catalogue, dealt by the key over buckets and sorted within; made where it isn't there yet.

    Two tables with the same number of buckets on the same key join without an exchange. Buckets should hold a few
    hundred megabytes each; a key with a large share of all rows stays in one, so lay out by keys that tell rows apart.
    """
    spark = rows.sparkSession
    if replace or not spark.catalog.tableExists(name):
        rows.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    return spark.table(name)
