"""Tables cut by a key, of which a task reads the part that belongs to the rows it has.

For what is joined with large rows (whole texts) that should stay where they are: the
other side is written sorted by key, in a folder per few keys, and each task opens its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.warc import open_path, qualified
from kindred.staging import shared_dir

KEYS = 4  # to a folder and task, on average
ROW_GROUP = 4 << 20


@dataclass(frozen=True)
class Shelf:
    """Where the rows of a key are; to be sent to tasks."""

    path: str
    folders: int

    def rows(self, key: int) -> pa.Table | None:
        """The rows with this key in ascending order; None if there are none.

        Only row groups whose range holds the key are read.
        """
        system, path = open_path(f"{self.path}/folder={key % self.folders}")
        if system.get_file_info(path).type != pafs.FileType.Directory:
            return None
        found = pads.dataset(path, filesystem=system, format="parquet", partitioning=None)
        return found.to_table(columns=[c for c in found.schema.names if c != "key"], filter=pads.field("key") == key)


def shelve(rows: DataFrame, n_keys: int) -> Shelf:
    """Write ``rows (key, …)``, of about ``n_keys`` different keys, sorted by all their columns.

    The key is a hashed long. It needs ``spark.checkpoint.dir`` to be a folder that Arrow's
    file systems reach (file, hdfs, s3, gs, …). A failed write leaves no part behind.
    """
    spark = rows.sparkSession
    folders = max(1, -(-n_keys // KEYS))
    path = f"{shared_dir(spark)}/shelf-{uuid.uuid4().hex}"
    (
        rows.withColumn("folder", F.pmod("key", F.lit(folders)))
        .repartition("folder")
        .sortWithinPartitions("folder", *rows.columns)
        .write.partitionBy("folder")
        .option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP)
        .parquet(path)
    )
    return Shelf(qualified(spark, path), folders)
