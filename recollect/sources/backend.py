"""A store's backend as a Python data source: `spark.read.format("recollect_volume").load(folder)`."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .log import scan_volume


class VolumeFile(InputPartition):
    pass


class VolumeReader(DataSourceReader):
    """One partition for each volume file; a file's last record of a key counts, one without a value deletes the key."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        names = sorted(os.listdir(self.path)) if os.path.isdir(self.path) else [""]
        return [VolumeFile(os.path.join(self.path, n) if n else self.path) for n in names]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            records, _ = scan_volume(f.read())
        live = {key: value for key, value in records}
        for key, value in live.items():
            if value:
                yield key, value, os.path.basename(partition.value)


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recollect_volume"

    def schema(self) -> str:
        return "key string, value binary, volume string"

    def reader(self, schema):
        return VolumeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VolumeSource)
