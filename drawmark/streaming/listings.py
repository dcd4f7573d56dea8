"""A watched folder's listings as a stream source whose offset is the listing's time.

``record_listing`` adds one folder per listing. The source reads those after its last offset and, once a batch is
committed, removes the listings that it and all before it have taken, but for the latest, with which the next listing is
compared. So the log holds what has not been processed, however long a folder is watched, and a stream that starts again
from its checkpoint goes on after the last committed listing. One stream reads a log."""
from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

OBSERVED = "path string, seen_at timestamp, obs_seq bigint, size_bytes bigint, mtime_us bigint"
NAME = "drawmark_listings"


def _opened(log: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(log) if urlsplit(log).scheme else (fs.LocalFileSystem(), log)


def listing_times(log: str) -> list[int]:
    """Times of the complete listings below ``log``, ascending."""
    system, path = _opened(log)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = [f.base_name for f in found if f.base_name.startswith("at=")]
    done = [n for n in names if system.get_file_info(f"{path}/{n}/_SUCCESS").type == fs.FileType.File]
    return sorted(int(n[3:]) for n in done)


class Listing(InputPartition):
    def __init__(self, file: str):
        self.file = file


class ListingReader(DataSourceStreamReader):
    def __init__(self, log: str):
        self.log = log

    def initialOffset(self) -> dict:
        return {"at": -1}

    def latestOffset(self) -> dict:
        return {"at": max(listing_times(self.log), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Listing]:
        system, path = _opened(self.log)
        files = []
        for at in listing_times(self.log):
            if start["at"] < at <= end["at"]:
                files += [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/at={at:020d}")) if f.path.endswith(".parquet")]
        return [Listing(f) for f in files]

    def read(self, partition: Listing) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.log)
        with system.open_input_file(partition.file) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(10_000, columns=[c.split()[0] for c in OBSERVED.split(", ")]):
                yield batch.set_column(1, "seen_at", batch.column(1).cast(pa.timestamp("us", "UTC")))

    def commit(self, end: dict) -> None:
        system, path = _opened(self.log)
        for at in listing_times(self.log)[:-1]:
            if at <= end["at"]:
                system.delete_dir(f"{path}/at={at:020d}")


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return OBSERVED

    def streamReader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"])


def listing_stream(spark: SparkSession, log: str) -> DataFrame:
    """Stream of the observations of a listing log. A batch takes all listings since the last one."""
    spark.dataSource.register(ListingSource)
    return spark.readStream.format(NAME).load(log)
