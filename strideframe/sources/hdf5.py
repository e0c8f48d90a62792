"""Recorded HDF5 files as a Spark source. Needs h5py, which is asked for only when the source is used."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class EpisodeFile(InputPartition):
    def __init__(self, path: str, episode_id: int):
        self.path, self.episode_id = path, episode_id


class EpisodeReader(DataSourceReader):
    """One partition for each file; frames are read in slices, so a long recording is never held whole."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.root = schema, options["path"]
        self.slice = int(options.get("slice", 100))

    def partitions(self):
        import glob
        import os
        import re

        found = []
        for path in sorted(glob.glob(os.path.join(self.root, "**", "*.hdf5"), recursive=True)):
            m = re.search(r"episode_(\d+)", os.path.basename(path))
            found.append(EpisodeFile(path, int(m[1]) if m else 0))
        return found

    def read(self, part: EpisodeFile):
        import h5py

        names = [f.name for f in self.schema.fields if f.name not in ("episode_id", "frame_index")]
        with h5py.File(part.path) as f:
            if missing := [n for n in names if n not in f]:
                raise ValueError(f"{part.path} has no {missing}")
            total = f[names[0]].shape[0] if names else 0
            for at in range(0, total, self.slice):
                columns = {n: f[n][at : at + self.slice].tolist() for n in names}
                for i in range(min(self.slice, total - at)):
                    row = {"episode_id": part.episode_id, "frame_index": at + i} | {n: columns[n][i] for n in names}
                    yield tuple(row[x.name] for x in self.schema.fields)


class EpisodeSource(DataSource):
    """spark.read.format("hdf5_episodes").schema(...).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "hdf5_episodes"

    def schema(self) -> str:
        return "episode_id long, frame_index long"

    def reader(self, schema: StructType) -> EpisodeReader:
        return EpisodeReader(schema, self.options)


def register(spark) -> None:
    spark.dataSource.register(EpisodeSource)
