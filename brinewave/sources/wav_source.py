"""WAV files as a Spark data source of their own: ``spark.read.format("wav")``.

Beside :func:`brinewave.sources.audio.read_recordings` it prunes files before
any is opened: filters that name recordings (``recording_id = ...`` or ``IN``)
are taken by the source, and only the files so named are dealt to tasks. A task
gets files of about ``bytesPerTask`` together and holds one recording at a time.

Options: ``path`` (a folder, searched below), ``skipSecs``, ``maxSecs``,
``channel``, ``bytesPerTask``. Broken files are left out, and a folder without
WAV files is an empty frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .audio import decode

BYTES_PER_TASK = 128 << 20
SCHEMA = "recording_id string, sample_rate int, samples array<double>, path string"


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def name_of(path: str) -> str:
    return path.rsplit("/", 1)[-1]


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:  # names in lower case
        most = options.get("maxsecs")
        self.folder = options["path"]
        self.skip, self.most = float(options.get("skipsecs", 0.0)), None if most is None else float(most)
        self.channel = int(options.get("channel", 0))
        self.bytes = int(options.get("bytespertask", BYTES_PER_TASK))
        self.names: set[str] | None = None

    def system(self) -> tuple[pyarrow.fs.FileSystem, str]:
        if ":/" in self.folder:
            return pyarrow.fs.FileSystem.from_uri(self.folder)
        return pyarrow.fs.LocalFileSystem(), self.folder

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("recording_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, folder = self.system()
        found = [x for x in system.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True)) if x.is_file and x.extension.lower() == "wav"]
        out: list[Files] = []
        room = 0
        for x in sorted(found, key=lambda x: x.path):
            if self.names is not None and name_of(x.path) not in self.names:
                continue
            if room <= 0:
                out.append(Files([]))
                room = self.bytes
            out[-1].paths.append(x.path)
            room -= x.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self.system()
        for path in partition.paths:
            with system.open_input_file(path) as f:
                content = f.read()
            try:
                rate, x = decode(content, self.skip, self.most, self.channel)
            except (ValueError, struct.error):
                continue
            x = x if len(x) or not self.skip else np.zeros(1)
            kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name_of(path), rate, x, path), kinds, strict=True)], names=["recording_id", "sample_rate", "samples", "path"])


class WavDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WavReader:
        return WavReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("wav")`` known, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavDataSource)
