"""Result files of runs, one per setting, named after it, with the seven published columns.

A Spark data source for writing: each task writes the files of the settings dealt to it under a name of its own, and
the commit gives them their final names, so a repeated or lost task leaves nothing behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tripletide.sources.metrics import HEADER, averages

NAMING = ("store", "policy", "storage", "n_triples", "size", "evict")
# The columns behind HEADER: the measure ``evict`` is a time, the setting ``evict`` a number of graphs.
VALUES = tuple("evict_ms" if c == "evict" else c for c in HEADER)


def file_name(setting: tuple) -> str:
    store, policy, storage, n_triples, size, evict = setting
    return f"{store}{policy}{storage}_bench_{n_triples}_{size}_{evict}.csv"


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def _where(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file:///") else self.path)
        return fs.LocalFileSystem(), self.path

    def write(self, iterator: Iterator) -> _Written:
        store, folder = self._where()
        store.create_dir(folder, recursive=True)
        files = []
        for setting, rows in groupby(iterator, key=lambda r: tuple(r[c] for c in NAMING)):
            lines = [", ".join(HEADER)] + [", ".join(str(float(r[c])) for c in VALUES) for r in rows]
            own = f"{folder}/_{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(own) as out:
                out.write(("\n".join(lines) + "\n").encode())
            files.append((own, f"{folder}/{file_name(setting)}"))
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, _ = self._where()
        for message in messages:
            for own, final in message.files if message else ():
                store.move(own, final)

    def abort(self, messages: list) -> None:
        store, _ = self._where()
        for message in messages:
            for own, _ in message.files if message else ():
                store.delete_file(own)


class ResultFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "result_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_results(metrics: DataFrame, path: str, averaged: bool, store: str = "spark", storage: str = "mem") -> None:
    """One file per setting in ``path``: a line per window, in order of ``epoch``, or one of the run's averages.

    ``metrics`` holds policy, n_triples, size, evict, epoch, precision, recall, fmeasure, and for averaging
    ``evictions`` (null: average over the windows there are). Columns store and storage are taken from it if
    it has them. Times (sparql, explain, evict_ms) and memory are 0 where it has no such columns.
    """
    known = {c for c in metrics.columns}
    whole = metrics.withColumns(
        {c: F.lit(v) for c, v in {"store": store, "storage": storage}.items() if c not in known}
        | {c: F.lit(0.0) for c in VALUES if c not in known}
    )
    if averaged:
        whole = averages(whole, NAMING, VALUES).withColumn("epoch", F.lit(0))
    spark = metrics.sparkSession
    spark.dataSource.register(ResultFiles)
    # A file is written by one task; it has a line per window of one run.
    dealt = whole.select(*NAMING, "epoch", *VALUES).repartition(*NAMING).sortWithinPartitions(*NAMING, "epoch")
    dealt.write.format("result_files").mode("append").save(path)
