"""A sink that writes one file for each name, all of them or none.

Rows are pieces of files: those of one name follow one another in a partition, in
order, and are appended to its file as they come, so that no file is held in
memory. Tasks write below a staging folder beside the target. What a task has
written whole is moved to its place there, by renaming; when all tasks are done,
one rename makes the folder the target. If a task fails, the staging folder goes,
and the target is as it was. A task that is run again writes the same names again.

Executors and driver must reach the target by a path or URI that pyarrow knows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Times that a given-up run's files are deleted while tasks still add to them.
FORMAT, ATTEMPTS = "named_files", 50


@dataclass
class Written(WriterCommitMessage):
    files: int


def _there(where: fs.FileSystem, path: str) -> bool:
    return where.get_file_info(path).type != fs.FileType.NotFound


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.uri, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid4().hex
        where, target = self._open()
        if not overwrite and _there(where, target):
            raise FileExistsError(f"{path} is there already")
        where.create_dir(self._staging(target), recursive=True)

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def _staging(self, target: str) -> str:
        return f"{target}.staging-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, target = self._open()
        own, whole = f"{self._staging(target)}/attempt-{uuid4().hex}", f"{self._staging(target)}/whole"
        names, out = [], None
        try:
            for batch in iterator:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    if not names or name != names[-1]:
                        if out:
                            out.close()
                        if not _there(where, self._staging(target)):
                            raise InterruptedError("the run has been given up")
                        # Below its number: a folder for each vehicle is made in its place alone.
                        where.create_dir(own, recursive=True)
                        out = where.open_output_stream(f"{own}/{len(names)}")
                        names.append(name)
                    out.write(content or b"")
        finally:
            if out:
                out.close()
        for k, name in enumerate(names):
            where.create_dir(f"{whole}/{name}".rpartition("/")[0], recursive=True)
            where.move(f"{own}/{k}", f"{whole}/{name}")
        return Written(len(names))

    def commit(self, messages: list[Written | None]) -> None:
        where, target = self._open()
        staging, old = self._staging(target), f"{target}.old-{self.run}"
        where.create_dir(f"{staging}/whole", recursive=True)
        if _there(where, target):
            if not self.overwrite:
                raise FileExistsError(f"{target} is there already")
            where.move(target, old)
        where.move(f"{staging}/whole", target)
        for rest in (staging, old):
            if _there(where, rest):
                where.delete_dir(rest)

    def abort(self, messages: list[Written | None]) -> None:
        where, target = self._open()
        for _ in range(ATTEMPTS):  # tasks that are being killed may still write
            try:
                if not _there(where, self._staging(target)):
                    break
                where.delete_dir(self._staging(target))
            except OSError:
                time.sleep(0.2)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


#: Bytes of read files that go back to Spark at once, unless one file has more.
READ_BYTES = 4 << 20


def read_files(names: DataFrame, path: str, column: str) -> DataFrame:
    """The rows of ``names`` (name, and others that are kept) with the text of the file of that name in the folder, in place of the name.

    Tasks open the files themselves, so that none are listed; one that isn't there is an error.
    """
    kept = [c for c in names.columns if c != "name"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(path.rstrip("/"))
        for batch in batches:
            start, texts, held = 0, [], 0
            for k, name in enumerate(batch.column("name").to_pylist(), 1):
                with where.open_input_file(f"{folder}/{name}") as file:
                    texts.append(file.read().decode())
                held += len(texts[-1])
                if held >= READ_BYTES or k == batch.num_rows:
                    rows = batch.select(kept).slice(start, k - start)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*kept, column])
                    start, texts, held = k, [], 0

    return names.mapInArrow(read, f"{', '.join(f'`{c}` {t}' for c, t in names.dtypes if c != 'name')}, `{column}` string")


def write_files(pieces: DataFrame, path: str, order: tuple[str, ...] = (), overwrite: bool = False) -> None:
    """Write pieces (name, content, and the columns that order a file's pieces) to a folder; names may have folders of their own.

    Null content is empty. Without ``order``, a name should have one piece. The
    folder must not be there yet, unless it may be replaced.
    """
    spark = pieces.sparkSession
    spark.dataSource.register(NamedFiles)
    rows = pieces.where("name is not null").repartition("name").sortWithinPartitions("name", *order)
    rows = rows.select("name", F.col("content").cast("binary").alias("content"))
    rows.write.format(FORMAT).option("path", path).mode("overwrite" if overwrite else "append").save()
