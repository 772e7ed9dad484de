"""Hooks for a user's recogniser and detector: batch functions run by mapInArrow.

A backend is a factory with options. What it makes is a function of a pandas
frame of tasks, which returns a list of results for each row, or yields them one
by one. It is made once for each Python worker and set of options. A row that
fails gives no results, and its error is reported in their place instead of
ending the job. If a function yields, the rows before the failing one keep their
results, and it goes on after that; if it returns all at once, the rows of the
failing batch are read one by one, so that none is read more than twice.
:func:`isolated` runs a backend in a process of its own, which may exit or hang.
"""

from __future__ import annotations

import inspect
import os
import pickle
import select
import struct
import subprocess
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field
from itertools import islice
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import LETTERS

READING = "reading_seq int, raw_text string, confidence double"
BOX = "det_seq int, x1 double, y1 double, x2 double, y2 double, confidence double"
#: name -> factory of a batch function: frame of tasks -> a list of tuples for each row, without their numbers.
BACKENDS: dict[str, Callable[..., Callable]] = {}
#: What this process has made: the same options give the same function, whatever the task.
_READY: dict[str, Callable] = {}
#: Bytes of a batch of rows that goes to Python, unless the session sets its own or one row has more.
BATCH_BYTES, _BATCH_KEY = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


@dataclass(frozen=True)
class Configured:
    """A backend with its options; calling it gives the batch function."""

    factory: Callable[..., Callable]
    options: dict
    key: str = field(default_factory=lambda: uuid4().hex)

    def __call__(self) -> Callable:
        if self.key not in _READY:
            _READY[self.key] = self.factory(**self.options)
        return _READY[self.key]


def backends() -> list[str]:
    return sorted(BACKENDS)


def backend(name: str, **options) -> Configured:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known: {', '.join(backends())}")
    inspect.signature(BACKENDS[name]).bind(**options)
    return Configured(BACKENDS[name], options)


def _said(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"


def answers(read: Callable, frame: pd.DataFrame) -> list[list[tuple] | str]:
    """Results of each row, or its error."""
    out: list[list[tuple] | str] = []
    while len(out) < len(frame):
        rest, got, found, error = frame[len(out) :], [], None, None
        try:
            found = read(rest)
            for one in found:
                got.append(one)
            if len(got) != len(rest):
                raise ValueError(f"{len(got)} results for {len(rest)} tasks")
        except Exception as e:  # noqa: BLE001  a bad photo must not end the job
            error = _said(e)
        if error is None:
            out += got
        elif inspect.isgenerator(found) and len(got) < len(rest):
            out += [*got, error]
        elif len(rest) == 1:
            out.append(error)
        else:
            out += [one for k in range(len(rest)) for one in answers(read, rest[k : k + 1])]
    return out


def _each(frame: pd.DataFrame, rows: pa.Table, column: str) -> tuple[pd.DataFrame, pa.Table]:
    """A row for each item of a list column, with its fields as columns; other values of the frame are shared, not copied."""
    lists = rows[column].combine_chunks()
    parents, items = lists.value_parent_indices(), lists.flatten()
    there = items.is_valid()
    parents, items = parents.filter(there), items.filter(there)
    fields = {f.name: items.field(k) for k, f in enumerate(items.type)}
    whole = frame.drop(columns=column).iloc[parents.to_numpy()].reset_index(drop=True)
    shown = pd.concat([whole, pa.table(fields).to_pandas()], axis=1)
    kept = rows.drop_columns([column]).take(parents)
    for name, values in fields.items():
        kept = kept.append_column(name, values)
    return shown, kept


def run(tasks: DataFrame, make: Callable[[], Callable], results: str, unseen: tuple[str, ...] = (), each: str | None = None) -> DataFrame:
    """The tasks' columns, those of ``results`` (the first numbers a task's results from 1), and error.

    Columns in ``unseen`` go to the backend and no further, as the bytes of a
    photo do. ``each`` names a column of lists of structs; the backend gets a row
    for each item, so that a crop goes to Python once with all its tasks. Batches
    are bounded in bytes; a larger row is a batch of its own.
    """
    spark = tasks.sparkSession
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    own = {c: t for c, t in tasks.dtypes if c not in unseen and c != each}
    if each:
        own |= dict(tasks.select(F.inline(each)).dtypes)
    names = [c.split()[0] for c in results.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = make()
        for part in parts:
            if not part.num_rows:
                continue
            rows = pa.Table.from_batches([part])
            frame, rows = rows.to_pandas(), rows.drop_columns([c for c in rows.column_names if c in unseen])
            if each:
                frame, rows = _each(frame, rows, each)
            task, number, said, error = [], [], [], []
            for k, found in enumerate(answers(read, frame) if len(frame) else []):
                if isinstance(found, str):
                    task.append(k), number.append(0), said.append(nothing), error.append(found)
                else:
                    for n, one in enumerate(found, 1):
                        task.append(k), number.append(n), said.append(one), error.append(None)
            if not task:
                continue
            # The tasks' own columns go through as they came.
            out = rows.select(list(own)).take(pa.array(task, pa.int64()))
            for field, values in zip(added, (number, *zip(*said, strict=True), error), strict=True):
                out = out.append_column(field, pa.Array.from_pandas(values, type=field.type))
            yield from out.combine_chunks().to_batches()

    kinds = ", ".join(f"`{c}` {t}" for c, t in own.items())
    shape = f"{kinds}, {results}, error string"
    empty = spark.createDataFrame([], f"{results}, error string")
    added, nothing = list(to_arrow_schema(empty.schema)), (None,) * (len(names) - 1)
    return tasks.mapInArrow(batches, shape).select(*own, *names, "error")


def remaining(tasks: DataFrame, answered: DataFrame, *keys: str) -> DataFrame:
    """Tasks that no answer, failed ones included, is there for yet: what is left of a job that ended early."""
    return tasks.join(answered.select(*keys).distinct(), [*keys], "left_anti")


def _receive(pipe: int, seconds: float | None) -> object:
    """The next message of a pipe."""

    def exactly(n: int) -> bytes:
        out = b""
        while len(out) < n:
            left = None if end is None else max(0.0, end - time.monotonic())
            if not select.select([pipe], [], [], left)[0]:
                raise TimeoutError(f"no answer within {seconds:g} s")
            part = os.read(pipe, min(1 << 20, n - len(out)))
            if not part:
                raise EOFError
            out += part
        return out

    end = None if seconds is None else time.monotonic() + seconds
    return pickle.loads(exactly(struct.unpack("<q", exactly(8))[0]))  # noqa: S301  from our own process


def _send(pipe, message: object) -> None:
    data = pickle.dumps(message)
    pipe.write(struct.pack("<q", len(data)) + data)
    pipe.flush()


class Child:
    """A process that holds a backend and answers frames, a message for each row."""

    def __init__(self, make: Callable[[], Callable], seconds: float):
        self.code, self.seconds, self.process = cloudpickle.dumps(make), seconds, None

    def _ask(self, frame: pd.DataFrame) -> Iterator[list[tuple] | str]:
        if self.process is None:
            env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, sys.path))}
            self.process = subprocess.Popen([sys.executable, "-c", f"from {__name__} import serve; serve()"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=env)
            _send(self.process.stdin, self.code)
        _send(self.process.stdin, frame)
        for _ in range(len(frame)):
            yield _receive(self.process.stdout.fileno(), self.seconds)

    def close(self) -> int | None:
        if self.process is None:
            return None
        self.process.kill()
        code = self.process.wait()
        self.process.stdin.close()
        self.process.stdout.close()
        self.process = None
        return code

    def __call__(self, frame: pd.DataFrame) -> Iterator[list[tuple] | str]:
        """Results or an error for each row; the process is replaced when it has died or takes too long."""
        k, alone = 0, False
        while k < len(frame):
            began, to = k, k + 1 if alone else len(frame)
            try:
                for one in self._ask(frame[k:to]):
                    yield one
                    k += 1
            except (EOFError, BrokenPipeError, TimeoutError) as e:
                code = None
                if self.process and not isinstance(e, TimeoutError):
                    with suppress(subprocess.TimeoutExpired):  # its pipe ends a moment before it does
                        code = self.process.wait(5)
                self.close()
                if k == began and to - k > 1:
                    alone = True  # nothing tells which row it was
                    continue
                yield _said(e) if isinstance(e, TimeoutError) else f"ChildProcessError: ended with {code}"
                k += 1


def isolated(make: Callable[[], Callable], seconds: float = 60.0) -> Configured:
    """The backend in a process of its own: one that exits, or takes longer than that for a row, costs that row only.

    A backend that yields its rows one by one is told apart by row at once. One
    that returns a batch gets the time for the batch, and where it dies, its rows
    are asked one by one.
    """
    return Configured(Child, {"make": make, "seconds": seconds})


def serve() -> None:
    """The other side of :class:`Child`."""
    said = os.fdopen(os.dup(1), "wb")
    os.dup2(2, 1)  # what a backend prints must not mix with its answers
    read = cloudpickle.loads(_receive(0, None))()
    try:
        while True:
            frame = _receive(0, None)
            found = None
            try:
                found = read(frame)
            except Exception as e:  # noqa: BLE001
                found = _said(e)
            if inspect.isgenerator(found):
                done = 0
                while done < len(frame):
                    try:
                        for one in islice(found, len(frame) - done):
                            _send(said, one)
                            done += 1
                        missing = f"ValueError: {done} results for {len(frame)} tasks"
                    except Exception as e:  # noqa: BLE001
                        missing = _said(e)
                    if done < len(frame):
                        _send(said, missing)
                        done += 1
                        found = read(frame[done:]) if done < len(frame) else None
            else:
                for one in found if isinstance(found, list) and len(found) == len(frame) else answers(read, frame):
                    _send(said, one)
    except EOFError:
        pass


def echo_reader(seed: int = 0) -> Callable:
    """A stand-in for a recogniser, which makes up each crop's plate from its number."""

    def read(tasks: pd.DataFrame) -> Iterator[list[tuple[str, float]]]:
        crops = tasks["crop_id"] if "crop_id" in tasks else tasks["photo_id"] * 1000 + tasks["det_seq"]
        for crop, field, variant, alphabet in zip(crops.array, tasks["field"].array, tasks["variant_no"].array, tasks["alphabet"].array, strict=True):
            crop = int(crop) + seed
            if crop % 11 == 0 and variant == 1:
                raise ValueError("no image")
            if field == "digits":
                text = str(10000 + crop % 90000)
            elif field == "letter":
                text = LETTERS[crop % len(LETTERS)]
            elif field == "region":
                text = str(1 + crop % 89)
            else:
                text = ("-" if alphabet == "any" else "").join((str(10000 + crop % 90000), LETTERS[crop % len(LETTERS)], str(1 + crop % 89)))
            yield [(text, variant / 8)]

    return read


def centre_detector() -> Callable:
    """A stand-in for a detector, which finds one box in the middle of each photo."""

    def detect(photos: pd.DataFrame) -> list[list[tuple[float, ...]]]:
        return [[(w / 4, h / 4, w * 3 / 4, h * 3 / 4, 0.5)] for w, h in zip(photos["img_w"], photos["img_h"], strict=True)]

    return detect


BACKENDS["echo"] = echo_reader
