"""Rows written once in order, read back as ranges of positions in any order.

One range shuffle puts the rows in order; every task writes its part as an
Arrow file of small records below the session's shared folder and returns the
file's name and row count. A range of positions is then a few records of one or
two files, whose footers say where they are: nothing else is read. A task
names its file afresh, so a retry never touches what another attempt wrote,
and only files that an accepted attempt returned are known.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame

from skein.session import scratch_path

#: files that a reader keeps open
OPEN_FILES = 64


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path there of a URI."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def write_ranges(df: DataFrame, order: str, parts: int, record_rows: int) -> "RowRanges":
    """The rows of ``df`` in the order of a column, in ``parts`` files of
    records with ``record_rows`` rows (a file's last one may have fewer). Equal
    values of the column come in any order, the same at every read."""
    folder = scratch_path(df.sparkSession, "ranges")

    def write(batches):
        files, path = opened(folder)
        files.create_dir(path, recursive=True)
        name, rest, rows, sink = f"{uuid.uuid4().hex}.arrow", [], 0, None
        for batch in batches:
            if sink is None:
                stream = files.open_output_stream(f"{path}/{name}")
                sink = pa.ipc.new_file(stream, batch.schema)
            rest.append(batch)
            if sum(b.num_rows for b in rest) < record_rows:
                continue
            held = pa.Table.from_batches(rest).combine_chunks()
            full = held.num_rows - held.num_rows % record_rows
            sink.write_table(held.slice(0, full), max_chunksize=record_rows)
            rows, rest = rows + full, held.slice(full).to_batches()
        if sink is not None:
            for b in pa.Table.from_batches(rest).combine_chunks().to_batches() if rest else []:
                sink.write_batch(b)
                rows += b.num_rows
            sink.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "rows": pa.array([rows], pa.int64())})

    ranged = df.repartitionByRange(parts, order).sortWithinPartitions(order)
    # a file per range; ranges come in order
    made = ranged.mapInArrow(write, "file string, rows long").toArrow()
    return RowRanges(made.column(0).to_pylist(), np.concatenate(([0], np.cumsum(made.column(1).to_numpy()))), record_rows)


class RowRanges:
    """Which positions each file has: one name and number per file."""

    def __init__(self, files: list[str], starts: np.ndarray, record_rows: int):
        self.files, self.starts, self.record_rows = files, starts, record_rows
        self._open: OrderedDict[int, tuple] = OrderedDict()

    @property
    def n_rows(self) -> int:
        return int(self.starts[-1])

    def __getstate__(self):
        return {**vars(self), "_open": OrderedDict()}

    def _file(self, i: int):
        if i not in self._open:
            files, path = opened(self.files[i])
            source = files.open_input_file(path)
            self._open[i] = source, pa.ipc.open_file(source)
            if len(self._open) > OPEN_FILES:
                self._open.popitem(last=False)[1][0].close()
        self._open.move_to_end(i)
        return self._open[i][1]

    def read(self, start: int, stop: int):
        """Record batches with the rows at positions start to stop - 1, in order."""
        i = int(np.searchsorted(self.starts, start, side="right")) - 1
        while start < stop:
            first, end = int(self.starts[i]), min(stop, int(self.starts[i + 1]))
            while start < end:
                record, skip = divmod(start - first, self.record_rows)
                batch = self._file(i).get_batch(record).slice(skip, end - start)
                yield batch
                start += batch.num_rows
            i += 1
