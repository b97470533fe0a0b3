"""Vectors in stored files of bounded size, which tasks open themselves and hold one at a time."""

from __future__ import annotations

import numpy as np
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from ..session import workdir
from ..sources.files import open_fs

FILE_BYTES = 16 << 20        # vectors in one file, about
HOLD_BYTES = 32 << 20        # vectors that a task holds beside a file


def write_files(df: DataFrame, tag: str) -> list[str]:
    """The files of ``df``, one for each of its partitions with rows, in their order."""
    path = workdir(df.sparkSession, tag)
    df.write.parquet(path)
    fs, at = open_fs(path)
    store = path[:-len(at)] if path.endswith(at) else ""       # tasks open the same store
    return [store + f.path for f in sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda f: f.path) if f.path.endswith(".parquet")]


def read_columns(path: str, *columns: str) -> list[np.ndarray]:
    """Columns of one file; an array<double> column becomes a matrix."""
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        t = pq.ParquetFile(f).read(columns=list(columns), use_threads=False)
    out = []
    for c in columns:
        if not str(t[c].type).startswith("list"):
            out.append(t[c].to_numpy())
        elif len(t):
            out.append(t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1))
        else:
            out.append(np.zeros((0, 0)))
    return out
