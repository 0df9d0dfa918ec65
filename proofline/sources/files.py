"""Named files out of a table, written by the tasks that hold their rows."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def save_files(rows: DataFrame, path: str) -> DataFrame:
    """Write each row of ``rows`` (name, content: binary) as a file of that name under ``path``, a URI of a
    file system that pyarrow knows and all workers reach. Returns name and bytes; nothing is written
    until that is read. A file appears whole, as it is renamed when complete; a task that is run again
    replaces it. Path separators in names become underscores."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(b["name"], b["content"]):
                own = re.sub(r"[/\\]", "_", name)
                part = posixpath.join(root, f".{own}.{uuid.uuid4().hex}")
                with system.open_output_stream(part) as f:
                    f.write(content)
                system.move(part, posixpath.join(root, own))
            yield pd.DataFrame({"name": b["name"], "bytes": [len(c) for c in b["content"]]})

    return rows.select("name", "content").mapInPandas(put, "name string, bytes long")


def saved(rows: DataFrame, path: str) -> int:
    """Write them now; how many there are."""
    return save_files(rows, path).count()
