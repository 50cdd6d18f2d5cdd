"""Files read by position: listings without contents, streamed digests, byte ranges.

A listing comes from Spark's own file reader, which knows every file system of the cluster and reads no content for it. Contents are then
opened inside tasks and read in pieces, so no file is ever one row or one buffer, whatever its size. Local, HDFS, S3, GCS and Azure paths
are opened by position; on other file systems contents arrive through Spark whole, one file at a time, which bounds a file there by 2 GB.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import ArrowInvalid, ArrowNotImplementedError
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes read at a time where a file is streamed.
PIECE = 8 << 20
#: Bytes of one range where a file is split.
RANGE = 64 << 20
#: Bytes fetched at least, so that small reads of a header are not requests of their own.
BUFFER = 64 << 10


def _parts(path: str) -> tuple[str, str, str]:
    """(scheme, authority, path) of a path as Hadoop writes it, which does not escape characters."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)", path)
    return found.groups(default="") if found else ("file", "", path)


def opener(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and inner path; raises where the scheme is not one that can be opened by position."""
    scheme, authority, inner = _parts(path)
    if scheme == "file":
        return arrow_fs.LocalFileSystem(), inner
    files, root = arrow_fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}/")
    return files, root.rstrip("/") + inner


def by_position(path: str) -> bool:
    """Whether files under the path can be opened by position."""
    try:
        opener(path)
    except (ArrowInvalid, ArrowNotImplementedError, OSError):
        return False
    return True


def listed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of every file under a folder; contents are not read. Spark lists no empty files and none that begin with `_` or `.`."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
            .select("path", "length"))


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over as many tasks as the session shuffles to: a listing is small, what its rows stand for is not."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def over_files(spark: SparkSession, path: str, use: Callable[[str, io.IOBase], Iterator[pd.DataFrame]], schema: str, glob: str = "*") -> DataFrame:
    """Frames that `use(path, handle)` yields for every file, the handle being seekable; files are spread over tasks."""
    if by_position(path):
        def run(batches):
            for pdf in batches:
                for name in pdf["path"]:
                    files, inner = opener(name)
                    with io.BufferedReader(files.open_input_file(inner), BUFFER) as handle:
                        yield from use(name, handle)

        return _spread(listed(spark, path, glob), "path").mapInPandas(run, schema)

    def whole(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield from use(name, io.BytesIO(content))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(whole, schema)


def relative(path: str) -> Column:
    """Names of listed paths below a folder; the last part where `path` is the file itself."""
    base = _parts(path)[2].rstrip("/") + "/"
    inner = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    return F.when(F.startswith(inner, F.lit(base)), F.substring(inner, F.lit(len(base) + 1), F.length(inner))).otherwise(F.element_at(F.split(inner, "/"), -1))


def digests(spark: SparkSession, path: str, glob: str = "*", piece: int = PIECE) -> DataFrame:
    """(path, bytes, sha256) of every file, each streamed in pieces through its digest; empty files are not listed."""
    def digest(name, handle):
        state, size = hashlib.sha256(), 0
        while block := handle.read(piece):
            state.update(block)
            size += len(block)
        yield pd.DataFrame({"path": [name], "bytes": [size], "sha256": [state.hexdigest()]})

    return over_files(spark, path, digest, "path string, bytes bigint, sha256 string", glob)


def over_ranges(rows: DataFrame, use: Callable[..., Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Frames that `use(handle, row)` yields for every row (path, ...), rows spread over tasks so that one file is read by many.

    A task keeps the file of the row before open. Only for paths that can be opened by position.
    """
    def run(batches):
        name, handle = None, None
        try:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    if row.path != name:
                        if handle is not None:
                            handle.close()
                        files, inner = opener(row.path)
                        name, handle = row.path, io.BufferedReader(files.open_input_file(inner), BUFFER)
                    yield from use(handle, row)
        finally:
            if handle is not None:
                handle.close()

    return _spread(rows).mapInPandas(run, schema)
