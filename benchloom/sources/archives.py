"""Archive scan: zip, tar and tar.gz files, nested, to mark-up payloads."""

from __future__ import annotations

import io
import re
import tarfile
import urllib.parse
import zipfile
import zlib
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nested entries larger than this many bytes are not read, but told.
MAX_ENTRY_BYTES = 2 << 30
#: Tables of contents and sequence listings, which hold no document.
_AUXILIARY = re.compile(r"__(?:TOC|SL\d+)\.xml$", re.IGNORECASE)


def archive_kind(name: Column) -> Column:
    """zip, tar, tar_gz or unknown, from the suffix."""
    low = F.lower(name)
    return F.when(low.endswith(".zip"), "zip").when(low.endswith(".tar.gz") | low.endswith(".tgz"), "tar_gz").when(low.endswith(".tar"), "tar").otherwise("unknown")


def unpack(name: str, data: IO[bytes], size: int, most: int = MAX_ENTRY_BYTES, outer: bool = True) -> Iterator[tuple[str, bytes | None, str]]:
    """(entry name, bytes, status) of every document in an archive, read from a file entry by entry.

    The outer file is streamed whatever its size; a nested entry over ``most`` bytes comes without bytes as
    ``oversized``, an unreadable archive as ``broken``; auxiliary entries are left out.
    """
    low = name.lower()
    if not outer and size > most:
        yield name, None, "oversized"
    elif low.endswith(".xml"):
        if not _AUXILIARY.search(name):
            yield name, data.read(), "ok"
    elif low.endswith(".zip"):
        try:
            with zipfile.ZipFile(data if outer else io.BytesIO(data.read())) as z:  # the table of contents is at the end
                for e in z.infolist():
                    if not e.is_dir():
                        with z.open(e) as f:
                            yield from unpack(e.filename, f, e.file_size, most, False)
        except (zipfile.BadZipFile, RuntimeError, EOFError, OSError):
            yield name, None, "broken"
    elif low.endswith((".tar", ".tar.gz", ".tgz")):
        try:
            with tarfile.open(fileobj=data, mode="r|" if low.endswith(".tar") else "r|gz") as t:
                for e in t:
                    if e.isfile() and (f := t.extractfile(e)):
                        yield from unpack(e.name, f, e.size, most, False)
        except (tarfile.TarError, OSError, EOFError, zlib.error):
            yield name, None, "broken"


class HadoopFile(io.RawIOBase):
    """A local view of one file: plain paths are opened in place, others are copied by the executor's file system client."""

    def __new__(cls, path: str):
        parts = urllib.parse.urlparse(path)
        if parts.scheme in ("", "file"):
            return open(urllib.parse.unquote(parts.path), "rb")
        import pyarrow.fs as fs

        store, at = fs.FileSystem.from_uri(path)
        return store.open_input_file(at)


def read_archives(spark: SparkSession, path: str, most: int = MAX_ENTRY_BYTES) -> DataFrame:
    """(archive, name, content, status) of every document in the archives under a path.

    Only the names of the files are listed by Spark; each task opens its files and reads them entry by entry,
    so an archive of any size takes the memory of one entry. Oversized and broken parts come with their
    status and no content.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, n in zip(b["path"], b["length"]):
                with HadoopFile(p) as f:
                    for name, data, status in unpack(p, f, int(n), most):
                        yield pd.DataFrame({"archive": [p], "name": [name], "content": [data], "status": [status]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    spread = files.repartition(spark.sparkContext.defaultParallelism, "path")
    return spread.mapInPandas(run, "archive string, name string, content binary, status string")
