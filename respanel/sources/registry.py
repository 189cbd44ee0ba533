"""Reader registry and format dispatch."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from respanel.schema import FormatError

SNIFF_BYTES = 8192


@dataclass(frozen=True)
class Reader:
    """A named format: extensions, a test of a file's head, and a function from (spark, path, options) to records."""

    name: str
    extensions: tuple[str, ...]
    sniff: Callable[[str, bytes], bool]
    read: Callable[..., DataFrame]
    description: str = ""


READERS: dict[str, Reader] = {}


def register(reader: Reader) -> Reader:
    if reader.name in READERS:
        raise ValueError(f"a reader named {reader.name!r} exists already")
    READERS[reader.name] = reader
    return reader


def head_of(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, through the file system that Spark uses for it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(conf)
    if not store.exists(place):
        raise FormatError(f"no such file: {path}")
    if store.getFileStatus(place).isDirectory():
        return b""
    stream = store.open(place)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, SNIFF_BYTES)))
    finally:
        stream.close()


def dispatch(name: str | None, path: str, head: bytes) -> Reader:
    """An explicit format wins; else the sniffers of the extension, then all, then a sole reader of the extension."""
    if name is not None:
        if name not in READERS:
            raise FormatError(f"unknown format: no reader is called {name!r}, only {', '.join(sorted(READERS))}")
        return READERS[name]
    extension = os.path.splitext(path)[1].lower()
    own = [r for r in READERS.values() if extension in r.extensions]
    for reader in [*own, *READERS.values()]:
        if head and reader.sniff(path, head):
            return reader
    if len(own) == 1 and head:
        return own[0]
    raise FormatError(f"cannot tell the format of {path}; name one of {', '.join(sorted(READERS))}")


def read_any(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Records of any known format."""
    import respanel.sources.delimited
    import respanel.sources.inspect_logs
    import respanel.sources.jsonl
    import respanel.sources.lmeval  # noqa: F401

    reader = dispatch(fmt, path, b"" if fmt else head_of(spark, path))
    return reader.read(spark, path, **options)
