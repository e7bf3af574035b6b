"""JSON dump files of any size, cut into elements as they are read.

A file is read as a stream: what is at hand is the element under way, not the file. The
elements of the root's list become rows of their own; what a row holds is parsed later, in
the JVM. A file whose structure breaks anywhere is told broken as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read at once at first (more for an element that goes on), and of a batch of rows, about.
READ, BATCH = 1 << 20, 4 << 20
#: Bytes beyond which an element may be too large for a variant or its parser. Of such a one's text
#: as many characters are kept, far more than any bound of a load.
LARGE = 8_000_000

_STRUCTURE = re.compile(rb'["\[\]{},]')
_STRING_END = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_BLANK = re.compile(rb"[ \t\r\n]*")


class Broken(ValueError):
    """The file isn't a JSON text."""


def cut(stream: BinaryIO, read: int | None = None) -> Iterator[bytes]:
    """The elements of a JSON list, or the one value that a file is, as they stand there.

    Whether an element is JSON is for its parser to say; the list around them must be whole.
    """
    step = read or READ
    buffer, at, more = b"", 0, step

    def fill() -> bool:
        """Drops what is done, reads on; False at the end."""
        nonlocal buffer, at, more
        new = stream.read(more)
        buffer, at, more = buffer[at:] + new, 0, max(step, len(buffer) - at)  # a long element is read by doubling steps
        return bool(new)

    def blank() -> bool:
        """Goes on to the next byte that is no white space; False at the end."""
        nonlocal at
        while True:
            at = _BLANK.match(buffer, at).end()
            if at < len(buffer):
                return True
            if not fill():
                return False

    if not blank():
        raise Broken("empty")
    if buffer[at : at + 1] != b"[":
        while fill():
            pass
        yield buffer[at:].strip(b" \t\r\n")
        return
    at += 1
    first = True
    while True:
        if not blank():
            raise Broken("no end")
        if first and buffer[at : at + 1] == b"]":
            at += 1
            break
        first, depth, pos = False, 0, 0  # pos: from the element's begin
        while True:
            m = _STRUCTURE.search(buffer, at + pos)
            if m is None:
                pos = len(buffer) - at
                if not fill():
                    raise Broken("no end")
                continue
            sign = m.group()
            if sign == b'"':
                end = _STRING_END.match(buffer, m.end())
                if end is None:  # the string goes on beyond what is at hand
                    pos = m.start() - at
                    if not fill():
                        raise Broken("no end")
                    continue
                pos = end.end() - at
                continue
            if depth == 0 and sign in b",]":
                break
            depth += 1 if sign in b"[{" else -1 if sign in b"]}" else 0
            if depth < 0:
                raise Broken("closed too often")
            pos = m.end() - at
        element = buffer[at : m.start()].strip(b" \t\r\n")
        if not element:
            raise Broken("nothing between commas")
        yield element
        at = m.end()
        if sign == b"]":
            break
    if blank():
        raise Broken("more after the end")


def shortened(element: bytes) -> str:
    """An element too large for a variant: of an object the known fields, each with LARGE characters at most; of anything else its kind."""
    try:
        value = json.loads(element)
    except ValueError as e:
        raise Broken(str(e)) from None
    if not isinstance(value, dict):
        return "[]" if isinstance(value, list) else '""'
    cut_ = lambda x: x[:LARGE] if isinstance(x, str) else x if x is None or isinstance(x, (bool, int, float)) else [0] if x else []
    return json.dumps({k: cut_(value[k]) for k in ("guid", "title", "url", "error", "article_text") if k in value}, ensure_ascii=False)


def _opened(path: str) -> BinaryIO:
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"))
    system, at = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return system.open_input_stream(at)


def raw_elements(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(ficheiro, pos, raw, partido) of the folder's files: an element's text; pos -1 and partido where the file breaks.

    A file's name has as many parts as the pattern. Names that begin with a dot are passed over.
    """
    parts = 1 + pattern.count("/")
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{pattern}").select("path", "length")  # contents aren't read here
    size = READ

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["ficheiro", "pos", "raw", "partido"])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                name, rows, held = "/".join(path.split("/")[-parts:]), [], 0
                try:
                    with _opened(path) as stream:
                        for i, element in enumerate(cut(stream, size)):
                            rows.append((name, i, shortened(element) if len(element) > LARGE else element.decode("utf-8", "replace"), False))
                            held += len(element)
                            if held >= BATCH:
                                yield made(rows)
                                rows, held = [], 0
                except Broken:
                    rows.append((name, -1, None, True))
                if rows:
                    yield made(rows)

    rows = files.mapInArrow(run, "ficheiro string, pos int, raw string, partido boolean")
    return rows.where(~F.element_at(F.split("ficheiro", "/"), 1).startswith("."))


def parsed(rows: DataFrame) -> DataFrame:
    """rows with item, the raw element as a variant; null where it is no JSON."""
    return rows.withColumn("item", F.try_parse_json("raw"))
