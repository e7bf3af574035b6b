"""Operator 8: Ogg containers as a media column.

A payload is kept as packets of 8-bit samples in one logical stream, beside a second
logical stream that describes it; the pages of both are multiplexed into one
physical stream. The streams are written as a table in the shared folder and read
back from there in a stage of their own. Reading verifies each page's checksum, puts
packets together from lacing values (through page bounds), separates the logical
streams and derives every packet's time from granule positions.

Defined results: a null text is the empty payload; the payload is padded with bytes
255 up to a positive multiple of 576; a text of any length is one stream, taken whole;
equal texts give equal values; repeated rows stay, and so do null doc_ids; an empty
table gives an empty result; other columns are ignored; damaged bytes raise
:class:`OggError`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import give_back, small_batches, written

UNIT = 576
RATE = 8000
#: Serial numbers of the two logical streams.
SAMPLES, NOTES = 0x51000001, 0x51000002
#: Bit-reversed bytes: Ogg's checksum is the plain CRC-32 with bits in the other order.
_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """A page or packet that does not hold together."""


def page_crc(page: bytes) -> int:
    """CRC of polynomial 0x04C11DB7, from 0 and without a final exclusive-or."""
    reflected = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{reflected:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, sequence, 0) + bytes([len(lacing)]) + lacing
    page = head + body
    return page[:22] + struct.pack("<I", page_crc(page)) + page[26:]


def pages_of(packets: list[bytes], granules: list[int], serial: int) -> Iterator[tuple[int, bytes]]:
    """Pages of one logical stream, with their sort key: the granule position so far.

    A page holds up to 255 lacing values; packets run on through pages.
    """
    lacing = bytearray()
    ends = []  # of each packet: lacing values so far
    for p in packets:
        lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        ends.append(len(lacing))
    body, at, sequence, done, last = b"".join(packets), 0, 0, 0, 0
    for lo in range(0, max(1, len(lacing)), 255):
        part = bytes(lacing[lo : lo + 255])
        size, ended = sum(part), done
        while ended < len(ends) and ends[ended] <= lo + len(part):
            ended += 1
        granule = granules[ended - 1] if ended > done else -1
        flags = (1 if lo and lacing[lo - 1] == 255 else 0) | (2 if not lo else 0) | (4 if lo + 255 >= len(lacing) else 0)
        last = granule if granule >= 0 else last
        yield last, _page(flags, granule, serial, sequence, part, body[at : at + size])
        at, sequence, done = at + size, sequence + 1, ended


def encode(payload: bytes, note: bytes = b"", unit: int = UNIT) -> bytes:
    """One physical stream: first pages of both streams, then pages by time."""
    packets = [payload[i : i + unit] for i in range(0, len(payload), unit)]
    granules = [min(i + unit, len(payload)) for i in range(0, len(payload), unit)]
    streams = [list(pages_of(packets, granules, SAMPLES)), list(pages_of([note], [len(payload)], NOTES))]
    first = [s[0][1] for s in streams]
    rest = sorted(((g, k, i, p) for k, s in enumerate(streams) for i, (g, p) in enumerate(s) if i), key=lambda x: x[:3])
    return b"".join(first + [p for *_, p in rest])


def decode(data: bytes) -> dict[int, dict]:
    """The logical streams by serial number: packets, granules (position at each packet's
    end where its page tells it, else -1), and pages.

    Raises OggError where a checksum, a sequence number or a lacing run is wrong.
    """
    out: dict[int, dict] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc = struct.unpack_from("<4sBBqIII", data, at)
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        body_at = at + 27 + n
        end = body_at + sum(lacing)
        if end > len(data) or len(lacing) < n:
            raise OggError(f"cut page at byte {at}")
        page = data[at:end]
        if page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        s = out.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "open": b"", "ended": False, "mid": False})
        if sequence != s["pages"] or s["ended"] or version or bool(flags & 2) != (sequence == 0) or bool(flags & 1) != s["mid"]:
            raise OggError(f"page out of order at byte {at}")
        s["pages"] += 1
        s["ended"] = bool(flags & 4)
        values = np.frombuffer(lacing, dtype=np.uint8)
        closes = np.flatnonzero(values < 255)
        stops = body_at + np.cumsum(values, dtype=np.int64)[closes]
        begin = body_at
        for stop in stops.tolist():
            s["packets"].append(s["open"] + data[begin:stop])
            s["granules"].append(-1)
            s["open"], begin = b"", stop
        s["open"] += data[begin:end]
        s["mid"] = bool(n) and lacing[-1] == 255
        if len(stops):
            s["granules"][-1] = granule
        elif granule != -1:
            raise OggError(f"a position without a packet's end at byte {at}")
        at = end
    if any(s["mid"] or not s["ended"] for s in out.values()):
        raise OggError("a stream does not end")
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload of a text, and its length before padding."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media: every whole text as an Ogg stream, read from the table it is stored in."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = []
            for t in batch.column("text"):
                payload, n = padded(t.as_py())
                media.append(encode(payload, b"bytes=%d;rate=%d" % (n, RATE)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])
        give_back()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary"), "media")


def packet_times(stream: dict, rate: int = RATE, unit: int = UNIT) -> np.ndarray:
    """Seconds at each packet's end: from positions where pages tell them, between them by
    counting packets of unit samples back from the next known position.

    A position that differs from the samples up to there raises OggError.
    """
    told = np.array(stream["granules"], dtype=np.int64)
    known = np.flatnonzero(told >= 0)
    samples = np.cumsum([len(p) for p in stream["packets"]])
    if len(told) and (not len(known) or known[-1] != len(told) - 1 or (told[known] != samples[known]).any()):
        raise OggError("a position differs from the samples up to there")
    at = np.arange(len(told))
    after = known[np.searchsorted(known, at)]
    return (told[after] - (after - at) * unit) / rate


def read_back(media: bytes) -> tuple:
    """What op 8 returns of one stored stream, without the id."""
    streams = decode(media)
    samples, notes = streams[SAMPLES], streams[NOTES]
    told = dict(x.split(b"=") for x in notes["packets"][0].split(b";"))
    payload = b"".join(samples["packets"])
    if samples["granules"][-1] != len(payload):
        raise OggError("the last position differs from the number of samples")
    values = np.frombuffer(payload, dtype=np.uint8)
    level = np.bincount(values, minlength=256)
    scale = np.arange(256) - 128
    total, power = int((level * scale).sum()), int((level * scale * scale).sum())
    changes = int(np.count_nonzero((values[1:] < 128) != (values[:-1] < 128)))
    times = packet_times(samples, int(told[b"rate"]))
    # Where the sound's power lies in time: packets by power, each at its middle.
    loud = np.add.reduceat((scale * scale)[values], np.arange(0, len(values), UNIT)).astype(np.float64)
    middle = (times + np.concatenate(([0.0], times[:-1]))) / 2
    centre = float((loud * middle).sum() / loud.sum()) if loud.any() else 0.0
    pages = sum(s["pages"] for s in streams.values())
    feature = (
        f"streams={len(streams)};pages={pages};packets={len(times)};seconds={times[-1]:.3f};centre={centre:.4f};"
        f"mean={total / len(values):.4f};rms={(power / len(values)) ** 0.5:.4f};crossings={changes}"
    )
    return int(told[b"bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def features(stored: DataFrame) -> DataFrame:
    """Reads stored streams back: sizes, digests and features by doc_id."""
    small_batches(stored.sparkSession)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_back(m.as_py()) for m in batch.column("media")]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names])
        give_back()

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
