import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm import ogg as G
from tests.llm.conftest import DOCS


def slow_crc(data: bytes) -> int:
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
    return c


@given(st.binary(max_size=200))
@settings(deadline=None, max_examples=50)
def test_checksum(data):
    assert G.page_crc(data) == slow_crc(data)


@given(st.lists(st.integers(0, 1200), min_size=1, max_size=12), st.integers(0, 5))
@settings(deadline=None, max_examples=60)
def test_packets_of_any_size(sizes, seed):
    rng = random.Random(seed)
    packets = [rng.randbytes(n) for n in sizes]
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    raw = b"".join(p for _, p in G.pages_of(packets, ends, 77))
    out = G.decode(raw)[77]
    assert out["packets"] == packets and out["granules"][-1] == ends[-1]


def test_packet_through_pages():
    packets = [b"a" * 255 * 300, b"", b"b" * 255, b"c" * 70000]
    pages = list(G.pages_of(packets, [1, 1, 2, 3], 5))
    assert len(pages) > 2 and G.decode(b"".join(p for _, p in pages))[5]["packets"] == packets


def test_streams_are_separated_and_timed():
    payload = bytes(range(256)) * 9 * 200
    out = G.decode(G.encode(payload, b"bytes=1;rate=8000"))
    assert set(out) == {G.SAMPLES, G.NOTES} and b"".join(out[G.SAMPLES]["packets"]) == payload
    times = G.packet_times(out[G.SAMPLES])
    assert times.tolist() == [(i + 1) * 576 / 8000 for i in range(len(payload) // 576)]
    wrong = out[G.SAMPLES] | {"granules": [*out[G.SAMPLES]["granules"][:-1], len(payload) + 1]}
    with pytest.raises(G.OggError):
        G.packet_times(wrong)


def test_damage_is_found():
    data = G.encode(b"x" * 576 * 200, b"bytes=3;rate=8000")
    rng = random.Random(1)
    for _ in range(60):
        at = rng.randrange(len(data))
        with pytest.raises(G.OggError):
            G.decode(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    for cut in (1, 30, 576, len(data) // 2):
        with pytest.raises(G.OggError):
            G.decode(data[:-cut])


def test_query(spark, table):
    texts = ["", None, "é" * 288, "x" * 577, "line\n" * 20000, "x" * 577]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in G.op8_media(spark, table("documents", rows, DOCS)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = G.encode(payload, b"bytes=%d;rate=8000" % len(raw))
        assert r.media_sha256 == hashlib.sha256(media).hexdigest() and r.media_bytes == len(media)
    assert out[3].feature == out[5].feature and out[0].media_sha256 == out[1].media_sha256
    assert G.op8_media(spark, table("documents", [], DOCS)).count() == 0


def test_times_reach_the_feature(spark, table):
    # Bytes near 128 are silent: "\x7f" has power 1 a sample, " " much more.
    quiet_first = "\x7f" * 576 * 3 + " " * 576
    rows = [(None, quiet_first, "x"), (5, "\x7f" * 576 * 4, "y")]
    got = {r.doc_id: dict(x.split("=") for x in r.feature.split(";")) for r in G.op8_media(spark, table("documents", rows, "doc_id long, text string, media string")).collect()}
    packet = 576 / 8000
    power = [1.0, 1.0, 1.0, 96.0**2]
    centre = sum(p * (i + 0.5) * packet for i, p in enumerate(power)) / sum(power)
    assert got[None]["seconds"] == f"{4 * packet:.3f}" and got[None]["centre"] == f"{centre:.4f}"
    assert got[5]["centre"] == f"{2 * packet:.4f}"
