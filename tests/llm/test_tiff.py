import hashlib
import itertools
import struct
import zlib

import edge
import numpy as np
import pytest

from seasonframe.llm import tiff as T

rng = np.random.default_rng(2)
IMAGES = [
    rng.integers(0, 256, (37, 50, 3), np.uint8),
    np.repeat(rng.integers(0, 4, (9, 16, 1), np.uint8), 20, axis=1),
    rng.integers(0, 65536, (5, 7, 1), np.uint16),
]


@pytest.mark.parametrize("compression", [T.NONE, T.LZW, T.DEFLATE, T.PACKBITS])
def test_round_trip(compression):
    for predictor, order, tile in itertools.product((1, 2), "<>", (None, (16, 32))):
        data = T.write_pages(IMAGES, compression, predictor, order, tile, rows=8)
        pages = list(T.read_pages(data))
        assert [(p.height, p.width, p.samples, p.bits, p.tiled) for p in pages] == [
            (*i.shape, 8 * i.itemsize, tile is not None) for i in IMAGES
        ]
        assert [p.pixels for p in pages] == [i.tobytes() for i in IMAGES]


def test_known_codes():
    assert T.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10
    # 256, 7, 258, 8, 8, 258, 6, 6, 257 in nine bits each.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    data = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert T.lzw_decode(data, 100) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    long = bytes(rng.integers(0, 256, 60000, np.uint8))
    assert T.lzw_decode(T.lzw_encode(long), len(long)) == long


def test_rows_of_pages_and_broken_files(spark):
    good = T.write_pages(IMAGES[:2])
    circle = bytearray(T.write_pages(IMAGES[:1]))
    struct.pack_into("<I", circle, len(circle) - 4, struct.unpack_from("<I", circle, 4)[0])
    files = [good, good[:200], b"", None, b"II*\0\xff\xff\xff\xff", b"GIF89a", bytes(circle), good]
    data = spark.createDataFrame([(k, f, 5) for k, f in enumerate(files)], "media_id long, content binary, page int")
    found = sorted((r.media_id, r.page, r.error is None) for r in T.tiff_pages(data).collect())
    assert found == [(0, 0, True), (0, 1, True), (1, 0, False), (2, 0, False), (3, 0, False), (4, 0, False), (5, 0, False),
                     (6, 0, True), (6, 1, False), (7, 0, True), (7, 1, True)]
    assert T.tiff_pages(data.filter("false")).collect() == []


def test_texts_come_back(spark):
    texts = edge.TEXTS | {30: "x" * 192, 31: "x" * 193, 32: "x" * 192}
    found = {r.doc_id: r for r in T.text_media(edge.docs(spark, texts)).collect()}
    for k, t in texts.items():
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = found[k]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    assert found[8].n_pages > 1 and found[30][1:] == found[32][1:] and found[0][1:] == found[1][1:]
    assert T.text_media(edge.empty(spark)).collect() == []
