"""TIFF in media columns: one row per page, decoded in tasks.

The reader walks the image directories of classic TIFF files in either byte order, decodes
strips or tiles (uncompressed, LZW, deflate, PackBits), undoes horizontal prediction and
gives samples of 8 or 16 bits, interleaved, row by row. The writer makes such files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seasonframe.llm.common import chunks

# Fixed values of the format: tags, field sizes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 128 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[i]])
        else:
            while n < 128 and i + n < len(data) and data[i + n] != data[i + n - 1]:
                n += 1
            out += bytes([n - 1]) + data[i : i + n]
        i += n
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears, 257 ends."""
    out, table, bits = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9
    held = have = 0
    last = b""
    for byte in data:
        held, have = (held << 8 | byte) & 0xFFFFFF, have + 8
        if have < bits:
            continue
        have -= bits
        code = held >> have & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            bits, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        bits = min(12, (len(table) + 1).bit_length())
        last = entry
        if len(out) >= size:
            break
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    table = {bytes([i]): i for i in range(256)}
    held = have = 0
    out, bits, word = bytearray(), 9, b""

    def put(code: int) -> None:
        nonlocal held, have
        held, have = held << bits | code, have + bits
        while have >= 8:
            have -= 8
            out.append(held >> have & 255)
            held &= (1 << have) - 1

    put(256)
    top = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer], top = top, top + 1
        word = data[i : i + 1]
        if top == 4094:
            put(table[word])
            put(256)
            table, top, bits, word = {bytes([k]): k for k in range(256)}, 258, 9, b""
            continue
        bits = max(9, top.bit_length())
    if word:
        put(table[word])
        top += 1
        bits = min(12, max(9, top.bit_length()))
    put(257)
    if have:
        out.append(held << 8 - have & 255)
    return bytes(out)


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {compression}")


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    fields: dict[int, tuple[int, ...]] = {}
    (count,) = struct.unpack_from(order + "H", data, at)
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in FIELD:
            where = at + 10 + 12 * k
            if n * struct.calcsize(FIELD[kind]) > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            fields[tag] = struct.unpack_from(f"{order}{n}{FIELD[kind]}", data, where)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _page(data: bytes, fields: dict[int, tuple[int, ...]], order: str) -> Page:
    def one(tag: int, default: int) -> int:
        return fields.get(tag, (default,))[0]

    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if not width or not height or bits not in (8, 16) or predictor not in (1, 2) or set(fields[BITS]) != {bits}:
        raise ValueError(f"{width} x {height} of {bits} bits, predictor {predictor}")
    tiled = TILE_OFFSETS in fields
    wide, high = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    offsets, counts = fields[TILE_OFFSETS if tiled else STRIP_OFFSETS], fields[TILE_COUNTS if tiled else STRIP_COUNTS]
    deep = samples if planar == 1 else 1
    across, down = -(-width // wide), -(-height // high)
    kind = np.dtype(f"{order}u{bits // 8}")
    image = np.zeros((height, width, samples), kind.newbyteorder("="))
    if len(offsets) != across * down * (samples // deep) or len(counts) != len(offsets):
        raise ValueError("number of strips or tiles")
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, k = divmod(k, across * down)
        y, x = k // across * high, k % across * wide
        rows = high if tiled else min(high, height - y)
        full = rows * wide * deep * kind.itemsize
        raw = _decode(data[at : at + size], compression, full)
        if len(raw) < full:
            raise ValueError("short strip or tile")
        part = np.frombuffer(raw, kind, rows * wide * deep).reshape(rows, wide, deep).astype(image.dtype)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=image.dtype)
        own = slice(None) if planar == 1 else slice(plane, plane + 1)
        image[y : y + rows, x : x + wide, own] = part[: height - y, : width - x]
    return Page(width, height, samples, bits, compression, predictor, tiled, image.tobytes())


def read_pages(data: bytes) -> Iterator[Page]:
    """Pages in the order of their directories; ValueError where the file is broken."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    try:
        if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise ValueError("no TIFF header")
        (at,) = struct.unpack_from(order + "I", data, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("directories in a circle")
            seen.add(at)
            fields, at = _directory(data, at, order)
            yield _page(data, fields, order)
    except (struct.error, KeyError, zlib.error, IndexError) as broken:
        raise ValueError(f"broken file: {broken}") from broken


def write_pages(
    pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, order: str = "<", tile: tuple[int, int] | None = None, rows: int = 64
) -> bytes:
    """Arrays of (height, width, samples), of 8 or 16 bits, as one file of strips or tiles."""
    pack: dict[int, Callable[[bytes], bytes]] = {
        NONE: bytes, DEFLATE: lambda x: zlib.compress(x, 1), LZW: lzw_encode, PACKBITS: pack_bits,
    }
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for image in pages:
        height, width, samples = image.shape
        wide, high = tile or (width, rows)
        offsets, counts = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                part = image[y : y + high, x : x + wide]
                if tile:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                data = pack[compression](part.astype(part.dtype.newbyteorder(order)).tobytes())
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        fields = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * image.itemsize] * samples), (COMPRESSION, 3, [compression]),
            (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]),
        ]
        if tile:
            fields += [(TILE_WIDTH, 4, [wide]), (TILE_HEIGHT, 4, [high]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, kind, values in sorted(fields):
            value = struct.pack(f"{order}{len(values)}{FIELD[kind]}", *values)
            if len(value) > 4:
                where = len(out)
                out += value
                value = struct.pack(order + "I", where)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + value.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries) + bytes(4)
        link = len(out) - 4
    return bytes(out)


PAGES = (
    "media_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, "
    "tiled boolean, pixels binary, error string"
)


def tiff_pages(media: DataFrame) -> DataFrame:
    """``media_id, content`` to one row per page.

    Pages read before a file breaks stay; the break is a row of its own with ``error`` set
    and no pixels. NULL and empty contents give such a row.
    """

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column("media_id").to_pylist(), batch.column("content"), strict=True):
                number, error = 0, None
                try:
                    for page in read_pages(content.as_py() or b""):
                        yield pa.RecordBatch.from_pylist([{"media_id": key, "page": number, **vars(page), "error": None}], schema)
                        number += 1
                except ValueError as broken:
                    error = str(broken)
                if error is not None:
                    yield pa.RecordBatch.from_pylist([{"media_id": key, "page": number, "error": error}], schema)

    schema = pa.schema(
        [("media_id", pa.int64()), *((n, pa.int32()) for n in "page width height samples bits compression predictor".split()),
         ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())]
    )
    return media.selectExpr("cast(media_id AS long) AS media_id", "cast(content AS binary) AS content").mapInArrow(pages, PAGES)


ROW = 192
PAGE_ROWS = 2048


def text_image(text: bytes) -> bytes:
    """A text as pages of 64 RGB pixels a row, padded with blanks to whole rows."""
    size = max(ROW, -(-len(text) // ROW) * ROW)
    rows = np.frombuffer(text.ljust(size), np.uint8).reshape(-1, ROW // 3, 3)
    return write_pages([rows[y : y + PAGE_ROWS] for y in range(0, len(rows), PAGE_ROWS)])


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_pages int"
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        rows = []
        for text in texts:
            media = text_image(text or b"")
            pages = list(read_pages(media))
            payload = b"".join(p.pixels for p in pages)
            levels = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
            rows.append(
                {
                    "n_bytes": len(text or b""),
                    "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-16:]),
                    "media_bytes": len(media),
                    "media_sha256": hashlib.sha256(media).hexdigest(),
                    "feature": f"{pages[0].width}x{sum(p.height for p in pages)}x{pages[0].samples}:" + "-".join(map(str, levels)),
                    "n_pages": len(pages),
                }
            )
        table = pa.RecordBatch.from_pylist(rows) if rows else None
        if table is not None:
            table = table.set_column(table.schema.get_field_index("n_pages"), "n_pages", table.column("n_pages").cast(pa.int32()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{n: table.column(n) for n in table.schema.names}})


def text_media(docs: DataFrame) -> DataFrame:
    """Every text as a TIFF file, read back: digests of payload and file, levels of the samples.

    NULL counts as empty; an empty text is one row of blanks.
    """
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(_digest, DIGEST)
