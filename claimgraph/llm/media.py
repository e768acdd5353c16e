"""Operator 8: TIFF columns. Walks image directories, decodes strips and tiles, one row per page.

Reads little- and big-endian files with 8-bit samples: no compression, PackBits, LZW or deflate; strips or
tiles; chunky or planar samples; no predictor or horizontal differencing. ``write_tiff`` stores
bytes losslessly in such files.

Cases: a null or broken file gives one row with page 0, null samples and the error; a
file with several directories gives a row for each, in order; repeated rows give repeated rows; an
empty table gives no rows; other columns are ignored. A null text is stored as 64 zero bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Fixed values of the TIFF 6.0 format: bytes per value of each field type; tag numbers.
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 322, 323, 324, 325

ROW = 64
PAGE_ROWS, STRIP_ROWS, TILE = 4096, 512, 64
#: Most samples of a page that are read: a file that claims more is taken as broken before any memory is asked for.
MOST_SAMPLES = 1 << 30


def unpack_bits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i += 2 + k
        else:
            if k > 128:
                out.append(data[i + 1 : i + 2] * (257 - k))
            i += 2 if k > 128 else 1
    return b"".join(out)


_RUNS = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(data: bytes) -> bytes:
    out, at = [], 0

    def plain(low: int, high: int) -> None:
        for i in range(low, high, 128):
            piece = data[i : min(high, i + 128)]
            out.append(bytes([len(piece) - 1]) + piece)

    for run in _RUNS.finditer(data):
        plain(at, run.start())
        out.append(bytes([257 - len(run[0])]) + run[1])
        at = run.end()
    plain(at, len(data))
    return b"".join(out)


def lzw_decode(data: bytes, expected: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; widths grow one code early, as TIFF has it."""
    out, size = [], 0
    table: list[bytes] = []
    bits = have = at = 0
    width, last = 9, None
    while size < expected:
        while have < width:
            if at >= len(data):
                return b"".join(out)
            bits = (bits << 8) | data[at]
            at += 1
            have += 8
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table = [bytes([k]) for k in range(256)] + [b"", b""]
            width, last = 9, None
            continue
        if last is None:
            piece = table[code]
        else:
            piece = table[code] if code < len(table) else last + last[:1]
            table.append(last + piece[:1])
        out.append(piece)
        size += len(piece)
        last = piece
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes as ``lzw_decode`` reads them; bits go out as they come, so time and memory grow with the data."""
    out = bytearray()
    bits, have = 256, 9  # the stream starts with a clear code
    table: dict[int, int] = {}  # (code of what is held, next byte) -> code
    nxt, width, held = 258, 9, -1
    for byte in data:
        if held < 0:
            held = byte
            continue
        key = held << 8 | byte
        code = table.get(key)
        if code is not None:
            held = code
            continue
        bits, have = bits << width | held, have + width
        table[key] = nxt
        nxt += 1
        if nxt == 4094:
            bits, have = bits << width | 256, have + width
            table.clear()
            nxt, width = 258, 9
        elif nxt >= (1 << width):
            width += 1
        held = byte
        if have >= 512:
            rest = have % 8
            out += (bits >> rest).to_bytes(have // 8, "big")
            bits, have = bits & ((1 << rest) - 1), rest
    if held >= 0:
        bits, have = bits << width | held, have + width
        nxt += 1
        if nxt >= (1 << width) and width < 12:
            width += 1
    bits, have = bits << width | 257, have + width
    pad = -have % 8
    return bytes(out) + (bits << pad).to_bytes((have + pad) // 8, "big")


def decompress(kind: int, data: bytes, expected: int) -> bytes:
    """A block's bytes; of what unpacks to more than expected, only that much is made."""
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return unpack_bits(data)
    if kind == LZW:
        return lzw_decode(data, expected)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, expected)
    raise ValueError(f"compression {kind} isn't known")


def compress(kind: int, data: bytes) -> bytes:
    return {NONE: lambda d: d, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1)}[kind](data)


@dataclass
class Page:
    page: int
    width: int
    height: int
    channels: int
    compression: int
    tiled: bool
    predictor: int
    samples: bytes


def _directory(file: bytes, at: int, end: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(end + "H", file, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(end + "HHI", file, at + 2 + 12 * i)
        size = FIELD_BYTES.get(kind, 0) * count
        place = at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(end + "I", file, place)
        if kind in (1, 3, 4) and place + size <= len(file):
            fields[tag] = list(struct.unpack_from(f"{end}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", file, place))
    (following,) = struct.unpack_from(end + "I", file, at + 2 + 12 * n)
    return fields, following


def read_tiff(file: bytes) -> Iterator[Page]:
    """All pages of a file, each as its samples row by row, channels interleaved."""
    end = {b"II": "<", b"MM": ">"}.get(file[:2])
    if end is None or struct.unpack_from(end + "H", file, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(end + "I", file, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        f, following = _directory(file, at, end)
        width, height = f[WIDTH][0], f[HEIGHT][0]
        channels, kind, predictor = f.get(SAMPLES, [1])[0], f.get(COMPRESSION, [1])[0], f.get(PREDICTOR, [1])[0]
        planes, tiled = f.get(PLANAR, [1])[0] == 2, TILE_AT in f
        if any(b != 8 for b in f.get(BITS, [1])):
            raise ValueError("samples don't have 8 bits")
        block_w, block_h = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (width, min(height, f.get(ROWS_PER_STRIP, [height])[0]))
        if min(width, height, channels, block_w, block_h) < 1 or max(width * height, block_w * block_h) * channels > MOST_SAMPLES:
            raise ValueError("a page of no or too many samples")
        offsets, sizes = (f[TILE_AT], f[TILE_BYTES]) if tiled else (f[STRIP_AT], f[STRIP_BYTES])
        across, down = -(-width // block_w), -(-height // block_h)
        image = np.zeros((height, width, channels), np.uint8)
        deep = 1 if planes else channels
        for k, (place, size) in enumerate(zip(offsets, sizes)):
            plane, k = divmod(k, across * down)
            if plane * deep >= channels:
                raise ValueError("more blocks than the page has")
            y, x = k // across * block_h, k % across * block_w
            rows = block_h if tiled else min(block_h, height - y)
            raw = decompress(kind, file[place : place + size], rows * block_w * deep)
            block = np.frombuffer(raw, np.uint8, rows * block_w * deep).reshape(rows, block_w, deep)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            elif predictor != 1:
                raise ValueError(f"predictor {predictor} isn't known")
            part = image[y : y + rows, x : x + block_w]
            part[..., plane : plane + deep] = block[: part.shape[0], : part.shape[1]]
        yield Page(len(seen) - 1, width, height, channels, kind, tiled, predictor, image.tobytes())
        at = following


def write_tiff(payload: bytes, kind: int, tiled: bool = False, predictor: int = 1) -> bytes:
    """Stores a payload (a positive multiple of 64 bytes) as pages of 64 samples a row."""
    out = [struct.pack("<2sHI", b"II", 42, 8)]
    at = 8
    pages = range(0, len(payload), ROW * PAGE_ROWS)
    for low in pages:
        image = np.frombuffer(payload[low : low + ROW * PAGE_ROWS], np.uint8).reshape(-1, ROW)
        height = len(image)
        block_h = TILE if tiled else STRIP_ROWS
        parts = []
        for y in range(0, height, block_h):
            block = image[y : y + block_h]
            if tiled and len(block) < TILE:
                block = np.vstack([block, np.zeros((TILE - len(block), ROW), np.uint8)])
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            parts.append(compress(kind, block.tobytes()))
        fields = [(WIDTH, 4, [ROW]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [kind]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [ROW]), (TILE_HEIGHT, 4, [TILE])] if tiled else [(ROWS_PER_STRIP, 4, [STRIP_ROWS])]
        head = 2 + 12 * (len(fields) + 2) + 4
        lists = 8 * len(parts) if len(parts) > 1 else 0
        data_at = at + head + lists
        places = [data_at + sum(map(len, parts[:i])) for i in range(len(parts))] if len(parts) < 64 else list(data_at + np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]))
        fields += [(TILE_AT if tiled else STRIP_AT, 4, [int(p) for p in places]), (TILE_BYTES if tiled else STRIP_BYTES, 4, [len(p) for p in parts])]
        after = data_at + sum(map(len, parts))
        after += after % 2
        table, extra = [], b""
        for tag, form, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{'HI'[form == 4]}", *values)
            if len(packed) > 4:
                place = at + head + len(extra)
                extra += packed
                packed = struct.pack("<I", place)
            table.append(struct.pack("<HHI", tag, form, len(values)) + packed.ljust(4, b"\0"))
        last = low == pages[-1]
        page = struct.pack("<H", len(fields)) + b"".join(table) + struct.pack("<I", 0 if last else after) + extra + b"".join(parts)
        out.append(page.ljust(after - at, b"\0"))
        at = after
    return b"".join(out)


def store(payload: bytes) -> bytes:
    """The stored form of a payload, chosen by its content alone, whatever its size: equal payloads are stored alike."""
    mark = zlib.crc32(payload) % 6
    if mark == 0:
        return write_tiff(payload, LZW, tiled=payload[0] % 2 == 1, predictor=1 + payload[-1] % 2)
    if mark < 3:
        return write_tiff(payload, DEFLATE)
    if mark < 5:
        return write_tiff(payload, DEFLATE, tiled=True, predictor=2)
    return write_tiff(payload, PACKBITS, predictor=1)


def payload_of(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b"\0")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the text's TIFF file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
                media = pa.array([store(payload_of(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PAGE_SCHEMA = "page int, width int, height int, channels int, compression int, tiled boolean, predictor int, samples binary, error string"


def tiff_pages(files: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of each file, in order, behind the row's other columns; ``samples`` has the decoded bytes.

    Columns of the pages' own names are replaced.
    """
    own_names = [f.split()[0] for f in PAGE_SCHEMA.split(", ")]
    keep = [c for c in files.columns if c != column and c not in own_names]
    at = files.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                rows, pages = [], []
                for i, file in enumerate(batch.column(at).to_pylist()):
                    try:
                        found = [(p.page, p.width, p.height, p.channels, p.compression, p.tiled, p.predictor, p.samples, None) for p in read_tiff(file or b"")]
                    except (ValueError, KeyError, IndexError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
                        found = [(0, None, None, None, None, None, None, None, str(e) or type(e).__name__)]
                    rows += [i] * len(found)
                    pages += found
                kinds = [pa.int32()] * 5 + [pa.bool_(), pa.int32(), pa.binary(), pa.string()]
                columns = [pa.array(v, t) for v, t in zip(zip(*pages), kinds)] if pages else [pa.array([], t) for t in kinds]
                taken = batch.select(keep).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, *columns], [*keep, *own_names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name in keep)
    return files.mapInArrow(run, f"{own}, {PAGE_SCHEMA}")


def feature(samples: np.ndarray, pages: int) -> str:
    """Pages, mean and spread of the samples, their distinct values and the entropy of their histogram."""
    counts = np.bincount(samples, minlength=256)
    n = len(samples)
    values = np.arange(256)
    mean = int(counts @ values) / n
    spread = max(0.0, int(counts @ (values * values)) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    return f"pages={pages};mean={mean:.4f};std={spread:.4f};distinct={len(p)};entropy={abs(float(-(p * np.log2(p)).sum())):.4f}"


def digests(pages: DataFrame) -> DataFrame:
    """Per document: sizes, hashes and features of what its pages hold.

    ``pages`` has media_bytes and media_sha256 too; a document's pages follow each other in a partition, as
    ``tiff_pages`` emits them, so they are put together in the stream, and nothing is shuffled. A file with an error (broken,
    empty or null) keeps its sizes and hash; its payload columns are null and ``feature`` tells the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        held: list[dict] = []

        def close() -> tuple:
            first = held[0]
            broken = next((p.get("error") or "no samples" for p in held if p["samples"] is None), None)
            if broken is not None:
                return (first["doc_id"], first["n_bytes"], None, None, None, first["media_bytes"], first["media_sha256"], f"error={broken}")
            data = b"".join(p["samples"] for p in held)
            return (first["doc_id"], first["n_bytes"], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), first["media_bytes"], first["media_sha256"], feature(np.frombuffer(data, np.uint8), len(held)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if held and row["page"] == 0:
                    rows.append(close())
                    held.clear()
                held.append(row)
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of([close()])

    return pages.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_tiff(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    stored = store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return digests(tiff_pages(stored).select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "samples", "error"))
