"""Media columns: baseline JPEG parsed and decoded to DC-only luminance thumbnails in numpy.

The decoder reads any baseline sequential JPEG with 8-bit samples (SOF0, one scan, up to
four components, any sampling factors, with or without restart intervals). All restart
intervals of a batch of images are decoded in lock step: every step takes one Huffman
symbol of each of them. A thumbnail has one sample per 8x8 block of the first component:
the block's mean, which is its DC coefficient times the quantiser, over 8, plus 128.

``store`` does the reverse for arbitrary bytes: every byte becomes the DC coefficient of
one block of a grey image 24 blocks wide, with one restart interval a row of blocks, so
the thumbnail of the stored file holds the very bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_blocks, small_batches, texts

#: Blocks of a row, and payload bytes come in multiples of this squared.
WIDE = 24
UNIT = WIDE * WIDE
#: Fixed values of the format: marker codes.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE
#: Images have at most this many rows of blocks (the format's height is 16 bits); longer payloads take several frames.
MOST_ROWS = 8191


class JpegError(ValueError):
    """The bytes are no baseline JPEG that this module reads."""


@dataclass
class Component:
    number: int
    h: int
    v: int
    quantiser: int
    dc: int = 0
    ac: int = 0


@dataclass
class Header:
    width: int = 0
    height: int = 0
    interval: int = 0
    components: list[Component] = field(default_factory=list)
    scan: list[Component] = field(default_factory=list)
    quant: dict[int, int] = field(default_factory=dict)
    tables: dict[tuple[int, int], bytes] = field(default_factory=dict)
    start: int = 0


def parse(data: bytes, at: int = 0) -> Header:
    """Read the markers up to the scan that begins after SOS."""
    head = Header()
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at += 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("marker expected")
        code, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise JpegError("segment is cut off")
        if code == DQT:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                head.quant[n] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif code == DHT:
            while body:
                n = sum(body[1:17])
                head.tables[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                body = body[17 + n :]
        elif code == DRI:
            head.interval = int.from_bytes(body[:2], "big")
        elif code == SOF0:
            bits, head.height, head.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not head.height or not head.width or len(body) != 6 + 3 * n:
                raise JpegError("only 8-bit frames of known size are read")
            head.components = [Component(c, hv >> 4, hv & 15, q) for c, hv, q in zip(body[6::3], body[7::3], body[8::3], strict=True)]
        elif 0xC1 <= code <= 0xCF and code not in (0xC8, 0xCC):
            raise JpegError("not baseline")
        elif code == SOS:
            by = {c.number: c for c in head.components}
            for c, t in zip(body[1 : 1 + 2 * body[0] : 2], body[2 : 2 + 2 * body[0] : 2], strict=True):
                if c not in by:
                    raise JpegError("scan of an unknown component")
                by[c].dc, by[c].ac = t >> 4, t & 15
                head.scan.append(by[c])
            if len(head.scan) != len(head.components):
                raise JpegError("one interleaved scan is read")
            head.start = at + 2 + size
            return head
        at += 2 + size


def _lookup(spec: bytes) -> np.ndarray:
    """For every 16 bits: code length << 8 | symbol; 0 where no code fits. Canonical codes by length."""
    table, code, k = np.zeros(1 << 16, np.uint16), 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            low = code << (16 - length)
            table[low : low + (1 << (16 - length))] = length << 8 | spec[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


_tables: dict[bytes, np.ndarray] = {}


def _table(spec: bytes) -> np.ndarray:
    if spec not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[spec] = _lookup(spec)
    return _tables[spec]


def _pairs(dc: bytes, ac: bytes) -> np.ndarray:
    """For every 16 bits that hold a whole block without AC coefficients: its length << 16 | difference + 32768; else 0."""
    key = b"pair" + bytes([len(dc)]) + dc + ac
    if key in _tables:
        return _tables[key]
    first, second, window = _table(dc).astype(np.int64), _table(ac).astype(np.int64), np.arange(1 << 16)
    length, size = first >> 8, first & 255
    rest = (window << length) & 0xFFFF
    bits = np.where(size > 0, rest >> np.maximum(16 - size, 0), 0)
    diff = np.where((size > 0) & (bits >> np.maximum(size - 1, 0) == 0), bits - (1 << np.minimum(size, 20)) + 1, bits)
    used = length + size
    end = second[(window << np.minimum(used, 16)) & 0xFFFF]
    total = used + (end >> 8)
    fits = (length > 0) & (size <= 11) & (total <= 16) & (end > 0) & (end & 255 == 0)
    _tables[key] = np.where(fits, total << 16 | (diff + 32768), 0).astype(np.int32)
    return _tables[key]


def _unstuff(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The entropy-coded bytes without stuffing and markers, where intervals start in them, and how long the scan was."""
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[ff + 1]
    marker = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    end = int(marker[0]) if len(marker) else len(scan)
    ff, after = ff[ff < end], after[ff < end]
    keep = np.ones(end, bool)
    keep[ff + 1] = False
    rst = ff[after != 0]
    keep[rst] = False
    starts = np.concatenate([[0], rst - 2 * np.arange(len(rst)) - np.searchsorted(ff[after == 0], rst)])
    return scan[:end][keep], starts, end


def dc_planes(files: list[bytes]) -> list[list[tuple[Header, np.ndarray]]]:
    """Of each file, its frames with the DC values of the first component, one row per row of blocks.

    The intervals of all frames with the same tables and layout are decoded together.
    """
    frames: list[list[tuple[Header, np.ndarray]]] = [[] for _ in files]
    groups: dict[tuple, list] = {}
    for i, data in enumerate(files):
        view, at = np.frombuffer(data, np.uint8), 0
        while at < len(data):
            head = parse(data, at)
            end = data.find(b"\xff\xd9", head.start)
            scan, starts, size = _unstuff(view[head.start : end + 2 if end >= 0 else len(data)])
            at = head.start + size + 2
            frames[i].append((head, np.zeros(0)))
            most_h, most_v = max(c.h for c in head.scan), max(c.v for c in head.scan)
            if len(head.scan) == 1:
                across, down = -(-head.width // 8), -(-head.height // 8)
                order = [(0, 1)]
            else:
                across, down = -(-head.width // (8 * most_h)), -(-head.height // (8 * most_v))
                order = [(k, c.h * c.v) for k, c in enumerate(head.scan)]
            blocks = tuple(k for k, n in order for _ in range(n))
            try:
                specs = tuple((head.tables[0, c.dc], head.tables[1, c.ac]) for c in head.scan)
            except KeyError as e:
                raise JpegError("a Huffman table is missing") from e
            units = across * down
            step = head.interval or units
            if len(starts) < -(-units // step):
                raise JpegError("restart intervals are missing")
            groups.setdefault((specs, blocks), []).append((i, len(frames[i]) - 1, scan, starts[: -(-units // step)], units, step, across, down))
    for (specs, blocks), members in groups.items():
        _decode(specs, blocks, members, frames)
    return frames


def _decode(specs: tuple, blocks: tuple[int, ...], members: list, frames: list) -> None:
    base = np.cumsum([0, *(len(m[2]) + 4 for m in members)])
    data = np.zeros(base[-1] + 8, np.uint8)
    for b, m in zip(base, members, strict=False):
        data[b : b + len(m[2])] = m[2]
    # Four bytes from every offset, as one number: a window of 16 bits at any bit is then one shift.
    word = data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]
    bit = np.concatenate([(b + m[3]) * 8 for b, m in zip(base, members, strict=False)]).astype(np.int64)
    todo = np.concatenate([np.minimum(m[5], m[4] - np.arange(len(m[3])) * m[5]) for m in members])
    out_at = np.cumsum([0, *(m[4] for m in members)])
    place = np.concatenate([b + np.arange(len(m[3])) * m[5] for b, m in zip(out_at, members, strict=False)])
    wanted = sum(k == 0 for k in blocks)
    out = np.zeros((out_at[-1], wanted), np.int32)
    stop = len(word) * 8 - 64
    # Longest intervals first, so those still at work are a prefix.
    order = np.argsort(-todo, kind="stable")
    bit, todo, place = bit[order], todo[order], place[order]
    predicted = np.zeros((len(specs), len(bit)), np.int32)

    def peek(at: np.ndarray) -> np.ndarray:
        return (word[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF

    for unit in range(int(todo[0]) if len(todo) else 0):
        n = int(np.searchsorted(-todo, -unit, side="left"))
        own, seen = bit[:n], 0
        for k in blocks:
            pair = _pairs(*specs[k])[peek(own)]
            slow = np.flatnonzero(pair == 0)
            diff = (pair & 0xFFFF) - 32768
            own += pair >> 16
            if len(slow):
                diff[slow], own[slow] = _block(specs[k], own[slow], peek, stop)
            predicted[k, :n] += diff
            if k == 0:
                out[place[:n] + unit, seen] = predicted[0, :n]
                seen += 1
        if n and own.max() > stop + 64:
            raise JpegError("the scan ends too early")
    for m, b in zip(members, out_at, strict=False):
        i, j, _, _, units, _, across, down = m
        head = frames[i][j][0]
        c = head.scan[0]
        h, v = (1, 1) if len(head.scan) == 1 else (c.h, c.v)
        plane = out[b : b + units].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        frames[i][j] = (head, plane)


def _block(spec: tuple[bytes, bytes], at: np.ndarray, peek, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """A block symbol by symbol: DC difference, then AC runs to the end of block."""
    dc, ac = _table(spec[0]), _table(spec[1])
    at = at.copy()

    def symbol(table: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = table[peek(np.minimum(own, stop))].astype(np.int64)
        if not found.all() or (own > stop).any():
            raise JpegError("no such Huffman code")
        return found >> 8, found & 255

    length, size = symbol(dc, at)
    if (size > 11).any():
        raise JpegError("DC difference is too large")
    at += length
    bits = np.where(size > 0, peek(np.minimum(at, stop)).astype(np.int64) >> (16 - size), 0)
    at += size
    diff = np.where((size > 0) & (bits >> np.maximum(size - 1, 0) == 0), bits - (1 << size) + 1, bits)
    k, live = np.ones(len(at), np.int64), np.arange(len(at))
    while len(live):
        length, run = symbol(ac, at[live])
        at[live] += length + (run & 15)
        k[live] += np.where(run == 0, 64, np.where(run == 0xF0, 16, (run >> 4) + 1))
        live = live[k[live] < 64]
    return diff, at


def _thumbs(found: list[list[tuple[Header, np.ndarray]]]) -> list[list[np.ndarray]]:
    return [[np.clip((plane * head.quant[head.scan[0].quantiser] + 4) // 8 + 128, 0, 255).astype(np.uint8) for head, plane in frames] for frames in found]


def thumbnails(files: list[bytes]) -> list[list[np.ndarray]]:
    """Of each file, its frames' luminance thumbnails: one 8-bit sample per block."""
    return _thumbs(dc_planes(files))


# Fixed values of what is written: DC categories 0..8 and their code lengths (a complete set but for the all-ones code); AC has the end of block alone.
_DC_LENGTHS = {7: 2, 6: 2, 5: 3, 8: 3, 4: 4, 0: 5, 3: 5, 2: 6, 1: 7}


def _written_tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    symbols = sorted(_DC_LENGTHS, key=lambda s: (_DC_LENGTHS[s], s))
    counts = bytes(sum(v == n for v in _DC_LENGTHS.values()) for n in range(1, 17))
    code, last, codes = 0, 0, {}
    for s in symbols:
        code <<= _DC_LENGTHS[s] - last
        last, codes[s] = _DC_LENGTHS[s], code
        code += 1
    # A whole block by difference + 255: its bits (code, magnitude, one 0 for the end of block), left-aligned in 16, and how many.
    bits, length = np.zeros(511, np.uint16), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        value = codes[size] << size | (d if d >= 0 else d + (1 << size) - 1)
        length[d + 255] = _DC_LENGTHS[size] + size + 1
        bits[d + 255] = (value << 1) << (16 - int(length[d + 255]))
    tables = bytes([0x00]) + counts + bytes(symbols) + bytes([0x10]) + bytes([1]) + bytes(15) + bytes([0])
    return tables, bits, length


_TABLES, _BITS, _LENGTH = _written_tables()


def _segment(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def _frame_head(rows: int) -> bytes:
    return (
        b"\xff\xd8" + _segment(DQT, b"\x00" + bytes([8] * 64)) + _segment(SOF0, struct.pack(">BHHBBBB", 8, rows * 8, WIDE * 8, 1, 1, 0x11, 0))
        + _segment(DHT, _TABLES) + _segment(DRI, WIDE.to_bytes(2, "big")) + _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 576 bytes, as JPEG frames; one frame up to 196,584 bytes."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDE).astype(np.int16) - 128
    diff = np.diff(samples, axis=1, prepend=0) + 255
    length = _LENGTH[diff]
    used = length.sum(1, dtype=np.int64)
    pad = (-used) % 8
    # Bits of all blocks in order; the padding of a row is the top of an all-ones word.
    codes = np.concatenate([_BITS[diff], np.full((len(diff), 1), 0xFFFF, np.uint16)], 1)
    sizes = np.concatenate([length, pad[:, None].astype(np.uint8)], 1)
    row_bytes = (used + pad) // 8
    body = np.packbits(np.unpackbits(codes.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[np.arange(16, dtype=np.uint8) < sizes.reshape(-1, 1)])
    # Stuff a zero after each 0xFF and put a restart marker after each row but a frame's last.
    edge = np.concatenate([[0], row_bytes.cumsum()])
    out, row = [], 0
    for payload in payloads:
        rows, parts = len(payload) // WIDE, []
        for first in range(0, rows, MOST_ROWS):
            n = min(MOST_ROWS, rows - first)
            a = edge[row + first : row + first + n + 1]
            scan = body[a[0] : a[-1]]
            inner, full = a[1:-1] - a[0], np.flatnonzero(scan == 0xFF) + 1
            at = np.concatenate([full, np.repeat(inner, 2)])
            value = np.concatenate([np.zeros(len(full), np.uint8), np.stack([np.full(n - 1, 0xFF), 0xD0 + np.arange(n - 1) % 8], 1).reshape(-1).astype(np.uint8)])
            parts += [_frame_head(n), np.insert(scan, at, value).tobytes(), b"\xff\xd9"]
        out.append(b"".join(parts))
        row += rows
    return out


def payload_of(data: bytes) -> bytes:
    """The UTF-8 bytes, filled with 255 to a positive multiple of 576."""
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def _phash(plane: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 grid over the thumbnail are brighter than their median."""
    rows, cols = np.linspace(0, plane.shape[0], 9).astype(int), np.linspace(0, plane.shape[1], 9).astype(int)
    total = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), np.int64)
    total[1:, 1:] = plane.cumsum(0, dtype=np.int64).cumsum(1)
    r0, c0, r1, c1 = rows[:-1, None], cols[None, :-1], np.maximum(rows[1:], rows[:-1] + 1)[:, None], np.maximum(cols[1:], cols[:-1] + 1)[None, :]
    r1, c1 = np.minimum(r1, plane.shape[0]), np.minimum(c1, plane.shape[1])
    r0, c0 = np.minimum(r0, r1 - 1), np.minimum(c0, c1 - 1)
    mean = (total[r1, c1] - total[r0, c1] - total[r1, c0] + total[r0, c0]) / ((r1 - r0) * (c1 - c0))
    return np.packbits((mean > np.median(mean)).reshape(-1)).tobytes().hex()


def decode_column(media: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of JPEG files with width, height, frames, thumb_width, thumb_height, thumb_sha256, thumb_phash, error.

    The figures are the first frame's; the hash covers all frames' thumbnails. Null
    content and files that are no baseline JPEG get nulls and the reason in ``error``;
    no row is dropped. ``keep`` names further columns to carry.
    """
    kept = [media.schema[k] for k in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "width int, height int, frames int, thumb_width int, thumb_height int, thumb_sha256 string, thumb_phash string, error string"])

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7 + ("null",)
        try:
            found = dc_planes([data])[0]
            planes = _thumbs([found])[0]
        except (ValueError, IndexError, KeyError, struct.error) as e:
            return (None,) * 7 + (str(e) or "broken",)
        head, plane = found[0][0], planes[0]
        return (head.width, head.height, len(planes), plane.shape[1], plane.shape[0], hashlib.sha256(b"".join(p.tobytes() for p in planes)).hexdigest(), _phash(plane), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, content):
            rows = [one(x) for x in batch.column(content).to_pylist()]
            kinds = [pa.int32()] * 5 + [pa.string()] * 3
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *cols], names=[*keep, "width", "height", "frames", "thumb_width", "thumb_height", "thumb_sha256", "thumb_phash", "error"])

    return media.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, content])]).mapInArrow(run, schema)


def store_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Texts stored as JPEG and read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height[, media].

    Null is the empty text, which is stored as 576 bytes 255. ``payload_sha256`` and
    ``tail_crc32`` are of the bytes read back. ``feature`` is the thumbnail's 64-bit
    brightness pattern with the dimensions. Each row is worked on alone, in blocks of a
    few MB; a very long text takes several frames. Repeated rows have equal values;
    extra columns are ignored.
    """
    small_batches(documents.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", *["media"] * with_media]
    schema = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int" + ", media binary" * with_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text", 1 << 20):
            raw = texts(batch)
            media = store([payload_of(x) for x in raw])
            cols: list[list] = [[] for _ in names[1:]]
            found = dc_planes(media)
            for x, m, frames, planes in zip(raw, media, found, _thumbs(found), strict=True):
                back = b"".join(p.tobytes() for p in planes)
                plane = np.concatenate(planes)
                width, height = frames[0][0].width, sum(h.height for h, _ in frames)
                row = [len(x), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"{width}x{height}:{_phash(plane)}", width, height, *[m] * with_media]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * with_media]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
