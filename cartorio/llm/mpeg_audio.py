"""Media columns of MPEG audio: parsing of streams, and bytes carried in frames.

``parse`` walks a stream: it skips an ID3v2 tag and reads its text frames, finds frame headers again after
foreign bytes, reads the Xing/Info table of a variable-bitrate stream, verifies the CRC of protected Layer III
frames, and gives the exact number of samples and the byte offset of every frame. ``carry`` builds a stream
whose frames hold a payload as ancillary data, 576 bytes in the 576 samples of each MPEG-2 Layer III frame;
players take it for silence. ``media_of`` and ``features_of`` do both on columns.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartorio.llm.shared import small_batches

# Fixed values of the format: kbit/s by version group and layer, Hz by version, samples by layer.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {0: 2.5, 2: 2.0, 3: 1.0}

BLOCK = 576
#: MPEG-2 Layer III, CRC present, 144 kbit/s, 16 kHz, mono: 648 bytes of which 15 come before the main data.
HEADER = bytes((0xFF, 0xF2, 0xD8, 0xC0))
SIDE = bytes(9)
FRAME = 648


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    rate: int
    samples: int
    length: int
    protected: bool
    side: int


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005 from 0xFFFF, as frames carry it."""
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005) & 0xFFFF if value & 0x8000 else value << 1
    return value


def header_of(four: bytes) -> Header | None:
    """The header in four bytes, or None. Free-format frames have no length of their own and are not taken."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    kbits, rate, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version is None or layer == 4 or kbits in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbit, hertz = KBITS[1 if version == 1.0 else 2, layer][kbits], RATES[version][rate]
    mono = four[3] >> 6 == 3
    if layer == 1:
        samples, length = 384, (12000 * kbit // hertz + pad) * 4
    else:
        samples = 1152 if layer == 2 or version == 1.0 else 576
        length = samples // 8 * 1000 * kbit // hertz + pad
    side = 0 if layer < 3 else (17 if mono else 32) if version == 1.0 else (9 if mono else 17)
    return Header(version, layer, hertz, samples, length, not four[1] & 1, side)


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    table: dict | None = None
    crc_checked: int = 0
    crc_wrong: int = 0
    lost: int = 0
    version: float = 0.0
    layer: int = 0

    @property
    def milliseconds(self) -> float:
        return 1000 * self.samples / self.rate if self.rate else 0.0


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a leading ID3v2.3/2.4 tag, and where it ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    plain = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, found = min(len(data), 10 + plain(data[6:10])), 10, {}
    while at + 10 <= end and data[at]:
        name, size = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
        size = plain(size) if data[3] >= 4 else int.from_bytes(size, "big")
        body = data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else ("", "", text)
            found[f"{name}:{key}" if key else name] = value
        at += 10 + size
    return found, end


def _xing(data: bytes, at: int, head: Header) -> dict | None:
    """Xing or Info table of the frame at ``at``."""
    begin = at + 4 + (2 if head.protected else 0) + head.side
    for place in (begin, at + 4 + head.side):
        if data[place : place + 4] in (b"Xing", b"Info"):
            flags, place, found = int.from_bytes(data[place + 4 : place + 8], "big"), place + 8, {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    found[name], place = int.from_bytes(data[place : place + 4], "big"), place + 4
            if flags & 4:
                found["seek"] = data[place : place + 100]
            return found
    return None


def parse(data: bytes) -> Stream:
    """What a stream holds. Foreign bytes, also between frames, are counted as lost; a cut last frame too.

    'TAG' 128 bytes before the end is an ID3v1 tag where a frame ends or where the byte count of the Xing table is
    passed; without such a count, in foreign bytes too, but not in a frame that another one or the end follows.
    """
    out = Stream()
    out.tags, at = _tags(data)
    end = len(data)
    tail = end - 128 if data[-128:-125] == b"TAG" and end - 128 >= at else -1
    counted = False  # the table says that frames go on behind ``tail``
    known: dict[bytes, Header | None] = {}
    sums: dict[bytes, int] = {}
    kind, synced = None, False

    def head_at(place: int) -> Header | None:
        four = data[place : place + 4]
        if four not in known:
            known[four] = header_of(four)
        return known[four]

    while at + 4 <= end:
        head = head_at(at)
        good = head is not None and at + head.length <= end and (kind is None or (head.version, head.layer, head.rate) == kind)
        if good:
            after = at + head.length
            across = at < tail < after <= end and not counted
            if across or not synced and after + 4 <= end and not tail - 4 < after <= tail:
                follows = head_at(after)
                good = across and after == end or follows is not None and (follows.version, follows.layer, follows.rate) == (head.version, head.layer, head.rate)
        if not good:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            if at <= tail < step and (not counted or synced and at == tail):
                step = end = tail
            out.lost += step - at
            at, synced = step, False
            continue
        synced, first = True, kind is None
        kind = (head.version, head.layer, head.rate)
        if first and head.layer == 3:
            out.table = _xing(data, at, head)
            size = (out.table or {}).get("bytes", 0)
            counted = at + size > tail
            if 0 < size <= tail - at:
                end = tail
        if not (first and out.table is not None):
            out.offsets.append(at)
            out.starts.append(at + 4 + (2 if head.protected else 0) + head.side)
            out.samples += head.samples
            if head.protected and head.layer == 3:
                covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + head.side]
                if covered not in sums:
                    sums[covered] = crc16(covered)
                out.crc_checked += 1
                out.crc_wrong += int.from_bytes(data[at + 4 : at + 6], "big") != sums[covered]
        at += head.length
    out.lost += max(0, end - at)
    if end < len(data):
        out.tags.setdefault("TIT2", data[-125:-95].decode("latin-1").rstrip("\0 "))
    if kind:
        out.version, out.layer, out.rate = kind
    return out


_PREFIX = HEADER + crc16(HEADER[2:] + SIDE).to_bytes(2, "big") + SIDE
_FILL = bytes(FRAME - len(_PREFIX) - BLOCK)


def _text_frame(name: str, text: str) -> bytes:
    body = b"\0" + text.encode("latin-1")
    return name.encode() + struct.pack(">IH", len(body), 0) + body


def padded(data: bytes) -> bytes:
    """The data and bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def carry(payload: bytes, size: int) -> bytes:
    """A stream that holds ``payload`` (a positive multiple of 576), with ``size`` of its bytes meant, as a tag."""
    frames = len(payload) // BLOCK
    text = _text_frame("TLEN", str(36 * frames)) + _text_frame("TXXX", f"bytes\0{size}")
    tag = b"ID3\x03\0\0" + bytes(len(text) >> s & 127 for s in (21, 14, 7, 0)) + text
    total = FRAME * (frames + 1)
    seek = bytes(min(255, 256 * FRAME * (1 + i * frames // 100) // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, frames, total) + seek
    first = (_PREFIX + table).ljust(FRAME, b"\0")
    return tag + first + b"".join([_PREFIX + payload[i : i + BLOCK] + _FILL for i in range(0, len(payload), BLOCK)])


def payload_of(data: bytes, stream: Stream) -> bytes:
    return b"".join([data[s : s + BLOCK] for s in stream.starts])


def media_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and ``media``: the UTF-8 bytes of every whole text in a stream. Null text: empty. Other columns are dropped; empty tables give empty ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            data = [(t or "").encode() for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([carry(padded(d), len(d)) for d in data], pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", text).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


FEATURES = [
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ("feature", pa.string()), ("n_frames", pa.int64()), ("n_samples", pa.int64()), ("sample_rate", pa.int64()), ("crc_wrong", pa.int64()), ("lost_bytes", pa.int64()), ("frame_offsets", pa.list_(pa.int64())),
]


def features_of(media: DataFrame) -> DataFrame:
    """doc_id and what the stored stream of every row (doc_id, media) holds, frame offsets included.

    n_bytes is read from its tag (null without one). Null media: zeros, no frames.
    """

    def row(data: bytes) -> tuple:
        stream = parse(data)
        payload = payload_of(data, stream)
        table = stream.table or {}
        offsets = struct.pack(f"<{len(stream.offsets)}Q", *stream.offsets)
        feature = (
            f"mpeg{stream.version:g} layer{stream.layer} {stream.rate}Hz frames={len(stream.offsets)} samples={stream.samples} ms={stream.milliseconds:.3f} "
            f"table={table.get('frames', -1)}/{table.get('bytes', -1)} crc={stream.crc_checked - stream.crc_wrong}/{stream.crc_checked} lost={stream.lost} seek={zlib.crc32(offsets):08x}"
        )
        size = stream.tags.get("TXXX:bytes")
        return (
            None if size is None else int(size), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(),
            feature, len(stream.offsets), stream.samples, stream.rate, stream.crc_wrong, stream.lost, stream.offsets,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media"):
            columns = list(zip(*(row(m or b"") for m in batch.column("media").to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, (_, t) in zip(columns, FEATURES))], ["doc_id", *(n for n, _ in FEATURES)])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return media.select("doc_id", F.col("media")).mapInArrow(work, ", ".join([f"doc_id {media.schema['doc_id'].dataType.simpleString()}", *(f"{n} {kinds[t]}" for n, t in FEATURES)]))
