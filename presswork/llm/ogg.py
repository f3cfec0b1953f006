"""Media columns: Ogg streams, written and read.

The writer cuts payloads into packets, packets into pages by lacing values and seals each page
with Ogg's checksum; the reader verifies every page, reassembles packets over page borders,
separates the logical streams by serial number and turns granule positions into times.

Defined results of store_texts: a null text is empty; the payload of an empty text is 64 zero
bytes; equal texts give equal values, whatever their id; repeated rows are reported each; an
empty table gives no row; columns other than id and text are not read.
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

#: Samples (bytes) a packet of the sample stream holds, and packets that a page ends after.
PACKET = 4096
PAGE_PACKETS = 8
RATE = 8000
SAMPLES, NOTES = 1, 2

#: Each byte with its bits in reverse order.
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 0x04C11DB7, most significant bit first, from 0, not inverted.

    zlib's runs the same polynomial least significant bit first and inverts at both ends, so it
    gives Ogg's, mirrored and inverted, over mirrored bytes.
    """
    value = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{value:032b}"[::-1], 2)


def pages_of(serial: int, packets: list[bytes], granules: list[int], per_page: int = PAGE_PACKETS) -> Iterator[bytes]:
    """The pages of one logical stream; granules: the position after each packet."""
    lacing: list[tuple[int, bytes, int]] = []  # (value, bytes, granule once the packet ends here else -1)
    for packet, granule in zip(packets, granules, strict=True):
        whole, rest = divmod(len(packet), 255)
        lacing += [(255, packet[i * 255 : i * 255 + 255], -1) for i in range(whole)]
        lacing.append((rest, packet[whole * 255 :], granule))
    sequence, at, open_packet = 0, 0, False
    while at < len(lacing) or not sequence:
        taken, ended = [], 0
        while at < len(lacing) and len(taken) < 255 and ended < per_page:
            taken.append(lacing[at])
            ended += lacing[at][2] >= 0
            at += 1
        flags = open_packet * 1 | (sequence == 0) * 2 | (at >= len(lacing)) * 4
        granule = max((g for _, _, g in taken), default=0)  # -1 where no packet ends on the page
        head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, sequence, 0) + bytes([len(taken)]) + bytes(v for v, _, _ in taken)
        page = head + b"".join(d for _, d, _ in taken)
        yield page[:22] + struct.pack("<I", page_crc(page)) + page[26:]
        open_packet = bool(taken) and taken[-1][2] < 0
        sequence += 1


def encode(payload: bytes) -> bytes:
    """A physical stream of two logical ones: 8-bit samples, and notes that describe them."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min(len(payload), i + PACKET) for i in range(0, len(payload), PACKET)]
    head = struct.pack("<8sII", b"pcm-u8\0\0", RATE, 1)
    samples = list(pages_of(SAMPLES, [head, *packets], [0, *ends]))
    notes = list(pages_of(NOTES, [struct.pack("<8sQ", b"notes\0\0\0", len(payload)), zlib.crc32(payload).to_bytes(4, "little")], [0, len(payload)]))
    # beginnings of all streams come first, then the pages in order of time
    return samples[0] + notes[0] + b"".join(samples[1:]) + b"".join(notes[1:])


@dataclass
class Logical:
    """One logical stream: packets, their end times where known, and what its pages showed."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    bad_pages: int = 0
    gaps: int = 0
    begun: bool = False
    ended: bool = False

    def seconds(self, rate: int) -> list[float | None]:
        """End time of each packet; none where its page carries no position for it."""
        return [g / rate if g >= 0 else None for g in self.granules]


def decode(data: bytes) -> dict[int, Logical]:
    """Logical streams by serial. A page that fails its checksum is dropped and counted, and a packet
    that it cuts is dropped too; bytes between pages are passed over."""
    found: dict[int, Logical] = {}
    parts: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    at = data.find(b"OggS")
    while 0 <= at <= len(data) - 27:
        _, version, flags, granule, serial, sequence, crc, count = struct.unpack_from("<4sBBqIIIB", data, at)
        table = data[at + 27 : at + 27 + count]
        size = 27 + count + sum(table)
        page = data[at : at + size]
        stream = found.setdefault(serial, Logical(serial)) if version == 0 and len(page) == size else None
        if stream is None or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            if stream is not None:
                stream.bad_pages += 1
                parts.pop(serial, None)
            at = data.find(b"OggS", at + 4)
            continue
        if sequence != expected.get(serial, 0):
            stream.gaps += 1
            parts.pop(serial, None)
        expected[serial] = sequence + 1
        stream.pages += 1
        stream.begun |= bool(flags & 2)
        stream.ended |= bool(flags & 4)
        held = parts.pop(serial, None) if flags & 1 else []
        body, ends = 27 + count, []
        for value in table:
            if held is not None:
                held.append(page[body : body + value])
            body += value
            if value < 255:
                if held is not None:
                    ends.append(b"".join(held))
                held = []
        stream.packets += ends
        stream.granules += [-1] * (len(ends) - 1) + [granule] * bool(ends)
        if table and table[-1] == 255 and held is not None:
            parts[serial] = held
        at = data.find(b"OggS", at + size)
    return found


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % 64 or (0 if data else 64))


def described(text: str | None) -> tuple:
    """What store_texts says of a text, all of it from the bytes read back."""
    n_bytes = len((text or "").encode("utf-8", "surrogatepass"))
    media = encode(payload_of(text))
    streams = decode(media)
    samples, notes = streams[SAMPLES], streams[NOTES]
    read = b"".join(samples.packets[1:])
    rate = struct.unpack_from("<I", samples.packets[0], 8)[0]
    ends = [s for s in samples.seconds(rate) if s is not None]
    intact = not any(s.bad_pages or s.gaps for s in streams.values()) and zlib.crc32(read) == int.from_bytes(notes.packets[1], "little")
    feature = f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={len(samples.packets) + len(notes.packets)};rate={rate};end={ends[-1]:.6f};mean={sum(read) / len(read):.6f};peak={max(read)};intact={int(intact)}"
    return n_bytes, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, media


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and media if kept."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    width = len(names) - (not keep_media)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [described(t.as_py())[:width] for t in part.column(1)]
                columns = [pa.array([x[i] for x in out], kinds[i]) for i in range(width)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names[:width]])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rows, schema)
