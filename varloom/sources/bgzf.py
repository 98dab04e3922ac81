"""Block-compressed gzip: members of at most 64 KiB that name their own size, so a file can be read from many places."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

#: Bytes of text in a member, and the most that a member may take.
MEMBER, LARGEST = 65_280, 1 << 16
#: How a member begins: gzip, deflate, with extra fields.
MAGIC = b"\x1f\x8b\x08\x04"
#: The empty member that ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def member(data: bytes, level: int = 6) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    if len(body) + 26 > LARGEST:  # what cannot be compressed is stored
        deflate = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = deflate.compress(data) + deflate.flush()
    head = MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def compressed(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Members of a stream of bytes, and the one that ends the file."""
    held = b""
    for chunk in chunks:
        held += chunk
        while len(held) >= MEMBER:
            yield member(held[:MEMBER])
            held = held[MEMBER:]
    if held:
        yield member(held)
    yield END


def size_of(head: bytes) -> int:
    """Bytes of the member that begins with `head`; 0 if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        kind, length = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and length == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    return 0


def text_of(raw: bytes) -> bytes:
    """The bytes of a whole member; raises if it is damaged."""
    skip = 12 + struct.unpack_from("<H", raw, 10)[0]
    data = zlib.decompress(raw[skip:-8], -15)
    if struct.unpack("<II", raw[-8:]) != (zlib.crc32(data), len(data)):
        raise ValueError("a member's checksum is wrong")
    return data


def first_member(file, start: int) -> int | None:
    """Offset of the first member at or behind `start`: a magic that is followed by a whole, sound member; None at the end."""
    while True:
        file.seek(start)
        raw = file.read(2 * LARGEST)
        at = raw.find(MAGIC)
        while 0 <= at < LARGEST:
            size = size_of(raw[at : at + 64])
            if size and at + size <= len(raw):
                try:
                    text_of(raw[at : at + size])
                    return start + at
                except (ValueError, zlib.error, struct.error):
                    pass
            at = raw.find(MAGIC, at + 1)
        if len(raw) < 2 * LARGEST:
            return None
        start += LARGEST


def members(file, start: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each member from `start` on."""
    file.seek(start)
    raw, at = b"", start
    while True:
        while len(raw) < LARGEST:
            more = file.read(16 * LARGEST)
            if not more:
                break
            raw += more
        if not raw:
            return
        size = size_of(raw[:64])
        if not size or size > len(raw):
            raise ValueError(f"no whole member at {at}")
        yield at, text_of(raw[:size])
        raw, at = raw[size:], at + size
