"""WARC/1.1 records: one gzip member each, written to and read from byte streams."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

# Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "https://iipc.github.io/warc-specifications/")
_CHUNK = 1 << 20


def record_id(*parts) -> str:
    """The same URN for the same parts."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '/'.join(map(str, parts)))}>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(labelled: str | None) -> str | None:
    """Lower-case hex of a labelled base-32 SHA-1."""
    return base64.b32decode(labelled.removeprefix("sha1:")).hex() if labelled else None


def target_uri(url: str) -> str:
    """A URL whose characters that no URI holds are percent-encoded."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def http_head(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


def member(fields: list[tuple[str, object]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member without a time stamp; length and digest of the block are told anew."""
    named = [*fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", len(block))]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v is not None) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def info(name: str, date: str) -> bytes:
    """The record that opens a file."""
    block = b"format: WARC File Format 1.1\r\nconformsTo: https://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def page(row_id: int | None, number: int, url: str | None, payload_digest: str, n_bytes: int, payload: bytes | None, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit (no payload) of the response of row ``refers_to``."""
    own = [("WARC-Record-ID", record_id(row_id, payload_digest, number)), ("WARC-Date", date), ("WARC-Target-URI", target_uri(url) if url else None), ("X-Row-Id", row_id)]
    if payload is not None:
        return member([("WARC-Type", "response"), *own, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload))], http_head(n_bytes) + payload)
    told = "sha1:" + base64.b32encode(bytes.fromhex(payload_digest)).decode()
    more = [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(refers_to, payload_digest, 0)), ("X-Refers-To-Row-Id", refers_to), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", told)]
    return member([("WARC-Type", "revisit"), *own, *more], http_head(n_bytes))


def members(stream) -> Iterator[bytes]:
    """Contents of a file's gzip members; memory holds one."""
    rest, unpacker, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(_CHUNK)
        if not data:
            if parts:
                raise EOFError("a record of the archive is cut off")
            return
        parts.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields by lower-case name, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def http_body(block: bytes) -> tuple[int | None, bytes]:
    """The length that an HTTP head states, and what follows the head."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value), body
    return None, body
