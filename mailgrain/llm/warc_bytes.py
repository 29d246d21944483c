"""WARC records as gzip members, and reading them from byte ranges."""

from __future__ import annotations

import hashlib
import zlib

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
FIRST = b"WARC/1."


def opened(uri: str):
    """The file system and path of a URI, local or remote."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _safe(value: str) -> str:
    return "".join(c if c.isprintable() and c not in "\r\n" else f"%{ord(c):02X}" for c in value)


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One record as one gzip member. A revisit carries the response's HTTP header without the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        *([] if url is None else [f"WARC-Target-URI: {_safe(url)}"]),
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
    ]
    if revisit:
        lines += [
            f"WARC-Refers-To: <urn:x-page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def write(batches, folder: str, date: str):
    """Write the task's rows (page_id, url, html, refers_to) to one archive; yields (path, bytes, records).

    The file gets its name when it is whole, and the name depends on the partition only: a task that is run again
    replaces the file by the same one.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    context = TaskContext.get()
    name = f"part-{context.partitionId():06d}.warc.gz"
    system, root = opened(folder)
    draft, out, size, count = f"{root}/.{name}.{context.taskAttemptId()}", None, 0, 0
    for batch in batches:
        for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(draft, compression=None)
            member = record(page_id, url, (html or "").encode(), refers_to, date)
            out.write(member)
            size, count = size + len(member), count + 1
    if out is not None:
        out.close()
        system.move(draft, f"{root}/{name}")
        columns = [pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([count], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["path", "bytes", "records"])


class Bytes:
    """A file read forward in chunks from any place."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, place: int) -> bytes:
        """What is held from ``place`` on, at least one byte unless the file ends there."""
        if not self.start <= place < self.start + len(self.data):
            self.file.seek(place)
            self.start, self.data = place, self.file.read(min(CHUNK, max(0, self.size - place)))
        return self.data[place - self.start :]


def find_magic(source: Bytes, place: int, end: int) -> int:
    """The first place from ``place`` up to ``end`` where gzip magic stands, or -1."""
    held = b""
    while place < min(end + len(MAGIC) - 1, source.size):
        held_at, piece = place - len(held), held + source.at(place)
        hit = piece.find(MAGIC)
        if hit >= 0:
            return held_at + hit if held_at + hit < end else -1
        place += len(piece) - len(held)
        held = piece[-(len(MAGIC) - 1) :]
    return -1


def fields(head: bytes) -> dict[str, str] | None:
    """Header fields by lower-case name; None if this is no record header."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(FIRST):
        return None
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out if "content-length" in out and "warc-record-id" in out else None


def member(source: Bytes, place: int):
    """Decode the member at ``place``: (header fields, block, place after it), or None if it is no record."""
    unpacker, parts, head, first, last = zlib.decompressobj(31), [], None, b"", b""
    try:
        while not unpacker.eof:
            piece = source.at(place)
            if not piece:
                return None
            parts.append(unpacker.decompress(piece))
            place += len(piece) - len(unpacker.unused_data)
            if head is None:
                # However long the header is, its first bytes tell a candidate that is no record.
                first = (first + parts[-1])[: len(FIRST)]
                if not FIRST.startswith(first):
                    return None
                last += parts[-1]
                if b"\r\n\r\n" in last:
                    head = fields(b"".join(parts).partition(b"\r\n\r\n")[0])
                    if head is None:
                        return None
                last = last[-3:]
    except zlib.error:
        return None
    if head is None:
        return None
    whole = b"".join(parts)
    start = whole.index(b"\r\n\r\n") + 4
    length = int(head["content-length"]) if head["content-length"].isdigit() else -1
    if length < 0 or whole[start + length :] != b"\r\n\r\n":
        return None
    return head, whole[start : start + length], place


def records(source: Bytes, start: int, end: int):
    """All records that start in [start, end): (offset, header fields, block).

    The first is searched by its magic and tried by decoding; each next one starts where one ends. Where that fails,
    the search goes on behind it.
    """
    place = start
    while 0 <= (place := find_magic(source, place, end)) < end:
        found = member(source, place)
        if found is None:
            place += 1
            continue
        yield place, found[0], found[1]
        place = found[2]


def _page(name: str | None):
    text = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def read(batches):
    """Arrow batches (path, start, end, size) to the records that start in those ranges."""
    import pyarrow as pa

    names = ["path", "offset", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact", "payload"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for path, start, end, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            system, name = opened(path)
            rows, held = [], 0
            with system.open_input_file(name) as file:
                for offset, head, block in records(Bytes(file, size), start, end):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    said = head.get("warc-payload-digest", "").removeprefix("sha256:")
                    revisit = head.get("warc-type") == "revisit"
                    length = len(payload)
                    for line in http.split(b"\r\n"):
                        if line.lower().startswith(b"content-length:"):
                            length = int(line.split(b":")[1])
                    digest = said if revisit else hashlib.sha256(payload).hexdigest()
                    intact = revisit or (digest == said and length == len(payload))
                    rows.append((
                        path, offset, _page(head["warc-record-id"]), head.get("warc-target-uri"), head.get("warc-type"),
                        _page(head.get("warc-refers-to")) if revisit else None, length, digest, intact, None if revisit else payload,
                    ))
                    held += len(block)
                    if held > CHUNK:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)
