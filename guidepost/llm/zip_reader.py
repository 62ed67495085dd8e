"""ZIP archives read by ranges, and written as a stream.

The reader never unpacks an archive: it finds the end record at the file's tail (and the
ZIP64 end record where sizes need it), reads the central directory, and turns a stored
member into the range of the file that holds its bytes. Files are named by URI and opened
through Arrow's file systems, so that any task can read any range.

The writer streams stored members whose sizes are known only at their end: it sets the
data-descriptor flag and always writes ZIP64 records, so members and archives have no
size limit and no position of the file is written twice.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs

# Fixed values of the format: signatures, and the mark that a size stands in the ZIP64 part.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64, DESCRIPTOR = b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08"
IN_64, IN_64_SHORT, EXTRA_64 = 0xFFFFFFFF, 0xFFFF, 0x0001
#: The end record and the longest comment that may follow it.
TAIL = 22 + 65_535
#: Bytes of the central directory that are read at once.
DIRECTORY_STEP = 1 << 20
# Version 4.5 (ZIP64), sizes after the data, UTF-8 name; 1 January 1980.
VERSION, FLAGS, DATE = 45, 0x0808, 0x0021


class BadArchive(ValueError):
    pass


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    local = re.fullmatch(r"file:/*(/.*)", uri)
    return fs.FileSystem.from_uri(local.group(1) if local else uri)


@dataclass(frozen=True)
class Member:
    """A member of an archive; ``header`` is the position of its local header."""

    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    header: int

    @property
    def stored(self) -> bool:
        """Do the file's own bytes hold the member as it is?"""
        return self.method == 0 and not self.flags & 1


class Archive:
    """An archive opened for reads of ranges."""

    def __init__(self, uri: str):
        system, path = place(uri)
        self.uri = uri
        self.file = system.open_input_file(path)
        self.length = self.file.size()

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def read(self, start: int, n: int) -> bytes:
        if start < 0 or n < 0 or start + n > self.length:
            raise BadArchive(f"{self.uri}: bytes {start} to {start + n} lie outside the file")
        return self.file.read_at(n, start)

    def directory(self) -> tuple[int, int, int]:
        """Start and length of the central directory and its number of members."""
        tail_at = max(0, self.length - TAIL)
        tail = self.read(tail_at, self.length - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)  # the signature can also stand in a comment
        if at < 0:
            raise BadArchive(f"{self.uri}: no end of a ZIP archive")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        ends = tail_at + at
        if ends >= 20 and (mark := self.read(ends - 20, 20))[:4] == LOCATOR64:
            end64 = struct.unpack_from("<Q", mark, 8)[0]
            record = self.read(end64, 56)
            if record[:4] != END64:
                raise BadArchive(f"{self.uri}: the ZIP64 end record is not where its locator says")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        elif IN_64 in (length, start) or count == IN_64_SHORT:
            raise BadArchive(f"{self.uri}: sizes need a ZIP64 end record, and there is none")
        if start + length > ends:
            raise BadArchive(f"{self.uri}: the central directory runs past its end")
        return start, length, count

    def members(self) -> Iterator[Member]:
        """Members in the order of the central directory, read step by step."""
        start, length, count = self.directory()
        buf, pos, seen = b"", start, 0
        while seen < count:
            fixed = 46
            need = fixed if len(buf) < fixed else fixed + sum(struct.unpack_from("<HHH", buf, 28))
            if len(buf) < need:
                more = min(max(DIRECTORY_STEP, need), start + length - pos)
                if not more:
                    raise BadArchive(f"{self.uri}: the central directory ends after {seen} of {count} members")
                buf += self.read(pos, more)
                pos += more
                continue
            if buf[:4] != CENTRAL:
                raise BadArchive(f"{self.uri}: entry {seen} of the central directory is damaged")
            yield self._member(buf[:need])
            buf = buf[need:]
            seen += 1

    @staticmethod
    def _member(entry: bytes) -> Member:
        flags, method = struct.unpack_from("<HH", entry, 8)
        crc, packed, size, n_name, n_extra = struct.unpack_from("<IIIHH", entry, 16)
        header = struct.unpack_from("<I", entry, 42)[0]
        name = entry[46 : 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entry[46 + n_name : 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == EXTRA_64:  # holds only those numbers that didn't fit, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                size, packed, header = (next(wide) if v == IN_64 else v for v in (size, packed, header))
                break
            extra = extra[4 + n :]
        return Member(name, method, flags, crc, packed, size, header)

    def data_at(self, m: Member) -> int:
        """Where the bytes of a member start; its local header can differ in length."""
        head = self.read(m.header, 30)
        if head[:4] != LOCAL:
            raise BadArchive(f"{self.uri}: no local header of {m.name}")
        return m.header + 30 + sum(struct.unpack_from("<HH", head, 26))


class Writer:
    """Stored members written one after another to a new file."""

    def __init__(self, uri: str):
        system, path = place(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.pos, self.done, self.now = system.open_output_stream(path), 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.pos += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.now = [raw, self.pos, 0, 0]
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", VERSION, FLAGS, 0, 0, DATE, 0, IN_64, IN_64, len(raw), 20) + raw + struct.pack("<HHQQ", EXTRA_64, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.now[2] = zlib.crc32(data, self.now[2])
        self.now[3] += len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.now
        self._put(DESCRIPTOR + struct.pack("<IQQ", crc, size, size))
        self.done.append(tuple(self.now))
        self.now = None

    def close(self) -> int:
        """Write the directories; the length of the file."""
        start = self.pos
        for raw, at, crc, size in self.done:
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", VERSION, VERSION, FLAGS, 0, 0, DATE, crc, IN_64, IN_64, len(raw), 28, 0, 0, 0, 0, IN_64) + raw + struct.pack("<HHQQQ", EXTRA_64, 24, size, size, at))
        length, end64, n = self.pos - start, self.pos, len(self.done)
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, VERSION, VERSION, 0, 0, n, n, length, start))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, min(n, IN_64_SHORT), min(n, IN_64_SHORT), IN_64, IN_64, 0))
        self.out.close()
        return self.pos
