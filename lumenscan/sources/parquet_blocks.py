"""Joining Parquet files by copying their encoded column chunks.

Nothing is decoded: the bytes of each column chunk move to the new file as
they are and only the footer is written anew, with shifted offsets. The footer
is a struct in Thrift's compact protocol; it is read into a generic tree here,
so fields this module knows nothing of survive.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs

MAGIC = b"PAR1"
_TRUE, _FALSE, _BYTE, _I16, _I32, _I64, _DOUBLE, _BINARY, _LIST, _SET, _MAP, _STRUCT = range(1, 13)

# Field numbers of parquet.thrift (fixed values of the format).
FILE_SCHEMA, FILE_ROWS, FILE_GROUPS, FILE_KEY_VALUES = 2, 3, 4, 5
GROUP_COLUMNS, GROUP_ROWS, GROUP_OFFSET, GROUP_ORDINAL = 1, 3, 5, 7
CHUNK_PATH, CHUNK_OFFSET, CHUNK_META, CHUNK_INDEXES = 1, 2, 3, (4, 5, 6, 7)
META_SIZE, META_DATA_PAGE, META_INDEX_PAGE, META_DICT_PAGE, META_BLOOM = 7, 9, 10, 11, (14, 15)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.byte()
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (_TRUE, _FALSE):
            return self.byte() == _TRUE
        if kind == _BYTE:
            return self.byte()
        if kind in (_I16, _I32, _I64):
            return self.zigzag()
        if kind == _DOUBLE:
            self.at += 8
            return struct.unpack_from("<d", self.data, self.at - 8)[0]
        if kind == _BINARY:
            n = self.varint()
            self.at += n
            return bytes(self.data[self.at - n : self.at])
        if kind in (_LIST, _SET):
            head = self.byte()
            n = head >> 4
            if n == 15:
                n = self.varint()
            return (head & 15, [self.value(head & 15) for _ in range(n)])
        if kind == _MAP:
            n = self.varint()
            kinds = self.byte() if n else 0
            return (kinds, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)])
        if kind == _STRUCT:
            return self.struct()
        raise ValueError(f"unknown thrift type {kind}")

    def struct(self) -> dict[int, tuple[int, object]]:
        fields, last = {}, 0
        while head := self.byte():
            kind = head & 15
            last = last + (head >> 4) if head >> 4 else self.zigzag()
            fields[last] = (kind, kind == _TRUE) if kind in (_TRUE, _FALSE) else (kind, self.value(kind))
        return fields


class _Writer:
    def __init__(self):
        self.out = bytearray()

    def varint(self, n: int) -> None:
        while n > 0x7F:
            self.out.append(n & 0x7F | 0x80)
            n >>= 7
        self.out.append(n)

    def zigzag(self, n: int) -> None:
        self.varint((n << 1) ^ (n >> 63))

    def value(self, kind: int, v) -> None:
        if kind in (_TRUE, _FALSE):
            self.out.append(_TRUE if v else _FALSE)
        elif kind == _BYTE:
            self.out.append(v)
        elif kind in (_I16, _I32, _I64):
            self.zigzag(v)
        elif kind == _DOUBLE:
            self.out += struct.pack("<d", v)
        elif kind == _BINARY:
            self.varint(len(v))
            self.out += v
        elif kind in (_LIST, _SET):
            inner, items = v
            if len(items) < 15:
                self.out.append(len(items) << 4 | inner)
            else:
                self.out.append(0xF0 | inner)
                self.varint(len(items))
            for x in items:
                self.value(inner, x)
        elif kind == _MAP:
            self.varint(len(v[1]))
            if v[1]:
                self.out.append(v[0])
            for a, b in v[1]:
                self.value(v[0] >> 4, a)
                self.value(v[0] & 15, b)
        else:
            self.struct(v)

    def struct(self, fields: dict) -> None:
        last = 0
        for number in sorted(fields):
            kind, v = fields[number]
            if kind in (_TRUE, _FALSE):
                kind = _TRUE if v else _FALSE
            if 0 < number - last < 16:
                self.out.append((number - last) << 4 | kind)
            else:
                self.out.append(kind)
                self.zigzag(number)
            last = number
            if kind not in (_TRUE, _FALSE):
                self.value(kind, v)
        self.out.append(0)


@dataclass
class Merged:
    """What a merge read and wrote; `ok` only if a second reading agrees."""

    path: str
    files_in: int
    blocks: int
    rows: int
    n_bytes: int
    ok: bool


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def read_footer(f, size: int) -> dict:
    f.seek(size - 8)
    tail = f.read(8)
    if tail[4:] != MAGIC:
        raise ValueError("not a Parquet file with a plain footer")
    n = struct.unpack("<I", tail[:4])[0]
    f.seek(size - 8 - n)
    return _Reader(f.read(n)).struct()


def _moved(group: dict, source, sink, ordinal: int) -> dict:
    """Copies the chunks of one row group; gives the group as it now stands."""
    inner, columns = group[GROUP_COLUMNS][1]
    start, out = sink.tell(), []
    for chunk in columns:
        if CHUNK_PATH in chunk:
            raise ValueError("column chunk in another file")
        meta = dict(chunk[CHUNK_META][1])
        first = min(meta[k][1] for k in (META_DICT_PAGE, META_INDEX_PAGE, META_DATA_PAGE) if k in meta and meta[k][1] > 0)
        shift = sink.tell() - first
        source.seek(first)
        left = meta[META_SIZE][1]
        while left:
            piece = source.read(min(left, 8 << 20))
            if not piece:
                raise ValueError("column chunk cut short")
            sink.write(piece)
            left -= len(piece)
        for k in (META_DICT_PAGE, META_INDEX_PAGE, META_DATA_PAGE):
            if k in meta and meta[k][1] > 0:
                meta[k] = (meta[k][0], meta[k][1] + shift)
        for k in META_BLOOM:
            meta.pop(k, None)
        new = {k: v for k, v in chunk.items() if k not in CHUNK_INDEXES}
        new[CHUNK_META] = (_STRUCT, meta)
        if new.get(CHUNK_OFFSET, (0, 0))[1] > 0:
            new[CHUNK_OFFSET] = (_I64, first + shift)
        out.append(new)
    moved = dict(group)
    moved[GROUP_COLUMNS] = (_LIST, (inner, out))
    if GROUP_OFFSET in moved:
        moved[GROUP_OFFSET] = (_I64, start)
    if GROUP_ORDINAL in moved:
        moved.pop(GROUP_ORDINAL)
    return moved


def merge_files(inputs: list[str], output: str) -> Merged:
    """Writes one Parquet file with all row groups of `inputs`, in that order.

    Raises if schemas differ. Files and row groups without rows add nothing. The result is
    written beside its place and moved there only once it has been read back
    and agrees in schema, row groups and rows, so a retried task cannot leave
    a torn or doubled file.
    """
    if not inputs:
        raise ValueError("nothing to merge")
    fs, place = open_fs(output)
    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
    draft = f"{place.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}"
    head, groups, rows, expected = None, [], 0, 0
    with fs.open_output_stream(draft) as sink:
        sink.write(MAGIC)
        for uri in inputs:
            source_fs, path = open_fs(uri)
            with source_fs.open_input_file(path) as source:
                footer = read_footer(source, source.size())
                if head is None:
                    head = footer
                elif footer[FILE_SCHEMA] != head[FILE_SCHEMA]:
                    raise ValueError(f"schema of {uri} differs")
                expected += footer[FILE_ROWS][1]
                for group in footer[FILE_GROUPS][1][1]:
                    if not group[GROUP_ROWS][1]:
                        continue
                    groups.append(_moved(group, source, sink, len(groups)))
                    rows += group[GROUP_ROWS][1]
        footer = dict(head)
        footer[FILE_ROWS] = (_I64, rows)
        footer[FILE_GROUPS] = (_LIST, (_STRUCT, groups))
        w = _Writer()
        w.struct(footer)
        sink.write(bytes(w.out))
        sink.write(struct.pack("<I", len(w.out)) + MAGIC)
        n_bytes = sink.tell()
    with fs.open_input_file(draft) as f:
        again = read_footer(f, f.size())
    ok = (
        rows == expected == again[FILE_ROWS][1]
        and again[FILE_SCHEMA] == head[FILE_SCHEMA]
        and len(again[FILE_GROUPS][1][1]) == len(groups)
        and sum(g[GROUP_ROWS][1] for g in again[FILE_GROUPS][1][1]) == rows
    )
    if not ok:
        fs.delete_file(draft)
        raise ValueError(f"merged file {output} does not agree with its inputs")
    fs.move(draft, place)
    return Merged(output, len(inputs), len(groups), rows, n_bytes, ok)
