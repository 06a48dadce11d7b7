"""BAM files as a Spark data source: spark.read.format("bam").load(path), in splits of compressed bytes.

A file is a chain of small gzip blocks, and records run over their borders. A split finds the first block at or after its
start, then the first place in it where a chain of records can begin, and owns the records that begin in blocks that begin
before its end. Fields are taken from all records of a stretch at once, and written for all rows of a batch at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "read_name string, flag int, seqname string, pos bigint, mapq int, cigar array<struct<op:string,len:int>>, mate_seqname string, mate_pos bigint, template bigint"
ARROW = pa.schema([("read_name", pa.string()), ("flag", pa.int32()), ("seqname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("mate_seqname", pa.string()), ("mate_pos", pa.int64()), ("template", pa.int64())])
#: Fixed values of the format: CIGAR operations by code, the first fields of a record, and the empty block that ends a file.
OPS = "MIDNSHP=X"
RECORD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name_length", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("seq_length", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("template", "<i4")])
FIELDS = struct.Struct("<iiiBBHHHiiii")
BLOCK_START, LARGEST_BLOCK = b"\x1f\x8b\x08\x04", 1 << 16
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Records that must follow one another for a place to count as a record's start; bytes of records that are decoded at once.
CHAIN, STRETCH = 8, 4 << 20


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI, or the local one, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str, suffix: str = ".bam") -> list[tuple[str, int]]:
    """(path in its store, bytes) of a file, or of those of a folder whose names end in the suffix."""
    store, inner = store_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file and f.path.endswith(suffix)]
    return sorted((f.path, f.size) for f in found)


def block_size(head: bytes, at: int = 0) -> int | None:
    """Length in bytes of the block whose header begins at a place, None where none does."""
    if head[at : at + 4] != BLOCK_START or len(head) < at + 12:
        return None
    end = at + 12 + int.from_bytes(head[at + 10 : at + 12], "little")
    at += 12
    while at + 6 <= min(end, len(head)):
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return None


def inflate(block: bytes) -> bytes | None:
    """What a whole block holds; None if it isn't one."""
    start = 12 + int.from_bytes(block[10:12], "little")
    try:
        data = zlib.decompress(block[start:-8], -15)
    except zlib.error:
        return None
    return data if struct.unpack("<II", block[-8:]) == (zlib.crc32(data), len(data) & 0xFFFFFFFF) else None


class Blocks:
    """Blocks of a file from a place on: (offset, what it holds). A block that the file's end cuts off ends them."""

    def __init__(self, file, at: int):
        self.file, self.at, self.end = file, at, file.size()
        self.held, self.held_at = b"", at

    def peek(self, n: int) -> bytes:
        have = self.held_at + len(self.held) - self.at
        if have < n:
            rest = self.held[self.at - self.held_at :]
            self.file.seek(self.at + len(rest))
            self.held, self.held_at = rest + self.file.read(max(n - len(rest), 1 << 20)), self.at
        start = self.at - self.held_at
        return self.held[start : start + n]

    def find(self, before: int) -> bool:
        """Go to the first block from here on; False if none begins before the given offset."""
        window = self.peek(2 * LARGEST_BLOCK)
        at = window.find(BLOCK_START)
        first = self.at
        while at >= 0 and first + at < before:
            size = block_size(window, at)
            if size and (at + size > len(window) or inflate(window[at : at + size]) is not None):
                self.at = first + at
                return True
            at = window.find(BLOCK_START, at + 1)
        return False

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.at < self.end:
            block = self.peek(LARGEST_BLOCK)
            size = block_size(block)
            if size is None and len(block) >= 18:
                raise ValueError(f"no block at byte {self.at}")
            if size is None or size > len(block):
                return
            data = inflate(block[:size])
            if data is None:
                raise ValueError(f"damaged block at byte {self.at}")
            at = self.at
            self.at += size
            yield at, data


class Stream:
    """Inflated bytes of blocks, fetched as needed; `own` is how many of those held are of blocks that begin before `end`, `last` the place in the file and among them of the last block."""

    def __init__(self, blocks: Blocks, end: int):
        self.blocks, self.end, self.data, self.own, self.ended, self.past, self.last = iter(blocks), end, bytearray(), 0, False, False, (0, 0)

    def need(self, n: int, own: bool = False) -> bool:
        """Hold n bytes, if there are so many; of this split alone, if `own`."""
        while len(self.data) < n and not self.ended and not (own and self.past):
            at, data = next(self.blocks, (None, b""))
            self.ended, self.past = at is None, at is None or at >= self.end
            if not self.ended:
                self.last = at, len(self.data)
            self.data += data
            if not self.past:
                self.own += len(data)
        return len(self.data) >= n

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.own -= n


@dataclass
class Header:
    """Sequences' names, with "*" behind them, and lengths; the records begin in the block at byte `at`, after `skip` bytes of it."""

    names: pa.Array
    lengths: np.ndarray
    at: int
    skip: int


def read_header(stream: Stream) -> Header:
    def number(at: int) -> int:
        if at + 4 > len(stream.data) and not stream.need(at + 4):
            raise ValueError("the file ends in its header")
        return int.from_bytes(stream.data[at : at + 4], "little", signed=True)

    if number(0) != int.from_bytes(b"BAM\x01", "little"):
        raise ValueError("not a BAM file")
    at = 8 + number(4)
    n, starts, sizes = number(at), [], []
    at += 4
    for _ in range(n):
        k = number(at)
        number(at + 4 + k)
        starts.append(at + 4)
        sizes.append(k)
        at += 8 + k
    raw, starts, sizes = np.frombuffer(bytes(stream.data[:at]), np.uint8), np.array(starts, np.int64), np.array(sizes, np.int64)
    text, ends = _gather(raw, starts, sizes - 1)
    names = pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes()))
    lengths = _gather(raw, starts + sizes, np.full(n, 4))[0].view("<i4").astype(np.int64)
    return Header(pa.concat_arrays([names, pa.array(["*"])]), lengths, stream.last[0], at - stream.last[1])


#: Headers that a worker has read, the oldest first, by file.
_HEADERS: dict[tuple, Header] = {}


def header_of(store: fs.FileSystem, path: str) -> Header:
    """A file's header. A worker reads many splits of a file, and lists of sequences can be long; the last four are kept."""
    info = store.get_file_info(path)
    key = store.type_name, path, info.size, info.mtime_ns
    if key not in _HEADERS:
        with store.open_input_file(path) as file:
            header = read_header(Stream(Blocks(file, 0), 0))
        if info.mtime_ns is None:
            return header
        while len(_HEADERS) >= 4:
            del _HEADERS[next(iter(_HEADERS))]
        _HEADERS[key] = header
    return _HEADERS[key]


def possible(stream: Stream, at: int, header: Header) -> int:
    """Bytes of the record that can begin at a place, 0 if none can."""
    if not stream.need(at + FIELDS.size):
        return 0
    size, ref, pos, name, _, _, n_cigar, flag, bases, mate_ref, mate_pos, _ = FIELDS.unpack_from(stream.data, at)
    n = len(header.lengths)
    fits = lambda r, p: -1 <= r < n and -1 <= p and (r < 0 or p <= header.lengths[r])
    if not (name and bases >= 0 and flag < 4096 and fits(ref, pos) and fits(mate_ref, mate_pos)) or size < 32 + name + 4 * n_cigar + (bases + 1) // 2 + bases:
        return 0
    start = at + FIELDS.size
    if not stream.need(start + name + 4 * n_cigar):
        return 0
    text = stream.data[start : start + name]
    if text[-1] or not all(33 <= c <= 126 for c in text[:-1]):
        return 0
    ops = np.frombuffer(bytes(stream.data[start + name : start + name + 4 * n_cigar]), "<u4") & 15
    return 4 + size if not len(ops) or ops.max() < len(OPS) else 0


def first_record(stream: Stream, header: Header) -> bool:
    """Drop what stands before the first record that begins in a block of this split; False if none does."""
    at = 0
    while stream.need(at + 1) and at < stream.own:
        end, n = at, 0
        while n < CHAIN and (size := possible(stream, end, header)):
            end, n = end + size, n + 1
        # At the file's end a chain is as long as the rest is; a file may be cut off within a record.
        if n == CHAIN or n and not stream.need(end + FIELDS.size):
            stream.drop(at)
            return True
        at += 1
    return False


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of stretches of the data, one after the other."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])], offsets.astype(np.int32)


def _long_cigars(data: bytes, starts: np.ndarray, fields: np.ndarray, counts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CIGARs of more operations than a record can count stand in a tag; the record has "all bases clipped, then a skip" instead."""
    ends = np.cumsum(counts)
    held = np.flatnonzero((counts == 2) & (fields["seq_length"] > 0))
    held = [i for i in held if values[ends[i] - 2] == (int(fields["seq_length"][i]) << 4 | 4) and values[ends[i] - 1] & 15 == 3]
    own = {}
    for i in held:
        f = fields[i]
        at, end = int(starts[i]) + 36 + int(f["name_length"]) + 8 + (int(f["seq_length"]) + 1) // 2 + int(f["seq_length"]), int(starts[i]) + 4 + int(f["size"])
        while at + 3 <= end:
            tag, kind = data[at : at + 2], chr(data[at + 2])
            at += 3
            if kind == "B":
                n = int.from_bytes(data[at + 1 : at + 5], "little")
                if tag == b"CG" and data[at : at + 1] == b"I":
                    own[i] = np.frombuffer(data[at + 5 : at + 5 + 4 * n], "<u4")
                at += 5 + n * {"c": 1, "C": 1, "s": 2, "S": 2}.get(chr(data[at]), 4)
            elif kind in "ZH":
                at = data.index(0, at) + 1
            else:
                at += {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2}.get(kind, 4)
    if not own:
        return counts, values
    parts = [own.get(i, part) for i, part in enumerate(np.split(values, ends[:-1]))]
    return np.array([len(p) for p in parts]), np.concatenate(parts)


def decode(data: bytes, starts: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    """Rows of the records that begin at the given places."""
    raw = np.frombuffer(data, np.uint8)
    fields = raw[starts[:, None] + np.arange(RECORD.itemsize)].view(RECORD)[:, 0]
    text, text_at = _gather(raw, starts + 36, fields["name_length"].astype(np.int64) - 1)
    counts = fields["n_cigar"].astype(np.int64)
    packed = _gather(raw, starts + 36 + fields["name_length"], 4 * counts)[0].view("<u4")
    counts, packed = _long_cigars(data, starts, fields, counts, packed)
    op = pa.array(list(OPS)).take(pa.array(packed & 15))
    cigar = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.StructArray.from_arrays([op, pa.array((packed >> 4).astype(np.int32))], ["op", "len"]))
    place = lambda ref: names.take(pa.array(np.where(ref < 0, len(names) - 1, ref)))
    columns = [
        pa.StringArray.from_buffers(len(starts), pa.py_buffer(text_at.tobytes()), pa.py_buffer(text.tobytes())),
        pa.array(fields["flag"].astype(np.int32)), place(fields["ref"]), pa.array(fields["pos"].astype(np.int64) + 1), pa.array(fields["mapq"].astype(np.int32)), cigar,
        place(fields["mate_ref"]), pa.array(fields["mate_pos"].astype(np.int64) + 1), pa.array(fields["template"].astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)


def split_rows(store: fs.FileSystem, path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """Rows of the records that a split owns."""
    header = header_of(store, path)
    if header.at >= end:
        return
    with store.open_input_file(path) as file:
        blocks = Blocks(file, max(start, header.at))
        if start > header.at and not blocks.find(end):
            return
        stream = Stream(blocks, end)
        if start <= header.at:
            if not stream.need(header.skip):
                return
            stream.drop(header.skip)
        elif not first_record(stream, header):
            return
        while stream.need(4) and stream.own > 0:
            stream.need(STRETCH, own=True)
            starts, at = [], 0
            while at < stream.own and at + 4 <= len(stream.data):
                size = 4 + int.from_bytes(stream.data[at : at + 4], "little", signed=True)
                if size < 36:
                    raise ValueError("a record is shorter than its fields")
                # Only the last record of a stretch, or one larger than it, needs more bytes.
                if at + size > len(stream.data) and (starts or not stream.need(at + size)):
                    break
                starts.append(at)
                at += size
            if not starts:
                return
            yield decode(bytes(stream.data[:at]), np.array(starts, np.int64), header.names)
            stream.drop(at)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class BamReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Split]:
        return [Split(path, at, min(size, at + self.split_bytes)) for path, size in files_of(self.path) for at in range(0, size, self.split_bytes)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return split_rows(store_of(self.path)[0], partition.path, partition.start, partition.end)


class BlockWriter:
    """Gzip blocks of what is written."""

    def __init__(self, file):
        self.file, self.held = file, bytearray()

    def write(self, data: bytes) -> None:
        self.held += data
        at = 0
        while len(self.held) - at >= 0xFF00:
            self.flush(bytes(self.held[at : at + 0xFF00]))
            at += 0xFF00
        del self.held[:at]

    def flush(self, data: bytes) -> None:
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(data) + deflate.flush()
        self.file.write(BLOCK_START + bytes([0, 0, 0, 0, 0, 255, 6, 0]) + b"BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data)))

    def close(self) -> None:
        if self.held:
            self.flush(bytes(self.held))
        self.file.write(END_BLOCK)


def header_bytes(sequences: list[tuple[str, int]]) -> bytes:
    text = "".join(f"@SQ\tSN:{name}\tLN:{length}\n" for name, length in sequences).encode()
    listed = b"".join(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length) for name, length in sequences)
    return b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(sequences)) + listed


def record_bytes(row, number: dict[str, int]) -> bytes:
    """One alignment without bases. CIGARs of over 65,535 operations go into a tag."""
    name = row["read_name"].encode() + b"\0"
    packed = [o["len"] << 4 | OPS.index(o["op"]) for o in row["cigar"] or []]
    bases, tags = 0, b""
    if len(packed) > 65_535:
        tags = b"CGBI" + struct.pack("<I", len(packed)) + np.array(packed, "<u4").tobytes()
        bases = sum(x >> 4 for x in packed if x & 15 in (0, 1, 4, 7, 8))
        packed = [bases << 4 | 4, sum(x >> 4 for x in packed if x & 15 in (0, 2, 3, 7, 8)) << 4 | 3]
    rest = name + np.array(packed, "<u4").tobytes() + b"\xff" * ((bases + 1) // 2 + bases) + tags
    at = lambda k, p: (number.get(row[k], -1), (row[p] or 0) - 1)
    return FIELDS.pack(32 + len(rest), *at("seqname", "pos"), len(name), row["mapq"] or 0, 0, len(packed), row["flag"], bases, *at("mate_seqname", "mate_pos"), row["template"] or 0) + rest


def _fill(out: np.ndarray, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
    """Put stretches that stand one after the other in the data at their places."""
    out[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(len(data))] = data


def _plain_bytes(batch: pa.RecordBatch, number: dict[str, int]) -> bytes:
    """record_bytes() of all rows, none of which has too long a CIGAR."""
    ints = lambda c: batch[c].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if batch["read_name"].null_count or batch["flag"].null_count:
        raise ValueError("an alignment has no name or no flag")

    def refs(column: str) -> np.ndarray:
        coded = batch[column].dictionary_encode()
        known = np.array([number.get(s, -1) for s in coded.dictionary.to_pylist()] + [-1], np.int64)
        return known[coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]

    names = batch["read_name"].cast(pa.large_binary())
    sizes = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.list_value_length(batch["cigar"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ops = batch["cigar"].flatten()
    codes = pc.index_in(ops.field("op"), pa.array(list(OPS)))
    if codes.null_count or ops.field("len").null_count:
        raise ValueError("a CIGAR has an unknown operation")
    packed = (ops.field("len").to_numpy(zero_copy_only=False).astype("<u4") << 4 | codes.to_numpy(zero_copy_only=False).astype("<u4")).astype("<u4")
    rows = {"size": 33 + sizes + 4 * counts, "ref": refs("seqname"), "pos": ints("pos") - 1, "name_length": sizes + 1, "mapq": ints("mapq"), "n_cigar": counts, "flag": ints("flag"), "mate_ref": refs("mate_seqname"), "mate_pos": ints("mate_pos") - 1, "template": ints("template")}
    fields = np.zeros(len(batch), RECORD)
    for name, values in rows.items():
        kind = np.iinfo(RECORD[name])
        if len(values) and not kind.min <= values.min() <= values.max() <= kind.max:
            raise ValueError(f"{name} of an alignment is beyond what a record holds")
        fields[name] = values
    ends = np.cumsum(4 + rows["size"])
    starts = ends - 4 - rows["size"]
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    out[starts[:, None] + np.arange(RECORD.itemsize)] = fields.view(np.uint8).reshape(-1, RECORD.itemsize)
    _fill(out, starts + RECORD.itemsize, sizes, np.frombuffer(b"".join(names.to_pylist()), np.uint8))
    _fill(out, starts + RECORD.itemsize + sizes + 1, 4 * counts, packed.view(np.uint8))
    return out.tobytes()


def batch_bytes(batch: pa.RecordBatch, number: dict[str, int]) -> Iterator[bytes]:
    """Rows as records, all of a stretch at once; those of over 65,535 operations one by one."""
    at = 0
    for i in np.flatnonzero(pc.list_value_length(batch["cigar"]).fill_null(0).to_numpy(zero_copy_only=False) > 65_535):
        yield _plain_bytes(batch.slice(at, i - at), number)
        yield record_bytes(batch.slice(i, 1).to_pylist()[0], number)
        at = i + 1
    yield _plain_bytes(batch.slice(at), number)


class BamWriter(DataSourceArrowWriter):
    """One file a task, whole with header and end; a file takes its name when it is complete, and no task replaces another's."""

    def __init__(self, path: str, sequences: list[tuple[str, int]]):
        self.path, self.sequences = path, sequences

    def write(self, iterator) -> WriterCommitMessage:
        import uuid

        store, inner = store_of(self.path)
        store.create_dir(inner, recursive=True)
        name = f"{inner}/part-{uuid.uuid4().hex}"
        number = {s: i for i, (s, _) in enumerate(self.sequences)}
        with store.open_output_stream(name + ".writing") as file:
            out = BlockWriter(file)
            out.write(header_bytes(self.sequences))
            for batch in iterator:
                for data in batch_bytes(batch, number):
                    out.write(data)
            out.close()
        message = WriterCommitMessage()
        message.file = name
        return message

    def commit(self, messages: list) -> None:
        store, _ = store_of(self.path)
        for m in messages:
            store.move(m.file + ".writing", m.file + ".bam")


class BamSource(DataSource):
    """Options: path, splitBytes; to write, sequences as "name:length,name:length"."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        if overwrite:
            raise ValueError("a folder of BAM files is not overwritten; append, or name a new one")
        pairs = (x.rpartition(":") for x in self.options["sequences"].split(",") if x)
        return BamWriter(self.options["path"], [(n, int(k)) for n, _, k in pairs])
