"""BAM files made by hand, cut in any places, against the reader of SAM text."""

import gzip
import random
import struct

import pyarrow as pa
import pytest

from tallyspark.sources import bam, readers

SEQUENCES = [("chr1", 1_000_000), ("chr2", 50_000), ("chrM", 16_000)]
OPS = "MIDNSHP=X"


def record(name, flag, ref, pos, cigar, bases=0, tags=b"", mate=(-1, -1)):
    ops = b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in cigar)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 30, 0, len(cigar), flag, bases, *mate, 0) + name.encode() + b"\0" + ops + bytes((bases + 1) // 2) + b"\xff" * bases + tags
    return struct.pack("<i", len(body)) + body


def block(data):
    body = gzip.compress(data)[10:-8]
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", __import__("zlib").crc32(data), len(data))


def whole_file(records, block_bytes):
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(SEQUENCES)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in SEQUENCES)
    data = head + b"".join(records)
    return b"".join(block(data[i : i + block_bytes]) for i in range(0, len(data), block_bytes)) + bam.END_BLOCK


@pytest.fixture(scope="module")
def reads():
    """(name, flag, ref, pos from 0, cigar): spliced, clipped and unmapped ones, and repeats."""
    pick, out = random.Random(4), []
    for i in range(4000):
        cigar = [(pick.randint(1, 99), o) for o in pick.choice(["M", "SM", "MNM", "SMIMDMS", "HSMH", "MX=", ""])]
        out.append((f"read{i // 2}:{pick.random()}"[: pick.randint(6, 30)] + f"/{i % 2 + 1}", pick.choice([83, 163, 99, 147, 4, 256]), pick.choice([0, 0, 0, 1, 2, -1]), pick.randint(0, 15_000), cigar))
        if i % 50 == 0:
            out.append(out[-1])
    return out


@pytest.fixture(scope="module")
def expected(spark, reads, tmp_path_factory):
    path = tmp_path_factory.mktemp("sam") / "r.sam"
    names = [n for n, _ in SEQUENCES] + ["*"]
    lines = [f"{n}\t{f}\t{names[ref]}\t{pos + 1}\t30\t{''.join(f'{k}{o}' for k, o in c) or '*'}\t*\t0\t0\t*\t*" for n, f, ref, pos, c in reads]
    path.write_text("@HD\tVN:1.6\n" + "\n".join(lines) + "\n")
    return lambda **k: sorted(map(repr, readers.sam(spark, str(path), **k).collect()))


@pytest.mark.parametrize("block_bytes", [200, 5_000, 60_000])
@pytest.mark.parametrize("splits", [1, 3, 20])
def test_splits_read_each_record_once(spark, reads, expected, tmp_path, splits, block_bytes):
    """Blocks may be smaller than a record, or hold many."""
    data = whole_file([record(*r, bases=7) for r in reads], block_bytes)
    (tmp_path / "r.bam").write_bytes(data)
    got = readers.bam(spark, str(tmp_path / "r.bam"), strip_mate=True, split_bytes=-(-len(data) // splits))
    assert sorted(map(repr, got.collect())) == expected(strip_mate=True)


def test_every_cut(reads, tmp_path):
    """Any two splits of a file have all of its records, once each."""
    data = whole_file([record(*r, bases=3) for r in reads[:120]], 700)
    path = tmp_path / "r.bam"
    path.write_bytes(data)
    store = bam.store_of(str(path))[0]
    rows = lambda a, b: [r for batch in bam.split_rows(store, str(path), a, b) for r in batch.to_pylist()]
    whole = rows(0, len(data))
    assert [r["read_name"] for r in whole] == [r[0] for r in reads[:120]]
    for cut in range(1, len(data), 37):
        assert rows(0, cut) + rows(cut, len(data)) == whole


def test_records_larger_than_splits_and_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bam, "STRETCH", 1000)
    records = [record(f"r{i}", 0, 0, i, [(10, "M")], bases=200_000 if i % 3 == 0 else 1) for i in range(12)]
    data = whole_file(records, 30_000)
    path = tmp_path / "r.bam"
    path.write_bytes(data)
    store = bam.store_of(str(path))[0]
    for size in (500, 5_000, len(data)):
        got = [r["pos"] for a in range(0, len(data), size) for b in bam.split_rows(store, str(path), a, min(len(data), a + size)) for r in b.to_pylist()]
        assert got == list(range(1, 13))


def test_cut_off_and_damaged_files(spark, reads, tmp_path):
    data = whole_file([record(*r) for r in reads[:500]], 3_000)
    (tmp_path / "cut.bam").write_bytes(data[: len(data) * 2 // 3])
    names = [r.read_name for r in spark.read.format("bam").option("splitBytes", 4_000).load(str(tmp_path / "cut.bam")).collect()]
    assert names == [r[0] for r in reads[: len(names)]] and 200 < len(names) < 500
    middle = len(data) // 2
    (tmp_path / "bad.bam").write_bytes(data[:middle] + bytes([data[middle] ^ 255]) + data[middle + 1 :])
    with pytest.raises(Exception, match="damaged block|no block"):
        spark.read.format("bam").load(str(tmp_path / "bad.bam")).collect()
    (tmp_path / "text.bam").write_text("no such thing" * 10)
    with pytest.raises(Exception, match="no block"):
        spark.read.format("bam").load(str(tmp_path / "text.bam")).collect()
    with pytest.raises(Exception, match="none.bam"):
        spark.read.format("bam").load(str(tmp_path / "none.bam")).collect()


def test_excluded_sequences_and_folders(spark, reads, expected, tmp_path):
    for i in (0, 1):
        (tmp_path / f"{i}.bam").write_bytes(whole_file([record(*r) for r in reads[i::2]], 9_000))
    (tmp_path / "empty.bam").write_bytes(whole_file([], 9_000))
    out = spark.createDataFrame([("chr2",), ("chrM",)], "seqname string")
    assert sorted(map(repr, readers.bam(spark, f"file://{tmp_path}", out).collect())) == expected(excluded=out)


def test_long_cigars_stand_in_a_tag(spark, tmp_path):
    real = [(1, "M" if i % 2 else "I") for i in range(70_000)]
    tag = b"NMC\x05" + b"ZZZabc\0" + b"CGBI" + struct.pack("<I", len(real)) + b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in real)
    records = [record("short", 0, 0, 5, [(3, "M")], 3), record("long", 0, 0, 9, [(70_000, "S"), (35_000, "N")], 70_000, tag), record("plain", 0, 0, 9, [(4, "S"), (2, "N")], 4)]
    (tmp_path / "r.bam").write_bytes(whole_file(records, 60_000))
    got = {r.read_name: [(o.len, o.op) for o in r.cigar] for r in spark.read.format("bam").load(str(tmp_path / "r.bam")).collect()}
    assert got == {"short": [(3, "M")], "long": real, "plain": [(4, "S"), (2, "N")]}


def test_written_files_are_read_back(spark, reads, tmp_path):
    long = [{"op": "M" if i % 2 else "D", "len": 2} for i in range(66_000)]
    rows = [(n, f, "*" if ref < 0 else SEQUENCES[ref][0], pos + 1, 30, [(o, k) for k, o in c], "*", 0, 0) for n, f, ref, pos, c in reads] + [("long", 0, "chr1", 1, 1, [(x["op"], x["len"]) for x in long], "chr2", 7, -5)]
    made = spark.createDataFrame(rows, bam.SCHEMA).repartition(3)
    spark.dataSource.register(bam.BamSource)
    made.write.format("bam").option("sequences", ",".join(f"{n}:{k}" for n, k in SEQUENCES)).mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("bam").option("splitBytes", 7_000).load(str(tmp_path / "out"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, made.collect()))
    with pytest.raises(Exception, match="not overwritten"):
        made.write.format("bam").option("sequences", "chr1:5").mode("overwrite").save(str(tmp_path / "out"))


def test_batches_are_written_as_their_rows(reads):
    """A batch's bytes are those of its rows one by one: nulls, unknown sequences, and a CIGAR that goes into a tag among short ones."""
    names = [n for n, _ in SEQUENCES]
    number = {s: i for i, s in enumerate(names)}
    rows = [{"read_name": n, "flag": f, "seqname": "*" if ref < 0 else names[ref], "pos": pos, "mapq": pos % 200, "cigar": [{"op": o, "len": k} for k, o in c], "mate_seqname": names[pos % 3], "mate_pos": pos, "template": -pos} for n, f, ref, pos, c in reads[:300]]
    rows[7] |= {"cigar": None, "pos": None, "seqname": None, "mapq": None, "mate_seqname": None, "mate_pos": None, "template": None}
    rows[8] |= {"read_name": "Läufer", "seqname": "elsewhere"}
    for i in (100, 101, 299):
        rows[i] |= {"cigar": [{"op": "MD"[j % 2], "len": 2} for j in range(66_000)]}
    batch = pa.RecordBatch.from_pylist(rows, bam.ARROW)
    for part, own in ((batch, rows), (batch.slice(5, 90), rows[5:95]), (batch.slice(0, 0), [])):
        assert b"".join(bam.batch_bytes(part, number)) == b"".join(bam.record_bytes(r, number) for r in own)
    for wrong in ({"read_name": None}, {"flag": None}, {"read_name": "n" * 255}, {"cigar": [{"op": "Q", "len": 1}]}, {"pos": 1 << 40}):
        with pytest.raises(ValueError):
            b"".join(bam.batch_bytes(pa.RecordBatch.from_pylist([rows[0] | wrong], bam.ARROW), number))


def test_a_long_header_is_read_once_and_not_searched(tmp_path, monkeypatch):
    """Splits that begin in a header of many sequences find the first record by what the header says, whatever place in a block it has."""
    sequences = [(f"s{i}", 1_000 + i) for i in range(30_000)]
    tries, heads, possible, read_header = [], [], bam.possible, bam.read_header
    monkeypatch.setattr(bam, "possible", lambda stream, at, header: tries.append(at) or possible(stream, at, header))
    monkeypatch.setattr(bam, "read_header", lambda stream: heads.append(1) or read_header(stream))
    body = b"".join(record(f"r{i}", 0, 29_999 - i, i, [(10, "M")], 5) for i in range(3_000))
    head = bam.header_bytes(sequences)
    for name, cut in (("within.bam", len(head) // 2), ("before.bam", len(head))):
        path = tmp_path / name
        data = b"".join(block(x[i : i + 20_000]) for x in ((head + body)[:cut], (head + body)[cut:]) for i in range(0, len(x), 20_000)) + bam.END_BLOCK
        path.write_bytes(data)
        tries.clear(), heads.clear()
        store = bam.store_of(str(path))[0]
        got = [(r["read_name"], r["seqname"], r["pos"]) for a in range(0, len(data), 9_000) for b in bam.split_rows(store, str(path), a, min(len(data), a + 9_000)) for r in b.to_pylist()]
        assert got == [(f"r{i}", f"s{29_999 - i}", i + 1) for i in range(3_000)]
        assert len(heads) == 1 and len(tries) < 2_000
        path.write_bytes(whole_file([record("other", 0, 1, 4, [(10, "M")], 5)], 20_000))
        assert [r["seqname"] for b in bam.split_rows(store, str(path), 0, 10_000) for r in b.to_pylist()] == ["chr2"]
