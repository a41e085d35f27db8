import gzip
import json
import re
import struct

import pytest

from karyospark import cli
from karyospark.params import Config
from karyospark.plans import frames, simulate
from karyospark.sources import bai, bam, bam_sorted, blocked, sinks, text


def put(path, content):
    with (gzip.open if str(path).endswith(".gz") else open)(path, "wt") as f:
        f.write(content)
    return str(path)


def test_contigs_keep_the_order_of_the_file(spark, tmp_path):
    p = put(tmp_path / "ref.dict", "@HD\tVN:1.5\n@SQ\tSN:chr2\tLN:50\tM5:x\n@SQ\tSN:chrX\tLN:9\n@SQ\tSN:chr1\tLN:100\n")
    assert [tuple(r) for r in text.read_contigs(spark, p).orderBy("chr_idx").collect()] == [("chr2", 0, 50, 0), ("chr1", 1, 100, 50)]


def test_config(tmp_path):
    p = put(tmp_path / "configure", "read_length\t101\nwindow_size\t500\nref\t/r\nsam\ts\ncaller\tc\nbin\tb\n")
    assert Config.read(p) == Config(101, 500, "/r", "s", "c", "b")


def test_vcf(spark, tmp_path):
    row = "chr{}\t{}\t.\tA\tC\t.\tPASS\t.\tGT:DP:AD\t{}\t{}\n"
    p = put(tmp_path / "v.vcf.gz", "##x\n#CHROM\n" + row.format(1, 7, "0/1:9:4,5", "0/1:9:6,3") + row.format(2, 8, "1/0:9:4,5", ".:.:.") + row.format("X", 9, "0/1:9:4,5", "0/1:9:6,3"))
    got = [tuple(r) for r in text.read_calls(spark, p).orderBy("pos").collect()]
    assert got == [(0, 7, "0/1", 4, 5, 6, 3), (1, 8, "1/0", 4, 5, None, None)]


def test_bcf_equals_vcf(spark, tmp_path):
    """The same calls as text and in binary, with missing values, phases and lengths of every kind."""
    from karyospark.sources import bcf

    header = "##fileformat=VCFv4.2\n##FILTER=<ID=PASS,Description=x>\n##contig=<ID=chr1>\n##contig=<ID=chr2>\n##contig=<ID=chrX>\n##INFO=<ID=DP,Number=1>\n##FORMAT=<ID=GT,Number=1>\n##FORMAT=<ID=DP,Number=1>\n##FORMAT=<ID=AD,Number=R>\n#CHROM\tPOS\n"
    sites = [(0, 7, ["0/1", "0/1"], [[4, 5], [6, 3]]), (1, 8, ["1|0", "./."], [[4, 5], [None, None]]), (2, 9, ["0/1", "0/1"], [[1, 2], [3, 4]]), (0, 300, ["0|1", "1/1"], [[4, 500], [70000, 3]]), (1, 12, ["1", "0/1"], [[4], [5, 6]])]
    lines, raw = "", b"BCF\2\2" + struct.pack("<I", len(header) + 1) + header.encode() + b"\0"

    def vector(values, n, code, missing, end):
        return struct.pack(f"<{n}{code}", *([missing if v is None else v for v in values] + [end] * (n - len(values))))

    for contig, pos, gts, ads in sites:
        told = ["." if a[0] is None else ",".join(map(str, a)) for a in ads]
        lines += f"{('chr1', 'chr2', 'chrX')[contig]}\t{pos}\t.\tA\tC\t.\t.\t.\tGT:DP:AD\t{gts[0]}:9:{told[0]}\t{gts[1]}:9:{told[1]}\n"
        site = struct.pack("<iiifI", contig, pos - 1, 1, 0.0, 2 << 16) + struct.pack("<I", 3 << 24 | 2) + b"\x07\x17A\x17C\x00"
        own = b"\x11\x02\x21"  # GT: pairs of small integers
        for g in gts:
            alleles = [0 if a == "." else int(a) + 1 for a in re.split("[/|]", g)]
            own += vector([a << 1 | (i > 0 and "|" in g) for i, a in enumerate(alleles)], 2, "b", -128, -127)
        own += b"\x11\x01\x11\x09\x09"  # DP, the same string as the info
        big = max(v or 0 for a in ads for v in a)
        kind, code, low = (3, "i", 31) if big > 30000 else (2, "h", 15) if big > 100 else (1, "b", 7)
        own += b"\x11\x03" + bytes([2 << 4 | kind]) + b"".join(vector(a, 2, code, -(1 << low), -(1 << low) + 1) for a in ads)
        raw += struct.pack("<II", len(site), len(own)) + site + own
    put(tmp_path / "v.vcf", header + lines)
    with gzip.open(tmp_path / "v.bcf", "wb") as f:
        f.write(raw)
    want = text.read_calls(spark, str(tmp_path / "v.vcf"))
    got = bcf.read_bcf(spark, str(tmp_path / "v.bcf"))
    assert got.columns == want.columns and got.count() == 4
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_truth_and_predicted(spark, tmp_path):
    t = put(tmp_path / "t.tsv", "chr\tstart\tend\tcp\tmajor\nchr1\t1\t9\t3\t2\nchr1\t10\t19\tx\t1\nchrX\t1\t2\t3\t2\nchr2\t1\t9\t2.5\tNA\n")
    assert [(r["chr_id"], r["cp"], r["is_clonal"]) for r in text.read_truth(spark, t).orderBy("chr_id").collect()] == [(1, 3.0, True), (2, 2.5, False)]
    p = put(tmp_path / "p.tsv", "chr\tstart\tend\tcp\tmajor_allele_cp\n1\t1\t9\t2\t1\n1\t10\t19\t2\t2\n2\t1\t9\t2.4\tNA\n#total=3\n")
    assert [(r["chr_id"], r["is_clonal"]) for r in text.read_predicted(spark, p).orderBy("chr_id").collect()] == [(1, True), (2, False)]


def test_fasta_and_regions(spark, tmp_path):
    p = put(tmp_path / "x.fa", ">chr1 about\nACGT\nNN\n>chr2\nGG\n")
    assert [tuple(r) for r in text.read_sequences(spark, p).orderBy("chr").collect()] == [("chr1", "ACGTNN"), ("chr2", "GG")]
    p = put(tmp_path / "cn.tab", "#CHR\tFIRST_POS\tLAST_POS\tCOPY_NUMBER\nchr1\t5\t9\t3\n")
    assert [tuple(r) for r in text.read_regions(spark, p).collect()] == [("chr1", 5, 9, 3)]


def make_bam(path, names, records):
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(names))
    for n in names:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000)
    for ref, pos, mapq, flags, length, mate, span in records:
        body = struct.pack("<iiBBHHHiiii", ref, pos, 2, mapq, 0, 0, flags, length, ref, mate, span) + b"q\0" + bytes((length + 1) // 2 + length)
        out += struct.pack("<i", len(body)) + body
    with gzip.open(path, "wb") as f:
        f.write(out)


def test_bam(spark, tmp_path):
    make_bam(tmp_path / "a.bam", ["chr1", "chrM"], [(0, 5, 60, 67, 100, 50, 300), (1, 5, 60, 67, 100, 50, 300), (-1, -1, 0, 4, 100, -1, 0)])
    contigs = spark.createDataFrame([("chr1", 0, 1000)], "chr string, chr_idx int, length bigint")
    assert [tuple(r) for r in bam.read_bam(spark, str(tmp_path / "a.bam"), "tumor", contigs).collect()] == [("tumor", 0, 5, 50, 300, 100, 60, 67)]


def bgzf(data, block=700):
    """Blocks of any size, whatever records they cut, and the empty one at the end."""
    import zlib

    out = b""
    for part in [*(data[i : i + block] for i in range(0, len(data), block)), b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize("block", [100, 700, 5000])
def test_splits_of_a_bam_file_equal_the_whole(spark, tmp_path, block):
    """Records that blocks and splits cut anywhere are read once each."""
    import random

    draw = random.Random(block)
    records = [(draw.randrange(-1, 2), draw.randrange(900), 60, 67, draw.randrange(1, 200), draw.randrange(900), 300) for _ in range(3000)]
    make_bam(tmp_path / "plain.bam", ["chr1", "chrM"], records)
    with gzip.open(tmp_path / "plain.bam") as f, open(tmp_path / "blocks.bam", "wb") as g:
        g.write(bgzf(f.read(), block))
    contigs = spark.createDataFrame([("chr1", 0, 1000), ("chrM", 1, 1000)], "chr string, chr_idx int, length bigint")
    whole = sorted(map(tuple, bam.read_bam(spark, str(tmp_path / "plain.bam"), "tumor", contigs).collect()))
    assert len(whole) == sum(r[0] >= 0 for r in records)
    for split in (1 << 30, 3000, 700):
        rows = bam.read_bam(spark, str(tmp_path / "blocks.bam"), "tumor", contigs, split)
        assert split > 1 << 20 or rows.rdd.getNumPartitions() > 5
        assert sorted(map(tuple, rows.collect())) == whole


def records_of(path):
    """All records of a BAM file, by a plain reader."""
    data = gzip.open(path).read()
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    n, at = struct.unpack_from("<i", data, at)[0], at + 4
    for _ in range(n):
        at += 8 + struct.unpack_from("<i", data, at)[0]
    out = []
    while at < len(data):
        size = struct.unpack_from("<i", data, at)[0] + 4
        out.append(data[at : at + size])
        at += size
    return out


def genome_bam(path, seed, n=6000):
    """Reads of three contigs, long deletions and reads without a place or a contig among them; small blocks."""
    import random

    draw = random.Random(seed)
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 3)
    for name in ("chr1", "chr2", "chrEmpty"):
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", 1 << 28)
    for i in range(n):
        ref = draw.choice([0, 0, 0, 1, 1, -1])
        pos = -1 if ref < 0 or draw.random() < 0.01 else draw.choice([draw.randrange(1 << 28), draw.randrange(40_000), 16_384, 1 << 20])
        ops = [(50, 0), (draw.choice([5, 5, 300_000]), 2), (7, 4), (43, 0)] if draw.random() < 0.3 else [(100, 0)] if draw.random() < 0.9 else []
        name = f"r{i}".encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 60, 0, len(ops), 67, 100, ref, pos, 300) + name + b"".join(struct.pack("<I", n << 4 | op) for n, op in ops) + bytes(150)
        out += struct.pack("<i", len(body)) + body
    path.write_bytes(bgzf(out, 3000))


def test_reads_are_sorted_into_files_with_indexes(spark, tmp_path, monkeypatch):
    """The same records in order, and filters that read only what the indexes name."""
    genome_bam(tmp_path / "a.bam", 1)
    genome_bam(tmp_path / "b.bam", 2, 500)
    monkeypatch.setattr(bam_sorted, "FULL", 3000)  # not in tasks, which have their own
    target = tmp_path / "sorted"
    cli.main(["sort-reads", str(tmp_path / "*.bam"), str(target), "--files", "5"], spark)
    files = sorted(target.glob("*.bam"))
    assert 3 <= len(files) <= 5 and not list(target.glob(".*")) and all((target / (f.name + ".bai")).exists() for f in files)
    got = [r for f in files for r in records_of(f)]
    place = lambda r: (lambda ref, pos: (ref < 0, ref, pos))(*struct.unpack_from("<ii", r, 4))
    want = records_of(tmp_path / "a.bam") + records_of(tmp_path / "b.bam")
    assert sorted(got) == sorted(want) and [place(r) for r in got] == sorted(map(place, want))
    assert all(bam_sorted.head_of(f)[0].startswith(b"@HD\tVN:1.6\tSO:coordinate\n") for f in files)
    with pytest.raises(FileExistsError):
        bam_sorted.sort_bam(spark, str(tmp_path / "a.bam"), str(target))
    with pytest.raises(FileNotFoundError):
        bam_sorted.sort_bam(spark, str(tmp_path / "none.bam"), str(target))

    whole = [(r["chr"], r["pos"]) for r in bam.scan(spark, str(tmp_path / "*.bam")).collect()]
    path = str(target / "*.bam")
    for where, keep in (
        ("chr = 'chr2'", lambda c, p: c == "chr2"),
        ("chr = 'chr1' and pos between 16384 and 16384", lambda c, p: c == "chr1" and p == 16384),
        ("chr in ('chr1', 'chrEmpty') and pos > 30000 and pos < 900000", lambda c, p: c == "chr1" and 30000 < p < 900000),
        ("pos >= 200000000", lambda c, p: p >= 200_000_000),
        ("pos < 20", lambda c, p: p < 20),
        ("pos = -1", lambda c, p: p == -1),
        ("chr = 'chrEmpty'", lambda c, p: False),
        ("chr = 'other' or pos = 1048576", lambda c, p: p == 1 << 20),
        ("chr = 'chr1' and chr <> 'chr2' and chr is not null and pos <= 1048576 and mapq >= 0", lambda c, p: c == "chr1" and p <= 1 << 20),
    ):
        assert sorted((r["chr"], r["pos"]) for r in bam.scan(spark, path).where(where).collect()) == sorted(x for x in whole if keep(*x)), where
    tasks = lambda where: bam.scan(spark, path, 4000).where(where).rdd.getNumPartitions()
    assert tasks("chr = 'chrEmpty'") == 1 < tasks("chr = 'chr2'") < tasks("mapq >= 0")
    contigs = spark.createDataFrame([("chr1", 0, 1 << 28)], "chr string, chr_idx int, length bigint")
    assert bam.read_bam(spark, path, "tumor", contigs, chrs=["chr1", "chr2"], start=10, end=30000).count() == sum(c == "chr1" and 10 <= p <= 30000 for c, p in whole)


@pytest.mark.parametrize("split", [1 << 30, 20_000, 1500])
def test_a_region_reads_only_its_blocks(tmp_path, monkeypatch, split):
    """Bytes counted: a contig's chunks are its share of the file, a place's some blocks; every chunk is read once."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

    genome_bam(tmp_path / "a.bam", 3)
    text_, refs = bam_sorted.head_of(tmp_path / "a.bam")
    monkeypatch.setattr(bam_sorted, "FULL", 3000)
    found = sorted(records_of(tmp_path / "a.bam"), key=lambda r: (r[7] > 127, *struct.unpack_from("<ii", r, 4)))
    index = bai.Index(3)
    with open(tmp_path / "s.bam", "wb") as f:
        out = bam_sorted.Blocks(f)
        out.write(b"BAM\1" + struct.pack("<i", len(text_)) + text_ + refs)
        for r in found:
            (ref, pos), begin = struct.unpack_from("<ii", r, 4), out.tell()
            out.write(r)
            index.add(ref, pos, pos + bam_sorted.span(r), begin, out.tell())
        out.close()
    size, read = (tmp_path / "s.bam").stat().st_size, []
    kept = bam.blocks

    def counted(f, at):
        for begin, data in kept(f, at):
            read.append(begin)
            yield begin, data

    monkeypatch.setattr(bam, "blocks", counted)

    def ask(*filters):
        reader = bam.BamReader({"path": str(tmp_path / "s.bam"), "split_bytes": str(split)})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        parts = reader.partitions()
        read.clear()
        rows = [(c, p) for x in parts for b in reader.read(x) for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        return len(parts), sorted(rows), len(read)

    n, whole, all_blocks = ask()
    (tmp_path / "s.bam.bai").write_bytes(index.to_bytes())
    assert vars(bai.Index.from_bytes(index.to_bytes())) == vars(index) and index.unplaced == sum(struct.unpack_from("<i", r, 4)[0] < 0 for r in found)
    n, rows, read_blocks = ask(EqualTo(("chr",), "chr2"))
    assert rows == [x for x in whole if x[0] == "chr2"] and read_blocks < (0.5 if split > 2000 else 2) * all_blocks and (n > 1) == (split < size)
    _, rows, read_blocks = ask(EqualTo(("chr",), "chr1"), GreaterThanOrEqual(("pos",), 100_000_000), LessThanOrEqual(("pos",), 110_000_000))
    inside = lambda x: x[0] == "chr1" and 100_000_000 <= x[1] <= 110_000_000
    assert [x for x in rows if inside(x)] == [x for x in whole if inside(x)] and len(rows) < 4 * sum(map(inside, whole)) and read_blocks < 0.2 * all_blocks
    assert ask(EqualTo(("chr",), "none"))[1:] == ([], 0)
    # reads at one place are one chunk of many blocks, cut where it is longer than a split
    n, rows, _ = ask(EqualTo(("chr",), "chr1"), EqualTo(("pos",), 16384))
    assert [x for x in rows if x[1] == 16384] == [x for x in whole if x == ("chr1", 16384)] and (split > 2000 or n > 3)


def test_bins_of_the_index():
    """Every read lies in a bin that a question over it asks."""
    import random

    draw = random.Random(4)
    for _ in range(3000):
        start = draw.randrange(bai.LONGEST - 1)
        end = min(bai.LONGEST, start + draw.choice([1, 100, 1 << 15, 1 << 22]))
        number = bai.bin_of(start, end)
        assert number < bai.LAST_BIN and bai.is_in(number, start, end) and bai.is_in(number, start, start + 1) and bai.is_in(number, max(0, end - 1), end)
    assert (bai.bin_of(0, 1), bai.bin_of(16384, 16385), bai.bin_of(16383, 16385), bai.bin_of(0, bai.LONGEST)) == (4681, 4682, 585, 0)
    at = lambda *x: [(a << 16, b << 16) for a, b in x]
    # chunks that overlap are read once, long ones are groups of their own
    assert bai.groups(at((0, 5), (3, 8), (4, 6), (8, 9), (20, 90), (90, 91)), 10) == [at((0, 9)), at((20, 90)), at((90, 91))]
    with pytest.raises(ValueError):
        bai.Index(1).add(0, bai.LONGEST, bai.LONGEST + 1, 0, 1)


@pytest.mark.parametrize("block", [40, 700, 20_000])
def test_lines_of_blocked_text_are_read_once(tmp_path, block):
    """Lines that blocks and splits cut anywhere, empty and very long ones, with and without an end."""
    import random

    draw = random.Random(block)
    for end in ("", "\n", "\n\n"):
        lines = ["x" * draw.choice([0, 1, 30, 30, 200, 3000 if draw.random() < 0.05 else 9]) + "é" * draw.randrange(3) + draw.choice(["", "", "\r"]) for _ in range(900)] + ["last"]
        (tmp_path / "a.gz").write_bytes(bgzf(("\n".join(lines) + end).encode(), block))
        want = [x.removesuffix("\r") for x in lines] + ([""] if end == "\n\n" else [])
        for split in (1 << 30, 5000, 1300, 300, 90):
            reader = blocked.BlockedReader({"path": str(tmp_path / "a.gz"), "split_bytes": str(split)})
            assert [x for p in reader.partitions() for b in reader.read(p) for x in b.column(0).to_pylist()] == want, (end, split)
    (tmp_path / "a.gz").write_bytes(bgzf(b"", 10))
    assert not [b for p in reader.partitions() for b in reader.read(p)]


def test_sites_in_blocks_equal_the_plain_file(spark, tmp_path):
    """A .vcf.gz in blocks is many tasks' work, and a BCF file in splits has the rows of one that is read as a whole."""
    from karyospark.sources import bcf

    row = "chr{}\t{}\t.\tA\tC\t.\tPASS\t.\tGT:DP:AD\t0/1:9:{},5\t0/1:9:6,{}\n"
    body = "##x\n#CHROM\n" + "".join(row.format(i % 3 + 1, i, i % 50, i % 7) for i in range(4000))
    put(tmp_path / "plain.vcf", body)
    (tmp_path / "b.vcf.gz").write_bytes(bgzf(body.encode(), 5000))
    want = sorted(map(tuple, text.read_calls(spark, str(tmp_path / "plain.vcf")).collect()))
    assert sorted(map(tuple, text.read_calls(spark, str(tmp_path / "b.vcf.gz")).collect())) == want and len(want) == 4000
    lines = blocked.read_lines(spark, str(tmp_path / "b.vcf.gz"), 1500)
    assert lines.rdd.getNumPartitions() >= 16 and sorted(r[0] for r in lines.collect()) == sorted(body.splitlines())

    head = "##contig=<ID=chr1>\n##contig=<ID=chr2>\n##contig=<ID=chr3>\n##FORMAT=<ID=GT,Number=1>\n##FORMAT=<ID=AD,Number=R>\n#CHROM\n"
    raw = b"BCF\2\2" + struct.pack("<I", len(head) + 1) + head.encode() + b"\0"
    gt, ad = (1, 2)  # after PASS
    for i in range(4000):
        site = struct.pack("<iiifI", i % 3, i - 1, 1, 0.0, 2 << 16) + struct.pack("<I", 2 << 24 | 2) + b"\x07\x17A\x17C\x00"
        own = bytes([0x11, gt, 0x21, 2, 4, 2, 4]) + bytes([0x11, ad, 0x21, i % 50, 5, 6, i % 7])
        raw += struct.pack("<II", len(site), len(own)) + site + own
    for block in (100, 3000):
        (tmp_path / "b.bcf").write_bytes(bgzf(raw, block))
        for split in (1 << 30, 4000, 900):
            rows = bcf.read_bcf(spark, str(tmp_path / "b.bcf"), split)
            assert sorted(map(tuple, rows.collect())) == want, (block, split)
            assert (rows.rdd.getNumPartitions() >= 5) == (split < 1 << 20)
    (tmp_path / "b.bcf").write_bytes(bgzf(raw[: 9 + len(head) + 1], 3000))
    assert bcf.read_bcf(spark, str(tmp_path / "b.bcf")).count() == 0


def test_fasta_of_many_splits(spark, tmp_path):
    import random

    draw = random.Random(4)
    seqs = {f"chr{i}": "".join(draw.choice("ACGTN") for _ in range(draw.choice((0, 1, 50, 700)))) for i in range(12)}
    text_of = lambda names: "".join(f">{n} about {n}\n" + "".join(seqs[n][i : i + 60] + "\n" for i in range(0, len(seqs[n]), 60)) for n in names)
    (tmp_path / "fa").mkdir()
    put(tmp_path / "fa" / "a.fa", text_of(list(seqs)[:7]))
    put(tmp_path / "fa" / "b.fa", text_of(list(seqs)[7:]))
    sizes = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1"}
    for split in (False, True):
        old = {k: spark.conf.get(k) for k in sizes}
        for k, v in sizes.items() if split else ():
            spark.conf.set(k, v)
        try:
            got = {}
            for r in text.read_fasta(spark, str(tmp_path / "fa"), piece=100).orderBy("chr", "start").collect():
                assert r["start"] == len(got.get(r["chr"], ""))
                got[r["chr"]] = got.get(r["chr"], "") + r["bases"]
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
        assert got == {n: s for n, s in seqs.items() if s}


def test_round_trips(spark, tmp_path, capsys):
    got, truth = simulate.demo(spark, 0.7, n_contigs=4)
    sinks.write_inference(got, str(tmp_path / "out"))
    assert {"auto", "peaks", "summary", "calls"} <= set(frames.frames(got))
    truth.where("not (cp = 2 and major = 1)").selectExpr("concat('chr', chr_id) chr", "start", "end", "cp", "major").write.option("sep", "\t").csv(str(tmp_path / "truth"))
    cli.main(["recall-precision", str(tmp_path / "truth"), str(tmp_path / "out/cnv.output.tsv"), str(tmp_path / "rp")], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["cp_recall"] > 0.7
    segs = spark.createDataFrame([(0, 1, 500, 1.0, 0.1, 1)], "chr_idx int, start bigint, end bigint, ratio double, stddev double, n_windows bigint")
    sinks.write_segments(segs, str(tmp_path / "segs"))
    assert [tuple(r) for r in text.read_segments(spark, str(tmp_path / "segs")).collect()] == [(0, 1, 500, 1.0, 0.1, 1)]
    ratio = spark.createDataFrame([(2, 1, 0.9, 1.0, 1.0, 1.0, 1.0)], "chr_idx int, start bigint, coverage_ratio double, coverage_tumor double, coverage_tumor_adj double, coverage_normal double, coverage_normal_adj double")
    sinks.write_ratio(ratio, str(tmp_path / "ratio"))
    assert [tuple(r) for r in text.read_ratio(spark, str(tmp_path / "ratio/*")).collect()] == [(2, 1, 0.9)]
    assert frames.genome_plot(got.calls, spark.createDataFrame([("chr1", 0, 30_000_000)], "chr string, chr_idx int, length bigint")).count() > 0
    assert isinstance(frames.subclones(got), list)


def read_gz(folder):
    return "".join(gzip.open(p, "rt").read() for p in sorted(folder.rglob("*.gz")))


def test_texts_of_an_inference(spark, tmp_path):
    """Totals, intervals, the summary and the models as files, and the readers of the last two."""
    got, _ = simulate.demo(spark, 0.7, n_contigs=4)
    sinks.write_inference(got, str(tmp_path))
    lines = next((tmp_path / "cnv.output.tsv").glob("part-*")).read_text().splitlines()
    assert lines[0].split("\t") == list(sinks.CALLS) and [x.split("=")[0] for x in lines[-4:]] == ["#genome_len_cnv_all", "#genome_len_clonal", "#ploidy_cnv_all", "#ploidy_clonal"]
    rows = [x.split("\t") for x in lines[1:-4]]
    assert len(rows) == got.calls.count() and rows == sorted(rows, key=lambda r: (int(r[0]), int(r[1])))
    assert next((tmp_path / "cnv.interval.tsv").glob("part-*")).read_text().splitlines()[0].split("\t") == list(sinks.INTERVALS)
    told = text.read_summary(spark, str(tmp_path / "infer.out.tsv"))
    assert told["purity"] == pytest.approx(got.best.purity, rel=1e-4) and told["period"] == got.best.period and told["no_of_segments"] == got.n_segments
    models = text.read_models(spark, str(tmp_path / "models"))
    assert models.where("selected").count() == got.models.where("models is not null").count() > 10 and models.first()["segment"].startswith("chr")
    for name in ("rc_log", "snp_log", "sub_peaks"):
        assert spark.read.parquet(str(tmp_path / name)).columns
    assert frames.plot_limits(got.calls).first()["highest"] is None  # all segments of this genome are short
    assert frames.histogram_plot(got.density).where("density = 0").count() == 0


def test_other_files(spark, tmp_path):
    from karyospark.operators import gc

    blocks = gc.gc_blocks(gc.pieces(spark.createDataFrame([("a", "GCatgN"), ("b", "GGGGGGGGG")], "chr string, seq string")), (1, 5), 4)
    sinks.write_gc_index(blocks, str(tmp_path / "gc"))
    assert list((tmp_path / "gc" / "a.gc5.bi").read_bytes()) == [3, 2, 1, 1, 1, 0] and list((tmp_path / "gc" / "b.gc1.bi").read_bytes()) == [1] * 9
    segs = spark.createDataFrame([(0, 1, 500, 1.0, 0.1, 1), (2, 1, 500, 1.0, 0.1, 1)], "chr_idx int, start bigint, end bigint, ratio double, stddev double, n_windows bigint")
    sinks.write_segments(segs, str(tmp_path / "split"), by_contig=True)
    assert sorted(p.name for p in (tmp_path / "split").glob("contig=*")) == ["contig=chr1", "contig=chr3"]
    names = "commit_id string, sample_class string, true_purity double, true_ploidy double, est_purity double, est_ploidy double, cp_recall double, cp_precision double, mcp_recall double, mcp_precision double, period double, first_peak_int double, likelihood double"
    for purity in (0.52, 0.6):
        sinks.append_results(spark.createDataFrame([("c1", "a", 0.5, 2.0, purity, 2.1, 0.9, 0.9, 0.8, 0.7, 300.0, 250.0, 1.0)], names), str(tmp_path / "results"))
    rows = text.read_history(spark, str(tmp_path / "results"))
    assert sorted(round(r["delta_purity"], 6) for r in rows.collect()) == [0.02, 0.1]
    from karyospark.operators.evaluate import gated

    assert sorted(r["passed"] for r in gated(rows).collect()) == [False, True]
    assert [r["true_purity"] for r in frames.history_plot(rows).collect()] == [0.5, 0.5]
    sinks.write_ploidy(simulate.simulated_ploidy(spark.createDataFrame([(0, 10, 3, 1.0)], "start bigint, end bigint, copy_number int, proportion double")), str(tmp_path / "ploidy"))
    assert read_gz(tmp_path / "ploidy").startswith("CNA_length\thaploid_length\tploidy\n20.0")
    plot = put(tmp_path / "t.tsv", "chr\tstart\tend\tcp\tmajor\nchr1\t1\t9\t3\tNA\nchrX\t1\t9\t3\t2\n7\t1\t9\t2\t1\n")
    assert [(r["chr"], r["is_clonal"]) for r in text.read_for_plot(spark, plot).orderBy("chr").collect()] == [("7", True), ("chr1", False)]
    reads = spark.createDataFrame([("r1", "ACGT", "IIII")], "name string, seq string, qual string")
    assert sorted(r["name"] for r in simulate.mixed(reads, reads).collect()) == ["normal_r1", "tumor_r1"]
    snps = spark.createDataFrame([(10, 7, 3), (10, 2, 8), (0, 0, 0)], "tumor_depth int, tumor_ro int, tumor_ao int")
    assert sorted(map(tuple, frames.maf_plot(snps).collect())) == [(70, 1), (80, 1)]
    contigs = spark.createDataFrame([("a", 0, 6)], "chr string, chr_idx int, length bigint")
    ratio = spark.createDataFrame([(0, 1, 1.5), (0, 4, 0.5)], "chr_idx int, start bigint, coverage_ratio double")
    got = frames.gc_plot(ratio, gc.gc_windows(gc.pieces(spark.createDataFrame([("a", "GCatgN")], "chr string, seq string")), (5,)), contigs, 3)
    assert sorted(map(tuple, got.collect())) == [(5, 1, 1, 0.5), (5, 3, 1, 1.5)]


def test_the_whole_workflow_as_a_command(spark, tmp_path, capsys):
    import random

    draw = random.Random(1)
    for name in ("tumor", "normal"):
        make_bam(tmp_path / f"{name}.bam", ["chr1", "chr2"], [(draw.randrange(2), p := draw.randrange(60_000), 60, 67, 100, p + 200, 300) for _ in range(3000)])
    put(tmp_path / "ref.dict", "@SQ\tSN:chr1\tLN:60500\n@SQ\tSN:chr2\tLN:60500\n")
    row = "chr{}\t{}\t.\tA\tC\t.\tPASS\t.\tGT:AD\t0/1:{},{}\t0/1:{},{}\n"
    put(tmp_path / "v.vcf", "".join(row.format(c, p, *[draw.randrange(8, 30) for _ in range(4)]) for c in (1, 2) for p in range(100, 60_000, 150)))
    put(tmp_path / "configure", "read_length\t100\nwindow_size\t500\nref\t/r\nsam\ts\ncaller\tc\nbin\tb\n")
    arguments = [str(tmp_path / x) for x in ("configure", "tumor.bam", "normal.bam", "v.vcf", "ref.dict", "out")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        cli.main(["run", *arguments, "--nCores", "4", "--clean"], spark)
        first = capsys.readouterr().out.splitlines()[-1]
        cli.main(["run", *arguments, "--nCores", "4", "-s", "4"], spark)
        assert capsys.readouterr().out.splitlines()[-1] == first and "status" in json.loads(first)
        notes = gzip.open(tmp_path / "out/report/ratio/chr1.ratio.w500.csv.gz", "rt").read().splitlines()[:11]
        assert [x[0] for x in notes] == ["#"] * 10 + ["s"]  # a run that goes on later has them too
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    cli.main(["normalize", str(tmp_path / "tumor.bam"), str(tmp_path / "normal.bam"), str(tmp_path / "ref.dict"), str(tmp_path / "ratio"), "--debug"], spark)
    one = gzip.open(tmp_path / "ratio" / "chr1.ratio.w500.csv.gz", "rt").read().splitlines()
    assert sorted(p.name for p in (tmp_path / "ratio").iterdir()) == ["chr1.ratio.w500.csv.gz", "chr2.ratio.w500.csv.gz"]
    assert [x.split(":")[0] for x in one[:10]] == [f"#{k}" for k in ("chr", "chromosome_len", "window_size", "no_of_windows", "no_of_fragments_tumor", "coverage_per_base_tumor", "no_of_fragments_normal", "coverage_per_base_normal", "genome-wide-coverage-mean-tumor", "genome-wide-coverage-mean-normal")]
    assert one[0] == "#chr: chr1" and one[3] == "#no_of_windows: 121" and one[10] == "start,coverage_ratio,coverage_tumor,coverage_tumor_adj,coverage_normal,coverage_normal_adj"
    starts = [int(x.split(",")[0]) for x in one[11:]]
    assert starts == sorted(starts) and len(starts) > 50
    assert text.read_ratio(spark, str(tmp_path / "ratio/*")).where("chr_idx = 0").count() == len(starts)


def test_published_files(spark, tmp_path):
    """Files appear at commit only, replace those of their name, and equal rows give equal bytes; a failure leaves nothing."""
    from pyspark.sql import functions as F

    from karyospark.sources.published import publish

    rows = spark.range(0, 10_000, 1, 7).withColumn("name", F.concat(F.lit("f"), F.col("id") % 5, F.when(F.col("id") % 5 < 2, ".txt.gz").otherwise(".txt")))
    line = F.encode(F.concat(F.col("id").cast("string"), F.lit("\n")), "UTF-8")
    held = []
    for order in (F.col("id"), F.col("id"), -F.col("id")):
        publish(rows, F.col("name"), line, [order], str(tmp_path))
        assert sorted(p.name for p in tmp_path.iterdir()) == ["f0.txt.gz", "f1.txt.gz", "f2.txt", "f3.txt", "f4.txt"]
        held.append({p.name: p.read_bytes() for p in tmp_path.iterdir()})
    assert held[0] == held[1] != held[2] and gzip.decompress(held[0]["f1.txt.gz"]).split() == [b"%d" % i for i in range(1, 10_000, 5)]
    assert held[2]["f3.txt"].split() == [b"%d" % i for i in range(9998, 0, -5)]
    late = F.when(F.col("id") == 9_999, F.raise_error(F.lit("late"))).otherwise(line).cast("binary")
    for name, value in ((F.col("name"), late), (F.concat(F.lit("../"), "name"), line)):
        with pytest.raises(Exception):
            publish(rows, name, value, [F.col("id")], str(tmp_path))
        assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == held[2]
    publish(rows.limit(0), F.col("name"), line, [], str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_stream(spark, tmp_path):
    from karyospark import adapters
    from karyospark.operators.coverage import spans, valid_fragments, window_counts
    from karyospark.streaming.coverage import start_counts

    rows = adapters.reads(spark, "/root/testdata/sf0.001")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = start_counts(stream, adapters.read_contigs(spark), "counts_so_far", str(tmp_path / "check"), adapters.READ_PARAMS)
    q.processAllAvailable()
    q.stop()
    want = window_counts(spans(valid_fragments(rows, adapters.READ_PARAMS), adapters.read_contigs(spark), adapters.READ_PARAMS))
    assert sorted(map(tuple, spark.table("counts_so_far").collect())) == sorted(map(tuple, want.collect()))
