import struct
import zlib

from graftline import schemas
from graftline.plans.relational import table
from graftline.sources import bam, files
from graftline.streaming.evidence import stream_site_counts, windowed_event_counts

SAM = """@HD\tVN:1.0
@SQ\tSN:chr1\tLN:1000
r1\t99\tchr1\t11\t60\t5S5M\t=\t21\t20\tACGTACGTAC\tIIIIIIIIII\tNM:i:1\tMD:Z:5\tAS:i:42
r1\t147\tchr1\t21\t60\t10M\t=\t11\t-20\tTTTTTTTTTT\t5555555555\tNM:i:0
r1\t355\tchr1\t31\t0\t10M\t=\t11\t0\t*\t*
r2\t77\t*\t0\t0\t*\t*\t0\t0\tGG\t!!
r2\t141\t*\t0\t0\t*\t*\t0\t0\tCC\t!!
"""


def test_sam(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(SAM)
    got = files.read_sam(spark, str(path), "s").collect()
    r = got[0]
    assert (r.contig, r.ref_start, r.ref_end, r.nm, r.md, r.as_score, r.is_reverse, r.quals[0]) == ("chr1", 10, 15, 1, "5", 42, False, 40)
    assert [tuple(x) for x in r.cigar] == [("S", 5), ("M", 5)] and got[3].is_unmapped and got[3].contig is None and got[2].seq is None
    assert files.read_contigs(spark, str(path)).select("contig", "length").collect() == [("chr1", 1000)]
    files.write_sam(files.read_sam(spark, str(path), "s"), str(tmp_path / "y.sam"), files.read_contigs(spark, str(path)))
    again = files.read_sam(spark, str(tmp_path / "y.sam"), "s").collect()
    key = lambda r: (r.read_name, r.flag)
    assert sorted(again, key=key) == sorted(got, key=key) and [r.ref_start for r in again[:3]] == [10, 20, 30]
    assert files.read_contigs(spark, str(tmp_path / "y.sam.header")).select("contig", "length").collect() == [("chr1", 1000)]
    made = {(x.read_name, x.flag): x for x in files.format_alignments(files.read_sam(spark, str(path), "s")).collect()}
    assert set(made) == {("r1", 99), ("r1", 147)}
    assert made["r1", 99].mate_seq == "T" * 10 and made["r1", 99].mate_quals == "5" * 10 and made["r1", 147].mate_seq == "ACGTACGTAC"
    files.write_alignments(files.read_sam(spark, str(path), "s"), str(tmp_path / "a.parquet"))
    assert spark.read.parquet(str(tmp_path / "a.parquet")).count() == 5


def as_bam(sam):
    lines = [x for x in sam.splitlines() if x]
    text = "".join(x + "\n" for x in lines if x.startswith("@")).encode()
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for x in lines:
        if x.startswith("@"):
            continue
        f = x.split("\t")
        ops = [] if f[5] == "*" else [int(n) << 4 | "MIDNSHP=X".index(o) for n, o in __import__("re").findall(r"(\d+)(\D)", f[5])]
        seq = "" if f[9] == "*" else f[9]
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
        packed = bytes(codes[k] << 4 | codes[k + 1] for k in range(0, len(seq), 2))
        quals = bytes(ord(c) - 33 for c in f[10]) if f[10] != "*" else b"\xff" * len(seq)
        tags = b""
        for t in f[11:]:
            name, kind, value = t.split(":", 2)
            tags += name.encode() + (b"i" + struct.pack("<i", int(value)) if kind == "i" else b"Z" + value.encode() + b"\0")
        ref = 0 if f[2] == "chr1" else -1
        rec = struct.pack("<iiBBHHHiiii", ref, int(f[3]) - 1, len(f[0]) + 1, int(f[4]), 0, len(ops), int(f[1]), len(seq), 0 if f[6] == "=" else -1, int(f[7]) - 1, int(f[8]))
        rec += f[0].encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + quals + tags
        out += struct.pack("<i", len(rec)) + rec
    blocks = b""
    for a in range(0, len(out), 100):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        blocks += c.compress(out[a : a + 100]) + c.flush()
    return blocks


def test_bam_equals_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    (tmp_path / "x.bam").write_bytes(as_bam(SAM))
    want = files.read_sam(spark, str(tmp_path / "x.sam"), "s").collect()
    assert bam.read_bam(spark, str(tmp_path / "x.bam"), "s", rows=2).collect() == want


def test_fasta_and_lists(spark, tmp_path):
    path = tmp_path / "x.fna"
    path.write_text(">c1 some words\nACGT\nAC\n>c2\n\n>c3\nTT")
    got = files.read_fasta(spark, str(path))
    assert sorted(map(tuple, got.collect())) == [("c1", "ACGTAC"), ("c2", ""), ("c3", "TT")]
    files.write_fasta(got, str(tmp_path / "out.fna"))
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "out.fna")).collect())) == sorted(map(tuple, got.collect()))
    listing = tmp_path / "list.txt"
    listing.write_text(f"{path}\n{path}\n")
    assert files.read_path_list(spark, [str(listing)]) == [str(path)] * 2
    assert files.read_path_list(spark, [str(path)]) == [str(path)]


def test_tsv_keeps_words_that_look_null(spark, tmp_path):
    rows = [("NA", 1, "m", "", 2, "NA"), ("007", 2, "m", "x:1-2", 3, "ACG")]
    df = spark.createDataFrame(rows, schemas.INFERRED)
    files.write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "t"), schemas.INFERRED).collect())) == sorted(rows)


def test_cluster_listing(spark, tmp_path):
    (tmp_path / "c").write_text(">Cluster 0\n0\t10nt, >a... *\n1\t9nt, >b... at +/90%\n>Cluster 1\n0\t5nt, >c... *\n")
    assert sorted(map(tuple, files.parse_clusters(spark.read.text(str(tmp_path / "c"))).collect())) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.sam").write_text(SAM)
    rows = files.parse_sam(spark.readStream.text(str(tmp_path / "in")), "s")
    q = stream_site_counts(rows).writeStream.outputMode("complete").format("memory").queryName("sites").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select pos, orient, softclip_count, reads from sites").collect()
    assert [tuple(r) for r in got] == [(9, "3p", 1, 1)]
    sf = "/root/testdata/sf0.001"
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(sf + "/events*.parquet")
    q = windowed_event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from windows").first()[0] == events.count()


def test_long_path_list(spark, tmp_path):
    one = tmp_path / "a.sam"
    one.write_text("x\n")
    listing = tmp_path / "list.txt"
    listing.write_text(f"{one}\n" * 100_001)
    assert len(files.read_path_list(spark, [str(listing)])) == 100_001


def bgzf(data, size):
    """Blocks as the usual writers make them, with an empty one at the end."""
    out = b""
    for a in [*range(0, len(data), size), None]:
        part = data[a : a + size] if a is not None else b""
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += bam._BLOCK + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam_in_splits(spark, tmp_path):
    """A file far larger than a split, and blocks that end anywhere in a record, give every record once."""
    import random

    rng = random.Random(3)
    lines = []
    for k in range(3000):
        n = rng.choice([5, 30, 100, 300])
        seq = "".join(rng.choices("ACGT", k=n))
        lines.append(f"read{k}\t{rng.choice([0, 16, 99])}\tchr1\t{rng.randint(1, 900)}\t60\t{n}M\t=\t{rng.randint(1, 900)}\t0\t{seq}\t{'I' * n}\tNM:i:{k % 7}\tMD:Z:{n}")
    sam = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n" + "\n".join(lines) + "\n"
    raw = b"".join(bam.inflate(as_bam(sam)))
    (tmp_path / "x.sam").write_text(sam)
    want = sorted(files.read_sam(spark, str(tmp_path / "x.sam"), "s").collect(), key=lambda r: r.read_name)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, split in ((700, 20_000), (60_000, 30_000), (5_000, 1 << 27)):
            path = tmp_path / f"x{size}.bam"
            path.write_bytes(bgzf(raw, size))
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = bam.read_bam(spark, str(path), "s")
            assert sorted(got.collect(), key=lambda r: r.read_name) == want
            assert bam.read_contigs(spark, str(path)).collect() == [("chr1", 1000, 0)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(list(tmp_path.glob("*.bam"))) == 3


def test_headers_with_marks(spark, tmp_path):
    """Only a mark that begins a line begins a record."""
    path = tmp_path / "x.fna"
    path.write_text(">c1 gene A>B fusion\nACGT\r\nAC>GT\n>c2>x\nTT\n")
    assert sorted(map(tuple, files.read_fasta(spark, str(path)).collect())) == [("c1", "ACGTAC>GT"), ("c2>x", "TT")]


def test_assembler_and_repeat_files(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "ACG", [40, 2, 7]), ("r2", "TT", None)], "name string, seq string, quals array<int>")
    files.write_fasta_with_quals(rows, str(tmp_path / "reads"))
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "reads.seq")).collect())) == [("r1", "ACG"), ("r2", "TT")]
    text = "\n".join(sorted(r.value for r in spark.read.text(str(tmp_path / "reads.qual")).collect()))
    assert text == "0 0\n40 2 7\n>r1\n>r2"
    (tmp_path / "arms").write_text(">p_1_3_17\nACGT\nAC\n>p_1_60_74\nGT\n>p_2_1_4\nAAAA\n>p_2_9_12\nTTTT\n")
    got = sorted(map(tuple, files.parse_repeat_arms(spark.read.text(str(tmp_path / "arms"))).collect()))
    assert got == [("p_1", 3, 17, "ACGTAC", 60, 74, "GT"), ("p_2", 1, 4, "AAAA", 9, 12, "TTTT")]


def test_sam_lines_are_made_before_they_are_sorted(spark, tmp_path, monkeypatch):
    """What is sorted is a line, not its arrays; files may be compressed."""
    from graftline.plans import domain

    plans = []
    kind, by = type(spark.range(1)), type(spark.range(1)).orderBy
    monkeypatch.setattr(kind, "orderBy", lambda df, *c: plans.append(df.columns) or by(df, *c))
    rows = domain.alignments(spark, "/root/testdata/sf0.001").limit(300).cache()
    files.write_sam(rows, str(tmp_path / "x"), compression="gzip")
    assert plans and "value" in plans[0] and "quals" not in plans[0] and "cigar" not in plans[0]
    assert list((tmp_path / "x").glob("*.gz"))
    lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "x")).collect()]
    places = [(x[2], int(x[3]), x[0], int(x[1])) for x in lines]
    assert len(lines) == 300 and sorted(map(str, lines)) == sorted(str(r.value.split("\t")) for r in files.sam_lines(rows).collect())
    one = [(r.value.split("\t")[2], int(r.value.split("\t")[3]), r.value.split("\t")[0], int(r.value.split("\t")[1])) for f in sorted((tmp_path / "x").glob("*.gz")) for r in spark.read.text(str(f)).collect()]
    assert one == sorted(places)


def test_qualities_of_a_batch_are_those_of_its_rows(spark):
    """Qualities and their texts are turned at once; nulls, empty and odd ones stay what they are."""
    from graftline.functions import sequence
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("!5I~", [0, 40, 93]), ("", []), (None, None), ("é5", [20]), ("II", [30, 31])], "t string, q array<int>").coalesce(1)
    odd = spark.createDataFrame([("~", [200, -33, -40, None, 10])], "t string, q array<int>")
    for rows in (df, odd):
        got = rows.select(files._qualities(F.col("t")).alias("q"), files._quality_text(F.col("q")).alias("t")).collect()
        assert got == rows.select(sequence.phred("t").alias("q"), sequence.phred_string("q").alias("t")).collect()
