import os
import random

import pytest
from graftline.schemas import ALIGNMENTS
from graftline.sources import bam, indexed
from pyspark.sql import functions as F

CONTIGS = [("b", 400_000), ("a", 90_000), ("empty", 10)]


def rows(n, seed=1):
    rng, out = random.Random(seed), []
    for k in range(n):
        contig, length = CONTIGS[0] if rng.random() < 0.7 else CONTIGS[1]
        start = rng.randrange(length - 70_000) if k % 50 else rng.randrange(length - 80_000)
        ops = [("M", 20), ("N", 70_000), ("M", 10)] if k % 50 == 0 else rng.choice([[("M", 30)], [("S", 4), ("M", 20), ("I", 2), ("M", 4)], [("M", 10), ("D", 900), ("M", 20)]])
        size = sum(x for o, x in ops if o in "MIS")
        span = sum(x for o, x in ops if o in "MDN")
        quals = None if k % 17 == 0 else [rng.randint(0, 40) for _ in range(size)]
        out.append(("s", f"r{k}", 64, contig, start, start + span, rng.randint(0, 60), k % 3 == 0, False, k % 5 == 0, ops, "".join(rng.choices("ACGTN", k=size)), quals, str(span), k % 4, -k, "ACGT" if k % 5 == 0 else None, "!5I~" if k % 5 == 0 else None))
    out += [("s", "placed", 4, "a", 500, 500, 0, False, True, False, [], "ACG", [1, 2, 3], None, None, None, None, None), ("s", "nowhere", 4, None, -1, -1, 0, False, True, True, [], None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    df = spark.createDataFrame(rows(3000), ALIGNMENTS)
    path = str(tmp_path_factory.mktemp("bam") / "x")
    contigs = spark.createDataFrame([(c, n, k) for k, (c, n) in enumerate(CONTIGS)], "contig string, length int, number int")
    indexed.write_bam(df.repartition(5), path, contigs, files=4)
    return df, path


def key(r):
    return str(tuple(r))


def plain(df):
    return sorted((tuple(r) for r in df.select(*[c for c in df.columns if c not in ("flag", "quals")], F.coalesce(F.array_join("quals", ","), F.lit("")).alias("q"), F.col("flag").bitwiseAND(64)).collect()), key=str)


def test_bins():
    rng = random.Random(3)
    for _ in range(3000):
        a = rng.randrange(1 << 29)
        b = min(1 << 29, a + rng.choice([0, 1, 100, 20_000, 500_000, 1 << 25]))
        x = rng.randrange(1 << 29)
        y = min(1 << 29, x + rng.choice([1, 300, 40_000]))
        if x < max(b, a + 1) and y > a:  # what overlaps is always in one of the bins looked through
            assert indexed.bin_of(x, y) in set(indexed.bins_over(a, b))
    assert indexed.bin_of(0, 1) == 4681 and indexed.bin_of(0, 1 << 29) == 0 and indexed.bin_of(16383, 16385) == 585


def test_index_round_trip():
    index = indexed.Index(2)
    for k in range(300):
        index.add(k // 200, k % 200 * 700, k % 200 * 700 + 50, k << 16, (k + 1) << 16)
    again = indexed.Index.load(index.dump())
    assert again.bins == index.bins and again.first == index.first
    assert index.chunks(0, 10**8, 10**8 + 5) == [] and index.chunks(1, 0, 10**6) != []


def test_written_and_read_back(spark, table):
    df, path = table
    back = indexed.read_indexed(spark, path, "s")
    assert plain(back) == plain(df)
    files = sorted(f for f in os.listdir(path) if f.endswith(".bam"))
    assert len(files) > 1 and not os.path.exists(f"{path}/_temporary")
    one = f"{path}/{files[0]}"  # each file is a whole BAM file for any other reader
    assert plain(bam.read_bam(spark, one, "s")) == plain(indexed.read_indexed(spark, one, "s"))


def regions_of(df, regions):
    hit = F.lit(False)
    for c, a, b in regions:
        hit = hit | ((F.col("contig") == c) & (F.col("ref_start") < b) & (F.col("ref_end") > a))
    return df.filter(hit)


@pytest.mark.parametrize("regions", [[("b", 1000, 1300)], [("a", 0, 10**9)], [("b", 0, 10), ("b", 5, 900), ("a", 450, 501)], [("b", 72_000, 72_001)], [("empty", 0, 10), ("nosuch", 0, 9)], []])
def test_regions_equal_a_filter(spark, table, regions):
    df, path = table
    assert plain(indexed.read_indexed(spark, path, "s", regions)) == plain(regions_of(df, regions))


def test_a_region_reads_its_chunks_only(table):
    _, path = table
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".bam"))
    reader = indexed._Reader({"path": path, "regions": '[["b", 5000, 5100]]'})
    parts = reader.partitions()
    got = [r for p in parts for r in reader.read(p)]
    assert len({p.path for p in parts}) < len([f for f in os.listdir(path) if f.endswith(".bam")])
    assert got and 0 < reader.read_bytes < size
    whole = indexed._Reader({"path": path})
    n = sum(1 for p in whole.partitions() for _ in whole.read(p))
    assert n == 3002 and reader.read_bytes < whole.read_bytes


def test_one_large_file_reads_few_blocks(tmp_path):
    """20,000 records in one file of many blocks: a region reads a small part of it."""
    rng = random.Random(6)
    writer = indexed._Writer({"path": str(tmp_path / "big"), "contigs": '[["c", 400000]]'}, True)
    import pyarrow as pa

    starts = sorted(rng.randrange(300_000) for _ in range(20_000))
    data = [{"read_name": f"r{k}", "flag": 0, "contig": "c", "ref_start": s, "ref_end": s + 50, "mapq": 9, "is_reverse": False, "is_unmapped": False, "mate_is_unmapped": False, "cigar": [{"op": "M", "len": 50}], "seq": "".join(rng.choices("ACGT", k=50)), "quals": [rng.randint(2, 40) for _ in range(50)], "md": "50", "nm": 0, "as_score": 50, "mate_seq": None, "mate_quals": None} for k, s in enumerate(starts)]
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(data)]))])
    reader = indexed._Reader({"path": str(tmp_path / "big"), "regions": '[["c", 200000, 200100]]'})
    got = sum(1 for p in reader.partitions() for _ in reader.read(p))
    size = sum(os.path.getsize(tmp_path / "big" / f) for f in os.listdir(tmp_path / "big") if f.endswith(".bam"))
    assert got == sum(s < 200_100 and s + 50 > 200_000 for s in starts)
    assert reader.read_bytes < size / 4


def test_filters_are_pushed(spark, table):
    df, path = table
    spark.dataSource.register(indexed.IndexedBam)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows_ = spark.read.format(indexed.FORMAT).option("pushdown", "true").load(path).filter("contig = 'b' and ref_start < 9000 and ref_end > 8000")
        assert rows_.count() == regions_of(df, [("b", 8000, 9000)]).count() > 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    reader = indexed._PushedReader({"path": path})
    assert len(list(reader.pushFilters([EqualTo(("contig",), "b"), LessThan(("ref_start",), 9000), GreaterThan(("ref_end",), 8000)]))) == 3
    assert reader._wanted(["b", "a"]) == {0: [(8000, 9000)]}


def test_lost_and_repeated_attempts_leave_nothing(tmp_path):
    """Only files that a commit names stay: of two attempts of a task one; an aborted run leaves the table as it was."""
    import pyarrow as pa

    row = {"read_name": "r", "flag": 0, "contig": "c", "ref_start": 5, "ref_end": 8, "mapq": 9, "is_reverse": False, "is_unmapped": False, "mate_is_unmapped": False, "cigar": [{"op": "M", "len": 3}], "seq": "ACG", "quals": [1, 2, 3], "md": "3", "nm": 0, "as_score": 3, "mate_seq": None, "mate_quals": None}
    path = str(tmp_path / "t")
    write = lambda w: w.write(iter([pa.RecordBatch.from_pylist([row])]))
    first = indexed._Writer({"path": path, "contigs": '[["c", 100]]'}, True)
    write(first)  # an attempt that was lost
    first.commit([write(first), None])
    assert len([f for f in os.listdir(path) if f.endswith(".bam")]) == 1
    second = indexed._Writer({"path": path, "contigs": '[["c", 100]]'}, True)
    second.abort([write(second)])
    names = sorted(os.listdir(path))
    assert len([f for f in names if f.endswith(".bam")]) == 1 and "_manifest.json" in names
    reader = indexed._Reader({"path": path})
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 1


def test_order_and_contigs_are_checked(spark, tmp_path):
    df = spark.createDataFrame(rows(5), ALIGNMENTS)
    with pytest.raises(Exception, match="no such contig"):
        indexed.write_bam(df, str(tmp_path / "x"), spark.createDataFrame([("zzz", 5)], "contig string, length int"))
    none = str(tmp_path / "none")
    indexed.write_bam(df.limit(0), none, spark.createDataFrame([("a", 5)], "contig string, length int"))
    assert indexed.read_indexed(spark, none, "s").count() == 0 and indexed.read_indexed(spark, none, "s", [("a", 0, 5)]).count() == 0


def test_records_of_a_batch_are_those_of_its_rows():
    """Records are made before rows are sorted, of all rows of a batch at once, byte for byte those of single rows."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, number = to_arrow_schema(ALIGNMENTS), {c: k for k, (c, _) in enumerate(CONTIGS)}
    some = [{n: [{"op": o, "len": x} for o, x in v] if n == "cigar" else v for n, v in zip(schema.names, r, strict=True)} for r in rows(300)]
    some += [dict(some[0], read_name=None, mapq=None, flag=None, cigar=None), dict(some[1], read_name="\u00e9", quals=[1]), dict(some[2], seq=None, quals=None)]
    at = np.array([number[r["contig"]] if r["contig"] else -1 for r in some])
    batch = pa.RecordBatch.from_pylist(some, schema=schema)
    for part, own, k in ((batch, some, at), (batch.slice(7, 90), some[7:97], at[7:97]), (batch.slice(0, 0), [], at[:0])):
        records, start, end = indexed.encode_batch(part, k)
        want = [indexed.encode(r, number) for r in own]
        assert list(zip(records.to_pylist(), start.tolist(), end.tolist(), strict=True)) == [(w[0], w[2], w[3]) for w in want]
    for odd in (dict(some[0], quals=[None]), dict(some[0], quals=[300]), dict(some[0], seq="\u00e9"), dict(some[0], read_name="")):
        assert indexed.encode_batch(pa.RecordBatch.from_pylist([odd], schema=schema), at[:1]) is None


def test_parts_hold_no_names_and_regions_of_their_file_alone(table):
    """A table may have many contigs and regions: neither goes with every part."""
    _, path = table
    reader = indexed._Reader({"path": path, "regions": '[["b", 0, 400000], ["a", 0, 90000]]'})
    parts = reader.partitions()
    assert parts and not any(hasattr(p, "names") for p in parts)
    assert any(set(p.regions) != {0, 1} for p in parts)
    index = indexed.Index(5000)
    for k in (0, 7, 4000, 4999):
        index.add(k, 300, 350, (k + 1) << 16, (k + 2) << 16)
    again = indexed.Index.load(index.dump())
    assert again.bins == index.bins and again.first == index.first
