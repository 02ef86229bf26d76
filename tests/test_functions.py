import math
import random

from pyspark.sql import functions as F

from graftline.functions import cigar as cg
from graftline.functions import sequence as sq


def test_sequence_functions(spark):
    df = spark.createDataFrame([("acgTN", "NNACN", "II5"), ("", "", "")], "s string, t string, q string")
    r = df.select(sq.revcomp("s").alias("rc"), sq.canonical("s").alias("c"), sq.strip_flank("t", "5p").alias("f5"), sq.strip_flank("t", "3p").alias("f3"), sq.phred("q").alias("q"), sq.phred_string(sq.phred("q")).alias("back"), sq.truncate("s", 2, "5p").alias("t5"), sq.truncate("s", 2, "3p").alias("t3"), sq.slice_seq("s", F.lit(1), F.lit(3)).alias("sl")).collect()
    assert r[0].asDict() == {"rc": "NACGT", "c": "ACGTN", "f5": "NNAC", "f3": "ACN", "q": [40, 40, 20], "back": "II5", "t5": "ac", "t3": "TN", "sl": "cg"}
    assert r[1].q == [] and r[1].rc == ""
    sq.register_all(spark)
    assert spark.sql("select gl_revcomp('aaC') r, gl_canonical('TTT') c, gl_overlap('AAAACCCCGGGG', 'CCCCGGGGTTTT').merged m").first()[:2] == ("GTT", "AAA")
    p = spark.range(1).select(sq.poisson_upper_tail(F.lit(3), F.lit(2.0)).alias("x"), sq.poisson_upper_tail(F.lit(0), F.lit(2.0)).alias("y"), sq.percent_identity(F.lit(50), F.lit(5)).alias("i"), sq.window_centre(F.lit(3), F.lit(4)).alias("w")).first()
    assert math.isclose(p.x, 1 - math.exp(-2) * (1 + 2 + 2)) and p.y == 1 and p.i == 0.9 and p.w == 4


def brute_overlap(a, b):
    best = None
    for shift in range(len(a) - 1, -len(b), -1):
        cols = [(i, i - shift) for i in range(len(a)) if 0 <= i - shift < len(b)]
        score = sum(1 if a[i] == b[j] else -1 for i, j in cols)
        if best is None or score > best[0]:
            best = (score, sum(a[i] != b[j] for i, j in cols), cols[0][0], cols[-1][0] + 1, cols[0][1], cols[-1][1] + 1)
    return best


def test_overlap():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choices("ACG", k=rng.randint(1, 14))) for _ in range(2))
        assert sq.best_overlap(a, b) == brute_overlap(a, b)
    core = "ACGTACGTTGCA"
    assert sq.merge_overlap("TTT" + core, core + "GGG", 10, 0.9) == ("TTT" + core + "GGG", "seq_5p:3-15;seq_3p:0-12")
    one_off = core[:5] + "T" + core[6:]
    assert sq.merge_overlap("TTT" + core, one_off + "GGG", 10, 0.9)[0] is not None
    assert sq.merge_overlap("TTT" + core[:10], core[:10] + "GGG", 10, 0.9)[0] is not None
    assert sq.merge_overlap("TTT" + core[:10], core[:4] + "T" + core[5:10] + "GGG", 10, 0.9) == (None, None)
    assert sq.merge_overlap("", "A", 1, 0.5) == (None, None)
    # Half of the merged length comes from the first sequence, the rest from the second.
    merged, _ = sq.merge_overlap("A" + "C" * 20, "C" * 9 + "G" + "C" * 10 + "T", 10, 0.5)
    whole = "A" + "C" * 20 + "T"
    assert len(merged) == len(whole)


def test_inverted_repeat():
    rng = random.Random(1)
    arm = "GGAAGGTGCGAATAAG"
    five = "AC" + arm + "".join(rng.choices("ACGT", k=20))
    three = "".join(rng.choices("ACGT", k=20)) + arm[::-1].translate(str.maketrans("ACGT", "TGCA")) + "GT"
    found = sq.inverted_repeat(five, three)
    assert arm in found[0] and found[1][::-1].translate(str.maketrans("ACGT", "TGCA")).startswith(found[0][:4])
    inner = "".join(rng.choices("AC", k=22))
    assert sq.inverted_repeat(inner + arm, arm[::-1].translate(str.maketrans("ACGT", "TGCA")) + inner) is None
    assert sq.inverted_repeat("AAAAAAA", "CCCCCCC") is None and sq.inverted_repeat("", "A") is None


def cigar_row(spark, cigar, md=None, start=100):
    return spark.createDataFrame([(cigar, md, start)], "c string, md string, s int").withColumn("cigar", cg.parse_cigar("c"))


def test_consensus_in_sql(spark):
    sq.register_all(spark)
    rows = [(1, "ACGT", [9, 9, 9, 9]), (1, "ACG", [1, 1, 1]), (1, "ACGA", [9, 9, 9, 9]), (1, None, None), (2, "T", [3]), (3, None, None)]
    spark.createDataFrame(rows, "k int, word string, quals array<int>").createOrReplaceTempView("clip_words")
    got = spark.sql("select k, inline(gl_consensus(collect_list(word), collect_list(quals))) from clip_words group by k").collect()
    assert {tuple(r) for r in got} == {(1, "ACGN", 3), (2, "", 1)}


def test_clips(spark):
    for cigar, md, side, strict, lenient, site in [
        ("90M10S", "90", "right", 10, 10, 190),
        ("10S90M", "90", "left", 10, 10, 99),
        ("100M", "99A0", "right", 0, 1, 199),
        ("100M", "0A99", "left", 0, 1, 100),
        ("100M", "100", "left", 0, 0, None),
    ]:
        df = cigar_row(spark, cigar, md).withColumn("e", F.col("s") + cg.reference_length("cigar"))
        r = df.select(cg.strict_length("cigar", side).alias("a"), cg.lenient_length("cigar", "md", side).alias("b"), cg.clip_site("cigar", "md", "s", "e", side).alias("p")).first()
        assert (r.a, r.b, r.p) == (strict, lenient, site)


def test_site_evidence(spark):
    cases = {"50M2D50M": {149: "runthrough", 150: "deletion", 151: "deletion", 152: "runthrough"}, "50M5I45M": {149: "small_insertion_3p", 150: "small_insertion_5p", 148: "runthrough"}, "50M35I15M": {149: "large_insertion_3p", 150: "large_insertion_5p"}, "50=10X40M": {150: "runthrough", 149: "runthrough", 99: None, 200: None}}
    for cigar, wanted in cases.items():
        df = cigar_row(spark, cigar).withColumn("b", cg.blocks("cigar", "s"))
        for pos, kind in wanted.items():
            assert df.select(cg.site_evidence("b", F.lit(pos), 30).alias("k")).first().k == kind, (cigar, pos)
    b = cigar_row(spark, "50M2D50M35I10M").select(cg.blocks("cigar", "s").alias("b")).first().b
    assert [tuple(x) for x in b] == [(100, 150, 0, 0), (152, 202, 2, 0), (202, 212, 0, 35)]
    at = cigar_row(spark, "2S3M1I2M1D1M").select(cg.aligned_bases("cigar", "s").alias("a")).first().a
    assert [tuple(x) for x in at] == [(100, 2), (101, 3), (102, 4), (103, 6), (104, 7), (106, 8)]
    assert cigar_row(spark, "*").first().cigar == [] and cigar_row(spark, None).first().cigar == []
