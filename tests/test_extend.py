import random

from graftline import schemas
from graftline.plans.extend import extend_pairs, prefix_counts

RC = str.maketrans("ACGT", "TGCA")


def test_extend_pairs(spark):
    rng = random.Random(4)
    genome, element = ("".join(rng.choices("ACGT", k=n)) for n in (600, 300))
    end = 305
    rows = []

    def read(name, start, ops, seq, reverse=False, mate=None):
        length = sum(n for o, n in ops if o == "M")
        rows.append(("s", name, 0, "c", start, start + length, 60, reverse, False, mate is not None, ops, seq, [30] * len(seq), str(length), 0, 0, mate, None))

    for k in range(5):
        left = 40 + k
        read(f"r{k}", end - left, [("M", left), ("S", 100 - left)], genome[end - left : end] + element[: 100 - left])
        read(f"l{k}", 300, [("S", left), ("M", 100 - left)], element[300 - left :] + genome[300 : 400 - left])
    for k in range(0, 100, 5):  # mates inside the insertion
        read(f"f{k}", 200, [("M", 80)], genome[200:280], mate=element[k : k + 90][::-1].translate(RC))
        read(f"b{k}", 400, [("M", 80)], genome[400:480], True, mate=element[210 - k : 300 - k])
    pairs = spark.createDataFrame([("s", 1, "c", end, 299, 1, 1, 1, 1, 0, False, 0, None, None, element[:50], element[-40:], "", ""), ("s", 2, "c", 500, 495, 1, 1, 1, 1, 0, False, 0, None, None, "acgt", "ACGT", "", "")], schemas.PAIRS)
    got = {r.pair_id: r for r in extend_pairs(pairs, spark.createDataFrame(rows, schemas.ALIGNMENTS)).collect()}
    assert len(got) == 2
    assert element.startswith(got[1].extended_5p) and len(got[1].extended_5p) >= 170
    assert element.endswith(got[1].extended_3p) and len(got[1].extended_3p) >= 170
    assert (got[2].extended_5p, got[2].extended_3p) == ("ACGT", "ACGT")


def test_bases_weigh_by_their_own_quality(spark):
    """One long read of poor bases doesn't outvote two short ones of good bases, whatever its length."""
    rng = random.Random(8)
    genome, inside, wrong = ("".join(rng.choices("ACGT", k=n)) for n in (400, 60, 260))
    end, rows = 205, []
    for k in range(3):
        left = 25 + k
        rows.append(("s", f"good{k}", 0, "c", end - left, end, 60, False, False, False, [("M", left), ("S", 50)], genome[end - left : end] + inside[:50], [35] * (left + 50), str(left), 0, 0, None, None))
        rows.append(("s", f"bad{k}", 0, "c", end - 40, end, 60, False, False, False, [("M", 40), ("S", 260)], genome[end - 40 : end] + inside[:20] + wrong[:240], [35] * 60 + [3] * 240, "40", 0, 0, None, None))
    pairs = spark.createDataFrame([("s", 1, "c", end, 199, 1, 1, 1, 1, 0, False, 0, None, None, inside[:20], None, "", "")], schemas.PAIRS)
    got = extend_pairs(pairs, spark.createDataFrame(rows, schemas.ALIGNMENTS)).first()
    assert got.extended_5p == inside[:50] and got.extended_3p is None


def test_prefix_counts(spark):
    words = spark.createDataFrame([(1, "ACGT"), (1, "ACG"), (2, "AC")], "k int, word string")
    asked = spark.createDataFrame([("AC",), ("ACG",), ("T",)], "prefix string")
    assert sorted(map(tuple, prefix_counts(words, asked, ["k"]).collect())) == [(1, "AC", 2), (1, "ACG", 2), (2, "AC", 1)]
