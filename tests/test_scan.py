import random

import pytest
from graftline.operators import joins, scan
from graftline.sources import files
from pyspark.sql import Window
from pyspark.sql import functions as F


@pytest.fixture
def many_tasks(spark):
    """Ranges stay as they are, so that a key lies in several of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(spark, n=2000, seed=3):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), k, rng.choice([None, 0, 1, 5, -2])) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, at int, v int").repartition(7)


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sum_equals_a_window(spark, many_tasks, keys):
    df = table(spark)
    got = scan.running_sum(df, keys, ["at"], "v", "s")
    want = df.withColumn("s", F.coalesce(F.sum("v").over(Window.partitionBy(*keys).orderBy("at")), F.lit(0)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("down", [False, True])
def test_carried_last_equals_a_window(spark, many_tasks, keys, down):
    df = table(spark, seed=5)
    order = F.desc("at") if down else F.asc("at")
    got = scan.carried_last(df, keys, [order], "min_by" if down else "max_by", "at", "v", "s")
    want = df.withColumn("s", F.last("v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_key_is_many_ranges(spark, many_tasks):
    df = spark.createDataFrame([("hot", k) for k in range(4000)], "k string, at int")
    ranged = scan._ranged(df, ["k"], [F.asc("at")], "part")
    sizes = [r["count"] for r in ranged.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_over_borders(spark, many_tasks, direction):
    rng = random.Random(8)
    probe = [(rng.choice("xxxxxy"), rng.randrange(3000), k) for k in range(700)]
    build = [(rng.choice("xxxxxz"), rng.randrange(3000), k) for k in range(60)]
    got = joins.asof(spark.createDataFrame(probe, "k string, at int, id int"), spark.createDataFrame(build, "k string, pos int, v int"), ["k"], "at", "pos", ["v"], direction)
    for r in got.collect():
        side = [(p, v) for k, p, v in build if k == r.k and (p < r.at if direction == "backward" else p > r.at)]
        near = (max if direction == "backward" else min)((p for p, _ in side), default=None)
        assert (r.pos, r.v) == (near, max((v for p, v in side if p == near), default=None))


def test_empty(spark):
    none = table(spark).limit(0)
    assert scan.running_sum(none, ["k"], ["at"], "v", "s").collect() == []
    assert scan.carried_last(none, [], [F.asc("at")], "max_by", "at", "v", "s").collect() == []


def test_listings_over_many_tasks(spark, many_tasks, tmp_path):
    lines, want = [], set()
    for c in range(300):
        lines.append(f">Cluster {c}")
        members = [f"m{c}_{k}" for k in range(c % 7 + 1)]
        for k, m in enumerate(members):
            lines.append(f"{k}\t100nt, >{m}... " + ("*" if k == c % (c % 7 + 1) else "at +/99%"))
            want.add((m, members[c % (c % 7 + 1)]))
    (tmp_path / "x.clstr").write_text("\n".join(lines) + "\n")
    got = files.parse_clusters(spark.read.text(str(tmp_path / "x.clstr")))
    assert {tuple(r) for r in got.collect()} == want


def test_sequences_and_qualities_are_in_one_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"r{rng.randrange(40)}", "".join(rng.choices("ACGT", k=5)), [rng.randint(1, 40) for _ in range(5)]) for _ in range(120)]
    files.write_fasta_with_quals(spark.createDataFrame(rows, "name string, seq string, quals array<int>").repartition(6), str(tmp_path / "x"))
    read = lambda end: [line for f in sorted((tmp_path / f"x.{end}").glob("part-*")) for line in f.read_text().splitlines()]
    seq, qual = read("seq"), read("qual")
    assert seq[::2] == qual[::2] and sorted(zip(seq[::2], seq[1::2], qual[1::2], strict=True)) == sorted((f">{n}", s, " ".join(map(str, q))) for n, s, q in rows)
