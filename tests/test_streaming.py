import datetime
import random

import pytest
from graftline import schemas
from graftline.plans.flanks import SITE, clips
from graftline.streaming import exact
from pyspark.sql import functions as F

CONF = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(CONF, exact.ROCKSDB)
    yield
    spark.conf.unset(CONF)


def reads(rng, n):
    rows = []
    for _ in range(n):
        start = rng.choice([100, 100, 100, 130, 160])
        rows.append(("s", f"r{rng.randrange(60)}", 0, "c", start, start + 30, 60, False, False, False, [("M", 30), ("S", 10)] if rng.random() < 0.8 else [("S", 12), ("M", 30)], "ACGT" * 10 + "AC", [30] * 42, "30", 0, 30, None, None))
    return rows


def written(spark, source, target, checkpoint, shards):
    """Every file that is there, one in a batch; updates are kept with their batch's number."""
    stream = spark.readStream.schema(schemas.ALIGNMENTS).option("maxFilesPerTrigger", 1).parquet(source)
    keep = lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{target}/batch={k}")
    q = exact.exact_site_counts(stream, shards=shards).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()


def test_counts_equal_the_batch_plan_after_a_restart(spark, rocksdb, tmp_path):
    rng = random.Random(7)
    at = lambda x: str(tmp_path / x)
    for k in range(2):
        spark.createDataFrame(reads(rng, 80), schemas.ALIGNMENTS).coalesce(1).write.mode("append").parquet(at("in"))
    written(spark, at("in"), at("out"), at("state"), 3)
    spark.createDataFrame(reads(rng, 80), schemas.ALIGNMENTS).coalesce(1).write.mode("append").parquet(at("in"))
    written(spark, at("in"), at("out"), at("state"), 3)  # a new query from the checkpoint
    got = exact.latest_counts(spark.read.parquet(at("out")))
    whole = clips(spark.read.schema(schemas.ALIGNMENTS).parquet(at("in")))
    want = whole.groupBy(*SITE, "orient").agg(F.countDistinct("read_name").alias("softclip_count"), F.count("*").alias("reads"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert max(r.softclip_count for r in got.collect()) < max(r.reads for r in got.collect())


def test_groups_close_after_their_last_event(spark, rocksdb, tmp_path):
    at = lambda x: str(tmp_path / x)
    begin = datetime.datetime(2024, 1, 1)
    rng = random.Random(1)
    for k, hours in enumerate((0, 0.1, 30, 60)):
        rows = spark.createDataFrame(reads(rng, 20), schemas.ALIGNMENTS).withColumn("seen", F.lit(begin + datetime.timedelta(hours=hours))).withColumn("contig", F.lit("early" if k < 2 else f"late{k}"))
        rows.coalesce(1).write.mode("append").parquet(at("in"))
    schema = spark.read.parquet(at("in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(at("in"))
    rows = []
    keep = lambda df, k: rows.extend((k, *r) for r in df.collect())
    q = exact.exact_site_counts(stream, event="seen").writeStream.outputMode("update").option("checkpointLocation", at("state")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = [r for r in rows if r[-1] and r[2] == "early"]
    sites = {r[1:5] for r in rows if r[2] == "early"}
    assert {r[1:5] for r in closed} == sites and len(closed) == len(sites)
    for r in closed:
        assert r[6:8] == max(x[6:8] for x in rows if x[1:5] == r[1:5] and not x[-1])
