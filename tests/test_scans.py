"""Columns that are computed once for a row."""

from pyspark.sql import functions as F

from graftline.operators.unions import once
from graftline.plans import domain, flanks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_once_computes_a_column_once(spark):
    rows = once(spark.range(5).withColumnRenamed("id", "a b"), {"x": F.sqrt(F.col("`a b`") + 1)})
    used = rows.filter("x > 1 and x < 2").select(F.col("x") + F.col("x"), "`a b`")
    assert plan(used).count("SQRT") == 1 and used.count() == 2
    plain = spark.range(5).select(F.sqrt(F.col("id") + 1).alias("x")).filter("x > 1 and x < 2").select(F.col("x") + F.col("x"))
    assert plan(plain).count("SQRT") > 1


def test_a_cigar_is_parsed_once_for_a_read(spark):
    rows = domain.alignments(spark, SF)
    assert plan(flanks.clips(rows)).count("regexp_extract_all") == 1
    # The sequence: in the filter of reads clipped at both ends, and for the words; not at all where words aren't asked for.
    assert plan(flanks.clips(rows)).count("md5") == 2
    assert plan(flanks.clips(rows, words=False)).count("md5") == 1
