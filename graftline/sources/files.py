"""FASTA, SAM and TSV as DataFrames, and their writers.

Everything goes through Spark's own readers, so any store that Spark reaches works
and large files are split.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import cigar as cg
from ..operators import scan
from ..schemas import ALIGNMENTS, SEQUENCES


def read_path_list(spark: SparkSession, paths: list[str]) -> list[str]:
    """A single argument that is a text file of existing paths, one a line, stands for these."""
    if len(paths) != 1:
        return paths
    rows = spark.read.text(paths[0]).select(F.trim("value").alias("value")).filter("value <> ''")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()

    def exists(x: str) -> bool:
        try:
            path = hadoop(x)
            return path.getFileSystem(conf).exists(path)
        except Exception:  # a line that is no path at all
            return False

    def listed(lines: list[str]) -> bool:
        return bool(lines) and all("\t" not in x and exists(x) for x in lines)

    # Only a file that begins as a list is read to its end: others are data of any size.
    if not listed([r.value.strip() for r in rows.limit(100).collect()]):
        return paths
    lines = [x for r in rows.collect() if (x := r.value.strip())]
    return lines if listed(lines) else paths


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): the name is the header's first word; line ends inside a sequence go.

    A record begins at a ``>`` that begins a line; any other is part of its header.
    Files are split at these, so a large one has many readers.
    """
    # The first record's ``>`` has no line end before it.  A carriage return stays with the line before it.
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).filter(F.length(F.trim("value")) > 0)
    head, body = F.split_part("value", F.lit("\n"), F.lit(1)), F.expr("substring(value, instr(value, '\\n') + 1)")
    seq = F.when(F.instr("value", "\n") > 0, F.regexp_replace(body, "\\s", "")).otherwise(F.lit(""))
    return rows.select(F.regexp_extract(head, "^\\s*(\\S*)", 1).alias("name"), seq.alias("seq")).to(SEQUENCES)


def write_fasta(rows: DataFrame, path: str, name: str | None = "name", seq: str = "seq") -> None:
    """One record a row; without a name column, records are numbered in no set order."""
    label = F.col(name).cast("string") if name else F.monotonically_increasing_id().cast("string")
    rows.select(F.concat(F.lit(">"), label, F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_fasta_with_quals(rows: DataFrame, path: str, name: str = "name", seq: str = "seq", quals: str = "quals") -> None:
    """Sequences under ``path``.seq and their qualities, as numbers with blanks between, under ``path``.qual, both in order of name, sequence and qualities.

    This is what local assemblers take; reads without qualities have a 0 for each base.
    """
    label = F.concat(F.lit(">"), F.col(name).cast("string"))
    numbers = F.array_join(F.coalesce(F.col(quals), F.array_repeat(F.lit(0), F.length(seq))), " ")
    ordered = rows.orderBy(label, seq, numbers)
    for end, body in (("seq", F.col(seq)), ("qual", numbers)):
        ordered.select(F.concat(label, F.lit("\n"), body).alias("value")).write.mode("overwrite").text(f"{path}.{end}")


def parse_repeat_arms(lines: DataFrame) -> DataFrame:
    """(name, start_5p, end_5p, arm_5p, start_3p, end_3p, arm_3p) of a repeat finder's FASTA output.

    Consecutive records are the two arms of a repeat; a record's name ends in
    ``_start_end``.  Lines are numbered by a segmented scan, so a long output is many tasks.
    """
    numbered = lines.filter(F.length("value") > 0).select("value", F.monotonically_increasing_id().alias("_n"), F.when(F.col("value").startswith(">"), 1).otherwise(0).alias("_head"))
    rows = scan.running_sum(numbered, [], ["_n"], "_head", "_r").filter("_r > 0").groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("all"))
    head, body = F.col("all")[0]["value"], F.array_join(F.transform(F.slice("all", 2, 1 << 30), lambda x: x["value"]), "")
    part = lambda k: F.regexp_extract(head, "^>(.*)_(\\d+)_(\\d+)", k)
    arm = F.struct(part(1).alias("name"), part(2).cast("int").alias("start"), part(3).cast("int").alias("end"), body.alias("seq"))
    arms = rows.select(F.floor((F.col("_r") - 1) / 2).alias("k"), (F.col("_r") % 2 == 1).alias("first"), arm.alias("a")).groupBy("k").agg(F.max(F.when(F.col("first"), F.col("a"))).alias("a"), F.max(F.when(~F.col("first"), F.col("a"))).alias("b"))
    return arms.filter("b is not null").select("a.name", *[F.col(f"{x}.{c}").alias(f"{n}_{o}") for x, o in (("a", "5p"), ("b", "3p")) for c, n in (("start", "start"), ("end", "end"), ("seq", "arm"))])


def read_tsv(spark: SparkSession, paths: list[str] | str, schema: StructType) -> DataFrame:
    """Tables with a header, by explicit schema; only an empty field of a non-string column is null."""
    out = []
    for path in [paths] if isinstance(paths, str) else paths:
        text = StructType([StructField(f.name, StringType()) for f in schema])
        raw = spark.read.schema(text).option("sep", "\t").option("header", True).option("nullValue", "\0").option("emptyValue", "").option("quote", "").csv(path)
        out.append(raw.select([_typed(F.col(f"`{f.name}`"), f) for f in schema]))
    return reduce(DataFrame.unionByName, out)


def _typed(c: Column, f: StructField) -> Column:
    kind = f.dataType.simpleString()
    if kind == "string":
        return F.coalesce(c, F.lit("")).alias(f.name)
    if kind == "boolean":
        return F.lower(c).isin("true", "1").alias(f.name)
    return F.expr(f"try_cast(`{f.name}` AS {kind})").alias(f.name)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").csv(path)


def _tag(fields: Column, name: str) -> Column:
    found = F.filter(fields, lambda x: x.startswith(name + ":"))
    return F.try_element_at(F.transform(found, lambda x: F.substring(x, 6, 1 << 30)), F.lit(1))


def _qualities(text: Column) -> Column:
    """``phred`` of a batch's strings at once."""

    @F.arrow_udf("array<int>")
    def run(x: pa.Array) -> pa.Array:
        valid = x.is_valid().to_numpy(zero_copy_only=False)
        joined = "".join(found := [t or "" for t in x.to_pylist()])
        sizes = np.array([len(t) for t in found], np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.int32) - 33
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(codes, pa.int32()), mask=pa.array(~valid))

    return run(text)


def _quality_text(quals: Column) -> Column:
    """``phred_string`` of a batch's arrays at once; the few that hold other than printable characters go by themselves."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        values = x.flatten()
        codes = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 33
        if values.null_count or ((codes < 33) | (codes > 126)).any():
            return pa.array([None if q is None else "".join(chr((v + 33) % 256) if v + 33 >= 0 else "" for v in q if v is not None) for q in x.to_pylist()], pa.string())
        sizes = np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        made = pa.StringArray.from_buffers(len(x), pa.py_buffer(ends), pa.py_buffer(codes.astype(np.uint8)))
        return pc.if_else(x.is_valid(), made, None) if x.null_count else made

    return run(quals)


def parse_sam(lines: DataFrame, sample: Column | str) -> DataFrame:
    """Alignments of SAM text lines (column value); header lines go."""
    x = F.split("value", "\t")
    at = lambda k: F.try_element_at(x, F.lit(k + 1))
    rows = lines.filter(~F.col("value").startswith("@") & (F.length("value") > 0)).select(x.alias("_x"), *[c for c in lines.columns if c != "value"])
    x = F.col("_x")
    flag, cigar, start = at(1).cast("int"), cg.parse_cigar(at(5)), at(3).cast("int") - 1
    tags = F.slice(x, 12, 1000)
    bit = lambda n: flag.bitwiseAND(n) != 0
    out = rows.select(
        (F.lit(sample) if isinstance(sample, str) else sample).alias("sample"),
        at(0).alias("read_name"),
        flag.alias("flag"),
        F.when(at(2) != "*", at(2)).alias("contig"),
        start.alias("ref_start"),
        (start + cg.reference_length(cigar)).alias("ref_end"),
        at(4).cast("int").alias("mapq"),
        bit(0x10).alias("is_reverse"),
        bit(0x4).alias("is_unmapped"),
        bit(0x8).alias("mate_is_unmapped"),
        cigar.alias("cigar"),
        F.when(at(9) != "*", at(9)).alias("seq"),
        F.when(at(10) != "*", _qualities(at(10))).alias("quals"),
        _tag(tags, "MD").alias("md"),
        _tag(tags, "NM").cast("int").alias("nm"),
        _tag(tags, "AS").cast("int").alias("as_score"),
        _tag(tags, "MT").alias("mate_seq"),
        _tag(tags, "MQ").alias("mate_quals"),
    )
    return out.select([F.col(f.name).cast(f.dataType) for f in ALIGNMENTS])


def read_sam(spark: SparkSession, path: str, sample: str) -> DataFrame:
    return parse_sam(spark.read.text(path), sample)


def sam_lines(alignments: DataFrame, beside: list[Column] | None = None) -> DataFrame:
    """(value), with columns to stand beside it: alignments as lines of SAM text without a header; mates' places aren't known and stay empty."""
    c = lambda n, none: F.coalesce(F.col(n).cast("string"), F.lit(none))
    cigar = F.when(F.size("cigar") > 0, F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), x["op"])), "")).otherwise("*")
    flag = F.coalesce("flag", F.lit(0))
    for bit, name in ((0x10, "is_reverse"), (0x4, "is_unmapped"), (0x8, "mate_is_unmapped")):
        flag = flag.bitwiseAND(F.lit(0xFFFF ^ bit)).bitwiseOR(F.when(F.coalesce(name, F.lit(False)), bit).otherwise(0))
    quals = F.when(F.size("quals") > 0, _quality_text(F.col("quals"))).otherwise("*")
    tag = lambda name, kind, col: F.when(F.col(col).isNotNull(), F.concat(F.lit(f"{name}:{kind}:"), F.col(col).cast("string")))
    tags = [tag("MD", "Z", "md"), tag("NM", "i", "nm"), tag("AS", "i", "as_score"), tag("MT", "Z", "mate_seq"), tag("MQ", "Z", "mate_quals")]
    start = F.coalesce(F.col("ref_start") + 1, F.lit(0)).cast("string")
    fields = [c("read_name", "*"), flag.cast("string"), c("contig", "*"), start, c("mapq", "0"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), c("seq", "*"), quals]
    return alignments.select(*(beside or []), F.concat_ws("\t", *fields, *tags).alias("value"))


def write_sam(alignments: DataFrame, path: str, contigs: DataFrame | None = None, compression: str | None = None) -> None:
    """SAM text in coordinate order; ``contigs`` (contig, length) gives the header's order, else names do.

    Files are ranges of (contig, place), so reading them by name gives the order of the
    whole; ``compression`` (gzip) holds for each of them.  Lines are made before rows are
    sorted: an array of qualities is four bytes a base, in a line it is one.
    """
    spark = alignments.sparkSession
    rows = sam_lines(alignments, [F.col("contig").alias("_contig"), F.col("ref_start").alias("_start"), F.col("read_name").alias("_name"), F.col("flag").alias("_flag")])
    if contigs is not None:
        order = contigs.withColumn("_number", F.monotonically_increasing_id()) if "number" not in contigs.columns else contigs.withColumnRenamed("number", "_number")
        rows = rows.join(F.broadcast(order.select(F.col("contig").alias("_contig"), "_number")), "_contig", "left")
        header = [f"@SQ\tSN:{r['contig']}\tLN:{r['length']}" for r in order.orderBy("_number").collect()]
        spark.createDataFrame([(k, x) for k, x in enumerate(["@HD\tVN:1.6\tSO:coordinate", *header])], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(f"{path}.header")
    key = [F.asc_nulls_last("_contig" if contigs is None else "_number"), F.asc_nulls_last("_start"), F.asc("_name"), F.asc("_flag")]
    rows.orderBy(*key).select("value").write.mode("overwrite").text(path, compression=compression)


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length, number) of a SAM header, numbered in its order."""
    rows = spark.read.text(path).withColumn("number", F.monotonically_increasing_id()).filter(F.col("value").startswith("@SQ"))
    return rows.select(F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", "\tLN:(\\d+)", 1).cast("int").alias("length"), "number")


def contigs_of(genome: DataFrame) -> DataFrame:
    """(contig, length, number) of a genome's sequences, numbered in the order of its file."""
    return genome.select(F.col("name").alias("contig"), F.length("seq").alias("length"), F.monotonically_increasing_id().alias("number"))


def format_alignments(alignments: DataFrame) -> DataFrame:
    """Primary alignments with their mate's sequence and qualities, without pairs that are both unmapped.

    Mates share a name; of several records of a name and mate bit the first in
    order of place stands for the mate.
    """
    primary = alignments.filter(F.col("flag").bitwiseAND(0x900) == 0).withColumn("_mate", F.when(F.col("flag").bitwiseAND(0x80) != 0, 2).otherwise(1))
    order = F.struct("contig", "ref_start", "seq")
    other = primary.groupBy("sample", "read_name", (3 - F.col("_mate")).alias("_mate")).agg(F.min_by("seq", order).alias("_seq"), F.min_by("quals", order).alias("_quals"), F.min_by("is_unmapped", order).alias("_unmapped"))
    joined = primary.join(other, ["sample", "read_name", "_mate"], "left")
    kept = joined.filter(~(F.col("is_unmapped") & F.coalesce("_unmapped", F.col("mate_is_unmapped"))))
    quals = F.array_join(F.transform("_quals", lambda q: F.char(q + 33)), "")
    out = kept.withColumn("mate_seq", F.col("_seq")).withColumn("mate_quals", F.when(F.col("_quals").isNotNull(), quals))
    return out.select([F.col(f.name) for f in ALIGNMENTS])


def write_alignments(alignments: DataFrame, path: str) -> None:
    """Parquet by sample, in coordinate order within files, so that row groups prune by place."""
    alignments.repartition("sample", "contig").sortWithinPartitions("sample", "contig", "ref_start").write.mode("overwrite").partitionBy("sample").parquet(path)


def parse_clusters(lines: DataFrame) -> DataFrame:
    """(member, rep) of a cluster listing: ``>Cluster n`` lines, members with ``>name...``, the representative ends in ``*``.

    Lines are numbered by a segmented scan, so a long listing is many tasks.
    """
    numbered = lines.select("value", F.monotonically_increasing_id().alias("_n"), F.when(F.col("value").startswith(">"), 1).otherwise(0).alias("_head"))
    rows = scan.running_sum(numbered, [], ["_n"], "_head", "cluster").filter(~F.col("value").startswith(">"))
    rows = rows.select("cluster", F.regexp_extract("value", ">(.+?)\\.\\.\\.", 1).alias("member"), F.rtrim("value").endswith("*").alias("is_rep"))
    reps = rows.filter("is_rep").select("cluster", F.col("member").alias("rep"))
    return rows.join(reps, "cluster").select("member", "rep")
