"""Flank discovery: clip sites, their evidence, filters and consensus sequences.

One forward plan over an alignments table (``schemas.ALIGNMENTS``); no site is
fetched by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..operators import joins
from ..operators.consensus import consensus_clusters
from ..operators.stash import stash
from ..operators.unions import once
from ..params import FindFlanks
from ..schemas import FLANKS

COUNTS = (
    "softclip_count_5p",
    "softclip_count_3p",
    "runthrough_count",
    "small_insertion_count_5p",
    "small_insertion_count_3p",
    "large_insertion_count_5p",
    "large_insertion_count_3p",
    "deletion_count",
    "upstream_deletion_count",
    "downstream_deletion_count",
)
SITE = ["sample", "contig", "pos"]


def clips(alignments: DataFrame, p: FindFlanks = FindFlanks(), also: tuple[str, ...] = (), words: bool = True) -> DataFrame:
    """One row for each clipped end of a read that passes: site, orientation, clipped word and qualities outwards (null without ``words``), and the columns in ``also``."""
    rows = alignments.filter(~F.coalesce("is_unmapped", F.lit(False))).filter(cg.passes_read_filters(p.min_alignment_quality, p.min_alignment_inner_length))
    # The reads without a clip go before sequences and qualities are looked at.
    rows = rows.filter(cg.leniently_clipped("cigar", "md", "left") | cg.leniently_clipped("cigar", "md", "right"))
    rows = once(rows, {"md": F.col("md")} | ({"seq": F.col("seq"), "quals": F.col("quals")} if words else {}))
    ends = []
    for side, orient in (("right", "5p"), ("left", "3p")):
        n = cg.lenient_length("cigar", "md", side)
        long = cg.strict_length("cigar", side) if p.strict_min_length else cg.terminal_op_length("cigar", side)
        word, quals = (F.upper(cg.clipped_seq("seq", n, side)), cg.clipped_quals("quals", n, side)) if words else (F.lit(None).cast("string"), F.lit(None).cast("array<int>"))
        ends.append(
            F.when(
                cg.leniently_clipped("cigar", "md", side),
                F.struct(
                    F.lit(orient).alias("orient"),
                    cg.clip_site("cigar", "md", "ref_start", "ref_end", side).alias("pos"),
                    F.coalesce(long, F.lit(0)).alias("clip_len"),
                    # A 3p word reads from the site outwards too.
                    (F.reverse(word) if words and side == "left" else word).alias("word"),
                    (F.reverse(quals) if words and side == "left" else quals).alias("quals"),
                ),
            )
        )
    return rows.select("sample", "contig", "read_name", *also, F.explode(F.array_compact(F.array(*ends))).alias("clip")).select("sample", "contig", "clip.pos", "clip.orient", "read_name", "clip.clip_len", "clip.word", "clip.quals", *also)


def clip_counts(rows: DataFrame, p: FindFlanks) -> DataFrame:
    """Sites with distinct read names by orientation and keep flags after the length and count filters."""
    is_5p, is_3p = F.col("orient") == "5p", F.col("orient") == "3p"
    by = rows.groupBy(*SITE).agg(
        F.countDistinct(F.when(is_5p, F.col("read_name"))).alias("softclip_count_5p"),
        F.countDistinct(F.when(is_3p, F.col("read_name"))).alias("softclip_count_3p"),
        F.max(F.when(is_5p, F.col("clip_len"))).alias("_long_5p"),
        F.max(F.when(is_3p, F.col("clip_len"))).alias("_long_3p"),
    )
    for o in ("5p", "3p"):
        by = by.withColumn(f"keep_{o}", (F.coalesce(f"_long_{o}", F.lit(0)) >= p.min_softclip_length) & (F.col(f"softclip_count_{o}") >= p.min_softclip_count))
    return by.drop("_long_5p", "_long_3p").filter("keep_5p or keep_3p")


def mate_filter(sites: DataFrame, p: FindFlanks) -> DataFrame:
    """Keep flags only where a site of the other orientation is near; any clip counts as a site, kept or not."""
    return joins.filter_by_mate(sites, ["sample", "contig"], "pos", "keep_5p", "keep_3p", F.col("softclip_count_5p") > 0, F.col("softclip_count_3p") > 0, p.min_distance_to_mate).filter("keep_5p or keep_3p")


def evidence(alignments: DataFrame, sites: DataFrame, p: FindFlanks, contigs: DataFrame | None = None) -> DataFrame:
    """(site, ...counts) of reads at each site that aren't clipped right there, by what they show of it.

    Reads come from one interval join of alignments and sites; the neighbouring
    positions' deletions use the same reads.
    """
    rows = alignments.filter(~F.coalesce("is_unmapped", F.lit(False))).filter(cg.passes_read_filters(p.min_alignment_quality, p.min_alignment_inner_length))
    reads = rows.select("sample", "contig", "read_name", "ref_start", "ref_end", cg.blocks("cigar", "ref_start").alias("blocks"), cg.clip_site("cigar", "md", "ref_start", "ref_end", "left").alias("_left"), cg.clip_site("cigar", "md", "ref_start", "ref_end", "right").alias("_right"))
    own = sites.select(*SITE).withColumn("_from", F.greatest(F.col("pos") - 1, F.lit(0))).withColumn("_to", F.col("pos") + 2)
    if contigs is not None:
        own = own.join(contigs.select("contig", "length"), "contig", "left").withColumn("_to", F.least(F.col("_to"), F.coalesce("length", F.col("_to")))).withColumn("_last", F.col("length") - 1).drop("length")
    else:
        own = own.withColumn("_last", F.lit(None).cast("int"))
    near = joins.interval_join(own, reads, ["sample", "contig"], ("_from", "_to"), ("ref_start", "ref_end"))
    unclipped = near.filter(~(F.coalesce(F.col("_left") == F.col("pos"), F.lit(False)) | F.coalesce(F.col("_right") == F.col("pos"), F.lit(False))))
    kinds = unclipped.select(
        *SITE,
        "read_name",
        cg.site_evidence("blocks", "pos", p.large_insertion_cutoff).alias("kind"),
        (cg.site_evidence("blocks", F.col("pos") - 1, p.large_insertion_cutoff) == "deletion").alias("_up"),
        (cg.site_evidence("blocks", F.col("pos") + 1, p.large_insertion_cutoff) == "deletion").alias("_down"),
        "_last",
    )
    named = lambda cond: F.countDistinct(F.when(cond, F.col("read_name")))
    kind = F.col("kind")
    return kinds.groupBy(*SITE).agg(
        named(kind == "runthrough").alias("runthrough_count"),
        named(kind == "small_insertion_5p").alias("small_insertion_count_5p"),
        named(kind == "small_insertion_3p").alias("small_insertion_count_3p"),
        named(kind == "large_insertion_5p").alias("large_insertion_count_5p"),
        named(kind == "large_insertion_3p").alias("large_insertion_count_3p"),
        named(kind == "deletion").alias("deletion_count"),
        named(F.col("_up") & (F.col("pos") >= 1)).alias("upstream_deletion_count"),
        named(F.col("_down") & F.coalesce(F.col("pos") < F.col("_last"), F.lit(True))).alias("downstream_deletion_count"),
    )


def with_counts(sites: DataFrame, found: DataFrame) -> DataFrame:
    """Sites with all ten counts and their total, zero where nothing was seen."""
    out = sites.join(found, SITE, "left")
    for c in COUNTS[2:]:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out.withColumn("total_count", total())


def total() -> Column:
    """Reads at the site; neighbouring deletions don't count."""
    return sum((F.col(c) for c in COUNTS[1:8]), F.col(COUNTS[0]))


def ratio_filter(sites: DataFrame, p: FindFlanks) -> DataFrame:
    """Keep orientations of enough clips and few indels; many deletions beside the site drop both."""
    share = lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("total_count")), F.lit(0.0))
    large = F.col("large_insertion_count_5p") + F.col("large_insertion_count_3p")
    for o in ("5p", "3p"):
        clip = share(F.col(f"softclip_count_{o}") + large)
        indel = share(F.col(f"small_insertion_count_{o}") + F.col("deletion_count"))
        sites = sites.withColumn(f"keep_{o}", F.col(f"keep_{o}") & (clip >= p.min_softclip_ratio) & (indel <= p.max_indel_ratio))
    beside = (share(F.col("upstream_deletion_count")) > p.max_indel_ratio) | (share(F.col("downstream_deletion_count")) > p.max_indel_ratio)
    return sites.filter((F.col("keep_5p") | F.col("keep_3p")) & ~beside)


def merged_words(rows: DataFrame) -> DataFrame:
    """One word for each site, orientation and read name: at each place the base of the higher quality.

    Any number of reads may share a name; equal qualities go to the first base in order.
    """
    keys = [*SITE, "orient", "read_name"]
    at = rows.select(*keys, "word", F.posexplode("quals").alias("i", "q")).select(*keys, "i", "q", F.expr("substring(word, i + 1, 1)").alias("b"))
    best = at.groupBy(*keys, "i").agg(F.min(F.struct((-F.col("q")).alias("q"), F.col("b").alias("b"))).alias("m"))
    whole = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", F.col("m.b").alias("b"), (-F.col("m.q")).alias("q")))).alias("all"))
    return whole.select(*keys, F.array_join(F.transform("all", lambda x: x["b"]), "").alias("word"), F.transform("all", lambda x: x["q"]).alias("quals"))


def consensus(rows: DataFrame, sites: DataFrame, p: FindFlanks) -> DataFrame:
    """(site, orient, consensus_seq, consensus_softclip_count): the best consensus of each kept site and orientation."""
    keys = [*SITE, "orient"]
    kept = sites.select(*SITE, F.explode(F.array_compact(F.array(F.when(F.col("keep_5p"), F.lit("5p")), F.when(F.col("keep_3p"), F.lit("3p"))))).alias("orient"))
    words = merged_words(rows.join(kept, keys, "left_semi")).filter(F.length("word") > 0)
    found = consensus_clusters(words.select(*keys, "word", "quals"), keys, p.min_cluster_similarity, p.min_count_consensus)
    found = found.filter((F.length("consensus") >= p.min_softclip_length) & (F.col("n_reads") >= p.min_softclip_count))
    best = Window.partitionBy(*keys).orderBy(F.desc("n_reads"), F.desc(F.length("consensus")), F.asc("consensus"))
    top = found.withColumn("_k", F.row_number().over(best)).filter("_k = 1")
    word = F.when(F.col("orient") == "3p", F.reverse("consensus")).otherwise(F.col("consensus"))
    return top.select(*keys, word.alias("consensus_seq"), F.col("n_reads").alias("consensus_softclip_count"))


def find_flanks(alignments: DataFrame, p: FindFlanks = FindFlanks(), contigs: DataFrame | None = None) -> DataFrame:
    """The flanks table of ``schemas.FLANKS`` from an alignments table; empty in, empty out."""
    rows = clips(alignments, p)
    sites = stash(mate_filter(clip_counts(clips(alignments, p, words=False), p), p), "sites")
    sites = stash(with_counts(sites, evidence(alignments, sites, p, contigs)), "sites")
    sites = mate_filter(ratio_filter(sites, p), p)
    found = consensus(rows, sites, p)
    per_site = found.groupBy(*SITE).agg(F.bool_or(F.col("orient") == "5p").alias("_c5"), F.bool_or(F.col("orient") == "3p").alias("_c3"))
    sites = sites.join(per_site, SITE).withColumn("keep_5p", F.col("_c5")).withColumn("keep_3p", F.col("_c3")).drop("_c5", "_c3")
    sites = mate_filter(sites, p)
    flat = sites.join(found, SITE).filter(F.when(F.col("orient") == "5p", F.col("keep_5p")).otherwise(F.col("keep_3p")))
    # Contigs in their own order (number) where it is known, else by name.
    if contigs is not None and "number" in contigs.columns:
        flat = flat.join(contigs.select("contig", F.col("number").alias("_number")), "contig", "left")
    else:
        flat = flat.withColumn("_number", F.lit(0))
    number = Window.partitionBy("sample").orderBy(F.asc_nulls_last("_number"), "contig", "pos", "orient")
    return flat.withColumn("flank_id", F.row_number().over(number)).select([F.col(f.name).cast(f.dataType) for f in FLANKS])


def recall(alignments: DataFrame, asked: DataFrame, p: FindFlanks = FindFlanks(), contigs: DataFrame | None = None) -> DataFrame:
    """The ten counts and their total at given sites, a 5p and a 3p row for each.

    ``asked`` has contig, pos_5p and pos_3p; repeated sites collapse.  Every sample
    has a row at every site, so the samples' names, a cohort's worth, go to the driver.
    """
    names = [r["sample"] for r in alignments.select("sample").distinct().collect()]
    samples = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    at = asked.select("contig", F.explode(F.array("pos_5p", "pos_3p")).alias("pos")).distinct().withColumn("sample", F.explode(samples))
    rows = clips(alignments, p, words=False)
    counted = rows.groupBy(*SITE).agg(F.countDistinct(F.when(F.col("orient") == "5p", F.col("read_name"))).alias("softclip_count_5p"), F.countDistinct(F.when(F.col("orient") == "3p", F.col("read_name"))).alias("softclip_count_3p"))
    sites = at.join(counted, SITE, "left").fillna(0, ["softclip_count_5p", "softclip_count_3p"])
    full = with_counts(sites, evidence(alignments, sites, p, contigs))
    wanted = asked.select("contig", F.explode(F.array(F.struct(F.col("pos_5p").alias("pos"), F.lit("5p").alias("orient")), F.struct(F.col("pos_3p").alias("pos"), F.lit("3p").alias("orient")))).alias("x")).select("contig", "x.pos", "x.orient").distinct()
    return wanted.join(full, ["contig", "pos"]).select("contig", "pos", "orient", *COUNTS, "total_count")
