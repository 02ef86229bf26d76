"""Flank extension: flanks grown into the insertion through an assembly of their sites' reads.

The clipped reads of a site and the unmapped mates beside it are assembled, all sites
in one plan (``operators.assembly``), a flank is laid on the graph by the last of its
words that is there, and follows the graph as long as there is one way on.  What ways there are
is decided by the qualities of the bases, one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions.sequence import phred, revcomp
from ..operators import assembly, joins
from ..operators.stash import stash
from ..operators.unions import apart, union_all

KEYS = ["sample", "contig", "pos", "orient"]


@dataclass(frozen=True)
class Extension:
    #: Bases that neighbouring reads must share, and reads that must go on.
    overlap: int = 15
    support: int = 2
    #: A way goes if another one at its place has over this many times its summed quality.
    share: int = 5
    #: Bases beside the site in which mates of mapped reads are looked for.
    search: int = 500

    @property
    def assembly(self) -> assembly.Assembly:
        return assembly.Assembly(word=self.overlap, support=self.support, share=self.share)


def site_reads(alignments: DataFrame, sites: DataFrame, p: Extension = Extension()) -> DataFrame:
    """(site, orient, seq, quals): clipped reads at a site and unmapped mates beside it, in reference direction."""
    mapped = alignments.filter(~F.coalesce("is_unmapped", F.lit(False)))
    ends = F.array_compact(F.array(*[F.when(cg.leniently_clipped("cigar", "md", side), F.struct(F.lit(o).alias("orient"), cg.clip_site("cigar", "md", "ref_start", "ref_end", side).alias("pos"))) for side, o in (("right", "5p"), ("left", "3p"))]))
    clipped = mapped.select("sample", "contig", F.explode(ends).alias("e"), F.upper("seq").alias("seq"), "quals").select("sample", "contig", "e.pos", "e.orient", "seq", "quals")
    clipped = clipped.join(sites.select(*KEYS).distinct(), KEYS, "left_semi")
    five = F.col("orient") == "5p"
    windows = sites.select(*KEYS).distinct().withColumn("_s", F.when(five, F.greatest(F.col("pos") - p.search, F.lit(0))).otherwise(F.col("pos"))).withColumn("_e", F.when(five, F.col("pos") + 1).otherwise(F.col("pos") + 1 + p.search))
    mates = mapped.filter(F.col("mate_is_unmapped") & F.col("mate_seq").isNotNull()).select("sample", "contig", "ref_start", "ref_end", "is_reverse", "mate_seq", "mate_quals")
    near = joins.interval_join(windows, mates, ["sample", "contig"], ("_s", "_e"), ("ref_start", "ref_end")).filter(F.col("is_reverse") == (F.col("orient") == "3p"))
    # A forward read's mate was read on the other strand.
    own = phred("mate_quals")
    turned = F.when(F.col("is_reverse"), F.upper("mate_seq")).otherwise(revcomp("mate_seq"))
    quals = F.when(F.col("is_reverse"), own).otherwise(F.reverse(own))
    return clipped.unionByName(apart(near.select(*KEYS, turned.alias("seq"), quals.alias("quals"))))


def _turned(c: Column | str, kind: str) -> Column:
    """What reads into the insertion: 3p flanks and their reads from right to left."""
    return F.when(F.col("orient") == "3p", F.reverse(c)).otherwise(F.col(c)).alias(kind)


def extend_pairs(pairs: DataFrame, alignments: DataFrame, p: Extension = Extension()) -> DataFrame:
    """``pairs`` with extended_5p and extended_3p; a flank that can't be extended stays as it is."""
    side = lambda o: pairs.select("sample", "contig", F.col(f"pos_{o}").alias("pos"), F.lit(o).alias("orient"), F.upper(f"seq_{o}").alias("flank"))
    flanks = stash(union_all([side("5p"), side("3p")]).filter("flank is not null").distinct(), "flanks")
    reads = site_reads(alignments, flanks, p).select(*KEYS, _turned("seq", "seq"), _turned("quals", "quals"))
    graph = assembly.build(reads, KEYS, p.assembly)
    long = assembly.walk(flanks.select(*KEYS, _turned("flank", "flank")), KEYS, graph, p.assembly)
    done = stash(long.select(*KEYS, _turned("flank", "flank"), _turned("extended", "extended")), "extended")
    out = pairs
    for o in ("5p", "3p"):
        own = done.filter(F.col("orient") == o).select("sample", "contig", F.col("pos").alias(f"pos_{o}"), F.col("flank").alias(f"_flank_{o}"), F.col("extended").alias(f"extended_{o}"))
        own = own.withColumnRenamed("sample", "_s").withColumnRenamed("contig", "_c").withColumnRenamed(f"pos_{o}", "_p")
        out = out.join(own, (out["sample"] == F.col("_s")) & (out["contig"] == F.col("_c")) & (out[f"pos_{o}"] == F.col("_p")) & (F.upper(out[f"seq_{o}"]) == F.col(f"_flank_{o}")), "left").drop("_s", "_c", "_p", f"_flank_{o}")
    return out.select(*pairs.columns, F.coalesce("extended_5p", "seq_5p").alias("extended_5p"), F.coalesce("extended_3p", "seq_3p").alias("extended_3p"))


def prefix_counts(words: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prefix, reads): the words of each key that begin with a prefix.

    Both sides meet by equal prefixes: a word has as many as it has characters, so
    no pair is made that doesn't count.  Words of one key are summed before.
    """
    counted = words.groupBy(*keys, "word").agg(F.count("*").alias("_n"))
    begun = counted.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), lambda k: F.substring("word", F.lit(1), k))))
    return begun.join(asked.select("prefix").distinct(), "prefix").groupBy(*keys, "prefix").agg(F.sum("_n").alias("reads"))
