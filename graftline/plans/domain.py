"""The engine's own operators as queries: alignments, flanks, placements and genotypes made from ordinary tables.

Every line of lineitem is a read: contig = supplier, position = day of shipment,
CIGAR, clips, mismatches and mapping quality from its quantity, discount and tax,
sequence from digests of its keys.  Placements of flanks use the return flag as
contig.  Genotypes use customers as samples, orders as pairs, brands as clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import sequence as sq
from ..operators import align, assembly
from ..operators import consensus as cs
from ..operators.joins import band_join
from ..operators.stash import new_path, stash
from ..operators.unions import once
from ..params import FindFlanks, InferAligned, InferDatabase, PairFlanks
from ..schemas import ALIGNMENTS, CLUSTERSEQ, METHODS
from ..sources import files, indexed
from . import cohort, extend, flanks, infer, pairs
from .relational import table

#: Contigs of placements are as long as this many digests.
DIGESTS = 80


def bases(text: Column) -> Column:
    """A, C, G and T for the digits of a digest."""
    return F.translate(text, "0123456789abcdef", "ACGTACGTACGTACGT")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that reads are made of."""
    rows = table(spark, sf_dir, "lineitem")
    q, d, x = F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    rows = rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", F.datediff("l_shipdate", F.lit("1995-01-01")).alias("day"))
    rows = once(rows, {"q": q, "d": d, "x": x}).drop("l_quantity", "l_discount", "l_tax")
    kind = F.col("d") % 4
    rows = rows.withColumns(
        {
            "ln": F.when(F.col("q") % 5 == 0, F.col("q") % 13 + 1).otherwise(0),
            "rn": F.when(F.col("q") % 3 == 0, F.col("q") % 17 + 1).otherwise(0),
            "m1": 10 + F.col("q") % 23,
            "m2": F.when(kind > 0, 12 + F.col("d")).otherwise(0),
            "ins": F.when(kind == 1, F.col("x") + 1).when(kind == 3, F.col("x") + 30).otherwise(0),
            "del": F.when(kind == 2, F.col("x") + 1).otherwise(0),
        }
    )
    op = lambda n, o: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(o))).otherwise("")
    matched = F.col("m1") + F.col("m2")
    md = F.when(F.col("q") % 7 == 1, F.concat(F.lit("0A"), (matched - 1).cast("string"))).when(F.col("q") % 7 == 2, F.concat((matched - 1).cast("string"), F.lit("A0"))).otherwise(matched.cast("string"))
    return rows.withColumns({"cigar": F.concat(op("ln", "S"), op("m1", "M"), op("ins", "I"), op("del", "D"), op("m2", "M"), op("rn", "S")), "md": md, "len": F.col("ln") + matched + F.col("ins") + F.col("rn")})


def _cycle() -> Column:
    """Qualities of a read from its quantity's place on: 20 to 39 over and over, longer than any read of ``lines``."""
    return F.array(*[F.lit(20 + k % 20) for k in range(160)])


def _read(rows: DataFrame, contig: Column, name: Column, sample: Column, reverse: Column, mapq: Column) -> DataFrame:
    """Rows of ``lines`` as alignments."""
    text = F.repeat(bases(F.md5(F.concat_ws("-", "l_orderkey", "l_partkey").cast("binary"))), 4)
    rows = once(once(rows, {"cigar": cg.parse_cigar("cigar")}), {"_length": cg.reference_length("cigar")})
    out = rows.select(
        sample.alias("sample"),
        name.alias("read_name"),
        (F.when(F.col("l_linenumber") % 2 == 0, 0x80).otherwise(0x40) + F.when(F.col("l_linenumber") == 7, 0x100).otherwise(0)).alias("flag"),
        contig.alias("contig"),
        F.col("day").alias("ref_start"),
        (F.col("day") + F.col("_length")).alias("ref_end"),
        mapq.alias("mapq"),
        reverse.alias("is_reverse"),
        ((F.col("x") == 0) & (F.col("l_returnflag") == "N")).alias("is_unmapped"),
        (F.col("x") == 1).alias("mate_is_unmapped"),
        "cigar",
        F.substring(text, F.lit(1), F.col("len")).alias("seq"),
        F.slice(_cycle(), F.col("q") % 20 + 1, F.col("len")).alias("quals"),
        F.col("md"),
        (F.col("x") % 3).alias("nm"),
        F.col("q").alias("as_score"),
        F.lit(None).cast("string").alias("mate_seq"),
        F.lit(None).cast("string").alias("mate_quals"),
    )
    return out.select([F.col(f.name).cast(f.dataType) for f in ALIGNMENTS])


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads on the suppliers' contigs."""
    rows = lines(spark, sf_dir)
    return _read(rows, F.concat(F.lit("c"), F.col("l_suppkey")), F.concat(F.lit("r"), F.col("l_orderkey")), F.concat(F.lit("s"), F.col("l_linenumber") % 2), F.col("l_returnflag") == "R", 10 + 3 * F.col("d"))


def placed_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flanks of pairs (orders) on the return flags' contigs; odd lines are 3p flanks."""
    rows = lines(spark, sf_dir)
    name = F.concat_ws("_", "l_orderkey", (1 + F.col("l_linenumber") % 2).cast("string"))
    return _read(rows, F.concat(F.lit("c"), F.col("l_returnflag")), name, F.lit("s"), F.col("l_linestatus") == "F", F.lit(40))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return flags' contigs."""
    flags = table(spark, sf_dir, "lineitem").select("l_returnflag").distinct()
    return flags.select(F.concat(F.lit("c"), F.col("l_returnflag")).alias("name"), F.repeat(bases(F.md5(F.col("l_returnflag").cast("binary"))), DIGESTS).alias("seq"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' contigs."""
    rows = table(spark, sf_dir, "supplier")
    return rows.select(F.concat(F.lit("c"), F.col("s_suppkey")).alias("name"), F.repeat(bases(F.md5(F.col("s_suppkey").cast("string").cast("binary"))), DIGESTS).alias("seq"))


# --- clips and sites -------------------------------------------------------------------------------------------------


def clip_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every read shows of its ends: clips, sites, lengths, proportions, and whether it passes."""
    p = FindFlanks()
    rows = alignments(spark, sf_dir)
    both = {}
    for side in ("left", "right"):
        n = cg.lenient_length("cigar", "md", side)
        both |= {
            f"{side}_strict": cg.strictly_clipped("cigar", side),
            f"{side}_lenient": cg.leniently_clipped("cigar", "md", side),
            f"{side}_length": n,
            f"{side}_operation": cg.terminal_op_length("cigar", side),
            f"{side}_site": cg.clip_site("cigar", "md", "ref_start", "ref_end", side),
            f"{side}_seq": cg.clipped_seq("seq", n, side),
            f"{side}_quality": F.aggregate(cg.clipped_quals("quals", n, side), F.lit(0), lambda a, x: a + x),
            f"{side}_share": F.round(cg.clip_proportion("cigar", "seq", side), 6),
        }
    inner, identity = cg.inner_length("seq", "cigar", "md"), F.round(sq.percent_identity(cg.query_aligned_length("cigar"), "nm"), 6)
    passes = cg.passes_read_filters(p.min_alignment_quality, p.min_alignment_inner_length)
    return rows.select("sample", "read_name", "contig", "ref_start", "ref_end", *[c.alias(n) for n, c in both.items()], inner.alias("inner_length"), identity.alias("identity"), passes.alias("passes"))


def cigar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every aligned block of every read, with the gap and the insertion before it."""
    rows = alignments(spark, sf_dir).select("read_name", "contig", "ref_start", F.explode(cg.blocks("cigar", "ref_start")).alias("b"))
    return rows.select("read_name", "contig", "ref_start", F.col("b.start").alias("block_start"), F.col("b.end").alias("block_end"), F.col("b.gap").alias("gap"), F.col("b.inserted").alias("inserted"))


def clip_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each clipped end of a read that passes: site, word outwards, summed quality."""
    rows = flanks.clips(alignments(spark, sf_dir), FindFlanks())
    return rows.select("sample", "contig", "pos", "orient", "read_name", "clip_len", "word", F.aggregate("quals", F.lit(0), lambda a, x: a + x).alias("quality"), F.col("quals")[0].alias("first_quality"))


def clip_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with a clip of enough length that have a site of the other orientation near."""
    p = FindFlanks(min_softclip_count=1)
    return flanks.mate_filter(flanks.clip_counts(flanks.clips(alignments(spark, sf_dir), p, words=False), p), p)


def site_evidence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten counts of reads at each site, their total, and the keep flags after the ratio filter."""
    p, rows = FindFlanks(), alignments(spark, sf_dir)
    sites = stash(flanks.clip_counts(flanks.clips(rows, p, words=False), p), "sites")
    return flanks.ratio_filter(flanks.with_counts(sites, flanks.evidence(rows, sites, p, files.contigs_of(genome(spark, sf_dir)))), p)


def recall_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts at asked sites: those of every line of quantity 50."""
    asked = lines(spark, sf_dir).filter("q = 50").select(F.concat(F.lit("c"), F.col("l_suppkey")).alias("contig"), F.col("day").alias("pos_5p"), (F.col("day") - 5).alias("pos_3p"))
    rows = alignments(spark, sf_dir).withColumn("sample", F.lit("s"))
    return flanks.recall(rows, asked, FindFlanks())


def merged_clip_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word for each site, orientation and read name, of the bases of higher quality."""
    rows = flanks.merged_words(flanks.clips(alignments(spark, sf_dir), FindFlanks()).withColumn("sample", F.lit("s")))
    return rows.select("contig", "pos", "orient", "read_name", "word", F.aggregate("quals", F.lit(0), lambda a, x: a + x).alias("quality"))


def words_of_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped words by site (supplier and part), alike at a site but for one changed base in some."""
    rows = lines(spark, sf_dir)
    text = bases(F.md5(F.concat_ws("-", (F.col("x") % 2).cast("string"), "l_partkey").cast("binary")))
    n = 6 + F.col("q") % 20
    word = F.substring(F.when(F.col("d") == 9, F.concat(F.substring(text, F.lit(1), F.lit(4)), F.lit("T"), F.substring(text, F.lit(6), F.lit(40)))).otherwise(text), F.lit(1), n)
    quals = F.transform(F.sequence(F.lit(0), n - 1), lambda i: 10 + (i * 7 + F.col("q")) % 30)
    return rows.select(F.col("l_partkey").alias("pos"), F.col("l_linestatus").alias("orient"), word.alias("word"), quals.alias("quals"))


def prefix_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus words of the clusters of each part's and status's words, with their reads."""
    return cs.consensus_clusters(words_of_sites(spark, sf_dir), ["pos", "orient"])


def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each part whose word begins with one of the prefixes that occur at part 1."""
    words = words_of_sites(spark, sf_dir).select("pos", "word")
    asked = words.filter("pos = 1").select(F.explode(F.sequence(F.lit(1), F.length("word"))).alias("n"), "word").select(F.expr("substring(word, 1, n)").alias("prefix")).distinct()
    return extend.prefix_counts(words, asked, ["pos"])


def found_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flank discovery as a whole, for single reads: clips, mates, evidence, ratios, consensus, numbers."""
    p = FindFlanks(min_softclip_length=3, min_softclip_count=1, min_count_consensus=1)
    rows = alignments(spark, sf_dir)
    return flanks.find_flanks(rows, p, files.contigs_of(genome(spark, sf_dir)).drop("number")).drop("flank_id")


# --- pairs -----------------------------------------------------------------------------------------------------------


def _paired_sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reads, candidate pairs of clip sites with their counts)."""
    p = FindFlanks(min_softclip_count=1)
    rows = alignments(spark, sf_dir).withColumn("sample", F.lit("s"))
    sites = stash(flanks.clip_counts(flanks.clips(rows, p, words=False), p), "sites")
    five = sites.filter("keep_5p").select("sample", "contig", F.col("pos").alias("pos_5p"), F.col("softclip_count_5p"))
    three = sites.filter("keep_3p").select("sample", "contig", F.col("pos").alias("pos_3p"), F.col("softclip_count_3p"))
    return rows, band_join(five, three, ["sample", "contig"], "pos_5p", "pos_3p", PairFlanks().max_direct_repeat_length + 1)


def junction_spanning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs with the reads that run through their whole junction."""
    rows, candidates = _paired_sites(spark, sf_dir)
    return pairs.spanning_counts(candidates, rows, PairFlanks()).select("contig", "pos_5p", "pos_3p", "softclip_count_5p", "softclip_count_3p", "spanning_count")


def junction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those pairs of which few reads run through the junction, measured by the clips of both sides."""
    rows, candidates = _paired_sites(spark, sf_dir)
    counted = pairs.spanning_counts(candidates.withColumn("total_count_5p", F.col("softclip_count_5p")).withColumn("total_count_3p", F.col("softclip_count_3p")), rows, PairFlanks())
    return pairs.junction_filter(counted, PairFlanks()).select("contig", "pos_5p", "pos_3p", "softclip_count_5p", "softclip_count_3p", "spanning_count")


def region_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus of reads and reference around every line of quantity 7."""
    regions = lines(spark, sf_dir).filter("q = 7").select(F.col("l_orderkey").alias("pair_id"), F.concat(F.lit("c"), F.col("l_suppkey")).alias("contig"), (F.col("day") - 5).alias("start"), (F.col("day") + 5).alias("end")).distinct()
    return pairs.region_consensus(regions, alignments(spark, sf_dir), genome(spark, sf_dir), ["pair_id", "contig", "start", "end"], "consensus_seq")


def inverted_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted repeats of the ends of each part's sequence and that of the part before, which half the parts share."""
    rows = table(spark, sf_dir, "part").select("p_partkey", bases(F.md5((F.col("p_partkey") - F.col("p_partkey") % 2).cast("string").cast("binary"))).alias("shared"), bases(F.md5(F.concat(F.lit("x"), F.col("p_partkey").cast("string")).cast("binary"))).alias("own"), "p_size")
    five = F.concat(F.substring("own", F.lit(1), F.col("p_size") % 6), F.substring("shared", 1, 18), F.substring("own", 20, 10))
    turned = sq.revcomp(F.concat(F.substring("own", F.lit(8), F.col("p_size") % 9), F.substring("shared", F.lit(1), 8 + F.col("p_size") % 11), F.substring("own", 1, 12)))
    found = rows.select("p_partkey", five.alias("five"), turned.alias("three"))
    return found.withColumn("ir", sq.inverted_repeats("five", "three")).select("p_partkey", F.col("ir.IR_5p").alias("ir_5p"), F.col("ir.IR_3p").alias("ir_3p"))


# --- assembly --------------------------------------------------------------------------------------------------------

#: Bases of each supplier's element, of a read, and of a word.
ELEMENT, READ, WORD = 256, 40, 12


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, element): the sequence that a supplier's reads are of."""
    digests = [F.md5(F.concat(F.col("s_suppkey").cast("string"), F.lit(f"-{j}")).cast("binary")) for j in range(ELEMENT // 32)]
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), bases(F.concat(*digests)).alias("element"))


def element_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, seq, quals): a read for each line at a place of its supplier's element, with a wrong base of low quality where the discount is 1 %."""
    rows = lines(spark, sf_dir).withColumn("at", 1 + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % (ELEMENT - READ + 1))
    rows = rows.join(elements(spark, sf_dir), F.col("l_suppkey") == F.col("site"))
    right = F.substring("element", F.col("at"), F.lit(READ))
    wrong = F.concat(F.substring(right, F.lit(1), 9 + F.col("x")), F.translate(F.substring(right, 10 + F.col("x"), F.lit(1)), "ACGT", "CGTA"), F.substring(right, 11 + F.col("x"), F.lit(READ)))
    bad = F.col("d") == 1
    quals = F.transform(F.sequence(F.lit(0), F.lit(READ - 1)), lambda i: F.when(bad & (i == 9 + F.col("x")), 2).otherwise(20 + (i + F.col("q")) % 20))
    return rows.select("site", F.when(bad, wrong).otherwise(right).alias("seq"), quals.alias("quals"))


def local_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contigs of every supplier's reads."""
    found = assembly.assemble(element_reads(spark, sf_dir), ["site"], assembly.Assembly(word=WORD))
    return found.select("site", "seq", "length", F.round("support", 6).alias("support"), "circular")


def flank_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty bases of every supplier's element, drawn out along the graph of its reads."""
    p = assembly.Assembly(word=WORD)
    flanks_ = elements(spark, sf_dir).select("site", F.substring("element", 1 + (F.col("site") % 200).cast("int"), F.lit(30)).alias("flank"))
    return assembly.walk(flanks_, ["site"], assembly.build(element_reads(spark, sf_dir), ["site"], p), p)


def flank_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places where 45 bases of each supplier's contig, every second on the other strand, align without a difference."""
    contigs = genome(spark, sf_dir)
    cut = F.expr("substring(seq, 1 + cast(substring(name, 2) as int) * 13 % 2000, 45)")
    odd = F.expr("cast(substring(name, 2) as int) % 2 = 1")
    flanks_ = contigs.select(F.lit("s").alias("sample"), F.concat(F.lit("f"), F.expr("substring(name, 2)")).alias("name"), F.when(odd, sq.revcomp(cut)).otherwise(cut).alias("seq"))
    found = align.align(flanks_, contigs).filter("nm = 0 and size(cigar) = 1")
    return found.select("read_name", "contig", "ref_start", "ref_end", "is_reverse", "as_score")


# --- inference -------------------------------------------------------------------------------------------------------


def flank_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements of enough identity whose outer end isn't clipped inside their contig."""
    rows = infer.flank_filter(infer.placements(placed_flanks(spark, sf_dir), targets(spark, sf_dir)), InferAligned().min_perc_identity)
    return rows.select("pair_id", "mate", "contig", "start", "end", "score", "left_clip", "right_clip", F.round("identity", 6).alias("identity"))


def _inferred(rows: DataFrame) -> DataFrame:
    return rows.select("pair_id", "method", "loc", "inferred_seq_length", F.md5(F.col("inferred_seq").cast("binary")).alias("seq_md5"))


def infer_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions whose flanks are placed on one contig, the nearest pairs of best score."""
    return _inferred(infer.infer_reference(placed_flanks(spark, sf_dir), targets(spark, sf_dir)))


def infer_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 25 bases of context on both sides."""
    return _inferred(infer.infer_in_context(placed_flanks(spark, sf_dir), targets(spark, sf_dir)))


def element_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements near an element's ends."""
    rows = infer.element_filter(infer.placements(placed_flanks(spark, sf_dir), targets(spark, sf_dir)), InferDatabase(max_edge_distance=400))
    return rows.select("pair_id", "mate", "contig", "start", "end", "score", "left_clip", "right_clip")


def infer_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known elements that both flanks of a pair reach the ends of, matched by the greatest distance."""
    return _inferred(infer.infer_database(placed_flanks(spark, sf_dir), targets(spark, sf_dir), InferDatabase(max_edge_distance=900, max_internal_softclip_prop=0.2)))


def inferred_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions that both flanks span: each order's flanks share their end and their start."""
    rows = lines(spark, sf_dir).filter("l_linenumber = 1").select("l_orderkey", "q", "d", "x", bases(F.md5(F.concat_ws("-", "l_orderkey", "l_partkey", "q").cast("binary"))).alias("t"), bases(F.md5(F.concat_ws("+", "l_orderkey", "l_suppkey", "q").cast("binary"))).alias("u"))
    five = F.concat("u", F.substring("t", F.lit(1), 6 + F.col("q") % 25))
    start = F.substring("t", F.lit(1), 6 + F.col("q") % 25)
    three = F.concat(F.when(F.col("d") == 3, F.concat(F.lit("N"), F.expr("substring(t, 2, 5 + q % 25)"))).otherwise(start), F.substring(F.reverse("u"), F.lit(1), 4 + F.col("x")))
    made = rows.select(F.lit("s").alias("sample"), F.col("l_orderkey").cast("int").alias("pair_id"), five.alias("seq_5p"), three.alias("seq_3p"))
    return infer.infer_overlap(made).select("pair_id", "method", "loc", "inferred_seq_length", "inferred_seq")


# --- cohort ----------------------------------------------------------------------------------------------------------


def _method(k: Column) -> Column:
    """Six methods for six residues."""
    out = F.lit(METHODS[5])
    for i, m in enumerate(METHODS[:5]):
        out = F.when(k == i, m).otherwise(out)
    return out


def _base() -> Column:
    """A part's sequence, made once for a part and not for each of its lines."""
    return F.repeat(bases(F.md5(F.col("p_size").cast("string").cast("binary"))), 3)


def clusterseq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred sequences: a row for each line; cluster = brand, group = type, method from quantity and discount."""
    rows = lines(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("sample"))
    names = [F.concat(F.lit("s"), F.col("p_size")).alias("seqid"), F.concat(F.lit("c"), F.substring("p_brand", 7, 10)).alias("cluster"), F.concat(F.lit("g"), F.col("p_type")).alias("group")]
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), *names, _base().alias("inferred_seq"))
    out = rows.join(orders, "l_orderkey").join(parts, "l_partkey").select(
        "sample",
        F.col("l_orderkey").alias("pair_id"),
        _method((F.col("q") + F.col("d")) % 6).alias("method"),
        F.lit("").alias("loc"),
        F.length("inferred_seq").alias("inferred_seq_length"),
        "seqid",
        "cluster",
        "group",
        "inferred_seq",
    )
    return out.select([F.col(f"`{f.name}`").cast(f.dataType) for f in CLUSTERSEQ])


def candidate_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of flanks: an order of a customer, at the nation's contig and the order's day."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1995-01-01")).alias("day"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = orders.join(customers, "o_custkey")
    return rows.select(F.col("o_custkey").cast("string").alias("sample"), F.col("o_orderkey").cast("int").alias("pair_id"), F.concat(F.lit("c"), F.col("c_nationkey")).alias("contig"), F.col("day").alias("pos_5p"), (F.col("day") - 6).alias("pos_3p"))


def genotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes of all pairs: best evidence, then support at the site, then mobility, the rest combined."""
    return cohort.genotype([candidate_insertions(spark, sf_dir)], clusterseq(spark, sf_dir))


def genotype_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster summary of these genotypes."""
    seqs = stash(clusterseq(spark, sf_dir), "clusterseq")
    out = cohort.summarize(stash(cohort.genotype([candidate_insertions(spark, sf_dir)], seqs), "genotypes"), seqs)
    return out.withColumn("mean_length", F.round("mean_length", 6)).withColumn("mean_copy", F.round("mean_copy", 6))


def cluster_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of the clusters that genotypes name."""
    seqs = clusterseq(spark, sf_dir)
    rows = cohort.cluster_fasta(cohort.genotype([candidate_insertions(spark, sf_dir)], seqs), seqs)
    return rows.select("name", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def null_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs there are, with and without an inferred sequence."""
    return cohort.null_genotypes([candidate_insertions(spark, sf_dir)], clusterseq(spark, sf_dir).filter("method = 'inferred_overlap'"))


def evidence_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each cluster by method, and whether an assembly gave it."""
    rows = clusterseq(spark, sf_dir)
    counts = rows.groupBy("cluster").agg(*[F.count_if(F.col("method") == m).alias(m) for m in METHODS])
    kept = cohort.assembly_clusters(rows.filter("seqid <> 's1' and inferred_seq_length > 0")).withColumn("from_assembly", F.lit(True))
    return counts.join(kept, "cluster", "left").withColumn("from_assembly", F.coalesce("from_assembly", F.lit(False)))


def shared_pair_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of clusters (brands with a size) that occur at one pair of a few customers."""
    rows = clusterseq(spark, sf_dir).withColumn("cluster", F.concat_ws(".", "cluster", "seqid")).drop("group")
    return cohort.with_groups(rows).select("cluster", "group").distinct()


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred sequences in families: one for each size, with a changed base, a lost end or the other strand in some lines."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), _base().alias("_s"), sq.revcomp(_base()).alias("_r"))
    rows = lines(spark, sf_dir).join(parts, "l_partkey")
    own = F.when(F.col("d") == 1, F.concat(F.expr("substring(_s, 1, 40 + x)"), F.lit("A"), F.expr("substring(_s, 42 + x, 100)"))).when(F.col("d") == 2, F.expr("substring(_s, 1, 96 - x)")).when(F.col("d") == 3, F.col("_r")).otherwise(F.col("_s"))
    out = rows.withColumn("_t", own)
    return out.select(F.lit("s").alias("sample"), F.col("l_orderkey").cast("int").alias("pair_id"), _method((F.col("q") + F.col("d")) % 6).alias("method"), F.lit("").alias("loc"), F.length("_t").alias("inferred_seq_length"), F.col("_t").alias("inferred_seq"))


def clustered_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those sequences numbered longest first, clustered by near identity, and grouped by shared pairs."""
    rows = cohort.cluster_sequences([families(spark, sf_dir).filter("method <> 'inferred_database'")])
    return rows.groupBy("seqid", "cluster", "group").agg(F.count("*").alias("n"), F.min("inferred_seq_length").alias("length"))


def element_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representative of each family of near-identical sequences."""
    return cohort.make_database([families(spark, sf_dir)]).select("name", F.length("seq").alias("length"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


# --- sources ---------------------------------------------------------------------------------------------------------


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts written as FASTA under names with blanks and marks, and read back."""
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(" A>B fusion")).alias("name"), "text")
    path = new_path(spark, "fasta")
    files.write_fasta(rows, path, "name", "text")
    return files.read_fasta(spark, path).select("name", F.length("seq").alias("length"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered sequences written as a table with a header, and read back by schema."""
    path = new_path(spark, "tsv")
    files.write_tsv(clusterseq(spark, sf_dir), path)
    rows = files.read_tsv(spark, [path], CLUSTERSEQ)
    return rows.groupBy("cluster", "method").agg(F.count("*").alias("n"), F.sum("pair_id").alias("pairs"), F.sum("inferred_seq_length").alias("bases"), F.min("seqid").alias("least_seqid"))


def sam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as SAM text and read back, with their parsed fields."""
    path = new_path(spark, "sam")
    files.write_sam(alignments(spark, sf_dir), path, compression="gzip")
    rows = files.read_sam(spark, path, "s")
    return rows.select("read_name", "flag", "contig", "ref_start", "ref_end", "mapq", "is_unmapped", F.size("cigar").alias("operations"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.aggregate("quals", F.lit(0), lambda a, x: a + x).alias("quality"), "md", "nm", "as_score")


def _parsed(rows: DataFrame) -> DataFrame:
    """What was read of alignments, field by field."""
    return rows.select("read_name", "flag", "contig", "ref_start", "ref_end", "mapq", "is_unmapped", F.size("cigar").alias("operations"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.aggregate("quals", F.lit(0), lambda a, x: a + x).alias("quality"), "md", "nm", "as_score")


def _as_bam(spark: SparkSession, sf_dir: str) -> str:
    """The alignments as a folder of indexed BAM files."""
    path = new_path(spark, "bam")
    contigs = genome(spark, sf_dir).select(F.col("name").alias("contig"), F.length("seq").alias("length"))
    indexed.write_bam(alignments(spark, sf_dir), path, contigs)
    return path


def bam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as indexed BAM files in order of place, and read back whole."""
    return _parsed(indexed.read_indexed(spark, _as_bam(spark, sf_dir), "s"))


def region_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads over a window of 20 days on every second supplier's contig, fetched through the index."""
    asked = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("c"), F.col("s_suppkey")).alias("c"), (F.col("s_suppkey") * 37 % 2000).cast("int").alias("a")).collect()
    return _parsed(indexed.read_indexed(spark, _as_bam(spark, sf_dir), "s", [(r["c"], r["a"], r["a"] + 20) for r in asked]))


def formatted_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary alignments with their mate's sequence and qualities."""
    rows = files.format_alignments(alignments(spark, sf_dir).withColumn("sample", F.lit("s")))
    return rows.select("read_name", "flag", "contig", "ref_start", "seq", "mate_seq", F.md5(F.col("mate_quals").cast("binary")).alias("mate_quals_md5"))


def cluster_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand as a cluster listing, whose representative is its least part, written and read back."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))
    body = F.transform("parts", lambda x, i: F.concat(i.cast("string"), F.lit("\t100nt, >p"), x.cast("string"), F.when(i == 0, "... *").otherwise("... at +/99%")))
    text = rows.select(F.concat_ws("\n", F.concat(F.lit(">Cluster "), F.col("p_brand")), F.array_join(body, "\n")).alias("value"))
    path = new_path(spark, "listing")
    text.coalesce(1).write.text(path)
    return files.parse_clusters(spark.read.text(path))


# --- scalar functions ------------------------------------------------------------------------------------------------


def poisson_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(X >= quantity) at a mean of ten times the discount and tax, for every line."""
    rows = lines(spark, sf_dir).select("l_orderkey", "q", (F.col("d") + F.col("x") * 3).alias("mean"))
    return rows.select("l_orderkey", "q", "mean", F.round(sq.poisson_upper_tail("q", "mean"), 9).alias("tail"))


def phred_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities of urls read as quality strings: how many, their sum and greatest, and the string made of them again."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", sq.phred("url").alias("q"))
    return rows.select("page_id", F.size("q").alias("n"), F.aggregate("q", F.lit(0), lambda a, x: a + x).alias("total"), F.array_max("q").alias("most"), sq.phred_string("q").alias("url"))


QUERIES = (
    clip_accessors,
    cigar_blocks,
    clip_words,
    clip_sites,
    site_evidence_classes,
    recall_counts,
    merged_clip_words,
    prefix_consensus,
    prefix_counts,
    found_flanks,
    junction_spanning,
    junction_filter,
    region_consensus,
    inverted_repeats,
    local_assembly,
    flank_extension,
    flank_places,
    flank_prefilter,
    infer_reference,
    infer_in_context,
    element_filter,
    infer_database,
    inferred_overlaps,
    genotype,
    genotype_summary,
    cluster_fasta,
    null_genotypes,
    evidence_methods,
    shared_pair_groups,
    clustered_sequences,
    element_database,
    fasta_round_trip,
    tsv_round_trip,
    sam_round_trip,
    bam_round_trip,
    region_fetch,
    formatted_alignments,
    cluster_listing,
    poisson_tail,
    phred_values,
)
