"""The cohort's tail: clustering, genotyping, summaries, database and FASTA tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import canonical
from ..operators import matching
from ..operators.dedupe import Identity, identity_clusters
from ..operators.graph import connected_components
from ..operators.stash import stash
from ..operators.unions import union_all
from ..params import ClusterSeq, Genotype, MakeDatabase
from ..schemas import CLUSTERSEQ, CONF_OF_METHOD, CONFS, FULL_CONTEXT, GENOTYPES, HALF_CONTEXT, NO_CONTEXT, STRICT_CONFS

PAIR = ["sample", "pair_id"]


def union_inferred(frames: list[DataFrame], least: int, most: int) -> DataFrame:
    """All inferred sequences of the size window, of every input alike."""
    return union_all(frames).filter(F.col("inferred_seq_length").between(least, most))


# --- clustering ------------------------------------------------------------------------------------------------------


def _text(seq: str) -> Column:
    """What rows of one text share; as short for a long sequence."""
    return F.md5(F.col(seq).cast("binary"))


def turned_sequences(rows: DataFrame, seq: str = "inferred_seq") -> DataFrame:
    """(text, key, seq) for each distinct text: its own digest, its digest up to strand, and it in upper case; copies are not turned."""
    return rows.select(seq).distinct().select(_text(seq).alias("text"), F.md5(canonical(seq).cast("binary")).alias("key"), F.upper(seq).alias("seq"))


def unique_sequences(turned: DataFrame) -> DataFrame:
    """(key, seq): one sequence for each, up to strand: the least; of ``turned_sequences``."""
    return turned.groupBy("key").agg(F.min("seq").alias("seq"))


def cluster_sequences(inferred: list[DataFrame], p: ClusterSeq = ClusterSeq()) -> DataFrame:
    """The clusterseq table: seqid by equal sequence, cluster by near identity, group by shared pairs.

    Labels number the sequences longest first.  A cluster is ``c`` and the number of
    its representative; clusters that occur at one pair are of one group.
    """
    rows = stash(union_inferred(inferred, p.minimum_size, p.maximum_size), "inferred")
    turned = stash(turned_sequences(rows), "turned")
    seqs = stash(unique_sequences(turned), "unique")
    found = identity_clusters(seqs, "key", "seq", Identity(p.identity, p.coverage))
    # Numbers need one order over all unique sequences: ranks within length bins, offset by the bins before.
    bins = seqs.groupBy(F.length("seq").alias("n")).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = bins.select("n", before.alias("before"))
    numbered = seqs.join(offset, F.length("seq") == F.col("n")).select("key", (F.col("before") + F.row_number().over(Window.partitionBy("n").orderBy("key"))).alias("number"))
    reps = numbered.select(F.col("key").alias("rep"), F.concat(F.lit("c"), F.col("number").cast("string")).alias("cluster"))
    ids = found.select(F.col("id").alias("key"), "rep").join(numbered, "key").join(reps, "rep").select("key", F.concat(F.lit("s"), F.col("number").cast("string")).alias("seqid"), "cluster")
    ids = stash(turned.select("text", "key").join(ids, "key").select("text", "seqid", "cluster"), "ids")  # a table of known size: rows stay where they are if it is small
    labelled = stash(rows.join(ids, _text("inferred_seq") == F.col("text")).drop("text"), "labelled")
    return with_groups(labelled).select([F.col(f"`{f.name}`").cast(f.dataType) for f in CLUSTERSEQ])


def with_groups(rows: DataFrame) -> DataFrame:
    """Clusters that share a (sample, pair) are one group, ``g1`` on in order of their least cluster."""
    held = rows.filter(F.col("sample").isNotNull() & F.col("pair_id").isNotNull()).select(*PAIR, "cluster").distinct()
    before = F.lag("cluster").over(Window.partitionBy(*PAIR).orderBy("cluster"))
    edges = held.select(before.alias("u"), F.col("cluster").alias("v")).filter("u <> v").distinct()
    found = connected_components(edges, rows.select(F.col("cluster").alias("node")))
    roots = found.select("component").distinct()
    # Numbers in order of length, then name: within buckets of names alike but for their end, after those of the buckets before.
    bucket = F.struct(F.length("component").alias("n"), F.expr("substring(component, 1, greatest(length(component) - 4, 0))").alias("start"))
    roots = stash(roots.withColumn("_bucket", bucket), "roots")
    sizes = roots.groupBy("_bucket").agg(F.count("*").alias("_c"))
    sizes = sizes.select("_bucket", F.coalesce(F.sum("_c").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_bucket").orderBy("component"))
    numbers = roots.join(sizes, "_bucket").select("component", F.concat(F.lit("g"), place.cast("string")).alias("group"))
    return rows.join(stash(found.join(numbers, "component").select(F.col("node").alias("cluster"), "group"), "groups"), "cluster")


def make_database(inferred: list[DataFrame], p: MakeDatabase = MakeDatabase()) -> DataFrame:
    """(name, seq): one representative of each near-identity cluster, all inputs size-filtered."""
    seqs = stash(unique_sequences(turned_sequences(union_inferred(inferred, p.minimum_size, p.maximum_size))), "unique")
    reps = identity_clusters(seqs, "key", "seq", Identity(p.identity, p.coverage)).select(F.col("rep").alias("key")).distinct()
    return seqs.join(reps, "key").select(F.concat(F.lit("e"), F.substring("key", 1, 12)).alias("name"), "seq")


# --- genotyping ------------------------------------------------------------------------------------------------------


def _conf(method: Column, of: int) -> Column:
    pairs = [F.lit(x) for m, c in CONF_OF_METHOD.items() for x in (m, c[of])]
    return F.create_map(*pairs)[method]


def assembly_clusters(clusterseq: DataFrame) -> DataFrame:
    """Clusters that an assembly gave at least once."""
    return clusterseq.filter(F.col("method").isin(FULL_CONTEXT, HALF_CONTEXT, NO_CONTEXT)).select("cluster").distinct()


def best_evidence(pairs: DataFrame, clusterseq: DataFrame) -> DataFrame:
    """Every pair's candidate (seqid, cluster, group) rows of its best confidence, repeated ones too; pairs without any go."""
    held = clusterseq.select(*PAIR, "seqid", "cluster", "group", _conf(F.col("method"), 0).alias("conf"), _conf(F.col("method"), 1).alias("_rank"))
    best = matching.cascade(held.filter(F.col("conf").isNotNull()), PAIR, F.col("_rank")).drop("_rank")
    return pairs.select(*PAIR, "contig", "pos_3p", "pos_5p").join(best, PAIR)


def null_genotypes(pairs: list[DataFrame], clusterseq: DataFrame) -> DataFrame:
    """One row (candidates, with_inference, without_inference): distinct pairs, with and without an inferred sequence."""
    every = union_all(pairs).select(*PAIR).distinct()
    found = clusterseq.select(*PAIR).distinct().withColumn("_found", F.lit(True))
    has = F.col("_found").isNotNull()
    return every.join(found, PAIR, "left").agg(F.count("*").alias("candidates"), F.count_if(has).alias("with_inference"), F.count_if(~has).alias("without_inference"))


def _one_cluster() -> Column:
    """Whether a row's pair has one cluster alone; null if it has none."""
    own = Window.partitionBy(*PAIR)
    return F.min("cluster").over(own) == F.max("cluster").over(own)


def resolve(rows: DataFrame) -> DataFrame:
    """Genotypes: pairs of one cluster stay; others go by site support, then mobility; the rest is combined as A.

    A pair's seqids of one cluster are joined.  Support of a cluster is its rows at
    the same site over all samples.  A cluster is mobile with more than two sites,
    strictly if only confident rows count.  Of several strictly mobile clusters, or
    none, the one that is not leniently mobile stands if it is alone.
    """
    place = ["contig", "pos_5p", "pos_3p"]
    one = rows.groupBy(*PAIR, *place, "cluster", "group", "conf").agg(F.array_join(F.array_sort(F.collect_set("seqid")), ";").alias("seqid"))
    one = stash(one.withColumn("_clear", _one_cluster()), "evidence")
    clear, open_ = one.filter("_clear").drop("_clear"), one.filter("not _clear").drop("_clear")

    # One row for each site of a cluster, from which its sites are counted.
    sites = one.groupBy(*place, "cluster").agg(F.count("*").alias("support"), F.max(F.col("conf").isin(*STRICT_CONFS)).alias("_sure"))
    mobile = sites.groupBy("cluster").agg((F.count_if("_sure") > 2).alias("_strict"), (F.count("*") > 2).alias("_lenient"))
    top = matching.ties_at_max(open_.join(sites.drop("_sure"), [*place, "cluster"]), PAIR, F.col("support")).drop("support")
    own = Window.partitionBy(*PAIR)
    seen = top.withColumn("_clear", _one_cluster()).join(mobile, "cluster").withColumn("_ns", F.count_if("_strict").over(own)).withColumn("_nl", F.count_if(~F.col("_lenient")).over(own))
    verdict = F.when(F.col("_clear"), "ArSC").when((F.col("_ns") == 1) & F.col("_strict"), "ArMS").when((F.col("_ns") != 1) & (F.col("_nl") == 1) & ~F.col("_lenient"), "ArML").when((F.col("_ns") != 1) & (F.col("_nl") != 1), "A")
    keep = ["sample", "pair_id", *place, "cluster", "group", "conf", "seqid"]
    judged = stash(seen.withColumn("conf", verdict).filter(F.col("conf").isNotNull()).select(keep), "judged")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(c, ";"))))), ";")
    combined = judged.filter("conf = 'A'").groupBy(*PAIR, *place, "group").agg(joined("seqid").alias("seqid"), joined("cluster").alias("cluster")).withColumn("conf", F.lit("A"))
    return union_all([clear, judged.filter("conf <> 'A'"), combined])


def genotype(pairs: list[DataFrame], clusterseq: DataFrame, p: Genotype = Genotype()) -> DataFrame:
    """The genotypes table; always its nine columns, empty in, empty out."""
    held = clusterseq.join(assembly_clusters(clusterseq), "cluster", "left_semi") if p.filter_clusters_inferred_assembly else clusterseq
    rows = best_evidence(union_all(pairs), held)
    return resolve(rows).select([F.col(f"`{f.name}`").cast(f.dataType) for f in GENOTYPES])


# --- summaries -------------------------------------------------------------------------------------------------------


def exploded(genotypes: DataFrame) -> DataFrame:
    """One row for each cluster of a genotype."""
    return genotypes.withColumn("cluster", F.explode(F.split("cluster", ";")))


def site_counts(rows: DataFrame, key: str) -> DataFrame:
    sites = rows.groupBy(key, "contig", "pos_5p", "pos_3p").agg(F.max(F.col("conf") != "A").alias("_clear"))
    return sites.groupBy(key).agg(F.count("*").alias("num_unique_sites_all"), F.count_if("_clear").alias("num_unique_sites_unambig"))


def conf_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(*[F.count_if(F.col("conf") == c).alias(c) for c in CONFS])


def copy_counts(rows: DataFrame, key: str) -> DataFrame:
    by = rows.groupBy(key, "sample").agg(F.count("*").alias("n"))
    return by.groupBy(key).agg(F.count("*").alias("num_samples"), F.mean("n").alias("mean_copy"), F.max("n").alias("max_copy"))


def sequence_counts(clusterseq: DataFrame, keys: list[str]) -> DataFrame:
    """How often keys have a sequence: copies are counted before a sequence is turned, digested or compared."""
    return clusterseq.groupBy(*keys, "seqid", "inferred_seq").agg(F.count("*").alias("n"))


def length_stats(clusterseq: DataFrame, key: str) -> DataFrame:
    """Lengths of a key's distinct canonical sequences."""
    seqs = clusterseq.select(key, F.md5(canonical("inferred_seq").cast("binary")).alias("k"), F.length("inferred_seq").alias("n")).distinct()
    return seqs.groupBy(key).agg(F.count("*").alias("num_unique_seqs"), F.mean("n").alias("mean_length"), F.min("n").alias("min_length"), F.max("n").alias("max_length"))


def representatives(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent (seqid, sequence) of a key, then the longest, then the least seqid; of ``sequence_counts``."""
    by = counts.groupBy(*keys, "seqid").agg(F.sum("n").alias("n"), F.min(F.upper("inferred_seq")).alias("seq"))
    best = by.groupBy(keys[0]).agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.length("seq")).alias("l"), F.col("seqid"), F.col("seq"), *keys[1:])).alias("m"))
    return best.select(keys[0], *[F.col(f"m.{k}").alias(f"repr_{k}") for k in keys[1:]], F.col("m.seqid").alias("repr_seqid"), F.length("m.seq").alias("repr_seq_length"), F.col("m.seq").alias("repr_seq"))


def summarize(genotypes: DataFrame, clusterseq: DataFrame, key: str = "cluster") -> DataFrame:
    """The cluster summary, or with ``key='group'`` the group summary.

    Repeated copies in a sample count; ambiguous rows count for every cluster they
    name.  Ordered by unique sites, most first.
    """
    rows = exploded(genotypes)
    if key == "group":
        rows = rows.drop("cluster").distinct()
    keys = [key, "cluster"] if key == "group" else [key]
    seqs = stash(sequence_counts(clusterseq.filter(~F.col("cluster").startswith("UClust")), keys), "sequences")
    parts = [site_counts(rows, key), length_stats(seqs, key), copy_counts(rows, key), conf_counts(rows, key), representatives(seqs, keys)]
    out = reduce(lambda a, b: a.join(b, key), parts)
    if key == "cluster":
        out = rows.select("cluster", "group").distinct().join(out, "cluster")
    lead = [*(["cluster"] if key == "cluster" else []), "group", "num_unique_sites_all", "num_unique_sites_unambig", "num_unique_seqs", "mean_length", "min_length", "max_length", "num_samples", "mean_copy", "max_copy", *CONFS]
    tail = [*(["repr_cluster"] if key == "group" else []), "repr_seqid", "repr_seq_length", "repr_seq"]
    return out.select(*[F.col(f"`{c}`") for c in [*lead, *tail]]).orderBy(F.desc("num_unique_sites_all"), F.asc(key))


def cluster_fasta(genotypes: DataFrame, clusterseq: DataFrame) -> DataFrame:
    """(name, seq): the distinct sequences of clusters that genotypes name, as ``seqid|cluster|group``."""
    named = exploded(genotypes).select("cluster").distinct()
    kept = clusterseq.join(named, "cluster", "left_semi")
    return kept.groupBy("seqid", "cluster", "group").agg(F.min(F.upper("inferred_seq")).alias("seq")).select(F.concat_ws("|", "seqid", "cluster", "group").alias("name"), "seq")
