"""The operators as queries over ordinary tables.

Sites are read from lineitem: contig = supplier, position = part, read name =
order, orientation by line status, base = return flag, quality = quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import consensus, dedupe, graph, joins, matching
from ..operators.unions import union_all

MATE_DISTANCE = 22
MAX_REPEAT = 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clipped read for each line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("contig"),
        F.col("l_partkey").alias("pos"),
        F.col("l_orderkey").alias("name"),
        F.when(F.col("l_linestatus") == "O", "5p").otherwise("3p").alias("orient"),
        F.col("l_returnflag").alias("base"),
        F.col("l_quantity").cast("int").alias("qual"),
    )


def sites(rows: DataFrame, least: int = 2) -> DataFrame:
    """Positions and orientations with enough distinct read names."""
    return rows.groupBy("contig", "pos", "orient").agg(F.countDistinct("name").alias("n_names")).filter(F.col("n_names") >= least)


def site_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct read names at each site by orientation, their total and ratio."""
    by = reads(spark, sf_dir).groupBy("contig", "pos").agg(F.countDistinct(F.when(F.col("orient") == "5p", F.col("name"))).alias("clips_5p"), F.countDistinct(F.when(F.col("orient") == "3p", F.col("name"))).alias("clips_3p"))
    total = F.col("clips_5p") + F.col("clips_3p")
    return by.select("contig", "pos", "clips_5p", "clips_3p", total.alias("total"), F.round(F.try_divide(F.col("clips_5p").cast("double"), total), 6).alias("ratio_5p")).filter((F.col("clips_5p") >= 2) | (F.col("clips_3p") >= 2))


def nearest_mate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with a site of the other orientation strictly beside them within the mate distance."""
    own = sites(reads(spark, sf_dir))
    near = joins.nearest_within(own, ["contig"], "pos", F.col("orient") == "5p", F.col("orient") == "3p", MATE_DISTANCE)
    return near.filter(F.when(F.col("orient") == "5p", F.col("near_5p")).otherwise(F.col("near_3p"))).select("contig", "pos", "orient", "n_names")


def reads_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reads placed at their day of shipment, where sites of both orientations lie close together at any size."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("contig"), F.datediff("l_shipdate", F.lit("1995-01-01")).alias("pos"), F.col("l_orderkey").alias("name"), F.when(F.col("l_linestatus") == "O", "5p").otherwise("3p").alias("orient"))


def candidates(rows: DataFrame) -> DataFrame:
    own = sites(rows, 1)
    five = own.filter("orient = '5p'").select("contig", F.col("pos").alias("pos_5p"), F.col("n_names").alias("n_5p"))
    three = own.filter("orient = '3p'").select("contig", F.col("pos").alias("pos_3p"), F.col("n_names").alias("n_3p"))
    return joins.band_join(five, three, ["contig"], "pos_5p", "pos_3p", MAX_REPEAT)


def pair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5p and 3p sites of a contig with the 3p site at most 21 below."""
    return candidates(reads_by_day(spark, sf_dir)).select("contig", "pos_5p", "pos_3p", "n_5p", "n_3p")


def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairing of the candidates: least difference in support, then shortest repeat."""
    order = [F.abs(F.col("n_5p") - F.col("n_3p")), F.col("pos_5p") - F.col("pos_3p"), F.col("contig"), F.col("pos_5p")]
    return matching.greedy_match(candidates(reads_by_day(spark, sf_dir)), ["contig", "pos_5p"], ["contig", "pos_3p"], order).select("contig", "pos_5p", "pos_3p", "n_5p", "n_3p")


def event_pairs_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the same user's clicks of the six hours before."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("us").alias("bought_us"))
    clicked = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("us").alias("clicked_us"))
    pairs = joins.band_join(bought, clicked, ["user_id"], "bought_us", "clicked_us", 6 * 3600 * 1_000_000)
    return pairs.select("user_id", "purchase_id", "click_id", (F.col("bought_us") - F.col("clicked_us")).alias("gap_us"))


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last click strictly before it."""
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought_at"))
    clicked = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked_at"))
    found = joins.asof(bought, clicked, ["user_id"], "bought_at", "clicked_at", ["click_id"])
    return found.select("user_id", "purchase_id", "click_id", (F.unix_micros(F.col("bought_at").cast("timestamp")) - F.unix_micros(F.col("clicked_at").cast("timestamp"))).alias("gap_us"))


def weighted_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base of the greatest summed quality at each site, N on a tie."""
    return consensus.unique_argmax(reads(spark, sf_dir), ["contig", "pos", "orient"], "base", F.col("qual").cast("long"))


def consensus_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site consensus joined along each contig in windows of 1000 positions."""
    base = consensus.unique_argmax(reads(spark, sf_dir), ["contig", "pos"], "base", F.col("qual").cast("long"))
    windows = base.withColumn("window", F.floor(F.col("pos") / 1000).cast("long"))
    return consensus.ordered_concat(windows, ["contig", "window"], "pos", "consensus", "consensus_seq")


def mate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One base for each read name at a site: the one of the highest quality."""
    return consensus.merge_mates(reads(spark, sf_dir), ["contig", "pos", "name"])


def spanning_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each site, the orders whose span on its contig reaches over it by more than one position on both sides."""
    rows = reads(spark, sf_dir)
    spans = rows.groupBy("contig", "name").agg(F.min("pos").alias("ref_start"), (F.max("pos") + 1).alias("ref_end"))
    own = sites(rows, 1).select("contig", "pos").distinct().withColumn("site_end", F.col("pos") + 1)
    over = joins.interval_join(own, spans, ["contig"], ("pos", "site_end"), ("ref_start", "ref_end"), levels=3)
    return over.filter("ref_start < pos - 1 and ref_end > pos + 2").groupBy("contig", "pos").agg(F.countDistinct("name").alias("spanning_count"))


def priority_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders of the best priority that the customer has."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return matching.cascade(rows, ["o_custkey"], F.col("o_orderpriority")).select("o_custkey", "o_orderkey", "o_orderpriority")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions: sample = customer, pair = order, cluster = brand, group = type, site = (supplier, part)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    return joined.select(F.col("o_custkey").alias("sample"), F.col("l_orderkey").alias("pair_id"), F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("pos"), F.col("p_brand").alias("cluster"), F.col("p_type").alias("grp"), F.col("o_orderpriority").alias("conf"), F.col("p_size").alias("seq_length"), "l_linestatus")


def ambiguity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with several clusters, resolved by the cluster of most support over all samples; all of them where that ties."""
    rows = placed(spark, sf_dir)
    held = rows.select("pair_id", "cluster").distinct()
    support = rows.groupBy("cluster").agg(F.countDistinct("pair_id").alias("support"))
    several = held.withColumn("n", F.count("*").over(Window.partitionBy("pair_id"))).filter("n > 1")
    top = matching.ties_at_max(joins.dealt_join(several, support, ["cluster"], ["pair_id"]), ["pair_id"], F.col("support"))
    left = F.count("*").over(Window.partitionBy("pair_id"))
    return top.withColumn("left", left).select("pair_id", "cluster", "support", F.when(F.col("left") == 1, "ArSC").otherwise("A").alias("conf"))


def mobile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sites of each cluster, over all lines and over the open ones, and whether there are more than two."""
    site = F.struct("contig", "pos")
    by = placed(spark, sf_dir).groupBy("cluster", "grp").agg(F.countDistinct(site).alias("sites"), F.countDistinct(F.when(F.col("l_linestatus") == "O", site)).alias("open_sites"))
    return by.select("cluster", "grp", "sites", "open_sites", (F.col("sites") > 2).alias("mobile_lenient"), (F.col("open_sites") > 2).alias("mobile_strict"))


def unresolved_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted distinct clusters of each pair, joined."""
    by = placed(spark, sf_dir).groupBy("sample", "pair_id").agg(F.array_join(F.array_sort(F.collect_set("cluster")), ";").alias("clusters"))
    return by.select("sample", "pair_id", "clusters")


#: Confidence codes of the analog and their output columns.
CONF_COLUMNS = {"1-URGENT": "conf_1", "2-HIGH": "conf_2", "3-MEDIUM": "conf_3", "4-NOT SPECIFIED": "conf_4", "5-LOW": "conf_5"}


def _summary(rows: DataFrame, key: str) -> DataFrame:
    """Sites, samples, copies, confidences, lengths and the most frequent length of each key."""
    site = F.struct("contig", "pos")
    base = rows.groupBy(key).agg(
        F.countDistinct(site).alias("num_unique_sites_all"),
        F.countDistinct(F.when(F.col("conf") != "5-LOW", site)).alias("num_unique_sites_unambig"),
        *[F.count_if(F.col("conf") == c).alias(n) for c, n in CONF_COLUMNS.items()],
    )
    copies = rows.groupBy(key, "sample").agg(F.count("*").alias("n")).groupBy(key).agg(F.count("*").alias("num_samples"), F.round(F.sum("n") / F.count("*"), 6).alias("mean_copy"), F.max("n").alias("max_copy"))
    seqs = rows.select(key, "seq_length").distinct().groupBy(key).agg(F.count("*").alias("num_unique_seqs"), F.round(F.sum("seq_length") / F.count("*"), 6).alias("mean_length"), F.min("seq_length").alias("min_length"), F.max("seq_length").alias("max_length"))
    mode = rows.groupBy(key, "seq_length").agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by("seq_length", F.struct("n", -F.col("seq_length"))).alias("repr_seq_length"))
    return base.join(copies, key).join(seqs, key).join(mode, key)


def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cluster: sites, samples, copies, confidence mix, lengths, representative."""
    return _summary(placed(spark, sf_dir), "cluster")


def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per group."""
    return _summary(placed(spark, sf_dir), "grp")


def dedupe_100p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents up to exact or reverse-complemented text: the first id and the copies."""
    return dedupe.dedupe(table(spark, sf_dir, "documents"), "text", F.col("doc_id")).select(F.col("key").alias("seq_key"), F.col("first").alias("first_doc"), "copies")


def revcomp_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every benchmark text's reverse complement and canonical form."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", F.md5(sq.revcomp("text").cast("binary")).alias("revcomp_md5"), F.md5(sq.canonical("text").cast("binary")).alias("canonical_md5"))


def prefix_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each benchmark text with the next one over their common length, on ASCII text."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^\\x00-\\x7F]", "?").alias("t"))
    nxt = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return rows.join(nxt, "item_id").select("item_id", F.round(sq.prefix_similarity("t", "u"), 6).alias("similarity"))


def identity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-identity clusters of the distinct document texts, longest first, with every document's representative."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.md5(sq.canonical(F.coalesce("text", F.lit(""))).cast("binary")).alias("key"))
    firsts = docs.groupBy("key").agg(F.min("doc_id").alias("id"))
    seqs = docs.join(firsts, [docs.key == firsts.key, docs.doc_id == firsts.id]).select("id", "text")
    found = dedupe.identity_clusters(seqs, "id", "text")
    return docs.join(firsts, "key").join(found, "id").select("doc_id", F.col("rep").alias("cluster_rep"))


def shared_pair_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters (brand and size) that orders share, as connected components with the least member as label.

    Each order's clusters are chained from its least one, so an order of n clusters makes n - 1 edges.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("cluster"))
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select("l_orderkey", "cluster").distinct()
    first = rows.groupBy("l_orderkey").agg(F.min("cluster").alias("u"))
    edges = rows.join(first, "l_orderkey").filter("u <> cluster").select("u", F.col("cluster").alias("v")).distinct()
    found = graph.connected_components(edges, parts.select(F.col("cluster").alias("node")))
    return found.select(F.col("node").alias("cluster"), F.col("component").alias("group_label"))


def overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation merged where the end of one overlaps the start of the next.

    Every other next turn is given the end of the turn before it, so that there is something to merge.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    n = 12 + F.col("turn") % 3 * 9
    given = F.when(F.col("turn") % 2 == 0, F.concat(F.substring("text", -n, n), F.col("next_text"))).otherwise(F.col("next_text"))
    pairs = rows.join(nxt, ["conv_id", "turn"]).withColumn("m", sq.overlap_merge(F.col("text"), given))
    return pairs.select("conv_id", "turn", F.length("m.merged").alias("merged_length"), F.col("m.loc").alias("loc"), F.md5(F.col("m.merged").cast("binary")).alias("merged_md5"))


def flank_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flank preparation of document texts: stripped ends, the insertion's 40 characters, and a slice."""
    rows = table(spark, sf_dir, "documents")
    five, three = sq.strip_flank("text", "5p"), sq.strip_flank("text", "3p")
    return rows.select("doc_id", F.length(five).alias("length_5p"), F.length(three).alias("length_3p"), sq.truncate(five, 40, "5p").alias("trunc_5p"), sq.truncate(three, 40, "3p").alias("trunc_3p"), sq.slice_seq("text", F.lit(5), F.lit(26)).alias("direct_repeat"))


def interval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by the window of 50 around the half-even middle of their two positions."""
    rows = reads(spark, sf_dir).select(sq.window_centre("contig", "pos").alias("centre"), "qual")
    return rows.groupBy("centre").agg(F.count("*").alias("n_reads"), F.sum("qual").alias("quality")).select("centre", (F.col("centre") - 25).alias("window_start"), (F.col("centre") + 25).alias("window_end"), "n_reads", "quality")


def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of brands that have at least one returned line, as clusters with an assembly-derived row are kept."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_linestatus = 'F'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return parts.join(returned, "p_partkey", "left_semi")


def union_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of three tables within the size window, by digest."""
    parts = [table(spark, sf_dir, n).select(F.col(c).alias("s")) for n, c in (("documents", "text"), ("pages", "html"), ("benchmark", "text"))]
    rows = union_all(parts).filter(F.length("s").between(70, 200_000))
    return rows.select(F.md5(F.col("s").cast("binary")).alias("text_md5"), F.length("s").alias("n_chars")).distinct()


def ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders numbered from 1 within each customer by date, then key."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(own).alias("pair_id"))


def best_score_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a user and type that have its greatest value."""
    return matching.ties_at_max(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], F.col("value"))


def smallest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the line with the narrowest distance between supplier and part, ties by part, supplier."""
    width = F.abs(F.col("l_partkey") - F.col("l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct(width.alias("w"), "l_partkey", "l_suppkey")).alias("m"))
    return rows.select("l_orderkey", F.col("m.w").alias("width"), F.col("m.l_partkey").alias("l_partkey"), F.col("m.l_suppkey").alias("l_suppkey"))


def conf_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions of each group by confidence, one column for each code, zero where there are none."""
    rows = placed(spark, sf_dir)
    return rows.groupBy("grp").agg(*[F.count_if(F.col("conf") == c).alias(n) for c, n in CONF_COLUMNS.items()])


def copy_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, mean and greatest copies of each cluster and group."""
    rows = placed(spark, sf_dir).groupBy("cluster", "grp", "sample").agg(F.count("*").alias("n"))
    return rows.groupBy("cluster", "grp").agg(F.count("*").alias("num_samples"), F.round(F.sum("n") / F.count("*"), 6).alias("mean_copy"), F.max("n").alias("max_copy"))


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the distinct canonical texts of each language."""
    rows = table(spark, sf_dir, "documents").select("lang", F.md5(sq.canonical("text").cast("binary")).alias("k"), F.length("text").alias("n")).distinct()
    return rows.groupBy("lang").agg(F.count("*").alias("num_unique_seqs"), F.round(F.sum("n") / F.count("*"), 6).alias("mean_length"), F.min("n").alias("min_length"), F.max("n").alias("max_length"))


def mode_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent brand of each supplier's lines, least name first on ties."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    by = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"))
    best = by.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("n")).alias("n"), "p_brand")).alias("m"))
    return best.select("l_suppkey", F.col("m.p_brand").alias("p_brand"), (-F.col("m.n")).alias("n"))


def left_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their order counts, and whether they have none (the outer join's left-only rows)."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    none = customers.join(n, "c_custkey", "left_anti").select("c_custkey", F.lit(True).alias("left_only"))
    return customers.join(n, "c_custkey", "left").join(none, "c_custkey", "left").select("c_custkey", "c_mktsegment", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("left_only", F.lit(False)).alias("left_only"))


