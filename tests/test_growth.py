"""What keeps the work of one task from growing: hot keys dealt to tasks."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from graftline.functions import cigar, sequence
from graftline.operators import align, assembly, dedupe, joins, stash
from graftline.operators.consensus import by_pieces, consensus_clusters
from graftline.plans import cohort, domain, infer

SF = "/root/testdata/sf0.001"


def heaviest(spark, joined):
    """The share of rows in the largest partition, where no small side is broadcast and nothing is split afterwards."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("false", "-1", "16"), strict=True):
            spark.conf.set(k, v)
        sizes = [r["count"] for r in joined().groupBy(F.spark_partition_id()).count().collect()]
        return max(sizes) / sum(sizes)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_dealt_join_is_the_join_and_deals_a_hot_key(spark):
    rows = spark.range(4000).select((F.col("id") % 100 == 0).cast("int").alias("k"), F.col("id").alias("v"))
    few = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (2, "d")], "k int, w string")
    assert sorted(joins.dealt_join(rows, few, ["k"], ["v"]).collect()) == sorted(rows.join(few, "k").collect())
    assert heaviest(spark, lambda: joins.dealt_join(rows, few, ["k"], ["v"])) < 0.3
    assert heaviest(spark, lambda: rows.join(few, "k")) > 0.9


def test_placements_on_three_contigs_are_many_tasks(spark):
    assert heaviest(spark, lambda: infer.placements(domain.placed_flanks(spark, SF), domain.targets(spark, SF))) < 0.2


def test_lists_are_summed_by_pieces(spark):
    lists = [("a", list(range(1, 41))), ("a", [2] * 40), ("b", [5] * 16), ("c", [7] * 17), ("d", [])]
    got = {}
    for r in sorted(by_pieces(spark.createDataFrame(lists, "k string, q array<int>"), ["k"], F.size("q"), lambda i: F.get("q", i), F.sum).collect()):
        got.setdefault(r["k"], []).append((r["_values"], r["_n"]))
    whole = {k: [x for values, _ in v for x in values] for k, v in got.items()}
    assert whole == {"a": [x + 2 for x in range(1, 41)], "b": [5] * 16, "c": [7] * 17}
    # Forty places are three rows, where one row for each place was made before.
    assert [len(v) for _, v in sorted(got.items())] == [3, 1, 2] and {n for _, n in got["a"]} == {2}


def test_consensus_makes_no_row_for_each_base_and_no_frame_for_each_site(spark):
    plan = consensus_clusters(domain.words_of_sites(spark, SF), ["pos", "orient"])._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "FlatMapGroupsInPandas" not in plan


def test_a_task_sums_its_words(monkeypatch):
    random.seed(3)
    element = "".join(random.choice("ACGT") for _ in range(120))
    reads = [(bytes([k % 2]), element[a : a + 60] if k % 7 else element[a : a + 20] + "N" + element[a + 21 : a + 60]) for k, a in enumerate(random.choices(range(60), k=300))]
    quals = [[20 + (i + k) % 20 for i in range(60)] for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in reads], pa.binary()), pa.array([s for _, s in reads]), pa.array(quals, pa.list_(pa.int32()))], names=["site", "seq", "w"])
    for k in (12, 40):
        want: dict[tuple, list[int]] = {}
        for (site, s), w in zip(reads, quals, strict=True):
            for i in range(len(s) - k):
                if "N" not in s[i : i + k + 1]:
                    held = want.setdefault((site, s[i : i + k], s[i + k]), [0, 0])
                    held[0], held[1] = held[0] + 1, held[1] + min(w[i], w[i + k])
        rows = [r for out in assembly._summed_words(k)(iter([batch])) for r in out.to_pylist()]
        # One row for each word, where a row for each place of each read was made before.
        assert {(r["site"], r["node"], r["base"]): [r["n"], r["weight"]] for r in rows} == want and len(rows) == len(want)
        monkeypatch.setattr(assembly, "WORDS", 1000)
        parts = [r for out in assembly._summed_words(k)(iter([batch])) for r in out.to_pylist()]
        assert sum(r["weight"] for r in parts) == sum(w for _, w in want.values()) and len(parts) > len(want)
        monkeypatch.undo()


def test_a_query_in_its_window_is_not_filled_in(monkeypatch):
    q, p = "ACGTTGCAAGGCTTAACCGA", align.Aligner()
    windows = ["TT" + q + "CC" + q, "G" + q]
    monkeypatch.setattr(align.np, "full", None)
    assert align.local_alignments([q, q], windows, p) == [(40, 0, 2, 22, "20M", 0), (40, 0, 1, 21, "20M", 0)]


def test_near_copies_are_compared_with_one_preparation_of_the_longer_text(monkeypatch):
    random.seed(11)
    p, made, texts = dedupe.Identity(), [], {}
    for k in range(12):
        base = "".join(random.choice("ACGT") for _ in range(300))
        for j in range(3):
            s = list(base)
            for _ in range(random.choice([0, 10, 25, 40])):
                i, kind = random.randrange(len(s)), random.random()
                s[i : i + (kind < 0.7)] = [] if kind < 0.2 else random.choice("ACGTN")
            text = "".join(s)[: random.choice([300, 280, 265])]
            texts[3 * k + j] = text if j != 1 else dedupe._revcomp(text)
    order = sorted(texts, key=lambda k: (-len(texts[k]), k))
    pairs = [(u, v) for n, u in enumerate(order) for v in order[n + 1 :]]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            was, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                was, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, was + (x != y))
        return row[-1]

    def same(a, b):
        most = int((1 - p.identity) * len(b) + 1e-9) + len(a) - len(b)
        return len(b) >= p.coverage * len(a) and min(distance(a, b), distance(a, dedupe._revcomp(b))) <= most

    near = [(u, v) for u, v in pairs if u // 3 == v // 3] + pairs[::25]
    near.sort(key=lambda x: order.index(x[0]))
    monkeypatch.setattr(dedupe, "char_masks", lambda s: made.append(s) or sequence.char_masks(s))
    got = dedupe.matches(texts, near, p)
    assert got == [same(texts[u], texts[v]) for u, v in near] and True in got and False in got
    assert len(made) <= len({u for u, _ in near})


def test_a_text_is_not_sent_with_each_of_its_candidate_pairs(spark, monkeypatch):
    """Thirty texts of one word family make 435 pairs; in the plan that compares them no text stands beside a pair."""
    random.seed(12)
    common = "".join(random.choice("ACGT") for _ in range(60))
    rows = [(k, "".join(random.choice("ACGT") for _ in range(200)) + common + "".join(random.choice("ACGT") for _ in range(200 + k))) for k in range(30)]
    plans = []

    def kept(df, name, codec="zstd"):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return stash.stash(df, name, codec)

    monkeypatch.setattr(dedupe, "stash", kept)
    got = {r.id: r.rep for r in dedupe.identity_clusters(spark.createDataFrame(rows, "id int, seq string"), "id", "seq").collect()}
    assert got == {k: k for k, _ in rows}
    compared = [plan for name, plan in plans if name == "edges"]
    assert compared and all("FlatMapCoGroupsInArrow" in plan and "RepartitionByExpression" in plan for plan in compared)


def test_overlaps_of_many_pairs_are_found_at_once(monkeypatch):
    random.seed(13)

    def text(n, letters="ACGT"):
        return "".join(random.choice(letters) for _ in range(random.randint(0, n)))

    five, three = [], []
    for k in range(400):
        shared, letters = text(20), ("AC", "ACGT", "aé😀")[k % 3]
        five.append(None if k == 7 else text(30, letters) + shared)
        three.append("" if k == 9 else shared + text(1500 if k == 11 else 30, letters))
    for least, identity in ((10, 0.9), (0, 0.0), (3, 0.5)):
        want = [sequence.merge_overlap(a, b, least, identity) if a is not None else (None, None) for a, b in zip(five, three, strict=True)]
        monkeypatch.setattr(sequence, "best_overlap", None)
        assert sequence.merge_overlaps(five, three, least, identity, step=4096) == want
        monkeypatch.undo()


def test_aligned_blocks_are_the_runs_of_aligned_bases(spark):
    rows = spark.createDataFrame([("3S4M2I5M1D6=2X4S", 10), ("5H8M", 0), ("7S", 3), ("2M3N2M", 1)], "c string, s int").withColumn("c", cigar.parse_cigar("c"))
    for r in rows.select(cigar.aligned_bases("c", "s").alias("bases"), cigar.aligned_blocks("c", "s").alias("blocks")).collect():
        assert [(x.pos, x.at) for x in r.bases] == [(b.start + k, b.at + k) for b in r.blocks for k in range(b.end - b.start)]


def test_region_consensus_sends_blocks_and_no_struct_for_each_base(spark):
    found = domain.region_consensus(spark, SF)
    exchanged = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(exchanged, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in exchanged.items():
            spark.conf.set(k, v)
    assert "aligned" not in plan and "_quals" in plan


def test_a_summary_turns_a_sequence_once_and_not_each_copy(spark, monkeypatch):
    held, real = {}, cohort.stash
    monkeypatch.setattr(cohort, "stash", lambda df, name: held.setdefault(name, real(df, name)))
    typed = spark.range(300).selectExpr("cast(id % 5 as string) sample", "cast(id as int) pair_id", "'chr' contig", "cast(id % 7 as int) pos_3p", "cast(id % 7 as int) pos_5p", "'s1' seqid", "'c1' cluster", "'g1' `group`", "if(id % 2 = 0, 'A', 'IO') conf")
    seqs = spark.range(300).selectExpr("'a' sample", "cast(id as int) pair_id", "'m' method", "'' loc", "4 inferred_seq_length", "'s1' seqid", "'c1' cluster", "'g1' `group`", "if(id % 3 = 0, 'ACGG', 'CCGT') inferred_seq")
    (r,) = cohort.summarize(typed, seqs).collect()
    assert held["sequences"].count() == 2
    assert (r.num_unique_seqs, r.num_unique_sites_all, r.num_unique_sites_unambig, r.num_samples, r.mean_copy, r.repr_seq) == (1, 7, 7, 5, 60.0, "ACGG")


def test_a_genotypes_evidence_is_read_for_few_branches(spark, monkeypatch):
    held, real = [], cohort.stash
    monkeypatch.setattr(cohort, "stash", lambda df, name: held.append(name) or real(df, name))
    plan = cohort.genotype([domain.candidate_insertions(spark, SF)], domain.clusterseq(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert held == ["evidence", "judged"] and "Window" not in plan and "collect_set(cluster" not in plan.replace("split(cluster", "")
    assert "md5" not in domain.clusterseq(spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_pairs_of_null_clusters_have_no_genotype_and_null_places_no_support(spark):
    cs = [("a", 1, None), ("b", 1, "c1"), ("b", 1, None), ("c", 1, "c1"), ("c", 1, "c2")]
    method = "inferred_assembly_with_full_context"
    seqs = spark.createDataFrame([(s, p, method, "", 4, "s1", c, "g1", "ACGT") for s, p, c in cs], "sample string, pair_id int, method string, loc string, inferred_seq_length int, seqid string, cluster string, group string, inferred_seq string")
    pairs = spark.createDataFrame([("a", 1, "chr", 1, 2), ("b", 1, "chr", 1, 2), ("c", 1, None, 1, 2)], "sample string, pair_id int, contig string, pos_5p int, pos_3p int")
    got = cohort.genotype([pairs], seqs, cohort.Genotype(filter_clusters_inferred_assembly=False)).collect()
    assert {(r.sample, r.cluster) for r in got} == {("b", "c1"), ("b", None)}


def test_clustering_turns_a_text_once_and_leaves_its_copies_where_they_are(spark, monkeypatch):
    held, real = {}, cohort.stash
    monkeypatch.setattr(cohort, "stash", lambda df, name: held.setdefault(name, real(df, name)))
    random.seed(4)
    seq = "".join(random.choices("ACGT", k=90))
    texts = [seq, seq.lower(), seq[::-1].translate(str.maketrans("ACGT", "TGCA")), "".join(random.choices("ACGT", k=80)), None]
    rows = spark.createDataFrame([("a", k % 50, "m", "", len(t or seq), t) for k in range(200) for t in texts], "sample string, pair_id int, method string, loc string, inferred_seq_length int, inferred_seq string")
    got = cohort.cluster_sequences([rows]).groupBy("seqid", "cluster", "group").count().collect()
    assert sorted(tuple(r) for r in got) == [("s1", "c1", "g1", 600), ("s2", "c2", "g1", 200)]
    assert held["turned"].count() == len(texts) and held["ids"].count() == len(texts) - 1  # none for the null text
    assert "Join" in (plan := domain.families(spark, SF)._jdf.queryExecution().optimizedPlan().toString()) and "md5" not in plan.split("Join")[0]


def test_groups_link_clusters_of_a_known_pair_in_one_pass(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "x"), ("b", 1, "y"), ("b", 1, "z"), ("b", 1, "w"), (None, 1, "n"), (None, 1, "x"), ("c", None, "m"), ("c", None, "x"), ("d", 1, None), ("d", 1, "n"), ("d", 1, "m")]
    got = cohort.with_groups(spark.createDataFrame(rows, "sample string, pair_id int, cluster string"))
    found = {r.cluster: r.group for r in got.collect()}
    assert got.count() == 12 and len(set(found.values())) == 2
    assert {c for c in found if found[c] == found["x"]} == {"w", "x", "y", "z"} and {c for c in found if found[c] == found["n"]} == {"m", "n"}


def test_many_texts_are_screened_at_once():
    """No text within its edits is refused, and texts far from it are, whatever their lengths."""
    random.seed(21)
    words = ["".join(random.choice("abcdeäé ") for _ in range(random.randint(2, 7))) for _ in range(40)]
    b = " ".join(random.choice(words) for _ in range(150))

    def changed(share):
        s = list(b[: len(b) - random.randint(0, 60)])
        for i in random.sample(range(len(s)), int(share * len(s))):
            s[i] = random.choice(["", "x", s[i] + "y", "\U0001f600"])
        return "".join(s)[: len(b)]

    texts = [changed(random.choice([0.0, 0.05, 0.09, 0.12, 0.5])) for _ in range(60)] + [" ".join(random.choice(words) for _ in range(140))[: len(b)] for _ in range(60)]
    most = [len(t) // 10 + len(b) - len(t) for t in texts]
    within = [sequence.edit_distance_within(t, b, m) <= m for t, m in zip(texts, most, strict=True)]
    passed = sequence.screen_within(texts, b, most)
    assert all(p or not w for p, w in zip(passed, within, strict=True)) and any(within)
    assert sum(passed) <= sum(within) + 8


def test_texts_of_common_words_meet_in_blocks(spark, monkeypatch):
    """Where words are common, no row is made for each word that two texts share; the clusters are those of all pairs."""
    random.seed(22)
    words = ["".join(random.choice("abcdefgh") for _ in range(9)) for _ in range(30)]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(40, 60))) for _ in range(40)]
    texts += [texts[k][:-20] + "x" * (k % 9) for k in range(0, 40, 4)]
    p, names = dedupe.Identity(), []
    monkeypatch.setattr(dedupe, "stash", lambda df, name, codec="zstd": names.append(name) or stash.stash(df, name, codec))
    got = {r.id: r.rep for r in dedupe.identity_clusters(spark.createDataFrame(list(enumerate(texts)), "id int, seq string"), "id", "seq").collect()}
    reps, want = [], {}
    for i in sorted(range(len(texts)), key=lambda k: (-len(texts[k]), k)):
        want[i] = next((r for r in reps if dedupe.same_cluster(texts[r], texts[i], p)), i)
        reps += [i] if want[i] == i else []
    assert got == want and len(reps) == 40
    assert "blocks" in names and "candidates" not in names[names.index("blocks") :]


def test_placements_are_dealt_by_pair_once(spark):
    """The windows over a pair's placements need no exchange of their own."""
    conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = infer.flank_filter(infer.placements(domain.placed_flanks(spark, SF), domain.targets(spark, SF)), 0.95)
        pairs = infer.best_scores(infer.smallest_windows(infer.nearest_pairs(rows, 25)), ["sample", "pair_id"])
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", conf)
    assert plan.count("Exchange hashpartitioning(pair_id") == 1 == plan.count("REPARTITION_BY_COL")


def test_groups_are_drawn_in_a_task_as_by_joins(spark, monkeypatch):
    """Chains, rings, forks and self-loops: a task draws whole groups without a join, larger groups are drawn by joins, all alike."""
    random.seed(23)
    rows = []
    for g in range(12):
        words = ["".join(x) for x in {tuple(random.choice("ACGT") for _ in range(6)) for _ in range(40)}]
        a, b, c = sorted(random.sample(range(len(words)), 3))
        edges = {(words[i], words[i + 1]) for i in range(len(words) - 1) if i not in (a, b, c)}
        edges |= {(words[b], words[a + 1])} if g % 2 else {(words[a], words[c]), (words[b], words[b])}
        into = [y for _, y in edges]
        rows += [(bytes([g]) * 16, x, y, random.randint(2, 9), into.count(y)) for x, y in edges]
    df = spark.createDataFrame(rows, "site binary, node string, after string, n long, n_in long")
    names = []
    monkeypatch.setattr(assembly, "stash", lambda df, name, codec="zstd": names.append(name) or stash.stash(df, name, codec))
    columns = ["site", "node", "last", "left", "circular", "n", "onward"]
    got = sorted((tuple(map(str, r)) for r in assembly.chains(df).select(columns).collect()))
    assert names == ["places"]
    for held in (5, 38):
        assert sorted((tuple(map(str, r)) for r in assembly.chains(df, held).select(columns).collect())) == got
    assert "chains" in names
    assert {r[4] for r in got} == {"True", "False"} and len(got) == len({(r[0], x) for r in rows for x in r[1:3]})


def test_words_of_seeds_are_hashed_where_they_are_found(spark):
    """A seed's row holds its word's hash and no sequence; equal words have equal hashes wherever they begin, others have others."""
    random.seed(24)
    p = align.Aligner()
    text = "".join(random.choice("ACGT") for _ in range(400))
    text += "N" + text[100:300]
    rows = align._classed(spark.createDataFrame([(1, text), (2, text[50:]), (3, None), (4, "ACG")], "k int, s string"), "s", ["k"], p, [13, 26, 52], 500)
    assert rows.columns == ["k", "at", "class", "word"]
    got = [(r["k"], r["at"], r["class"], r["word"]) for r in rows.collect()]
    texts = {1: text, 2: text[50:]}
    want = {(k, int(at), c) for k, t in texts.items() for at in align.minimizers(t[:500], p.word, p.run) for c, n in enumerate((13, 26, 52)) if at + n <= len(t)}
    assert {x[:3] for x in got} == want and len(got) == len(want)
    words = {x: texts[x[0]][x[1] : x[1] + (13, 26, 52)[x[2]]] for x in want}
    assert len({(words[x[:3]], x[3]) for x in got}) == len(set(words.values())) == len({x[3] for x in got})
