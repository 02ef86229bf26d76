import random

import pytest
from pyspark.sql import functions as F

from graftline import schemas, workflow
from graftline.functions import cigar as cg
from graftline.params import FindFlanks, InferAligned, PairFlanks
from graftline.plans import cohort, flanks, infer, pairs
from graftline.sources import files

RNG = random.Random(12)
GENOME = "".join(RNG.choices("ACGT", k=600))
RC = str.maketrans("ACGT", "TGCA")
#: An element with perfect inverted ends, inserted at 300 with a duplicated target of 5.
ARM = "".join(RNG.choices("ACGT", k=20))
ELEMENT = ARM + "".join(RNG.choices("ACGT", k=60)) + ARM[::-1].translate(RC)
SITE, REPEAT = 300, 5


def alignment(spark_rows, sample, name, start, cigar, seq, qual=30, mapq=60, md=None, flag=0, contig="chr", nm=0, score=0, reverse=False):
    length = sum(int(n) for n, op in _ops(cigar) if op in "MD=X")
    spark_rows.append((sample, name, flag, contig, start, start + length, mapq, reverse, False, False, [(op, int(n)) for n, op in _ops(cigar)], seq, [qual] * len(seq), md or str(length), nm, score, None, None))


def _ops(cigar):
    import re

    return re.findall(r"(\d+)([MIDNSHP=X])", cigar)


def insertion_reads(sample, n=8):
    """Reads over both junctions of the insertion: 5p clips at its start, 3p clips at its end."""
    rows = []
    end = SITE + REPEAT
    for k in range(n):
        left = 40 + k
        # Right-clipped reads end at the insertion's start: aligned up to `end`, then the element.
        alignment(rows, sample, f"r{k}", end - left, f"{left}M{100 - left}S", GENOME[end - left : end] + ELEMENT[: 100 - left])
        # Left-clipped reads: the element's end, then the genome from SITE on.
        alignment(rows, sample, f"l{k}", SITE, f"{left}S{100 - left}M", ELEMENT[len(ELEMENT) - left :] + GENOME[SITE : SITE + 100 - left])
    alignment(rows, sample, "low", end - 50, "50M50S", GENOME[end - 50 : end] + "A" * 50, mapq=3)
    alignment(rows, sample, "through", 250, "100M", GENOME[250:350])
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = insertion_reads("a") + insertion_reads("b", 6)
    return spark.createDataFrame(rows, schemas.ALIGNMENTS).cache(), spark.createDataFrame([("chr", GENOME)], schemas.SEQUENCES)


def test_find_flanks(spark, tables):
    alignments, genome = tables
    found = flanks.find_flanks(alignments, FindFlanks(), files.contigs_of(genome)).collect()
    got = {(r.sample, r.pos, r.orient): r for r in found}
    assert set(got) == {(s, p, o) for s in "ab" for p, o in ((SITE + REPEAT, "5p"), (SITE - 1, "3p"))}
    five, three = got["a", SITE + REPEAT, "5p"], got["a", SITE - 1, "3p"]
    assert five.softclip_count_5p == 8 and five.runthrough_count == 9 and five.total_count == 17
    assert ELEMENT.startswith(five.consensus_seq) and len(five.consensus_seq) >= 55
    assert ELEMENT.endswith(three.consensus_seq) and len(three.consensus_seq) >= 40
    assert [r.flank_id for r in sorted(found, key=lambda r: (r.sample, r.pos))] == [1, 2, 1, 2]
    assert flanks.find_flanks(alignments.limit(0)).collect() == []


def test_mates_of_one_name_merge(spark):
    rows = []
    for k, (base, q) in enumerate([("A", 10), ("C", 30), ("G", 20)]):
        alignment(rows, "s", "same", 100, "50M10S", GENOME[100:150] + base * 10, qual=q, flag=k)
    df = spark.createDataFrame(rows, schemas.ALIGNMENTS)
    words = flanks.merged_words(flanks.clips(df, FindFlanks())).collect()
    assert [(r.word, r.quals) for r in words] == [("C" * 10, [30] * 10)]


def test_recall(spark, tables):
    alignments, genome = tables
    asked = spark.createDataFrame([("chr", SITE + REPEAT, SITE - 1), ("chr", SITE + REPEAT, SITE - 1), ("chr", 320, 310)], schemas.RECALL_SITES)
    got = flanks.recall(alignments.filter("sample = 'a'"), asked, contigs=files.contigs_of(genome)).collect()
    assert len(got) == 4
    by = {(r.pos, r.orient): r for r in got}
    assert by[SITE + REPEAT, "5p"].softclip_count_5p == 8 and by[SITE - 1, "3p"].softclip_count_3p == 8 and by[320, "5p"].runthrough_count == 9


def test_pair_flanks(spark, tables):
    alignments, genome = tables
    found = flanks.find_flanks(alignments, contigs=files.contigs_of(genome))
    got = pairs.pair_flanks(found, alignments, genome).collect()
    assert len(got) == 2 and [f.name for f in schemas.PAIRS] == list(got[0].asDict())
    r = next(x for x in got if x.sample == "a")
    assert (r.pos_5p, r.pos_3p, r.spanning_count, r.has_IR, r.pair_id) == (SITE + REPEAT, SITE - 1, 1, True, 1)
    assert r.IR_length >= 20 and r.direct_repeat_reference == GENOME[SITE : SITE + REPEAT] == r.direct_repeat_reads_consensus
    strict = PairFlanks(max_junction_spanning_prop=0.01)
    assert pairs.pair_flanks(found, alignments, genome, strict).collect() == []


def test_candidate_distance(spark):
    rows = [("s", i, "c", p, o, *[1] * 10, 10, 5, "A" * n) for i, (p, o, n) in enumerate([(100, "5p", 9), (99, "3p", 9), (79, "3p", 9), (78, "3p", 9), (100, "3p", 9)])]
    got = pairs.candidate_pairs(spark.createDataFrame(rows, schemas.FLANKS)).collect()
    assert sorted(r.pos_3p for r in got) == [79, 99]


def test_overlap(spark):
    a, b = ELEMENT[:70], ELEMENT[30:]
    rows = [("s", 1, "c", 10, 5, 1, 1, 1, 1, 0, False, 0, None, None, a, b, "", ""), ("s", 2, "c", 10, 5, 1, 1, 1, 1, 0, False, 0, None, None, "A" * 20, "C" * 20, "", ""), ("s", 3, "c", 10, 5, 1, 1, 1, 1, 0, False, 0, None, None, None, b, "", "")]
    got = infer.infer_overlap(spark.createDataFrame(rows, schemas.PAIRS)).collect()
    assert [(r.pair_id, r.inferred_seq, r.method) for r in got] == [(1, ELEMENT, schemas.OVERLAP)]


def placed(name, start, end, reverse, score=50, clip="", contig="ref", seq=None, nm=0):
    rows = []
    n = end - start
    alignment(rows, "s", name, start, clip.format(n=n) if clip else f"{n}M", seq or "A" * (n + (10 if clip else 0)), contig=contig, reverse=reverse, score=score, nm=nm)
    return rows[0]


def test_infer_reference(spark):
    target = "".join(RNG.choices("ACGT", k=400))
    rows = [
        placed("1_1", 100, 140, False),
        placed("1_2", 200, 240, True),
        placed("1_2", 300, 340, True),  # further away: a wider window of the same forward place
        placed("2_2", 100, 140, False),  # the 3p flank comes first: turned round
        placed("2_1", 160, 200, True),
        placed("3_1", 100, 140, False, score=10),
        placed("3_2", 180, 220, True, score=10),
        placed("3_1", 250, 290, False, score=20),
        placed("3_2", 330, 370, True, score=20),
        placed("4_1", 100, 140, False, nm=10),  # too little identity
        placed("4_2", 180, 220, True),
        placed("5_1", 100, 140, False),  # no mate
        placed("6_1", 100, 110, False),
        placed("6_2", 110, 120, True),  # too short
    ]
    df = spark.createDataFrame(rows, schemas.ALIGNMENTS)
    got = infer.infer_reference(df, spark.createDataFrame([("ref", target)], schemas.SEQUENCES)).collect()
    by = {(r.pair_id, r.loc): r.inferred_seq for r in got}
    assert by == {(1, "ref:100-240"): target[100:240], (2, "ref:100-200"): target[100:200][::-1].translate(RC), (3, "ref:250-370"): target[250:370]}


def test_infer_context_and_edges(spark):
    target = "".join(RNG.choices("ACGT", k=300))
    rows = [placed("1_1", 50, 120, False), placed("1_2", 200, 270, True), placed("2_1", 0, 60, False, clip="10S{n}M"), placed("2_2", 180, 250, True)]
    df = spark.createDataFrame(rows, schemas.ALIGNMENTS)
    got = {r.pair_id: r for r in infer.infer_in_context(df, spark.createDataFrame([("ref", target)], schemas.SEQUENCES), InferAligned()).collect()}
    assert got[1].method == schemas.FULL_CONTEXT and got[1].inferred_seq == target[75:245] and got[1].loc == "ref:50-270"
    assert got[2].method == schemas.HALF_CONTEXT


def test_infer_database(spark):
    rows = [
        placed("1_1", 3, 60, False, contig="e1"),
        placed("1_2", 60, 117, True, contig="e1"),
        placed("2_1", 40, 80, False, contig="e1"),  # far from the element's end
        placed("2_2", 60, 117, True, contig="e1"),
        placed("3_2", 0, 60, False, contig="e1", score=30),
        placed("3_1", 60, 120, True, contig="e1", score=30),
        placed("3_1", 0, 60, False, contig="e2", score=10),
        placed("3_2", 60, 120, True, contig="e2", score=10),
    ]
    db = spark.createDataFrame([("e1", ELEMENT[:120] + "A" * (120 - len(ELEMENT[:120]))), ("e2", "C" * 120)], schemas.SEQUENCES)
    got = infer.infer_database(spark.createDataFrame(rows, schemas.ALIGNMENTS), db).collect()
    assert sorted((r.pair_id, r.loc) for r in got) == [(1, "e1:3-117"), (3, "e1:0-120")]


def inferred(spark, rows):
    return spark.createDataFrame([(s, p, m, "x", len(q), q) for s, p, m, q in rows], schemas.INFERRED)


def test_cluster_sequences(spark):
    near = list(ELEMENT)
    near[50] = "A" if near[50] != "A" else "C"
    near = "".join(near)
    other = "".join(RNG.choices("ACGT", k=120))
    rows = [("a", 1, schemas.FULL_CONTEXT, ELEMENT), ("b", 1, schemas.OVERLAP, ELEMENT[::-1].translate(RC)), ("b", 2, schemas.OVERLAP, near), ("c", 1, schemas.REFERENCE, other), ("c", 1, schemas.REFERENCE, ELEMENT), ("d", 1, schemas.REFERENCE, "ACGT" * 5)]
    got = cohort.cluster_sequences([inferred(spark, rows[:3]), inferred(spark, rows[3:])]).collect()
    assert len(got) == 5
    seqid = {r.inferred_seq: r.seqid for r in got}
    assert seqid[ELEMENT] == seqid[ELEMENT[::-1].translate(RC)] != seqid[near]
    cluster = {r.inferred_seq: r.cluster for r in got}
    assert cluster[ELEMENT] == cluster[near] != cluster[other]
    assert {r.group for r in got} == {"g1"}  # pair c/1 has both clusters
    db = cohort.make_database([inferred(spark, rows)]).collect()
    assert len(db) == 2 or len(db) == 3


def clusterseq(spark, rows):
    return spark.createDataFrame([(s, p, m, "x", 100, q, c, g, "ACGT" * 25) for s, p, m, q, c, g in rows], schemas.CLUSTERSEQ)


def pair_rows(spark, rows):
    return spark.createDataFrame([(s, p, "chr", x, x - 5, 1, 1, 1, 1, 0, False, 0, None, None, "A", "C", "", "") for s, p, x in rows], schemas.PAIRS)


def test_genotype_cascade_and_resolution(spark):
    full, over, ref, no = schemas.FULL_CONTEXT, schemas.OVERLAP, schemas.REFERENCE, schemas.NO_CONTEXT
    cs = [
        ("a", 1, full, "s1", "c1", "g1"),
        ("a", 1, ref, "s9", "c2", "g1"),  # beaten by full context
        ("a", 2, over, "s1", "c1", "g1"),
        ("a", 2, over, "s2", "c1", "g1"),  # two sequences of one cluster
        ("b", 1, no, "s1", "c1", "g1"),
        ("b", 1, no, "s3", "c2", "g1"),  # ambiguous: c1 has more support at this site
        ("c", 1, ref, "s4", "c3", "g2"),  # c3 was never assembled: dropped
        ("d", 1, ref, "s1", "c1", "g1"),
        ("d", 1, ref, "s3", "c2", "g1"),
        ("e", 1, full, "s3", "c2", "g1"),
    ]
    ps = [("a", 1, 100), ("a", 2, 200), ("b", 1, 100), ("c", 1, 300), ("d", 1, 400), ("e", 1, 500), ("f", 1, 600)]
    got = {(r.sample, r.pair_id): r for r in cohort.genotype([pair_rows(spark, ps)], clusterseq(spark, cs)).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("d", 1), ("e", 1)}
    assert (got["a", 1].cluster, got["a", 1].conf) == ("c1", "IAwFC")
    assert (got["a", 2].seqid, got["a", 2].conf) == ("s1;s2", "IO")
    assert (got["b", 1].cluster, got["b", 1].conf) == ("c1", "ArSC")
    # d ties in support; c1 has sites 100, 200, 400 and c2 100, 400, 500; confidently c1 has 2 and c2 2: neither strictly mobile.
    assert got["d", 1].conf == "A" and got["d", 1].cluster == "c1;c2" and got["d", 1].seqid == "s1;s3"
    kept = cohort.genotype([pair_rows(spark, ps)], clusterseq(spark, cs), cohort.Genotype(filter_clusters_inferred_assembly=False)).collect()
    assert ("c", 1) in {(r.sample, r.pair_id) for r in kept}
    empty = cohort.genotype([pair_rows(spark, ps).limit(0)], clusterseq(spark, cs).limit(0))
    assert empty.collect() == [] and empty.columns == [f.name for f in schemas.GENOTYPES]


def test_mobility_resolves(spark):
    full, ref = schemas.FULL_CONTEXT, schemas.REFERENCE
    cs = [(f"m{k}", 1, full, "s1", "c1", "g1") for k in range(3)] + [("z", 1, ref, "s1", "c1", "g1"), ("z", 1, ref, "s2", "c2", "g1"), ("y", 1, full, "s2", "c2", "g1")]
    ps = [(f"m{k}", 1, 100 * k + 50) for k in range(3)] + [("z", 1, 900), ("y", 1, 990)]
    got = {r.sample: r for r in cohort.genotype([pair_rows(spark, ps)], clusterseq(spark, cs)).collect()}
    assert (got["z"].cluster, got["z"].conf) == ("c1", "ArMS")


def test_summaries(spark):
    g = [("a", 1, "chr", 1, 2, "s1", "c1", "g1", "IAwFC"), ("a", 2, "chr", 5, 6, "s1", "c1", "g1", "IO"), ("b", 1, "chr", 1, 2, "s1;s2", "c1;c2", "g1", "A"), ("b", 2, "chr", 9, 10, "s2", "c2", "g1", "ArSC")]
    typed = spark.createDataFrame(g, schemas.GENOTYPES)
    cs = [("a", 1, "m", "x", 4, "s1", "c1", "g1", "ACGG"), ("a", 2, "m", "x", 4, "s1", "c1", "g1", "CCGT"), ("b", 1, "m", "x", 6, "s3", "c1", "g1", "ACGGAA"), ("b", 2, "m", "x", 5, "s2", "c2", "g1", "TTTTT")]
    held = spark.createDataFrame(cs, schemas.CLUSTERSEQ)
    got = {r.cluster: r for r in cohort.summarize(typed, held).collect()}
    r = got["c1"]
    assert (r.num_unique_sites_all, r.num_unique_sites_unambig, r.num_unique_seqs, r.mean_length, r.min_length, r.max_length) == (2, 2, 2, 5.0, 4, 6)
    assert (r.num_samples, r.mean_copy, r.max_copy, r.IAwFC, r.IO, r.A, r.ArSC) == (2, 1.5, 2, 1, 1, 1, 0)
    assert (r.repr_seqid, r.repr_seq_length) == ("s1", 4)
    group = cohort.summarize(typed, held, "group").collect()
    assert len(group) == 1 and group[0].num_unique_sites_all == 3 and group[0].repr_cluster == "c1" and group[0].max_copy == 2
    assert sorted(x.name for x in cohort.cluster_fasta(typed, held).collect()) == ["s1|c1|g1", "s2|c2|g1", "s3|c1|g1"]


def test_workflow(spark, tables):
    alignments, genome = tables
    end = SITE + REPEAT
    assembly = spark.createDataFrame([("as", GENOME[:end] + ELEMENT + GENOME[SITE:])], schemas.SEQUENCES)
    out = workflow.run(workflow.Inputs(alignments, genome, assembly=assembly, database=spark.createDataFrame([("e", ELEMENT)], schemas.SEQUENCES)))
    assert out.pairs.count() == 2
    found = {(r.sample, r.method): r.inferred_seq for r in out.inferred.collect()}
    assert {s for s, m in found if m == schemas.FULL_CONTEXT} == {"a", "b"}
    assert found["a", schemas.FULL_CONTEXT] == ELEMENT == found["a", schemas.NO_CONTEXT] == found["a", schemas.DATABASE]
    assert {(r.sample, r.conf) for r in out.genotypes.collect()} == {("a", "IAwFC"), ("b", "IAwFC")}
    c = out.clusters.collect()
    assert len(c) == 1 and (c[0].num_samples, c[0].IAwFC, c[0].repr_seq) == (2, 2, ELEMENT)
    assert out.groups.count() == 1 and [r.seq for r in out.fasta.collect()] == [ELEMENT]


def test_command_line(spark, tables, tmp_path):
    alignments, genome = tables
    alignments.write.parquet(str(tmp_path / "reads.parquet"))
    files.write_fasta(genome, str(tmp_path / "genome.fna"))
    at = lambda x: str(tmp_path / x)
    workflow.main(["findflanks", at("reads.parquet"), "-o", at("flanks"), "-minlen", "9", "--min_softclip_ratio", "0.1"])
    workflow.main(["pairflanks", at("flanks"), at("reads.parquet"), at("genome.fna"), "-o", at("pairs"), "-maxdr", "20"])
    files.write_fasta(spark.createDataFrame([("e", ELEMENT)], schemas.SEQUENCES), str(tmp_path / "db.fna"))
    workflow.main(["inferseq-database", at("pairs"), at("db.fna"), "-o", at("inferred")])
    workflow.main(["clusterseq", at("inferred"), "-o", at("clusterseq"), "-minsize", "70"])
    assert files.read_tsv(spark, at("clusterseq"), schemas.CLUSTERSEQ).count() == 2
    workflow.main(["findflanks", at("reads.parquet"), "-o", at("none"), "-minlen", "90"])
    assert files.read_tsv(spark, at("none"), schemas.FLANKS).count() == 0
    workflow.main(["genotype", at("clusterseq"), at("pairs"), "-o", at("typed"), "--no-filter_clusters_inferred_assembly"])
    workflow.main(["makefasta", at("clusterseq"), at("typed"), "-o", at("fasta")])
    assert [r.seq for r in files.read_fasta(spark, at("fasta")).collect()] == [ELEMENT]


def test_configuration(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    workflow.main(["getworkflow", "-o", at("config.yml")])
    assert workflow.configured(spark, at("config.yml")) == workflow.Workflow() == workflow.configured(spark, None)
    (tmp_path / "own.yml").write_text("bam_dir: reads\nmemory: 16000\nfindflanks:\n  minlen: 11\n  maxir: 0.05\ninferseq_reference:\n  maxsize: 5000\nclusterseq:\n  minsize: 80\ngenotype:\n  filter_clusters: False\n")
    w = workflow.configured(spark, at("own.yml"))
    assert (w.bam_dir, w.findflanks.min_softclip_length, w.findflanks.max_indel_ratio, w.findflanks.min_softclip_count) == ("reads", 11, 0.05, 2)
    assert (w.inferseq.max_inferseq_size, w.clusterseq.minimum_size, w.genotype.filter_clusters_inferred_assembly) == (5000, 80, False)
    defaults = {"findflanks": "8 2 20 21 22 0.1 0.03 30 2", "pairflanks": "20 20 21 0.15 30", "inferseq": "0.95 0.05 30 200000", "inferseq_overlap": "10 0.9 30", "inferseq_database": "0.9 0.05 10", "makedatabase": "30 200000", "clusterseq": "70 200000", "genotype": "True"}
    for name, want in defaults.items():
        got = [str(v) for v in vars(getattr(workflow.Workflow(), name)).values()]
        assert set(want.split()) <= set(got), name
    with pytest.raises(KeyError):
        workflow.Workflow.from_dict({"findflanks": {"nothing": 1}})


def test_working_directory(spark, tables, tmp_path):
    """Two samples of one genome, one of them with an assembly, by the folder convention."""
    alignments, genome = tables
    end = SITE + REPEAT
    for s in ("a", "b"):
        alignments.filter(F.col("sample") == s).write.parquet(str(tmp_path / "00.bam" / f"{s}.g1.parquet"))
    files.write_fasta(genome, str(tmp_path / "00.genome" / "g1.fna"))
    files.write_fasta(spark.createDataFrame([("chr", GENOME[:end] + ELEMENT + GENOME[SITE:])], schemas.SEQUENCES), str(tmp_path / "00.assembly" / "a.fna"))
    workflow.main(["workflow", str(tmp_path)])
    typed = files.read_tsv(spark, str(tmp_path / "03.results/g1/02.genotype"), schemas.GENOTYPES).collect()
    assert {(r["sample"], r.conf) for r in typed} == {("a", "IAwFC"), ("b", "IDB")}
    inferred = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "01.stages/g1/03.inferseq"))
    found = {(r["sample"], r.method): r["loc"] for r in inferred.collect()}
    assert found["a", schemas.FULL_CONTEXT].startswith("chr:") and ("b", schemas.FULL_CONTEXT) not in found
    assert [r.seq for r in files.read_fasta(spark, str(tmp_path / "03.results/g1/05.makefasta")).collect()] == [ELEMENT]
    assert (tmp_path / "03.results/g1/03.summarize.clusters").exists() and (tmp_path / "01.stages/g1/01.findflanks/sample=a").exists()


def test_a_second_run_computes_nothing(spark, tables, tmp_path, caplog):
    """A finished directory is read; another parameter computes what depends on it; a changed file all that is made of it."""
    alignments, genome = tables
    for s in ("a", "b"):
        alignments.filter(F.col("sample") == s).write.parquet(str(tmp_path / "00.bam" / f"{s}.g1.parquet"))
    files.write_fasta(genome, str(tmp_path / "00.genome" / "g1.fna"))
    caplog.set_level("INFO", logger="graftline")

    def run(w):
        caplog.clear()
        out = workflow.run_directory(spark, str(tmp_path), w)["g1"]
        said = next(r.getMessage() for r in caplog.records if "computed" in r.getMessage())
        return out, set(said.partition("computed ")[2].partition(";")[0].split(", "))

    first, computed = run(workflow.Workflow())
    assert {"alignments", "findflanks", "pairflanks", "inferseq_database", "clusterseq", "genotype", "write.genotype"} <= computed
    assert any(r.getMessage().startswith("findflanks: ") and " rows in " in r.getMessage() for r in caplog.records)
    again, computed = run(workflow.Workflow())
    assert computed == {"nothing"} and sorted(again.genotypes.collect()) == sorted(first.genotypes.collect())
    w = workflow.Workflow.from_dict({"genotype": {"filter_clusters": False}})
    _, computed = run(w)
    assert computed == {"genotype", "summarize.clusters", "summarize.groups", "makefasta", "write.genotype", "write.summarize.clusters", "write.summarize.groups", "write.makefasta"}
    kept = tmp_path / "01.stages/g1/.kept/pairflanks"
    (key,) = kept.iterdir()
    assert {"stage", "key", "rows", "seconds", "from", "parameters"} == set(__import__("json").loads((key / "_manifest.json").read_text()))
    (key / "_SUCCESS").unlink()  # as a run that was broken off leaves it
    _, computed = run(w)
    assert computed == {"pairflanks"}
    files.write_fasta(genome, str(tmp_path / "00.genome" / "g1.fna"))
    _, computed = run(w)
    assert "findflanks" in computed and "alignments" not in computed


def test_clip_filters(spark):
    rows = []
    alignment(rows, "s", "both", 100, "40S15M40S", "A" * 95)
    alignment(rows, "s", "ok", 100, "40S30M40S", "A" * 110)
    df = spark.createDataFrame(rows, schemas.ALIGNMENTS)
    assert [r.read_name for r in df.filter(cg.passes_read_filters(20, 21)).collect()] == ["ok"]
    assert df.select(F.col("read_name")).count() == 2
