"""The whole cohort as one lazy plan, and a command line.

Every stage is a function of DataFrames; ``run`` chains them over all samples at
once, so what was a process and a file for each sample is one plan here, and
``run_directory`` does so for every genome of a working directory.  Flanks are
aligned by ``operators.align``; alignments of another aligner can be given instead.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators.align import Aligner, align
from .operators.stash import stash
from .operators.unions import union_all
from .params import SHORT, ClusterSeq, FindFlanks, Genotype, InferAligned, InferDatabase, InferOverlap, MakeDatabase, PairFlanks, Workflow, long_name
from .plans import cohort, extend, flanks, infer, pairs
from .sources import bam, files
from .stages import Stages

log = logging.getLogger("graftline")


#: Elements are looked for with a lower least score.
DATABASE_ALIGNER = Aligner(slope=5.0)


@dataclass(frozen=True)
class Inputs:
    """Tables of a run.  Flank alignments that are not given are made here."""

    alignments: DataFrame
    genome: DataFrame
    #: (name, seq), or (sample, name, seq) where each sample has an assembly of its own.
    assembly: DataFrame | None = None
    to_reference: DataFrame | None = None
    to_assembly: DataFrame | None = None
    to_assembly_in_context: DataFrame | None = None
    database: DataFrame | None = None
    to_database: DataFrame | None = None


@dataclass(frozen=True)
class Outputs:
    flanks: DataFrame
    pairs: DataFrame
    inferred: DataFrame
    clusterseq: DataFrame
    genotypes: DataFrame
    clusters: DataFrame
    groups: DataFrame
    fasta: DataFrame


@dataclass
class _Steps:
    """Stages of one run: written tables, kept under keys where there is a folder of stages."""

    stages: Stages | None
    #: Keys of the inputs by name, and of the stages that were made.
    keys: dict[str, str]

    def __call__(self, name: str, build: Callable[[], DataFrame], after: Sequence[str], params: object = None) -> DataFrame:
        if self.stages is None:
            return stash(build(), name)
        made_of = {k: self.keys[k] for k in after}
        self.keys[name] = self.stages.key(name, list(made_of.values()), params)
        return self.stages.table(name, self.keys[name], build, {"from": made_of, "parameters": asdict(params) if params else None})


def _inferred(x: Inputs, w: Workflow, step: _Steps) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(flanks, pairs, inferred sequences by method); what the database gives only if there is one."""
    found = step("findflanks", lambda: flanks.find_flanks(x.alignments, w.findflanks, files.contigs_of(x.genome)), ["alignments", "genome"], w.findflanks)
    paired = step("pairflanks", lambda: pairs.pair_flanks(found, x.alignments, x.genome, w.pairflanks), ["findflanks", "alignments", "genome"], w.pairflanks)
    plain = infer.flank_sequences(paired)
    aligned = lambda given, queries, targets: given if given is not None else stash(align(queries, targets), "aligned")
    parts = {
        "inferseq_overlap": step("inferseq_overlap", lambda: infer.infer_overlap(paired, w.inferseq_overlap), ["pairflanks"], w.inferseq_overlap),
        "inferseq_reference": step("inferseq_reference", lambda: infer.infer_reference(aligned(x.to_reference, plain, x.genome), x.genome, w.inferseq), ["pairflanks", "genome"], w.inferseq),
    }
    if x.assembly is not None:
        parts["inferseq_assembly"] = step("inferseq_assembly", lambda: assembled(x, paired, w), ["pairflanks", "alignments", "genome", "assembly"], w.inferseq_assembly)
    if x.database is not None:
        known = lambda: x.to_database if x.to_database is not None else stash(align(plain, x.database, DATABASE_ALIGNER), "aligned")
        parts["inferseq_database"] = step("inferseq_database", lambda: infer.infer_database(known(), x.database, w.inferseq_database), ["pairflanks", "database"], w.inferseq_database)
    return found, paired, parts


def run(x: Inputs, w: Workflow = Workflow(), step: _Steps | None = None) -> Outputs:
    """All stages, from alignments to the final FASTA table."""
    step = step or _Steps(None, {})
    found, paired, by_method = _inferred(x, w, step)
    parts = list(by_method.values())
    clustered = step("clusterseq", lambda: cohort.cluster_sequences(parts, w.clusterseq), list(by_method), w.clusterseq)
    typed = step("genotype", lambda: cohort.genotype([paired], clustered, w.genotype), ["pairflanks", "clusterseq"], w.genotype)
    last = ["genotype", "clusterseq"]
    return Outputs(
        found,
        paired,
        cohort.union_inferred(parts, 0, 1 << 30),
        clustered,
        typed,
        step("summarize.clusters", lambda: cohort.summarize(typed, clustered), last),
        step("summarize.groups", lambda: cohort.summarize(typed, clustered, "group"), last),
        step("makefasta", lambda: cohort.cluster_fasta(typed, clustered), last),
    )


def assembled(x: Inputs, paired: DataFrame, w: Workflow) -> DataFrame:
    """Insertions found in the assembly; with a sample column, in that of their own sample."""
    own, targets = "sample" in x.assembly.columns, x.assembly
    mark = F.concat(F.col("sample"), F.lit("|"))
    if own:  # contigs of one name in several assemblies
        targets = stash(x.assembly.withColumn("name", F.concat(mark, "name")), "assembly")
    plain = infer.flank_sequences(paired)
    in_context = infer.flank_sequences_in_context(paired, x.alignments, x.genome, w.inferseq_assembly)
    aligned = lambda given, queries: given if given is not None else stash(align(queries, targets), "aligned")
    found = infer.infer_assembly(aligned(x.to_assembly_in_context, in_context), aligned(x.to_assembly, plain), targets.select("name", "seq"), w.inferseq_assembly)
    return found.withColumn("loc", F.when(F.startswith("loc", mark), F.expr("substring(loc, length(sample) + 2)")).otherwise(F.col("loc"))) if own else found


# --- a working directory ---------------------------------------------------------------------------------------------


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of any store that Spark reaches; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def run_directory(spark: SparkSession, workdir: str, w: Workflow = Workflow()) -> dict[str, Outputs]:
    """Every genome of a working directory over all its samples; tables are written beside their inputs.

    ``{genome_dir}/{genome}.fna``, ``{bam_dir}/{sample}.{genome}.bam`` (or .sam, or
    .parquet) and, where there is one, ``{assembly_dir}/{sample}.fna`` are read.  A
    first pass over overlap, reference and assembly makes the genome's database of
    elements; the second adds what the database gives, and reads all else.  Stage tables are partitioned by sample.
    Stages lie in ``{stages_dir}/{genome}/.kept``; what is there under the same inputs and
    parameters is not computed again, nor its output written.
    """
    at = lambda *parts: "/".join([workdir.rstrip("/"), *parts])
    genomes = {n.rpartition(".")[0]: n for n in _listed(spark, at(w.genome_dir)) if n.endswith(".fna")}
    assemblies = {n.rpartition(".")[0]: n for n in _listed(spark, at(w.assembly_dir)) if n.endswith(".fna")}
    out = {}
    for genome, file in genomes.items():
        reads = {}
        for n in _listed(spark, at(w.bam_dir)):
            sample, _, rest = n.partition("." + genome + ".")
            if rest in ("bam", "sam", "parquet"):
                reads[sample] = at(w.bam_dir, n)
        if not reads:
            log.info("no alignments for genome %s", genome)
            continue
        stages = Stages(spark, at(w.stages_dir, genome, ".kept"))
        step = _Steps(stages, {"reads": stages.files_key(*reads.values()), "genome": stages.files_key(at(w.genome_dir, file))})
        alignments = step("alignments", lambda reads=reads: union_all([_alignments(spark, path, sample).withColumn("sample", F.lit(sample)) for sample, path in reads.items()]), ["reads"])
        with_assembly = {s: at(w.assembly_dir, assemblies[s]) for s in reads if s in assemblies}
        own = [files.read_fasta(spark, path).withColumn("sample", F.lit(s)) for s, path in with_assembly.items()]
        step.keys["assembly"] = stages.files_key(*with_assembly.values())
        x = Inputs(alignments, files.read_fasta(spark, at(w.genome_dir, file)), assembly=union_all(own) if own else None)
        log.info("genome %s: %d samples, %d assemblies", genome, len(reads), len(own))
        *_, first = _inferred(x, w, step)
        database = step("makedatabase", lambda first=first: cohort.make_database([cohort.union_inferred(list(first.values()), 0, 1 << 30)], w.makedatabase), list(first), w.makedatabase)
        step.keys["database"] = step.keys["makedatabase"]
        stages.once("write.database", step.keys["makedatabase"], lambda database=database, genome=genome: files.write_fasta(database, at(w.database_dir, genome)))
        y = run(replace(x, database=database), w, step)
        key = step.keys
        inferred_key = stages.key("inferseq", [v for k, v in sorted(key.items()) if k.startswith("inferseq_")])
        for number, (name, own_key, table) in enumerate((("findflanks", key["findflanks"], y.flanks), ("pairflanks", key["pairflanks"], y.pairs), ("inferseq", inferred_key, y.inferred)), 1):
            stages.once(f"write.{name}", own_key, lambda table=table, number=number, name=name, genome=genome: table.write.mode("overwrite").partitionBy("sample").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").csv(at(w.stages_dir, genome, f"{number:02d}.{name}")))
        for number, (name, table) in enumerate((("clusterseq", y.clusterseq), ("genotype", y.genotypes), ("summarize.clusters", y.clusters), ("summarize.groups", y.groups)), 1):
            stages.once(f"write.{name}", key[name], lambda table=table, number=number, name=name, genome=genome: files.write_tsv(table, at(w.results_dir, genome, f"{number:02d}.{name}")))
        stages.once("write.makefasta", key["makefasta"], lambda y=y, genome=genome: files.write_fasta(y.fasta, at(w.results_dir, genome, "05.makefasta")))
        log.info("genome %s: computed %s; kept %s", genome, ", ".join(stages.computed) or "nothing", ", ".join(stages.found) or "nothing")
        out[genome] = y
    return out


# --- command line ----------------------------------------------------------------------------------------------------


def _table(spark: SparkSession, paths: Sequence[str], schema) -> DataFrame:
    """Parquet folders, or TSV files or lists of them, of a known schema."""
    paths = files.read_path_list(spark, list(paths)) if not paths[0].endswith(".parquet") else list(paths)
    return spark.read.schema(schema).parquet(*paths) if paths[0].endswith(".parquet") else files.read_tsv(spark, paths, schema)


def _alignments(spark: SparkSession, path: str, sample: str) -> DataFrame:
    if path.endswith(".sam"):
        return files.read_sam(spark, path, sample)
    if path.endswith(".bam"):
        return bam.read_bam(spark, path, sample)
    return spark.read.schema(schemas.ALIGNMENTS).parquet(path)


def _contigs(spark: SparkSession, path: str) -> DataFrame | None:
    """The contigs of an alignment file's header; Parquet has none."""
    if path.endswith(".sam"):
        return files.read_contigs(spark, path)
    return bam.read_contigs(spark, path) if path.endswith(".bam") else None


#: Positional arguments (+ for several), blocks of parameters, and the default output of each command, in order of a run.
COMMANDS: dict[str, tuple[list[str], tuple[type, ...], str]] = {
    "workflow": (["workdir"], (), ""),
    "getworkflow": ([], (), "config.yml"),
    "findflanks": (["alignments"], (FindFlanks,), "graftline.findflanks.tsv"),
    "pairflanks": (["flanks", "alignments", "genome"], (PairFlanks,), "graftline.pairflanks.tsv"),
    "inferseq-assembly": (["pairs", "alignments", "assembly", "genome"], (InferAligned,), "graftline.inferseq_assembly.tsv"),
    "inferseq-reference": (["pairs", "genome"], (InferAligned,), "graftline.inferseq_reference.tsv"),
    "inferseq-overlap": (["pairs"], (InferOverlap,), "graftline.inferseq_overlap.tsv"),
    "makedatabase": (["inferred+"], (MakeDatabase,), "graftline.database"),
    "inferseq-database": (["pairs", "database"], (InferDatabase,), "graftline.inferseq_database.tsv"),
    "clusterseq": (["inferred+"], (ClusterSeq,), "graftline.clusterseq.tsv"),
    "genotype": (["clusterseq", "pairs+"], (Genotype,), "graftline.genotype.tsv"),
    "summarize": (["clusterseq", "genotypes"], (), "graftline.summarize"),
    "makefasta": (["clusterseq", "clusters"], (), "graftline.makefasta"),
    "formatbam": (["alignments", "out"], (), ""),
    "recall": (["sites", "alignments"], (FindFlanks,), "graftline.recall.tsv"),
    "extendpairs": (["pairs", "alignments"], (extend.Extension,), "graftline.extendpairs.tsv"),
}
_SHORT_SIZES = {"min_inferseq_size": "minsize", "minimum_size": "minsize", "max_inferseq_size": "maxsize", "maximum_size": "maxsize"}


def parser() -> argparse.ArgumentParser:
    """One command for each stage; parameters have their long and short names and the defaults of ``params``."""
    out = argparse.ArgumentParser(prog="graftline")
    sub = out.add_subparsers(dest="command", required=True)
    short = {v: k for k, v in SHORT.items()} | _SHORT_SIZES
    for name, (args, blocks, default) in COMMANDS.items():
        one = sub.add_parser(name, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
        for a in args:
            one.add_argument(a.rstrip("+"), nargs="+" if a.endswith("+") else None)
        one.add_argument("--config", "-c", help="JSON or YAML file of parameter blocks, which options override")
        one.add_argument("--cores", "--threads", "-t", type=int, help="local cores, where no cluster is set")
        one.add_argument("--memory", "-m", type=int, help="megabytes of the driver, where no cluster is set")
        if default:
            one.add_argument("--output_file", "--output_dir", "--output_prefix", "-o", dest="output", default=default)
        if name == "findflanks":
            one.add_argument("--sample_id", "-id", help="the output's path by default")
        if name == "formatbam":
            one.add_argument("--single-end", action="store_true", help="reads have no mates")
        for block in blocks:
            for f in fields(block):
                names = [f"--{f.name}", *([f"-{short[f.name]}"] if f.name in short else [])]
                kind = argparse.BooleanOptionalAction if isinstance(f.default, bool) else None
                # Nothing unless it is given, so that a configuration file's value stands; the help shows the default.
                own = {"action": kind} if kind else {"type": type(f.default)}
                one.add_argument(*(n for n in names if not kind or n.startswith("--")), dest=f"p_{f.name}", default=argparse.SUPPRESS, help=f"default: {f.default}", **own)
    return out


def configured(spark: SparkSession, path: str | None) -> Workflow:
    """The parameters of a JSON or YAML file, or the defaults."""
    if not path:
        return Workflow()
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    try:
        return Workflow.from_dict(json.loads(text))
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("a configuration that isn't JSON needs PyYAML") from error
        return Workflow.from_dict(yaml.safe_load(text) or {})


def template(w: Workflow = Workflow()) -> str:
    """A configuration file with every parameter's default, in the part of YAML that is plain mappings."""
    lines = []
    for name, own in w.to_dict().items():
        lines += [f"{name}:", *(f"  {k}: {json.dumps(v)}" for k, v in own.items())] if isinstance(own, dict) else [f"{name}: {json.dumps(own)}"]
    return "\n".join(lines) + "\n"


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    log.info("parameters\n%s", "\n".join(f"{k.removeprefix('p_')}: {v}" for k, v in sorted(vars(a).items())))
    if a.command == "getworkflow":
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(template())
        return
    builder = SparkSession.builder.appName("graftline")
    if a.cores and "SPARK_REMOTE" not in os.environ:
        builder = builder.master(f"local[{a.cores}]")
    if a.memory:
        builder = builder.config("spark.driver.memory", f"{a.memory}m")
    spark = builder.getOrCreate()
    w, given = configured(spark, a.config), {k[2:]: v for k, v in vars(a).items() if k.startswith("p_")}
    own = lambda block: replace(block, **{long_name(k, type(block)): v for k, v in given.items()})
    s = schemas
    tsv = lambda df: files.write_tsv(df, a.output)
    table = lambda paths, schema: _table(spark, [paths] if isinstance(paths, str) else paths, schema)
    sample = getattr(a, "sample_id", None) or os.path.abspath(getattr(a, "output", "") or ".")
    aligned = lambda path: _alignments(spark, path, sample)
    fasta = lambda path: files.read_fasta(spark, path)
    if a.command == "workflow":
        run_directory(spark, a.workdir, w)
    elif a.command == "findflanks":
        tsv(flanks.find_flanks(aligned(a.alignments), own(w.findflanks), _contigs(spark, a.alignments)))
    elif a.command == "recall":
        tsv(flanks.recall(aligned(a.alignments), table(a.sites, s.RECALL_SITES), own(w.findflanks), _contigs(spark, a.alignments)))
    elif a.command == "pairflanks":
        found = table(a.flanks, s.FLANKS)
        # Reads of one file are of the one sample that the flanks name.
        name = found.select("sample").first()
        tsv(pairs.pair_flanks(found, _alignments(spark, a.alignments, name["sample"] if name else sample), fasta(a.genome), own(w.pairflanks)))
    elif a.command == "inferseq-overlap":
        tsv(infer.infer_overlap(table(a.pairs, s.PAIRS), own(w.inferseq_overlap)))
    elif a.command == "inferseq-reference":
        genome = fasta(a.genome)
        tsv(infer.infer_reference(align(infer.flank_sequences(table(a.pairs, s.PAIRS)), genome), genome, own(w.inferseq)))
    elif a.command == "inferseq-assembly":
        paired = table(a.pairs, s.PAIRS)
        name = paired.select("sample").first()
        reads = _alignments(spark, a.alignments, name["sample"] if name else sample)
        tsv(assembled(Inputs(reads, fasta(a.genome), assembly=fasta(a.assembly)), paired, replace(w, inferseq_assembly=own(w.inferseq_assembly))))
    elif a.command == "inferseq-database":
        known = fasta(a.database)
        tsv(infer.infer_database(align(infer.flank_sequences(table(a.pairs, s.PAIRS)), known, DATABASE_ALIGNER), known, own(w.inferseq_database)))
    elif a.command == "extendpairs":
        paired = table(a.pairs, s.PAIRS)
        name = paired.select("sample").first()
        tsv(extend.extend_pairs(paired, _alignments(spark, a.alignments, name["sample"] if name else sample), own(extend.Extension())))
    elif a.command == "formatbam":
        rows = _alignments(spark, a.alignments, sample)
        rows = rows.filter(F.col("flag").bitwiseAND(0x900) == 0) if a.single_end else files.format_alignments(rows)
        write = files.write_sam if a.out.endswith(".sam") else files.write_alignments
        write(rows, a.out, _contigs(spark, a.alignments)) if a.out.endswith(".sam") else write(rows, a.out)
    elif a.command == "makedatabase":
        files.write_fasta(cohort.make_database([table(a.inferred, s.INFERRED)], own(w.makedatabase)), a.output)
    elif a.command == "clusterseq":
        tsv(cohort.cluster_sequences([table(a.inferred, s.INFERRED)], own(w.clusterseq)))
    elif a.command == "genotype":
        paired, clustered = table(a.pairs, s.PAIRS), table(a.clusterseq, s.CLUSTERSEQ)
        n = cohort.null_genotypes([paired], clustered).first()
        log.info("of %d candidate insertions, %d have an inferred sequence and %d have none", *n)
        tsv(cohort.genotype([paired], clustered, own(w.genotype)))
    elif a.command == "summarize":
        clustered, typed = table(a.clusterseq, s.CLUSTERSEQ), table(a.genotypes, s.GENOTYPES)
        files.write_tsv(cohort.summarize(typed, clustered), f"{a.output}.clusters")
        files.write_tsv(cohort.summarize(typed, clustered, "group"), f"{a.output}.groups")
    else:
        # Genotypes or a summary: any table with a column of clusters.
        named = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(a.clusters).select("cluster")
        files.write_fasta(cohort.cluster_fasta(named, table(a.clusterseq, s.CLUSTERSEQ)), a.output)


if __name__ == "__main__":
    main()
