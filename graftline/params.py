"""Parameters of every stage with their effective defaults."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields


@dataclass(frozen=True)
class FindFlanks:
    min_softclip_length: int = 8
    min_softclip_count: int = 2
    min_alignment_quality: int = 20
    min_alignment_inner_length: int = 21
    min_distance_to_mate: int = 22
    min_softclip_ratio: float = 0.10
    max_indel_ratio: float = 0.03
    large_insertion_cutoff: int = 30
    min_count_consensus: int = 2
    min_cluster_similarity: float = 0.75
    #: Count only real soft clips towards the minimum length, not terminal mismatches.
    strict_min_length: bool = False


@dataclass(frozen=True)
class PairFlanks:
    max_direct_repeat_length: int = 20
    min_alignment_quality: int = 20
    min_alignment_inner_length: int = 21
    max_junction_spanning_prop: float = 0.15
    large_insertion_cutoff: int = 30
    truncated_flank_length: int = 40
    ir_distance_from_end: int = 15
    insertion_spanning_length: int = 10
    target_region_size: int = 50


@dataclass(frozen=True)
class InferAligned:
    min_perc_identity: float = 0.95
    max_internal_softclip_prop: float = 0.05
    min_inferseq_size: int = 30
    max_inferseq_size: int = 200_000
    context_width: int = 25


@dataclass(frozen=True)
class InferOverlap:
    min_overlap_score: int = 10
    min_overlap_perc_identity: float = 0.9
    min_inferseq_size: int = 30


@dataclass(frozen=True)
class InferDatabase:
    min_perc_identity: float = 0.90
    max_internal_softclip_prop: float = 0.05
    max_edge_distance: int = 10


@dataclass(frozen=True)
class MakeDatabase:
    minimum_size: int = 30
    maximum_size: int = 200_000
    identity: float = 0.99
    coverage: float = 0.99


@dataclass(frozen=True)
class ClusterSeq:
    minimum_size: int = 70
    maximum_size: int = 200_000
    identity: float = 0.90
    coverage: float = 0.85


@dataclass(frozen=True)
class Genotype:
    filter_clusters_inferred_assembly: bool = True


#: Short names of parameters, on the command line and in configuration files.
SHORT = {
    "minlen": "min_softclip_length",
    "mincount": "min_softclip_count",
    "minq": "min_alignment_quality",
    "minial": "min_alignment_inner_length",
    "mindist": "min_distance_to_mate",
    "minratio": "min_softclip_ratio",
    "maxir": "max_indel_ratio",
    "lins": "large_insertion_cutoff",
    "mcc": "min_count_consensus",
    "maxdr": "max_direct_repeat_length",
    "maxjsp": "max_junction_spanning_prop",
    "minident": "min_perc_identity",
    "maxclip": "max_internal_softclip_prop",
    "maxedgedist": "max_edge_distance",
    "minscore": "min_overlap_score",
    "minopi": "min_overlap_perc_identity",
    "filter_clusters": "filter_clusters_inferred_assembly",
}
#: Sizes have other names in each block.
_SIZES = {"minsize": ("min_inferseq_size", "minimum_size"), "maxsize": ("max_inferseq_size", "maximum_size")}


def long_name(short: str, block: type) -> str:
    """The field of a block of parameters that a short name stands for; long names stand for themselves."""
    known = {f.name for f in fields(block)}
    for name in (short, SHORT.get(short), *_SIZES.get(short, ())):
        if name in known:
            return name
    raise KeyError(f"{block.__name__} has no parameter {short!r}")


@dataclass(frozen=True)
class Workflow:
    """One run's parameters; ``from_dict`` takes the blocks of a JSON or YAML configuration."""

    findflanks: FindFlanks = field(default_factory=FindFlanks)
    pairflanks: PairFlanks = field(default_factory=PairFlanks)
    inferseq: InferAligned = field(default_factory=InferAligned)
    inferseq_assembly: InferAligned = field(default_factory=InferAligned)
    inferseq_overlap: InferOverlap = field(default_factory=InferOverlap)
    inferseq_database: InferDatabase = field(default_factory=InferDatabase)
    makedatabase: MakeDatabase = field(default_factory=MakeDatabase)
    clusterseq: ClusterSeq = field(default_factory=ClusterSeq)
    genotype: Genotype = field(default_factory=Genotype)
    genome_dir: str = "00.genome"
    bam_dir: str = "00.bam"
    assembly_dir: str = "00.assembly"
    stages_dir: str = "01.stages"
    database_dir: str = "02.database"
    results_dir: str = "03.results"

    @staticmethod
    def from_dict(blocks: dict) -> Workflow:
        """Blocks by name with long or short parameter names; what isn't a parameter here (cores, memory) is left out."""
        known, found = Workflow(), {}
        for name, own in blocks.items():
            name = {"inferseq_reference": "inferseq"}.get(name, name)
            if isinstance(own, dict):
                kind = type(getattr(known, name))
                found[name] = kind(**{long_name(k, kind): v for k, v in own.items()})
            elif name in {f.name for f in fields(Workflow)}:
                found[name] = own
        return Workflow(**found)

    def to_dict(self) -> dict:
        """All blocks with long names: a template of a configuration file."""
        return asdict(self)
