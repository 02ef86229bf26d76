"""Explicit schemas of every table and the closed sets of methods and confidence codes."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"s": StringType(), "i": IntegerType(), "l": LongType(), "d": DoubleType(), "b": BooleanType()}


def _schema(text: str) -> StructType:
    """``name:code`` pairs with the codes of ``_TYPES``."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (x.split(":") for x in text.split())])


CIGAR = ArrayType(StructType([StructField("op", StringType()), StructField("len", IntegerType())]))

#: Coordinates are 0-based and half-open everywhere.
ALIGNMENTS = StructType(
    [
        *_schema("sample:s read_name:s flag:i contig:s ref_start:i ref_end:i mapq:i is_reverse:b is_unmapped:b mate_is_unmapped:b").fields,
        StructField("cigar", CIGAR),
        StructField("seq", StringType()),
        StructField("quals", ArrayType(IntegerType())),
        *_schema("md:s nm:i as_score:i mate_seq:s mate_quals:s").fields,
    ]
)
CONTIGS = _schema("contig:s length:i")
SEQUENCES = _schema("name:s seq:s")

FLANKS = _schema(
    "sample:s flank_id:i contig:s pos:i orient:s softclip_count_5p:l softclip_count_3p:l runthrough_count:l small_insertion_count_5p:l small_insertion_count_3p:l "
    "large_insertion_count_5p:l large_insertion_count_3p:l deletion_count:l upstream_deletion_count:l downstream_deletion_count:l total_count:l consensus_softclip_count:l consensus_seq:s"
)
PAIRS = _schema(
    "sample:s pair_id:i contig:s pos_5p:i pos_3p:i softclip_count_5p:l softclip_count_3p:l total_count_5p:l total_count_3p:l spanning_count:l has_IR:b IR_length:i IR_5p:s IR_3p:s "
    "seq_5p:s seq_3p:s direct_repeat_reference:s direct_repeat_reads_consensus:s"
)
INFERRED = _schema("sample:s pair_id:i method:s loc:s inferred_seq_length:i inferred_seq:s")
CLUSTERSEQ = _schema("sample:s pair_id:i method:s loc:s inferred_seq_length:i seqid:s cluster:s group:s inferred_seq:s")
GENOTYPES = _schema("sample:s pair_id:i contig:s pos_3p:i pos_5p:i seqid:s cluster:s group:s conf:s")
RECALL_SITES = _schema("contig:s pos_5p:i pos_3p:i")

FULL_CONTEXT = "inferred_assembly_with_full_context"
HALF_CONTEXT = "inferred_assembly_with_half_context"
NO_CONTEXT = "inferred_assembly_without_context"
REFERENCE = "inferred_reference"
OVERLAP = "inferred_overlap"
DATABASE = "inferred_database"
METHODS = (FULL_CONTEXT, HALF_CONTEXT, NO_CONTEXT, REFERENCE, OVERLAP, DATABASE)

#: Confidence of a method, best first; database and reference rank alike.
CONF_OF_METHOD = {FULL_CONTEXT: ("IAwFC", 1), HALF_CONTEXT: ("IAwHC", 2), OVERLAP: ("IO", 3), NO_CONTEXT: ("IAwoC", 4), DATABASE: ("IDB", 5), REFERENCE: ("IDB", 5)}
CONFS = ("IAwFC", "IAwHC", "IO", "IAwoC", "IDB", "ArSC", "ArMS", "ArML", "A")
STRICT_CONFS = ("IAwFC", "IAwHC", "IO", "IAwoC")
