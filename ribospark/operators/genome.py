"""Peptides on the genome: transcript coordinates of coding blocks and GFF3 rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def transcript_positions(blocks: DataFrame) -> DataFrame:
    """Coding blocks with rank, trans_start and trans_end along their transcript (start ascending on +, descending on -)."""
    along = F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("start"))
    order = Window.partitionBy("transcript_id").orderBy(along, "end")
    size = F.col("end") - F.col("start") + 1
    end = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("rank", F.row_number().over(order)).withColumn("trans_end", end).withColumn("trans_start", F.col("trans_end") - size + 1)


#: Peptides that are looked for in a protein at a time.
PEPTIDES = 2000


def _places(seq: Column, peptides: Column) -> Column:
    """The first place (from 1, or 0) of each peptide in its sequence."""

    @F.arrow_udf("array<int>")
    def run(seqs: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([[s.find(p) + 1 for p in ps] for s, ps in zip(seqs.to_pylist(), lists.to_pylist())], pa.list_(pa.int32()))

    return run(seq, peptides)


def map_peptides(peptides: DataFrame, id_map: DataFrame, proteins: DataFrame, blocks: DataFrame, seen: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Peptides (peptide, protein, ord) with chrom, strand, start, end and their coding blocks, in rank order.

    The first row of a peptide and the first mapping of a protein count. Peptides that no
    protein, transcript or block places are left out; ``seen`` is told the rows at each step by name.
    """
    asked = seen(peptides.filter("peptide is not null").groupBy("peptide").agg(F.min_by("protein", "ord").alias("protein")), "distinct peptides")
    first = id_map.groupBy("protein").agg(F.min_by("transcript", "ord").alias("transcript_id"))
    known = proteins.filter("seq is not null").groupBy(F.col("id").alias("protein")).agg(F.min_by("seq", "ord").alias("_seq"))
    mapped = seen(asked.join(first, "protein"), "peptides with a transcript")
    # a protein's text meets some thousand of its peptides in one row
    many = mapped.groupBy("protein").agg(F.ceil(F.count(F.lit(1)) / PEPTIDES).alias("_parts"))
    grouped = mapped.join(many, "protein").groupBy("protein", "transcript_id", F.pmod(F.xxhash64("peptide"), F.col("_parts")).alias("_part")).agg(F.collect_list("peptide").alias("_peptides"))
    found = grouped.join(known, "protein").select("protein", "transcript_id", F.inline(F.arrays_zip(F.col("_peptides").alias("peptide"), _places(F.col("_seq"), F.col("_peptides")).alias("_at")))).filter("_at > 0")
    found = seen(found, "peptides that their protein holds")
    found = found.withColumn("n1", F.col("_at") * 3 - 2).withColumn("n2", F.col("_at") * 3 - 3 + F.length("peptide") * 3).drop("_at")
    placed = found.join(transcript_positions(blocks), "transcript_id").filter("trans_start <= n2 and n1 <= trans_end")
    plus = F.col("strand") == "+"
    low = F.when(plus, F.col("start") + F.greatest(F.col("n1") - F.col("trans_start"), F.lit(0))).otherwise(F.col("end") - (F.least("n2", "trans_end") - F.col("trans_start")))
    high = F.when(plus, F.col("start") + (F.least("n2", "trans_end") - F.col("trans_start"))).otherwise(F.col("end") - F.greatest(F.col("n1") - F.col("trans_start"), F.lit(0)))
    cut = placed.withColumn("_low", low).withColumn("_high", high)
    out = cut.groupBy("peptide").agg(
        F.first("chrom").alias("chrom"), F.first("strand").alias("strand"), F.min("_low").alias("start"), F.max("_high").alias("end"),
        F.array_sort(F.collect_list(F.struct("rank", F.col("_low").alias("start"), F.col("_high").alias("end")))).alias("blocks"),
        (F.min("trans_start") <= F.first("n1")).alias("_from"), (F.max("trans_end") >= F.first("n2")).alias("_to"),
    )
    return out.filter("_from and _to and start > 0 and start <= end").drop("_from", "_to")


def gff3_rows(mapped: DataFrame) -> DataFrame:
    """GFF3 rows: an mRNA and its CDS parts for each peptide; the phase is 0 in the first part and ``.`` behind it."""
    chrom = F.concat(F.lit("chr"), F.replace("chrom", F.lit("MT"), F.lit("M")))
    ordered = F.array_sort(F.transform("blocks", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    row = lambda kind, start, end, phase, name: F.struct(F.lit(kind).alias("type"), start.cast("long").alias("start"), end.cast("long").alias("end"), phase.alias("phase"), F.concat(F.lit(name), "peptide").alias("attributes"))
    parts = F.transform(ordered, lambda b, i: row("CDS", b["start"], b["end"], F.when(i == 0, F.lit("0")).otherwise(F.lit(".")), "Parent="))
    rows = F.concat(F.array(row("mRNA", F.col("start"), F.col("end"), F.lit("."), "ID=")), parts)
    return mapped.select("peptide", chrom.alias("seqid"), F.lit("MS").alias("source"), "strand", F.posexplode(rows).alias("ord", "r")).select("peptide", "ord", "seqid", "source", F.col("r.type").alias("type"), F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.lit(".").alias("score"), "strand", F.col("r.phase").alias("phase"), F.col("r.attributes").alias("attributes"))
