"""Somatic mutation tables to proteins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.functions.constants import PROTEIN_CLASSES
from ribospark.functions.mutations import hgvs_protein, maf_dna
from ribospark.functions.sequences import translate
from ribospark.functions.variants import unversioned


Seen = Callable[[DataFrame, str], DataFrame]


def _unseen(df: DataFrame, name: str) -> DataFrame:
    return df


def census_proteins(mutations: DataFrame, genes: DataFrame, accepted: list[str] | None = None, seen: Seen = _unseen) -> DataFrame:
    """(header, seq, group) of census mutations: gene, dna_mut, aa_mut, mutation_type, group, ord.

    Silent mutations go. A gene may have several sequences; the first (by ``ord``) that
    gives a protein counts. Rows are per mutation; ``first_by_header`` makes them distinct. ``seen``
    is told the rows at each step by name. A gene is translated once, a changed sequence once.
    """
    kept = seen(seen(mutations, "mutations read").filter(~F.contains("mutation_type", F.lit("coding silent"))), "mutations that are not silent")
    if accepted and accepted != ["all"]:
        kept = seen(kept.filter(F.col("group").isin(*accepted)), "mutations of accepted groups")
    g = genes.select(F.col("id").alias("_gene"), "seq", F.col("ord").alias("_gene_ord"), translate(F.col("seq")).alias("_native"))
    pairs = seen(kept.join(g, F.col("gene") == F.col("_gene")), "pairs of a mutation and a sequence of its gene")
    protein = hgvs_protein(F.col("seq"), F.col("dna_mut"), F.col("aa_mut"), F.col("mutation_type"), F.col("_native"))
    # exploded, as a filter on a mere column is moved below it and makes every protein twice
    made = seen(pairs.select(*kept.columns, "_gene_ord", F.explode(F.array(protein)).alias("_protein")).filter(F.col("_protein") != ""), "pairs with a protein")
    header = F.concat_ws(":", F.lit("COSMIC"), "gene", "aa_mut", F.replace("mutation_type", F.lit(" "), F.lit("")))
    return made.groupBy("ord").agg(F.min_by(header, "_gene_ord").alias("header"), F.min_by("_protein", "_gene_ord").alias("seq"), F.first("group").alias("group"))


def first_by_header(entries: DataFrame) -> DataFrame:
    """Distinct headers with the sequence of their first row."""
    return entries.groupBy("header").agg(F.min_by("seq", "ord").alias("seq"))


def last_by_group(entries: DataFrame) -> DataFrame:
    """(group, header, seq) for one file by group: letters of the group name; the last row of a header counts."""
    return entries.groupBy(F.regexp_replace("group", "[^a-zA-Z]", "").alias("group"), "header").agg(F.max_by("seq", "ord").alias("seq"))


def mutation_table_proteins(maf: DataFrame, transcripts: DataFrame, samples: DataFrame | None = None, accepted: list[str] | None = None, min_length: int = 6, seen: Seen = _unseen) -> DataFrame:
    """(ord, header, seq, group) of mutation-table rows of the protein-changing classes.

    ``transcripts`` (id, seq, ord): the first record of an unversioned id counts.
    ``samples`` (sample, group) is asked only if groups are; rows of unknown samples go.
    """
    kept = seen(seen(maf, "mutations read").filter(F.col("varclass").isin(*PROTEIN_CLASSES)), "mutations that change a protein")
    if samples is not None:
        kept = kept.join(samples.groupBy("sample").agg(F.min("group").alias("group")), "sample")
        if accepted and accepted != ["all"]:
            kept = kept.filter(F.col("group").isin(*accepted))
        kept = seen(kept, "mutations of known samples and accepted groups")
    elif "group" not in kept.columns:
        kept = kept.withColumn("group", F.lit(None).cast("string"))
    seqs = transcripts.groupBy(unversioned(F.col("id")).alias("_tx")).agg(F.min_by("seq", "ord").alias("_seq"))
    made = seen(kept.join(seqs, F.col("transcript_id") == F.col("_tx")), "mutations with a transcript").withColumn("_dna", maf_dna(F.col("_seq"), F.col("hgvsc"), F.col("vartype")))
    made = made.filter(F.length("_dna") >= 3 * (min_length + 1)).withColumn("seq", translate(F.col("_dna")))  # a protein has a residue for every three bases
    return made.select("ord", F.concat_ws(":", F.lit("cbiomut"), "transcript_id", "gene", "hgvsp", "varclass").alias("header"), "seq", "group")
