"""Genomic and proteomic views of the driver's tables.

The tables hold no sequences, so every view derives them row by row: a text's letters
become nucleotides or residues, line items become coding blocks, events become variants,
orders become mutations, embeddings become spectra. All rows and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.plans.runtime import maybe_among

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
RESIDUES = "ACDEFGHIKLMNPQRSTVWYKRKRPI"
STOPPED = "ACDEFGHIKLMNPQRSTVW*KR-RPI"
#: Every residue's neighbour in the alphabet, for mutated peptides.
FROM, TO = "ACDEFGHIKLMNPQRSTVWY", "CDEFGHIKLMNPQRSTVWYA"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letters(to: str) -> Column:
    return F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), LETTERS, to)


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), _letters(BASES).alias("seq"), F.col("doc_id").alias("ord"))


def protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), _letters(RESIDUES).alias("seq"), F.col("doc_id").alias("ord"))


def stopped_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat_ws(" ", F.col("doc_id").cast("string"), "source").alias("description"), _letters(STOPPED).alias("seq"))


def blocks(spark: SparkSession, sf_dir: str, transcripts: DataFrame | None = None) -> DataFrame:
    """Coding blocks: one for each distinct (order, line number, part); ``transcripts`` (id): only theirs."""
    o = F.col("l_orderkey")
    start = o % 1000 * 10_000 + F.col("l_linenumber") * 1000
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", start.cast("long").alias("start"), (start + 30 + F.col("l_partkey") % 300).cast("long").alias("end"))
    if transcripts is not None:  # before anything is shuffled
        rows = maybe_among(rows.withColumn("_t", o.cast("string")), ["_t"], transcripts.select("id")).drop("_t")
    rows = rows.groupBy("l_orderkey", "start").agg(F.max("end").alias("end"))  # blocks of a transcript don't overlap
    rows = rows.select(o.cast("string").alias("transcript_id"), (o % 24).cast("string").alias("chrom"), F.when(o % 2 == 0, "+").otherwise("-").alias("strand"), "start", "end")
    return rows if transcripts is None else rows.join(transcripts.select(F.col("id").alias("transcript_id")).distinct(), "transcript_id", "left_semi")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    base = lambda n: F.substring(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))
    ref = F.concat(base(e), F.when(e % 5 == 0, base(e + 1)).otherwise(F.lit("")), F.when(e % 97 == 0, F.lit("N")).otherwise(F.lit("")))
    alt = F.concat(base(e + 2), F.when(e % 7 == 0, F.concat(F.lit(","), base(e + 3), base(e))).otherwise(F.lit("")), F.when(e % 11 == 0, F.lit(",<DEL>")).otherwise(F.lit("")))
    status = F.element_at(F.array(*map(F.lit, ("PASS", ".", "AC0;RF", "PASS,RF", "q10"))), (e % 5 + 1).cast("int"))
    info = F.concat(F.lit("DB;AF="), F.when(e % 13 == 0, F.lit("0.1,0.2")).otherwise((e % 100 / 100).cast("double").cast("string")), F.lit(";CSQ=A|"), "event_type", F.lit("|"), (F.col("user_id") % 50).cast("string"), F.lit("|protein_coding,A|other|"), (F.col("user_id") % 7).cast("string"), F.lit("|"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 24).cast("string").alias("chrom"), (e * 7919 % 10_000_000).cast("long").alias("pos"), e.cast("string").alias("id"), ref.alias("ref"), alt.alias("alt"), status.alias("filter"), info.alias("info"), e.alias("ord"))


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("event_id"), pick(CLNSIG, e).alias("clnsig"), pick(MC, e / 7).alias("mc"), pick(GENEINFO, e / 3).alias("geneinfo"))


CLNSIG = ("Benign", "", "Pathogenic", "Benign/Likely_benign", "Benign,_risk_factor", "/,", "Likely_benign/Pathogenic", "benign,Likely_benign")
MC = ("", "SO:0001583|missense_variant", "SO:0001819|synonymous_variant", "SO:0001819|synonymous_variant,SO:0001587|nonsense", "intron_variant")
GENEINFO = ("BRCA1:672", "A:1|B:2", "", "NOID")
EXCLUDED, INCLUDED = ["Benign", "Likely_benign", "Benign/Likely_benign"], ["missense_variant", "nonsense"]


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Somatic mutations: a gene is a document, changes come from the order's numbers."""
    o = F.col("o_orderkey")
    n = (o % 90 + 1).cast("string")
    m = (o % 90 + 3).cast("string")
    base = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))
    forms = [F.concat(F.lit("c."), n, base(o), F.lit(">"), base(o + 1)), F.concat(F.lit("c."), n, F.lit("_"), m, F.lit("delinsGAT")), F.concat(F.lit("c."), n, F.lit("_"), m, F.lit("insACG")), F.concat(F.lit("c."), n, F.lit("_"), m, F.lit("del")), F.concat(F.lit("c."), n, F.lit("del")), F.lit("c.?"), F.lit("c.?")]
    aa = [F.concat(F.lit("p.V"), n, F.lit("E")), F.concat(F.lit("p.Val"), n, F.lit("Glu")), F.concat(F.lit("p.K"), n, F.lit("*")), F.concat(F.lit("p.A"), n, F.lit("_G"), m, F.lit("insKR")), F.concat(F.lit("p.A"), n, F.lit("_G"), m, F.lit("del")), F.concat(F.lit("p.A"), n, F.lit("_G"), m, F.lit(">WW"))]
    kinds = ["Substitution - Missense", "Substitution - Missense", "Substitution - Nonsense", "Insertion - In frame", "Deletion - In frame", "Complex - deletion inframe"]
    pick = lambda xs, k: F.element_at(F.array(*xs), (k % len(xs) + 1).cast("int"))
    k = F.floor(o / 7)
    return table(spark, sf_dir, "orders").select((F.col("o_custkey")).cast("string").alias("gene"), pick(forms, o).alias("dna_mut"), pick(aa, k).alias("aa_mut"), pick([F.lit(x) for x in kinds], k).alias("mutation_type"), F.col("o_orderpriority").alias("group"), o.alias("ord"))


def maf(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    n, m = (o % 90 + 1).cast("string"), (o % 90 + 2).cast("string")
    base = lambda x: F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1))
    forms = [F.concat(F.lit("T:c."), n, base(o), F.lit(">"), base(o + 1)), F.concat(F.lit("T:c."), n, F.lit("del"), base(o)), F.concat(F.lit("c."), n, F.lit("_"), m, F.lit("insGG")), F.concat(F.lit("c."), n, F.lit("_"), m, F.lit("dupAC"))]
    pick = lambda xs, k: F.element_at(F.array(*xs), (k % len(xs) + 1).cast("int"))
    classes = ["Missense_Mutation", "Frame_Shift_Del", "In_Frame_Ins", "Frame_Shift_Ins", "Silent"]
    kinds = ["SNP", "DEL", "INS", "INS"]
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("G"), F.col("o_custkey").cast("string")).alias("gene"), pick(forms, o).alias("hgvsc"), F.col("o_custkey").cast("string").alias("transcript_id"), pick([F.lit(x) for x in classes], F.floor(o / 4)).alias("varclass"), pick([F.lit(x) for x in kinds], o).alias("vartype"), F.concat(F.lit("p.X"), n).alias("hgvsp"), F.col("o_custkey").cast("string").alias("sample"), o.alias("ord"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample"), F.col("c_mktsegment").alias("group"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = F.transform("embedding", lambda x, i: F.struct((F.lit(100.0) + i * 13.5).alias("mz"), F.abs(F.floor(x.cast("double") * 1_000_000)).cast("double").alias("intensity")))
    return table(spark, sf_dir, "embeddings").select(F.lit("f").alias("file"), F.col("vec_id").cast("int").alias("scan"), peaks.alias("peaks"))


def digested_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tryptic peptides of 7 to 40 residues of all proteins."""
    from ribospark.functions.sequences import cleave

    return protein(spark, sf_dir).select(F.explode(cleave(F.col("seq"), "Trypsin", 0, 7, 40)).alias("sequence")).distinct()


def searched_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All digested peptides, and each of them with its middle residue changed."""
    p = digested_peptides(spark, sf_dir)
    changed = F.expr(f"concat(substring(sequence, 1, length(sequence) div 2 - 1), translate(substring(sequence, length(sequence) div 2, 1), '{FROM}', '{TO}'), substring(sequence, length(sequence) div 2 + 1))")
    return p.select(F.explode(F.array("sequence", changed)).alias("sequence")).distinct()
