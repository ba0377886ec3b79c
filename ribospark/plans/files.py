"""Round trips: bridge views are written as files to the shared folder and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.plans import bridges as B
from ribospark.plans import oracles as O
from ribospark.functions.sequences import cleave
from ribospark.functions.spectra import intensity_summary
from ribospark.operators import somatic
from ribospark.plans.runtime import cut, ensure_checkpoint_dir
from ribospark.sources import blockgzip, flatfiles, mzml, sinks, tables
from ribospark.sources import offsets as offsets_of


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _written(df: DataFrame, header: str | None = None, latin: bool = False) -> str:
    """The tab-separated cells of ``df`` as text files; a header line, if any, is a file that sorts first."""
    folder = _folder(df.sparkSession)
    if header is not None:
        df.sparkSession.range(1).select(F.lit(header).alias("value")).coalesce(1).write.text(f"{folder}/0")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    lines = df.select(F.concat_ws("\t", *cells).alias("value")).write
    if latin:  # the text writer knows UTF-8 alone
        lines.options(encoding="ISO-8859-1", sep="\x01", quote="").csv(f"{folder}/1")
    else:
        lines.text(f"{folder}/1")
    return f"{folder}/*"


def fasta_files(spark: SparkSession, d: str) -> DataFrame:
    """Records written as FASTA and scanned."""
    folder = _folder(spark)
    sinks.write_fasta(B.stopped_protein(spark, d), folder, description="description")
    return flatfiles.read_fasta(spark, folder).select("id", "description", "seq")


def fasta_index(spark: SparkSession, d: str) -> DataFrame:
    """Records of a FASTA file by key."""
    folder = _folder(spark)
    sinks.write_fasta(B.protein(spark, d), folder)
    found = flatfiles.index_fasta(flatfiles.read_fasta(spark, folder), F.concat(F.lit("k"), "id"))
    return found.select("key", "id", "seq")


def fasta_offset_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The proteins that orders name, fetched by their places from a FASTA folder."""
    folder = _folder(spark)
    sinks.write_fasta(B.protein(spark, d), folder)
    offsets = cut(offsets_of.fasta_offsets(spark, folder))
    asked = B.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"))
    return offsets_of.fetch_records(asked, offsets).select("id", "seq")


def spectra_by_scan(spark: SparkSession, d: str) -> DataFrame:
    """Spectra written as indexed mzML files, and those that orders name fetched by scan."""
    folder = _folder(spark)
    written = cut(mzml.write_indexed_mzml(B.spectra(spark, d), folder))
    named = B.table(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("scan")).distinct()
    found = offsets_of.fetch_spectra(written.join(named, "scan"), folder)
    s = intensity_summary(F.col("peaks"))
    return found.filter("scan is not null").select("scan", F.size("peaks").alias("n"), s["sum"].alias("sum"), s["median"].alias("median"))


def vcf_files(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_vcf(B.variants(spark, d).withColumn("qual", F.lit(None).cast("string")), folder, ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"])
    _, rows = flatfiles.read_vcf(spark, folder)
    return rows.select("chrom", "pos", "id", "ref", "alt", "qual", "filter")


def annotated_vcf(spark: SparkSession, d: str) -> DataFrame:
    """Variants with the transcripts that they overlap, written, and how many of the records read back say so."""
    dot = lambda: F.lit(".")
    gtf = B.blocks(spark, d).select("chrom", dot().alias("source"), F.lit("CDS").alias("type"), "start", "end", dot().alias("score"), "strand", dot().alias("frame"), F.concat(F.lit('transcript_id "'), "transcript_id", F.lit('";')).alias("attributes"))
    blocks = flatfiles.read_gtf(spark, _written(gtf))
    folder = _folder(spark)
    sinks.write_vcf(flatfiles.annotate_overlaps(B.variants(spark, d).withColumn("qual", dot()), blocks), folder)
    _, rows = flatfiles.read_vcf(spark, folder)
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.contains("info", F.lit(";transcriptOverlaps="))).alias("overlapping"))


def block_gzip_region(spark: SparkSession, d: str) -> DataFrame:
    """All variants written in order as one block-gzip file, indexed, and the records of a region read through the index."""
    v = B.variants(spark, d).withColumn("qual", F.lit("."))
    cells = [F.col(c).cast("string") for c in ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")]
    lines = v.orderBy("chrom", "pos", "ord").select(F.concat_ws("\t", *cells).alias("value"))
    path = blockgzip.write_block_gzip(lines, _folder(spark), "variants.vcf.gz")
    blockgzip.write_index(spark, path)
    _, rows = flatfiles.read_vcf(spark, path)
    return rows.filter(F.col("chrom").isin("3", "17") & F.col("pos").between(2_000_000, 7_500_000)).select("chrom", "pos", "id", "ref", "alt", "filter")


def block_gzip_runs(spark: SparkSession, d: str) -> DataFrame:
    """The same file without an index, all of it, in runs of 64 KiB."""
    v = B.variants(spark, d).withColumn("qual", F.lit("."))
    cells = [F.col(c).cast("string") for c in ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")]
    path = blockgzip.write_block_gzip(v.orderBy("ord").select(F.concat_ws("\t", *cells).alias("value")), _folder(spark), "variants.vcf.gz")
    return blockgzip.read_variants(spark, path, 1 << 16).select("chrom", "pos", "id", "ref", "alt", "qual", "filter")


def group_files(spark: SparkSession, d: str) -> DataFrame:
    """Mutated proteins written as one file for each sample group, and what the files hold."""
    made = somatic.last_by_group(somatic.mutation_table_proteins(B.maf(spark, d), B.dna(spark, d), B.samples(spark, d)))
    folder = _folder(spark)
    sinks.write_grouped_fasta(made, f"{folder}/out.fa")
    found = spark.read.option("lineSep", "\n>").text(folder)
    text = F.regexp_replace("value", "^>|\n$", "")
    return found.select(F.regexp_extract("_metadata.file_path", "out_(.*)[.]fa$", 1).alias("group"), F.split_part(text, F.lit("\n"), F.lit(1)).alias("header"), F.split_part(text, F.lit("\n"), F.lit(2)).alias("seq"))


def gtf_files(spark: SparkSession, d: str) -> DataFrame:
    """Coding blocks written as GTF and scanned."""
    def attribute(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'{name} "'), value, F.lit('"; '))

    b = B.blocks(spark, d)
    rows = b.select("chrom", F.lit("s").alias("source"), F.lit("CDS").alias("type"), "start", "end", F.lit(".").alias("score"), "strand", F.lit("0").alias("frame"), F.concat(attribute("gene_id", F.concat(F.lit("g"), "transcript_id")), attribute("transcript_id", F.col("transcript_id"))).alias("attributes"))
    gtf = flatfiles.read_gtf(spark, _written(rows, "#!genome-build x"))
    return gtf.select("gene_id", "transcript_id", "chrom", "strand", "start", "end")


def census_files(spark: SparkSession, d: str) -> DataFrame:
    """Mutations written as a latin-1 census table and scanned."""
    m = B.mutations(spark, d)
    rows = m.select(F.concat(F.lit("é"), "gene").alias("gene"), F.lit("E").alias("mrna"), "dna_mut", "aa_mut", "mutation_type", "group")
    names = [*tables.CENSUS_COLUMNS.values(), "Primary site"]
    found = tables.read_census(spark, _written(rows, "\t".join(names), latin=True), "Primary site")
    return found.select("gene", "dna_mut", "aa_mut", "mutation_type", "group")


def maf_files(spark: SparkSession, d: str) -> DataFrame:
    """The mutation table written in two halves, each under a header of its own with the columns in another order, and scanned."""
    rows, names = B.maf(spark, d), {"gene": "Hugo_Symbol"} | tables.MAF_COLUMNS
    folder = _folder(spark)
    for half, columns in enumerate((list(names), ["gene", *list(names)[:0:-1]])):
        part = rows.filter(F.col("ord") % 2 == half).select(*(F.col(c).alias(names[c]) for c in columns))
        part.write.options(header=True, sep="\t", quote="").csv(f"{folder}/{half}")
    return tables.read_maf(spark, f"{folder}/*").drop("ord")


def peptide_files(spark: SparkSession, d: str) -> DataFrame:
    """Digested peptides with their proteins as files that each have a header, scanned."""
    p = B.protein(spark, d).select(F.explode(cleave(F.col("seq"), "Trypsin", 0, 7, 40)).alias("peptide"), "id")
    rows = p.select(F.concat(F.lit("-."), "peptide", F.lit("+16.")).alias("pep"), F.concat("id", F.lit(";other")).alias("prot"))
    folder = _folder(spark)
    rows.write.options(header=True, sep="\t", quote="").csv(folder)
    return tables.read_peptides(spark, folder).select("peptide", "protein")


def sample_files(spark: SparkSession, d: str) -> DataFrame:
    rows = B.samples(spark, d).select(F.lit("p").alias("p"), "sample", F.concat(F.lit("A "), "group").alias("group"))
    return tables.read_samples(spark, _written(rows, "PATIENT_ID\tSAMPLE_ID\tCANCER_TYPE"), "CANCER_TYPE").select("sample", "group")


def assembly_files(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    rows = B.table(spark, d, "nation").select(n.alias("a"), *(F.lit(".").alias(f"x{i}") for i in range(5)), F.concat(F.lit("NC_"), n).alias("b"), F.lit(".").alias("y"), F.lit(".").alias("z"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("na")).otherwise(F.concat(F.lit("chr"), n)).alias("c"))
    return tables.read_assembly_report(spark, _written(rows, "# report"))


def id_map_files(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("t"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("p"))
    return tables.read_id_map(spark, _written(rows)).select("gene", "transcript", "protein")


def psm_files(spark: SparkSession, d: str) -> DataFrame:
    """Peptides written as a PSM table and scanned; text stays as it is."""
    folder = f"{_folder(spark)}.tsv"
    sinks.write_psms(B.searched_peptides(spark, d).select("sequence", F.concat(F.lit("00"), F.length("sequence").cast("string")).alias("scan_number")), folder)
    return tables.read_psms(spark, folder).select("sequence", "scan_number")


def queries() -> dict:
    own = (fasta_files, fasta_index, vcf_files, annotated_vcf, fasta_offset_lookup, spectra_by_scan, block_gzip_region, block_gzip_runs, group_files, gtf_files, census_files, maf_files, peptide_files, sample_files, assembly_files, id_map_files, psm_files)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "fasta_files": f"SELECT id, id || ' ' || description AS description, seq FROM {O.STOPPED}",
        "fasta_index": f"SELECT 'k' || id AS key, id, seq FROM {O.PROTEIN}",
        "vcf_files": f"SELECT chrom, pos, id, ref, alt, '.' AS qual, filter FROM {O.VARIANTS}",
        "annotated_vcf": f"""SELECT count(*) AS records, count(*) FILTER (ord IN (SELECT ord FROM {O.VARIANTS} v JOIN {O.BLOCKS} b ON v.chrom = b.chrom AND v.pos <= b."end" AND v.pos + length(ref) - 1 >= b.start)) AS overlapping FROM {O.VARIANTS}""",
        "fasta_offset_lookup": f"SELECT id, seq FROM {O.PROTEIN} WHERE id IN (SELECT cast(o_custkey AS varchar) FROM orders)",
        "spectra_by_scan": f"SELECT scan, count(*)::int AS n, sum(intensity) AS sum, median(intensity) AS median FROM {O.PEAKS} WHERE scan IN (SELECT o_orderkey FROM orders) GROUP BY scan",
        "block_gzip_region": f"SELECT chrom, pos, id, ref, alt, filter FROM {O.VARIANTS} WHERE chrom IN ('3', '17') AND pos BETWEEN 2000000 AND 7500000",
        "block_gzip_runs": f"SELECT chrom, pos, id, ref, alt, '.' AS qual, filter FROM {O.VARIANTS}",
        "group_files": f"""SELECT "group", header, arg_max(seq, ord) AS seq FROM {O.MAF} WHERE length(seq) > 6 GROUP BY ALL""",
        "gtf_files": f'SELECT \'g\' || transcript_id AS gene_id, transcript_id, chrom, strand, start, "end" FROM {O.BLOCKS}',
        "census_files": f'SELECT \'é\' || gene AS gene, dna_mut, aa_mut, mutation_type, "group" FROM {O.mutations_sql()}',
        "maf_files": O.maf_sql(),
        "peptide_files": f"SELECT DISTINCT p AS peptide, id AS protein FROM (SELECT id, unnest({O.pieces('seq')}) AS p FROM {O.PROTEIN}) WHERE length(p) BETWEEN 7 AND 40",
        "sample_files": "SELECT cast(c_custkey AS varchar) AS sample, 'A_' || c_mktsegment AS \"group\" FROM customer",
        "assembly_files": "SELECT cast(n_nationkey AS varchar) AS \"numeric\", 'NC_' || n_nationkey AS refseq, CASE WHEN n_nationkey % 2 = 1 THEN 'chr' || n_nationkey END AS ucsc FROM nation",
        "id_map_files": "SELECT cast(c_nationkey AS varchar) AS gene, cast(c_custkey AS varchar) AS transcript, 'p' || c_custkey AS protein FROM customer",
        "psm_files": f"SELECT sequence, '00' || length(sequence) AS scan_number FROM {O.SEARCHED}",
    }
