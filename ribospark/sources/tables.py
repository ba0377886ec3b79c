"""Readers of mutation, sample, assembly, peptide and PSM tables. All cells are text unless said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.sources.flatfiles import in_file_order

#: Columns of the mutation tables.
CENSUS_COLUMNS = {"gene": "Gene name", "mrna": "Accession Number", "dna_mut": "Mutation CDS", "aa_mut": "Mutation AA", "mutation_type": "Mutation Description"}
MAF_COLUMNS = {"hgvsc": "HGVSc", "transcript_id": "Transcript_ID", "varclass": "Variant_Classification", "vartype": "Variant_Type", "hgvsp": "HGVSp_Short", "sample": "Tumor_Sample_Barcode"}


def _placed(lines: DataFrame) -> DataFrame:
    """value, and where in which file a line stands."""
    return lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _by_header(lines: DataFrame, needed: list[str], pick) -> DataFrame:
    """Rows of tab-separated lines under a header line that holds the needed columns; ragged rows go.

    ``lines`` come from ``_placed``. Where header lines differ (tables put one behind another),
    each binds the columns anew for the lines behind it in its file; a line without a header
    before it goes by the file's first one, a file without a header by the first of all.
    """
    numbered = lines.withColumn("ord", F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"), F.monotonically_increasing_id().alias("row")))
    parts = F.split("value", "\t")
    is_header = F.size(F.array_intersect(F.transform(parts, lambda x: F.trim(x)), F.array(*map(F.lit, needed)))) == len(set(needed))
    headers = sorted(tuple(r) for r in numbered.filter(is_header).select("_file", "_block", "ord.row", "value").collect())  # one for each table
    if not headers:
        raise ValueError(f"missing required columns: expected {needed}")
    layouts: list[dict[str, int]] = []
    by_file: dict[str, list[tuple[int, int, int]]] = {}
    for file, block, ord_, line in headers:
        layout = pick([x.strip() for x in line.split("\t")])
        if layout not in layouts:
            layouts.append(layout)
        by_file.setdefault(file, []).append((block, ord_, layouts.index(layout)))
    body = numbered.filter(~is_header)
    table = F.lit(0)
    if len(layouts) > 1:
        told = lines.sparkSession.createDataFrame(list(by_file.items()), "_in string, _heads array<struct<block: long, ord: long, layout: int>>")
        body = body.join(F.broadcast(told), F.col("_file") == F.col("_in"), "left")
        before = F.filter("_heads", lambda h: (h["block"] < F.col("_block")) | ((h["block"] == F.col("_block")) & (h["ord"] < F.col("ord.row"))))
        table = F.coalesce(F.get(before, F.size(before) - 1)["layout"], F.get("_heads", 0)["layout"], F.lit(0))
    body = body.withColumn("_table", table)
    place = lambda name: F.get(F.array(*(F.lit(x[name]) for x in layouts)), F.col("_table"))
    last = F.get(F.array(*(F.lit(max(x.values())) for x in layouts)), F.col("_table"))
    return body.filter(F.size(parts) > last).select(*(F.get(parts, place(n)).alias(n) for n in layouts[0]), "ord")


def read_census(spark: SparkSession, path: str, filter_column: str = "") -> DataFrame:
    """gene, mrna, dna_mut, aa_mut, mutation_type, group, ord of a census export (latin-1)."""
    lines = _placed(spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").csv(path, schema="value string"))

    def pick(names: list[str]) -> dict[str, int]:
        found = {k: names.index(v) for k, v in CENSUS_COLUMNS.items()}
        return found | ({"group": names.index(filter_column)} if filter_column in names else {})

    out = _by_header(lines, list(CENSUS_COLUMNS.values()), pick)
    return out if "group" in out.columns else out.withColumn("group", F.lit(None).cast("string"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """gene (first column), the named mutation-table columns and ord; comment lines and the header are skipped."""
    lines = _placed(spark.read.text(path)).filter(~F.startswith("value", F.lit("#")))
    return _by_header(lines, list(MAF_COLUMNS.values()), lambda names: {"gene": 0} | {k: names.index(v) for k, v in MAF_COLUMNS.items()})


def read_samples(spark: SparkSession, path: str, group_column: str) -> DataFrame:
    """sample and group (spaces as ``_``) of a clinical sample table."""
    lines = _placed(spark.read.text(path)).filter(~F.startswith("value", F.lit("#")))
    rows = _by_header(lines, ["SAMPLE_ID", group_column], lambda names: {"sample": names.index("SAMPLE_ID"), "group": names.index(group_column)})
    return rows.select("sample", F.replace("group", F.lit(" "), F.lit("_")).alias("group"))


def read_assembly_report(spark: SparkSession, path: str) -> DataFrame:
    """numeric, refseq and ucsc names of an assembly report; ``na`` is null."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.size(parts) >= 10))
    return rows.select(*(F.nullif(F.trim(F.element_at(parts, i)), F.lit("na")).alias(n) for n, i in (("numeric", 1), ("refseq", 7), ("ucsc", 10))))


def read_psms(spark: SparkSession, path: str) -> DataFrame:
    """A PSM table by suffix: .csv or .tsv, possibly .gz."""
    plain = path.removesuffix(".gz")
    if not plain.endswith((".csv", ".tsv")):
        raise ValueError(f"{path}: expected a .csv or .tsv file, possibly with .gz")
    return spark.read.csv(path, header=True, sep="," if plain.endswith(".csv") else "\t")


def read_peptides(spark: SparkSession, path: str | list[str], peptide_column: int = 0, protein_column: int = 1) -> DataFrame:
    """peptide (letters only), protein (before the first ``;``) and ord; columns count from 0, the first line of each file is a header."""
    parts = F.split("value", "\t")
    lines = spark.read.options(header=True, sep="\x01", quote="", escape="").schema("value string")
    cell = lambda i: F.get(parts, F.lit(i))
    body = in_file_order(lines.csv, path).filter("value is not null")
    return body.select(F.regexp_replace(F.trim(cell(peptide_column)), r"[\W\d]", "").alias("peptide"), F.split_part(cell(protein_column), F.lit(";"), F.lit(1)).alias("protein"), "ord")


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """gene, transcript, protein and ord of the lines with exactly three columns."""
    parts = F.split(F.trim("value"), "\t")
    rows = in_file_order(spark.read.text, path).filter(F.size(parts) == 3)
    return rows.select(*(F.element_at(parts, i + 1).alias(n) for i, n in enumerate(("gene", "transcript", "protein"))), "ord")
