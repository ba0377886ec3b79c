"""Command line: one command for each service. Input files become DataFrames, results go to folders of part files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ribospark.config import load_config, resolve, section
from ribospark.functions.constants import ENZYMES
from ribospark.functions.variants import clinical_header, format_fields, option_list
from ribospark.operators import genome, intervals, peptides, proteins, somatic, spectra, translation, variant_proteins
from ribospark.sources import fetch_plan, flatfiles, mzml, offsets, sinks, tables


class Counters:
    """Row counts taken while the rows pass: no job of their own."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def of(self, df: DataFrame, name: str) -> DataFrame:
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("n"))

    def report(self) -> dict[str, int]:
        counts = {name: o.get["n"] for name, o in self.seen.items()}
        print("\n".join(f"{name}: {n}" for name, n in counts.items()), file=sys.stderr)
        return counts


def _transcripts(spark: SparkSession, path: str) -> DataFrame:
    records = flatfiles.read_fasta(spark, path)
    kv = translation.header_values(F.col("description"))
    return records.select(F.split_part(F.split_part("id", F.lit("|"), F.lit(1)), F.lit(" "), F.lit(1)).alias("id"), "seq", translation.coding_range(F.try_element_at(kv, F.lit("CDS"))).alias("cds"), "ord")


def _models(gtf: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Coding features of transcripts with a coding range, exons of the others."""
    coding = transcripts.filter("cds is not null").select(F.col("id").alias("_id"))
    rows = gtf.filter("type in ('CDS', 'exon', 'stop_codon') and transcript_id <> ''")
    kind = rows.join(coding, F.col("transcript_id") == F.col("_id"), "left").withColumn("_coding", F.col("_id").isNotNull())
    return intervals.transcript_models(kind.filter("(_coding and type <> 'exon') or (not _coding and type = 'exon')"))


def vcf_to_proteindb(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    from ribospark.functions.variants import passes_choice

    seen = Counters()
    header, records = flatfiles.read_vcf(spark, a.vcf)
    gtf = flatfiles.read_gtf(spark, a.gene_annotations_gtf)
    transcripts = _transcripts(spark, a.input_fasta)
    key = a.annotation_field_name
    if key:
        fields = format_fields(header, key)
    else:
        records, key, fields = flatfiles.annotate_overlaps(records, gtf), "transcriptOverlaps", [a.transcript_str.upper()]
        sinks.write_vcf(records, f"{a.output}_annotated.vcf", [*header, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"])
    rows = variant_proteins.filter_variants(seen.of(records, "variants read"), option_list(a.accepted_filters), a.ignore_filters, a.af_field, a.af_threshold)
    rows = variant_proteins.explode_annotations(seen.of(rows, "alleles kept by the filters"), key, fields, a.transcript_str, a.consequence_str, a.biotype_str)
    for name, include, exclude in (("consequence", a.include_consequences, a.exclude_consequences), ("biotype", a.include_biotypes, a.exclude_biotypes)):
        if name in rows.columns:
            rows = rows.filter(passes_choice(F.col(name), option_list(include), option_list(exclude)))
    found = intervals.resolve_versions(seen.of(rows, "annotations kept"), transcripts, "transcript_id", "id", "ord").withColumn("transcript_id", F.col("resolved_id")).filter("transcript_id is not null")
    out = variant_proteins.variant_proteins(seen.of(found, "annotations with a transcript"), transcripts, _models(gtf, transcripts), a.protein_prefix, a.translation_table, report_reference=a.report_ref_seq)
    sinks.write_fasta(seen.of(out, "proteins written"), a.output, "accession")
    return seen.report()


def clinvar_to_proteindb(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    seen = Counters()
    _, records = flatfiles.read_vcf(spark, a.vcf)
    kept = variant_proteins.clinical_filter(seen.of(records, "variants read"), option_list(a.clinical_significance_exclude), option_list(a.include_consequences))
    kept = variant_proteins.map_chromosomes(seen.of(kept, "variants kept by the filters"), tables.read_assembly_report(spark, a.assembly_report), "chrom", "refseq")
    gtf = flatfiles.read_gtf(spark, a.gtf)
    transcripts = _transcripts(spark, a.fasta)
    blocks = flatfiles.coding_blocks(gtf).select("transcript_id", F.col("chrom").alias("f_chrom"), F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    spans = kept.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + F.length("ref") - 1)
    met = intervals.interval_join(spans, blocks, chrom="f_chrom", start="f_start", end="f_end").dropDuplicates(["chrom", "pos", "ref", "alt", "transcript_id"])
    biotypes = flatfiles.transcript_biotypes(gtf).withColumnRenamed("transcript_id", "_bt")
    wanted = option_list(a.include_biotypes)
    met = seen.of(met, "overlaps with transcripts")
    if wanted != ["all"]:
        met = met.join(biotypes, F.col("transcript_id") == F.col("_bt"), "left").filter(F.coalesce(F.col("biotype") == "", F.lit(True)) | F.col("biotype").isin(*wanted))
    out = variant_proteins.variant_proteins(seen.of(met, "overlaps kept by biotype"), transcripts, _models(gtf, transcripts), a.protein_prefix, a.translation_table, orf_frames=a.num_orfs, report_reference=a.report_ref_seq, header=clinical_header)
    sinks.write_fasta(seen.of(out, "proteins written"), a.output, "accession")
    return seen.report()


def cosmic_to_proteindb(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    seen = Counters()
    made = somatic.census_proteins(tables.read_census(spark, a.input_mutation, a.filter_column), flatfiles.read_fasta(spark, a.input_genes), option_list(a.accepted_values), seen.of)
    sinks.write_fasta(seen.of(somatic.first_by_header(made), "proteins written"), a.output_db, "header")
    if a.split_by_filter_column:
        sinks.write_grouped_fasta(somatic.last_by_group(made), a.output_db)
    return seen.report()


def cbioportal_to_proteindb(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    accepted = option_list(a.accepted_values)
    grouped = accepted != ["all"] or a.split_by_filter_column
    if grouped and not a.clinical_sample_file:
        raise SystemExit("a filter needs a clinical sample file")
    samples = tables.read_samples(spark, a.clinical_sample_file, a.filter_column) if grouped else None
    seen = Counters()
    made = somatic.mutation_table_proteins(tables.read_maf(spark, a.input_mutation), flatfiles.read_fasta(spark, a.input_cds), samples, accepted, seen=seen.of)
    sinks.write_fasta(seen.of(made, "proteins written"), a.output_db, "header")
    if a.split_by_filter_column:
        sinks.write_grouped_fasta(somatic.last_by_group(made), a.output_db)
    return seen.report()


def dnaseq_to_proteindb(spark: SparkSession, a: argparse.Namespace) -> None:
    out = translation.dna_orfs(flatfiles.read_fasta(spark, a.input_fasta), a.num_orfs, a.num_orfs_complement, a.translation_table, a.biotype_str, option_list(a.include_biotypes), option_list(a.exclude_biotypes), a.expression_str, a.expression_thresh, a.skip_including_all_cds, a.alternative)
    sinks.write_fasta(out.withColumn("id", F.concat_ws("_", "id", (F.col("frame") + 1).cast("string"))), a.output)


def threeframe_translation(spark: SparkSession, a: argparse.Namespace) -> None:
    out = translation.three_frames(flatfiles.read_fasta(spark, a.input_fasta), a.translation_table)
    sinks.write_fasta(out.withColumn("id", F.concat("id", F.lit("_RF"), F.col("frame").cast("string"))), a.output)


def ensembl_check(spark: SparkSession, a: argparse.Namespace) -> None:
    out = proteins.check_proteins(flatfiles.read_fasta(spark, a.input_fasta), a.add_stop_codon, a.num_aa)
    sinks.write_fasta(out, a.output, description="description", sep="\t")


def generate_decoy(spark: SparkSession, a: argparse.Namespace) -> None:
    records = flatfiles.read_fasta(spark, a.input_database)
    if a.method in ("protein-reverse", "protein-shuffle"):
        out = proteins.whole_decoys(records, a.method.removeprefix("protein-"), a.decoy_prefix)
    else:
        missed = a.max_missed_cleavages if a.method == "pgdbdeep" else 0
        if not a.do_not_shuffle:
            swaps = proteins.decoy_swaps(records, a.enzyme, a.min_peptide_length, a.max_iterations, missed)
            sinks.write_lines(swaps.filter("other is null"), f"{a.output_database}_noAlternative.fa", "peptide")
        out = proteins.switched_decoys(records, a.enzyme, a.decoy_prefix, a.min_peptide_length, a.max_iterations, missed, not a.do_not_shuffle, keep_target_hits=a.keep_target_hits or a.method == "decoypyrat")
    sinks.write_fasta(out, a.output_database)
    counts = proteins.decoy_composition(flatfiles.read_fasta(spark, a.output_database), a.decoy_prefix, a.enzyme, a.max_missed_cleavages, a.min_peptide_length)
    print("\n".join(proteins.composition_report(counts.first().asDict())), file=sys.stderr)


def digest_mutant_protein(spark: SparkSession, a: argparse.Namespace) -> None:
    mutants = flatfiles.read_fasta(spark, option_list(a.input))
    out = proteins.unique_variant_peptides(mutants, flatfiles.read_fasta(spark, a.fasta), a.prefix, a.missed_cleavages, a.min_length, a.max_length)
    sinks.write_fasta(out, a.output, "header", "peptide")


def map_peptide2genome(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    seen = Counters()
    mapped = genome.map_peptides(tables.read_peptides(spark, option_list(a.input), a.pep_col, a.prot_col), tables.read_id_map(spark, a.idmap), flatfiles.read_fasta(spark, a.fasta), flatfiles.coding_blocks(flatfiles.read_gtf(spark, a.gtf)), seen.of)
    sinks.write_gff3(genome.gff3_rows(seen.of(mapped, "peptides on the genome")), a.output)
    return seen.report()


def blast_get_position(spark: SparkSession, a: argparse.Namespace) -> None:
    found = peptides.locate_peptides(tables.read_psms(spark, a.input_psm_to_blast), flatfiles.read_fasta(spark, a.input_reference_database))
    sinks.write_psms(found.orderBy("usi"), a.output_psm)


def spectrumai(spark: SparkSession, a: argparse.Namespace) -> None:
    psms = tables.read_psms(spark, a.infile_name)
    file, scan = (F.col("SpecFile"), F.col("ScanNum")) if a.mztab else (F.concat("reference_file_name", F.lit(".mzML")), F.col("scan_number"))
    psms = psms.withColumn("file", file).withColumn("scan", scan.cast("int"))
    found = mzml.read_mzml(spark, option_list(a.mzml_files)) if a.mzml_files else offsets.fetch_spectra(psms, a.mzml_path)
    sinks.write_psms(spectra.inspect_spectra(psms, found, a.ions_tolerance, a.relative), a.outfile_name)


def downloads(spark: SparkSession | None, a: argparse.Namespace) -> None:
    if a.command == "ensembl-downloader" and a.list_species:
        print("\n".join(fetch_plan.species_names(a.species_server)))
        return
    if a.command == "cbioportal-downloader" and a.list_studies:
        print("\n".join(fetch_plan.study_names(a.study_list)))
        return
    plans = {
        "ensembl-downloader": lambda: fetch_plan.genome_files(a.name, a.assembly, a.release, tuple(k for k in ("protein", "gtf", "cds", "cdna", "ncrna", "dna", "vcf") if not getattr(a, f"skip_{k}")), grch37=a.grch37, server=a.ensembl_base_url),
        "ncbi-downloader": lambda: fetch_plan.clinical_files(a.ncbi_refseq_ftp, a.clinvar_ftp),
        "cosmic-downloader": lambda: fetch_plan.census_files(a.cosmic_ftp),
        "cbioportal-downloader": lambda: fetch_plan.study_files(option_list(a.studies), a.cbioportal_download_url, a.study_list),
    }
    files = plans[a.command]()
    lines = fetch_plan.url_lines(files, a.output)
    if not a.fetch:
        print("\n".join(lines))
        return
    named = (lambda url: fetch_plan.census_url(url, a.cosmic_user, a.cosmic_password)) if a.command == "cosmic-downloader" else None
    for url, path in fetch_plan.fetch_all(files, a.output, a.force, named, fetch_plan.by_chromosome):
        print(f"{url}\t{path or 'failed'}")


# What commands take and leave out unless told otherwise.
NOT_CLINICAL = "Benign,Likely_benign,Benign/Likely_benign"
CLINICAL_CONSEQUENCES = "missense_variant,nonsense,frameshift_variant,inframe_insertion,inframe_deletion,stop_gained,stop_lost,start_lost"
NOT_CODING = "downstream_gene_variant, upstream_gene_variant, intergenic_variant, intron_variant, synonymous_variant"
#: The section of a configuration file that a command reads.
SECTIONS = {"vcf-to-proteindb": "ensembl_translation", "dnaseq-to-proteindb": "ensembl_translation", "threeframe-translation": "ensembl_translation", "ensembl-check": "ensembl_translation", "clinvar-to-proteindb": "clinvar_translation", "ncbi-downloader": "clinvar_translation", "cosmic-to-proteindb": "proteindb", "cbioportal-to-proteindb": "proteindb", "generate-decoy": "proteindb_decoy", "ensembl-downloader": "ensembl_data_downloader", "cosmic-downloader": "cosmic_data", "cbioportal-downloader": "cbioportal_data_downloader"}
DEFAULTS: dict[str, dict] = {}
# Other names of options, by command. Underscores may be written as hyphens everywhere.
OTHER_NAMES = {
    "vcf-to-proteindb": {"input_fasta": "-f", "vcf": "-v", "gene_annotations_gtf": "-g", "translation_table": "-t", "protein_prefix": "-p", "output": "-o --output_proteindb"},
    "clinvar-to-proteindb": {"vcf": "-v", "gtf": "-g", "fasta": "-f", "assembly_report": "-a", "output": "-o"},
    "cosmic-to-proteindb": {"input_mutation": "-in", "input_genes": "-fa", "output_db": "-out", "filter_column": "-f", "accepted_values": "-a", "split_by_filter_column": "-s"},
    "cbioportal-to-proteindb": {"input_mutation": "-in", "input_cds": "-fa", "output_db": "-out", "filter_column": "-f", "accepted_values": "-a", "split_by_filter_column": "-s", "clinical_sample_file": "-cl"},
    "dnaseq-to-proteindb": {"output": "--output_proteindb"},
    "threeframe-translation": {"input_fasta": "-in", "translation_table": "-t", "output": "-out"},
    "ensembl-check": {"input_fasta": "-in", "output": "-out", "add_stop_codon": "-adds --add_stop_codons", "num_aa": "-aa"},
    "generate-decoy": {"input_database": "-in", "output_database": "-out", "method": "-m", "decoy_prefix": "-d", "enzyme": "-e", "max_missed_cleavages": "-s"},
    "digest-mutant-protein": {"input": "-i", "fasta": "-f", "output": "-o", "min_length": "--min-len", "max_length": "--max-len"},
    "map-peptide2genome": {"input": "-i", "gtf": "-g", "fasta": "-f", "idmap": "-m", "output": "-o"},
    "blast_get_position": {"input_psm_to_blast": "-i", "output_psm": "-o", "input_reference_database": "-r"},
    "spectrumai": {"mzml_path": "-p", "mzml_files": "-f", "infile_name": "-i", "outfile_name": "-o", "ions_tolerance": "-ion", "relative": "-r", "mztab": "-m"},
    "ensembl-downloader": {"output": "-o --output_directory", "name": "-en --ensembl_name", "skip_gtf": "-sg", "skip_protein": "-sp", "skip_cds": "-sc", "skip_cdna": "-sdn", "skip_ncrna": "-sn", "skip_dna": "-sd", "skip_vcf": "-sv"},
    "ncbi-downloader": {"output": "-o --output-dir"},
    "cosmic-downloader": {"output": "-o --output_directory", "cosmic_user": "-u --username", "cosmic_password": "-p --password"},
    "cbioportal-downloader": {"output": "-o --output_directory", "list_studies": "-l", "studies": "-d --download_study"},
}
# Options that are taken and mean nothing here, as Spark deals the work: with a value, and without one.
WITHOUT_MEANING = {"blast_get_position": "-n --number_of_processes", "spectrumai": "-n --number_of_processes", "cbioportal-downloader": "-th --multithreading", "generate-decoy": "--temp_file"}
FLAGS_WITHOUT_MEANING = {"generate-decoy": "--memory_save"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ribospark")
    commands = top.add_subparsers(dest="command", required=True)

    def command(title: str, run, required: str = "", /, **options) -> None:
        p = commands.add_parser(title)
        p.add_argument("-c", "--config", "--config_file", default=None, help="a YAML or JSON file; what is given on the command line comes before it")

        def names(option: str) -> list[str]:
            return list(dict.fromkeys([f"--{option}", f"--{option.replace('_', '-')}", *OTHER_NAMES.get(title, {}).get(option, "").split()]))

        for option in required.split():
            p.add_argument(*names(option), dest=option, required=True)
        for option, default in options.items():
            if isinstance(default, bool):
                p.add_argument(*names(option), dest=option, action="store_true", default=None)
            else:
                p.add_argument(*names(option), dest=option, default=None, type=type(default))
        for told, flag in ((WITHOUT_MEANING, {}), (FLAGS_WITHOUT_MEANING, {"action": "store_true"})):
            if title in told:
                p.add_argument(*told[title].split(), dest="_" + told[title].rpartition("--")[2], help="taken, without effect", **flag)
        DEFAULTS[title] = options
        p.set_defaults(run=run)

    biotypes = {"include_biotypes": "all", "exclude_biotypes": ""}
    command("vcf-to-proteindb", vcf_to_proteindb, "input_fasta vcf gene_annotations_gtf output", translation_table=1, protein_prefix="var", report_ref_seq=False, annotation_field_name="CSQ", af_field="", af_threshold=0.01, transcript_str="FEATURE", biotype_str="BIOTYPE", consequence_str="CONSEQUENCE", include_consequences="all", exclude_consequences=NOT_CODING, ignore_filters=False, accepted_filters="PASS", **biotypes)
    command("clinvar-to-proteindb", clinvar_to_proteindb, "vcf gtf fasta assembly_report output", clinical_significance_exclude=NOT_CLINICAL, include_consequences=CLINICAL_CONSEQUENCES, protein_prefix="clinvar_", translation_table=1, num_orfs=1, report_ref_seq=False, include_biotypes="protein_coding")
    groups = {"filter_column": "Primary site", "accepted_values": "all", "split_by_filter_column": False}
    command("cosmic-to-proteindb", cosmic_to_proteindb, "input_mutation input_genes output_db", **groups)
    command("cbioportal-to-proteindb", cbioportal_to_proteindb, "input_mutation input_cds output_db", clinical_sample_file="", **(groups | {"filter_column": "CANCER_TYPE"}))
    command("dnaseq-to-proteindb", dnaseq_to_proteindb, "input_fasta output", translation_table=1, num_orfs=3, num_orfs_complement=0, biotype_str="", expression_str="", expression_thresh=5.0, skip_including_all_cds=False, alternative=False, **biotypes)
    command("threeframe-translation", threeframe_translation, "input_fasta output", translation_table=1)
    command("ensembl-check", ensembl_check, "input_fasta output", add_stop_codon=False, num_aa=6)
    command("generate-decoy", generate_decoy, "input_database output_database", method="protein-reverse", enzyme="Trypsin", decoy_prefix="DECOY_", min_peptide_length=5, max_missed_cleavages=2, max_iterations=100, do_not_shuffle=False, keep_target_hits=False)
    command("digest-mutant-protein", digest_mutant_protein, "input fasta output", prefix="Mutation", min_length=7, max_length=40, missed_cleavages=0)
    command("map-peptide2genome", map_peptide2genome, "input gtf fasta idmap output", pep_col=0, prot_col=1)
    command("blast_get_position", blast_get_position, "input_psm_to_blast output_psm input_reference_database")
    command("spectrumai", spectrumai, "infile_name outfile_name", mzml_path="", mzml_files="", ions_tolerance=0.02, relative=False, mztab=False)
    fetching = {"output": ".", "fetch": False, "force": False}
    skips = {f"skip_{k}": False for k in ("protein", "gtf", "cds", "cdna", "ncrna", "dna", "vcf")}
    command("ensembl-downloader", downloads, name="homo_sapiens", assembly="GRCh38", release="110", grch37=False, ensembl_base_url=fetch_plan.GENOME_SERVER, list_species=False, species_server=fetch_plan.SPECIES_LIST, **skips, **fetching)
    command("ncbi-downloader", downloads, ncbi_refseq_ftp=fetch_plan.REFSEQ_SERVER, clinvar_ftp=fetch_plan.CLINICAL_SERVER, **fetching)
    command("cosmic-downloader", downloads, cosmic_ftp=fetch_plan.CENSUS_SERVER, cosmic_user="", cosmic_password="", **fetching)
    command("cbioportal-downloader", downloads, studies="all", cbioportal_download_url=fetch_plan.STUDY_SERVER, list_studies=False, study_list=fetch_plan.STUDY_LIST, **fetching)
    return top


def options_of(args: list[str] | None = None) -> argparse.Namespace:
    """What was given, over the configuration file, over the defaults."""
    a = parser().parse_args(args)
    defaults = DEFAULTS[a.command]
    configured = section(load_config(a.config), SECTIONS.get(a.command, a.command))
    configured = {k: ",".join(map(str, v)) if isinstance(v, list) else v for k, v in configured.items()}
    vars(a).update(resolve({k: v for k, v in vars(a).items() if k in defaults}, configured, defaults))
    return a


def main(args: list[str] | None = None) -> dict[str, int] | None:
    a = options_of(args)
    if hasattr(a, "enzyme") and a.enzyme not in ENZYMES:
        raise SystemExit(f"unknown enzyme {a.enzyme}; known: {', '.join(ENZYMES)}")
    return a.run(None if a.command.endswith("-downloader") else SparkSession.builder.appName(f"ribospark {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
