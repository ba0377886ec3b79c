"""The queries of the proteogenomics operators over the bridge views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.functions import mutations as M
from ribospark.functions import sequences as S
from ribospark.functions import spectra as P
from ribospark.functions import variants as V
from ribospark.functions.constants import ENZYMES
from ribospark.operators import genome, intervals, peptides, proteins, somatic, spectra, translation, variant_proteins
from ribospark.plans import bridges as B

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


@query
def three_frame_translation(spark, d):
    return translation.three_frames(B.dna(spark, d))


@query
def six_frame_translation(spark, d):
    return B.dna(spark, d).select("id", F.posexplode(S.orfs(F.col("seq"), 3, 3)).alias("frame", "seq"))


@query
def cds_to_stop_translation(spark, d):
    return B.dna(spark, d).select("id", S.translate(F.col("seq"), 1, to_stop=True).alias("seq"))


@query
def mito_translation(spark, d):
    return B.dna(spark, d).select("id", S.translate_by(F.col("seq"), F.col("ord") % 2 == 0).alias("seq"))


@query
def reverse_complement(spark, d):
    return B.dna(spark, d).select("id", S.reverse_complement(F.col("seq")).alias("seq"))


@query
def dna_orf_selection(spark, d):
    """Transcripts with header fields, chosen by biotype and expression."""
    doc = B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat_ws(" ", F.col("doc_id").cast("string"), F.concat(F.lit("biotype="), "lang"), F.concat(F.lit("tpm="), (F.col("n_chars") % 10).cast("string")), F.when(F.col("doc_id") % 3 == 0, F.lit("CDS=4-90"))).alias("description"))
    records = doc.join(B.dna(spark, d).select("id", "seq"), "id")
    return translation.dna_orfs(records, 3, 1, biotype_key="biotype", include=["en", "fr"], exclude=["fr"], expression_key="tpm", expression_least=5.0)


@query
def digest_trypsin(spark, d):
    return B.protein(spark, d).select("id", F.explode(S.cleave(F.col("seq"), "Trypsin", 0, 6)).alias("peptide"))


@query
def digest_missed_cleavages(spark, d):
    return B.protein(spark, d).select("id", F.explode(S.cleave(F.col("seq"), "Trypsin", 2, 6)).alias("peptide"))


@query
def digest_enzyme_catalog(spark, d):
    pieces = [F.struct(F.lit(name).alias("enzyme"), F.filter(F.split("seq", rule[0]), lambda p: p != "").alias("p")) for name, rule in ENZYMES.items()]
    each = B.protein(spark, d).select(F.explode(F.array(*pieces)).alias("x")).select("x.enzyme", F.size("x.p").alias("n"), F.coalesce(F.array_max(F.transform("x.p", lambda p: F.length(p))), F.lit(0)).alias("longest"))
    return each.groupBy("enzyme").agg(F.sum("n").alias("peptides"), F.max("longest").alias("longest"))


@query
def canonical_peptidome(spark, d):
    return proteins.peptidome(B.protein(spark, d))


def _mutants(spark, d):
    p = B.protein(spark, d)
    kind = F.when(F.col("ord") % 2 == 0, F.lit("Substitution-Missense")).otherwise(F.lit("Nonsense*"))
    text = F.concat(F.lit("COSMIC:G"), "id", F.lit(":p.A"), (F.col("ord") % 50 + 1).cast("string"), F.lit("V:"), kind)
    return p.select(text.alias("description"), F.translate("seq", "AE", "VW").alias("seq"))


@query
def variant_unique_peptides(spark, d):
    return proteins.unique_variant_peptides(_mutants(spark, d), B.protein(spark, d))


@query
def vcf_allele_filter(spark, d):
    kept = variant_proteins.filter_variants(B.variants(spark, d), ignore=True)
    return kept.select("ord", "ref", "alt")


@query
def vcf_filter_status(spark, d):
    return B.variants(spark, d).filter(V.passes_filter(F.col("filter"), ["PASS", "RF"])).select("ord", "filter")


@query
def vcf_af_threshold(spark, d):
    return B.variants(spark, d).filter(V.passes_frequency(F.col("info"), "AF", 0.25)).select("ord", V.info_value(F.col("info"), "AF").alias("af"))


@query
def csq_explode_filter(spark, d):
    rows = variant_proteins.explode_annotations(B.variants(spark, d), "CSQ", ["ALLELE", "CONSEQUENCE", "FEATURE", "BIOTYPE"], "Feature", "Consequence", "Biotype")
    kept = rows.filter(V.passes_choice(F.col("consequence"), ["all"], ["error"]) & V.passes_choice(F.col("biotype"), ["all"], [""]))
    return kept.select("ord", "transcript_id", "consequence", "biotype")


@query
def clnsig_filter(spark, d):
    return B.clinical(spark, d).filter(V.passes_clinical_significance(F.col("clnsig"), B.EXCLUDED)).select("event_id", "clnsig")


@query
def mc_filter(spark, d):
    return B.clinical(spark, d).filter(V.passes_consequence(F.col("mc"), B.INCLUDED)).select("event_id", "mc")


@query
def geneinfo_parse(spark, d):
    g = V.gene_info(F.col("geneinfo"))
    return B.clinical(spark, d).select("event_id", g["symbol"].alias("symbol"), g["id"].alias("gene_id"))


def _spans(spark, d):
    return B.variants(spark, d).filter(V.valid_ref(F.col("ref"))).withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + F.length("ref") - 1)


def _met(spark, d, transcripts=None):
    b = B.blocks(spark, d, transcripts).select("transcript_id", F.col("chrom").alias("f_chrom"), "strand", F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    return intervals.interval_join(_spans(spark, d), b, chrom="f_chrom", start="f_start", end="f_end")


@query
def interval_overlap_join(spark, d):
    return _met(spark, d).select("ord", "transcript_id", "f_start", "f_end")


@query
def transcripts_by_variant(spark, d):
    out = intervals.transcripts_by_variant(_met(spark, d), ["ord"])
    return out.select("ord", F.array_join("transcripts", ",").alias("transcripts"))


def _sequenced(spark, d):
    """Ids of the transcripts that have a sequence: others make no protein, so their blocks needn't meet the variants."""
    return B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"))


def _models(spark, d):
    return intervals.transcript_models(B.blocks(spark, d, _sequenced(spark, d)).withColumn("type", F.lit("CDS")))


def _transcripts(spark, d):
    cds = F.when(F.col("ord") % 3 == 0, F.struct(F.lit(4).alias("start"), F.lit(600).alias("end")))
    return B.dna(spark, d).select("id", "seq", cds.alias("cds"))


def _paired(spark, d):
    met = _met(spark, d, _sequenced(spark, d)).select("ord", "chrom", "pos", "id", "ref", F.col("alt").alias("_alts"), "transcript_id").distinct()
    alts = met.withColumn("alt", F.explode(V.valid_alts(F.col("_alts"))))
    return alts.withColumn("transcript_id", F.col("transcript_id"))


@query
def variant_allele_splice(spark, d):
    m = _models(spark, d).select(F.col("transcript_id").alias("_t"), "strand", "features")
    t = _transcripts(spark, d).select(F.col("id").alias("_s"), "seq", "cds")
    rows = _paired(spark, d).join(m, F.col("transcript_id") == F.col("_t")).join(t, F.col("transcript_id") == F.col("_s"))
    made = V.splice(F.col("seq"), F.col("ref"), F.col("alt"), F.col("pos"), F.col("strand"), F.col("features"), F.col("cds"))
    return rows.withColumn("x", made).select("ord", "transcript_id", "alt", F.col("x.ref_seq").alias("ref_seq"), F.col("x.alt_seq").alias("alt_seq"))


@query
def variant_to_protein(spark, d):
    return variant_proteins.variant_proteins(_paired(spark, d), _transcripts(spark, d), _models(spark, d))


@query
def translation_summary(spark, d):
    made = variant_to_protein(spark, d)
    return made.agg(F.count(F.lit(1)).alias("orfs"), F.countDistinct("accession").alias("accessions"), F.count_if(F.contains("seq", F.lit("*"))).alias("with_stop"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("residues"))


def _edited(spark, d):
    genes = B.dna(spark, d).select(F.col("id").alias("_g"), "seq")
    return B.mutations(spark, d).join(genes, F.col("gene") == F.col("_g"))


@query
def hgvs_dna(spark, d):
    return _edited(spark, d).select("ord", F.coalesce(S.translate(M.mutated_dna(F.col("seq"), F.col("dna_mut"))), F.lit("")).alias("protein"))


@query
def hgvs_protein_level(spark, d):
    return _edited(spark, d).select("ord", F.coalesce(M.mutated_protein(S.translate(F.col("seq")), F.col("aa_mut"), F.col("mutation_type")), F.lit("")).alias("protein"))


@query
def census_to_protein(spark, d):
    return somatic.census_proteins(B.mutations(spark, d), B.dna(spark, d))


@query
def census_accepted_groups(spark, d):
    """Census mutations of two groups; every fifth one is silent."""
    kind = F.when(F.col("ord") % 5 == 0, F.lit("Substitution - coding silent")).otherwise(F.col("mutation_type"))
    return somatic.census_proteins(B.mutations(spark, d).withColumn("mutation_type", kind), B.dna(spark, d), ["1-URGENT", "2-HIGH"])


@query
def census_dedup_by_header(spark, d):
    return somatic.first_by_header(census_to_protein(spark, d))


@query
def maf_to_protein(spark, d):
    return somatic.mutation_table_proteins(B.maf(spark, d), B.dna(spark, d), B.samples(spark, d), ["BUILDING", "MACHINERY"])


@query
def split_by_group(spark, d):
    return somatic.last_by_group(somatic.mutation_table_proteins(B.maf(spark, d), B.dna(spark, d), B.samples(spark, d)))


@query
def decoy_reverse(spark, d):
    return proteins.whole_decoys(B.protein(spark, d))


@query
def decoy_revswitch(spark, d):
    return B.protein(spark, d).select("id", S.reverse_switch(S.isobaric(F.col("seq"))).alias("seq"))


@query
def decoy_collision_peptides(spark, d):
    return proteins.decoy_collisions(B.protein(spark, d), min_length=4)


@query
def decoy_database(spark, d):
    return proteins.switched_decoys(B.protein(spark, d))


@query
def decoy_shuffle(spark, d):
    return proteins.whole_decoys(B.protein(spark, d), "shuffle")


@query
def target_decoy_composition(spark, d):
    p = B.protein(spark, d)
    decoys = p.select(F.concat(F.lit("DECOY_"), "id").alias("id"), S.reverse_switch(F.col("seq")).alias("seq"))
    return proteins.decoy_composition(p.select("id", "seq").unionByName(decoys))


@query
def stop_codon_qc_split(spark, d):
    return proteins.check_proteins(B.stopped_protein(spark, d), True)


@query
def stop_codon_qc_truncate(spark, d):
    return proteins.check_proteins(B.stopped_protein(spark, d), False)


@query
def stop_codon_summary(spark, d):
    return proteins.check_summary(B.stopped_protein(spark, d))


@query
def residue_totals(spark, d):
    return proteins.residue_totals(B.protein(spark, d))


@query
def merged_database(spark, d):
    p = B.protein(spark, d)
    return proteins.merged_database([p, p.select(F.concat(F.lit("B"), "id").alias("id"), S.isobaric(F.col("seq")).alias("seq"))]).select("seq", F.array_join("ids", ",").alias("ids"))


@query
def peptide_containment_all(spark, d):
    """Which of all digested peptides, as they are or with a residue changed, a protein contains."""
    return peptides.contained_peptides(B.searched_peptides(spark, d), B.protein(spark, d))


@query
def one_mismatch_all(spark, d):
    """Where the same peptides stand with one change."""
    return peptides.one_mismatch(B.searched_peptides(spark, d), B.protein(spark, d))


@query
def psm_locate_all(spark, d):
    """Both, for each of these peptides as a PSM."""
    psms = B.searched_peptides(spark, d).withColumn("usi", F.concat(F.lit("mzspec:"), "sequence"))
    return peptides.locate_peptides(psms, B.protein(spark, d))


@query
def cds_transcript_positions(spark, d):
    return genome.transcript_positions(B.blocks(spark, d)).select("transcript_id", "start", "end", "rank", "trans_start", "trans_end")


def _placed(spark, d):
    p = B.protein(spark, d)
    first = p.select(F.posexplode(F.filter(S.trypsin_pieces(F.col("seq"), 0, 7, 40), lambda x: F.length(x) >= 7)).alias("k", "peptide"), F.col("id").alias("protein"), (F.col("ord") * 100_000).alias("o")).withColumn("ord", F.col("o") + F.col("k"))
    ids = p.select(F.col("id").alias("protein"), F.col("id").alias("transcript"), "ord")
    return genome.map_peptides(first, ids, p, B.blocks(spark, d))


@query
def peptide_to_genome(spark, d):
    return _placed(spark, d).select("peptide", "chrom", "strand", "start", "end", F.size("blocks").alias("n_blocks"))


@query
def gff3_rows(spark, d):
    return genome.gff3_rows(_placed(spark, d))


def _ions(sequences):
    ions = sequences.select("sequence", F.explode(P.fragment_ions(F.col("sequence"))).alias("x"))
    return ions.select("sequence", "x.ion", F.round("x.mz", 3).alias("mz"))


@query
def theoretical_ions_all(spark, d):
    """Fragment ions of all digested peptides."""
    return _ions(B.digested_peptides(spark, d))


@query
def spectrum_summary(spark, d):
    s = P.intensity_summary(F.col("peaks"))
    return B.spectra(spark, d).select("scan", s["sum"].alias("sum"), s["max"].alias("max"), F.round(s["mean"], 3).alias("mean"), s["median"].alias("median"))


@query
def nearest_peak_match(spark, d):
    masses = F.explode(F.array(*(F.lit(x) for x in (101.0, 250.25, 1000.5)))).alias("mz")
    near = P.nearest_peak(F.col("peaks"), F.col("mz"))
    return B.spectra(spark, d).select("scan", "peaks", masses).select("scan", "mz", F.round(near["error"], 6).alias("error"), near["intensity"].alias("intensity"), P.ppm(near["error"], F.col("mz")).alias("ppm"))


def _psms(spark, d, sequences):
    n = B.spectra(spark, d).agg(F.max("scan").alias("m"))  # one row
    return sequences.crossJoin(n).select("sequence", F.lit("f").alias("file"), F.pmod(F.crc32("sequence"), F.col("m") + 1).cast("int").alias("scan"), (F.length("sequence") - 3).cast("string").alias("position"))


@query
def ion_support_all(spark, d):
    """Support of all digested peptides by spectra."""
    return spectra.inspect_spectra(_psms(spark, d, B.digested_peptides(spark, d)), B.spectra(spark, d), 7.0)


@query
def doubly_charged_matches(spark, d):
    """The singly and doubly charged ions of all digested peptides that a peak of their spectrum matches."""
    psms = _psms(spark, d, B.digested_peptides(spark, d)).join(B.spectra(spark, d).select("scan", "peaks"), "scan")
    ions = spectra.matched_fragments(psms, 1.5, charge=2)
    return ions.select("sequence", "ion", "z", F.round("mz", 3).alias("mz"), "intensity")


@query
def version_resolution(spark, d):
    wanted = B.table(spark, d, "orders").select((F.col("o_custkey").cast("string")).alias("wanted"), F.col("o_orderkey").alias("ord"))
    known = B.table(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") % 2 == 0, F.lit(".2")).otherwise(F.lit(""))).alias("known"), F.col("c_custkey").alias("o"))
    return intervals.resolve_versions(wanted, known, "wanted", "known", "o").select("ord", "wanted", "resolved_id")


@query
def chromosome_names(spark, d):
    n = F.col("n_nationkey")
    report = B.table(spark, d, "nation").select(n.cast("string").alias("numeric"), F.concat(F.lit("NC_"), n.cast("string")).alias("refseq"), F.concat(F.lit("chr"), n.cast("string")).alias("ucsc"))
    return variant_proteins.map_chromosomes(B.variants(spark, d).select("ord", "chrom"), report, "chrom", "ucsc")


def queries() -> dict[str, Query]:
    return dict(FOUND)
