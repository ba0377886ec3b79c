"""Every command on small files, from its options to what it leaves behind."""

import base64
import gzip
import http.server
import json
import struct
import threading

import pytest

from ribospark import cli
from ribospark.sources import fetch_plan, flatfiles, mzml, tables


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def _lines(folder):
    """The lines of all part files, in the order of the parts."""
    from pathlib import Path

    return [x for f in sorted(Path(folder).rglob("part-*")) for x in f.read_text().splitlines()]


def _fasta(folder):
    lines = _lines(folder)
    return dict(zip([x[1:] for x in lines[::2]], lines[1::2]))


#: t1: a coding transcript of two exons on the forward strand; t2: not coding, on the reverse strand.
T1 = "GG" + "ATGAAATTTCCC" + "TAA" + "CC"
GTF = "\n".join(
    "\t".join(["1", "s", kind, str(a), str(z), ".", strand, ".", f'gene_id "g"; transcript_id "{t}"; transcript_biotype "protein_coding";'])
    for kind, a, z, strand, t in [("transcript", 101, 219, "+", "t1"), ("exon", 101, 110, "+", "t1"), ("exon", 211, 219, "+", "t1"), ("CDS", 103, 110, "+", "t1"), ("CDS", 211, 214, "+", "t1"), ("stop_codon", 215, 217, "+", "t1"), ("transcript", 301, 315, "-", "t2"), ("exon", 301, 315, "-", "t2")]
) + "\n"


@pytest.fixture
def genome(tmp_path):
    return {
        "fasta": _write(tmp_path / "t.fa", f">t1 CDS=3-17 biotype=protein_coding tpm=9\n{T1}\n>t2 biotype=lncRNA tpm=2\nATGGCCAAATTTTGA\n"),
        "gtf": _write(tmp_path / "t.gtf", "#!x\n" + GTF),
    }


def test_vcf_to_proteindb(spark, genome, tmp_path):
    vcf = _write(tmp_path / "a.vcf", '##INFO=<ID=CSQ,Number=.,Type=String,Description="Format: Allele|Consequence|Feature">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t106\trs1\tA\tC\t.\tPASS\tCSQ=C|missense_variant|t1\n1\t107\trs2\tA\tG\t.\tLOW\tCSQ=G|missense_variant|t1\n1\t108\trs3\tA\tG\t.\tPASS\tCSQ=G|synonymous_variant|t1,G|missense_variant|none\n')
    seen = cli.main(["vcf-to-proteindb", "--input_fasta", genome["fasta"], "--gene_annotations_gtf", genome["gtf"], "--vcf", vcf, "--output", str(tmp_path / "out"), "--protein_prefix", "v_"])
    found = _fasta(tmp_path / "out")
    assert list(found.values()) == ["MQFP*"] or list(found.values()) == ["MQFP"] and all(k.startswith("v_") for k in found)
    assert seen == {"variants read": 3, "alleles kept by the filters": 2, "annotations kept": 2, "annotations with a transcript": 1, "proteins written": 1}


def test_vcf_to_proteindb_annotates_by_overlap(spark, genome, tmp_path):
    vcf = _write(tmp_path / "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t106\trs1\tA\tC\t.\tPASS\tDB\n1\t999\trs9\tA\tC\t.\tPASS\tDB\n")
    config = _write(tmp_path / "c.yaml", "ensembl_translation:\n  translation_table: 1\n  ensembl_translation:\n    annotation_field_name: ''\n    transcript_str: transcript\n    ignore_filters: true\n")
    cli.main(["vcf-to-proteindb", "--input_fasta", genome["fasta"], "--gene_annotations_gtf", genome["gtf"], "--vcf", vcf, "--output", str(tmp_path / "out"), "--config", config])
    assert len(_fasta(tmp_path / "out")) == 1
    told = _lines(tmp_path / "out_annotated.vcf")
    assert told == ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO", "1\t106\trs1\tA\tC\t.\tPASS\tDB;transcriptOverlaps=t1", "1\t999\trs9\tA\tC\t.\tPASS\tDB"]
    header, again = flatfiles.read_vcf(spark, str(tmp_path / "out_annotated.vcf"))
    assert header == ["##x"] and again.count() == 2


def test_clinvar_to_proteindb(spark, genome, tmp_path):
    vcf = _write(tmp_path / "c.vcf", "#CHROM\tPOS\n1\t106\t1\tA\tC\t.\t.\tGENEINFO=G:1;CLNSIG=Pathogenic;MC=SO:1|missense_variant\n1\t107\t2\tA\tG\t.\t.\tGENEINFO=G:1;CLNSIG=Benign;MC=SO:1|missense_variant\n1\t109\t3\tT\tG\t.\t.\tGENEINFO=G:1;CLNSIG=Pathogenic;MC=SO:1|synonymous_variant\n")
    report = _write(tmp_path / "r.txt", "# x\n1\ta\t1\tC\tG\t=\tNC_1.1\tP\t9\tchr1\n")
    gtf = _write(tmp_path / "n.gtf", GTF.replace("1\ts", "NC_1.1\ts"))
    common = ["--vcf", vcf, "--gtf", gtf, "--fasta", genome["fasta"], "--assembly_report", report]
    seen = cli.main(["clinvar-to-proteindb", *common, "--output", str(tmp_path / "out")])
    assert [x.rstrip("*") for x in _fasta(tmp_path / "out").values()] == ["MQFP"]
    assert seen["variants read"] == 3 and seen["variants kept by the filters"] == seen["overlaps with transcripts"] == 1
    config = _write(tmp_path / "c.yaml", "clinvar_translation:\n  clinical_significance_exclude: [Pathogenic]\n  protein_prefix: p_\n")
    cli.main(["clinvar-to-proteindb", *common, "--output", str(tmp_path / "two"), "--config", config])
    assert [k[:2] for k in _fasta(tmp_path / "two")] == ["p_"]


def test_cosmic_to_proteindb(spark, tmp_path):
    genes = _write(tmp_path / "g.fa", ">G1\natgaaatttccctaa\n")
    head = "Gene name\tAccession Number\tMutation CDS\tMutation AA\tMutation Description\tPrimary site\n"
    mutations = _write(tmp_path / "m.tsv", head + "G1\tE\tc.4A>C\tp.K2Q\tSubstitution - Missense\tlung\nG1\tE\tc.4A>C\tp.K2Q\tSubstitution - Missense\tskin\nG1\tE\tc.7T>G\tp.F3V\tSubstitution - Missense\tskin\nG1\tE\tc.6A>G\tp.K2K\tSubstitution - coding silent\tlung\n")
    cli.main(["cosmic-to-proteindb", "--input_mutation", mutations, "--input_genes", genes, "--output_db", str(tmp_path / "out"), "--split_by_filter_column"])
    assert set(_fasta(tmp_path / "out")) == {"COSMIC:G1:p.K2Q:Substitution-Missense", "COSMIC:G1:p.F3V:Substitution-Missense"}
    assert {x.name for x in tmp_path.iterdir() if x.name.startswith("out_")} == {"out_lung.fa", "out_skin.fa"}
    config = _write(tmp_path / "c.yaml", "proteindb:\n  filter_info:\n    filter_column: Primary site\n    accepted_values: lung\n")
    cli.main(["cosmic-to-proteindb", "--input_mutation", mutations, "--input_genes", genes, "--output_db", str(tmp_path / "one"), "--config", config])
    assert set(_fasta(tmp_path / "one")) == {"COSMIC:G1:p.K2Q:Substitution-Missense"}


MAF = ["Hugo_Symbol", "HGVSc", "Transcript_ID", "Variant_Classification", "Variant_Type", "HGVSp_Short", "Tumor_Sample_Barcode"]


def test_cbioportal_to_proteindb(spark, tmp_path):
    cds = _write(tmp_path / "c.fa", ">t1.3 CDS=1-24\nATGAAATTTCCCGGGAAATTTTAA\n")
    swapped = [MAF[0], *MAF[:0:-1]]
    row = {"Hugo_Symbol": "G", "HGVSc": "t1:c.4A>C", "Transcript_ID": "t1", "Variant_Classification": "Missense_Mutation", "Variant_Type": "SNP", "HGVSp_Short": "p.K2Q", "Tumor_Sample_Barcode": "s1"}
    other = row | {"HGVSc": "t1:c.7T>G", "HGVSp_Short": "p.F3V", "Tumor_Sample_Barcode": "s2"}
    maf = _write(tmp_path / "m.txt", "\n".join(["#v", "\t".join(MAF), "\t".join(row[c] for c in MAF), "\t".join(swapped), "\t".join(other[c] for c in swapped), "short"]) + "\n")
    assert [r["hgvsp"] for r in tables.read_maf(spark, maf).orderBy("ord").collect()] == ["p.K2Q", "p.F3V"]  # a second header binds the columns anew
    cli.main(["cbioportal-to-proteindb", "--input_mutation", maf, "--input_cds", cds, "--output_db", str(tmp_path / "out")])
    assert _fasta(tmp_path / "out") == {"cbiomut:t1:G:p.K2Q:Missense_Mutation": "MQFPGKF*", "cbiomut:t1:G:p.F3V:Missense_Mutation": "MKVPGKF*"}
    samples = _write(tmp_path / "s.txt", "#a\nPATIENT_ID\tSAMPLE_ID\tCANCER_TYPE\np\ts1\tBone Cancer\np\ts2\tLung\n")
    cli.main(["cbioportal-to-proteindb", "--input_mutation", maf, "--input_cds", cds, "--output_db", str(tmp_path / "one"), "--clinical_sample_file", samples, "--accepted_values", "Bone_Cancer"])
    assert set(_fasta(tmp_path / "one")) == {"cbiomut:t1:G:p.K2Q:Missense_Mutation"}
    with pytest.raises(SystemExit):
        cli.main(["cbioportal-to-proteindb", "--input_mutation", maf, "--input_cds", cds, "--output_db", "x", "--accepted_values", "Lung"])


def test_translations_and_check(spark, genome, tmp_path):
    cli.main(["dnaseq-to-proteindb", "--input_fasta", genome["fasta"], "--output", str(tmp_path / "a"), "--biotype_str", "biotype", "--include_biotypes", "lncRNA", "--num_orfs", "2", "--skip_including_all_cds"])
    assert _fasta(tmp_path / "a") == {"t2_1": "MAKF*", "t2_2": "WPNF"}
    cli.main(["dnaseq-to-proteindb", "--input_fasta", genome["fasta"], "--output", str(tmp_path / "b"), "--expression_str", "tpm", "--expression_thresh", "5"])
    assert _fasta(tmp_path / "b") == {"t1_1": "MKFP*"}
    cli.main(["threeframe-translation", "--input_fasta", genome["fasta"], "--output", str(tmp_path / "c")])
    assert {k: v for k, v in _fasta(tmp_path / "c").items() if k.startswith("t2")} == {"t2_RF1": "MAKF*", "t2_RF2": "WPNF", "t2_RF3": "GQIL"}
    db = _write(tmp_path / "p.fa", ">a one\nMAAAAAAAA*\n>b two\nMAAAAAAA*CCCCCCCCC\n")
    cli.main(["ensembl-check", "--input_fasta", db, "--output", str(tmp_path / "d")])
    assert sorted(_fasta(tmp_path / "d").values()) == ["MAAAAAAA", "MAAAAAAAA"]


@pytest.mark.parametrize("method", ["protein-reverse", "protein-shuffle", "decoypyrat", "pgdbdeep"])
def test_generate_decoy(spark, tmp_path, method):
    db = _write(tmp_path / "p.fa", ">a\nACDEFGHKLMNPQRSTVWYK\n>b\nKFGHEDCAMMKK\n>c\nKAAAAAAK\n>d\nCKAAAAAK\n")
    cli.main(["generate-decoy", "--input_database", db, "--output_database", str(tmp_path / "out"), "--method", method])
    found = _fasta(tmp_path / "out")
    assert {"DECOY_a", "a", "b", "c"} <= set(found) and sorted(found["DECOY_a"]) == sorted(found["a"])
    if method == "protein-reverse":
        assert found["DECOY_b"] == found["b"][::-1]
    if method == "decoypyrat":
        assert _lines(tmp_path / "out_noAlternative.fa") == ["AAAAAK"]  # every order of it is itself


def test_digest_and_map(spark, tmp_path):
    canonical = _write(tmp_path / "c.fa", ">c\nMKAAAAAAAK\n")
    mutant = _write(tmp_path / "m.fa", ">COSMIC:G:p.A5V:Substitution-Missense\nMKAAVAAAAK\n")
    cli.main(["digest-mutant-protein", "--input", mutant, "--fasta", canonical, "--output", str(tmp_path / "d")])
    assert _fasta(tmp_path / "d") == {"Mutation:G:p.A5V:Substitution-Missense:3": "AAVAAAAK"}
    peps = _write(tmp_path / "p.tsv", "pep\tprot\nKFP\ta\n")
    ids = _write(tmp_path / "i.tsv", "g\tt1\ta\n")
    prots = _write(tmp_path / "q.fa", ">a\nMKFP\n")
    cli.main(["map-peptide2genome", "--input", peps, "--gtf", _write(tmp_path / "t.gtf", GTF), "--fasta", prots, "--idmap", ids, "--output", str(tmp_path / "g")])
    rows = [x.split("\t") for x in _lines(tmp_path / "g")]
    assert [(r[0], r[2], r[3], r[4]) for r in rows] == [("chr1", "mRNA", "106", "214"), ("chr1", "CDS", "106", "110"), ("chr1", "CDS", "211", "214")]


def test_blast_get_position(spark, tmp_path):
    psms = _write(tmp_path / "p.tsv", "sequence\tusi\tScanNum\nKVLS\tu1\t007\nKILS\tu2\t1.0\n")
    db = _write(tmp_path / "d.fa", ">p1\nMKVLSAGR\n")
    cli.main(["blast_get_position", "--input_psm_to_blast", psms, "--input_reference_database", db, "--output_psm", str(tmp_path / "out.tsv")])
    rows = [r.asDict() for r in tables.read_psms(spark, str(tmp_path / "out.tsv")).orderBy("usi").collect()]
    assert [(r["usi"], r["ScanNum"], r["position"], r["variant"]) for r in rows] == [("u1", "007", "canonical", None), ("u2", "1.0", "2", "V>I")]  # text stays as it was


def test_spectrumai(spark, tmp_path):
    def array(values, kind):
        data = base64.b64encode(struct.pack(f"<{len(values)}d", *values)).decode() if values else "QUJ"
        return f'<binaryDataArray><cvParam accession="{kind}"/><cvParam accession="{mzml.FLOAT64}"/><binary>{data}</binary></binaryDataArray>'

    def spectrum(scan, values):
        return f'<spectrum id="scan={scan}"><binaryDataArrayList count="2">{array(values, mzml.MZ_ARRAY)}{array([1.0] * len(values), mzml.INTENSITY_ARRAY)}</binaryDataArrayList></spectrum>'

    _write(tmp_path / "f.mzML", f"<mzML><spectrumList>{spectrum(17, [58.02874, 115.0502])}</spectrumList></mzML>")
    _write(tmp_path / "bad.mzML", f"<mzML><spectrumList>{spectrum(1, [])}</spectrumList></mzML>")
    psms = _write(tmp_path / "p.tsv", "sequence\tposition\treference_file_name\tscan_number\nGGG\t2\tf\t17\nGGG\t2\tf\t18\nGGG\t2\tbad\t1\n")
    cli.main(["spectrumai", "--infile_name", psms, "--outfile_name", str(tmp_path / "out.tsv"), "--mzml_path", str(tmp_path)])
    rows = {(r["reference_file_name"], r["scan_number"]): r for r in tables.read_psms(spark, str(tmp_path / "out.tsv")).collect()}
    assert [(rows[k]["status"], rows[k]["ions_support"], rows[k]["matched_ions"]) for k in (("f", "17"), ("f", "18"), ("bad", "1"))] == [("checked", "YES", "b1,b2"), ("skiped", "NO", None), ("skiped", "mzML ERROR", None)]


@pytest.fixture
def server():
    """A server on this machine: lists, a gzipped file, a file that fails twice, and one behind a password."""
    tries = {"n": 0}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            port = self.server.server_port
            known = self.headers.get("Authorization") == "Basic " + base64.b64encode(b"me:secret").decode()
            tries["n"] += self.path == "/shaky.tar.gz"
            pages = {"/species": json.dumps({"species": [{"name": "homo_sapiens"}]}), "/studies": json.dumps([{"studyId": "one"}, {"studyId": "shaky"}]), "/secret/f": "rows"}
            if self.path.endswith(".gz"):
                data = gzip.compress(b"packed") if self.path != "/shaky.tar.gz" or tries["n"] > 2 else None
            elif self.path.startswith("/cosmic"):
                data = json.dumps({"url": f"http://127.0.0.1:{port}/secret/f"}).encode() if known else None
            else:
                data = pages[self.path].encode() if self.path in pages else None
            self.send_response(200 if data else 500)
            self.end_headers()
            self.wfile.write(data or b"")

        def log_message(self, *_):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{s.server_port}"
        s.shutdown()


def test_downloaders(server, tmp_path, capsys):
    cli.main(["ensembl-downloader", "--name", "homo_sapiens", "--release", "110", "--skip_vcf", "--output", "x"])
    assert len(capsys.readouterr().out.splitlines()) == 6
    cli.main(["ensembl-downloader", "--list_species", "--species_server", f"{server}/species"])
    assert capsys.readouterr().out == "homo_sapiens\n"
    cli.main(["cbioportal-downloader", "--list_studies", "--study_list", f"{server}/studies"])
    assert capsys.readouterr().out == "one\nshaky\n"
    out = str(tmp_path / "s")
    cli.main(["cbioportal-downloader", "--study_list", f"{server}/studies", "--cbioportal_download_url", server, "--fetch", "--output", out])
    assert capsys.readouterr().out.splitlines() == [f"{server}/one.tar.gz\t{out}/one.tar", f"{server}/shaky.tar.gz\t{out}/shaky.tar"]
    assert (tmp_path / "s/shaky.tar").read_bytes() == b"packed"
    config = _write(tmp_path / "c.yaml", f"cosmic_data:\n  cosmic_server:\n    cosmic_ftp: {server}\n    cosmic_user: me\n    cosmic_password: secret\n")
    assert fetch_plan.census_url(f"{server}/cosmic/x", "me", "secret") == f"{server}/secret/f"
    assert cli.options_of(["cosmic-downloader", "--config", config]).cosmic_password == "secret"
    cli.main(["ncbi-downloader", "--ncbi_refseq_ftp", f"{server}/none/", "--clinvar_ftp", f"{server}/", "--fetch", "--output", out])
    assert [x.split("\t")[1] for x in capsys.readouterr().out.splitlines()] == [f"{out}/GRCh38_latest_genomic.gtf", f"{out}/GRCh38_latest_rna.fna", "failed", f"{out}/clinvar.vcf", "failed"]
    before = (tmp_path / "s/clinvar.vcf").stat().st_mtime_ns
    assert fetch_plan.fetch(f"{server}/clinvar.vcf.gz", f"{out}/clinvar.vcf.gz") and (tmp_path / "s/clinvar.vcf").stat().st_mtime_ns == before
    for url in ("file:///etc/hosts", "data:,x"):
        with pytest.raises(ValueError, match="not allowed"):
            fetch_plan.fetch(url, f"{out}/x")


def test_an_unknown_enzyme_is_refused(tmp_path):
    with pytest.raises(SystemExit, match="unknown enzyme"):
        cli.main(["generate-decoy", "--input_database", "x", "--output_database", "y", "--enzyme", "Nonsense"])


def test_other_names_of_options():
    a = cli.options_of(["map-peptide2genome", "-i", "a", "-g", "b", "-f", "c", "-m", "d", "-o", "e", "--pep-col", "3"])
    assert (a.input, a.gtf, a.fasta, a.idmap, a.output, a.pep_col, a.prot_col) == ("a", "b", "c", "d", "e", 3, 1)
    a = cli.options_of(["generate-decoy", "-in", "x", "-out", "y", "-m", "decoypyrat", "-s", "1", "--memory_save", "--temp_file", "t"])
    assert (a.input_database, a.output_database, a.method, a.max_missed_cleavages) == ("x", "y", "decoypyrat", 1)
    a = cli.options_of(["cosmic-to-proteindb", "-in", "m", "-fa", "g", "-out", "o", "-s", "-a", "lung"])
    assert (a.input_mutation, a.input_genes, a.output_db, a.split_by_filter_column, a.accepted_values) == ("m", "g", "o", True, "lung")
    a = cli.options_of(["spectrumai", "-i", "p", "-o", "q", "-ion", "0.5", "-r", "-n", "4"])
    assert (a.infile_name, a.ions_tolerance, a.relative) == ("p", 0.5, True)
    for command in cli.DEFAULTS:
        assert cli.parser().parse_args([command, *[x for o in cli.parser()._subparsers._group_actions[0].choices[command]._actions if o.required for x in (o.option_strings[0], "v")]]).command == command
