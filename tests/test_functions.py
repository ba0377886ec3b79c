"""Column functions against hand-worked cases and plain Python versions."""

import random

import pytest
from pyspark.sql import functions as F

from ribospark.functions import mutations as M
from ribospark.functions import sequences as S
from ribospark.functions import spectra as P
from ribospark.functions import variants as V


def one(spark, column, **values):
    kinds = {str: "string", int: "long"}
    ddl = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], ddl).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("seq", "table", "want"), [("ATGAAATTTCCC", 1, "MKFP"), ("ATGTGATA", 1, "M*"), ("ATGTGA", 2, "MW"), ("augaaa", 1, "MK"), ("GCNATN", 1, "AX"), ("RAYSAR", 1, "BZ"), ("AT", 1, ""), ("", 1, ""), ("AT-GGG", 1, "XG")])
def test_translate(spark, seq, table, want):
    assert one(spark, S.translate(F.col("s"), table), s=seq) == want


def test_frames_and_complement(spark):
    assert one(spark, S.orfs(F.col("s"), 3, 1), s="ATGCATGCAT") == ["MHA", "CMH", "AC", "MHA"]
    assert one(spark, S.reverse_complement(F.col("s")), s="AACGTN") == "NACGTT"
    assert one(spark, S.translate(F.col("s"), 1, True), s="ATGTAAATG") == "M"


def test_digestion(spark):
    assert one(spark, S.cleave(F.col("s")), s="AKPBRCRK") == ["AKPBR", "CR", "K"]
    assert one(spark, S.cleave(F.col("s"), missed=1), s="AKBKAKB") == ["AK", "BK", "B", "AKBK", "BKAK", "AKB"]
    assert one(spark, S.cleave(F.col("s"), "Asp-N"), s="ADBE") == ["A", "D", "BE"]
    assert one(spark, S.trypsin_pieces(F.col("s"), 1, 2), s="AKAKR") == ["AK", "AK", "AKAK", "AKR"]
    assert one(spark, S.cleave(F.col("s")), s="") == []


def test_reverse_switch(spark):
    def plain(s):
        r = list(s[::-1])
        for i in range(1, len(r)):
            if r[i] in "KR":
                r[i - 1], r[i] = r[i], r[i - 1]
        return "".join(r)

    rng = random.Random(1)
    rows = [("".join(rng.choice("KRACP") for _ in range(rng.randint(0, 14))),) for _ in range(500)]
    for s, got in spark.createDataFrame(rows, "s string").select("s", S.reverse_switch(F.col("s"))).collect():
        assert got == plain(s)


def test_shuffle_keeps_residues_and_last(spark):
    got = one(spark, S.shuffled(F.col("s"), F.lit(3)), s="PEPTIDEK")
    assert sorted(got) == sorted("PEPTIDEK") and got[-1] == "K" and got == one(spark, S.shuffled(F.col("s"), F.lit(3)), s="PEPTIDEK")


FEATURES = "array(named_struct('end', 4L, 'start', 1L, 'type', 'exon'), named_struct('end', 15L, 'start', 10L, 'type', 'exon'))"


@pytest.mark.parametrize(("ref", "alt", "pos", "strand", "want"), [
    ("G", "T", 3, "+", ("ATGCATGCAT", "ATTCATGCAT")), ("A", "C", 10, "+", ("ATGCATGCAT", "ATGCCTGCAT")), ("CTT", "G", 4, "+", ("ATGCATGCAT", "ATGATGCAT")),
    ("CTT", "GAT", 4, "+", ("ATGCATGCAT", "ATGGATGCAT")), ("A", "AGG", 1, "+", ("ATGCATGCAT", "AGGTGCATGCAT")), ("A", "C", 7, "+", ("ATGCATGCAT", "")), ("A", "C", 1, "-", ("ATGCATGCAT", "ATGCATGCAG")),
])
def test_splice(spark, ref, alt, pos, strand, want):
    got = one(spark, V.splice(F.col("s"), F.col("r"), F.col("a"), F.col("p"), F.col("t"), F.expr(FEATURES)), s="ATGCATGCAT", r=ref, a=alt, p=pos, t=strand)
    assert got["alt_seq"] == want[1] and (not want[1] or got["ref_seq"] == want[0])


def test_splice_in_coding_range(spark):
    cds = F.struct(F.lit(4).alias("start"), F.lit(9).alias("end"))
    got = one(spark, V.splice(F.col("s"), F.lit("C"), F.lit("G"), F.lit(1).cast("long"), F.lit("+"), F.expr(FEATURES), cds), s="AAACCCGGGT")
    assert (got["ref_seq"], got["alt_seq"]) == ("CCCGGG", "GCCGGG")
    got = one(spark, V.splice(F.col("s"), F.lit("C"), F.lit("G"), F.lit(1).cast("long"), F.lit("-"), F.expr(FEATURES), cds), s="AAACCCGGGT")
    assert (got["ref_seq"], got["alt_seq"]) == ("CCCGGG", "CCCGGC")


@pytest.mark.parametrize(("dna", "aa", "kind", "want"), [
    ("c.4A>G", "p.K2E", "Substitution - Missense", "MEFP"), ("c.4C>G", "p.K2E", "Substitution - Missense", ""), ("c.4_6del", "p.K2del", "Deletion", "MFP"), ("c.4del", "p.x", "x", "MNF"),
    ("c.3_4insGGG", "p.x", "x", "MGKFP"), ("c.4_6delinsTTT", "p.x", "x", "MFFP"), ("c.4dup", "p.x", "x", ""), ("c.?", "p.K2E", "Substitution - Missense", "MEFP"), ("c.?", "p.Lys2Glu", "Substitution - Missense", "MEFP"),
    ("c.?", "p.K2*", "Substitution - Nonsense", "M"), ("c.?", "p.K2_F3insAA", "Insertion - In frame", "MKAAFP"), ("c.?", "p.K2_F3del", "Deletion - In frame", "MP"), ("c.?", "p.?", "Substitution - Missense", ""),
    ("c.?", "p.K2_F3>WW", "Complex - deletion inframe", "MWWP"), ("c.?", "p.K2_F3>W*", "Complex - compound substitution", "MW"), ("c.400A>G", "p.x", "x", ""),
])
def test_hgvs(spark, dna, aa, kind, want):
    assert one(spark, M.hgvs_protein(F.lit("ATGAAATTTCCC"), F.col("d"), F.col("a"), F.col("k")), d=dna, a=aa, k=kind) == want


@pytest.mark.parametrize(("change", "kind", "want"), [("T:c.1A>G", "SNP", "GTGAAA"), ("c.1C>G", "SNP", None), ("c.4del", "DEL", "ATGAAA"), ("c.4delA", "DEL", "ATGAA"), ("c.3_4insCC", "INS", "ATGCCAAA"), ("c.3dupG", "INS", "ATGGAAA"), ("c.2_3dupTG", "INS", "ATGTGAAA"), ("c.1A>G", "DNP", None)])
def test_maf(spark, change, kind, want):
    assert one(spark, M.maf_dna(F.lit("ATGAAA"), F.col("c"), F.col("k")), c=change, k=kind) == want


@pytest.mark.parametrize(("value", "want"), [("", True), ("Benign", False), ("Benign/Likely_benign", False), ("Benign,_risk_factor", True), ("Likely_benign/Benign", False), ("/,", True), ("Pathogenic", True)])
def test_significance(spark, value, want):
    assert one(spark, V.passes_clinical_significance(F.col("v"), ["Benign", "Likely_benign"]), v=value) is want


@pytest.mark.parametrize(("value", "want"), [("PASS", True), (".", True), ("", True), ("RF;AC0", False), ("PASS,RF", True), ("pass", True), ("RF", True)])
def test_filter_status(spark, value, want):
    assert one(spark, V.passes_filter(F.col("v"), ["PASS", "RF"]), v=value) is want


def test_fields(spark):
    assert one(spark, V.info_value(F.col("i"), "AF"), i="DB;AF=0.5;XAF=1") == "0.5"
    assert one(spark, V.info_value(F.col("i"), "AC"), i="DB;AF=0.5") is None
    assert one(spark, V.consequences(F.col("m")), m="SO:1|a,b") == ["a", "b"]
    assert V.format_fields(['##INFO=<ID=CSQ,Number=.,Description="x Format: Allele|Feature|SIFT">'], "CSQ") == ["ALLELE", "FEATURE", "SIFT"]


def test_ions_and_support(spark):
    ions = one(spark, P.fragment_ions(F.col("p")), p="GAK")
    assert sorted(x["ion"] for x in ions) == ["b1", "b2", "b3", "y1", "y2", "y3"]
    assert {x["ion"]: round(x["mz"], 3) for x in ions}["y1"] == 147.113
    peaks = "array(named_struct('mz', 58.02874, 'intensity', 5.0), named_struct('mz', 147.11281, 'intensity', 9.0), named_struct('mz', 218.15, 'intensity', 7.0))"
    got = one(spark, P.matched_ions(P.fragment_ions(F.col("p")), F.expr(peaks), 0.02), p="GAK")
    assert [x["ion"] for x in got] == ["b1", "y1", "y2"]
    flags = one(spark, P.ion_support(F.col("p"), F.lit(2), P.matched_ions(P.fragment_ions(F.col("p")), F.expr(peaks), 0.02), F.lit(7.0)), p="GAK")
    assert flags["ions_support"] == "YES" and flags["support_ions"] == "y2" and flags["flanking_ions_support"] == "YES"


def test_peptide_classes(spark):
    from ribospark.functions.classes import class_groups, has_prefix, in_group

    assert class_groups("{var:[COSMIC,cbiomut]};{alt:[altorf]}") == {"var": ["COSMIC", "cbiomut"], "alt": ["altorf"]}
    assert class_groups("a,b") == {"a": ["a"], "b": ["b"]}
    rows = [(1, ["COSMIC:1", "cbiomut:2"]), (2, ["COSMIC:1", "ENSP"]), (3, ["DECOY_COSMIC"]), (4, [])]
    df = spark.createDataFrame(rows, "id int, a array<string>")
    got = {r["id"]: (r["g"], r["d"]) for r in df.select("id", in_group(F.col("a"), ["COSMIC", "cbiomut"]).alias("g"), has_prefix(F.col("a"), "DECOY_").alias("d")).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, True), 4: (True, False)}


def test_nearest_peaks_and_ladders_equal_plain_loops(spark):
    import time

    import numpy as np

    from ribospark.operators import spectra as OS

    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 50):
        peaks, mz = rng.integers(0, 20, n) / 2.0, rng.integers(-2, 44, 60) / 4.0
        error, at = OS.nearest_peaks(mz, peaks)
        want = [min((abs(p - m), i) for i, p in enumerate(peaks)) for m in mz]
        assert [(e, i) for e, i in zip(error, at)] == want
    began = time.perf_counter()
    OS.nearest_peaks(rng.random(10_000), rng.random(10_000))
    assert time.perf_counter() - began < 1
    rows = [("PEPTIDEK", [(98.06, 5.0), (147.11, 2.0), (74.06, 9.0)], 1), ("AXK", [(72.04, 1.0)], 2), ("", [(1.0, 1.0)], 3), (None, None, 4), ("GK", None, 5), ("GK", [], 6)]
    df = spark.createDataFrame(rows, "sequence string, peaks array<struct<mz: double, intensity: double>>, _ion int")
    for charge in (1, 2):
        got = {r["_ion"]: [(x["ion"], x["z"], round(x["mz"], 6), x["intensity"]) for x in r["m"]] for r in OS.match_fragments(df, charge).select("_ion", OS.matched("_ions", 0.02).alias("m")).collect()}
        plain = df.select("_ion", P.matched_ions(P.fragment_ions(F.col("sequence"), charge), F.col("peaks"), 0.02).alias("m")).collect()
        assert {k: [(i, m, x) for i, _, m, x in v] for k, v in got.items()} == {r["_ion"]: [(x["ion"], round(x["mz"], 6), x["intensity"]) for x in r["m"] or []] for r in plain}
        assert len(got[1]) == charge + 1 and [x[0] for x in got[2]] == ["b1"]


def test_placed_pieces_equal_first_places(spark):
    import random
    import re

    from ribospark.functions import sequences as S

    rng = random.Random(9)
    seqs = ["".join(rng.choices("AKPR", [4, 1, 2, 1], k=rng.randint(0, 400))) for _ in range(60)] + [None, "", "KPKPKPAKPAKPAAKPA", "AAAAAAAK" * 3 + "AAAAAAA", "WWWWWWWAAAAAAAK" + "AAAAAAAK", "AAAAAAAKPAAAAAAAK"]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for low, high in ((1, 40), (3, 6), (7, 40)):
        got = [r[0] for r in df.select(S.placed_pieces(F.col("s"), low, high)).collect()]
        want = [None if s is None else [(p, s.find(p) + 1) for p in re.split("(?<=[KR])(?!P)", s) if low <= len(p) <= high] for s in seqs]
        assert [None if g is None else [tuple(x) for x in g] for g in got] == want


def test_spectra_are_inspected_in_batches(spark):
    """PSMs of all lengths together give what the column functions give one by one: odd peptides, peaks, places and charges."""
    from ribospark.operators import spectra as OS

    rng = random.Random(12)
    peptide = lambda: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY" + "XU" * (rng.random() < 0.1)) for _ in range(rng.randrange(1, 14)))
    peaks = [[(round(rng.uniform(50, 900), rng.choice([0, 3])), float(rng.randrange(50))) for _ in range(rng.choice([1, 2, 40, 400]))] for _ in range(30)] + [[], None, [(200.0, 5.0)] * 3]
    spectra = spark.createDataFrame([("f", k, p) for k, p in enumerate(peaks)] + [("g", 1, None)], "file string, scan int, peaks array<struct<mz: double, intensity: double>>")
    rows = [(x, rng.choice("ffffg"), rng.randrange(-1, len(peaks) + 1), rng.choice([str(rng.randrange(-1, 15)), "canonical", None])) for x in [peptide() for _ in range(300)] + ["", None, "PP", "P"]]
    psms = spark.createDataFrame(rows, "sequence string, file string, scan int, position string")
    told = ["sequence", "scan", "position", "status", "support_ions", "sum_supportions_intensity", "flanking_ions_support", "flanking_ions", "sum_flanking_ions_intensity", "matched_ions", "sum_matchedions_intensity", "sum_fragmentions_intensity", "median_intensity"]
    for tolerance, relative, charge in ((2.0, False, 1), (9000.0, True, 1), (3.0, False, 2), (0.0, False, 1)):
        plain = OS.match_fragments(psms.join(spectra, ["file", "scan"], "left"), charge).withColumn("_ions", OS.matched("_ions", tolerance, relative)).withColumn("_sum", P.intensity_summary(F.col("peaks")))
        place = F.col("position").try_cast("int")
        on = F.coalesce((F.size("_ions") > 0) & place.between(1, F.length("sequence")), F.lit(False))
        x = F.when(on, P.ion_support(F.col("sequence"), place, F.col("_ions"), F.col("_sum.median")))
        none, zero = F.lit(""), F.lit(0.0)
        want = plain.select("sequence", "scan", "position", F.when(on, "checked").otherwise("skiped"), F.coalesce(x["support_ions"], none), F.coalesce(x["support_intensity"], zero), F.coalesce(x["flanking_ions_support"], F.lit("NO")), F.coalesce(x["flanking_ions"], none), F.coalesce(x["flanking_intensity"], zero), F.coalesce(F.array_join(F.array_distinct(F.transform("_ions", lambda i: i["ion"])), ","), none), F.coalesce(F.aggregate("_ions", zero, lambda a, i: a + i["intensity"]), zero), F.coalesce("_sum.sum", zero), F.coalesce("_sum.median", zero))
        got = OS.inspect_spectra(psms, spectra, tolerance, relative, charge).select(*told)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
        joined = psms.join(spectra, ["file", "scan"])
        each = OS.match_fragments(joined, charge).select("sequence", F.inline(OS.matched("_ions", tolerance, relative))).select("sequence", "ion", "z", "mz", "error", "intensity")
        assert sorted(map(repr, map(tuple, OS.matched_fragments(joined, tolerance, relative, charge).collect()))) == sorted(map(repr, map(tuple, each.collect())))


def test_frame_0_alone_equals_the_general_reader(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ACGTUNacgtRY-é") for _ in range(n)),) for n in [*range(12), 300]] + [(None,)]
    df = spark.createDataFrame(rows, "s string").coalesce(1)
    got = df.select(S.translate(F.col("s")), S.translate_by(F.col("s"), F.lit(False))).collect()
    assert [r[0] for r in got] == [r[1] for r in got] and got[-1][0] is None


def test_census_proteins_translate_once(spark):
    """A gene is translated before the join and a changed sequence once, not again in the filter."""
    import re

    from ribospark.operators.somatic import census_proteins

    genes = spark.createDataFrame([("g", "ATGAAATTTCCC", 2), ("g", "ATGCAATTTCCC", 1), ("h", "ATG", 1)], "id string, seq string, ord long")
    rows = [("g", "c.4A>C", "p.K2Q", "Substitution - Missense", "x", 1), ("g", "c.4C>A", "p.Q2K", "Substitution - Missense", "x", 2), ("g", "c.?", "p.K2*", "Substitution - Nonsense", "y", 3), ("h", "c.9A>C", "p.K2Q", "Substitution - Missense", "x", 4), ("h", "c.1A>C", "p.M1L", "Substitution - coding silent", "x", 5)]
    made = census_proteins(spark.createDataFrame(rows, "gene string, dna_mut string, aa_mut string, mutation_type string, group string, ord long"), genes)
    got = {r["ord"]: (r["header"], r["seq"], r["group"]) for r in made.collect()}
    assert got == {1: ("COSMIC:g:p.K2Q:Substitution-Missense", "MQFP", "x"), 2: ("COSMIC:g:p.Q2K:Substitution-Missense", "MKFP", "x"), 3: ("COSMIC:g:p.K2*:Substitution-Nonsense", "M", "y")}
    evaluated = re.findall(r"ArrowEvalPython .*, \[(pythonUDF[^\]]*)\]", made._jdf.queryExecution().optimizedPlan().toString())
    assert sum(x.count("pythonUDF") for x in evaluated) == 2
