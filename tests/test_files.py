"""Sources, sinks, operators and streams on small files."""

import base64
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from ribospark.operators import genome, intervals, peptides, proteins, variant_proteins
from ribospark.sources import fetch_plan, flatfiles, mzml, sinks, tables
from ribospark.streaming import variants as streams


def _write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_fasta_round_trip(spark, tmp_path):
    src = _write(tmp_path / "a.fa", ">x one two\r\nACG\r\nT\r\n>y\nGG\n")
    rows = flatfiles.read_fasta(spark, src).orderBy("ord").collect()
    assert [(r["id"], r["description"], r["seq"]) for r in rows] == [("x", "x one two", "ACGT"), ("y", "y", "GG")]
    sinks.write_fasta(flatfiles.read_fasta(spark, src), str(tmp_path / "out"), single=True, order="ord")
    again = flatfiles.read_fasta(spark, str(tmp_path / "out")).orderBy("ord").collect()
    assert [(r["id"], r["seq"]) for r in again] == [("x", "ACGT"), ("y", "GG")]


def test_vcf_and_gtf(spark, tmp_path):
    header, rows = flatfiles.read_vcf(spark, _write(tmp_path / "a.vcf", "##INFO=<ID=CSQ>\n#CHROM\n1\t3\trs1\tA\tC\t.\tPASS\tAF=0.2\n\n1\t99\t.\tA\tN,G\t.\t.\tDB\n"))
    assert header == ["##INFO=<ID=CSQ>"] and [r["pos"] for r in rows.orderBy("ord").collect()] == [3, 99]
    gtf = flatfiles.read_gtf(spark, _write(tmp_path / "a.gtf", '#!x\n1\ts\tCDS\t1\t50\t.\t+\t0\tgene_id "g"; transcript_id "t1"; tag "a";\n1\ts\texon\t1\t60\t.\t+\t.\ttranscript_id "t1";\n'))
    assert flatfiles.coding_blocks(gtf).collect()[0]["transcript_id"] == "t1"
    found = flatfiles.annotate_overlaps(rows, gtf).orderBy("ord").collect()
    assert [r["info"] for r in found] == ["AF=0.2;transcriptOverlaps=t1", "DB"]  # records without overlap stay as they are
    kept = variant_proteins.filter_variants(rows, ["PASS"], af_key="AF", af_threshold=0.1)
    assert [(r["pos"], r["alt"]) for r in kept.collect()] == [(3, "C")]
    assert {(r["pos"], r["alt"]) for r in variant_proteins.filter_variants(rows).collect()} == {(3, "C"), (99, "G")}


def test_tables(spark, tmp_path):
    census = _write(tmp_path / "c.tsv", "Gene name\tAccession Number\tMutation CDS\tMutation AA\tMutation Description\tPrimary site\nGé\tE1\tc.1A>G\tp.M1V\tSubstitution - Missense\tlung\nshort\n", "latin-1")
    rows = tables.read_census(spark, census, "Primary site").collect()
    assert [(r["gene"], r["group"]) for r in rows] == [("Gé", "lung")]
    with pytest.raises(ValueError, match="missing required"):
        tables.read_census(spark, _write(tmp_path / "bad.tsv", "a\tb\n"))
    samples = tables.read_samples(spark, _write(tmp_path / "s.txt", "#c\nPATIENT_ID\tSAMPLE_ID\tCANCER_TYPE\np\ts1\tBreast Cancer\n"), "CANCER_TYPE").collect()
    assert [tuple(r) for r in samples] == [("s1", "Breast_Cancer")]
    with pytest.raises(ValueError):
        tables.read_psms(spark, "x.txt")
    peps = tables.read_peptides(spark, _write(tmp_path / "p.tsv", "pep\tprot\nK.PEP+16\tA;B\n")).collect()
    assert [(r["peptide"], r["protein"]) for r in peps] == [("KPEP", "A")]


def test_mzml(spark, tmp_path):
    def array(values, names, packed):
        data = struct.pack(f"<{len(values)}d", *values)
        data = base64.b64encode(zlib.compress(data) if packed else data).decode()
        return f"<binaryDataArray>{''.join(f'<cvParam accession={chr(34)}{n}{chr(34)}/>' for n in names)}<binary>{data}</binary></binaryDataArray>"

    xml = f'<mzML><spectrumList><spectrum id="controllerType=0 scan=17"><binaryDataArrayList count="2">{array([100.5, 200.25], [mzml.MZ_ARRAY, mzml.FLOAT64, mzml.ZLIB], True)}{array([3.0, 4.0], [mzml.INTENSITY_ARRAY, mzml.FLOAT64], False)}</binaryDataArrayList></spectrum></spectrumList></mzML>'
    row = mzml.read_mzml(spark, _write(tmp_path / "f.mzML", xml)).first()
    assert (row["file"], row["scan"], [tuple(p) for p in row["peaks"]]) == ("f.mzML", 17, [(100.5, 3.0), (200.25, 4.0)])


def test_interval_join_counts_a_pair_once(spark):
    import random

    rng = random.Random(8)

    def some(n):
        sizes = [0, 1, 30, 16_383, 16_384, 200_000, 2_000_000, 70_000_000, 248_956_422]
        starts = [(rng.randrange(0, 249_000_000), rng.choice(sizes)) for _ in range(n)] + [(1, 248_956_422), (16_383, 1), (16_384, 0), (2**26 - 1, 1)]
        return [(k, rng.choice("12"), s, s + w) for k, (s, w) in enumerate(starts)] + [(None, None, 5, 6), (n + 9, "1", None, 7)]

    left, right = some(150), some(150)
    a = spark.createDataFrame(left, "k int, chrom string, start long, end long")
    b = spark.createDataFrame(right, "j int, c string, s long, e long")
    got = intervals.interval_join(a, b, chrom="c", start="s", end="e").select("k", "j").collect()
    want = [(x[0], y[0]) for x in left for y in right if x[1] and x[1] == y[1] and None not in x[1:] + y[1:] and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000
    spread = a.select(intervals.F.size(intervals._bins(intervals.F.col("start"), intervals.F.col("end"))).alias("n")).agg({"n": "max"}).first()[0]
    assert spread <= 6


def _shuffled(spark):
    """Bytes that all stages of the session have shuffled so far."""
    jvm = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("kind", ["string", "int"])
def test_interval_join_shuffles_short_intervals_once(spark, kind):
    """A right row goes to its own bin alone where no left row's own bin is larger; names of another type meet all the same."""
    b = spark.range(0, 20_000, 1, 2).select((F.col("id") % 3).cast(kind).alias("c"), (F.col("id") * 1000).alias("s"), (F.col("id") * 1000 + 50).alias("e"), F.concat(*(F.sha2(F.concat("id", F.lit(str(k))), 256) for k in range(4))).alias("load")).localCheckpoint()
    a = spark.range(0, 300, 1, 2).select("id", (F.col("id") % 3).cast("string").alias("chrom"), (F.col("id") * 60_000 + 20).alias("start"), (F.col("id") * 60_000 + F.when(F.col("id") % 7 == 0, 2000).otherwise(21)).alias("end")).localCheckpoint()
    threshold, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), _shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        got = intervals.interval_join(a, b, chrom="c", start="s", end="e").select("id", "s", "load").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert _shuffled(spark) - before < 2 * 20_000 * 256
    near = [(x["id"], s, x) for x in a.collect() for s in range(x["start"] // 1000 * 1000 - 1000, x["end"] + 1, 1000)]
    assert sorted((r["id"], r["s"]) for r in got) == sorted((i, s) for i, s, x in near if 0 <= s < 20_000_000 and x["chrom"] == str(s // 1000 % 3) and x["start"] <= s + 50 and s <= x["end"])


def test_variants_meet_only_blocks_of_transcripts_with_a_sequence(spark, tmp_path):
    """Blocks that can make no protein are left out before the interval join, and no pair of the others is lost."""
    from ribospark.plans import bridges as B
    from ribospark.plans import queries as Q

    d = str(tmp_path)
    spark.createDataFrame([(n, "acgt" * 200) for n in range(0, 60, 2)] + [(None, "x")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(o, k, (o or 0) + 7 * k + j) for o in [*range(100), None] for k in range(1, 5) for j in (0, 90)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(n, n * 7 % 24, "view") for n in range(20_000)], "event_id long, user_id long, event_type string").write.parquet(f"{d}/events.parquet")
    every = [tuple(r) for r in Q._met(spark, d).select("ord", "transcript_id").distinct().collect()]
    sequenced = {str(n) for n in range(0, 60, 2)}
    got = [tuple(r) for r in Q._met(spark, d, Q._sequenced(spark, d)).select("ord", "transcript_id").distinct().collect()]
    assert sorted(got) == sorted(x for x in every if x[1] in sequenced) and 0 < len(got) < len(every)
    assert {r["transcript_id"] for r in Q._paired(spark, d).select("transcript_id").distinct().collect()} <= sequenced
    assert B.blocks(spark, d).filter("transcript_id is null").count() == 1  # all lines of no order are one block without a place


def test_peptides(spark):
    db = spark.createDataFrame([("p1", "MKVLSAGR"), ("p2", "AAMKVLSAGR"), ("p3", "TTTTT")], "id string, seq string")
    psms = spark.createDataFrame([("KVLS", "u1"), ("KILS", "u2"), ("WWWW", "u3")], "sequence string, usi string")
    got = {r["usi"]: (r["position"], r["variant"], r["proteins"]) for r in peptides.locate_peptides(psms, db).collect()}
    assert got == {"u1": ("canonical", None, None), "u2": ("2", "V>I", "p1,p2"), "u3": ("non-canonical", None, None)}


def test_peptide_queries_take_all_lengths(spark, tmp_path):
    """The queries over all digested peptides against plain loops: 7 to 40 residues, not one or two lengths."""
    from ribospark.functions.constants import RESIDUE_MASS
    from ribospark.plans import bridges as B
    from ribospark.plans import queries as Q

    words = "abcdefg hjklmnpq abcdefgi stabcdefgyz jklmnprstabcdefghabcdefgjklmnpo abcdefggi abcdffgi".split()
    texts = [" ".join(words[k % 7 :] + words[: k % 5]) + chr(97 + k) for k in range(12)] + [None, "abcdefgi"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, [0.1 * j for j in range(60)]) for k in range(3)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = str(tmp_path)
    seqs = {str(k): "".join(c for c in t or "" if c.isalpha()).translate(str.maketrans(B.LETTERS, B.RESIDUES)) for k, t in enumerate(texts)}
    digested = {p for s in seqs.values() for p in re.split("(?<=[KR])(?!P)", s) if 7 <= len(p) <= 40}
    swap = str.maketrans(B.FROM, B.TO)
    asked = digested | {p[: len(p) // 2 - 1] + p[len(p) // 2 - 1].translate(swap) + p[len(p) // 2 :] for p in digested}
    lengths = {len(p) for p in digested}
    assert min(lengths) < 10 and max(lengths) > 21 and len(lengths) > 4
    canonical = {p for p in asked if any(p in s for s in seqs.values())}
    assert {r["sequence"] for r in Q.peptide_containment_all(spark, d).collect()} == canonical
    found = {}
    for p in asked:
        for k, s in seqs.items():
            for at in range(len(s) - len(p) + 1):
                diff = [i for i in range(len(p)) if s[at + i] != p[i]]
                if len(diff) == 1:
                    found.setdefault((p, diff[0] + 1, f"{s[at + diff[0]]}>{p[diff[0]]}"), set()).add(k)
                    break
    want = {(*key, ",".join(sorted(ids))) for key, ids in found.items()}
    assert {tuple(r) for r in Q.one_mismatch_all(spark, d).select("sequence", "position", "variant", "proteins").collect()} == want and want
    located = {(p, "canonical", None, None) for p in canonical} | {(p, str(i), v, ids) for p, i, v, ids in want if p not in canonical}
    located |= {(p, "non-canonical", None, None) for p in asked - canonical - {w[0] for w in want}}
    assert {tuple(r) for r in Q.psm_locate_all(spark, d).select("sequence", "position", "variant", "proteins").collect()} == located
    ions = {(r["sequence"], r["ion"]): r["mz"] for r in Q.theoretical_ions_all(spark, d).collect()}
    assert set(ions) == {(p, f"{kind}{i}") for p in digested for kind in "by" for i in range(1, len(p) + 1)}
    assert all(abs(ions[p, f"b{len(p)}"] - sum(RESIDUE_MASS[c] for c in p) - 1.007276) < 0.001 for p in digested)
    assert {(r["sequence"], r["status"]) for r in Q.ion_support_all(spark, d).select("sequence", "status").collect()} >= {(p, "checked") for p in digested if len(p) > 21}
    assert {r["sequence"] for r in Q.ion_support_all(spark, d).collect()} == digested


def test_genome(spark):
    blocks = spark.createDataFrame([("t", "1", "+", 11, 16), ("t", "1", "+", 101, 130), ("m", "MT", "-", 11, 16), ("m", "MT", "-", 101, 130)], "transcript_id string, chrom string, strand string, start long, end long")
    peps = spark.createDataFrame([("KFP", "a", 1), ("KFP", "b", 2), ("PKF", "b", 3), ("XX", "a", 4)], "peptide string, protein string, ord long")
    ids = spark.createDataFrame([("g", "t", "a", 1), ("g", "m", "b", 2)], "gene string, transcript string, protein string, ord long")
    prots = spark.createDataFrame([("a", "MKFPKFPAAAAA", 1), ("b", "MKFPKFPAAAAA", 2)], "id string, seq string, ord long")
    got = {r["peptide"]: (r["chrom"], r["start"], r["end"], len(r["blocks"])) for r in genome.map_peptides(peps, ids, prots, blocks).collect()}
    assert got == {"KFP": ("1", 14, 106, 2), "PKF": ("MT", 113, 121, 1)}
    rows = genome.gff3_rows(genome.map_peptides(peps, ids, prots, blocks)).orderBy("peptide", "ord").collect()
    assert [(r["type"], r["start"], r["end"], r["phase"]) for r in rows if r["peptide"] == "KFP"] == [("mRNA", 14, 106, "."), ("CDS", 14, 16, "0"), ("CDS", 101, 106, ".")]
    assert {r["seqid"] for r in rows} == {"chr1", "chrM"}


def test_proteins(spark):
    db = spark.createDataFrame([("x", "x note", "MAAAAAAA*"), ("y", "y", "AA*CCCCCCCCC*DDDDDDDD")], "id string, description string, seq string")
    assert sorted((r["id"], r["seq"]) for r in proteins.check_proteins(db, True).collect()) == [("x", "MAAAAAAA"), ("y_codon_2", "CCCCCCCCC"), ("y_codon_3", "DDDDDDDD")]
    canon = spark.createDataFrame([("c", "MKAAAAAAAK")], "id string, seq string")
    mut = spark.createDataFrame([("COSMIC:G:p.A5V:Substitution-Missense", "MKAAVAAAAKAALAAAAK"), ("single", "AAIAAAAKAAAAAAAK")], "description string, seq string")
    got = {r["peptide"]: r["header"] for r in proteins.unique_variant_peptides(mut, canon).collect()}
    assert got == {"AAVAAAAK": "Mutation:G:p.A5V:Substitution-Missense:3", "AALAAAAK": "Mutation:G:p.A5V:Substitution-Missense:-5", "AAIAAAAK": "Mutation"}
    out = proteins.switched_decoys(spark.createDataFrame([("a", "ACDEFGHKLMNPQRSTVWYK"), ("b", "KFGHEDCAMMKK")], "id string, seq string")).collect()
    known = {r["peptide"] for r in proteins.digested(spark.createDataFrame([(r["id"], r["seq"]) for r in out if not r["is_decoy"]], "id string, seq string"), "Trypsin", 0, 5).collect()}
    made = {r["peptide"] for r in proteins.digested(spark.createDataFrame([(r["id"], r["seq"]) for r in out if r["is_decoy"]], "id string, seq string"), "Trypsin", 0, 5).collect()}
    assert made and not made & known


def test_fetch_plan():
    files = fetch_plan.genome_files("homo_sapiens", "GRCh38", 110, ("protein", "gtf", "vcf"))
    assert files[0][0].endswith("/release-110/fasta/homo_sapiens/pep/Homo_sapiens.GRCh38.pep.all.fa.gz")
    assert files[1][1] == "Homo_sapiens.GRCh38.110.gtf.gz"
    assert len(fetch_plan.genome_files("homo_sapiens", "GRCh38", 110, ("vcf",), per_chromosome=True)) == 25
    with pytest.raises(ValueError):
        fetch_plan.url_lines([("file:///etc/x", "x")], ".")


def test_streamed_filter(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "chrom string, pos long, ref string, alt string, filter string, info string, ts timestamp"
    rows = [("1", 5, "A", "C,<X>", "PASS", "AF=1"), ("1", 5, "A", "C", "PASS", "AF=1"), ("1", 6, "N", "C", "PASS", "AF=1")]
    spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, filter string, info string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.json(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in/*"))
    out = streams.distinct_within(streams.streamed_filter(stream), "ts")
    q = out.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["pos"], r["alt"]) for r in spark.table("kept").collect()] == [(5, "C")]


def test_counts_and_clinical_filter_on_streams(spark, tmp_path):
    """Late records count until the watermark passes; the clinical filter keeps no state."""
    rows = [("1", "2024-01-01 00:10:00", "CLNSIG=Pathogenic;MC=SO:1|missense_variant"), ("1", "2024-01-01 00:50:00", "CLNSIG=Benign;MC=SO:1|missense_variant"), ("2", "2024-01-01 01:10:00", "CLNSIG=Pathogenic;MC=SO:1|intron_variant")]
    schema = "chrom string, ts timestamp, pos long, ref string, alt string, info string"
    spark.createDataFrame(rows, "chrom string, ts string, info string").selectExpr("chrom", "cast(ts as timestamp) as ts", "5L as pos", "'A' as ref", "'C' as alt", "info").write.json(str(tmp_path / "in/a"))
    read = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in/*"))

    def run(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    counted = run(streams.windowed_counts(read(), "ts").select("window.start", "chrom", "n"), "counted", "complete")
    assert sorted((str(r["start"]), r["chrom"], r["n"]) for r in counted) == [("2024-01-01 00:00:00", "1", 2), ("2024-01-01 01:00:00", "2", 1)]
    kept = run(streams.streamed_clinical_filter(read(), ["Benign"], ["missense_variant"]), "clinical", "append")
    assert len(kept) == 1


def test_headers_bind_by_file(spark, tmp_path):
    (tmp_path / "d").mkdir()
    head = "PATIENT_ID\tSAMPLE_ID\tCANCER_TYPE\n"
    _write(tmp_path / "d/a.txt", head + "".join(f"p\ts{i}\tA\n" for i in range(50)))
    _write(tmp_path / "d/b.txt", "CANCER_TYPE\tSAMPLE_ID\nB\tt1\n" + head + "p\tt2\tC\n")
    rows = {r["sample"]: r["group"] for r in tables.read_samples(spark, str(tmp_path / "d"), "CANCER_TYPE").collect()}
    assert rows == {f"s{i}": "A" for i in range(50)} | {"t1": "B", "t2": "C"}


def test_duplicate_keys_of_an_index(spark, tmp_path):
    records = flatfiles.read_fasta(spark, _write(tmp_path / "a.fa", ">x\nA\n>x\nC\n>y\nG\n"))
    assert flatfiles.index_fasta(records.filter("id = 'y'")).collect()[0]["key"] == "y"
    with pytest.raises(Exception, match="duplicate key x"):
        flatfiles.index_fasta(records).collect()


def test_entry_and_oracles_agree_on_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_seed_search_equals_plain_loops(spark, monkeypatch):
    """Peptides shorter than a seed, longer than the compared stretch, repeated texts and letters of any kind."""
    import random

    from ribospark.operators import seeds

    rng = random.Random(3)
    texts = ["".join(rng.choices("ACDK", k=rng.randint(0, 300))) for _ in range(25)] + ["A" * 200, "A" * 90 + "C" + "A" * 90, "MÜX*" * 20, "", "ACDK" * 50]
    asked = {t[a : a + n] for t in texts for n in (1, 3, 6, 7, 8, 10, 13, 14, 15, 21, 40, 64, 65, 100) for a in rng.choices(range(max(1, len(t))), k=2)}
    asked |= {p[:k] + "W" + p[k + 1 :] for p in sorted(asked) for k in [rng.randrange(max(1, len(p)))]} | {"WWWWWWW", "", "MÜX*MÜXA"}
    db = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts + texts[:3])], "id string, seq string").repartition(4)
    peps = spark.createDataFrame([(p,) for p in sorted(asked)] + [(None,)], "sequence string")
    exact, changed = set(), set()
    for p in asked - {""}:
        found = {}
        for i, t in enumerate(texts + texts[:3]):
            if p in t:
                exact.add(p)
            for at in range(len(t) - len(p) + 1):
                diff = [k for k in range(len(p)) if t[at + k] != p[k]]
                if len(diff) == 1:
                    found.setdefault((diff[0] + 1, f"{t[at + diff[0]]}>{p[diff[0]]}"), set()).add(str(i))
                    break
        changed |= {(p, k, v, ",".join(sorted(ids))) for (k, v), ids in found.items()}
    monkeypatch.setattr(seeds, "SPAN", 100)
    assert {r[0] for r in peptides.contained_peptides(peps, db).collect()} == exact
    assert {tuple(r) for r in peptides.one_mismatch(peps, db).collect()} == changed
    for name in ("LEAST_BITS", "MOST_BITS"):  # a filter that knows everything, counts that tell nothing
        monkeypatch.setattr(seeds, name, 6)
    monkeypatch.setattr(seeds, "SLOTS", 1)
    assert {r[0] for r in peptides.contained_peptides(peps, db).collect()} == exact
    assert {tuple(r) for r in peptides.one_mismatch(peps.filter("length(sequence) < 20"), db).collect()} == {x for x in changed if len(x[0]) < 20}
    assert peptides.contained_peptides(peps.limit(0), db).collect() == [] and peptides.one_mismatch(peps, db.limit(0)).collect() == []


def test_order_and_headers_over_several_files(spark, tmp_path):
    """The first record is the first file's, whatever the files' sizes; each file's first line is its header."""
    (tmp_path / "in").mkdir()
    a = _write(tmp_path / "in" / "a.fa", ">x one\nAAA\n")
    b = _write(tmp_path / "in" / "b.fa", ">x two\n" + "CCC\n" * 5000 + ">y\nG\n")
    for path, want in ((str(tmp_path / "in"), ["AAA", "C" * 15_000, "G"]), ([b, a], ["C" * 15_000, "G", "AAA"]), ([a, b], ["AAA", "C" * 15_000, "G"])):
        assert [r["seq"] for r in flatfiles.read_fasta(spark, path).orderBy("ord").collect()] == want
    first = flatfiles.read_fasta(spark, [b, a]).groupBy("id").agg({"id": "count"}).collect()
    assert {r["id"]: r["count(id)"] for r in first} == {"x": 2, "y": 1}
    p = _write(tmp_path / "p.tsv", "pep\tprot\nKR\tA;B\n")
    q = _write(tmp_path / "q.tsv", "pep\tprot\n" + "LL\tC\n" * 3000)
    rows = tables.read_peptides(spark, [p, q]).orderBy("ord").collect()
    assert [(r["peptide"], r["protein"]) for r in rows] == [("KR", "A")] + [("LL", "C")] * 3000


def test_all_genetic_codes(spark):
    from ribospark.functions import sequences as S
    from ribospark.functions.constants import CODON_TABLES

    assert len(CODON_TABLES) == 27 and all(len(t) == 64 for t in CODON_TABLES.values())
    df = spark.createDataFrame([("CTGTGATAAAGGGGGCTA",)], "s string")
    got = {t: df.select(S.translate(F.col("s"), t)).first()[0] for t in (1, 10, 12, 13, 26, 33)}
    assert got == {1: "L**RGL", 10: "LC*RGL", 12: "S**RGL", 13: "LW*GGL", 26: "A**RGL", 33: "LWYKGL"}
    with pytest.raises(ValueError):
        S.translate(F.col("s"), 7)


def test_composition_report(spark):
    from ribospark.operators import proteins as PR

    db = spark.createDataFrame([("a", "AAAAAAKCCCCCCKGGGGGGK"), ("DECOY_a", "AAAAAAKCCCCCCGKGGGGGK")], "id string, seq string")
    lines = PR.composition_report(PR.decoy_composition(db).first().asDict())
    assert lines[:3] == ["target peptides: 2 (40.0 %)", "decoy peptides: 3 (60.0 %)", "peptides of both: 1 (20.0 %)"] and "residue A, target to decoy: 1.0" in lines


def test_fetching_in_threads_with_tries_and_files_instead(tmp_path):
    import http.server
    import threading
    import time

    asked = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            flaky = self.path.startswith("/flaky") and asked.count(self.path) < 3
            there = self.path.startswith(("/flaky", "/ok")) or "-chr" in self.path and "-chrMT" not in self.path
            self.send_response(503 if flaky else 200 if there else 404)
            self.end_headers()
            if there and not flaky:
                time.sleep(0.1)
                self.wfile.write(b"data")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert fetch_plan.fetch(f"{base}/flaky", f"{tmp_path}/f", pause=0.01) == f"{tmp_path}/f" and asked.count("/flaky") == 3
    assert fetch_plan.fetch(f"{base}/none", f"{tmp_path}/n", pause=5) is None and asked.count("/none") == 1
    began = time.perf_counter()
    files = [(f"{base}/ok{k}", f"ok{k}") for k in range(20)]
    assert fetch_plan.fetch_all(files, str(tmp_path), most=1000) == [(u, f"{tmp_path}/{n}") for u, n in files]
    assert time.perf_counter() - began < 1.5
    pace = fetch_plan.Pace(50)
    began = time.perf_counter()
    for _ in range(11):
        pace.wait()
    assert time.perf_counter() - began >= 0.19
    url = f"{base}/vcf/homo_sapiens_incl_consequences.vcf"
    found = fetch_plan.fetch_all([(url + ".gz", "v"), (f"{base}/ok1", "ok1")], str(tmp_path / "w"), instead=lambda u: [(x.removesuffix(".gz"), n.removesuffix(".gz")) for x, n in fetch_plan.by_chromosome(u)], most=1000)
    assert len(found) == 26 and found[0] == (url.replace(".vcf", "-chr1.vcf"), f"{tmp_path}/w/homo_sapiens_incl_consequences-chr1.vcf") and found[24][1] is None and found[25][1]
    server.shutdown()
