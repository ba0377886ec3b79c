"""Block-gzip files in runs and by region, and files under their own names."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from ribospark.sources import blockgzip as Z
from ribospark.sources import flatfiles, named


def _variants(n=4000):
    rng = random.Random(6)
    rows = sorted((rng.choice(["1", "2", "X"]), rng.randrange(1, 3_000_000), f"v{k}", "A" * rng.choice([1, 1, 1, 5, 40_000 if k % 500 == 0 else 2])) for k in range(n))
    return [(c, p, i, r, "C", ".", "PASS", "AF=0.1") for c, p, i, r in rows]


def _block_file(path, rows, sizes):
    """A file whose blocks have the given sizes in turn, empty ones among them."""
    text = ("##fileformat=VCFv4.2\n##INFO=x\n#CHROM\tPOS\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows)).encode()
    out, at, k = b"", 0, 0
    while at < len(text):
        size = sizes[k % len(sizes)]
        out += Z.pack(text[at : at + size])
        at, k = at + size, k + 1
    path.write_bytes(out + Z.END_BLOCK)
    return text


@pytest.mark.parametrize("sizes", [[65280], [100, 0, 7, 1], [1000, 3333, 0, 0, 17]])
def test_runs_have_each_line_once(tmp_path, sizes):
    text = _block_file(tmp_path / "v.vcf.gz", _variants(300)[:120], sizes)
    assert gzip.decompress((tmp_path / "v.vcf.gz").read_bytes()) == text and Z.is_block_gzip(str(tmp_path / "v.vcf.gz"))
    size = os.path.getsize(tmp_path / "v.vcf.gz")
    want = text.decode().split("\n")[:-1]
    for step in (size, size // 3 + 1, 999, 61):
        got = [line.decode() for at in range(0, size, step) for _, _, line in Z.run_lines(Z.Run(str(tmp_path / "v.vcf.gz"), at, min(at + step, size)))]
        assert got == want
    plain = tmp_path / "p.vcf.gz"
    plain.write_bytes(gzip.compress(text))
    assert not Z.is_block_gzip(str(plain)) and not Z.is_block_gzip(str(tmp_path / "none"))


def test_variants_by_region(spark, tmp_path):
    path, rows = tmp_path / "v.vcf.gz", _variants()
    _block_file(path, rows, [5000, 0, 20_000])
    header, records = flatfiles.read_vcf(spark, str(path))
    assert header == ["##fileformat=VCFv4.2", "##INFO=x"] and records.rdd.getNumPartitions() >= 1
    fine = Z.read_variants(spark, str(path), 4000)
    assert fine.rdd.getNumPartitions() > 5
    key = lambda df: [tuple(r) for r in df.orderBy("ord").select("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info").collect()]
    assert key(fine) == rows and key(records) == rows
    index = Z.index_of(fine)
    (tmp_path / "v.vcf.gz.tbi").write_bytes(Z.packed(index.to_bytes()) + Z.END_BLOCK)
    assert Z.read_index(str(path)) == index
    for chrom, low, high in (("2", 1_000_000, 1_020_000), ("X", 1, 50), ("1", 2_990_000, 4_000_000), ("none", 1, 9), ("2", 7, 6)):
        reader = Z.VariantReader(str(path), 4000)
        asked = [Z.EqualTo(("chrom",), chrom), Z.GreaterThanOrEqual(("pos",), low), Z.LessThanOrEqual(("pos",), high)]
        assert list(reader.pushFilters(asked)) == asked
        want = [r for r in rows if r[0] == chrom and low <= r[1] <= high]
        found = [r for run in reader.partitions() for b in reader.read(run) for r in b.to_pylist()]
        assert [(r["chrom"], r["pos"]) for r in found if r["chrom"] == chrom and low <= r["pos"] <= high] == [r[:2] for r in want]
        assert len({r["ord"] for r in found}) == len(found) < len(rows) / 4  # no line twice, few blocks read
        assert key(fine.filter((F.col("chrom") == chrom) & F.col("pos").between(low, high))) == want
    assert key(fine.filter("chrom in ('1', 'X') and pos > 2900000")) == [r for r in rows if r[0] in "1X" and r[1] > 2_900_000]


def test_written_block_gzip_with_index(spark, tmp_path):
    rows = _variants(900)
    lines = spark.createDataFrame([(k, "\t".join(map(str, r))) for k, r in enumerate(rows)], "k long, value string").repartitionByRange(4, "k").sortWithinPartitions("k")
    path = Z.write_block_gzip(lines, f"file://{tmp_path}/out", "v.vcf.gz")
    assert os.listdir(tmp_path / "out") == ["v.vcf.gz"]
    index = Z.write_index(spark, path)
    assert Z.read_index(path) == index and list(index.bins) == ["1", "2", "X"]
    got = flatfiles.read_vcf(spark, path)[1].filter("chrom = '2' and pos <= 500000").orderBy("ord").select("pos", "id").collect()
    assert [tuple(r) for r in got] == [r[1:3] for r in rows if r[0] == "2" and r[1] <= 500_000]


def test_named_files(spark, tmp_path):
    rows = [(k, f"g{k % 3}.fa", f">h{k}\n" + "ACGT" * (k % 50)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, f string, v string").repartitionByRange(6, "k").sortWithinPartitions("k")
    for blocks in (False, True):
        folder = tmp_path / f"out-{blocks}"
        named.write_named(df, str(folder), F.col("f"), F.col("v"), blocks)
        assert sorted(os.listdir(folder)) == ["g0.fa", "g1.fa", "g2.fa"]
        for k in range(3):
            data = (folder / f"g{k}.fa").read_bytes()
            assert (gzip.decompress(data) if blocks else data).decode() == "".join(v + "\n" for _, f, v in rows if f == f"g{k}.fa")
    broken = df.withColumn("f", F.when(F.col("k") == 2999, F.lit("a/b")).otherwise(F.col("f")))
    with pytest.raises(Exception):
        named.write_named(broken, str(tmp_path / "broken"), F.col("f"), F.col("v"))
    assert os.listdir(tmp_path / "broken") == []
