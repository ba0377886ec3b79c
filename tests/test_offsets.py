"""Records and spectra by their places."""

import pytest
from pyspark.sql import functions as F

from ribospark.sources import mzml, offsets


def test_fasta_records_by_place(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(1)
    folder = tmp_path / "fa"
    folder.mkdir()
    want = {}
    for k in range(2):
        text = "; a comment\n" if k else ""
        for i in range(60):
            seq = "".join(rng.choices("ACDEFGHIK>", k=rng.randint(0, 90)))
            key, about = f"p{k}_{i}", rng.choice(["", " some > words", " x" * 200])
            want[key] = (f"{key}{about}".strip(), seq)
            text += f">{key}{about}\r\n" + "".join(f"{seq[a : a + 20].lstrip('>') if seq[a : a + 1] == '>' else seq[a : a + 20]}\n" for a in range(0, len(seq), 20))
            want[key] = (want[key][0], "".join(seq[a : a + 20].lstrip(">") if seq[a : a + 1] == ">" else seq[a : a + 20] for a in range(0, len(seq), 20)))
        (folder / f"{k}.fa").write_bytes(text.encode())
    for read in (1 << 20, 5000):
        monkeypatch.setattr(offsets, "READ", read)
        for run in (1 << 20, 777, 50):
            table = offsets.fasta_offsets(spark, str(folder), run)
            rows = table.collect()
            assert sorted(r["id"] for r in rows) == sorted(want)
            if run == 50:
                continue
            asked = spark.createDataFrame([("p0_3",), ("p1_59",), ("p1_59",), ("none",), ("p0_0",)], "id string")
            got = {r["id"]: (r["description"], r["seq"]) for r in offsets.fetch_records(asked, table).collect()}
            assert got == {k: want[k] for k in ("p0_3", "p1_59", "p0_0")}
    again = table.unionByName(table.filter("id = 'p0_3'"))
    with pytest.raises(Exception, match="duplicate id p0_3"):
        offsets.fetch_records(spark.createDataFrame([("p0_3",)], "id string"), again).collect()


def test_spectra_by_scan(spark, tmp_path, monkeypatch):
    rows = [(k, [(100.0 + j, float(k * j)) for j in range(k % 4)]) for k in range(40)]
    df = spark.createDataFrame(rows, "scan int, peaks array<struct<mz: double, intensity: double>>").repartition(3)
    written = [tuple(r) for r in mzml.write_indexed_mzml(df, str(tmp_path / "m")).collect()]
    assert sorted(s for _, s in written) == list(range(40))
    asked = [w for w in written if w[1] % 9 == 0] + [("gone.mzML", 1), (written[0][0], 999), (None, 3)]
    got = offsets.fetch_spectra(spark.createDataFrame(asked, "file string, scan int"), str(tmp_path / "m")).collect()
    assert sorted((r["scan"], [tuple(p) for p in r["peaks"]]) for r in got if r["scan"] is not None) == [r for r in rows if r[0] % 9 == 0]
    assert {r["file"] for r in got if r["scan"] is None} == {f for f, s in asked if f and f != "gone.mzML"}
    with offsets.open_file(f"{tmp_path}/m/{written[0][0]}") as f:
        indexed = offsets.spectrum_offsets(f)
        for read in (1 << 20, 70_000, 300):
            monkeypatch.setattr(offsets, "READ", read)
            f.seek(0)
            assert {s: p for s, (p, _) in offsets.scanned_offsets(f).items()} == {s: p for s, (p, _) in indexed.items()}
    whole = mzml.read_mzml(spark, str(tmp_path / "m")).filter(F.col("scan") == 7).first()  # the plain reader takes the same files
    assert [tuple(p) for p in whole["peaks"]] == rows[7][1]
    (tmp_path / "plain.mzML").write_text("<mzML></mzML>")
    assert offsets.fetch_spectra(spark.createDataFrame([("plain.mzML", 1)], "file string, scan int"), str(tmp_path)).collect() == []
