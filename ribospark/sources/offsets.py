"""Records of large files by their places: FASTA records by id and spectra by scan, read as just the bytes asked for.

A FASTA file is scanned once, in many tasks, for where its records begin; the table of places
can be kept. An indexed mzML file has such a table at its end. Asked records are then fetched
by ranged reads, in the order of their places, so what is read grows with what is asked.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.sources.blockgzip import open_file
from ribospark.sources.mzml import INTENSITY_ARRAY, MZ_ARRAY, PEAKS, decode_array

#: Bytes of a task's part of a scan, and of one read.
RUN_BYTES, READ = 64 << 20, 1 << 20


def files_under(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder that aren't hidden."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(name))
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _runs(spark: SparkSession, files: list[tuple[str, int]], run_bytes: int) -> DataFrame:
    runs = [(path, at, min(at + run_bytes, size)) for path, size in files for at in range(0, size, run_bytes)]
    return spark.createDataFrame(runs, "file string, start long, stop long").repartition(max(1, min(len(runs), 10_000)), "file", "start")


def _starts(f, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, first bytes) of the FASTA records that begin in [start, stop), and (offset, b"") of where the last of them ends."""
    f.seek(max(0, start - 1))
    at, text, open_record = max(0, start - 1), b"\n" if start == 0 else b"", False
    base = at - len(text)
    while True:
        more = f.read(READ)
        text += more
        found = 0
        for m in re.finditer(rb"(?<=\n)>", text):
            place = base + m.start()
            head = text[m.start() : m.start() + 4096]
            if b"\n" not in head and more and len(head) < 4096:
                break  # its first line isn't whole yet
            found = m.start() + 1
            if place >= stop:
                if open_record:
                    yield place, b""
                return
            if place >= start:
                yield place, head
                open_record = True
        if not more:
            if open_record:
                yield base + len(text), b""
            return
        if not open_record and base + len(text) > stop + 1:
            return
        keep = max(found, len(text) - 4096, 1)
        base, text = base + keep - 1, text[keep - 1 :]


def fasta_offsets(spark: SparkSession, path: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(id, file, offset, length) of all records of a FASTA file or folder, found in one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                with open_file(file) as f:
                    found = list(_starts(f, start, stop))
                ids = [(head[1:].split(b"\n", 1)[0].split() or [b""])[0].decode("utf-8", "replace") for _, head in found[:-1]]
                places = [p for p, _ in found]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([file] * n, pa.string()), pa.array(places[:-1], pa.int64()), pa.array(np.diff(places), pa.int64())], names=["id", "file", "offset", "length"])

    return _runs(spark, files_under(path), run_bytes).mapInArrow(scan, "id string, file string, offset long, length long")


def fetch_records(asked: DataFrame, offsets: DataFrame) -> DataFrame:
    """(id, description, seq) of the asked ids (a column ``id``); an id that several records have is an error when it is met."""
    once = offsets.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("file").alias("file"), F.first("offset").alias("offset"), F.first("length").alias("length"))
    found = asked.select("id").distinct().join(once, "id")
    found = found.withColumn("id", F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("duplicate id "), "id"))))
    near = found.select("id", "file", "offset", "length").repartition("file", F.floor(F.col("offset") / RUN_BYTES)).sortWithinPartitions("file", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = name = None
        for b in batches:
            ids, descriptions, seqs = [], [], []
            for key, file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    f, name = open_file(file), file
                head, _, body = f.read_at(length, offset)[1:].decode("utf-8", "replace").replace("\r", "").partition("\n")
                ids.append(key)
                descriptions.append(head.strip())
                seqs.append("".join(body.split()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, descriptions, seqs)], names=["id", "description", "seq"])

    return near.mapInArrow(fetch, "id string, description string, seq string")


def spectrum_offsets(f) -> dict[int, tuple[int, int]] | None:
    """Scan -> (offset, length of the element and what follows up to the next) from an mzML file's own index; None without one."""
    size = f.size()
    tail = f.read_at(min(size, 4096), max(0, size - 4096))
    told = re.search(rb"<indexListOffset>(\d+)</indexListOffset>", tail)
    if not told:
        return None
    index = f.read_at(size - int(told[1]), int(told[1]))
    spectra = re.search(rb'<index name="spectrum">(.*?)</index>', index, re.S)
    places = sorted((int(m[2]), m[1].decode("utf-8", "replace")) for m in re.finditer(rb'<offset idRef="([^"]*)"[^>]*>(\d+)</offset>', spectra[1] if spectra else b""))
    ends = [p for p, _ in places[1:]] + [int(told[1])]
    out = {}
    for (place, name), end in zip(places, ends):
        scan = re.search(r"(\d+)$", name)
        if scan:
            out[int(scan[1])] = (place, end - place)
    return out


def scanned_offsets(f) -> dict[int, tuple[int, int]]:
    """The same from one pass over a file without an index."""
    places, base, text = [], 0, b""
    f.seek(0)
    while True:
        more = f.read(READ)
        text += more
        last = 0
        for m in re.finditer(rb"<spectrum\s[^>]*>", text):
            name = re.search(rb'\sid="[^"]*?(\d+)"', m[0])
            places.append((base + m.start(), int(name[1]) if name else -1))
            last = m.end()
        if not more:
            break
        keep = max(last, len(text) - 65_536)
        base, text = base + max(keep, 0), text[max(keep, 0) :]
    ends = [p for p, _ in places[1:]] + [base + len(text)]
    return {scan: (place, end - place) for (place, scan), end in zip(places, ends) if scan >= 0}


def _peaks(element: bytes) -> list[dict] | None:
    """The peaks of one spectrum element, None if they can't be decoded."""
    end = element.find(b"</spectrum>")
    try:
        tree = ElementTree.fromstring(element[: end + len(b"</spectrum>")])
        found = {}
        for a in tree.iter("binaryDataArray"):
            names = [c.get("accession") for c in a.iter("cvParam")]
            for key in (MZ_ARRAY, INTENSITY_ARRAY):
                if key in names:
                    found[key] = decode_array(a.findtext("binary"), names)
        return [{"mz": m, "intensity": i} for m, i in zip(found.get(MZ_ARRAY, np.empty(0)).tolist(), found.get(INTENSITY_ARRAY, np.empty(0)).tolist())]
    except (ElementTree.ParseError, ValueError, zlib.error):
        return None


def fetch_spectra(asked: DataFrame, folder: str) -> DataFrame:
    """(file, scan, peaks) of the asked (file, scan) pairs that mzML files of a folder hold.

    Of a file with an index only the index and the asked spectra are read (and the
    first ones, until one can be decoded: such a file also gives a row without a scan).
    """
    kind = pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())]))
    near = asked.select("file", "scan").filter("file is not null and scan is not null").distinct().repartition("file", F.floor(F.col("scan") / 10_000)).sortWithinPartitions("file", "scan")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, name, places = None, None, {}
        for b in batches:
            out: list[tuple] = []
            for file, scan in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    name, f, places = file, None, {}
                    try:
                        f = open_file(f"{folder.rstrip('/')}/{file}")
                        places = spectrum_offsets(f) or scanned_offsets(f)
                    except (FileNotFoundError, pa.ArrowException):
                        pass
                    if any(_peaks(f.read_at(size, at)) is not None for at, size in places.values()):
                        out.append((file, None, []))
                if scan in places:
                    offset, length = places[scan]
                    out.append((file, scan, _peaks(f.read_at(length, offset))))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], kind)], names=["file", "scan", "peaks"])

    return near.mapInArrow(fetch, f"file string, scan int, {PEAKS}")
