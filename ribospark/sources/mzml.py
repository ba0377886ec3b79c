"""mzML spectra: the XML reader splits spectra, an Arrow function decodes their binary arrays."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

# Controlled-vocabulary accessions of binary arrays.
MZ_ARRAY, INTENSITY_ARRAY, ZLIB, FLOAT64, FLOAT32 = "MS:1000514", "MS:1000515", "MS:1000574", "MS:1000523", "MS:1000521"
PEAKS = "peaks array<struct<mz: double, intensity: double>>"
_SCHEMA = "_id string, binaryDataArrayList struct<binaryDataArray array<struct<cvParam array<struct<_accession string>>, binary string>>>"


def decode_array(text: str, accessions: list[str]) -> np.ndarray:
    """The numbers of a binary array."""
    data = base64.b64decode(text or "")
    if ZLIB in accessions:
        data = zlib.decompress(data)
    return np.frombuffer(data, "<f8" if FLOAT64 in accessions else "<f4").astype(np.float64)


def write_indexed_mzml(spectra: DataFrame, folder: str) -> DataFrame:
    """The spectra (scan, peaks) of each partition as one indexed mzML file of the folder; returns (file, scan) of what was written.

    A file is written under another name and renamed when it is whole, so a task that is tried
    again replaces it.
    """
    from pyarrow import fs

    def array(values: np.ndarray, accession: str) -> str:
        data = base64.b64encode(zlib.compress(values.astype("<f8").tobytes())).decode()
        terms = "".join(f'<cvParam cvRef="MS" accession="{a}" name=""/>' for a in (accession, FLOAT64, ZLIB))
        return f'<binaryDataArray encodedLength="{len(data)}">{terms}<binary>{data}</binary></binaryDataArray>'

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        name, hidden = f"part-{context.partitionId():05d}.mzML", f"{base}/.part-{context.partitionId():05d}-{context.taskAttemptId()}"
        places: list[tuple[str, int]] = []
        with store.open_output_stream(hidden, compression=None) as out:
            out.write(b'<?xml version="1.0" encoding="utf-8"?>\n<indexedmzML><mzML><run><spectrumList>\n')
            for b in batches:
                for scan, peaks in zip(b.column("scan").to_pylist(), b.column("peaks").to_pylist()):
                    key = f"controllerType=0 controllerNumber=1 scan={scan}"
                    places.append((key, out.tell()))
                    arrays = [array(np.array([p[k] for p in peaks or []]), a) for k, a in (("mz", MZ_ARRAY), ("intensity", INTENSITY_ARRAY))]
                    out.write(f'<spectrum id="{key}"><binaryDataArrayList count="2">{"".join(arrays)}</binaryDataArrayList></spectrum>\n'.encode())
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows, pa.string()), b.column("scan").cast(pa.int32())], names=["file", "scan"])
            out.write(b"</spectrumList></run></mzML>\n")
            start = out.tell()
            out.write(b'<indexList count="1"><index name="spectrum">\n' + b"".join(f'<offset idRef="{k}">{p}</offset>\n'.encode() for k, p in places) + f"</index></indexList>\n<indexListOffset>{start}</indexListOffset></indexedmzML>\n".encode())
        store.move(hidden, f"{base}/{name}")

    return spectra.select("scan", "peaks").mapInArrow(write, "file string, scan int")


def read_mzml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, scan and peaks (mz, intensity) of all spectra; the scan is the last number of the spectrum's id.

    The peaks of a spectrum whose arrays can't be decoded are null.
    """
    raw = spark.read.schema(_SCHEMA).option("rowTag", "spectrum").xml(path)
    arrays = raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.regexp_extract("_id", r"(\d+)$", 1).try_cast("int").alias("scan"), F.col("binaryDataArrayList.binaryDataArray").alias("arrays"))
    peak = pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for entry in b.column("arrays").to_pylist():
                found: dict[str, np.ndarray] = {}
                try:
                    for a in entry or []:
                        names = [c["_accession"] for c in a["cvParam"] or []]
                        for key in (MZ_ARRAY, INTENSITY_ARRAY):
                            if key in names:
                                found[key] = decode_array(a["binary"], names)
                except (ValueError, zlib.error):  # not base64, not compressed, or a broken number
                    out.append(None)
                    continue
                out.append([{"mz": m, "intensity": i} for m, i in zip(found.get(MZ_ARRAY, np.empty(0)).tolist(), found.get(INTENSITY_ARRAY, np.empty(0)).tolist())])
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("scan"), pa.array(out, peak)], names=["file", "scan", "peaks"])

    return arrays.mapInArrow(decode, f"file string, scan int, {PEAKS}")
