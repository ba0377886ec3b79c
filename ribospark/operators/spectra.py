"""PSMs against spectra."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.functions.constants import PROTON, RESIDUE_MASS, WATER
from ribospark.functions.spectra import intensity_summary, ppm

_ION = pa.struct([("mz", pa.float64()), ("ion", pa.string()), ("type", pa.string()), ("pos", pa.int32()), ("z", pa.int32()), ("error", pa.float64()), ("intensity", pa.float64())])
_ION_DDL = "array<struct<mz: double, ion: string, type: string, pos: int, z: int, error: double, intensity: double>>"


@cache
def _names(n: int, charge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ion, type, pos, z) of the b and y ladders of n residues for the charges up to ``charge``."""
    kinds = np.repeat(np.array(["b", "y"], object), n)
    places = np.tile(np.arange(1, n + 1, dtype=np.int32), 2)
    ions = np.array([f"{k}{p}" for k, p in zip(kinds, places)], object)
    return tuple(np.tile(x, charge) for x in (ions, kinds, places)) + (np.repeat(np.arange(1, charge + 1, dtype=np.int32), 2 * n),)


_MASSES = np.full(128, np.nan)
_MASSES[[ord(aa) for aa in RESIDUE_MASS]] = list(RESIDUE_MASS.values())


def ladder_masses(peptide: str, charge: int) -> np.ndarray:
    """m/z of b1..bL and y1..yL, then of their forms with more charges; NaN from an unknown residue on."""
    codes = np.frombuffer(peptide.encode("utf-32-le", "surrogatepass"), np.uint32)
    masses = _MASSES[np.minimum(codes, 127)]
    single = np.concatenate([masses.cumsum() + PROTON, masses[::-1].cumsum() + (PROTON + WATER)])
    return np.concatenate([(single + PROTON * (z - 1)) / z for z in range(1, charge + 1)])


def nearest_peaks(mz: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(error, index of the nearest peak) of each m/z; of equally near ones the first. Sorts the peaks once and looks at two for each m/z."""
    order = np.argsort(peaks, kind="stable")
    ascending = peaks[order]
    right = np.searchsorted(ascending, mz, side="left")  # the first of equal peaks
    left = np.searchsorted(ascending, ascending[np.maximum(right - 1, 0)], side="left")
    right = np.minimum(right, len(peaks) - 1)
    errors = np.abs(ascending[left] - mz), np.abs(ascending[right] - mz)
    take = (errors[0] < errors[1]) | ((errors[0] == errors[1]) & (order[left] < order[right]))
    return np.where(take, *errors), np.where(take, order[left], order[right])


def match_fragments(psms: DataFrame, charge: int = 1, name: str = "_ions") -> DataFrame:
    """The rows (sequence, peaks, ...) with the fragment ions of their peptide, by m/z, and the nearest peak of each.

    Rows without peaks or sequence have none; an ion with an unknown residue has no mass and is left out.
    """
    columns = psms.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            peaks, sequences = b.column("peaks"), b.column("sequence").to_pylist()
            offsets, there = peaks.offsets.to_numpy(), peaks.is_valid().to_numpy(zero_copy_only=False)
            all_mz, all_intensity = (peaks.values.field(k).to_numpy(zero_copy_only=False) for k in ("mz", "intensity"))
            sizes, parts = [0], []
            for k, sequence in enumerate(sequences):
                own = slice(offsets[k], offsets[k + 1])
                n = 0
                if sequence and there[k] and offsets[k] < offsets[k + 1]:
                    mz = ladder_masses(sequence, charge)
                    kept = np.flatnonzero(~np.isnan(mz))
                    ions, kinds, places, charges = (x[kept] for x in _names(len(sequence), charge))
                    mz = mz[kept]
                    order = np.lexsort([charges, ions.astype(str), mz])
                    if (n := len(order)):
                        error, at = nearest_peaks(mz[order], all_mz[own])
                        parts.append((mz[order], ions[order], kinds[order], places[order], charges[order], error, all_intensity[own][at]))
                sizes.append(n)
            joined = [np.concatenate(x) for x in zip(*parts)] or [[]] * _ION.num_fields
            made = pa.StructArray.from_arrays([pa.array(x, type=f.type) for x, f in zip(joined, _ION)], fields=list(_ION))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), made)], names=[*columns, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in psms.schema)
    return psms.mapInArrow(rows, f"{kinds}, `{name}` {_ION_DDL}")


def matched(ions: str, tolerance: float, relative: bool = False):
    """The ions of a column of ``match_fragments`` whose error (Da, or ppm) is under the tolerance."""
    return F.filter(F.transform(ions, lambda x: x.withField("ppm", ppm(x["error"], x["mz"]))), lambda x: (x["ppm"] if relative else x["error"]) < tolerance)


#: PSMs of one length that are worked on at a time.
_CHUNK = 2000


class _Ladder:
    """The ions of all peptides of n residues in the order of their names, then charges: one column for each."""

    def __init__(self, n: int, charge: int):
        names, kinds, places, charges = _names(n, charge)
        self.order = np.lexsort([charges, names.astype(str)])
        self.names, self.places, self.charges = pa.array(names[self.order], pa.string()), places[self.order], charges[self.order]
        self.b = kinds[self.order] == "b"

    def column(self, b: bool, place: np.ndarray) -> np.ndarray:
        """(PSMs, ions): whether an ion is the b (or y) ion of the PSM's place."""
        return (self.b == b) & (self.places == place[:, None])


_ladder = cache(_Ladder)


class _Peaks:
    """The peaks of a batch, ascending within each row, for searches of all rows at once."""

    def __init__(self, peaks: pa.ListArray):
        offsets = peaks.offsets.to_numpy()
        mz, intensity = (peaks.values.field(k).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] for k in ("mz", "intensity"))
        self.begin, self.end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        row = np.repeat(np.arange(len(peaks)), self.end - self.begin)
        same = row[1:] == row[:-1]
        self.order = np.arange(len(mz))
        if not (mz[1:] >= mz[:-1])[same].all():
            self.order = np.lexsort([mz, row])
        self.mz, self.intensity = mz[self.order], intensity[self.order]
        fresh = np.ones(len(mz), bool)
        fresh[1:] = ~same | (self.mz[1:] != self.mz[:-1])
        self.first = np.maximum.accumulate(np.where(fresh, np.arange(len(mz)), 0))  # of equal peaks of a row

    def nearest(self, rows: np.ndarray, mz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(error, intensity) of the nearest peak of each m/z (rows, ions), as in ``nearest_peaks``; every row has a peak."""
        begin, end = self.begin[rows][:, None], self.end[rows][:, None]
        low, high = np.broadcast_to(begin, mz.shape), np.broadcast_to(end, mz.shape)
        for _ in range(int((end - begin).max()).bit_length()):
            middle = (low + high) >> 1
            less = (low < high) & (self.mz[np.minimum(middle, end - 1)] < mz)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        left, right = self.first[np.maximum(low - 1, begin)], np.minimum(low, end - 1)
        errors = np.abs(self.mz[left] - mz), np.abs(self.mz[right] - mz)
        take = (errors[0] < errors[1]) | ((errors[0] == errors[1]) & (self.order[left] < self.order[right]))
        return np.where(take, *errors), self.intensity[np.where(take, left, right)]


def _under(error: np.ndarray, mz: np.ndarray, tolerance: float, relative: bool) -> np.ndarray:
    """Whether the error (Da, or ppm rounded half to even to two places) is under the tolerance."""
    if not relative:
        return error < tolerance
    value = error / mz * 1_000_000
    out = value < tolerance
    for at in zip(*np.nonzero(np.abs(value - tolerance) < 0.02)):  # where rounding may decide
        out[at] = float(Decimal(repr(float(value[at]))).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) < tolerance
    return out


def _found(batch: pa.RecordBatch, charge: int, tolerance: float, relative: bool) -> Iterator[tuple]:
    """(rows, ladder, m/z, error, intensity, whether matched, order by m/z) of the batch's PSMs with peaks, those of one length together."""
    sequences, peaks = batch.column("sequence"), batch.column("peaks")
    held = _Peaks(peaks)
    length = pc.fill_null(pc.utf8_length(sequences), 0).to_numpy(zero_copy_only=False)
    there = peaks.is_valid().to_numpy(zero_copy_only=False) & (held.end > held.begin)
    for n in np.unique(length[there & (length > 0)]).tolist():
        ladder, every = _ladder(n, charge), np.flatnonzero(there & (length == n))
        for rows in (every[k : k + _CHUNK] for k in range(0, len(every), _CHUNK)):
            text = "".join(sequences.take(pa.array(rows)).to_pylist())
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            masses = _MASSES[np.minimum(codes, 127)]
            single = np.concatenate([masses.cumsum(axis=1) + PROTON, masses[:, ::-1].cumsum(axis=1) + (PROTON + WATER)], axis=1)
            mz = np.concatenate([(single + PROTON * (z - 1)) / z for z in range(1, charge + 1)], axis=1)[:, ladder.order]
            error, intensity = held.nearest(rows, mz)
            yield rows, ladder, mz, error, intensity, _under(error, mz, tolerance, relative), np.argsort(mz, axis=1, kind="stable")


def matched_fragments(psms: DataFrame, tolerance: float, relative: bool = False, charge: int = 1) -> DataFrame:
    """One row (sequence, ion, z, mz, error, intensity) for each ion of a PSM (sequence, peaks) that a peak matches: the rows of ``matched`` over ``match_fragments``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, ladder, mz, error, intensity, on, _ in _found(b, charge, tolerance, relative):
                psm, ion = np.nonzero(on)
                ions = pa.array(ion)
                yield pa.RecordBatch.from_arrays([b.column("sequence").take(pa.array(at[psm])), ladder.names.take(ions), pa.array(ladder.charges[ion]), pa.array(mz[on]), pa.array(error[on]), pa.array(intensity[on])], names=["sequence", "ion", "z", "mz", "error", "intensity"])

    return psms.select("sequence", "peaks").mapInArrow(rows, "sequence string, ion string, z int, mz double, error double, intensity double")


def _told(names: pa.Array, on: np.ndarray, columns: np.ndarray | None = None) -> pa.Array:
    """The names of each row's marked columns, in order, joined by commas."""
    _, at = np.nonzero(on)
    ends = np.cumsum([0, *on.sum(axis=1)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(at if columns is None else columns[on]))), ",")


def _once(columns: np.ndarray, on: np.ndarray, charge: int) -> np.ndarray:
    """The marks of each row's first ion of a name; columns of a name stand together."""
    if charge == 1:
        return on
    key = np.where(on, columns // charge, columns.shape[1])
    order = np.argsort(key, axis=1, kind="stable")
    ascending = np.take_along_axis(key, order, 1)
    first = np.ones_like(on)
    first[:, 1:] = ascending[:, 1:] != ascending[:, :-1]
    out = np.empty_like(on)
    np.put_along_axis(out, order, first, 1)
    return out & on


def _total(intensity: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Each row's sum over the marks, added one after the other."""
    return np.where(on, intensity, 0.0).cumsum(axis=1)[:, -1]


_TOLD = "_checked boolean, _matched string, _matched_sum double, _ions_support boolean, _support string, _support_sum double, _flanked boolean, _flanks string, _flanks_sum double"


def _supported(b: pa.RecordBatch, charge: int, tolerance: float, relative: bool) -> list[pa.Array]:
    """The columns of ``_TOLD`` for a batch (sequence, peaks, _place, _median): the ions of ``match_fragments`` and their support as in ``ion_support``."""
    n = b.num_rows
    flags, sums = np.zeros((3, n), bool), np.zeros((3, n))
    order, parts = [np.arange(0)], []
    places = pc.fill_null(b.column("_place"), 0).to_numpy(zero_copy_only=False)
    medians = b.column("_median").to_numpy(zero_copy_only=False)
    known = b.column("_median").is_valid().to_numpy(zero_copy_only=False)
    for rows, ladder, mz, _, intensity, on, by_mz in _found(b, charge, tolerance, relative):
        length, p = len(ladder.names) // (2 * charge), places[rows]
        checked = on.any(axis=1) & (p >= 1) & (p <= length)
        behind = np.where(ladder.b, ladder.places >= p[:, None], ladder.places > length - p[:, None]) & on & checked[:, None]
        end = (p == 1) | (p == length)
        left = np.where((p == 1)[:, None], ladder.column(True, np.ones_like(p)) | ladder.column(False, np.full_like(p, length - 1)), np.where((p == length)[:, None], ladder.column(False, np.ones_like(p)) | ladder.column(True, np.full_like(p, length - 1)), ladder.column(True, p - 1) | ladder.column(False, length - p + 1)))
        right = np.where(end[:, None], left, ladder.column(True, p) | ladder.column(False, length - p))
        flank = (left | right) & on & checked[:, None]
        sorted_intensity = np.take_along_axis(intensity, by_mz, 1)
        in_order = [np.take_along_axis(x, by_mz, 1) for x in (on, behind, flank)]
        sums[:, rows] = [_total(sorted_intensity, x) for x in in_order]
        enough = lambda total: known[rows] & ((total >= medians[rows]) | np.isnan(total))
        supported = behind.any(axis=1) & enough(sums[1, rows])
        flanked = (flank & left).any(axis=1) & (flank & right).any(axis=1) & enough(sums[2, rows])
        texts = b.column("sequence").take(pa.array(rows)).to_pylist()
        proline = np.fromiter((k > 0 and t[k - 1 : k] == "P" for t, k in zip(texts, p.tolist())), bool, len(rows))
        flags[:, rows] = checked, supported & checked, np.where(proline, supported, flanked) & checked
        named = flank.reshape(len(rows), -1, charge).any(axis=2)
        order.append(rows)
        parts.append((_told(ladder.names, _once(by_mz, in_order[0], charge), by_mz), _told(ladder.names, in_order[1], by_mz), _told(ladder.names[::charge], named)))
    others = np.setdiff1d(np.arange(n), np.concatenate(order))
    back = pa.array(np.argsort(np.concatenate([*order, others])))
    texts = [pa.concat_arrays([*(x.cast(pa.string()) for x in column), pa.array([""] * len(others), pa.string())]).take(back) for column in (zip(*parts) if parts else [()] * 3)]
    checked, supported, flanked = map(pa.array, flags)
    return [checked, texts[0], pa.array(sums[0]), supported, texts[1], pa.array(sums[1]), flanked, texts[2], pa.array(sums[2])]


def inspect_spectra(psms: DataFrame, spectra: DataFrame, tolerance: float = 0.02, relative: bool = False, charge: int = 1) -> DataFrame:
    """PSM rows (sequence, file, scan, position) with matched ions, intensity summary and support of the substituted residue.

    PSMs without a spectrum keep their defaults (``skiped``); only a place inside the
    peptide is checked. A PSM whose file has no readable spectrum at all says so in ``ions_support``.
    The PSMs of a batch that are of one length are compared with their peaks together.
    """
    summary = intensity_summary(F.col("peaks"))  # once for each spectrum
    s = spectra.select(F.col("file").alias("_file"), F.col("scan").alias("_scan"), "peaks", summary.alias("_sum"))
    readable = spectra.filter("peaks is not null").select(F.col("file").alias("_readable")).distinct()
    joined = psms.join(s, (F.col("file") == F.col("_file")) & (F.col("scan") == F.col("_scan")), "left").drop("_file", "_scan")
    joined = joined.join(readable, F.col("file") == F.col("_readable"), "left")
    parts = ("sum", "max", "mean", "median")
    joined = joined.select(*psms.columns, "peaks", F.col("position").try_cast("int").alias("_place"), F.col("_readable").isNotNull().alias("_known"), *(F.col(f"_sum.{k}").cast("double").alias(f"_{k}") for k in parts))
    kept = [f for f in joined.schema if f.name not in ("peaks", "_place")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *_supported(b, charge, tolerance, relative)], names=[*(f.name for f in kept), *(x.split()[0] for x in _TOLD.split(", "))])

    made = joined.mapInArrow(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + _TOLD)
    yes = lambda name: F.when(F.col(name), F.lit("YES")).otherwise(F.lit("NO"))
    return made.select(
        *psms.columns, F.length("sequence").alias("peptide_length"), F.when(F.col("_checked"), F.lit("checked")).otherwise(F.lit("skiped")).alias("status"),
        F.when(~F.col("_known"), F.lit("mzML ERROR")).otherwise(yes("_ions_support")).alias("ions_support"), F.col("_support").alias("support_ions"), F.col("_support_sum").alias("sum_supportions_intensity"),
        yes("_flanked").alias("flanking_ions_support"), F.col("_flanks").alias("flanking_ions"), F.col("_flanks_sum").alias("sum_flanking_ions_intensity"),
        F.col("_matched").alias("matched_ions"), F.col("_matched_sum").alias("sum_matchedions_intensity"),
        *(F.coalesce(F.col(f"_{k}"), F.lit(0.0)).alias(name) for k, name in zip(parts, ("sum_fragmentions_intensity", "maxintensity", "average_intensity", "median_intensity"))),
    )
