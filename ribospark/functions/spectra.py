"""Column functions over peptides and spectra: fragment ions, nearest peaks and support."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ribospark.functions.binding import bind
from ribospark.functions.constants import PROTON, RESIDUE_MASS, WATER


def residue_mass(residue: Column) -> Column:
    """Monoisotopic mass; an unknown residue has none (null)."""
    out = F.when(residue == "G", F.lit(RESIDUE_MASS["G"]))
    for aa, mass in RESIDUE_MASS.items():
        if aa != "G":
            out = out.when(residue == aa, F.lit(mass))
    return out


def fragment_ions(peptide: Column, charge: int = 1) -> Column:
    """Structs (mz, ion, type, pos, z): b1..bL and y1..yL, by m/z; charge 2 adds their doubly charged forms.

    bL is the whole peptide without water and yL the whole protonated peptide.
    """
    n = F.length(peptide)
    masses = F.transform(F.sequence(F.lit(1), n), lambda i: residue_mass(F.substring(peptide, i, F.lit(1))))
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x)

    def ladders(m: Column) -> Column:
        def ladder(kind: str, extra: float, part) -> Column:
            return F.transform(m, lambda _, j: F.struct((total(part(j + 1)) + F.lit(extra)).alias("mz"), F.concat(F.lit(kind), (j + 1).cast("string")).alias("ion"), F.lit(kind).alias("type"), (j + 1).alias("pos"), F.lit(1).alias("z")))

        return F.concat(ladder("b", PROTON, lambda i: F.slice(m, F.lit(1), i)), ladder("y", PROTON + WATER, lambda i: F.slice(m, F.size(m) - i + 1, i)))

    single = bind(masses, ladders)
    if charge > 1:
        double = F.transform(single, lambda x: F.struct(((x["mz"] + F.lit(PROTON)) / 2).alias("mz"), x["ion"].alias("ion"), x["type"].alias("type"), x["pos"].alias("pos"), F.lit(2).alias("z")))
        single = F.concat(single, double)
    return F.when(n > 0, F.array_sort(single))


def nearest_peak(peaks: Column, mz: Column) -> Column:
    """(error, intensity) of the peak (mz, intensity) with the least distance; the first one of equals."""
    near = F.array_min(F.transform(peaks, lambda p, i: F.struct(F.abs(p["mz"] - mz).alias("error"), i.alias("i"), p["intensity"].alias("intensity"))))
    return F.struct(near["error"].alias("error"), near["intensity"].alias("intensity"))


def ppm(error: Column, mz: Column) -> Column:
    return F.bround(error / mz * 1_000_000, 2)


def matched_ions(ions: Column, peaks: Column, tolerance: float, relative: bool = False) -> Column:
    """Ions with their nearest peak, where the error (Da, or ppm) is under the tolerance."""
    def nearest(p: Column) -> Column:
        return F.transform(ions, lambda x: F.struct(x["mz"].alias("mz"), x["ion"].alias("ion"), x["type"].alias("type"), x["pos"].alias("pos"), nearest_peak(p, x["mz"]).alias("near")))

    full = F.transform(bind(peaks, nearest), lambda x: F.struct(x["mz"].alias("mz"), x["ion"].alias("ion"), x["type"].alias("type"), x["pos"].alias("pos"), x["near"]["error"].alias("error"), x["near"]["intensity"].alias("intensity"), ppm(x["near"]["error"], x["mz"]).alias("ppm")))
    return F.filter(full, lambda x: (x["ppm"] if relative else x["error"]) < tolerance)


def intensity_summary(peaks: Column) -> Column:
    """Sum, maximum, mean and median of the intensities; the median of an even number is the middle of two."""
    def summed(values: Column) -> Column:
        n = F.size(values)
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        low, high = F.get(values, ((n + 1) / 2).cast("int") - 1), F.get(values, (n / 2).cast("int"))
        return F.struct(total.alias("sum"), F.array_max(values).alias("max"), (total / F.nullif(n, F.lit(0))).alias("mean"), ((low + high) / 2).alias("median"))

    return bind(F.array_sort(F.transform(peaks, lambda p: p["intensity"])), summed)


def ion_support(peptide: Column, position: Column, matched_ions: Column, median: Column) -> Column:
    """Support of a substituted residue: flags, ions and intensities of supporting and flanking ions.

    Ions behind the residue support it; ions at both sides flank it (at an end, one does).
    Either counts only from the median intensity on; at a proline the support decides
    for the flanks too. Flanking ions are compared by their exact names.
    """
    return bind(matched_ions, lambda matched: _support(peptide, position, matched, median))


def _support(peptide: Column, position: Column, matched: Column, median: Column) -> Column:
    n, p = F.length(peptide), position
    support = F.filter(matched, lambda x: ((x["type"] == "b") & (x["pos"] >= p)) | ((x["type"] == "y") & (x["pos"] > n - p)))
    b, y = (lambda k: F.concat(F.lit("b"), k.cast("string"))), (lambda k: F.concat(F.lit("y"), k.cast("string")))
    left = F.when(p == 1, F.array(b(F.lit(1)), y(n - 1))).when(p == n, F.array(y(F.lit(1)), b(n - 1))).otherwise(F.array(b(p - 1), y(n - p + 1)))
    right = F.when((p == 1) | (p == n), left).otherwise(F.array(b(p), y(n - p)))
    hits = lambda names: F.filter(matched, lambda x: F.array_contains(names, x["ion"]))
    flank = F.filter(matched, lambda x: F.array_contains(left, x["ion"]) | F.array_contains(right, x["ion"]))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["intensity"])
    yes = lambda c: F.when(c, F.lit("YES")).otherwise(F.lit("NO"))
    supported = yes((F.size(support) > 0) & (total(support) >= median))
    flanked = yes((F.size(hits(left)) > 0) & (F.size(hits(right)) > 0) & (total(flank) >= median))
    return F.struct(
        supported.alias("ions_support"), F.array_join(F.transform(support, lambda x: x["ion"]), ",").alias("support_ions"), total(support).alias("support_intensity"),
        F.when(F.substring(peptide, p, F.lit(1)) == "P", supported).otherwise(flanked).alias("flanking_ions_support"), F.array_join(F.array_sort(F.array_distinct(F.transform(flank, lambda x: x["ion"]))), ",").alias("flanking_ions"), total(flank).alias("flanking_intensity"),
    )
