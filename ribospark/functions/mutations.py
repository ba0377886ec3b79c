"""Column functions that apply HGVS and mutation-table edits to coding sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ribospark.functions.binding import bind
from ribospark.functions.constants import THREE_TO_ONE
from ribospark.functions.sequences import translate

_ALL = 2**31 - 1


def three_to_one(text: Column) -> Column:
    """One-letter codes of three-letter ones; a text that isn't wholly made of them stays as it is."""
    table = F.create_map(*(F.lit(x) for pair in THREE_TO_ONE.items() for x in pair))
    pieces = F.regexp_extract_all(text, F.lit("(.{1,3})"), 1)
    codes = F.transform(pieces, lambda p: F.try_element_at(table, F.initcap(F.lower(p))))
    whole = F.length(text).between(3, _ALL) & text.rlike("[a-z]") & F.forall(codes, lambda c: c.isNotNull())
    return F.when(whole, F.array_join(codes, "")).otherwise(text)


def _head(seq: Column, n: Column) -> Column:
    return F.substring(seq, F.lit(1), F.greatest(n, F.lit(0)))


def _tail(seq: Column, n: Column) -> Column:
    """What follows the first ``n`` letters."""
    return F.substring(seq, F.greatest(n, F.lit(0)) + 1, F.lit(_ALL))


def _numbers(text: Column) -> Column:
    # numbers of over nine digits lie past the end of any sequence
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), lambda x: F.coalesce(x.try_cast("int"), F.lit(999_999_999)))


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``."""
    return F.substring(text, F.instr(text, mark) + len(mark), F.lit(_ALL))


def _between(text: Column, mark: str) -> Column:
    """What stands between the first and the second ``mark``."""
    return F.split_part(text, F.lit(mark), F.lit(2))


def mutated_dna(seq: Column, change: Column) -> Column:
    """The coding sequence after a ``c.`` change, or null where it can't be applied."""
    return bind(_numbers(change), lambda at: _edited_dna(seq, change, at))


def _edited_dna(seq: Column, change: Column, at: Column) -> Column:
    n = F.size(at)
    one, two = F.try_element_at(at, F.lit(1)), F.try_element_at(at, F.lit(2))
    ref = F.regexp_replace(F.split_part(change, F.lit(">"), F.lit(1)), "[^A-Z]+", "")
    alt = F.regexp_replace(_between(change, ">"), "[^A-Z]+", "")
    put = _between(change, "delins")
    ins = _after(change, "ins")
    return (
        F.when(F.contains(change, F.lit(">")) & (n == 1), F.when((ref == F.upper(F.substring(seq, one, F.lit(1)))) & alt.isin("A", "T", "C", "G") & (one <= F.length(seq)), F.concat(_head(seq, one - 1), alt, _tail(seq, one))))
        .when(F.contains(change, F.lit("delins")), F.when(put.rlike("^[A-Za-z]+$") & (n >= 1), F.concat(_head(seq, one - 1), put, _tail(seq, F.when(n >= 2, two).otherwise(one)))))
        .when(F.contains(change, F.lit("ins")), F.when(ins.rlike("^[A-Za-z]+$") & (n >= 1), F.concat(_head(seq, one), ins, _tail(seq, one))))
        .when(F.contains(change, F.lit("del")), F.when(n.isin(1, 2), F.concat(_head(seq, one - 1), _tail(seq, F.when(n == 2, two).otherwise(one)))))
    )


def mutated_protein(protein: Column, change: Column, kind: Column) -> Column:
    """The protein after a ``p.`` change of a mutation type, or null where it can't be applied."""
    return bind(F.struct(protein.alias("protein"), _numbers(change).alias("at")), lambda v: _edited_protein(v["protein"], change, kind, v["at"]))


def _edited_protein(protein: Column, change: Column, kind: Column, at: Column) -> Column:
    n = F.size(at)
    one, two = F.try_element_at(at, F.lit(1)), F.try_element_at(at, F.lit(2))
    residue = three_to_one(F.regexp_replace(change, r"^p\..*[0-9]+", ""))
    put = three_to_one(_after(change, "ins"))
    raw = _after(change, ">")
    plain = three_to_one(F.replace(raw, F.lit("*"), F.lit("")))
    starred = F.contains(raw, F.lit("*"))
    new = F.when(starred, F.concat(plain, F.lit("*"))).otherwise(plain)
    swap = F.when(n >= 2, F.concat(_head(protein, one - 1), new, _tail(protein, two)))
    has = lambda x: F.contains(kind, F.lit(x))
    return (
        F.when(has("Missense"), F.when(residue.rlike("^[A-Za-z]$") & (n >= 1), F.concat(_head(protein, one - 1), residue, _tail(protein, one))))
        .when(has("Nonsense"), F.when(n >= 1, _head(protein, one - 1)))
        .when(has("Insertion - In frame"), F.when(F.contains(change, F.lit("ins")) & put.rlike("^[A-Za-z]+$") & (n >= 1), F.concat(_head(protein, one), put, _tail(protein, one))))
        .when(has("Deletion - In frame"), F.when(n.isin(1, 2), F.concat(_head(protein, one - 1), _tail(protein, F.when(n == 2, two).otherwise(one)))))
        .when(
            has("Complex") & ~has("frameshift"),
            F.when(
                F.contains(change, F.lit(">")) & plain.rlike("^[A-Za-z]+$"),
                F.when(has("deletion"), swap)
                .when(has("insertion"), F.when(n >= 1, F.concat(_head(protein, one), new, _tail(protein, one))))
                .when(has("compound substitution"), F.when(starred, F.when(n >= 1, F.concat(_head(protein, one - 1), plain))).otherwise(swap)),
            ),
        )
    )


def hgvs_protein(seq: Column, dna: Column, protein: Column, kind: Column, native: Column | None = None) -> Column:
    """The protein of a somatic mutation, empty where it can't be applied.

    A known DNA change decides alone; the protein change is used only where the DNA change
    (or its effect) is unknown. ``native``: the translation of ``seq``, where it is at hand.
    """
    by_dna = dna.isNotNull() & ~F.contains(dna, F.lit("?")) & protein.isNotNull() & (protein != "p.?")
    by_protein = protein.isNotNull() & ~F.contains(protein, F.lit("?"))
    out = F.when(F.coalesce(by_dna, F.lit(False)), translate(mutated_dna(seq, dna))).when(F.coalesce(by_protein, F.lit(False)), mutated_protein(translate(seq) if native is None else native, protein, kind))
    return F.coalesce(out, F.lit(""))


def maf_dna(seq: Column, hgvsc: Column, kind: Column) -> Column:
    """The coding sequence after a mutation-table edit (SNP, DEL or INS), or null where it can't be applied."""
    change = F.when(F.contains(hgvsc, F.lit(":")), F.split_part(hgvsc, F.lit(":"), F.lit(2))).otherwise(hgvsc)
    first = F.try_element_at(_numbers(change), F.lit(1))
    head = F.try_element_at(_numbers(F.split_part(change, F.lit("_"), F.lit(1))), F.lit(1))
    second = F.try_element_at(_numbers(F.split_part(change, F.lit("_"), F.lit(2))), F.lit(1))
    arrow = F.instr(hgvsc, ">")
    ref, alt = F.substring(hgvsc, arrow - 1, F.lit(1)), F.substring(hgvsc, arrow + 1, F.lit(1))
    gone, put, dup = _between(hgvsc, "del"), _between(hgvsc, "ins"), _between(hgvsc, "dup")
    place = F.when(F.contains(hgvsc, F.lit("ins")) | (F.length(dup) <= 1), head).otherwise(second)
    added = F.when(F.contains(hgvsc, F.lit("ins")), put).when(F.contains(hgvsc, F.lit("dup")), dup)
    return (
        F.when(kind == "SNP", F.when((arrow > 1) & alt.isin("A", "T", "C", "G") & (first <= F.length(seq)) & (ref == F.substring(seq, first, F.lit(1))), F.concat(_head(seq, first - 1), alt, _tail(seq, first))))
        .when(kind == "DEL", F.when(F.contains(hgvsc, F.lit("del")) & (gone == F.substring(seq, head, F.length(gone))), F.concat(_head(seq, head - 1), _tail(seq, head - 1 + F.length(gone)))))
        .when(kind == "INS", F.concat(_head(seq, place), added, _tail(seq, place)))
    )
