"""Protein databases: stop-codon checks, digestion, canonical peptides, decoys and composition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.functions.constants import ALPHABET, ENZYMES
from ribospark.functions.sequences import cleave, isobaric, placed_pieces, residue_count, reverse_switch, shuffled, trypsin_pieces
from ribospark.plans.runtime import cut


def check_proteins(records: DataFrame, split_at_stops: bool = False, min_length: int = 6) -> DataFrame:
    """(id, description, seq, starts_with_met) after the stop-codon check.

    One trailing stop is dropped and gaps are noted. A sequence with inner stops is split
    into ``_codon_k`` pieces (k counts all pieces) or cut at its first stop, with a note.
    Only sequences longer than ``min_length`` stay.
    """
    seq, text = F.col("seq"), F.col("description")
    note = F.when(F.contains(text, F.lit(" ")), F.substring(text, F.instr(text, " ") + 1, F.lit(2**31 - 1))).otherwise(text)
    one = records.select("id", note.alias("_note"), F.regexp_replace(seq, r"\*$", "").alias("_s"), F.startswith(seq, F.lit("M")).alias("starts_with_met"))
    one = one.withColumn("_note", F.when(F.contains("_s", F.lit("-")), F.concat("_note", F.lit(" (Contains gaps)"))).otherwise(F.col("_note")))
    stops = F.contains("_s", F.lit("*"))
    whole = one.filter(~stops).select("id", F.col("_note").alias("description"), F.col("_s").alias("seq"), "starts_with_met")
    cut = one.filter(stops)
    if split_at_stops:
        pieces = cut.select("id", "_note", "starts_with_met", F.posexplode(F.split("_s", r"\*")).alias("k", "seq"))
        rest = pieces.select(F.concat("id", F.lit("_codon_"), (F.col("k") + 1).cast("string")).alias("id"), F.col("_note").alias("description"), "seq", "starts_with_met")
    else:
        head = F.substring_index("_s", "*", 1)
        rest = cut.select("id", F.concat("_note", F.lit(" (Premature stop "), F.length(head).cast("string"), F.lit("/"), F.length("_s").cast("string"), F.lit(")")).alias("description"), head.alias("seq"), "starts_with_met")
    return whole.unionByName(rest).filter(F.length("seq") > min_length)


def check_summary(records: DataFrame, min_length: int = 6) -> DataFrame:
    """The counters of the check: proteins, without Met, with gaps, with inner stops, short."""
    body = F.regexp_replace("seq", r"\*$", "")
    return records.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.startswith("seq", F.lit("M"))).alias("no_met"), F.count_if(F.contains(body, F.lit("-"))).alias("gaps"), F.count_if(F.contains(body, F.lit("*"))).alias("stops"), F.count_if(F.length(body) <= min_length).alias("short"))


def peptidome(records: DataFrame, missed: int = 0, min_length: int = 7, max_length: int = 40) -> DataFrame:
    """Distinct peptide keys (I as L) of canonical proteins."""
    return records.select(F.explode(trypsin_pieces(F.col("seq"), missed, min_length, max_length)).alias("peptide")).select(isobaric(F.col("peptide")).alias("key")).distinct()


def unique_variant_peptides(mutants: DataFrame, canonical: DataFrame, prefix: str = "Mutation", missed: int = 0, min_length: int = 7, max_length: int = 40) -> DataFrame:
    """(peptide, header) of mutant peptides that no canonical protein has, headers joined by ``;``.

    A header's first ``:`` field becomes the prefix; a Missense header also gets the
    mutation's place in the peptide; ``*`` becomes ``-``. Headers with under two fields
    have no mutation place.
    """
    fields = F.split("description", ":")
    n = F.size(fields)
    missense = (n >= 2) & F.contains(F.element_at(fields, -1), F.lit("Missense"))
    # a peptide's first place is found beside its protein, so that no sequence travels with its peptides
    if missed or max_length is None:
        placed = F.transform(trypsin_pieces(F.col("seq"), missed, min_length, max_length), lambda p: F.struct(p.alias("peptide"), F.when(missense, F.instr(F.col("seq"), p)).alias("at")))
    else:
        placed = placed_pieces(F.col("seq"), min_length, max_length)
    pieces = mutants.filter(F.length("seq") >= min_length).select("description", F.inline(placed))
    fresh = pieces.withColumn("_key", isobaric(F.col("peptide"))).join(peptidome(canonical, missed, min_length, max_length).withColumnRenamed("key", "_key"), "_key", "left_anti")
    place = F.regexp_extract(F.try_element_at(fields, n - 1), r"(\d+)", 1).try_cast("int") - F.col("at") + 1
    renamed = F.concat(F.lit(prefix), F.when(n > 1, F.substring(F.col("description"), F.instr("description", ":"), F.lit(2**31 - 1))).otherwise(F.lit("")))
    header = F.when(missense, F.concat(renamed, F.lit(":"), place.cast("string"))).otherwise(renamed)  # null where Missense has no number
    return fresh.withColumn("header", F.replace(header, F.lit("*"), F.lit("-"))).filter("header is not null").groupBy("peptide").agg(F.array_join(F.array_sort(F.collect_set("header")), ";").alias("header"))


def whole_decoys(records: DataFrame, mode: str = "reverse", prefix: str = "DECOY_", seed: int = 1) -> DataFrame:
    """Targets and their whole-protein decoys (reverse or shuffle)."""
    changed = F.reverse("seq") if mode == "reverse" else shuffled(F.col("seq"), F.lit(seed), keep_last=False)
    return records.select("id", "seq").unionByName(records.select(F.concat(F.lit(prefix), "id").alias("id"), changed.alias("seq")))


def digested(records: DataFrame, enzyme: str, missed: int, min_length: int) -> DataFrame:
    """Distinct peptides of all records."""
    return records.select(F.explode(cleave(F.col("seq"), enzyme, missed, min_length)).alias("peptide")).distinct()


def _decoy_pieces(records: DataFrame, enzyme: str) -> tuple[DataFrame, DataFrame]:
    """The targets with I as L, and (id, k, peptide) of their reversed and switched decoys."""
    targets = records.select("id", isobaric(F.col("seq")).alias("seq"))
    decoys = targets.select("id", reverse_switch(F.col("seq"), ENZYMES[enzyme][2]).alias("seq"))
    return targets, decoys.select("id", F.posexplode(F.filter(F.split("seq", ENZYMES[enzyme][0]), lambda p: p != "")).alias("k", "peptide"))


def decoy_swaps(records: DataFrame, enzyme: str = "Trypsin", min_length: int = 5, max_iterations: int = 100, missed_targets: int = 0, shuffle: bool = True, seed: int = 1) -> DataFrame:
    """(peptide, other): the decoy peptides that are target peptides too, and what takes their place (null: no order is free).

    Orders are tried in rounds: the first, the next two, the next four and so on, each only for
    the peptides that are still without one, so under twice the orders up to the free one are made.
    """
    targets, placed = _decoy_pieces(records, enzyme)
    known = targets.select(F.explode(cleave(F.col("seq"), enzyme, missed_targets, min_length)).alias("peptide")).distinct()
    hit = placed.filter(F.length("peptide") >= min_length).select("peptide").distinct().join(known, "peptide", "left_semi")
    if not shuffle:
        return hit.withColumn("other", F.col("peptide"))
    taken, left, first, found = cut(known.withColumnRenamed("peptide", "other")), cut(hit), 1, []
    while first <= max_iterations and not left.isEmpty():
        last = min(2 * first - 1, max_iterations)  # twice as many orders each round, and only for what is left
        tried = left.select("peptide", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("i")).withColumn("other", shuffled(F.col("peptide"), F.lit(seed) + F.col("i")))
        found.append(cut(tried.join(taken, "other", "left_anti").groupBy("peptide").agg(F.min_by("other", "i").alias("other"))))
        left, first = cut(left.join(found[-1], "peptide", "left_anti")), last + 1
    return reduce(DataFrame.unionByName, found, left.withColumn("other", F.lit(None).cast("string")))


def switched_decoys(records: DataFrame, enzyme: str = "Trypsin", prefix: str = "DECOY_", min_length: int = 5, max_iterations: int = 100, missed_targets: int = 0, shuffle: bool = True, keep_targets: bool = True, keep_target_hits: bool = False, seed: int = 1) -> DataFrame:
    """(id, seq, is_decoy): reversed and switched decoys whose peptides are no target peptides.

    I becomes L. A decoy peptide of at least ``min_length`` that is also a target peptide is
    shuffled (its last residue stays) in ``max_iterations`` seeded orders; the first that is
    no target peptide takes its place, wherever the peptide stands in a decoy. Peptides
    without such an order stay or, without ``keep_target_hits``, are left out. Collisions
    are few, so only they are joined back to the proteins.
    """
    targets, placed = _decoy_pieces(records, enzyme)
    swap = decoy_swaps(records, enzyme, min_length, max_iterations, missed_targets, shuffle, seed).withColumn("_hit", F.lit(True))
    kept = F.when(F.col("_hit").isNull(), F.col("peptide")).when(F.col("other").isNotNull(), F.col("other")).otherwise(F.col("peptide") if keep_target_hits else F.lit(""))
    parts = placed.join(swap, "peptide", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", kept.alias("p")))).alias("x"))
    made = parts.select(F.concat(F.lit(prefix), "id").alias("id"), F.array_join(F.transform("x", lambda x: x["p"]), "").alias("seq"), F.lit(True).alias("is_decoy")).filter("seq <> ''")
    return targets.withColumn("is_decoy", F.lit(False)).unionByName(made) if keep_targets else made


def decoy_collisions(records: DataFrame, enzyme: str = "Trypsin", min_length: int = 6) -> DataFrame:
    """Distinct decoy peptides that are target peptides too."""
    targets = records.select(isobaric(F.col("seq")).alias("seq"))
    decoys = targets.select(reverse_switch(F.col("seq"), ENZYMES[enzyme][2]).alias("seq"))
    return digested(decoys, enzyme, 0, min_length).join(digested(targets, enzyme, 0, min_length), "peptide", "left_semi")


def decoy_composition(records: DataFrame, prefix: str = "DECOY", enzyme: str = "Trypsin", missed: int = 0, min_length: int = 6) -> DataFrame:
    """One row of target and decoy peptide counts, their overlap and the residue counts of both sides."""
    decoy = F.contains("id", F.lit(prefix))
    pieces = records.select(decoy.alias("d"), F.explode(cleave(F.col("seq"), enzyme, missed, min_length)).alias("p")).groupBy("p").agg(F.max("d").alias("in_decoy"), F.min("d").alias("only_decoy"))
    counts = pieces.agg(F.count_if(~F.col("only_decoy")).alias("target_peptides"), F.count_if("in_decoy").alias("decoy_peptides"), F.count_if(F.col("in_decoy") & ~F.col("only_decoy")).alias("shared_peptides"))
    sums = [F.sum(F.when(on, residue_count(F.col("seq"), aa)).otherwise(0)).alias(f"{name}_{aa}") for name, on in (("target", ~decoy), ("decoy", decoy)) for aa in ALPHABET]
    return counts.crossJoin(records.agg(*sums))  # one row each


def composition_report(counts: dict) -> list[str]:
    """The lines of a report on the row of ``decoy_composition``: peptides of one side only or both, and residue ratios.

    A peptide of both sides counts as a decoy.
    """
    target, decoy, both = counts["target_peptides"] - counts["shared_peptides"], counts["decoy_peptides"], counts["shared_peptides"]
    share = lambda n: 100 * n / max(1, target + decoy)
    lines = [f"target peptides: {target} ({share(target):.1f} %)", f"decoy peptides: {decoy} ({share(decoy):.1f} %)", f"peptides of both: {both} ({share(both):.1f} %)"]
    ratios = {aa: (counts[f"target_{aa}"], counts[f"decoy_{aa}"]) for aa in ALPHABET}
    return lines + [f"residue {aa}, target to decoy: {t / d:.1f}" for aa, (t, d) in ratios.items() if t and d]


def residue_totals(records: DataFrame) -> DataFrame:
    """(residue, n) over all records for the alphabet of composition reports."""
    row = records.agg(*(F.sum(residue_count(F.col("seq"), aa)).alias(aa) for aa in ALPHABET))
    return row.select(F.explode(F.array(*(F.struct(F.lit(aa).alias("residue"), F.col(aa).alias("n")) for aa in ALPHABET))).alias("x")).select("x.residue", "x.n")


def merged_database(parts: list[DataFrame]) -> DataFrame:
    """Sequences with the sorted ids of all records that have them."""
    every = reduce(DataFrame.unionByName, [p.select("id", "seq") for p in parts])
    return every.groupBy("seq").agg(F.array_sort(F.collect_set("id")).alias("ids"))
