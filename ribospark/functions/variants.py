"""Column functions over variant records: filters, annotation fields, allele splicing and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ribospark.functions.binding import bind
from ribospark.functions.sequences import complement


def option_list(text: str) -> list[str]:
    """A comma-separated option; the empty text is one empty option."""
    return [x.strip() for x in text.split(",")]


def valid_ref(ref: Column) -> Column:
    """Upper-case A, C, G, T only; the empty allele passes."""
    return ref.rlike("^[ACGT]*$")


def valid_alts(alt: Column, strict: bool = False) -> Column:
    """The valid alleles of a comma list. ``strict`` trims them and refuses empty ones."""
    alts = F.split(alt, ",")
    if strict:
        return F.filter(F.transform(alts, F.trim), lambda a: a.rlike("^[ACGT]+$"))
    return F.filter(alts, lambda a: a.rlike("^[ACGT]*$"))


def passes_filter(status: Column, accepted: list[str], ignore: bool = False) -> Column:
    """A FILTER value without content passes, otherwise all its parts must be accepted."""
    if ignore or accepted == ["ALL"]:
        return F.lit(True)
    value = F.coalesce(status, F.lit(""))
    upper = F.upper(value)
    by_comma = F.split(upper, ",")
    parts = F.when(F.contains(upper, F.lit(";")) & (F.size(by_comma) <= 1), F.split(upper, ";")).otherwise(by_comma)
    return value.isin("", ".", "NA") | (F.size(F.array_except(parts, F.array(*map(F.lit, accepted)))) == 0)


def info_value(info: Column, key: str) -> Column:
    """The value of the first ``key=value`` of an INFO text, or null."""
    found = F.filter(F.split(info, ";"), lambda kv: F.startswith(kv, F.lit(f"{key}=")))
    return F.substring(F.try_element_at(found, F.lit(1)), len(key) + 2, 2**31 - 1)


def passes_frequency(info: Column, key: str, least: float) -> Column:
    """The allele frequency is one number and reaches the threshold; missing or several numbers fail."""
    return F.coalesce(info_value(info, key).try_cast("double") >= F.lit(least), F.lit(False))


def annotations(info: Column, key: str) -> Column:
    """Records (arrays of sub-fields) of a comma- and pipe-separated annotation."""
    return F.transform(F.split(info_value(info, key), ","), lambda r: F.split(r, r"\|"))


def format_fields(header_lines: list[str], key: str) -> list[str]:
    """The sub-field names that a ``##INFO=<ID=key...Format: a|b">`` line declares, in upper case."""
    for line in header_lines:
        if line.startswith(f"##INFO=<ID={key}"):
            tail = line.upper().split("FORMAT")[-1]
            return [x.strip().strip('">').strip() for x in tail.split(":")[-1].split("=")[-1].split("|")]
    return []


def passes_choice(value: Column, include: list[str], exclude: list[str]) -> Column:
    """Not excluded and (included or everything is)."""
    kept = F.lit(True) if include == ["all"] else value.isin(*include)
    return kept & ~value.isin(*exclude)


def passes_clinical_significance(value: Column, excluded: list[str]) -> Column:
    """Empty passes; a listed value fails; a compound fails if all its parts are listed (``_`` as space, case ignored)."""
    low = [x.replace("_", " ").lower() for x in excluded]
    parts = F.filter(F.transform(F.split(value, "[/,]"), lambda p: F.lower(F.translate(F.trim(p), "_", " "))), lambda p: p != "")
    all_out = (F.size(parts) > 0) & F.forall(parts, lambda p: p.isin(*low))
    return F.coalesce(value == "", F.lit(True)) | ~(value.isin(*excluded) | all_out)


def consequences(mc: Column) -> Column:
    """All terms of a molecular-consequence list ``SO:1|term,SO:2|term``."""
    return F.filter(F.transform(F.split(mc, ","), lambda x: F.when(F.contains(x, F.lit("|")), F.substring(x, F.instr(x, "|") + 1, F.lit(2**31 - 1))).otherwise(x)), lambda t: t != "")


def passes_consequence(mc: Column, included: list[str]) -> Column:
    """Empty passes, ``all`` passes everything, otherwise any listed term."""
    if included == ["all"]:
        return F.lit(True)
    return F.coalesce(mc == "", F.lit(True)) | F.arrays_overlap(consequences(mc), F.array(*map(F.lit, included)))


def gene_info(value: Column) -> Column:
    """(symbol, id) of the first gene of ``SYM:1|SYM2:2``."""
    first = F.split_part(value, F.lit("|"), F.lit(1))
    return F.struct(F.split_part(first, F.lit(":"), F.lit(1)).alias("symbol"), F.split_part(first, F.lit(":"), F.lit(2)).alias("id"))


def attribute(attributes: Column, key: str) -> Column:
    """The first quoted value of a GTF attribute, or the empty text."""
    return F.regexp_extract(attributes, rf'(?:^|[;\s]){key} "([^"]*)"', 1)


def fasta_key(header: Column) -> Column:
    return F.split_part(F.split_part(header, F.lit("|"), F.lit(1)), F.lit(" "), F.lit(1))


def unversioned(identifier: Column) -> Column:
    return F.split_part(identifier, F.lit("."), F.lit(1))


def bare_chromosome(chrom: Column) -> Column:
    """Without leading letters c, h and r."""
    return F.regexp_replace(chrom, "^[chr]+", "")


def overlaps(start: Column, end: Column, features: Column) -> Column:
    """Whether [start, end] meets any feature; a start of -1 always does."""
    return (start == -1) | F.exists(features, lambda f: (start <= f["end"]) & (f["start"] <= end))


def splice(seq: Column, ref: Column, alt: Column, pos: Column, strand: Column, features: Column, cds: Column | None = None) -> Column:
    """(ref_seq, alt_seq): the coding sequence before and after an allele; alt_seq is empty if no feature holds ``pos``.

    ``features`` are structs (end, start, type) in ascending order of end, ``cds`` a struct
    (start, end) or null. On the minus strand the arithmetic is done on the reversed
    sequence with complemented alleles. An allele that runs over its feature's end is
    clipped, the alternative by as many trailing bases.
    """
    minus = strand == "-"
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    walked = F.aggregate(
        features,
        F.struct(zero.alias("off"), none.alias("at"), none.alias("stop")),
        lambda acc, f: F.struct(
            (acc["off"] + f["end"] - f["start"] + 1).cast("long").alias("off"),
            F.when(acc["at"].isNull() & (pos >= f["start"]) & (pos <= f["end"]), (acc["off"] + pos - f["start"]).cast("long")).otherwise(acc["at"]).alias("at"),
            F.when(acc["at"].isNull() & (pos >= f["start"]) & (pos <= f["end"]), f["end"].cast("long")).otherwise(acc["stop"]).alias("stop"),
        ),
    )
    return bind(walked, lambda w: _spliced(seq, ref, alt, pos, minus, w, cds))


def _spliced(seq: Column, ref: Column, alt: Column, pos: Column, minus: Column, walked: Column, cds: Column | None) -> Column:
    zero = F.lit(0).cast("long")
    r, a = F.when(minus, complement(ref)).otherwise(ref), F.when(minus, complement(alt)).otherwise(alt)
    turned = F.when(minus, F.reverse(seq)).otherwise(seq)
    first = F.coalesce(cds["start"] - 1, F.lit(0)) if cds is not None else F.lit(0)
    last = F.coalesce(cds["end"].cast("long"), walked["off"]) if cds is not None else walked["off"]
    has_cds = cds.isNotNull() if cds is not None else F.lit(False)
    n = F.length(seq)
    begin = F.greatest(F.when(minus & has_cds, n - last).otherwise(first), F.lit(0)).cast("int")
    stop = F.greatest(F.when(minus & has_cds, n - first).otherwise(last), begin).cast("int")
    window = F.substring(turned, begin + 1, stop - begin)
    c = F.greatest(F.least(pos + F.length(r) - 1, walked["stop"]) - pos + 1, zero)
    over = F.length(r) - c
    clipped = F.when(over > 0, F.substring(a, F.lit(1), F.greatest(F.length(a) - over, zero).cast("int"))).otherwise(a)
    at = walked["at"].cast("int")
    changed = F.when(at.isNull(), F.lit("")).otherwise(F.concat(F.substring(window, F.lit(1), at), clipped, F.substring(window, (at + c + 1).cast("int"), F.lit(2**31 - 1))))
    turn = lambda s: F.when(minus, F.reverse(s)).otherwise(s)
    return F.struct(turn(window).alias("ref_seq"), turn(changed).alias("alt_seq"))


def variant_header(prefix: str, identifier: Column, chrom: Column, pos: Column, ref: Column, alt: Column, transcript: Column) -> Column:
    """``prefix_ID_chrom.pos.ref.alt_transcript``; the id is kept as it is."""
    return F.concat_ws("_", F.lit(prefix), identifier, F.concat_ws(".", chrom, pos.cast("string"), ref, alt), transcript)


def clinical_header(prefix: str, identifier: Column, chrom: Column, pos: Column, ref: Column, alt: Column, transcript: Column) -> Column:
    name = F.when(identifier.isNull() | (identifier == "."), F.lit("")).otherwise(identifier)
    return F.concat(F.lit(prefix), name, F.lit("_"), F.concat_ws(".", chrom, pos.cast("string"), ref, alt), F.lit("_"), transcript)
