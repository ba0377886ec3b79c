"""DNA to ORFs: frame translation and header-driven selection of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospark.functions.sequences import orfs, translate


def three_frames(records: DataFrame, table: int = 1) -> DataFrame:
    """(id, frame 1..3, seq) of all records, stops kept; the FASTA name is ``id_RF{frame}``."""
    return records.select("id", F.posexplode(orfs(F.col("seq"), 3, 0, table)).alias("frame", "seq")).withColumn("frame", F.col("frame") + 1)


def header_values(header: Column, sep: str = " ") -> Column:
    """Map of a transcript header's ``k=v`` (else ``k:v``) fields; later fields win, ``cds`` keys are upper-cased.

    The value is the text between the first and the second ``=``.
    """
    fields = F.split(F.replace(header, F.lit(" "), F.lit(sep)), F.lit(f"[{sep}]") if len(sep) == 1 and sep not in "^]\\" else F.lit(sep))
    pair = lambda f: F.when(F.contains(f, F.lit("=")), F.split(f, "=")).when(F.contains(f, F.lit(":")), F.split(f, ":"))
    entries = F.transform(F.filter(fields, lambda f: F.contains(f, F.lit("=")) | F.contains(f, F.lit(":"))), lambda f: F.struct(F.when(F.element_at(pair(f), 1) == "cds", F.lit("CDS")).otherwise(F.element_at(pair(f), 1)).alias("k"), F.element_at(pair(f), 2).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def coding_range(value: Column) -> Column:
    """(start, end) of ``a-b``, square brackets ignored; null if it isn't one."""
    found = F.regexp_replace(value, r"[\[\]]", "")
    start, end = (F.split_part(found, F.lit("-"), F.lit(k)).try_cast("int") for k in (1, 2))
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def dna_orfs(records: DataFrame, forward: int = 3, backward: int = 0, table: int = 1, biotype_key: str = "", include: list[str] | None = None, exclude: list[str] | None = None, expression_key: str = "", expression_least: float = 5.0, skip_cds: bool = False, alternative: bool = False) -> DataFrame:
    """(id, frame, seq) ORFs of transcripts with a header, chosen by coding range, biotype and expression.

    A record with a coding range is kept unless it is skipped; without ``alternative`` only
    its coding part is read, in its first frame. Others must have an included biotype.
    Expression that is missing or not a number drops the record.
    """
    include, exclude = include or ["all"], exclude or []
    kv = F.col("_kv")
    got = records.withColumn("_kv", header_values(F.col("description"))).withColumn("_cds", coding_range(F.try_element_at(kv, F.lit("CDS"))))
    has_cds = F.col("_cds").isNotNull()
    if biotype_key:
        biotype = F.coalesce(F.try_element_at(kv, F.lit(biotype_key)), F.lit(""))
        wanted = (biotype != "") & ~biotype.isin(*exclude) & (F.lit(True) if include == ["all"] else biotype.isin(*include))
        got = got.filter((has_cds & F.lit(not skip_cds or alternative)) | wanted)
    if expression_key:
        got = got.filter(F.try_element_at(kv, F.lit(expression_key)).try_cast("double") >= expression_least)
    coding = has_cds & F.lit(not alternative)
    part = F.substring(F.col("seq"), F.col("_cds.start"), F.col("_cds.end") - F.col("_cds.start") + 1)
    read = F.when(coding, F.array(translate(part, table))).otherwise(orfs(F.col("seq"), forward, backward, table))
    return got.select("id", F.posexplode(read).alias("frame", "seq"))
