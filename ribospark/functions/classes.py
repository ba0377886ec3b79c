"""Peptides by the classes of the proteins that hold them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_groups(text: str) -> dict[str, list[str]]:
    """Groups of classes written as ``{name:[class,class]};{name:[class]}``; a name alone, or several with commas, are groups of themselves."""
    found = re.findall(r"\{?([^{}:;\[\]]+):\[([^\]]*)\]\}?", text)
    if found:
        return {name: [c for c in members.split(",") if c] for name, members in found}
    return {c: [c] for c in text.split(",") if c}


def in_group(accessions: Column, members: list[str]) -> Column:
    """Whether the accessions hold the group's classes as often as there are accessions: each exactly one, in the usual case."""
    hits = lambda a: sum((F.contains(a, F.lit(m)).cast("int") for m in members), F.lit(0))
    return F.aggregate(F.transform(accessions, hits), F.lit(0), lambda total, n: total + n) == F.size(accessions)


def has_prefix(accessions: Column, prefix: str) -> Column:
    """Whether any accession holds the prefix of decoys."""
    return F.exists(accessions, lambda a: F.contains(a, F.lit(prefix)))
