"""Variant filters on streams: the stateless filters as they are, distinct pairs within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.operators.variant_proteins import clinical_filter, filter_variants


def streamed_filter(stream: DataFrame, **options) -> DataFrame:
    """``filter_variants`` on a stream of variant records: row-local, so no state is kept."""
    return filter_variants(stream, **options)


def streamed_clinical_filter(stream: DataFrame, excluded: list[str], included: list[str]) -> DataFrame:
    return clinical_filter(stream, excluded, included)


def distinct_within(stream: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """One record for each (chrom, pos, ref, alt) within the watermark; state older than ``delay`` is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["chrom", "pos", "ref", "alt"])


def windowed_counts(stream: DataFrame, time: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Records by event-time window and chromosome; late records count until the watermark passes."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), "chrom").agg(F.count(F.lit(1)).alias("n"))
