"""Substring dedup by hashing lines and the sentences inside them.

A text is cut into lines and those, after a full stop, question or exclamation mark and
white space, into sentences: its units, each with its offsets in the original text. A
unit's digest is a 64-bit hash of its words (lower-cased runs of letters and digits). Digests
are grouped globally; the occurrence of the least rank (doc_id, then the text's hash, then
place) stays, and every other one is repeated. A maximal run of repeated units that stand
next to each other in a text is removed if it has at least ``min_words`` words; with 1, the
default, every repeated unit goes, however short. Offsets of what is removed are
kept.

Digest groups are never gathered: the first occurrence is a partially aggregated minimum,
written apart, and joined back to the units of digests that occur twice, where adaptive
execution splits a hot digest. Texts are cut once: units are written with their offsets.
What is gathered is a text's own list of units.

Defined results: every row has a result; rows with equal doc_id and text are one document and
get the same one;
null ids rank last (a kept document without an id shows as null in ``kept_docs``); null and empty texts and units without a word lose nothing; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.llm.common import Stored, hash_bytes, map_batches, shingle_words
from ribospark.plans.runtime import cut

_END = re.compile(r"(?<=[.!?])(?=\s)|\n")


def units(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, end, words, digest) of the units of a text that have a word, in order."""
    out: list[tuple[int, int, int, int]] = []
    if not text:
        return out
    at = 0
    for end, after in [*(m.span() for m in _END.finditer(text)), (len(text), len(text))]:
        unit = text[at:end]
        words = shingle_words(unit)
        if words:
            start = end - len(unit.lstrip())
            out.append((start, end, len(words), hash_bytes(" ".join(words).encode("utf-8", "surrogatepass"))))
        at = after
    return out


def removed_runs(places: list[int], sizes: list[int], least: int) -> list[tuple[int, int]]:
    """Runs [i, j) of marked units, given by place and words, that stand next to each other and have at least ``least`` words."""
    out, i = [], 0
    for j in range(1, len(places) + 1):
        if j == len(places) or places[j] != places[j - 1] + 1:
            if sum(sizes[i:j]) >= least:
                out.append((i, j))
            i = j
    return out


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """Every document: doc_id, n_units, n_removed, removed_words, longest_run (words), starts and ends of the removed runs, kept_docs (where their units stay), kept_text."""
    taken = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_h", F.xxhash64("_text"))

    def rows(batches: Iterator[dict]):
        for b in batches:
            for at in range(0, len(b["_id"]), 500):
                found = [units(t.as_py()) for t in b["_text"][at : at + 500]]
                n = np.array([len(u) for u in found])
                if n.sum():
                    start, end, words, digest = zip(*(u for x in found for u in x))
                    own = np.repeat(np.arange(len(n)), n)
                    yield {"_id": b["_id"][at : at + 500].take(own), "_h": b["_h"][at : at + 500].take(own), "place": np.concatenate([np.arange(x) for x in n]), "units": n[own], "start": start, "end": end, "words": words, "digest": digest}

    stored = Stored(map_batches(taken, rows, "_id long, _h long, place int, units int, start int, end int, words int, digest long"))
    every = stored.table
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_h").alias("h"), F.col("place").alias("place"))
    # written apart: the join is then between two plain shuffles, which adaptive execution can split
    first = cut(every.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("digest", "first"))
    repeated = every.join(first, "digest").filter(rank != F.col("first"))
    fields = ("place", "units", "start", "end", "words", "kept")
    marks = repeated.groupBy("_id", "_h").agg(F.collect_set(F.struct("place", "units", "start", "end", "words", F.col("first.id").alias("kept"))).alias("marks"))
    marks = cut(marks.select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), *(F.col(f"marks.{c}").alias(c) for c in fields)))
    stored.drop()
    joined = taken.join(marks, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left").select("_id", "_text", *fields)

    def cut_out(batches: Iterator[dict]):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_units", "n_removed", "removed_words", "longest_run", "starts", "ends", "kept_docs", "kept_text")}
            for i in range(len(b["_id"])):
                text, lost = b["_text"][i].as_py() or "", b["place"][i].is_valid
                marked = sorted(zip(*(b[c][i].as_py() for c in ("place", "start", "end", "words", "kept"))), key=lambda m: m[0]) if lost else []
                runs = removed_runs([m[0] for m in marked], [m[3] for m in marked], min_words)
                starts, ends = [marked[i][1] for i, _ in runs], [marked[j - 1][2] for _, j in runs]
                pieces = [text[a:z] for a, z in zip([0, *ends], [*starts, len(text)])]
                docs_kept = {marked[k][4] for i, j in runs for k in range(i, j)}
                docs_kept = sorted(docs_kept - {None}) + [None] * (None in docs_kept)
                words = [sum(m[3] for m in marked[i:j]) for i, j in runs]
                n_units = b["units"][i][0].as_py() if lost else len(units(text))
                row = (b["_id"][i].as_py(), n_units, sum(j - i for i, j in runs), sum(words), max(words, default=0), starts, ends, docs_kept, "".join(pieces))
                for name, value in zip(out, row):
                    out[name].append(value)
            yield out

    return map_batches(joined, cut_out, "doc_id long, n_units long, n_removed long, removed_words long, longest_run long, starts array<int>, ends array<int>, kept_docs array<long>, kept_text string")
