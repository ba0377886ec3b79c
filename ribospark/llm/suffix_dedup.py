"""Exact substring dedup with suffix arrays built by grouping (Lyndon prefixes).

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else, in any
document, is removed. Strings are judged on the input; matches never cross documents.

A corpus has no single suffix array here. Strings that can be equal are brought together:

1. Every start of a ``LENGTH``-byte window picks the least hash among the ``GRAM``-byte strings
   inside the window (leftmost of equals). Equal windows pick the same string at the same
   offset, so starts fall into runs by picked place, and by ``BLOCK`` offsets within a run.
   All windows of such a short run contain one common core; equal windows have equal cores,
   so a run whose core (a 64-bit key) occurs nowhere else has no repeated window.
2. Of the runs whose key occurs again, equal ones (same bytes, same place in the core) are
   collapsed: two copies repeat all their windows. The distinct ones of a key go to one
   task, which concatenates the runs of many keys into a text of bounded size, writes a core
   as one symbol (all windows of a run hold it whole) and builds the text's suffix array;
   neighbours in it that agree on a window's symbols are repeated windows.
3. Repeated starts go back to their documents, which are cut.

The suffix array is built without recursive renaming: phase 1 takes the groups of suffixes
(at first by first byte) in descending order, follows previous-smaller pointers to the
suffixes that precede a group's members, and moves those, most pointed-to first, to new
groups behind their old ones, so that groups end up ordered by Lyndon prefix; phase 2 reads
the array from the left and lets every placed suffix induce the place of the suffixes
before it along the same pointers.

A key with more than ``HOT`` distinct runs would be an unbounded group for one task; its
windows are compared by hash with a distributed aggregation instead (an exact way of its
own: equal windows, equal key and hash). Hashes have 64 bits; digests and window hashes
count together with their key, cores are compared by their bytes.

Defined results: a null text is empty; rows with equal doc_id and text share a result but
count as two documents; texts under ``LENGTH`` bytes lose nothing; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.llm.common import Stored, map_batches
from ribospark.plans.runtime import cut

LENGTH, GRAM, BLOCK, HOT = 400, 32, 128, 2000
CORE = LENGTH - BLOCK + 1
#: Window starts that are looked at together, and symbols of one suffix array.
PIECE, TEXT = 1 << 20, 1 << 15
_MIX = np.random.default_rng(29).integers(1, 2**63, 256).astype(np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a sequence of non-negative ints whose last one is its only least one."""
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    group, ends, members, at = [0] * n, [0] * n, {}, 0  # group: start of a suffix's group; ends: last slot -> start
    for c in sorted(by_symbol):
        own = by_symbol[c]
        members[at] = own
        for i in own:
            group[i] = at
        ends[at + len(own) - 1] = at
        at += len(own)
    size = {s: len(m) for s, m in members.items()}
    before = [-1] * n
    last = n - 1
    while last >= 0:
        g = ends[last]
        last = g - 1
        pointed: dict[int, int] = {}
        for i in sorted(members.pop(g)) if size[g] > 1 else members.pop(g):
            if group[i] == g:  # not moved to another group since it was listed
                p = i - 1
                while p >= 0 and group[p] >= g:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
        if not pointed:
            continue
        split: dict[int, dict[int, list[int]]] = {}
        for p, times in pointed.items():
            split.setdefault(times, {}).setdefault(group[p], []).append(p)
        for times in sorted(split, reverse=True):
            for old, moved in split[times].items():
                have, many = size[old], len(moved)
                if many == have:
                    continue  # the whole group moves behind itself
                new = old + have - many
                size[old], size[new], members[new] = have - many, many, moved
                ends[new + many - 1], ends[new - 1] = new, old
                for p in moved:
                    group[p] = new
    out, slot = [-1] * n, list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[slot[g]] = j
            slot[g] += 1
            placed[j] = 1
            j = before[j]
    return out


def repeated_starts(regions: list[list[int]], length: int) -> list[list[int]]:
    """For every sequence, the starts whose window of ``length`` symbols occurs at another start of the sequences."""
    text: list[int] = []
    for r in regions:
        text += [b + 2 for b in r]
        text.append(1)
    sizes = np.array([len(r) + 1 for r in regions])
    owner = np.repeat(np.arange(len(regions)), sizes)
    inside = np.arange(len(text)) - np.repeat(sizes.cumsum() - sizes, sizes)
    able = inside + length < np.repeat(sizes, sizes)
    order = np.array(suffix_array([*text, 0]))[1:]
    found = np.zeros(len(text), bool)
    close = np.flatnonzero(able[order[:-1]] & able[order[1:]])
    for a, b in zip(order[close].tolist(), order[close + 1].tolist()):
        if text[a : a + length] == text[b : b + length]:
            found[a] = found[b] = True
    out: list[list[int]] = [[] for _ in regions]
    for i in np.flatnonzero(found):
        out[owner[i]].append(int(inside[i]))
    return out


def picked_places(data: np.ndarray) -> np.ndarray:
    """For every window start, the place of the least gram hash inside the window."""
    h, width = _MIX[data], 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * _A + h[width:] * _B
            h ^= h >> np.uint64(29)
            width *= 2
    n, span = len(h), LENGTH - GRAM + 1
    keyed = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keyed
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    starts = len(data) - LENGTH + 1
    return (np.minimum(ahead[:starts], behind[span - 1 : span - 1 + starts]) & np.uint64(0xFFFFFF)).astype(np.int64)


def short_runs(data: bytes) -> list[tuple[int, int, int, int, int, int]]:
    """(start, starts, repetitions, key, digest, place of the core) of the runs of window starts of a text.

    ``repetitions`` equal runs may follow one another directly.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    for base in range(0, len(data) - LENGTH + 1, PIECE):
        piece = data[base : base + PIECE + LENGTH - 1]
        place = picked_places(np.frombuffer(piece, np.uint8))
        block = (place - np.arange(len(place))) // BLOCK
        edge = np.flatnonzero((np.diff(place) != 0) | (np.diff(block) != 0)) + 1
        starts = np.concatenate([[0], edge]).tolist()
        stops = np.concatenate([edge, [len(place)]]).tolist()
        for a, z, p, b in zip(starts, stops, place[starts].tolist(), block[starts].tolist()):
            c = p - b * BLOCK
            key = xxhash.xxh3_64_intdigest(piece[c : c + CORE], b)
            digest = xxhash.xxh3_64_intdigest(piece[a : z + LENGTH - 1], p - a)
            if out and out[-1][3] == key and out[-1][4] == digest and out[-1][1] == z - a and out[-1][0] + out[-1][1] * out[-1][2] == base + a:
                s, n, times, *_ = out[-1]
                out[-1] = (s, n, times + 1, key, digest, c - a)
            else:
                out.append((base + a, z - a, 1, key, digest, c - a))
    return out


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def repeated_spans(intervals: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows whose starts are the [first, last] of ``intervals``."""
    out: list[list[int]] = []
    for a, z in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z + length)
        else:
            out.append([a, z + length])
    return [(a, z) for a, z in out]


def _ranges(starts: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and out[-1][1] == s - 1:
            out[-1] = (out[-1][0], s)
        else:
            out.append((s, s))
    return out


def _runs(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[dict]):
        for b in batches:
            for at in range(0, len(b["_k"]), 200):
                found = [short_runs(t.as_py()) for t in b["_bytes"][at : at + 200]]
                flat = [r for f in found for r in f]
                if flat:
                    s, n, times, key, digest, core = zip(*flat)
                    yield {"doc": b["_k"][at : at + 200].take(np.repeat(np.arange(len(found)), [len(f) for f in found])), "start": s, "starts": n, "times": times, "key": _signed(key), "digest": _signed(digest), "core": core}

    return map_batches(docs, rows, "doc long, start int, starts int, times int, key long, digest long, core int")


def _judged(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, digest, firsts, lasts): the repeated starts, as ranges inside a run, of the runs that have any."""
    kinds = runs.groupBy("key", "digest").agg(F.sum("times").alias("n"), F.min(F.struct("doc", "start", "starts", "core")).alias("at"))
    kinds = cut(kinds)
    per_key = cut(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")))  # apart, so that a hot key's join can be split
    kinds = kinds.join(per_key, "key")
    alone = kinds.filter("kinds = 1").select("key", "digest", F.array(F.lit(0)).alias("firsts"), F.array((F.col("at.starts") - 1).cast("int")).alias("lasts"))
    several = kinds.filter("kinds > 1")
    asked = several.groupBy(F.col("at.doc").alias("doc")).agg(F.collect_list(F.struct("key", "digest", "n", "kinds", F.col("at.start").alias("start"), F.col("at.starts").alias("starts"), F.col("at.core").alias("core"))).alias("x"))
    asked = asked.select("doc", *(F.col(f"x.{c}").alias(c) for c in ("key", "digest", "n", "kinds", "start", "starts", "core")))
    texts = docs.join(asked, docs["_k"] == asked["doc"]).dropDuplicates(["doc"]).drop("doc", "_k")

    def regions(batches: Iterator[dict]):
        for b in batches:
            for i in range(len(b["key"])):
                data, starts, sizes = b["_bytes"][i].as_py(), b["start"][i].as_py(), b["starts"][i].as_py()
                cuts = [data[s : s + n + LENGTH - 1] for s, n in zip(starts, sizes)]
                hot = [k > HOT for k in b["kinds"][i].as_py()]
                hashes = [[xxhash.xxh3_64_intdigest(c[o : o + LENGTH]) - 2**63 for o in range(len(c) - LENGTH + 1)] if on else None for c, on in zip(cuts, hot)]
                yield {"key": b["key"][i].values, "digest": b["digest"][i].values, "n": b["n"][i].values, "core": b["core"][i].values, "hot": hot, "bytes": [None if on else c for c, on in zip(cuts, hot)], "windows": hashes}

    fetched = cut(map_batches(texts, regions, "key long, digest long, n long, core int, hot boolean, bytes binary, windows array<long>"))

    def sorted_suffixes(batches: Iterator[dict]):
        held: list[tuple[int, int, int, list[int]]] = []
        cores: dict[bytes, int] = {}

        def done() -> dict:
            found = repeated_starts([h[3] for h in held], BLOCK)  # a window is its core and BLOCK - 1 bytes
            found = [_ranges(f) if n < 2 else [(0, len(r) - BLOCK)] for f, (_, _, n, r) in zip(found, held)]
            on = [i for i, f in enumerate(found) if f]
            out = {"key": [held[i][0] for i in on], "digest": [held[i][1] for i in on], "firsts": [[a for a, _ in found[i]] for i in on], "lasts": [[z for _, z in found[i]] for i in on]}
            held.clear()
            cores.clear()
            return out

        total = 0
        for b in batches:
            for key, digest, n, core, data in zip(*(b[c].to_pylist() for c in ("key", "digest", "n", "core", "bytes"))):
                if total >= TEXT and held[-1][0] != key:  # the runs of a key stay together
                    yield done()
                    total = 0
                symbol = cores.setdefault(data[core : core + CORE], 256 + len(cores))
                held.append((key, digest, n, [*data[:core], symbol, *data[core + CORE :]]))
                total += len(held[-1][3])
        if held:
            yield done()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as the work isn't in the bytes
    sorted_runs = fetched.filter("not hot").select("key", "digest", "n", "core", "bytes").repartition(parts, "key").sortWithinPartitions("key", "digest")
    cold = map_batches(sorted_runs, sorted_suffixes, "key long, digest long, firsts array<int>, lasts array<int>")
    windows = fetched.filter("hot").select("key", "digest", "n", F.posexplode("windows").alias("o", "w"))
    often = windows.groupBy("key", "w").agg(F.sum("n").alias("m")).filter("m > 1").select("key", "w")
    hot = windows.join(often, ["key", "w"]).groupBy("key", "digest").agg(F.array_sort(F.collect_list(F.col("o").cast("int"))).alias("firsts"))
    return alone.unionByName(cold).unionByName(hot.withColumn("lasts", F.col("firsts")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed spans (starts, ends) and the kept bytes of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    taken = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("_k"), text.cast("binary").alias("_bytes"))
    able = taken.select("_k", "_bytes").filter(F.octet_length("_bytes") >= LENGTH)
    stored = Stored(_runs(able))
    again = cut(stored.table.groupBy("key").agg(F.sum("times").alias("n")).filter("n > 1").select("key"))
    runs = cut(stored.table.join(again, "key"))
    stored.drop()
    judged = _judged(able, runs)
    back = runs.join(judged, ["key", "digest"]).groupBy("doc").agg(F.collect_set(F.struct("start", "starts", "times", "firsts", "lasts")).alias("x"))
    marks = back.select(F.col("doc"), *(F.col(f"x.{c}").alias(c) for c in ("start", "starts", "times", "firsts", "lasts")))
    joined = taken.join(marks, taken["_k"] == marks["doc"], "left").drop("doc", "_k")

    def cut_out(batches: Iterator[dict]):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "kept")}
            for i in range(len(b["_id"])):
                data, spans = b["_bytes"][i].as_py(), []
                if b["start"][i].is_valid:
                    hit = zip(*(b[c][i].as_py() for c in ("start", "starts", "times", "firsts", "lasts")))
                    spans = repeated_spans([(s + k * n + a, s + k * n + z) for s, n, times, firsts, lasts in hit for k in range(times) for a, z in zip(firsts, lasts)])
                kept = b"".join(data[a:z] for a, z in zip([0, *(z for _, z in spans)], [*(a for a, _ in spans), len(data)]))
                row = (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [a for a, _ in spans], [z for _, z in spans], kept)
                for name, value in zip(out, row):
                    out[name].append(value)
            yield {"doc_id": b["_id"], **out}

    return map_batches(joined, cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>, kept binary")
