"""Benchmark decontamination: size-partitioned MinHash containment search with exact checks.

The question is containment, |Q and X| / |Q| >= ``threshold``, of the five-word shingles of
a short test item Q in those of a document X that may be thousands of times longer. Items
are partitioned by their number of distinct shingles; a partition [2^k, 2^(k+1)) has a table
and a signature length of its own, and an item's signature is its minimal shingle under each
of that many hash functions. A symmetric signature of X would hardly ever agree with it
(the Jaccard similarity of a long X is near zero), so X is asked whether it holds Q's
minimal shingles: for every hash function that has exactly the probability of the
containment, whatever the length of X. The items of the first partitions have no more
shingles than hash functions and keep all of them; later ones need fewer of theirs. X is
looked up only in the partitions whose items it is long enough to contain. Documents that
hold at least ``need`` of a signature's shingles (set by partition so that a containment at
the threshold is missed with a probability under ``miss``) and have enough distinct shingles
are candidates; a candidate counts only after its shingles have been compared with the
item's as tuples of words.

The benchmark is the stated query set: it is dealt by a hash of the item into blocks of
about ``BLOCK_SHINGLES`` shingles, each of which goes to the executors for a pass over the
documents of its own. A benchmark of one block is one pass; of a larger one the driver and
every task hold one block at a time, and what each pass finds is written to the shared
folder before the next begins. Nothing else is broadcast and nothing is shuffled.

Shingles: words are runs of letters, digits and marks, lower-cased, so white space and punctuation
don't matter. An item of one to four words is one shingle of all its words, looked for as it
stands; for ``drop_contaminated`` such an item must be all that the document says, unless
``least_words`` says otherwise, because ordinary texts hold a few words by chance.

Defined results: null or empty texts match nothing; repeated documents are reported each;
items with the same shingles are reported each, repeated rows of an item (which are looked for
once) as often as they come; an empty table on either side gives an empty result; other columns
are not read, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.llm.common import WordHashes, fresh, frugal, map_batches, mix, shingle_hashes, shingle_words
from ribospark.plans.runtime import cut

SHINGLE = 5
#: Words, and so about shingles, of one block of the benchmark.
BLOCK_SHINGLES = 2_000_000


def _tuples(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return set(zip(*(words[k:] for k in range(size))))


def needed_hits(n_hashes: int, threshold: float, miss: float) -> int:
    """The largest number of hits that a containment at the threshold reaches but for a probability under ``miss``."""
    below, need = 0.0, 0
    for hits in range(n_hashes):
        below += math.comb(n_hashes, hits) * threshold**hits * (1 - threshold) ** (n_hashes - hits)
        if below > miss:
            break
        need = hits + 1
    return max(1, need)


def signature_length(size_class: int) -> int:
    """Hash functions of the partition of items with 2^size_class shingles and more: fewer where there are more shingles to take minima of."""
    return max(20, 32 - 2 * size_class)


class Partition:
    """The signatures of items of one size class: a sorted table of shingle hashes and the items that ask for each."""

    def __init__(self, signatures: list[tuple[int, np.ndarray]], smallest: int):
        self.smallest = smallest  # fewer shingles than this contain none of the items
        flat = np.concatenate([k for _, k in signatures])
        owners = np.repeat(np.array([i for i, _ in signatures]), [len(k) for _, k in signatures])
        order = flat.argsort(kind="stable")
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.last = np.append(self.first[1:], len(flat))
        self.owners = owners[order]

    def hits(self, shingles: np.ndarray, items: int) -> np.ndarray:
        """How many signature shingles of every item are among the distinct ``shingles``."""
        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        at = at[self.keys[at] == shingles]
        if len(at) == 0:
            return np.zeros(items, np.int64)
        return np.bincount(np.concatenate([self.owners[self.first[i] : self.last[i]] for i in at]), minlength=items)


class ContainmentIndex:
    """A block of items: partitions by size, and the items under ``SHINGLE`` words by their number of words."""

    def __init__(self, items: list[tuple], threshold: float = 0.8, miss: float = 1e-6, least_words: int = 1):
        hashes, self.ids, self.counts, self.words, need, least = WordHashes(), [], [], [], [], []
        self.least_words, self.whole = least_words, {}  # what is too short for a search is held against whole texts
        signed: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.short: dict[int, dict[tuple[str, ...], list[int]]] = {}
        for item_id, text, *times in items:
            words = shingle_words(text)
            if not words:
                continue
            number = len(self.ids)
            self.ids.append(item_id)
            self.counts.append(times[0] if times else 1)
            self.words.append(words)
            if len(words) < least_words:
                self.whole.setdefault(tuple(words), []).append(number)
                need.append(1)
                least.append(1)
                continue
            if len(words) < SHINGLE:
                self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(number)
                need.append(1)
                least.append(1)
                continue
            shingles = np.unique(shingle_hashes(np.fromiter((hashes[w] for w in words), np.uint64, len(words)), SHINGLE))
            size_class = len(shingles).bit_length() - 1
            most, n_hashes = math.ceil(threshold * len(shingles) - 1e-9), signature_length(size_class)
            if 2 ** (size_class + 1) <= n_hashes:
                signature, hits = shingles, most
            else:
                signature = np.unique([shingles[mix(shingles ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (2**64 - 1))).argmin()] for k in range(n_hashes)])
                # hash functions that share a minimum are hit together: their number bounds the lost hits
                hits = max(1, needed_hits(n_hashes, threshold, miss) - (n_hashes - len(signature)))
            signed.setdefault(size_class, []).append((number, signature))
            need.append(hits)
            least.append(most)
        self.need, self.least = np.array(need, np.int64), np.array(least, np.int64)
        self.partitions = [Partition(signed[k], math.ceil(threshold * 2**k - 1e-9)) for k in sorted(signed)]
        self.filter = np.zeros(1 << 20, bool)
        for p in self.partitions:
            self.filter[(p.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self._sets: dict[int, set] = {}

    def shingles(self, item: int) -> set[tuple[str, ...]]:
        if item not in self._sets:
            if len(self._sets) > 10_000:
                self._sets.clear()
            self._sets[item] = _tuples(self.words[item], min(SHINGLE, len(self.words[item])))
        return self._sets[item]

    def search(self, words: list[str], hashes: WordHashes) -> list[tuple[int, int, int]]:
        """(item number, its shingles, those that the document holds) of all items contained in the words."""
        out = [(c, 1, 1) for c in self.whole.get(tuple(words), ())] if len(words) < self.least_words else []
        for size, asked in self.short.items():
            out += [(c, 1, 1) for words_of in asked.keys() & _tuples(words, size) for c in asked[words_of]]
        if not self.partitions or len(words) < SHINGLE:
            return out
        shingles = shingle_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), SHINGLE)
        many = len(shingles)
        shingles = shingles[self.filter[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)]]
        if len(shingles) == 0:
            return out
        shingles, hits = np.unique(shingles), np.zeros(len(self.ids), np.int64)
        for p in self.partitions:
            if p.smallest > many:
                break
            hits += p.hits(shingles, len(self.ids))
        candidates = np.flatnonzero((hits >= self.need) & (hits > 0))
        if len(candidates) == 0:
            return out
        own = _tuples(words)
        for c in candidates.tolist():
            if len(own) >= self.least[c] and (both := len(self.shingles(c) & own)) >= self.least[c]:
                out.append((c, len(self.shingles(c)), both))
        return out


def _blocks(docs: DataFrame, items: DataFrame, item_id: str, text_col: str, threshold: float, least_words: int) -> tuple[int, Callable]:
    """The number of the benchmark's blocks, and a function that broadcasts the index of one."""
    sc = docs.sparkSession.sparkContext
    asked = items.select(F.col(item_id).cast("long").alias("_item"), F.col(text_col).cast("string").alias("_text")).filter("_text is not null")
    asked = asked.groupBy("_item", "_text").agg(F.count(F.lit(1)).alias("_times"))
    asked = asked.withColumn("_words", F.regexp_count("_text", F.lit(r"[\p{L}\p{N}\p{M}_]++")).cast("long"))
    blocks = max(1, -(-int(asked.agg(F.sum("_words").alias("n")).first()["n"] or 0) // BLOCK_SHINGLES))

    def block(number: int):
        own = asked.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == number).select("_item", "_text", "_times").collect()
        return sc.broadcast(ContainmentIndex(sorted(map(tuple, own), key=lambda r: (r[0] is None, r[0] or 0, r[1])), threshold, least_words=least_words))

    return blocks, block


def _searched(taken: DataFrame, shared, keep: str) -> DataFrame:
    """The pairs that one block finds in ``taken`` (_id, _text and the long column ``keep``)."""
    names = ("doc_id", keep, "item_id", "item_shingles", "shared_shingles", "containment")

    def rows(batches: Iterator[dict]):
        index, hashes = shared.value, WordHashes()
        for b in batches:
            found = []
            for i, k, t in zip(b["_id"].to_pylist(), b[keep].to_pylist(), b["_text"]):
                for c, n, both in index.search(shingle_words(t.as_py()), hashes):
                    found += [(i, k, index.ids[c], n, both, both / n)] * index.counts[c]
            if found:
                yield dict(zip(names, zip(*found)))

    return map_batches(taken.select("_id", keep, "_text"), rows, f"doc_id long, {keep} long, item_id long, item_shingles long, shared_shingles long, containment double")


def find_contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", threshold: float = 0.8, least_words: int = 1) -> DataFrame:
    """Pairs (doc_id, _h, item_id, item_shingles, shared_shingles, containment) with containment at or over the threshold; ``_h`` is the text's hash."""
    text = F.col(text_col).cast("string")
    taken = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text")).filter("_text is not null")
    blocks, block = _blocks(docs, items, item_id, text_col, threshold, least_words)
    if blocks == 1:
        return _searched(taken, block(0), "_h")
    found = None
    for number in range(blocks):
        shared = block(number)
        part = cut(_searched(taken, shared, "_h"))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", threshold: float = 0.8, least_words: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, all columns kept: for a benchmark of one block a filter without a shuffle."""
    blocks, block = _blocks(docs, items, item_id, text_col, threshold, least_words)
    if blocks > 1:
        found = find_contained(docs, items, doc_id, item_id, text_col, threshold, least_words)
        leak_id, leak_hash = fresh(docs.columns, "_leak_id"), fresh(docs.columns, "_leak_h")
        found = found.select(F.col("doc_id").alias(leak_id), F.col("_h").alias(leak_hash)).distinct()
        own = F.col(doc_id).cast("long").eqNullSafe(F.col(leak_id)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(leak_hash))
        return docs.join(found, own, "left_anti")
    shared = block(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = shared.value, WordHashes()
        for b in batches:
            yield b.filter(pa.array([not index.search(shingle_words(t.as_py()), hashes) for t in b.column(text_col)], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
