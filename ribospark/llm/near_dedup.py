"""MinHash near-dedup with BagMinHash signatures of multisets of shingles.

A text is the multiset of its five-word shingles; the similarity is the weighted Jaccard
sum(min counts) / sum(max counts). BagMinHash gives every (shingle, unit of weight) a Poisson
process; the j-th signature component is the earliest point with mark j. The weights are
discretised at the integers, so nothing is lost, and the processes are hierarchical: the
unit intervals [0,1), [1,2), then [2,4), [4,8), ... have one process each, of a rate equal to
their width, whose points carry a location inside the interval; of the topmost interval only
the points under the weight are kept (Poisson thinning). A shingle that occurs w times
thus costs log2(w) processes, and two components agree with exactly the probability of the
weighted Jaccard. Points are drawn in order of time up to a limit by which all components
are nearly always filled; a text with an empty one is drawn again with twice the limit.

Candidates share one of ``bands`` bands of ``rows`` components: at the threshold of 0.8 a
pair is missed with a probability of (1 - 0.8^5)^30 = 7e-6. Candidates first compare
signatures (estimates under ``threshold - 0.2``, six standard errors, are dropped), then
their shingle multisets exactly.

No bucket is expanded into all its pairs. Texts with equal multisets are collapsed first.
Every text of a bucket is linked to the bucket's most central text (the one that shares
most buckets), those links are verified and components merged. Buckets that still hold
several classes are gathered by their central text and compared across classes: the members
outside a group's largest class ask all members, in units of at most about ``BLOCK`` askers
and ``BLOCK`` asked (fewer of long texts), of which only links come out. So a group of n
members, k of them outside its largest class, makes about n + k + 2 x n x k / ``BLOCK`` rows
(asking whether two texts are alike can't be saved where each may be a link). A group of over ``LARGE`` members is first dealt by longer keys (``DEALS`` choices of ``AGREE``
signature components), whose members are compared before the group: most links are found there,
so that few members stay outside the largest class. Then the group is compared whole as any other
as long as it holds several classes, so no link depends on the longer keys.
Hot keys are joined under adaptive skew splitting and minima are aggregated partially.

Texts are identified by 64 bits of their multiset's hash. Defined results: a text of one to
four words is one shingle of all its words; a null text is empty; texts without a word are
in one class if they are equal; the class id is the least doc_id of the class (nulls are
larger than all), and where no row of a class has an id a negative number of the class's
own; repeated rows are in one class; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.llm.common import WordHashes, fresh, hash_bytes, key_filter, map_batches, mix, shingle_hashes, shingle_words
from ribospark.llm.components import components
from ribospark.plans.runtime import cut

SHINGLE, BANDS, ROWS = 5, 30, 5
SIZE = BANDS * ROWS
#: Texts whose signatures are drawn together.
CHUNK = 250
#: Members, and shingles, of a block in the comparison across classes; members of a group that is dealt anew.
BLOCK, WEIGHT, LARGE = 512, 400_000, 200_000
#: Choices of signature components that deal a large group, and components of each.
DEALS, AGREE = 72, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bag(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a text, ascending, and their counts."""
    words = shingle_words(text)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return np.unique(shingle_hashes(codes, min(SHINGLE, max(1, len(words)))), return_counts=True)


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """Signatures (texts by components) of non-empty multisets."""
    out = np.zeros((len(bags), size), np.uint32)
    todo, limit = np.arange(len(bags)), size * (np.log(size) + 6)
    while len(todo):
        full = _draw([bags[i] for i in todo], size, limit, out, todo)
        todo, limit = todo[~full], limit * 2
    return out


def _draw(bags, size, limit, out, at) -> np.ndarray:
    """Fill the signatures of ``bags`` into ``out[at]``; false for those that ``limit`` was too short for."""
    x = np.concatenate([b[0] for b in bags])
    w = np.concatenate([b[1] for b in bags]).astype(np.int64)
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    stop = limit / np.bincount(doc, w, len(bags))
    best = np.full(len(bags) * size, np.inf)
    value = np.zeros(len(bags) * size, np.uint32)
    low, high, level = 0, 1, 0
    held = np.arange(len(x))
    while len(held):
        offset = np.uint64((2 * level + 1) * int(_STEP) & (2**64 - 1))
        seed, weight, where = mix(x[held] + offset), w[held], doc[held]
        time, width, step = np.zeros(len(held)), high - low, 0
        while len(seed):
            many = min(64, max(1, 50_000 // len(seed)))  # points of each process drawn at once
            steps = np.arange(step + 1, step + many + 1, dtype=np.uint64) * _STEP
            step += many
            r = mix(seed[:, None] + steps)
            times = np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / -width
            times = times.cumsum(axis=1) + time[:, None] if many > 1 else times + time[:, None]
            on = times <= stop[where][:, None]
            row = np.nonzero(on)[0]
            r2, t = mix(r[on] ^ np.uint64(0xD6E8FEB86659FD93)), times[on]
            slot = where[row] * size + (r2 & np.uint64(0xFFFFFF)).astype(np.int64) % size
            v = (r2 >> np.uint64(32)).astype(np.uint32)
            if width > 1:
                inside = low + (r2 >> np.uint64(24)).astype(np.int64) % width < weight[row]
                slot, t, v = slot[inside], t[inside], v[inside]
            np.minimum.at(best, slot, t)
            won = best[slot] == t
            value[slot[won]] = v[won]
            stop = np.minimum(stop, best.reshape(-1, size).max(axis=1))  # later points can't win any more
            go = times[:, -1] <= stop[where]
            seed, weight, where, time = seed[go], weight[go], where[go], times[go, -1]
        held = held[w[held] > high]
        low, high, level = high, 2 * high, level + 1
    full = np.isfinite(best).reshape(-1, size).all(axis=1)
    out[at[full]] = value.reshape(-1, size)[full]
    return full


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), signatures.shape[1] // ROWS, ROWS)
    key = mix(np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), parts.shape[:2]) * _STEP)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = mix(key * _STEP + parts[:, :, k])
    return key.view(np.int64)


def bag_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _node(b: tuple[np.ndarray, np.ndarray]) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(b[0].tobytes() + b[1].astype("<i8").tobytes()), "big", signed=True)


def _signed(docs: DataFrame) -> DataFrame:
    """id, text hash, node, total weight, band keys and signature; no keys and signature for a text without words."""

    def rows(batches: Iterator[dict]):
        hashes = WordHashes()
        for b in batches:
            for at in range(0, len(b["_id"]), CHUNK):
                bags = [bag(t.as_py(), hashes) for t in b["_text"][at : at + CHUNK]]
                able = [i for i, x in enumerate(bags) if len(x[0])]
                signatures = bag_minhash([bags[i] for i in able])
                keys, n = band_keys(signatures), len(bags)
                node, weight, band, sig = [0] * n, [0] * n, [None] * n, [None] * n
                for k, i in enumerate(able):
                    node[i], weight[i], band[i], sig[i] = _node(bags[i]), int(bags[i][1].sum()), keys[k], signatures[k].tobytes()
                for i in set(range(n)).difference(able):
                    node[i] = hash_bytes(b"text:" + (b["_text"][at + i].as_py() or "").encode("utf-8", "surrogatepass"))
                yield {"doc_id": b["_id"][at : at + CHUNK], "_h": b["_h"][at : at + CHUNK], "node": node, "weight": weight, "bands": band, "sig": sig}

    taken = docs.select("_id", "_h", "_text")
    return map_batches(taken, rows, "doc_id long, _h long, node long, weight long, bands array<long>, sig binary")


def _alike(pairs: DataFrame, texts: DataFrame, least: float, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weights and signatures allow the threshold."""
    side = texts.select("node", "weight", "sig")
    a, b = (side.select(*(F.col(c).alias(f"{c}_{s}") for c in side.columns)) for s in "ab")
    both = pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b"))
    both = both.filter(F.least("weight_a", "weight_b") >= threshold * F.greatest("weight_a", "weight_b"))

    def rows(batches: Iterator[dict]):
        for x in batches:
            sa, sb = (np.frombuffer(b"".join(x[c].to_pylist()), np.uint32).reshape(len(x["a"]), SIZE) for c in ("sig_a", "sig_b"))
            on = np.flatnonzero((sa == sb).mean(axis=1) >= least)
            on = pa.array(on, pa.int64())
            yield {"a": x["a"].take(on), "b": x["b"].take(on)}

    return map_batches(both.select("a", "b", "sig_a", "sig_b"), rows, "a long, b long")


def _bags(docs: DataFrame, nodes: DataFrame, first: DataFrame) -> DataFrame:
    """The multisets (node, shingles, counts) of the texts in ``nodes``, from one document of each."""
    wanted = cut(first.join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("_d"), F.col("_h").alias("_g")))
    asked = key_filter(wanted.select(F.xxhash64("_d", "_g")))  # so that the other texts aren't shuffled
    found = docs.filter(asked(F.xxhash64("_id", "_h"))).join(wanted, docs["_id"].eqNullSafe(wanted["_d"]) & (docs["_h"] == wanted["_g"])).select("node", "_text")

    def rows(batches: Iterator[dict]):
        hashes = WordHashes()
        for b in batches:
            bags = [bag(t.as_py(), hashes) for t in b["_text"]]
            yield {"node": b["node"], "x": [x.tobytes() for x, _ in bags], "n": [n.astype("<i4").tobytes() for _, n in bags]}

    return map_batches(found, rows, "node long, x binary, n binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose multisets reach the threshold."""
    a, b = (bags.select(*(F.col(c).alias(f"{c}_{s}") for c in bags.columns)) for s in "ab")
    both = pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b")).select("a", "b", "x_a", "n_a", "x_b", "n_b")

    def rows(batches: Iterator[dict]):
        for r in batches:
            on = []
            for i in range(len(r["a"])):
                sides = [(np.frombuffer(r[f"x_{s}"][i].as_py(), np.uint64), np.frombuffer(r[f"n_{s}"][i].as_py(), "<i4")) for s in "ab"]
                if bag_similarity(*sides) >= threshold - 1e-12:
                    on.append(i)
            kept = pa.array(on, pa.int64())
            yield {"a": r["a"].take(kept), "b": r["b"].take(kept)}

    return map_batches(both, rows, "a long, b long")


def _dealt(groups: DataFrame, texts: DataFrame) -> DataFrame | None:
    """The large ones of ``groups`` dealt by longer keys, as far as members of several classes meet; None without large ones."""
    size = cut(groups.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE))
    if size.isEmpty():
        return None
    large = groups.join(size.select("rep"), "rep").join(texts.select("node", "sig"), "node").select("rep", "node", "class", "sig")
    rng = np.random.default_rng(5)
    choice = np.array([rng.choice(SIZE, AGREE, replace=False) for _ in range(DEALS)])

    def rows(batches: Iterator[dict]):
        for b in batches:
            for at in range(0, len(b["node"]), CHUNK):
                sig = np.frombuffer(b"".join(b["sig"][at : at + CHUNK].to_pylist()), np.uint32).reshape(-1, SIZE).astype(np.uint64)
                key = mix(b["rep"][at : at + CHUNK].to_numpy().view(np.uint64)[:, None] + np.arange(1, DEALS + 1, dtype=np.uint64) * _STEP)
                with np.errstate(over="ignore"):
                    for k in range(AGREE):
                        key = mix(key * _STEP + sig[:, choice[:, k]])
                times = np.repeat(np.arange(len(sig)), DEALS)
                yield {"rep": key.view(np.int64).ravel(), "node": b["node"][at : at + CHUNK].take(times), "class": b["class"][at : at + CHUNK].take(times)}

    anew = cut(map_batches(large, rows, "rep long, node long, class long"))
    several = cut(anew.groupBy("rep").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("rep"))
    return anew.join(several, "rep").select("rep", "node", "class")


def _apart(groups: DataFrame, label: DataFrame) -> DataFrame:
    """``groups`` under the classes of ``label``, those of one class left out."""
    anew = groups.drop("class").join(label, "node", "left").select("rep", "node", F.coalesce("class", "node").alias("class"))
    several = anew.groupBy("rep").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("rep")
    return anew.join(several, "rep")


def _across(groups: DataFrame, texts: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different classes of the groups (rep, node, class)."""
    weighed = groups.join(texts.select("node", "weight"), "node")
    by_class = weighed.groupBy("rep", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    size = by_class.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "class")).alias("top"))
    parts = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / WEIGHT)).cast("int")
    size = cut(size.select("rep", F.col("top.class").alias("_top"), parts(F.col("n"), F.col("w")).alias("_is"), parts(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("_js")))
    marked = groups.join(size, "rep")
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = marked.select("rep", place(1, "_is").alias("i"), every("_js").alias("j"), F.lit(False).alias("asks"), "node", "class")
    asking = marked.filter(F.col("class") != F.col("_top")).select("rep", every("_is").alias("i"), place(2, "_js").alias("j"), F.lit(True).alias("asks"), "node", "class")
    full = asked.unionByName(asking).join(texts.select("node", "sig"), "node").join(bags, "node")

    def compared(held: list[dict]) -> list[tuple[int, int]]:
        sig = np.frombuffer(b"".join(m["sig"] for m in held), np.uint32).reshape(len(held), -1)
        bag_of = [(np.frombuffer(m["x"], np.uint64), np.frombuffer(m["n"], "<i4")) for m in held]
        total, kind = np.array([int(n.sum()) for _, n in bag_of]), np.array([m["class"] for m in held])
        asks = np.array([m["asks"] for m in held])
        base, out = np.flatnonzero(~asks), []
        for k in np.flatnonzero(asks).tolist():
            at = base[(kind[base] != kind[k]) & (np.minimum(total[base], total[k]) >= threshold * np.maximum(total[base], total[k]))]
            at = at[(sig[at] == sig[k]).mean(axis=1) >= threshold - 0.2]
            for m in at.tolist():
                if kind[m] != kind[k] and bag_similarity(bag_of[m], bag_of[k]) >= threshold - 1e-12:
                    out.append((held[m]["node"], held[k]["node"]))
                    kind[kind == kind[m]] = kind[k]  # one link joins two classes
        return out

    def rows(batches: Iterator[dict]):
        held: list[dict] = []
        for b in batches:
            found = []
            names = list(b)
            for row in zip(*(b[n].to_pylist() for n in names)):
                member = dict(zip(names, row))
                if held and any(member[n] != held[-1][n] for n in ("rep", "i", "j")):
                    found += compared(held)
                    held = []
                held.append(member)
            if found:
                yield {"a": [min(p) for p in found], "b": [max(p) for p in found]}
        if held and (found := compared(held)):
            yield {"a": [min(p) for p in found], "b": [max(p) for p in found]}

    order = ("rep", "i", "j")
    return map_batches(full.repartition(*order).sortWithinPartitions(*order, "node"), rows, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, ``_class`` (a key that differs between classes even where ids repeat) and the text's hash ``_h``, for every row."""
    taken = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_h", F.xxhash64("_text"))
    signed = cut(_signed(taken))
    texts = signed.filter("sig is not null").dropDuplicates(["node"])
    first = signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h")).alias("m")).select("node", "m.doc_id", "m._h")
    bands = texts.select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bands = cut(bands.join(shared, "key"))  # only keys that several texts have
    texts = cut(texts.select("node", "weight", "sig").join(bands.select("node").distinct(), "node", "left_semi"))
    hub = bands.groupBy("node").agg(F.sum("n").alias("score"))  # how often a text shares a bucket: central texts most
    bands = bands.select("key", "node").join(hub, "node")
    chosen = bands.groupBy("key").agg(F.max(F.struct("score", "node")).alias("r")).select("key", F.col("r.node").alias("rep"))
    held = cut(bands.select("key", "node").join(chosen, "key"))
    stars = held.filter("node <> rep").select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()
    alike = cut(_alike(stars, texts, threshold - 0.2, threshold))
    ends = alike.select(F.col("a").alias("node")).unionByName(alike.select(F.col("b").alias("node"))).distinct()
    links = cut(_verified(alike, cut(_bags(taken, ends, first)), threshold))
    label = components(links)
    classed = held.join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
    mixed = classed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("key")
    groups = cut(classed.join(mixed, "key").select("rep", "node", "class").distinct())
    if not groups.isEmpty():
        bags = cut(_bags(taken, groups.select("node").distinct(), first))
        if (dealt := _dealt(groups, texts)) is not None:
            links = cut(links.unionByName(_across(cut(dealt), texts, bags, threshold)))
            groups = cut(_apart(groups, components(links)))
        more = cut(_across(groups, texts, bags, threshold))
        label = components(links.unionByName(more))
    named = first.select("node", "doc_id")
    named = named.join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = named.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    # a class without an id is named by a negative number
    own = -F.abs(F.col("class").bitwiseAND(F.lit(2**62 - 1))) - 1
    named = named.join(least, "class").select("node", F.col("class").alias("_class"), F.coalesce("class_id", own).alias("class_id"))
    return signed.select("doc_id", "_h", "node").join(named, "node").select("doc_id", "class_id", "_class", "_h")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stand for their class: the least id's, once, all columns kept; null texts are one empty text."""
    found = near_duplicates(docs, id_col, text_col, threshold)
    key, digest, own = (fresh(docs.columns, name) for name in ("_dedup_id", "_dedup_h", "_dedup_own"))
    rows = found.groupBy("_class", "doc_id", "_h").agg(F.count(F.lit(1)).alias("n"))
    chosen = rows.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h")).alias("m"))
    stays = F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("_h") == F.col("m._h"))
    judged = rows.join(chosen, "_class").select(F.col("doc_id").alias(key), F.col("_h").alias(digest), stays.alias("stays"), "n")
    open_ = cut(judged.filter("not stays or n > 1"))
    # all other rows stay as they are: only what may go, or stands there several times, is shuffled with its text
    asked = key_filter(open_.select(F.xxhash64(key, digest)))
    hashed = docs.withColumn(own, F.xxhash64(F.col(text_col).cast("string")))
    doubtful = asked(F.xxhash64(F.col(id_col).cast("long"), own))
    gone = open_.filter("not stays").select(key, digest)
    kept = hashed.filter(doubtful).join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest)), "left_anti")
    return hashed.filter(~doubtful).unionByName(kept.dropDuplicates([id_col, own])).drop(own)
