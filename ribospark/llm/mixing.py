"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A flow
network routes token capacity: super-source -> pattern (one arc for each repetition, the
k-th copy of a pattern's words costing more than the one before), pattern -> source, source
-> sink (its target). As only the repetition arcs cost anything, the cheapest flow is found
by opening the repetitions one after another and pushing a maximum flow through the
residual network each time; no word is repeated while an unused one could serve. A
pattern's flow then becomes copies of its documents: all get the whole copies, and a seeded
choice of documents gets one more until the rest is used up.

Sources in order of their code points, null last, weigh ``weights`` in turn. They share the
words of all documents by weight; a target stops at ``max_repeat`` times the source's words
and what is left over is shared again by weight until none is above its limit.

The seeded choice needs no global sort: documents fall into hash buckets, bucket sums tell
in which bucket a pattern's rest runs out, and only that bucket is looked at more closely,
by finer buckets, then by hash, id and size, and last, for rows that are equal in these, by
partition and place in it. No window is longer than a bucket, a partition or their number.

Bounds: the patterns' totals and the flow are on the driver; more than ``MAX_PATTERNS``
patterns raise. Everything by document stays distributed.

Defined results: a null text has size 0 and is never taken; a null source is a source of
its own; rows that share a doc_id are chosen one by one, rows that are equal in id and size
in the order in which they are read; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ribospark.llm.common import local_table
from ribospark.plans.runtime import cut

MAX_PATTERNS = 100_000
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """The words of a text: runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long"), F.lit(0).cast("long"))


def share_targets(sizes: dict, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> dict:
    """Each source's target in words."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, free = float(sum(sizes.values())), {}, list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * unit > max_repeat * sizes[s]]
        if not above:
            return target | {s: weight[s] * unit for s in free}
        for s in above:
            target[s] = float(max_repeat * sizes[s])
            left -= target[s]
        free = [s for s in free if s not in target]
    return target


class FlowNetwork:
    """Maximum flow by shortest level graphs; arcs may be added between calls of ``push``."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        self.arcs[a].append(len(self.to))
        self.arcs[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0]
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc + 1]

    def _levels(self, source: int) -> list[int]:
        level, queue = [-1] * len(self.arcs), deque([source])
        level[source] = 0
        while queue:
            a = queue.popleft()
            for e in self.arcs[a]:
                if self.room[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def push(self, source: int, sink: int) -> int:
        total = 0
        while (level := self._levels(source))[sink] >= 0:
            at = [0] * len(self.arcs)
            path: list[int] = []
            node = source
            while True:
                if node == sink:
                    amount = min(self.room[e] for e in path)
                    total += amount
                    for e in path:
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                    cut_at = next(i for i, e in enumerate(path) if self.room[e] == 0)
                    node = self.to[path[cut_at] ^ 1]
                    del path[cut_at:]
                    continue
                while at[node] < len(self.arcs[node]):
                    e = self.arcs[node][at[node]]
                    if self.room[e] > 0 and level[self.to[e]] == level[node] + 1:
                        break
                    at[node] += 1
                if at[node] < len(self.arcs[node]):
                    path.append(e)
                    node = self.to[e]
                elif path:
                    node = self.to[path.pop() ^ 1]
                    at[node] += 1
                else:
                    break
        return total


def route(patterns: dict[tuple, int], targets: dict, max_repeat: int = 3) -> dict[tuple, int]:
    """Words to take of each pattern, repeats counted, at the least repetition cost."""
    names, sources = list(patterns), list(targets)
    net = FlowNetwork(2 + len(names) + len(sources))
    place = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    for s in sources:
        net.arc(place[s], 1, round(targets[s]))
    for i, p in enumerate(names):
        for s in dict.fromkeys(p):
            if s in place:
                net.arc(2 + i, place[s], max_repeat * patterns[p])
    used: dict[tuple, int] = dict.fromkeys(names, 0)
    for _ in range(max_repeat):
        opened = [(p, net.arc(0, 2 + i, patterns[p])) for i, p in enumerate(names) if patterns[p] > 0]
        net.push(0, 1)
        for p, e in opened:
            used[p] += net.flow(e)
    return used


def _keyed(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """``rows`` with the seeded hash, its bucket and the order of choice (columns starting with _mix)."""
    hashed = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col("_mix_size"))
    order = F.struct(F.col("_mix_hash").alias("hash"), F.col(id_col).cast("long").alias("id"), F.col("_mix_size").alias("size"), F.col("_mix_row").alias("row"))
    return rows.withColumn("_mix_row", F.monotonically_increasing_id()).withColumn("_mix_hash", hashed).withColumn("_mix_bucket", F.pmod(F.col("_mix_hash"), F.lit(BUCKETS)).cast("int")).withColumn("_mix_order", order)


def _running(rows: DataFrame, level: Column) -> DataFrame:
    """The sizes of ``rows`` by pattern and ``level``, with running sums in its order."""
    sums = rows.groupBy("_members", level.alias("_level")).agg(F.sum("_mix_size").alias("_n"))
    return sums.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_members").orderBy("_level").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _edge(rows: DataFrame, left: DataFrame, level: Column) -> DataFrame:
    """(_p, _at, _left): at which ``level`` the words ``_left`` of a pattern run out, and what is left there."""
    ends = _running(rows, level).join(F.broadcast(left), F.col("_members").eqNullSafe(F.col("_p"))).filter("_upto > _left")
    return cut(ends.groupBy("_p").agg(F.min(F.struct("_level", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("left"))).alias("e")).select("_p", F.col("e._level").alias("_at"), F.col("e.left").alias("_left")))


def mixing_plan(docs: DataFrame, members: Column, size: Column, id_col: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: int = 7) -> DataFrame:
    """One row for each membership pattern: its whole copies and the last document that gets one more."""
    spark = docs.sparkSession
    sized = cut(_keyed(docs.select(F.col(id_col).cast("long").alias("_id"), members.alias("_members"), size.cast("long").alias("_mix_size")), "_id", seed))
    by_pattern = sized.groupBy("_members").agg(F.sum("_mix_size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(by_pattern) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["_members"]): int(r["n"]) for r in sorted(by_pattern, key=lambda r: [(x is None, x or "") for x in r["_members"]])}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in dict.fromkeys(p):
            sizes[s] = sizes.get(s, 0) + n
    # overlapping sources hold some words twice: the targets share the words there are, not their sum
    scale = sum(patterns.values()) / max(1, sum(sizes.values()))
    quotas = {s: t * scale for s, t in share_targets(sizes, weights, max_repeat).items()}
    used = route(patterns, quotas, max_repeat)
    plan = [(list(p), used[p] // n if n else 0, used[p] % n if n else 0, sizes[p[0]] if p else 0, quotas[p[0]] if p else 0.0) for p, n in patterns.items()]
    told = local_table(spark, plan, "_p array<string>, _whole long, _rest long, source_size long, target double")
    finer = F.pmod(F.shiftright("_mix_hash", 12), F.lit(BUCKETS)).cast("int")
    levels = [F.col("_mix_bucket"), finer, F.struct("_mix_order.hash", "_mix_order.id", "_mix_order.size"), F.shiftright("_mix_row", 33)]
    inside, left, last = sized, told.select("_p", F.col("_rest").alias("_left")), None
    for level in levels:
        left = _edge(inside, left, level)
        last = last or left.select(F.col("_p").alias("_q"), F.col("_at").alias("_last"))
        here = F.broadcast(left.select(F.col("_p").alias("_q"), "_at"))
        inside = cut(inside.join(here, F.col("_members").eqNullSafe(F.col("_q")) & level.eqNullSafe(F.col("_at"))).drop("_q", "_at"))
    ends = _running(inside, F.col("_mix_order")).join(F.broadcast(left), F.col("_members").eqNullSafe(F.col("_p")))
    final = ends.groupBy(F.col("_p").alias("_r")).agg(
        F.max(F.when((F.col("_left") > 0) & (F.col("_upto") - F.col("_n") / 2 <= F.col("_left")), F.col("_level"))).alias("_until"),
        F.min(F.col("_level")).alias("_first"),
    )
    out = told.join(last, F.col("_p").eqNullSafe(F.col("_q")), "left").join(final, F.col("_p").eqNullSafe(F.col("_r")), "left")
    return cut(out.select("_p", "_whole", "source_size", "target", F.coalesce("_last", F.lit(-1)).alias("_last"), "_until", "_first"))


def with_copies(docs: DataFrame, plan: DataFrame, members: Column, size: Column, id_col: str = "doc_id", max_repeat: int = 3, seed: int = 7) -> DataFrame:
    """``docs`` and ``_mix_size``, ``_mix_copies``, ``_mix_source_size``, ``_mix_target``; the plan (bounded) is broadcast, nothing is shuffled."""
    told = F.broadcast(plan.select(F.col("_p").alias("_mix_p"), F.col("_whole").alias("_mix_whole"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"), F.col("_last").alias("_mix_last"), F.col("_until").alias("_mix_until"), F.col("_first").alias("_mix_first")))
    keyed = _keyed(docs.withColumn("_mix_size", size.cast("long")).withColumn("_mix_members", members), id_col, seed)
    joined = keyed.join(told, F.col("_mix_members").eqNullSafe(F.col("_mix_p")))
    fine = F.pmod(F.shiftright("_mix_hash", 12), F.lit(BUCKETS))
    edge = F.pmod(F.shiftright(F.col("_mix_first.hash"), 12), F.lit(BUCKETS))
    until = F.coalesce(F.col("_mix_order") <= F.col("_mix_until"), F.lit(False)) | (F.col("_mix_order") < F.col("_mix_first"))
    inside = (fine < edge) | ((fine == edge) & until)
    chosen = (F.col("_mix_bucket") < F.col("_mix_last")) | ((F.col("_mix_bucket") == F.col("_mix_last")) & F.coalesce(inside, F.lit(False)))
    copies = F.when(F.col("_mix_size") > 0, F.least(F.col("_mix_whole") + chosen.cast("long"), F.lit(max_repeat))).otherwise(0).cast("int")
    return joined.withColumn("_mix_copies", copies).drop("_mix_hash", "_mix_bucket", "_mix_order", "_mix_row", "_mix_first", "_mix_p", "_mix_whole", "_mix_last", "_mix_until")


def mix_sources(docs: DataFrame, members: Column, size: Column, id_col: str = "doc_id", **options) -> DataFrame:
    """id, members, size, source_size and target (of the first member), copies (0..max_repeat) and taken words of every row.

    ``members`` is an array of source names (an element may be null).
    """
    plan = mixing_plan(docs, members, size, id_col, **options)
    options = {k: v for k, v in options.items() if k in ("max_repeat", "seed")}
    out = with_copies(docs.select(F.col(id_col).cast("long").alias(id_col), members.alias("_m"), size.alias("_s")), plan, F.col("_m"), F.col("_s"), id_col, **options)
    return out.select(id_col, F.col("_m").alias("members"), F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_copies").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, members: Column, size: Column, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, all columns kept."""
    plan = mixing_plan(docs, members, size, id_col, **options)
    options = {k: v for k, v in options.items() if k in ("max_repeat", "seed")}
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), members.alias("m"), size.alias("s"))  # so that no column's name can clash
    taken = with_copies(packed, plan, F.col("m"), F.col("s"), "id", **options).filter("_mix_copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select("doc.*")
