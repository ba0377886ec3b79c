"""Language identification by prediction by partial matching (PPM) over bytes.

One context tree holds the byte n-grams of all languages up to ``depth`` context bytes,
with counts for each language. The counts are frozen after training, and a byte costs, in
a language,

    -log2 c(ctx, byte) / (n(ctx) + d(ctx))          if the language has seen it after ctx,
    -log2 d(ctx) / (n(ctx) + d(ctx)) + cost(shorter ctx)   otherwise (escape, method C),

where n counts a context's symbols and d its distinct ones; a context that the language has
never seen costs nothing to leave, and below the empty context every byte has 8 bits. The
code length of a text is the sum over its bytes. Because nothing changes while scoring,
each tree node carries the finished cost of its last byte in every language, and a batch of
texts is scored by walking the tree one gram length at a time for all positions together.

The prediction is the language with the shortest code (ties: the first name);
``score`` is its share of the posterior over the learned languages, which are equally
likely beforehand. ``bits`` is the shortest code length per byte.

Training sample: at most ``max_docs`` distinct labelled texts and ``max_bytes`` bytes for each
language, those of the least hashes (of id and text); of a longer text the first ``max_bytes``
bytes count. A gram of over two bytes is kept if it was seen ``seen`` times: twice, or more
often where the tree would need more than ``max_tree`` bytes. A count never falls short of
that of a longer gram, so a kept gram's beginning and end are kept as well. Every document
is scored, over its whole text.

Defined results: ``und`` with score 0 for a null text, a text without a letter (Unicode
category L), or when nothing could be learned; repeated rows give repeated results; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospark.llm.common import frugal, hash_limit, local_table, map_batches, remainder

_LETTER = regex.compile(r"\p{L}")
#: Bytes scored at a time; a longer text goes on with the last bytes of the piece before as context.
PIECE = 1 << 18
#: Texts that are judged together.
CHUNK = 200


class PpmLanguages:
    """The frozen context tree of all languages."""

    def __init__(self, texts: dict[str, list[bytes]], depth: int = 4, max_tree: int = 96_000_000):
        self.languages, self.depth = sorted(texts), depth
        k = len(self.languages)
        pieces = [(lang, t) for lang in self.languages for t in texts[lang] if t]
        flat = np.frombuffer(b"".join(t for _, t in pieces), np.uint8)
        lang = np.repeat(np.array([self.languages.index(x) for x, _ in pieces], np.int32), [len(t) for _, t in pieces])
        doc = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(t) for _, t in pieces])
        known = np.unique(flat)
        self.code = np.zeros(256, np.int32)  # 0: a byte never learned
        self.code[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 2  # the last code separates texts
        self.seen = 2
        while not self._grow(self.code[flat], lang, doc, k, max_tree):
            self.seen += max(1, self.seen // 3)
        counts, self.cost, self.escape = self._counts, [], []
        del self._counts
        with np.errstate(divide="ignore", invalid="ignore"):
            for length in range(1, depth + 2):
                size, c, up = len(counts[length - 2]) if length > 1 else 1, counts[length - 1], self.parents[length - 1]
                n, d = np.zeros((size, k)), np.zeros((size, k))
                np.add.at(n, up, c)
                np.add.at(d, up, c > 0)
                escape = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
                self.escape.append(escape)
                if length == 1:
                    shorter = np.full((len(c), k), 8.0)
                else:
                    shorter = self.cost[-1][self._suffix(self.parents, self.symbols, length)]
                seen = -np.log2(c / (n + d)[up])
                self.cost.append(np.where(c > 0, seen, escape[up] + shorter))
        self.floor = self.escape[0][0] + 8.0  # a byte never learned, after the empty context
        # bits per byte that the sample of a language stays well below
        own = {x: [t for t in texts[x] if t] for x in self.languages}
        self.usual = [2 * float(np.quantile(self.code_lengths(own[x])[:, j] / [len(t) for t in own[x]], 0.99)) + 2 if own[x] else 8.0 for j, x in enumerate(self.languages)]

    def _grow(self, codes: np.ndarray, lang: np.ndarray, doc: np.ndarray, k: int, max_tree: int) -> bool:
        """Take the grams that occur ``self.seen`` times; false if they need more than ``max_tree`` bytes."""
        # children[L][node of length L-1, code] -> node of length L, or -1; node counts by language
        self.children, self._counts, self.parents, self.symbols = [], [], [], []
        node, used = np.zeros(len(codes), np.int32), 0
        for length in range(1, self.depth + 2):
            n = max(0, len(codes) - length + 1)
            at = np.flatnonzero((node[:n] >= 0) & (doc[:n] == doc[length - 1 : length - 1 + n])).astype(np.int32)
            key = node[at]
            key *= self.width  # nodes times codes stay far below 2^31
            key += codes[at + length - 1]
            order = key.argsort()
            at, key = at[order], key[order]
            del order
            first = np.flatnonzero(np.diff(key, prepend=-1) > 0)
            keys, own = key[first], lang[at]
            del key
            by = np.stack([np.add.reduceat(own == j, first, dtype=np.int32) for j in range(k)], axis=1) if len(first) else np.zeros((0, k), np.int32)
            keep = by.sum(axis=1) >= (1 if length <= 2 else self.seen)
            number = np.where(keep, keep.cumsum() - 1, -1).astype(np.int32)
            self.parents.append(keys[keep] // self.width)
            self.symbols.append(keys[keep] % self.width)
            self._counts.append(by[keep].astype(np.float64))
            used += int(keep.sum()) * (8 * k + 8 + (4 * self.width if length <= self.depth else 0))
            if used > max_tree and length > 2 and keep.any():
                return False
            node = np.full(len(codes), -1, np.int32)
            node[at] = np.repeat(number, np.diff(first, append=len(at)))
        self._tables()
        return True

    def _tables(self) -> None:
        sizes = [1, *map(len, self.parents)]
        for size, up, code in zip(sizes, self.parents, self.symbols):
            table = np.full((size + 1, self.width), -1, np.int32)  # the last row answers for node -1
            table[up, code] = np.arange(len(up), dtype=np.int32)
            self.children.append(table)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"children": []}  # the tables are filled anew where they are needed

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._tables()

    def _suffix(self, parents: list, symbols: list, length: int) -> np.ndarray:
        """For the nodes of a length, the node of their gram without its first byte."""
        at, grams = np.arange(len(parents[length - 1])), []
        for level in range(length - 1, -1, -1):
            grams.append(symbols[level][at])
            at = parents[level][at]
        node = np.zeros(len(grams[0]), np.int64)
        for level, code in enumerate(grams[::-1][1:]):
            node = self.children[level][node, code]
        if (node < 0).any():
            raise AssertionError("a gram is kept without its suffix")
        return node

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, texts by languages."""
        out = np.zeros((len(texts), len(self.languages)))
        batch: list[tuple[int, bytes, int]] = []
        held = 0
        for i, t in enumerate(texts):
            for start in range(0, len(t), PIECE):
                before = min(start, self.depth)
                piece = t[start - before : start + PIECE]
                batch.append((i, piece, before))
                held += len(piece)
                if held >= PIECE:
                    self._add(batch, out)
                    batch, held = [], 0
        if batch:
            self._add(batch, out)
        return out

    def _add(self, batch: list[tuple[int, bytes, int]], out: np.ndarray) -> None:
        sizes = np.array([len(p) + 1 for _, p, _ in batch])
        codes = self.code[np.frombuffer(b"\0".join(p for _, p, _ in batch) + b"\0", np.uint8)]
        ends = sizes.cumsum()
        codes[ends - 1] = self.width - 1
        row = np.repeat(np.array([i for i, _, _ in batch]), sizes)
        real = np.ones(len(codes), bool)  # positions whose symbol is to be paid for
        real[ends - 1] = False
        for end, size, (_, _, before) in zip(ends, sizes, batch):
            real[end - size : end - size + before] = False
        k, n = len(self.languages), len(codes)
        rows = len(out)

        def pay(where: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
            for j in range(k):
                out[:, j] += np.bincount(row[where], values[at, j], rows)

        node = self.children[0][0][codes]  # gram of length 1 that starts here
        paid_from: list[np.ndarray] = [node]
        for length in range(1, self.depth + 1):
            longer = np.full(n, -1, np.int32)
            m = max(0, n - length)
            longer[:m] = self.children[length][node[:m], codes[length : length + m]]
            left = np.flatnonzero((node >= 0) & (longer < 0))  # the context is known, not what follows it
            left = left[left + length < n]
            left = left[real[left + length]]
            if len(left):
                pay(left + length, node[left], self.escape[length])
            paid_from.append(longer)
            node = longer
        paid = np.zeros(n, bool)
        for length in range(self.depth + 1, 0, -1):
            start = np.flatnonzero(paid_from[length - 1] >= 0)
            end = start + length - 1
            fresh = real[end] & ~paid[end]
            start, end = start[fresh], end[fresh]
            pay(end, paid_from[length - 1][start], self.cost[length - 1])
            paid[end] = True
        rest = np.flatnonzero(real & ~paid)
        if len(rest):
            out += np.bincount(row[rest], minlength=rows)[:, None] * self.floor


def learn_languages(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 400, max_bytes: int = 1_000_000, depth: int = 4) -> PpmLanguages | None:
    """The tree of the languages that occur among the rows where ``learn`` holds; a longer text counts by its first ``max_bytes`` bytes."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    size = F.least(F.octet_length(text), F.lit(max_bytes))
    able = docs.filter(learn & F.col(lang_col).isNotNull() & (F.length(text) > 0))
    able = able.select(F.col(lang_col).alias("_lang"), F.xxhash64(F.col(id_col), text).alias("_hash"), size.alias("_size"), text.alias("_text"))
    totals = able.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes")).collect()  # a row for each language
    # twice the bounds: what is over them goes when the sample is put in order
    bounds = [(r["_lang"], _limit(r["n"], r["bytes"], max_docs, max_bytes)) for r in totals]
    if not bounds:
        return None
    wanted = F.broadcast(local_table(spark, bounds, "_l string, _below long"))
    picked = able.join(wanted, (F.col("_lang") == F.col("_l")) & (F.col("_hash") <= F.col("_below")))
    found = picked.select("_lang", "_hash", F.substring(F.col("_text").cast("binary"), 1, max_bytes).alias("_text")).distinct().collect()
    texts: dict[str, list[bytes]] = {}
    for lang, _, data in sorted((r[0], r[1], bytes(r[2])) for r in found):
        own = texts.setdefault(lang, [])
        if len(own) < max_docs and sum(map(len, own)) < max_bytes:
            own.append(data)
    return PpmLanguages(texts, depth)


def _limit(n: int, size: int, max_docs: int, max_bytes: int) -> int:
    """The hash up to which about twice the bounds' share of ``n`` texts of ``size`` bytes lies, but not fewer than some twenty."""
    return hash_limit(max(2 * min(max_docs / n, max_bytes / size), 20 / n))


def judge(tree: PpmLanguages | None, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """(language, score, bits per byte) of every text."""
    out = [("und", 0.0, 0.0)] * len(texts)
    able = [i for i, t in enumerate(texts) if tree is not None and t and _LETTER.search(t)]
    data = [texts[i].encode("utf-8", "surrogatepass") for i in able]
    if able:
        length = tree.code_lengths(data)
        least = length.min(axis=1)
        share = 1 / np.exp2(np.clip(least[:, None] - length, -1000, 0)).sum(axis=1)
        for i, t, j, s, x in zip(able, data, length.argmin(axis=1), share, least):
            out[i] = (tree.languages[j], float(s), float(x) / len(t))
    return out


def is_known(tree: PpmLanguages | None, texts: list[str | None], least: float) -> list[bool]:
    """Whether a text has a language of at least this score and costs no more than texts of that language do.

    The bound is twice what 99 of 100 sample texts cost a byte, and two bits a byte and 64 for
    the whole text on top, so that it lies far above any text of the language, shouted or
    garbled ones included; a text in letters that were never learned costs more.
    """
    out = []
    for t, (lang, score, bits) in zip(texts, judge(tree, texts)):
        size = len(t.encode("utf-8", "surrogatepass")) if lang != "und" else 0
        out.append(lang != "und" and score >= least and bits * size <= tree.usual[tree.languages.index(lang)] * size + 64)
    return out


def predict_languages(docs: DataFrame, model: PpmLanguages | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, columns named in ``keep`` as they are, lang_pred, score and bits per byte of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by max_tree

    def rows(batches: Iterator[dict]):
        tree = shared.value
        for b in batches:
            for at in range(0, len(b["_text"]), CHUNK):
                lang, score, bits = zip(*judge(tree, b["_text"][at : at + CHUNK].to_pylist()))
                yield {id_col: b[id_col][at : at + CHUNK], **{c: b[c][at : at + CHUNK] for c in keep}, "lang_pred": lang, "score": score, "bits": bits}

    kinds = dict(docs.dtypes)
    ddl = ", ".join([f"{id_col} long", *(f"{c} {'long' if kinds[c] == 'bigint' else kinds[c]}" for c in keep), "lang_pred string, score double, bits double"])
    taken = docs.select(F.col(id_col).cast("long").alias(id_col), *keep, F.col(text_col).cast("string").alias("_text"))
    return map_batches(taken, rows, ddl)


def keep_known(docs: DataFrame, model: PpmLanguages | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language ``is_known``, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, tree = b.column(text_col), shared.value
            on = [x for at in range(0, len(texts), CHUNK) for x in is_known(tree, texts[at : at + CHUNK].to_pylist(), least)]
            yield b.filter(pa.array(on, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)


def held_out_languages(docs: DataFrame, modulus: int = 3, fold: int = 1) -> DataFrame:
    """Learn outside the fold, predict every document; ``held_out`` marks the fold."""
    model = learn_languages(docs, remainder(F.col("doc_id"), modulus) != fold)
    return predict_languages(docs, model).withColumn("held_out", remainder(F.col("doc_id"), modulus) == fold)
