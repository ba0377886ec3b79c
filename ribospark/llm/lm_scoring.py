"""LM scoring with a hidden Markov model over words.

Symbols: the end of a text, the ``n_top`` most frequent training words, and ``CLASSES`` word
classes (a hash of a word's last two bytes) for all other words. A latent state emits a
symbol; a word inside a class has the probability (c + 1) / (N_class + V_class + 1) from its
own training count c, an unseen word counting as one more type. So every text has an exact
probability, and only a bounded table (``n_top``) travels to the executors: the counts of
all other words stay distributed and are joined to the words that ask for them. Words are known
by 64-bit hashes, so that whole columns of texts are cut and counted with array operations.

Training learns from all training texts, at the start too: the pairs of neighbouring symbols of all
of them are counted (the ``PAIRED`` most frequent symbols apart, all others by class, so the table
has a fixed size), and EM over that table gives the first parameters. Then Baum-Welch runs over
all training texts: each task adds up its expected counts (symbol by state, state by state), the
counts are summed across partitions, and the driver normalises a table of ``n_top`` + ``CLASSES`` rows. In the E-step
texts are cut into stretches of at most ``STRETCH`` tokens that are handled side by side; each
runs ``LAP`` tokens into its neighbours, so that the messages over a cut have settled, and
counts its own tokens and transitions only.
Scoring uses no cuts: the scaled forward recursion runs over each whole text, all texts of a
batch in step, and the logarithms of the scales add up to its probability.

The base score is the add-one unigram of the contract, from exact counts of all training
words.

Defined results: a null text is empty and consists of its end; repeated rows give repeated
results; without training texts all counts are 0; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribospark.llm.common import map_batches, mix, word_arrays
from ribospark.plans.runtime import cut

CLASSES = 64
STRETCH, LAP = 400, 16
#: Symbols that have a row of their own in the table of pairs.
PAIRED = 512
#: Distinct words that a task counts before it hands them on.
FLUSH = 1_000_000
#: Texts whose words are looked at together.
CHUNK = 1000
#: The hash that stands for the end of a text.
END = 0


def word_classes(tails: np.ndarray) -> np.ndarray:
    """The classes of words by their last two bytes."""
    return (mix(tails.astype(np.uint64) + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)


class Symbols:
    """Word hash -> symbol: 0 the end, then the top words, then the classes."""

    def __init__(self, top: np.ndarray):
        order = top.argsort()
        self.keys, self.symbol, self.n_top = top[order], order + 1, len(top) + 1

    @property
    def size(self) -> int:
        return self.n_top + CLASSES

    def encode(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        if len(self.keys) == 0:
            return self.n_top + word_classes(tails)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.symbol[at], self.n_top + word_classes(tails))


class HiddenMarkov:
    """Start, transition (from, to) and emission (symbol, state) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def seeded(cls, unigram: np.ndarray, states: int, seed: int = 11) -> HiddenMarkov:
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * rng.uniform(0.2, 1.8, (len(unigram), states))
        move = rng.uniform(0.5, 1.5, (states, states)) + states * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    @classmethod
    def from_pairs(cls, pairs: np.ndarray, coarse: np.ndarray, unigram: np.ndarray, states: int, rounds: int) -> HiddenMarkov:
        """EM over the counts of neighbours (rows of ``pairs``: the left ones, at last the starts) of coarse symbols, spread over their symbols."""
        mass = np.bincount(coarse, unigram, pairs.shape[1])
        first = cls.seeded(mass, states)
        emit, start = first.emit, first.start
        joint = first.move / states  # of the states of two neighbours
        beside, begun = pairs[:-1].astype(np.float64), pairs[-1].astype(np.float64)
        told, whole = mass[:, None], beside.sum() + begun.sum() + 1.0
        for _ in range(rounds):
            ahead, back = emit @ joint.T, emit @ joint
            ratio = beside / np.maximum(back @ emit.T, 1e-300)
            left, right = emit * (ratio @ ahead), emit * (ratio.T @ back)
            opened = emit * start * (begun / np.maximum(emit @ start, 1e-300))[:, None]
            joint = joint * (emit.T @ ratio @ emit) + whole * 1e-6
            start, joint = opened.sum(axis=0) + 0.1, joint / joint.sum()
            start, emit = start / start.sum(), left + right + opened + told
            emit /= emit.sum(axis=0)
        share = unigram / np.maximum(mass[coarse], 1e-300)
        spread = (emit * (joint.sum(axis=0) * whole))[coarse] * share[:, None]
        return cls.from_counts(np.concatenate([spread, joint * whole, [start * begun.sum()]]), unigram, 200.0)

    @classmethod
    def from_counts(cls, counts: np.ndarray, unigram: np.ndarray, weight: float = 20.0) -> HiddenMarkov:
        """Normalised counts: rows of symbols, then rows of transitions, then the row of starts."""
        states, size = counts.shape[1], len(unigram)
        emit = counts[:size] + weight * unigram[:, None]
        move, start = counts[size : size + states] + 0.1, counts[size + states] + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 of the exact probabilities of whole sequences by the scaled forward recursion."""
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        lengths = np.array([len(sequences[i]) for i in order])
        flat, first = np.concatenate([sequences[i] for i in order]), np.concatenate([[0], lengths.cumsum()[:-1]])
        out, alpha = np.zeros(len(order)), None
        rows = len(order)
        for t in range(lengths[0]):
            while lengths[rows - 1] <= t:
                rows -= 1
            alpha = (np.broadcast_to(self.start, (rows, len(self.start))) if t == 0 else alpha[:rows] @ self.move) * self.emit[flat[first[:rows] + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            out[:rows] += np.log10(scale)
        back = np.empty(len(order))
        back[order] = out
        return back

    def expected(self, sequences: list[np.ndarray], counts: np.ndarray) -> None:
        """Add the expected counts of the sequences to ``counts`` (rows as in ``from_counts``)."""
        pieces = [(s[max(0, i - LAP) : i + STRETCH + LAP], min(i, LAP), i == 0) for s in sequences for i in range(0, len(s), STRETCH)]
        pieces.sort(key=lambda p: -len(p[0]))
        lengths = np.array([len(p) for p, _, _ in pieces])
        states, size = self.move.shape[0], len(self.emit)
        live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # rows alive at step t
        at = np.concatenate([[0], live.cumsum()])
        flat, first = np.concatenate([p for p, _, _ in pieces]), np.concatenate([[0], lengths.cumsum()[:-1]])
        lead = np.array([n for _, n, _ in pieces])
        own = np.concatenate([(lead[:n] <= t) & (t < lead[:n] + STRETCH) for t, n in enumerate(live)])  # not of a neighbour
        symbol = np.concatenate([flat[first[:n] + t] for t, n in enumerate(live)])  # by step
        emit, move = self.emit.astype(np.float32), self.move.astype(np.float32)
        e = emit[symbol]
        alpha = np.empty_like(e)
        scale = np.empty(len(symbol), np.float32)
        whole = np.array([b for _, _, b in pieces])
        rest = self.stationary()
        alpha[: live[0]] = np.where(whole[:, None], self.start, rest) * e[: live[0]]
        for t, n in enumerate(live):
            a, b = at[t], at[t + 1]
            if t:
                np.multiply(alpha[at[t - 1] : at[t - 1] + n] @ move, e[a:b], out=alpha[a:b])
            scale[a:b] = alpha[a:b].sum(axis=1)
            alpha[a:b] /= scale[a:b, None]
        ahead = np.empty_like(e)  # emission * beta / scale of a step, for the step before it
        beta = np.ones((live[-1], states), np.float32)
        gamma = np.empty_like(e)
        for t in range(len(live) - 1, -1, -1):
            a, b, n = at[t], at[t + 1], live[t]
            if t < len(live) - 1:
                beta = np.ones((n, states), np.float32)
                beta[: live[t + 1]] = ahead[at[t + 1] : at[t + 2]] @ move.T
            gamma[a:b] = alpha[a:b] * beta
            ahead[a:b] = e[a:b] * beta / scale[a:b, None]
        before = np.concatenate([np.arange(at[t], at[t] + live[t + 1]) for t in range(len(live) - 1)]) if len(live) > 1 else np.empty(0, np.int64)
        mine = own[before]
        counts[size : size + states] += (alpha[before[mine]].T @ ahead[live[0] :][mine]).astype(np.float64) * self.move
        counts[size + states] += gamma[: live[0]][whole].sum(axis=0)
        symbol = symbol[own]
        for k, column in enumerate(np.ascontiguousarray(gamma[own].T)):
            counts[:size, k] += np.bincount(symbol, column, size)

    def stationary(self) -> np.ndarray:
        p = self.start
        for _ in range(50):
            p = p @ self.move
        return p / p.sum()


def count_words(docs: DataFrame) -> DataFrame:
    """(h, class, c) over the rows of ``docs`` (_text); the end has hash ``END`` and class -1."""

    def rows(batches: Iterator[dict]):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = texts = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, tail, c = (np.concatenate(x) for x in zip(*held))
            order = h.argsort()
            first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0)
            return h[order[first]], tail[order[first]], np.add.reduceat(c[order], first)

        def out(h: np.ndarray, tail: np.ndarray, c: np.ndarray) -> dict:
            return {"h": h.view(np.int64), "class": word_classes(tail), "c": c}

        for b in batches:
            texts += len(b["_text"])
            for at in range(0, len(b["_text"]), CHUNK):
                h, tail, _ = word_arrays(b["_text"][at : at + CHUNK])
                if len(h):
                    held.append((h, tail, np.ones(len(h), np.int64)))
                    size += len(h)
                if size > 2 * FLUSH:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > FLUSH:
                        yield out(*held.pop())
                        size = 0
        if held:
            yield out(*merged())
        yield {"h": [END], "class": [-1], "c": [texts]}

    return map_batches(docs.select("_text"), rows, "h long, class int, c long").groupBy("h", "class").agg(F.sum("c").alias("c")).filter("c > 0")


def encode_texts(docs: DataFrame, symbols: Symbols) -> DataFrame:
    """Rows (_id, _learn) with their symbols (16-bit) and the hashes of their words outside the top."""
    shared = docs.sparkSession.sparkContext.broadcast(symbols)

    def rows(batches: Iterator[dict]):
        table = shared.value
        for b in batches:
            for at in range(0, len(b["_id"]), CHUNK):
                h, tail, words = word_arrays(b["_text"][at : at + CHUNK])
                coded = table.encode(h, tail)
                last = words.cumsum()
                rare = coded >= table.n_top
                ends = np.concatenate([[0], np.concatenate([[0], rare.cumsum()])[last]])
                data = np.insert(coded, last, 0).astype("<u2")
                stops = np.concatenate([[0], (last + np.arange(1, len(words) + 1)) * 2])
                yield {
                    "_id": b["_id"][at : at + CHUNK], "_learn": b["_learn"][at : at + CHUNK],
                    "symbols": pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(data)]),
                    "rare": pa.ListArray.from_arrays(ends.astype(np.int32), h[rare].view(np.int64)),
                }

    return map_batches(docs, rows, "_id long, _learn boolean, symbols binary, rare array<long>")


def _chunks(batches: Iterator[dict], most_texts: int, most_tokens: int):
    """(batch, row positions, symbol arrays) in pieces of bounded size."""
    for b in batches:
        at, held, encoded = [], 0, []
        for i, data in enumerate(b["symbols"]):
            at.append(i)
            encoded.append(np.frombuffer(data.as_py(), "<u2"))
            held += len(encoded[-1])
            if len(at) >= most_texts or held >= most_tokens or i == len(b["symbols"]) - 1:
                yield b, at, encoded
                at, held, encoded = [], 0, []


def count_pairs(train: DataFrame, coarse: np.ndarray) -> np.ndarray:
    """How often each coarse symbol follows each other one in ``train`` (symbols), and in a last row how often it comes first."""
    size, shared = int(coarse.max()) + 1, train.sparkSession.sparkContext.broadcast(coarse)

    def rows(batches: Iterator[dict]):
        table, found = shared.value, np.zeros((size + 1) * size, np.int64)
        for _, _, texts in _chunks(batches, 2000, 400_000):
            now = table[np.concatenate(texts)]
            first = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
            before = np.concatenate([[0], now[:-1]])
            before[first] = size
            found += np.bincount(before * size + now, minlength=len(found))
        on = np.flatnonzero(found)
        yield {"cell": on, "c": found[on]}

    summed = map_batches(train.select("symbols"), rows, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()  # (size + 1) * size rows at most
    out = np.zeros((size + 1) * size, np.int64)
    out[summed["cell"].to_numpy()] = summed["c"].to_numpy()
    return out.reshape(size + 1, size)


def fit_hmm(train: DataFrame, coarse: np.ndarray, unigram: np.ndarray, states: int, passes: int, warm_rounds: int) -> HiddenMarkov:
    """``warm_rounds`` of EM over the pairs of all of ``train`` (symbols), then ``passes`` of Baum-Welch over all of it; ``coarse`` gives the symbols' rows among the pairs."""
    spark, size = train.sparkSession, len(unigram)
    model = HiddenMarkov.from_pairs(count_pairs(train, coarse), coarse, unigram, states, warm_rounds)
    names = [f"e{k}" for k in range(states)]
    ddl = "row int, " + ", ".join(f"{n} double" for n in names)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(model)

        def rows(batches: Iterator[dict], shared=shared):
            now = shared.value
            counts = np.zeros((size + states + 1, states))
            for _, _, texts in _chunks(batches, 2000, 400_000):
                now.expected(texts, counts)
            on = np.flatnonzero(counts.any(axis=1))
            yield {"row": on, **{n: counts[on, k] for k, n in enumerate(names)}}

        summed = map_batches(train.select("symbols"), rows, ddl).groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).collect()
        counts = np.zeros((size + states + 1, states))
        for r in summed:
            counts[r["row"]] = r[1:]
        model = HiddenMarkov.from_counts(counts, unigram)
    return model


def top_words(counts: DataFrame, most: int) -> tuple[list, DataFrame]:
    """The rows (h, c, class) of the most frequent words, at most ``most``: all above a count that a histogram gives; and the others."""
    words = counts.filter(F.col("class") >= 0).withColumn("b", F.floor(F.log2("c") * 64).cast("int"))
    sizes = words.groupBy("b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect()  # some thousand buckets
    least, held = 2**31 - 1, 0
    for r in sizes:
        held += r["n"]
        if held > most:
            break
        least = r["b"]
    top = words.filter(F.col("b") >= least).select("h", "c", "class").collect()
    return sorted(top, key=lambda r: (-r["c"], r["h"])), words.filter(F.col("b") < least).drop("b")


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", states: int = 16, n_top: int = 50_000, passes: int = 2, warm_rounds: int = 100) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``learn`` says which rows are learned from. ``n_top`` must leave room for 16-bit symbols.
    """
    if n_top + CLASSES + 1 > 1 << 16:
        raise ValueError("n_top is too large for 16-bit symbols")
    spark = docs.sparkSession
    taken = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"))
    counts = cut(count_words(taken.filter("_learn")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end = next((r["c"] for r in counts.filter("class < 0").collect()), 0)
    top, outside = top_words(counts, n_top)
    symbols = Symbols(np.array([r["h"] for r in top], np.int64).view(np.uint64))
    by_class = {r["class"]: (r["n"], r["v"]) for r in outside.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    class_n = np.array([by_class.get(k, (0, 0)) for k in range(CLASSES)], np.float64)
    known = np.array([end, *(r["c"] for r in top)], np.float64)
    mass = np.concatenate([known, class_n[:, 0]]) + 1
    encoded = cut(encode_texts(taken, symbols)).withColumn("_row", F.monotonically_increasing_id())  # fixed: the rows are in the checkpoint
    apart = min(PAIRED, symbols.n_top)
    coarse = np.concatenate([np.arange(apart), [apart + r["class"] for r in top[apart - 1 :]], apart + np.arange(CLASSES)]).astype(np.int64)
    model = fit_hmm(encoded.filter("_learn").select("symbols"), coarse, mass / mass.sum(), states, passes, warm_rounds)
    total = float(n + v + 1)
    # log10 of what a token adds to the base score, and of the class's denominator for the model
    base = np.concatenate([np.log10((known + 1) / total), np.full(CLASSES, -np.log10(total))])
    inside = np.concatenate([np.zeros(len(known)), -np.log10(class_n.sum(axis=1) + 1)])
    seen = np.concatenate([known > 0, np.zeros(CLASSES, bool)])
    shared = spark.sparkContext.broadcast((model, base, inside, seen))

    def rows(batches: Iterator[dict]):
        hmm, base, inside, seen = shared.value
        for b, at, texts in _chunks(batches, 8192, 4_000_000):
            lengths = np.array([len(t) for t in texts])
            flat = np.concatenate(texts)
            first = np.concatenate([[0], lengths.cumsum()[:-1]])
            yield {
                "_id": b["_id"].take(pa.array(at)), "_learn": b["_learn"].take(pa.array(at)), "_row": b["_row"].take(pa.array(at)), "n": lengths,
                "known": np.add.reduceat(seen[flat].astype(np.int64), first), "base": np.add.reduceat(base[flat], first), "model": hmm.log10(texts) + np.add.reduceat(inside[flat], first),
            }

    scored = map_batches(encoded.select("_id", "_learn", "_row", "symbols"), rows, "_id long, _learn boolean, _row long, n long, known long, base double, model double")
    asked = encoded.select("_row", F.explode("rare").alias("h"))
    # a word that was never counted adds log10(1): only counted words are joined
    told = asked.join(outside.select("h", "c"), "h").groupBy("_row").agg(F.count(F.lit(1)).alias("t"), F.sum(F.log10(F.col("c") + 1)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return scored.join(told, "_row", "left").select(
        F.col("_id").alias("doc_id"), F.col("_learn").alias("learned"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("t", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + gain).alias("base_score"), (F.col("model") + gain).alias("score")
    )
