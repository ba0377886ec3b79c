"""Verdicts and scores of the queries' operators against the models walked by plain loops."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ribospark.llm import language_id, lm_scoring, quality_rules
from ribospark.llm.common import WORD, ascii_lower, word_arrays


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of four hundred words of two languages, some labels, null and empty texts, equal rows and one of over a megabyte."""
    rng = np.random.default_rng(12)
    vocabulary = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(200)] for lang, letters in (("a", "abcdefgh"), ("b", "klmnopqr"))}
    rows = []
    for i in range(120):
        lang = "ab"[i % 2]
        words = [vocabulary[lang][k] for k in np.minimum(rng.zipf(1.3, rng.integers(3, 200)) - 1, 199)]
        rows.append((i, " ".join(words) + (" ### $$$ !!" * 10 if i % 5 == 0 else "."), lang if i % 7 else None, int(i % 5 != 0)))
    rows += [(120, None, "a", 1), (121, "", "b", 0), (122, "### ...", "a", 0), rows[3], rows[3], (123, "abcd efgh " * 110_000, "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int").repartition(4)


def test_lm_score_equals_a_plain_forward_recursion(spark, corpus, monkeypatch):
    held = {}
    fit, top = lm_scoring.fit_hmm, lm_scoring.top_words
    monkeypatch.setattr(lm_scoring, "fit_hmm", lambda *a: held.setdefault("model", fit(*a)))
    monkeypatch.setattr(lm_scoring, "top_words", lambda *a: held.setdefault("top", top(*a)))
    docs = corpus.filter("doc_id <> 123")
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = lm_scoring.score_texts(docs, learn, n_top=60, states=4, warm_rounds=3).collect()
    texts = {r["doc_id"]: [ascii_lower(w) for w in WORD.findall(r["text"] or "")] for r in docs.collect()}
    counts = Counter(w for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for w in texts[r["doc_id"]])

    def seen_as(word):
        h, tail, _ = word_arrays(pa.array([word]))
        return int(h.view(np.int64)[0]), int(lm_scoring.word_classes(tail)[0])

    known = {w: seen_as(w) for ws in texts.values() for w in ws}
    place = {r["h"]: k + 1 for k, r in enumerate(held["top"][0])}
    rare = Counter()  # of a class: all counts of its rare words, and one for each and for what was never seen
    for w, c in counts.items():
        if known[w][0] not in place:
            rare[known[w][1]] += c + 1
    model = held["model"]

    def forward(words):
        total, alpha = 0.0, None
        for w in [*words, None]:
            symbol, share = 0, 1.0
            if w is not None:
                h, kind = known[w]
                symbol, share = (place[h], 1.0) if h in place else (len(place) + 1 + kind, (counts[w] + 1) / (rare[kind] + 1))
            before = model.start if alpha is None else [sum(alpha[i] * model.move[i][j] for i in range(4)) for j in range(4)]
            alpha = [before[j] * model.emit[symbol][j] * share for j in range(4)]
            scale = sum(alpha)
            alpha, total = [x / scale for x in alpha], total + math.log10(scale)
        return total

    assert len(got) == docs.count() and len(place) <= 60 < len(counts)
    for r in got:
        assert r["score"] == pytest.approx(forward(texts[r["doc_id"]]), rel=1e-6)


def test_the_first_model_learns_from_every_training_text(spark, corpus, monkeypatch):
    """Pairs of neighbours are counted over all training texts, whole ones: against a plain loop, with few and many symbols apart."""
    held = {}
    counted = lm_scoring.count_pairs
    monkeypatch.setattr(lm_scoring, "count_pairs", lambda *a: held.setdefault("pairs", counted(*a)))
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    texts = [[ascii_lower(w) for w in WORD.findall(r["text"] or "")] for r in corpus.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    counts = Counter(w for t in texts for w in t)
    hashed = {w: word_arrays(pa.array([w])) for w in counts}
    by_count = sorted(counts, key=lambda w: (-counts[w], int(hashed[w][0].view(np.int64)[0])))
    for apart in (10, 4000):
        held.clear()
        monkeypatch.setattr(lm_scoring, "PAIRED", apart)
        assert lm_scoring.score_texts(corpus, learn, states=3, passes=0, warm_rounds=2).count() == corpus.count()
        single = {w: k + 1 for k, w in enumerate(by_count[: apart - 1])}
        rows = min(apart, len(counts) + 1)
        want = Counter()
        for t in texts:
            now = [single[w] if w in single else rows + int(lm_scoring.word_classes(hashed[w][1])[0]) for w in t] + [0]
            want.update(zip([rows + lm_scoring.CLASSES, *now], now))
        pairs = held["pairs"]
        assert {(int(i), int(j)): int(pairs[i, j]) for i, j in np.argwhere(pairs)} == want
        assert pairs.sum() == sum(len(t) + 1 for t in texts) and pairs.sum() > 200_000


def test_kept_equals_a_plain_walk_of_the_trees(spark, corpus):
    labels = corpus.select("doc_id", "quality").distinct()
    model = quality_rules.fit_quality(corpus, labels)
    rows = quality_rules.judge_quality(corpus, model).collect()
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}

    def walk(at, x):
        while model.feature[at] >= 0:
            at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
        return model.value[at]

    for r in rows:
        stats = quality_rules.document_stats(texts[r["doc_id"]])
        p = 1 / (1 + math.exp(-(model.base + sum(walk(root, stats.features) for root in model.roots))))
        failed = stats.n_words < 50 or 100 * stats.n_repeat_words > 50 * stats.n_words
        assert (r["base_failed"], r["kept"]) == (failed, not failed and p >= 0.5) and r["quality"] == pytest.approx(p)
    assert len({r["kept"] for r in rows}) == 2 and len(rows) == corpus.count()


def test_languages_equal_the_shortest_of_plain_code_lengths(spark, corpus):
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = language_id.learn_languages(corpus, learn)
    rows = language_id.predict_languages(corpus, model).collect()
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert len(rows) == corpus.count() and model.languages == ["a", "b"]
    for r in rows:
        text = texts[r["doc_id"]]
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und"
            continue
        bits = model.code_lengths([text.encode()])[0]  # held against a plain recursion in the model's test
        best = min(range(2), key=lambda k: bits[k])
        assert r["lang_pred"] == model.languages[best] and r["score"] == pytest.approx(1 / sum(2.0 ** max(-1000, bits[best] - b) for b in bits))
    right = [(r["doc_id"], r["lang_pred"]) for r in rows if r["lang_pred"] != "und" and r["doc_id"] < 120]
    assert all(lang == "ab"[i % 2] for i, lang in right)
