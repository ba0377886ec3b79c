"""The operators on small tables: odd rows, empty tables and brute-force versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ribospark.llm import decontamination, language_id, line_dedup, lm_scoring, mixing, near_dedup, quality_rules, suffix_dedup, token_output, url_filters
from ribospark.llm.common import WORD, WordHashes, ascii_lower, key_filter
from ribospark.llm.queries import mix_documents, op6_line_dedup, op7_mixing, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, class_id long, size string"
PASSAGE = " ".join(f"word{i * 7919 % 1000}" for i in range(120))
LONG = " ".join(f"tok{i * 31 % 9973}" for i in range(4000))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n\t", "One.", "one", PASSAGE, PASSAGE, "Before it. " + PASSAGE + ". After it.", LONG, LONG + " end", "x" * 5000, "ein text der sprache " * 20, "the text of that language " * 20, "!!! ###", PASSAGE]
    rows = [(i if i != 13 else None, t, ["en", "de", None][i % 3], ["s", None, "t"][i % 3], None, 0.5, "clash", 1, "clash") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(PASSAGE.split()[10:60])), (2, "short item"), (None, LONG[:400]), (3, None), (4, "Text, der")], "item_id long, text string")


def _texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_decontamination(docs, empty, items):
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_contained(docs, items).collect()}

    def shingles(t, size=5):
        w = decontamination.shingle_words(t)
        return set(zip(*(w[k:] for k in range(size))))

    want = set()
    for d, t in _texts(docs):
        for i, q in [(r["item_id"], r["text"]) for r in items.collect()]:
            size = min(5, len(decontamination.shingle_words(q))) or 5
            if shingles(q, size) and len(shingles(q, size) & shingles(t, size)) >= 0.8 * len(shingles(q, size)):
                want.add((d, i))
    assert got == want and len({i for _, i in got}) == 3
    assert decontamination.find_contained(empty, items).count() == 0
    assert decontamination.find_contained(docs, items.limit(0)).count() == 0
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - sum(1 for d, _ in _texts(docs) if d in {x for x, i in got if i != 4})
    assert decontamination.drop_contaminated(docs, items, least_words=1).count() == kept.count() - 1


def test_blocks_of_a_large_benchmark(docs, items, monkeypatch):
    whole = sorted(map(str, decontamination.find_contained(docs, items).collect()))
    kept = sorted(map(str, decontamination.drop_contaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 60)
    assert sorted(map(str, decontamination.drop_contaminated(docs, items).collect())) == kept
    assert sorted(map(str, decontamination.find_contained(docs, items).collect())) == whole


def test_near_duplicates(docs, empty):
    got = Counter((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(docs).collect())
    hashes = WordHashes()
    rows = _texts(docs)
    bags = [near_dedup.bag(t, hashes) for _, t in rows]
    bags = [b if len(b[0]) else (np.array([zlib.crc32((t or "").encode())], np.uint64), np.array([10**6])) for b, (_, t) in zip(bags, rows)]  # equal without words
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.bag_similarity(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), 10**9), d)
    assert Counter((d, c if c is None or c >= 0 else "none") for d, c in got.elements()) == Counter((d, least.get(find(i), "none")) for i, (d, _) in enumerate(rows))
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({find(i) for i in range(len(rows))})


def test_near_duplicates_without_words_or_ids(spark):
    """A partition of only wordless texts, and classes none of whose rows has an id."""
    rows = [(i, t) for i, t in enumerate([None, "", "!!!", "!!!", "?"])] + [(None, PASSAGE), (None, PASSAGE + " x"), (None, LONG)]
    df = spark.createDataFrame(rows[:5], "doc_id long, text string").coalesce(1).unionByName(spark.createDataFrame(rows[5:], "doc_id long, text string"))
    got = [(r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(df).collect()]
    assert sorted(x for x in got if x[0] is not None) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)]
    assert sorted(Counter(c for d, c in got if d is None).values()) == [1, 2] and all(c < 0 for d, c in got if d is None)
    assert near_dedup.near_duplicates(df.filter("doc_id < 5")).count() == 5


def test_near_duplicates_across_blocks(spark, monkeypatch):
    """A chain of near copies without a centre: blocks of two members lose no link."""
    base = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(base[: 400 - 12 * n])) for n in range(12)] + [(50 + n, " ".join(base[:200] + [f"z{n}{i}" for i in range(150)])) for n in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    for large in (200_000, 3):  # in blocks, and dealt anew by longer keys before
        monkeypatch.setattr(near_dedup, "LARGE", large)
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
        assert all(got[n] == 0 for n in range(12)) and all(got[50 + n] == 50 + n for n in range(6))


def test_large_groups_are_compared_whole(spark, monkeypatch):
    """Where neither a group's centre nor its longer keys find a link, the group's own comparison finds all."""
    base = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(base[: 400 - 12 * n])) for n in range(12)] + [(50 + n, " ".join(base[:200] + [f"z{n}{i}" for i in range(150)])) for n in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("LARGE", 3), ("DEALS", 1), ("AGREE", near_dedup.SIZE)):
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(near_dedup, "_alike", lambda pairs, *rest: pairs.limit(0))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == {n: 0 for n in range(12)} | {50 + n: 50 + n for n in range(6)}


def _shuffled(spark):
    """Bytes that all stages of the session have shuffled so far."""
    jvm = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_duplicates_leave_texts_where_they_are(spark):
    """Only texts that may be near copies are shuffled, not the corpus; copies go and repeated rows stay once all the same."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.integers(0, 10**9, 4000).astype(str)) for _ in range(60)]
    rows = [*enumerate(texts), (70, texts[3]), (71, texts[3] + " end"), (3, texts[3]), (5, texts[5]), (None, texts[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).localCheckpoint()
    before = _shuffled(spark)
    kept = near_dedup.drop_near_duplicates(docs).collect()
    assert sorted(tuple(r) for r in kept) == rows[:60]
    assert _shuffled(spark) - before < sum(map(len, texts)) / 2


def test_key_filter(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(-(10**6), 10**6, 1001)]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    known = key_filter(frame)
    assert frame.filter(known("k")).count() == len(keys)
    assert spark.range(10**8, 10**8 + 5000).filter(known("id")).count() < 50
    assert frame.filter(key_filter(frame.limit(0))("k")).count() == 0


def test_suffix_dedup(docs, empty, monkeypatch):
    def check():
        rows = [(d, (t or "").encode()) for d, t in _texts(docs)]
        n = suffix_dedup.LENGTH
        seen = Counter(b[i : i + n] for _, b in rows for i in range(len(b) - n + 1))
        want = Counter()
        for d, b in rows:
            covered = bytearray(len(b))
            for i in range(len(b) - n + 1):
                if seen[b[i : i + n]] > 1:
                    covered[i : i + n] = b"\1" * n
            kept = bytes(x for x, c in zip(b, covered) if not c)
            spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
            want[(d, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())] += 1
        got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
        assert got == want

    check()
    monkeypatch.setattr(suffix_dedup, "HOT", 1)  # the way of keys with very many runs
    check()
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_line_dedup(docs, empty):
    rows = line_dedup.dedup_units(docs, min_words=10).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and {(r["n_removed"], r["longest_run"], r["kept_text"]) for r in rows if r["doc_id"] in (0, 1)} == {(0, 0, "")}
    assert all(got[d]["removed_words"] == got[d]["longest_run"] == 120 for d in (6, 14))
    assert {d for d, r in got.items() if r["n_removed"]} == {6, 7, 14}  # the copies behind the first; a row like another is the same document
    assert got[6]["kept_text"] == "" and got[6]["kept_docs"] == [5]
    assert got[7]["kept_text"].split() == ["Before", "it.", ".", "After", "it."] or got[7]["kept_text"].split() == ["Before", "it.", "After", "it."]
    assert line_dedup.dedup_units(empty).count() == 0


def test_line_dedup_against_a_plain_pass(spark, docs):
    """Every repeated unit goes, in the order of ids (none last), over odd rows and driver documents."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text")
    df = docs.select("doc_id", "text").unionByName(real)
    rows = sorted({(d is None, d or 0, t) for d, t in _texts(df) if t}, key=lambda r: r[:2])
    assert len({r[:2] for r in rows}) == len(rows)
    seen, want = {}, {}
    for none, d, text in rows:
        lost, kept = [], set()
        for k, (a, z, _, digest) in enumerate(line_dedup.units(text)):
            if digest in seen:
                lost.append((k, a, z))
                kept.add(seen[digest])
            seen.setdefault(digest, None if none else d)
        if lost:
            starts = [a for i, (k, a, _) in enumerate(lost) if not i or lost[i - 1][0] != k - 1]
            ends = [z for i, (k, _, z) in enumerate(lost) if i + 1 == len(lost) or lost[i + 1][0] != k + 1]
            want[None if none else d] = (len(line_dedup.units(text)), len(lost), starts, ends, sorted(kept))
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["starts"], r["ends"], r["kept_docs"]) for r in line_dedup.dedup_units(df).collect()}
    assert {d: r for d, r in got.items() if r[1]} == want and len(want) > 20
    assert all(r == (len(line_dedup.units(t)), 0, [], [], []) for d, t in _texts(df) if d not in want for r in [got[d]])


def test_line_dedup_query_removes_short_units(spark, tmp_path):
    """The registered query against a plain pass: every occurrence of a unit but the first goes, however short."""
    texts = ["Read more\nUp here it rains. Ok.", "Sign up!\nA line of its own\nRead more\nRead  MORE\nAnother one", "Ok. But why? Ok.\nsign up", "Nothing twice."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = set(), {}
    for d, text in enumerate(texts):
        marked = []
        for a, z, _, digest in line_dedup.units(text):
            marked.append((a, z, digest in seen))
            seen.add(digest)
        starts = [a for k, (a, _, r) in enumerate(marked) if r and not (k and marked[k - 1][2])]
        ends = [z for k, (_, z, r) in enumerate(marked) if r and not (k + 1 < len(marked) and marked[k + 1][2])]
        if starts:
            kept = "".join(text[a:z] for a, z in zip([0, *ends], [*starts, len(text)]))
            want[d] = (sum(r for _, _, r in marked), starts, ends, hashlib.sha256(kept.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_removed"], r["starts"], r["ends"], r["kept_sha256"]) for r in op6_line_dedup(spark, str(tmp_path)).filter("n_removed > 0").collect()}
    assert got == want and {d: n for d, (n, *_) in got.items()} == {1: 2, 2: 3}


def test_language_id(docs, empty):
    got = Counter((r["doc_id"], r["lang_pred"]) for r in language_id.held_out_languages(docs).collect())
    assert sum(got.values()) == docs.count() and got[(0, "und")] == got[(1, "und")] == got[(None, "und")] == 1
    assert language_id.held_out_languages(empty).count() == 0
    model = language_id.learn_languages(docs, F.lit(True))
    assert language_id.keep_known(docs, model).columns == docs.columns
    assert {r["lang_pred"] for r in language_id.predict_languages(docs, None).collect()} == {"und"}


def test_language_sample_takes_a_megabyte_and_long_texts(spark):
    rows = [(i, f"{i}the text " * 30_000, "en") for i in range(4)] + [(9, "ein satz " * 130_000, "de")]
    model = language_id.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == ["de", "en"]  # all texts of de are over the bound
    assert all(model.code[ord(str(i))] for i in range(4))  # 0.9 MB come before the last of en


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(15)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge_quality(docs, quality_rules.fit_quality(docs, labels)).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_words"] == 0 and by[0]["base_failed"] and not by[0]["kept"]
    assert by[11]["base_failed"] and not by[5]["base_failed"]
    assert quality_rules.fit_quality(docs, labels.limit(0)) is None
    assert quality_rules.judge_quality(docs, None).filter("not base_failed and not kept").count() == 0
    assert quality_rules.judge_quality(empty, None).count() == 0


def _lm_tokens(text):
    return [ascii_lower(w) for w in WORD.findall(text or "")]


def test_lm_scores(docs, empty):
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    rows = lm_scoring.score_texts(docs, learn, n_top=30, warm_rounds=2).collect()
    counts = Counter()
    for d, t in _texts(docs):
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            counts.update([*_lm_tokens(t), ""])
    n, v = sum(counts.values()), len(counts)
    texts = {d: t for d, t in _texts(docs)}
    import math

    for r in rows:
        words = [*_lm_tokens(texts[r["doc_id"]]), ""]
        assert r["n_tokens"] == len(words) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r["score"] < 0
    assert len(rows) == docs.count()
    assert lm_scoring.score_texts(empty, F.lit(True)).count() == 0
    nothing = lm_scoring.score_texts(docs, F.lit(False), warm_rounds=1).collect()
    assert {r["n_known"] for r in nothing} == {0}


def test_mixing(docs, empty):
    rows = mix_documents(docs).collect()
    assert len(rows) == docs.count()
    taken, target, source = Counter(), {}, {}
    for r in rows:
        key = r["members"][0]
        taken[key] += r["taken"]
        target[key], source[key] = r["target"], r["source_size"]
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["size"] * r["copies"]
    most = max(r["size"] for r in rows)
    assert all(abs(taken[k] - target[k]) <= most for k in target) and sum(target.values()) == pytest.approx(sum(source.values()))
    assert sorted(map(str, rows)) == sorted(map(str, mix_documents(docs.repartition(5)).collect()))
    assert mix_documents(empty).count() == 0
    out = mixing.mixed_documents(docs, F.array("source"), mixing.word_count(F.col("text")))
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in rows)


def test_mixing_of_equal_rows(spark):
    """Rows that share id and size are told apart: no target is missed by more than a document."""
    for ids in ("cast(null as long)", "id % 3"):
        df = spark.range(3000).selectExpr(f"{ids} as doc_id", "'a b c d e' as text", "array('s', 't', 'u')[cast(id % 2 + if(id % 6 = 5, 1, 0) as int)] as source")
        rows = mix_documents(df.repartition(7, "doc_id", "source")).collect()
        taken, target = Counter(), {}
        for r in rows:
            taken[r["members"][0]] += r["taken"]
            target[r["members"][0]] = r["target"]
        assert len(target) == 3 and all(abs(taken[k] - target[k]) <= 5 for k in target), (ids, taken, target)


def test_mixing_query_against_plain_sums(spark):
    """size, source_size and target of every row of the registered query, computed anew."""
    folder = "/root/testdata/sf0.001"
    words = {r["doc_id"]: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sizes = Counter()
    for d, n in words.items():
        sizes[source[d]] += n
    rows, taken = op7_mixing(spark, folder).collect(), Counter()
    targets = mixing.share_targets(dict(sizes))
    for r in rows:
        assert (r["size"], r["source_size"]) == (words[r["doc_id"]], sizes[source[r["doc_id"]]])
        assert r["target"] == pytest.approx(targets[source[r["doc_id"]]])
        assert r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(rows) == len(words) and all(abs(taken[s] - targets[s]) <= max(words.values()) for s in targets)


def test_token_output(spark, docs, empty, tmp_path):
    got = token_output.token_output(docs, tokenizer_path(), 2, str(tmp_path / "a"), shard_tokens=500).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in _texts(docs)), key=lambda d: (d is not None, d))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    crc = lambda text: zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in [*t.encode(text or "", add_special_tokens=False).ids, 2]))
    want = {d: crc(x) for d, x in _texts(docs)}
    at = 0
    for r in got:
        assert r["start"] == at and r["ids_crc32"] == want[r["doc_id"]]
        at += r["n_tokens"]
    assert token_output.token_output(empty, tokenizer_path(), 2, str(tmp_path / "b")).count() == 0
    same = spark.createDataFrame([(None if i % 2 else 7, f"text {i % 50}") for i in range(400)], "doc_id long, text string")
    rows = token_output.token_output(same, tokenizer_path(), 2, str(tmp_path / "c"), shard_tokens=100).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] * 200 + [7] * 200 and rows[-1]["start"] + rows[-1]["n_tokens"] == sum(r["n_tokens"] for r in rows)


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "x"), (3, "http://a.net/b"), (3, "http://a.net/b"), (None, "https://spam-farm.example.org/en/1")], "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = url_filters.filter_urls(pages, url_filters.default_rules())
    assert Counter(tuple(r) for r in rows.collect()) == Counter({(1, "", "", None, "allow", None): 1, (2, "", "", None, "allow", None): 1, (3, "a.net", "/b", "net/", "block", None): 2, (None, "spam-farm.example.org", "/en/1", None, "block", "spam farm"): 1})
    assert url_filters.filter_urls(pages.limit(0), url_filters.default_rules()).count() == 0


def test_pipeline_against_plain_loops(spark, tmp_path):
    """Odd rows through ``run``: nulls, repeated rows and ids, texts without words, extra columns, near copies and a leak."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    real = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    leak = real[3][1] + " " + PASSAGE
    rows = [*real, (500, None, "en", "s"), (501, "", None, None), (502, "!!! 12", "en", "s"), (None, real[5][1] + " tail", "en", None), (None, leak, None, "s"), real[0], real[0], (0, real[7][1] + " x y", "en", "s"), (503, "漢字仮名交じり文" * 80, None, "s")]
    docs = spark.createDataFrame([(*r, 1, 0.5, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, _h string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "of the")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder, now, plain = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), [(r[0], r[1]) for r in rows]
    # language id: nothing without a letter stays, all texts of the learned languages do
    now = corpus_pipeline.STAGES[0][1](spark, now, folder)
    plain = [(d, t) for d, t in plain if t and re.search("[A-Za-z]", t)]
    assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == Counter(plain) and now.columns == docs.columns
    # near dedup: components of all pairs, the least id (null last) stays, once
    hashes, root = WordHashes(), list(range(len(plain)))
    bags = [near_dedup.bag(t, hashes) for _, t in plain]
    for i in range(len(plain)):
        for j in range(i):
            if near_dedup.bag_similarity(bags[i], bags[j]) >= 0.8:
                root = [root[j] if x == root[i] else x for x in root]
    now = corpus_pipeline.STAGES[1][1](spark, now, folder)
    left = [(r["doc_id"], r["text"]) for r in now.collect()]
    want = [min((d is None, d or 0) for k, (d, _) in enumerate(plain) if root[k] == c) for c in set(root)]
    assert Counter((d is None, d or 0) for d, _ in left) == Counter(want) and set(left) <= set(plain) and len(left) < len(plain)
    # decontamination: the passage's document goes, short items are ordinary language
    now = corpus_pipeline.STAGES[2][1](spark, now, folder)
    left = [(d, t) for d, t in left if PASSAGE not in t]
    assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == Counter(left)
    # mixing and tokens: no row more than three times, sources near their targets, ids as the library gives them
    mixed = [(r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.STAGES[3][1](spark, now, folder).collect()]
    sizes, taken, count = Counter(), Counter(), lambda t: len(WORD.findall(t))
    for r in now.collect():
        sizes[r["source"]] += count(r["text"])
    for _, t, source in mixed:
        taken[source] += count(t)
    targets = mixing.share_targets(dict(sizes))
    assert all(abs(taken[s] - targets[s]) <= max(count(t) for _, t in left) for s in targets)
    assert max(Counter(mixed).values()) <= 3 and {(d, t) for d, t, _ in mixed} <= set(left)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    crc = lambda t: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*tokenizer.encode(t, add_special_tokens=False).ids, 2]))
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((d, crc(t)) for d, t, _ in mixed)
    spark.createDataFrame([], docs.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_languages_of_the_fold(spark):
    """Held-out accuracy of the query on driver documents, and scores as shares of the posterior."""
    from ribospark.llm.queries import op10_language_id

    folder = "/root/testdata/sf0.001"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op10_language_id(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows) and len(rows) == len(truth)
    fold = [r for r in rows if r["held_out"] and truth[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in fold) >= 0.95 * len(fold)


def test_items_with_marks_and_repeated_items(spark, monkeypatch):
    """Combining marks belong to their words; rows of an item that come twice are reported twice; names may clash."""
    hindi = "यह हिन्दी की पंक्ति"
    assert len(decontamination.shingle_words(hindi)) == 4
    rows = [(1, f"आज {hindi} है और कुछ नहीं", 1, 2, 3, 4), (2, hindi + "!", 1, 2, 3, 4), (3, "something else entirely and more of it", 1, 2, 3, 4), (4, None, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _leak_id int, _leak_h int, _dedup_own int, _mix_hash int")
    items = spark.createDataFrame([(7, hindi), (7, hindi), (8, "else entirely and more of")], "item_id long, text string")
    for size in (decontamination.BLOCK_SHINGLES, 4):
        monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", size)
        assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_contained(docs, items).collect()) == [(1, 7), (1, 7), (2, 7), (2, 7), (3, 8)]
        kept = decontamination.drop_contaminated(docs, items)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]  # a short item must be the whole text
        assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(docs, items, least_words=1).collect()) == [4]


def test_clashing_names_stay(spark):
    names = ("_dedup_own", "_dedup_id", "_dedup_h", "_mix_hash", "_mix_size", "_mix_row", "_mix_order", "doc", "m", "s", "id")
    docs = spark.createDataFrame([(i, f"text number {i} of many words that stay apart {i * 7} {i * 13}", "ab"[i % 2], *range(len(names))) for i in range(12)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))
    mixed = mixing.mixed_documents(docs, F.array("source"), mixing.word_count(F.col("text")))
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(map(tuple, docs.collect())) and mixed.count() > 0


def test_flow_equals_exhaustive_search_with_overlapping_sources():
    """Words routed and their repetition cost, over all ways to give each pattern's words to its sources."""
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(40):
        patterns = {p: rng.randint(1, 3) for p in rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("c",)], 3)}
        targets = {s: rng.randint(0, 5) for s in sorted({s for p in patterns for s in p})}
        used = mixing.route(patterns, targets)
        assert all(0 <= used[p] <= 3 * n for p, n in patterns.items())

        def reachable(amounts):
            """Whether the sources' quotas hold the amounts, each pattern's split among its sources."""
            left = [targets]
            for p, n in amounts.items():
                left = [{**t, **{s: t[s] - k for s, k in zip(p, ks)}} for t in left for ks in itertools.product(range(n + 1), repeat=len(p)) if sum(ks) == n and all(t[s] >= k for s, k in zip(p, ks))]
            return bool(left)

        cost = lambda amounts: sum(sum(range(1, 4)[k // patterns[p]] for k in range(n)) for p, n in amounts.items())
        ways = [dict(zip(patterns, ns)) for ns in itertools.product(*(range(3 * n + 1) for n in patterns.values()))]
        ways = [w for w in ways if reachable(w)]
        most = max(sum(w.values()) for w in ways)
        least = min(cost(w) for w in ways if sum(w.values()) == most)
        assert reachable(used) and sum(used.values()) == most and cost(used) == least


def test_pipeline_sends_texts_in_bounded_batches(spark, tmp_path, monkeypatch):
    """No stage gives Python more than ``TEXT_ROWS`` texts at once, or starts Python workers for rows that the driver has; a lower setting stays."""
    import corpus_pipeline
    from pyspark import SparkContext
    from pyspark.sql.classic.dataframe import DataFrame
    from ribospark.plans import runtime

    words = [f"w{i}" for i in range(97)]
    rows = [(i, " ".join(words[(i * k + i) % 97] for k in range(20)), "en" if i % 2 else "de", "ab"[i % 2]) for i in range(2500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    most, usual, plain = 1000, "10000", DataFrame.mapInArrow

    def watched(self, run, schema, *args):
        def counted(batches):
            for b in batches:
                if b.num_rows > most:
                    raise ValueError(f"a batch of {b.num_rows} rows")
                yield b

        return plain(self, lambda batches: run(counted(batches)), schema, *args)

    monkeypatch.setattr(DataFrame, "mapInArrow", watched)
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("a Python RDD for rows of the driver"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        assert runtime.TEXT_ROWS <= most
        now = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            spark.conf.set(key, usual)
            stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
            now = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert now.count() > 0
        spark.conf.set(key, "7")
        runtime.bound_batches(spark)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)
