"""The operators' inner parts against plain versions, without Spark."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ribospark.llm import decontamination, language_id, line_dedup, lm_scoring, mixing, near_dedup, quality_rules, suffix_dedup, token_output, url_filters
from ribospark.llm.common import WordHashes
from ribospark.llm.queries import tokenizer_path


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.integers(1, 6))
def test_suffix_array(text, times):
    text = (text * times)[:160] + [0]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300))
def test_wavelet_matrix(ids):
    ids = np.array(ids, np.uint32)
    _, _, m = token_output.read_shard(token_output.write_shard([1], [len(ids)], ids))
    assert np.array_equal(m.tokens(), ids)
    for i in range(len(ids)):
        assert m.access(i) == ids[i]
    for t in [*ids[:5].tolist(), 3]:
        assert m.count(t) == (ids == t).sum() and m.positions(t) == np.flatnonzero(ids == t).tolist()
        assert m.rank(t, len(ids) // 2) == (ids[: len(ids) // 2] == t).sum()


def _same_ids(texts):
    coder = token_output.WordEncoder(tokenizer_path())
    ids, sizes = coder.encode(texts)
    at = 0
    for text, n, want in zip(texts, sizes.tolist(), coder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at : at + n].tolist() == want.ids, repr(text)
        at += n
    assert at == len(ids)
    return coder


def test_words_encode_like_whole_texts(monkeypatch):
    rng = random.Random(3)
    letters = "aZ'sStTrR1 9.,!?-_é É ñß€«»¿¡'llve\n\t\x0b„“”‚‘’…–—#$%&*²ªΣİ́漢"
    texts = ["", "it's 'sIt'LL!! <|endoftext|>x \x1c\x85 Σς ſ ŉ ½"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    coder = _same_ids(texts)
    for token in coder.special:
        _same_ids([token, f"x{token}y", f" {token} it's{token}"])
    monkeypatch.setattr(token_output, "SPAN", 20)
    _same_ids([*texts, "long it's text " * 50, "x" * 200, "a" * 30 + " b"])


def test_every_character_of_the_first_plane():
    _same_ids([f"a{c}b{c} {c}'s{c}A" for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000])


def test_a_full_table_of_pieces_starts_again():
    coder = token_output.WordEncoder(tokenizer_path(), limit=5)
    for text in ("one two three four five six", "seven one it's", "six five"):
        assert coder.encode([text])[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    a, b = (x, rng.integers(1, 9, 300)), (x, rng.integers(1, 30, 300))
    s = near_dedup.bag_minhash([a, b], 6000)
    assert abs((s[0] == s[1]).mean() - near_dedup.bag_similarity(a, b)) < 0.03
    assert np.array_equal(s[0], near_dedup.bag_minhash([a], 6000)[0])  # a batch doesn't matter


def test_flow_takes_unused_words_first():
    used = mixing.route({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 120, "b": 40})
    assert used == {("a",): 100, ("a", "b"): 50, ("b",): 10}
    assert mixing.route({("a",): 10}, {"a": 25}) == {("a",): 25}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3)), st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(sizes):
    targets = mixing.share_targets(sizes)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()), abs=1e-6)
    assert all(targets[s] <= 3 * sizes[s] + 1e-6 for s in sizes)


def test_ppm_prefers_its_language_and_pieces_do_not_matter(monkeypatch):
    tree = language_id.PpmLanguages({"x": [b"abab abab baba " * 20], "y": [b"cdcd dcdc ccdd " * 20]})
    assert [r[0] for r in language_id.judge(tree, ["abab", "dcdc", None, "", "12 !"])] == ["x", "y", "und", "und", "und"]
    texts = [b"abab cdcd zz", b"q", b"baba " * 30]
    whole = tree.code_lengths(texts)
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert np.allclose(whole, tree.code_lengths(texts))


def _plain_code_length(tree, texts, data):
    """PPM with escapes, byte by byte, from counts taken anew."""
    out = []
    for lang in tree.languages:
        grams = {}
        for t in [x for x in texts[lang]]:
            for n in range(1, tree.depth + 2):
                for i in range(len(t) - n + 1):
                    grams[t[i : i + n]] = grams.get(t[i : i + n], 0) + 1
        total = {}
        for other in tree.languages:
            for t in texts[other]:
                for n in range(1, tree.depth + 2):
                    for i in range(len(t) - n + 1):
                        total[t[i : i + n]] = total.get(t[i : i + n], 0) + 1
        keep = {g for g, c in total.items() if len(g) <= 2 or c >= 2}
        bits = 0.0
        for i in range(len(data)):
            for n in range(min(i, tree.depth), -1, -1):
                ctx = data[i - n : i]
                kids = {g[-1]: c for g, c in grams.items() if len(g) == n + 1 and g[:-1] == ctx and g in keep}
                if not kids:
                    continue
                whole = sum(kids.values()) + len(kids)
                if data[i] in kids:
                    bits -= np.log2(kids[data[i]] / whole)
                    break
                bits -= np.log2(len(kids) / whole)
            else:
                bits += 8
        out.append(bits)
    return out


def test_ppm_code_length_is_exact():
    texts = {"x": [b"the cat sat on the mat, the cat ran"], "y": [b"el gato se sento en la mesa del gato"]}
    tree = language_id.PpmLanguages(texts)
    for data in (b"the gato sat", b"zzz", b"en la mat, el cat", b"t"):
        assert tree.code_lengths([data])[0] == pytest.approx(_plain_code_length(tree, texts, data))


def test_a_small_tree_keeps_whole_grams():
    """Where memory is short the seldom grams of all lengths go, with their longer ones."""
    import pickle

    rng = random.Random(6)
    texts = {x: [" ".join(rng.choice(["eins", "zwei", "one", "two", "uno"]) + rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(300)).encode()] for x in "xyz"}
    full = language_id.PpmLanguages(texts)
    for room in (60_000, 20_000):
        tree = language_id.PpmLanguages(texts, max_tree=room)
        assert tree.seen > full.seen == 2 and sum(map(len, tree.parents)) < sum(map(len, full.parents))
        again = pickle.loads(pickle.dumps(tree))
        assert np.array_equal(again.code_lengths(texts["x"]), tree.code_lengths(texts["x"]))


def test_signs_are_no_letters():
    tree = language_id.PpmLanguages({"x": [b"abab"]})
    assert [r[0] for r in language_id.judge(tree, ["²", "½ ①", "12_", "é", "漢"])] == ["und", "und", "und", "x", "x"]


def test_unknown_languages_are_rejected():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    tree = language_id.PpmLanguages({"x": [text(300).encode() for _ in range(20)]})
    other = " ".join("".join(rng.choice("qrstuvwxyz") for _ in range(6)) for _ in range(100))
    assert language_id.is_known(tree, [text(5), text(500), other, "漢字" * 60, None, "1"], 0.5) == [True, True, False, False, False, False]


def test_no_signatures():
    none = near_dedup.bag_minhash([])
    assert near_dedup.band_keys(none).shape == (0, near_dedup.BANDS)


def test_hmm_forward_and_counts():
    rng = np.random.default_rng(4)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = lm_scoring.HiddenMarkov(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((6, 3)), 0))
    texts = [rng.integers(0, 6, n) for n in (1, 4, 5, 2)]
    from itertools import product

    for s, got in zip(texts, model.log10(texts)):
        p, counts = 0.0, np.zeros((6 + 3 + 1, 3))
        for path in product(range(3), repeat=len(s)):
            q = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                q *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            p += q
            for t, k in enumerate(path):
                counts[s[t], k] += q
                if t:
                    counts[6 + path[t - 1], k] += q
            counts[9, path[0]] += q
        assert got == pytest.approx(np.log10(p))
        found = np.zeros((10, 3))
        model.expected([s], found)
        assert np.allclose(found, counts / p, atol=1e-4)


def test_counts_over_the_cuts_of_a_text(monkeypatch):
    """Stretches with a lap count nearly what the whole text does, and as many transitions."""
    rng = np.random.default_rng(8)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = lm_scoring.HiddenMarkov(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((6, 3)), 0))
    texts = [rng.integers(0, 6, n) for n in (3000, 801, 400, 1)]
    cut, whole = np.zeros((10, 3)), np.zeros((10, 3))
    model.expected(texts, cut)
    monkeypatch.setattr(lm_scoring, "STRETCH", 10_000)
    model.expected(texts, whole)
    assert cut[6:9].sum() == pytest.approx(sum(len(t) - 1 for t in texts), rel=1e-4)
    assert np.allclose(cut, whole, rtol=1e-3, atol=0.02)


def test_word_arrays(monkeypatch):
    from ribospark.llm import common

    texts = ["", None, "One two", "two ÉÉ\x85x \t\v one", "a" * 50 + " B", " ", "漢字 b\n", "one"]
    for span in (1 << 19, 8):
        monkeypatch.setattr(common, "_SPAN", span)
        h, tail, n = common.word_arrays(pa.array([*texts, "x", *texts])[len(texts) + 1 :])
        words = [common.ascii_lower(w) for t in texts for w in common.WORD.findall(t or "")]
        assert n.tolist() == [len(common.WORD.findall(t or "")) for t in texts] and len(h) == len(words)
        assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
        assert [int(t) for t in tail] == [int.from_bytes(w.encode()[-2:], "big") for w in words]
    assert [len(x) for x in common.word_arrays(pa.array([], pa.string()))] == [0, 0, 0]


def test_boosted_trees_are_monotone():
    rng = np.random.default_rng(2)
    x = rng.random((800, 2))
    y = ((x[:, 0] < 0.5) ^ (rng.random(800) < 0.1)).astype(float)
    model = quality_rules.BoostedTrees(n_trees=20, monotone=(-1, 0)).fit(x, y)
    grid = np.stack([np.linspace(0, 1, 50), np.full(50, 0.3)], axis=1)
    assert (np.diff(model.predict(grid)) <= 1e-12).all()
    assert ((model.predict(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30))
def test_repeated_windows(words):
    marked = [False] * len(words)
    seen = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, w in enumerate(seen):
        if seen.count(w) > 1:
            marked[i : i + 3] = [True] * 3
    assert quality_rules.repeated_window_words(words) == sum(marked)


def test_urls():
    index = url_filters.RuleIndex(url_filters.default_rules(), {})
    judge = lambda u: index.judge(*url_filters.split_url(u))
    assert url_filters.split_url(None) == url_filters.split_url("a.net/x") == ("", "")
    assert url_filters.split_url("http://A.Net/En?x#y") == ("a.net", "/En")
    assert judge("http://x.example.net/en/1")[:2] == ("example.net/en/", "allow")
    assert judge("http://example.net/de/1")[:2] == ("net/", "block")
    assert judge("http://net")[:2] == (None, "allow") and judge("http://net/")[:2] == ("net/", "block")
    assert judge("http://badexample.com/de/1")[:2] == (None, "allow")
    assert judge("http://www.cheap-pills.example.com/en/1") == (None, "block", "cheap pills")


def test_units_keep_their_offsets():
    text = "One two.  Three four!\n\nFive"
    assert [text[a:b] for a, b, _, _ in line_dedup.units(text)] == ["One two.", "Three four!", "Five"]
    assert line_dedup.units(None) == line_dedup.units(" \n.\n") == []
    assert line_dedup.removed_runs([0, 1, 3], [3, 4, 5], 6) == [(0, 2)] and line_dedup.removed_runs([0, 1, 3], [3, 4, 5], 1) == [(0, 2), (2, 3)]
    assert line_dedup.removed_runs([], [], 1) == []


def test_units_of_long_runs_of_marks():
    start = time.process_time()
    assert [x[:2] for x in line_dedup.units("!" * 200_000 + "a" + "?" * 200_000 + " b...\n\nc")] == [(0, 400_001), (400_002, 400_006), (400_008, 400_009)]
    assert time.process_time() - start < 1


def test_containment_finds_short_items_in_long_texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    item = [rng.choice(words) for _ in range(40)]
    index = decontamination.ContainmentIndex([(7, " ".join(item)), (8, "too short for it"), (9, " ".join(item[:6]))])
    noise = [rng.choice(words) for _ in range(20_000)]
    assert index.search(noise, WordHashes()) == []
    found = lambda w: [index.ids[c] for c, _, _ in index.search(w, WordHashes())]
    assert found(noise[:9000] + item + noise[9000:]) == [7, 9]
    assert found(item[:36]) == [7, 9]  # 32 of 36 shingles
    assert found(item[:30]) == [9]
    assert found(["is", *"too short for it".split(), "x"]) == [8] and found("too short for".split()) == []  # exact below five words


@pytest.mark.parametrize("size", [12, 25, 70, 300, 3000])
def test_every_size_class_is_found(size):
    rng = random.Random(size)
    items = [(n, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(size + 4))) for n in range(10)]
    index = decontamination.ContainmentIndex(items)
    for n, text in items:
        words = text.split()
        assert [c for c, _, _ in index.search(["x"] * 500 + words[: int(size * 0.85) + 5], WordHashes())] == [n]


def test_short_runs_cover_every_window():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(700)) + b"x" * 900 + bytes(rng.choice(b"abc") for _ in range(500))
    starts = [s + k * n + i for s, n, times, *_ in suffix_dedup.short_runs(data) for k in range(times) for i in range(n)]
    assert sorted(starts) == list(range(len(data) - suffix_dedup.LENGTH + 1))
    for s, n, _, _, _, core in suffix_dedup.short_runs(data):
        assert n - 1 <= core < suffix_dedup.BLOCK and s + core + suffix_dedup.CORE <= s + suffix_dedup.LENGTH  # inside the first and the last window


def test_tokens_come_from_the_expression():
    assert url_filters.literal_tokens(r"(?:^|[.\-])spam-farm(?:[.\-]|$)") == ("spam", "farm")
    assert url_filters.literal_tokens(r"^(?:[^/]*[.\-])?casino[.\-]") == ("casino",)
    for none in ("abc", "/abc", "/a?bc/", "/(?:ab|cd)/", "/ab{2}/", "/(?:ab)?/", r"\bab\b", "/ab|/cd/", "[^/]ab/"):
        assert url_filters.literal_tokens(none) == (), none
    assert url_filters.literal_tokens("(?i)/AbC/x1$") == ("abc", "x1")


def test_thousands_of_rules_match_like_running_each():
    """The index against every expression on every URL, ties and allowing rules included."""
    rng = random.Random(12)
    names = ["".join(rng.choice("abcdks") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    forms = ["/{0}/", "^{0}[.]", "(?:^|[.-]){0}-{1}(?:[.-]|$)", "/{0}\\.{1}$", "{0}", "/[^/]*{0}/", "(?i)/{0}/{1}/", "^(?:[^/]*[.])?{0}[./]", "/(?:{0}|{1})/"]
    rules = [url_filters.pattern_rule(f"r{i}", rng.choice(["allow", "block"]), rng.choice(forms).format(rng.choice(names), rng.choice(names))) for i in range(3000)]
    rules += [url_filters.host_rule(f"{a}.{b}/{c}", "block") for a, b, c in (rng.sample(names, 3) for _ in range(200))]
    index = url_filters.RuleIndex(rules, {n: rng.randint(0, 50) for n in names})
    import re

    part = lambda: rng.choice(names) if rng.random() < 0.9 else rng.choice(["ſ", "K", "É", "AB", "x" * 3000])
    for _ in range(150):
        host, path = f"{part()}.{part()}".lower(), "".join(rng.choice("/.-_") + part() for _ in range(rng.randint(0, 4)))
        want = sorted(r.name for r in rules if (re.match if r.host_rule else re.search)(r.pattern, host + path))
        assert sorted(r.name for r in index.matches(host, path)) == want
