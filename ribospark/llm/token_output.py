"""Token-id output: one wavelet matrix per shard, readable without unpacking it.

Documents are dealt by ranges of their id and sorted, each partition encodes its documents
and closes a shard once it holds ``shard_tokens`` ids. A shard is one compressed file image:

    magic, counts, then zstd sections: document ids, document lengths, zeros per level,
    and for each of the ids' bits (highest first) its bit-plane and the running counts of
    ones at every ``BLOCK`` bits.

The bit-planes form a wavelet matrix: ``access``, ``rank``, ``count`` and ``positions``
(occurrence lookup through select) work on them directly; ``tokens`` rebuilds all ids.
Shards are the rows of an uncompressed Parquet folder (partition, number in it, ids before
it in the partition, the image), so any store that Spark writes to can hold them; a rerun
of a lost task replaces its files whole.

Encoding: words are encoded by the tokenizers library one by one and remembered (bounded
memos), which gives the ids of the whole text for a tokenizer that drops white space before
it splits (tests compare both, over all of Unicode's first plane); ``by_word=False`` encodes
whole texts instead. Ranges are by id and hash of the text, so that a repeated (or null) id
is no single task.

Defined results: a null text is empty and has only the end id; rows that share a doc_id
follow one another in the order of a hash of their texts; null ids come first; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribospark.llm.common import WORD, local_table, map_batches, mix, powers
from ribospark.plans.runtime import ensure_checkpoint_dir

MAGIC = b"RSWM0001"
BLOCK = 512
NO_ID = -(2**63)  # stands for a null id inside a shard


class WaveletMatrix:
    """Bit-planes of a sequence of ids with rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if width <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(width - 1, -1, -1):
            bit = (now & now.dtype.type(1 << level)) != 0
            plane = np.packbits(bit, bitorder="little")
            planes.append(plane)
            ranks.append(cls._ones_before(plane))
            zeros.append(int(len(now) - np.count_nonzero(bit)))
            now = np.concatenate([now[~bit], now[bit]])
        return cls(len(ids), zeros, planes, ranks)

    @staticmethod
    def _ones_before(plane: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-max(len(plane), 1) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], ones.cumsum()]).astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        block, plane = i // BLOCK, self.planes[level]
        inside = plane[block * (BLOCK // 8) : i // 8]
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(inside).sum())
        return ones + (int(plane[i // 8] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) bit of this value."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i // 8]) >> (i % 8) & 1
            ones = self._rank1(level, i)
            value, i = value << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, end: int, start: int = 0) -> int:
        """How often ``token`` occurs in [start, end)."""
        a, b = self._range(token, start, end)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def positions(self, token: int) -> list[int]:
        """Where ``token`` occurs, ascending."""
        out = []
        for i in range(*self._range(token, 0, self.n)):
            for level in range(len(self.planes) - 1, -1, -1):
                bit = token >> (len(self.planes) - 1 - level) & 1
                i = self._select(level, bit, i - self.zeros[level] * bit)
            out.append(i)
        return out

    def tokens(self) -> np.ndarray:
        """All ids, by undoing the stable partitions from the last level to the first."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            one = now.dtype.type(1 << (len(self.planes) - 1 - level))
            back = np.empty_like(now)
            back[~bit] = now[: self.zeros[level]]
            back[bit] = now[self.zeros[level] :] | one
            now = back
        return now.astype(np.uint32)


def write_shard(doc_ids: list[int], lengths: np.ndarray | list[int], ids: np.ndarray) -> bytes:
    """The file image of a shard."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(ids)
    parts = [np.array(doc_ids, "<i8"), np.array(lengths, "<i8"), np.array(matrix.zeros, "<i8")]
    parts += [x for pair in zip(matrix.planes, matrix.ranks) for x in pair]
    sections = [press(p.tobytes()) for p in parts]
    head = struct.pack("<8sqqq", MAGIC, len(doc_ids), len(ids), len(matrix.planes))
    return head + struct.pack(f"<{len(sections)}q", *map(len, sections)) + b"".join(sections)


def read_shard(image: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, document lengths and the matrix of a shard's file image."""
    import zstandard

    unpress = zstandard.ZstdDecompressor().decompress
    magic, n_docs, n, width = struct.unpack_from("<8sqqq", image)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    sizes = struct.unpack_from(f"<{3 + 2 * width}q", image, 32)
    at, parts = 32 + 8 * len(sizes), []
    for size in sizes:
        parts.append(unpress(image[at : at + size]))
        at += size
    docs, lengths, zeros = (np.frombuffer(p, "<i8") for p in parts[:3])
    planes = [np.frombuffer(p, np.uint8) for p in parts[3::2]]
    ranks = [np.frombuffer(p, "<u4") for p in parts[4::2]]
    return docs, lengths, WaveletMatrix(n, zeros.tolist(), planes, ranks)


#: Texts of these characters are lower-cased and split alike by the classes below and by the tokenizers library.
_PLAIN = re.compile("[^\x09-\x0d\x20-\x7e\xa1\xab\xbb\xbf\xc0-\u012f\u0131-\u017f\u2010-\u2027\u20ac]")
# The layout of a tokenizer whose words can be taken apart beforehand, and its word pattern.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same pattern for plain texts in lower case.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|[0-9]|[^\\sa-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u017f]+")


_LETTER = re.compile("[a-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]")
_SPACE = re.compile(r"\s")


def _byte_letters() -> dict[int, str]:
    """The letter of every byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def takes_pieces(path: str) -> bool:
    """Whether the tokenizer file has the layout for which ``_PIECES`` holds."""
    with open(path, encoding="utf-8") as f:
        layout = json.load(f)
    split = ((layout.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (layout.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and split.get("pattern") == {"Regex": _PATTERN} and split.get("invert") is True and layout["model"]["type"] == "BPE"


class Pieces:
    """Ids of pieces by the 64-bit hash of their characters; emptied once it holds over ``limit`` of them."""

    def __init__(self, limit: int):
        self.limit = limit
        self._empty()

    def _empty(self) -> None:
        self.keys, self.start, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the distinct ``keys`` aren't held."""
        at = np.searchsorted(self.keys, keys)
        return np.ones(len(keys), bool) if len(self.keys) == 0 else self.keys[np.minimum(at, len(self.keys) - 1)] != keys

    def learn(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """Add new ascending ``keys``."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        start = len(self.flat) + sizes.cumsum() - sizes
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = (np.insert(old, at, new) for old, new in ((self.keys, keys), (self.start, start), (self.size, sizes)))

    def gather(self, keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``keys[times]`` one after another, and how many each has; ``keys`` are held and ascending."""
        at = np.searchsorted(self.keys, keys)[times]
        begin, sizes = self.start[at], self.size[at]
        total = sizes.cumsum()
        return self.flat[np.arange(int(total[-1]) if len(at) else 0) + np.repeat(begin - total + sizes, sizes)], sizes

    def trim(self) -> None:
        if len(self.keys) > self.limit:
            self._empty()


#: By character below ``_TOP``: class (0 white space, 1 letter, 2 digit, 3 other) and lower case.
_TOP = 0x20AD
_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(_TOP)], np.uint32)
_CLASS = np.array([0 if c.isspace() else 2 if c in "0123456789" else 1 if _LETTER.match(c) else 3 for c in map(chr, _LOWER)], np.uint8)
_CODE = np.random.default_rng(17).integers(1, 2**63, _TOP).astype(np.uint64)
_APOSTROPHE = ord("'")
#: Characters that are looked at together; a longer text is cut at white space.
SPAN = 1 << 19


def cut_units(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, whole) of the units of a plain text: pieces, or whole words around an apostrophe."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind, low = _CLASS[code], _LOWER[code]
    edge = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
    start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(code)]])
    on = kind[start] > 0
    start, end = start[on], end[on]
    whole = np.zeros(len(start), bool)
    mark = np.flatnonzero(code == _APOSTROPHE)
    if len(mark):
        space = np.concatenate([[-1], np.flatnonzero(kind == 0), [len(code)]])
        word = np.unique(np.searchsorted(space, mark))
        first, last = space[word - 1] + 1, space[word]
        at = np.minimum(np.searchsorted(last, start, side="right"), len(word) - 1)
        keep = (start < first[at]) | (start >= last[at])
        start, end = np.concatenate([start[keep], first]), np.concatenate([end[keep], last])
        order = start.argsort(kind="stable")
        start, end = start[order], end[order]
        whole = order >= keep.sum()
    size = 1 << max(16, (len(code)).bit_length())
    power, inverse = powers(size)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), (_CODE[low] * power[: len(low)]).cumsum()])
        key = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(2) + whole)
    return start, end, key, whole


class WordEncoder:
    """Ids of texts from the ids of their pieces, which are learned once.

    Plain texts are split into the tokenizer's own pieces with array operations; the ids of
    a new piece come from the library's model. Words around an apostrophe are split by the
    tokenizer's pattern. Other texts are encoded word by word by the library in full.
    """

    def __init__(self, path: str, by_word: bool = True, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.letters, self.pieces = _byte_letters(), Pieces(limit)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_piece = by_word and takes_pieces(path)
        if any(WORD.fullmatch(t) is None for t in self.special):
            self.by_word = self.by_piece = False  # such a token may span words

    def _model_ids(self, pieces: list[str]) -> list[list[int]]:
        tokenize = self.tokenizer.model.tokenize
        spelled = "\n".join(pieces).encode().decode("latin-1").translate(self.letters).split(self.letters[10])
        return [[t.id for t in tokenize(w)] for w in spelled]

    def _plain_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain texts one after another, and how many each has."""
        joined = "\n".join([*texts, ""])
        start, end, key, whole = cut_units(joined)
        self.pieces.trim()
        order = key.argsort()
        first = np.diff(key[order], prepend=~key[order[:1]]) != 0
        every = key[order[first]]
        number = np.empty(len(key), np.int64)
        number[order] = first.cumsum() - 1
        fresh = self.pieces.missing(every)
        distinct, at = every[fresh], order[first][fresh]
        for words in (False, True):
            own = whole[at] == words
            found = [joined[a:z].lower() for a, z in zip(start[at[own]].tolist(), end[at[own]].tolist())]
            if not found:
                continue
            if words:
                cuts = [_PIECES.findall(w) for w in found]
                flat = iter(self._model_ids([p for c in cuts for p in c]))
                self.pieces.learn(distinct[own], [[x for _ in c for x in next(flat)] for c in cuts])
            else:
                self.pieces.learn(distinct[own], self._model_ids(found))
        ids, sizes = self.pieces.gather(every, number)
        last = np.fromiter(map(len, texts), np.int64, len(texts)).cumsum() + np.arange(len(texts))
        ends = np.concatenate([[0], sizes.cumsum()])[np.searchsorted(start, last)]
        return ids, np.diff(ends, prepend=0)

    def _parts(self, texts: list[str]) -> Iterator[tuple[int, str, bool]]:
        """(text number, part, plain): texts, cut at white space where they are very long."""
        for i, text in enumerate(texts):
            plain = self.by_piece and not _PLAIN.search(text) and not any(x in text for x in self.special)
            at = 0
            while plain and len(text) - at > SPAN:
                stop = next((m.start() for m in _SPACE.finditer(text, at + SPAN)), len(text))
                yield i, text[at:stop], True
                at = stop
            yield i, text[at:], plain

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        ids: list[np.ndarray] = []
        count = np.zeros(len(texts), np.int64)
        held: list[tuple[int, str]] = []

        def plain() -> None:
            if held:
                found, sizes = self._plain_ids([t for _, t in held])
                ids.append(found)
                np.add.at(count, [i for i, _ in held], sizes)
                held.clear()

        chars = 0
        for i, part, on in self._parts(texts):
            if on:
                held.append((i, part))
                chars += len(part)
            if not on or chars > SPAN:
                plain()
                chars = 0
            if not on:
                words = WORD.findall(part) if self.by_word else [part]
                found = [x for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False) for x in e.ids]
                ids.append(np.array(found, np.uint32))
                count[i] += len(found)
        plain()
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), count


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, by_word: bool) -> WordEncoder:
    """One encoder for each Python worker: loaded once, its bounded memos serve all tasks of the worker."""
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = WordEncoder(path, by_word)
    return _ENCODERS[path, by_word]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 20, by_word: bool = True) -> None:
    """Encode ``docs`` and write their shards to ``folder``."""

    def rows(batches: Iterator[dict]):
        from pyspark import TaskContext

        part, state = TaskContext.get().partitionId(), {"seq": 0, "before": 0}
        ids: list[int] = []
        lengths: list[np.ndarray] = []
        pieces: list[np.ndarray] = []
        held = 0
        coder = encoder(tokenizer, by_word)

        def shard() -> dict:
            tokens, sizes = np.concatenate(pieces), np.concatenate(lengths)
            out = {"part": [part], "seq": [state["seq"]], "before": [state["before"]], "n_docs": [len(ids)], "n_tokens": [len(tokens)], "image": [write_shard(ids, sizes, tokens)]}
            state["seq"] += 1
            state["before"] += len(tokens)
            for x in (ids, lengths, pieces):
                x.clear()
            return out

        for b in batches:
            for at in range(0, len(b["_id"]), 256):
                texts = [t or "" for t in b["_text"][at : at + 256].to_pylist()]
                names = [NO_ID if i is None else i for i in b["_id"][at : at + 256].to_pylist()]
                tokens, sizes = coder.encode(texts)
                tokens, sizes = np.insert(tokens, sizes.cumsum(), np.uint32(end_id)), sizes + 1
                ends, done = np.concatenate([[0], sizes.cumsum()]), 0
                while done < len(names):
                    # a shard closes behind the document with which it is full
                    stop = min(int(np.searchsorted(ends, ends[done] + shard_tokens - held)), len(names))
                    ids += names[done:stop]
                    lengths.append(sizes[done:stop])
                    pieces.append(tokens[ends[done] : ends[stop]])
                    held += int(ends[stop] - ends[done])
                    done = stop
                    if held >= shard_tokens:
                        yield shard()
                        held = 0
        if ids:
            yield shard()

    taken = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_h", F.xxhash64("_text"))
    dealt = taken.repartitionByRange(F.col("_id"), F.col("_h")).sortWithinPartitions("_id", "_h", "_text")
    map_batches(dealt, rows, "part int, seq int, before long, n_docs long, n_tokens long, image binary").write.option("compression", "uncompressed").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """From the shards in ``folder``: doc_id, start, n_tokens, ids_crc32 and the shard of every document."""
    shards = spark.read.parquet(folder)
    sizes = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a number for each partition
    base, total = [], 0
    for part in sorted(sizes):
        base.append((part, total))
        total += sizes[part]
    starts = local_table(spark, base, "part int, base long")
    placed = shards.select("part", "seq", "before", "image").join(F.broadcast(starts), "part").select("part", "seq", (F.col("base") + F.col("before")).alias("first"), "image")

    def rows(batches: Iterator[dict]):
        for b in batches:
            for part, seq, first, image in zip(*(b[c] for c in ("part", "seq", "first", "image"))):
                docs, lengths, matrix = read_shard(image.as_py())
                data = matrix.tokens().astype("<u4").tobytes()
                ends = lengths.cumsum()
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield {"doc_id": [None if d == NO_ID else d for d in docs.tolist()], "start": first.as_py() + ends - lengths, "n_tokens": lengths, "ids_crc32": crcs, "part": [part.as_py()] * len(docs), "seq": [seq.as_py()] * len(docs)}

    return map_batches(placed, rows, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seq int")


def token_output(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, **options) -> DataFrame:
    """Write the shards (to the shared folder unless one is given), read them back and digest every document."""
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer, end_id, **options)
    return read_tokens(spark, folder)
