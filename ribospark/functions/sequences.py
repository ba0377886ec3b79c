"""Column functions over nucleotide and protein sequences; all but translation stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ribospark.functions.binding import bind
from ribospark.functions.constants import ALPHABET, AMBIGUOUS_BASES, CODON_ORDER, CODON_TABLES, COMPLEMENT_FROM, COMPLEMENT_TO

_IUPAC = "".join(AMBIGUOUS_BASES)


def _amino_acids(table: int) -> str:
    """Amino acids by codon number: three hexadecimal digits, each the place of a base in ``_IUPAC``; X for other letters.

    An ambiguous codon stands for the amino acids of all codons that its bases stand for.
    """
    if table not in CODON_TABLES:
        raise ValueError(f"no genetic code {table}; known: {', '.join(map(str, CODON_TABLES))}")
    code = CODON_TABLES[table]
    pairs = {frozenset("DN"): "B", frozenset("EQ"): "Z", frozenset("IL"): "J"}
    out = []
    for codon in product(range(16), repeat=3):
        if max(codon) >= len(_IUPAC):
            out.append("X")
            continue
        found = {code[16 * CODON_ORDER.index(a) + 4 * CODON_ORDER.index(b) + CODON_ORDER.index(c)] for a, b, c in product(*(AMBIGUOUS_BASES[_IUPAC[x]] for x in codon))}
        out.append(found.pop() if len(found) == 1 else pairs.get(frozenset(found), "X"))
    return "".join(out)


#: Bases that are translated at a time.
_SPAN = 1 << 20
_OTHER = 15


def _base_numbers(complemented: bool) -> np.ndarray:
    """By byte: the place of a base in ``_IUPAC`` (U is T, any case), ``_OTHER`` for what is none."""
    out = np.full(256, _OTHER, np.uint16)
    swap = str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO) if complemented else {}
    for byte in range(128):
        base = chr(byte).translate(swap).upper().replace("U", "T")
        if base in _IUPAC:
            out[byte] = _IUPAC.index(base)
    return out


def _reader(table: int, forward: int, backward: int) -> Callable[[pa.Array, pa.Array | None], pa.Array]:
    """A function from sequences (and which of them take table 2) to the strings of all their frames, frame after frame for each sequence."""
    tables = [np.frombuffer(_amino_acids(t).encode(), np.uint8) for t in (table, 2)]
    numbers = _base_numbers(False), _base_numbers(True)

    def amino_acids(data: np.ndarray, code: np.ndarray, strand: int) -> np.ndarray:
        """The amino acid of the codon that starts at every base, on the reverse strand towards the left."""
        n = numbers[strand][data]
        first, second, third = (n[:-2], n[1:-1], n[2:]) if strand == 0 else (n[2:], n[1:-1], n[:-2])
        return code[first << 8 | second << 4 | third]

    def codons(texts: list[bytes], code: np.ndarray) -> list[bytes]:
        """Frame 0 alone: each text's whole codons, one after the other."""
        n = numbers[0][np.frombuffer(b"".join([t[: len(t) // 3 * 3] for t in texts]), np.uint8)]
        made = code[n[::3] << 8 | n[1::3] << 4 | n[2::3]].tobytes()
        ends = np.cumsum([0, *(len(t) // 3 for t in texts)]).tolist()
        return [made[a:z] for a, z in zip(ends, ends[1:])]

    def read(seqs: pa.Array, other: pa.Array | None = None) -> pa.Array:
        texts = [b"" if s is None else s.encode("ascii", "replace") for s in seqs.to_pylist()]
        second = other.fill_null(False).to_pylist() if other is not None else [False] * len(texts)
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= _SPAN):
                size += len(texts[stop])
                stop += 1
            if (forward, backward) == (1, 0) and other is None:
                out += codons(texts[at:stop], tables[0])
                at = stop
                continue
            data = np.frombuffer(b"".join(texts[at:stop]) + b"   ", np.uint8)
            made: dict[tuple[int, int], np.ndarray] = {}
            start = 0
            for text, code in zip(texts[at:stop], second[at:stop]):
                end = start + len(text)
                for strand, frames in enumerate((forward, backward)):
                    if frames and (strand, code) not in made:
                        made[strand, code] = amino_acids(data, tables[code], strand)
                    for f in range(frames):
                        if end - start - f < 3:
                            out.append(b"")
                        elif strand == 0:
                            out.append(made[strand, code][start + f : end - 2 : 3].tobytes())
                        else:  # a codon of the reverse strand is kept at its last base's place
                            out.append(made[strand, code][start : end - 2 - f][::-3].tobytes())
                start = end
            at = stop
        ends = np.cumsum([0, *map(len, out)])
        strings = pa.LargeStringArray.from_buffers(len(out), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(out))).cast(pa.string())
        if seqs.null_count:
            gone = np.repeat(seqs.is_null().to_numpy(zero_copy_only=False), forward + backward)
            strings = pc.if_else(pa.array(~gone), strings, pa.scalar(None, pa.string()))
        return strings

    return read


def translate(seq: Column, table: int = 1, to_stop: bool = False, mitochondrial: Column | None = None) -> Column:
    """Frame-0 translation: a partial last codon is ignored, a stop is ``*``, ambiguous codons give B, J, Z or X.

    An Arrow function looks up the codon at every base of a batch at once. Rows where
    ``mitochondrial`` holds use table 2.
    """
    out = _translation(seq, table, mitochondrial, 1, 0)[0]
    return F.substring_index(out, "*", 1) if to_stop else out


def _translation(seq: Column, table: int, mitochondrial: Column | None, forward: int, backward: int) -> Column:
    read, frames = _reader(table, forward, backward), forward + backward

    def listed(strings: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(strings) + 1, frames, dtype=np.int32)), strings)

    @F.arrow_udf("array<string>")
    def one(seqs: pa.Array) -> pa.Array:
        return listed(read(seqs))

    @F.arrow_udf("array<string>")
    def either(seqs: pa.Array, other: pa.Array) -> pa.Array:
        return listed(read(seqs, other))

    return one(seq) if mitochondrial is None else either(seq, mitochondrial)


def translate_by(seq: Column, mitochondrial: Column, table: int = 1) -> Column:
    """Table 2 where ``mitochondrial`` holds."""
    return translate(seq, table, mitochondrial=mitochondrial)


def is_mitochondrial(chrom: Column) -> Column:
    return F.upper(chrom).isin("M", "MT")


def complement(seq: Column) -> Column:
    return F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def frame(seq: Column, offset: int) -> Column:
    """The sequence from a frame's first base on."""
    return F.substring(seq, offset + 1, 2**31 - 1)


def orfs(seq: Column, forward: int, backward: int = 0, table: int = 1, mitochondrial: Column | None = None) -> Column:
    """Translations of the first ``forward`` frames and of ``backward`` frames of the reverse complement."""
    if forward + backward == 0:
        return F.array().cast("array<string>")
    return _translation(seq, table, mitochondrial, forward, backward)


def isobaric(seq: Column) -> Column:
    return F.replace(seq, F.lit("I"), F.lit("L"))


def reverse_switch(seq: Column, sites: str = "KR") -> Column:
    """The reversed sequence with every cleavage residue changed places with its predecessor, from left to right."""
    return F.regexp_replace(F.reverse(seq), f"(^.|[^{sites}])([{sites}]+)", "$2$1")


def shuffled(seq: Column, seed: Column, keep_last: bool = True) -> Column:
    """The residues in the order of digests of (digest of seed and sequence, place); the last may stay."""
    size = F.length(seq)
    movable = F.substring(seq, F.lit(1), size - 1) if keep_last else seq
    last = F.substring(seq, size, F.lit(1)) if keep_last else F.lit("")
    own = F.struct(F.filter(F.split(movable, ""), lambda c: c != "").alias("chars"), F.md5(F.concat_ws("|", seed.cast("string"), seq)).alias("own"))

    def ordered(v: Column) -> Column:
        keyed = F.transform(v["chars"], lambda c, i: F.struct(F.md5(F.concat_ws("|", v["own"], i.cast("string"))).alias("k"), c.alias("c")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), "")

    return F.concat(bind(own, ordered), last)


def residue_count(seq: Column, residue: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(residue), F.lit("")))


def composition(seq: Column) -> Column:
    """Residue -> count over the alphabet of composition reports."""
    return F.create_map(*(x for aa in ALPHABET for x in (F.lit(aa), residue_count(seq, aa))))


def mismatch_positions(protein: Column, peptide: Column) -> Column:
    """``i|A>B`` for every place (from 1) where the peptide (B) differs from the protein's window (A)."""
    places = F.sequence(F.lit(1), F.length(peptide))
    differing = F.filter(places, lambda i: F.substring(protein, i, F.lit(1)) != F.substring(peptide, i, F.lit(1)))
    return F.transform(differing, lambda i: F.concat(i.cast("string"), F.lit("|"), F.substring(protein, i, F.lit(1)), F.lit(">"), F.substring(peptide, i, F.lit(1))))


def cleave(seq: Column, enzyme: str = "Trypsin", missed: int = 0, min_length: int = 1, max_length: int | None = None, rule: str | None = None) -> Column:
    """Distinct peptides of an enzyme with up to ``missed`` missed cleavages."""
    from ribospark.functions.constants import ENZYMES

    return F.array_distinct(_cleaved(seq, rule or ENZYMES[enzyme][0], missed, min_length, max_length))


def trypsin_pieces(seq: Column, missed: int = 0, min_length: int = 1, max_length: int | None = None) -> Column:
    """Peptides cut after K or R but not before P, repeats kept, missed cleavages behind the others."""
    return _cleaved(seq, "(?<=[KR])(?!P)", missed, min_length, max_length)


def placed_pieces(seq: Column, min_length: int, max_length: int) -> Column:
    """Structs (peptide, at) of ``trypsin_pieces`` without missed cleavages, each with its first place in the sequence (from 1).

    A piece's residues hold no cut, so an earlier place of it can only be the end of an earlier
    piece or end before a P inside one: all such ends of the asked lengths are noted once, which
    takes time in proportion to the sequence. Only the last piece, which need not end in K or R,
    is searched for.
    """
    cut, inner = re.compile("(?<=[KR])(?!P)"), re.compile("[KR](?=P)")

    def places(seq: str) -> list[dict]:
        first: dict[str, int] = {}
        found, start = [], 0
        for piece in cut.split(seq):
            stop = start + len(piece)
            ends = [start + m.end() for m in inner.finditer(piece)] if len(piece) > min_length else []
            for end in (*ends, stop):
                for at in range(end - min_length, max(start, end - max_length) - 1, -1):
                    first.setdefault(seq[at:end], at)
            if min_length <= len(piece) <= max_length:
                found.append((piece, first[piece] if stop < len(seq) else seq.find(piece)))
            start = stop
        return [{"peptide": p, "at": at + 1} for p, at in found]

    @F.arrow_udf("array<struct<peptide: string, at: int>>")
    def run(seqs: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("peptide", pa.string()), ("at", pa.int32())]))
        return pa.array([None if s is None else places(s) for s in seqs.to_pylist()], kind)

    return run(seq)


def _cleaved(seq: Column, rule: str, missed: int, min_length: int, max_length: int | None) -> Column:
    pieces = F.filter(F.split(seq, rule), lambda p: p != "")
    fits = (lambda p: (F.length(p) >= min_length) & (F.length(p) <= max_length)) if max_length else (lambda p: F.length(p) >= min_length)
    if not missed:
        return F.filter(pieces, fits)

    def joined(p: Column) -> Column:
        def neighbours(k: int) -> Column:
            starts = F.when(F.size(p) > k, F.sequence(F.lit(1), F.greatest(F.size(p) - k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(p, i, F.lit(k + 1)), ""))

        return F.concat(p, *(neighbours(k) for k in range(1, missed + 1)))

    return F.filter(bind(pieces, joined), fits)
