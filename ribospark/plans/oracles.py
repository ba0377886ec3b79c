"""The queries over the bridge views as DuckDB SQL, written apart from the operators."""

from __future__ import annotations

from ribospark.functions.constants import ALPHABET, CODON_TABLES, COMPLEMENT_FROM, COMPLEMENT_TO, ENZYMES, RESIDUE_MASS
from ribospark.plans import bridges as B


def _letters(to: str) -> str:
    return f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{B.LETTERS}', '{to}')"


DNA = f"(SELECT cast(doc_id AS varchar) AS id, {_letters(B.BASES)} AS seq, doc_id AS ord FROM documents)"
PROTEIN = f"(SELECT cast(doc_id AS varchar) AS id, {_letters(B.RESIDUES)} AS seq, doc_id AS ord FROM documents)"
STOPPED = f"(SELECT cast(doc_id AS varchar) AS id, doc_id || ' ' || source AS description, {_letters(B.STOPPED)} AS seq FROM documents)"
BLOCKS = """(SELECT transcript_id, chrom, strand, start, max("end") AS "end" FROM (
    SELECT cast(l_orderkey AS varchar) AS transcript_id, cast(l_orderkey % 24 AS varchar) AS chrom, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
           cast(l_orderkey % 1000 * 10000 + l_linenumber * 1000 AS bigint) AS start, cast(l_orderkey % 1000 * 10000 + l_linenumber * 1000 + 30 + l_partkey % 300 AS bigint) AS "end"
    FROM lineitem) GROUP BY ALL)"""


def _base(n: str) -> str:
    return f"substr('ACGT', cast(({n}) % 4 + 1 AS int), 1)"


def _pick(values: list[str], n: str) -> str:
    return f"([{', '.join(values)}])[cast(({n}) % {len(values)} + 1 AS int)]"


def _q(values) -> list[str]:
    return [f"'{v}'" for v in values]


_E = "event_id"
VARIANTS = f"""(SELECT cast(user_id % 24 AS varchar) AS chrom, cast(event_id * 7919 % 10000000 AS bigint) AS pos, cast(event_id AS varchar) AS id,
    {_base(_E)} || CASE WHEN event_id % 5 = 0 THEN {_base("event_id + 1")} ELSE '' END || CASE WHEN event_id % 97 = 0 THEN 'N' ELSE '' END AS ref,
    {_base("event_id + 2")} || CASE WHEN event_id % 7 = 0 THEN ',' || {_base("event_id + 3")} || {_base(_E)} ELSE '' END || CASE WHEN event_id % 11 = 0 THEN ',<DEL>' ELSE '' END AS alt,
    {_pick(_q(("PASS", ".", "AC0;RF", "PASS,RF", "q10")), _E)} AS filter, event_type, user_id,
    CASE WHEN event_id % 13 = 0 THEN '0.1,0.2' ELSE cast(event_id % 100 / 100.0::double AS varchar) END AS af, event_id AS ord FROM events)"""
ALLELES = f"""(SELECT * EXCLUDE (a), a AS allele FROM (SELECT *, unnest(string_split(alt, ',')) AS a FROM {VARIANTS}) WHERE regexp_full_match(ref, '[ACGT]*') AND regexp_full_match(a, '[ACGT]*'))"""
CLINICAL = f"(SELECT event_id, {_pick(_q(B.CLNSIG), _E)} AS clnsig, {_pick(_q(B.MC), 'event_id // 7')} AS mc, {_pick(_q(B.GENEINFO), 'event_id // 3')} AS geneinfo FROM events)"


def tr(seq: str, table: int = 1) -> str:
    place = " + ".join(f"{w} * (strpos('TCAG', substr(c, {k}, 1)) - 1)" for k, w in ((1, 16), (2, 4), (3, 1)))
    return f"array_to_string(list_transform(regexp_extract_all({seq}, '...'), lambda c: substr('{CODON_TABLES[table]}', ({place} + 1)::int, 1)), '')"


def rc(seq: str) -> str:
    return f"reverse(translate({seq}, '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}'))"


def pieces(seq: str, sites: str = "KRX") -> str:
    """Peptides cut after the sites but not before P."""
    return f"list_filter(string_split(replace(regexp_replace({seq}, '([{sites}])', '\\1|', 'g'), '|P', 'P'), '|'), lambda x: x <> '')"


def _marked(rule: str, seq: str) -> str:
    """The sequence with ``|`` at an enzyme's cuts."""
    sites = rule[rule.index("[") + 1 : rule.index("]")] if "[" in rule else rule[rule.index("=") + 1 : -1]
    if rule.startswith("(("):
        return f"regexp_replace({seq}, '([{sites}])', '|\\1|', 'g')"
    if rule.startswith("(?="):
        return f"regexp_replace({seq}, '([{sites}])', '|\\1', 'g')"
    if "][" in rule:
        return f"replace(regexp_replace({seq}, '([{sites}][PX])', '\\1|', 'g'), '|P', 'P')"
    if rule.startswith("(?<=W"):
        sites = "W"
    if rule.startswith("(?<=[A-Z"):
        return f"regexp_replace({seq}, '([A-Z])', '\\1|', 'g')"
    cut = f"regexp_replace({seq}, '([{sites}])', '\\1|', 'g')"
    return f"replace({cut}, '|P', 'P')" if rule.endswith("(?!P)") else cut


def revswitch(seq: str) -> str:
    return f"regexp_replace(reverse({seq}), '(^.|[^KR])([KR]+)', '\\2\\1', 'g')"


def _shuffle(chars: str, own: str) -> str:
    """The characters of a text in the order of the digests of ``own`` and their places."""
    return f"coalesce(array_to_string(list_transform(list_sort(list_transform(range(0, length({chars})), lambda i: {{'k': md5({own} || '|' || i), 'c': substr({chars}, i + 1, 1)}})), lambda x: x.c), ''), '')"


def _switched_decoys() -> str:
    """Decoys whose peptides are no target peptides, with 100 orders for each collision."""
    return f"""
        WITH targets AS (SELECT id, replace(seq, 'I', 'L') AS seq FROM {PROTEIN}),
        cut AS (SELECT id, {pieces(revswitch("seq"))} AS x FROM targets),
        placed AS (SELECT id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS p FROM cut),
        known AS (SELECT DISTINCT p FROM (SELECT unnest({pieces("seq")}) AS p FROM targets) WHERE length(p) >= 5),
        hit AS (SELECT DISTINCT p FROM placed SEMI JOIN known USING (p) WHERE length(p) >= 5),
        orders AS (SELECT p, i, left(p, length(p) - 1) AS body, md5((1 + i) || '|' || p) AS own FROM hit, range(1, 101) AS r(i)),
        tried AS (SELECT p AS old, i, {_shuffle("body", "own")} || right(p, 1) AS p FROM orders),
        best AS (SELECT old AS p, arg_min(p, i) AS other FROM tried ANTI JOIN known USING (p) GROUP BY old),
        made AS (SELECT id, string_agg(CASE WHEN hit.p IS NULL THEN placed.p ELSE coalesce(other, '') END, '' ORDER BY k) AS seq
                 FROM placed LEFT JOIN hit ON placed.p = hit.p LEFT JOIN best ON placed.p = best.p GROUP BY id)
        SELECT id, seq, false AS is_decoy FROM targets UNION ALL SELECT 'DECOY_' || id, seq, true FROM made WHERE seq <> ''"""


def _scan_psms() -> str:
    """Digested peptides with the scan that their digest names."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(sequence, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"
    return f"SELECT sequence, length(sequence) AS n, length(sequence) - 3 AS p, ({crc} % ((SELECT max(scan) FROM peaks) + 1))::int AS scan FROM {DIGESTED}"


def _charged() -> str:
    """Ions of charge 1 and 2 whose nearest peak, the first of equals, is less than 1.5 away."""
    return f"""
        WITH peaks AS MATERIALIZED {PEAKS}, psms AS ({_scan_psms()}), places AS (SELECT *, unnest(range(1, n + 1)) AS k FROM psms),
        single AS (SELECT sequence, scan, 'b' || k AS ion, {_mass("substr(sequence, 1, k::int)")} + 1.007276 AS m FROM places
                   UNION ALL SELECT sequence, scan, 'y' || k, {_mass("right(sequence, k::int)")} + 1.007276 + 18.010565 FROM places),
        ions AS (SELECT *, unnest([1, 2]) AS z, unnest([m, (m + 1.007276) / 2]) AS mz FROM single)
        SELECT sequence, ion, z, round(ions.mz, 3) AS mz, arg_min(intensity, {{'e': abs(peaks.mz - ions.mz), 'i': i}}) AS intensity
        FROM ions JOIN peaks ON ions.scan = peaks.scan AND abs(peaks.mz - ions.mz) < 1.5 GROUP BY sequence, ion, z, ions.mz"""


def _ion_support() -> str:
    """Matched fragments of all digested peptides against their spectra, and the support of the residue three before the end."""
    return f"""
        WITH peaks AS MATERIALIZED {PEAKS},
        spectra AS (SELECT scan, sum(intensity) AS total, max(intensity) AS most, sum(intensity) / count(*) AS mean, median(intensity) AS mid FROM peaks GROUP BY scan),
        psms AS ({_scan_psms()}),
        places AS (SELECT *, unnest(range(1, n + 1)) AS i FROM psms),
        ions AS (SELECT *, 'b' AS kind, {_mass("substr(sequence, 1, i::int)")} + 1.007276 AS mz FROM places
                 UNION ALL SELECT *, 'y', {_mass("right(sequence, i::int)")} + 1.007276 + 18.010565 FROM places),
        matched AS (SELECT sequence, n, p, ions.i AS i, kind, kind || ions.i AS ion, ions.mz AS mz, arg_min(intensity, abs(peaks.mz - ions.mz)) AS x
                    FROM ions JOIN peaks ON ions.scan = peaks.scan GROUP BY ALL HAVING min(abs(peaks.mz - ions.mz)) < 7.0),
        marked AS (SELECT *, (kind = 'b' AND i >= p) OR (kind = 'y' AND i > n - p) AS s,
                          (kind = 'b' AND i = p - 1) OR (kind = 'y' AND i = n - p + 1) AS l, (kind = 'b' AND i = p) OR (kind = 'y' AND i = n - p) AS r FROM matched),
        summed AS (SELECT sequence, string_agg(ion, ',' ORDER BY mz, ion) AS ions, sum(x) AS all_x,
                          coalesce(string_agg(ion, ',' ORDER BY mz, ion) FILTER (s), '') AS s_ions, coalesce(sum(x) FILTER (s), 0) AS s_x, count(*) FILTER (s) AS s_n,
                          coalesce(string_agg(ion, ',' ORDER BY ion) FILTER (l OR r), '') AS f_ions, coalesce(sum(x) FILTER (l OR r), 0) AS f_x, count(*) FILTER (l) AS l_n, count(*) FILTER (r) AS r_n
                   FROM marked GROUP BY sequence),
        judged AS (SELECT *, s_n > 0 AND s_x >= mid AS s_ok, l_n > 0 AND r_n > 0 AND f_x >= mid AS f_ok FROM psms LEFT JOIN spectra USING (scan) LEFT JOIN summed USING (sequence))
        SELECT sequence, 'f' AS file, scan, cast(p AS varchar) AS position, n::int AS peptide_length, CASE WHEN ions IS NULL THEN 'skiped' ELSE 'checked' END AS status,
               CASE WHEN s_ok THEN 'YES' ELSE 'NO' END AS ions_support, coalesce(s_ions, '') AS support_ions, coalesce(s_x, 0) AS sum_supportions_intensity,
               CASE WHEN CASE WHEN substr(sequence, p, 1) = 'P' THEN s_ok ELSE f_ok END THEN 'YES' ELSE 'NO' END AS flanking_ions_support, coalesce(f_ions, '') AS flanking_ions, coalesce(f_x, 0) AS sum_flanking_ions_intensity,
               coalesce(ions, '') AS matched_ions, coalesce(all_x, 0) AS sum_matchedions_intensity, total AS sum_fragmentions_intensity, most AS maxintensity, mean AS average_intensity, mid AS median_intensity
        FROM judged"""


def _missed(seq: str, n: int) -> str:
    joined = " || ".join(f"list_transform(range(1, greatest(len(p) - {k} + 1, 1)), lambda i: array_to_string(p[i:i + {k}], ''))" for k in range(1, n + 1))
    return f"(SELECT id, list_distinct(list_filter(p || {joined}, lambda x: length(x) >= 6)) AS ps FROM (SELECT id, {pieces(seq)} AS p FROM {PROTEIN}))"


MET = f"""(SELECT v.*, b.transcript_id, b.strand, b.start AS f_start, b."end" AS f_end FROM {VARIANTS} v JOIN {BLOCKS} b
    ON v.chrom = b.chrom AND v.pos <= b."end" AND b.start <= v.pos + length(v.ref) - 1 WHERE regexp_full_match(v.ref, '[ACGT]*'))"""
#: The blocks of a transcript with the bases before them, in ascending order of end.
OFFSETS = f"""(SELECT *, coalesce(sum("end" - start + 1) OVER (PARTITION BY transcript_id ORDER BY "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
    sum("end" - start + 1) OVER (PARTITION BY transcript_id) AS total FROM {BLOCKS})"""
SPLICED = f"""(SELECT ord, id, chrom, pos, ref, a AS alt, transcript_id, cds, CASE WHEN minus THEN reverse(w) ELSE w END AS ref_seq,
    CASE WHEN k IS NULL THEN '' WHEN minus THEN reverse(changed) ELSE changed END AS alt_seq FROM (
    SELECT *, substr(w, 1, k::int) || CASE WHEN length(r) - c > 0 THEN substr(x, 1, greatest(length(x) - (length(r) - c), 0)::int) ELSE x END || substr(w, (k + c + 1)::int) AS changed FROM (
    SELECT *, greatest(least(pos + length(r) - 1, stop) - pos + 1, 0) AS c, substr(turned, (lo + 1)::int, greatest(hi - lo, 0)::int) AS w FROM (
    SELECT *, CASE WHEN minus AND cds THEN greatest(n - 600, 0) WHEN cds THEN 3 ELSE 0 END AS lo, CASE WHEN minus AND cds THEN n - 3 WHEN cds THEN 600 ELSE total END AS hi FROM (
    SELECT p.*, t.strand = '-' AS minus, t.total, t.k, t.stop, length(d.seq) AS n, d.ord % 3 = 0 AS cds, CASE WHEN t.strand = '-' THEN reverse(d.seq) ELSE d.seq END AS turned,
        CASE WHEN t.strand = '-' THEN translate(p.ref, 'ACGT', 'TGCA') ELSE p.ref END AS r, CASE WHEN t.strand = '-' THEN translate(p.a, 'ACGT', 'TGCA') ELSE p.a END AS x
    FROM (SELECT DISTINCT ord, id, chrom, pos, ref, a, transcript_id FROM (SELECT *, unnest(string_split(alt, ',')) AS a FROM {MET}) WHERE regexp_full_match(a, '[ACGT]*')) p
    JOIN (SELECT v.ord AS vord, o.transcript_id AS tx, any_value(o.strand) AS strand, any_value(o.total) AS total,
                 min(CASE WHEN v.pos BETWEEN o.start AND o."end" THEN o.off + v.pos - o.start END) AS k, min(CASE WHEN v.pos BETWEEN o.start AND o."end" THEN o."end" END) AS stop
          FROM (SELECT DISTINCT ord, pos, transcript_id FROM {MET}) v JOIN {OFFSETS} o ON v.transcript_id = o.transcript_id GROUP BY ALL) t
      ON p.ord = t.vord AND p.transcript_id = t.tx
    JOIN {DNA} d ON d.id = p.transcript_id)))))"""
_MITO = "upper(chrom) IN ('M', 'MT')"
ALT_ORFS = f"""(SELECT 'var_' || id || '_' || chrom || '.' || pos || '.' || ref || '.' || alt || '_' || transcript_id || CASE WHEN cds THEN '' ELSE '_' || (f + 1) END AS accession, f::int AS frame, alt_orfs[f + 1] AS seq, ref_orfs FROM (
    SELECT *, unnest(range(0, len(alt_orfs))) AS f FROM (
    SELECT *, CASE WHEN cds THEN [{tr("alt_seq")}] ELSE [{", ".join(tr(f"substr(alt_seq, {k})") for k in (1, 2, 3))}] END AS alt_orfs,
              CASE WHEN cds THEN [{tr("ref_seq")}] ELSE [{", ".join(tr(f"substr(ref_seq, {k})") for k in (1, 2, 3))}] END AS ref_orfs
    FROM {SPLICED} WHERE alt_seq <> '')) WHERE NOT list_contains(ref_orfs, alt_orfs[f + 1]))"""


def mutations_sql() -> str:
    n, m = "cast(o_orderkey % 90 + 1 AS varchar)", "cast(o_orderkey % 90 + 3 AS varchar)"
    forms = [f"'c.' || {n} || {_base('o_orderkey')} || '>' || {_base('o_orderkey + 1')}", f"'c.' || {n} || '_' || {m} || 'delinsGAT'", f"'c.' || {n} || '_' || {m} || 'insACG'", f"'c.' || {n} || '_' || {m} || 'del'", f"'c.' || {n} || 'del'", "'c.?'", "'c.?'"]
    aa = [f"'p.V' || {n} || 'E'", f"'p.Val' || {n} || 'Glu'", f"'p.K' || {n} || '*'", f"'p.A' || {n} || '_G' || {m} || 'insKR'", f"'p.A' || {n} || '_G' || {m} || 'del'", f"'p.A' || {n} || '_G' || {m} || '>WW'"]
    kinds = _q(["Substitution - Missense", "Substitution - Missense", "Substitution - Nonsense", "Insertion - In frame", "Deletion - In frame", "Complex - deletion inframe"])
    k = "o_orderkey // 7"
    return f"""(SELECT cast(o_custkey AS varchar) AS gene, {_pick(forms, "o_orderkey")} AS dna_mut, {_pick(aa, k)} AS aa_mut, {_pick(kinds, k)} AS mutation_type, o_orderpriority AS "group", o_orderkey AS ord,
        o_orderkey % 90 + 1 AS n, o_orderkey % 7 AS form, {k} % 6 AS kind, {_base("o_orderkey")} AS b0, {_base("o_orderkey + 1")} AS b1 FROM orders)"""


def _dna_edit(s: str) -> str:
    return f"""CASE form WHEN 0 THEN CASE WHEN n <= length({s}) AND substr({s}, n, 1) = b0 THEN substr({s}, 1, n - 1) || b1 || substr({s}, n + 1) END
        WHEN 1 THEN substr({s}, 1, n - 1) || 'GAT' || substr({s}, n + 3) WHEN 2 THEN substr({s}, 1, n) || 'ACG' || substr({s}, n + 1)
        WHEN 3 THEN substr({s}, 1, n - 1) || substr({s}, n + 3) WHEN 4 THEN substr({s}, 1, n - 1) || substr({s}, n + 1) END"""


def _aa_edit(p: str) -> str:
    return f"""CASE WHEN kind IN (0, 1) THEN substr({p}, 1, n - 1) || 'E' || substr({p}, n + 1) WHEN kind = 2 THEN substr({p}, 1, n - 1) WHEN kind = 3 THEN substr({p}, 1, n) || 'KR' || substr({p}, n + 1)
        WHEN kind = 4 THEN substr({p}, 1, n - 1) || substr({p}, n + 3) ELSE substr({p}, 1, n - 1) || 'WW' || substr({p}, n + 3) END"""


EDITED = f"(SELECT m.*, d.seq FROM {mutations_sql()} m JOIN {DNA} d ON m.gene = d.id)"
CENSUS = f"""(SELECT ord, 'COSMIC:' || gene || ':' || aa_mut || ':' || replace(mutation_type, ' ', '') AS header, seq, "group" FROM (
    SELECT * EXCLUDE (seq), CASE WHEN form < 5 THEN coalesce({tr(_dna_edit("seq"))}, '') ELSE {_aa_edit(tr("seq"))} END AS seq FROM {EDITED}) WHERE seq <> '')"""


def maf_sql() -> str:
    """The rows of the mutation table as they are written."""
    n, m = "cast(o_orderkey % 90 + 1 AS varchar)", "cast(o_orderkey % 90 + 2 AS varchar)"
    forms = [f"'T:c.' || {n} || {_base('o_orderkey')} || '>' || {_base('o_orderkey + 1')}", f"'T:c.' || {n} || 'del' || {_base('o_orderkey')}", f"'c.' || {n} || '_' || {m} || 'insGG'", f"'c.' || {n} || '_' || {m} || 'dupAC'"]
    classes = _q(["Missense_Mutation", "Frame_Shift_Del", "In_Frame_Ins", "Frame_Shift_Ins", "Silent"])
    return f"""SELECT 'G' || o_custkey AS gene, {_pick(forms, "o_orderkey")} AS hgvsc, cast(o_custkey AS varchar) AS transcript_id, {_pick(classes, "o_orderkey // 4")} AS varclass,
        {_pick(_q(["SNP", "DEL", "INS", "INS"]), "o_orderkey")} AS vartype, 'p.X' || {n} AS hgvsp, cast(o_custkey AS varchar) AS sample FROM orders"""


def _maf() -> str:
    n, m = "cast(o_orderkey % 90 + 1 AS varchar)", "cast(o_orderkey % 90 + 2 AS varchar)"
    classes = _q(["Missense_Mutation", "Frame_Shift_Del", "In_Frame_Ins", "Frame_Shift_Ins", "Silent"])
    return f"""(SELECT * FROM (SELECT o_orderkey AS ord, 'G' || o_custkey AS gene, cast(o_custkey AS varchar) AS tx, {_pick(classes, "o_orderkey // 4")} AS varclass, 'p.X' || {n} AS hgvsp, c_mktsegment AS "group",
        o_orderkey % 4 AS form, (o_orderkey % 90 + 1)::int AS n, {_base("o_orderkey")} AS b0, {_base("o_orderkey + 1")} AS b1, d.seq AS s
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN {DNA} d ON d.id = cast(o_custkey AS varchar)) WHERE varclass <> 'Silent')"""


MAF = f"""(SELECT ord, 'cbiomut:' || tx || ':' || gene || ':' || hgvsp || ':' || varclass AS header, {tr("e")} AS seq, "group" FROM (SELECT *, CASE form
    WHEN 0 THEN CASE WHEN n <= length(s) AND substr(s, n, 1) = b0 THEN substr(s, 1, n - 1) || b1 || substr(s, n + 1) END
    WHEN 1 THEN CASE WHEN substr(s, n, 1) = b0 THEN substr(s, 1, n - 1) || substr(s, n + 1) END
    WHEN 2 THEN substr(s, 1, n) || 'GG' || substr(s, n + 1) ELSE substr(s, 1, n + 1) || 'AC' || substr(s, n + 2) END AS e FROM {_maf()}))"""
DIGESTED = f"(SELECT DISTINCT p AS sequence FROM (SELECT unnest({pieces('seq')}) AS p FROM {PROTEIN}) WHERE length(p) BETWEEN 7 AND 40)"
SEARCHED = f"""(SELECT DISTINCT unnest([sequence, substr(sequence, 1, length(sequence) // 2 - 1) || translate(substr(sequence, length(sequence) // 2, 1), '{B.FROM}', '{B.TO}') || substr(sequence, length(sequence) // 2 + 1)]) AS sequence FROM {DIGESTED})"""
#: Peptides with their first seven residues and the rest, and the sequences' windows of seven residues with what stands before and behind them.
SEARCH = f"""asked AS MATERIALIZED (SELECT sequence, length(sequence)::int AS n, left(sequence, 7) AS head, substr(sequence, 8) AS rest FROM {SEARCHED}),
    windows AS MATERIALIZED (SELECT seq, i::int AS i, substr(seq, i, 7) AS k, substr(seq, i + 7, 33) AS behind, CASE WHEN i > 7 THEN substr(seq, i - 7, 7) END AS before
                             FROM (SELECT seq, unnest(range(1, length(seq) - 5)) AS i FROM (SELECT DISTINCT seq FROM {PROTEIN}))),
    canonical AS MATERIALIZED (SELECT DISTINCT sequence FROM asked JOIN windows ON k = head AND starts_with(behind, rest))"""
#: A change behind the first seven residues, in them with the next seven intact, or in them at a left-out place of a peptide of under fourteen.
MISMATCH = f"""places AS (SELECT sequence, seq, i, rest AS p, left(behind, n - 7) AS w, 7 AS shift FROM asked JOIN windows ON k = head AND length(behind) >= n - 7 AND n > 7 AND hamming(left(behind, n - 7), rest) = 1
        UNION ALL SELECT sequence, seq, i - 7, head, before, 0 FROM asked JOIN windows ON n >= 14 AND k = substr(sequence, 8, 7) AND starts_with(behind, substr(sequence, 15)) AND before IS NOT NULL AND hamming(before, head) = 1
        UNION ALL SELECT sequence, seq, i, head, k, 0 FROM (SELECT *, unnest(range(1, 8)) AS j FROM asked WHERE n < 14) a JOIN (SELECT *, unnest(range(1, 8)) AS h FROM windows) b
            ON h = j AND left(k, h - 1) || substr(k, h + 1) = left(head, j - 1) || substr(head, j + 1) AND k <> head AND starts_with(behind, rest)),
    changes AS (SELECT sequence, seq, arg_min({{'p': p, 'w': w, 'shift': shift}}, i) AS c FROM places GROUP BY ALL),
    named AS (SELECT sequence, seq, c, list_filter(range(1, length(c.p) + 1), lambda x: substr(c.p, x, 1) <> substr(c.w, x, 1))[1]::int AS spot FROM changes),
    mismatched AS (SELECT sequence, spot + c.shift AS position, substr(c.w, spot, 1) || '>' || substr(c.p, spot, 1) AS variant, array_to_string(list_sort(list_distinct(list(id))), ',') AS proteins
                   FROM named JOIN {PROTEIN} USING (seq) GROUP BY ALL)"""
POSITIONS = f"""(SELECT *, trans_end - ("end" - start) AS trans_start FROM (
    SELECT transcript_id, chrom, strand, start, "end", (row_number() OVER w)::int AS rank, (sum("end" - start + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::bigint AS trans_end
    FROM {BLOCKS} WINDOW w AS (PARTITION BY transcript_id ORDER BY CASE WHEN strand = '+' THEN start ELSE -start END, "end")))"""
PLACED = f"""(SELECT peptide, any_value(chrom) AS chrom, any_value(strand) AS strand, min(lo)::bigint AS start, max(hi)::bigint AS "end", list({{'lo': lo, 'hi': hi}} ORDER BY lo) AS parts FROM (
    SELECT *, CASE WHEN strand = '+' THEN start + greatest(n1 - trans_start, 0) ELSE "end" - (least(n2, trans_end) - trans_start) END AS lo,
              CASE WHEN strand = '+' THEN start + least(n2, trans_end) - trans_start ELSE "end" - greatest(n1 - trans_start, 0) END AS hi FROM (
    SELECT peptide, 3 * strpos(p.seq, peptide) - 2 AS n1, 3 * strpos(p.seq, peptide) - 3 + 3 * length(peptide) AS n2, b.* FROM (
        SELECT peptide, arg_min(id, o) AS id FROM (SELECT id, unnest(ps) AS peptide, ord * 100000 + unnest(range(0, len(ps))) AS o FROM (SELECT id, ord, list_filter({pieces("seq")}, lambda x: length(x) BETWEEN 7 AND 40) AS ps FROM {PROTEIN})) GROUP BY peptide) f
    JOIN {PROTEIN} p ON p.id = f.id JOIN {POSITIONS} b ON b.transcript_id = f.id) WHERE trans_start <= n2 AND n1 <= trans_end)
    GROUP BY peptide HAVING min(trans_start) <= any_value(n1) AND max(trans_end) >= any_value(n2) AND min(lo) > 0)"""


def _mass(p: str) -> str:
    return " + ".join(f"{m!r}::double * (length({p}) - length(replace({p}, '{aa}', '')))" for aa, m in RESIDUE_MASS.items())


PEAKS = "(SELECT vec_id::int AS scan, unnest(range(0, len(embedding))) AS i, 100.0::double + unnest(range(0, len(embedding))) * 13.5::double AS mz, abs(floor(unnest(embedding)::double * 1000000)) AS intensity FROM embeddings)"


def _qc(split: bool) -> str:
    body = f"""(SELECT id, description, starts_with('' || seq, 'M') AS starts_with_met, regexp_replace(seq, '\\*$', '') AS s,
        substr(description, strpos(description, ' ') + 1) || CASE WHEN strpos(regexp_replace(seq, '\\*$', ''), '-') > 0 THEN ' (Contains gaps)' ELSE '' END AS note FROM {STOPPED})"""
    whole = f"SELECT id, note AS description, s AS seq, starts_with_met FROM {body} WHERE strpos(s, '*') = 0"
    if split:
        rest = f"SELECT id || '_codon_' || k AS id, note AS description, ps[k] AS seq, starts_with_met FROM (SELECT *, string_split(s, '*') AS ps, unnest(range(1, len(string_split(s, '*')) + 1)) AS k FROM {body} WHERE strpos(s, '*') > 0)"
    else:
        rest = f"SELECT id, note || ' (Premature stop ' || length(h) || '/' || length(s) || ')' AS description, h AS seq, starts_with_met FROM (SELECT *, substr(s, 1, strpos(s, '*') - 1) AS h FROM {body} WHERE strpos(s, '*') > 0)"
    return f"SELECT * FROM ({whole} UNION ALL {rest}) WHERE length(seq) > 6"


def _composition() -> str:
    both = f"(SELECT id, seq FROM {PROTEIN} UNION ALL SELECT 'DECOY_' || id, {revswitch('seq')} FROM {PROTEIN})"
    sums = ", ".join(f"sum(CASE WHEN {on} THEN length(seq) - length(replace(seq, '{aa}', '')) ELSE 0 END)::bigint AS {name}_{aa}" for name, on in (("target", "NOT contains(id, 'DECOY')"), ("decoy", "contains(id, 'DECOY')")) for aa in ALPHABET)
    ps = f"(SELECT p, bool_or(d) AS in_decoy, bool_and(d) AS only_decoy FROM (SELECT contains(id, 'DECOY') AS d, unnest({pieces('seq')}) AS p FROM {both}) WHERE length(p) >= 6 GROUP BY p)"
    return f"SELECT * FROM (SELECT count(*) FILTER (NOT only_decoy) AS target_peptides, count(*) FILTER (in_decoy) AS decoy_peptides, count(*) FILTER (in_decoy AND NOT only_decoy) AS shared_peptides FROM {ps}), (SELECT {sums} FROM {both})"


def _unique() -> str:
    known = f"(SELECT DISTINCT replace(p, 'I', 'L') AS key FROM (SELECT unnest({pieces('seq', 'KR')}) AS p FROM {PROTEIN}) WHERE length(p) BETWEEN 7 AND 40)"
    mut = f"(SELECT id, ord, translate(seq, 'AE', 'VW') AS seq FROM {PROTEIN})"
    header = "'Mutation:G' || id || ':p.A' || (ord % 50 + 1) || 'V:' || CASE WHEN ord % 2 = 0 THEN 'Substitution-Missense:' || (ord % 50 + 1 - (strpos(seq, p) - 1)) ELSE 'Nonsense-' END"
    return f"SELECT p AS peptide, array_to_string(list_sort(list_distinct(list({header}))), ';') AS header FROM (SELECT *, unnest({pieces('seq', 'KR')}) AS p FROM {mut} WHERE length(seq) >= 7) WHERE length(p) BETWEEN 7 AND 40 AND replace(p, 'I', 'L') NOT IN (SELECT key FROM {known}) GROUP BY p"


def _clnsig() -> str:
    low = ", ".join(f"'{x.replace('_', ' ').lower()}'" for x in B.EXCLUDED)
    parts = "list_filter(list_transform(string_split_regex(clnsig, '[/,]'), lambda p: lower(replace(trim(p), '_', ' '))), lambda p: p <> '')"
    return f"SELECT event_id, clnsig FROM {CLINICAL} WHERE clnsig = '' OR (clnsig NOT IN ({', '.join(_q(B.EXCLUDED))}) AND (len({parts}) = 0 OR len(list_filter({parts}, lambda p: p NOT IN ({low}))) > 0))"


def _catalog() -> str:
    each = " UNION ALL ".join(f"SELECT '{name}' AS enzyme, list_filter(string_split({_marked(rule[0], 'seq')}, '|'), lambda x: x <> '') AS p FROM {PROTEIN}" for name, rule in ENZYMES.items())
    return f"SELECT enzyme, sum(len(p))::bigint AS peptides, max(coalesce(list_max(list_transform(p, lambda x: length(x))), 0))::int AS longest FROM ({each}) GROUP BY enzyme"


def oracle_sql() -> dict[str, str]:
    near = f"(SELECT scan, m.mz, min(abs(p.mz - m.mz)) AS err, arg_min(intensity, abs(p.mz - m.mz) * 1e6 + i) AS intensity FROM {PEAKS} p, (VALUES (101.0::double), (250.25::double), (1000.5::double)) AS m(mz) GROUP BY ALL)"
    collisions = f"SELECT DISTINCT p AS peptide FROM (SELECT unnest({pieces(revswitch('s'))}) AS p FROM (SELECT replace(seq, 'I', 'L') AS s FROM {PROTEIN})) WHERE length(p) >= 4 AND p IN (SELECT q FROM (SELECT unnest({pieces('s')}) AS q FROM (SELECT replace(seq, 'I', 'L') AS s FROM {PROTEIN})))"
    orf = f"""SELECT id, (k - 1)::int AS frame, CASE WHEN cds THEN {tr("substr(seq, 4, 87)")} ELSE [{", ".join(tr(f"substr(seq, {k})") for k in (1, 2, 3))}, {tr(rc("seq"))}][k] END AS seq FROM (
        SELECT *, unnest(CASE WHEN cds THEN [1] ELSE [1, 2, 3, 4] END) AS k FROM (SELECT d.id, d.seq, t.doc_id % 3 = 0 AS cds, lang, n_chars FROM {DNA} d JOIN documents t ON d.ord = t.doc_id)
        WHERE (cds OR lang = 'en') AND n_chars % 10 >= 5)"""
    return {
        "three_frame_translation": " UNION ALL ".join(f"SELECT id, {k} AS frame, {tr(f'substr(seq, {k})')} AS seq FROM {DNA}" for k in (1, 2, 3)),
        "six_frame_translation": " UNION ALL ".join([*(f"SELECT id, {k - 1} AS frame, {tr(f'substr(seq, {k})')} AS seq FROM {DNA}" for k in (1, 2, 3)), *(f"SELECT id, {k + 2} AS frame, {tr(f'substr({rc("seq")}, {k})')} AS seq FROM {DNA}" for k in (1, 2, 3))]),
        "cds_to_stop_translation": f"SELECT id, string_split({tr('seq')}, '*')[1] AS seq FROM {DNA}",
        "mito_translation": f"SELECT id, CASE WHEN ord % 2 = 0 THEN {tr('seq', 2)} ELSE {tr('seq')} END AS seq FROM {DNA}",
        "reverse_complement": f"SELECT id, {rc('seq')} AS seq FROM {DNA}",
        "dna_orf_selection": orf,
        "digest_trypsin": f"SELECT DISTINCT id, p AS peptide FROM (SELECT id, unnest({pieces('seq')}) AS p FROM {PROTEIN}) WHERE length(p) >= 6",
        "digest_missed_cleavages": f"SELECT id, unnest(ps) AS peptide FROM {_missed('seq', 2)}",
        "digest_enzyme_catalog": _catalog(),
        "canonical_peptidome": f"SELECT DISTINCT replace(p, 'I', 'L') AS key FROM (SELECT unnest({pieces('seq', 'KR')}) AS p FROM {PROTEIN}) WHERE length(p) BETWEEN 7 AND 40",
        "variant_unique_peptides": _unique(),
        "vcf_allele_filter": f"SELECT ord, ref, allele AS alt FROM {ALLELES}",
        "vcf_filter_status": f"SELECT ord, filter FROM {VARIANTS} WHERE filter IN ('PASS', '.', 'PASS,RF')",
        "vcf_af_threshold": f"SELECT ord, af FROM {VARIANTS} WHERE try_cast(af AS double) >= 0.25",
        "csq_explode_filter": f"SELECT ord, cast(user_id % 50 AS varchar) AS transcript_id, event_type AS consequence, 'protein_coding' AS biotype FROM {VARIANTS} WHERE event_type <> 'error'",
        "clnsig_filter": _clnsig(),
        "mc_filter": f"SELECT event_id, mc FROM {CLINICAL} WHERE mc = '' OR contains(mc, 'missense_variant') OR contains(mc, 'nonsense')",
        "geneinfo_parse": f"SELECT event_id, split_part(split_part(geneinfo, '|', 1), ':', 1) AS symbol, split_part(split_part(geneinfo, '|', 1), ':', 2) AS gene_id FROM {CLINICAL}",
        "interval_overlap_join": f"SELECT ord, transcript_id, f_start, f_end FROM {MET}",
        "transcripts_by_variant": f"SELECT ord, array_to_string(list_sort(list_distinct(list(transcript_id))), ',') AS transcripts FROM {MET} GROUP BY ord",
        "variant_allele_splice": f"SELECT ord, transcript_id, alt, ref_seq, alt_seq FROM {SPLICED}",
        "variant_to_protein": f"SELECT accession, frame, seq FROM {ALT_ORFS}",
        "translation_summary": f"SELECT count(*) AS orfs, count(DISTINCT accession) AS accessions, count(*) FILTER (contains(seq, '*')) AS with_stop, coalesce(sum(length(seq)), 0)::bigint AS residues FROM {ALT_ORFS}",
        "hgvs_dna": f"SELECT ord, coalesce({tr(_dna_edit('seq'))}, '') AS protein FROM {EDITED}",
        "hgvs_protein_level": f"SELECT ord, {_aa_edit('p')} AS protein FROM (SELECT *, {tr('seq')} AS p FROM {EDITED})",
        "census_to_protein": f'SELECT ord, header, seq, "group" FROM {CENSUS}',
        "census_accepted_groups": f"""SELECT ord, header, seq, "group" FROM {CENSUS} WHERE ord % 5 <> 0 AND "group" IN ('1-URGENT', '2-HIGH')""",
        "census_dedup_by_header": f"SELECT header, arg_min(seq, ord) AS seq FROM {CENSUS} GROUP BY header",
        "maf_to_protein": f"""SELECT ord, header, seq, "group" FROM {MAF} WHERE length(seq) > 6 AND "group" IN ('BUILDING', 'MACHINERY')""",
        "split_by_group": f"""SELECT "group", header, arg_max(seq, ord) AS seq FROM {MAF} WHERE length(seq) > 6 GROUP BY ALL""",
        "decoy_reverse": f"SELECT id, seq FROM {PROTEIN} UNION ALL SELECT 'DECOY_' || id, reverse(seq) FROM {PROTEIN}",
        "decoy_revswitch": f"SELECT id, {revswitch("replace(seq, 'I', 'L')")} AS seq FROM {PROTEIN}",
        "decoy_collision_peptides": collisions,
        "decoy_database": _switched_decoys(),
        "decoy_shuffle": f"SELECT id, seq FROM {PROTEIN} UNION ALL SELECT 'DECOY_' || id, {_shuffle('seq', 'own')} FROM (SELECT *, md5('1|' || seq) AS own FROM {PROTEIN})",
        "target_decoy_composition": _composition(),
        "stop_codon_qc_split": _qc(True),
        "stop_codon_qc_truncate": _qc(False),
        "stop_codon_summary": f"SELECT count(*) AS n, count(*) FILTER (NOT starts_with(seq, 'M')) AS no_met, count(*) FILTER (contains(b, '-')) AS gaps, count(*) FILTER (contains(b, '*')) AS stops, count(*) FILTER (length(b) <= 6) AS short FROM (SELECT seq, regexp_replace(seq, '\\*$', '') AS b FROM {STOPPED})",
        "residue_totals": " UNION ALL ".join(f"SELECT '{aa}' AS residue, sum(length(seq) - length(replace(seq, '{aa}', '')))::bigint AS n FROM {PROTEIN}" for aa in ALPHABET),
        "merged_database": f"SELECT seq, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids FROM (SELECT id, seq FROM {PROTEIN} UNION ALL SELECT 'B' || id, replace(seq, 'I', 'L') FROM {PROTEIN}) GROUP BY seq",
        "peptide_containment_all": f"WITH {SEARCH} SELECT sequence FROM canonical",
        "one_mismatch_all": f"WITH {SEARCH}, {MISMATCH} SELECT sequence, position, variant, proteins FROM mismatched",
        "psm_locate_all": f"""WITH {SEARCH}, {MISMATCH}
            SELECT 'mzspec:' || sequence AS usi, sequence, 'canonical' AS position, NULL::varchar AS variant, NULL::varchar AS proteins FROM canonical
            UNION ALL SELECT 'mzspec:' || sequence, sequence, coalesce(cast(position AS varchar), 'non-canonical'), variant, proteins FROM (FROM asked ANTI JOIN canonical USING (sequence)) LEFT JOIN mismatched USING (sequence)""",
        "cds_transcript_positions": f'SELECT transcript_id, start, "end", rank, trans_start, trans_end FROM {POSITIONS}',
        "peptide_to_genome": f'SELECT peptide, chrom, strand, start, "end", len(parts)::int AS n_blocks FROM {PLACED}',
        "gff3_rows": f"""SELECT peptide, 0 AS ord, 'chr' || replace(chrom, 'MT', 'M') AS seqid, 'MS' AS source, 'mRNA' AS type, start, "end", '.' AS score, strand, '.' AS phase, 'ID=' || peptide AS attributes FROM {PLACED}
            UNION ALL SELECT peptide, k::int, 'chr' || replace(chrom, 'MT', 'M'), 'MS', 'CDS', parts[k].lo::bigint, parts[k].hi::bigint, '.', strand, CASE WHEN k = 1 THEN '0' ELSE '.' END, 'Parent=' || peptide FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM {PLACED})""",
        "theoretical_ions_all": f"""SELECT sequence, 'b' || i AS ion, round({_mass("substr(sequence, 1, i::int)")} + 1.007276, 3) AS mz FROM (SELECT sequence, unnest(range(1, length(sequence) + 1)) AS i FROM {DIGESTED})
            UNION ALL SELECT sequence, 'y' || i, round({_mass("right(sequence, i::int)")} + 1.007276 + 18.010565, 3) FROM (SELECT sequence, unnest(range(1, length(sequence) + 1)) AS i FROM {DIGESTED})""",
        "ion_support_all": _ion_support(),
        "doubly_charged_matches": _charged(),
        "spectrum_summary": f"SELECT scan, sum(intensity) AS sum, max(intensity) AS max, round(sum(intensity) / count(*), 3) AS mean, median(intensity) AS median FROM {PEAKS} GROUP BY scan",
        "nearest_peak_match": f"SELECT scan, mz, round(err, 6) AS error, intensity, round_even(err / mz * 1000000, 2) AS ppm FROM {near}",
        "version_resolution": """SELECT o_orderkey AS ord, cast(o_custkey AS varchar) AS wanted, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey || '.2' ELSE cast(c_custkey AS varchar) END AS resolved_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
        "chromosome_names": f"SELECT ord, coalesce('chr' || n_nationkey, chrom) AS chrom FROM {VARIANTS} LEFT JOIN nation ON chrom = cast(n_nationkey AS varchar)",
    }
