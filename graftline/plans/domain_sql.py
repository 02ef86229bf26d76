"""SQL for the queries of ``domain``: reads, blocks and evidence from the numbers they are made of."""

from __future__ import annotations

from ..params import PairFlanks
from ..schemas import FULL_CONTEXT, HALF_CONTEXT, METHODS, REFERENCE
from .domain import DIGESTS, ELEMENT, READ, WORD

_LENGTH = 32 * DIGESTS


def _bases(text: str) -> str:
    return f"translate({text}, '0123456789abcdef', 'ACGTACGTACGTACGT')"


_REVCOMP = "translate(reverse({}), 'ACGT', 'TGCA')"

_LINES = f"""lines AS (
    SELECT *, ln + m1 + m2 + ins + rn AS len, day + m1 + del + m2 AS e, day + m1 + del AS b2, q % 7 = 1 AS lmis, q % 7 = 2 AS rmis,
           {_bases("repeat(md5(l_orderkey || '-' || l_partkey), 4)")}[1 : ln + m1 + m2 + ins + rn] AS seq
    FROM (SELECT *, CASE WHEN q % 5 = 0 THEN q % 13 + 1 ELSE 0 END AS ln, CASE WHEN q % 3 = 0 THEN q % 17 + 1 ELSE 0 END AS rn,
                 10 + q % 23 AS m1, CASE WHEN d % 4 > 0 THEN 12 + d ELSE 0 END AS m2,
                 CASE d % 4 WHEN 1 THEN x + 1 WHEN 3 THEN x + 30 ELSE 0 END AS ins, CASE WHEN d % 4 = 2 THEN x + 1 ELSE 0 END AS del
          FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, CAST(l_quantity AS INTEGER) AS q,
                       CAST(round(l_discount * 100) AS INTEGER) AS d, CAST(round(l_tax * 100) AS INTEGER) AS x,
                       CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS day FROM lineitem)))"""

#: Reads: s and e are the span, ll and rl the lenient clips, lsite and rsite their sites.
_READS = f"""{_LINES}, reads AS (
    SELECT *, mapq >= 20 AND NOT ((ln > 0 OR lmis) AND (rn > 0 OR rmis) AND len - ll - rl < 21) AS passes,
           CASE WHEN ln > 0 THEN s - 1 WHEN lmis THEN s END AS lsite, CASE WHEN rn > 0 THEN e WHEN rmis THEN e - 1 END AS rsite
    FROM (SELECT 's' || (l_linenumber % 2) AS sample, 'r' || l_orderkey AS read_name, 'c' || l_suppkey AS contig, day AS s, 10 + 3 * d AS mapq,
                 x = 0 AND l_returnflag = 'N' AS unmapped, CASE WHEN ln > 0 THEN ln WHEN lmis THEN 1 ELSE 0 END AS ll,
                 CASE WHEN rn > 0 THEN rn WHEN rmis THEN 1 ELSE 0 END AS rl, * FROM lines)),
    good AS (SELECT * FROM reads WHERE passes AND NOT unmapped)"""

_CLIPS = """clips AS (
    SELECT sample, contig, rsite AS pos, '5p' AS orient, read_name, CASE WHEN rn > 0 THEN rn WHEN m2 > 0 THEN m2 ELSE m1 END AS clip_len,
           right(seq, rl) AS word, list_transform(range(len - rl, len), lambda i: 20 + (i + q) % 20) AS quals FROM good WHERE rl > 0
    UNION ALL
    SELECT sample, contig, lsite, '3p', read_name, CASE WHEN ln > 0 THEN ln ELSE m1 END, reverse(left(seq, ll)),
           list_transform(range(ll - 1, -1, -1), lambda i: 20 + (i + q) % 20) FROM good WHERE ll > 0)"""


def _site_counts(least: int = 2, sample: str = "sample", length: int = 8) -> str:
    return f"""counted AS (
    SELECT *, coalesce(long_5p >= {length}, false) AND softclip_count_5p >= {least} AS keep_5p, coalesce(long_3p >= {length}, false) AND softclip_count_3p >= {least} AS keep_3p
    FROM (SELECT {sample} AS sample, contig, pos, count(DISTINCT read_name) FILTER (WHERE orient = '5p') AS softclip_count_5p,
                 count(DISTINCT read_name) FILTER (WHERE orient = '3p') AS softclip_count_3p,
                 max(clip_len) FILTER (WHERE orient = '5p') AS long_5p, max(clip_len) FILTER (WHERE orient = '3p') AS long_3p
          FROM clips GROUP BY ALL)),
    sites AS (SELECT sample, contig, pos, softclip_count_5p, softclip_count_3p, keep_5p, keep_3p FROM counted WHERE keep_5p OR keep_3p)"""


def _kind(p: str) -> str:
    """What a read shows of a position that it isn't clipped at."""
    return f"""CASE WHEN ins > 0 AND ins < 30 AND b2 = {p} THEN 'small_insertion_5p' WHEN ins > 0 AND ins < 30 AND b2 - 1 = {p} THEN 'small_insertion_3p'
        WHEN ins >= 30 AND b2 = {p} THEN 'large_insertion_5p' WHEN ins >= 30 AND b2 - 1 = {p} THEN 'large_insertion_3p'
        WHEN del > 0 AND {p} >= b2 - del AND {p} < b2 THEN 'deletion'
        WHEN ({p} >= s AND {p} < s + m1) OR (m2 > 0 AND {p} >= b2 AND {p} < b2 + m2) THEN 'runthrough' END"""


_EVIDENCE_COUNTS = ("runthrough", "small_insertion_5p", "small_insertion_3p", "large_insertion_5p", "large_insertion_3p", "deletion")


def _evidence(sites: str, sample: str, end: str, last: str) -> str:
    names = ", ".join(f"count(DISTINCT read_name) FILTER (WHERE kind = '{k}') AS {k[:-3] + '_count' + k[-3:] if k[-1] == 'p' else k + '_count'}" for k in _EVIDENCE_COUNTS)
    return f"""seen AS (
    SELECT t.sample, t.contig, t.pos, read_name, {_kind("t.pos")} AS kind, ({_kind("(t.pos - 1)")}) = 'deletion' AS up, ({_kind("(t.pos + 1)")}) = 'deletion' AS down
    FROM {sites} t JOIN good r ON r.contig = t.contig AND {sample} = t.sample AND greatest(t.pos - 1, 0) < r.e AND r.s < {end} AND greatest(t.pos - 1, 0) < {end}
    WHERE coalesce(lsite <> t.pos, true) AND coalesce(rsite <> t.pos, true)),
    evidence AS (
    SELECT sample, contig, pos, {names}, count(DISTINCT read_name) FILTER (WHERE up AND pos >= 1) AS upstream_deletion_count,
           count(DISTINCT read_name) FILTER (WHERE down AND {last}) AS downstream_deletion_count FROM seen GROUP BY sample, contig, pos)"""


_COUNTED = [f"{k[:-3]}_count{k[-3:]}" if k[-1] == "p" else f"{k}_count" for k in _EVIDENCE_COUNTS] + ["upstream_deletion_count", "downstream_deletion_count"]
_ZEROED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in _COUNTED)
_TOTAL = "softclip_count_5p + softclip_count_3p + " + " + ".join(f"coalesce({c}, 0)" for c in _COUNTED[:6])

def _near(name: str, sites: str, distance: int = 22) -> str:
    """Sites whose keep flags hold only where a site of the other orientation is near."""
    other = lambda o, low, high: f"EXISTS (SELECT 1 FROM {sites} t WHERE t.sample = s.sample AND t.contig = s.contig AND t.softclip_count_{o} > 0 AND t.pos BETWEEN s.pos {low} AND s.pos {high})"
    return f"""{name} AS (SELECT * FROM (SELECT * REPLACE (keep_5p AND {other("3p", f"- {distance}", "- 1")} AS keep_5p, keep_3p AND {other("5p", "+ 1", f"+ {distance}")} AS keep_3p) FROM {sites} s) WHERE keep_5p OR keep_3p)"""


_RATIOS = """ratios AS (SELECT * FROM (SELECT * REPLACE (
            keep_5p AND (softclip_count_5p + large_insertion_count_5p + large_insertion_count_3p) / CAST(total_count AS DOUBLE) >= 0.1 AND (small_insertion_count_5p + deletion_count) / CAST(total_count AS DOUBLE) <= 0.03 AS keep_5p,
            keep_3p AND (softclip_count_3p + large_insertion_count_5p + large_insertion_count_3p) / CAST(total_count AS DOUBLE) >= 0.1 AND (small_insertion_count_3p + deletion_count) / CAST(total_count AS DOUBLE) <= 0.03 AS keep_3p) FROM counts)
        WHERE (keep_5p OR keep_3p) AND upstream_deletion_count / CAST(total_count AS DOUBLE) <= 0.03 AND downstream_deletion_count / CAST(total_count AS DOUBLE) <= 0.03)"""


def _clusters(keys: str, least: int) -> str:
    """Consensus words of ``words`` (keys, word, quals): leaves, their clusters, and the walk along their beginnings."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    return f"""own AS (SELECT DISTINCT {keys}, word FROM words),
        leaves AS (SELECT * FROM own a WHERE NOT EXISTS (SELECT 1 FROM own b WHERE {on("b", "a")} AND length(b.word) > length(a.word) AND starts_with(b.word, a.word))),
        edges AS (SELECT {of("a")}, a.word AS u, b.word AS v FROM leaves a JOIN leaves b ON {on("a", "b")} AND a.word <> b.word
                  WHERE 1 - levenshtein(left(a.word, least(length(a.word), length(b.word))), left(b.word, least(length(a.word), length(b.word)))) / CAST(least(length(a.word), length(b.word)) AS DOUBLE) >= 0.75),
        reach({keys}, word, label) AS (
            SELECT {keys}, word, word FROM leaves
            UNION SELECT {of("e")}, e.v, r.label FROM reach r JOIN edges e ON {on("e", "r")} AND e.u = r.word WHERE r.label < e.v),
        member AS (SELECT {keys}, word, min(label) AS root FROM reach GROUP BY ALL),
        begins AS (SELECT DISTINCT {keys}, root, left(word, CAST(k AS INTEGER)) AS start FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM member)),
        spots AS (SELECT {of("w")}, root, k, w.word[CAST(k AS INTEGER)] AS c, quals[CAST(k AS INTEGER)] AS qu
               FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM words) w JOIN begins b ON {on("b", "w")} AND b.start = left(w.word, CAST(k AS INTEGER))),
        chars AS (SELECT {keys}, root, k, c, sum(qu) AS w, sum(count(*)) OVER (PARTITION BY {keys}, root, k) AS n FROM spots GROUP BY {keys}, root, k, c),
        calls AS (SELECT {keys}, root, k, CASE WHEN count(*) FILTER (WHERE w = m) > 1 THEN 'N' ELSE max(c) FILTER (WHERE w = m) END AS c
                  FROM (SELECT *, max(w) OVER (PARTITION BY {keys}, root, k) AS m FROM chars WHERE n >= {least}) GROUP BY ALL),
        texts AS (SELECT {keys}, root, string_agg(c, '' ORDER BY k) AS consensus FROM calls GROUP BY ALL),
        reads_of AS (SELECT {of("w")}, root, count(*) AS n_reads FROM words w JOIN begins b ON {on("b", "w")} AND b.start = w.word GROUP BY ALL)"""


_WORDS = f"""words AS (
    SELECT pos, orient, list_transform(range(6 + q % 20), lambda i: 10 + (i * 7 + q) % 30) AS quals, left(CASE WHEN d = 9 THEN left(t, 4) || 'T' || substr(t, 6, 40) ELSE t END, 6 + q % 20) AS word
    FROM (SELECT l_partkey AS pos, l_linestatus AS orient, q, d, {_bases("md5((x % 2) || '-' || l_partkey)")} AS t FROM lines))"""

_TARGETS = f"""targets AS (SELECT 'c' || l_returnflag AS contig, {_bases(f"repeat(md5(l_returnflag), {DIGESTS})")} AS target FROM lineitem GROUP BY l_returnflag)"""

#: Placements of flanks with their clips, as one struct x beside the keys.
_PLACED = f"""{_LINES}, placed AS (
    SELECT l_orderkey AS pair_id, 1 + l_linenumber % 2 AS mate, 'c' || l_returnflag AS contig, l_linestatus = 'F' AS reverse, day AS "start", e AS "end", q AS score,
           ln AS left_clip, rn AS right_clip, left(seq, ln) AS left_seq, right(seq, rn) AS right_seq, len AS read_length,
           l_orderkey || '_' || (1 + l_linenumber % 2) AS read_name, (m1 + m2 + ins - x % 3) / CAST(m1 + m2 + ins AS DOUBLE) AS identity
    FROM lines WHERE NOT (x = 0 AND l_returnflag = 'N')),
    kept AS (SELECT * FROM placed WHERE identity >= 0.95 AND NOT CASE WHEN reverse THEN right_clip > 1 AND "end" < {_LENGTH} ELSE left_clip > 1 AND "start" >= 1 END)"""
_HELD = f"""struct_pack(read_name := read_name, "start" := "start", "end" := "end", score := score, left_clip := left_clip, right_clip := right_clip, left_seq := left_seq, right_seq := right_seq, read_length := read_length, target_length := {_LENGTH})"""


def _aligned_pairs(shift: int, outer: bool) -> str:
    """Nearest pairs, the smallest windows, little internal clipping, the best scores, sizes."""
    both = "AND NOT (f.left_clip > 1 AND r.right_clip > 1)" if outer else ""
    return f"""{_PLACED}, based AS (
        SELECT pair_id, contig, reverse, CASE WHEN reverse THEN 3 - mate ELSE mate END AS lane, CASE WHEN reverse THEN "end" - {shift} ELSE "start" + {shift} END AS spot, score, {_HELD} AS x FROM kept),
        best AS (SELECT pair_id, contig, lane, reverse, spot, x FROM based
                 QUALIFY row_number() OVER (PARTITION BY pair_id, contig, lane, reverse, spot ORDER BY x.score DESC, x."start" DESC, x."end" DESC, x DESC) = 1),
        ahead AS (SELECT a.pair_id, a.contig, a.lane AS mate, a.x AS f, b.x AS r FROM based a JOIN best b ON b.pair_id = a.pair_id AND b.contig = a.contig AND b.lane = a.lane
                  AND NOT a.reverse AND b.reverse AND b.spot > a.spot QUALIFY b.spot = min(b.spot) OVER (PARTITION BY a.pair_id, a.contig, a.lane, a.spot)),
        behind AS (SELECT a.pair_id, a.contig, a.lane AS mate, b.x AS f, a.x AS r FROM based a JOIN best b ON b.pair_id = a.pair_id AND b.contig = a.contig AND b.lane = a.lane
                   AND a.reverse AND NOT b.reverse AND b.spot < a.spot QUALIFY b.spot = max(b.spot) OVER (PARTITION BY a.pair_id, a.contig, a.lane, a.spot)),
        near AS (SELECT * FROM ahead UNION SELECT * FROM behind),
        ranked AS (SELECT *, struct_pack(w := r."end" - f."start", a := f."start", b := r."end", f := f, r := r, mate := mate) AS p FROM near),
        small AS (SELECT DISTINCT pair_id, contig, least(min(p) OVER (PARTITION BY pair_id, contig, f.read_name, f."start"), min(p) OVER (PARTITION BY pair_id, contig, r.read_name, r."end")) AS p FROM ranked),
        opened AS (SELECT pair_id, contig, p.f AS f, p.r AS r, p.mate AS mate FROM small),
        whole AS (SELECT * FROM opened WHERE NOT (f.right_clip > 0 AND f."end" < r."end" AND f.right_clip / CAST(f.read_length AS DOUBLE) > 0.05)
                  AND NOT (r.left_clip > 0 AND r."start" > f."start" AND r.left_clip / CAST(r.read_length AS DOUBLE) > 0.05) {both}),
        top AS (SELECT * FROM whole QUALIFY f.score + r.score = max(f.score + r.score) OVER (PARTITION BY pair_id)),
        {_TARGETS},
        sized AS (SELECT *, f.left_seq || substr(target, f."start" + 1, greatest(0, r."end" - f."start")) || r.right_seq AS whole_seq FROM top JOIN targets USING (contig) WHERE r."end" - f."start" BETWEEN 30 AND 200000)"""


def _finished(seq: str, method: str, rows: str) -> str:
    turned = f"CASE WHEN mate = 2 THEN {_REVCOMP.format(seq)} ELSE {seq} END"
    return f"""SELECT CAST(pair_id AS INTEGER) AS pair_id, {method} AS method, contig || ':' || f."start" || '-' || r."end" AS loc, CAST(length({seq}) AS INTEGER) AS inferred_seq_length, md5({turned}) AS seq_md5 FROM {rows}"""


_METHOD = "CASE (q + d) % 6 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(METHODS)) + " END"
_CLUSTERSEQ = f"""{_LINES}, clusterseq AS (
    SELECT CAST(o_custkey AS VARCHAR) AS sample, l_orderkey AS pair_id, {_METHOD} AS method, 's' || p_size AS seqid, 'c' || substr(p_brand, 7, 10) AS cluster,
           'g' || p_type AS "group", {_bases("repeat(md5(CAST(p_size AS VARCHAR)), 3)")} AS inferred_seq
    FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
_ASSEMBLED = f"method IN ({', '.join(repr(m) for m in METHODS[:3])})"
_CONF = "CASE method " + " ".join(f"WHEN '{m}' THEN '{c}'" for m, c in zip(METHODS, ("IAwFC", "IAwHC", "IAwoC", "IDB", "IO", "IDB"), strict=True)) + " END"
_RANK = "CASE method " + " ".join(f"WHEN '{m}' THEN {c}" for m, c in zip(METHODS, (1, 2, 4, 5, 3, 5), strict=True)) + " END"

_GENOTYPES = f"""{_CLUSTERSEQ}, insertions AS (
    SELECT CAST(o_custkey AS VARCHAR) AS sample, o_orderkey AS pair_id, 'c' || c_nationkey AS contig, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS pos_5p
    FROM orders JOIN customer ON o_custkey = c_custkey),
    held AS (SELECT * FROM clusterseq WHERE cluster IN (SELECT cluster FROM clusterseq WHERE {_ASSEMBLED})),
    firsts AS (SELECT DISTINCT sample, pair_id, contig, pos_5p, seqid, cluster, "group", {_CONF} AS conf, {_RANK} AS rank FROM insertions JOIN held USING (sample, pair_id)),
    best AS (SELECT * FROM firsts QUALIFY rank = min(rank) OVER (PARTITION BY sample, pair_id)),
    one AS (SELECT sample, pair_id, contig, pos_5p, cluster, "group", conf, string_agg(DISTINCT seqid, ';' ORDER BY seqid) AS seqid FROM best GROUP BY ALL),
    many AS (SELECT o.*, n FROM one o JOIN (SELECT sample, pair_id, count(DISTINCT cluster) AS n FROM one GROUP BY ALL) USING (sample, pair_id)),
    support AS (SELECT contig, pos_5p, cluster, count(*) AS support FROM one GROUP BY ALL),
    tied AS (SELECT * FROM (SELECT m.*, support FROM many m JOIN support USING (contig, pos_5p, cluster) WHERE n > 1) QUALIFY support = max(support) OVER (PARTITION BY sample, pair_id)),
    top AS (SELECT t.*, k FROM tied t JOIN (SELECT sample, pair_id, count(DISTINCT cluster) AS k FROM tied GROUP BY ALL) USING (sample, pair_id)),
    mobile AS (SELECT cluster, count(DISTINCT (contig, pos_5p)) FILTER (WHERE conf IN ('IAwFC', 'IAwHC', 'IO', 'IAwoC')) > 2 AS strict, count(DISTINCT (contig, pos_5p)) > 2 AS lenient FROM one GROUP BY cluster),
    seen AS (SELECT t.*, strict, lenient, count(*) FILTER (WHERE strict) OVER w AS ns, count(*) FILTER (WHERE NOT lenient) OVER w AS nl
             FROM top t JOIN mobile USING (cluster) WHERE k > 1 WINDOW w AS (PARTITION BY sample, pair_id)),
    rest AS (SELECT sample, pair_id, contig, pos_5p, "group", unnest(string_split(seqid, ';')) AS seqid, cluster FROM seen WHERE ns <> 1 AND nl <> 1),
    typed AS (
    SELECT sample, pair_id, contig, pos_5p, seqid, cluster, "group", conf FROM many WHERE n = 1
    UNION ALL SELECT sample, pair_id, contig, pos_5p, seqid, cluster, "group", 'ArSC' FROM top WHERE k = 1
    UNION ALL SELECT sample, pair_id, contig, pos_5p, seqid, cluster, "group", 'ArMS' FROM seen WHERE ns = 1 AND strict
    UNION ALL SELECT sample, pair_id, contig, pos_5p, seqid, cluster, "group", 'ArML' FROM seen WHERE ns <> 1 AND nl = 1 AND NOT lenient
    UNION ALL SELECT sample, pair_id, contig, pos_5p, string_agg(DISTINCT seqid, ';' ORDER BY seqid), string_agg(DISTINCT cluster, ';' ORDER BY cluster), "group", 'A' FROM rest GROUP BY sample, pair_id, contig, pos_5p, "group")"""

_FAMILIES = f"""{_LINES}, family AS (
    SELECT pair_id, method, seq, md5(least(seq, {_REVCOMP.format("seq")})) AS key FROM (
        SELECT pair_id, method, CASE d WHEN 1 THEN substr(s, 1, 40 + x) || 'A' || substr(s, 42 + x, 100) WHEN 2 THEN substr(s, 1, 96 - x) WHEN 3 THEN {_REVCOMP.format("s")} ELSE s END AS seq
        FROM (SELECT l_orderkey AS pair_id, d, x, {_METHOD} AS method, {_bases("repeat(md5(CAST(p_size AS VARCHAR)), 3)")} AS s FROM lines JOIN part ON l_partkey = p_partkey)))"""


def _greedy(rows: str, least: int, identity: float, coverage: float) -> str:
    """``clustered`` (k, key, seq, rep): greedy clusters of the distinct sequences, numbered longest first."""
    return f"""numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY length(seq) DESC, key) AS k, key, seq FROM (SELECT key, min(seq) AS seq FROM family WHERE {rows} AND length(seq) BETWEEN {least} AND 200000 GROUP BY key)),
        pairs AS MATERIALIZED (SELECT a.k AS u, b.k AS v FROM numbered a JOIN numbered b ON a.k < b.k AND length(b.seq) >= {coverage} * length(a.seq)
                  WHERE least(levenshtein(b.seq, a.seq), levenshtein({_REVCOMP.format("b.seq")}, a.seq)) <= floor((1 - {identity}) * length(b.seq) + 1e-9) + length(a.seq) - length(b.seq)),
        before AS MATERIALIZED (SELECT n.k, coalesce(list(u ORDER BY u) FILTER (WHERE u IS NOT NULL), []) AS us FROM numbered n LEFT JOIN pairs ON v = n.k GROUP BY n.k),
        walk(k, rep, reps) AS (
            SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), [CAST(1 AS BIGINT)]
            UNION ALL
            SELECT k, rep, CASE WHEN rep = k THEN list_append(reps, k) ELSE reps END FROM (
                SELECT b.k, coalesce(list_min(list_filter(us, lambda u: list_contains(reps, u))), b.k) AS rep, reps FROM walk w JOIN before b ON b.k = w.k + 1)),
        clustered AS MATERIALIZED (SELECT n.k, key, seq, rep FROM numbered n JOIN walk USING (k))"""


#: Candidate pairs of clip sites with the reads that run through them.
_SPANNING = f"""{_READS}, {_CLIPS}, {_site_counts(1, "'s'")},
        pairs AS (SELECT a.contig, a.pos AS pos_5p, b.pos AS pos_3p, a.softclip_count_5p, b.softclip_count_3p FROM sites a JOIN sites b ON a.contig = b.contig AND a.keep_5p AND b.keep_3p AND b.pos >= a.pos - 21 AND b.pos < a.pos),
        through AS (SELECT p.contig, pos_5p, pos_3p, count(DISTINCT read_name) AS n FROM pairs p JOIN good r ON r.contig = p.contig AND r.s < pos_3p - 10 AND r.e > pos_5p + 11
                    WHERE NOT (ins >= 30 AND (b2 IN (pos_5p, pos_3p) OR b2 - 1 IN (pos_5p, pos_3p))) GROUP BY p.contig, pos_5p, pos_3p),
        spanning AS (SELECT contig, pos_5p, pos_3p, softclip_count_5p, softclip_count_3p, coalesce(n, 0) AS spanning_count FROM pairs LEFT JOIN through USING (contig, pos_5p, pos_3p))"""

#: Reads of the suppliers' elements, their words as a graph, and its contigs, followed from word to word.
_CONTIGS = f"""{_LINES},
        elements AS (SELECT s_suppkey AS site, {_bases(" || ".join(f"md5(s_suppkey || '-{j}')" for j in range(ELEMENT // 32)))} AS element FROM supplier),
        own AS (SELECT site, q, d, x, substr(element, 1 + (l_partkey * 7 + l_linenumber) % {ELEMENT - READ + 1}, {READ}) AS s FROM lines JOIN elements ON l_suppkey = site),
        pieces AS (SELECT site, q, d, x, CASE WHEN d = 1 THEN left(s, 9 + x) || translate(substr(s, 10 + x, 1), 'ACGT', 'CGTA') || substr(s, 11 + x) ELSE s END AS seq, unnest(range({READ - WORD})) AS i FROM own),
        weighed AS (SELECT site, substr(seq, i + 1, {WORD}) AS node, substr(seq, i + {WORD} + 1, 1) AS base,
                           least(CASE WHEN d = 1 AND i = 9 + x THEN 2 ELSE 20 + (i + q) % 20 END, CASE WHEN d = 1 AND i + {WORD} = 9 + x THEN 2 ELSE 20 + (i + {WORD} + q) % 20 END) AS w FROM pieces),
        summed AS (SELECT site, node, base, substr(node, 2) || base AS after, count(*) AS n, sum(w) AS w FROM weighed GROUP BY ALL HAVING count(*) >= 2),
        kept AS (SELECT * FROM summed QUALIFY 5 * w >= max(w) OVER (PARTITION BY site, node) AND 5 * w >= max(w) OVER (PARTITION BY site, after)),
        edges AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY site, node) AS n_out, count(*) OVER (PARTITION BY site, after) AS n_in FROM kept),
        simple AS MATERIALIZED (SELECT site, node, after, n FROM edges WHERE n_out = 1 AND n_in = 1 AND node <> after),
        nodes AS MATERIALIZED (SELECT site, node FROM edges UNION SELECT site, after FROM edges),
        heads AS MATERIALIZED (SELECT * FROM nodes ANTI JOIN (SELECT site, after AS node FROM simple) USING (site, node)),
        steps(site, head, node, spot, n) AS (
            SELECT site, node, node, 0, NULL::BIGINT FROM heads
            UNION ALL SELECT t.site, t.head, s.after, t.spot + 1, s.n FROM steps t JOIN simple s ON s.site = t.site AND s.node = t.node),
        rings(site, head, node, spot, n) AS (
            SELECT site, node, node, 0, NULL::BIGINT FROM (SELECT site, node FROM nodes ANTI JOIN (SELECT DISTINCT site, node FROM steps) USING (site, node))
            UNION ALL SELECT t.site, t.head, s.after, t.spot + 1, s.n FROM rings t JOIN simple s ON s.site = t.site AND s.node = t.node WHERE s.after <> t.head),
        places AS MATERIALIZED (
            SELECT *, false AS circular FROM steps
            UNION ALL SELECT *, true FROM rings WHERE (site, head) IN (SELECT (site, head) FROM rings GROUP BY site, head HAVING min(node) = head)),
        contigs AS MATERIALIZED (
            SELECT site, head, head || coalesce(string_agg(right(node, 1), '' ORDER BY spot) FILTER (WHERE spot > 0), '') AS seq, arg_max(node, spot) AS tail, coalesce(avg(n), 0) AS support, circular FROM places GROUP BY site, head, circular)"""

_ONE_QUAL = "list_sum(list_transform({}, lambda i: 20 + (i + q) % 20))"

ORACLE: dict[str, str] = {
    "clip_accessors": f"""WITH {_READS}
        SELECT sample, read_name, contig, s AS ref_start, e AS ref_end, ln > 0 AS left_strict, rn > 0 AS right_strict, ln > 0 OR lmis AS left_lenient, rn > 0 OR rmis AS right_lenient,
               ll AS left_length, rl AS right_length, CASE WHEN ln > 0 THEN ln ELSE m1 END AS left_operation, CASE WHEN rn > 0 THEN rn WHEN m2 > 0 THEN m2 ELSE m1 END AS right_operation,
               lsite AS left_site, rsite AS right_site, left(seq, ll) AS left_seq, CASE WHEN rl > 0 THEN right(seq, rl) ELSE '' END AS right_seq,
               CAST(coalesce({_ONE_QUAL.format("range(ll)")}, 0) AS INTEGER) AS left_quality, CAST(coalesce({_ONE_QUAL.format("range(len - rl, len)")}, 0) AS INTEGER) AS right_quality,
               round(CAST(ln AS DOUBLE) / len, 6) AS left_share, round(CAST(rn AS DOUBLE) / len, 6) AS right_share, len - ll - rl AS inner_length,
               round((m1 + m2 + ins - x % 3) / CAST(m1 + m2 + ins AS DOUBLE), 6) AS identity, passes FROM reads""",
    "cigar_blocks": f"""WITH {_READS}
        SELECT read_name, contig, s AS ref_start, s AS block_start, s + m1 AS block_end, 0 AS gap, 0 AS inserted FROM reads
        UNION ALL SELECT read_name, contig, s, b2, b2 + m2, del, ins FROM reads WHERE m2 > 0""",
    "clip_words": f"""WITH {_READS}, {_CLIPS}
        SELECT sample, contig, pos, orient, read_name, clip_len, word, CAST(list_sum(quals) AS INTEGER) AS quality, CAST(quals[1] AS INTEGER) AS first_quality FROM clips""",
    "clip_sites": f"""WITH {_READS}, {_CLIPS}, {_site_counts(1)}, near AS (
        SELECT sample, contig, pos, softclip_count_5p, softclip_count_3p,
               keep_5p AND EXISTS (SELECT 1 FROM sites t WHERE t.sample = s.sample AND t.contig = s.contig AND t.softclip_count_3p > 0 AND t.pos BETWEEN s.pos - 22 AND s.pos - 1) AS keep_5p,
               keep_3p AND EXISTS (SELECT 1 FROM sites t WHERE t.sample = s.sample AND t.contig = s.contig AND t.softclip_count_5p > 0 AND t.pos BETWEEN s.pos + 1 AND s.pos + 22) AS keep_3p
        FROM sites s) SELECT * FROM near WHERE keep_5p OR keep_3p""",
    "site_evidence_classes": f"""WITH {_READS}, {_CLIPS}, {_site_counts()}, {_evidence("sites", "r.sample", f"least(t.pos + 2, {_LENGTH})", f"pos < {_LENGTH} - 1")},
        counts AS (SELECT sample, contig, pos, softclip_count_5p, softclip_count_3p, keep_5p, keep_3p, {_ZEROED}, {_TOTAL} AS total_count FROM sites LEFT JOIN evidence USING (sample, contig, pos)),
        {_RATIOS} SELECT * FROM ratios""",
    "found_flanks": f"""WITH RECURSIVE {_READS}, {_CLIPS}, {_site_counts(1, length=3)}, {_near("near_1", "sites")}, {_evidence("near_1", "r.sample", f"least(t.pos + 2, {_LENGTH})", f"pos < {_LENGTH} - 1")},
        counts AS (SELECT sample, contig, pos, softclip_count_5p, softclip_count_3p, keep_5p, keep_3p, {_ZEROED}, {_TOTAL} AS total_count FROM near_1 LEFT JOIN evidence USING (sample, contig, pos)),
        {_RATIOS}, {_near("near_2", "ratios")},
        single AS (SELECT sample, contig, pos, orient, read_name, i, word[CAST(i AS INTEGER)] AS b, quals[CAST(i AS INTEGER)] AS qu FROM (
            SELECT c.*, unnest(range(1, length(word) + 1)) AS i FROM clips c JOIN near_2 n USING (sample, contig, pos) WHERE CASE WHEN orient = '5p' THEN keep_5p ELSE keep_3p END)),
        words AS (SELECT sample, contig, pos, orient, read_name, string_agg(b, '' ORDER BY i) AS word, list(qu ORDER BY i) AS quals
                  FROM (SELECT * FROM single QUALIFY row_number() OVER (PARTITION BY sample, contig, pos, orient, read_name, i ORDER BY qu DESC, b) = 1) GROUP BY sample, contig, pos, orient, read_name),
        {_clusters("sample, contig, pos, orient", 1)},
        top AS (SELECT sample, contig, pos, orient, consensus, n_reads FROM reads_of JOIN texts USING (sample, contig, pos, orient, root) WHERE length(consensus) >= 3
                QUALIFY row_number() OVER (PARTITION BY sample, contig, pos, orient ORDER BY n_reads DESC, length(consensus) DESC, consensus) = 1),
        flagged AS (SELECT * REPLACE (has_5p AS keep_5p, has_3p AS keep_3p) FROM near_2 JOIN (SELECT sample, contig, pos, bool_or(orient = '5p') AS has_5p, bool_or(orient = '3p') AS has_3p FROM top GROUP BY ALL) USING (sample, contig, pos)),
        {_near("near_3", "flagged")}
        SELECT * EXCLUDE (keep_5p, keep_3p, has_5p, has_3p, consensus, n_reads), n_reads AS consensus_softclip_count, CASE WHEN orient = '3p' THEN reverse(consensus) ELSE consensus END AS consensus_seq
        FROM near_3 JOIN top USING (sample, contig, pos) WHERE CASE WHEN orient = '5p' THEN keep_5p ELSE keep_3p END""",
    "recall_counts": f"""WITH {_READS}, {_CLIPS}, asked AS (SELECT DISTINCT 's' AS sample, 'c' || l_suppkey AS contig, unnest([day, day - 5]) AS pos FROM lines WHERE q = 50),
        wanted AS (SELECT DISTINCT 'c' || l_suppkey AS contig, day AS pos, '5p' AS orient FROM lines WHERE q = 50 UNION SELECT DISTINCT 'c' || l_suppkey, day - 5, '3p' FROM lines WHERE q = 50),
        counted AS (SELECT contig, pos, count(DISTINCT read_name) FILTER (WHERE orient = '5p') AS softclip_count_5p, count(DISTINCT read_name) FILTER (WHERE orient = '3p') AS softclip_count_3p FROM clips GROUP BY contig, pos),
        sites AS (SELECT sample, contig, pos, coalesce(softclip_count_5p, 0) AS softclip_count_5p, coalesce(softclip_count_3p, 0) AS softclip_count_3p FROM asked LEFT JOIN counted USING (contig, pos)),
        {_evidence("sites", "'s'", "t.pos + 2", "true")}
        SELECT contig, pos, orient, softclip_count_5p, softclip_count_3p, {_ZEROED}, {_TOTAL} AS total_count FROM wanted JOIN (SELECT * FROM sites LEFT JOIN evidence USING (sample, contig, pos)) USING (contig, pos)""",
    "merged_clip_words": f"""WITH {_READS}, {_CLIPS}, spots AS (SELECT contig, pos, orient, read_name, i, word[CAST(i AS INTEGER)] AS b, quals[CAST(i AS INTEGER)] AS qu FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM clips)),
        best AS (SELECT * FROM spots QUALIFY row_number() OVER (PARTITION BY contig, pos, orient, read_name, i ORDER BY qu DESC, b) = 1)
        SELECT contig, pos, orient, read_name, string_agg(b, '' ORDER BY i) AS word, CAST(sum(qu) AS INTEGER) AS quality FROM best GROUP BY contig, pos, orient, read_name""",
    "prefix_consensus": f"""WITH RECURSIVE {_LINES}, {_WORDS}, {_clusters("pos, orient", 2)}
        SELECT pos, orient, coalesce(consensus, '') AS consensus, n_reads FROM reads_of LEFT JOIN texts USING (pos, orient, root)""",
    "prefix_counts": f"""WITH {_LINES}, {_WORDS}, asked AS (SELECT DISTINCT left(word, CAST(k AS INTEGER)) AS prefix FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words WHERE pos = 1))
        SELECT pos, prefix, count(*) AS reads FROM words JOIN asked ON starts_with(word, prefix) GROUP BY pos, prefix""",
    "junction_spanning": f"""WITH {_SPANNING} SELECT * FROM spanning""",
    "junction_filter": f"""WITH {_SPANNING} SELECT * FROM spanning WHERE spanning_count < {PairFlanks().max_junction_spanning_prop} * (softclip_count_5p + softclip_count_3p) / 2.0""",
    "local_assembly": f"""WITH RECURSIVE {_CONTIGS} SELECT site, seq, CAST(length(seq) AS INTEGER) AS length, round(support, 6) AS support, circular FROM contigs WHERE length(seq) >= {2 * WORD}""",
    "flank_extension": f"""WITH RECURSIVE {_CONTIGS},
        flanks AS (SELECT site, substr(element, 1 + site % 200, 30) AS flank FROM elements),
        words AS (SELECT site, flank, i, substr(flank, CAST(i AS INTEGER), {WORD}) AS node FROM (SELECT *, unnest(range(1, length(flank) - {WORD - 2})) AS i FROM flanks)),
        anchors AS (SELECT site, flank, i, head, spot FROM words JOIN places USING (site, node) QUALIFY row_number() OVER (PARTITION BY site, flank ORDER BY i DESC) = 1),
        walk(site, flank, text, tail, been) AS (
            SELECT a.site, flank, left(flank, i + {WORD - 1}) || substr(seq, spot + {WORD + 1}), tail, [a.head] FROM anchors a JOIN contigs c ON c.site = a.site AND c.head = a.head
            UNION ALL
            SELECT w.site, flank, text || substr(seq, {WORD}), c.tail, list_append(been, c.head)
            FROM walk w JOIN edges e ON e.site = w.site AND e.node = w.tail AND e.n_out = 1 JOIN contigs c ON c.site = w.site AND c.head = e.after WHERE NOT list_contains(been, c.head)),
        longest AS (SELECT site, flank, arg_max(text, len(been)) AS text FROM walk GROUP BY site, flank)
        SELECT site, flank, CASE WHEN length(text) > length(flank) THEN text ELSE flank END AS extended FROM flanks LEFT JOIN longest USING (site, flank)""",
    "flank_places": f"""WITH genome AS (SELECT s_suppkey AS k, {_bases(f"repeat(md5(CAST(s_suppkey AS VARCHAR)), {DIGESTS})")} AS g FROM supplier),
        flanks AS (SELECT k, CASE WHEN k % 2 = 1 THEN {_REVCOMP.format("f")} ELSE f END AS f FROM (SELECT k, substr(g, CAST(1 + k * 13 % 2000 AS BIGINT), 45) AS f FROM genome)),
        strands AS (SELECT k, f AS s, false AS reverse FROM flanks UNION ALL SELECT k, {_REVCOMP.format("f")}, true FROM flanks),
        places AS (SELECT k, g, unnest(range({_LENGTH - 44})) AS p FROM genome)
        SELECT 'f' || s.k AS read_name, 'c' || t.k AS contig, CAST(p AS INTEGER) AS ref_start, CAST(p + 45 AS INTEGER) AS ref_end, reverse AS is_reverse, 90 AS as_score
        FROM places t JOIN strands s ON s.s = substr(g, CAST(p + 1 AS BIGINT), 45)""",
    "region_consensus": f"""WITH {_READS}, regions AS (SELECT DISTINCT l_orderkey AS pair_id, 'c' || l_suppkey AS contig, day - 5 AS a, day + 5 AS b FROM lines WHERE q = 7),
        genome AS (SELECT 'c' || s_suppkey AS contig, {_bases(f"repeat(md5(CAST(s_suppkey AS VARCHAR)), {DIGESTS})")} AS g FROM supplier),
        seeds AS (SELECT pair_id, contig, a, b, unnest(range(greatest(a, 0), least(b, {_LENGTH}))) AS p, g FROM regions JOIN genome USING (contig)),
        bases AS (
            SELECT pair_id, contig, a, b, p, g[CAST(p + 1 AS INTEGER)] AS base, 1 AS w, 1 AS ref FROM seeds
            UNION ALL
            SELECT pair_id, contig, a, b, p, seq[CAST(spot + 1 AS INTEGER)], 20 + (spot + q) % 20, 0 FROM (
                SELECT t.pair_id, t.contig, t.a, t.b, t.p, seq, q, CASE WHEN p >= s AND p < s + m1 THEN ln + p - s WHEN m2 > 0 AND p >= b2 AND p < b2 + m2 THEN ln + m1 + ins + p - b2 END AS spot
                FROM seeds t JOIN reads r ON r.contig = t.contig AND NOT unmapped AND p >= s AND p < e) WHERE spot IS NOT NULL),
        sums AS (SELECT pair_id, contig, a, b, p, base, sum(w) AS w, max(ref) AS ref FROM bases GROUP BY ALL),
        calls AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY pair_id, contig, a, b, p ORDER BY w DESC, ref DESC, base) = 1)
        SELECT pair_id, contig, a AS "start", b AS "end", string_agg(base, '' ORDER BY p) AS consensus_seq FROM calls GROUP BY pair_id, contig, a, b""",
    "inverted_repeats": f"""WITH RECURSIVE parts AS (SELECT p_partkey, p_size, {_bases("md5(CAST(p_partkey - p_partkey % 2 AS VARCHAR))")} AS shared, {_bases("md5('x' || p_partkey)")} AS own FROM part),
        ends AS (SELECT p_partkey AS id, left(own, p_size % 6) || left(shared, 18) || substr(own, 20, 10) AS x, substr(own, 8, p_size % 9) || left(shared, 8 + p_size % 11) || left(own, 12) AS y FROM parts),
        cells(id, k, i, j, s, a, b, fresh) AS (
            SELECT id, 0, 0, 0, 0, 0, 0, true FROM ends
            UNION ALL
            SELECT * FROM (
                WITH offers AS (
                    SELECT c.id, k + 1 AS k, i + 1 AS i, j, s - 12 AS v, 2 AS move, CASE WHEN s > 0 THEN a ELSE i END AS a, CASE WHEN s > 0 THEN b ELSE j END AS b FROM cells c WHERE fresh
                    UNION ALL SELECT c.id, k + 1, i, j + 1, s - 12, 3, CASE WHEN s > 0 THEN a ELSE i END, CASE WHEN s > 0 THEN b ELSE j END FROM cells c WHERE fresh
                    UNION ALL SELECT c.id, k + 1, i + 1, j + 1, s + CASE WHEN x[i + 1] = y[j + 1] THEN 3 ELSE -4 END, 1, CASE WHEN s > 0 THEN a ELSE i END, CASE WHEN s > 0 THEN b ELSE j END FROM cells c JOIN ends USING (id) WHERE NOT fresh),
                fitting AS (SELECT o.* FROM offers o JOIN ends e ON e.id = o.id AND i <= length(x) AND j <= length(y)),
                picked AS (SELECT id, k, i, j, arg_max(struct_pack(v := v, a := a, b := b), struct_pack(v := v, m := -move)) AS o FROM fitting GROUP BY id, k, i, j)
                SELECT id, k, i, j, CASE WHEN i = 0 OR j = 0 THEN 0 ELSE greatest(o.v, 0) END, CASE WHEN o.v > 0 AND i > 0 AND j > 0 THEN o.a ELSE i END, CASE WHEN o.v > 0 AND i > 0 AND j > 0 THEN o.b ELSE j END, true FROM picked
                UNION ALL SELECT id, k + 1, i, j, s, a, b, false FROM cells WHERE fresh)),
        good AS (SELECT * FROM cells WHERE fresh AND s >= 15 AND a + 1 <= 15 AND b <= 15 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, i - a DESC, a, i, j) = 1)
        SELECT e.id AS p_partkey, substr(x, a + 1, i - a) AS ir_5p, CASE WHEN i IS NOT NULL THEN {_REVCOMP.format("substr(y, b + 1, j - b)")} END AS ir_3p FROM ends e LEFT JOIN good USING (id)""",
    "flank_prefilter": f"""WITH {_PLACED} SELECT CAST(pair_id AS INTEGER) AS pair_id, mate, contig, "start", "end", score, left_clip, right_clip, round(identity, 6) AS identity FROM kept""",
    "infer_reference": f"WITH {_aligned_pairs(0, False)} {_finished('whole_seq', repr(REFERENCE), 'sized')}",
    "infer_in_context": f"""WITH {_aligned_pairs(25, True)}, cut AS (SELECT *, substr(whole_seq, 26, greatest(0, length(whole_seq) - 50)) AS cut_seq FROM sized)
        {_finished("cut_seq", f'''CASE WHEN (f.left_clip > 0 AND f."start" - 1 < 0) OR (r.right_clip > 0 AND r."end" >= {_LENGTH}) THEN '{HALF_CONTEXT}' ELSE '{FULL_CONTEXT}' END''', "cut")}""",
    "element_filter": f"""WITH {_PLACED} SELECT CAST(pair_id AS INTEGER) AS pair_id, mate, contig, "start", "end", score, left_clip, right_clip FROM placed
        WHERE identity >= 0.9 AND CASE WHEN reverse THEN left_clip / CAST(read_length AS DOUBLE) <= 0.05 AND {_LENGTH} - "end" <= 400 AND right_clip - ({_LENGTH} - "end") <= 400
              ELSE right_clip / CAST(read_length AS DOUBLE) <= 0.05 AND "start" <= 400 AND left_clip - "start" <= 400 END""",
    "infer_database": f"""WITH RECURSIVE {_PLACED}, near AS (SELECT *, struct_pack(read_name := read_name, "start" := "start", "end" := "end", score := score, left_clip := left_clip, right_clip := right_clip, left_seq := left_seq, right_seq := right_seq, read_length := read_length, target_length := {_LENGTH}, reverse := reverse) AS x FROM placed
            WHERE identity >= 0.9 AND CASE WHEN reverse THEN left_clip / CAST(read_length AS DOUBLE) <= 0.2 AND {_LENGTH} - "end" <= 900 AND right_clip - ({_LENGTH} - "end") <= 900
              ELSE right_clip / CAST(read_length AS DOUBLE) <= 0.2 AND "start" <= 900 AND left_clip - "start" <= 900 END),
        combos AS (SELECT DISTINCT a.pair_id, a.contig, a.x AS a, b.x AS b, abs(CASE WHEN a.reverse THEN a."end" ELSE a."start" END - CASE WHEN b.reverse THEN b."end" ELSE b."start" END) AS far
                 FROM near a JOIN near b ON a.pair_id = b.pair_id AND a.contig = b.contig AND a.mate = 1 AND b.mate = 2),
        greedy(pair_id, contig, todo, taken) AS (
            SELECT pair_id, contig, list(struct_pack(a := a, b := b) ORDER BY far DESC, a, b), CAST([] AS STRUCT(a STRUCT(read_name VARCHAR, "start" INTEGER, "end" INTEGER, score INTEGER, left_clip INTEGER, right_clip INTEGER, left_seq VARCHAR, right_seq VARCHAR, read_length INTEGER, target_length INTEGER, reverse BOOLEAN), b STRUCT(read_name VARCHAR, "start" INTEGER, "end" INTEGER, score INTEGER, left_clip INTEGER, right_clip INTEGER, left_seq VARCHAR, right_seq VARCHAR, read_length INTEGER, target_length INTEGER, reverse BOOLEAN))[]) FROM combos GROUP BY pair_id, contig
            UNION ALL
            SELECT pair_id, contig, list_filter(todo, lambda t: t.a <> todo[1].a AND t.b <> todo[1].b), list_append(taken, todo[1]) FROM greedy WHERE len(todo) > 0),
        matched AS (SELECT pair_id, contig, unnest(taken) AS m FROM greedy WHERE len(todo) = 0),
        opened AS (SELECT pair_id, contig, 1 AS mate, CASE WHEN m.a.reverse THEN m.b ELSE m.a END AS f, CASE WHEN m.a.reverse THEN m.a ELSE m.b END AS r FROM matched WHERE m.a.reverse <> m.b.reverse),
        ends AS (SELECT * FROM opened WHERE f."start" <= 900 AND {_LENGTH} - r."end" <= 900 AND f.score + r.score > 0),
        top AS (SELECT * FROM ends QUALIFY f.score + r.score = max(f.score + r.score) OVER (PARTITION BY pair_id)),
        {_TARGETS}, sized AS (SELECT *, f.left_seq || substr(target, f."start" + 1, greatest(0, r."end" - f."start")) || r.right_seq AS whole_seq FROM top JOIN targets USING (contig))
        {_finished("whole_seq", "'inferred_database'", "sized")} WHERE length(whole_seq) > 0""",
    "inferred_overlaps": f"""WITH {_LINES}, made AS (SELECT l_orderkey AS pair_id, row_number() OVER () AS id, {_bases("md5(l_orderkey || '-' || l_partkey || '-' || q)")} AS t, {_bases("md5(l_orderkey || '+' || l_suppkey || '+' || q)")} AS u, q, d, x FROM lines WHERE l_linenumber = 1),
        pairs AS (SELECT pair_id, id, u || left(t, 6 + q % 25) AS a, CASE WHEN d = 3 THEN 'N' || substr(t, 2, 5 + q % 25) ELSE left(t, 6 + q % 25) END || left(reverse(u), 4 + x) AS b FROM made),
        shifts AS (SELECT *, unnest(range(1 - length(b), length(a))) AS shift FROM pairs),
        places AS (SELECT *, greatest(shift, 0) AS i, greatest(-shift, 0) AS j, least(length(a) - greatest(shift, 0), length(b) - greatest(-shift, 0)) AS n FROM shifts),
        scored AS (SELECT *, hamming(substr(a, i + 1, n), substr(b, j + 1, n)) AS miss FROM places),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY n - 2 * miss DESC, shift DESC) = 1),
        merged AS (SELECT *, least(n, greatest(0, (i + length(b) - j) // 2 + 1 - i)) AS k FROM best WHERE n - 2 * miss >= 10 AND 1 - miss / CAST(n AS DOUBLE) > 0.9)
        SELECT CAST(pair_id AS INTEGER) AS pair_id, 'inferred_overlap' AS method, 'seq_5p:' || i || '-' || (i + n) || ';seq_3p:' || j || '-' || (j + n) AS loc,
               CAST(i + length(b) - j AS INTEGER) AS inferred_seq_length, left(a, i + k) || substr(b, j + k + 1) AS inferred_seq FROM merged WHERE i + length(b) - j >= 30""",
    "clustered_sequences": f"""WITH RECURSIVE {_FAMILIES}, {_greedy("method <> 'inferred_database'", 70, 0.9, 0.85)},
        labelled AS (SELECT f.pair_id, 's' || c.k AS seqid, 'c' || c.rep AS cluster, length(f.seq) AS n FROM family f JOIN clustered c ON c.key = f.key WHERE method <> 'inferred_database'),
        firsts AS (SELECT pair_id, min(cluster) AS u FROM labelled GROUP BY pair_id),
        links AS (SELECT DISTINCT u, cluster AS v FROM labelled JOIN firsts USING (pair_id) WHERE u <> cluster),
        both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
        reach(node, label) AS (SELECT DISTINCT cluster, cluster FROM labelled UNION SELECT b.v, r.label FROM reach r JOIN both_ways b ON b.u = r.node WHERE r.label < b.v),
        roots AS (SELECT node, min(label) AS root FROM reach GROUP BY node),
        numbers AS (SELECT root, 'g' || row_number() OVER (ORDER BY length(root), root) AS "group" FROM (SELECT DISTINCT root FROM roots))
        SELECT seqid, cluster, "group", count(*) AS n, CAST(min(n) AS INTEGER) AS length FROM labelled JOIN roots ON node = cluster JOIN numbers USING (root) GROUP BY seqid, cluster, "group\"""",
    "element_database": f"""WITH RECURSIVE {_FAMILIES}, {_greedy("true", 30, 0.99, 0.99)}
        SELECT 'e' || left(key, 12) AS name, CAST(length(seq) AS INTEGER) AS length, md5(seq) AS seq_md5 FROM clustered WHERE rep = k""",
    "genotype": f"""WITH {_GENOTYPES}
        SELECT sample, CAST(pair_id AS INTEGER) AS pair_id, contig, CAST(pos_5p - 6 AS INTEGER) AS pos_3p, CAST(pos_5p AS INTEGER) AS pos_5p, seqid, cluster, "group", conf FROM typed""",
    "genotype_summary": f"""WITH {_GENOTYPES}, opened AS (SELECT * REPLACE (unnest(string_split(cluster, ';')) AS cluster) FROM typed),
        sites AS (SELECT cluster, count(DISTINCT (contig, pos_5p)) AS num_unique_sites_all, count(DISTINCT (contig, pos_5p)) FILTER (WHERE conf <> 'A') AS num_unique_sites_unambig,
                         {", ".join(f"count(*) FILTER (WHERE conf = '{c}') AS {c}" for c in ("IAwFC", "IAwHC", "IO", "IAwoC", "IDB", "ArSC", "ArMS", "ArML", "A"))} FROM opened GROUP BY cluster),
        copies AS (SELECT cluster, count(*) AS num_samples, round(avg(n), 6) AS mean_copy, max(n) AS max_copy FROM (SELECT cluster, sample, count(*) AS n FROM opened GROUP BY ALL) GROUP BY cluster),
        lengths AS (SELECT cluster, count(*) AS num_unique_seqs, round(avg(n), 6) AS mean_length, CAST(min(n) AS INTEGER) AS min_length, CAST(max(n) AS INTEGER) AS max_length
                    FROM (SELECT DISTINCT cluster, least(inferred_seq, {_REVCOMP.format("inferred_seq")}) AS k, length(inferred_seq) AS n FROM clusterseq) GROUP BY cluster),
        reps AS (SELECT cluster, seqid AS repr_seqid, CAST(length(seq) AS INTEGER) AS repr_seq_length, seq AS repr_seq FROM (SELECT cluster, seqid, count(*) AS n, min(inferred_seq) AS seq FROM clusterseq GROUP BY ALL)
                 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, length(seq) DESC, seqid) = 1)
        SELECT * FROM (SELECT DISTINCT cluster, "group" FROM opened) JOIN sites USING (cluster) JOIN lengths USING (cluster) JOIN copies USING (cluster) JOIN reps USING (cluster)""",
    "cluster_fasta": f"""WITH {_GENOTYPES}, named AS (SELECT DISTINCT unnest(string_split(cluster, ';')) AS cluster FROM typed)
        SELECT seqid || '|' || cluster || '|' || "group" AS name, md5(min(inferred_seq)) AS seq_md5 FROM clusterseq WHERE cluster IN (SELECT cluster FROM named) GROUP BY seqid, cluster, "group\"""",
    "null_genotypes": f"""WITH {_CLUSTERSEQ}, found AS (SELECT DISTINCT sample, pair_id FROM clusterseq WHERE method = 'inferred_overlap')
        SELECT count(*) AS candidates, count(f.pair_id) AS with_inference, count(*) - count(f.pair_id) AS without_inference
        FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS sample, o_orderkey AS pair_id FROM orders JOIN customer ON o_custkey = c_custkey) o LEFT JOIN found f USING (sample, pair_id)""",
    "evidence_methods": f"""WITH {_CLUSTERSEQ}
        SELECT cluster, {", ".join(f"count(*) FILTER (WHERE method = '{m}') AS {m}" for m in METHODS)}, count(*) FILTER (WHERE {_ASSEMBLED} AND seqid <> 's1') > 0 AS from_assembly FROM clusterseq GROUP BY cluster""",
    "shared_pair_groups": f"""WITH RECURSIVE {_CLUSTERSEQ}, held AS (SELECT DISTINCT sample, pair_id, cluster || '.' || seqid AS c FROM clusterseq),
        firsts AS (SELECT sample, pair_id, min(c) AS u FROM held GROUP BY ALL),
        edges AS (SELECT DISTINCT u, c AS v FROM held JOIN firsts USING (sample, pair_id) WHERE u <> c),
        both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
        reach(node, label) AS (SELECT DISTINCT c, c FROM held UNION SELECT b.v, r.label FROM reach r JOIN both_ways b ON b.u = r.node WHERE r.label < b.v),
        roots AS (SELECT node, min(label) AS root FROM reach GROUP BY node),
        numbers AS (SELECT root, 'g' || row_number() OVER (ORDER BY length(root), root) AS "group" FROM (SELECT DISTINCT root FROM roots))
        SELECT node AS cluster, "group" FROM roots JOIN numbers USING (root)""",
    "fasta_round_trip": r"""SELECT CAST(item_id AS VARCHAR) AS name, CAST(length(regexp_replace(text, '\s', '', 'g')) AS INTEGER) AS length, md5(regexp_replace(text, '\s', '', 'g')) AS seq_md5 FROM benchmark""",
    "tsv_round_trip": f"""WITH {_CLUSTERSEQ} SELECT cluster, method, count(*) AS n, CAST(sum(pair_id) AS BIGINT) AS pairs, CAST(sum(length(inferred_seq)) AS BIGINT) AS bases, min(seqid) AS least_seqid FROM clusterseq GROUP BY cluster, method""",
    **{name: f"""WITH {_READS}
        SELECT read_name, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 128 ELSE 64 END + CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN unmapped THEN 4 ELSE 0 END + CASE WHEN x = 1 THEN 8 ELSE 0 END AS INTEGER) AS flag,
               contig, s AS ref_start, e AS ref_end, mapq, unmapped AS is_unmapped, CAST(1 + CAST(ln > 0 AS INTEGER) + CAST(rn > 0 AS INTEGER) + CASE WHEN m2 > 0 THEN 2 ELSE 0 END AS INTEGER) AS operations, md5(seq) AS seq_md5,
               CAST({_ONE_QUAL.format("range(len)")} AS INTEGER) AS quality,
               CASE WHEN lmis THEN '0A' || (m1 + m2 - 1) WHEN rmis THEN (m1 + m2 - 1) || 'A0' ELSE CAST(m1 + m2 AS VARCHAR) END AS md, x % 3 AS nm, q AS as_score FROM reads {which}""" for name, which in (("sam_round_trip", ""), ("bam_round_trip", ""), ("region_fetch", "WHERE l_suppkey % 2 = 0 AND s < l_suppkey * 37 % 2000 + 20 AND e > l_suppkey * 37 % 2000"))},
    "formatted_alignments": f"""WITH {_READS}, rows AS (
            SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS mate, array_to_string(list_transform(range(len), lambda i: chr(CAST(53 + (i + q) % 20 AS INTEGER))), '') AS qs FROM reads WHERE l_linenumber <> 7),
        other AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY read_name, mate ORDER BY contig, s, seq) = 1)
        SELECT a.read_name, CAST(CASE WHEN a.mate = 2 THEN 128 ELSE 64 END AS INTEGER) AS flag, a.contig, a.s AS ref_start, a.seq, o.seq AS mate_seq, md5(o.qs) AS mate_quals_md5
        FROM rows a LEFT JOIN other o ON o.read_name = a.read_name AND o.mate = 3 - a.mate WHERE NOT (a.unmapped AND coalesce(o.unmapped, a.x = 1))""",
    "cluster_listing": """SELECT 'p' || p_partkey AS member, 'p' || min(p_partkey) OVER (PARTITION BY p_brand) AS rep FROM part""",
    "poisson_tail": f"""WITH {_LINES} SELECT l_orderkey, q, mean, round(CASE WHEN mean = 0 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(q), lambda i: exp(i * ln(mean) - mean - lgamma(i + 1))))) END, 9) AS tail
        FROM (SELECT l_orderkey, q, d + x * 3 AS mean FROM lines)""",
    "phred_values": """SELECT page_id, CAST(length(url) AS INTEGER) AS n, CAST(list_sum(list_transform(string_split(url, ''), lambda c: ascii(c) - 33)) AS INTEGER) AS total,
        list_max(list_transform(string_split(url, ''), lambda c: ascii(c) - 33)) AS most, url FROM pages""",
}
