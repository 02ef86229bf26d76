"""Registered core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import domain, domain_sql
from . import relational as r

FLAGSHIP = "cluster_summary"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        r.site_evidence,
        r.nearest_mate_filter,
        r.pair_candidates,
        r.greedy_pairs,
        r.event_pairs_interval,
        r.asof_nearest,
        r.weighted_consensus,
        r.consensus_string,
        r.mate_merge,
        r.spanning_reads,
        r.priority_cascade,
        r.ambiguity_resolution,
        r.mobile_clusters,
        r.unresolved_combine,
        r.cluster_summary,
        r.group_summary,
        r.dedupe_100p,
        r.revcomp_canonical,
        r.prefix_similarity,
        r.identity_clusters,
        r.shared_pair_components,
        r.overlap_merge,
        r.flank_slice,
        r.interval_context,
        r.semi_filter,
        r.union_sized,
        r.ordered_ids,
        r.best_score_ties,
        r.smallest_window,
        r.conf_pivot,
        r.copy_numbers,
        r.length_stats,
        r.mode_value,
        r.left_and_anti,
        *domain.QUERIES,
    )
}

_READS = """reads AS (
    SELECT l_suppkey AS contig, l_partkey AS pos, l_orderkey AS name,
           CASE WHEN l_linestatus = 'O' THEN '5p' ELSE '3p' END AS orient,
           l_returnflag AS base, CAST(l_quantity AS BIGINT) AS qual
    FROM lineitem)"""

_BY_DAY = """sites AS (
    SELECT l_suppkey AS contig, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS pos,
           CASE WHEN l_linestatus = 'O' THEN '5p' ELSE '3p' END AS orient, count(DISTINCT l_orderkey) AS n
    FROM lineitem GROUP BY ALL)"""

_PLACED = """placed AS (
    SELECT o_custkey AS sample, l_orderkey AS pair_id, l_suppkey AS contig, l_partkey AS pos,
           p_brand AS cluster, p_type AS grp, o_orderpriority AS conf, p_size AS seq_length, l_linestatus
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

_UPPER = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_UP = _UPPER.format("text")
_REVCOMP = f"translate(reverse({_UP}), 'ACGT', 'TGCA')"


def _summary(key: str) -> str:
    confs = ", ".join(f"count(*) FILTER (WHERE conf = '{c}') AS {n}" for c, n in r.CONF_COLUMNS.items())
    return f"""WITH {_PLACED},
        base AS (SELECT {key}, count(DISTINCT (contig, pos)) AS num_unique_sites_all,
                        count(DISTINCT (contig, pos)) FILTER (WHERE conf <> '5-LOW') AS num_unique_sites_unambig, {confs}
                 FROM placed GROUP BY {key}),
        copies AS (SELECT {key}, count(*) AS num_samples, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS mean_copy, max(n) AS max_copy
                   FROM (SELECT {key}, sample, count(*) AS n FROM placed GROUP BY {key}, sample) GROUP BY {key}),
        seqs AS (SELECT {key}, count(*) AS num_unique_seqs, round(CAST(sum(seq_length) AS DOUBLE) / count(*), 6) AS mean_length,
                        min(seq_length) AS min_length, max(seq_length) AS max_length
                 FROM (SELECT DISTINCT {key}, seq_length FROM placed) GROUP BY {key}),
        modes AS (SELECT {key}, seq_length AS repr_seq_length FROM
                  (SELECT {key}, seq_length, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, seq_length) AS k
                   FROM placed GROUP BY {key}, seq_length) WHERE k = 1)
        SELECT * FROM base JOIN copies USING ({key}) JOIN seqs USING ({key}) JOIN modes USING ({key})"""


ORACLE: dict[str, str] = domain_sql.ORACLE | {
    "site_evidence": f"""WITH {_READS}, by_site AS (
        SELECT contig, pos, count(DISTINCT name) FILTER (WHERE orient = '5p') AS clips_5p,
               count(DISTINCT name) FILTER (WHERE orient = '3p') AS clips_3p
        FROM reads GROUP BY contig, pos)
        SELECT contig, pos, clips_5p, clips_3p, clips_5p + clips_3p AS total,
               round(CAST(clips_5p AS DOUBLE) / (clips_5p + clips_3p), 6) AS ratio_5p
        FROM by_site WHERE clips_5p >= 2 OR clips_3p >= 2""",
    "nearest_mate_filter": f"""WITH {_READS}, sites AS (
        SELECT contig, pos, orient, count(DISTINCT name) AS n_names FROM reads GROUP BY ALL HAVING count(DISTINCT name) >= 2)
        SELECT * FROM sites s WHERE EXISTS (
            SELECT 1 FROM sites t WHERE t.contig = s.contig AND t.orient <> s.orient
            AND CASE WHEN s.orient = '5p' THEN s.pos - t.pos ELSE t.pos - s.pos END BETWEEN 1 AND {r.MATE_DISTANCE})""",
    "pair_candidates": f"""WITH {_BY_DAY}
        SELECT a.contig, a.pos AS pos_5p, b.pos AS pos_3p, a.n AS n_5p, b.n AS n_3p
        FROM sites a JOIN sites b ON a.contig = b.contig AND a.orient = '5p' AND b.orient = '3p'
             AND b.pos >= a.pos - {r.MAX_REPEAT} AND b.pos < a.pos""",
    "greedy_pairs": f"""WITH RECURSIVE {_BY_DAY}, pairs AS (
        SELECT a.contig, struct_pack(d := abs(a.n - b.n), r := a.pos - b.pos, f := a.pos, t := b.pos, n := a.n, m := b.n) AS p
        FROM sites a JOIN sites b ON a.contig = b.contig AND a.orient = '5p' AND b.orient = '3p' AND b.pos >= a.pos - {r.MAX_REPEAT} AND b.pos < a.pos),
        greedy(contig, todo, p) AS (
            SELECT contig, list(p ORDER BY p), CASE WHEN false THEN any_value(p) END FROM pairs GROUP BY contig
            UNION ALL
            SELECT contig, list_filter(todo, lambda x: x.f <> todo[1].f AND x.t <> todo[1].t), todo[1] FROM greedy WHERE len(todo) > 0)
        SELECT contig, p.f AS pos_5p, p.t AS pos_3p, p.n AS n_5p, p.m AS n_3p FROM greedy WHERE p IS NOT NULL""",
    "event_pairs_interval": """SELECT a.user_id, a.event_id AS purchase_id, b.event_id AS click_id, epoch_us(a.ts) - epoch_us(b.ts) AS gap_us
        FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click'
             AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 6 HOUR""",
    "asof_nearest": """WITH c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
        SELECT a.user_id, a.event_id AS purchase_id, c.click_id, epoch_us(a.ts) - epoch_us(c.ts) AS gap_us
        FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.ts > c.ts""",
    "weighted_consensus": f"""WITH {_READS}, w AS (
        SELECT contig, pos, orient, base, sum(qual) AS w, count(*) AS n FROM reads GROUP BY ALL),
        m AS (SELECT *, max(w) OVER (PARTITION BY contig, pos, orient) AS top FROM w)
        SELECT contig, pos, orient, CASE WHEN count(*) FILTER (WHERE w = top) > 1 THEN 'N' ELSE max(base) FILTER (WHERE w = top) END AS consensus,
               CAST(sum(n) AS BIGINT) AS support FROM m GROUP BY contig, pos, orient""",
    "consensus_string": f"""WITH {_READS}, w AS (SELECT contig, pos, base, sum(qual) AS w FROM reads GROUP BY ALL),
        m AS (SELECT *, max(w) OVER (PARTITION BY contig, pos) AS top FROM w),
        c AS (SELECT contig, pos, CASE WHEN count(*) FILTER (WHERE w = top) > 1 THEN 'N' ELSE max(base) FILTER (WHERE w = top) END AS b FROM m GROUP BY contig, pos)
        SELECT contig, CAST(floor(pos / 1000) AS BIGINT) AS "window", string_agg(b, '' ORDER BY pos) AS consensus_seq FROM c GROUP BY ALL""",
    "mate_merge": f"""WITH {_READS}
        SELECT contig, pos, name, base, CAST(qual AS INTEGER) AS qual FROM
        (SELECT *, row_number() OVER (PARTITION BY contig, pos, name ORDER BY qual DESC, base) AS k FROM reads) WHERE k = 1""",
    "spanning_reads": f"""WITH {_READS}, spans AS (SELECT contig, name, min(pos) AS s, max(pos) + 1 AS e FROM reads GROUP BY contig, name),
        sites AS (SELECT DISTINCT contig, pos FROM reads)
        SELECT t.contig, t.pos, count(DISTINCT name) AS spanning_count
        FROM sites t JOIN spans r ON r.contig = t.contig AND r.s < t.pos - 1 AND r.e > t.pos + 2 GROUP BY t.contig, t.pos""",
    "priority_cascade": """SELECT o_custkey, o_orderkey, o_orderpriority FROM
        (SELECT *, min(o_orderpriority) OVER (PARTITION BY o_custkey) AS best FROM orders) WHERE o_orderpriority = best""",
    "ambiguity_resolution": f"""WITH {_PLACED}, held AS (SELECT DISTINCT pair_id, cluster FROM placed),
        support AS (SELECT cluster, count(DISTINCT pair_id) AS support FROM placed GROUP BY cluster),
        several AS (SELECT * FROM held JOIN support USING (cluster) QUALIFY count(*) OVER (PARTITION BY pair_id) > 1),
        top AS (SELECT * FROM several QUALIFY support = max(support) OVER (PARTITION BY pair_id))
        SELECT pair_id, cluster, support, CASE WHEN count(*) OVER (PARTITION BY pair_id) = 1 THEN 'ArSC' ELSE 'A' END AS conf FROM top""",
    "mobile_clusters": f"""WITH {_PLACED}
        SELECT cluster, grp, count(DISTINCT (contig, pos)) AS sites, count(DISTINCT (contig, pos)) FILTER (WHERE l_linestatus = 'O') AS open_sites,
               count(DISTINCT (contig, pos)) > 2 AS mobile_lenient,
               count(DISTINCT (contig, pos)) FILTER (WHERE l_linestatus = 'O') > 2 AS mobile_strict
        FROM placed GROUP BY cluster, grp""",
    "unresolved_combine": f"""WITH {_PLACED}
        SELECT sample, pair_id, string_agg(DISTINCT cluster, ';' ORDER BY cluster) AS clusters FROM placed GROUP BY sample, pair_id""",
    "cluster_summary": _summary("cluster"),
    "group_summary": _summary("grp"),
    "dedupe_100p": f"""SELECT md5(least({_UP}, {_REVCOMP})) AS seq_key, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1""",
    "revcomp_canonical": f"""SELECT item_id, md5({_REVCOMP}) AS revcomp_md5, md5(least({_UP}, {_REVCOMP})) AS canonical_md5 FROM benchmark""",
    "prefix_similarity": """WITH t AS (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS t FROM benchmark)
        SELECT a.item_id, round(1 - CAST(levenshtein(left(a.t, least(length(a.t), length(b.t))), left(b.t, least(length(a.t), length(b.t)))) AS DOUBLE)
               / least(length(a.t), length(b.t)), 6) AS similarity
        FROM t a JOIN t b ON b.item_id = a.item_id + 1""",
    "shared_pair_components": """WITH RECURSIVE cl AS (SELECT p_partkey, p_brand || '/' || p_size AS cluster FROM part),
        held AS (SELECT DISTINCT l_orderkey, cluster FROM lineitem JOIN cl ON l_partkey = p_partkey),
        first AS (SELECT l_orderkey, min(cluster) AS u FROM held GROUP BY l_orderkey),
        e AS (SELECT DISTINCT u, cluster AS v FROM held JOIN first USING (l_orderkey) WHERE u <> cluster),
        both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
        reach(node, label) AS (
            SELECT DISTINCT cluster, cluster FROM cl
            UNION
            SELECT b.v, r.label FROM reach r JOIN both_ways b ON b.u = r.node WHERE r.label < b.v)
        SELECT node AS cluster, min(label) AS group_label FROM reach GROUP BY node""",
    "overlap_merge": """WITH pairs AS (SELECT a.conv_id, a.turn, a.text AS x, CASE WHEN a.turn % 2 = 0 THEN right(a.text, 12 + a.turn % 3 * 9) ELSE '' END || b.text AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
        xs AS (SELECT conv_id, turn, x, y, unnest(string_split(x, '')) AS c, unnest(range(length(x))) AS p FROM pairs),
        ys AS (SELECT conv_id, turn, x, y, unnest(string_split(y, '')) AS c, unnest(range(length(y))) AS q FROM pairs),
        shifts AS (SELECT conv_id, turn, x, y, p - q AS shift, count(*) AS same FROM xs JOIN ys USING (conv_id, turn, x, y, c) GROUP BY ALL),
        scored AS (SELECT *, n - same AS miss FROM (SELECT *, greatest(shift, 0) AS i, greatest(-shift, 0) AS j, least(length(x) - greatest(shift, 0), length(y) - greatest(-shift, 0)) AS n FROM shifts)),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY conv_id, turn, x, y ORDER BY n - 2 * miss DESC, shift DESC) = 1),
        merged AS (SELECT conv_id, turn, n >= 1 AND n - 2 * miss >= 10 AND 1 - miss / CAST(n AS DOUBLE) > 0.9 AS good, i, j, n,
                          left(x, i + least(n, greatest(0, (i + length(y) - j) // 2 + 1 - i))) || substr(y, j + least(n, greatest(0, (i + length(y) - j) // 2 + 1 - i)) + 1) AS m FROM best)
        SELECT p.conv_id, p.turn, CASE WHEN good THEN CAST(length(m) AS INTEGER) END AS merged_length,
               CASE WHEN good THEN 'seq_5p:' || i || '-' || (i + n) || ';seq_3p:' || j || '-' || (j + n) END AS loc, CASE WHEN good THEN md5(m) END AS merged_md5
        FROM pairs p LEFT JOIN merged USING (conv_id, turn)""",
    "flank_slice": f"""WITH t AS (SELECT doc_id, text, regexp_replace({_UP}, 'N+$', '') AS five, regexp_replace({_UP}, '^N+', '') AS three FROM documents)
        SELECT doc_id, CAST(length(five) AS INTEGER) AS length_5p, CAST(length(three) AS INTEGER) AS length_3p,
               left(five, 40) AS trunc_5p, right(three, 40) AS trunc_3p, substring(text, 6, 21) AS direct_repeat FROM t""",
    "interval_context": """SELECT CAST(round_even((l_suppkey + l_partkey) / 2.0, 0) AS BIGINT) AS centre,
               CAST(round_even((l_suppkey + l_partkey) / 2.0, 0) AS BIGINT) - 25 AS window_start,
               CAST(round_even((l_suppkey + l_partkey) / 2.0, 0) AS BIGINT) + 25 AS window_end,
               count(*) AS n_reads, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quality
        FROM lineitem GROUP BY 1, 2, 3""",
    "semi_filter": """SELECT p_partkey, p_brand, p_type, p_size FROM part
        WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')""",
    "union_sized": """SELECT DISTINCT md5(s) AS text_md5, CAST(length(s) AS INTEGER) AS n_chars FROM (
        SELECT text AS s FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT text FROM benchmark)
        WHERE length(s) BETWEEN 70 AND 200000""",
    "ordered_ids": """SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS pair_id FROM orders""",
    "best_score_ties": """SELECT event_id, user_id, event_type, value FROM events
        QUALIFY value = max(value) OVER (PARTITION BY user_id, event_type)""",
    "smallest_window": """SELECT l_orderkey, abs(l_partkey - l_suppkey) AS width, l_partkey, l_suppkey FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_partkey - l_suppkey), l_partkey, l_suppkey) = 1""",
    "conf_pivot": f"""WITH {_PLACED}
        SELECT grp, {", ".join(f"count(*) FILTER (WHERE conf = '{c}') AS {n}" for c, n in r.CONF_COLUMNS.items())} FROM placed GROUP BY grp""",
    "copy_numbers": f"""WITH {_PLACED}
        SELECT cluster, grp, count(*) AS num_samples, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS mean_copy, max(n) AS max_copy
        FROM (SELECT cluster, grp, sample, count(*) AS n FROM placed GROUP BY ALL) GROUP BY cluster, grp""",
    "length_stats": f"""SELECT lang, count(*) AS num_unique_seqs, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS mean_length,
               CAST(min(n) AS INTEGER) AS min_length, CAST(max(n) AS INTEGER) AS max_length
        FROM (SELECT DISTINCT lang, md5(least({_UP}, {_REVCOMP})) AS k, length(text) AS n FROM documents) GROUP BY lang""",
    "mode_value": """SELECT l_suppkey, p_brand, n FROM (
            SELECT l_suppkey, p_brand, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_brand) AS k
            FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand) WHERE k = 1""",
    "left_and_anti": """SELECT c_custkey, c_mktsegment, coalesce(n_orders, 0) AS n_orders, n_orders IS NULL AS left_only
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
}
