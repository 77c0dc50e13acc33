"""SQL for DuckDB that gives the rows of the graph queries."""

from __future__ import annotations

from strandweave.params import SampleParams

_CLEAN = "translate(regexp_replace(text, '[^ACGTNacgtn]', '', 'g'), 'ACGTNn', 'acgtaa')"
_RC = "reverse(translate({0}, 'acgt', 'tgca'))"

SEQS = f"seqs AS (SELECT doc_id AS seq_ord, source, {_CLEAN} AS seq FROM documents)"
CONVS = f"cseqs AS (SELECT conv_id * 100000 + turn AS seq_ord, role AS source, {_CLEAN} AS seq FROM conversations)"
BENCH = f"bseqs AS (SELECT item_id AS seq_ord, 'benchmark' AS source, {_CLEAN} AS seq FROM benchmark)"

LONG, SHORT = SampleParams(), SampleParams(k=5, w=10)


def hashed(t: str, seqs: str, p: SampleParams = LONG) -> str:
    """{t}h: every k-mer of a set of sequences with its hash."""
    k = p.k
    _forward = " + ".join(f"(strpos('acgt', substr(km, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k))
    _back = " + ".join(f"(4 - strpos('acgt', substr(km, {i + 1}, 1))) * {4**i}" for i in range(k))
    _hash = f"(((({{0}})::HUGEINT * {p.factor}) % 18446744073709551616::HUGEINT) >> {64 - 2 * k})::BIGINT"
    return f"""{t}k AS (SELECT seq_ord, length(seq) AS n, pos, substr(seq, pos + 1, {k}) AS km FROM (SELECT seq_ord, seq, unnest(range(0, length(seq) - {k - 1})) AS pos FROM {seqs})),
{t}m AS (SELECT seq_ord, n, pos, ({_forward})::BIGINT AS f, ({_back})::BIGINT AS r FROM {t}k),
{t}h AS (SELECT seq_ord, n, pos, f, {_hash.format("f")} AS hf, {_hash.format("r")} AS hr, least({_hash.format("f")}, {_hash.format("r")}) AS h FROM {t}m)"""


def sampled(t: str, seqs: str, p: SampleParams = LONG) -> str:
    """{t}o: closed syncmers (seq_ord, pos, canon, orient, poly)."""
    return f"""{hashed(t, seqs, p)},
{t}w AS (SELECT seq_ord, n, pos, h, min(h) OVER (PARTITION BY seq_ord ORDER BY pos ROWS BETWEEN CURRENT ROW AND {p.w} FOLLOWING) AS low, lead(h, {p.w}) OVER (PARTITION BY seq_ord ORDER BY pos) AS e FROM {t}h),
{t}s AS (SELECT w.seq_ord, w.pos, substr(q.seq, w.pos + 1, {p.length}) AS s FROM {t}w w JOIN {seqs} q USING (seq_ord) WHERE w.pos + {p.length} < w.n AND (w.h = w.low OR w.e = w.low)),
{t}o AS (SELECT seq_ord, pos, least(s, {_RC.format("s")}) AS canon, CASE WHEN s < {_RC.format("s")} THEN 1 ELSE -1 END AS orient, length(replace(s, s[1], '')) = 0 AS poly FROM {t}s)"""


FILES = """files AS (SELECT q.seq_ord, f.file, length(q.seq) AS len, coalesce(sum(length(q.seq)) OVER (ORDER BY q.seq_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM seqs q JOIN (SELECT source, (row_number() OVER (ORDER BY source))::INTEGER AS file FROM (SELECT DISTINCT source FROM seqs)) f USING (source))"""
NODES = """firsts AS (SELECT canon, seq_ord AS first_seq, pos AS first_pos, orient AS first_orient FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY seq_ord, pos) AS k FROM o WHERE NOT poly) WHERE k = 1),
of_file AS (SELECT canon, file, count(*) AS c FROM o JOIN files USING (seq_ord) WHERE NOT poly GROUP BY ALL),
counted AS (SELECT canon, sum(c)::BIGINT AS count, max(least(c, 127))::INTEGER AS max_count FROM of_file GROUP BY ALL),
nodes AS (SELECT (2 + row_number() OVER (ORDER BY f.first_seq, f.first_pos))::BIGINT AS node, canon, c.count, c.max_count, f.first_seq, f.first_pos, f.first_orient, (l.start + f.first_pos)::BIGINT AS loc
FROM firsts f JOIN counted c USING (canon) JOIN files l ON l.seq_ord = f.first_seq)"""
VISITS = """visits AS (SELECT o.seq_ord AS path_id, (row_number() OVER (PARTITION BY o.seq_ord ORDER BY o.pos) - 1)::BIGINT AS idx, n.node * o.orient AS node, o.pos FROM o JOIN nodes n USING (canon) WHERE NOT poly)"""

OCC = f"WITH {SEQS}, {sampled('', 'seqs')}"
DICT = f"{OCC}, {FILES}, {NODES}"
PATHS = f"{DICT}, {VISITS}"
SHORT_PATHS = f"WITH {SEQS}, {sampled('', 'seqs', SHORT)}, {FILES}, {NODES}, {VISITS}"

EVENTS = """WITH visits AS (SELECT path_id, idx, node, idx AS pos FROM (SELECT user_id AS path_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS idx,
list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::BIGINT AS node FROM events))"""
ORDERS = """WITH visits AS (SELECT o_custkey AS path_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS idx,
((strpos('FOP', o_orderstatus) - 1) * 5 + substr(o_orderpriority, 1, 1)::BIGINT)::BIGINT AS node, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS pos FROM orders)"""
LINES = """WITH visits AS (SELECT path_id, idx, node, idx AS pos FROM (SELECT l_orderkey AS path_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate) - 1)::BIGINT AS idx,
CASE WHEN l_returnflag = 'R' THEN -(l_partkey + 1) ELSE l_partkey + 1 END AS node FROM lineitem))"""

BOTH = """v AS (SELECT path_id, idx, node, coalesce(lag(node) OVER w, 0) AS before, -coalesce(lead(node) OVER w, 0) AS after, coalesce(pos - lag(pos) OVER w, 0) AS gap, coalesce(lead(pos) OVER w - pos, 0) AS next_gap, count(*) OVER (PARTITION BY path_id) AS n
FROM visits WINDOW w AS (PARTITION BY path_id ORDER BY idx)),
both_ AS (SELECT path_id, 1 AS strand, idx, node, before AS adj, gap FROM v UNION ALL SELECT path_id, -1, n - 1 - idx, -node, after, next_gap FROM v)"""
EDGES = "edges AS (SELECT node, adj, gap AS off, count(*) AS count FROM both_ GROUP BY ALL)"
SIDES = "sides AS (SELECT abs(node) AS node, CASE WHEN node > 0 THEN 'in' ELSE 'out' END AS side, count(*) AS n_edges, sum(count)::BIGINT AS visits FROM edges GROUP BY ALL)"
ORDERED = """hist AS (SELECT *, list({'n': node, 'g': gap}) OVER (PARTITION BY path_id, strand ORDER BY idx) AS so_far FROM both_),
ordered AS (SELECT path_id, strand, idx, node, adj, gap, (row_number() OVER (PARTITION BY node ORDER BY list_reverse(so_far), path_id, strand) - 1)::BIGINT AS place FROM hist),
lists AS (SELECT node, place, coalesce(lead(node) OVER w, 0)::BIGINT AS next_node, coalesce(lead(gap) OVER w, 0)::BIGINT AS next_gap FROM ordered WINDOW w AS (PARTITION BY path_id, strand ORDER BY idx))"""


def edges(source: str) -> str:
    return f"{source}, {BOTH}, {EDGES} SELECT * FROM edges"


def statistics(source: str) -> str:
    one = "SELECT '{0}' AS stat, round(({1})::DOUBLE, 6) AS value FROM {2}"
    parts = [
        one.format("nodes", "count(DISTINCT node)", "sides"), one.format("blank_nodes", "max(node) - count(DISTINCT node)", "sides"), one.format("complex_percent", "100.0 * count(*) FILTER (n_edges > 1) / (2 * max(node))", "sides"),
        one.format("sequences", "floor(coalesce(sum(count) FILTER (adj = 0), 0) / 2)", "edges"), one.format("simple_sides", "count(*) FILTER (n_edges = 1)", "sides"), one.format("complex_sides", "count(*) FILTER (n_edges > 1)", "sides"),
        one.format("max_edge_list", "max(n_edges)", "sides"), one.format("max_paths_through", "max(visits) FILTER (n_edges > 1)", "sides"), one.format("max_edge_count", "max(count) FILTER (n > 1)", "placed"), one.format("edge_lines", "count(*)", "edges"),
        one.format("edges", "floor(count(*) / 2)", "edges"), one.format("expected_search", "sum(count * place) FILTER (n > 1) / sum(count) FILTER (n > 1)", "placed"),
    ]
    placed = "placed AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY off, adj) AS place, count(*) OVER (PARTITION BY node) AS n FROM edges)"
    return f"{source}, {BOTH}, {EDGES}, {SIDES}, {placed} " + " UNION ALL ".join(parts)


def mem(t: str, seqs: str) -> str:
    """Maximal exact matches of a set of sequences against the documents' paths, up to {t}mem (query, blk, first, last, count)."""
    return f"""{SHORT_PATHS}, {BOTH}, {seqs}, {sampled(t, t + 'seqs', SHORT)},
{t}f AS (SELECT {t}o.*, coalesce(nodes.node * {t}o.orient, 0) AS node FROM {t}o LEFT JOIN nodes USING (canon)),
{t}b AS (SELECT *, sum((poly OR node = 0)::INTEGER) OVER (PARTITION BY seq_ord ORDER BY pos)::BIGINT AS blk FROM {t}f),
{t}q AS (SELECT seq_ord AS query, blk, (row_number() OVER w - 1)::BIGINT AS c, pos, node, coalesce(pos - lag(pos) OVER w, 0) AS gap FROM {t}b WHERE NOT poly AND node <> 0 WINDOW w AS (PARTITION BY seq_ord, blk ORDER BY pos)),
{t}j AS (SELECT q.query, q.blk, q.c, b.path_id, b.strand, b.idx - q.c AS d, q.gap AS qg, b.gap AS rg FROM {t}q q JOIN both_ b USING (node)),
{t}x AS (SELECT *, CASE WHEN lag(c) OVER w = c - 1 AND qg = rg THEN 0 ELSE 1 END AS br FROM {t}j WINDOW w AS (PARTITION BY query, blk, path_id, strand, d ORDER BY c)),
{t}r AS (SELECT *, sum(br) OVER (PARTITION BY query, blk, path_id, strand, d ORDER BY c) AS run FROM {t}x),
{t}i AS (SELECT query, blk, path_id, strand, d, run, min(c) AS first, max(c) AS last FROM {t}r GROUP BY ALL),
{t}c AS (SELECT query, blk, first, last, count(*) AS count FROM {t}i GROUP BY ALL),
{t}z AS (SELECT *, max(last) OVER (PARTITION BY query, blk ORDER BY first, last DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {t}c),
{t}mem AS (SELECT query, blk, first, last, count FROM {t}z WHERE reach IS NULL OR reach < last),
{t}pos AS (SELECT m.query, m.blk, m.first, m.last, a.pos AS start, z.pos + {SHORT.length} AS "end", m.count FROM {t}mem m JOIN {t}q a ON a.query = m.query AND a.blk = m.blk AND a.c = m.first JOIN {t}q z ON z.query = m.query AND z.blk = m.blk AND z.c = m.last)"""


UNIQUE = f"""held AS (SELECT q.query, q.blk, q.c, q.pos AS at_, q.node, n.loc, n.first_orient FROM bq q JOIN nodes n ON n.node = abs(q.node) WHERE n.count = 1),
best AS (SELECT * FROM (SELECT m.*, h.at_, h.node, h.loc, h.first_orient, row_number() OVER (PARTITION BY m.query, m.blk, m.first, m.last ORDER BY h.c) AS k FROM bpos m JOIN held h ON h.query = m.query AND h.blk = m.blk AND h.c BETWEEN m.first AND m.last) WHERE k = 1),
placed AS (SELECT query, start, "end", (CASE WHEN sign(node) = first_orient THEN loc - (at_ - start) ELSE loc + {SHORT.length} + (at_ - start) - ("end" - start) END)::BIGINT AS place, CASE WHEN sign(node) = first_orient THEN 1 ELSE -1 END AS strand FROM best)"""
LOCATED = """SELECT p.query, p.start, p."end", p.place, p.strand, f.file, f.seq_ord AS path_id, (p.place - f.start)::BIGINT AS "offset" FROM placed p LEFT JOIN files f ON p.place >= f.start AND p.place < f.start + f.len"""
