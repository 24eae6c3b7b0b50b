"""The same queries in DuckDB's SQL, put together from named steps."""

from __future__ import annotations

EVENTS = """SELECT event_id AS line_id, concat_ws(' ', 'event', event_type, 'user', user_id, CASE WHEN event_id % 3 = 0 THEN 'r' || event_id END, 'props', props) AS value FROM events"""
ORDERS = """SELECT o_orderkey AS line_id, concat_ws(' ', 'order', o_orderkey, 'customer', o_custkey, 'status', o_orderstatus, o_orderpriority) AS value FROM orders"""
DOCUMENTS = """SELECT doc_id * 1000000 + p AS line_id, line AS value FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents)"""
CONVERSATIONS = """SELECT conv_id * 1000000 + turn * 1000 + p AS line_id, concat_ws(' ', role, line) AS value FROM (SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM conversations)"""
SHIFTS = """SELECT o_orderkey AS line_id, concat_ws(' ', CASE WHEN o_orderkey % 7 > 4 THEN 'recheck' ELSE 'line ' || (o_orderkey % 7) END, 'flag', o_orderstatus, 'order', 'n' || o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'x' || o_custkey END, 'team', o_orderkey // 7 % 2) AS value FROM orders"""
PAGES = "SELECT page_id AS line_id, url AS value FROM pages"
PADDED = f"SELECT line_id, ' ' || replace(value, ' user ', '  user ') || ' ' AS value FROM ({EVENTS})"
MIXED = f"{EVENTS} UNION ALL SELECT line_id + 1000000000, value FROM ({CONVERSATIONS})"


def tokens(source: str, separator: str = "[ ]+", text: str = "value", usable: str = "value <> ''") -> str:
    return f"""lines AS ({source}),
split AS (SELECT line_id, value, CASE WHEN {usable} THEN string_split_regex({text}, '{separator}') ELSE [] END AS t FROM lines),
tok AS (SELECT line_id, value, (CASE WHEN len(t) > 1 AND t[len(t)] = '' THEN t[1:len(t) - 1] ELSE t END)[1:512] AS tokens FROM split)"""


def cut_bytes(line: str, start: str, length: str | None = None) -> str:
    """Bytes of valid UTF-8 text; what is left of characters that are cut through becomes U+FFFD."""
    part = f"substr(hex(encode({line})), 2 * ({start}) + 1{f', 2 * ({length})' if length else ''})"
    orphans = f"regexp_extract({part}, '^(?:[89AB][0-9A-F])*')"
    whole = f"repeat('EFBFBD', len({orphans}) // 2) || substr({part}, len({orphans}) + 1)"
    unfinished = "(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})"
    return f"decode(unhex(regexp_replace({whole}, '^((?:[0-9A-F]{{2}})*?){unfinished}$', '\\1EFBFBD')))"


def derived(wfilter: str, wsearch: str, wreplace: str) -> str:
    return f"""der AS (SELECT line_id, value, tokens, list_transform(tokens, lambda t: CASE WHEN t <> '' AND regexp_matches(t, '{wfilter}') AND regexp_matches(t, '{wsearch}')
  THEN regexp_replace(t, '{wsearch}', '{wreplace}', 'g') END) AS derived FROM tok)"""


VOCABULARY = """vocab AS (SELECT word, count(*) AS df FROM (
  SELECT line_id, unnest(list_distinct(list_filter(tokens, lambda t: t <> ''))) AS word FROM tok) GROUP BY word)"""
VOCABULARY_DERIVED = """vocab AS (SELECT word, count(*) AS df FROM (
  SELECT line_id, unnest(list_distinct(list_concat(list_filter(tokens, lambda t: t <> ''), list_filter(derived, lambda t: t IS NOT NULL)))) AS word FROM der) GROUP BY word)"""


def support(percent: float | None = None, absolute: int | None = None) -> str:
    if absolute is not None:
        return f"s AS (SELECT {absolute}::BIGINT AS s)"
    return f"s AS (SELECT trunc(count(*)::DOUBLE * {percent}::DOUBLE / 100)::BIGINT AS s FROM lines)"


FREQUENT = "freq AS (SELECT word, df FROM vocab, s WHERE df >= s)"
PLACED = "placed AS (SELECT line_id, len(tokens) AS n, unnest(tokens) AS w, unnest(range(len(tokens))) AS p FROM tok), hits AS (SELECT line_id, n, w, p FROM placed JOIN freq ON w = word WHERE w <> '')"
PLACED_DERIVED = """placed AS (SELECT line_id, len(tokens) AS n, unnest(tokens) AS t, unnest(derived) AS d, unnest(range(len(tokens))) AS p FROM der),
hits AS (SELECT line_id, n, coalesce(f.word, g.word) AS w, p FROM placed LEFT JOIN freq f ON t = f.word AND t <> '' LEFT JOIN freq g ON d = g.word AND t <> '' WHERE coalesce(f.word, g.word) IS NOT NULL)"""
REDUCED = """red0 AS (SELECT line_id, n, list(w ORDER BY p) AS words, list(p ORDER BY p) AS ps FROM hits GROUP BY line_id, n),
red AS (SELECT line_id, words, len(words) AS k, list_transform(range(len(ps)), lambda i: ps[i + 1] - CASE WHEN i = 0 THEN -1 ELSE ps[i] END - 1) AS gaps, n - 1 - ps[len(ps)] AS tail FROM red0)"""
CANDIDATES = """spots AS (SELECT line_id, words, unnest(list_append(gaps, tail)) AS g, unnest(range(len(gaps) + 1)) AS p FROM red),
bounds AS (SELECT words, p, min(g) AS lo, max(g) AS hi, count(*) AS n, min(line_id) AS first_seen FROM spots GROUP BY words, p),
cand AS (SELECT words, len(words) AS k, list(lo ORDER BY p) AS lo, list(hi ORDER BY p) AS hi, max(n) AS own_support, min(first_seen) AS first_seen FROM bounds GROUP BY words)"""
PLAIN = "rolled AS (SELECT *, own_support AS support FROM cand)"
ROLLUP = """nodes AS (SELECT *, list_filter(list_concat(flatten(list_transform(range(k), lambda i: [
    {'kind': 1, 'w': '', 'lo': lo[i + 1], 'hi': hi[i + 1], 'j': 0, 'alive': true, 'ok': false},
    {'kind': 0, 'w': words[i + 1], 'lo': 1::BIGINT, 'hi': 1::BIGINT, 'j': 0, 'alive': true, 'ok': false}])),
    [{'kind': 1, 'w': '', 'lo': lo[k + 1], 'hi': hi[k + 1], 'j': 0, 'alive': true, 'ok': false}]), lambda x: x.kind = 0 OR x.hi > 0) AS nodes,
  coalesce(nullif(list_position(list_transform(hi[1:k], lambda h: h > 0), true), 0) - 1, k) AS p FROM cand),
pairs AS (SELECT c.words, c.k, c.lo, c.hi, c.p, d.nodes AS dn, d.own_support AS more FROM nodes c JOIN nodes d ON d.k > c.k
  WHERE list_max(c.hi) > 0 AND list_transform(d.nodes[1:c.p], lambda x: x.w) = c.words[1:c.p] AND len(list_filter(d.nodes[1:c.p], lambda x: x.kind = 1)) = 0),
folded AS (SELECT *, list_reduce(dn[p + 1:], lambda s, n: CASE
    WHEN NOT s.alive THEN s
    WHEN s.j <= k THEN CASE
      WHEN s.lo + n.lo - 1 < lo[s.j] THEN {'kind': 0, 'w': '', 'lo': s.lo + n.lo, 'hi': s.hi + n.hi, 'j': s.j, 'alive': true, 'ok': false}
      WHEN s.hi + n.hi - 1 > hi[s.j] THEN {'kind': 0, 'w': '', 'lo': 0::BIGINT, 'hi': 0::BIGINT, 'j': s.j, 'alive': false, 'ok': false}
      WHEN n.kind = 0 AND n.w = words[s.j] THEN {'kind': 0, 'w': '', 'lo': 0::BIGINT, 'hi': 0::BIGINT, 'j': s.j + 1, 'alive': true, 'ok': s.j = k AND (hi[k + 1] = 0 OR lo[k + 1] = 0)}
      ELSE {'kind': 0, 'w': '', 'lo': s.lo + n.lo, 'hi': s.hi + n.hi, 'j': s.j, 'alive': true, 'ok': false} END
    WHEN hi[k + 1] = 0 THEN {'kind': 0, 'w': '', 'lo': 0::BIGINT, 'hi': 0::BIGINT, 'j': s.j, 'alive': false, 'ok': false}
    WHEN s.lo + n.lo < lo[k + 1] THEN {'kind': 0, 'w': '', 'lo': s.lo + n.lo, 'hi': s.hi + n.hi, 'j': s.j, 'alive': true, 'ok': false}
    WHEN s.hi + n.hi > hi[k + 1] THEN {'kind': 0, 'w': '', 'lo': 0::BIGINT, 'hi': 0::BIGINT, 'j': s.j, 'alive': false, 'ok': false}
    ELSE {'kind': 0, 'w': '', 'lo': s.lo + n.lo, 'hi': s.hi + n.hi, 'j': s.j, 'alive': true, 'ok': true} END,
  {'kind': 0, 'w': '', 'lo': 0::BIGINT, 'hi': 0::BIGINT, 'j': (p + 1)::INTEGER, 'alive': true, 'ok': false}) AS f FROM pairs),
gained AS (SELECT words, sum(more)::BIGINT AS more FROM folded WHERE f.alive AND f.ok GROUP BY words),
rolled AS (SELECT cand.*, own_support + coalesce(more, 0) AS support FROM cand LEFT JOIN gained USING (words))"""
CLUSTERS = "clus AS (SELECT rolled.* FROM rolled, s WHERE support >= s)"
DEPENDENCY = """members AS (SELECT words AS c, own_support, unnest(list_distinct(words)) AS a FROM cand),
shared AS (SELECT x.a, y.a AS b, sum(x.own_support)::BIGINT AS n FROM members x JOIN members y ON x.c = y.c GROUP BY x.a, y.a),
wanted AS (SELECT DISTINCT a, unnest(bs) AS b FROM (SELECT unnest(list_distinct(words)) AS a, list_distinct(words) AS bs FROM clus)),
dep AS (SELECT x.a, x.b, x.n / y.n AS dep FROM shared x JOIN shared y ON x.a = y.a AND y.b = y.a JOIN wanted w ON w.a = x.a AND w.b = x.b)"""


def weights(function: int) -> str:
    givers = "words" if function == 1 else "list_distinct(words)"
    weight = "t / m" if function == 1 else "CASE WHEN m = 1 THEN 1 ELSE (t - 1) / (m - 1) END"
    return f"""posed AS (SELECT words, len({givers}) AS m, unnest(words) AS word, unnest(range(k)) AS pos FROM clus),
given AS (SELECT words, unnest({givers}) AS giver, unnest(range(len({givers}))) AS g FROM clus),
summed AS (SELECT posed.words, pos, word, m, sum(dep ORDER BY g) AS t FROM posed JOIN given ON posed.words = given.words JOIN dep ON a = giver AND b = word GROUP BY posed.words, pos, word, m),
weight AS (SELECT words, pos, word, {weight} AS weight FROM summed)"""


def joined(threshold: float) -> str:
    return f"""mask AS (SELECT words, list(weight < {threshold} ORDER BY pos) AS weak FROM weight GROUP BY words),
marked AS (SELECT clus.*, weak, list_transform(range(k), lambda i: CASE WHEN weak[i + 1] THEN ' ' ELSE clus.words[i + 1] END) AS key FROM clus JOIN mask USING (words)),
whole AS (SELECT key, sum(support)::BIGINT AS support, count(*) AS n_inputs, min(first_seen) AS first_seen, max(first_seen) AS latest FROM marked WHERE list_contains(weak, true) GROUP BY key),
ranges AS (SELECT key, list(lo ORDER BY p) AS lo, list(hi ORDER BY p) AS hi FROM (SELECT key, p, min(l) AS lo, max(h) AS hi FROM (
  SELECT key, unnest(lo) AS l, unnest(hi) AS h, unnest(range(k + 1)) AS p FROM marked WHERE list_contains(weak, true)) GROUP BY key, p) GROUP BY key),
options AS (SELECT key, list(o ORDER BY p) AS alts FROM (SELECT key, p, list(w ORDER BY last, w) AS o FROM (SELECT key, p, w, max(first_seen) AS last FROM (
  SELECT key, first_seen, unnest(words) AS w, unnest(range(k)) AS p FROM marked WHERE list_contains(weak, true)) GROUP BY key, p, w) GROUP BY key, p) GROUP BY key),
fin AS (SELECT words, k, lo, hi, support, first_seen, list_transform(words, lambda w: [w]) AS alts, list_transform(words, lambda w: false) AS weak, 1::BIGINT AS n_inputs, false AS is_joined, first_seen AS latest FROM marked WHERE NOT list_contains(weak, true)
UNION ALL SELECT key, len(key), lo, hi, support, first_seen, alts, list_transform(key, lambda w: w = ' '), n_inputs, true, latest FROM whole JOIN ranges USING (key) JOIN options USING (key))"""


NOT_JOINED = "fin AS (SELECT *, list_transform(words, lambda w: [w]) AS alts, list_transform(words, lambda w: false) AS weak, 1::BIGINT AS n_inputs, false AS is_joined, first_seen AS latest FROM clus)"


def rendered(detail: bool = False) -> str:
    bracket = "weak[i + 1]" if detail else "len(alts[i + 1]) > 1"
    return f"""shown AS (SELECT *, array_to_string(list_transform(range(k), lambda i: CASE WHEN hi[i + 1] <> 0 THEN '*{{' || lo[i + 1] || ',' || hi[i + 1] || '}} ' ELSE '' END
    || CASE WHEN {bracket} THEN '(' || array_to_string(alts[i + 1], '|') || ')' ELSE alts[i + 1][1] END || ' '), '')
  || CASE WHEN hi[k + 1] <> 0 THEN '*{{' || lo[k + 1] || ',' || hi[k + 1] || '}}' ELSE '' END AS pattern FROM fin)"""


def with_(*steps: str) -> str:
    return "WITH " + ",\n".join(steps) + "\n"


def mining(source: str, s: str, separator: str = "[ ]+") -> list[str]:
    return [tokens(source, separator), s, VOCABULARY, FREQUENT, PLACED, REDUCED, CANDIDATES]


def mining_derived(source: str, s: str, rule: tuple[str, str, str]) -> list[str]:
    return [tokens(source), derived(*rule), s, VOCABULARY_DERIVED, FREQUENT, PLACED_DERIVED, REDUCED, CANDIDATES]


REPORT = "SELECT pattern, support::BIGINT AS support, k::BIGINT AS k FROM shown"
CANDIDATE_ROWS = "SELECT array_to_string(words, ' ') AS words, array_to_string(list_transform(range(k + 1), lambda i: lo[i + 1] || '-' || hi[i + 1]), ' ') AS gaps, k::BIGINT AS k, {0}::BIGINT AS support FROM {1}"
WEIGHT_ROWS = "SELECT array_to_string(words, ' ') AS words, pos::BIGINT AS pos, word, round(weight, 6) AS weight FROM weight"
COUNTED_ROWS = "SELECT row_number() OVER (ORDER BY {0}) - 1 AS place, pattern, support::BIGINT AS support, k::BIGINT AS k FROM shown"
BY_SUPPORT = "support DESC, k, first_seen DESC, pattern"
BY_CONSTANTS = "k, is_joined, CASE WHEN is_joined THEN latest END NULLS FIRST, first_seen DESC, pattern"
