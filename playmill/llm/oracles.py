"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from playmill.llm.chat import CLOSE, COLON, ESCAPE, OPEN, REPLY
from playmill.llm.urls import LINK, LOWER, UPPER


def top_k_sql(k: int, every: int, scale: int) -> str:
    """Operator 2: all products of queries and rows."""
    return f"""WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
u AS (SELECT vec_id, e FROM r WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT len(e) AS n FROM u GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 1),
v AS (SELECT DISTINCT vec_id, list_transform(e, lambda x: floor({scale} * x)) AS z FROM u, d WHERE len(e) = n),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.z, x.z) AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % {every} = 0),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= {k}"""


def url_sql(rules: list[tuple[str, str, str]], damping: float, rounds: int, threshold: float) -> str:
    """Operator 5: rules, and as many rounds of four propagations as the operator makes."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    keep = repr(1 - damping)
    fits = ", ".join(f"CASE WHEN (host = {text(h)} OR ends_with(host, {text('.' + h)})) AND starts_with(path, {text(p)}) THEN {{'n': {len(h + p)}, 'rule': {text(h + p)}, 'verdict': {text(v)}}} END" for v, h, p in rules)
    low = f"translate(%s, '{UPPER}', '{LOWER}')"
    parts = [
        "u AS (SELECT page_id, html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"hp AS (SELECT page_id, html, {low % "regexp_extract(rest, '^([^/?#]*)', 1)"} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"j AS (SELECT *, list_sort(list_filter([{fits}], lambda x: x IS NOT NULL), 'DESC')[1] AS best FROM hp)",
        f"l AS (SELECT host AS src, {low % 'dst'} AS dst FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, {text(LINK)}, 1))) AS dst FROM j WHERE host <> ''))",
        "links AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND dst <> '' GROUP BY src, dst)",
        "hosts AS MATERIALIZED (SELECT host, count(*) FILTER (best.verdict = 'allow') / count(*) AS allowed, count(*) FILTER (best.verdict = 'block') / count(*) AS blocked FROM j WHERE host <> '' GROUP BY host)",
        "forward AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM links)",
        "reverse AS MATERIALIZED (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS weight FROM links)",
        "nodes AS (SELECT host, 1.0::DOUBLE AS mass FROM (SELECT host FROM hosts UNION SELECT src FROM links UNION SELECT dst FROM links))",
        "allows AS (SELECT host, allowed AS mass FROM hosts WHERE allowed > 0)",
        "blocks AS (SELECT host, blocked AS mass FROM hosts WHERE blocked > 0)",
    ]
    for name, seeds, way in (("trust", "allows", "forward"), ("distrust", "blocks", "reverse"), ("all_trust", "nodes", "forward"), ("all_distrust", "nodes", "reverse")):
        start = f"SELECT host, mass * {keep} AS score FROM {seeds}"
        parts.append(f"{name}_0 AS MATERIALIZED ({start})")
        for i in range(1, rounds + 1):
            moved = f"SELECT w.dst AS host, s.score * w.weight * {damping} AS score FROM {name}_{i - 1} s JOIN {way} w ON s.host = w.src"
            parts.append(f"{name}_{i} AS MATERIALIZED (SELECT host, sum(score) AS score FROM ({start} UNION ALL {moved}) GROUP BY host)")
    joins = " ".join(f"LEFT JOIN {n}_{rounds} {n} ON {n}.host = h.host" for n in ("trust", "distrust", "all_trust", "all_distrust"))
    parts.append("sc AS (SELECT h.host, allowed + blocked > 0 AS ruled, " + ", ".join(f"coalesce({n}.score, 0) AS {n}" for n in ("trust", "distrust", "all_trust", "all_distrust")) + f" FROM hosts h {joins})")
    share = lambda n: f"CASE WHEN {n} > 0 THEN round({n} / nullif(all_{n} - CASE WHEN ruled THEN 0 ELSE {keep} END, 0), 9) ELSE 0 END"
    parts.append(f"v AS (SELECT host, trust, distrust, coalesce({share('distrust')} > {share('trust')} AND {share('distrust')} >= {threshold}, FALSE) AS low FROM sc)")
    return "WITH " + ",\n".join(parts) + (
        "\nSELECT page_id, j.host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN low THEN 'block' ELSE 'allow' END) AS verdict, "
        "round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust FROM j LEFT JOIN v ON v.host = j.host"
    )


def chat_sql(extra: list[tuple[int, int, str, str]], block: int) -> str:
    """Operator 11: digests of turns and replies, and the lengths of the formatted prefixes inside each block."""
    text = lambda s: "'" + s.replace("'", "''") + "'"

    def size(column: str) -> str:
        out = f"replace({column}, {text(ESCAPE)}, {text(ESCAPE * 2)})"
        for mark in (OPEN, COLON, CLOSE):
            out = f"replace({out}, {text(mark)}, {text(mark[0] + ESCAPE + mark[1:])})"
        return f"length({out})"

    more = ", ".join(f"({c}, {t}, {text(r)}, {text(x)})" for c, t, r, x in extra)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES {more}),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  {size("role")} + {size("text")} + {len(OPEN) + len(COLON) + len(CLOSE) + 1} AS chars FROM c),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id, k // {block} ORDER BY k) AS upto, role = {text(REPLY)} AS reply, k % {block} = {block - 1} OR k = n - 1 AS closes FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (reply), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (reply), '')) AS loss_sha256, CAST(sum(upto) FILTER (reply OR closes) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""


def merkle_sql(fanout: int) -> str:
    """Operator 13: all levels of the sources' trees and of the tree over them, siblings of each leaf, and the way up from the leaf shown."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda t: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", t))) + ")"
    # crc32 by its polynomial, bit by bit, over the digits of the id
    bits = "list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {bits}), 4294967295)"
    up = lambda name, base: f"{name}(g, l, i, h, n) AS (SELECT g, 0, i, h, n FROM {base} UNION ALL SELECT g, l + 1, i // {fanout}, sha256(string_agg(h, '' ORDER BY i)), (n + {fanout - 1}) // {fanout} FROM {name} WHERE n > 1 GROUP BY g, l, i // {fanout}, n)"

    def way(name: str, base: str, levels: str) -> str:
        own = f"CAST(floor(b.i / power({fanout}, v.l)) AS BIGINT)"
        return f"{name} AS (SELECT b.g, b.i, v.l, coalesce(string_agg(v.h, '' ORDER BY v.i) FILTER (v.i < {own}), '') AS lft, coalesce(string_agg(v.h, '' ORDER BY v.i) FILTER (v.i > {own}), '') AS rgt FROM {base} b JOIN {levels} v ON v.g = b.g AND v.n > 1 AND v.i // {fanout} = {own} // {fanout} GROUP BY b.g, b.i, v.l)"

    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS h, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS shown FROM documents),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{up("lv", "b")},
s AS MATERIALIZED (SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
{up("top", "s")},
{way("low", "b", "lv")},
{way("high", "s", "top")},
tall AS (SELECT g, max(l) AS l FROM lv GROUP BY g),
steps AS MATERIALIZED (SELECT g, i, l, lft, rgt FROM low UNION ALL SELECT b.g, b.i, t.l + h.l, h.lft, h.rgt FROM b JOIN tall t ON t.g = b.g JOIN s ON s.name = b.g JOIN high h ON h.i = s.i),
climb(g, i, l, h) AS (SELECT g, i, CAST(0 AS BIGINT), shown FROM b UNION ALL SELECT c.g, c.i, c.l + 1, sha256(p.lft || c.h || p.rgt) FROM climb c JOIN steps p ON p.g = c.g AND p.i = c.i AND p.l = c.l),
reached AS (SELECT g, i, max_by(h, l) AS h FROM climb GROUP BY g, i),
proofs AS (SELECT g, i, string_agg(lft || rgt, '' ORDER BY l) AS p FROM steps GROUP BY g, i)
SELECT doc_id, b.h AS leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM b JOIN s ON s.name = b.g CROSS JOIN (SELECT h FROM top WHERE n = 1) r JOIN reached f ON f.g = b.g AND f.i = b.i LEFT JOIN proofs p ON p.g = b.g AND p.i = b.i"""
