"""DuckDB SQL of the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

ITEM_WORDS = """regexp_extract_all(
    translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ITEM_WORDS.format(text="text")} AS w FROM documents),
i AS (SELECT item_id, {ITEM_WORDS.format(text="text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n,
              array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.rid, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (win, n)),
pos AS (SELECT rid, count(*) AS n_hit FROM
        (SELECT DISTINCT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT rid, item_id::varchar AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit,
       coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

OP4 = """
WITH s AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://')
                  THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
c AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM s),
u AS (SELECT page_id, regexp_extract(rest, '^[^/]*') AS raw,
             substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM c),
p AS (SELECT page_id, path,
             translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                      ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""

#: Permutation of the blocks of a source in a pass: a * (i + 1) - 1 modulo n, with a the first,
#: second or third power of 2^61 - 1.
OP6 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::hugeint AS size FROM documents),
s AS (SELECT source, sum(size)::hugeint AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (k - 1) % 3] AS wt, n * 2.0::double AS cap FROM s),
o AS (SELECT *, (sum(n) OVER ())::double * 1.5
             - coalesce(sum(cap) OVER (ORDER BY cap / wt, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(wt) OVER (ORDER BY cap / wt, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wts FROM w),
l AS (SELECT (SELECT lft / wts FROM o WHERE NOT cap < wt * (lft / wts) ORDER BY cap / wt, k LIMIT 1) AS level),
t AS (SELECT k, source, n, least(cap, coalesce(level * wt, cap)) AS target FROM o, l),
q AS (SELECT *, round(target)::hugeint AS words, (n + 63) // 64 AS nb FROM t WHERE n > 0),
q2 AS (SELECT *, words // n AS passes, words % n AS part FROM q),
st AS (SELECT rid, k, size, coalesce(sum(size) OVER (PARTITION BY k
              ORDER BY ((coalesce(doc_id, 0) % 65536) + 65536) % 65536, doc_id NULLS FIRST, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::hugeint AS start
       FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
sl AS (SELECT k, nb, passes, part, unnest(range(0, (passes * nb + (part + 63) // 64)::bigint))::hugeint AS j FROM q2),
sp AS (SELECT *, j // nb AS p, j % nb AS i, (2305843009213693951 % nb)::hugeint AS m FROM sl),
sa AS (SELECT *, CASE (k + p) % 3 WHEN 0 THEN m WHEN 1 THEN (m * m) % nb ELSE (((m * m) % nb) * m) % nb END AS a FROM sp),
sb AS (SELECT k, (a * (i + 1) + nb - 1) % nb AS blk,
              CASE WHEN p < passes THEN 64 ELSE least(64, part - i * 64) END AS take FROM sa),
pc AS (SELECT rid, k, start, size,
              unnest(range((start // 64)::bigint, ((start + size - 1) // 64)::bigint + 1))::hugeint AS blk
       FROM st WHERE size > 0),
tk AS (SELECT rid, sum(greatest(0, least(start + size - blk * 64, 64, take) - greatest(start - blk * 64, 0))) AS taken
       FROM pc JOIN sb USING (k, blk) GROUP BY rid)
SELECT d.doc_id, d.size::bigint AS size, t.n::bigint AS source_size, t.target::double AS target,
       coalesce(taken, 0)::bigint AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN tk USING (rid)
"""

#: All pairs that share a shingle, counted; components by the smallest id that is reached.
OP9 = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, CASE WHEN len(w) < 2 THEN w[1] ELSE w[s] || ' ' || w[s + 1] END AS g
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w), 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
i AS (SELECT x.rid AS a, y.rid AS b, count(*) AS shared FROM g x JOIN g y USING (g) WHERE x.rid <> y.rid GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ZEROS = "[0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of ASCII text, bit by bit."""
    byte = f"list_reduce(list_prepend(xor(c, b), {ZEROS}), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda b: ascii(b)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295::BIGINT)"


#: Cheapest edits as one text for every state of the pattern (s0 nothing yet, s1 after s, s2 after
#: u, s3 after a): the cost in six digits, then the audit, so that the least text is wanted.
def op11() -> str:
    def more(key: str, cost: str, letter: str) -> str:
        return f"(lpad((left({key}, 6)::bigint + {cost})::varchar, 6, '0') || substr({key}, 7) || '{letter}')"

    def if_(condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN {value} END"

    stays = "f NOT IN ('blank', 'duplicate')"
    extra = "(CASE WHEN f = 'truncated' THEN 3 ELSE 0 END)"

    def row(state: int, kept: list[tuple[str, int]], reroled: list[int]) -> str:
        options = [more(f"s{state}", "4", "D")]
        options += [if_(f"{stays} AND c = '{c}'", more(f"s{p}", extra, "K")) for c, p in kept]
        options += [if_(stays, more(f"s{p}", f"(3 + {extra})", "R")) for p in reroled]
        return f"least({', '.join(options)})"

    return f"""
WITH RECURSIVE src AS (SELECT *, {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 AS k,
              coalesce(role, ' ') AS r, coalesce(text, ' ') AS x FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS role,
               CASE k WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS text,
               unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE k <> 0),
n AS (SELECT *, row_number() OVER o - 1 AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
             lag(left(role, 1)) OVER o || left(role, 1) AS pair, left(role, 1) AS c,
             regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail
      FROM dam WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
w AS (SELECT conv_id, turn, role, text, i, pair, c,
             CASE WHEN tail = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                  WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS f FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::bigint AS gaps,
             count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
             count(*) FILTER (f = 'truncated') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM w GROUP BY conv_id),
dp AS (SELECT conv_id, 0::bigint AS i, '000000' AS s0, NULL::varchar AS s1, '000003I' AS s2, '000006II' AS s3 FROM g
       UNION ALL
       SELECT conv_id, i, s0, s1, s2, least(s3, {more("s2", "3", "I")}) FROM (
         SELECT conv_id, i, s0, s1, s3, least(s2, {more("s0", "3", "I")}, {more("s1", "3", "I")}, {more("s3", "3", "I")}) AS s2 FROM (
           SELECT dp.conv_id, dp.i + 1 AS i, {row(0, [], [])} AS s0, {row(1, [("s", 0)], [])} AS s1,
                  {row(2, [("u", 0), ("u", 1), ("u", 3)], [0, 1, 3])} AS s2, {row(3, [("a", 2)], [2])} AS s3
           FROM dp JOIN w ON w.conv_id IS NOT DISTINCT FROM dp.conv_id AND w.i = dp.i))),
fin AS (SELECT dp.conv_id, least(s0, s3) AS best FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = g.rows),
e AS (SELECT conv_id, unnest(string_split(substr(best, 7), '')) AS l, unnest(range(length(best) - 6)) AS j FROM fin WHERE length(best) > 6),
p AS (SELECT *, count(*) FILTER (l <> 'I') OVER o - 1 AS i, count(*) FILTER (l <> 'D') OVER o AS nth
      FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY j)),
l AS (SELECT p.conv_id, p.j, p.nth, l, role, text, c,
             bool_or(l = 'K' AND c = 's') OVER (PARTITION BY p.conv_id) AS led
      FROM p LEFT JOIN w ON l <> 'I' AND w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.i),
t AS (SELECT conv_id, string_agg(CASE l WHEN 'K' THEN role ELSE CASE WHEN (nth + led::int) % 2 = 1 THEN 'user' ELSE 'assistant' END END
                                 || ':' || CASE l WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) FILTER (l <> 'D') AS body
      FROM l GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank,
       coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated,
       coalesce(illegal, 0)::bigint AS illegal, coalesce(left(best, 6)::bigint, 0)::bigint AS cost,
       coalesce(substr(best, 7), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def tree(name: str, leaves: str, levels: int) -> str:
    """CTEs of the levels of Merkle trees over `leaves` (t, p, n, h); `{name}_root` has the last node of each.

    `{name}_k{i}` has the children, `h` in order, of every parent at level i.
    """
    out = []
    for i in range(1, levels + 1):
        below = leaves if i == 1 else f"{name}_{i - 1}"
        out.append(f"{name}_k{i} AS (SELECT t, p // 16 AS p, (n + 15) // 16 AS n, list(h ORDER BY p) AS h FROM {below} WHERE n > 1 GROUP BY t, p // 16, n)")
        out.append(f"{name}_{i} AS (SELECT t, p, n, sha256(array_to_string(h, '')) AS h FROM {name}_k{i})")
    ends = " UNION ALL ".join(f"SELECT t, h FROM {x} WHERE n = 1" for x in [leaves, *(f"{name}_{i}" for i in range(1, levels + 1))])
    return ",\n".join([*out, f"{name}_root AS ({ends})"])


def climb(name: str, start: str, levels: int) -> str:
    """CTEs that carry `proof` and `f` of `start` (t, p, proof, f, ...) up the tree; the last is `{name}_up{levels}`."""
    out, below = [], start
    for i in range(1, levels + 1):
        slot = f"(x.p // {16 ** (i - 1)}) % 16"
        left, right = f"array_to_string(k.h[1:{slot}], '')", f"array_to_string(k.h[{slot} + 2:], '')"
        out.append(
            f"{name}_up{i} AS (SELECT x.* REPLACE (CASE WHEN k.h IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, "
            f"CASE WHEN k.h IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f) "
            f"FROM {below} x LEFT JOIN {name}_k{i} k ON k.t = x.t AND k.p = x.p // {16 ** i})"
        )
        below = f"{name}_up{i}"
    return ",\n".join(out)


def op13(levels: int = 7) -> str:
    def leaf(text: str = "text") -> str:
        fields = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({x})::varchar || ':' || {x}, '-')" for x in fields) + ")"

    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS t, {leaf()} AS h,
                  CASE WHEN {crc32("doc_id::varchar")} % 5 = 0 THEN {leaf(LOWER.format("text"))} ELSE {leaf()} END AS f FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY t) AS n FROM d),
{tree("a", "o", levels)},
s AS (SELECT 0 AS t, t AS st, h, row_number() OVER (ORDER BY t) - 1 AS p, count(*) OVER () AS n FROM a_root),
{tree("b", "s", levels)},
x AS (SELECT doc_id, t, p, h AS leaf, f, '' AS proof FROM o),
{climb("a", "x", levels)},
y AS (SELECT doc_id, leaf, a_root.h AS subroot, s.t AS t, s.p AS p, proof, f
      FROM a_up{levels} u JOIN a_root USING (t) JOIN s ON s.st = u.t),
{climb("b", "y", levels)}
SELECT doc_id, leaf, subroot, b_root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b_root.h AS verified
FROM b_up{levels} JOIN b_root USING (t)
"""


ORACLE: dict[str, str] = {
    "op2_decontaminate": OP2,
    "op4_url_filter": OP4,
    "op6_mixing": OP6,
    "op9_near_dedup": OP9,
    "op11_conversation_repair": op11(),
    "op13_manifest": op13(),
}
