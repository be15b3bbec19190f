"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP9 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents),
grams AS (
  SELECT doc_id, rid, unnest(range(1, len(w) - 1)) AS i, w
  FROM (SELECT *, row_number() OVER () AS rid FROM base) WHERE len(w) >= 3),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM grams),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (
  SELECT b.doc_id, b.text, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(ln)::BIGINT AS n_lines,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_capitals
  FROM (SELECT *, row_number() OVER () AS rid FROM base) b LEFT JOIN cov c USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_capitals > word_chars
            OR word_chars > 15 * n_words OR 2 * word_chars < 3 * n_words) AS kept
FROM v
"""

OP10 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^[^?#]*') ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM u),
f AS (
  SELECT *, '.' || host AS h,
         host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM p),
r AS (
  SELECT *, CASE WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM f)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(t, '(^|[.-])(casino|poker|bet-win|xxx|porn|adult-cams?|(cheap|buy)-pills)[.-]|^ads[.]|^[^/]*/(.*/)?track/click(/|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM r
"""

OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
e AS (SELECT *, length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length(role) + 12 + 1 + 10 + 1 AS chars FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(chars)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM g
"""

#: CRC-32 of an ASCII string: bit by bit, since there is no such function.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP11 = """
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS nc,
         CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END AS nt,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
l AS (
  SELECT doc_id, lang, sha256(head || nc || tail) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN sha256(head || nt || tail) ELSE sha256(head || nc || tail) END AS claimed
  FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
g AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, count(*) AS n, count(*) OVER () AS trees FROM p GROUP BY lang),
t AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, p.n FROM p JOIN g ON p.lang IS NOT DISTINCT FROM g.lang
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, lvl, pos // 2, n),
s AS (
  SELECT 0 AS lvl, t.tree AS pos, h, trees AS n FROM t JOIN g ON t.tree = g.tree WHERE t.n = 1
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM s WHERE n > 1 GROUP BY lvl, pos // 2, n),
every AS (
  SELECT tree, lvl, pos, h, n FROM t WHERE n > 1
  UNION ALL
  SELECT -1, lvl, pos, h, n FROM s WHERE n > 1),
walk AS (
  SELECT p.doc_id, p.leaf, p.claimed, p.pos, g.tree, row_number() OVER () AS rid FROM p JOIN g ON p.lang IS NOT DISTINCT FROM g.lang),
steps AS (
  SELECT rid, v.lvl, w.pos >> v.lvl AS mine, e.h FROM walk w JOIN (SELECT DISTINCT tree, lvl FROM every) v ON v.tree = w.tree
  LEFT JOIN every e ON e.tree = w.tree AND e.lvl = v.lvl AND e.pos = xor(w.pos >> v.lvl, 1)
  UNION ALL
  SELECT rid, 1000 + v.lvl, w.tree >> v.lvl, e.h FROM walk w JOIN (SELECT DISTINCT lvl FROM every WHERE tree = -1) v ON true
  LEFT JOIN every e ON e.tree = -1 AND e.lvl = v.lvl AND e.pos = xor(w.tree >> v.lvl, 1)),
proofs AS (
  SELECT w.rid, w.doc_id, w.leaf, w.claimed, t.h AS subroot, (SELECT h FROM s WHERE n = 1) AS root,
         coalesce(list(CASE WHEN s2.h IS NULL THEN '-' WHEN s2.mine % 2 = 1 THEN 'l' || s2.h ELSE 'r' || s2.h END ORDER BY s2.lvl) FILTER (WHERE s2.rid IS NOT NULL), []) AS sib
  FROM walk w JOIN t ON t.tree = w.tree AND t.n = 1 LEFT JOIN steps s2 ON s2.rid = w.rid
  GROUP BY ALL),
f AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sib, lambda x: x[2:]), '')) AS proof_sha256,
         list_reduce(list_prepend(claimed, sib), lambda h, x: sha256(CASE x[1] WHEN '-' THEN h WHEN 'l' THEN x[2:] || h ELSE h || x[2:] END)) AS folded_root
  FROM proofs)
SELECT *, folded_root = root AS verified FROM f
""".replace("{crc}", CRC32.format("doc_id::VARCHAR"))

def _edit(top: str, cost: str, initial: str, where: str = "true") -> str:
    """A top after an edit; one that cannot be is dearer than any."""
    return f"CASE WHEN {where} THEN {{'c': {top}.c + {cost}, 'a': {top}.a || '{initial}'}} ELSE {{'c': 1000000000::BIGINT, 'a': ''}} END"


def _least(*tops: str) -> str:
    return f"list_min([{', '.join(tops)}])"


def _shift(to: str, froms: str, initial: str) -> str:
    kept = [_edit(f"w{f}", "late", "K", f"init = '{initial}' AND NOT must_go") for f in froms]
    changed = [] if initial == "s" else [_edit(f"w{f}", "2 + late", "R", "NOT must_go") for f in froms]
    return _least(_edit(f"w{to}", "3", "D"), *kept, *changed)


#: Tops: 0 nothing yet, s, u, a (a whole pair); w0 and so on are the tops after insertions.
OP13 = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT *, {CRC32.format("k")} % 20 AS code FROM raw),
dam AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE code <> 0)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM dam),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, left(role, 1) AS init,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\\z', 1) AS final FROM num),
r AS (
  SELECT *, lead(init) OVER (PARTITION BY conv_id ORDER BY n) AS after,
         CASE WHEN final = '' THEN 'b' WHEN again THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM seen),
e AS (SELECT *, fault IN ('b', 'd') AS must_go, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS late FROM r),
dp AS (
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': ''}} AS t0, {{'c': 1000000000::BIGINT, 'a': ''}} AS ts, {{'c': 1000000000::BIGINT, 'a': ''}} AS tu, {{'c': 1000000000::BIGINT, 'a': ''}} AS ta
  FROM (SELECT DISTINCT conv_id FROM e)
  UNION ALL
  SELECT conv_id, n, {_edit("w0", "3", "D")}, {_shift("s", "0", "s")}, {_shift("u", "0sa", "u")}, {_shift("a", "u", "a")}
  FROM (
    SELECT *, {_least("ta", _edit("wu", "2", "I"))} AS wa FROM (
      SELECT dp.conv_id, e.n, t0, ts, tu, ta, init, must_go, late, t0 AS w0, ts AS ws,
             {_least("tu", *[_edit(t, "2", "I") for t in ("t0", "ts", "ta")])} AS wu
      FROM dp JOIN e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.n = dp.n + 1))),
best AS (
  SELECT dp.conv_id, {_least("t0", "ta", _edit("tu", "2", "I"), _edit("ts", "4", "II"))} AS w
  FROM dp JOIN (SELECT conv_id, max(n) AS n FROM e GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM dp.conv_id AND l.n = dp.n),
steps AS (
  SELECT conv_id, k, w.a[k] AS ed, length(replace(w.a[:k], 'I', '')) AS n, length(replace(w.a[:k], 'D', '')) AS j
  FROM (SELECT *, unnest(range(1, length(w.a) + 1)) AS k FROM best)),
made AS (
  SELECT s.conv_id, s.k, s.ed, s.j, e.role, e.text,
         bool_or(s.ed = 'K' AND s.j = 1 AND e.init = 's') OVER (PARTITION BY s.conv_id) AS has_s
  FROM steps s LEFT JOIN e ON s.ed <> 'I' AND e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.n = s.n),
fixed AS (
  SELECT conv_id, sha256(coalesce(string_agg(CASE WHEN ed = 'K' THEN role WHEN (j - has_s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN ed = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) FILTER (WHERE ed <> 'D'), '')) AS h FROM made GROUP BY conv_id),
agg AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE after IS NOT NULL AND init || after NOT IN ('su', 'ua', 'au')) AS illegal
  FROM e GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost,
       coalesce(w.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN agg ON agg.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLES: dict[str, str] = {"op4_chat_formatting": OP4, "op9_quality_rules": OP9, "op10_url_filters": OP10, "op11_merkle_manifest": OP11, "op13_conversation_repair": OP13}
