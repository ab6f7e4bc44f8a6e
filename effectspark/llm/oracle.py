"""The results of the registered queries in SQL, where SQL can express them."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), filled AS (
  SELECT *, row_number() OVER w AS k, lead(line) OVER w AS next FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), rolled AS (
  SELECT doc_id, i, k, CASE WHEN next IS NOT NULL THEN md5(md5(line) || md5(next)) END AS p FROM filled
), edges AS (
  SELECT doc_id, i, k, r, p IS NOT NULL AND substr(p, 2 * r + 1, 1) != '0' AS starts,
         CASE WHEN substr(p, 2 * r + 2, 1) != '0' OR p2 IS NULL THEN 1
              WHEN substr(p2, 2 * r + 2, 1) != '0' OR p3 IS NULL THEN 2
              WHEN substr(p3, 2 * r + 2, 1) != '0' OR p4 IS NULL THEN 3 ELSE 4 END AS more
  FROM (SELECT *, lead(p, 1) OVER w AS p2, lead(p, 2) OVER w AS p3, lead(p, 3) OVER w AS p4
        FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY k)), (SELECT unnest(range(3)) AS r)
), ranges AS (
  SELECT DISTINCT e.doc_id, e.i AS a, f.i AS b FROM edges e JOIN filled f ON f.doc_id = e.doc_id AND f.k = e.k + more WHERE starts
), chunks AS (
  SELECT r.doc_id, a, b, string_agg(line, chr(10) ORDER BY i) AS body
  FROM ranges r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN a AND b GROUP BY ALL
), gone AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a, b) AS copy FROM chunks) WHERE copy > 1
), cut AS (
  SELECT DISTINCT g.doc_id, l.i FROM gone g JOIN l ON l.doc_id = g.doc_id AND l.i BETWEEN a AND b
), texts AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (c.i IS NULL), '') AS kept
  FROM l LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_chunks_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN texts USING (doc_id)
"""

EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY bare) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g
"""


# crc32 of a text whose code points are given as a list, all below U+0100
CRC32 = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crcs
)"""


def crc32(text: str) -> str:
    """crc32 of a text without code points from U+0100; ``crcs`` must be at hand."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    octets = f"flatten(list_transform({codes}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END))"
    step = "lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295)"


SPELLING = f"""
WITH {CRC32.strip()}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\u00c0-\u00ff]+')) AS run FROM documents
), counted AS (
  SELECT run, {crc32("coalesce(CAST(doc_id AS varchar), '') || ':' || run")} AS h, n
  FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL), crc_table
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
    FROM counted) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), dropped AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM dropped a JOIN dropped b USING (i, rest) WHERE a.word != b.word UNION
  SELECT a.word, a.n, b.word, b.n FROM dropped a JOIN words b ON a.rest = b.word UNION
  SELECT b.word, b.n, a.word, a.n FROM dropped a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, struct_pack(a := -m, b := other)) AS other, max(m) AS m, any_value(n) AS n
  FROM near GROUP BY word
), forms AS (
  SELECT w.word, CASE WHEN m >= 5 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS here FROM forms
    UNION ALL SELECT c.word, f.form FROM c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL
  ) SELECT c.word, c.here AS root FROM c JOIN forms f ON f.word = c.here WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word)
"""

CONVERSATIONS = f"""
WITH RECURSIVE {CRC32.strip()}, conv AS (
  SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), spaced AS (
  SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("coalesce(CAST(r.conv_id AS varchar), ' ') || ':' || coalesce(CAST(turn AS varchar), ' ')")} % 20 AS kind
  FROM conversations r JOIN conv ON r.conv_id IS NOT DISTINCT FROM conv.conv_id, crc_table
), damaged AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM spaced WHERE kind != 0)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair
  FROM ordered
), facts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faulty GROUP BY c
), inserts(s, price, letters, t, said) AS (
  VALUES (0, 0, '', 0, []), (1, 0, '', 1, []), (2, 0, '', 2, []), (3, 0, '', 3, []),
         (0, 3, 'I', 2, ['user:']), (1, 3, 'I', 2, ['user:']), (2, 3, 'I', 3, ['assistant:']), (3, 3, 'I', 2, ['user:']),
         (0, 6, 'II', 3, ['user:', 'assistant:']), (1, 6, 'II', 3, ['user:', 'assistant:'])
), edits(s, letter, initial, t, role) AS (
  VALUES (0, 'D', NULL, 0, NULL), (1, 'D', NULL, 1, NULL), (2, 'D', NULL, 2, NULL), (3, 'D', NULL, 3, NULL),
         (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL), (3, 'K', 'u', 2, NULL),
         (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'), (2, 'R', NULL, 3, 'assistant'), (3, 'R', NULL, 2, 'user')
), walk(c, i, s, price, letters, said) AS (
  SELECT c, 0::BIGINT, 0, 0, '', []::varchar[] FROM conv
  UNION ALL
  SELECT c, i, t, best.price, best.letters, best.said FROM (
    SELECT f.c, f.i, e.t, min(struct_pack(
             price := w.price + a.price + CASE WHEN e.letter = 'D' THEN 4 ELSE
                        CASE WHEN e.letter = 'R' THEN 3 ELSE 0 END + CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END END,
             letters := w.letters || a.letters || e.letter,
             said := list_concat(w.said, a.said, CASE WHEN e.letter = 'D' THEN [] ELSE [coalesce(e.role, f.role) || ':' || f.text] END)
           )) AS best
    FROM walk w JOIN faulty f ON f.c = w.c AND f.i = w.i + 1 JOIN inserts a ON a.s = w.s
      JOIN edits e ON e.s = a.t AND (e.letter = 'D' OR f.fault IN ('', 'truncated') AND coalesce(e.initial, left(f.role, 1)) = left(f.role, 1))
    GROUP BY f.c, f.i, e.t)
), ended AS (
  SELECT w.c, min(struct_pack(price := w.price + a.price, letters := w.letters || a.letters, said := list_concat(w.said, a.said))) AS best
  FROM walk w JOIN facts f ON f.c = w.c AND f.n = w.i JOIN inserts a ON a.s = w.s WHERE a.t IN (0, 3) GROUP BY w.c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.price, 0)::BIGINT AS cost,
       coalesce(best.letters, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM conv LEFT JOIN facts USING (c) LEFT JOIN ended USING (c)
"""

URL_RULES = r"""
WITH given(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), rest AS (
  SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                            THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), address AS (
  SELECT row_number() OVER () AS id, page_id, url,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), judged AS (
  SELECT a.*, max(struct_pack(l := length(g.host || g.path), rule := g.host || g.path, verdict := g.verdict)) AS best
  FROM address a LEFT JOIN given g ON (a.host = g.host OR a.host LIKE '%.' || g.host) AND starts_with(a.path, g.path)
  GROUP BY ALL
), parts AS (
  SELECT id, page_id, host, path, CASE WHEN best.rule IS NULL THEN NULL ELSE best.rule END AS rule, best.verdict AS given,
         list_filter(string_split_regex(host, '[.
]'), lambda x: x != '') AS labels,
         list_filter(string_split_regex(regexp_replace(path, '[0-9]+', '#', 'g'), '[/
]'), lambda x: x != '') AS dirs,
         list_filter(list_transform(string_split_regex(
           regexp_extract(coalesce(url, ''), '^[^?#]*[?]([^#]*)', 1), '[&
]'), lambda x: split_part(x, '=', 1)),
           lambda x: x != '') AS names
  FROM judged
), tokens AS (
  SELECT id, page_id, host, path, rule, given, list_sort(list_distinct(list_concat(
    list_transform(labels, lambda x: 'host:' || x), list_transform(dirs[1:1], lambda x: 'first:' || x),
    CASE WHEN len(dirs) > 1 THEN ['last:' || dirs[-1]] ELSE [] END, list_transform(names, lambda x: 'query:' || x)))) AS held
  FROM parts
), total AS (
  SELECT count(*) AS n, greatest(5, (count(*) * 10 + 999) // 1000) AS least,
         CASE WHEN count(*) FILTER (given = 'block') > count(*) FILTER (given = 'allow') THEN 'block' ELSE 'allow' END AS usual
  FROM tokens WHERE rule IS NOT NULL
), masks AS (
  SELECT given, held, unnest(range(1::BIGINT << len(held))) AS mask FROM tokens WHERE rule IS NOT NULL
), subsets AS (
  SELECT list_filter(held, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items, given FROM masks
), sets AS (
  SELECT items, count(*) AS n, count(*) FILTER (given = 'allow') AS allowed, count(*) FILTER (given = 'block') AS blocked
  FROM subsets GROUP BY items
), certain AS (
  SELECT items, 'allow' AS verdict, n, allowed AS hits FROM sets UNION ALL
  SELECT items, 'block', n, blocked FROM sets
), frequent AS (
  SELECT * FROM certain, (SELECT least FROM total) WHERE hits >= least OR items = []
), shorter AS (
  SELECT items, verdict, unnest(items) AS gone FROM frequent
), weaker AS (
  SELECT s.items, s.verdict, max(p.hits / p.n) AS share
  FROM shorter s JOIN frequent p ON p.items = list_filter(s.items, lambda x: x != s.gone) AND p.verdict = s.verdict
  GROUP BY ALL
), rules AS (
  SELECT f.items, f.verdict, f.n, f.hits FROM frequent f JOIN weaker w USING (items, verdict)
  WHERE f.hits * 100 >= f.n * 80 AND f.hits / f.n > w.share
), matched AS (
  SELECT id, arg_min(r.verdict, struct_pack(a := -r.hits / r.n, b := -r.hits, c := len(r.items),
                                            d := array_to_string(r.items, chr(10)), e := r.verdict)) AS verdict
  FROM tokens t JOIN rules r ON list_has_all(t.held, r.items) WHERE t.rule IS NULL GROUP BY id
)
SELECT page_id, host, path, rule, coalesce(given, m.verdict, (SELECT usual FROM total)) AS verdict
FROM tokens t LEFT JOIN matched m USING (id)
"""


def queries() -> dict[str, str]:
    return {"op7_line_dedup": LINE_DEDUP, "op10_exact_dedup": EXACT_DEDUP, "op11_conversations": CONVERSATIONS, "op12_spelling": SPELLING, "op13_url_rules": URL_RULES}
