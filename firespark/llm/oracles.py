"""The numbered queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP3 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS h FROM pages),
  best AS (SELECT h, octet_length(body) AS n, max(page_id) AS original FROM p GROUP BY 1, 2)
SELECT page_id, octet_length(body) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('{ALPHABET}',
    CAST(((CAST('0x' || substr(p.h, CAST(k // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM p JOIN best ON p.h = best.h AND octet_length(body) = best.n"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  fine AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
  link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
  reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a),
  least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY 1),
  degree AS (SELECT a AS id, count(*) AS n_links FROM link GROUP BY 1)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON v.vec_id = least.id LEFT JOIN degree ON v.vec_id = degree.id"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  cut AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0),
  win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, w[s:s + 12] AS x FROM cut),
  size AS (SELECT DISTINCT len(x) AS n FROM win),
  place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, size WHERE len(w) >= n),
  hit AS (SELECT doc_id, item, s, n FROM place JOIN win ON win.x = w[s:s + n - 1]),
  covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM hit) GROUP BY 1),
  owner AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN owner USING (doc_id)"""

OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS g, source IS NULL AS none,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('0:' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
  per AS (SELECT g, none, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1, 2),
  w AS (SELECT *, ([3e0, 1e0, 2e0])[(row_number() OVER (ORDER BY none, g) - 1) % 3 + 1] AS w, source_size * 2e0 AS cap FROM per),
  s AS (SELECT *, (sum(source_size) OVER ()) * 1.5e0 AS words, sum(w) OVER () AS w_all, coalesce(sum(w) OVER b, 0e0) AS w_before,
    coalesce(sum(cap) OVER b, 0e0) AS cap_before FROM w WINDOW b AS (ORDER BY cap / w, none, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT *, cap * (w_all - w_before) <= w * (words - cap_before) AS capped FROM s),
  t AS (SELECT *, CASE WHEN capped THEN cap ELSE w * ((words - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0e0))
    / sum(CASE WHEN NOT capped THEN w END) OVER ()) END AS target FROM f),
  e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
  r AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS missing,
    coalesce(sum(size) OVER (PARTITION BY d.g, d.none ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN e ON d.g = e.g AND d.none = e.none)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN missing > 0 AND 2 * before + size <= 2 * missing THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""



def _crc32(text: str) -> str:
    """crc32 of a string of digits, a colon and letters up to U+00FF, bit by bit."""
    octets = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, unicode(ch) - 64] END))"
    bits = f"flatten(list_transform({octets}, lambda x: list_transform(range(8), lambda k: (x >> k) & 1)))"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, b) & 1))),"
            " CAST(4294967295 AS BIGINT))")


OP11 = rf"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
  l AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM r GROUP BY 1, 2),
  h AS (SELECT run, c, {_crc32("id || ':' || run")} AS h FROM l),
  w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
  v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
  place AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
  cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM place),
  near AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.x = b.x AND a.i = b.i AND a.word <> b.word
    UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.x = v.word UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.x = v.word),
  best AS (SELECT a, count(*) OVER (PARTITION BY a) AS n_near, b, v.n AS n FROM near JOIN v ON b = v.word
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) = 1),
  f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * v.n THEN b END AS form,
    CASE WHEN best.n >= 10 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON v.word = a),
  walk AS (SELECT word, word AS stop FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.stop = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.stop AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk ON f.word = walk.word JOIN f z ON walk.stop = z.word AND z.form IS NULL"""

OP12 = rf"""
WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
  s AS (SELECT *, len(w) AS n, h // 10 % greatest(len(w), 1) AS a, h // 10 AS g FROM c),
  m AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i
    ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM s),
  p AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM m),
  pair AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
  isle AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS o FROM pair),
  long AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM isle GROUP BY doc_id, q, o HAVING count(*) + q >= greatest(24, 3 * q)),
  run AS (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
  listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY 1),
  best AS (SELECT * FROM run x WHERE NOT EXISTS (SELECT 1 FROM run y WHERE y.doc_id = x.doc_id AND (y.l * x.q > x.l * y.q
    OR (y.l * x.q = x.l * y.q AND (y.s < x.s OR (y.s = x.s AND y.q < x.q)))))),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
  kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM m LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _digits(value: str, width: int) -> str:
    return f"lpad(lower(to_hex(CAST({value} AS UBIGINT))), {width}, '0')"


def _like(a: str, b: str) -> str:
    differ = f"list_transform(range(8), lambda l: list_sum(list_transform(range(32), lambda k: CAST({a}.spots[l * 32 + k + 1] <> {b}.spots[l * 32 + k + 1] AS INT))))"
    full = f"coalesce(list_max(list_filter(range(8), lambda l: ({differ})[l + 1] > 29)), -1)"
    # ln(1 - 1/32), the share of lanes that one paragraph leaves alone.
    guess = f"list_sum(list_transform(range(8), lambda l: CASE WHEN l > {full} THEN ln(1 - least(({differ})[l + 1], 31) / 32e0) / ln(31e0 / 32e0) ELSE 0e0 END)) * 2e0 ** ({full} + 1)"
    return (f"CASE WHEN {a}.total + {b}.total = 0 THEN 1e0 WHEN {full} = 7 THEN 0e0 "
            f"ELSE round(greatest(0e0, 1 - {guess} / ({a}.total + {b}.total)), 4) END")


_LANES = ", ".join(f"CAST('0x' || substr(x, {8 * i + 1}, 8) AS BIGINT) AS d{i}" for i in range(8))
_LEVEL = " + ".join(f"CAST(d6 < {1 << (32 - k)} AS INT)" for k in range(1, 8))
_DENSE = " || ".join(_digits(f"sum(d{i}) % 4294967296", 8) for i in range(6))

OP13 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  o AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS nid
    FROM t WINDOW w AS (ORDER BY doc_id DESC)),
  e AS (SELECT *, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) AS edited FROM o),
  both_texts AS (SELECT doc_id, 0 AS kind, t AS body FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
  x AS (SELECT doc_id, kind, sha256(unnest(regexp_extract_all(body, '[^\x09-\x0D\x20.!?][^.!?\x0A]*[.!?]*'))) AS x FROM both_texts),
  lanes AS (SELECT doc_id, kind, {_LANES} FROM x),
  dense AS (SELECT doc_id, kind, count(*) AS total, {_digits('count(*)', 8)} || {_DENSE} AS front FROM lanes GROUP BY 1, 2),
  spot AS (SELECT doc_id, kind, ({_LEVEL}) * 32 + d7 % 32 AS k, CAST(sum((d7 >> 5) % 256) AS BIGINT) % 256 AS v FROM lanes GROUP BY 1, 2, 3),
  spots AS (SELECT doc_id, kind, map(list(k), list(v)) AS m FROM spot GROUP BY 1, 2),
  fp AS (SELECT b.doc_id, b.kind, coalesce(total, 0) AS total, coalesce(front, repeat('0', 56)) AS front,
    list_transform(range(256), lambda k: coalesce(m[k], 0)) AS spots
    FROM both_texts b LEFT JOIN dense USING (doc_id, kind) LEFT JOIN spots USING (doc_id, kind)),
  shown AS (SELECT *, front || list_aggregate(list_transform(spots, lambda v: {_digits('v', 2)}), 'string_agg', '') AS shown FROM fp)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, a.shown AS fingerprint, b.shown AS edited_fingerprint,
  {_like('a', 'b')} AS near_edited, {_like('a', 'z')} AS near_next
FROM e JOIN shown a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN shown b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN shown z ON z.doc_id = e.nid AND z.kind = 0"""

ORACLES = {
    "op3_warc": OP3, "op4_embeddings": OP4, "op7_contamination": OP7, "op10_mix": OP10, "op11_spelling": OP11, "op12_runs": OP12,
    "op13_fingerprints": OP13,
}
