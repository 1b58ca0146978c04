"""DuckDB SQL for the queries that SQL can express."""

OP7_MIXING = """
WITH RECURSIVE base AS (
  SELECT doc_id, source, CAST(ceil(coalesce(strlen(text), 0) / 4.0) AS BIGINT) AS tokens,
    CAST(concat('0x', substr(md5(concat('17|', CAST(doc_id AS VARCHAR))), 1, 15)) AS BIGINT) AS h
  FROM documents),
held AS (SELECT source, sum(tokens) AS held FROM base GROUP BY source HAVING sum(tokens) > 0),
one AS (SELECT list(CAST(held AS DOUBLE) / total ORDER BY source) AS p, max(total) AS total FROM (SELECT source, held, sum(held) OVER () AS total FROM held)),
solve(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN e >= 0.95 THEN m ELSE lo END, CASE WHEN e >= 0.95 THEN hi ELSE m END
  FROM (SELECT i, lo, hi, m, list_sum(list_transform(r, lambda x: -(x / z) * ln(x / z))) / ln(len(r)) AS e
    FROM (SELECT *, list_sum(r) AS z FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m, list_transform(p, lambda x: pow(x, (lo + hi) / 2)) AS r FROM solve, one WHERE i < 50)))),
ex AS (SELECT round(lo, 6) AS a FROM solve WHERE i = 50),
w AS (SELECT source, CAST(held AS BIGINT) AS held, CAST(total AS BIGINT) AS budget,
    CAST(floor(round(pow(CAST(held AS DOUBLE) / total, a) / sum(pow(CAST(held AS DOUBLE) / total, a)) OVER (), 9) * total) AS BIGINT) AS quota
  FROM held, one, ex),
placed AS (SELECT doc_id, source, tokens, h, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY h, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS BIGINT) - tokens AS start FROM base),
copies AS (SELECT doc_id, source, tokens, quota, budget, e AS epoch, e * held + start AS pos
  FROM (SELECT *, unnest(range(0, CAST((quota - start - 1) // held AS BIGINT) + 1)) AS e FROM placed JOIN w USING (source) WHERE start < quota)),
blocks AS (SELECT *, CAST(floor(CAST(pos AS DOUBLE) / CAST(quota AS DOUBLE) * ceil(budget / CAST(1000000 AS DOUBLE))) AS BIGINT) AS block,
    CAST(concat('0x', substr(md5(concat('18|', CAST(epoch AS VARCHAR), '|', CAST(doc_id AS VARCHAR))), 1, 15)) AS BIGINT) AS drawn FROM copies)
SELECT doc_id, source, tokens, CAST(epoch AS BIGINT) AS epoch, block, CAST(row_number() OVER (PARTITION BY block ORDER BY drawn, doc_id, source, pos) AS BIGINT) AS place FROM blocks
"""

_ID = "concat('<urn:uuid:', substr({h},1,8), '-', substr({h},9,4), '-', substr({h},13,4), '-', substr({h},17,4), '-', substr({h},21,12), '>')"
_SHA = "concat('sha1:', list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(concat('0x', substr(sha1({x}), CAST((i // 4) * 5 + 1 AS INTEGER), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER) + 1, 1)), 'string_agg', ''))"


def op9_warc() -> str:
    from skerry.llm.warc import BLOCK_TAGS, ENTITIES

    text = "regexp_replace(payload, '(?s)<!--.*?-->', ' ', 'g')"
    for pattern, to in ((r"(?is)<script\b.*?</script>", "' '"), (r"(?is)<style\b.*?</style>", "' '"), (rf"(?is)</?(?:{BLOCK_TAGS})(?:\s[^>]*)?/?>", "chr(10)"), ("(?s)<[^>]*>", "''")):
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    for entity, shown in ENTITIES.items():
        text = f"replace({text}, '{entity}', '{shown.replace(chr(39), chr(39) * 2)}')"
    text = f"regexp_replace(regexp_replace(regexp_replace({text}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '\\A[ \\n]+|[ \\n]+\\z', '', 'g')"
    return f"""
WITH r AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, md5(concat_ws('|', 'response', CAST(page_id AS VARCHAR), url)) AS h FROM pages),
s AS (SELECT *, {_ID.format(h='h')} AS refers_to, {_SHA.format(x='payload')} AS source_digest,
  concat('source-status: HTTP/1.1 200 OK', chr(13), chr(10), 'source-Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'source-Content-Length: ', strlen(payload)) AS headers FROM r),
b AS (
  SELECT page_id, refers_to, target_uri, source_digest, 'metadata' AS record_type,
    concat('title: ', trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), chr(13), chr(10), 'language: ', regexp_extract(payload, '(?is)<html[^>]*\\blang="([^"]*)"', 1),
      chr(13), chr(10), 'outlinks: ', len(regexp_extract_all(payload, '(?is)<a\\s[^>]*href=')), chr(13), chr(10), headers, chr(13), chr(10)) AS block FROM s
  UNION ALL
  SELECT page_id, refers_to, target_uri, source_digest, 'conversion', {text} FROM s),
i AS (SELECT *, md5(concat_ws('|', record_type, refers_to)) AS h FROM b)
SELECT page_id, record_type, {_ID.format(h='h')} AS record_id, refers_to, target_uri, source_digest, {_SHA.format(x='block')} AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM i
"""

#: crc32 of a decimal text, byte by byte; ``crcs`` is the table of the 256 remainders.
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda r, b: xor(r >> 8, crcs[CAST(xor(r & 255, b) AS INTEGER) + 1])), CAST(4294967295 AS BIGINT))"
_FIELD = "coalesce(concat(strlen(CAST({x} AS VARCHAR)), ':', CAST({x} AS VARCHAR)), '-')"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(x=c) for c in ("doc_id", "source", "lang", "n_chars", "{t}")) + "))"


def op12_merkle() -> str:
    climb = "SELECT tree, k + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree, k) AS n FROM {x}) WHERE n > 1 GROUP BY tree, k, i // 16"
    sides = "SELECT tree, k, i, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {x} WINDOW w AS (PARTITION BY tree, k, i // 16 ORDER BY i)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE bits(b, r, k) AS (SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256) UNION ALL SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(r ORDER BY b) AS crcs FROM bits WHERE k = 8),
leaves AS (SELECT doc_id, coalesce(concat('s', source), '') AS tree, {_LEAF.format(t="text")} AS leaf,
  CASE WHEN {_CRC.format(x="CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_LEAF.format(t=lowered)} END AS changed FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low(tree, k, i, d) AS (SELECT tree, 0, pos, leaf FROM placed UNION ALL {climb.format(x="low")}),
subroots AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM (SELECT tree, arg_max(d, k) AS d FROM low GROUP BY tree)),
high(tree, k, i, d) AS (SELECT '', 0, pos, subroot FROM subroots UNION ALL {climb.format(x="high")}),
sides AS ({sides.format(x="low")}), upper AS ({sides.format(x="high")}),
tops AS (SELECT max(k) AS top, arg_max(d, k) AS root FROM high),
heights AS (SELECT tree, max(k) AS height FROM low GROUP BY tree),
steps AS (
  SELECT p.doc_id, p.tree, p.pos, s.k AS lev, s.before, s.after FROM placed p JOIN heights h USING (tree) JOIN sides s ON s.tree = p.tree AND s.k < h.height AND s.i = p.pos // CAST(pow(16, s.k) AS BIGINT)
  UNION ALL
  SELECT p.doc_id, p.tree, p.pos, h.height + s.k, s.before, s.after FROM placed p JOIN heights h USING (tree) JOIN subroots r USING (tree), upper s, tops t WHERE s.k < t.top AND s.i = r.pos // CAST(pow(16, s.k) AS BIGINT)),
proofs AS (SELECT tree, pos, sha256(string_agg(concat(before, after), '' ORDER BY lev)) AS proof FROM steps GROUP BY tree, pos),
fold(tree, pos, lev, d) AS (SELECT tree, pos, CAST(0 AS BIGINT), coalesce(changed, leaf) FROM placed UNION ALL SELECT f.tree, f.pos, f.lev + 1, sha256(concat(s.before, f.d, s.after)) FROM fold f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.lev = f.lev),
ends AS (SELECT tree, pos, arg_max(d, lev) AS folded_root FROM fold GROUP BY tree, pos)
SELECT p.doc_id, p.leaf, r.subroot, t.root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.root AS verified
FROM placed p JOIN subroots r USING (tree) JOIN ends e ON e.tree = p.tree AND e.pos = p.pos LEFT JOIN proofs q ON q.tree = p.tree AND q.pos = p.pos, tops t
"""
