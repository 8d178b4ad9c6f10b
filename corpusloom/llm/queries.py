"""Queries over the training-data operators: opN_<name>(spark, sf_dir), and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.decontaminate import UNITS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusloom.llm.bpe import encode_report

    return encode_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_inside=True)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds after 16 arrivals and their merges."""
    from pyspark.sql import functions as F

    from corpusloom.llm.shards import compacted

    _, rows = compacted(table(spark, sf_dir, "documents"), arrivals=16, target_bytes=32 << 20)
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("text_bytes"))


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.hmm import scores

    return scores(table(spark, sf_dir, "documents"), held_out=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusloom.llm.rans import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.quotes import reply_ordered

    return reply_ordered(table(spark, sf_dir, "conversations"))


def quotes_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over messages that quote each other; the table itself has no quotes."""
    from corpusloom.llm.quotes import reply_ordered, with_quotes

    return reply_ordered(with_quotes(table(spark, sf_dir, "conversations")))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 tells of the base kinds, which SQL can say too; the field's spans it can't."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def hmm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 tells beside the model's score, for which no model need be trained."""
    from pyspark.sql import functions as F

    from corpusloom.llm.hmm import scores

    return scores(table(spark, sf_dir, "documents"), held_out=2, hidden=False).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES = {"quotes_linked": quotes_linked, "secrets_base": secrets_base, "hmm_base": hmm_base, "op1_quality": op1_quality, "op2_secrets": op2_secrets, "op3_bpe": op3_bpe, "op4_decontaminate": op4_decontaminate, "op5_minhash": op5_minhash, "op6_compaction": op6_compaction, "op7_hmm": op7_hmm, "op8_warc": op8_warc, "op9_token_files": op9_token_files, "op10_quotes": op10_quotes}

OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        len(ls) AS n_lines, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper,
        length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_alpha
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_upper > 60 * n_alpha
    OR NOT (word_chars BETWEEN 2 * n_words AND 20 * n_words) OR 100 * n_alpha < 50 * word_chars) AS kept
FROM b
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w JOIN m ON m.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

OP4_SQL = r"""
WITH unit AS (SELECT [UNITS] AS u),
txt AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
tok AS (SELECT side, id, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+') AS ws FROM txt),
frm AS (SELECT side, id, list_transform(ws, lambda t: lower(t)) AS raw, list_transform(ws, lambda t: CASE WHEN t[1] BETWEEN '0' AND '9' THEN '<num>'
    WHEN list_contains(u, lower(t)) THEN '<unit>' WHEN lower(t) <> t THEN '<name>' ELSE t END) AS tmpl FROM tok, unit WHERE len(ws) > 0),
pos AS (SELECT side, id, raw, tmpl, unnest(range(1, greatest(len(raw) - 4, 1) + 1)) AS p FROM frm),
win AS (SELECT side, id, p, raw[p:p + 4] AS r, tmpl[p:p + 4] AS t FROM pos),
lit AS (SELECT *, len(list_filter(t, lambda x: x NOT IN ('<num>', '<unit>', '<name>'))) AS n FROM win),
k AS (SELECT side, id, p, 'raw' AS kind, array_to_string(r, ' ') AS form, r, t FROM lit
  UNION ALL SELECT side, id, p, 'template', array_to_string(t, ' '), r, t FROM lit WHERE n BETWEEN 2 AND len(t) - 1),
n AS (SELECT id AS item, CAST(max(p) AS BIGINT) AS n FROM win WHERE side = 'i' GROUP BY id),
met AS (SELECT DISTINCT d.id, i.id AS item, d.kind, i.p AS place, d.p - i.p AS shift, i.t, i.r AS was, d.r AS raw
  FROM k d JOIN k i ON d.side = 'd' AND i.side = 'i' AND d.kind = i.kind AND d.form = i.form),
sh AS (SELECT id, item, shift, count(DISTINCT place) AS places FROM met GROUP BY ALL),
gap AS (SELECT sh.*, CASE WHEN shift - lag(shift) OVER (PARTITION BY id, item ORDER BY shift) > n // 2 THEN 1 ELSE 0 END AS new FROM sh JOIN n USING (item)),
occ AS (SELECT id, item, shift, places, sum(new) OVER (PARTITION BY id, item ORDER BY shift ROWS UNBOUNDED PRECEDING) AS occ FROM gap),
tk AS (SELECT met.*, occ, places, rank() OVER (PARTITION BY id, item, occ, place ORDER BY places DESC, shift) AS rk FROM met JOIN occ USING (id, item, shift)),
slot AS (SELECT id, item, occ, place, was[x] AS was, raw[x] AS raw FROM (SELECT *, unnest(range(1, len(t) + 1)) AS x FROM tk WHERE kind = 'template' AND rk = 1)
  WHERE t[x] IN ('<num>', '<unit>', '<name>')),
bad AS (SELECT *, min(raw) OVER a <> max(raw) OVER a OR min(was) OVER b <> max(was) OVER b AS bad FROM slot
  WINDOW a AS (PARTITION BY id, item, occ, was), b AS (PARTITION BY id, item, occ, raw)),
judged AS (SELECT id, item, occ, place FROM bad GROUP BY ALL HAVING NOT bool_or(bad)),
ex AS (SELECT DISTINCT id, item, place FROM met WHERE kind = 'raw'),
more AS (SELECT id, item, occ, count(*) AS m FROM judged ANTI JOIN ex USING (id, item, place) GROUP BY ALL),
tot AS (SELECT id, item, sum(e) AS e, max(m) AS m FROM (SELECT id, item, count(*) AS e, 0 AS m FROM ex GROUP BY ALL UNION ALL SELECT id, item, 0, m FROM more) GROUP BY ALL)
SELECT id AS doc_id, item AS item_id, n AS n_windows, CAST(e + m AS BIGINT) AS n_found, CAST(e AS BIGINT) AS n_exact FROM tot JOIN n USING (item) WHERE 100 * (e + m) >= 80 * n
"""

OP6_SQL = """
SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS text_bytes FROM documents
"""

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS sha FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first,
  list_transform(range(0, 8), lambda k: CAST('0x' || substr(sha, 5 * k + 1, 5) AS INTEGER)) AS twenty FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((twenty[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""

OP10_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS raw FROM conversations),
lv AS (SELECT *, list_transform(raw, lambda x: length(regexp_replace(regexp_extract(x, '^(?:[ \t]{0,3}>)+'), '[^>]', '', 'g'))) AS lv FROM m),
n AS (SELECT *, list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN lv[i] = 0 AND coalesce(lv[i + 1], 0) > 0
    AND regexp_matches(raw[i], '^.{1,200}\b(?:wrote|writes|schrieb|escribió|a écrit) ?:[ \t]*$') THEN -1 ELSE lv[i] END) AS l FROM lv),
p AS (SELECT conv_id, turn, role, raw, l, regexp_replace(array_to_string(list_transform(list_filter(range(1, len(raw) + 1), lambda i: l[i] = 0), lambda i: raw[i]), chr(10)), '^\s+|\s+$', '', 'g') AS text FROM n),
pc AS (SELECT conv_id, turn, raw, l, unnest(list_distinct(l)) AS level FROM p WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, level, l, list_transform(raw, lambda x: trim(regexp_replace(x, '^(?:[ \t]{0,3}>)+', ''))) AS c FROM pc WHERE level >= 0),
g AS (SELECT conv_id, turn, level, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN l[i] <> level THEN ''
    WHEN i = 1 OR c[i] = '' OR l[i - 1] <> level THEN chr(10) || c[i] ELSE ' ' || c[i] END), '') AS t FROM c),
s AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) AS s
  FROM (SELECT conv_id, turn, level, unnest(regexp_split_to_array(t, '[.!?]+\s+|\n')) AS x FROM g)),
q AS (SELECT DISTINCT conv_id, turn, level, s, len(string_split(s, ' ')) AS w FROM s WHERE level >= 1 AND s <> ''),
f AS (SELECT conv_id, s, min(turn) AS t FROM s WHERE level = 0 AND s <> '' GROUP BY ALL),
v AS (SELECT q.conv_id, q.turn, q.level, f.t, sum(w) AS w FROM q JOIN f ON q.conv_id = f.conv_id AND q.s = f.s AND f.t < q.turn GROUP BY ALL),
vi AS (SELECT conv_id, turn, level, arg_max(t, (w, t)) AS t FROM v GROUP BY ALL),
a AS (SELECT s, min((t, conv_id)) AS org FROM f GROUP BY s),
ov AS (SELECT q.conv_id, q.turn, q.level, org, sum(w) AS w FROM q JOIN a USING (s) ANTI JOIN vi ON q.conv_id = vi.conv_id AND q.turn = vi.turn AND q.level = vi.level
  WHERE org[2] <> q.conv_id GROUP BY ALL HAVING sum(w) >= 5),
o AS (SELECT conv_id, turn, level, arg_max(org, (w, org)) AS org FROM ov GROUP BY ALL),
al AS (SELECT conv_id, turn, level, conv_id AS lc, t AS lt FROM vi UNION ALL SELECT conv_id, turn, level, org[2], org[1] FROM o),
r AS (SELECT conv_id, turn, arg_min(lc, level) AS lc, arg_min(lt, level) AS lt FROM al GROUP BY ALL),
i AS (SELECT conv_id, turn, lt AS t FROM r WHERE lc = conv_id),
up AS (SELECT conv_id, turn, lt AS root, CAST(1 AS BIGINT) AS depth FROM r WHERE lc = conv_id
  UNION ALL SELECT up.conv_id, up.turn, i.t, depth + 1 FROM up JOIN i ON up.conv_id = i.conv_id AND up.root = i.turn),
top AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM up GROUP BY ALL),
j AS (SELECT p.conv_id, p.turn, p.role, p.text, CAST(len(list_filter(l, lambda x: x > 0)) AS BIGINT) AS quoted_lines, CAST(greatest(list_max(l), 0) AS BIGINT) AS quote_levels,
  CASE WHEN r.lc = p.conv_id THEN r.lt END AS reply_to, r.lc AS linked_conv, r.lt AS linked_turn, coalesce(top.root, p.turn) AS root, coalesce(top.depth, 0) AS depth
  FROM p LEFT JOIN r ON p.conv_id = r.conv_id AND p.turn = r.turn LEFT JOIN top ON p.conv_id = top.conv_id AND p.turn = top.turn)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY root NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text) - 1 AS position FROM j
"""

def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Places of matches are sums of the lengths of what stands between them and of the matches before them.
BASE_SECRETS_SQL = rf"""
WITH pat AS (SELECT '({_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api')}_?{_either('key')})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p0, 'AKIA[A-Z0-9]+' AS p1, '[0-9a-f]+' AS p2),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT rid, 0 AS o, 'assign' AS k, regexp_split_to_array(t, p0) AS gap, regexp_extract_all(t, p0, 0) AS hit, list_transform(regexp_extract_all(t, p0, 2), lambda x: length(x) >= 12) AS ok FROM d, pat
  UNION ALL SELECT rid, 1, 'access', regexp_split_to_array(t, p1), regexp_extract_all(t, p1, 0), list_transform(regexp_extract_all(t, p1, 0), lambda x: length(x) >= 18) FROM d, pat
  UNION ALL SELECT rid, 2, 'hex', regexp_split_to_array(t, p2), regexp_extract_all(t, p2, 0), list_transform(regexp_extract_all(t, p2, 0), lambda x: length(x) >= 16) FROM d, pat),
m AS (SELECT rid, o, k, unnest(range(1, len(hit) + 1)) AS i, gap, hit, ok FROM k),
l AS (SELECT rid, o, k, ok[i] AS ok, length(hit[i]) AS n, sum(length(gap[i])) OVER w AS gaps, coalesce(sum(length(hit[i])) OVER (PARTITION BY rid, o ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits FROM m WINDOW w AS (PARTITION BY rid, o ORDER BY i ROWS UNBOUNDED PRECEDING)),
s AS (SELECT rid, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  string_agg(concat(k, ':', CAST(gaps + hits AS BIGINT), ':', CAST(gaps + hits + n AS BIGINT)), ',' ORDER BY gaps + hits, o) AS spans FROM l WHERE ok GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN s USING (rid)
"""

BASE_HMM_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> ''), ' ') AS ws,
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM documents),
h AS (SELECT rid, doc_id, ws, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([1, 2, 3, 4, 5, 6, 7, 8] AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 7 = 2 AS held_out FROM d),
t AS (SELECT rid, held_out, unnest(ws) AS w FROM h),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
s AS (SELECT rid, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1))) AS base_score FROM t LEFT JOIN c USING (w), n GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(base_score, 4) AS base_score FROM h JOIN s USING (rid), n
"""

#: The same over messages that quote each other, as with_quotes() has them.
QUOTED_SQL = OP10_SQL.replace("FROM conversations)", "FROM quoted)", 1).replace("WITH RECURSIVE ", r"""WITH RECURSIVE one AS (SELECT conv_id, turn, min(text) AS t FROM conversations GROUP BY ALL),
src AS (SELECT c.*, a.t AS t1, b.t AS t2, z.t AS t0 FROM conversations c LEFT JOIN one a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1
  LEFT JOIN one b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2 LEFT JOIN one z ON z.conv_id = c.conv_id - 1 AND z.turn = 0),
lead AS (SELECT *, coalesce('> ' || regexp_replace(t1, '\r?\n', chr(10) || '> ', 'g') || chr(10), '') AS q1,
  coalesce('> > ' || regexp_replace(t2, '\r?\n', chr(10) || '> > ', 'g') || chr(10), '') AS q2, coalesce('> ' || regexp_replace(t0, '\r?\n', chr(10) || '> ', 'g') || chr(10), '') AS q0 FROM src),
quoted AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN CASE WHEN conv_id % 3 = 0 THEN q0 ELSE '' END
  WHEN (conv_id + turn) % 4 = 1 THEN q1 WHEN (conv_id + turn) % 4 = 2 THEN q2 || q1 WHEN (conv_id + turn) % 4 = 3 THEN q2 ELSE '' END || coalesce(text, '') AS text FROM lead),
""", 1)

SQL = {"secrets_base": BASE_SECRETS_SQL, "hmm_base": BASE_HMM_SQL, "op8_warc": OP8_SQL, "quotes_linked": QUOTED_SQL, "op6_compaction": OP6_SQL, "op10_quotes": OP10_SQL, "op4_decontaminate": OP4_SQL.replace("[UNITS]", str(UNITS)), "op5_minhash": OP5_SQL, "op1_quality": OP1_SQL}
