"""Queries opN_<name> over whole tables, thin shells around the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, jaccard, katz, licences, lines, mixing, quality, token_files, winnowing


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark, _read(spark, sf_dir, "embeddings"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare(spark, _read(spark, sf_dir, "documents"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(spark, _read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(spark, _read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False, with_text=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(spark, _read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.scan(spark, _read(spark, sf_dir, "documents")))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(spark, _read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_winnowing": op2_winnowing,
    "op3_katz": op3_katz,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_lines": op7_lines,
    "op8_token_files": op8_token_files,
    "op9_licences": op9_licences,
    "op10_jaccard": op10_jaccard,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CLASSES = "reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x), least AS (SELECT x, min(y) y FROM reach GROUP BY 1)"



def _notice_row(n: licences.Notice) -> str:
    """Label, base, key, text, offset of the key in the text, and the key's longest word with its place."""
    key, text = n.key.split(), n.text.split()
    longest = max(range(len(key)), key=lambda j: len(key[j]))
    return f"('{n.label}', {str(n.base).lower()}, {key}, {text}, {next(i for i in range(len(text)) if text[i:][: len(key)] == key)}, '{key[longest]}', {longest})"


_NOTICES = ", ".join(map(_notice_row, licences.NOTICES))

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size FROM documents),
o AS (SELECT *, md5(concat_ws(':', '7', doc_id, size, source)) ord FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM o GROUP BY 1),
q AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) rnk, CAST(source_size AS DOUBLE) * 3 cap FROM s),
w AS (SELECT *, CAST([5, 2, 1][(rnk - 1) % 3 + 1] AS DOUBLE) weight FROM q),
f AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0) lft, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) share FROM w WINDOW b AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, first_value(CASE WHEN lft * weight < cap * share THEN lft / share END IGNORE NULLS) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) lvl FROM f),
t AS (SELECT source, source_size, least(lvl * weight, cap) target FROM g),
r AS (SELECT o.*, source_size, target, sum(size) OVER (PARTITION BY o.source ORDER BY ord, doc_id ROWS UNBOUNDED PRECEDING) ran FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
e AS (SELECT r.*, CAST(k * source_size + ran AS DOUBLE) / nullif(target, 0) finish FROM r, (VALUES (0), (1), (2)) n(k) WHERE size > 0),
c AS (SELECT doc_id, sum(size) OVER (ORDER BY finish, ord, doc_id ROWS UNBOUNDED PRECEDING) queued FROM e),
m AS (SELECT doc_id, count(*) copies FROM c WHERE queued <= (SELECT sum(size) FROM o) GROUP BY 1)
SELECT r.doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) taken, source, CAST(coalesce(copies, 0) AS INTEGER) copies FROM r LEFT JOIN m ON m.doc_id = r.doc_id""",
    "op9_licences": rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
pos AS (SELECT doc_id, unnest(w) x, generate_subscripts(w, 1) i FROM w),
notices(label, base, key, txt, off, kx, ko) AS (VALUES {_NOTICES}),
voc AS (SELECT DISTINCT unnest(txt) v FROM notices),
df AS (SELECT x, count(DISTINCT doc_id) n FROM pos WHERE x IN (SELECT v FROM voc) GROUP BY 1),
idf AS (SELECT v, ln(((SELECT count(*) FROM w) + 1) / (coalesce(n, 0) + 1)) + 1e-6 idf FROM voc LEFT JOIN df ON x = v),
near AS (SELECT doc_id, label, base, key, txt, off, i - ko s FROM pos JOIN notices ON x = kx),
places AS (SELECT doc_id, label, base, key, txt, off, w, s FROM near JOIN w USING (doc_id) WHERE s >= 1 AND w[s:s + len(key) - 1] = key),
words AS (SELECT doc_id, label, s, off, key, w, unnest(txt) v, generate_subscripts(txt, 1) j FROM places),
scored AS (SELECT doc_id, label, s, sum(CASE WHEN j - 1 >= off AND j - 1 < off + len(key) OR (s - off + j - 1 >= 1 AND w[s - off + j - 1] = words.v) THEN idf ELSE 0 END) / sum(idf) score FROM words JOIN idf ON idf.v = words.v GROUP BY ALL),
p AS (SELECT places.doc_id, places.label, base, places.s - 1 s, score FROM places JOIN scored ON scored.doc_id = places.doc_id AND scored.label = places.label AND scored.s = places.s),
a AS (SELECT doc_id, count(*) FILTER (WHERE base) n_base, min(s) FILTER (WHERE base) first_word, max(s) FILTER (WHERE base) last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) base_labels, string_agg(DISTINCT label, ',' ORDER BY label) labels, round(least(max(score), 1.0), 6) score FROM p GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, CAST(0 AS DOUBLE)) score FROM w LEFT JOIN a USING (doc_id)""",
    "op1_embeddings": rf"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings),
usable AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id x, b.vec_id y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{_CLASSES}, n AS (SELECT x, count(*) n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(y, vec_id)) component_id, vec_id = least(vec_id, coalesce(y, vec_id)) kept FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN least ON least.x = vec_id""",
    "op7_lines": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) ln, generate_subscripts(string_split(text, chr(10)), 1) pos FROM documents),
m AS (SELECT doc_id, pos, ln, list_transform(list_filter(string_split_regex(ln, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) t FROM l),
t AS (SELECT *, len(t) n, CAST('0x' || substr(md5(array_to_string(t, ' ')), 1, 15) AS BIGINT) line FROM m),
u AS (SELECT DISTINCT line, t, n FROM t WHERE n > 0),
j AS (SELECT unnest(range({lines.RUNS})) j),
short AS (SELECT line, j, least(n - {lines.DEPTH}, {lines.RUNS}) r, n || ' ' || array_to_string(t[:{lines.DEPTH}], ' ') || ' ' || j || ' ' || array_to_string(t[{lines.DEPTH} + (n - {lines.DEPTH}) * j // {lines.RUNS} + 1:{lines.DEPTH} + (n - {lines.DEPTH}) * (j + 1) // {lines.RUNS}], ' ') k FROM u, j WHERE n < {lines.LONG} AND n > {lines.DEPTH} AND (n - {lines.DEPTH}) * j // {lines.RUNS} < (n - {lines.DEPTH}) * (j + 1) // {lines.RUNS}),
words AS (SELECT line, t, n, unnest(t) x, generate_subscripts(t, 1) - 1 i FROM u WHERE n >= {lines.LONG}),
best AS (SELECT line, j, t, greatest(i - 2, 0) a FROM words JOIN j ON n * j // {lines.RUNS} <= i AND i < n * (j + 1) // {lines.RUNS} QUALIFY row_number() OVER (PARTITION BY line, j ORDER BY length(x) DESC, i) = 1),
runs AS (SELECT line, j, ceil(r * {lines.SHARE} / 100) need, k FROM short UNION ALL SELECT line, j, ceil({lines.RUNS} * {lines.SHARE} / 100), 'long ' || array_to_string(t[a + 1:a + 5], ' ') FROM best),
heads AS (SELECT k, min(line) head FROM runs GROUP BY 1 HAVING min(line) <> max(line)),
met AS (SELECT line, head FROM runs JOIN heads USING (k) WHERE line <> head GROUP BY 1, 2 HAVING count(DISTINCT j) >= max(need)),
joins AS (SELECT line, min(head) head FROM met GROUP BY 1),
belongs AS (SELECT line, head FROM joins UNION SELECT head, head FROM joins),
g AS (SELECT doc_id, pos, n, coalesce(head, line) template FROM t LEFT JOIN belongs USING (line) WHERE n > 0),
c AS (SELECT template, min(doc_id) f FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= CASE WHEN max(n) >= {lines.LONG} THEN {lines.LONG_DOCS} ELSE {lines.MIN_DOCS} END),
d AS (SELECT DISTINCT doc_id, pos FROM g JOIN c USING (template) WHERE doc_id <> f),
kept AS (SELECT doc_id, count(*) n_lines, count(d.pos) n_dropped, string_agg(ln, chr(10) ORDER BY l.pos) FILTER (WHERE d.pos IS NULL) kept FROM l LEFT JOIN d USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_dropped, 0) n_dropped, length(CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END) kept_chars, sha256(CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END) kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)""",
    "op10_jaccard": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g FROM w),
z AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
meet AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM meet JOIN z p ON p.doc_id = x JOIN z q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
{_CLASSES}
SELECT doc_id, coalesce(n, 0) n_shingles, least(doc_id, coalesce(y, doc_id)) component_id FROM documents LEFT JOIN z USING (doc_id) LEFT JOIN least ON least.x = doc_id""",
}
