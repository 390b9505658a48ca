"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import decontamination, exact_dedup, language_model, mixing, near_dup, packing, quality, runs, search, site_style, token_counts, token_files, url_filter
from .common import table


def op1_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    read = token_files.round_trip(table(spark, sf_dir, "documents"), path, end=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.PAGE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.document_levels(), mixing.DOCUMENT_WEIGHTS).drop("text", "n_chars")


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"), token_counts.document_sections(), path)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, end=0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_report(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.with_planted_runs(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_lm_scoring,
        op3_url_filter,
        op4_mixing,
        op5_token_counts,
        op6_exact_dedup,
        op7_packing,
        op8_quality_rules,
        op9_near_duplicates,
        op10_html_extraction,
        op11_lexical_search,
        op12_decontamination,
        op13_periodic_runs,
    )
}




#: DuckDB: crc32 of a text of ASCII, bit by bit.
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


def _level_sql(i: int, levels: list[str], weight: str) -> str:
    """DuckDB: deal the budgets of one level's parents to its nodes, by weighted water-filling."""
    above, here = levels[:i], levels[: i + 1]
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    cols, up = ", ".join(here), f"LEFT JOIN n{i} USING ({', '.join(above)})" if above else ", n0"
    return f"""
c{i} AS (SELECT {cols}, max(w{i}) AS w, sum(cap) AS cap FROM t GROUP BY {cols}),
f{i} AS (
  SELECT *, w > 0 AND cap * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= w * (b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS done,
         CASE WHEN w > 0 THEN CAST(cap AS DOUBLE) / w END AS ratio
  FROM c{i} {up} WINDOW o AS ({part} ORDER BY CASE WHEN w > 0 THEN CAST(cap AS DOUBLE) / w END NULLS LAST, {levels[i]})),
g{i} AS (
  SELECT *, b - sum(CASE WHEN done THEN cap ELSE 0 END) OVER ({part}) AS rest, CASE WHEN done THEN 0 ELSE w END AS ow,
         sum(CASE WHEN done THEN 0 ELSE w END) OVER ({part}) AS allw,
         sum(CASE WHEN done THEN 0 ELSE w END) OVER ({part} ORDER BY ratio NULLS LAST, {levels[i]} ROWS UNBOUNDED PRECEDING) AS tow
  FROM f{i}),
n{i + 1} AS (SELECT {cols}, CASE WHEN done THEN cap WHEN allw > 0 THEN tow * rest // allw - (tow - ow) * rest // allw ELSE 0 END AS b FROM g{i}),"""


def mixing_sql(documents: str = "documents", fraction: float = 1.0, epochs: int = 4, seed: int = 17) -> str:
    """The mix of a relation with the columns of documents, with ``text`` and ``n_chars``."""
    weights = (
        "CASE domain WHEN 'crawl' THEN 2 WHEN 'books' THEN 5 ELSE 3 END",
        "CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 ELSE 1 END",
        "1",
    )
    levels = ["domain", "lang", "source"]
    return rf"""
d AS (
  SELECT * REPLACE (coalesce(lang, '') AS lang, coalesce(source, '') AS source),
         CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_full_match(source, 'src[1-9]') THEN 'books' ELSE 'forum' END AS domain,
         CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS n_tokens
  FROM {documents}),
l AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM d GROUP BY ALL),
t AS (SELECT *, tokens * {epochs} AS cap, {", ".join(f"CAST({w} AS HUGEINT) AS w{i}" for i, w in enumerate(weights))} FROM l),
n0 AS (SELECT CAST(least(floor(sum(tokens) * {fraction}), sum(cap)) AS HUGEINT) AS b FROM t),
{"".join(_level_sql(i, levels, w) for i, w in enumerate(weights))}
q AS (SELECT domain, lang, source, b // tokens AS full_epochs, b % tokens AS rest FROM n3 JOIN l USING (domain, lang, source) WHERE tokens > 0),
e AS (
  SELECT d.*, e AS epoch, full_epochs, rest, CAST('0x' || substr(md5('{seed}:' || e || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS order_key
  FROM d JOIN q USING (domain, lang, source), (SELECT unnest(range(0, {epochs} + 1)) AS e)
  WHERE e < full_epochs OR (e = full_epochs AND rest > 0)),
s AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY order_key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
mixed AS (
  SELECT doc_id, text, lang, source, n_chars, domain, n_tokens, CAST(epoch AS BIGINT) AS epoch, order_key,
         CAST(CASE WHEN epoch < full_epochs THEN n_tokens ELSE least(n_tokens, rest - start) END AS BIGINT) AS take_tokens
  FROM s WHERE epoch < full_epochs OR start < rest)"""


def near_sql(documents: str = "documents") -> str:
    """The report of near duplicates, with all pairs of texts that share a shingle."""
    return rf"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
s AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
  FROM d),
m AS (SELECT *, len(s) AS n, CASE WHEN len(s) > 0 THEN min(r) OVER (PARTITION BY s) ELSE r END AS c FROM s),
k AS (SELECT c, min(doc_id) AS copy_id, count(*) AS copies, any_value(n) AS n, any_value(s) AS s FROM m GROUP BY c),
x AS (SELECT c, n, unnest(s) AS x FROM k),
p AS (
  SELECT a.c AS u, b.c AS v FROM x a JOIN x b ON a.x = b.x AND a.c <> b.c AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
reach AS (SELECT c AS u, c AS v FROM k UNION SELECT reach.u, p.v FROM reach JOIN p ON reach.v = p.u),
g AS (SELECT u AS c, min(copy_id) AS class_id FROM reach JOIN k ON v = c GROUP BY u),
l AS (SELECT u AS c, sum(copies) AS others FROM p JOIN k ON v = c GROUP BY u)
SELECT doc_id, CASE WHEN m.n > 0 THEN class_id ELSE doc_id END AS class_id, CASE WHEN m.n > 0 THEN copy_id ELSE doc_id END AS copy_id,
       CAST(CASE WHEN m.n > 0 THEN copies - 1 + coalesce(others, 0) ELSE 0 END AS BIGINT) AS n_links, CAST(m.n AS BIGINT) AS n_shingles
FROM m JOIN k USING (c) JOIN g USING (c) LEFT JOIN l USING (c)
"""


def base_score_sql(documents: str = "documents") -> str:
    """What of the scores is exact counts: all but the model's own.  Ids must not be null."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 7 = 2 AS held_out,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') || [' '] AS t
  FROM {documents}),
w AS (SELECT r, held_out, unnest(t) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w),
s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score
FROM d JOIN w USING (r, held_out) LEFT JOIN c USING (w), s GROUP BY r, doc_id, held_out"""


def url_sql(rules: list[tuple[str, str]], pages: str = "pages", damping: float = 0.85, rounds: int = 120) -> str:
    """The verdicts on a relation of pages.  Ranks are sums over walks: what starts at the seeds is passed on
    along links round by round, and all that a host ever gets is added up."""
    split = [(v, *r.partition("/")[::2]) for v, r in rules]
    values = ", ".join(f"('{v}', '{h}/{p}', '{h}', '/{p}')" for v, h, p in split)
    host = lambda x: f"translate(regexp_extract({x}, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}')"
    link = url_filter.LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE
rules (verdict, rule, h, p) AS (VALUES {values}),
u AS (
  SELECT row_number() OVER () AS r, page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM {pages}),
s AS (SELECT r, page_id, html, {host("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (
  SELECT s.*, rule, verdict FROM s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC NULLS LAST, rule DESC) = 1),
hosts AS (
  SELECT host, count(*) AS pages, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked
  FROM j WHERE host <> '' GROUP BY host),
seeds AS (
  SELECT 'trust' AS kind, host, allowed AS mass FROM hosts WHERE 2 * allowed > pages
  UNION ALL SELECT 'distrust', host, blocked FROM hosts WHERE 2 * blocked > pages),
links AS (
  SELECT src, dst, count(*) AS n
  FROM (SELECT src, {host("substr(link, instr(link, '//') + 2)")} AS dst
        FROM (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM s))
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
edges AS (
  SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM links
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links),
walks AS (
  SELECT 0 AS i, kind, host, CAST(mass / sum(mass) OVER (PARTITION BY kind) AS DOUBLE) AS mass FROM seeds
  UNION ALL
  SELECT any_value(i) + 1, w.kind, e.dst, sum({damping} * mass * share)
  FROM walks w JOIN edges e ON w.kind = e.kind AND w.host = e.src WHERE i < {rounds} GROUP BY w.kind, e.dst),
ranks AS (SELECT kind, host, sum(mass) / sum(sum(mass)) OVER (PARTITION BY kind) AS rank FROM walks GROUP BY kind, host),
scores AS (
  SELECT host, coalesce(max(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(max(rank) FILTER (kind = 'distrust'), 0) AS distrust
  FROM ranks GROUP BY host)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN distrust > 0 AND distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN scores USING (host)
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def search_sql(documents: str = "documents", benchmark: str = "benchmark", k: int = 50) -> str:
    """Every score of every text with a term of an item."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM {documents}),
s AS (SELECT count(*) AS n_all, sum(len(t)) AS l_all FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_all),
m AS (SELECT r, doc_id, 50 + CAST((50 * CAST(len(t) AS HUGEINT) * n_all) // l_all AS BIGINT) AS m FROM d, s WHERE len(t) > 0),
q AS (SELECT i, item_id, unnest(list_distinct(t)) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM {benchmark})),
x AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER b AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
WINDOW b AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) QUALIFY rank <= {k}
"""


def leaks_sql(documents: str = "documents", benchmark: str = "benchmark", n: int = 10) -> str:
    """Windows of documents of all lengths that windows of items have, joined by their words."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM {documents}),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_TERMS} AS t FROM {benchmark}),
w AS (SELECT DISTINCT item, least(len(t), {n}) AS size, array_to_string(t[k:k + least(len(t), {n}) - 1], ' ') AS words
      FROM (SELECT item, t, unnest(range(1, len(t) - least(len(t), {n}) + 2)) AS k FROM i WHERE len(t) > 0)),
g AS (SELECT r, k, size, array_to_string(t[k:k + size - 1], ' ') AS words
      FROM (SELECT r, size, t, unnest(range(1, len(t) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM w) WHERE len(t) >= size)),
f AS (SELECT r, k, size, item FROM g JOIN w USING (size, words)),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + size)) AS at FROM f) GROUP BY r),
e AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN e USING (r)
"""


def runs_sql(documents: str = "documents", least: int = 12) -> str:
    """Places of equal factors of half the least length, a period apart; each stretch of them is a run."""
    half = -(-least // 2)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS t,
         {_CRC32.format("CAST(doc_id AS VARCHAR)")} AS h
  FROM {documents}),
a AS (SELECT *, len(t) AS n, CASE WHEN h % 10 = 0 AND len(t) > 0 THEN (h // 10) % len(t) END AS a FROM d),
b AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
c AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN t ELSE list_transform(range(0, n), lambda i: t[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS t FROM b),
g AS (SELECT r, i, array_to_string(t[i + 1:i + {half}], ' ') AS words FROM (SELECT r, t, unnest(range(0, n - {half - 1})) AS i FROM c WHERE n >= {half})),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.words = y.words AND x.i < y.i),
s AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
f AS (SELECT r, q, min(i) AS start, max(i) + {half} + q AS stop FROM s GROUP BY r, q, island HAVING max(i) + {half} - min(i) >= greatest(q, {least} - q)),
u AS (SELECT r, start, stop - start AS length, min(q) AS period FROM f GROUP BY r, start, stop),
v AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         min({{'l': -length, 's': start, 'p': period}}) AS top
  FROM u GROUP BY r),
k AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
o AS (SELECT r, list(i) AS dropped FROM k GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(-top.l AS BIGINT) AS length, CAST(top.p AS BIGINT) AS period,
       CAST(1000 * -top.l // top.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN dropped IS NULL THEN t ELSE list_filter(t, lambda x, i: NOT list_contains(dropped, i - 1)) END, ' ')) AS collapsed_sha256
FROM c LEFT JOIN v USING (r) LEFT JOIN o USING (r)
"""


ORACLES = {
    "op11_lexical_search": search_sql(),
    "op12_decontamination": leaks_sql(),
    "op13_periodic_runs": runs_sql(),
    "op3_url_filter": url_sql(url_filter.PAGE_RULES),
    "op4_mixing": f"WITH {mixing_sql()} SELECT * EXCLUDE (text, n_chars) FROM mixed",
    "op6_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
    "op9_near_duplicates": near_sql(),
    "op8_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM d LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words) AS kept
FROM m
""",
}
