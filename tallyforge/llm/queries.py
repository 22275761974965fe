"""The registered queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, fill_in_middle, licenses, mixing, near_dedup, search, spelling, substring_dedup, suffix_dedup, toxicity, url_filter, warc, winnowing
from tallyforge.llm.common import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.describe(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "topic", "n_tokens")
    mixed = mixing.mix(cut(docs, "described"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeated(docs, window=20).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents like each one whose id is divisible by 20, by all words of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.search(search.build(docs), docs.where("doc_id % 20 = 0"), k=10)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    return left.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    made = op1_mix_sources, op2_toxicity, op3_url_filter, op4_substring_dedup, op5_search, op6_warc, op7_near_dedup, op8_licenses, op9_bpe, op10_fingerprints, op11_spelling, op12_fill_in_middle, op13_suffix_dedup
    return {f.__name__: f for f in made}


_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TOPIC = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{x}')" for x in parts) + f" THEN '{name}'" for name, parts in mixing.TOPICS) + " ELSE 'prose' END"
_GOAL = "(SELECT {0}, pow(sum(tokens), 0.7) / sum(pow(sum(tokens), 0.7)) OVER () AS goal_{0} FROM cell GROUP BY {0})"

#: Rounds of the twin: far more than these tables need; once they have settled, the rest changes nothing.
_RAKE_ROUNDS = 300

_OP1 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {_TOPIC} AS topic,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS n_tokens FROM documents),
every AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
cell AS (SELECT * FROM every WHERE tokens > 0),
goals AS (SELECT * FROM cell JOIN {_GOAL.format("source")} USING (source) JOIN {_GOAL.format("lang")} USING (lang) JOIN {_GOAL.format("topic")} USING (topic)),
ipf AS (
  SELECT 0 AS i, source, lang, topic, tokens, goal_source, goal_lang, goal_topic, tokens / sum(tokens) OVER () AS w FROM goals
  UNION ALL
  SELECT i + 1, source, lang, topic, tokens, goal_source, goal_lang, goal_topic, w * goal_topic / sum(w) OVER (PARTITION BY topic) FROM (
    SELECT * REPLACE (w * goal_lang / sum(w) OVER (PARTITION BY lang) AS w) FROM (
      SELECT * REPLACE (w * goal_source / sum(w) OVER (PARTITION BY source) AS w) FROM ipf WHERE i < {_RAKE_ROUNDS}))),
raked AS (SELECT source, lang, topic, tokens, w / sum(w) OVER () * sum(tokens) OVER () / tokens AS r FROM ipf WHERE i = {_RAKE_ROUNDS}),
ranked AS (
  SELECT *, 0.8 * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY r DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget,
    sum(tokens * r) OVER (ORDER BY r DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass FROM raked),
scale AS (SELECT arg_max(budget / mass, r) FILTER (budget / mass * r < 1) AS scale FROM ranked),
chance AS (SELECT source, lang, topic, r, least(1.0, r * scale) AS p FROM raked, scale)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(coalesce(r, 1.0), 6) AS weight, round(coalesce(p, 1.0), 6) AS probability,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 < coalesce(p, 1.0) AS sampled
FROM d LEFT JOIN chance c ON d.source = c.source AND d.lang = c.lang AND d.topic = c.topic
"""

_RULES = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = ["(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')".format(h, p) for _, h, p in _RULES]
_BY_RULE = "CASE " + " ".join(f"WHEN {fits} THEN '{v}'" for fits, (v, _, _) in zip(_FITS, _RULES, strict=True)) + " END"
_RULE = "CASE " + " ".join(f"WHEN {fits} THEN '{h}{p}'" for fits, (_, h, p) in zip(_FITS, _RULES, strict=True)) + " END"
_M = url_filter.SMOOTHING
_LEVEL = """
l{k} AS (SELECT g.gram, (g.a + {m} * s.pa) / (c.a + {m}) AS pa, (g.b + {m} * s.pb) / (c.b + {m}) AS pb
  FROM gram g JOIN l{j} s ON s.gram = g.gram[2:] JOIN context c ON c.gram = g.gram[:-2] WHERE length(g.gram) = {k} + 1),"""
_RATIO = "coalesce(r{k}.ratio, coalesce(c{k}.fall, 0) + {rest})"


def _ratio(k: int) -> str:
    return "coalesce(r0.ratio, unseen)" if k == 0 else _RATIO.format(k=k, rest=_ratio(k - 1))


_OP3 = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS id FROM pages),
j AS (SELECT *, {_RULE} AS rule, {_BY_RULE} AS by_rule, md5(coalesce(CAST(page_id AS VARCHAR), ''))[1] < '8' AS fold, chr(2) || url || chr(3) AS s FROM p),
pos AS (SELECT id, by_rule, fold, s, unnest(range(2, length(s) + 1)) AS i FROM j),
run AS (SELECT by_rule, unnest(list_transform(range(0, least(i, 5)), lambda k: s[i - k:i])) AS gram FROM pos WHERE by_rule IS NOT NULL AND fold),
counted AS (SELECT gram, CAST(count(*) FILTER (by_rule = 'allow') AS DOUBLE) AS a, CAST(count(*) FILTER (by_rule = 'block') AS DOUBLE) AS b FROM run GROUP BY gram),
gram AS (SELECT * FROM counted),
n AS (SELECT sum(a) AS na, sum(b) AS nb, ln(nb + {_M}) - ln(na + {_M}) AS unseen FROM gram WHERE length(gram) = 1),
context AS (SELECT gram[:-2] AS gram, sum(a) AS a, sum(b) AS b, ln(sum(b) + {_M}) - ln(sum(a) + {_M}) AS fall FROM gram WHERE length(gram) > 1 GROUP BY 1),
l0 AS (SELECT gram, (a + {_M} / {url_filter.CHARACTERS}) / (na + {_M}) AS pa, (b + {_M} / {url_filter.CHARACTERS}) / (nb + {_M}) AS pb FROM gram, n WHERE length(gram) = 1),
{"".join(_LEVEL.format(k=k, j=k - 1, m=_M) for k in range(1, 5))}
ratio AS (SELECT gram, ln(pa) - ln(pb) AS ratio FROM ({" UNION ALL ".join(f"FROM l{k}" for k in range(5))})),
scored AS (SELECT id, avg({_ratio(4)}) AS score FROM (SELECT *, {", ".join(f"CASE WHEN i > {k} THEN s[i - {k}:i] END AS g{k}" for k in range(5))} FROM pos) CROSS JOIN n
  {" ".join(f"LEFT JOIN ratio r{k} ON r{k}.gram = g{k}" for k in range(5))} {" ".join(f"LEFT JOIN context c{k} ON c{k}.gram = g{k}[:-2]" for k in range(1, 5))} GROUP BY id),
c AS (SELECT count(*) FILTER (by_rule = 'allow') AS na, count(*) FILTER (by_rule = 'block') AS nb, avg(score) FILTER (by_rule = 'allow') AS ma, avg(score) FILTER (by_rule = 'block') AS mb,
    var_pop(score) FILTER (by_rule = 'allow') AS va, var_pop(score) FILTER (by_rule = 'block') AS vb FROM j JOIN scored USING (id) WHERE by_rule IS NOT NULL AND NOT fold)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN (ma - mb) / greatest((na * va + nb * vb) / (na + nb), 1e-9) * (score - (ma + mb) / 2) < 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN scored USING (id), c
"""

_OP4 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words FROM documents),
win AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS s FROM w),
hashed AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 19], ' ')) AS h FROM win),
placed AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM hashed),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM placed WHERE k > 1),
lost AS (SELECT doc_id, list(i) AS lost FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS i FROM w),
kept AS (
  SELECT e.doc_id, list(e.words[e.i] ORDER BY e.i) AS left_over
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(len(l.lost), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(k.left_over, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

_OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
each AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id > b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT e.a, r.root FROM reach r JOIN edge e ON r.doc_id = e.b WHERE r.root < e.a),
top AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN top USING (doc_id)
"""


_OP6 = """
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS hex, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS head FROM p),
bits AS (SELECT DISTINCT hex, list_transform(range(0, 40), lambda i: CAST('0x' || hex[i + 1] AS INTEGER)) AS x FROM h),
five AS (
  SELECT hex, array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(1 + list_sum(list_transform(range(0, 5), lambda k:
      ((x[((5 * i + k) // 4) + 1] >> (3 - (5 * i + k) % 4)) & 1) << (4 - k))) AS BIGINT)]), '') AS b32 FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM h JOIN five USING (hex)
"""


_LICENSE_WORD = licenses.WORD


def _template_sql(markup: str) -> tuple[list[str], str]:
    """A template's first mandatory words, and a pattern for its words with a space after each."""
    out, lead, depth = "", [], 0
    for i, part in enumerate(licenses.MARK.split(markup)):
        if i % 2 and part == "beginOptional":
            depth += 1
            out += "(?:" if lead else ""
        elif i % 2 and part == "endOptional":
            depth -= 1
            out += ")?" if lead else ""
        elif i % 2:
            out += "(?:[^ ]+ ){0,%s}" % part.partition("max=")[2] if "max=" in part else "(?:[^ ]+ )*"
        elif lead or not depth:
            own = [w.lower() for w in re.findall(_LICENSE_WORD, part.lower())]
            lead = lead or own
            out += "".join(f"{w} " for w in own)
    return lead, out


def _places(label: str, phrase: list[str], base: bool, size: str) -> str:
    m = len(phrase)
    same = "array_to_string(words[i + 1:i + {0}], ' ') = '{1}'".format(m, " ".join(phrase))
    return f"SELECT doc_id, '{label}' AS label, {base} AS base, i AS first, {size} AS size FROM (SELECT doc_id, words, unnest(list_filter(range(0, greatest(len(words) - {m - 1}, 0)), lambda i: {same})) AS i FROM w WHERE contains(line, ' {' '.join(phrase)} '))"


_FOUND = " UNION ALL ".join(
    [_places(label, text.split(), True, str(len(text.split()))) for label, text in licenses.PHRASES]
    + [_places(label, lead, False, f"len(string_split(regexp_extract(array_to_string(words[i + 1:], ' ') || ' ', '^{pattern}'), ' ')) - 1") for label, (lead, pattern) in ((x, _template_sql(t)) for x, t in licenses.TEMPLATES)]
)
_OP8 = rf"""
WITH w AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS line FROM (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LICENSE_WORD}') AS words FROM documents)),
f AS (SELECT * FROM ({_FOUND}) WHERE size > 0),
c AS (SELECT doc_id, count(DISTINCT pos) AS covered FROM (SELECT doc_id, unnest(range(first, first + size)) AS pos FROM f) GROUP BY 1),
b AS (SELECT doc_id, count(*) FILTER (base) AS n, min(first) FILTER (base) AS lo, max(first) FILTER (base) AS hi, list_sort(list_distinct(list(label) FILTER (base))) AS base_labels, list_sort(list_distinct(list(label))) AS labels FROM f GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, lo AS first_word, hi AS last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(labels, ','), '') AS labels, coalesce(covered, 0) / CAST(greatest(len(words), 1) AS DOUBLE) AS score FROM w LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""


_OP11 = rf"""
WITH RECURSIVE raw AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, {_LOWER.format(f"unnest(regexp_extract_all(coalesce(text, ''), '{spelling.LETTERS}'))")} AS run FROM documents),
each AS (SELECT id, run, count(*) AS n FROM raw GROUP BY ALL),
-- the table of the CRC-32, each entry by eight shifts of its number
crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entry FROM range(256) r(i)),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT))),
    lambda c, b: xor(c >> 8, entry[1 + (xor(c, b) & 255)]))) AS h
  FROM (SELECT run, n, hex(encode(id || ':' || run)) AS h FROM each), crc),
w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
link AS (
  SELECT DISTINCT x.word AS a, y.word AS b FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM w) UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM w)),
near AS (SELECT a AS word, count(*) AS n_near, max(n) AS top FROM link JOIN w ON b = w.word GROUP BY a),
best AS (SELECT a AS word, min(b) AS form, top AS form_n, n_near FROM link JOIN w ON b = w.word JOIN near ON a = near.word AND n = top GROUP BY ALL),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL),
last AS (SELECT walk.word, root FROM walk JOIN f ON root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
"""

_OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS unit,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
g AS (SELECT *, len(unit) AS n, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT)) AS r FROM d),
c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(unit[:a], '') AS pre, array_to_string(unit[a + 1:b], '') AS mid, array_to_string(unit[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

_OP13 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS row FROM documents),
s AS (SELECT row, doc_id, unnest(range(1, len(h) // 2 - 48)) AS i, h FROM d),
w AS (SELECT row, doc_id, i, md5(substr(h, 2 * i - 1, 100)) AS k FROM s),
f AS (SELECT k, min(coalesce(doc_id, -9223372036854775807)) AS first FROM w GROUP BY k),
again AS (SELECT row, i FROM w JOIN f USING (k) WHERE coalesce(doc_id, -9223372036854775807) > first),
-- windows that touch or overlap make one removed run
turn AS (SELECT row, i, CASE WHEN i - lag(i) OVER o <= 50 THEN 0 ELSE 1 END AS turn FROM again WINDOW o AS (PARTITION BY row ORDER BY i)),
run AS (SELECT row, i, sum(turn) OVER (PARTITION BY row ORDER BY i) AS run FROM turn),
span AS (SELECT row, run, min(i) AS lo, max(i) + 50 AS past FROM run GROUP BY ALL),
gap AS (SELECT row, lo, past, lag(past, 1, 1) OVER (PARTITION BY row ORDER BY lo) AS begin FROM span),
kept AS (SELECT row, count(*) AS n, sum(past - lo) AS lost, string_agg(h[2 * begin - 1:2 * lo - 2], '' ORDER BY lo) || any_value(h)[2 * max(past) - 1:] AS h FROM gap JOIN d USING (row) GROUP BY row)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _OP1, "op3_url_filter": _OP3, "op4_substring_dedup": _OP4, "op6_warc": _OP6, "op7_near_dedup": _OP7, "op8_licenses": _OP8, "op11_spelling": _OP11, "op12_fill_in_middle": _OP12, "op13_suffix_dedup": _OP13}
