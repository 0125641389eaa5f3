"""One query for each operator, over its whole table with production parameters, and the SQL for its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._base import table, word_count, written
from .chat import CLOSE, OPEN, perspectives
from .decontaminate import leaks
from .divergence import source_divergence
from .minhash import minhash_components
from .mixing import mixed
from .neighbours import nearest
from .quality import RISK, quality_verdicts
from .repeats import without_repeats
from .resample import resampled
from .tokens import token_output
from .toxicity import toxicity_scores
from .urls import url_verdicts
from .warc import warc_round_trip

#: (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), ngram=3, numerator=85, denominator=100)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    out = mixed(sizes)
    return out.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).alias("taken"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_minhash, op2_quality, op3_chat, op4_repeats, op5_mixture, op6_urls, op7_decontaminate, op8_tokens, op9_warc, op10_toxicity, op11_resample, op12_neighbours, op13_divergence, pipeline)}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""


def _op2() -> str:
    ratio = {"symbol_ratio": "n_symbols::DOUBLE / greatest(word_chars, 1)", "dup_line_ratio": "n_dup_lines::DOUBLE / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words::DOUBLE / greatest(n_words, 1)", "bang_ratio": "n_bangs::DOUBLE / greatest(word_chars, 1)"}
    a, steps = RISK.alpha, list(enumerate(RISK.steps()))
    rejected = " UNION ALL ".join(f"SELECT lang, {i} AS i, count(*) FILTER ({f} > {c}) AS n FROM free GROUP BY lang" for i, (f, c) in steps)
    hits = " UNION ALL ".join(f"SELECT doc_id, good.lang, r FROM good JOIN path ON path.lang IS NOT DISTINCT FROM good.lang AND i = {i} WHERE {f} > {c}" for i, (f, c) in steps)
    tail = f"CASE WHEN k < {a} * n THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a}) + (n - i) * ln(1 - {a})))) ELSE 1 END"
    fails = " OR ".join(f"coalesce({f} > (SELECT min(cut) FROM safe WHERE safe.lang IS NOT DISTINCT FROM x.lang AND safe.f = '{f}'), false)" for f in RISK.grid)
    return rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
stat AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(line.n - line.u, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(line.n, 0) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_bangs
    FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id LEFT JOIN line ON line.doc_id = w.doc_id),
x AS (SELECT *, {', '.join(f'{e} AS {f}' for f, e in ratio.items())}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stat),
l AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
good AS (SELECT x.* FROM x JOIN l ON l.doc_id = x.doc_id WHERE q = 1 AND NOT base_failed),
free AS (SELECT x.* FROM x ANTI JOIN l ON l.doc_id = x.doc_id WHERE NOT base_failed),
step(i, f, cut) AS (VALUES {', '.join(f"({i}, '{f}', {c}::DOUBLE)" for i, (f, c) in steps)}),
n AS (SELECT lang, count(*) AS n FROM good GROUP BY lang),
path AS (SELECT n.lang, step.*, row_number() OVER (PARTITION BY n.lang ORDER BY coalesce(j.n, 0), step.i) AS r FROM n CROSS JOIN step LEFT JOIN ({rejected}) j ON j.lang IS NOT DISTINCT FROM n.lang AND j.i = step.i),
first AS (SELECT doc_id, lang, min(r) AS r FROM ({hits}) GROUP BY doc_id, lang),
tests AS (SELECT path.lang, path.r, any_value(n.n) AS n, count(first.doc_id) AS k FROM path JOIN n ON n.lang IS NOT DISTINCT FROM path.lang LEFT JOIN first ON first.lang IS NOT DISTINCT FROM path.lang AND first.r <= path.r GROUP BY path.lang, path.r),
went AS (SELECT lang, max(r) AS r FROM tests WHERE {tail} <= {RISK.delta} / (SELECT count(*) FROM n) GROUP BY lang),
safe AS (SELECT path.* FROM path JOIN went ON went.lang IS NOT DISTINCT FROM path.lang AND path.r <= went.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {fails}) AS kept FROM x
"""


_OP3 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.conv_id, perspective, turn, speaker, text, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN speaker <> 'system' AND speaker <> perspective THEN regexp_replace(replace(speaker, '<|im_', '< |im_'), '[\r\n]+', ' ', 'g') END AS name FROM t JOIN p ON p.conv_id IS NOT DISTINCT FROM t.conv_id),
h AS (SELECT *, '{OPEN}' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '{CLOSE}' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS position, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text))
SELECT conv_id, perspective, position::BIGINT AS position, turn, role, name, segment, (role = 'assistant')::INT AS mask, start,
    CASE WHEN role = 'assistant' THEN start + length(head) END::BIGINT AS train_start, CASE WHEN role = 'assistant' THEN start + length(segment) - 1 END::BIGINT AS train_end FROM o
"""

_OP4 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN f ON f.g = win.g AND f.d < win.doc_id, (SELECT unnest(range(0, 13)) AS k)),
word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_OP5 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, coalesce('=' || source, '') AS key FROM documents),
s AS (SELECT source, key, sum(size)::BIGINT AS ss FROM d GROUP BY source, key),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
c AS (SELECT *, 2 * ss AS cap, (2 * ss)::DOUBLE / w::DOUBLE AS ratio, sum(ss) OVER () AS every_size, sum(w) OVER () AS every_w FROM w),
v AS (SELECT *, (1.5 * every_size::DOUBLE - (sum(cap) OVER o - cap)::DOUBLE) / (every_w - sum(w) OVER o + w)::DOUBLE AS level FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min(level, ratio) AS level FROM v WHERE level <= ratio),
g AS (SELECT v.source, v.key, ss, CASE WHEN ratio < l.level THEN cap::DOUBLE ELSE l.level * w::DOUBLE END AS target FROM v, l),
r AS (SELECT doc_id, size, ss, target, CASE WHEN ss > 0 THEN target / ss::DOUBLE ELSE 0 END AS rate, ('0x' || substr(md5('mix:' || d.key), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u,
    row_number() OVER (PARTITION BY d.key ORDER BY size, doc_id) AS k FROM d JOIN g ON g.key = d.key)
SELECT doc_id, size, ss AS source_size, target, ((floor(k::DOUBLE * rate + u) - floor((k - 1)::DOUBLE * rate + u))::BIGINT * size)::BIGINT AS taken FROM r
"""


def _op6() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return rf"""
WITH rules(h, p, v) AS (VALUES {rules}),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UP}', '{_LOW}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS n FROM pages)
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(h) + length(p) DESC, length(h) DESC) = 1
"""


_OP9 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT n, d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY n, d)
SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest, CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top > page_id THEN top END AS refers_to
FROM p LEFT JOIN m ON m.n = p.n AND m.d = p.d
"""

#: CRC-32 of a word's bytes, a byte at a time through the table of its polynomial.
_OP11 = rf"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
x AS (SELECT r, unnest(w) AS w FROM d),
word AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM x UNION SELECT w FROM b)),
hash AS (SELECT w, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM word, crc),
s AS (SELECT bucket, count(*) AS s FROM x JOIN hash USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN hash USING (w) GROUP BY bucket),
tot AS (SELECT (SELECT count(*) FROM x)::DOUBLE AS ss, (SELECT count(*) FROM b)::DOUBLE AS tt),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000))))::BIGINT AS g FROM (SELECT unnest(range(0, 10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), tot),
doc AS (SELECT r, sum(g)::BIGINT AS g FROM x JOIN hash USING (w) JOIN gain USING (bucket) GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n, coalesce((g - ((g % len(w)) + len(w)) % len(w)) // len(w), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN doc USING (r)),
score AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM f)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= 20 THEN CASE WHEN row_number() OVER o <= 10 * count(*) FILTER (n >= 20) OVER () // 100 THEN row_number() OVER o END END AS rank FROM score WINDOW o AS (ORDER BY n >= 20 DESC, score DESC, doc_id)
"""

_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(DISTINCT r) AS docs, count(*) AS n FROM x GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT c.lang, source, sum(c.n) AS n FROM c JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY c.lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(gn.n, 0) + 5 * v) AS p, 1 + 1000000000::HUGEINT * (k.n + 5) // (v.n + 5 * v) AS q
    FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM u WHERE part = 'pair' OR rank <= 50
"""

#: op7 aligns with edits, op8 needs the tokenizer and op10 a fitted model: tests hold them against plain versions.
ORACLES = {"op1_minhash": _OP1, "op2_quality": _op2(), "op3_chat": _OP3, "op4_repeats": _OP4, "op5_mixture": _OP5, "op6_urls": _op6(), "op9_warc": _OP9, "op11_resample": _OP11, "op13_divergence": _OP13}
