"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneguard.llm.ann import nearest_neighbours
from laneguard.llm.line_dedup import dedup_lines
from laneguard.llm.merkle import manifest
from laneguard.llm.mixing import mix_sources
from laneguard.llm.near_vectors import near_vectors
from laneguard.llm.ngram_join import ngram_components
from laneguard.llm.packing import pack_documents
from laneguard.llm.phrases import collocations
from laneguard.llm.quality import held_out, score_quality
from laneguard.llm.registry import CHECKS, QUERIES, query, table
from laneguard.llm.secrets import scan_secrets
from laneguard.llm.sharding import shard_by_bytes
from laneguard.llm.substring import remove_repeats
from laneguard.llm.url_filter import hosts_with_words, judge_urls

__all__ = ["CHECKS", "QUERIES"]

WEIGHTS = [("domain", "domain0", 4), ("domain", "domain1", 3), ("domain", "domain2", 2), ("domain", "domain3", 1),
           ("lang", "en", 6), ("lang", "de", 2), ("lang", "fr", 2), ("lang", "es", 1), ("source", "src0", 2)]
"""Target weights of the domain - language - source tree (level, node, weight among its siblings)."""


def weights_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "level string, name string, weight long")


def domain_of(source="source"):
    """Four domains by the number in the source's name."""
    return F.concat(F.lit("domain"), F.pmod(F.coalesce(F.regexp_extract(F.col(source), "([0-9]+)$", 1).try_cast("int"), F.lit(0)), F.lit(4)))


@query("op1_pack_documents")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


_COMPONENTS_SQL = """reach(n, m) AS (SELECT a, b FROM links UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a),
smallest AS (SELECT n, min(m) AS m FROM reach GROUP BY n)"""

NEAR_SQL = f"""WITH RECURSIVE able AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id a, b.vec_id b FROM able a JOIN able b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
{_COMPONENTS_SQL}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id)::BIGINT n_links, least(e.vec_id, coalesce(s.m, e.vec_id)) component_id,
    least(e.vec_id, coalesce(s.m, e.vec_id)) = e.vec_id kept FROM embeddings e LEFT JOIN smallest s ON s.n = e.vec_id"""


@query("op2_near_vectors", NEAR_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op3_dedup_lines")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op4_nearest_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


NGRAM_SQL = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) s
    FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) n FROM shingles GROUP BY doc_id),
links AS (SELECT x.doc_id a, y.doc_id b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
{_COMPONENTS_SQL}
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT n_shingles, least(d.doc_id, coalesce(s.m, d.doc_id)) component_id
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN smallest s ON s.n = d.doc_id"""


@query("op5_ngram_join", NGRAM_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


_WEIGHTS_SQL = ", ".join(f"('{a}', '{b}', {c}::BIGINT)" for a, b, c in WEIGHTS)


def _share_sql(name: str, children: str, parent: list[str], child: str) -> str:
    by = f"PARTITION BY {', '.join(parent)} " if parent else ""
    keys = ", ".join([*parent, child])
    return f"""{name}_a AS (SELECT *, coalesce(sum(cap) OVER ({by}ORDER BY cap / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT used,
        (sum(weight) OVER ({by}ORDER BY cap / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT ow FROM ({children})),
    {name}_b AS (SELECT *, cap * ow <= (pb - used) * weight AS is_full FROM {name}_a),
    {name}_c AS (SELECT *, (pb - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}))::HUGEINT rest, (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}))::HUGEINT rw FROM {name}_b),
    {name} AS (SELECT {keys}, (CASE WHEN is_full THEN cap ELSE (rest * weight) // rw END)::BIGINT budget FROM {name}_c)"""


def _weighted_sql(source: str, level: str) -> str:
    return f"SELECT x.*, coalesce(w.weight, 1)::HUGEINT weight FROM ({source}) x LEFT JOIN weights w ON w.level = '{level}' AND w.name = x.{level} WHERE coalesce(w.weight, 1) > 0"


_LEAF_CAP = "SELECT domain, lang, source, (supply * 2)::HUGEINT cap FROM leaves"
_LANG_CAP = f"SELECT domain, lang, sum(cap)::HUGEINT cap FROM ({_weighted_sql(_LEAF_CAP, 'source')}) GROUP BY ALL"
_DOMAIN_CAP = f"SELECT domain, sum(cap)::HUGEINT cap FROM ({_weighted_sql(_LANG_CAP, 'lang')}) GROUP BY ALL"
MIX_SQL = f"""WITH weights(level, name, weight) AS (VALUES {_WEIGHTS_SQL}),
docs AS (SELECT doc_id, 'domain' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER), 0) % 4) AS domain, coalesce(lang, '(none)') lang,
    coalesce(source, '(none)') source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT supply FROM docs GROUP BY ALL),
{_share_sql("d1", f"SELECT w.*, least((SELECT sum(supply) * 3 // 5 FROM leaves), sum(cap) OVER ())::HUGEINT pb FROM ({_weighted_sql(_DOMAIN_CAP, 'domain')}) w", [], "domain")},
{_share_sql("d2", f"SELECT w.*, d1.budget::HUGEINT pb FROM ({_weighted_sql(_LANG_CAP, 'lang')}) w JOIN d1 USING (domain)", ["domain"], "lang")},
{_share_sql("d3", f"SELECT w.*, d2.budget::HUGEINT pb FROM ({_weighted_sql(_LEAF_CAP, 'source')}) w JOIN d2 USING (domain, lang)", ["domain", "lang"], "source")},
plan AS (SELECT l.domain, l.lang, l.source, CASE WHEN supply > 0 THEN coalesce(budget, 0) // supply ELSE 0 END whole,
    coalesce(budget, 0) - CASE WHEN supply > 0 THEN coalesce(budget, 0) // supply ELSE 0 END * supply rest FROM leaves l LEFT JOIN d3 USING (domain, lang, source)),
dealt AS (SELECT docs.*, whole, rest, md5(concat_ws(':', '17', whole::VARCHAR, coalesce(doc_id::VARCHAR, ''))) o FROM docs JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, doc_id, tokens ROWS UNBOUNDED PRECEDING) upto FROM dealt)
SELECT doc_id, domain, lang, source, tokens, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::INTEGER epochs FROM summed"""


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


REPEATS_SQL = """WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) w FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 11)) i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) g FROM words WHERE len(w) >= 13),
firsts AS (SELECT g, min(doc_id) d FROM grams GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT x.doc_id, x.i FROM grams x JOIN firsts f ON f.g = x.g AND f.d < x.doc_id), range(0, 13) r(j)),
flat AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) t FROM flat ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT n_words, coalesce(l.n, 0)::BIGINT n_removed, sha256(coalesce(k.t, '')) kept_sha256
FROM words w LEFT JOIN lost l USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


@query("op8_remove_repeats", REPEATS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op9_mix_sources", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights_table(spark), domain_of())


@query("op10_shard_documents")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def _manifest_sql(levels: int = 8, fanout: int = 8) -> str:
    """Levels are spelled out; a group that has one node left passes it on (``levels`` allow fanout ** levels rows)."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]), lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""docs AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS changed FROM documents),
    leaves AS (SELECT doc_id, lang, leaf, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM docs),
    n0 AS (SELECT lang g, idx i, leaf h FROM leaves), p0 AS (SELECT doc_id, leaf, lang g, idx i, changed f, '' AS sib FROM leaves)"""]

    def climb(n: str, p: str, k: str, extra: str) -> str:
        return f"""k{k} AS (SELECT g, i // {fanout} AS i, list(h ORDER BY i) AS kids FROM {n} WHERE g IN (SELECT g FROM {n} GROUP BY g HAVING count(*) > 1) GROUP BY 1, 2
            UNION ALL SELECT NULL, i // {fanout}, list(h ORDER BY i) FROM {n} WHERE g IS NULL AND (SELECT count(*) FROM {n} WHERE g IS NULL) > 1 GROUP BY 2),
        n{k} AS (SELECT g, i, sha256(array_to_string(kids, '')) h FROM k{k} UNION ALL SELECT n.g, n.i, n.h FROM {n} n WHERE NOT EXISTS (SELECT 1 FROM k{k} WHERE k{k}.g IS NOT DISTINCT FROM n.g)),
        p{k} AS (SELECT doc_id, leaf{extra}, p.g, p.i // {fanout} i,
            CASE WHEN kids IS NULL THEN f ELSE sha256(array_to_string(list_concat(list_append(kids[:p.i % {fanout}], f), kids[p.i % {fanout} + 2:]), '')) END f,
            CASE WHEN kids IS NULL THEN sib ELSE sib || array_to_string(list_concat(kids[:p.i % {fanout}], kids[p.i % {fanout} + 2:]), '') END sib
            FROM {p} p LEFT JOIN k{k} k ON k.g IS NOT DISTINCT FROM p.g AND k.i = p.i // {fanout})"""

    for k in range(1, levels + 1):
        steps.append(climb(f"n{k - 1}", f"p{k - 1}", str(k), ""))
    steps.append(f"""t AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM n{levels}),
    n100 AS (SELECT 0 AS g, i, subroot AS h FROM t), p100 AS (SELECT doc_id, leaf, subroot, 0 AS g, t.i, f, sib FROM p{levels} p JOIN t ON t.lang IS NOT DISTINCT FROM p.g)""")
    for k in range(101, 104):
        steps.append(climb(f"n{k - 1}", f"p{k - 1}", str(k), ", subroot"))
    return f"""WITH {", ".join(steps)}
    SELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = h AS verified FROM p103, n103"""


@query("op11_merkle_manifest", _manifest_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
"""Rules on urls (host, start of path, verdict)."""
BLOCKED_WORDS = ["spam", "pills", "casino", "bets", "betting", "viagra", "escort", "warez", "torrent"]
"""A host with one of these words in its name is listed."""
URL_SQL = f"""WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, RULES))}),
urls AS (SELECT page_id, row_number() OVER () AS r, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
listed AS (SELECT DISTINCT host FROM urls WHERE len(list_intersect(regexp_split_to_array(host, '[.-]'), {BLOCKED_WORDS})) > 0),
bad AS (SELECT DISTINCT r FROM urls u JOIN listed l ON u.host = l.host OR suffix(u.host, '.' || l.host)),
fits AS (SELECT r, arg_max(rules.host || rules.path, (length(rules.host || rules.path), length(rules.host))) AS rule, arg_max(verdict, (length(rules.host || rules.path), length(rules.host))) AS verdict
    FROM urls u JOIN rules ON (u.host = rules.host OR suffix(u.host, '.' || rules.host)) AND prefix(u.path, rules.path) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad.r IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM urls LEFT JOIN fits USING (r) LEFT JOIN bad USING (r)"""


@query("op12_url_filter", URL_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), hosts_with_words(pages, BLOCKED_WORDS))


PHRASES_SQL = """WITH pieces AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)),
spans AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM spans GROUP BY ALL),
totals AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, w, a, c, array_to_string(w[:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM cand, (SELECT unnest([1, 2]) AS c) WHERE c < k),
scored AS (SELECT cuts.*, l.f AS l, r.f AS r, 1000000 * a * a // (l.f * r.f) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM cand WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


@query("op13_phrases", PHRASES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
