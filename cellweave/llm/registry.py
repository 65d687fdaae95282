"""The queries of this subpackage and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cellweave.llm.packing import pack

    pieces = pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), longest=1024, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op5_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), words=4, bits=4)


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.crf_quality import score, train

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)))
    model = train(docs.where(~F.col("held_out")), _read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model, keep=["doc_id", "held_out"])


#: Fixed values of the query's rules.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op3_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.url_templates import judge

    return judge(_read(spark, sf_dir, "pages"), RULES)


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.secrets_link import digest

    return digest(_read(spark, sf_dir, "documents"))


def op6_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.warc_store import round_trip

    return round_trip(_read(spark, sf_dir, "pages"), least=100)


def op7_pstable_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.pstable import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_ftrl_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.langid import predict, train

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    docs = docs.withColumn("held_out", F.coalesce(out, F.lit(False)))
    model = train(docs.where(~F.col("held_out")).select("text", "lang"))
    return predict(docs, model, keep=["doc_id", "held_out"])


def op9_pigeonhole_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.decontam import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm.licenses import scan, train

    docs = _read(spark, sf_dir, "documents")
    return scan(docs, train(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pow2_packing, op2_crf_quality, op3_url_template_tree, op4_secret_links, op5_simhash_gph, op6_warc_store, op7_pstable_embeddings, op8_ftrl_langid, op9_pigeonhole_decontam, op10_license_scan)}


_OP6 = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha256(coalesce(html, '')) AS g FROM pages),
f AS (SELECT g, min(page_id) AS first FROM d GROUP BY 1)
SELECT page_id, b::BIGINT AS payload_bytes, g AS payload_digest,
  CASE WHEN b >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 100 AND page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (g)
"""


def _rule_case(value: int) -> str:
    """The rules as SQL, the longest first; value 0: their names, 1: their verdicts."""
    lines = []
    for rule, verdict in sorted(RULES, key=lambda r: -len(r[0])):
        host, _, rest = rule.partition("/")
        lines.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}') THEN '{(rule, verdict)[value]}'")
    return "CASE " + " ".join(lines) + " END"


def _text(s: str) -> str:
    return f"({s} <> '' AND NOT regexp_matches({s}, '^\\{{[nht]\\}}'))"


def _level(d: int) -> str:
    """One level of the tree: from the table s{d} of paths with their prefixes to s{d + 1}."""
    seg, after, side = f"segs[{d + 1}]", f"coalesce(segs[{d + 2}], '')", "host, prefix, lead"
    return f"""
c{d} AS MATERIALIZED (SELECT host, prefix, {seg} AS seg, {after} AS after, sum(n)::BIGINT AS c FROM s{d} WHERE len(segs) > {d} AND {_text(seg)} GROUP BY ALL),
h{d} AS MATERIALIZED (SELECT host, prefix, after FROM c{d} WHERE {_text('after')} GROUP BY ALL HAVING count(*) > 1),
k{d} AS MATERIALIZED (SELECT c.host, c.prefix, seg, CASE WHEN {_text('c.after')} AND h.after IS NULL THEN '{{w}}' ELSE c.after END AS what, sum(c)::BIGINT AS c
  FROM c{d} c LEFT JOIN h{d} h ON c.host = h.host AND c.prefix = h.prefix AND c.after = h.after GROUP BY ALL),
b{d} AS MATERIALIZED (SELECT host, prefix, seg, sum(c)::BIGINT AS size, count(*) AS kinds, max({{'c': c, 'what': what}}).what AS lead FROM k{d} GROUP BY host, prefix, seg),
f{d} AS MATERIALIZED (SELECT host, prefix, lead, max({{'size': size, 'seg': seg, 'kinds': kinds}}) AS top FROM b{d} GROUP BY host, prefix, lead HAVING count(*) > 1),
t{d} AS MATERIALIZED (SELECT f.host, f.prefix, f.lead, what, c AS t FROM k{d} k JOIN f{d} f ON k.host = f.host AND k.prefix = f.prefix AND k.seg = f.top.seg),
g{d} AS MATERIALIZED (SELECT b.host, b.prefix, b.lead, b.seg, b.size, f.top.size AS top_size, f.top.kinds AS top_kinds, k.c, t.t
  FROM b{d} b JOIN f{d} f USING ({side}) JOIN k{d} k ON k.host = b.host AND k.prefix = b.prefix AND k.seg = b.seg
  LEFT JOIN t{d} t ON t.host = b.host AND t.prefix = b.prefix AND t.lead = b.lead AND t.what = k.what WHERE b.seg <> f.top.seg),
q{d} AS MATERIALIZED (SELECT {side}, seg, 2 * (sum(c * ln(c / ((c + coalesce(t, 0))::DOUBLE * size / (size + top_size))) + CASE WHEN t > 0 THEN t * ln(t / ((c + t)::DOUBLE * top_size / (size + top_size))) ELSE 0 END)
  + (top_size - sum(coalesce(t, 0))) * ln((size + top_size) / top_size::DOUBLE)) AS g, count(*) FILTER (WHERE t IS NULL) + top_kinds - 1 AS df FROM g{d} GROUP BY {side}, seg, size, top_size, top_kinds),
l{d} AS MATERIALIZED (SELECT {side}, seg FROM q{d} WHERE g - df <= 3 * sqrt(greatest(1, 2 * df))),
m{d} AS MATERIALIZED (SELECT host, prefix, seg, '{{~' || lead || '}}' AS token FROM (SELECT * FROM l{d} UNION SELECT host, prefix, lead, top.seg FROM f{d} SEMI JOIN l{d} USING ({side}))),
s{d + 1} AS MATERIALIZED (SELECT s.host, path, n, good, bad, segs, CASE WHEN {seg} IS NULL THEN s.prefix ELSE s.prefix || '/' || coalesce(token, {seg}) END AS prefix, CASE WHEN token IS NULL THEN stratum ELSE stratum || '/' || {seg} END AS stratum
  FROM s{d} s LEFT JOIN m{d} m ON s.host = m.host AND s.prefix = m.prefix AND m.seg = {seg}),"""


_LEVELS = 8
_OP3 = f"""
WITH raw AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM raw),
ruled AS MATERIALIZED (SELECT *, {_rule_case(0)} AS rule, {_rule_case(1)} AS ruled FROM split),
paths AS (SELECT host, path, count(*) AS n, count(*) FILTER (WHERE ruled = 'allow') AS good, count(*) FILTER (WHERE ruled = 'block') AS bad FROM ruled GROUP BY 1, 2),
cut AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS words FROM paths),
look AS (SELECT *, list_transform(words, lambda s: regexp_extract(s, '(\\.[A-Za-z]{{1,5}})$', 1)) AS exts, list_transform(words, lambda s: regexp_replace(s, '\\.[A-Za-z]{{1,5}}$', '')) AS stems FROM cut),
s0 AS MATERIALIZED (SELECT host, path, n, good, bad, list_transform(range(1, len(words) + 1), lambda i:
  CASE WHEN regexp_matches(stems[i], '^[0-9]+$') THEN '{{n}}' || exts[i]
    WHEN regexp_matches(stems[i], '^[0-9A-Fa-f-]{{8,}}$') AND regexp_matches(stems[i], '[0-9]') AND regexp_matches(stems[i], '[A-Za-z]') THEN '{{h}}' || exts[i]
    WHEN regexp_matches(stems[i], '[0-9]') AND regexp_matches(stems[i], '[A-Za-z]') AND length(stems[i]) >= 12 THEN '{{t}}' || exts[i]
    ELSE words[i] END) AS segs, '' AS prefix, '' AS stratum FROM look),
{"".join(map(_level, range(_LEVELS)))}
templates AS MATERIALIZED (SELECT host, path, n, good, bad, stratum, host || prefix || list_aggregate(list_transform(segs[{_LEVELS + 1}:], lambda s: '/' || s) || [''], 'string_agg', '')
  || CASE WHEN len(segs) = 0 OR ends_with(path, '/') THEN '/' ELSE '' END AS template FROM s{_LEVELS}),
strata AS (SELECT template, stratum, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, (sum(good) + sum(bad))::BIGINT AS known FROM templates GROUP BY 1, 2),
sums AS (SELECT template, sum(n)::BIGINT AS n, sum(known)::BIGINT AS labels, count(*) FILTER (WHERE known > 0) AS strata, sum(CASE WHEN known > 0 THEN bad / known::DOUBLE ELSE 0 END) AS shares,
  sum(n * bad / (known + 2::DOUBLE)) AS own, sum(n * 2::DOUBLE / (known + 2::DOUBLE)) AS pulled FROM strata GROUP BY 1),
score AS (SELECT template, labels, floor((own + (shares + 0.2::DOUBLE) / (strata + 2::DOUBLE) * pulled) / n * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS purity FROM sums)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, CASE WHEN labels >= 5 AND purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, template, purity::DOUBLE AS purity
FROM ruled r JOIN templates t ON r.host = t.host AND r.path = t.path JOIN score USING (template)
"""


_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_OP7 = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings WHERE {_FINITE}),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, m.b AS component_id, vec_id = m.b AS kept
FROM embeddings JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    """The other queries train models, hash or search in ways SQL can't express: tests/llm compares
    them with brute force, round trips and held-out labels."""
    return {"op3_url_template_tree": _OP3, "op6_warc_store": _OP6, "op7_pstable_embeddings": _OP7}
