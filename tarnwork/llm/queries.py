"""The queries that apply each operator to its whole table, and DuckDB SQL for them where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL_OP2 = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""


#: Host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import url_rules

    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


SQL_OP1 = r"""
WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS k,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
m AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (k)
"""


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import read_tokens, token_folder, write_tokens

    manifest = write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), token_folder(spark), public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(manifest, keep=False)


def op4_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), keep=False)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_folder, read_warc, write_warc

    manifest = write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), archive_folder(spark))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_OP5 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY b) AS first FROM p),
bits AS (SELECT *, list_transform(range(32), lambda i: ((('0x' || substr(hex, (i * 5 // 4) + 1, 2) || '0')::INT >> (7 - (i * 5) % 4)) & 31)) AS v FROM d)
SELECT page_id, payload_bytes, list_aggregate(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM bits
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, open_ledger, scan_into

    findings = scan_into(table(spark, sf_dir, "documents").select("doc_id", "text"), open_ledger(spark))
    said = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return findings.select(F.col("path").alias("doc_id"), *map(count, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def _sql_op7() -> str:
    from .secrets import BASE, RULES

    each, cols = [], []
    for rank, (kind, _, pattern, group, least, needs) in enumerate(RULES):
        p, needs = pattern.replace("'", "''"), needs.replace("'", "''")
        whole, part = f"regexp_extract_all(text, '{p}')", f"regexp_extract_all(text, '{p}', {group})"
        each.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, unnest({whole}) AS m, unnest({part}) AS g, "
            f"unnest(regexp_split_to_array(text, '{p}')[1:len({whole})]) AS gap, generate_subscripts({whole}, 1) AS i FROM documents WHERE regexp_matches(text, '{needs}')"
        )
    for kind in BASE:
        cols.append(f"count(*) FILTER (kind = '{kind}') AS n_{kind}")
    base = ", ".join(f"'{k}'" for k in BASE)
    said = "string_agg(kind || ':' || (e - length(m)) || ':' || e, ',' ORDER BY e - length(m), rank)"
    return f"""
WITH x AS ({' UNION ALL '.join(each)}),
s AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM x),
f AS (SELECT doc_id, {', '.join(cols)}, {said} FILTER (kind IN ({base})) AS b, {said} AS spans FROM s WHERE length(g) >= least GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN f USING (doc_id)
"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the weight that its quality label asks for."""
    w = F.max(F.when(F.col("quality") == 1, 2.0).otherwise(0.5)).alias("w")
    return table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("labelled")).agg(w)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, sizes_of

    sizes = sizes_of(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("w")
    sizes = sizes.join(_quality(spark, sf_dir), F.col("doc_id") == F.col("labelled"), "left").withColumn("w", F.coalesce("w", F.lit(1.0))).drop("labelled")
    return mix(sizes).drop("copies")


SQL_OP8 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM labels GROUP BY doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
t AS (SELECT source, source_size, least(cap, weight * greatest(max(level) OVER (), 0)) AS target FROM o),
k AS (SELECT d.doc_id, size, d.source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
  -ln((('0x' || substr(md5('0:' || d.doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) * pow(2, -52)) / coalesce(w, 1) AS key FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN q USING (doc_id)),
u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN size > 0 AND upto - size / 2 < target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM u
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


SQL_OP9 = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, pos, lines[pos:pos + 2] AS win FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM l)
  WHERE len(list_filter(lines[pos:pos + 2], lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) > 0),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM w),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM r WHERE k > 1),
g AS (SELECT doc_id, list(line) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(lines) AS n_lines, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(list_transform(lines, lambda x, i: {'x': x, 'i': i}), lambda s: gone IS NULL OR NOT list_contains(gone, s.i)), lambda s: s.x), chr(10))) AS text_sha256
FROM l LEFT JOIN g USING (doc_id)
"""


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import ngram_jaccard

    return ngram_jaccard(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL_OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
g AS (SELECT shingle, list(doc_id) AS docs FROM s GROUP BY shingle HAVING count(*) > 1),
c AS (SELECT a.doc_id AS x, b.y, count(*) AS c FROM s a JOIN (SELECT shingle, unnest(docs) AS y FROM g) b USING (shingle) WHERE a.doc_id < b.y GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(node, root) AS (SELECT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node WHERE r.root < e.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(min(root), doc_id), doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = documents.doc_id GROUP BY doc_id, n
"""


def queries() -> dict:
    return {
        "op1_url_rules": op1_url_rules, "op2_exact_dedup": op2_exact_dedup, "op3_token_files": op3_token_files, "op4_piece_round_trip": op4_piece_round_trip,
        "op5_warc_round_trip": op5_warc_round_trip, "op6_quality_rules": op6_quality_rules, "op7_secret_scan": op7_secret_scan, "op8_mix_sources": op8_mix_sources,
        "op9_line_dedup": op9_line_dedup, "op10_ngram_jaccard": op10_ngram_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_rules": SQL_OP1, "op2_exact_dedup": SQL_OP2, "op5_warc_round_trip": SQL_OP5, "op7_secret_scan": _sql_op7(), "op8_mix_sources": SQL_OP8, "op9_line_dedup": SQL_OP9, "op10_ngram_jaccard": SQL_OP10}
