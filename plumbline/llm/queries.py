"""The registered queries of this subpackage, with SQL where SQL can express them.

Each query applies its operator to a whole table and derives from its result the
columns that identify it (digests, counts, ids).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from plumbline.llm import boosting, bpe, fim, langid, mixing, mtree, packing, pulearn, samples, simhash, substring, trie, urls, warc
from plumbline.plans.durable import scratch_path

#: Rules of the URL query, by host and path.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
#: Tokenizer file of the BPE query.
VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, table: str, sql: str | None = None):
    """Register ``fn(df)`` over a whole table."""

    def register(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@_query(
    "op5_mix",
    "documents",
    rf"""
WITH docs AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           ('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''))), 1, 15))::BIGINT AS place
    FROM documents
), whole AS (
    SELECT sum(size)::BIGINT AS tokens, greatest(1, sum(size)::BIGINT // {mixing.BLOCKS}) AS block,
           least({mixing.MAX_SHARDS}, greatest(1, ceil(sum(size) / {mixing.SHARD_TOKENS})))::BIGINT AS shards FROM docs
), placed AS (
    SELECT d.*, place % shards AS shard FROM docs d, whole
), lines AS (
    SELECT source, shard, sum(size)::BIGINT AS line FROM placed GROUP BY ALL
), ranked AS (
    SELECT source, sum(line)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
    FROM lines GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][(r - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM ranked
), levels AS (
    SELECT *, (sum(source_size) OVER ()
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
              / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
), aimed AS (
    SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM levels
), source_wins AS (
    SELECT source FROM (
        SELECT source, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, source NULLS LAST, j) AS win
        FROM aimed, whole, generate_series(0, (tokens // block)::BIGINT) AS g(j) WHERE target > 0
    ), whole WHERE win <= round(tokens / block)
), source_quota AS (
    SELECT source, count(*) AS blocks FROM source_wins GROUP BY source
), line_wins AS (
    SELECT source, shard FROM (
        SELECT l.source, shard, blocks,
               row_number() OVER (PARTITION BY l.source ORDER BY line / (2 * j + 1) DESC, shard, j) AS win
        FROM lines l JOIN source_quota q ON l.source IS NOT DISTINCT FROM q.source, unnest(range(blocks)) AS g(j) WHERE line > 0
    ) WHERE win <= blocks
), line_quota AS (
    SELECT source, shard, count(*) AS quota FROM line_wins GROUP BY ALL
), given AS (
    SELECT l.source, l.shard, line, least(coalesce(quota, 0) * block, 3 * line) AS give,
           CASE WHEN line > 0 THEN ('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(l.source, ''), l.shard::VARCHAR)), 1, 15))::BIGINT
                % line ELSE 0 END AS origin
    FROM lines l LEFT JOIN line_quota q ON l.source IS NOT DISTINCT FROM q.source AND l.shard = q.shard, whole
), laid AS (
    SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
    FROM placed
), arcs AS (
    SELECT d.*, d.stop - size AS start, origin, line, CASE WHEN line > 0 THEN give // line ELSE 0 END AS turns,
           origin + give - CASE WHEN line > 0 THEN give // line ELSE 0 END * line AS arc_end
    FROM laid d JOIN given g ON d.source IS NOT DISTINCT FROM g.source AND d.shard = g.shard
)
SELECT a.doc_id, size, s.source_size, s.target,
       (turns * size + greatest(0, least(stop, arc_end, line) - greatest(start, origin))
        + greatest(0, least(stop, arc_end - line) - start))::BIGINT AS taken
FROM arcs a JOIN aimed s ON a.source IS NOT DISTINCT FROM s.source
""",
)
def op5_mix(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@_query("op2_bpe", "documents")
def op2_bpe(docs: DataFrame) -> DataFrame:
    return bpe.encode_digests(docs, public_tokenizers.path(VOCABULARY))


@_query(
    "op10_warc",
    "pages",
    """
WITH rows AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digests AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM rows
), kept AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM kept
""",
)
def op10_warc(pages: DataFrame) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    warc.write(warc.records(pages), folder)
    full = warc.read(pages.sparkSession, folder).where("record_type = 'response'")
    full = full.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    bare = warc.read(pages.sparkSession, folder, payload=False).where("record_type = 'revisit'")
    return full.drop("payload").unionByName(bare).select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


@_query(
    "op9_topk",
    "embeddings",
    """
WITH rows AS (
    SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 10
""",
)
def op9_topk(embeddings: DataFrame) -> DataFrame:
    return mtree.top_k(embeddings, embeddings.where("vec_id % 100 = 0"))


@_query("op6_simhash", "documents")
def op6_simhash(docs: DataFrame) -> DataFrame:
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@_query(
    "op1_substring",
    "documents",
    r"""
WITH words AS (
    SELECT doc_id, w.pos - 1 AS pos, w.word AS word FROM (
        SELECT doc_id, unnest(list_zip(found, range(1, len(found) + 1))) AS pair
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS found FROM documents)
    ), LATERAL (SELECT pair[1] AS word, pair[2] AS pos) AS w
), windows AS (
    SELECT doc_id, pos, word,
           CASE WHEN count(*) OVER ahead = 20 THEN md5(string_agg(word, ' ') OVER ahead) END AS hash
    FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), firsts AS (
    SELECT doc_id, pos, word,
           hash IS NOT NULL AND row_number() OVER (PARTITION BY hash ORDER BY doc_id, pos) > 1 AS late
    FROM windows
), judged AS (
    SELECT doc_id, pos, word, bool_or(late) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS removed
    FROM firsts
), kept AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
)
def op1_substring(docs: DataFrame) -> DataFrame:
    return substring.removal_digests(docs)


def _labelled(name: str):
    """Register ``fn(documents, labels)``."""

    def register(fn: Callable[[DataFrame, DataFrame], DataFrame]):
        read = lambda spark, sf_dir, t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        QUERIES[name] = lambda spark, sf_dir: fn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
        return fn

    return register


@_labelled("op4_rules")
def op4_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = boosting.judge(docs, boosting.train(docs, labels), ["doc_id"])
    return found.drop("score")


@_labelled("op8_quality")
def op8_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    group = samples.remainder(F.col("doc_id"), 4)
    model = pulearn.train(docs, labels, group != 2)
    found = pulearn.score(docs, model, ["doc_id"])
    predicted = (F.col("score") >= pulearn.THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", F.coalesce(group == 2, F.lit(False)).alias("held_out"), "score", predicted)


@_query("op7_langid", "documents")
def op7_langid(docs: DataFrame) -> DataFrame:
    fold = samples.remainder(F.col("doc_id"), 5)
    found = langid.identify(docs, langid.train(docs, fold != 0), ["doc_id"])
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


_LINK = urls.LINK.replace("'", "''")


@_query(
    "op3_urls",
    "pages",
    rf"""
WITH RECURSIVE rules(rule, name, rest, verdict) AS (
    VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
           ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
           ('com/de/', 'com', '/de/', 'block')
), parsed AS (
    SELECT page_id, html,
           translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), fitted AS (
    SELECT page_id, host, path, html,
           (SELECT arg_max([rule, verdict], length(rule)) FROM rules
            WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, rest)) AS decided FROM parsed
), seeds AS (
    SELECT decided[2] AS kind, host, floor(count(*) * {urls.UNIT} * {1 - urls.DAMPING}::DOUBLE)::BIGINT AS rank
    FROM fitted WHERE decided IS NOT NULL GROUP BY ALL
), pairs AS (
    SELECT src, dst, count(*) AS n FROM (
        SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_LINK}', 1)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM fitted
    ) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
), ways AS (
    SELECT 'allow' AS kind, src AS a, dst AS b, n FROM pairs UNION ALL SELECT 'block', dst, src, n FROM pairs
), shares AS (
    SELECT kind, a, b, {urls.DAMPING}::DOUBLE * n / sum(n) OVER (PARTITION BY kind, a) AS share FROM ways
), ranks AS (
    SELECT 0 AS step, kind, host, rank FROM seeds
    UNION ALL
    SELECT step + 1, kind, host, sum(rank)::BIGINT FROM (
        SELECT r.step, s.kind, s.b AS host, floor(r.rank * s.share)::BIGINT AS rank
        FROM ranks r JOIN shares s ON r.kind = s.kind AND r.host = s.a WHERE step < {urls.ROUNDS}
        UNION ALL
        SELECT t.step, seeds.kind, seeds.host, seeds.rank FROM seeds, (SELECT DISTINCT step FROM ranks WHERE step < {urls.ROUNDS}) t
    ) GROUP BY ALL
), scores AS (
    SELECT host, coalesce(sum(rank) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'block'), 0) AS distrust
    FROM ranks WHERE step = {urls.ROUNDS} GROUP BY host
)
SELECT page_id, f.host, path, decided[1] AS rule,
       coalesce(decided[2], CASE WHEN trust < {urls.THRESHOLD} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM fitted f LEFT JOIN scores s ON f.host = s.host
""",
)
def op3_urls(pages: DataFrame) -> DataFrame:
    return urls.judge(pages, RULES)


@_query(
    "op11_fim",
    "documents",
    rf"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
           sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
           ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut
), formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR h3 % 100 >= {fim.RATE} THEN 'plain'
                WHEN h4 % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parted AS (
    SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
           array_to_string(units[b + 1:], '') AS suffix FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
""",
)
def op11_fim(docs: DataFrame) -> DataFrame:
    return fim.fill_in_middle(fim.store(docs), digests=True)


@_query("op13_packing", "documents")
def op13_packing(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), digests=True)


@_query(
    "op12_trie",
    "conversations",
    r"""
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), crc_table AS (
    WITH RECURSIVE steps(i, k, v) AS (
        SELECT i, 0, i FROM range(256) r(i)
        UNION ALL
        SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
    ) SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8
), convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                           lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 9 END AS h
    FROM (SELECT DISTINCT conv_id FROM own), crc_table
), taken AS (
    SELECT c.conv_id, o.role, o.text, 0 AS part, o.pos FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
    UNION ALL
    SELECT c.conv_id, o.role, o.text, 1, o.pos FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM taken
), paths AS (
    SELECT conv_id, depth, strlen(text) AS bytes, count(*) OVER (PARTITION BY conv_id) AS len,
           md5(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node
    FROM placed
    UNION ALL
    SELECT c.conv_id, 0, 0, (SELECT count(*) FROM taken t WHERE t.conv_id = c.conv_id), '' FROM convs c
), nodes AS (
    SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(bytes) AS bytes, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends_sha256
    FROM paths GROUP BY node
), links AS (
    SELECT DISTINCT u.node AS parent, v.node AS child FROM paths u JOIN paths v ON u.conv_id = v.conv_id AND v.depth = u.depth + 1
), below AS (
    SELECT DISTINCT u.node AS top, v.node AS node FROM paths u JOIN paths v ON u.conv_id = v.conv_id AND v.depth >= u.depth
), sums AS (
    SELECT top, count(*) FILTER (node NOT IN (SELECT parent FROM links)) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
    FROM below JOIN nodes USING (node) GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
       (SELECT count(*) FROM links WHERE links.parent = n.node) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums ON n.node = sums.top LEFT JOIN links l ON l.child = n.node LEFT JOIN nodes p ON p.node = l.parent
""",
)
def op12_trie(conversations: DataFrame) -> DataFrame:
    return trie.prefix_trie(conversations)
