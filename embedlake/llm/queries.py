"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from embedlake.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from embedlake.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from embedlake.llm import warc
    from embedlake.llm._work import Workspace

    pages, ws = _table(spark, sf_dir, "pages"), Workspace(spark, "archives")
    urn = "urn:x-page"
    warc.write_archives(pages, ws.path("warc"), urn=urn)
    found = warc.read_archives(spark, ws.path("warc"), payload=False)
    # ids as they were: what stands behind the name space, in the type that the pages have
    own = lambda c: F.nullif(F.substring(F.col(c), F.lit(len(urn) + 2), F.length(c)), F.lit("")).try_cast(pages.schema["page_id"].dataType)
    out = ws.save(found.select(own("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", own("refers_to").alias("refers_to"), "digest_ok"), "records")
    ws.drop("warc")
    return out


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from embedlake.llm.substring import removal_report

    return removal_report(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from embedlake.llm.lines import drop_report

    return drop_report(_table(spark, sf_dir, "documents"))


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from embedlake.llm.bpe import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from embedlake.llm.tokencount import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from embedlake.llm import toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    found = toxicity.score(docs, model, spans=False)
    return found.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from embedlake.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from embedlake.llm.embed_join import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from embedlake.llm import conversation_trie as C
    from embedlake.llm._work import Workspace

    return C.trie(C.rebuilt(Workspace(spark, "conversations"), _table(spark, sf_dir, "conversations")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from embedlake.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from embedlake.llm import urlgraph

    return urlgraph.judge(_table(spark, sf_dir, "pages"), urlgraph.rule_table(spark, URL_RULES))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_ngram_jaccard_join, op3_warc, op4_substring_dedup, op5_line_dedup, op6_bpe_roundtrip, op7_token_counts, op8_toxicity, op9_quality_rules, op10_embedding_near_dedup, op11_conversation_trie, op12_source_divergence, op13_url_filters)}
ORACLE_SQL: dict[str, str] = {
    "op10_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
        ), ok AS (
            SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach(x, y) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
        ), comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
        n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
        SELECT c.x AS vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.x = c.component_id AS kept
        FROM comp c LEFT JOIN n ON c.x = n.x
    """,
    "op11_conversation_trie": """
        WITH t AS (
            SELECT conv_id, role, txt, turn_hash, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, turn_hash) AS i FROM (
                SELECT conv_id, turn, role, txt, sha256(strlen(role)::VARCHAR || ':' || role || txt) AS turn_hash
                FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS txt FROM conversations WHERE conv_id IS NOT NULL)
            )
        ), c AS (
            SELECT conv_id, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k, 1))::BIGINT)),
                lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
            )) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
        ), r AS (
            SELECT c.conv_id, 0 AS part, i, turn_hash, length(txt) AS chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.i <= c.h
            UNION ALL
            SELECT c.conv_id, 1, i, turn_hash, length(txt) FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h
        ), m AS (
            SELECT conv_id, row_number() OVER w AS depth, string_agg(turn_hash, '') OVER w AS path, chars FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)
            UNION ALL
            SELECT conv_id, 0, '', 0 FROM c
        ), node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM m GROUP BY path, depth),
        ends AS (
            SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path
        ), kids AS (SELECT substr(path, 1, 64 * (depth - 1)::BIGINT) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
        below AS (
            SELECT substr(path, 1, 64 * d) AS path, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
            FROM (SELECT node.path, n_convs, chars, kids.n IS NULL AS leaf, unnest(range(depth + 1)) AS d FROM node LEFT JOIN kids ON node.path = kids.path) GROUP BY 1
        )
        SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM node JOIN below ON node.path = below.path LEFT JOIN kids ON node.path = kids.path LEFT JOIN ends ON node.path = ends.path
        LEFT JOIN node up ON node.depth > 0 AND up.path = substr(node.path, 1, 64 * (node.depth - 1)::BIGINT)
    """,
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce("text", '') AS t FROM documents
        ), w AS (
            SELECT k, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
        ), vocabulary AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
        v AS (SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM d),
        counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
        own AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source),
        p AS (
            SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(o.total, 0) + 5 * v.v) AS p
            FROM groups g JOIN v USING (lang) JOIN vocabulary t USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source
        ), of_lang AS (
            SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 5 * v) AS q
            FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term) JOIN v USING (lang)
        ), pair AS (
            SELECT g.lang, g.source, o.source AS item, coalesce(s.value, 0)::BIGINT AS value
            FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
            LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source) s
            ON s.lang = g.lang AND s.source = g.source AND s.item = o.source
        ), term AS (
            SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q
        )
        SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
        UNION ALL
        SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 50
    """,
    "op13_url_filters": r"""
        WITH RECURSIVE rules(verdict, rule, dom, start) AS (
            VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
        ), read AS (
            SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, row_number() OVER () AS k
            FROM pages
        ), links AS (
            SELECT src, dst, count(*) AS n FROM (
                SELECT DISTINCT k, host AS src, translate(unnest(regexp_extract_all(html, '(?i)href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["'']?[\x20\x09-\x0D]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''<>\x20\x09-\x0D]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM read
            ) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
        ), judged AS (
            SELECT r.k, max_by(u.rule, length(u.rule)) AS rule, max_by(u.verdict, length(u.rule)) AS ruled
            FROM read r JOIN rules u ON (r.host = u.dom OR ends_with(r.host, '.' || u.dom)) AND starts_with(r.path, u.start) GROUP BY r.k
        ), nodes AS (
            SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM read LEFT JOIN judged USING (k) WHERE host <> '' GROUP BY host
            UNION ALL
            SELECT dst, 1, (arg_max(verdict, length(rule)) = 'allow')::INT, (arg_max(verdict, length(rule)) = 'block')::INT
            FROM (SELECT DISTINCT dst FROM links WHERE dst NOT IN (SELECT host FROM read)) JOIN rules ON (dst = dom OR ends_with(dst, '.' || dom)) AND start = '/' GROUP BY dst
        ), seeds AS (
            SELECT 1 AS kind, host, good::HUGEINT * 1000000000 // n AS score FROM nodes WHERE good > 0 UNION ALL SELECT -1, host, bad::HUGEINT * 1000000000 // n FROM nodes WHERE bad > 0
        ), both_ways AS (
            SELECT 1 AS kind, src, dst, n FROM links UNION ALL SELECT -1, dst, src, n FROM links
        ), arcs AS (
            SELECT kind, src, dst, n::HUGEINT * 1000000000 // sum(n) OVER (PARTITION BY kind, src)::HUGEINT AS share FROM both_ways
        ), rounds(k, kind, host, score) AS (
            SELECT 0, kind, host, score FROM seeds
            UNION ALL
            SELECT k + 1, kind, host, sum(score)::HUGEINT FROM (
                SELECT k, kind, host, score FROM (SELECT DISTINCT k FROM rounds), seeds
                UNION ALL
                SELECT r.k, r.kind, a.dst, r.score * (a.share * 85) // 100000000000 FROM rounds r JOIN arcs a ON r.kind = a.kind AND r.host = a.src
            ) WHERE k < 40 GROUP BY k, kind, host
        ), blocked AS (
            SELECT host FROM rounds WHERE k = 40 GROUP BY host HAVING sum(-kind * score) > 500000000
        )
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
        FROM read LEFT JOIN judged USING (k)
    """,
}
