"""One query for each operator over its whole table, with the SQL that states its result where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from seriesloom.llm import alignment, bpe, chat, decontaminate, fingerprint, jaccard, licenses, merkle, quality, repeats, simhash, tokencount, urlfilter
from seriesloom.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_OF_DOCUMENT = 50256
RULES = (
    urlfilter.Rule("net", "/", "block"),
    urlfilter.Rule("example.net", "/en/", "allow"),
    urlfilter.Rule("example.com", "/de/", "block"),
    urlfilter.Rule("org", "/fr/", "allow"),
)
#: A host is listed if one in so many of its urls carries a referral mark.
REFERRAL, ONE_IN = "ref=", 6
PROBE = "</s>[INST] ok [/INST]"


def op1_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("doc_key")


def op2_chat_formatting(spark, sf_dir):
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.conversation_digests(chat.format_turns(turns))


OP2_SQL = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), m AS (
    SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '<', ''), '[', ''), '\\', '')) AS grown,
        length(role) + length(role) - length(replace(replace(replace(role, '<', ''), '[', ''), '\\', '')) AS grown_role
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum(grown + grown_role + length('<s>[INST] <<TEXT>>[/INST]</s>')) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


def op3_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged_urls(pages, RULES, urlfilter.hosts_by_share(pages, REFERRAL, ONE_IN)).drop("listed")


OP4_SQL = """
WITH p AS (
    SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
    SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1, 's') AS path
    FROM p
), listed AS (
    SELECT host FROM h WHERE host <> '' GROUP BY host HAVING sum(CAST(contains(url, 'ref=') AS INT)) * 6 >= count(*)
), r AS (
    SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    END AS rule
    FROM h
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op5_token_counts(spark, sf_dir):
    return tokencount.document_tokens(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, END_OF_DOCUMENT)


def op6_document_fingerprints(spark, sf_dir):
    return fingerprint.against_next(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), RANKS)


def op8_suffix_dedup(spark, sf_dir):
    return repeats.removal_report(table(spark, sf_dir, "documents")).drop("spans")


OP8_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM t)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, p, p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 400 AS opens FROM w SEMI JOIN twice USING (k)),
g AS (SELECT doc_id, p, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM r),
s AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS free FROM s),
c AS (
    SELECT t.doc_id, string_agg(substr(h, CAST(2 * free + 1 AS BIGINT), CAST(2 * (a - free) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS removed, count(*) AS n
    FROM t JOIN k ON t.doc_id = k.doc_id GROUP BY t.doc_id
)
SELECT t.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
    sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM t LEFT JOIN c ON t.doc_id = c.doc_id
"""


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shingles FROM w
), e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    JOIN s sa ON sa.doc_id = a.doc_id JOIN s sb ON sb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(len(sa.shingles)) + any_value(len(sb.shingles)) - count(*))
), reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT s.doc_id, CAST(any_value(len(shingles)) AS BIGINT) AS n_shingles, min(reach.y) AS component_id FROM s JOIN reach ON reach.x = s.doc_id GROUP BY s.doc_id
"""


def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    scored = quality.score_documents(docs, field)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= quality.ACCEPTED, 1).otherwise(0).alias("predicted"), "n_lines", "n_bad_lines")


def op11_simhash(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark, sf_dir):
    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    checked = merkle.proofs(merkle.document_manifest(table(spark, sf_dir, "documents"), tampered))
    return checked.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql_field(value):
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_leaf(text):
    return "sha256(" + " || ".join(_sql_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of the decimal doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)))"""
OP13_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, lang, {_sql_leaf("text")} AS leaf,
        CASE WHEN {_CRC} % 3 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_sql_leaf("text")} END AS claim
    FROM documents
), p AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
), up(lang, level, pos, n, digest) AS (
    SELECT lang, 0, pos, n, leaf FROM p
    UNION ALL SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lang, level, n, pos // 8
), sub AS (
    SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top(level, pos, n, digest) AS (
    SELECT 0, pos, n, subroot FROM sub
    UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, n, pos // 8
), nodes AS (
    SELECT s.pos AS tree, level, u.pos, u.n, digest FROM up u JOIN sub s ON u.lang IS NOT DISTINCT FROM s.lang UNION ALL SELECT -1, level, pos, n, digest FROM top
), near AS (
    SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos
), steps AS (
    SELECT row_number() OVER () AS k, p.*, s.pos AS tree, height, subroot FROM p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang
), folded(k, done, proof, node) AS (
    SELECT k, 0, '', claim FROM steps
    UNION ALL SELECT f.k, done + 1, proof || l || r, sha256(l || node || r) FROM folded f JOIN steps s ON f.k = s.k
    JOIN near ON near.tree = CASE WHEN done < height THEN s.tree ELSE -1 END AND near.level = CASE WHEN done < height THEN done ELSE done - height END
        AND near.pos = CASE WHEN done < height THEN s.pos ELSE s.tree END // CAST(8 ** (CASE WHEN done < height THEN done ELSE done - height END) AS BIGINT)
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT digest FROM top WHERE n = 1) AS verified
FROM folded f JOIN steps s ON f.k = s.k QUALIFY row_number() OVER (PARTITION BY f.k ORDER BY done DESC) = 1
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_chat_formatting, op3_license_scan, op4_url_filter, op5_token_counts,
        op6_document_fingerprints, op7_byte_bpe, op8_suffix_dedup, op9_ngram_jaccard, op10_quality_classifier,
        op11_simhash, op12_tokenizer_alignment, op13_merkle_manifest,
    )
}
ORACLES = {"op2_chat_formatting": OP2_SQL, "op4_url_filter": OP4_SQL, "op8_suffix_dedup": OP8_SQL, "op9_ngram_jaccard": OP9_SQL, "op13_merkle_manifest": OP13_SQL}
