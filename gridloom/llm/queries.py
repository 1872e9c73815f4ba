"""The queries that apply each operator of this subpackage to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import best_fit_packing, bloom_fingerprint, bpe_dynamic, exact_topk, exponion_clusters, html_extraction, language_id, license_lookup, merkle_manifest, quality_gam, simhash_dedup, token_counts, warc
from gridloom.llm.common import held_out, remove, shared_folder, table


@cache
def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> dict:
    """The arguments of `best_fit_packing.token_ids` for the byte-level vocabulary."""
    import public_tokenizers

    return {"ranks_path": tokenizer_file("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "end_text": "<|endoftext|>", "end_id": 50256}


def op1_tag_path_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op2_bloom_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bloom_fingerprint.compare_versions(table(spark, sf_dir, "documents"))
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return found.select(*columns, F.size("only_before").alias("n_only_before"), F.size("only_edited").alias("n_only_edited"))


def op3_output_code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs, F.col("lang"), ~held_out()))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_lookup.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", ","))


def op8_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.fit(docs, table(spark, sf_dir, "labels")))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_dynamic.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), capacity=2048)


def op11_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write(warc.captures(table(spark, sf_dir, "pages")), folder)
    found = warc.resolve(warc.read(spark, folder))  # has read the archives
    remove(spark, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", _UPPER, _LOWER))
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"), tampered={"text": lowered})


def op13_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion_clusters.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_tag_path_extraction, op2_bloom_fingerprints, op3_output_code_language, op4_simhash_components, op5_viterbi_token_counts,
        op6_threshold_topk, op7_license_digests, op8_additive_quality, op9_prefix_bpe, op10_best_fit_packing, op11_warc_revisits,
        op12_merkle_manifest, op13_exponion_clusters, pipeline,
    )
}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(x: str) -> str:
    """DuckDB's SQL for the canonical form of x, as a list of words: written by itself, apart from the operator's steps."""
    stated = "(?m)^[ \\t*#/;-]*(?:(?:portions )?copyright[ \\t:,]*(?:\\(c\\)|©|<|\\[|[12]\\d\\d\\d|by )|(?:\\(c\\)|©)[ \\t]*[a-z0-9<]|all rights reserved).*$"
    letters = "[a-z0-9\\x{80}-\\x{9F}\\x{A1}-\\x{A8}\\x{AA}-\\x{AD}\\x{AF}-\\x{200F}\\x{2028}-\\x{202F}\\x{205F}-\\x{2FFF}\\x{3001}-\\x{10FFFF}]+"
    small = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all(regexp_replace({small}, {_text(stated)}, '', 'g'), {_text(letters)})"


def _canonical(x: str) -> str:
    return f"""array_to_string(string_split(replace(replace(replace(replace(replace('#' || array_to_string(list_transform({_words(x)}, lambda w: CASE
        WHEN w IN ('licence', 'licences', 'licenced', 'sublicence') THEN replace(w, 'licence', 'license')
        WHEN w IN ('authorisation', 'authorised', 'organisation', 'initialise', 'recognise') THEN replace(w, 'is', 'iz')
        WHEN w IN ('behaviour', 'favour', 'labour') THEN replace(w, 'our', 'or')
        WHEN w = 'acknowledgement' THEN 'acknowledgment' WHEN w = 'centre' THEN 'center' WHEN w = 'fulfil' THEN 'fulfill'
        WHEN w = 'merchantibility' THEN 'merchantability' WHEN w = 'noncommercial' THEN 'non#,#commercial' WHEN w = 'whilst' THEN 'while'
        WHEN w = 'wilful' THEN 'willful' WHEN w = 'https' THEN 'http' ELSE w END), '#,#') || '#',
        '#sub#,#license#', '#sublicense#'), '#redistribution#,#s#', '#redistributions#'),
        '#copyright#,#holder#', '#copyright#,#owner#'), '#copyright#,#holders#', '#copyright#,#owners#'), '#', ''), ','), ' ')"""


def _clusters(k: int, rounds: int, scale: int) -> str:
    """DuckDB's SQL for centroid clusters: all vectors against all centroids, round by round."""
    steps = f"""
        v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM v QUALIFY j < {k})"""
    for i in range(rounds + 1):
        steps += f""", a{i} AS MATERIALIZED (
            SELECT row, vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS HUGEINT))) AS d
            FROM v, c{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, j) = 1)"""
        if i < rounds:
            steps += f""", m{i} AS (
                SELECT j, list(CAST(floor(s / n) AS BIGINT) - CASE WHEN floor(s / n) * n > s THEN 1 ELSE 0 END ORDER BY i) AS c
                FROM (SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY j, i) GROUP BY j
            ), c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (j))"""
    return f"""WITH {steps}
        SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (j)"""


def _leaf(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || {v}, '-')" for v in values) + ")"


_KNOWN = ", ".join(f"({_text(name)}, {_text(text)})" for name, text in license_lookup.KNOWN)
ORACLES = {
    "op6_threshold_topk": """
        WITH v AS (
            SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings WHERE embedding IS NOT NULL
        ), asked AS (
            SELECT DISTINCT id, v FROM v WHERE id % 50 = 0
        ), scored AS (
            SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM asked q JOIN v c ON q.id <> c.id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 5""",
    "op7_license_digests": f"""
        WITH known AS (
            SELECT sha256({_canonical("t.text")}) AS digest, min(t.license) AS license FROM (VALUES {_KNOWN}) AS t(license, text) GROUP BY 1
        ), lines AS (
            SELECT DISTINCT doc_id, k.license FROM (
                SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
            ) l JOIN known k ON sha256({_canonical("l.line")}) = k.digest
        ), noted AS (
            SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM lines GROUP BY doc_id
        ), scanned AS (
            SELECT doc_id, sha256({_canonical("text")}) AS digest FROM documents
        )
        SELECT s.doc_id, s.digest, k.license, coalesce(n.notices, '') AS notices
        FROM scanned s LEFT JOIN known k ON s.digest = k.digest LEFT JOIN noted n ON s.doc_id = n.doc_id""",
    "op11_warc_revisits": """
        WITH p AS (
            SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
        ), coded AS (
            SELECT page_id, url, strlen(html) AS n, h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31), 1)), '') AS digest FROM p
        ), placed AS (
            SELECT *, row_number() OVER w AS nth, first_value(page_id) OVER w AS original FROM coded
            WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST)
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN nth > 1 THEN original END AS refers_to FROM placed""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE rows AS MATERIALIZED (
            SELECT doc_id, coalesce(':' || lang, '-') AS tree, {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
                -- zlib's crc32 of the id, bit by bit
                (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x:
                    list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) AS c,
                {_leaf("doc_id", "source", "lang", "n_chars", f"translate(text, '{_UPPER}', '{_LOWER}')")} AS lowered
            FROM documents
        ), leaves AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows
        ), climb AS (
            SELECT 0 AS level, tree, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM leaves
            UNION ALL
            SELECT any_value(level) + 1, tree, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 7) // 8) FROM climb WHERE n > 1 GROUP BY tree, pos // 8
        ), subroots AS MATERIALIZED (
            SELECT tree, level AS depth, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM climb WHERE n = 1
        ), top AS (
            SELECT 0 AS level, pos, node, n FROM subroots
            UNION ALL
            SELECT any_value(level) + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 7) // 8) FROM top WHERE n > 1 GROUP BY pos // 8
        ), beside AS MATERIALIZED (
            SELECT tree, level, pos, coalesce(string_agg(node, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
                coalesce(string_agg(node, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
            FROM (SELECT level, tree, pos, node FROM climb WHERE n > 1 UNION ALL SELECT level, '', pos, node FROM top WHERE n > 1)
            WINDOW r AS (PARTITION BY tree, level, pos // 8 ORDER BY pos)
        ), fold AS (
            SELECT 0 AS level, row_number() OVER () AS row, l.tree, l.pos, 0 AS above, CASE WHEN xor(l.c, 4294967295) % 3 = 0 THEN l.lowered ELSE l.leaf END AS node, '' AS proof,
                s.tree AS name, s.depth, s.pos AS place, l.doc_id, l.leaf, s.node AS subroot FROM leaves l JOIN subroots s ON l.tree = s.tree
            UNION ALL
            SELECT f.level + 1, f.row, f.tree, CASE WHEN f.level < f.depth THEN f.pos // 8 ELSE f.pos END, f.above + CASE WHEN f.level < f.depth THEN 0 ELSE 1 END,
                sha256(b.b || f.node || b.a), f.proof || b.b || b.a, f.name, f.depth, CASE WHEN f.level < f.depth THEN f.place ELSE f.place // 8 END, f.doc_id, f.leaf, f.subroot
            FROM fold f JOIN beside b ON b.tree = CASE WHEN f.level < f.depth THEN f.tree ELSE '' END AND b.level = CASE WHEN f.level < f.depth THEN f.level ELSE f.above END
                AND b.pos = CASE WHEN f.level < f.depth THEN f.pos ELSE f.place END
        )
        SELECT doc_id, leaf, subroot, (SELECT node FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT node FROM top WHERE n = 1) AS verified
        FROM fold QUALIFY row_number() OVER (PARTITION BY row ORDER BY level DESC) = 1""",
    "op13_exponion_clusters": _clusters(16, 3, 64),
}
