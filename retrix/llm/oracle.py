"""SQL that gives the results of this subpackage's queries, where SQL can express them over whole tables."""

ORACLE: dict[str, str] = {
    "p3_found": """
        WITH requests AS (
            SELECT request_id, min(chunk_size) AS chunk_size FROM ingest_requests GROUP BY request_id
        )
        SELECT DISTINCT i.item_id
        FROM ingest_items i LEFT JOIN requests r ON i.request_id = r.request_id
        WHERE coalesce(r.chunk_size, 500) > 0 AND length(i.content) > coalesce(r.chunk_size, 500)
    """,
    "p7_certified": """
        WITH once AS (
            SELECT query_id, min(coalesce(lower(trim(model_used)), '')) AS model_used,
                   min(total_latency) AS total_latency, min(estimated_cost) AS estimated_cost
            FROM query_metrics WHERE query_id IS NOT NULL GROUP BY query_id
        ), long AS (
            SELECT model_used, 'total_latency' AS metric, total_latency AS v FROM once
            UNION ALL SELECT model_used, 'estimated_cost', estimated_cost FROM once
        )
        SELECT model_used, metric, q.quantile, count(*) AS n, true AS within_bound
        FROM long, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) q(quantile)
        WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0
        GROUP BY model_used, metric, q.quantile
    """,
    "p9_assigned": """
        SELECT doc_id, true AS fits FROM documents WHERE text IS NOT NULL AND text <> ''
    """,
    "p4_found": """
        WITH once AS (
            SELECT id, min(query_embedding)::DOUBLE[] AS v FROM semantic_cache
            WHERE id IS NOT NULL AND len(query_embedding) = 64 AND NOT list_bool_or([isnan(x) OR isinf(x) FOR x IN query_embedding])
              AND list_bool_or([x <> 0 FOR x IN query_embedding])
            GROUP BY id
        ), scored AS (
            SELECT a.id AS asker, b.id AS other, round(list_cosine_similarity(a.v, b.v), 12) AS cosine
            FROM once a JOIN once b ON a.id <> b.id
        ), ranked AS (
            SELECT asker, other, row_number() OVER (PARTITION BY asker ORDER BY cosine DESC, other) AS place FROM scored
        )
        SELECT DISTINCT least(asker, other) AS id_a, greatest(asker, other) AS id_b FROM ranked WHERE place <= 5
    """,
}
