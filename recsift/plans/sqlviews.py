"""DuckDB text of the domain views (FIXTURES.md §2), used to build the
independent oracle queries. Each view is a CTE; :func:`sql` prepends the
views a query needs, in dependency order."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_interactions": ((), """
        SELECT o_custkey AS user_id, l_partkey AS parent_asin,
               CAST(1 + (CAST(floor(l_quantity) AS BIGINT) % 5) AS DOUBLE) AS rating,
               epoch_ms(o_orderdate) + l_linenumber AS "timestamp",
               l_orderkey * 8 + l_linenumber AS seq
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "interactions": (("raw_interactions",), """
        SELECT user_id, parent_asin, x.rating AS rating, x.ts AS "timestamp", x.seq AS seq
        FROM (SELECT user_id, parent_asin, min({'ts': "timestamp", 'seq': seq, 'rating': rating}) AS x
              FROM raw_interactions GROUP BY 1, 2)"""),
    "ranked": (("interactions",), """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", parent_asin) AS rn,
               count(*) OVER (PARTITION BY user_id) AS n_user
        FROM interactions"""),
    "thresholds": (("raw_interactions",), """
        SELECT max(CASE WHEN pos = CEIL(0.8 * n) THEN "timestamp" END) AS t_valid,
               max(CASE WHEN pos = CEIL(0.9 * n) THEN "timestamp" END) AS t_test
        FROM (SELECT "timestamp", row_number() OVER (ORDER BY "timestamp") AS pos, count(*) OVER () AS n
              FROM raw_interactions)"""),
    "items": ((), """
        SELECT p_partkey AS parent_asin, p_name AS title, [p_type, p_brand] AS features, [p_brand] AS categories,
               CASE WHEN p_size % 4 = 0 THEN []::VARCHAR[] ELSE [p_name, p_type] END AS description,
               p_brand AS category
        FROM part WHERE p_size <= 45"""),
    "reviews": (("interactions",), """
        SELECT r.user_id, r.parent_asin, r.rating, r."timestamp", r.seq,
               CASE WHEN r.seq % 10 = 0 THEN NULL ELSE left(d.text, 20) END AS title, d.text
        FROM interactions r JOIN documents d ON d.doc_id = r.seq % (SELECT count(*) FROM documents)"""),
    "judgements": ((), """
        SELECT p_name || ' ' || p_type AS query, l_partkey AS product_id,
               CASE WHEN l_linestatus = 'O' THEN 'us' ELSE 'es' END AS product_locale,
               CASE l_returnflag WHEN 'N' THEN 'Exact' WHEN 'R' THEN 'Substitute' ELSE 'Irrelevant' END AS relevance_label,
               CAST(l_linenumber % 2 AS BIGINT) AS small_version
        FROM lineitem JOIN part ON p_partkey = l_partkey"""),
    "category_map": ((), """
        SELECT p_partkey AS item_id,
               CASE WHEN ends_with(p_brand, '5') THEN 'Unknown ' || p_brand ELSE p_brand END AS category
        FROM part"""),
    "corpus": ((), "SELECT doc_id, text, source AS category FROM documents"),
    "search_queries": ((), """
        SELECT b.item_id AS qid, b.text AS query, min(d.doc_id) AS target
        FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL"""),
    "pairs": ((), """
        SELECT a.conv_id, a.turn, a.text AS sent0, b.text AS sent1
        FROM conversations a JOIN conversations b
          ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'"""),
    "vectors": ((), "SELECT vec_id, embedding, label FROM embeddings"),
}


def _order(names: tuple[str, ...], seen: list[str]) -> None:
    for n in names:
        if n in seen:
            continue
        deps, _ = VIEWS[n]
        _order(deps, seen)
        seen.append(n)


def sql(body: str, *views: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """``WITH <views...>, <extra...> <body>``."""
    names: list[str] = []
    _order(tuple(views), names)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in names]
    # a trailing '*' on an extra name asks DuckDB to materialise that CTE once
    parts += [f"{n[:-1]} AS MATERIALIZED ({b})" if n.endswith("*") else f"{n} AS ({b})" for n, b in extra]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
