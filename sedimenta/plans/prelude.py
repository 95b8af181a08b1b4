"""The views of `sources.views` as SQL for the oracle."""

VIEWS = {
    "paths": """SELECT p_partkey, p_size, lower(replace(p_brand,'#','_')) || '/' || lower(p_type) || '/' || CASE WHEN p_size % 10 = 0 THEN 'test_' ELSE '' END || replace(p_name,' ','_')
      || CASE p_size % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.json' ELSE '.py' END AS path FROM part""",
    "commits": """SELECT 'o' || o_orderkey AS hash, o_orderkey AS pos, CAST(o_orderdate AS DATE) AS date, n_name AS author,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'fix(core): order flow' WHEN '2-HIGH' THEN 'feat: order entry, totals and tax lines' WHEN '3-MEDIUM' THEN 'Refactor pricing'
        WHEN '4-NOT SPECIFIED' THEN 'docs: describe orders' ELSE 'Revert "Refactor pricing"' END || CASE WHEN o_orderkey % 5 = 0 THEN ' (#' || (o_orderkey % 997) || ')' ELSE '' END AS subject
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "changes": """SELECT hash, pos, date, author, subject, path, added, deleted FROM commits JOIN (
      SELECT l_orderkey, path, CAST(SUM(l_quantity) AS BIGINT) AS added, CAST(SUM(FLOOR(l_quantity*l_discount*10)) AS BIGINT) AS deleted
      FROM lineitem JOIN paths ON l_partkey = p_partkey GROUP BY l_orderkey, path) ON l_orderkey = pos""",
    "people": """SELECT hash, pos, date, author AS person, CAST(0 AS BIGINT) AS position, 1 + coalesce(n, 0) AS people FROM commits LEFT JOIN (SELECT c.pos AS p, count(*) AS n FROM co c GROUP BY c.pos) ON p = pos
      UNION ALL SELECT commits.hash, commits.pos, date, other, row_number() OVER (PARTITION BY commits.pos ORDER BY other), 1 + count(*) OVER (PARTITION BY commits.pos) FROM commits JOIN co ON co.pos = commits.pos""",
    "credits": """SELECT changes.hash, changes.pos, changes.date, person, position, path, added // people + CASE WHEN position < added % people THEN 1 ELSE 0 END AS added,
      deleted // people + CASE WHEN position < deleted % people THEN 1 ELSE 0 END AS deleted FROM changes JOIN people ON people.pos = changes.pos""",
    "size_files": "SELECT path, CAST(SUM(p_size*10) AS BIGINT) AS code, CAST(SUM(p_size % 50) AS BIGINT) AS complexity FROM paths GROUP BY path",
    "tree": "SELECT DISTINCT path FROM paths WHERE p_partkey % 10 <> 0",
    "ending": "SELECT max(date) AS now FROM commits",
    "ranked_docs": "SELECT doc_id, n_chars AS cost, quality AS outcome, toxic, lang, source FROM documents JOIN labels USING (doc_id)",
}
CO = "SELECT DISTINCT commits.pos, n_name AS other FROM commits JOIN lineitem ON l_orderkey = commits.pos AND l_linenumber = 1 JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name <> author"


def sql(query: str) -> str:
    """A query over the views, as one statement."""
    views = []
    for name, text in VIEWS.items():
        if name == "people":
            views.append(f"co AS ({CO})")
        views.append(f"{name} AS ({text})")
    query = query.strip()
    return f"WITH {', '.join(views)}" + (f", {query[5:]}" if query[:5].upper() == "WITH " else f" {query}")
