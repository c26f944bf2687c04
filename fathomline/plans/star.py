"""Notes, pages and source files made of the star schema's rows: data in which links, imports, calls and bases resolve.

Each customer is a note that links to its nation's, each nation's to its region's; suppliers are Python modules that
call their nation's, which import and extend their region's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.session import prepare, table


def _word(c: str) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def _named(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    r = table(prepare(spark), folder, "region").select("r_regionkey", "r_name")
    n = table(spark, folder, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return r, n.select("n_nationkey", "n_name", "r_name")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of regions, nations and customers."""
    r, n = _named(spark, folder)
    c = table(spark, folder, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    regions = r.select(F.concat(F.lit("regions/"), "r_name", F.lit(".md")), F.concat(F.lit("# "), "r_name", F.lit("\n\nA region.\n")))
    nations = n.select(F.concat(F.lit("nations/"), "n_name", F.lit(".md")), F.concat(F.lit("# "), "n_name", F.lit("\n\n## Place\n\nIt lies in [["), "r_name", F.lit("|this region]].\n")))
    text = F.concat(
        F.lit("# Customer "), "c_custkey", F.lit("\n\nLives in [["), "n_name", F.lit("]].\n\n## Segment [["), "c_mktsegment", F.lit("]]\n\n```\n# [[no link]]\n```\n\nLast word\n=========\n\nend\n")
    )
    customers = c.select(F.concat(F.lit("customers/c"), "c_custkey", F.lit(".md")), text)
    return regions.union(nations).union(customers).toDF("path", "text")


def described(spark: SparkSession, folder: str) -> DataFrame:
    """(key, text): parts as notes with properties, links, formulas and addresses."""
    p = table(prepare(spark), folder, "part")
    text = F.concat(
        F.lit("---\nname: "), "p_name", F.lit("\ntags:\n- "), "p_brand", F.lit("\n- part\naliases: part "), F.col("p_partkey").cast("string"), F.lit(", "), "p_type", F.lit("\nsize: "), "p_size",
        F.lit("\n---\nMade by [["), "p_brand", F.lit("|the maker]] of [type](t/"), F.col("p_partkey").cast("string"), F.lit(") with $x_1$ at https://example.org/a?b `code` end.\n"),
    )
    return p.select(F.col("p_partkey").cast("string").alias("key"), text.alias("text"))


def technical(spark: SparkSession, folder: str) -> DataFrame:
    """(key, name, text): parts in which every kind of token occurs: identifiers, versions, dates, units, paths, broken words."""
    p = table(prepare(spark), folder, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("part_no_"), key, F.lit(" sizeLimit v1."), size, F.lit(" 2024-05-06 "), size, F.lit("kb src/lib/p"), key, F.lit(f".py com{chr(0xFFFE)}piler Été"))
    return p.select(key.alias("key"), F.lit("").alias("name"), text.alias("text"))


def sectioned(spark: SparkSession, folder: str) -> DataFrame:
    """(key, text): a note a supplier: an introduction, a part with paragraphs that fill it, references."""
    s = table(prepare(spark), folder, "supplier")
    line = F.concat(F.lit("About "), "s_name", F.lit(" there is much to say.\n\n"))
    text = F.concat(F.lit("intro\n\n# "), "s_name", F.lit("\n\n"), F.repeat(line, F.lit(8)), F.lit("## References\n\n[1] a\n"))
    return s.select(F.col("s_suppkey").cast("string").alias("key"), text.alias("text"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): an HTML page a nation."""
    n = _named(spark, folder)[1]
    page = F.concat(
        F.lit("<html><head><title>no</title></head><body><h1>"), "n_name", F.lit(" &amp; more</h1><p>in <b>"), "r_name", F.lit("</b><br>there</p><ul><li>one<li>two</ul>"),
        F.lit("<table><tr><td>a</td><td>"), "n_nationkey", F.lit("</td></tr><tr><td>b</td><td>c</td></tr></table><pre>x\n  y</pre><img src='f.png' alt='map'></body></html>"),
    )
    return n.select(F.concat("n_name", F.lit(".html")).alias("path"), F.encode(page, "UTF-8").alias("content"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): a PDF file of two pages a nation."""
    n = _named(spark, folder)[1]
    first = F.concat(F.lit("BT /F1 12 Tf 72 700 Td ("), "n_name", F.lit(" is \\(now\\)) Tj 0 -14 Td [(in) -300 ("), "r_name", F.lit(")] TJ ET"))
    second = F.concat(F.lit("BT /F1 12 Tf 72 700 Td (Number "), "n_nationkey", F.lit(") Tj ET"))
    stream = lambda no, text: F.concat(F.lit(f"{no} 0 obj\n<< /Length "), F.length(text).cast("string"), F.lit(" >>\nstream\n"), text, F.lit("\nendstream\nendobj\n"))
    page = lambda no, at: F.lit(f"{no} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {at} 0 R /Resources << /Font << /F1 7 0 R >> >> >>\nendobj\n")
    tree = F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 >>\nendobj\n")
    whole = F.concat(tree, page(3, 5), page(4, 6), stream(5, second), stream(6, first), F.lit("7 0 obj\n<< /Type /Font /BaseFont /Helvetica >>\nendobj\n%%EOF\n"))
    return n.select(F.concat("n_name", F.lit(".pdf")).alias("path"), F.encode(whole, "UTF-8").alias("content"))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text): a module for each region, nation and supplier."""
    r, n = _named(spark, folder)
    s = table(spark, folder, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    area, region, nation = F.replace("r_name", F.lit(" "), F.lit("")), _word("r_name"), _word("n_name")
    regions = r.select(F.concat(F.lit("geo/regions/"), region, F.lit(".py")), F.concat(F.lit("class "), area, F.lit("Area:\n    pass\n\n\ndef open_"), region, F.lit("():\n    return 1\n")))
    text = F.concat(
        F.lit("from geo.regions."), region, F.lit(" import "), area, F.lit("Area, open_"), region, F.lit("\n\n\nclass "), "n_name", F.lit("Place("), area,
        F.lit("Area):\n    pass\n\n\ndef start_"), nation, F.lit("():\n    return open_"), region, F.lit("()\n"),
    )
    nations = n.select(F.concat(F.lit("geo/nations/"), nation, F.lit(".py")), text)
    text = F.concat(F.lit("import geo.nations."), nation, F.lit("\n\n\ndef ship():\n    return geo.nations."), nation, F.lit(".start_"), nation, F.lit("()\n"))
    suppliers = s.select(F.concat(F.lit("geo/suppliers/s"), "s_suppkey", F.lit(".py")), text)
    return regions.union(nations).union(suppliers).toDF("path", "text")


N_SQL = "n AS (SELECT n_nationkey, n_name, r_name, lower(replace(n_name, ' ', '_')) AS nw, lower(replace(r_name, ' ', '_')) AS rw, replace(r_name, ' ', '') AS area FROM nation JOIN region ON n_regionkey = r_regionkey)"
R_SQL = "r AS (SELECT r_name, lower(replace(r_name, ' ', '_')) AS rw, replace(r_name, ' ', '') AS area FROM region)"
NOTES_SQL = f"""
    {N_SQL}, c AS (SELECT c_custkey, c_mktsegment, n_name FROM customer JOIN n ON c_nationkey = n_nationkey),
    notes AS (SELECT 'regions/' || r_name || '.md' AS path FROM region UNION ALL SELECT 'nations/' || n_name || '.md' FROM n UNION ALL SELECT 'customers/c' || c_custkey || '.md' FROM c),
    edges AS (SELECT 'nations/' || n_name || '.md' AS src, 'regions/' || r_name || '.md' AS dst, false AS scaffold FROM n
              UNION ALL SELECT 'customers/c' || c_custkey || '.md', 'nations/' || n_name || '.md', false FROM c),
    heads AS (SELECT 'regions/' || r_name || '.md' AS key, 1 AS level, r_name AS title, 1 AS line, 0 AS off FROM region
              UNION ALL SELECT 'nations/' || n_name || '.md', 1, n_name, 1, 0 FROM n UNION ALL SELECT 'nations/' || n_name || '.md', 2, 'Place', 3, length(n_name) + 4 FROM n
              UNION ALL SELECT 'customers/c' || c_custkey || '.md', 1, 'Customer ' || c_custkey, 1, 0 FROM c
              UNION ALL SELECT 'customers/c' || c_custkey || '.md', 2, 'Segment [[' || c_mktsegment || ']]', 5, length(c_custkey::VARCHAR) + length(n_name) + 29 FROM c
              UNION ALL SELECT 'customers/c' || c_custkey || '.md', 1, 'Last word', 11, length(c_custkey::VARCHAR) + length(n_name) + length(c_mktsegment) + 69 FROM c)"""
FILES_SQL = f"""
    {N_SQL}, {R_SQL}, s AS (SELECT s_suppkey, nw FROM supplier JOIN n ON s_nationkey = n_nationkey),
    symbols_ AS (SELECT 'geo/regions/' || rw || '.py' AS path, 'class' AS kind, area || 'Area' AS name, 'class ' || area || 'Area' AS signature, 1 AS line, 2 AS end_line FROM r
                UNION ALL SELECT 'geo/regions/' || rw || '.py', 'function', 'open_' || rw, 'def open_' || rw || '()', 5, 6 FROM r
                UNION ALL SELECT 'geo/nations/' || nw || '.py', 'class', n_name || 'Place', 'class ' || n_name || 'Place(' || area || 'Area)', 4, 5 FROM n
                UNION ALL SELECT 'geo/nations/' || nw || '.py', 'function', 'start_' || nw, 'def start_' || nw || '()', 8, 9 FROM n
                UNION ALL SELECT 'geo/suppliers/s' || s_suppkey || '.py', 'function', 'ship', 'def ship()', 4, 5 FROM s),
    imports_ AS (SELECT 'geo/nations/' || nw || '.py' AS src, 'geo.regions.' || rw || '.' || area || 'Area' AS module, 'geo/regions/' || rw || '.py' AS value FROM n
                UNION ALL SELECT 'geo/nations/' || nw || '.py', 'geo.regions.' || rw || '.open_' || rw, 'geo/regions/' || rw || '.py' FROM n
                UNION ALL SELECT 'geo/suppliers/s' || s_suppkey || '.py', 'geo.nations.' || nw, 'geo/nations/' || nw || '.py' FROM s)"""
ORACLE_SQL = {
    "link_graph": f"WITH {NOTES_SQL} SELECT * FROM edges",
    "unresolved_links": f"WITH {NOTES_SQL} SELECT 'customers/c' || c_custkey || '.md' AS src, c_mktsegment AS target FROM c",
    "orphans": f"WITH {NOTES_SQL} SELECT path FROM notes EXCEPT SELECT dst FROM edges",
    "link_degrees": f"WITH {NOTES_SQL} SELECT path, (SELECT count(*) FROM edges WHERE src = path) AS links_out, (SELECT count(*) FROM edges WHERE dst = path) AS links_in FROM notes",
    "note_lint": f"WITH {NOTES_SQL} SELECT 'customers/c' || c_custkey || '.md' AS path, 'line 5: unresolved [[' || c_mktsegment || ']]' AS issue FROM c",
    "outline": f"WITH {NOTES_SQL} SELECT key, level, title, line, CAST(off AS INT) AS off FROM heads",
    "section_ends": f"WITH {NOTES_SQL} SELECT key, level, title, line, CAST(off AS INT) AS off, CAST(coalesce((SELECT min(b.off) FROM heads b WHERE b.key = a.key AND b.off > a.off AND b.level <= a.level), -1) AS INT) AS end_off FROM heads a",
    "graph_reach": f"""WITH {NOTES_SQL}, links_ AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), h0 AS (SELECT 'regions/ASIA.md' AS path),
        h1 AS (SELECT DISTINCT b AS path FROM links_ JOIN h0 ON a = path), h2 AS (SELECT DISTINCT b AS path FROM links_ JOIN h1 ON a = path)
        SELECT path, CAST(min(hop) AS INT) AS hop FROM (SELECT path, 0 AS hop FROM h0 UNION ALL SELECT path, 1 FROM h1 UNION ALL SELECT path, 2 FROM h2) GROUP BY path""",
    "code_symbols": f"WITH {FILES_SQL} SELECT path, kind, name, signature, '' AS doc, '' AS parent, '' AS doc_full, CAST(line AS INT) AS line, CAST(end_line AS INT) AS end_line FROM symbols_",
    "import_edges": f"WITH {FILES_SQL} SELECT src, module, false AS deferred, 'resolved' AS kind, value FROM imports_",
    "fan_in": f"WITH {FILES_SQL} SELECT value AS path, count(DISTINCT src) AS fan_in FROM imports_ GROUP BY value",
    "call_edges": f"""WITH {FILES_SQL} SELECT 'geo/nations/' || nw || '.py' AS src, 'geo/regions/' || rw || '.py' AS target, 'open_' || rw AS callee, 'start_' || nw AS caller, 9 AS line FROM n
        UNION ALL SELECT 'geo/suppliers/s' || s_suppkey || '.py', 'geo/nations/' || nw || '.py', 'start_' || nw, 'ship', 5 FROM s""",
    "class_hierarchy": f"WITH {FILES_SQL} SELECT 'geo/nations/' || nw || '.py' AS path, n_name || 'Place' AS class, area || 'Area' AS base, 'geo/regions/' || rw || '.py' AS base_path FROM n",
    "code_units": f"""WITH {FILES_SQL} SELECT 'geo/regions/' || rw || '.py' AS path, 0 AS off, area || 'Area' AS title, CAST(length(area) + 21 AS INT) AS n_chars FROM r
        UNION ALL SELECT 'geo/regions/' || rw || '.py', CAST(length(area) + 21 AS INT), 'open_' || rw, CAST(length(rw) + 28 AS INT) FROM r
        UNION ALL SELECT 'geo/nations/' || nw || '.py', 0, '', CAST(2 * length(rw) + length(area) + 39 AS INT) FROM n
        UNION ALL SELECT 'geo/nations/' || nw || '.py', CAST(2 * length(rw) + length(area) + 39 AS INT), n_name || 'Place', CAST(length(n_name) + length(area) + 28 AS INT) FROM n
        UNION ALL SELECT 'geo/nations/' || nw || '.py', CAST(2 * length(rw) + 2 * length(area) + length(n_name) + 67 AS INT), 'start_' || nw, CAST(length(nw) + length(rw) + 35 AS INT) FROM n
        UNION ALL SELECT 'geo/suppliers/s' || s_suppkey || '.py', 0, '', CAST(length(nw) + 22 AS INT) FROM s
        UNION ALL SELECT 'geo/suppliers/s' || s_suppkey || '.py', CAST(length(nw) + 22 AS INT), 'ship', CAST(2 * length(nw) + 45 AS INT) FROM s""",
    "skeleton_changes": f"""WITH {FILES_SQL} SELECT path, '+' AS change, kind || ' ' || name AS what FROM symbols_ WHERE path LIKE 'geo/suppliers/%'
        UNION ALL SELECT src, '+', 'import ' || module FROM imports_ WHERE src LIKE 'geo/suppliers/%'
        UNION ALL SELECT path, '~', kind || ' ' || name FROM symbols_ WHERE path LIKE 'geo/regions/%' AND kind = 'function'""",
    "html_to_markdown": f"""WITH {N_SQL} SELECT n_name || '.html' AS path, '# ' || n_name || ' & more' || chr(10) || chr(10) || 'in ' || r_name || ' there' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10)
        || 'a | ' || n_nationkey || chr(10) || 'b | c' || chr(10) || chr(10) || '```' || chr(10) || 'x' || chr(10) || '  y' || chr(10) || '```' || chr(10) || chr(10) || '[image: map]' AS markdown, NULL::VARCHAR AS reason FROM n""",
    "pdf_pages": f"""WITH {N_SQL} SELECT n_name || '.pdf' AS key, 1 AS page, 0 AS off, n_name || ' is (now)' || chr(10) || 'in ' || r_name AS text FROM n
        UNION ALL SELECT n_name || '.pdf', 2, CAST(length(n_name) + length(r_name) + 15 AS INT), 'Number ' || n_nationkey FROM n""",
    "full_tokens": f"""WITH p AS (SELECT p_partkey::VARCHAR AS key, p_size::VARCHAR AS size FROM part),
        t AS (SELECT key, unnest(['v1.' || size, '2024-05-06', size || 'kb', 'src/lib/p' || key || '.py', 'compiler', 'part_no_' || key, 'size', 'limit', 'part', key, 'sizelimit', 'v1', size, '2024', '05', '06', size || 'kb', 'src', 'lib', 'p' || key, 'py', 'com', 'piler', 'ete']) AS term FROM p)
        SELECT key, term, count(*) AS tf FROM t WHERE length(term) >= 2 GROUP BY key, term""",
    "section_by_title": f"WITH {N_SQL} SELECT 'nations/' || n_name || '.md' AS key, 'Place' AS title, 3 AS line, '## Place' || chr(10) || chr(10) || 'It lies in [[' || r_name || '|this region]].' || chr(10) AS section, CAST(1 AS BIGINT) AS matches FROM n",
    "name_search": "SELECT 'nations/' || n_name || '.md' AS path FROM nation WHERE contains(n_name, 'NATION_1')",
    "code_vocabulary": f"""WITH {FILES_SQL}, f AS (SELECT value AS path, count(DISTINCT src) AS fan_in FROM imports_ GROUP BY value ORDER BY 2 DESC, 1 LIMIT 10)
        SELECT DISTINCT f.path, fan_in, name FROM f JOIN symbols_ s ON s.path = f.path""",
    "pages_asof": f"""WITH {N_SQL}, w AS (SELECT n_name || '.pdf' AS key, length(n_name) + length(r_name) + 15 AS second FROM n)
        SELECT key, off, CAST(CASE WHEN off >= second THEN 2 ELSE 1 END AS INT) AS page FROM w, (SELECT CAST(unnest([0, 5, 25, 27, 29, 40]) AS INT) AS off)""",
    "front_properties": "SELECT p_partkey::VARCHAR AS key, unnest(['name', 'tags', 'aliases', 'size']) AS name, unnest([p_name, p_brand || ', part', 'part ' || p_partkey || ', ' || p_type, p_size::VARCHAR]) AS value FROM part",
    "alias_index": "SELECT 'p' || p_partkey AS title, unnest(['part ' || p_partkey, p_type]) AS alias FROM part",
    "clean_bodies": "SELECT p_partkey::VARCHAR AS key, 'Made by ' || replace(p_brand, '#', ' ') || ' the maker of type t/' || p_partkey || ' with at end.' AS body FROM part",
    "segments": """WITH s AS (SELECT s_suppkey::VARCHAR AS key, s_name, 'intro' || chr(10) || chr(10) AS intro, '# ' || s_name || chr(10) || chr(10) AS head, 'About ' || s_name || ' there is much to say.' AS line, chr(10) || chr(10) AS gap FROM supplier)
        SELECT key, CAST(1 AS INT) AS n, intro || head || line || gap || line || gap || line || gap || line || gap AS segment, '' AS kind FROM s
        UNION ALL SELECT key, 2, line || gap || line || gap || line || gap || line || gap, '' FROM s
        UNION ALL SELECT key, 3, '## References' || gap || '[1] a' || chr(10), 'references' FROM s""",
}
