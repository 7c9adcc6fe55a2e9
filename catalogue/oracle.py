"""SQL over the same tables that gives the same results as the queries, for DuckDB."""

from __future__ import annotations

# Corpora -------------------------------------------------------------------------------------------

DOC = """
doc AS (
  SELECT source AS repo_id, lang, doc_id, text, n_chars,
         lang || '/b' || (doc_id % 7) AS dir,
         'doc_' || doc_id || ['.md', '.log', '.py', '.PY', '.png', '', '.tar.gz', '.ipynb', '.json', '.pyc', '.txt'][(doc_id % 11 + 1)::INT] AS name,
         dir || '/' || name AS path,
         octet_length(encode(text))::BIGINT AS size,
         doc_id % 11 IN (4, 6, 9) AS is_binary
  FROM documents)"""

DIRS = """
dirs AS (
  SELECT repo_id, unnest(['', lang, dir]) AS path, * EXCLUDE (repo_id, path) FROM files)"""

PAGE = """
page AS (
  SELECT repo_id, path, arg_max(html, page_id) AS html FROM (
    SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo_id,
           coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1), '/+$', ''), ''), 'index.html') AS path,
           html, page_id
    FROM pages)
  GROUP BY ALL)"""

COMMITS = """
dated AS (
  SELECT d.*, coalesce(h.first_day, fallback) AS created, coalesce(h.last_day, fallback) AS modified
  FROM (SELECT *, strftime(DATE '1970-01-01' + n_chars::INT, '%Y-%m-%d') AS fallback FROM doc) d
  LEFT JOIN (SELECT user_id, strftime(arg_min(ts, event_id), '%Y-%m-%d') AS first_day,
                    strftime(arg_max(ts, event_id), '%Y-%m-%d') AS last_day
             FROM events GROUP BY user_id) h ON h.user_id = d.doc_id)"""

# Rules ---------------------------------------------------------------------------------------------

DEFAULTS = [
    (".git", r"(^|/)\.git(/|$)"),
    (".env", r"(^|/)\.env(/|$)"),
    (".env.local", r"(^|/)\.env\.local(/|$)"),
    (".env.*.local", r"(^|/)\.env\.[^/]*\.local(/|$)"),
    ("node_modules", r"(^|/)node_modules(/|$)"),
    ("__pycache__", r"(^|/)__pycache__(/|$)"),
    ("*.pyc", r"\.pyc(/|$)"),
    ("*.pyo", r"\.pyo(/|$)"),
    (".pytest_cache", r"(^|/)\.pytest_cache(/|$)"),
    (".coverage", r"(^|/)\.coverage(/|$)"),
    ("*.log", r"\.log(/|$)"),
    (".DS_Store", r"(^|/)\.DS_Store(/|$)"),
    ("Thumbs.db", r"(^|/)Thumbs\.db(/|$)"),
    (".vscode", r"(^|/)\.vscode(/|$)"),
    (".idea", r"(^|/)\.idea(/|$)"),
    ("*.swp", r"\.swp(/|$)"),
    ("*.swo", r"\.swo(/|$)"),
    ("*~", r"~(/|$)"),
]
USER = [
    ("b3/", r"(^|/)b3/"),
    ("en/b1", r"^en/b1(/|$)"),
    ("*.json", r"\.json(/|$)"),
    ("!doc_*8.json", r"(^|/)doc_[^/]*8\.json(/|$)"),
    ("/fr/b2/*", r"^fr/b2/[^/]"),
    ("doc_14.py", r"(^|/)doc_14\.py(/|$)"),
    ("*.log", r"\.log(/|$)"),
]


def rules(default: list[tuple[str, str]], user: list[tuple[str, str]]) -> str:
    rows = [("default", 1, *r) for r in default] + [("user", 3, *r) for r in user]
    values = ",\n".join(f"({i}, '{o}', {rank}, '{p}', {str(not p.startswith('!')).lower()}, '{x}')" for i, (o, rank, p, x) in enumerate(rows))
    return f"rules(ord, origin, origin_rank, pattern, include, regex) AS (VALUES {values})"


RULES = rules(DEFAULTS, USER)

# One row per file and matching rule; binary files meet no rule.
JUDGED = f"""
{DOC}, {RULES},
hits AS (
  SELECT f.repo_id, f.path, r.* FROM doc f JOIN rules r ON NOT f.is_binary AND regexp_matches(f.path, r.regex)),
decided AS (SELECT repo_id, path, arg_max(include, ord) AS last FROM hits GROUP BY ALL),
judged AS (
  SELECT f.*, is_binary OR coalesce(d.last, false) AS is_ignored,
         CASE WHEN is_binary THEN 'binary' WHEN d.last THEN 'pattern' END AS reason,
         CASE doc_id % 11 WHEN 4 THEN '.png' WHEN 6 THEN '.gz' WHEN 9 THEN '.pyc' END AS binary_extension
  FROM doc f LEFT JOIN decided d USING (repo_id, path)),
credits AS (
  SELECT h.*, row_number() OVER (PARTITION BY h.repo_id, h.path ORDER BY ord) - 1 AS nth
  FROM hits h JOIN judged j USING (repo_id, path) WHERE h.include = j.is_ignored)"""

SIZE_LABEL = """
CASE WHEN {0} < 1024 THEN format('{{:.2f}} B', {0}::DOUBLE)
     WHEN {0} < 1048576 THEN format('{{:.2f}} KB', {0} / 1024.0::DOUBLE)
     WHEN {0} < 1073741824 THEN format('{{:.2f}} MB', {0} / 1048576.0::DOUBLE)
     ELSE format('{{:.2f}} GB', {0} / 1073741824.0::DOUBLE) END"""


def tree(levels: list[str], files: str, order: str, label: str = "''", partition: str = "repo_id") -> str:
    """CTEs that draw a tree of fixed depth; ``files`` has one column per level (the last is the name)."""
    keys = ", ".join(levels)
    parts = []
    for depth in range(1, len(levels) + 1):
        held = levels[:depth]
        is_dir = depth < len(levels)
        group = ", ".join([partition, *held])
        above = ", ".join([partition, *held[:-1]])
        parts.append(f"""
n{depth} AS (
  SELECT {group}, {held[-1]} AS name, {str(is_dir).lower()} AS is_dir, concat_ws('/', {", ".join(held)}) AS path,
         sum(size)::BIGINT AS size, min(created) AS created, max(modified) AS modified, sum(n4)::BIGINT AS n4
  FROM {files} GROUP BY ALL),
r{depth} AS (
  SELECT *, row_number() OVER (PARTITION BY {above} ORDER BY {order}) AS rn,
         count(*) OVER (PARTITION BY {above}) AS siblings
  FROM n{depth})""")
    unions = [f"SELECT {partition}, '' AS path, '' AS place, '.' || {label} AS line FROM (SELECT {partition}, sum(size)::BIGINT AS size, min(created) AS created, max(modified) AS modified, sum(n4)::BIGINT AS n4 FROM {files} GROUP BY {partition})"]
    for depth in range(1, len(levels) + 1):
        joins = "".join(
            f" JOIN r{d} a{d} ON " + " AND ".join(f"a{d}.{c} = n.{c}" for c in [partition, *levels[:d]])
            for d in range(1, depth)
        )
        place = " || '.' || ".join([*[f"lpad(a{d}.rn::VARCHAR, 6, '0')" for d in range(1, depth)], "lpad(n.rn::VARCHAR, 6, '0')"])
        indent = " || ".join([*[f"CASE WHEN a{d}.rn = a{d}.siblings THEN '    ' ELSE '│   ' END" for d in range(1, depth)], "''"])
        text = label
        for column in ("size", "created", "modified", "n4"):
            text = text.replace(f"<{column}>", f"n.{column}")
        slash = "'/'" if depth < len(levels) else "''"
        unions.append(
            f"SELECT n.{partition}, n.path, {place} AS place, {indent} || CASE WHEN n.rn = n.siblings THEN '└── ' ELSE '├── ' END || n.name || {slash} || {text} AS line FROM r{depth} n{joins}"
        )
    root = label
    for column in ("size", "created", "modified", "n4"):
        root = root.replace(f"<{column}>", column)
    unions[0] = unions[0].replace(f"'.' || {label}", f"'.' || {root}")
    _ = keys
    return ",".join(parts) + ",\ndrawn AS (" + "\nUNION ALL ".join(unions) + ")"


BY_NAME = "lower(name), name"
BY_SIZE = "size DESC, lower(name), name"
BY_MODIFIED = "coalesce(modified, '0000-00-00') DESC, lower(name) DESC, name DESC"

PLAIN = "SELECT repo_id, lang, split_part(dir, '/', 2) AS batch, name, path, size, NULL::VARCHAR AS created, NULL::VARCHAR AS modified, NULL::BIGINT AS n4"

# All nodes but the roots, for sibling ranks.
def siblings(columns: str, aggregates: str) -> str:
    return f"""
nodes AS (
  SELECT repo_id, lang AS path, '' AS parent, lang AS name, true AS is_dir, {aggregates} FROM f GROUP BY ALL
  UNION ALL SELECT repo_id, dir, lang, split_part(dir, '/', 2), true, {aggregates} FROM f GROUP BY ALL
  UNION ALL SELECT repo_id, path, dir, name, false, {columns} FROM f)"""


COUNTS = """
counted AS (
  SELECT repo_id, lang, dir, path, name, CASE WHEN is_binary THEN length('binary content (' || size || ' bytes)') ELSE length(text) END AS chars
  FROM doc),
counts AS (
  SELECT repo_id, lang, dir, path, unnest([
    {'model': 'chars-1', 'n': ceil(chars / 1.0::DOUBLE)::BIGINT},
    {'model': 'chars-4', 'n': ceil(chars / 4.0::DOUBLE)::BIGINT},
    {'model': 'chars-3.5', 'n': ceil(chars / 3.5::DOUBLE)::BIGINT}], recursive := true)
  FROM counted WHERE chars > 0)"""

HEADER = "'Project Structure:' || chr(10) || '```' || chr(10)"

ORACLE = {
    "directory_totals": f"""WITH {DOC}, files AS (SELECT repo_id, lang, dir, path, size FROM doc), {DIRS}
        SELECT repo_id, path, count(*) AS n_files, sum(size)::BIGINT AS size FROM dirs GROUP BY ALL""",
    "deep_directory_totals": f"""WITH {DOC}, l AS (SELECT repo_id, unnest(range(doc_id % 500 + 1))::INT AS level, size FROM doc)
        SELECT repo_id, level, md5(array_to_string(list_transform(range(1, level + 1), lambda i: 'd' || i), '/')) AS path_md5, count(*) AS n_files, sum(size)::BIGINT AS size
        FROM l GROUP BY repo_id, level""",
    "order_value_by_place": """
        WITH o AS (SELECT r_name, n_name, c_mktsegment, o_totalprice::DECIMAL(18,2) AS value
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT concat_ws('/', r_name, n_name, c_mktsegment) AS path, count(*) AS n_files, sum(value)::DOUBLE AS value
        FROM o GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
    "extension_notions": f"""WITH {DOC}, e AS (SELECT repo_id, path, ['.md', '.log', '.py', '.PY', '.png', '', '.gz', '.ipynb', '.json', '.pyc', '.txt'][(doc_id % 11 + 1)::INT] AS ext FROM doc)
        SELECT repo_id, path, lower(ltrim(ext, '.')) AS node, ext AS suffix, ext AS split, ltrim(ext, '.') AS fence FROM e""",
    "tree_by_name": f"""WITH {DOC}, f AS ({PLAIN} FROM doc),
        {tree(["lang", "batch", "name"], "f", BY_NAME)}
        SELECT repo_id, path, place, line FROM drawn""",
    "tree_by_size_with_stats": f"""WITH {JUDGED}, f AS ({PLAIN} FROM judged WHERE NOT is_ignored),
        {tree(["lang", "batch", "name"], "f", BY_SIZE, "' (' || " + SIZE_LABEL.format("<size>") + " || ')'")}
        SELECT repo_id, path, place, line FROM drawn""",
    "order_tree_structure": f"""
        WITH f AS (SELECT 'orders' AS repo_id, r_name AS a, n_name AS b, c_mktsegment AS c, o_orderkey::VARCHAR AS name, 0 AS size, NULL::VARCHAR AS created, NULL::VARCHAR AS modified, NULL::BIGINT AS n4
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        {tree(["a", "b", "c", "name"], "f", BY_NAME)}
        SELECT path, place, line FROM drawn""",
    "siblings_by_size": f"""WITH {DOC}, f AS (SELECT * FROM doc), {siblings("size", "sum(size)::BIGINT AS size")}
        SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id, parent ORDER BY is_dir DESC, size DESC, lower(name), name) AS rn, size, {SIZE_LABEL.format("size")} AS label FROM nodes""",
    "token_counts": f"WITH {DOC}, {COUNTS} SELECT repo_id, path, model, n FROM counts",
    "directory_tokens": f"""WITH {DOC}, {COUNTS}, files AS (SELECT * FROM counts), {DIRS}
        SELECT repo_id, path, model, sum(n)::BIGINT AS n FROM dirs GROUP BY ALL""",
    "token_totals": f"WITH {DOC}, {COUNTS} SELECT model, sum(n)::BIGINT AS n FROM counts GROUP BY model",
    "siblings_by_tokens": f"""WITH {DOC}, {COUNTS}, f AS (SELECT c.*, name FROM counts c JOIN doc USING (repo_id, path) WHERE model = 'chars-4'),
        {siblings("n", "sum(n)::BIGINT AS n")}
        SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id, parent ORDER BY is_dir DESC, n DESC, lower(name), name) AS rn, n FROM nodes""",
    "file_dates": f"WITH {DOC}, {COMMITS} SELECT repo_id, path, created, modified FROM dated",
    "directory_dates": f"""WITH {DOC}, {COMMITS}, files AS (SELECT repo_id, lang, dir, path, created, modified FROM dated), {DIRS}
        SELECT repo_id, path, min(created) AS created, max(modified) AS modified FROM dirs GROUP BY ALL""",
    "siblings_by_modified": f"""WITH {DOC}, {COMMITS}, f AS (SELECT * FROM dated), {siblings("modified", "max(modified) AS modified")}
        SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id, parent ORDER BY is_dir DESC, modified DESC, lower(name) DESC, name DESC) AS rn, modified FROM nodes""",
    "siblings_by_created": f"""WITH {DOC}, {COMMITS}, f AS (SELECT * FROM dated),
        {siblings("size, created, modified", "sum(size)::BIGINT AS size, min(created) AS created, max(modified) AS modified")}
        SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id, parent ORDER BY is_dir DESC, created DESC, lower(name) DESC, name DESC) AS rn, created,
               ' (' || {SIZE_LABEL.format("size")} || '; created: ' || created || '; modified: ' || modified || ')' AS label FROM nodes""",
    "binary_files": f"""WITH {DOC} SELECT repo_id, path,
        lower(regexp_extract(name, '[^.](\\.[^.]*)$', 1)) IN ('.png', '.gz', '.pyc') OR contains(text, chr(0)) AS is_binary FROM doc""",
    "rule_verdicts": f"WITH {JUDGED} SELECT repo_id, path, is_ignored, is_binary FROM judged",
    "removed_files": f"WITH {JUDGED} SELECT repo_id, path, reason, binary_extension FROM judged WHERE is_ignored",
    "files_within_level": f"""WITH {PAGE}
        SELECT repo_id, path, octet_length(encode(html))::BIGINT AS size FROM page
        WHERE len(string_split(path, '/')) <= 2 AND NOT regexp_matches(path, '\\.html(/|$)') AND NOT regexp_matches(path, '^de/')""",
    "credited_rules": f"WITH {JUDGED} SELECT repo_id, path, nth::INT AS nth, pattern FROM credits",
    "binaries_kept_or_not": f"""WITH {JUDGED}
        SELECT repo_id, path, is_binary, is_ignored AS without, is_ignored AND NOT is_binary AS included FROM judged""",
    "pattern_hits": f"""WITH {JUDGED} SELECT repo_id, arg_min(origin, origin_rank) AS origin, pattern, count(*) AS hits FROM credits GROUP BY repo_id, pattern""",
    "pattern_hits_of_all": f"""WITH {JUDGED} SELECT arg_min(origin, origin_rank) AS origin, pattern, count(*) AS hits FROM credits GROUP BY pattern""",
    "binary_extensions": f"""WITH {JUDGED} SELECT repo_id, binary_extension, count(*) AS files, count(*) FILTER (is_ignored) AS blocked
        FROM judged WHERE binary_extension <> '' GROUP BY ALL""",
    "ignore_summary": f"""WITH {JUDGED}, c AS (SELECT repo_id, count(*) AS a, count(*) FILTER (is_ignored) AS b, count(*) FILTER (is_binary) AS c,
          count(*) FILTER (is_binary AND is_ignored) AS d FROM judged GROUP BY repo_id)
        SELECT repo_id, unnest(['Total files checked', 'Files ignored', 'Binary files found', 'Binary files blocked', 'Files included']) AS category,
          unnest([a, b, c, d, a - b]) AS count FROM c""",
    "first_ignored_files": f"""WITH {JUDGED}, p AS (SELECT repo_id, path, string_agg(pattern, ', ' ORDER BY ord) AS patterns FROM credits GROUP BY ALL),
        r AS (SELECT j.repo_id, path AS file, reason, is_binary, coalesce(patterns, '-') AS patterns,
               row_number() OVER (PARTITION BY j.repo_id ORDER BY path) AS line, count(*) OVER (PARTITION BY j.repo_id) AS n
             FROM judged j LEFT JOIN p USING (repo_id, path) WHERE is_ignored)
        SELECT repo_id, line::INT AS line, file, reason, is_binary, patterns FROM r WHERE line <= 20
        UNION ALL SELECT DISTINCT repo_id, 21, '... and ' || (n - 20) || ' more', '', NULL, '' FROM r WHERE n > 20""",
    "pattern_strings": f"""WITH {JUDGED}, h AS (SELECT repo_id, arg_min(origin, origin_rank) AS origin, pattern FROM credits GROUP BY repo_id, pattern)
        SELECT repo_id, origin, row_number() OVER g AS ordinal, CASE WHEN row_number() OVER g > 1 THEN ',' ELSE '' END || pattern AS patterns
        FROM h WINDOW g AS (PARTITION BY repo_id, origin ORDER BY pattern)""",
    "extension_strings": f"""WITH {JUDGED}, x AS (SELECT DISTINCT repo_id, binary_extension AS e FROM judged WHERE is_binary)
        SELECT repo_id, row_number() OVER g AS ordinal, CASE WHEN row_number() OVER g > 1 THEN ',' ELSE '' END || '*' || e AS extensions
        FROM x WINDOW g AS (PARTITION BY repo_id ORDER BY e)""",
    "extension_statistics": f"""WITH {DOC} SELECT repo_id, ['md', 'log', 'py', 'py', 'png', '', 'gz', 'ipynb', 'json', 'pyc', 'txt'][(doc_id % 11 + 1)::INT] AS extension,
        count(*) AS files, sum(size)::BIGINT AS bytes FROM doc GROUP BY ALL""",
    "text_sections": """WITH c AS (SELECT conv_id::VARCHAR AS repo_id, 'turn_' || lpad(turn::VARCHAR, 4, '0') || '_' || role || '.md' AS path, text FROM conversations WHERE text <> '')
        SELECT repo_id, path,
          '## ' || path || chr(10) || chr(10) || '```' || chr(10) || replace(text, '```', '''''''') || chr(10) || '```' || chr(10) || chr(10) AS section FROM c""",
    "xml_sections": f"""WITH {PAGE}, n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS idx,
            replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM page WHERE html <> '')
        SELECT repo_id, idx, path, md5('<document index="' || idx || '">' || chr(10) || '<source>' ||
          replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</source>' || chr(10) ||
          '<document_content>' || chr(10) || '<![CDATA[' || chr(10) || replace(text, ']]>', ']]]]><![CDATA[>') || chr(10) || ']]>' || chr(10) ||
          '</document_content>' || chr(10) || '</document>' || chr(10)) AS digest FROM n""",
    "markdown_sections": f"""WITH {DOC}, t AS (SELECT *, CASE WHEN is_binary THEN 'binary content (' || size || ' bytes)'
            ELSE replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS shown,
            strftime(DATE '1970-01-01' + n_chars::INT, '%Y-%m-%d') AS day,
            ['md', 'log', 'py', 'PY', 'png', '', 'gz', 'ipynb', 'json', 'pyc', 'txt'][(doc_id % 11 + 1)::INT] AS fence FROM doc)
        SELECT repo_id, path,
          md5('## ' || path || chr(10) || chr(10) || '---' || chr(10) || 'created: ' || day || chr(10) || 'modified: ' || day || chr(10) || '---' || chr(10) || chr(10) ||
              '```' || fence || chr(10) || shown || chr(10) || '```' || chr(10) || chr(10)) AS digest
        FROM t WHERE shown <> ''""",
    "written_files": f"""WITH {DOC} SELECT repo_id, count(*) AS n_files FROM doc WHERE size <= 5242880 AND (is_binary OR text <> '') GROUP BY repo_id""",
    "readable_files": f"""WITH {DOC}, t AS (SELECT repo_id, CASE WHEN size > 5000 THEN '' WHEN is_binary THEN 'binary content (' || size || ' bytes)'
            ELSE replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS shown, size, is_binary FROM doc)
        SELECT repo_id, CASE WHEN size > 5000 THEN 'capped' WHEN shown = '' THEN 'empty' WHEN is_binary THEN 'placeholder' ELSE 'text' END AS kind,
          count(*) AS files, sum(length(shown))::BIGINT AS chars FROM t GROUP BY ALL""",
    "notebook_texts": f"""WITH {DOC}, c AS (
          SELECT repo_id, doc_id, lang || '/doc_' || doc_id || '.ipynb' AS path, unnest(string_split(text, chr(10))) AS cell, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM doc),
        n AS (SELECT repo_id, path, string_agg(CASE WHEN cell <> '' AND i % 3 = 0 THEN '# Code cell' || chr(10) || cell || chr(10) || chr(10)
                  WHEN cell <> '' AND i % 3 = 1 THEN '# Markdown cell' || chr(10) || cell || chr(10) || chr(10) ELSE '' END, '' ORDER BY i) AS text
          FROM c GROUP BY ALL)
        SELECT repo_id, path, length(text) AS chars, md5(text) AS digest FROM n""",
    "latest_pages": f"WITH {PAGE} SELECT repo_id, path, octet_length(encode(html))::BIGINT AS size, md5(html) AS digest FROM page",
    "path_conflicts": f"WITH {DOC} SELECT repo_id, lang AS path, count(*) AS n_below FROM doc GROUP BY ALL",
    "refreshed_totals": f"""WITH {DOC}, files AS (
          SELECT repo_id, lang, dir, path, CASE WHEN quality = 0 THEN 0 ELSE size END AS size,
                 CASE WHEN quality = 0 THEN '2030-01-01' ELSE strftime(DATE '1970-01-01' + n_chars::INT, '%Y-%m-%d') END AS day
          FROM doc LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0), {DIRS}
        SELECT repo_id, path, count(*) AS n_files, sum(size)::BIGINT AS size, min(day) AS created, max(day) AS modified FROM dirs GROUP BY ALL""",
    "bundle_text": f"""WITH f AS (SELECT conv_id::VARCHAR AS repo_id, 'turn_' || lpad(turn::VARCHAR, 4, '0') || '_' || role || '.md' AS name, text,
            0 AS size, NULL::VARCHAR AS created, NULL::VARCHAR AS modified, NULL::BIGINT AS n4 FROM conversations WHERE role <> 'system'),
        {tree(["name"], "f", BY_NAME)},
        s AS (SELECT * FROM f WHERE text <> '')
        SELECT repo_id, '000001' || CASE WHEN place = '' THEN '' ELSE '.' || place END AS place, '' AS path, line || chr(10) AS chunk FROM drawn
        UNION ALL SELECT DISTINCT repo_id, '000000', '', {HEADER} FROM f
        UNION ALL SELECT DISTINCT repo_id, '000002', '', '```' || chr(10) || chr(10) FROM f
        UNION ALL SELECT repo_id, '000003', name, '## ' || name || chr(10) || chr(10) || '```' || chr(10) ||
          replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '```', '''''''') || chr(10) || '```' || chr(10) || chr(10) FROM s""",
    "running_totals": f"""WITH {DOC}, files AS (SELECT repo_id, lang, dir, path, size FROM doc), {DIRS}
        SELECT repo_id, path, count(*) AS n_files, sum(size)::BIGINT AS size FROM dirs GROUP BY ALL""",
}

ORACLE["processed_texts"] = f"""WITH {DOC} SELECT repo_id, path,
    len(string_split(CASE WHEN is_binary THEN 'binary content (' || size || ' bytes)' ELSE replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END, ' ')) AS words
    FROM doc WHERE is_binary OR text <> ''"""

ORACLE["arriving_texts"] = f"""WITH {JUDGED}, {COUNTS}
    SELECT c.repo_id, c.path, model, n FROM counts c JOIN judged j USING (repo_id, path) WHERE NOT is_ignored"""

ORACLE["log_dates"] = f"""WITH {DOC} SELECT repo_id, path, strftime(arg_min(ts, event_id), '%Y-%m-%d') AS h_created, strftime(arg_max(ts, event_id), '%Y-%m-%d') AS h_modified
    FROM events JOIN doc ON user_id = doc_id GROUP BY ALL"""

ORACLE["token_maps"] = f"""WITH {DOC}, {COUNTS}, listed AS (
      SELECT repo_id, path, string_agg('"' || model || '":' || n, ',' ORDER BY CASE model WHEN 'chars-1' THEN 1 WHEN 'chars-4' THEN 2 ELSE 3 END) AS pairs FROM counts GROUP BY ALL)
    SELECT repo_id, path, '{{' || coalesce(pairs, '') || '}}' AS counts FROM doc LEFT JOIN listed USING (repo_id, path)"""

ORACLE["own_detector_and_reader"] = f"""WITH {DOC}, t AS (SELECT *, doc_id % 11 = 1 AS marked, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS plain FROM doc)
    SELECT repo_id, path, marked AS is_binary,
      md5(CASE WHEN marked THEN 'binary content (' || size || ' bytes)' WHEN doc_id % 11 = 10 THEN '# ' || path || chr(10) || text ELSE plain END) AS digest FROM t"""

ORACLE["own_layout"] = """WITH c AS (SELECT conv_id::VARCHAR AS repo_id, 'turn_' || lpad(turn::VARCHAR, 4, '0') || '_' || role || '.md' AS path,
      replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM conversations WHERE text <> ''),
    n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS idx FROM c)
    SELECT repo_id, idx, path, idx || ' ' || path || ' ' || length(text) || chr(10) AS section FROM n"""

ORACLE["structure_only"] = f"""WITH {JUDGED}, f AS ({PLAIN} FROM judged WHERE is_ignored), {tree(["lang", "batch", "name"], "f", BY_NAME)}
    SELECT repo_id, '000001' || CASE WHEN place = '' THEN '' ELSE '.' || place END AS place, line || chr(10) AS chunk FROM drawn
    UNION ALL SELECT DISTINCT repo_id, unnest(['000000', '000002', '000004']),
      unnest(['<documents>' || chr(10) || '<structure>' || chr(10) || '<![CDATA[' || chr(10), ']]>' || chr(10) || '</structure>' || chr(10), '</documents>' || chr(10)]) FROM f"""

ORACLE["bundle_positions"] = f"""WITH b AS (SELECT *, octet_length(encode(chunk)) AS n FROM ({ORACLE["bundle_text"]}))
    SELECT repo_id, place, path, (sum(n) OVER (PARTITION BY repo_id ORDER BY place, path ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS "offset", n::BIGINT AS bytes FROM b"""

ORACLE["bundle_spans"] = f"""SELECT repo_id, place, path, md5(chunk) AS digest FROM ({ORACLE["bundle_text"]})"""


def _structure_forms() -> str:
    edges = {
        "text": {"000000": HEADER, "000002": "'```' || chr(10)"},
        "markdown": {"000000": "'# Project Structure' || chr(10) || chr(10) || '```' || chr(10)", "000002": "'```' || chr(10) || chr(10)"},
        "xml": {
            "000000": "'<documents>' || chr(10) || '<structure>' || chr(10) || '<![CDATA[' || chr(10)",
            "000002": "']]>' || chr(10) || '</structure>' || chr(10)",
            "000004": "'</documents>' || chr(10)",
        },
    }
    fixed = [f"SELECT '{form}' AS form, repo_id, '{place}' AS place, {chunk} AS chunk FROM every" for form, pieces in edges.items() for place, chunk in pieces.items()]
    return f"""WITH every AS (SELECT DISTINCT conv_id::VARCHAR AS repo_id FROM conversations),
    f AS (SELECT conv_id::VARCHAR AS repo_id, 'turn_' || lpad(turn::VARCHAR, 4, '0') || '_' || role || '.md' AS name,
        0 AS size, NULL::VARCHAR AS created, NULL::VARCHAR AS modified, NULL::BIGINT AS n4 FROM conversations WHERE turn BETWEEN 3 AND 9),
    {tree(["name"], "f", BY_NAME)},
    shown AS (
        SELECT repo_id, '000001' || CASE WHEN place = '' THEN '' ELSE '.' || place END AS place, line || chr(10) AS chunk FROM drawn
        UNION ALL SELECT repo_id, '000001', '.' || chr(10) FROM every WHERE repo_id NOT IN (SELECT repo_id FROM f))
    SELECT form, repo_id, place, chunk FROM shown, (VALUES ('text'), ('xml'), ('markdown')) AS forms(form)
    UNION ALL """ + " UNION ALL ".join(fixed)


ORACLE["structure_forms"] = _structure_forms()

# Whole documents in SQL; the written files are compared by their lines and bytes.
_DOCUMENTS = """WITH c AS (
      SELECT conv_id::VARCHAR AS repo_id, 'turn_' || lpad(turn::VARCHAR, 4, '0') || '_' || role || '.md' AS name,
             replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM conversations),
    docs AS (
      SELECT repo_id, '# Project Structure' || chr(10) || chr(10) || '```' || chr(10) || '.' || chr(10) ||
             string_agg(CASE WHEN last THEN '└── ' ELSE '├── ' END || name || chr(10), '' ORDER BY lower(name), name) || '```' || chr(10) || chr(10) ||
             coalesce(string_agg('## ' || name || chr(10) || chr(10) || '```md' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY name) FILTER (text <> ''), '') AS doc
      FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY lower(name) DESC, name DESC) = 1 AS last FROM c) GROUP BY repo_id)"""

ORACLE["written_bundles"] = f"""{_DOCUMENTS}
    SELECT repo_id, (length(doc) - length(replace(doc, chr(10), '')))::BIGINT AS lines, length(replace(doc, chr(10), ''))::BIGINT AS chars FROM docs"""

ORACLE["scanned_directory"] = f"""{_DOCUMENTS}
    SELECT repo_id, octet_length(encode(doc))::BIGINT AS bytes, octet_length(encode(doc))::BIGINT AS read FROM docs"""

# Rules of the ignore files, each in its folder, and the user's; the order is the one they apply in.
_NESTED = """
langs AS (SELECT DISTINCT repo_id, lang FROM doc),
filed(repo_id, rank, dir, line, pattern, include, regex) AS (
  SELECT repo_id, 1, '', unnest([1, 2, 3, 4]), unnest(['*.json', 'en/b1', '/fr/b2/*', '!doc_1*.log']), unnest([true, true, true, false]),
         unnest(['\\.json(/|$)', '^en/b1(/|$)', '^fr/b2/[^/]', '(^|/)doc_1[^/]*\\.log(/|$)'])
  FROM (SELECT DISTINCT repo_id FROM doc)
  UNION ALL
  SELECT repo_id, 2, lang, unnest([1, 2, 3, 4]), unnest([lang || '/b3/', lang || '/*.txt', '!' || lang || '/b' || length(lang) || '/*.json', lang || '/b?/doc_*5*']),
         unnest([true, true, false, true]),
         unnest(['^' || lang || '/b3/', '^' || lang || '/[^/]*\\.txt(/|$)', '^' || lang || '/b' || length(lang) || '/[^/]*\\.json(/|$)', '^' || lang || '/b[^/]/doc_[^/]*5[^/]*(/|$)'])
  FROM langs)"""

_IGNORE_FILE_USER = [("*.md", r"\.md(/|$)"), ("!doc_2*.md", r"(^|/)doc_2[^/]*\.md(/|$)")]

ORACLE["ignore_file_verdicts"] = f"""WITH {DOC}, {rules(DEFAULTS, _IGNORE_FILE_USER)}, {_NESTED},
files AS (
  SELECT repo_id, path, is_binary FROM doc
  UNION ALL SELECT repo_id, lang || '/.gitignore', false FROM langs
  UNION ALL SELECT DISTINCT repo_id, '.gitignore', false FROM doc),
hits AS (
  SELECT f.repo_id, f.path, origin_rank * 1000000 + ord AS pos, pattern, include FROM files f JOIN rules r ON NOT is_binary AND regexp_matches(path, regex)
  UNION ALL
  SELECT f.repo_id, f.path, 2000000 + rank * 1000 + line, pattern, include FROM files f JOIN filed r ON f.repo_id = r.repo_id AND NOT is_binary AND regexp_matches(path, regex)),
decided AS (SELECT repo_id, path, arg_max(include, pos) AS last FROM hits GROUP BY ALL),
judged AS (SELECT f.*, is_binary OR coalesce(last, false) AS is_ignored, CASE WHEN is_binary THEN 'binary' WHEN last THEN 'pattern' END AS reason
  FROM files f LEFT JOIN decided USING (repo_id, path)),
credit AS (SELECT h.repo_id, h.path, string_agg(pattern, '|' ORDER BY pos) AS credited FROM hits h JOIN judged j USING (repo_id, path) WHERE include = is_ignored GROUP BY ALL)
SELECT repo_id, path, is_ignored, reason, coalesce(credited, '') AS credited FROM judged LEFT JOIN credit USING (repo_id, path)"""

_MANY = f"""{DOC}, {rules(DEFAULTS, [("!doc_3*.md", r"(^|/)doc_3[^/]*[.]md(/|$)")])},
files AS (
  SELECT repo_id, lang, doc_id, path, name, is_binary FROM doc
  UNION ALL SELECT DISTINCT repo_id, NULL, NULL, '.gitignore', '.gitignore', false FROM doc),
filed AS (
  SELECT 2000000 + p_partkey * 5 AS pos, p_partkey AS k, 0 AS nth, 'doc_' || p_partkey || '.md' AS pattern FROM part
  UNION ALL SELECT 2000000 + p_partkey * 5 + 1, p_partkey, 1, '*' || p_partkey || '.py' FROM part
  UNION ALL SELECT 2000000 + p_partkey * 5 + 2, p_partkey, 2, '/en/b' || (p_partkey % 7) || '/doc_' || p_partkey || '.log' FROM part
  UNION ALL SELECT 2000000 + p_partkey * 5 + 3, p_partkey, 3, 'doc_' || p_partkey || '*' FROM part
  UNION ALL SELECT 2000000 + p_partkey * 5 + 4, p_partkey, 4, '!/de/*/doc_' || p_partkey || '.txt' FROM part),
hits AS (
  SELECT f.repo_id, f.path, origin, origin_rank * 1000000 + CASE WHEN origin = 'user' THEN 1000000000 ELSE ord END AS pos, pattern, include
  FROM files f JOIN rules r ON NOT is_binary AND regexp_matches(path, regex)
  UNION ALL
  SELECT f.repo_id, f.path, 'gitignore', pos, pattern, nth <> 4 FROM files f JOIN filed r ON NOT is_binary AND CASE nth
    WHEN 0 THEN f.name = r.pattern
    WHEN 1 THEN ends_with(f.name, substr(r.pattern, 2))
    WHEN 2 THEN '/' || f.path = r.pattern
    WHEN 3 THEN starts_with(f.name, 'doc_' || k)
    ELSE f.lang = 'de' AND f.name = 'doc_' || k || '.txt' END),
decided AS (SELECT repo_id, path, arg_max(include, pos) AS last FROM hits GROUP BY ALL),
judged AS (SELECT f.*, is_binary OR coalesce(last, false) AS is_ignored, CASE WHEN is_binary THEN 'binary' WHEN last THEN 'pattern' END AS reason
  FROM files f LEFT JOIN decided USING (repo_id, path))"""

ORACLE["many_rules_verdicts"] = f"WITH {_MANY} SELECT repo_id, path, is_ignored, reason FROM judged"

ORACLE["many_rules_hits"] = f"""WITH {_MANY}
SELECT h.repo_id, min(origin) AS origin, pattern, count(*) AS hits FROM hits h JOIN judged j USING (repo_id, path) WHERE include = is_ignored GROUP BY h.repo_id, pattern"""

ORACLE["late_ignore_files"] = f"""SELECT repo_id, path, is_ignored, reason FROM ({ORACLE["ignore_file_verdicts"]})"""

ORACLE["judged_batches"] = f"""WITH {JUDGED.replace("doc_id % 11 IN (4, 6, 9) AS is_binary", "doc_id % 11 = 1 AS is_binary")}
    SELECT repo_id, path, is_ignored, is_binary, reason FROM judged"""

ORACLE["tree_line_numbers"] = f"""SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY place) AS line_no FROM ({ORACLE["tree_by_name"]})"""

_LISTING_LABEL = (
    "' (' || " + SIZE_LABEL.format("<size>")
    + " || '; chars-4:' || <n4> || '; created: ' || <created> || '; modified: ' || <modified> || ')'"
)

ORACLE["listing_with_stats"] = f"""WITH {JUDGED}, {COMMITS.replace("FROM doc)", "FROM judged WHERE NOT is_ignored)")},
f AS (SELECT repo_id, lang, split_part(dir, '/', 2) AS batch, name, path, size, created, modified,
             ceil(length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) / 4.0::DOUBLE)::BIGINT AS n4 FROM dated),
{tree(["lang", "batch", "name"], "f", BY_MODIFIED, _LISTING_LABEL)}
SELECT repo_id, path, place, line FROM drawn"""

ORACLE["all_files"] = f"""WITH {JUDGED}
    SELECT repo_id, path, is_ignored, reason, CASE WHEN is_ignored THEN 'removed' ELSE 'included' END AS part FROM judged"""

# Each part of the whole report: its columns by name, between bars.
_PARTS = {
    "summary": ("ignore_summary", "category, count"),
    "patterns": ("pattern_hits", "hits, origin, pattern"),
    "binary_extensions": ("binary_extensions", "binary_extension, blocked, files"),
    "ignored_files": ("first_ignored_files", "file, is_binary, line, patterns, reason"),
    "pattern_strings": ("pattern_strings", "ordinal, origin, patterns"),
    "extension_strings": ("extension_strings", "extensions, ordinal"),
}


def _whole_report() -> str:
    rows = [f"SELECT repo_id, '{name}' AS part, concat_ws('|', {columns}) AS told FROM ({ORACLE[query]})" for name, (query, columns) in _PARTS.items()]
    rows.append(f"""SELECT repo_id, 'extensions', concat_ws('|', sum(size)::BIGINT, extension, count(*)) FROM (WITH {JUDGED}
        SELECT *, ['md', 'log', 'py', 'py', 'png', '', 'gz', 'ipynb', 'json', 'pyc', 'txt'][(doc_id % 11 + 1)::INT] AS extension FROM judged WHERE NOT is_ignored)
        GROUP BY repo_id, extension""")
    return "\nUNION ALL ".join(rows)


ORACLE["ignore_report"] = _whole_report()
ORACLE["ignore_report_of_all"] = f"SELECT part, told FROM ({ORACLE['ignore_report'].replace('source AS repo_id', "'' AS repo_id")})"

# Documents with texts that the tables do not hold: empty, other line ends, fences, an end of CDATA, NUL.
_RARE = f"""edited AS (
  SELECT * REPLACE (CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN text || chr(13) || chr(10) || 'x' || chr(13) || 'y' WHEN 2 THEN '```' || text || chr(10) || '```'
    WHEN 3 THEN text || ']]>' ELSE text || chr(0) END AS text) FROM documents),
{DOC.replace("FROM documents", "FROM edited").replace("doc_id % 11 IN (4, 6, 9)", "(doc_id % 11 IN (4, 6, 9) OR doc_id % 5 = 4)")},
shown AS (SELECT *, CASE WHEN is_binary THEN 'binary content (' || size || ' bytes)'
  ELSE replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS plain FROM doc)"""

ORACLE["rare_texts"] = f"WITH {_RARE} SELECT repo_id, path, is_binary, plain <> '' AS has_text, md5(nullif(plain, '')) AS digest FROM shown"

ORACLE["rare_text_sections"] = f"""WITH {_RARE} SELECT repo_id, path, md5('## ' || path || chr(10) || chr(10) || '```' || chr(10) ||
    replace(plain, '```', '''''''') || chr(10) || '```' || chr(10) || chr(10)) AS digest FROM shown WHERE plain <> ''"""

ORACLE["rare_xml_sections"] = f"""WITH {_RARE}, n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS idx FROM shown WHERE plain <> '')
    SELECT repo_id, idx, path, md5('<document index="' || idx || '">' || chr(10) || '<source>' || path || '</source>' || chr(10) ||
      '<document_content>' || chr(10) || '<![CDATA[' || chr(10) || replace(plain, ']]>', ']]]]><![CDATA[>') || chr(10) || ']]>' || chr(10) ||
      '</document_content>' || chr(10) || '</document>' || chr(10)) AS digest FROM n"""
