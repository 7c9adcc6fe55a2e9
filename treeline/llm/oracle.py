"""SQL that gives the same results, for the operators that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {
    "op5_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
            FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.reached FROM r JOIN e ON e.a = r.doc_id)
        SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
            sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    # Lines with a common word among the rarest that a linked pair has to share; these candidates are compared whole.
    "op9_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
        s AS (
            SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS w FROM l),
        c AS (SELECT w, min(doc_id * 1000000 + line_no) AS k, len(w) AS n FROM s WHERE len(w) > 0 GROUP BY w),
        t AS (SELECT k, n, unnest(w) AS word FROM c),
        f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
        o AS (SELECT k, n, word, row_number() OVER (PARTITION BY k ORDER BY df, word) AS pos FROM t JOIN f USING (word)),
        x AS (SELECT k, n, word FROM o WHERE pos <= n - ceil(0.8 * n) + 1),
        p AS (SELECT DISTINCT a.k AS a, b.k AS b FROM x a JOIN x b ON a.word = b.word AND a.k < b.k AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n),
        gone AS (
            SELECT DISTINCT b FROM p JOIN c y ON y.k = a JOIN c z ON z.k = b
            WHERE 100 * len(list_intersect(y.w, z.w)) >= 80 * (y.n + z.n - len(list_intersect(y.w, z.w))))
        SELECT doc_id, line_no, CAST(len(s.w) AS INTEGER) AS n_tokens, len(s.w) = 0 OR (c.k = doc_id * 1000000 + line_no AND gone.b IS NULL) AS kept
        FROM s LEFT JOIN c ON s.w = c.w LEFT JOIN gone ON gone.b = c.k""",
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (
            SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) % (length(t) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (length(t) + 1) AS y,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d),
        p AS (
            SELECT doc_id, t, n, form, least(x, y) AS a, abs(x - y) AS b, left(t, least(x, y)) AS prefix, substring(t, least(x, y) + 1, abs(x - y)) AS middle,
                substring(t, greatest(x, y) + 1) AS suffix
            FROM u)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM p""",
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents),
        s AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d),
        tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
        q AS (
            SELECT item_id, term, CAST(count(*) AS BIGINT) AS c
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
            GROUP BY ALL),
        m AS (SELECT doc_id, 75 + (25 * CAST(len(w) AS BIGINT) * big_n) // big_l AS m FROM d, s WHERE len(w) > 0),
        r AS (
            SELECT item_id, doc_id, CAST(sum(c * CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM q JOIN tf USING (term) JOIN df USING (term) JOIN m USING (doc_id), s GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY rank <= 20""",
}


def _host(url: str) -> str:
    return rf"translate(regexp_extract({url}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(url: str) -> str:
    return rf"regexp_extract({url}, '://[^/?#]*([^?#]*)', 1)"


def _normal(url: str) -> str:
    parts = rf"list_filter(string_split(regexp_extract({url}, '://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))"
    return rf"('https://' || {_host(url)} || {_path(url)} || CASE WHEN len({parts}) > 0 THEN '?' || array_to_string({parts}, '&') ELSE '' END)"


def _node(url: str) -> str:
    return f"md5(regexp_replace({url}, '(?s)#.*$', ''))"


# Decisions reach a page from every alias that links lead to, in both directions; the component's name is its smallest node.
ORACLE["op1_url_filter"] = rf"""
    WITH RECURSIVE rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
    tags AS (
        SELECT url, 'link' AS kind, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*>')) AS tag FROM p WHERE contains(url, '://')
        UNION ALL SELECT url, 'meta', unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*>')) FROM p WHERE contains(url, '://')),
    declared AS (
        SELECT url, replace(regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&') AS target FROM tags
        WHERE kind = 'link' AND regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b')
        UNION SELECT url, replace(regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&') FROM tags
        WHERE kind = 'meta' AND regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh\b')),
    based AS (SELECT url, target, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root, regexp_extract(url, '(?s)^(.*?://[^/?#]*[^?#]*/)', 1) AS folder FROM declared WHERE target <> ''),
    linked AS (
        SELECT url, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || target
            WHEN starts_with(target, '/') THEN root || target WHEN folder <> '' THEN folder || target ELSE root || '/' || target END AS target
        FROM based),
    named AS (SELECT url FROM p WHERE contains(url, '://') UNION SELECT url FROM linked UNION SELECT target FROM linked),
    link AS (SELECT * FROM (SELECT url, target FROM linked UNION SELECT url, {_normal("url")} FROM named) WHERE url <> target),
    ends AS (SELECT {_node("url")} AS a, {_node("target")} AS b FROM link),
    both_ways AS (SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b),
    reach(node, found) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.found FROM reach r JOIN both_ways e ON e.a = r.node),
    component AS (SELECT node, min(found) AS component FROM reach GROUP BY node),
    alias AS (SELECT url FROM link UNION SELECT target FROM link),
    place AS (SELECT {_host("url")} AS host, {_path("url")} AS path FROM (SELECT url FROM p UNION SELECT url FROM alias)),
    judged AS (
        SELECT DISTINCT ON (x.host, x.path) x.host, x.path, r.host || r.path AS rule, r.verdict
        FROM place x JOIN rules r ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path)
        WHERE x.host <> '' ORDER BY x.host, x.path, length(r.host || r.path) DESC, r.verdict, r.host || r.path DESC),
    told AS (
        SELECT component, bool_or(verdict = 'allow') AS allowed FROM alias JOIN component ON node = {_node("url")}
        JOIN judged ON judged.host = {_host("url")} AND judged.path = {_path("url")} GROUP BY component)
    SELECT page_id, {_host("p.url")} AS host, {_path("p.url")} AS path, rule, coalesce(verdict, CASE WHEN NOT allowed THEN 'block' END, 'allow') AS verdict, told.component AS alias_of
    FROM p LEFT JOIN judged ON judged.host = {_host("p.url")} AND judged.path = {_path("p.url")}
    LEFT JOIN component ON contains(p.url, '://') AND node = {_node("p.url")} LEFT JOIN told USING (component)"""
