"""DuckDB SQL that computes the same rows from the same tables."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def op6() -> str:
    """Matches follow each other: each is found as what lies before it and itself."""
    kinds = {
        "assign": (0, r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""),
        "access": (1, "AKIA[A-Z0-9]+"),
        "hex": (2, "[0-9a-f]+"),
        "pem": (3, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*"),
    }
    value = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    least = {
        "assign": f"length(regexp_extract(found, '^{value}', 1)) >= 6",
        "access": "length(found) >= 20",
        "hex": "length(found) >= 24",
        "pem": "true",
    }
    parts = []
    for kind, (order, pattern) in kinds.items():
        parts.append(f"""
        SELECT doc_id, '{kind}' AS kind, {order} AS kind_order, start_at AS s, start_at + length(found) AS e
        FROM (
            SELECT doc_id, found,
                   sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) - length(found) AS start_at
            FROM (
                SELECT doc_id, unnest(regexp_extract_all(t, '([\\s\\S]*?)({pattern})', 1)) AS gap,
                       unnest(regexp_extract_all(t, '([\\s\\S]*?)({pattern})', 2)) AS found,
                       unnest(generate_series(1, len(regexp_extract_all(t, '([\\s\\S]*?)({pattern})', 1)))) AS i
                FROM texts
            )
        ) WHERE {least[kind]}""")
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({" UNION ALL ".join(parts)}),
    per AS (
        SELECT doc_id,
            count(*) FILTER (kind = 'assign') AS n_assign,
            count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind_order) FILTER (kind <> 'pem') AS base,
            string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind_order) AS spans
        FROM spans GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN per USING (doc_id)"""


def op7() -> str:
    measures = {
        "word_length": ("100 * word_chars", "n_words", 100),
        "symbols": ("1000 * n_symbols", "word_chars", 20),
        "dup_lines": ("1000 * n_dup_lines", "n_lines", 400),
        "repeats": ("1000 * n_repeat_words", "n_words", 250),
    }
    bins = ", ".join(f"{a} // greatest({b}, 1) AS {m}" for m, (a, b, _) in measures.items())
    limits, inside = [], []
    for m, (_, _, margin) in measures.items():
        first = f"list_sort(list({m}))[((count(*) + 3) // 4)::BIGINT]"
        third = f"list_sort(list({m}))[((3 * count(*) + 3) // 4)::BIGINT]"
        limits.append(f"{third} + 3 * ({third} - {first}) + {margin} AS most_{m}")
        limits.append(f"{first} - 3 * ({third} - {first}) - {margin} AS least_{m}")
        inside.append(f"{m} BETWEEN least_{m} AND most_{m}")
    return rf"""
    WITH split AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
    runs AS (
        SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS run
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM split)
    ),
    repeated AS (
        SELECT doc_id, count(DISTINCT i + k) AS n FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS times FROM runs
        ), (SELECT unnest(generate_series(0, 7)) AS k) WHERE times > 1 GROUP BY doc_id
    ),
    lines AS (
        SELECT doc_id, count(*) AS n, count(DISTINCT line) AS different
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
    ),
    counts AS (
        SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words,
            length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            coalesce(lines.n - lines.different, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
            coalesce(lines.n, 0) AS n_lines
        FROM split s LEFT JOIN lines USING (doc_id) LEFT JOIN repeated r ON r.doc_id = s.doc_id
    ),
    binned AS (
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {bins} FROM counts
    ),
    limits AS (SELECT lang, source, {", ".join(limits)} FROM binned WHERE NOT base_failed GROUP BY lang, source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {" AND ".join(inside)} AS kept
    FROM binned b LEFT JOIN limits l
      ON b.lang IS NOT DISTINCT FROM l.lang AND b.source IS NOT DISTINCT FROM l.source"""


def op9() -> str:
    return """
    WITH vectors AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    )
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
        FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    ) WHERE rank <= 10"""


def op2() -> str:
    return f"""
    WITH split AS (SELECT doc_id, {WORDS} AS w FROM documents),
    runs AS (
        SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS run
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM split)
    ),
    later AS (
        SELECT doc_id, i FROM (
            SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM runs
        ) WHERE n > 1
    ),
    removed AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(generate_series(0, 19)) AS k)),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM split),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
        FROM words ANTI JOIN removed USING (doc_id, i) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(t, '')) AS kept_sha256
    FROM split LEFT JOIN kept USING (doc_id)"""


def op1() -> str:
    return r"""
    WITH RECURSIVE split AS (
        SELECT doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
        FROM documents
    ),
    shingles AS (
        SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS s
        FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM split WHERE len(w) > 0)
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
    ),
    links AS (
        SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
        WHERE 100 * common.n >= 80 * (p.n + q.n - common.n)
    ),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x
    ),
    components AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM components LEFT JOIN sizes USING (doc_id)"""


def op11(levels: int = 7) -> str:
    """Trees level by level, to ``16 ** levels`` leaves; then each row's way up."""

    def field(column):
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"

    def leaf(text):
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def climb(name, start):
        """``name_k``: nodes of level k with what their siblings are; ``name_k + 1`` follows from their runs."""
        parts = [f"{name}_0 AS ({start})"]
        for k in range(levels):
            around = "coalesce(string_agg(h, '') OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN {}), '')"
            before, after = around.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), around.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
            parts.append(f"{name}_runs_{k} AS (SELECT tree, i, n, h, {before} AS before, {after} AS after FROM {name}_{k})")
            parts.append(f"""{name}_{k + 1} AS (
                SELECT tree, i // 16 AS i, (max(n) + 15) // 16 AS n,
                       CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h
                FROM {name}_{k} GROUP BY tree, i // 16)""")
        return parts

    def walk(name, nodes, start):
        """Rows that fold what is below with their siblings, level by level."""
        parts = [f"{name}_0 AS ({start})"]
        for k in range(levels):
            parts.append(f"""{name}_{k + 1} AS (
                SELECT w.* REPLACE (i // 16 AS i,
                           CASE WHEN n > 1 THEN sha256(before || folded || after) ELSE folded END AS folded,
                           CASE WHEN n > 1 THEN proof || before || after ELSE proof END AS proof)
                FROM {name}_{k} w JOIN {nodes}_runs_{k} USING (tree, i))""")
        return parts

    bits = "list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    bytes_of = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    crc32 = f"xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda crc, byte: {bits}), 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rows = f"""leaves AS (
        SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {leaf("text")} AS leaf,
               CASE WHEN {crc32} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS changed
        FROM documents
    ),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
               count(*) OVER (PARTITION BY tree) AS n FROM leaves
    )"""
    parts = [
        rows,
        *climb("node", "SELECT tree, i, n, leaf AS h FROM placed"),
        f"subroots AS (SELECT tree AS source_tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM node_{levels})",
        *climb("top", "SELECT '' AS tree, i, n, h FROM subroots"),
        *walk("row", "node", "SELECT doc_id, tree, i, leaf, changed AS folded, '' AS proof FROM placed"),
        *walk("way", "top", f"""
            SELECT doc_id, r.leaf, s.h AS subroot, '' AS tree, s.i, folded, proof
            FROM row_{levels} r JOIN subroots s ON s.source_tree = r.tree"""),
    ]
    return f"""
    WITH {", ".join(parts)}
    SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
    FROM way_{levels} JOIN top_{levels} t USING (tree, i)"""
