"""DuckDB SQL that gives the rows of registered queries, from the definitions alone."""

from __future__ import annotations

from likeness.llm import chat, secrets, substrings


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_secrets() -> str:
    """Every rule's regex over every whole text; a match begins behind the texts between
    the matches before it and these matches themselves."""
    parts = []
    for order, rule in enumerate(secrets.RULES):
        regex = sql_text(rule.regex)
        before = "coalesce(list_sum(list_transform({}[1:{}], lambda x: length(x))), 0)"
        parts.append(f"""
        SELECT doc_id, {order} AS place, {sql_text(rule.kind)} AS kind, unnest(list_transform(
            range(len(m)), lambda i: {{
              'start': CAST({before.format('p', 'i + 1')} + {before.format('m', 'i')} AS BIGINT),
              'size': length(m[i + 1]),
              'part': length(regexp_extract(m[i + 1], {regex}, {rule.group}))}})) AS s
        FROM (SELECT doc_id, regexp_extract_all(t, {regex}) AS m, string_split_regex(t, {regex}) AS p
              FROM docs) WHERE len(m) > 0""")
    kept = " OR ".join(f"(place = {n} AND s.part >= {r.least})" for n, r in enumerate(secrets.RULES))
    listed = "string_agg(kind || ':' || s.start || ':' || (s.start + s.size), ',' ORDER BY s.start, place)"
    base = len(secrets.BASE)
    counts = ", ".join(
        f"coalesce(n{n}, 0) AS n_{rule.kind}" for n, rule in enumerate(secrets.BASE)
    )
    sums = ", ".join(f"count(*) FILTER (WHERE place = {n}) AS n{n}" for n in range(base))
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    matches AS ({" UNION ALL ".join(parts)}),
    summed AS (
      SELECT doc_id, {sums}, {listed} AS spans,
        {listed} FILTER (WHERE place < {base}) AS base
      FROM matches WHERE {kept} GROUP BY doc_id)
    SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256,
      coalesce(spans, '') AS spans
    FROM docs d LEFT JOIN summed s ON d.doc_id = s.doc_id"""


def sql_chats() -> str:
    def written(column: str) -> str:
        for plain, shown in chat.ESCAPES:
            column = f"replace({column}, {sql_text(plain)}, {sql_text(shown)})"
        return column

    marks = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
        (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    whole AS (
      SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' {order}) AS told,
        coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '') AS learnt,
        CAST(sum(length({written("role")}) + length({written("text")}) + {marks}) AS BIGINT)
          AS formatted_chars
      FROM turns GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learnt) AS loss_chars,
      sha256(learnt) AS loss_sha256, formatted_chars, 0::BIGINT AS n_tokens_expanded FROM whole"""


def sql_substrings(window: int = substrings.WINDOW) -> str:
    return f"""
    WITH texts AS (
      SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
        lambda x: x <> '') AS words FROM documents),
    windows AS (
      SELECT doc_id, i, array_to_string(words[i:i + {window - 1}], ' ') AS w FROM (
        SELECT doc_id, words, unnest(range(1, len(words) - {window - 2})) AS i FROM texts)),
    placed AS (
      SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS place FROM windows),
    gone AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM placed WHERE place > 1),
    spread AS (
      SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts),
    kept AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS rest, count(*) AS n
      FROM spread s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY doc_id)
    SELECT t.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
      sha256(coalesce(rest, '')) AS kept_sha256
    FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id"""


SQL_TOPK = """
    WITH whole AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (
      SELECT *, CAST(row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
