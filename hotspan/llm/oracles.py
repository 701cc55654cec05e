"""SQL (DuckDB) that gives the rows of the queries it can express, from the tables alone."""

from __future__ import annotations

from hotspan.llm.quality import CLASSES, QualityConfig

_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

CHAT = """WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
f AS (SELECT *, 14 + length(role) + length(regexp_replace(role, '[^\\\\#<:]', '', 'g')) + length(text)
    + length(regexp_replace(text, '[^\\\\#<]', '', 'g')) AS size FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM k WHERE r > 1),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT a.doc_id, a.i, a.word, g.i IS NOT NULL AS gone FROM a LEFT JOIN g USING (doc_id, i)),
o AS (SELECT doc_id, sum(gone::BIGINT)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(
    text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.node WHERE r.low < e.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.low) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality(config: QualityConfig | None = None) -> str:
    config = config or QualityConfig()
    count = lambda pattern: f"length(t) - length(regexp_replace(t, {_quoted(pattern)}, '', 'g'))"
    classes = ["length(t) - length(array_to_string(w, ''))", *map(count, CLASSES.values())]
    chars = ", ".join(f"({c})::DOUBLE" for c in classes)
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(map(_quoted, v))}]" for k, v in config.common_words.items())
    known = ", ".join(f"'{k}'" for k in config.common_words)

    def divergence(p: str, q: str) -> str:
        term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p}.v / {p}.s + {q}.v / {q}.s) / 2)) ELSE 0 END"
        return f"sum({term(f'({p}.v / {p}.s)')} + {term(f'({q}.v / {q}.s)')}) / 2"

    def compared(name: str) -> str:
        """Cells of every document and of its language, and their divergence."""
        return f"""{name}_c AS (SELECT doc_id, lang, unnest({name}) AS v, unnest(range(len({name}))) AS i FROM h WHERE lang IN ({known})),
{name}_d AS (SELECT *, sum(v) OVER (PARTITION BY doc_id) AS s FROM {name}_c),
{name}_l AS (SELECT *, sum(v) OVER (PARTITION BY lang) AS s FROM (SELECT lang, i, sum(v) AS v FROM {name}_c GROUP BY 1, 2)),
{name}_j AS (SELECT a.doc_id, {divergence('a', 'b')} AS js FROM {name}_d a JOIN {name}_l b USING (lang, i) WHERE a.s > 0 AND b.s > 0 GROUP BY 1)"""

    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
x AS (SELECT *, CASE lang {lists} ELSE [] END AS cw, list_transform(w, lambda a: lower(a)) AS lw FROM d),
h0 AS (SELECT *, [{chars}] AS ch, list_transform(cw, lambda c: len(list_filter(lw, lambda a: a = c))::DOUBLE) AS hits FROM x),
h AS (SELECT *, list_append(ch, length(t) - list_sum(ch)) AS chars, list_append(hits, len(w) - coalesce(list_sum(hits), 0)) AS common FROM h0),
{compared('chars')}, {compared('common')},
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY 1),
n AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
m AS (SELECT h.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  ({count('[#*$%&|<>]')})::BIGINT AS n_symbols, coalesce(n.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  CASE WHEN length(t) >= {config.min_chars} THEN sqrt(greatest(coalesce(a.js, 0), 0)) ELSE 0 END AS cd,
  CASE WHEN len(w) >= {config.min_compared_words} THEN sqrt(greatest(coalesce(b.js, 0), 0)) ELSE 0 END AS wd
  FROM h LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN chars_j a USING (doc_id) LEFT JOIN common_j b USING (doc_id)),
o AS (SELECT *, n_words < {config.min_words} OR 100 * n_repeat_words > {config.max_repeat_percent} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND cd <= {config.max_char_distance} AND wd <= {config.max_word_distance} AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM o"""
