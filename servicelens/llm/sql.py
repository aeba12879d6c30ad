"""SQL twins (DuckDB) of the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

from servicelens.llm import rules

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _histogram_sql() -> str:
    """Per document its character shares and, per language, its common-word shares."""
    classes = ", ".join(
        f"length(regexp_replace(t, '{outside.replace(chr(39), chr(39) * 2)}', '', 'g'))::DOUBLE"
        for outside in rules.CLASSES.values())
    words = ",\n".join(
        f"list_transform([{_quoted(common)}], lambda c: len(list_filter(w, lambda x: x = c OR x = "
        f"upper(c[1]) || c[2:]))::DOUBLE) AS common_{lang}"
        for lang, common in rules.COMMON_WORDS.items())
    return f"SELECT *, [{classes}, length(t) - length(array_to_string(w, ''))] AS classes,\n{words} FROM counted"


def quality_rules() -> str:
    whole = ",\n".join(
        f"list_transform(common_{x} || [len(w) - list_sum(common_{x})], lambda c: c / greatest(len(w), 1)) AS shares_{x}"
        for x in rules.COMMON_WORDS)
    own = " ".join(f"WHEN lang = '{x}' THEN shares_{x}" for x in rules.COMMON_WORDS)
    other = " ".join(f"WHEN r.lang = '{x}' THEN shares_{x}" for x in rules.COMMON_WORDS)
    size = 1 + max(map(len, rules.COMMON_WORDS.values()))
    known = _quoted(list(rules.COMMON_WORDS))
    distance = ("sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: "
                "(CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END) + "
                "(CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END))) / 2, 0))")
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS n, doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, regexp_extract_all(t, '{_WORD}') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM texts),
windows AS (
  SELECT n, pos, md5(array_to_string(w[pos:pos + 7], ' ')) AS g
  FROM (SELECT n, w, unnest(range(1, len(w) - 6)) AS pos FROM split WHERE len(w) >= 8)),
twice AS (
  SELECT n, pos FROM (SELECT n, pos, count(*) OVER (PARTITION BY n, g) AS times FROM windows) WHERE times > 1),
repeats AS (
  SELECT n, sum(least(8, coalesce(follows - pos, 8)))::BIGINT AS repeated
  FROM (SELECT n, pos, lead(pos) OVER (PARTITION BY n ORDER BY pos) AS follows FROM twice) GROUP BY n),
counted AS (
  SELECT s.*, coalesce(repeated, 0) AS repeated FROM split s LEFT JOIN repeats USING (n)),
histograms AS ({_histogram_sql()}),
shared AS (
  SELECT *, list_transform(classes || [length(t) - list_sum(classes)], lambda c: c / greatest(length(t), 1)) AS chars,
         {whole} FROM histograms),
entries AS (
  SELECT lang, kind, i, avg(v) AS v FROM (
    SELECT lang, 'chars' AS kind, unnest(range(1, len(chars) + 1)) AS i, unnest(chars) AS v
    FROM shared WHERE lang IN ({known}) AND length(t) >= {rules.CHARS_GUARD} AND len(w) >= {rules.WORDS_GUARD}
    UNION ALL
    SELECT lang, 'words', unnest(range(1, {size} + 1)), unnest(CASE {own} END)
    FROM shared WHERE lang IN ({known}) AND length(t) >= {rules.CHARS_GUARD} AND len(w) >= {rules.WORDS_GUARD})
  GROUP BY ALL),
reference AS (
  SELECT lang, list(v ORDER BY i) FILTER (kind = 'chars') AS chars,
         list(v ORDER BY i) FILTER (kind = 'words') AS words FROM entries GROUP BY lang),
distances AS (
  SELECT s.n, min({distance.format(p='s.chars', q='r.chars')}) AS char_distance,
         min({distance.format(p=f'(CASE {other} END)', q='r.words')}) AS word_distance
  FROM shared s JOIN reference r ON r.lang = s.lang
    OR s.lang IS NULL OR s.lang NOT IN (SELECT lang FROM reference) GROUP BY s.n),
judged AS (
  SELECT s.*, len(w) < {rules.LEAST_WORDS} OR 100 * repeated > {rules.MOST_REPEATED} * len(w) AS base_failed,
         length(t) < {rules.CHARS_GUARD} OR coalesce(char_distance <= {rules.CHARS_LIMIT}, true) AS chars_near,
         len(w) < {rules.WORDS_GUARD} OR coalesce(word_distance <= {rules.WORDS_LIMIT}, true) AS words_near
  FROM counted s LEFT JOIN distances USING (n))
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
       repeated AS n_repeat_words, base_failed, NOT base_failed AND chars_near AND words_near AS kept
FROM judged"""


CHAT_FORMATTING = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
placed AS (
  SELECT *, coalesce(lag(role) OVER o = role, false) AS goes_on,
         row_number() OVER o AS n
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(regexp_replace(text, '([\\#<])', '\\\1', 'g'))
           + CASE WHEN goes_on THEN length(' <next> ')
                  ELSE length('### : ') + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g'))
                       + length(' </turn>.') END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id"""

WARC_NORMALISER = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM payloads)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda b:
           CASE WHEN bits[5 * i + b + 1] = '1' THEN (16 >> b) ELSE 0 END))::BIGINT]), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM (SELECT *, unhex(sha1(html))::BIT::VARCHAR AS bits FROM firsts)"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT n, i, parts[i] AS line, {_LOWERED.format(f"trim(parts[i], {_SPACES})")} AS key
  FROM (SELECT n, string_split(t, chr(10)) AS parts, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM texts)),
frequent AS (SELECT key FROM split WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT n) >= 10),
kept AS (
  SELECT n, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '') AS t
  FROM split LEFT JOIN frequent f USING (key) GROUP BY n)
SELECT doc_id, n_lines, n_dropped, sha256(kept.t) AS kept_sha256 FROM texts JOIN kept USING (n)"""

FILL_IN_MIDDLE = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
lines AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS parts,
         list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS g FROM hashed),
formed AS (
  SELECT *, least(g[1] % (len(parts) + 1), g[2] % (len(parts) + 1)) AS a,
         greatest(g[1] % (len(parts) + 1), g[2] % (len(parts) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 100
              THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM lines),
cut AS (
  SELECT *, array_to_string(parts[1:a], '') AS p, array_to_string(parts[a + 1:b], '') AS m,
         array_to_string(parts[b + 1:], '') AS s FROM formed)
SELECT doc_id, len(parts)::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL_SEARCH = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{_TERM}') AS w
  FROM documents),
corpus AS (SELECT count(*)::BIGINT AS total, sum(len(w))::BIGINT AS l FROM texts WHERE len(w) > 0),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '{_TERM}')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
held AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM texts)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM held, corpus GROUP BY term, total),
scores AS (
  SELECT item_id, r, doc_id,
         sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * total) // l))))::BIGINT AS score
  FROM held JOIN weights USING (term) JOIN asked USING (term), corpus GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""

SQL = {
    "op3_quality_rules": quality_rules(),
    "op4_chat_formatting": CHAT_FORMATTING,
    "op6_warc_normaliser": WARC_NORMALISER,
    "op11_line_dedup": LINE_DEDUP,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op13_lexical_search": LEXICAL_SEARCH,
}
