"""Quality rules, line first.

Every line is judged alone: a *navigation* rule (separator-heavy lines), a
*boilerplate* rule (licence, cookie, subscription and script phrases) and a
*punctuation* rule (no letter at all, symbol noise, shouted exclamation marks).
Failing lines are removed; a document that loses more than ``max_lost`` of its
word characters to them is rejected, as is one that fails the base rules (fewer
than 50 words, or over half of its words in repeated three-word windows).

Defined cases: a null or empty text has no words, fails the base rules and is
not kept; repeated rows are judged each by itself; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from tracklake.llm.common import map_rows, texts

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
PHRASES = (
    b"all rights reserved", b"cookie", b"privacy policy", b"terms of use", b"terms of service", b"licensed under",
    b"copyright", b"subscribe", b"newsletter", b"click here", b"javascript", b"sign in", b"log in",
)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_bad_lines long, bad_bytes long, kept boolean"


def line_fails(line: bytes) -> bool:
    """Whether a line with at least one word is navigation, boilerplate or noise.

    All rules count ASCII bytes only, so they hold for UTF-8 in any language.
    """
    n = len(line.split())
    if 10 * line.count(b"|") >= 3 * n and line.count(b"|") >= 2:
        return True
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if 2 * symbols > n and symbols >= 3:
        return True
    if 2 * line.count(b"!!") > n and line.count(b"!!") >= 3:
        return True
    if not len(line.translate(None, b"0123456789.,;:!?'\"()[]{}/\\+-=_@^~`" + SYMBOLS + WHITE)):
        return True
    low = line.lower()
    return any(p in low for p in PHRASES)


def repeat_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def judge(text: str | None, max_lost_pct: int) -> tuple:
    b = (text or "").encode()
    words = b.split()
    solid = b.translate(None, WHITE)
    lines = [x for x in b.split(b"\n") if x.strip()]
    repeated = repeat_words(words)
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    bad = [x for x in lines if line_fails(x)]
    lost = sum(len(x.translate(None, WHITE)) for x in bad)
    kept = not failed and 100 * lost <= max_lost_pct * len(solid)
    return len(words), len(text or "") - (len(b) - len(solid)), len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed, len(lines), len(bad), lost, kept


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost_pct: int = 50) -> DataFrame:
    """One row per document with its counts and the verdict. A single pass: no shuffle."""
    names = SCHEMA.replace(",", "").split()[::2]

    def make():
        def step(batch):
            rows = zip(*(judge(t, max_lost_pct) for t in batch.column("text").to_pylist()))
            return dict(zip(names, [batch.column("doc_id"), *map(list, rows)]))

        return step

    return map_rows(texts(docs, id_col, text_col), make, SCHEMA)


def cleaned(text: str | None) -> str:
    """The text without its failing lines; lines without words stay."""
    return "\n".join(x for x in (text or "").split("\n") if not x.strip() or not line_fails(x.encode()))


#: The same in SQL. Byte counts of a string are its octet length.
_N = "len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))"
_CUT = "strlen(line) - strlen(regexp_replace(line, '{}', '', 'g'))"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT doc_id, line, {_N} AS n, strlen(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS solid,
  {_CUT.format(r'\|')} AS bars, {_CUT.format('[#*$%&|<>]')} AS syms, ({_CUT.format('!!')}) // 2 AS shouts FROM l WHERE {_N} > 0),
v AS (SELECT *, (10 * bars >= 3 * n AND bars >= 2) OR (2 * syms > n AND syms >= 3) OR (2 * shouts > n AND shouts >= 3)
  OR NOT regexp_matches(line, '[^\x20\x09-\x0D0-9.,;:!?''"()\[\]{{}}/\\+=_@^~`#*$%&|<>-]')
  OR regexp_matches(line, '(?i){'|'.join(p.decode() for p in PHRASES)}') AS bad FROM m),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups, count(*) FILTER (bad) AS n_bad, sum(CASE WHEN bad THEN solid ELSE 0 END) AS lost FROM v GROUP BY doc_id),
b AS (SELECT d.doc_id, len(ws) AS n, length(array_to_string(ws, '')) AS wc, strlen(t) - strlen(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS sy,
  strlen(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS solid, coalesce(r.n, 0) AS rep, coalesce(n_lines, 0) AS nl, coalesce(dups, 0) AS dl, coalesce(n_bad, 0) AS nb, coalesce(lost, 0) AS lo
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(wc AS BIGINT) AS word_chars, CAST(sy AS BIGINT) AS n_symbols, CAST(dl AS BIGINT) AS n_dup_lines,
  CAST(rep AS BIGINT) AS n_repeat_words, n < 50 OR 100 * rep > 50 * n AS base_failed, CAST(nl AS BIGINT) AS n_lines, CAST(nb AS BIGINT) AS n_bad_lines,
  CAST(lo AS BIGINT) AS bad_bytes, NOT (n < 50 OR 100 * rep > 50 * n) AND 100 * lo <= 50 * solid AS kept
FROM b
"""
