"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths, computed with numpy over a
whole text, tell which characters lie inside duplicated n-grams and lines. A
document is kept if it passes the base rules (50 words or more, at most half of
the words inside repeated 3-word windows) and none of these shares, taken of
the characters in words, is exceeded:

* n = 2, 3, 4: the n-gram whose occurrences hold most characters
  (occurrences times its characters, if it occurs twice or more);
* n = 5 to 10: words covered by an occurrence of an n-gram after its first;
* words in lines equal to an earlier line, and the share of such lines.

The rolling hash runs over the hashes of whole words.

All comparisons are of integers, so ties at a limit are kept, on every engine
alike. Defined cases: a null or empty text has zero counts and fails the base
rules; null or repeated ids are judged row by row; every length is read whole;
an empty table gives an empty one; other columns, whatever their names, are not
read and not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kvlake.llm.common import Rolling, map_batches, word_hashes

#: Percent of the characters in words; fixed values of published repetition rules.
TOP_LIMITS = {2: 20, 3: 18, 4: 16}
COVER_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
DUP_LINE_LIMIT, DUP_LINE_CHARS_LIMIT = 30, 20
SYMBOLS = "#*$%&|<>"

COLUMNS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, max_cover_percent double"
_ROLL = Rolling()
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = 1


def word_arrays(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of code points of every word of a UTF-8 text."""
    hashes, start, end = word_hashes(raw)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return hashes, points[end] - points[start]


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by hash (then place), and whether each equals the one before it."""
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    again = np.zeros(len(h), bool)
    again[1:] = ordered[1:] == ordered[:-1]
    return order, again


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    marks = np.zeros(words + 1, np.int64)
    marks[starts] += 1
    marks[starts + n] -= 1
    return np.cumsum(marks[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The row of one text, without its id."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return 0, 0, 0, 0, 0, True, False, 0.0
    symbols = int(_IS_SYMBOL[np.frombuffer(raw, np.uint8)].sum())
    hashes, chars = word_arrays(raw)
    n, total = len(hashes), int(chars.sum())
    seen: set[bytes] = set()
    lines = dup_lines = dup_line_chars = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup_lines += 1
                dup_line_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in line.split())
            else:
                seen.add(line)
    prefix = _ROLL.prefix(hashes)
    up = np.concatenate([[0], np.cumsum(chars)])
    over, worst, repeat_words, more = False, 0.0, 0, True
    for k in range(2, 11):
        # a repeated k-gram holds a repeated (k-1)-gram, so the first length without one ends the search
        if not more or n < k:
            break
        order, again = _groups(_ROLL.windows(prefix, k))
        more = bool(again.any())
        if not more:
            break
        if k == 3:
            twice = again.copy()
            twice[:-1] |= again[1:]
            repeat_words = int(_covered(order[twice], 3, n).sum())
        if k in TOP_LIMITS:
            head = np.flatnonzero(~again)
            size = np.diff(np.append(head, len(order)))
            width = up[order[head] + k] - up[order[head]]
            held, limit = int((size * width)[size > 1].max()), TOP_LIMITS[k]
        else:
            inside = _covered(order[again], k, n)
            held, limit = int(chars[inside].sum()), COVER_LIMITS[k]
        over |= 100 * held > limit * total
        worst = max(worst, 100.0 * held / total)
    over |= 100 * dup_lines > DUP_LINE_LIMIT * lines or 100 * dup_line_chars > DUP_LINE_CHARS_LIMIT * total
    failed = n < 50 or 100 * repeat_words > 50 * n
    return n, total, symbols, dup_lines, repeat_words, failed, not failed and not over, worst


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row of COLUMNS for every row of ``docs`` (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("max_cover_percent", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [measure(x) for x in part.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, COLUMNS)


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
w as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
t as (select r, unnest(ws) as word, unnest(range(len(ws))) as i from w),
base as (select r, count(*) as n, sum(length(word))::bigint as total from t group by r),
grams as (
  select w.r, k.n, i.i, array_to_string(list_slice(w.ws, i.i + 1, i.i + k.n), ' ') as g
  from w, (select unnest(range(2, 11)) as n) k, unnest(range(greatest(len(w.ws) - k.n + 1, 0))) as i(i)),
counted as (
  select r, n, i, length(g) - (n - 1) as width, count(*) over (partition by r, n, g) as c,
         row_number() over (partition by r, n, g order by i) as nth from grams),
top as (select r, n, max(c * width) as held from counted where n <= 4 and c > 1 group by r, n),
cov as (
  select r, n, sum(len)::bigint as held from (
    select distinct c.r, c.n, t.i, length(t.word) as len
    from (select r, n, unnest(range(i, i + n)) as j from counted where n >= 5 and nth > 1) c
    join t on t.r = c.r and t.i = c.j) group by r, n),
rep as (
  select r, count(distinct j)::bigint as repeat_words
  from (select r, unnest(range(i, i + 3)) as j from counted where n = 3 and c > 1) group by r),
lim(n, cap) as (values (2, 20), (3, 18), (4, 16), (5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10)),
bad as (
  select distinct h.r from (select * from top union all select * from cov) h join lim using (n) join base b on b.r = h.r
  where 100 * h.held > lim.cap * b.total),
lines as (
  select r, line, row_number() over (partition by r, line) as nth
  from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
ln as (
  select r, count(*) as lines, sum((nth > 1)::int)::bigint as dups,
         coalesce(sum(case when nth > 1 then length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) end), 0)::bigint as dup_chars
  from lines group by r),
s as (
  select d.doc_id, coalesce(b.n, 0) as n_words, coalesce(b.total, 0)::bigint as word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(ln.dups, 0)::bigint as n_dup_lines, coalesce(rep.repeat_words, 0)::bigint as n_repeat_words,
         bad.r is not null or coalesce(100 * ln.dups > 30 * ln.lines
           or 100 * ln.dup_chars > 20 * coalesce(b.total, 0), false) as over_limit
  from d left join base b using (r) left join ln using (r) left join rep using (r) left join bad using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not over_limit as kept
from s
"""
