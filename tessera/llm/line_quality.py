"""Operator 1: line-first quality cleaning.

Each line that has a word is judged on its own by three rules (the first that
fails names the reason); failing lines are removed, and a document that loses
more than ``max_lost`` of its words that way is rejected.

* ``punctuation``: at least ``noisy_share`` of the line's words carry symbol or
  shouting marks (``# * $ % & < >``, two or more ``!``/``?`` at the end), or the
  line has ``plain_words`` words or more and no sentence punctuation at all;
* ``navigation``: two or more words that are only a separator (``|``, ``>``,
  a bullet, ...) and at least ``separator_share`` of the words, or at most
  ``menu_words`` words that are all menu words;
* ``boilerplate``: the line holds one of the fixed phrases and has at most
  ``boilerplate_words`` words.

Rows are independent: one pass, no shuffle; a text is held in memory one batch
at a time. Defined results: null text counts as no text (0 words, base_failed);
texts without words fail the base rule; repeated rows and tied ids are judged row
by row; an empty table gives an empty result; ``clean`` keeps every other column, or,
where a result name clashes with one, all of them in a struct ``_doc``; ``keep_clean``
keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPACE, split_words, table, whole_row

NOISY = re.compile(r"[#*$%&<>]|[!?]{2,}$")
MARK = re.compile(r"[#*$%&<>]|[!?]{2}")
SENTENCE = re.compile(r"[.,;:!?…。！？،۔।]")
SEPARATORS = frozenset("| || » › > • · - – — / \\ :: ~".split())
MENU = frozenset(
    "home about contact login logout register sign in up menu search next previous prev back top share help faq "
    "sitemap privacy terms cookies account cart news blog".split())
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of service", "terms of use",
    "privacy policy", "cookie policy", "uses cookies", "enable javascript", "javascript is disabled",
    "subscribe to our newsletter", "sign up for our newsletter", "click here to", "share this article",
    "lorem ipsum",
)


@dataclass(frozen=True)
class LineRules:
    noisy_share: float = 0.3
    plain_words: int = 30
    separator_share: float = 0.15
    menu_words: int = 6
    boilerplate_words: int = 40
    max_lost: float = 0.3
    min_words: int = 50
    max_repeat_percent: int = 50


def line_fault(line: str, words: list[str], r: LineRules) -> str | None:
    """The first rule that the line (with at least one word) breaks."""
    n = len(words)
    if MARK.search(line) and sum(1 for w in words if NOISY.search(w)) >= r.noisy_share * n:
        return "punctuation"
    if n >= r.plain_words and not SENTENCE.search(line):
        return "punctuation"
    if not SEPARATORS.isdisjoint(words):
        bars = sum(1 for w in words if w in SEPARATORS)
        if bars >= 2 and bars >= r.separator_share * n:
            return "navigation"
    low = line.lower()
    if n <= r.menu_words and all(w in MENU for w in split_words(low)):
        return "navigation"
    if n <= r.boilerplate_words and any(p in low for p in BOILERPLATE):
        return "boilerplate"
    return None


def repeat_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    k = len(seen)
    if k == n:
        return 0
    if k < (1 << 21):
        tri = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        _, pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
        tri = pair[:-1].astype(np.int64) * k + ids[2:]
    order = np.argsort(tri, kind="stable")
    s = tri[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i:n - 2 + i] |= twice
    return int(covered.sum())


def judge(text: str | None, r: LineRules = LineRules()) -> dict:
    """All measures, the cleaned text and the verdict for one text."""
    text = text or ""
    seen, dup, lost, removed, n_lines = set(), 0, 0, 0, 0
    reasons = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    keep, words = [], []
    for line in text.split("\n"):
        lw = split_words(line)
        if lw:
            words += lw
            n_lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
            fault = line_fault(line, lw, r)
            if fault:
                reasons[fault] += 1
                lost += len(lw)
                removed += 1
                continue
        keep.append(line)
    n_words, n_repeat = len(words), repeat_words(words)
    base_failed = n_words < r.min_words or 100 * n_repeat > r.max_repeat_percent * n_words
    return {
        "n_words": n_words, "word_chars": len(text) - sum(text.count(c) for c in SPACE),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup, "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": not base_failed and lost <= r.max_lost * n_words,
        "n_lines": n_lines, "lines_removed": removed, "words_removed": lost, **{f"lines_{k}": v for k, v in reasons.items()},
        "clean_text": "\n".join(keep) if removed else text,
    }


RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField(c, T.LongType()) for c in ("n_lines", "lines_removed", "words_removed", "lines_punctuation",
                                                "lines_navigation", "lines_boilerplate")]
    + [T.StructField("clean_text", T.StringType())])


def clean(df: DataFrame, text: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """``df`` and the result columns of ``judge`` (``with_text=False``: without clean_text and the text column;
    where names clash: ``_doc``, the row of ``df``, and the result columns)."""
    fields = [f for f in RESULT.fields if with_text or f.name != "clean_text"]
    if {f.name.lower() for f in fields} & {c.lower() for c in df.columns}:
        rest = df if with_text else df.drop(text)
        packed = df.select(whole_row(rest), F.col(text).alias("_text"))
        return clean(packed, "_text", rules, with_text).drop("_text")
    kept = [f for f in df.schema.fields if with_text or f.name != text]
    names, at = [f.name for f in kept], df.columns.index(text)
    out = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
                      [f.dataType.simpleString()]) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(t, rules) for t in b.column(at).to_pylist()]
            extra = [pa.array([x[f.name] for x in found], f.type) for f in out]
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(cols + extra, names=names + out.names)

    return df.mapInArrow(run, T.StructType(kept + fields))


def keep_clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with the failing lines removed (same columns)."""
    packed = docs.select(whole_row(docs.drop("text")), "text")
    got = clean(packed, rules=rules).filter("kept")
    return got.select(*[F.col("clean_text").alias("text") if c == "text" else
                        F.length("clean_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_doc.`{c}`")
                        for c in docs.columns])


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(docs, with_text=False)


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values)) + "]"


_R = LineRules()
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, i, w, lead(w) OVER p AS w1, lead(w, 2) OVER p AS w2
  FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
        FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM docs))
  WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (
  SELECT r, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w1, w2) >= 2 AS t FROM words),
cover AS (
  SELECT r, bool_or(t) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM twice),
rep AS (SELECT r, count(*) FILTER (c) AS n_repeat_words FROM cover GROUP BY r),
lines AS (
  SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
  FROM (SELECT r, string_split(text, chr(10)) AS ls FROM docs)),
judged AS (
  SELECT r, i, line, len(ws) AS n, row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth,
    CASE
      WHEN len(list_filter(ws, lambda w: regexp_matches(w, '[#*$%&<>]|[!?]{{2,}}$'))) >= {_R.noisy_share} * len(ws)
        OR (len(ws) >= {_R.plain_words} AND NOT regexp_matches(line, '[.,;:!?…。！？،۔।]')) THEN 'punctuation'
      WHEN (len(list_filter(ws, lambda w: list_contains({_sql_list(SEPARATORS)}, w))) >= 2
            AND len(list_filter(ws, lambda w: list_contains({_sql_list(SEPARATORS)}, w))) >= {_R.separator_share} * len(ws))
        OR (len(ws) <= {_R.menu_words} AND len(list_filter(ws, lambda w: NOT list_contains({_sql_list(MENU)}, lower(w)))) = 0)
        THEN 'navigation'
      WHEN len(ws) <= {_R.boilerplate_words}
        AND len(list_filter({_sql_list(BOILERPLATE)}, lambda p: contains(lower(line), p))) > 0 THEN 'boilerplate'
    END AS fault
  FROM (SELECT r, i, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS ws FROM lines) WHERE len(ws) > 0),
per AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines, count(fault) AS lines_removed,
    coalesce(sum(n) FILTER (fault IS NOT NULL), 0) AS words_removed, count(*) FILTER (fault = 'punctuation') AS lines_punctuation,
    count(*) FILTER (fault = 'navigation') AS lines_navigation, count(*) FILTER (fault = 'boilerplate') AS lines_boilerplate
  FROM judged GROUP BY r),
base AS (
  SELECT d.r, doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    coalesce(lines_removed, 0) AS lines_removed, coalesce(words_removed, 0) AS words_removed,
    coalesce(lines_punctuation, 0) AS lines_punctuation, coalesce(lines_navigation, 0) AS lines_navigation,
    coalesce(lines_boilerplate, 0) AS lines_boilerplate
  FROM docs d LEFT JOIN per USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words) AS base_failed,
  NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words)
    AND words_removed <= {_R.max_lost} * n_words AS kept,
  n_lines::BIGINT AS n_lines, lines_removed::BIGINT AS lines_removed, words_removed::BIGINT AS words_removed,
  lines_punctuation::BIGINT AS lines_punctuation, lines_navigation::BIGINT AS lines_navigation,
  lines_boilerplate::BIGINT AS lines_boilerplate
FROM base
"""
