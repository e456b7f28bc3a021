"""Operator 1: rules line by line, measures against plain counting."""

import re
from collections import Counter


from tessera.llm import line_quality as op
from tessera.llm.common import split_words
from tests.llm.util import DOCS, P, documents, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(words):
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    return sum(any(windows[tuple(words[j:j + 3])] > 1 for j in range(max(0, i - 2), i + 1) if j + 3 <= len(words))
               for i in range(len(words)))


def test_words_are_cut_at_the_six_separators():
    for text in ("a\x1cb\x85c\xa0d e\tf\x0bg", "", "  ", "x y", "é z q", "a　b c"):
        assert split_words(text) == WORD.findall(text)


def test_measures_equal_plain_counting():
    for text in ["a b c a b c d", "a a a a", "x", "", None, "one two\none two\n\n \none two", P, P + " " + P, "# * | < > &", "a b c"]:
        t, r = text or "", op.judge(text)
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == repeats(words)
        assert r["base_failed"] == (len(words) < 50 or 100 * repeats(words) > 50 * len(words))


def test_rules_by_line():
    r = op.LineRules()
    fault = lambda x: op.line_fault(x, split_words(x), r)
    assert fault("THE!! BEST!! DEAL!!") == fault("buy*** now### cheap") == "punctuation"
    assert fault(" ".join(["word"] * 30)) == "punctuation" and fault(" ".join(["word"] * 29)) is None
    assert fault("Home | News | Contact") == fault("home about contact") == "navigation"
    assert fault("Copyright 2020. All rights reserved.") == "boilerplate"
    assert fault("A plain sentence about the home of the news.") is None


def test_documents_that_lose_too_much_go():
    body = " ".join(f"plain{i} words{i}, here." for i in range(20))
    good = op.judge(body + "\nHome | News | Contact")
    assert good["kept"] and good["lines_removed"] == 1 and good["clean_text"] == body
    bad = op.judge(body + "\n" + " ".join(f"loud{i}!!" for i in range(60)))
    assert not bad["kept"] and not bad["base_failed"]


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark), "row", "lines")
    out = op.keep_clean(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert 3 not in kept and 4 not in kept and 10 not in kept and kept[1] == DOCS[0][1]
    assert "home" not in kept.get(9, "")
    assert op.clean(docs, with_text=False).count() == len(DOCS)
    assert op.clean(documents(spark, [])).count() == 0
    clash = op.clean(with_clashes(docs, "kept", "_doc"))
    assert {r["_doc"]["kept"] for r in clash.collect()} == {"kept"} and clash.filter("kept").count() == out.count()
    assert op.clean(with_clashes(docs, "kept"), with_text=False).columns[0] == "_doc"
    odd = op.keep_clean(with_clashes(docs, "kept", "clean_text", "_doc", "n_words"))
    assert odd.columns[-4:] == ["kept", "clean_text", "_doc", "n_words"] and odd.filter("kept = 'kept' AND _doc = '_doc'").count() == out.count()
