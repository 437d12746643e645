from collections import Counter

from feedloom.llm import quality
from tests.llm.conftest import rows_of


def brute(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def texts(prose):
    line = prose(1, words=9)
    return [
        "", "one", "a b c d e", "a b c d e a b c d e", "x " * 50, "a b c d e f " * 3, f"{line}\n" * 4 + "\n \n" + line,
        f"{line} | & # {line[:20]} <b>", prose(2, words=400) + "\r\n" + prose(3, words=30) + "\n" + prose(3, words=30), "数字 ünï 🎉 " * 7,
    ]


def test_measures(make, prose):
    docs = make(*texts(prose))
    found = quality.report(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(found) == sorted(((i, *brute(t)) for i, t in enumerate(texts(prose))), key=repr)


def test_strange_histograms_go_and_prose_stays(make, prose):
    clean = [prose(i, words=200) + "." for i in range(60)]
    shouting = [prose(100 + i, words=200).upper() + "!!" for i in range(3)]
    symbols = [" ".join(w + "$$$" for w in prose(200 + i, words=200).split()) for i in range(3)]
    rows = quality.report(make(*clean, *shouting, *symbols)).collect()
    assert all(r.kept for r in rows if r.doc_id < 60)
    assert not any(r.kept for r in rows if r.doc_id >= 60)


def test_short_texts_are_not_judged_by_histograms(make, prose):
    rows = quality.report(make(*[prose(i, words=200) for i in range(30)], "AB CD EF GH IJ KL MN OP QR ST UV")).collect()
    assert [r.kept for r in rows if r.doc_id == 30] == [True]


def test_awkward_rows(awkward):
    found = quality.report(awkward).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(found) == sorted(((r.doc_id, *brute(r.text)) for r in awkward.collect()), key=repr)
    kept = quality.kept(awkward)
    assert kept.schema == awkward.schema
    assert quality.report(awkward.limit(0)).count() == 0 and quality.kept(awkward.limit(0)).count() == 0
