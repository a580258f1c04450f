import re
from collections import Counter

from limnos.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark, odd, make, text_of):
    a = text_of(5, 30)
    more = make([(20, a + " " + a), (21, "x " * 40), (22, "a b c d e f g h a b c d e f g h a"), (23, "l1\nl1\n\nl1 # | <"), (24, "\x0b\x0cw\r")])
    for df in (odd, more):
        texts = [r.text for r in df.collect()]
        got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.quality_rules(df).collect()]
        for t, g in zip(texts, got, strict=True):
            b = brute(t)
            assert g[:5] == b
            assert g[5] == (b[0] < 20 or 100 * b[4] > 30 * b[0])
            assert not (g[5] and g[6])


def test_keep_good_has_the_same_verdict_and_columns(odd, none):
    want = sorted(str(r.doc_id) for r in quality.quality_rules(odd).filter("kept").collect())
    got = quality.keep_good(odd)
    assert got.dtypes == odd.dtypes
    assert sorted(str(r.doc_id) for r in got.collect()) == want
    assert quality.keep_good(none).count() == 0 and quality.quality_rules(none).count() == 0


def test_no_user_function_and_no_exchange(odd):
    plan = quality.quality_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
