import re

from dnsq.llm import quality_rules as Q

from .helpers import WORD, prose, table

TEXTS = [None, "", "  \n\t ", "one two", "a b c a b c a", "x x x x x x", prose(1, 400), "A#*$ %&|<> é!\n\nline\nline\n  \nline ",
         "é日本 \x0b\x0c 🙂🙂 b", "p q r s " * 5000, "\n".join(["same line here"] * 5), prose(2, 3000), "ab c", "a bc"]


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated),
            len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def test_counts_like_brute_force(spark):
    got = {r.doc_id: r for r in Q.judge(table(spark, TEXTS, clash=True), []).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t and t[:50]
        assert r.kept == (not r.base_failed) and r.rule is None


def test_rules_are_learned_and_applied(spark):
    good = [(i, prose(i, 120), "en", "s", 0) for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 120).split()), "en", "s", 0) for i in range(60)]
    bad += [(2000 + i, " | ".join(prose(i, 120).split()), "en", "s", 0) for i in range(60)]
    df = table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in good + bad] + [(7, 1), (None, 0), (5000, None)],
                                   "doc_id long, quality long")
    rules = Q.learn(Q.with_counts(Q.train_sample(df, labels)))
    assert 1 <= len(rules) <= Q.MAX_RULES and all(1 <= len(r) <= Q.MAX_CONDITIONS for r in rules)
    got = {r.doc_id: r for r in Q.judge(df, rules).collect()}
    assert all(got[i].kept for i in range(300))
    assert sum(got[i].kept for i, *_ in bad) <= 2 and "case when" in Q.as_sql(rules)
    assert len({r.rule for r in got.values()}) == len(rules) + 1


def test_nothing_to_learn_from(spark):
    df = table(spark, [prose(i, 60) for i in range(5)])
    none = spark.createDataFrame([], "doc_id long, quality long")
    one = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality long")
    assert Q.learn(Q.with_counts(Q.train_sample(df, none))) == [] == Q.learn(Q.with_counts(Q.train_sample(df, one)))
    assert Q.judge(table(spark, []), []).count() == 0
