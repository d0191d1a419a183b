"""Counts and risk-controlled cutoffs against brute force."""

import random
import re
from collections import Counter
from math import comb

import pytest

from tidemark.llm.quality import LADDERS, certified, judge, op2_quality_rules

SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, dup, len(hit)


def values(c):
    n, chars, symbols, lines, dup, again = c
    return {
        "symbols_per_word": symbols / n if n else 0.0,
        "repeated_lines": dup / lines if lines else 0.0,
        "repeated_words": again / n if n else 0.0,
        "long_words": chars / n if n else 0.0,
        "short_words": -chars / n if n else -1e9,
    }


def brute(rows, labels, alpha=0.02, delta=0.05):
    """rows: (doc_id, text, stratum); returns per row counts, base_failed and kept."""
    told = {}
    for i, t, s in rows:
        c = counts(t)
        told[i] = (c, c[0] < 10 or 100 * c[5] > 20 * c[0], s, values(c))
    good = [told[i] for i, q in labels if q == 1 and i in told and not told[i][1] and told[i][2] is not None]
    strata = {g[2] for g in good}
    cut = {}
    for s in strata:
        own = [g[3] for g in good if g[2] == s]
        for rule, ladder in LADDERS.items():
            for c in ladder:
                k, n, r = sum(v[rule] >= c for v in own), len(own), alpha / len(LADDERS)
                if sum(comb(n, j) * r**j * (1 - r) ** (n - j) for j in range(k + 1)) > delta / (len(strata) * len(LADDERS)):
                    break
                cut[s, rule] = c
    return {
        i: (*c, failed, not failed and not any(v[r] >= cut[s, r] for r in LADDERS if (s, r) in cut))
        for i, (c, failed, s, v) in told.items()
    }


def shaped(rows):
    return {
        r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
        for r in rows
    }


@pytest.mark.parametrize("alpha", [0.02, 0.3])
def test_equals_brute_force(spark, alpha):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [None, "", " \n\n", "\n\nx\nx\n", "a b c d e a b c d e x", "# é\t中 #", "x " * 3000, "a\n a\na", "l\r\nl\r\n"]
    docs += [(10_000 + i, t, None if i % 2 else "en") for i, t in enumerate(odd)]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    labels += [(10_001, 1), (10_004, None), (5, 1), (5, 0), (99_999, 1)]
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id bigint, text string, lang string, stratum int")
    told = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = shaped(judge(df.repartition(4), told, alpha=alpha).collect())
    want = brute(docs, labels, alpha)
    assert got == want
    if alpha == 0.3:
        assert any(not w[-1] and not w[-2] for w in want.values())


def test_whole_table_and_odd_rows(spark):
    rows = op2_quality_rules(spark, SF).collect()
    assert len(rows) == 1000 and all(not (r.base_failed and r.kept) for r in rows)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    df = spark.createDataFrame([(None, "a " * 12, "en"), (1, None, None), (1, None, None)], "doc_id bigint, text string, lang string")
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in judge(df, labels).collect()) == [(0, 12, False), (1, 0, False), (1, 0, False)]
    assert judge(df.where("doc_id = 7"), labels).count() == 0


def test_bound_is_exact():
    assert certified(0, 300, 0.01, 0.05) and not certified(0, 298, 0.01, 0.05)
    assert not certified(0, 0, 0.5, 0.5) and not certified(3, 3, 0.9, 0.9)
