"""Dictionary segmentation against all selections of each group, in SQL and with a dictionary fitted to a corpus."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from tidewright.functions.segment import Segmenter, fitted_dictionary, keyword_counts, register_segments, segments


def brute(run, dictionary):
    """Of every set of dictionary words without overlaps: group by group, the best by the rule."""
    found = sorted((b, e) for b in range(len(run)) for e in range(b + 2, len(run) + 1) if run[b:e] in dictionary)
    groups, upto = [], 0
    for w in found:
        if not groups or w[0] >= upto:
            groups.append([])
        groups[-1].append(w)
        upto = max(upto, w[1]) if len(groups[-1]) > 1 else w[1]
    out, at = [], 0
    for g in groups:
        best = None
        for n in range(1, len(g) + 1):
            for pick in itertools.combinations(g, n):
                if all(a[1] <= b[0] for a, b in itertools.pairwise(pick)):
                    sizes = [e - b for b, e in pick]
                    rank = (sum(sizes), -n, pick[-1][1] - pick[0][0], pick[-1][1], math.prod(sizes), sum(k * s for k, s in enumerate(sizes, 1)))
                    if best is None or rank > best[0]:
                        best = rank, pick
        for b, e in best[1]:
            out += [*run[at:b], run[b:e]]
            at = e
    return out + list(run[at:])


def test_choice_among_overlapping_words():
    r, letters = np.random.default_rng(4), "一丁七万丈三"
    for _ in range(400):
        dictionary = {"".join(r.choice(list(letters), r.integers(2, 5))) for _ in range(r.integers(0, 14))}
        run = "".join(r.choice(list(letters), r.integers(1, 12)))
        assert Segmenter(dictionary).words(run) == brute(run, dictionary)


def test_words_of_texts():
    s = Segmenter(["小米", "手机", "京东", "自营", "移动", "联通", "电信", "移动联通", "米手", "x"])
    assert s.words("小米手机 京东自营5G移动联通电信! OK") == ["小米", "手机", "京东", "自营", "5g", "移动联通", "电信", "ok"]
    assert s.words(None) == s.words("") == s.words("、 \n") == [] and Segmenter([]).words("小米a") == ["小", "米", "a"]
    long = "小米手机米" * 20_000
    assert Counter(s.words(long)) == {"小米": 20_000, "手机": 20_000, "米": 20_000}


def test_table_function_and_fitted_dictionary(spark):
    r = np.random.default_rng(2)
    words = ["小米", "手机", "人民银行", "电信"]
    texts = [("ab"[k % 2], None if k == 3 else "".join(r.choice([*words, "的", "了", "是"], 12)) + " Ab1") for k in range(120)]
    df = spark.createDataFrame(texts, "k string, text string")
    fitted = {x.word: x.n for x in fitted_dictionary(df, "text").collect()}
    every = Counter(t[i : i + n] for _, t in texts if t for i in range(len(t)) for n in range(1, 5) if i + n <= len(t))
    assert set(words) <= set(fitted) and all(every[w] == n for w, n in fitted.items()) and "的了" not in fitted
    dictionary = set(words)
    want = Counter((k, w) for k, t in texts if t for w in [*brute(t[:-4], dictionary), "ab1"])
    of = segments(spark, dictionary)
    assert {(x.k, x.keyword): x.keyword_count for x in keyword_counts(df, "text", of, ["k"]).collect()} == want
    register_segments(spark, dictionary, "cut_words")
    df.createOrReplaceTempView("segment_texts")
    got = spark.sql("SELECT k, word, count(*) AS n FROM segment_texts t, LATERAL cut_words(t.text) GROUP BY k, word").collect()
    assert {(x.k, x.word): x.n for x in got} == want
    with pytest.raises(ValueError, match="at most 3"):
        segments(spark, dictionary, most=3)
    assert fitted_dictionary(df.limit(0), "text").count() == 0
