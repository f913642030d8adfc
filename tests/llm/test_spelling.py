"""Spelling variants against plain loops."""

import random
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidemark.llm import spelling
from tidemark.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def neighbours(word, alphabet):
    """All texts one edit away, built one by one."""
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


def expected(counts, ratio=5):
    alphabet = sorted(set("".join(counts)))
    forms, near = {}, {}
    for word, n in counts.items():
        found = [w for w in neighbours(word, alphabet) if w in counts]
        best = min(found, key=lambda w: (-counts[w], w), default=None)
        near[word] = len(found)
        forms[word] = best if best is not None and counts[best] >= ratio * n else None
    rows = {}
    for word, n in counts.items():
        root = word
        while forms[root]:
            root = forms[root]
        rows[word] = (n, near[word], forms[word], counts.get(forms[word]), root)
    return rows


def got(frame):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in frame.collect()}


@pytest.mark.parametrize("seed, group_rows", [(1, 512), (2, 4), (3, 1)])
def test_variants_equal_brute_force(spark, seed, group_rows):
    rng = random.Random(seed)
    counts = {}
    for _ in range(250):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
        counts[word] = rng.choice([1, 2, 5, 10, 25, 50, 125, 625])
        if rng.random() < 0.5:
            counts["hotprefix" + word + "hottail"] = rng.choice([1, 5, 25])
    words = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("score", F.lit(1))
    rows = spelling.spelling_variants(words, group_rows=group_rows)
    assert got(rows) == expected(counts) and rows.count() == len(counts)


def test_scan_equals_pairwise_distance():
    rng = random.Random(4)

    for m in (1, 2, 5):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([m, m + 1]))) for _ in range(120)})
        pairs = set(spelling.one_edit(words, m))
        want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words)
                if len(a) == m and b in neighbours(a, "abc") and len(b) >= m and (len(b) > m or j > i)}
        assert pairs == want and want


def brute_counts(rows, min_length=6, min_count=5):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
                counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def test_counts_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "Letter letter LETTERÉ αletter letterĀletter x9letters9"), (3, "letter " * 5000), (None, "letter lettre"),
            (4, "×÷×÷×÷ " * 7), (4, "×÷×÷×÷ " * 7)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    for held in (spelling.HELD_WORDS, 1):
        found = {r["word"]: r["n"] for r in spelling.word_counts(frame, held=held).collect()}
        assert found == brute_counts(rows) and len(found) == 2
    assert spelling.spelling_variants(spelling.word_counts(frame.limit(0))).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").collect()]
    result = spelling.op11_spelling(spark, FOLDER)
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = expected(brute_counts(rows))
    assert got(result) == want and len(want) > 500 and any(r[2] for r in want.values())
