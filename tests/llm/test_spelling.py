"""Spelling variants against plain counting and all pairs of words."""
import random
import re
import zlib
from collections import Counter

import pytest

from lograil.llm import spelling
from lograil.llm.common import table

DOCS = "doc_id bigint, text string"


def plain_words(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            found[word] += 1
    return {w: n for w, n in found.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    """By removing letters one at a time."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(words, near):
    forms = {}
    for word, n in words.items():
        best = min(near[word], key=lambda x: (-words[x], x), default=None)
        forms[word] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for word, n in words.items():
        root = word
        while forms[root]:
            root = forms[root]
        out[word] = (forms[word], root, n, len(near[word]), words[forms[word]] if forms[word] else None)
    return out


def all_pairs(words):
    return {a: [b for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)] for a in words}


def found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    words = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    assert len(words) > 2000
    assert found(spelling.spelling_variants(docs)) == plain_variants(words, all_pairs(words))


SMALL = spelling.Grams(longest=4, share=200, least=1, window=5, block=8, pairs=50)


@pytest.mark.parametrize("grams", [spelling.Grams(), SMALL])
def test_few_letters_and_long_words(spark, grams):
    """Repetitive words, words beyond both windows, lists over several blocks."""
    rng = random.Random(2)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 400) for _ in range(250)}
    long = "".join(rng.choice("abcdé") for _ in range(90))
    for at in (0, 1, 30, 33, 45, 60, 88, 89):
        words[long[:at] + "x" + long[at + 1:]] = words[long[:at] + long[at + 1:]] = words[long[:at] + "y" + long[at:]] = at + 3
    words |= {long: 1000, long + "z": 7, "z" + long: 8, "aaaaa" * 30: 5, "aaaaa" * 30 + "a": 50}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(5)
    assert found(spelling.variants(df, grams=grams)) == plain_variants(words, all_pairs(words))


def test_damage_nulls_repeats_and_ties(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcÀé") for _ in range(rng.randrange(4, 8))) for _ in range(60)]
    docs = [(rng.choice([None, *range(300)]), rng.choice([None, "", "12 345", " ".join(rng.choice([w, w.upper()]) for w in rng.choices(vocabulary, k=30))]))
            for _ in range(200)]
    docs += docs[:40] + [(9, "word×word÷" * 5 + "ÀÉÎ_àéîxx" * 4)]
    words = plain_words(docs)
    assert len(words) > 50
    clashing = spark.createDataFrame([(*d, "w", 1, "k") for d in docs], DOCS + ", word string, n int, key string")
    assert found(spelling.spelling_variants(clashing)) == plain_variants(words, all_pairs(words))


def test_chains_end_at_the_last_form(spark):
    words = {"aaaaaaaaaa"[:10 - k] + "b" * k: 3 * 2 ** k for k in range(11)}
    assert {w: r[1] for w, r in found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint"))).items()} == dict.fromkeys(words, "b" * 10)


def test_empty_tables(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (None, ""), (2, "ab cd")], DOCS)).collect() == []


def test_very_long_text_and_run():
    words = ["hello", "wörld", "ab", "abcdef"] * 400_000
    run = "q" * 3_000_000
    got = spelling.words_of(None, " ".join(words) + " " + run + " " + run, 5)
    plain = Counter()
    for word, n in {"hello": 400_000, "wörld": 400_000, "ab": 400_000, "abcdef": 400_000, run: 2}.items():
        h = zlib.crc32(f":{word}".encode())
        word = word[:h % len(word)] + word[h % len(word) + 1:] if h % 97 == 0 else word
        plain[word] += n
    assert got == {w: n for w, n in plain.items() if len(w) >= 5}
