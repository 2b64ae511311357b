"""License scan against plain word matching and plain containment."""
import random
import re
from re import _parser as sre

from lograil.llm import licenses

TEXTS = [None, "", "Under the MIT License!", "under the mit\nlicense under the MIT license", "Apache License, Version 2.0",
         "CC-BY-NC 4.0; licensed under the Apache License, Version 2.0 (the License)", "cc by\u00a0nc", "permit the mit",
         "Distributed under the GNU General Public License v3 or later. SPDX-License-Identifier: BSD-3-Clause. All rights reserved.",
         "x " * 30_000 + "cc by nc" + " y" * 30_000, "cc by nc-sa license", "éunder the mit license"]


def plain(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_and_labels(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumnRenamed("doc_id", "doc_id").repartition(3)
    rows = {r.doc_id: r for r in licenses.summary(licenses.detect(docs)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert rows[0].labels == "" and rows[0].score == 0
    assert {"gpl-3-or-later", "bsd-3", "proprietary"} <= set(rows[8].labels.split(","))
    assert "cc-by-nc-sa" in rows[10].labels


def test_suppression_is_containment_by_priority():
    rng = random.Random(2)
    for _ in range(200):
        found = []
        for n in range(rng.randint(0, 12)):
            a = rng.randint(0, 10)
            found.append((n, rng.randint(1, 3), a, a + rng.randint(1, 6)))

        def beaten(x, y):
            if not (y[2] <= x[2] and x[3] <= y[3]) or x is y or y[1] < x[1]:
                return False
            return y[1] > x[1] or (y[2:] != x[2:]) or y[0] < x[0]
        wanted = [x for x in found if not any(beaten(x, y) for y in found)]
        assert sorted(licenses.suppress(found)) == sorted(wanted)


def test_keywords_never_hide_a_match():
    names = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", name).split("|")[0] for name, _ in licenses.NAMES.values()]
    texts = [f"licensed under the {n} license" for n in names] + [f"spdx license identifier {n}" for n in names] + [t or "" for t in TEXTS[:9]]
    for text in texts:
        words = licenses.words_of(text.encode())
        run = set(licenses.possible(set(words)))
        assert all(n in run for n, (_, pattern) in enumerate(licenses.rules()) if pattern.search(b" ".join(words)))


def made(tree, rng):
    """A text that a parsed pattern matches; choices, repeats and characters of a set at random."""
    out = ""
    for op, x in tree:
        if op is sre.LITERAL:
            out += chr(x)
        elif op is sre.NOT_LITERAL:
            out += "q"
        elif op is sre.IN:
            kind, y = rng.choice(x)
            out += "q" if kind is sre.NEGATE or x[0][0] is sre.NEGATE else chr(rng.randint(*y) if kind is sre.RANGE else y)
        elif op is sre.BRANCH:
            out += made(rng.choice(x[1]), rng)
        elif op is sre.SUBPATTERN:
            out += made(x[3], rng)
        elif op is sre.MAX_REPEAT:
            out += "".join(made(x[2], rng) for _ in range(rng.randint(x[0], min(x[1], x[0] + 6))))
        else:
            raise ValueError(op)
    return out


def test_every_form_of_a_rule_passes_its_keywords():
    """Optional spaces join words: gplv3, mpl2; all rules run without prefilter find what `scan` runs."""
    rng = random.Random(4)
    for n, (rule, pattern) in enumerate(licenses.rules()):
        tree = sre.parse(rule.pattern)
        for text in {made(tree, rng) for _ in range(30)}:
            assert pattern.fullmatch(text.encode()), (rule.label, text)
            words = licenses.words_of(text.encode())
            run = set(licenses.possible(set(words)))
            assert n in run, (rule.label, text)
    for name in ("gpl", "lgpl", "agpl", "mpl", "epl"):
        for joint in ("", "v", "v ", " v", " v ", " version ", "version ", " "):
            for version in ("1", "1 1", "2", "2 1", "3", "3 or later"):
                for text in (f"licensed under {name}{joint}{version}", f"spdx license identifier {name}{joint}{version}",
                             f"subject to the terms of the gnu {name}{joint}{version} license"):
                    words = licenses.words_of(text.encode())
                    run = set(licenses.possible(set(words)))
                    assert all(n in run for n, (_, pattern) in enumerate(licenses.rules()) if pattern.search(b" ".join(words))), text
    labels = lambda text: {rule.label for rule, _, _ in licenses.scan(text)[1]}
    assert labels(b"Licensed under GPLv3.") == {"gpl-3"} and labels(b"subject to LGPLv2.1") == {"lgpl-2.1"}
    assert labels(b"SPDX-License-Identifier: MPL2") == {"mpl-2"} and labels(b"an EPLv2 license") == {"epl-2"}


def test_hundreds_of_rules_and_empty_table(spark):
    assert len(licenses.rules()) > 300
    assert licenses.summary(licenses.detect(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0
