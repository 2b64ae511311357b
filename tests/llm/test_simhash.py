"""SimHash links and components against all pairs."""
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lograil.llm import simhash
from lograil.llm.components import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\r\x0b\x0c":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(items, linked):
    parent = {i: i for i in items}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in combinations(items, 2):
        if linked(a, b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in items}


def test_equals_all_pairs(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["the", "Cat", "sat", "ÉÀ", "on", "a\tmat", "x\u00a0y"]) for _ in range(n)) for n in (3, 40, 200, 200)]
    rows = [(None, None), (7, ""), (8, " \n"), (9, "One"), (10, "one two"), (11, "ONE TWO")]
    for i in range(90):
        words = rng.choice(base).split(" ")
        words[rng.randrange(len(words))] = rng.choice(["dog", "the"])
        rows.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = simhash.near_duplicates(docs).collect()
    prints = {r: plain_fingerprint(t) for r, t in rows}
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == prints and len(found) == len(rows)
    ids = [i for i in prints if i is not None]
    wanted = plain_components(ids, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == wanted
    assert next(r.component_id for r in found if r.doc_id is None) == 7
    kept = [r.doc_id for r in simhash.one_of_each(simhash.near_duplicates(docs)).collect() if r.kept]
    assert sorted(kept) == sorted(set(wanted.values()))


@pytest.mark.parametrize("size", [200, 900])
def test_links_inside_a_posting_list(size):
    rng = np.random.default_rng(size)
    members = np.unique(rng.integers(0, 1 << 16, size, dtype=np.uint64)) << np.uint64(24)
    rng.shuffle(members)
    i, j = simhash._near(2, members)
    got = {frozenset((int(members[a]), int(members[b]))) for a, b in zip(i, j)}
    wanted = {frozenset((int(a), int(b))) for a, b in combinations(members, 2) if int(a ^ b).bit_count() <= 2}
    assert got == wanted and len(i) == len(wanted)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (2000, 2001), (2001, 2000)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)} | {2000: 2000, 2001: 2000}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(simhash.near_duplicates(empty)).count() == 0
