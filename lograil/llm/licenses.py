"""License detection by ordered signature rules.

Texts become words (ASCII letters and digits lower-cased, and all non-ASCII characters); a rule is a
regular expression over the words joined by single spaces, with a label, a priority, a weight and
keywords that its matches cannot do without. Only rules whose keywords stand in the text are run, so
most texts are settled by their set of words. A detection whose words lie inside those of another one of at
least its priority gives way to it; of equal intervals the earlier rule stays. Places of the three
base phrases are never suppressed.

Defined cases: a null text is empty, has no words, no places, empty labels and score 0; every row
gets a row, whatever its other columns are called.
"""
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm.common import whole

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}



def _joined(name: str, digit: int) -> str:
    """Words that a short name begins with a version behind it: apart from it or, as in gplv3, joined to it."""
    return f"{name} {name}{digit} {name}v {name}v{digit} {name}version"


# Label: its names as patterns over words, and keywords, one of which any of its names contains.
NAMES = {
    "mit": ("(?:the )?mit(?: x11| expat)?", "mit"),
    "mit-0": ("mit (?:0|no attribution|zero)", "mit"),
    "apache-1.1": ("apache (?:software )?(?:license )?(?:version |v ?)?1 1", "apache"),
    "apache-2": ("apache (?:software )?(?:license )?(?:version |v ?)?2(?: 0)?", "apache"),
    "gpl-2": ("(?:gnu )?(?:gpl|general public license) ?(?:version |v ?)?2(?: 0)?(?: only)?", "general " + _joined("gpl", 2)),
    "gpl-2-or-later": ("(?:gnu )?(?:gpl|general public license) ?(?:version |v ?)?2(?: 0)?(?: or (?:any )?later)", "general " + _joined("gpl", 2)),
    "gpl-3": ("(?:gnu )?(?:gpl|general public license) ?(?:version |v ?)?3(?: 0)?(?: only)?", "general " + _joined("gpl", 3)),
    "gpl-3-or-later": ("(?:gnu )?(?:gpl|general public license) ?(?:version |v ?)?3(?: 0)?(?: or (?:any )?later)", "general " + _joined("gpl", 3)),
    "lgpl-2.1": ("(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v ?)?2 1", "lesser " + _joined("lgpl", 2)),
    "lgpl-3": ("(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v ?)?3(?: 0)?", "lesser " + _joined("lgpl", 3)),
    "agpl-3": ("(?:gnu )?(?:agpl|affero general public license) ?(?:version |v ?)?3(?: 0)?", "affero " + _joined("agpl", 3)),
    "gfdl": ("(?:gnu )?(?:gfdl|free documentation license)(?: 1 [0-3])?", "gfdl documentation"),
    "0bsd": ("0bsd|zero clause bsd", "0bsd bsd"),
    "bsd-2": ("bsd (?:2 clause|simplified)|2 clause bsd|freebsd", "bsd freebsd"),
    "bsd-3": ("bsd (?:3 clause|new|revised|modified)|(?:3 clause|new|modified) bsd", "bsd"),
    "bsd-4": ("bsd (?:4 clause|original)|(?:4 clause|original) bsd", "bsd"),
    "isc": ("isc", "isc"),
    "mpl-1.1": ("(?:mozilla public license|mpl) ?(?:version |v ?)?1 1", "mozilla " + _joined("mpl", 1)),
    "mpl-2": ("(?:mozilla public license|mpl) ?(?:version |v ?)?2(?: 0)?", "mozilla " + _joined("mpl", 2)),
    "epl-1": ("(?:eclipse public license|epl) ?(?:version |v ?)?1(?: 0)?", "eclipse " + _joined("epl", 1)),
    "epl-2": ("(?:eclipse public license|epl) ?(?:version |v ?)?2(?: 0)?", "eclipse " + _joined("epl", 2)),
    "eupl": ("(?:european union public licen[cs]e|eupl)(?: (?:version |v ?)?1 [12])?", "european eupl"),
    "cddl": ("(?:common development and distribution license|cddl)(?: 1 [01])?", "development cddl"),
    "cpl": ("(?:common public license|cpl)(?: 1 0)?", "common cpl"),
    "ms-pl": ("microsoft public license|ms pl", "microsoft ms"),
    "ms-rl": ("microsoft reciprocal license|ms rl", "microsoft ms"),
    "artistic-1": ("artistic (?:license )?1(?: 0)?", "artistic"),
    "artistic-2": ("artistic (?:license )?2(?: 0)?", "artistic"),
    "boost": ("boost(?: software)?(?: license)?(?: 1 0)?|bsl 1 0", "boost bsl"),
    "zlib": ("zlib(?: libpng)?", "zlib"),
    "libpng": ("libpng", "libpng"),
    "openssl": ("openssl", "openssl"),
    "python": ("python(?: software foundation)?|psf", "python psf"),
    "php": ("php(?: 3 0[01]?)?", "php"),
    "ruby": ("ruby", "ruby"),
    "perl": ("perl(?: 5)?", "perl"),
    "postgresql": ("postgresql", "postgresql"),
    "unlicense": ("unlicense", "unlicense"),
    "wtfpl": ("wtfpl|do what the fuck you want to public license", "wtfpl fuck"),
    "beerware": ("beer ?ware", "beerware beer"),
    "ofl": ("(?:sil )?open font license(?: 1 [01])?|ofl 1 1", "font ofl"),
    "odbl": ("odbl(?: 1 0)?|open (?:data commons open )?database license", "odbl database"),
    "odc-by": ("odc by(?: 1 0)?|open data commons attribution", "odc attribution"),
    "pddl": ("pddl(?: 1 0)?", "pddl"),
    "cc0": ("cc0(?: 1 0)?(?: universal)?|(?:cc|creative commons) zero", "cc0 zero"),
    "cc-by": ("(?:cc|creative commons) (?:by|attribution)(?: [1-4] [05])?", "cc creative"),
    "cc-by-sa": ("(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)(?: [1-4] [05])?", "cc creative"),
    "cc-by-nd": ("(?:cc|creative commons) (?:by|attribution) (?:nd|no ?deriv(?:ative)?s?)(?: [1-4] [05])?", "cc creative"),
    "cc-by-nc": ("(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)(?: [1-4] [05])?", "cc creative"),
    "cc-by-nc-sa": ("(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)(?: [1-4] [05])?", "cc creative"),
    "cc-by-nc-nd": ("(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s?)(?: [1-4] [05])?", "cc creative"),
    "llama": ("llama ?[234]?(?: community)?", "llama llama2 llama3 llama4"),
    "openrail": ("(?:bigscience |bigcode |creativeml )?open ?rail(?: m)?(?: v1)?", "openrail rail"),
    "elastic-2": ("elastic (?:license )?(?:version |v ?)?2(?: 0)?", "elastic"),
    "sspl": ("server side public license|sspl(?: v?1)?", "server sspl"),
    "busl": ("business source license|busl(?: 1 1)?", "business busl"),
    "ncsa": ("(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    "afl-3": ("academic free license|afl 3(?: 0)?", "academic afl"),
    "osl-3": ("open software license|osl 3(?: 0)?", "software osl"),
    "upl": ("universal permissive license|upl 1 0", "universal upl"),
}
# Priority, weight, shape of what may stand around a name, and keywords of it; the higher priority wins.
SHAPES = (
    (9, 0.98, "spdx license identifier (?:NAME)", "spdx"),
    (8, 0.95, "(?:licen[sc]ed|released|distributed|available|provided|published|covered|redistributed|offered) "
              "(?:only |freely )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:NAME)(?: (?:public )?licen[sc]e)?", "under"),
    (7, 0.9, "under (?:the )?(?:terms of (?:the )?)?(?:NAME) (?:public )?licen[sc]e", "under"),
    (6, 0.85, "licen[sc]e (?:is |type |name )?(?:the )?(?:NAME)(?: licen[sc]e)?", "license licence"),
    (5, 0.8, "(?:NAME) (?:public |software |style )?licen[sc]e[ds]?", "license licence licensed licenced licenses licences"),
    (4, 0.7, "subject to (?:the )?(?:terms of (?:the )?)?(?:NAME)", "subject"),
)
# Sentences of license texts and notices: label, priority, weight, pattern, keywords.
SENTENCES = (
    ("mit", 10, 0.95, "permission is hereby granted free of charge to any person obtaining a copy", "permission"),
    ("isc", 10, 0.9, "permission to use copy modify and or distribute this software for any purpose", "permission"),
    ("bsd", 8, 0.9, "redistribution and use in source and binary forms with or without modification", "redistribution"),
    ("bsd-3", 10, 0.9, "neither the name of (?:the )?(?:[^ ]+ ){1,6}nor the names of its contributors", "neither"),
    ("apache-2", 10, 0.95, "you may obtain a copy of the license at (?:http |https )?www apache org licenses license 2 0", "apache"),
    ("gpl", 8, 0.9, "free software you can redistribute it and or modify it under the terms of the gnu", "gnu"),
    ("unlicense", 10, 0.95, "free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", 5, 0.7, "(?:in|into|to) the public domain", "domain"),
    ("public-domain", 6, 0.8, "dedicated to the public domain", "domain"),
    ("proprietary", 3, 0.5, "all rights reserved", "reserved"),
    ("proprietary", 6, 0.7, "(?:confidential and proprietary|proprietary and confidential)", "proprietary"),
    ("proprietary", 6, 0.7, "(?:no part of this|may not be) (?:[^ ]+ ){0,6}reproduced", "reproduced"),
    ("copyright", 1, 0.3, "copyright (?:c )?(?:19|20)[0-9]{2}", "copyright"),
    ("no-warranty", 1, 0.3, "provided as is without (?:any )?warranty", "warranty"),
    ("non-commercial", 4, 0.6, "(?:non commercial|noncommercial|research) (?:use|purposes?) only", "commercial noncommercial research"),
    ("eula", 5, 0.6, "end user licen[sc]e agreement", "agreement"),
)
LETTERS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    pattern: str
    needs: tuple[str, ...]      # of each of these lists of words a match contains one
    base: bool = False


@lru_cache(maxsize=1)
def rules() -> tuple[tuple[Rule, re.Pattern], ...]:
    """All rules in order: base phrases, sentences, then every name in every shape."""
    listed = [Rule(label, 20, 0.95, phrase, tuple(phrase.split()), True) for phrase, label in BASE.items()]
    listed += [Rule(label, priority, weight, pattern, (words,)) for label, priority, weight, pattern, words in SENTENCES]
    listed += [Rule(label, priority, weight, shape.replace("NAME", name), (words, around))
               for priority, weight, shape, around in SHAPES for label, (name, words) in NAMES.items()]
    return tuple((rule, re.compile(b"(?<![^ ])(?:" + rule.pattern.encode() + b")(?![^ ])")) for rule in listed)


@lru_cache(maxsize=1)
def _keywords() -> tuple[dict[bytes, list[int]], list[list[frozenset[bytes]]]]:
    """Rules by the words of their first list, and the other lists of each rule."""
    by_word: dict[bytes, list[int]] = {}
    others = []
    for n, (rule, _) in enumerate(rules()):
        lists = [frozenset(x.encode().split()) for x in rule.needs]
        for word in lists[0]:
            by_word.setdefault(word, []).append(n)
        others.append(lists[1:])
    return by_word, others


def possible(words: set[bytes]) -> list[int]:
    """Numbers of the rules of whose keywords a text with these words has enough."""
    by_word, others = _keywords()
    found = {n for word in words & by_word.keys() for n in by_word[word]}
    return sorted(n for n in found if not any(words.isdisjoint(x) for x in others[n]))


def words_of(data: bytes) -> list[bytes]:
    return data.lower().translate(LETTERS).split()


def suppress(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Detections (rule number, priority, start, end) that lie inside none of at least their priority."""
    kept, starts, reach = [], np.empty(0, np.int64), np.empty(0, np.int64)
    for level in sorted({x[1] for x in found}, reverse=True):
        furthest = -1
        for item in sorted((x for x in found if x[1] == level), key=lambda x: (x[2], -x[3], x[0])):
            at = np.searchsorted(starts, item[2], "right") - 1
            if item[3] > furthest and (at < 0 or reach[at] < item[3]):
                kept.append(item)
                furthest = item[3]
        order = sorted((x[2], x[3]) for x in kept)
        starts = np.array([x[0] for x in order], np.int64)
        reach = np.maximum.accumulate(np.array([x[1] for x in order], np.int64))
    return kept


def scan(data: bytes) -> tuple[int, list[tuple[Rule, int, int]]]:
    """Number of words, and detections as (rule, first word, word behind the last)."""
    words = words_of(data)
    numbers = possible(set(words))
    if not numbers:
        return len(words), []
    text = b" ".join(words)
    matches = [(n, rules()[n][0], m.start(), m.end()) for n in numbers for m in rules()[n][1].finditer(text)]
    if not matches:
        return len(words), []
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    first = np.searchsorted(gaps, [m[2] for m in matches])
    behind = np.searchsorted(gaps, [m[3] for m in matches]) + 1
    base = [(rule, int(a), int(b)) for (_, rule, _, _), a, b in zip(matches, first, behind) if rule.base]
    others = suppress([(n, rule.priority, int(a), int(b)) for (n, rule, _, _), a, b in zip(matches, first, behind)])
    return len(words), base + [(rules()[n][0], a, b) for n, _, a, b in others if not rules()[n][0].base]


DETECTIONS = "array<struct<label:string,start:bigint,stop:bigint,priority:int,weight:double,base:boolean>>"


def _scanned(batches):
    for batch in batches:
        counts, found = [], []
        for data in batch.column("data").to_pylist():
            n, places = scan(data)
            counts.append(n)
            found.append([{"label": r.label, "start": a, "stop": b, "priority": r.priority, "weight": r.weight, "base": r.base}
                          for r, a, b in places])
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("priority", pa.int32()),
                                   ("weight", pa.float64()), ("base", pa.bool_())]))
        yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind)],
                              ["doc_id", "n_words", "detections"])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, detections (label, start, stop, priority, weight, base) for each document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").cast("binary").alias("data"))
    return rows.mapInArrow(_scanned, f"doc_id bigint, n_words bigint, detections {DETECTIONS}")


def summary(found: DataFrame) -> DataFrame:
    """Counts, places, labels and a score of each document; score is 1 - product of (1 - weight) over labels."""
    base = F.filter("detections", lambda x: x["base"])
    names = lambda items: F.array_join(F.array_sort(F.array_distinct(F.transform(items, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"])
    labels = F.array_distinct(F.transform("detections", lambda x: x["label"]))
    doubt = F.aggregate(labels, F.lit(1.0), lambda left, label: left * (1 - F.array_max(
        F.transform(F.filter("detections", lambda x: x["label"] == label), lambda x: x["weight"]))))
    return found.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"),
                        names(F.col("detections")).alias("labels"), (1 - doubt).alias("score"))
