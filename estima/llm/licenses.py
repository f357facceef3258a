"""License scans: a positional index of rare words finds templates, mandatory phrases confirm them."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# The phrases that name a license wherever they stand.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening or characteristic passages of license texts and notices, by name: the label, the
# passage and the phrases that a place must hold to count. Lower case, words as WORD finds them.
TEMPLATES = {
    "mit text": (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ["permission is hereby granted free of charge"],
    ),
    "apache-2 text": (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ["apache license version 2", "in compliance with the license"],
    ),
    "bsd text": (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ["redistribution and use in source and binary forms"],
    ),
    "gpl text": (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ["gnu general public license"],
    ),
    "lgpl text": (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ["gnu lesser general public license"],
    ),
    "mpl-2 text": (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ["mozilla public license"],
    ),
    "cc-by text": (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ["creative commons attribution"],
    ),
    "cc-by-nc text": (
        "cc-by-nc",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        ["creative commons attribution noncommercial"],
    ),
    "cc0 text": (
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        ["waived all copyright and related or neighboring rights"],
    ),
    "isc text": (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["permission to use copy modify and or distribute this software"],
    ),
    "unlicense text": (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        ["free and unencumbered software released into the public domain"],
    ),
    "mit notice": ("mit", "released under the mit license", ["mit license"]),
    "apache-2 notice": ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    "gpl-3 notice": ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "gpl-2 notice": ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    "cc-by-nc notice": ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by notice": ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    "cc-by-sa notice": ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
}

# The opening lines of full texts, by label.
OPENINGS = {
    "gpl-3": "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation",
    "gpl-2": "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation",
    "lgpl-3": "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation",
    "lgpl-2.1": "gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software foundation",
    "agpl-3": "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation",
    "apache-2": "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution",
    "mpl-2": "mozilla public license version 2 0 1 definitions",
    "cc0": "creative commons legal code cc0 1 0 universal",
}

# Identifiers after "SPDX-License-Identifier", as words, and their labels.
SPDX = {
    "mit": "mit", "apache 2 0": "apache-2", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3",
    "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 3 0": "agpl-3", "mpl 2 0": "mpl-2", "isc": "isc", "unlicense": "unlicense",
    "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc",
}

# What must stand in an opening: its first seven words, which name the licence and its version.
TEMPLATES |= {f"{label} opening": (label, text, [" ".join(text.split()[:7])]) for label, text in OPENINGS.items()}
TEMPLATES |= {f"{name} identifier": (label, f"spdx license identifier {name}", [f"spdx license identifier {name}"]) for name, label in SPDX.items()}

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8; lower() changes A-Z alone."""
    return WORD.findall(text.lower())


class Index:
    """Postings (template, position) of the templates' words, and the rarest words by which a file is looked up."""

    def __init__(self, idf: dict[bytes, float], templates: dict, rare_words: int, min_match: float, slack: int):
        self.label = {k: label for k, (label, _, _) in templates.items()}
        self.idf, self.min_match, self.rare_words, self.slack = idf, min_match, rare_words, slack
        self.bodies = {k: text.encode().split() for k, (_, text, _) in templates.items()}
        self.phrases = {k: [p.encode().split() for p in phrases] for k, (_, _, phrases) in templates.items()}
        self.postings = defaultdict(list)
        for name, body in self.bodies.items():
            for at, word in enumerate(body):
                self.postings[word].append((name, at))
        self.weight = {k: sum(idf[w] for w in body) for k, body in self.bodies.items()}
        self.wants = {k: len({w for p in phrases for w in p}) for k, phrases in self.phrases.items()}
        self.wanted_by = defaultdict(list)
        for name, phrases in self.phrases.items():
            for word in {w for p in phrases for w in p}:
                self.wanted_by[word].append(name)
        self.base = [(p.encode().split(), label) for p, label in BASE_PHRASES.items()]
        rare = sorted(self.postings, key=lambda w: (-idf[w], w))
        self.rank = {w: i for i, w in enumerate(rare)}

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str], dict[str, float]]:
        """(places of base phrases, first, last, their labels, {label of the index: share of its weight found})."""
        own = set(words)
        phrases = [(p, label) for p, label in self.base if own.issuperset(p)]
        # Only a template whose mandatory words all stand somewhere in the file can match.
        known = own.intersection(self.rank)
        held = Counter(name for word in known for name in self.wanted_by[word])
        names = {k for k, n in held.items() if n == self.wants[k]}
        if not phrases and not names:
            return 0, None, None, set(), {}
        wanted = {p[-1] for p, _ in phrases}.union(known if names else ())
        at = defaultdict(list)
        for i, word in enumerate(words):
            if word in wanted:
                at[word].append(i)
        places, base = [], set()
        for phrase, label in phrases:
            k = len(phrase)
            found = [i - k + 1 for i in at[phrase[-1]] if i + 1 >= k and words[i - k + 1 : i + 1] == phrase]
            places += found
            base |= {label} if found else set()
        return len(places), min(places, default=None), max(places, default=None), base, self._templates(words, at, sorted(known, key=self.rank.__getitem__), names)

    def _templates(self, words: list[bytes], at: dict[bytes, list[int]], rarest: list[bytes], names: set[str]) -> dict[str, float]:
        """{label: share of its weight found}. The file's licence words, rarest first, are looked up in the postings,
        until each template has been met by rare_words of them; the places where it would begin, give or take slack, get
        the words' weights, and those with enough are verified."""
        met = Counter()
        seeds = Counter()  # by template, the weight of the words that it was looked up by
        votes: dict[str, Counter] = defaultdict(Counter)
        for word in rarest:
            starts: dict[str, set[int]] = defaultdict(set)
            for name, offset in self.postings[word]:
                if name in names and met[name] < self.rare_words:
                    starts[name].update(i - offset + d for i in at[word] for d in range(-self.slack, self.slack + 1))
            for name, agreed in starts.items():
                met[name] += 1
                seeds[name] += self.idf[word]
                for start in agreed:
                    votes[name][start] += self.idf[word]
            if starts and all(met[name] >= self.rare_words for name in names):
                break
        out: dict[str, float] = {}
        for name, places in votes.items():
            label, body = self.label[name], self.bodies[name]
            # A match may miss words of 1 - min_match of the template's weight; where seeds of more are missing, none begins.
            enough = seeds[name] - (1 - self.min_match) * self.weight[name] - 1e-9
            for start in sorted(x for x, w in places.items() if w >= enough):
                near = words[max(0, start - self.slack) : max(0, start + len(body) + self.slack)]
                share = self._share(body, words, start) / self.weight[name]
                if share >= self.min_match and share > out.get(label, 0.0) and all(_holds(near, p) for p in self.phrases[name]):
                    out[label] = share
        return out

    def _share(self, body: list[bytes], words: list[bytes], start: int) -> float:
        """The weight of the template's words that stand in the file at their place, give or take slack."""
        total = 0.0
        for offset, word in enumerate(body):
            i = start + offset
            if word in words[max(0, i - self.slack) : max(0, i + self.slack + 1)]:
                total += self.idf[word]
        return total


def _holds(words: list[bytes], phrase: list[bytes]) -> bool:
    k = len(phrase)
    return any(words[i : i + k] == phrase for i, w in enumerate(words[: len(words) - k + 1]) if w == phrase[0])


def document_frequencies(docs: DataFrame, text_col: str, templates: dict) -> tuple[int, dict[bytes, int]]:
    """(rows, in how many of them each word of the templates occurs): a table as large as the templates' vocabulary."""
    vocabulary = {w for _, text, _ in templates.values() for w in text.encode().split()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen = 0, defaultdict(int)
        for batch in batches:
            for text in batch.column(0):
                rows += 1
                for word in vocabulary.intersection(words_of(text.as_py() or b"")):
                    seen[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *seen], pa.binary()), pa.array([rows, *seen.values()], pa.int64())], names=["word", "n"])

    counts = {bytes(r["word"]): r["n"] for r in docs.select(F.encode(F.col(text_col), "UTF-8").alias("t")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counts.pop(b"", 0), counts


def scan(docs: DataFrame, templates: dict | None = None, rare_words: int = 12, min_match: float = 0.8, slack: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    Words are runs of 0-9, a-z (A-Z in lower case) and anything beyond ASCII. n_base counts all places where a
    base phrase's words stand one after the other; first_word and last_word are the smallest and largest start.
    A template's label is added if, from a place where some of the file's words of highest inverse document
    frequency (over all rows of docs; rare_words for each template that they are in) stand give or take slack words,
    words of min_match of its weight stand at
    their places give or take slack words, and all its mandatory phrases are there. Places that the rare words rule
    out by that weight aren't tried. score is 1 with a base
    label, else the best template's share of weight, else 0. Labels are distinct, sorted, joined by commas.

    Null and empty texts have no words, places or labels (empty strings, score 0). Rows may repeat and keep their
    number; no other column of docs is read; an empty table gives an empty table. What is collected is one count
    for each word of the templates.
    """
    small_batches(docs.sparkSession)
    templates = templates or TEMPLATES
    rows, counts = document_frequencies(docs, text_col, templates)
    idf = {w: math.log((1 + rows) / (1 + counts.get(w, 0))) + 1 for _, text, _ in templates.values() for w in text.encode().split()}
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf, templates, rare_words, min_match, slack)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py() or b"")
                n, first, last, base, more = index.scan(words)
                score = 1.0 if base else max(more.values(), default=0.0)
                out.append((key, len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | set(more))), min(1.0, score)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("t")).mapInArrow(find, schema).withColumnRenamed("id", id_col)
