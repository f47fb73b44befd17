"""License scans with a positional index of rare words.

Templates are short word sequences of license notices. A file is looked up by its own license words of the highest inverse
document frequency, counted over all texts: where such a word stands in the file, its place in a template gives the place
the template would start at. Places that two of the words agree on are laid against the template word by word. A template
counts when enough words stand at their place and its key phrase, all of it, is among them.

Nothing is lost by looking at the rarest words only. Of a template's words that the file holds, all but ``spare`` must
stand at their place for it to count; among any ``spare + 2`` of them at least two do.

Words are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z in lower case. Null texts have
none. Repeated rows stay, extra columns are kept.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.words import byte_texts, map_batches, plain_words

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Openings of public license notices, each with its mandatory key phrase and label.
NOTICES = {
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files",
        "hereby granted free of charge",
    ),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    "gpl-3.0": ("licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    "gpl-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "gnu general public license",
    ),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "source and binary forms",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "mozilla public license v 2 0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted",
        "with or without fee is hereby granted",
    ),
}
# The share of a template's words that must stand at their place.
COVERAGE = 0.7


class Template:
    def __init__(self, label: str, text: str, key: str | None = None):
        self.label, self.base = label, key is None
        self.words = plain_words(text.encode())
        phrase = plain_words(key.encode()) if key else self.words
        fits = [i for i in range(len(self.words)) if self.words[i : i + len(phrase)] == phrase]
        self.key = range(fits[0], fits[0] + len(phrase))
        # How many words must stand at their place, and how many of those looked up agree on it.
        least = 1.0 if self.base else COVERAGE
        self.need = next(n for n in range(1, len(self.words) + 1) if n / len(self.words) >= least)
        self.votes = min(2, self.need)
        self.key_words = frozenset(phrase)

    def coverage(self, words: list[bytes], start: int) -> float:
        """The share of words at their place; 0 if the key phrase isn't whole."""
        at = lambda i: 0 <= start + i < len(words) and words[start + i] == self.words[i]
        if not all(at(i) for i in self.key):
            return 0.0
        return sum(at(i) for i in range(len(self.words))) / len(self.words)


def templates() -> list[Template]:
    base = [Template(label, phrase) for phrase, label in PHRASES.items()]
    return base + [Template(label, text, key) for label, (text, key) in NOTICES.items()]


def document_frequencies(df: DataFrame, text: str) -> dict[bytes, int]:
    """In how many texts each template word stands; as many rows as the templates have words reach the driver."""
    vocabulary = {w for t in templates() for w in t.words}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = Counter(w for t in byte_texts(batch.column(0)) for w in vocabulary.intersection(plain_words(t)))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    rows = map_batches(df.select(text), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


class Index:
    """The templates, with their words in the order in which files are looked up by them."""

    def __init__(self, found_in: Mapping[bytes, int]):
        self.templates = templates()
        self.vocabulary = frozenset(w for t in self.templates for w in t.words)
        # Places of each template, those of the rarest words first.
        self.rarest = [
            sorted(range(len(t.words)), key=lambda i, t=t: (found_in.get(t.words[i], 0), t.words[i], i)) for t in self.templates
        ]

    def postings(self, held: frozenset[bytes]) -> dict[bytes, list[tuple[int, int]]]:
        """``(template, place)`` for the rarest words of a file that holds these license words."""
        out: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, (template, rarest) in enumerate(zip(self.templates, self.rarest)):
            if not template.key_words <= held:
                continue
            places = [i for i in rarest if template.words[i] in held]
            spare = len(places) - template.need
            if spare >= 0:
                for place in places[: spare + template.votes]:
                    out[template.words[place]].append((number, place))
        return out

    def scan(self, words: list[bytes]) -> list[tuple[str, bool, int, float]]:
        """``(label, base, start, coverage)``: every place of a phrase, the best place of a notice."""
        postings = self.postings(self.vocabulary.intersection(words))
        agreed: Counter = Counter()
        if postings:
            for at, word in enumerate(words):
                if word in postings:
                    agreed.update((number, at - place) for number, place in postings[word])
        found, best = [], {}
        for (number, start), votes in agreed.items():
            template = self.templates[number]
            if votes < template.votes:
                continue
            share = template.coverage(words, start)
            if template.base and share == 1:
                found.append((template.label, True, start, 1.0))
            elif not template.base and share >= COVERAGE:
                best[number] = max(best.get(number, (0.0, 0)), (share, -start))
        found += [(self.templates[n].label, False, -start, share) for n, (share, start) in best.items()]
        return sorted(found, key=lambda f: (f[2], f[0]))


def scan_licences(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df``, ``n_words`` and ``licences``, an array of ``(label, base, start, coverage)`` by start.

    Columns of these names are replaced.
    """
    df = df.drop("n_words", "licences")
    frequencies = df.sparkSession.sparkContext.broadcast(document_frequencies(df, text))
    state: list[Index] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Index(frequencies.value))
        sizes, found = [], []
        for value in byte_texts(batch.column(batch.schema.get_field_index(text))):
            words = plain_words(value)
            sizes.append(len(words))
            found.append(
                [{"label": a, "base": b, "start": c, "coverage": d} for a, b, c, d in state[0].scan(words)]
            )
        kind = pa.list_(
            pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("coverage", pa.float64())])
        )
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sizes, pa.int64()), pa.array(found, kind)],
            names=[*batch.schema.names, "n_words", "licences"],
        )

    schema = ", ".join(
        [
            *(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema),
            "n_words bigint, licences array<struct<label: string, base: boolean, start: bigint, coverage: double>>",
        ]
    )
    return map_batches(df, run, schema)
