"""Licence scans: passages of texts compared with licence templates.

A passage is a run of whole sentences.  Texts and templates are normalised to
lower-case words; passage and template are compared by the Dice coefficient of
their word bigrams, counted with repeats.  A Dice coefficient of t needs a
passage with between t / (2 - t) and (2 - t) / t times the template's bigrams,
so only templates in these bounds are compared, and only passages which begin
and end with a sentence that shares a bigram with the template: a sentence
without one, at either end, only lowers the coefficient.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import with_arrow_columns

# ---- fixed values: public licence notices ------------------------------------
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
# ------------------------------------------------------------------------------

WORD = re.compile(r"[^\W_]+")
SIMILAR = 0.8


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    size = a.total() + b.total()
    return 2.0 * (a & b).total() / size if size else 0.0


class Templates:
    def __init__(self, templates: dict[str, list[str]], similar: float) -> None:
        self.all = sorted((name, Counter(bigrams(words_of(text)))) for name, texts in templates.items() for text in texts)
        self.similar, self.vocabulary = similar, {w for _, grams in self.all for pair in grams for w in pair}
        self.known = {pair for _, grams in self.all for pair in grams}

    def scan(self, text: str | None) -> list[tuple[str, float]]:
        """The best coefficient of each licence found, best first."""
        if not text:
            return []
        lowered = text.lower()
        words = WORD.findall(lowered)
        if len(self.vocabulary.intersection(words)) < 2:
            return []
        shared = Counter(filter(self.known.__contains__, zip(words, words[1:])))
        # A passage shares no more pairs than its whole text, and needs as many
        # as the smallest passage in bounds has.
        wanted = [(name, t) for name, t in self.all if (t & shared).total() >= self.similar / (2 - self.similar) * t.total() - 1e-9] if shared else []
        if not wanted:
            return []
        found: dict[str, float] = {}
        pairs = list(zip(words, words[1:]))
        for name, template in wanted:
            value = self.best_passage(pairs, template, found.get(name, 0.0))
            if value >= self.similar and value > found.get(name, 0.0):
                found[name] = value
        return sorted(found.items(), key=lambda x: (-x[1], x[0]))

    def best_passage(self, pairs: list[tuple[str, str]], template: Counter, least: float) -> float:
        """The greatest coefficient of any run of words, if above ``least``.

        A run which begins or ends with a pair the template lacks is beaten by
        the run without it, so runs lead from one shared pair to another.  The
        size bounds end a run, and a start with too few shared pairs ahead of
        it within them is passed over.
        """
        size, best = template.total(), least
        places = [i for i, pair in enumerate(pairs) if pair in template]
        low, high = self.similar / (2 - self.similar) * size - 1e-9, (2 - self.similar) / self.similar * size + 1e-9
        reach = 0
        for first, start in enumerate(places):
            while reach < len(places) and places[reach] - start + 1 <= high:
                reach += 1
            if reach - first < low:
                continue
            seen: dict[tuple[str, str], int] = {}
            shared = 0
            for at in places[first:reach]:
                pair = pairs[at]
                seen[pair] = seen.get(pair, 0) + 1
                if seen[pair] <= template[pair]:
                    shared += 1
                    best = max(best, 2.0 * shared / (at - start + 1 + size))
            if best >= 1.0:
                break
        return best


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with ``license`` (the most similar, ties by name; null if none
    reaches ``similar``), ``dice`` (0 if none) and ``licenses`` (all found,
    best first, comma-joined), in place of columns of these names.

    Null and empty texts have no licence.
    """
    known = Templates(templates or TEMPLATES, similar)

    def fill(texts: list[str | None]) -> dict[str, list]:
        found = [known.scan(t) for t in texts]
        return {"license": [f[0][0] if f else None for f in found], "dice": [f[0][1] if f else 0.0 for f in found], "licenses": [",".join(n for n, _ in f) for f in found]}

    return with_arrow_columns(docs, text, {"license": "string", "dice": "double", "licenses": "string"}, fill)
