"""Licence scans: a trained paragraph classifier, confirmed against templates.

A multinomial logistic regression over sparse word 1- to 3-grams gives each paragraph the probability of every licence
family and of the class "unknown"; a temperature fitted on held-out paragraphs calibrates them. A prediction counts only
if its family is likelier than THRESHOLD and the paragraph agrees with one of the family's templates: at least AGREEMENT
of the template's word pairs occur in it, one of them is in no other family's templates, and no template of another family
agrees better. Where a paragraph agrees with several families, the words that confirm one finding are set apart and what is
left on either side is looked at again, so that each of several licences in a line is found; if no family is likely enough
for the whole, its two overlapping parts are looked at. What follows a finding after "or" or "and" is read as if its statement
went on ("licensed under" it), so that each choice of "X or Y" is found. A statement of three words or fewer, such as a
licence's bare name, has to begin or end where its clause does: amid other words it is none.

The classifier is trained here, on PARAGRAPHS texts per family that a seeded generator writes from the templates, and on
prose and near misses for "unknown"; no document of the input is learnt from. A paragraph is a line of the text, and also a
run of lines between lines without words, so that wrapped statements are found; one of more than WINDOW words is
classified in windows that overlap by half. A finding's place is that of the words that confirm it, in paragraphs of any length. Of a line and a run that are found by the same words, the better agreement counts, the line if
they are equal; a line within a run of the same family is part of its statement.

Defined results: a null or empty text has no licence; a null doc_id stays null; rows that repeat give a row each; an
empty table gives an empty table; other columns are left out. Places are code points, end exclusive.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

PARAGRAPHS, WINDOW, SHORTEST, THRESHOLD, AGREEMENT, MIN_COUNT, BARE = 200, 60, 3, 0.8, 0.6, 3, 3
UNKNOWN = "unknown"

# Statements by which texts are put under licences, in families. # stands for a number, @ for a name.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version #", "released under the agpl #", "you can redistribute it under the terms of the gnu affero general public license as published by the free software foundation", "spdx license identifier agpl # or later", "spdx license identifier agpl # only"],
    "apache": ["licensed under the apache license version #", "released under the apache license #", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license #", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "spdx license identifier apache #"],
    "bsd": ["licensed under the bsd license", "released under the # clause bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "neither the name of @ nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "spdx license identifier bsd # clause", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"],
    "cc0": ["released under cc0 #", "dedicated to the public domain", "the author has waived all copyright and related rights to this work under the cc0 # universal public domain dedication", "this work is in the public domain", "spdx license identifier cc0 #"],
    "cc-by": ["licensed under cc by #", "this work is licensed under a creative commons attribution # international license", "spdx license identifier cc by #"],
    "cc-by-nc": ["licensed under cc by nc #", "this work is licensed under a creative commons attribution noncommercial # international license", "for noncommercial use only under cc by nc #", "spdx license identifier cc by nc #"],
    "cc-by-sa": ["licensed under cc by sa #", "this work is licensed under a creative commons attribution sharealike # international license", "text is available under the creative commons attribution sharealike license", "spdx license identifier cc by sa #", "licensed under the creative commons attribution sharealike # license"],
    "gpl": ["this work is licensed under the gnu general public license version #", "released under the gpl v #", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version # of the license or at your option any later version", "you should have received a copy of the gnu general public license along with this program", "spdx license identifier gpl # or later", "spdx license identifier gpl # only", "licensed under gpl # or later", "licensed under the gpl"],
    "isc": ["licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "spdx license identifier isc"],
    "lgpl": ["licensed under the gnu lesser general public license version #", "released under the lgpl #", "you can redistribute it under the terms of the gnu lesser general public license", "spdx license identifier lgpl # or later", "spdx license identifier lgpl # only"],
    "mit": ["released under the mit license", "licensed under the mit license", "this project is available under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "spdx license identifier mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v #", "licensed under the mozilla public license version #", "spdx license identifier mpl #"],
    "boost": ["spdx license identifier bsl #", "distributed under the boost software license version #", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "cc-by-nd": ["spdx license identifier cc by nd #", "licensed under cc by nd #", "this work is licensed under a creative commons attribution noderivatives # international license"],
    "epl": ["spdx license identifier epl #", "made available under the terms of the eclipse public license #", "licensed under the eclipse public license version #"],
    "eupl": ["spdx license identifier eupl #", "licensed under the eupl", "licensed under the european union public licence version #"],
    "unlicense": ["spdx license identifier unlicense", "released under the unlicense", "this is free and unencumbered software released into the public domain"],
    "zlib": ["spdx license identifier zlib", "licensed under the zlib license", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
    "proprietary": ["all rights reserved", "copyright # @ all rights reserved", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", "no part of this publication may be reproduced without the prior written permission of the publisher"],
}
# Names by which families are called, and full names that stand before a version.
NAMES = {
    "agpl": ["agpl #", "gnu agpl #"], "apache": ["apache #", "apache"], "artistic": ["artistic #", "artistic"], "boost": ["bsl #", "boost software"], "bsd": ["bsd # clause", "bsd", "# clause bsd"], "cc0": ["cc0 #", "cc0"],
    "cc-by": ["cc by #"], "cc-by-nc": ["cc by nc #"], "cc-by-nd": ["cc by nd #"], "cc-by-sa": ["cc by sa #"], "epl": ["epl #"], "eupl": ["eupl #", "eupl"], "gpl": ["gpl #", "gpl", "gnu gpl #", "gnu gpl"], "isc": ["isc"], "lgpl": ["lgpl #", "gnu lgpl #"],
    "mit": ["mit"], "mpl": ["mpl #"], "unlicense": ["unlicense"], "zlib": ["zlib"],
}
FULL_NAMES = {
    "agpl": "gnu affero general public license", "apache": "apache license", "artistic": "artistic license", "boost": "boost software license", "epl": "eclipse public license", "gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "mpl": "mozilla public license",
    "cc-by": "creative commons attribution", "cc-by-nc": "creative commons attribution noncommercial", "cc-by-nd": "creative commons attribution noderivatives", "cc-by-sa": "creative commons attribution sharealike",
}
for _family, _names in NAMES.items():
    TEMPLATES.setdefault(_family, [])
    TEMPLATES[_family] += [t for n in _names for t in (f"{n} license", f"license {n}", f"licensed under {n}", f"licensed under the {n} license", f"released under {n}", f"spdx license identifier {n}") if t not in TEMPLATES[_family]]
for _family, _name in FULL_NAMES.items():
    TEMPLATES[_family] += [t for t in (f"{_name} #", f"{_name} version #", f"licensed under the {_name} #", f"licensed under the {_name} # international license" if "creative" in _name else f"released under the {_name} #") if t not in TEMPLATES[_family]]
NEAR_MISSES = [
    "he reserved all rights reserved seats", "the students at mit license their work to others", "a license or permit was asked for", "the apache and the boost of the wind", "they license and sell the artistic works of the group",
    "the driver showed a license to the officer and went on", "she was released under the old bridge", "version # of the story is about the general public", "all the rights of the people were reserved for later",
    "the apache people lived on the plains", "they were all reserved and right", "students at mit study hard in general", "the public library gave permission to read", "a copy of the book was obtained free of charge",
    "the work is in the house", "he used the software under the terms of trade", "she may not use the kitchen", "the notice was above the door", "conditions of any kind were met by the team", "this work is for the commons of the town", "creative people in general share alike", "the spdx license identifier of a file names its license", "spdx license identifier zz", "in no event shall the guests be late",
]
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"v?[0-9.]+")


def tokens(text: str) -> list[str]:
    return ["#" if NUMBER.fullmatch(w) else w for w in WORD.findall(text)]


def grams(words: list[str]) -> Iterator[str]:
    for i, w in enumerate(words):
        yield w
        for n in (2, 3):
            if i + n <= len(words):
                yield " ".join(words[i : i + n])


def _filled(template: str, r: random.Random) -> list[str]:
    out = []
    for w in template.split():
        out += [r.choice(["acme", "foo", "the", "jane", "labs"]) for _ in range(r.randint(1, 3))] if w == "@" else [w]
    return out


_STOP = "the of and to in is that it was for on as with by be this at from are an".split()


def training(seed: int = 11) -> list[tuple[str, list[str]]]:
    """Paragraphs (family, words) of every family and of none."""
    r, rows = random.Random(seed), []

    def prose(lo: int, hi: int) -> list[str]:
        return [r.choice(_STOP) if r.random() < 0.4 else "".join(r.choice(["ka", "lo", "mi", "ter", "on", "er"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]

    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split()} - {"@"})
    for family, ts in TEMPLATES.items():
        for i in range(PARAGRAPHS):
            words = _filled(ts[i % len(ts)], r)
            if len(words) > 6 and r.random() < 0.3:
                del words[r.randrange(len(words))]
            if r.random() < 0.25:
                words += _filled(r.choice(ts), r)
            rows.append((family, (prose(1, 12) if r.random() < 0.3 else []) + words + (prose(1, 12) if r.random() < 0.3 else [])))
    for i in range(PARAGRAPHS * len(TEMPLATES) // 2):
        miss = prose(1, 50)
        if i % 3 == 0:
            miss = r.choice(NEAR_MISSES).split() + prose(0, 10)
        elif i % 3 == 1:
            for _ in range(r.randint(1, 4)):
                miss[r.randrange(len(miss))] = r.choice(vocabulary)
        rows.append((UNKNOWN, miss))
    r.shuffle(rows)
    return rows


class LicenceModel:
    """The regression's weights by n-gram, its temperature, and the templates' word pairs."""

    def __init__(self) -> None:
        rows = training()
        cut = len(rows) * 4 // 5
        counts = Counter(g for f, ws in rows[:cut] if f != UNKNOWN for g in set(grams(ws)))
        self.index = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= MIN_COUNT))}
        self.vocabulary = frozenset(w for g in self.index for w in g.split())
        self.classes = [UNKNOWN, *TEMPLATES]
        x, y = self._matrix([ws for _, ws in rows]), np.array([self.classes.index(f) for f, _ in rows])
        self.w, self.b = self._fit(x[:cut], y[:cut])
        self.w = (self.w - self.w[:, :1]).astype(np.float32)
        held = x[cut:] @ self.w + self.b
        losses = {t: -np.mean(np.log(self._softmax(held / t)[np.arange(len(held)), y[cut:]] + 1e-12)) for t in (0.5, 0.7, 1.0, 1.4, 2.0)}
        self.temperature = min(losses, key=losses.get)
        self.pairs = {f: [self._pairs([w for w in t.split() if w != "@"]) for t in ts] for f, ts in TEMPLATES.items()}
        self.holders: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for f, ts in self.pairs.items():
            for i, t in enumerate(ts):
                for p in t:
                    self.holders.setdefault(p, []).append((f, i))
        self.known_pairs = frozenset(self.holders)
        self.own = {f: frozenset(p for p, held in self.holders.items() if {g for g, _ in held} == {f}) for f in self.pairs}

    def _matrix(self, texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.index)), np.float32)
        for i, ws in enumerate(texts):
            x[i, [self.index[g] for g in set(grams(ws)) if g in self.index]] = 1
        return x

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        one, mw, mb = np.eye(len(self.classes), dtype=np.float32)[y], 0, 0
        for _ in range(steps):
            d = (self._softmax(x @ w + b) - one) / len(x)
            mw, mb = 0.9 * mw + x.T @ d + 1e-4 * w, 0.9 * mb + d.sum(0)
            w, b = w - 1.5 * mw, b - 1.5 * mb
        return w, b

    @staticmethod
    def _pairs(words: list[str]) -> frozenset[tuple[str, str]]:
        return frozenset(zip(words, words[1:], strict=False))

    def confirmed(self, words: list[str]) -> dict[str, float]:
        """The families that a template confirms, with the best agreement of each."""
        seen = Counter(h for p in set(zip(words, words[1:], strict=False)) if p in self.holders for h in self.holders[p])
        found: dict[str, float] = {}
        for (f, i), n in seen.items():
            agrees = n / len(self.pairs[f][i])
            if agrees >= AGREEMENT and agrees > found.get(f, 0.0):
                found[f] = agrees
        if not found:
            return found
        pairs = self._pairs(words)
        return {f: a for f, a in found.items() if pairs & self.own[f]}

    def classify(self, words: list[str]) -> tuple[str, float, float] | None:
        """Family, calibrated probability and agreement of a paragraph, or None for "unknown" or what no template confirms."""
        agreed = self.confirmed(words)
        if not agreed:
            return None
        at = sorted({self.index[g] for g in grams(words) if g in self.index})
        p = self._softmax((self.w[at].sum(0) + self.b)[None] / self.temperature)[0]
        best = int(p.argmax())
        family = self.classes[best]
        if not best or p[best] < THRESHOLD or family not in agreed or max(agreed.values()) > agreed[family]:
            return None
        return family, float(p[best]), agreed[family]

    def _place(self, family: str, words: list[str]) -> tuple[int, int]:
        """Where most of the template's word pairs that confirm a finding stand together."""
        pairs = self._pairs(words)
        template = max(sorted(self.pairs[family], key=sorted), key=lambda t: (len(pairs & t) / len(t), len(t)))
        at = [i for i, p in enumerate(zip(words, words[1:], strict=False)) if p in template]
        width, best = 2 * len(template) + 2, (0, 0, 0)
        for k, i in enumerate(at):
            seen: set[tuple[str, str]] = set()
            for j in at[k : k + width]:
                if j < i + width and (words[j], words[j + 1]) not in seen:
                    seen.add((words[j], words[j + 1]))
                    best = max(best, (len(seen), i - j, i))
        return best[2], best[2] - best[1] + 2

    def _matched(self, family: str, words: list[str]) -> frozenset[tuple[str, str]]:
        """The word pairs that confirm a family."""
        pairs = self._pairs(words)
        return max((pairs & t for t in sorted(self.pairs[family], key=sorted)), key=len)

    def _settled(self, lines: list[tuple], of_run: list[tuple], words: list[str]) -> list[tuple]:
        """Findings of a run and of its lines (finding, words of the line) without those that others are found by the words of."""
        lost, kept = set(), []
        for got in of_run:
            mine, stays, beaten = self._matched(got[2], words), True, []
            for i, (line, theirs) in enumerate(lines):
                if line[0] < got[1] and line[1] > got[0]:
                    other = self._matched(line[2], theirs)
                    if 2 * len(mine & other) >= len(mine):
                        stays = False
                    elif got[2] == line[2] or got[4] > line[4] and 2 * len(mine & other) >= len(other):
                        beaten.append(i)
            if stays:
                kept.append(got)
                lost.update(beaten)
        return sorted(kept + [line for i, (line, _) in enumerate(lines) if i not in lost])

    def _parts(self, words: list[str], lo: int, hi: int) -> list[tuple[int, int, str, float, float]]:
        """Findings (first word, end, family, probability, agreement) of words[lo:hi]."""
        some = words[lo:hi]
        got = self.classify(some)
        if got:
            a, b = self._place(got[0], some)
            more, on = self._choices(words, lo + b)
            rest = [(lo, lo + a), (on, hi)]
            out: list[tuple[int, int, str, float, float]] = []
            for x in sorted([(lo + a, lo + b, *got), *more, *(x for i, j in rest if j - i > 1 for x in self._parts(words, i, j))]):
                if out and out[-1][2] == x[2]:  # of one statement, in the words of two templates
                    out[-1] = (out[-1][0], x[1], x[2], max(out[-1][3], x[3]), max(out[-1][4], x[4]))
                else:
                    out.append(x)
            return out
        if hi - lo > SHORTEST and len(self.confirmed(some)) > 0:
            third = (hi - lo) // 3
            return sorted({x[:3]: x for i, j in ((lo, hi - third), (lo + third, hi)) for x in self._parts(words, i, j)}.values())
        return []

    def _choices(self, words: list[str], at: int) -> tuple[list[tuple[int, int, str, float, float]], int]:
        """What "or" and "and" add to a finding that ends at this word, and where it ends then."""
        out: list[tuple[int, int, str, float, float]] = []
        at += 1 if words[at : at + 1] == ["only"] else 2 if words[at : at + 2] == ["or", "later"] else 0
        while at + 1 < len(words) and words[at] in ("or", "and"):
            for n in range(min(6, len(words) - at - 1), 0, -1):
                some = words[at + 1 : at + 1 + n]
                got = None if {"licensed", "released"} & set(some) else self.classify(["licensed", "under", *some])
                if got and set(self._pairs(["under", *some])) <= self._matched(got[0], ["licensed", "under", *some]):
                    out.append((at + 1, at + 1 + n, *got))
                    at += 1 + n
                    break
            else:
                break
        return out, at

    @staticmethod
    def _stands(words: list[str], at: list[tuple[int, int]], text: str, a: int, b: int) -> bool:
        """Whether words a to b begin or end a clause: something other than a space lies between them and the word beside them."""
        apart = lambda i, j: at[i] == at[j] or bool(text[at[i][1] : at[j][0]].strip(" "))
        return a == 0 or b == len(words) or words[a - 1] in ("or", "and") or apart(a - 1, a) or apart(b - 1, b)

    def _found(self, words: list[str], text: str, places) -> list[tuple[int, int, str, float, float]]:
        """Findings of a paragraph of the text; places() has the ends of each word."""
        if len(words) <= WINDOW:
            spans = [(0, len(words))]
        else:
            spans = [(lo, min(len(words), lo + WINDOW)) for lo in range(0, len(words) - WINDOW // 2, WINDOW // 2)]
        found: list[tuple[int, int, str, float, float]] = []
        for x in sorted(x for lo, hi in spans for x in self._parts(words, lo, hi)):
            if found and found[-1][2] == x[2] and x[0] < found[-1][1]:
                found[-1] = (found[-1][0], max(x[1], found[-1][1]), x[2], max(found[-1][3], x[3]), max(found[-1][4], x[4]))
            else:
                found.append(x)
        at = places() if found else []
        return [(at[a][0], at[b - 1][1], *rest) for a, b, *rest in found if b - a > BARE or self._stands(words, at, text, a, b)]

    def scan(self, text: str | None) -> list[tuple[int, int, str, float, float]]:
        """Findings (start, end, family, probability, agreement) of one text, in order."""
        found, at, run, single = [], 0, [], []

        def placed(start: int, line: str) -> list[tuple[int, int]]:
            low = line.lower()
            if len(low) == len(line):
                return [(start + m.start(), start + m.end()) for m in WORD.finditer(low)]
            return [(start, start + len(line))] * len(tokens(low))

        def close() -> None:
            """The end of a run of lines: a paragraph, if it is more than a line and has any word pair of a template."""
            of_run = []
            words = [w for _, _, ws in run for w in ws] if len(run) > 1 else []
            if not self.known_pairs.isdisjoint(zip(words, words[1:], strict=False)):
                of_run = self._found(words, text, lambda: [p for start, line, _ in run for p in placed(start, line)])
            found.extend(self._settled(single, of_run, words) if of_run else [x for x, _ in single])
            run.clear()
            single.clear()

        text = text or ""
        for line in text.split("\n"):
            start, at = at, at + len(line) + 1
            words = tokens(line.lower())
            if not words:
                close()
                continue
            run.append((start, line, words))
            if not self.vocabulary.isdisjoint(words):  # else no n-gram of the model can occur
                single.extend((x, words) for x in self._found(words, text, lambda: placed(start, line)))  # noqa: B023
        close()
        return found


_MODEL: list[LicenceModel] = []


def model() -> LicenceModel:
    if not _MODEL:
        _MODEL.append(LicenceModel())
    return _MODEL[0]


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_found, families (sorted, comma-joined), spans (family:start:end), and the lists
    probability and agreement of the spans."""
    known = docs.sparkSession.sparkContext.broadcast(model())  # weights of the templates' n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [known.value.scan(t) for t in b.column(1).to_pylist()]
            cols = [
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([",".join(sorted({x[2] for x in f})) for f in found], pa.string()),
                pa.array([",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in f) for f in found], pa.string()),
                pa.array([[x[3] for x in f] for f in found], pa.list_(pa.float64())),
                pa.array([[x[4] for x in f] for f in found], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_found", "families", "spans", "probability", "agreement"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_found long, families string, spans string, probability array<double>, agreement array<double>")
