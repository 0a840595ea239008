"""Licence scans by held-out accuracy and on the tables' statements."""

import random

from brookline.llm import license_scan as ls

IN_TABLES = {"gpl": "GNU General", "proprietary": "All rights reserved", "cc-by-nc": "CC BY-NC", "mit": "MIT License", "apache": "Apache License"}


def test_held_out_paragraphs():
    rows = ls.training(seed=99)[:1200]
    right = sum((ls.model().classify(words) or (ls.UNKNOWN,))[0] == family for family, words in rows)
    false = sum(ls.model().classify(words) is not None for family, words in rows if family == ls.UNKNOWN)
    assert right > 0.93 * len(rows) and false <= 3


def test_near_misses_are_unknown():
    assert not [x for x in ls.NEAR_MISSES if ls.model().classify(ls.tokens(x))]


def test_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in ls.scan_licences(docs).collect()}
    for r in docs.collect():
        want = sorted({f for f, k in IN_TABLES.items() if k in r.text})
        assert got[r.doc_id].families == ",".join(want), r.doc_id


def test_places_windows_and_odd_rows(spark):
    r = random.Random(2)
    long = " ".join(r.choice(["river", "stone", "green"]) for _ in range(5000)) + " Released under the MIT License. " + "stone " * 300
    rows = [(1, "Intro.\nReleased under the MIT License.\nEnd", "x"), (2, None, "x"), (None, "All rights reserved.", "x"), (3, "", "x"), (4, long, "x"), (4, long, "x")]
    got = ls.scan_licences(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].spans == "mit:7:37" and by[2].n_found == by[3].n_found == 0 and by[None].families == "proprietary" and by[4].families == "mit"
    _, a, b = by[4].spans.split(":")
    assert "MIT License" in long[int(a) : int(b)]
    assert ls.scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
}


def test_wrapped_statements_are_found():
    import textwrap

    for family, statement in WRAPPED.items():
        for width in (40, 72, 80):
            for mark in ("", "# ", " * "):
                lines = [mark + x for x in textwrap.wrap(statement, width)]
                head = "Über the sea 😀 and the hills.\n" + mark.strip() + "\n"
                text = head + "\n".join(lines) + "\n" + mark.strip() + "\nimport this\n"
                got = ls.model().scan(text)
                assert [x[2] for x in got] == [family], (family, width, mark, got)
                a, b = got[0][:2]
                assert len(head) <= a < b <= len(head) + len("\n".join(lines)), (family, width, mark)
    assert ls.model().scan("A free tale\nof the general public\nand its source.") == []


def test_identifiers_and_more_families():
    want = {
        "SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: Apache-2.0": "apache", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl",
        "Distributed under the Boost Software License, Version 1.0.": "boost", "Licensed under the EUPL": "eupl", "Licensed under CC BY-ND 4.0": "cc-by-nd",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "mit",
    }
    assert {t: [x[2] for x in ls.model().scan(t)] for t in want} == {t: [f] for t, f in want.items()}
    assert ls.model().scan("SPDX-License-Identifier: Zz-9") == [] and ls.model().scan("The SPDX license identifier of a file names its license.") == []


def test_each_of_several_licences_in_a_line_is_found():
    """However long the line is: the same statements with nothing, little or much around them."""
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    for n in (0, 3, 10, 30, 60, 200):
        prose = "stone river green " * (n // 3)
        for text in (f"{mit} {apache} {prose}", f"{prose}{apache} {mit}", f"{mit} {prose}{apache}"):
            got = ls.model().scan(text)
            assert sorted(x[2] for x in got) == ["apache", "mit"], (n, text[:80], got)
            for a, b, family, *_ in got:
                assert {"mit": "MIT License", "apache": "Apache License"}[family] in text[a:b] and {"mit": "Apache", "apache": "MIT"}[family] not in text[a:b]


SHORT = {
    "This work is licensed under the Creative Commons Attribution 4.0 International License": "cc-by", "MIT License": "mit", "The MIT License (MIT)": "mit", "Apache License 2.0": "apache", "License: BSD-3-Clause": "bsd", "Licensed under MIT or Apache-2.0": "apache mit",
    "Licensed under the Artistic License 2.0": "artistic", "SPDX-License-Identifier: MIT OR Apache-2.0": "apache mit", "He reserved all rights reserved seats": "", "License: MIT": "mit", "GNU General Public License v3.0": "gpl", "Mozilla Public License 2.0": "mpl",
    "ISC License": "isc", "licensed under GPL-2.0-only OR MIT": "gpl mit", "the students at MIT license their work": "", "BSD 2-Clause License": "bsd", "All rights reserved.": "proprietary",
}


def test_short_forms_and_choices():
    assert {t: " ".join(sorted(x[2] for x in ls.model().scan(t))) for t in SHORT} == SHORT


def test_places_are_those_of_the_words_on_either_side_of_a_window():
    """However long the line: the same words are the place."""
    for n in (0, 20, 52, 53, 54, 55, 58, 60, 62, 70, 200):
        for before, after in ((n, 0), (0, n), (n // 2, n - n // 2)):
            text = "stone " * before + "Released under the MIT License." + " stone" * after
            assert [(x[2], text[x[0] : x[1]]) for x in ls.model().scan(text)] == [("mit", "Released under the MIT License")], (before, after)
