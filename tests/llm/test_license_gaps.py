"""Notices and statements wrapped over lines and inside comments."""

import random
import re
import time

import pytest

from citeflow.llm import licenses

WRAPPED = [
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee"),
    ("zlib", "This software is provided 'as-is', without any express or implied\nwarranty."),
    ("mpl", "This file is licensed under the Mozilla Public\nLicense, v. 2.0"),
    ("gpl", "/*\n * you can redistribute it and/or modify\n * it under the terms of the GNU General\n * Public License as published by the Free Software\n * Foundation"),
    ("lgpl", "# licensed under the GNU Lesser\n# General Public License"),
    ("lgpl", "covered by the terms; licensed under the GNU Library General Public License"),
    ("gpl", "subject to the conditions\nof the GPL"),
    ("gpl", "a copy\r\n\tof the GNU General Public License"),
    ("mit", "// Permission is hereby granted,  free of charge, to any person obtaining a copy"),
    ("mit", "# Permission is hereby    #\n# granted, free of charge, #\n# to any person obtaining a copy"),
    ("cc-by-sa", "licensed under a Creative Commons\nAttribution-ShareAlike 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0"),
    ("public-domain", "-- placed into the public\n-- domain"),
    ("all-rights-reserved", "All rights\n    reserved."),
]


@pytest.mark.parametrize("label,text", WRAPPED)
def test_wrapped(label, text):
    scanner = licenses.Scanner()
    low = text.encode().lower()
    assert label in {r.label for r, _, _ in scanner.detect(low)}
    flat = re.sub(r"\s*[#*/-]*\s*\n[\s#*/-]*|\s+", " ", text).encode().lower()
    assert [r.name for r, _, _ in scanner.detect(flat)] == [r.name for r, _, _ in scanner.detect(low)]


def plain_suppress(found):
    """By comparing each detection (rank, order, start, end) with each other."""
    key = lambda i: (-found[i][0], found[i][2] - found[i][3], found[i][1], found[i][2], i)
    inside = lambda i, j: found[j][2] <= found[i][2] and found[i][3] <= found[j][3]
    return {i for i in range(len(found)) if not any(key(j) < key(i) and inside(i, j) for j in range(len(found)))}


@pytest.mark.parametrize("seed", range(30))
def test_suppression(seed):
    rng = random.Random(seed)
    found = [(rng.randrange(4), rng.randrange(5), a, a + rng.randrange(1, 12)) for a in (rng.randrange(30) for _ in range(40))]
    assert set(licenses.suppress(found)) == plain_suppress(found)


def test_gates_lose_nothing():
    """Keywords only save time: all expressions over all texts find the same."""
    scanner = licenses.Scanner()
    others = ["plain text of no licence", "copy of it", "", "mit unter https://opensource.org/licenses/MIT, some rights reserved", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"]
    for text in [t for _, t in WRAPPED] + others + [" ".join(t for _, t in WRAPPED)]:
        low = text.encode().lower()
        found = [(r.rank, r.order, m.start(), m.end()) for r in scanner.rules for m in re.finditer(r.pattern.encode(), low)]
        want = sorted((found[i][2], found[i][3], found[i][1]) for i in plain_suppress(found))
        assert sorted((a, b, r.order) for r, a, b in scanner.detect(low)) == want


def test_very_long_text():
    """300,000 places in one text, in seconds."""
    scanner, start = licenses.Scanner(), time.time()
    found = scanner.detect(b"licensed under the mit license. the apache license and gpl " * 100_000)
    assert len(found) >= 200_000 and time.time() - start < 60


def test_long_runs():
    scanner = licenses.Scanner()
    assert scanner.detect(b"licensed under the" + b" " * 200_000 + b"*" * 200_000 + b" mit") == []
