"""Lists of names, SPDX expressions, word order and negation."""

import time

import pytest

from citeflow.llm.licenses import Scanner, rules


def labels(text):
    return sorted({r.label for r, _, _ in Scanner().detect(text.lower().encode())})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["apache", "mit"]),
        ("# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause", ["bsd-3-clause", "gpl"]),
        ("SPDX-License-Identifier: LicenseRef-own", []),
        ("dual licensed under MIT and Apache 2.0", ["apache", "mit"]),
        ("licensed under the MIT, BSD 2-Clause or\n# the Eclipse Public License", ["bsd-2-clause", "epl", "mit"]),
        ("license: mit/apache-2.0", ["apache", "mit"]),
        ("released under the MIT license and built in May", ["mit"]),
        ("it comes under the BSD 3-Clause License", ["bsd-3-clause"]),
        ("under the bsd sea", []),
        ("licensed under the BSD 3-Clause License", ["bsd-3-clause"]),
        ("distributed under the modified BSD license", ["bsd-3-clause"]),
        ("MIT-licensed code", ["mit"]),
        ("Lizenz: CC BY-SA 4.0", ["cc-by-sa"]),
        ("it is not licensed under the Eclipse Public License", []),
        ("Rather than being licensed under the GPL 3 it is free", []),
        ("nothing; licensed under the Eclipse Public License", ["epl"]),
        ("Version 3, 29 June 2007 of the GNU General Public License version 3, 29 June 2007", ["gpl-3.0"]),
        ("This product includes cryptographic software written by Eric Young", ["ssleay"]),
    ],
)
def test_detections(text, want):
    assert labels(text) == want


def test_signatures_written_by_hand():
    single = [r for r in rules() if ":notice" in r.name]
    assert len(single) >= 300 and len({(r.label, r.pattern) for r in single}) == len(single)


@pytest.mark.parametrize("part", ["licensed under mit, ", "spdx-license-identifier: mit or ", "not ", "licensed under the mit and mit and ", "mit and "])
def test_linear(part):
    scanner = Scanner()
    times = []
    for n in (5_000, 20_000):
        start = time.time()
        scanner.detect((part * n).encode())
        times.append(time.time() - start)
    assert times[1] < 8 * times[0] + 1
