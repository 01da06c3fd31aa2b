import itertools
import time

import pytest

from quarry.llm import license

SCANNER = license.Scanner()
FULL = {k: v[-1] for k, v in license.TEMPLATES.items()}


def found(text):
    return {b["license"] for b in SCANNER.scan(text) if b["license"]}


def test_every_two_notices_in_one_block():
    for a, b in itertools.combinations(FULL, 2):
        for between in ("\n", " "):
            assert found(FULL[a] + between + FULL[b]) == {a, b}, (a, b)


def test_every_wording_alone():
    for name, texts in license.TEMPLATES.items():
        for text in texts:
            assert found("Some prose before it.\n" + text + "\nSome prose after it.") == {name}, text
            if len(text.split()) > 3:  # a line must hint at a license
                assert found(text.replace(" ", "\n")) == {name}, text
            words = text.split()
            if len(words) > 30:  # a few words may differ, many may not
                assert found(" ".join(["changed" if i == 12 else w for i, w in enumerate(words)])) == {name}
                assert name not in found(" ".join(["changed" if i % 3 == 0 else w for i, w in enumerate(words)]))


def test_two_short_notices():
    assert found("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.") == {"MIT", "Apache-2.0"}
    assert found("This is free and unencumbered software released into the public domain.") == {"Unlicense"}


def test_named_licenses():
    assert found("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+ WITH Classpath-exception-2.0") == {"MIT", "Apache-2.0", "GPL-2.0+"}
    assert found("SPDX-License-Identifier:") == set()


@pytest.mark.parametrize("filler", ["license " * 3000, "the software " * 4000, "\n".join(["permission is granted"] * 2000)])
def test_long_blocks(filler):
    began = time.time()
    assert {"MIT", "BSD-3-Clause"} <= found(filler + "\n" + FULL["MIT"] + "\n" + filler + "\n" + FULL["BSD-3-Clause"] + " " + filler)
    assert time.time() - began < 60


def test_every_wording_against_every_other_license():
    """No notice is taken for another license's, alone or with its version changed."""
    for name, texts in license.TEMPLATES.items():
        for text in texts:
            assert found(text) == {name}, text
    gpl = FULL["GPL-3.0"]
    for changed, wanted in ((gpl.replace("GNU General", "GNU Lesser General"), {"LGPL-3.0"}), (gpl.replace("GNU General", "GNU Affero General"), {"AGPL-3.0"}), (gpl.replace("version 3", "version 1"), set()), (gpl.replace("version 3", "version 4"), set())):
        assert found(changed) == wanted, changed
    for text in (
        "GNU Affero General Public License, version 2.", "This work is licensed under the GNU General Public License, version 1.", "This work is not licensed under the GNU General Public License, version 3.",
        "Not licensed under the Apache License, Version 2.0.", "This isn't released under the MIT License.", "It was never released under the BSD 3-Clause License.", "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "This work is licensed under a Creative Commons Attribution 3.0 International License.", "Licensed under the EUPL, Version 1.1.",
    ):
        assert found(text) == set(), text
    assert found(FULL["LGPL-2.1"].replace("2.1", "3").replace("software;", "software:").replace("Foundation;", "Foundation,")) == {"LGPL-3.0"}


def test_common_short_forms():
    for text, name in (("Licensed under the GNU Affero General Public License v3.0.", "AGPL-3.0"), ("Licensed under the Mozilla Public License 2.0", "MPL-2.0"), ("licensed under the MIT license", "MIT"), ("Licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1")):
        assert found(text) == {name}


def test_notices_are_found_once_with_their_line():
    rows = [*SCANNER.scan("\n".join(["All rights reserved."] * 1000))]
    assert [r["line"] for r in sorted(rows, key=lambda r: r["line"])] == list(range(1000)) and {r["license"] for r in rows} == {"Proprietary"}
    text = "the software " * 900 + "\n" + FULL["MIT"] + "\n" + "the software " * 900 + "\nReleased under CC0 1.0."
    assert sorted((r["license"], r["line"]) for r in SCANNER.scan(text)) == [("CC0-1.0", 3), ("MIT", 1)]


def test_a_megabyte_of_notices():
    text = "\n".join(FULL[n] for n in ("MIT", "ISC", "Zlib") for _ in range(700))
    began = time.time()
    rows = [*SCANNER.scan(text)]
    assert len(text) > 700_000 and {r["license"] for r in rows} == {"MIT", "ISC", "Zlib"} and abs(len(rows) - 2100) <= 3
    assert time.time() - began < 60


def test_edges(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "Released under the MIT License.", "x"), (3, "prose only", "x")]
    got = license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()
    assert sorted((r.doc_id or 0, r.licenses) for r in got) == [(0, ["MIT"]), (1, []), (1, []), (2, []), (3, [])]
    assert license.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
