"""op6: notices, cosines against a dense computation, inheritance against a direct walk."""

import math
import textwrap

import pytest

from aerolith.llm import licenses as lic

SCHEMA = "doc_id long, path string, text string, license int"


@pytest.mark.parametrize(
    "text,name",
    [
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("x\nThis work is licensed under the GNU General Public License, version 3.\ny", "GPL-3.0"),
        ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", "Apache-2.0"),
        ("filler " * 500 + "Released under the MIT License. " + "filler " * 500, "MIT"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("a driving license was lost", None),
        ("copyright and permission", None),
        ("", None),
        (None, None),
    ],
)
def test_notices(text, name):
    assert lic.detect(text)[0] == name


def test_cosine_matches_dense():
    counts = [lic._terms(t) for _, t in lic.TEMPLATES]
    words = sorted({x for c in counts for x in c}, key=str)
    idf = [(math.log((1 + len(counts)) / (1 + sum(x in c for c in counts))) + 1) * (2 if any(map(str.isdigit, "".join(x))) else 1) for x in words]
    note = lic._terms("This file is licensed under the Apache License, Version 2.0 and MIT")
    v = [note[x] * w for x, w in zip(words, idf)]
    for k, c in enumerate(counts):
        u = [c[x] * w for x, w in zip(words, idf)]
        want = sum(a * b for a, b in zip(u, v)) / math.sqrt(sum(a * a for a in u) * sum(b * b for b in v))
        got = [s for s, _ in lic.cosines("This file is licensed under the Apache License, Version 2.0 and MIT")]
        if sum(isinstance(x, str) and x in c for x in note) >= lic.SHARED:
            assert any(abs(want - s) < 1e-9 for s in got), k


def test_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.", 0),
        (2, "a/b/c/x.py", "code", 0),
        (3, "a/b/COPYING.txt", "Licensed under CC BY-NC 4.0.", 0),
        (4, "a/x.py", "Licensed under the Apache License, Version 2.0.", 0),
        (5, "z/x.py", None, 0),
        (6, "ab/x.py", "", 0),
        (7, None, "code", 0),
        (8, "LICENSE", "nothing to see", 0),
        (2, "a/b/c/x.py", "code", 0),
        (9, "a/y.py", "code", 0),
    ]
    got = sorted(tuple(r) for r in lic.scan(spark.createDataFrame(rows, SCHEMA), "doc_id", "path", "text").select("doc_id", "license", "origin", "directory").collect())
    assert [g for g in got if g[0] != 7] == [
        (1, "MIT", "notice", "a"),
        (2, "CC-BY-NC-4.0", "inherited", "a/b"),
        (2, "CC-BY-NC-4.0", "inherited", "a/b"),
        (3, "CC-BY-NC-4.0", "notice", "a/b"),
        (4, "Apache-2.0", "notice", "a"),
        (5, None, None, None),
        (6, None, None, None),
        (8, None, None, None),
        (9, "MIT", "inherited", "a"),
    ] and (7, None, None, None) in got
    assert lic.scan(spark.createDataFrame([], SCHEMA), "doc_id", "path", "text").collect() == []


def wrapped(text, mark=" * ", width=76):
    """A header as it stands in a source file, its paragraphs apart."""
    return "\n".join("\n".join(textwrap.wrap(p, width, initial_indent=mark, subsequent_indent=mark) + [mark.rstrip()]) for p in text.split("\n"))


@pytest.mark.parametrize("k", range(len(lic.TEMPLATES)))
@pytest.mark.parametrize("mark", [" * ", "# ", "// ", ""])
def test_wrapped_templates_keep_their_name(k, mark):
    name, text = lic.TEMPLATES[k]
    code = "\n\nint main(void) {\n    return run(argc, argv);\n}\n"
    for copy in (text, text + code, "Copyright (c) 2019 Some Body\n\n" + text + code, "#!/usr/bin/env tool\n" + text):
        assert lic.detect(wrapped(copy, mark))[0] == name


def test_head_of_a_long_licence_file():
    filler = "\n\n".join("The licensee may modify the work and distribute copies under the terms of this License." for _ in range(300))
    for name, text in lic.TEMPLATES:
        if len(text) > 400:
            assert lic.detect(wrapped(text, "") + "\n\n" + filler)[0] == name


def test_titles_tell_versions_apart():
    for title, name in [("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", "GPL-2.0"), ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999", "LGPL-2.1"), ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "LGPL-3.0"), ("MIT License", "MIT")]:
        assert lic.detect(title)[0] == name


def test_a_file_that_is_mostly_notice_speaks_for_its_directory(spark):
    rows = [(1, "a/b/1.txt", "Released under the MIT License.", 0), (2, "a/b/2.txt", "word " * 50 + "\nLicensed under CC BY-NC 4.0.", 0), (3, "a/b/c/3.txt", "other", 0)]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in lic.scan(spark.createDataFrame(rows, SCHEMA), "doc_id", "path", "text").collect()}
    assert got == {1: ("MIT", "notice"), 2: ("CC-BY-NC-4.0", "notice"), 3: ("MIT", "inherited")}


AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL = AGPL.replace("GNU Affero General", "GNU General")


def test_restricting_words_and_versions_decide():
    for mark in ("", "# ", "// ", " * "):
        marked = lambda t: "\n".join(mark + line for line in t.split("\n"))  # noqa: B023, E731
        assert lic.detect(marked(AGPL))[0] == "AGPL-3.0"
        for part in (GPL, GPL.split("\n\n")[0], "\n\n".join(GPL.split("\n\n")[:2])):
            assert lic.detect(marked(part))[0] == "GPL-3.0"
    assert lic.detect("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.")[0] in (None, "CC-BY-NC-SA-4.0")
    assert lic.detect("This work is licensed under the Creative Commons Attribution 3.0 Unported License.")[0] in (None, "CC-BY-3.0")
    assert lic.detect("The Apache Software License, Version 1.1")[0] in (None, "Apache-1.1")


def test_identifiers_are_taken_as_they_stand():
    for said, name in (("EPL-2.0", "EPL-2.0"), ("AGPL-3.0-only", "AGPL-3.0"), ("ISC", "ISC"), ("LGPL-2.1-or-later", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("BSL-1.0", "BSL-1.0"), ("GPL-2.0+", "GPL-2.0"), ("(MIT OR X11)", "MIT")):
        assert lic.detect(f"x = 1\n# SPDX-License-Identifier: {said}\ny")[:2] == (name, 1.0)
