"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Templates are headers, notices and the heads or whole texts of licence files. A text's
notices start at lines with a cue word (licence, copyright, SPDX ...), stripped of comment
marks. Each is read as the line alone, as its paragraph, and as the block around it: the
neighbouring lines whose words are mostly those of licences, blank ones between them too, in
windows of PIECES words where it is longer. Lines that go on and on give a window around the
cue. All become sparse TF-IDF vectors of words and word pairs, with document frequencies from
the templates, terms with digits (versions) counting double; the best cosine over all readings
in the whole text names the licence (ties to the longer, then the earlier reading, then the
smaller name).

Files that declare a licence for their directory (named like LICENSE or COPYING, or at least
half of them notice, or as the caller says) vote for it; a file without a notice inherits from
the nearest ancestor directory that has one. Texts are read once and the findings stored.
Directories and their ancestors are joined as distinct rows, so a directory that holds a third
of all files costs one row in these joins; findings without text are all that meets them.

Nulls and empty texts have no notice; null paths inherit nothing. Rows may repeat.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm.common import stored, text_batches

#: Cosine from which a notice names a licence, and words of a template it must share.
THRESHOLD = 0.55
SHARED = 3
#: Words around a cue in lines longer than 40 times this in characters.
AROUND = 18
#: Words of a block that are read at a time; windows overlap by half.
PIECES = (64, 128, 256)
#: Share of a line's words that are words of licences, from which it belongs to a block.
LIKE = 0.6

# Short notices, headers, and the heads or whole texts of common licences.
TEMPLATES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
        TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
        1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.
        "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.
        "Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("MIT", "License: MIT"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("GPL-3.0", """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
        Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
        Preamble
        The GNU General Public License is a free, copyleft license for software and other kinds of works.
        The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."""),
    ("GPL-3.0", "GNU General Public License Version 3"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("GPL-2.0", """GNU GENERAL PUBLIC LICENSE Version 2, June 1991
        Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
        Preamble
        The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."""),
    ("GPL-2.0", "GNU General Public License Version 2"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("LGPL-2.1", """GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999
        Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
        [This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.]"""),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("LGPL-3.0", """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007
        Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
        This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."""),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("AGPL-3.0", """GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007
        Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
        Preamble
        The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."""),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright; CC0 1.0 public domain dedication"),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
CUES = ("license", "licence", "spdx", "copyright", "permission", "redistribution", "public domain", "unencumbered", "cc by", "cc0", "free software")
_CUE = re.compile("|".join(CUES), re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Marks of comments at either end of a line.
_MARKS = re.compile(r"^[\s/*#;%!<>|\-]*|[\s/*#;%!<>|\-]*$")
_DECLARES = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\..*)?$"


def _terms(text: str) -> Counter:
    words = _WORD.findall(text.lower())
    return Counter(words) + Counter(zip(words, words[1:]))


@lru_cache(maxsize=1)
def _vectors():
    """(idf of each term, {term: [(template, weight)]} of unit vectors, words each template must share, words of licences)."""
    counts = [_terms(t) for _, t in TEMPLATES]
    df = Counter(x for c in counts for x in c)
    idf = {x: (math.log((1 + len(counts)) / (1 + n)) + 1) * (2 if any(ch.isdigit() for ch in "".join(x)) else 1) for x, n in df.items()}
    postings = defaultdict(list)
    for k, c in enumerate(counts):
        norm = math.sqrt(sum((n * idf[x]) ** 2 for x, n in c.items()))
        for x, n in c.items():
            postings[x].append((k, n * idf[x] / norm))
    needed = [min(SHARED, sum(isinstance(x, str) for x in c)) for c in counts]
    return idf, postings, needed, frozenset(x for x in df if isinstance(x, str))


def cosines(notice: str) -> list[tuple[float, str]]:
    """(cosine, licence) of a notice to each template it shares enough words with; terms in no template don't count."""
    idf, postings, needed, _ = _vectors()
    weights = {x: n * idf[x] for x, n in _terms(notice).items() if x in idf}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    dot, shared = defaultdict(float), Counter()
    for x, w in weights.items():
        for k, v in postings[x]:
            dot[k] += w * v
            shared[k] += isinstance(x, str)
    return [(min(1.0, d / norm), TEMPLATES[k][0]) for k, d in dot.items() if shared[k] >= needed[k]]


def _like(line: str) -> bool | None:
    """Whether most words of a line are words of licences; None for a line without words."""
    words = _WORD.findall(line.lower())
    return sum(w in _vectors()[3] for w in words) >= LIKE * len(words) if words else None


def _lines(text: str, a: int, step: int):
    """(start, end, whether like licences) of the lines before (step -1) or from (1) position a on."""
    while 0 <= a <= len(text):
        if step < 0:
            if a == 0:
                return
            begin, end = text.rfind("\n", 0, a - 1) + 1, a - 1
            a = begin
        else:
            begin, end = a, text.find("\n", a)
            end = len(text) if end < 0 else end
            a = end + 1
        yield begin, end, _like(text[begin:end]) if end - begin <= 40 * AROUND else False


def _grown(text: str, a: int, b: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """(paragraph, block) around the line from a to b."""
    edges = []
    for start, step in ((a, -1), (b + 1, 1)):
        paragraph = block = a if step < 0 else b
        open_, blank = True, 0
        for x, y, like in _lines(text, start, step):
            if like is None:
                open_, blank = False, blank + 1
                if blank > 2:
                    break
            elif like:
                block, blank = (x if step < 0 else y), 0
                paragraph = block if open_ else paragraph
            else:
                break
        edges.append((paragraph, block))
    (pa, ba), (pb, bb) = edges
    return (pa, pb), (ba, bb)


def notices(text: str):
    """(start, end) of each reading of each notice in a whole text, in characters."""
    lower = text.lower()
    if not any(c in lower for c in CUES):
        return
    line_end = block_end = -1
    for cue in _CUE.finditer(text):
        if cue.start() < line_end:
            continue
        a = text.rfind("\n", 0, cue.start()) + 1
        b = text.find("\n", cue.end())
        b = len(text) if b < 0 else b
        if b - a > 40 * AROUND:
            left = [m.start() for m in _WORD.finditer(text, max(a, cue.start() - 20 * AROUND), cue.start())]
            right = [m.end() for m in _WORD.finditer(text, cue.end(), min(b, cue.end() + 20 * AROUND))]
            yield left[-AROUND] if len(left) >= AROUND else left[0] if left else cue.start(), right[AROUND - 1] if len(right) >= AROUND else right[-1] if right else cue.end()
            continue
        line_end = b
        yield a, b
        if a < block_end:
            continue
        paragraph, block = _grown(text, a, b)
        block_end = block[1]
        if paragraph != (a, b):
            yield paragraph
        if block != paragraph:
            words = [m.span() for m in _WORD.finditer(text, *block)]
            for size in PIECES:
                for k in range(0, max(1, len(words) - size // 2), size // 2):
                    yield words[k][0], words[min(k + size, len(words)) - 1][1]


# Words that restrict a licence, without blanks and hyphens, and the part of a name that says the same.
RESTRICTS = (("affero", "AGPL"), ("lessergeneral", "LGPL"), ("librarygeneral", "LGPL"), ("noncommercial", "-NC"), ("sharealike", "-SA"), ("noderiv", "-ND"))
_IDENTIFIER = re.compile(r"SPDX-License-Identifier:\s*\(?([A-Za-z0-9][A-Za-z0-9.+-]*)", re.I)
_VERSION = re.compile(r"(?:versions?|licen[cs]es?,?(?: version| v)?|\bv\.?|\bby(?:-[a-z]{2})*|international|unported|alike|commercial|attribution|deriv\w*)[\s,:(]{0,3}(\d+(?:\.\d+)?)\b", re.I)
_SHORT = re.compile(r"\bcc[ -]by((?:-(?:nc|sa|nd))*)", re.I)


def identifier(text: str) -> str | None:
    """The licence that an SPDX line names, without only, or-later and +, which tell of versions to come."""
    found = _IDENTIFIER.search(text)
    return re.sub(r"(-only|-or-later|\+|\.)$", "", found[1]) if found else None


def agrees(name: str, text: str) -> bool:
    """Whether a notice says nothing against a licence's name: other restrictions, or only other versions."""
    squeezed = re.sub(r"[\s_-]+", "", text.lower())
    said = {part for word, part in RESTRICTS if word in squeezed} | {f"-{x.upper()}" for m in _SHORT.finditer(text) for x in m[1].split("-") if x}
    if any((part in said) != (part in name) for _, part in RESTRICTS):
        return False
    own = re.search(r"-(\d+(?:\.\d+)?)$", name)
    versions = {float(v) for v in _VERSION.findall(text)}
    return own is None or name.startswith(("BSD", "0BSD")) or not versions or float(own[1]) in versions


def detect(text: str | None) -> tuple[str | None, float, int, int]:
    """(licence or None, cosine, start, end) of a text's best notice.

    A line with an SPDX identifier is that licence (cosine 1), known to the templates or not. Of
    other notices the nearest template counts that the notice doesn't speak against.
    """
    text, best = text or "", (None, 0.0, 0, 0)
    for a, b in notices(text):
        plain = "\n".join(_MARKS.sub("", line) for line in text[a:b].split("\n"))
        named = identifier(plain)
        told = [(1.0, named)] if named else sorted(cosines(plain), key=lambda x: (-x[0], x[1]))
        for score, name in told:
            if score < THRESHOLD:
                break
            if named or agrees(name, plain):
                if score > best[1] + 1e-12 or (score > best[1] - 1e-12 and b - a > best[3] - best[2]):
                    best = (name, score, a, b)
                break
    return best


_FOUND = T.StructType([T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


@F.pandas_udf(_FOUND)
def detected(texts: pd.Series) -> pd.DataFrame:
    """Column function: text -> struct(license, score, start, end)."""
    return pd.DataFrame([detect(t) for t in texts], columns=["license", "score", "start", "end"])


def _directory(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def scan(files: DataFrame, id_col: str, path_col: str, text_col: str, declares=None) -> DataFrame:
    """(id, path, license, score, origin, directory) for each row of files.

    origin is notice, inherited (then directory is the ancestor's) or null. declares is a boolean
    column over path, license and share (of the text that is notice): which files speak for their
    directory; by default those named so, and those that are at least half notice.
    """
    size = F.greatest(F.lit(1), F.length(F.coalesce(F.col(text_col), F.lit(""))))
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), size.alias("size"), detected(text_col).alias("d"))
    rows = rows.select("id", "path", F.col("d.license").alias("license"), F.col("d.score").alias("score"), ((F.col("d.end") - F.col("d.start")) / F.col("size")).alias("share"), _directory(F.col("path")).alias("directory"))
    rows = stored(rows, "notices")
    named = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(_DECLARES), F.lit(False))
    if declares is None:
        declares = named | (F.col("share") >= 0.5)
    votes = rows.where(declares & F.col("license").isNotNull() & F.col("directory").isNotNull()).groupBy("directory", "license").agg(F.sum(named.cast("long")).alias("named"), F.count(F.lit(1)).alias("files"))
    # most files of such a name, then most files, then the smaller name
    spoken = votes.groupBy(F.col("directory").alias("ancestor")).agg(F.min(F.struct(-F.col("named"), -F.col("files"), "license")).alias("most")).select("ancestor", F.col("most.license").alias("inherited"))
    directories = rows.where("directory is not null and license is null").select("directory").distinct()
    parts = F.split("directory", "/")
    ancestors = directories.select("directory", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("ancestor")).distinct()
    nearest = ancestors.join(spoken, "ancestor").groupBy("directory").agg(F.max_by(F.struct("ancestor", "inherited"), F.length("ancestor")).alias("from"))
    out = rows.join(nearest, "directory", "left")
    got = F.col("license").isNotNull()
    heir = ~got & F.col("from").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("license", "from.inherited").alias("license"),
        F.when(got, F.col("score")).alias("score"),
        F.when(got, "notice").when(heir, "inherited").alias("origin"),
        F.when(got, F.col("directory")).when(heir, F.col("from.ancestor")).alias("directory"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """documents as files source/lang/<hundred>/<id>.txt (the table has no paths); a file that is at least half notice speaks for its directory."""
    text_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("_")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("_")), F.lit(".txt"))).alias("path"))
    return scan(files, "doc_id", "path", "text")
