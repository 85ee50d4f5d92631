"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then
inheritance from the nearest ancestor directory.

Each text is compared in units from large to small: the whole text, its leading comment block,
its paragraphs, runs of adjacent lines that are mostly licence words, single lines, and the
sentences of lines with a notice. The lines of a unit are joined, so that wrapping means
nothing, and every line takes part. A text that as a whole, or for the most part, is a licence
is a licence file, and so is one that begins with a licence's title, but no text that goes on
after a leading comment block; a licence file licenses its directory and all below that have
none nearer."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerroutes.llm._shared import Tables

#: Names of licences as notices write them, by SPDX name.
NAMES = {
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL v3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"],
    "Unlicense": ["Unlicense"],
}
#: What notices say around a name.
PHRASES = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This library is licensed under the {}.", "This project is licensed under the terms of the {}.", "License: {}"]
#: Titles that licence files begin with.
TITLES = {
    "MIT": ["MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "EPL-2.0": ["Eclipse Public License - v 2.0"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
}
_BSD_TOP = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GPL_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
#: Full notices and licence texts.
TEXTS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [_BSD_TOP + " " + _BSD_TWO + " " + _BSD_END],
    "BSD-3-Clause": [
        _BSD_TOP,
        _BSD_TOP + " " + _BSD_TWO + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    ],
    "GPL-2.0": [_GPL.format("General Public License", 2), (_GPL + _GPL_REST).format("General Public License", 2)],
    "GPL-3.0": [_GPL.format("General Public License", 3), (_GPL + _GPL_REST).format("General Public License", 3)],
    "LGPL-2.1": [_GPL.format("Lesser General Public License", 2.1), (_GPL + _GPL_REST).format("Lesser General Public License", 2.1)],
    "LGPL-3.0": [_GPL.format("Lesser General Public License", 3), (_GPL + _GPL_REST).format("Lesser General Public License", 3)],
    "AGPL-3.0": [_GPL.format("Affero General Public License", 3), (_GPL + _GPL_REST).format("Affero General Public License", 3)],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
_WORD = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*")
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|;|--|<!--|%|\"\"\"|'''|rem\b|dnl\b)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: What a notice of any licence says, known or not.
_CLAIM = re.compile(r"licen[cs]ed (?:under|to you)|released under|distributed under|under the terms of|spdx.license.identifier|permission (?:is|to use)\b.{0,40}\b(?:granted|copy)|redistribution and use|all rights reserved")
_SPDX = re.compile(r"spdx-license-identifier:[ \t]*([^\n\r]*)", re.I)
_TERM = re.compile(r"\(|\)|[\w.+-]+")
_VERSION = re.compile(r"v?(\d{1,2}(?:\.\d+)*)")
_NOTICE = re.compile(r"licen[cs]ed under|released under|distributed under the|spdx.license.identifier|permission is hereby granted|redistribution and use")


def templates() -> list[tuple[str, bool, str]]:
    """Rows (name, is it a title, text): names in phrases and as SPDX tags, titles and texts."""
    out = [(k, False, p.format(n)) for k, names in NAMES.items() for n in names for p in PHRASES]
    out += [(k, False, f"SPDX-License-Identifier: {tag}") for k in NAMES for tag in (k, k + "-only", k + "-or-later")[: 3 if "GPL" in k else 1]]
    out += [(k, True, x) for k, xs in TITLES.items() for x in xs]
    return out + [(k, False, x) for k, xs in TEXTS.items() for x in xs]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def versions(unit: list[str]) -> frozenset[str]:
    """Version numbers among words; 2 and 2.0 are one, and years are none."""
    found = (_VERSION.fullmatch(w) for w in unit)
    return frozenset(re.sub(r"(?:\.0)+$", "", m.group(1)) for m in found if m)


def expression(text: str) -> tuple[str | None, bool]:
    """(SPDX expression with several licences, is there one with an unknown name) of the first
    tag line that has operators. Names lose -only, -or-later and +; WITH exceptions are left out."""
    known = {k.lower(): k for k in NAMES}
    for m in _SPDX.finditer(text):
        terms, out, names, skip, unknown = _TERM.findall(m.group(1)), [], [], False, False
        for x in terms:
            if skip or x.upper() == "WITH":
                skip = not skip
            elif x in "()" or x.upper() in ("AND", "OR"):
                out.append(x.upper())
            else:
                name = known.get(re.sub(r"(-only|-or-later|\+)$", "", x.lower()))
                unknown |= name is None
                names.append(name)
                out.append(name or x)
        if len(names) > 1:
            return (None, True) if unknown else (" ".join(out).replace("( ", "(").replace(" )", ")"), False)
    return None, False


class Scanner:
    """Compares one text after the other with templates; weights are set by the corpus."""

    def __init__(self, given: list[tuple[str, bool, str]], idf: dict[str, float], other: float, threshold: float, share: float):
        self.idf, self.other, self.threshold, self.share = idf, other, threshold, share
        self.known, self.versions, self.posts = [], [], defaultdict(list)
        for name, title, text in given:
            tf = Counter(words(text))
            norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items()))
            for w, c in tf.items():
                self.posts[w].append((len(self.known), c * idf[w] / norm))
            self.known.append((name, title))
            self.versions.append(versions(words(text)))
        self.odds = threshold**2 / (1 - threshold**2) if threshold < 1 else math.inf

    def best(self, unit: list[str]) -> tuple[float, str, bool] | None:
        """(similarity, name, is it a title) of the nearest template from the threshold on whose
        version numbers, if both have some, are among the unit's; of equal similarities the first
        name, then a title."""
        inside = [w for w in unit if w in self.idf]
        out = len(unit) - len(inside)
        if not inside or len(inside) ** 2 < self.odds * out:  # no weights could make up for the other words
            return None
        tf = Counter(inside)
        mass = sum((c * self.idf[w]) ** 2 for w, c in tf.items())
        rest = self.other**2 * sum(c * c for c in Counter(w for w in unit if w not in self.idf).values()) if out else 0.0
        if mass < self.odds * rest * (1 - 1e-9):
            return None
        dots = defaultdict(float)
        for w, c in tf.items():
            for k, v in self.posts[w]:
                dots[k] += c * self.idf[w] * v
        norm, said = math.sqrt(mass + rest), versions(unit)
        found = min(((-round(d / norm, 9), self.known[k][0], not self.known[k][1]) for k, d in dots.items() if not said or self.versions[k] <= said), default=(0.0, "", False))
        return (-found[0], found[1], not found[2]) if -found[0] >= self.threshold else None

    def units(self, text: str) -> Iterator[tuple[int, int, int, list[str]]]:
        """Rows (level, first line, line after the last, words), large units first."""
        raw = text.lower().split("\n")
        lines = [_WORD.findall(x) for x in raw]
        joined = lambda a, b: [w for x in lines[a:b] for w in x]
        yield 0, 0, len(lines), joined(0, len(lines))
        full = [k for k, x in enumerate(lines) if x]
        if full and _COMMENT.match(raw[full[0]]):
            end = full[0]
            while end < len(raw) and _COMMENT.match(raw[end]):
                end += 1
            yield 1, full[0], end, joined(full[0], end)
        mostly = [2 * sum(w in self.idf for w in x) >= len(x) for x in lines]
        a = 0
        for b in [*(k for k, x in enumerate(lines) if not x), len(lines)]:
            if b > a:
                yield 2, a, b, joined(a, b)
                start = a
                for k in range(a, b + 1):
                    if k == b or not mostly[k]:
                        if 1 < k - start < b - a:
                            yield 3, start, k, joined(start, k)
                        start = k + 1
                for k in range(a, b):
                    if b - a > 1:
                        yield 4, k, k + 1, lines[k]
                    if _NOTICE.search(raw[k]):
                        for x in _SENTENCE.split(raw[k]):
                            yield 5, k, k + 1, _WORD.findall(x)
            a = b + 1

    def text(self, text: str) -> tuple[str | None, float, bool, bool]:
        """(licence, similarity, is it a licence file, does it have an unknown notice)."""
        several, odd = expression(text)
        if several or odd:
            return several, 1.0 if several else 0.0, False, odd
        chosen, taken, matched, total, title, code = None, set(), 0, 0, False, False
        first = None
        for level, a, b, unit in self.units(text):
            total = total or len(unit)
            if level == 1:
                code = len(unit) < total
            if level == 2 and first is None:
                first = a
            if not unit or not (hit := self.best(unit)):
                continue
            if level == 2 and a == first:
                title = hit[2]
            chosen = min(chosen or (9,), (level, -hit[0], a, hit[1]))
            if level < 5 and a not in taken:
                matched += len(unit)
                taken.update(range(a, b))
        if not chosen:
            return None, 0.0, False, bool(_CLAIM.search(text.lower()))
        return chosen[3], -chosen[1], not code and (chosen[0] == 0 or title or matched >= self.share * total), False


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, file_share: float = 0.5, given: list[tuple[str, bool, str]] | None = None) -> DataFrame:
    """Per row of ``docs``: id_col, path, license, origin (header, file, inherited, unknown or
    none), similarity of its own best unit (0 without one) and license_dir (of the directory
    that an inherited licence comes from).

    Weights are term frequency times ln((1 + N) / (1 + df)) + 1 with df over all rows; words of
    no template have df 0. A unit matches its best template from ``threshold`` on, if the version
    numbers of the template are among those that the unit names; of equal similarities the first
    name wins. An SPDX tag with several licences gives the expression, with similarity 1, and
    origin unknown if it has a name that is not known. The largest kind of unit that matches counts, then the
    most similar, then the earliest. A file licenses its directory: a text that matches as a
    whole, begins with a title paragraph, or has ``file_share`` of its words in matched units,
    and has nothing after a leading comment block; of several files, the most similar, then the first by name, then by path. A text with a
    notice of no known licence, rights reserved included, has origin unknown and inherits nothing. Null and empty texts
    have no lines, null paths no directory. Repeated rows are scanned alike; other columns are
    ignored. An empty table gives an empty result.

    Two passes over the texts without a shuffle: document frequencies of the few hundred
    template words, then the units; the templates are a fixed list. Directories join by path, and rows
    meet their directory's answer in a join that may be split, so that a directory of any size
    does not bind one task."""
    t = Tables(docs.sparkSession, "licenses")
    given = given or templates()
    vocab = frozenset(w for _, _, x in given for w in words(x))
    rows = docs.select(F.col(id_col).alias("doc"), path.cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def frequencies(batches):
        df: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                df.update(vocab.intersection(_WORD.findall(x.as_py().lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["term", "df"])

    n = rows.count()
    df = rows.select("text").mapInArrow(frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    counts = {r.term: r.df for r in df.collect()}  # a row per template word
    idf = {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 1 for w in vocab}
    other = math.log(1.0 + n) + 1

    def found(batches):
        scanner = Scanner(given, idf, other, threshold, file_share)
        for b in batches:
            got = [scanner.text(x.as_py()) for x in b.column(2)]
            kinds = (pa.string(), pa.float64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds))], ["doc", "path", "license", "similarity", "is_file", "unknown"])

    fields = [T.StructField("doc", docs.schema[id_col].dataType), T.StructField("path", T.StringType())]
    fields += [T.StructField(c, k) for c, k in (("license", T.StringType()), ("similarity", T.DoubleType()), ("is_file", T.BooleanType()), ("unknown", T.BooleanType()))]
    marked = t.store(rows.mapInArrow(found, T.StructType(fields)).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "marked")

    files = marked.where("is_file and dir is not null")
    of = files.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license", "path")).alias("g")).select(F.col("dir").alias("from_dir"), F.col("g.license").alias("given"))
    dirs = marked.where("dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("from_dir")).distinct()
    nearest = ups.join(of, "from_dir").groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("n"), "from_dir", "given")).alias("g"))
    nearest = t.store(nearest.select("dir", F.col("g.from_dir").alias("license_dir"), F.col("g.given").alias("given")), "nearest")
    out = marked.join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    heir = ~has & ~F.col("unknown") & F.col("given").isNotNull()
    origin = F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("unknown"), "unknown").when(heir, "inherited").otherwise("none")
    return out.select(F.col("doc").alias(id_col), "path", F.when(heir, F.col("given")).otherwise(F.col("license")).alias("license"), origin.alias("origin"), "similarity", F.when(heir, F.col("license_dir")).alias("license_dir"))
