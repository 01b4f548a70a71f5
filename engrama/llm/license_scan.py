"""License scans: which licence families the paragraphs of documents state.

Native: DataFrame functions only on the path over documents. A paragraph is a line, or
neighbouring lines over which a notice is wrapped (see `wrapped`); a line without a word
ends a paragraph. A multinomial logistic regression over sparse word 1- and 2-grams, one
class for each family and one for unknown text, is fitted on the driver from two bounded
sources: TEMPLATES with words dropped, added and cut (by a seeded generator), and as
unknown text SAMPLE_LINES lines of the corpus, templates without the words that name a
licence, and licence words out of order. A temperature fitted on held-out examples calibrates its
probabilities. A prediction counts only if it is MIN_PROBABILITY likely and is confirmed, by a
template of its family (CONFIRM of the template's n-grams stand in the paragraph) or by the
grammar of statements: a line says under, of, as or by which licence, names the family in
one of NAMED's forms, with or without a version, and nothing before it denies it. Each name
of a line is classified by itself, in its statement, so "MIT or Apache-2.0" states two.

Because of that confirmation a paragraph needs one of the rarest n-grams of a template
(the prefix filter for containment), so paragraphs without any of those few words are
unknown at once, exactly; the words that it has call for their templates only, and only
paragraphs that hold most of one are scored. The tables that are broadcast (weights,
template n-grams) come from TEMPLATES and do not grow with the data.

Defined cases: null, empty and wordless texts have no licence; equal rows get equal
results; several licences in a document are all listed; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_ALNUM, ROW_KEY, ascii_lower, keyed, materialize, split_words

# Notices of public licences, and the paragraphs and clauses of their texts.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "Licensed under Apache 2.0", "Released under the Apache License 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT license", "Licensed under MIT", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License version 2 or later", "Licensed under the GPL version 3", "Released under the GNU GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program. If not, see www.gnu.org/licenses",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License", "Licensed under the LGPL version 3",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3", "Licensed under the AGPL version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License", "Licensed under the BSD license", "Licensed under the BSD 2-Clause License",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License", "Licensed under the ISC license",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "bsl-1.0": [
        "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "zlib": [
        "Released under the zlib License", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "epl": ["Licensed under the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "eupl": ["Licensed under the EUPL, Version 1.2", "Licensed under the European Union Public Licence"],
    "wtfpl": ["Licensed under the WTFPL", "Do What The Fuck You Want To Public License"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal Public Domain Dedication"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "proprietary": ["All rights reserved.", "Copyright holder. All rights reserved. Unauthorized copying is prohibited"],
}
# Identifiers in the form of SPDX, by family.
_SPDX = {
    "apache-2.0": "Apache-2.0", "mit": "MIT", "gpl": "GPL", "lgpl": "LGPL", "agpl": "AGPL", "bsd": "BSD", "mpl": "MPL-2.0", "isc": "ISC", "bsl-1.0": "BSL-1.0", "zlib": "Zlib", "epl": "EPL-2.0", "eupl": "EUPL", "wtfpl": "WTFPL",
    "cc-by": "CC-BY", "cc-by-sa": "CC-BY-SA", "cc-by-nc": "CC-BY-NC", "cc-by-nd": "CC-BY-ND", "cc0": "CC0-1.0", "unlicense": "Unlicense",
}
# Words that name a licence; a notice without those it had speaks of another one, or of none.
_NAMES = frozenset("apache mit gnu gpl lgpl agpl affero bsd mozilla mpl isc boost bsl zlib eclipse epl eupl european wtfpl fuck cc creative commons cc0 unlicense".split())
_L = "licen[cs]e"
# How statements name a family, in lower-case words apart by one space: full names, and bare ones that need a closer statement.
NAMED = {
    "apache-2.0": (f"apache (?:software |public )?(?:{_L}|v?2(?: 0)?)(?: version)?(?: v?2(?: 0)?)?", "apache|asl ?2"),
    "mit": (f"(?:mit|expat) {_L}", "mit|expat"),
    "gpl": (f"(?:gnu )?gpl ?(?:v ?)?[123](?: 0)?|(?:gnu )?gpl {_L}|gnu (?:general )?public {_L}", "(?:gnu )?gpl"),
    "lgpl": (f"(?:gnu )?lgpl ?(?:v ?)?[23](?: [01])?|(?:gnu )?lgpl {_L}|(?:gnu )?(?:lesser|library) (?:general )?public {_L}", "(?:gnu )?lgpl"),
    "agpl": (f"(?:gnu )?agpl ?(?:v ?)?3(?: 0)?|(?:gnu )?agpl {_L}|(?:gnu )?affero (?:general )?public {_L}", "(?:gnu )?agpl"),
    "bsd": (f"(?:[0-4] clause |two clause |three clause |new |modified |simplified |revised )bsd(?: {_L})?|bsd (?:[0-4] clause|two clause|three clause|style)(?: {_L})?|bsd {_L}", "bsd"),
    "mpl": (f"mpl ?v? ?[12](?: [01])?|mozilla public {_L}", "mpl"),
    "isc": (f"isc {_L}", "isc"),
    "bsl-1.0": (f"boost software {_L}|boost {_L}|bsl 1 0", "bsl"),
    "zlib": (f"zlib(?: libpng)? {_L}", "zlib"),
    "epl": (f"epl ?v? ?[12](?: 0)?|eclipse public {_L}", "epl"),
    "eupl": (f"eupl ?v? ?1(?: [0-9])?|european union public {_L}", "eupl"),
    "wtfpl": (f"wtfpl {_L}|do what the fuck you want to public {_L}", "wtfpl"),
    "cc-by-sa": (f"cc by sa(?: [0-9] [0-9])?|creative commons attribution share ?alike(?: [0-9] [0-9])?(?: (?:international|unported))?(?: {_L})?", "cc by sa"),
    "cc-by-nc": ("cc by nc(?: sa| nd)?(?: [0-9] [0-9])?|creative commons attribution non ?commercial", "cc by nc"),
    "cc-by-nd": ("cc by nd(?: [0-9] [0-9])?|creative commons attribution no ?deriv(?:ative)?s", "cc by nd"),
    "cc-by": (f"cc by(?! (?:sa|nc|nd))(?: [0-9] [0-9])?|creative commons attribution(?! (?:share|non|no))(?: [0-9] [0-9])?(?: (?:international|unported))?(?: {_L})?", "cc by(?! (?:sa|nc|nd))"),
    "cc0": ("cc0(?: 1 0)?|cc zero", "cc0"),
    "unlicense": ("the unlicense", "unlicense"),
}
# Forms that statements are made up of for the fit, by family.
FORMS = {
    "apache-2.0": ["apache 2 0", "apache license 2 0", "apache software license", "apache v2"], "mit": ["mit", "mit license", "mit licence", "expat license"], "gpl": ["gpl", "gplv3", "gplv2", "gpl 3 0", "gpl v2", "gnu gpl", "gnu general public licence"],
    "lgpl": ["lgpl", "lgplv3", "lgpl 2 1", "gnu lgpl", "lesser general public license"], "agpl": ["agpl", "agplv3", "agpl 3 0", "gnu affero general public licence"], "bsd": ["bsd", "bsd license", "3 clause bsd", "bsd 2 clause", "new bsd license", "bsd style license"],
    "mpl": ["mpl", "mpl 2 0", "mozilla public license"], "isc": ["isc", "isc license", "isc licence"], "bsl-1.0": ["bsl 1 0", "boost software license", "boost license"], "zlib": ["zlib", "zlib license"], "epl": ["epl", "epl 2 0", "eclipse public license"],
    "eupl": ["eupl", "eupl 1 2", "european union public licence"], "wtfpl": ["wtfpl"], "cc-by": ["cc by", "cc by 4 0", "creative commons attribution license"], "cc-by-sa": ["cc by sa", "cc by sa 3 0", "creative commons attribution sharealike"],
    "cc-by-nc": ["cc by nc", "cc by nc sa 4 0", "creative commons attribution noncommercial"], "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives"], "cc0": ["cc0", "cc0 1 0"], "unlicense": ["unlicense", "the unlicense"],
}
_FRAMES = ("licensed under {}", "under the terms of the {}", "released under the {} see", "available under {} or later", "the code is {} licensed", "{} applies to this file", "{}")
#: What a statement begins with, and what may stand between that and a name: other names of a list.
_SAYS = f"(?:under|licen[cs]ed|licen[cs]ing|{_L} is|{_L} identifier|released|distributed|available|terms|subject|governed|covered|choose)"
_DENIES = "(?:not|never|neither|no longer|cannot|isn t|aren t|wasn t|weren t|doesn t|unlike|incompatible with|instead of|rather than)"
_NAME_WORDS = sorted({w for forms in FORMS.values() for f in forms for w in f.split() if w not in ("license", "licence", "public", "software", "general", "the", "new", "style", "clause", "by", "sa", "nc", "nd", "v2", "union", "0", "1", "2", "3", "4")} | {"mplv2", "lgplv2", "agplv2", "eplv2", "gplv1", "asl", "asl2"})


def statement(family: str) -> tuple[str, str]:
    """Patterns over a line's lower-case words, apart and surrounded by single spaces: its statement of the family, groups being the name, and its denial of one."""
    full, bare = NAMED[family]
    after = "(?= (?:$|or |and |licen[cs]|see |v?[0-9]|only |for |with ))"
    close = f"(?:under|licen[cs]ed|{_L} identifier|{_L} is)(?: (?:the|an|a|as|either|both|dual))*(?:(?: [^ ]+){{1,4}} (?:or|and))?"
    any_name = "(?:" + "|".join(f"{a}|{b}" for a, b in NAMED.values()) + ")(?: [0-9])*(?: (?:or later|only))?"
    several = f"^(?=.* (?:or|and|with) ) (?:{any_name} (?:or|and|with) )*({full}|{bare})(?: [0-9])*(?: (?:or later|only))?(?: (?:or|and|with) {any_name})* $"
    says = f" {_SAYS}(?: [^ ]+){{0,6}}? ({full})(?= )| ({full})(?: [^ ]+){{0,2}} (?:licen[cs]ed|applies|apply|governs)(?= )| {close} ({bare}){after}| ({bare}) licensed(?= )|^ (?:the )?({full}) (?:version )?(?:[0-9] )*$|{several}"
    return says, f" {_DENIES}(?: [^ ]+){{0,5}} (?:{full}|{bare})(?= )"


for _family, _id in _SPDX.items():
    TEMPLATES[_family].append(f"SPDX-License-Identifier: {_id}")
UNKNOWN = "unknown"
FAMILIES = [*sorted(TEMPLATES), UNKNOWN]
#: Lines of the corpus at most that the unknown class is fitted on, none longer than SAMPLE_CHARS.
SAMPLE_LINES, SAMPLE_CHARS = 2000, 2000
#: Varied copies of each notice, and copies without the words that name a licence.
COPIES, NAMELESS = 40, 10
#: Weight of the unknown class against a family's in the fit.
UNKNOWN_WEIGHT = 6.0
MIN_PROBABILITY = 0.6
CONFIRM = 0.75
_SPLIT = re.compile(NOT_ALNUM)
A_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"


def word_list(text: str) -> list[str]:
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return [w for w in _SPLIT.split(lowered) if w]


def gram_set(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def words(line: Column) -> Column:
    return split_words(ascii_lower(line), NOT_ALNUM)


def grams(ws: str) -> Column:
    """Distinct 1- and 2-grams of a column of words."""
    two = F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.concat(F.col(ws), F.coalesce(two, F.array().cast("array<string>"))))


def examples(lines: list[str], seed: int = 7) -> list[tuple[set[str], int]]:
    """(n-grams, class) of varied templates, and of lines and mixed-up words as unknown text."""
    rng, out = random.Random(seed), []
    filler = [w for line in lines for w in word_list(line)[:20] if w not in _NAMES] or ["the", "of", "and", "with", "from"]
    every = [w for notices in TEMPLATES.values() for t in notices for w in word_list(t)]
    for c, family in enumerate(FAMILIES[:-1]):
        for notice in TEMPLATES[family]:
            base = word_list(notice)
            for k in range(COPIES):
                ws = [w for w in base if k < 5 or w in _NAMES or rng.random() > 0.06]
                if k >= 5 and len(ws) > 8 and rng.random() < 0.5:  # three quarters of it at least
                    cut = rng.randint(0, len(ws) // 4)
                    first = rng.randint(0, cut)
                    ws = ws[first : len(ws) - cut + first]
                for _ in range(rng.choice((0, 0, 1, 3, 8, 16)) if k else 0):
                    ws.insert(rng.choice((0, len(ws))), rng.choice(filler if rng.random() < 0.5 else every))
                if not _NAMES & set(base) or _NAMES & set(ws):
                    out.append((gram_set(ws), c))
    for family, forms in FORMS.items():
        for form in forms:
            for frame in _FRAMES:
                for _ in range(2):
                    ws = frame.format(form).split()
                    for _ in range(rng.choice((0, 0, 2, 4))):
                        ws.insert(rng.choice((0, len(ws))), rng.choice(filler))
                    out.append((gram_set(ws), FAMILIES.index(family)))
    unknown = len(FAMILIES) - 1
    for base in (word_list(t) for notices in TEMPLATES.values() for t in notices):
        for _ in range(NAMELESS if _NAMES & set(base) else 0):
            ws = [rng.choice(filler) if w in _NAMES else w for w in base if w not in _NAMES or rng.random() < 0.5]
            out.append((gram_set(ws), unknown))
    confirmed = [gram_set(word_list(t)) for notices in TEMPLATES.values() for t in notices]
    for line in lines:
        g = gram_set(word_list(line))
        if not any(len(t & g) >= 0.5 * len(t) for t in confirmed):
            out.append((g, unknown))
    for _ in range(500):  # licence words out of order say nothing
        out.append((gram_set([rng.choice(every) if rng.random() < 0.4 else rng.choice(filler) for _ in range(rng.randint(3, 20))]), unknown))
    rng.shuffle(out)
    return out


def fit(found: list[tuple[set[str], int]], rounds: int = 200, rate: float = 0.1, l2: float = 1e-5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(n-grams, weights [n-gram, class], biases), the weights divided by the calibrating temperature."""
    framed = [frame.format(form).split() for forms in FORMS.values() for form in forms for frame in _FRAMES]
    vocabulary = sorted(set().union(*[gram_set(word_list(t)) for notices in TEMPLATES.values() for t in notices], *[gram_set(ws) for ws in framed]))
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(found), len(vocabulary) + 1), dtype=np.float32)  # with single precision throughout, or each product would copy it
    x[:, -1] = 1.0
    y = np.zeros((len(found), len(FAMILIES)), dtype=np.float32)
    for i, (g, c) in enumerate(found):
        x[i, [at[a] for a in g if a in at]] = 1.0
        y[i, c] = 1.0
    held = np.arange(len(found)) % 5 == 4
    w = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = (y * np.where(np.arange(y.shape[1]) == y.shape[1] - 1, UNKNOWN_WEIGHT, 1.0) / np.maximum(1, y.sum(axis=0))).sum(axis=1) / y.shape[1]

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    xs, ys, weight = x[~held], y[~held], share[~held, None].astype(np.float32)
    for t in range(1, rounds + 1):
        g = xs.T @ (weight * (softmax(xs @ w) - ys)) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    z = x[held] @ w
    loss = lambda t: -np.log(np.maximum((softmax(z / t) * y[held]).sum(axis=1), 1e-12)).mean()
    w = w.astype(np.float64) / min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return vocabulary, w[:-1], w[-1]


def needed(lines: list[str]) -> list[tuple[str, int, str]]:
    """(family, template, word): words of which a paragraph holds one at least, if CONFIRM of that template's n-grams stand in it.

    Of each template: its n-grams that are rarest in the sample, as many as it may lack and
    one more; a 2-gram is stood for by its rarer word.
    """
    seen: dict[str, int] = {}
    for line in lines:
        for w in set(word_list(line)):
            seen[w] = seen.get(w, 0) + 1
    out = set()
    for family, notices in TEMPLATES.items():
        for i, t in enumerate(notices):
            rare = sorted((min((seen.get(w, 0), w) for w in g.split()), g) for g in gram_set(word_list(t)))
            lack = len(rare) - int(np.ceil(CONFIRM * len(rare) - 1e-9))
            out.update((family, i, w) for (_, w), _ in rare[: lack + 1])
    return sorted(out)


def sample_lines(docs: DataFrame, n: int = SAMPLE_LINES) -> list[str]:
    """Distinct lines of the corpus, n at most: of n classes of hashes the line of the least hash, if it has SAMPLE_CHARS at most.

    The least hashes are an aggregation (n numbers), the lines of those hashes another, so
    the driver gets n lines whatever the size of the corpus and however often a line occurs.
    """
    lines = docs.where(F.col("text").isNotNull()).select(F.explode(F.split("text", "\n")).alias("l")).where((F.col("l") != "") & (F.length("l") <= SAMPLE_CHARS)).select("l", F.xxhash64("l").alias("h"))
    least = sorted(r.h for r in lines.groupBy(F.pmod("h", F.lit(n)).alias("class")).agg(F.min("h").alias("h")).select("h").collect())
    return sorted(r.l for r in lines.where(F.col("h").isin(least)).groupBy("h").agg(F.min("l").alias("l")).collect()) if least else []


def paragraphs(docs: DataFrame, lines: list[str] | None = None) -> DataFrame:
    """(doc_id, text_key, at, family, probability, match) of each confirmed licence paragraph; at counts lines from 0."""
    return _paragraphs(docs, lines)[0]


def _paragraphs(docs: DataFrame, lines: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """`paragraphs`, and (doc_id, text_key, n_paragraphs) of each row of docs."""
    spark = docs.sparkSession
    lines = sample_lines(docs) if lines is None else lines
    vocabulary, weights, biases = fit(examples(lines))
    names = [f"w{c}" for c in range(len(FAMILIES))]
    table = F.broadcast(spark.createDataFrame([(g, *map(float, row)) for g, row in zip(vocabulary, weights, strict=True)], "gram string, " + ", ".join(f"{n} double" for n in names)))
    grams_of = {(f, i): sorted(gram_set(word_list(t))) for f in FAMILIES[:-1] for i, t in enumerate(TEMPLATES[f])}
    need_words = needed(lines)
    # a row for each word that calls for a comparison with a template
    called = [(w, f, i, grams_of[f, i], len(grams_of[f, i]), len(word_list(TEMPLATES[f][i]))) for f, i, w in need_words]
    template = F.broadcast(spark.createDataFrame(called, "word string, family string, template int, expected array<string>, n int, n_words int"))
    key = ["doc_id", "text_key", "at"]
    need = F.array(*[F.lit(w) for w in sorted({w for _, _, w in need_words})])
    names_of = F.array(*[F.lit(w) for w in _NAME_WORDS])

    def judge(found: DataFrame, by: list[str]) -> DataFrame:
        """(*by, family, probability) of the rows (*by, grams) that are surely of a family."""
        scored = found.select(*by, F.explode("grams").alias("gram")).join(table, "gram").groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])
        scored = scored.select(*by, F.array(*[F.col(n) + F.lit(float(b)) for n, b in zip(names, biases, strict=True)]).alias("z"))
        top = F.array_max("z")
        family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.array_position("z", top).cast("int"))
        mass = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        judged = scored.select(*by, family.alias("family"), (1.0 / mass).alias("probability"))
        return judged.where((F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY))

    split = F.split(F.coalesce("text", F.lit("")), "\n")
    worded = F.filter(F.transform("split", lambda l, i: F.struct(i.alias("at"), words(l).alias("ws"))), lambda x: F.size(x.ws) > 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), split.alias("split"), words(F.col("text")).alias("all"))
    rows = rows.select("*", F.arrays_overlap("all", need).alias("calls"), F.arrays_overlap("all", names_of).alias("names"))
    texts = rows.select(
        "doc_id", "text_key", F.size(F.filter("split", lambda l: l.rlike(A_WORD))).cast("long").alias("n_paragraphs"),
        "calls", "names", F.when(F.col("calls") | F.col("names"), worded).alias("lines"),
    )
    texts = materialize(texts, "license-texts")  # the lines of texts with one of the needed words, and a row for each text
    found = texts.where("calls").select("doc_id", "text_key", "lines")
    likely = (
        found.select("doc_id", "text_key", F.explode("lines").alias("x")).select("doc_id", "text_key", "x.at", "x.ws")
        .withColumn("called", F.array_intersect("ws", need))
        .where(F.size("called") > 0)
        .select(*key, grams("ws").alias("grams"), _denied(F.col("ws")).alias("denied"), F.explode("called").alias("word"))
    )
    match = F.size(F.array_intersect("grams", "expected")) / F.col("n")
    alike = likely.join(template, "word").select(*key, "grams", "denied", F.col("family").alias("of"), match.alias("match")).where((F.col("match") >= CONFIRM) & ~F.array_contains("denied", F.col("of"))).drop("denied")
    alike = materialize(alike, "license-alike")  # few rows: lines that hold most of a notice
    sure = judge(alike.dropDuplicates([*key, "grams"]).select(*key, "grams"), key).select(*[F.col(c).alias(f"_{c}") for c in key], "family", "probability")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")) & (F.col("at") == F.col("_at")) & (F.col("of") == F.col("family"))
    single = alike.join(sure, same).groupBy(*key, "family", "probability").agg(F.max("match").alias("match"))
    single = single.unionByName(stated(texts.where("names"), judge)).groupBy(*key, "family").agg(F.max("probability").alias("probability"), F.max("match").alias("match"))
    single = materialize(single, "license-lines")
    both = single.unionByName(wrapped(found, single, need, F.array(*[F.lit(g) for g in vocabulary]), template, judge))
    return both, texts.select("doc_id", "text_key", "n_paragraphs")


def _line(ws: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))


def _denied(ws: Column) -> Column:
    """The families that a line of words says it is not of."""
    line, none = _line(ws), F.array().cast("array<string>")
    each = [F.when(line.rlike(statement(f)[1]), F.lit(f)) for f in NAMED]
    return F.when(line.rlike(f" {_DENIES} "), F.filter(F.array(*each), lambda f: f.isNotNull())).otherwise(none)


def stated(lines: DataFrame, judge) -> DataFrame:
    """(doc_id, text_key, at, family, probability, match) of lines that state a licence by a name: the name in its statement is classified, and has to be of the family that it names."""
    key = ["doc_id", "text_key", "at"]
    named = lines.select("doc_id", "text_key", F.explode("lines").alias("x")).select("doc_id", "text_key", "x.at", "x.ws").where(F.arrays_overlap("ws", F.array(*[F.lit(w) for w in _NAME_WORDS])))
    named = named.select(*key, _line(F.col("ws")).alias("line"), _denied(F.col("ws")).alias("denied"))
    each = []
    for family in NAMED:
        says = statement(family)[0]
        found = F.concat(*[F.regexp_extract("line", says, g) for g in range(1, 7)])  # one of them has taken part
        speaks = F.col("line").rlike(f" (?:{'|'.join(NAMED[family])})(?= )")  # most lines name one family, and only its statement is looked for
        each.append(F.when(speaks & ~F.array_contains("denied", family) & F.col("line").rlike(says), F.struct(F.lit(family).alias("of"), F.concat(F.lit("licensed under "), found).alias("clause"))))
    claims = named.select(*key, F.explode(F.filter(F.array(*each), lambda c: c.isNotNull())).alias("c")).select(*key, "c.of", F.split("c.clause", " ").alias("ws"))
    claims = materialize(claims.dropDuplicates([*key, "of"]).select(*key, "of", grams("ws").alias("grams")), "license-stated")  # few rows: lines that name a licence
    sure = judge(claims, [*key, "of"])
    return sure.where("family = of").select(*key, "family", "probability", F.lit(1.0).alias("match"))


def wrapped(lines: DataFrame, single: DataFrame, need: Column, vocabulary: Column, template: DataFrame, judge) -> DataFrame:
    """(doc_id, text_key, at, family, probability, match) of each notice that is wrapped over lines; at is its first line.

    A window of neighbouring lines, none without a word and no more lines than the template
    has words, confirms the template if CONFIRM of its n-grams stand in it (2-grams also
    across the line ends). The least such windows, with what the lines around them still
    hold of the template, are classified like lines; those of a family that overlap are one
    notice, and a notice with a line that is confirmed as of its family counts as that line. Its match takes in the lines around the window.
    """
    key = ["doc_id", "text_key"]
    before = lambda x, i: F.get("lines", i - 1)
    joint = lambda x, i: F.when(before(x, i).at == x.at - 1, F.concat(F.element_at(before(x, i).ws, -1), F.lit(" "), x.ws[0]))
    rows = lines.select(*key, F.explode(F.transform("lines", lambda x, i: F.struct(x.at.alias("at"), (x.at - i).alias("run"), x.ws.alias("ws"), joint(x, i).alias("joint")))).alias("x")).select(*key, "x.*")
    hit = F.struct(F.col("at"), F.col("at").alias("since"), F.array_intersect(grams("ws"), vocabulary).alias("grams"))
    across = F.struct(F.col("at"), (F.col("at") - 1).alias("since"), F.array_intersect(F.array("joint"), vocabulary).alias("grams"))
    hits = rows.select(*key, "run", F.explode(F.array(hit, across)).alias("h")).where(F.size("h.grams") > 0)
    runs = hits.groupBy(*key, "run").agg(F.collect_list("h").alias("hits")).where(F.array_min("hits.since") < F.array_max("hits.at"))
    runs = runs.withColumn("grams", F.array_distinct(F.flatten("hits.grams")))
    least = F.ceil(F.col("n") * CONFIRM - 1e-9)
    called = runs.select("*", F.explode(F.array_intersect("grams", need)).alias("word")).join(template, "word").where(F.size(F.array_intersect("grams", "expected")) >= least)
    possible = called.dropDuplicates([*key, "run", "family", "template"])
    # the first line at which the n-grams since the start are enough
    possible = possible.withColumn("seen", F.filter(F.transform("hits", lambda h: F.struct(h.at.alias("at"), h.since.alias("since"), F.array_intersect(h.grams, F.col("expected")).alias("grams"))), lambda h: F.size(h.grams) > 0))
    starts = possible.select(*key, "run", "family", "template", "expected", "n", "n_words", "seen", F.explode(F.array_distinct("seen.since")).alias("at"))
    starts = starts.withColumn("near", F.filter("seen", lambda h: (h.since >= F.col("at")) & (h.at < F.col("at") + F.col("n_words"))))
    held = lambda end: F.array_distinct(F.flatten(F.filter("near", lambda h: h.at <= end).grams))
    starts = starts.withColumn("end", F.array_min(F.filter(F.array_distinct("near.at"), lambda e: F.size(held(e)) >= F.ceil(F.col("n") * CONFIRM - 1e-9))))
    around = F.filter("seen", lambda h: (h.since > F.col("end") - F.col("n_words")) & (h.at < F.col("at") + F.col("n_words")))
    starts = starts.where("end is not null").withColumn("extra", F.array_distinct(F.flatten(around.grams))).withColumn("match", F.size("extra") / F.col("n"))
    windows = starts.groupBy(*key, "run", "family", "template", "end").agg(F.max_by(F.struct("at", "match", "extra"), "at").alias("w")).select(*key, "run", F.col("family").alias("of"), "w.at", "end", "w.match", "w.extra")
    windows = windows.where("at < end").groupBy(*key, "run", "of", "at", "end").agg(F.max("match").alias("match"), F.array_distinct(F.flatten(F.collect_set("extra"))).alias("extra"))
    by = [*key, "run", "of", "at", "end", "match"]
    inside = windows.join(runs.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("run").alias("_run"), "hits"), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")) & (F.col("run") == F.col("_run")))
    inside = inside.select(*by, F.array_distinct(F.concat("extra", F.flatten(F.filter("hits", lambda h: (h.since >= F.col("at")) & (h.at <= F.col("end"))).grams))).alias("grams"))
    sure = judge(inside.dropDuplicates(by), by).where("family = of")
    order = Window.partitionBy(*key, "family").orderBy("at", "end")
    opens = F.when(F.col("at") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    notices = sure.withColumn("opens", opens).withColumn("notice", F.sum("opens").over(order)).groupBy(*key, "family", "notice")
    notices = notices.agg(F.min("at").cast("int").alias("at"), F.max("end").alias("end"), F.max("probability").alias("probability"), F.max("match").alias("match"))
    line = single.select(*[F.col(c).alias(f"_{c}") for c in [*key, "at", "family"]])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")) & (F.col("family") == F.col("_family")) & F.col("_at").between(F.col("at"), F.col("end"))
    return notices.join(line, same, "left_anti").select(*key, "at", "family", "probability", "match")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs (lines with a word), n_licensed, families (sorted, comma-joined), probability (of the surest), match (its best) of each row of docs; a wrapped notice adds one to n_licensed."""
    found, rows = _paragraphs(docs)
    per_doc = keyed(found).groupBy(*ROW_KEY).agg(
        F.count(F.lit(1)).alias("n_licensed"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("probability"), F.max("match").alias("match")
    )
    joined = keyed(rows).join(per_doc, ROW_KEY, "left")
    return joined.select("doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).cast("long").alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"), "probability", "match")
