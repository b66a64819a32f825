"""License notices in texts: MinHash bands over windows find templates, exact containment confirms.

Templates are word shingles. For a template of m shingles a text is read in windows of a quarter
more, a quarter apart, so any run of m lies in one of them whole. A window and a template that is
there to ``percent`` of its shingles are alike to at least 0.5, and ``bands`` bands of one
smallest hash each miss such a pair with a chance of 0.5 ** bands (2 in 10,000 at 12). A band in common
makes a candidate; the share of the template's shingles in the window decides.

Notices of different licenses may have most of their words in common. Templates that have half of
their shingles in another license's are held against it: in the window, the share of the shingles that
only this one of the two has must not be the smaller one, nor none.

A band can only agree in a shingle that is the smallest of a template under its hash, so texts
without any of these are done after one look. All of it is DataFrame functions within a row:
nothing is shuffled or sent but the templates, which stand in the plan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexline.llm.common import lower_ascii

#: GNU licenses: name, what a notice calls the work, title, version.
_GNU = (
    ("gpl-1.0", "program", "GNU General Public License", "1"),
    ("gpl-2.0", "program", "GNU General Public License", "2"),
    ("gpl-3.0", "program", "GNU General Public License", "3"),
    ("lgpl-2.0", "library", "GNU Library General Public License", "2"),
    ("lgpl-2.1", "library", "GNU Lesser General Public License", "2.1"),
    ("lgpl-3.0", "library", "GNU Lesser General Public License", "3"),
    ("agpl-3.0", "program", "GNU Affero General Public License", "3"),
)
_CC = (
    ("cc-by", "Attribution"),
    ("cc-by-sa", "Attribution-ShareAlike"),
    ("cc-by-nc", "Attribution-NonCommercial"),
    ("cc-by-nd", "Attribution-NoDerivatives"),
    ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
)


def _gnu_notices(work: str, title: str, version: str) -> list[str]:
    """A line, the grant, and the whole notice that the license's appendix gives."""
    grant = (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {title} as "
        f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
        "later version."
    )
    rest = (
        f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        f"implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details. "
        f"You should have received a copy of the {title} along with this {work}"
    )
    return [f"This work is licensed under the {title}, version {version}.", grant, f"{grant} {rest}"]


_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = (
    f"{_BSD}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction'
)

#: Lines and whole notices by which texts name their license, and short license texts. Fixed values.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations "
        "under the License.",
    ),
    ("mit", "Released under the MIT License."),
    ("mit", _MIT),
    (
        "mit",
        f"{_MIT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
        "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("bsd", _BSD),
    ("bsd-2-clause", f"{_BSD_2} {_AS_IS}"),
    ("bsd-3-clause", f"{_BSD_3} {_AS_IS}"),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    *[(name, text) for name, *of in _GNU for text in _gnu_notices(*of)],
    *[(f"{name}-4.0", f"Licensed under CC {name[3:].upper()} 4.0.") for name, _ in _CC],
    *[
        (f"{name}-4.0", f"This work is licensed under a Creative Commons {title} 4.0 International License.")
        for name, title in _CC
    ],
)


def _whole_texts() -> list[tuple[str, str]]:
    """The license texts that are packaged with this module, by file name."""
    files = sorted((f for f in resources.files(__package__).joinpath("license_texts").iterdir()), key=lambda f: f.name)
    return [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in files if f.name.endswith(".txt")]


TEMPLATES = (*NOTICES, *_whole_texts())


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 75
    bands: int = 12
    max_templates: int = 1_000


def _shingles(words: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words in order; of all words as one where they are fewer."""

    def of(p: Column) -> Column:
        last = F.greatest(F.size(p["w"]) - (n - 1), F.least(F.size(p["w"]), F.lit(1)))
        places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.slice(p["w"], i, n)))

    # The words are worked out once, not for each place.
    return F.element_at(F.transform(F.array(F.struct(words.alias("w"))), of), 1)


def _words(text: Column) -> Column:
    """Runs of letters and digits, dots within them too; A-Z lowered."""
    return F.filter(F.split(lower_ascii(text), "[^\\p{L}\\p{N}.]+|\\.+(?![\\p{L}\\p{N}])"), lambda w: w != "")


def _smallest(shingles: Column, band: Column) -> Column:
    return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, band)))


def find_licenses(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    text: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """The columns of ``docs`` with ``licenses``, replaced if it is there: an array of (license,
    containment), each license once with its best share of a template, in order of name.

    A null or empty text, and any without a notice, has an empty array. A template of fewer words than
    a shingle is one shingle. Templates without words match nothing.
    """
    if len(templates) > settings.max_templates:
        raise ValueError(f"more than {settings.max_templates} templates")
    spark = docs.sparkSession
    bands = F.sequence(F.lit(1), F.lit(settings.bands))
    lowest = F.transform(
        bands, lambda j: F.array_min(F.transform("s", lambda x: F.struct(F.xxhash64(x, j).alias("low"), x.alias("key"))))
    )
    made = (
        spark.createDataFrame([(n, t) for n, t in templates], "license string, text string")
        .select("license", F.array_distinct(_shingles(_words(F.col("text")), settings.words)).alias("s"))
        .where(F.size("s") > 0)
        .select("license", "s", lowest.alias("m"))
        .select("license", "s", F.col("m.low").alias("low"), F.col("m.key").alias("keys"))
        .collect()
    )
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("licenses", "_shingles")])
    nothing = F.array().cast("array<struct<license:string,containment:double>>")
    if not made:
        return base.withColumn("licenses", nothing)
    # One literal each: a column for every number would make a plan of some ten thousand columns.
    known = _literal(
        [r.asDict() | {"rivals": _rivals(r, made)} for r in made],
        "array<struct<license:string,s:array<bigint>,low:array<bigint>,keys:array<bigint>,"
        "rivals:array<struct<mine:array<bigint>,theirs:array<bigint>>>>>",
    )
    keys = _literal(sorted({k for r in made for k in r["keys"]}), "array<bigint>")

    def share(of: Column, window: Column) -> Column:
        return F.size(F.array_intersect(of, window)) / F.greatest(F.size(of), F.lit(1))

    def stands(t: Column, window: Column) -> Column:
        """Whether no rival has more of what tells the two apart."""

        def against(r: Column) -> Column:
            mine, theirs = share(r["mine"], window), share(r["theirs"], window)
            return (mine >= theirs) & ((mine > 0) | (F.size(r["mine"]) == 0))

        return F.forall(t["rivals"], against)

    def containment(t: Column, all_shingles: Column) -> Column:
        """Best share of the template in a window that has a band in common with it; null if none has."""
        m = F.size(t["s"])
        step = F.greatest(F.lit(1), F.floor(m / 4).cast("int"))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_shingles)), step)

        def of(start: Column) -> Column:
            window = F.slice(all_shingles, start, m + step - 1)
            alike = F.exists(bands, lambda j: _smallest(window, j) == F.element_at(t["low"], j))
            found = F.when(F.arrays_overlap(window, t["s"]) & alike, share(t["s"], window))
            return F.when((100 * found >= settings.percent) & stands(t, window), found)

        return F.array_max(F.transform(starts, of))

    def found(p: Column) -> Column:
        # A band in common is one of the template's keys in the text.
        near = F.filter(known, lambda t: F.arrays_overlap(p["s"], t["keys"]))
        shares = F.transform(
            near, lambda t: F.struct(t["license"].alias("license"), containment(t, p["s"]).alias("containment"))
        )
        return F.element_at(F.transform(F.array(F.filter(shares, lambda x: x["containment"].isNotNull())), best), 1)

    def best(enough: Column) -> Column:
        """Each license once; a license without its version or kind, such as ``bsd``, only where none is more exact."""
        names = F.array_sort(F.array_distinct(F.transform(enough, lambda x: x["license"])))
        exact = F.filter(
            names, lambda n: ~F.exists(enough, lambda x: F.startswith(x["license"], F.concat(n, F.lit("-"))))
        )
        return F.transform(
            exact,
            lambda n: F.struct(
                n.alias("license"),
                F.array_max(
                    F.transform(F.filter(enough, lambda x: x["license"] == n), lambda x: x["containment"])
                ).alias("containment"),
            ),
        )

    own = _shingles(_words(F.coalesce(F.col(text).cast("string"), F.lit(""))), settings.words)
    some = lambda p: F.when(F.arrays_overlap(p["s"], keys), found(p)).otherwise(nothing)
    return base.withColumn("licenses", F.element_at(F.transform(F.array(F.struct(own.alias("s"))), some), 1))


def _literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _rivals(t, made: list) -> list[dict[str, list[int]]]:
    """What tells ``t`` and each template of another license apart that has half of its shingles or more."""
    own, out = set(t["s"]), []
    for r in made:
        other = set(r["s"])
        if r["license"] != t["license"] and 2 * len(own & other) >= len(own):
            out.append({"mine": sorted(own - other), "theirs": sorted(other - own)})
    return out
