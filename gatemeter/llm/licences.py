"""Licence scans by canonical digest, in DataFrame functions only.

A text is brought to canonical form: lower case, equivalent spellings as one, lines that state a copyright dropped (``copyright`` with
a sign, a year or ``by``, or a holder's line that begins the text or a paragraph; a copyright
notice, holder, owner or license is of the terms wherever lines break), everything that is
no letter or digit as one space. The SHA-256 of the canonical text is looked up among the
digests of known licence texts by an equi-join. The whole text must be the licence;
a licence within a longer text isn't a match.

The known digests are a table of any size: the built-in one holds short licences and
notices and the whole texts in ``licence_texts``, ``digests`` makes rows of any (licence, text) table. The join is left to the
planner, which broadcasts the digests only while their size allows.

Defined results: a null, empty or all-copyright text has a null digest and no licence;
repeated rows are looked up each on its own; texts with equal canonical forms have equal
digests; where several licences share a digest the first name by order is given; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from importlib.resources import files
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (from, to) in order, after lower-casing; whole words only.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("analogue", "analog"), ("authorisation", "authorization"),
    ("centre", "center"), ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"), ("organisation", "organization"), ("recognise", "recognize"), ("utilise", "utilize"), ("wilful", "willful"), ("programme", "program"),
    ("per cent", "percent"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"), ("http", "https"),
)
#: typographic dashes beside the plain one; other signs make no difference
_DASHES = "‐‑‒–—-"
_GAP = rf"[ \t\n*#/;{_DASHES}]"
_LEAD = rf"[ \t*#/;{_DASHES}]*"
#: (pattern, replacement) in order; what is replaced by a space are statements, not terms, however the lines are broken.
_STATEMENTS = (
    (rf"all{_GAP}+rights{_GAP}+reserved\b\.?", " "),
    # words of the terms, set aside
    (rf"copyright({_GAP}+(?:notices?|holders?|owners?|licen[cs]es?|laws?|statements?|interests?|disclaimers?|protection|and|or|in|on|to|of|is|may|must|shall)\b)", r"copyxright\1"),
    # lines of a holder: at the head of the text or of a paragraph
    (rf"(\A|\n[ \t]*\n)(?:{_LEAD}copyright\b[^\n]*(?:\n|\z))+", r"\1 "),
    (rf"\A[ \t\n*#/;{_DASHES}]*\(c\)[^\n]*", " "),
    (rf"(\n[ \t]*\n){_LEAD}\(c\)[^\n]{{1,80}}(\n[ \t]*(?:\n|\z))", r"\1\2"),
    # a year, a sign or "by", on any line
    (rf"(?m)^{_LEAD}(?:copyright[ \t]*(?:\(c\)|©|:|by\b|[0-9]{{4}})|\(c\)[ \t]*(?:copyright\b|[0-9]{{4}})|©)[^\n]*$", " "),
    ("copyxright", "copyright"),
)
#: one of these stands in any text that the patterns above change
_TOLD = ("copyright", "(c)", "©", "reserved")
_OTHER = r"[^a-z0-9\p{L}\p{N}]+"
_RESPELT = " (?:" + "|".join(a for a, _ in SPELLINGS) + ") "


def _with(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), where the value is worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _unstated(c: Column) -> Column:
    """Without lines that state a copyright."""
    out = F.regexp_replace(c, "\r\n?", "\n")
    for pattern, by in _STATEMENTS:
        out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
    return F.when(reduce(or_, [F.contains(c, F.lit(x)) for x in _TOLD]), out).otherwise(c)


def _spelt(c: Column) -> Column:
    """With one spelling of each word; words stand between single blanks."""
    out = c
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.when(c.rlike(_RESPELT), out).otherwise(c))


def canonical(text: Column) -> Column:
    """The canonical form; one space between words, none at the ends."""
    stated = _with(F.lower(F.coalesce(text, F.lit(""))), _unstated)
    return _with(F.concat(F.lit(" "), F.regexp_replace(stated, _OTHER, " "), F.lit(" ")), _spelt)


def digest(text: Column) -> Column:
    return _with(canonical(text), lambda c: F.when(c != "", F.sha2(c, 256)))


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
{}THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def _whole_texts() -> tuple[tuple[str, str], ...]:
    """(licence, text) of the whole licences in licence_texts, in the forms that are about."""
    out = []
    for file in sorted(files("gatemeter.llm").joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        forms = [text]
        if end := re.search(r"END OF TERMS AND CONDITIONS", text):  # without how to apply it
            forms += [text[: end.start()], text[: end.end()]]
        if name.startswith("BSD"):
            places = iter(range(1, 4))
            forms.append(re.sub(r"(?m)^ *\*", lambda m: f"{next(places)}.", text))
            forms += [f"{title}\n\n{x}" for title in (f"BSD {name[4]}-Clause License", f"The BSD {name[4]}-Clause License") for x in forms]
        out += [(name, x) for x in forms]
    return tuple(out)


KNOWN = (
    ("0BSD", _ISC.format("")), ("Apache-2.0-notice", _APACHE), ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."), ("GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."), ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("MIT", _MIT.format(_MIT_NOTICE)), ("MIT", "MIT License\n" + _MIT.format(_MIT_NOTICE)), ("MIT-0", _MIT[: _MIT.index(", subject to")] + ".\n" + _MIT[_MIT.index("THE SOFTWARE IS") :]),
    ("MIT-notice", "Released under the MIT License."), ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."), ("Zlib", _ZLIB),
    *_whole_texts(),
)


def known(spark: SparkSession) -> DataFrame:
    """(digest, licence) of the built-in texts."""
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(t).alias("text")) for n, t in KNOWN])).alias("k")).select("k.*")
    return digests(rows)


def digests(licences: DataFrame) -> DataFrame:
    """(digest, licence) of a table of (licence, text); the first name of each digest."""
    return licences.select(digest(F.col("text")).alias("digest"), "licence").where("digest IS NOT NULL").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, licences: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest and licence (null if none) of every document."""
    table = (known(docs.sparkSession) if licences is None else licences).select(F.col("digest").alias("known_digest"), "licence")
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    return rows.join(table, F.col("digest") == F.col("known_digest"), "left").select("doc_id", "digest", "licence")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)


def _sql_digest(text: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    c = f"regexp_replace(lower(coalesce({text}, '')), '\\r\\n?', chr(10), 'g')"
    for pattern, by in _STATEMENTS:
        c = f"regexp_replace({c}, '{pattern}', {quote(by)}, 'g')"
    c = f"' ' || regexp_replace({c}, '{_OTHER}', ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        c = f"replace({c}, ' {a} ', ' {b} ')"
    return f"sha256(nullif(trim({c}), ''))"


ORACLE = (
    "WITH k AS (SELECT digest, min(licence) AS licence FROM (SELECT " + _sql_digest("t") + " AS digest, licence FROM (VALUES "
    + ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in KNOWN)
    + ") AS v(licence, t)) GROUP BY digest), d AS (SELECT doc_id, " + _sql_digest("text") + " AS digest FROM documents) SELECT d.doc_id, d.digest, k.licence FROM d LEFT JOIN k ON d.digest = k.digest"
)
