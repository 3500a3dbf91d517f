"""Licence scans by canonical digest: a whole text, paragraph or line is brought to a canonical form and its digest is looked up
among the digests of known licence texts.

The canonical form has no case, punctuation, copyright lines or spelling variants. The scan is a hash join; only matches, at
most one a document and known text, are grouped. Known are the whole texts in `licence_texts`, as published and without title
or appendix, the usual file headers, and an identifier line of every SPDX name; callers can give a table of their own.
"""

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.scale import attach

from .catalog import ASCII_LOWER, ASCII_UPPER, query, table

# Equivalent spellings, and licence texts and notices with their SPDX names.
SPELLINGS = {"licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense", "organisation": "organization", "v2": "version 2", "v3": "version 3",
             "merchantibility": "merchantability", "non infringement": "noninfringement", "http": "https"}
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC), ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
]
COPYRIGHT = r"^[\x09-\x0D\x20*#/;-]*(copyright|\(c\)|©|all rights reserved)"
# a line is a copyright line by a sign, year or name after the word; prose of licences can begin a line with "copyright" or "(c)" too
PROSE = r"(also|and|are|disclaimers?|doctrines|for|holders?|if|interests?|in|is|laws?|licen[sc]es?|like|line|notices?|of|on|or|owners?|ownership|patent|permission|protection|resulting|statements?|treaty|treaties|those|to|under|the (software|library|program))"
ITEM = r"(you|under|representations|the (?!regents|university|authors?|contributors)|any|if|a|an|all|to|in|for|it|such|this|that|must|include|indicate|accompany|distribute)"
NOTICE = rf"^[\x09-\x0D\x20*#/;-]*(copyright[\x09\x20:]*(\(c\)|©|[0-9<\[{{])|copyright[\x09\x20:]+(?!{PROSE}\b)[^\x09\x20]|\(c\)(?![\x09\x20]+{ITEM}\b)|©|all rights reserved)"
SPDX_PLUS = r"(spdx-license-identifier:[\x09\x20]*[a-z0-9.-]*[0-9])\+"
# a text may come with these titles, or without its own
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "(The MIT License)", "MIT", "Expat License"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
          "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License", "The BSD License"),
          "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License", "The BSD License"),
          "BSL-1.0": ("Boost Software License 1.0",), "Unlicense": ("The Unlicense", "Unlicense")}
ENDS = ("END OF TERMS AND CONDITIONS", "How to Apply These Terms", "APPENDIX: How to apply", "Exhibit A - ", "EXHIBIT A -")
NAMES = ("the copyright holder nor the names of its", "the copyright owner nor the names of its", "the University nor the names of its", "the author nor the names of its", "the authors nor the names of its")
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _forms(name: str, text: str) -> set[str]:
    """A published text with and without its title and appendix, and with the wordings in use."""
    paragraphs, bodies = re.split(r"\n\s*\n", text.strip()), {text}
    for i in range(1, 4):
        if len(paragraphs) > i and len(paragraphs[i - 1].split()) <= 12:
            bodies.add("\n\n".join(paragraphs[i:]))
        else:
            break
    for body in list(bodies):
        at = [k for end in ENDS if (k := body.find(end)) > len(body) // 2]
        bodies |= {body[:k] for k in at} | {body[:k] + ENDS[0] for k in at if body.startswith(ENDS[0], k)}
    if name == "MIT":
        bodies |= {b.replace("this permission notice shall", "this permission notice (including the next paragraph) shall") for b in bodies}
    if name.startswith("BSD"):
        bodies |= {re.sub(r"\bnotice(?=, *\s*this\s+list)|(?<=\n)\s*\d\.", lambda m: m[0] if m[0] == "notice" else "", b) for b in bodies}
        bodies |= {b.replace("COPYRIGHT HOLDER OR", f"{w} OR") for b in bodies for w in ("COPYRIGHT OWNER",)}
        bodies |= {b.replace(NAMES[0], n) for b in bodies for n in NAMES}
    return bodies | {f"{t}\n\n{b}" for t in TITLES.get(name, ()) for b in bodies}


def _headers() -> list[tuple[str, str]]:
    """Notices that files of these licences begin with, whole and by paragraph."""
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    copy, url = "You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0"
    rest = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
    out = [("Apache-2.0", t) for t in (apache, f"{apache} {copy}", f"{apache} {copy} {url}", f"{apache} {copy} {url} {rest}")]
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    out += [("MPL-2.0", mpl), ("MPL-2.0", mpl + " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")]
    for short, versions, called in (("GPL", ("1", "2", "3"), "General"), ("LGPL", ("2",), "Library General"), ("LGPL", ("2", "2.1", "3"), "Lesser General"), ("AGPL", ("3",), "Affero General")):
        for v in versions:
            spdx = f"{short}-{v if '.' in v else v + '.0'}"
            for what in ("program", "library", "software", "file", "package"):
                law = f"GNU {called} Public License"
                start = f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {law}"
                hope = (f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
                        f"PARTICULAR PURPOSE. See the {law} for more details.")
                got = f"You should have received a copy of the {law} along with this {what}."
                ends = [hope, *(f"{hope} {got} If not, {see}" for see in ("see <https://www.gnu.org/licenses/>.", "see <https://www.gnu.org/licenses>.", *(f"write to the Free Software Foundation, Inc., {at}" for at in (
                    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"))))]
                fsf = "as published by the Free Software Foundation"
                late = f"{fsf}, either version {v} of the License, or (at your option) any later version."
                firsts = [(f"{spdx}-or-later", f"{start} {late}"), (spdx, f"{start} version {v} {fsf}."), (spdx, f"{start} version {v} only, {fsf}."), (spdx, f"{start} {fsf}, version {v} of the License.")]
                out += [(n, t) for n, first in firsts for t in (first, *(f"{first} {e}" for e in ends))]
    for kind, called in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                         ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        for a in ("a", "the"):
            line = f"This work is licensed under {a} Creative Commons {called} 4.0 International License."
            out += [(f"CC-{kind}-4.0", line), (f"CC-{kind}-4.0", f"{line} To view a copy of this license, visit http://creativecommons.org/licenses/{kind.lower()}/4.0/.")]
    return out


def published() -> list[tuple[str, str]]:
    """(licence, text) of whole texts in all their forms, file headers and SPDX lines; a version `only` goes by the plain name."""
    folder, out = files(__package__) / "licence_texts", _headers()
    for file in sorted(folder.iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name = file.name[:-4].split("@")[0]
            out += [(name, t) for t in sorted(_forms(name, file.read_text(encoding="utf-8")))]
    for spdx in (folder / "spdx_ids").read_text(encoding="utf-8").split():
        out.append((re.sub(r"-only$", "", re.sub(r"\+$", "-or-later", spdx)), f"SPDX-License-Identifier: {spdx}"))
    return out


def canonical(text: Column) -> Column:
    """A-Z lower-cased, copyright lines dropped, everything but letters and digits one space, spellings made equal."""
    low = F.regexp_replace(F.translate(text, ASCII_UPPER, ASCII_LOWER), SPDX_PLUS, "$1 or later")
    lines = F.filter(F.split(low, "\n", -1), lambda s: ~s.rlike(NOTICE))
    out = F.concat(F.lit(" "), F.regexp_replace(F.array_join(lines, " "), GAP, " "), F.lit(" "))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN + published(), "licence string, text string")


def scanned(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, licences (names in order) and whole (a licence makes up the entire text) of every row of `docs` (doc_id, text).

    Looked up are the text itself, its paragraphs (between empty lines) and its lines; the last two count only where the
    text itself is no known one. Null, empty and purely
    punctuating texts match nothing, nor do such entries of `known` (licence, text). Rows that share a doc_id, null
    included, are one document and get the same answer each. An empty table gives no rows.
    """
    empty = F.md5(F.lit("").cast("binary"))
    table_ = known.select("licence", digest(F.col("text")).alias("digest")).where(F.col("digest").isNotNull() & (F.col("digest") != empty) & F.col("licence").isNotNull()).distinct()
    key = [F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id")]
    t = F.col("text")
    unit = lambda kind: lambda s: F.struct(F.lit(kind).alias("whole"), s.alias("text"))
    units = F.concat(F.array(unit(True)(t)), F.transform(F.array_except(F.concat(F.split(t, r"\n[\x09-\x0D\x20]*\n", -1), F.split(t, "\n", -1)), F.array(t)), unit(False)))
    parts = docs.where(t.isNotNull()).select(*key, F.xxhash64(t).alias("__text"), F.explode(units).alias("u"))
    parts = parts.select("__none", "__id", "__text", "u.whole", digest(F.col("u.text")).alias("digest"))
    # a licence text may quote the notice of its own files: in a text that is a licence, parts say nothing more
    texts = attach(parts, table_, ["digest"]).groupBy("__none", "__id", "__text").agg(
        F.collect_set(F.when(F.col("whole"), F.col("licence"))).alias("own"), F.collect_set("licence").alias("any"), F.max("whole").alias("whole"))
    texts = texts.withColumn("licences", F.when(F.col("whole"), F.col("own")).otherwise(F.col("any")))
    found = texts.groupBy("__none", "__id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("licences")))).alias("licences"), F.max("whole").alias("whole"))
    rows = attach(docs.select("doc_id", *key), found, ["__none", "__id"], "left")
    return rows.select("doc_id", F.coalesce("licences", F.array().cast("array<string>")).alias("licences"), F.coalesce("whole", F.lit(False)).alias("whole"))


def canonical_sql(text: str) -> str:
    lines = f"list_filter(string_split(translate({text}, '{ASCII_UPPER}', '{ASCII_LOWER}'), chr(10)), lambda s: not regexp_matches(s, '{COPYRIGHT}'))"
    out = f"' ' || regexp_replace(coalesce(array_to_string({lines}, ' '), ''), '{GAP}', ' ', 'g') || ' '"
    for old, new in SPELLINGS.items():
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out}, ' ')"


SQL = f"""
with k(licence, text) as (values {", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in KNOWN)}),
kd as (select distinct licence, {canonical_sql('text')} as c from k),
u as (select doc_id, true as whole, text as t from documents where text is not null
  union all select doc_id, false, unnest(regexp_split_to_array(text, '\\n[\\x09-\\x0D\\x20]*\\n')) from documents
  union all select doc_id, false, unnest(string_split(text, chr(10))) from documents),
h as (select doc_id, whole, licence from u join kd on kd.c = {canonical_sql('u.t')} where kd.c <> ''),
g as (select doc_id, string_agg(distinct licence, ',' order by licence) as names, bool_or(whole) as whole from h group by 1)
select d.doc_id, coalesce(names, '') as licences, coalesce(whole, false) as whole from documents d left join g on d.doc_id is not distinct from g.doc_id"""


@query("op9_licence_digests", SQL)
def op9_licence_digests(spark, sf_dir):
    out = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), known_texts(spark))
    return out.select("doc_id", F.array_join("licences", ",").alias("licences"), "whole")
