"""Page rendering against a plain reader of visible words, and licence scans against plain canonical texts."""

import random
import re
import textwrap
import time
from html.parser import HTMLParser
from pathlib import Path

import pytest

from scenelake.llm import html_text as HT
from scenelake.llm import licences as LI


class Words(HTMLParser):
    """Words outside elements that are never shown, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.unseen, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.unseen += tag in ("head", "script", "style", "template")

    def handle_endtag(self, tag):
        self.unseen -= tag in ("head", "script", "style", "template")

    def handle_data(self, data):
        if not self.unseen:
            self.words += data.split()


def test_all_visible_words_in_order(spark):
    rows = HT.extracted(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")).collect()
    assert len(rows) == 50
    for r in rows:
        w = Words()
        w.feed(r.html)
        w.close()
        assert [x for x in r.visible_text.split() if x != "-"] == w.words


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b</p></p></div>c", "a\n\nb\n\nc"), ("a<br>b<hr>c", "a\nb\nc"), ("<b>x</b>y <i> z </i>!", "xy z !"),
    ("<ul><li>a<li>b<ol><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  1. c\n  2. d\n- e"), ("<ol><li>" * 2 + "x", "1. 1. x"),
    ("<table><tr><td>aa<td>b<tr><td>c<td><p>d<p>e</table>f", "aa  b\nc   d\n\n    e\n\nf"), ("<table><thead><tr><th>h</thead><tbody><tr><td>v</table>", "h\nv"),
    ("<table><caption>cap</caption><tr><td><table><tr><td>in</table><td>out</table>", "cap\nin  out"),
    ("<pre>\n a\n  b</pre>", "a\n  b".replace("a", " a", 1)), ("<dl><dt>t<dd>d<dt>u</dl>", "t\nd\nu"), ("<select><option>a<option>b</select>c", "a c"), ("<select><option disabled>a<option>b</select>c", "b c"),
    ("<div hidden>x</div><span style='display: none'>y</span><p style=\"Visibility:hidden\">z</p><input type=hidden value=v>w", "w"),
    ("<script>if (a < b) '</p>'</script><style>p{}</style><template>t</template><!-- <p>n</p> -->s", "s"), ("<title>t</title><body>b", "b"), ("<script>never closed", ""),
    ("<p>cut off &am", "cut off &am"), ("<a href='x>y'>z</a", "z"), ("< 5 and > 3", "< 5 and > 3"), ("<head><title>t</title><h1>x</h1>", "x"),
])
def test_layout(page, text):
    assert HT.text_of(page) == text


@pytest.mark.parametrize("page, text", [
    ("<a title='the hidden truth'>x</a>", "x"), ("<div class='nav hidden lg:flex'>x</div>", "x"), ("<p data-note=\"use display: none\">x", "x"), ("<p alt='type=hidden'>x", "x"), ("<b title=hidden>x</b>", "x"),
    ("<p style='--note: \"display: none; \"; color: red'>x", "x"), ("<p style='display:none;display:block'>x", "x"), ("<p hidden=''>x</p><p HIDDEN>y</p>z", "z"), ("<p a=1 hidden>x</p>y", "y"),
    ("<p style=display:none>x</p>y", "y"), ("<p style='color:red; DISPLAY : none !important'>x</p>y", "y"), ("<p style='display&#58;none'>x</p>y", "y"), ("<p style='/* a */visibility:hidden'>x</p>y", "y"),
])
def test_only_attributes_hide(page, text):
    assert HT.text_of(page) == text


@pytest.mark.parametrize("page, text", [
    ("<table><colgroup><col><col><tr><td>a<td>b</table>", "a  b"), ("<table><colgroup><col><tbody><tr><td>a</table>", "a"), ("<table><caption>cap<tr><td>a</table>", "cap\na"),
    ("<table><tr><form><td>a<td>b</form></table>", "a  b"), ("<table><form><tr><td>a<tr><td>b</form></table>", "a\nb"), ("<table><tr><div>x<td>a</div></table>", "x\na"),
    ("<table><tr>one<td>a<tr>two<td>b</table>", "one\ntwo\na\nb"),
    ("<table><tbody>x<b>y</b><tr><td>a</table>", "xy\na"), ("<table><tr><td/>a<td/>b</table>", "a  b"), ("<table><td>a<td>b</table>c", "a  b\n\nc"), ("<table>x</table>", "x"),
    ("<table><tr><td>a</td>after</tr><tr><p>p</p><td>b</table>", "after\np\na\nb"), ("<table><tr hidden><td>a<tr><td>b</table>", "b"), ("<div hidden/>a</div>b", "b"),
])
def test_all_of_a_table(page, text):
    assert HT.text_of(page) == text


def test_deep_and_long_pages():
    assert HT.text_of("<div>" * 3000 + "x") == "x" and HT.text_of("<b>" * 3000 + "x") == "x"
    assert len(HT.text_of("<p>word " * 50_000).split()) == 50_000
    rng = random.Random(1)
    for _ in range(300):
        HT.text_of("".join(rng.choice(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<b", "'", "\"", ">", "x ", "&amp", "<!--", "-->", "<pre>", "\n", "</"]) for _ in range(60)))


@pytest.mark.parametrize("page, text", [
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"), ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>", "1 2"), ("<math><semantics><mi>x</mi><annotation>TeX</annotation></semantics></math>", "x"),
    ("<p>a<svg><title>t</title><desc>d</desc>no<text>one</text><text>two <tspan>three</tspan></text></svg>b", "a\none\ntwo three\nb"), ("<svg><style/><path d='M0'/><text>x</text></svg>y", "x\ny"),
    ("<svg><foreignObject><p>in</p></foreignObject><defs><text>no</text></defs></svg>", "in"), ("<p>a<textarea>\nx &lt; <b>\n  y</textarea>b", "a\nx < <b>\n  y\nb"), ("<xmp><b>&lt;</xmp>c", "<b>&lt;\nc"),
    ("<p>size <select>no<option>S<option selected>M<option>L</select> only", "size M only"), ("<select><option selected>a<option selected>b</select>", "b"),
    ("<select multiple><option>a<option>b</select>", "a b"), ("<select size=2><optgroup label=g><option>a</option><option>b</option></optgroup></select>", "a b"), ("<object data=x><p>fallback</p></object>", "fallback"),
    ("<table><tr><td colspan=2>wide one<td>x<tr><td>a<td>b<td>c</table>", "wide one  x\na  b      c"), ("<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td>q<td>3</table>", "r  1\n   2\nq  3"),
    ("<table><tr><td colspan=1000>t<tr><td>a<td>b</table>", "t\na  b"), ("<table><tr><td rowspan=0>r<td>1<tr><td>2</table>", "r  1\n   2"), ("<table><tr><td colspan=x>a<td>b</table>", "a  b"),
    ("<details><summary>s</summary>gone<p>gone too</details>k", "s\nk"), ("<details open><summary>s</summary>here</details>k", "s\nhere\nk"),
    ("<svg><g><p>out", "out"), ("<math><mi>x<div>out", "x\nout"), ("<select><option>a<input>out", "a out"),
    ("<textarea>never closed", "never closed"), ("<noscript>n</noscript><video>v</video><canvas>c</canvas><datalist><option>d</datalist>s", "s"), ("<textarea hidden>x</textarea>y", "y"),
])
def test_elements_that_browsers_show(page, text):
    assert HT.text_of(page) == text


@pytest.mark.parametrize("outer", ["<div>", "<blockquote>", "<ul>", "<ul><li>", "<table><tr><td>", "<table><tr>x<td>y<td>", "<dl><dd>"])
def test_blocks_stay_apart_at_any_depth(outer):
    inner = "<div>a</div><div>b</div><ol><li>c<li>d</ol><table><tr><td>e<td>f</table>"
    lines = [s.strip("- ") for s in HT.text_of(outer * 700 + inner).split("\n") if s.strip()]
    assert [w for s in lines for w in s.split() if w not in "xy-"] == ["a", "b", "1.", "c", "2.", "d", "e", "f"]


def test_deep_pages_take_linear_time():
    page = "<div>w<ul><p>v" * 30_000
    start = time.time()
    assert HT.text_of(page).split() == ["w", "v"] * 30_000 and time.time() - start < 20


def test_null_pages_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "<p>a", None), (3, "<p>a", None)], "page_id long, html string, text string")
    got = HT.extracted(df)
    assert got.columns == [*df.columns, "visible_text"]
    assert sorted((r.page_id, r.visible_text) for r in got.where("page_id <> 1").collect()) == [(2, ""), (3, "a"), (3, "a")]
    assert got.where("visible_text is null").count() == 1 and HT.extracted(df.limit(0)).count() == 0


def canonical(text):
    lines = [s for s in text.encode().lower().decode().split("\n") if not re.match(r"[\t-\r */#;-]*(copyright|\(c\)|©|all rights reserved)", s)]
    out = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", " ".join(lines)) + " "
    for a, b in LI.SPELLINGS.items():
        out = out.replace(f" {a} ", f" {b} ")
    return out.strip(" ")


def test_licences(spark):
    mit = "MIT License\n".replace("MIT License\n", "") + LI.MIT.replace("Software", "SOFTWARE").replace(". ", ".\n\n")
    texts = [None, "", "...", "nothing here", "Released under the MIT licence", "a\nb\n\n  * LICENSED under the Apache  License; version 2.0 \nc", "Copyright (c) 2020 A\n" + mit,
             "x " + mit, "para\n\nReleased under\nthe MIT License\n\nmore", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "y" * 100_000 + "\nSPDX-License-Identifier: ISC",
             "Released under the MIT License. And more on this line"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "other"), (None, texts[9]), (9, texts[9])]
    known = {}
    for name, t in LI.KNOWN:
        known.setdefault(canonical(t), set()).add(name)
    found, whole = {}, {}
    for i, t in rows:
        units = [(True, t)] + [(False, u) for u in [*re.split(r"\n[\t-\r ]*\n", t), *t.split("\n")]] if t is not None else []
        for w, u in units:
            names = known.get(canonical(u), set())
            found.setdefault(i, set()).update(names)
            whole[i] = whole.get(i, False) or (w and bool(names))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = LI.scanned(docs, LI.known_texts(spark)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    want = [(i, sorted(found.get(i, ())), whole.get(i, False)) for i, _ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert found[6] == {"MIT"} and whole[6] and not found[7] and found[8] == {"MIT"} and found[9] == {"MIT", "CC-BY-NC-4.0"} and not found[11]
    assert LI.scanned(docs.limit(0), LI.known_texts(spark)).count() == 0
    odd = spark.createDataFrame([("X", None), ("X", "!!!"), (None, "nothing here")], "licence string, text string")
    assert LI.scanned(docs, odd).where("size(licences) > 0").count() == 0


@pytest.mark.parametrize("name, file", [("MIT", "MIT"), ("ISC", "ISC"), ("Apache-2.0", "Apache-2.0"), ("BSD-3-Clause", "BSD-3-Clause"), ("GPL-2.0", "GPL-2.0"), ("MPL-2.0", "MPL-2.0")])
def test_published_licence_files(spark, name, file):
    text = (Path(LI.__file__).parent / "licence_texts" / f"{file}.txt").read_text()
    wrapped = "\n\n".join(p if re.search(r"copyright (\(c\)|\d)", p, re.I) else "\n".join(textwrap.wrap(p, 61, break_on_hyphens=False)) for p in re.split(r"\n\s*\n", text))
    got = LI.scanned(spark.createDataFrame([(1, text), (2, wrapped)], "doc_id long, text string"), LI.known_texts(spark)).collect()
    assert [(r.licences, r.whole) for r in got] == [([name], True)] * 2


def test_titles_headers_and_identifiers(spark):
    gnu = """/* Copyright (C) 2020 A

   This program is free software: you can redistribute it and/or modify
   it under the terms of the GNU General Public License as published by
   the Free Software Foundation, either version 3 of the License, or
   (at your option) any later version.

   more */"""
    apache = "\n".join(f"# {s}" for s in """Copyright 2020 A\nAll rights reserved.\n
Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at
\n    http://www.apache.org/licenses/LICENSE-2.0\n
Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.""".split("\n"))
    texts = {"MIT License\n\nCopyright (c) 2020 A\n\n" + LI.MIT: ["MIT"], "ISC License\n\nCopyright 2020 A\n\n" + LI.ISC.replace("above copyright", "above\ncopyright"): ["ISC"], gnu: ["GPL-3.0-or-later"],
             apache + "\n\nimport x": ["Apache-2.0"], "x = 1  \n# SPDX-License-Identifier: BSD-3-Clause\n": ["BSD-3-Clause"], "SPDX-License-Identifier: GPL-2.0+": ["GPL-2.0-or-later"],
             "SPDX-License-Identifier: GPL-2.0": ["GPL-2.0"], "// SPDX-License-Identifier: GPL-3.0-or-later\nint x;": ["GPL-3.0-or-later"], "SPDX-License-Identifier: none such": []}
    got = LI.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), LI.known_texts(spark)).collect()
    assert [r.licences for r in sorted(got, key=lambda r: r.doc_id)] == list(texts.values())
