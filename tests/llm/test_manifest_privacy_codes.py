"""Merkle manifest, personal data and vector codes against plain versions: nulls, empty and long texts, ties, repeated rows, no rows,
columns whose names clash."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.llm import merkle as ME
from scenelake.llm import privacy as PR
from scenelake.llm import vector_codes as VC

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, leaf_ string, size long, `__row` string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, at):
    """Root of `nodes` and the siblings of node `at` as (left, right) of each level."""
    path = []
    while len(nodes) > 1:
        lo = at - at % 8
        path.append((nodes[lo:at], nodes[at + 1:lo + 8]))
        nodes, at = [sha(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)], at // 8
    return nodes[0], path


def plain_manifest(rows, changed):
    """For rows (doc_id, text, lang): sorted (doc_id, leaf, subroot, root, proof, folded root)."""
    trees = {}
    for d, t, g in rows:
        trees.setdefault(g, []).append((d is not None, d or 0, plain_leaf(d, g, t), plain_leaf(d, g, changed(d, t)), d))
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    tops = [climb([x[2] for x in sorted(trees[g])], 0)[0] for g in names]
    out = []
    for k, g in enumerate(names):
        nodes = [x[2] for x in sorted(trees[g])]
        for i, (_, _, leaf, claimed, d) in enumerate(sorted(trees[g])):
            subroot, path = climb(nodes, i)
            root, above = climb(tops, k)
            for left, right in path + above:
                claimed = sha(*left, claimed, *right)
            out.append((d, leaf, subroot, root, "".join("".join(a) + "".join(b) for a, b in path + above), claimed))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest(spark, height):
    """Trees of one row, of one superblock and of several layers of them."""
    rng = random.Random(height)
    rows = [(i, f"Text {i} É" if i % 5 else [None, "", "a" * 200_000][i % 3], "en") for i in range(601)]
    rows += [(1000 + i, "X", "de") for i in range(9)] + [(2000, "lone", None), (2001, None, ""), (None, "no id", "de"), (3, "Twice", "fr"), (3, "Twice", "fr"), (4, "tie", "fr"), (4, "Tie", "fr")]
    rows += [(3000 + i, "t", f"l{i}") for i in range(9)]
    rng.shuffle(rows)

    def changed(d, t):
        return t if d is None or d % 3 else t and t.lower()
    df = spark.createDataFrame([(d, t, g, "s", 1, "x", 5, "y", 6, "z") for d, t, g in rows], SCHEMA).repartition(7)
    got = ME.merkle_manifest(df, "doc_id", "lang", [F.col(c) for c in ("doc_id", "lang", "text")],
                             [F.col("doc_id"), F.col("lang"), F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))], height).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got), key=str) == plain_manifest(rows, changed)
    assert {r.lang for r in got} == {g for _, _, g in rows}


def test_manifest_of_little(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ME.merkle_manifest(none, "doc_id", "lang", [F.col("text")]).count() == 0
    one = ME.merkle_manifest(spark.createDataFrame([(1, None, None, "s", 1, "", 1, "", 1, "")], SCHEMA), "doc_id", "lang", [F.col("text")]).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("-") and one.proof == ""


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


CHECKS = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": lambda v: 14 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v)),
          "phone": lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15}


def plain_spans(text):
    return sorted((m.start(), k, m.end(), m.group()) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text or "") if CHECKS[kind](m.group()))


def test_base_spans(spark):
    rng = random.Random(9)
    pieces = ["a", "x.y", "@", ".", "..", "_", "%", "+", "-", " ", "\n", "(", ")", "é", "𝒳", "0", "1", "25", "255", "256", "007", "4111 1111 1111 1111", "4111111111111111", "378282246310005", "+1 (743) 555-3824",
              "me@mail.example.com", "10.0.0.1", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "a@b.co_x@d.ef", "a@b.co.@d.ef"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(3_000)]
    long = ["9" * 300_000, "a" * 300_000]        # none in these, though Python's own search takes hours to find out
    texts += [None, "", *long, "a@" + "b." * 20_000 + "c", "+1" + " 2" * 20_000, "1.2.3.4 " * 3_000, "é@mail.de", "+12345678901 " * 2_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").repartition(8)
    got = {r.i: [(s.start, s.kind, s.end, s.value) for s in r.s] for r in df.select("i", PR.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ([] if t in long else plain_spans(t)), (i, (t or "")[:200])


def test_terms_that_disclose(spark):
    """A nickname that only goes with one address is removed, a village whose stem is common is generalised, common words stay."""
    rng = random.Random(4)
    common = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(80)] + ["kirchberg", "kirchheim", "kirsche"]

    def filler(n):
        return " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, filler(200)) for i in range(120)]
    rows += [(200 + i, f"{filler(15)} Zorbax of Kirchlein wrote from zb@mail.example.org {filler(15)}") for i in range(6)]
    rows += [(300, "nobody but zorbax, kirchlein! " + filler(60)), (301, None), (302, ""), (303, "Zorbax@home.example"), (304, filler(10)), (304, filler(10))]
    docs = spark.createDataFrame([(d, t, "p", "b") for d, t in rows], "doc_id long, text string, base string, term string").repartition(4)
    got = {r.doc_id: r for r in PR.personal_data(docs).collect()}
    assert PR.personal_data(docs).count() == len(rows) and got[304].base == "p"
    what = {(s.value.lower(), PR.KINDS[s.kind]) for r in got.values() for s in r.private.spans if s.kind > 3}
    assert ("zorbax", "removed") in what and ("kirchlein", "general") in what and not any(v.startswith("word") for v, _ in what)
    assert got[300].private.text.startswith("nobody but <TERM>, kir*! ")
    assert [(s.kind, s.value) for s in got[303].private.spans] == [(0, "Zorbax@home.example")] and got[303].private.text == "<EMAIL>"
    assert got[301].private.spans == [] and got[301].private.text == "" and got[302].private.text == ""
    for d, t in rows:
        for s in got[d].private.spans if d != 304 else []:
            assert t[s.start:s.end] == s.value


def test_no_corpus_no_disclosure(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert PR.personal_data(empty).count() == 0
    copies = spark.createDataFrame([(i, "unique words around me@mail.example.org here") for i in range(50)], "doc_id long, text string")
    assert all([s.kind for s in r.private.spans] == [0] for r in PR.personal_data(copies).collect())   # copies are one surrounding


def plain_codes(rows, parts, entries=256, rounds=4):
    """For rows (key, vector): sorted (key, code, error) and the codebooks, by plain loops."""
    rows = [r for r in rows if r[1] is not None]
    width = -(-max([1, *(len(v) for _, v in rows)]) // parts) * parts
    rows = [(k, [*v, *[0] * (width - len(v))]) for k, v in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w, books, codes, errors = width // parts, [], ["" for _ in rows], [0] * len(rows)
    for p in range(parts):
        book, x = [v[p * w:(p + 1) * w] for _, v in first], [v[p * w:(p + 1) * w] for _, v in rows]

        def nearest(y):
            return min((sum((a - b) ** 2 for a, b in zip(y, e)), i) for i, e in enumerate(book))
        for _ in range(rounds if rows else 0):
            own = [nearest(y)[1] for y in x]
            for i in range(len(book)):
                mine = [y for y, o in zip(x, own) if o == i]
                if mine:
                    book[i] = [sum(c) // len(mine) for c in zip(*mine)]
        for j, y in enumerate(x):
            e, i = nearest(y)
            codes[j] += f"{i:02x}"
            errors[j] += e
        books.append(book)
    return sorted(zip((str(k) for k, _ in rows), codes, errors)), [[int(c) for c in e] for b in books for e in b]


@pytest.mark.parametrize("parts,entries,size,spread", [(4, 256, 400, 60), (3, 9, 700, 4), (2, 5, 300, 2 ** 25), (4, 256, 1, 10), (4, 256, 0, 1), (1, 3, 200, 0)])
def test_vector_codes(spark, parts, entries, size, spread):
    rng = np.random.default_rng(size)
    centres = rng.integers(-9 * spread, 9 * spread + 1, (6, 7))
    rows = [(int(i), [int(c) for c in centres[i % 6] + rng.integers(-spread, spread + 1, 7)]) for i in rng.permutation(size)]
    if size > 100:
        rows += [(None, [1, 2, 3]), (5, rows[0][1]), (5, rows[1][1]), (7, None), (900, []), rows[2], rows[2]]
    df = spark.createDataFrame([(k, v, "c", 1.0) for k, v in rows], "vec_id long, v array<bigint>, trees string, n double").repartition(3)
    out, books = VC.vector_codes(df, "v", "vec_id", parts, entries)
    want, plain = plain_codes(rows, parts, entries)
    assert sorted((str(r.vec_id), r.code, r.error) for r in out.collect()) == want
    assert [[int(c) for c in e] for b in books for e in b] == plain
    assert out.columns == ["vec_id", "trees", "n", "code", "error"]


def test_balls_are_owned_whole():
    """On clustered points most points are never compared one by one."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-10_000, 10_000, (40, 8))
    x = centres[rng.integers(0, 40, 8_000)] + rng.integers(-30, 30, (8_000, 8))
    tree = VC.Tree(x)
    balls, _ = VC.owners(tree, VC.numbers(centres))
    assert sum(int(tree.count[n]) for n, _ in balls) > 7_000
    code, error = VC.assigned(tree, VC.numbers(centres))
    d = VC.squares(VC.numbers(x), VC.numbers(centres))
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
