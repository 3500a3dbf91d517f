"""The operators against plain versions on small tables with nulls, empty and long texts, ties, repeated rows, no rows, and
columns whose names clash."""

import hashlib
import math
import random
import tracemalloc
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scenelake.llm import catalog as CA
from scenelake.llm import contamination as CO
from scenelake.llm import context_tree as CT
from scenelake.llm import mixing as MI
from scenelake.llm import near_dups as ND
from scenelake.llm import quality as QU
from scenelake.llm import sharding as SH
from scenelake.llm import token_files as TF
from scenelake.llm import topk as TK

from . import brute, test_pages_and_licences

SCHEMA = "doc_id long, text string, source string, __row string, hit string, node long, size long, key long"


def words(rng, n, vocabulary=300):
    return [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source)"""
    rng = random.Random(3)
    out = []
    for i in range(60):
        w = words(rng, rng.randint(1, 120))
        out.append((10 * i, " ".join(w), rng.choice(["a", "b", "ä", "Z", None])))
        if i % 4 == 0:
            for k in range(3):
                v = list(w)
                for _ in range(len(v) * k // 25):
                    v[rng.randrange(len(v))] = "other"
                out.append((10 * i + k + 1, " ".join(v), "a"))
    out += [(701, None, "a"), (702, "", None), (703, " \n\t ", "b"), (704, "One", "b"), (705, "one", "b"), (None, "null id text here", "a"), (None, "null id text here", "a")]
    out += [(706, "twice the same row", "b")] * 2 + [(707, " ".join(words(rng, 30_000, 10**6)), "Z"), (708, "É ẞ   x\u0085y \x00 z", "ä")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, s, "r", "h", 1, 2, 3) for d, t, s in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, rows, empty, width):
    got = ND.near_duplicates(docs.select("doc_id", "text"), width).collect()
    want = []
    for (d, t), (n, _, name) in zip([r[:2] for r in rows], brute.components([r[:2] for r in rows], width)):
        name = d if n == 0 else name
        want.append((d, n, name, d == name))
    same(got, want)
    assert ND.near_duplicates(empty, width).count() == 0


def test_crowds_lose_no_link(spark):
    """Chains of texts that each resemble the next only, and a crowd of texts around the threshold."""
    rng = random.Random(1)
    base, out = words(rng, 100, 10**9), []
    for i in range(40):
        base = list(base)
        for _ in range(4):
            base[rng.randrange(100)] = f"x{rng.random()}"
        out.append((i, " ".join(base)))
    for i in range(40, 160):                       # neighbours in a crowd have 70 to 90 in 100 shingles in common
        near = list(base)
        for _ in range(rng.randint(1, 9)):
            near[rng.randrange(100)] = f"y{rng.random()}"
        out.append((i, " ".join(near[:rng.randint(80, 100)])))
    rng.shuffle(out)
    want = [(d, n, name, d == name) for (d, _), (n, _, name) in zip(out, brute.components(out, 2))]
    same(ND.near_duplicates(spark.createDataFrame(out, "doc_id long, text string"), 2).collect(), want)


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Members of a large group that its first comparison leaves out meet the group's centres, not all of its members."""
    rng, pairs, settle = random.Random(5), [], ND.settle

    def counting(df, name="t", **metrics):
        out = settle(df, name, **metrics)
        if name == "pairs":
            pairs.append(out._settled["rows"])
        return out
    monkeypatch.setattr(ND, "settle", counting)
    base, out = [f"b{i}" for i in range(120)], []
    for i in range(500):                           # J with the base is 0.94, 0.82 or 0.78; with each other often below 0.8
        near = list(base)
        for at in rng.sample(range(2, 118, 2), 2 if i < 350 else 6 if i < 480 else 7):
            near[at] = f"x{rng.random()}"
        out.append((i, " ".join(near)))
    out.append((500, " ".join(base)))
    rng.shuffle(out)
    want = [(d, n, name, d == name) for (d, _), (n, _, name) in zip(out, brute.components(out, 2))]
    same(ND.near_duplicates(spark.createDataFrame(out, "doc_id long, text string"), 2).collect(), want)
    assert pairs and sum(pairs) < 3 * len(out)


def test_steps_of_near_duplicates_hold_little(spark):
    """What a worker holds beside its batch: temporary arrays of a slice only, and a bounded number of words."""
    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run
    rng = np.random.default_rng(4)
    regs = rng.integers(1, 1 << 15, (10_000, ND.REGISTERS)).astype("<u2")
    regs[rng.random(regs.shape) < 0.5] = 0
    batch = pa.RecordBatch.from_pydict({"node": np.arange(len(regs)), "regs": [r.tobytes() for r in regs]})
    tracemalloc.start()
    n, total = 0, 0
    for out in ND._bands(Frame())([batch, batch.slice(0, 0)]):
        n, total = n + out.num_rows, total ^ int(np.bitwise_xor.reduce(out.column("key").to_numpy()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    row, key = ND.band_keys(regs)
    assert (n, total) == (len(row), int(np.bitwise_xor.reduce(key)))
    for words_of in (ND.Shingles(2), QU.Featuriser()):
        most = 0
        for i in range(150):
            words_of(b" ".join(b"w%d" % j for j in range(2_000 * i, 2_000 * i + 2_000)))
            most = max(most, len(words_of.known))
        assert most < 110_000


def test_workers_give_memory_back(spark, monkeypatch):
    """At the end of a task, when its step and caches are gone."""
    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    class State:
        pass
    made, seen = [], []

    def worker():
        state = State()
        made.append(weakref.ref(state))
        return lambda batch: [batch.column("x"), [id(state) > 0] * batch.num_rows]
    monkeypatch.setattr(CA, "release", lambda: seen.append(made[0]() is None))
    run = CA.mapped(Frame(), worker, "x long, y boolean", 2)
    got = [b.num_rows for b in run([pa.RecordBatch.from_pydict({"x": [1, 2, 3, 4, 5]})])]
    assert got == [2, 2, 1] and seen == [True]


def test_deduplicated(docs, rows, empty):
    got = ND.deduplicated(docs)
    assert got.columns == docs.columns
    groups = {}
    for (d, t, _), (n, root, _) in zip(rows, brute.components([r[:2] for r in rows], 5)):
        groups.setdefault(root if n else object(), []).append((d is None, d if d is not None else 0, t or ""))
    same([(r.doc_id is None, r.doc_id or 0) for r in got.collect()], [min(g)[:2] for g in groups.values()])
    assert ND.deduplicated(empty).count() == 0


def test_registers_estimate(spark):
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        n = 20_000
        both = int(2 * n * share / (1 + share))
        h = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(h[:n]), np.unique(np.concatenate([h[:both], h[n:2 * n - both]]))
        j, _ = ND.corrected(ND.registers(a)[None], ND.registers(b)[None], np.array([n]), np.array([n]))
        assert abs(j[0] - share) < 0.12


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vec = {i: [None if i == 7 and j == 3 else float(x) for j, x in enumerate(rng.normal(size=6 if i % 9 else 4))] for i in range(150)}
    vec[20] = [math.inf] + [0.0] * 5
    vec[33] = [math.nan] * 6
    vec[40] = vec[41] = vec[42] = [0.5] * 6
    data = [(i, v) for i, v in vec.items()] + [(40, vec[40]), (60, None), (None, vec[41])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    q = TK.quantised("embedding")
    got = TK.top_k(df.select("vec_id", q.alias("v")), F.col("vec_id") % 20 == 0, 5, query_tile=3, shard_tile=16).collect()
    ints = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in vec.items() if v and all(x is not None and math.isfinite(x) for x in v)}
    ints[60] = ints.get(60)
    want = []
    for i in (i for i in ints if i % 20 == 0 and ints[i]):
        s = sorted((-sum(a * b for a, b in zip(ints[i], ints[j])), j) for j in ints if j != i and ints[j])[:5]
        want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    same(got, want)
    assert TK.top_k(df.select("vec_id", q.alias("v")).where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    big = np.array([[2**40, 3], [-(2**41), 1]])
    assert (TK.products(big, big[:, ::-1].copy()) == [[2**40 * 3 * 2, 2**40 - 3 * 2**41], [2**40 - 3 * 2**41, -(2**42)]]).all()
    assert sorted(TK.best(np.array([[5, 5, 5, 1]]), 2)[0]) == [0, 1]


def test_token_files(docs, rows, empty, spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TF.public_tokenizer())
    got = sorted(map(tuple, TF.token_index(docs, TF.public_tokenizer()).collect()), key=lambda r: r[1])
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    same([(d, n, c) for d, _, n, c in got], [(d, len(ids(t)) // 4, zlib.crc32(ids(t))) for d, t, _ in rows])
    assert [s for _, s, _, _ in got] == [0, *np.cumsum([n for _, _, n, _ in got])[:-1]]
    order = [(d is not None, d or 0) for d, _, _, _ in got]
    assert order == sorted(order)
    assert TF.token_index(empty, TF.public_tokenizer()).count() == 0
    folder, manifest = TF.write_token_files(docs, TF.public_tokenizer(), file_ids=500)
    assert manifest.count() > 20
    back = TF.read_token_files(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    same([r for r in map(tuple, back.collect()) if r[0] not in (None, 706)], [r for r in got if r[0] not in (None, 706)])


def test_elias_fano():
    rng = np.random.default_rng(4)
    for steps in ([0], [5], [0, 0, 0], rng.integers(0, 3, 5000), rng.integers(0, 10**6, 3000), [0] * 2000 + [10**9] + [0] * 2000):
        v = np.cumsum([0, *steps])
        ef = TF.EliasFano.of(v)
        assert (ef.select(np.arange(len(v))) == v).all()
        assert len(ef.low) + len(ef.high) + 4 * len(ef.ones) <= len(v) * (2.2 + max(0, math.log2(max(1, v[-1] / len(v))))) / 8 + 32


def test_words_are_the_tokenizers():
    from tokenizers import Tokenizer
    tok, enc = Tokenizer.from_file(TF.public_tokenizer()), TF.WordTokens(TF.public_tokenizer(), keep=10)
    texts = ["it's DON'T 'sé l'été it'll x'''s", "ΣΑΣ Σ İx ﬁ 日本語。 a b–c «ab» x_y a1b22 ½ Ⅷ é ŉ ß ẞ", "<|endoftext|> a <|startoftext|>b", "\x1c a\x85b 　 ​", "", " "]
    assert enc.encode([t.encode() for t in texts]) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_words_are_looked_up_once():
    """However often a word comes up in the texts given together; ids, white space, marks and invalid bytes as before."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    class Counted(dict):
        def __getitem__(self, word):
            asked.append(word)
            return dict.__getitem__(self, word)
    tok, enc, asked = Tokenizer.from_file(TF.public_tokenizer()), TF.WordTokens(TF.public_tokenizer()), []
    enc.known = Counted()
    texts = [b" One two, " * 500, b"", b"\n", b"two, <|x|> \xff\xfe \x1c one", b"a <|endoftext|> b", b"one " * 500]
    want = [np.array(tok.encode(t.decode(errors="replace"), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode(texts) == want and len(asked) < 50
    assert enc.encode(pa.array([b"left out", *texts], pa.binary()).slice(1)) == want
    assert enc.encode([b"", b" "]) == [b"", b""] and enc.encode([]) == []


def test_slices_of_texts():
    import pyarrow as pa
    cut = lambda sizes, size: TF._slices(pa.array([b"x" * n for n in sizes], pa.binary()), size)
    assert cut([], 4) == [] and cut([0, 0, 0], 4) == [(0, 3)] and cut([1, 2, 3, 50, 0, 1], 4) == [(0, 3), (3, 4), (4, 6)] and cut([4, 4], 4) == [(0, 1), (1, 2)]


def test_contamination(spark, docs, rows, empty):
    rng = random.Random(9)
    long_text = next(t for d, t, _ in rows if d == 707).split()
    items = [(1, " ".join(long_text[100:140])), (2, "W5 w1"), (3, "one"), (4, None), (5, "?!"), (6, " ".join(words(rng, 20))), (7, " ".join(long_text[130:143])), (7, " ".join(long_text[130:143])), (None, "null id text here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("null" if i is None else i, t or "") for i, t in items]
    want = []
    for d, t, _ in rows:
        n, hit, names = brute.hits(t, named)
        want.append((d, n, hit, ",".join(names), hit > 0 and 20 * hit >= n))
    for size in (1 << 20, 40):
        got = CO.contamination(docs.drop("hit"), bench, batch_bytes=size)
        same(got.select("doc_id", "hit.n_words", "hit.n_hit", F.array_join("hit.items", ","), "hit.contaminated").collect(), want)
    clean = CO.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    same(clean.select("doc_id").collect(), [(d,) for d, *_, bad in want if not bad])
    assert CO.contamination(docs.drop("hit"), bench.limit(0)).where("hit.n_hit > 0").count() == 0
    assert CO.decontaminated(empty, bench).count() == 0


def test_mixing(docs, rows, empty):
    want = [(d, n, total, target, n * taken, taken) for (d, _, _), (n, total, target, taken) in zip(rows, brute.mix(rows))]
    got = MI.mix_report(docs)
    same([(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got.collect()], [(*w[:3], round(w[3], 6), w[4]) for w in want])
    out = MI.mixed(docs)
    assert out.columns == docs.columns
    have = Counter(r.doc_id for r in out.collect())
    need = Counter()
    for w in want:
        need[w[0]] += w[5]
    assert have == +need
    assert MI.mixed(empty).count() == 0 and MI.mix_report(empty).count() == 0


def test_two_pass_shuffle(docs, rows, empty, monkeypatch):
    plain = docs.select("doc_id", "text")
    for size in (SH.BUCKET_BYTES, 2_000):
        out = SH.two_pass_shuffle(plain, 5, bucket_bytes=size).collect()
        same([(r.doc_id, r.text) for r in out], [r[:2] for r in rows])
        for s in range(5):
            slots = sorted(r.slot for r in out if r.shard == s)
            assert slots == list(range(len(slots)))
        assert sorted(map(str, out)) == sorted(map(str, SH.two_pass_shuffle(plain.repartition(3), 5, bucket_bytes=size).collect()))
        by = [r.doc_id for r in sorted((r for r in out if r.shard == 0 and r.doc_id), key=lambda r: r.slot)]
        assert by != sorted(by)
    assert SH.two_pass_shuffle(empty.select("doc_id", "text"), 5).count() == 0
    keys = np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)
    a, b = SH.jump(keys, 40), SH.jump(keys, 41)
    assert ((a == b) | (b == 40)).all() and np.bincount(a, minlength=40).std() < 40 and 300 < (b == 40).sum() < 700
    assert sorted(SH.fisher_yates(50, np.random.default_rng(1))) == list(range(50))


def test_quality(spark, docs, empty):
    rng = random.Random(5)
    text = lambda good: " ".join(w if good else w + rng.choice(["###", "!!"]) for w in words(rng, 60))
    data = [(i, text(i % 4 > 0), int(i % 4 > 0)) for i in range(400)]
    some = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (3, None), (1, 1)], "doc_id long, quality int")
    w = QU.train(some, labels)
    got = {r.doc_id: r.quality_score for r in QU.scored(some, w).collect()}
    held = [(i, y) for i, _, y in data if brute.crc(i) % 3 == 1]
    assert len(held) > 80 and np.mean([(got[i] >= 0.5) == y for i, y in held]) > 0.97
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (QU.train(some, flipped) == w).all()                            # held-out labels are never read
    scored = QU.scored(docs.select("doc_id", "text"), w).collect()
    assert all(0 <= r.quality_score <= 1 for r in scored)
    kept = QU.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert QU.good_documents(empty, labels).count() == 0
    nothing = QU.train(some, labels.limit(0))
    assert {r.quality_score for r in QU.scored(some, nothing).collect()} == {0.5}


def plain_tree(train, texts):
    """log10 probabilities by walking a context tree that is held as dictionaries."""
    pad, depth = bytes(CT.DEPTH), CT.DEPTH
    count = Counter()

    def bits(t):
        for i, byte in enumerate(t):
            ctx = (pad + t)[i:i + depth]
            for j in range(8):
                yield ctx, (1 << j) | byte >> (8 - j), byte >> (7 - j) & 1
    for t in train:
        for ctx, node, bit in bits(t):
            for d in range(depth + 1):
                count[ctx[depth - d:], node, bit] += 1
    nodes, kids = {k[:2] for k in count}, {}
    for ctx, node in nodes:
        if ctx:
            kids.setdefault((ctx[1:], node), []).append((ctx, node))

    def kt(n0, n1):
        return math.lgamma(n0 + .5) + math.lgamma(n1 + .5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)
    weight, beta = {}, {}
    for s in sorted(nodes, key=lambda s: -len(s[0])):
        pe = kt(count[*s, 0], count[*s, 1])
        if len(s[0]) == depth:
            weight[s], beta[s] = pe, 1.0
        else:
            low = sum(weight[k] for k in kids[s])
            weight[s] = np.logaddexp(pe, low) - math.log(2)
            beta[s] = 1 / (1 + math.exp(min(700, low - pe)))
    out = []
    for t in texts:
        total = 0.0
        for ctx, node, bit in bits(t):
            p, seen = 0.5, False
            for d in range(depth, -1, -1):
                s = (ctx[depth - d:], node)
                if s in nodes:
                    own = (count[*s, bit] + .5) / (count[*s, 0] + count[*s, 1] + 1)
                    p, seen = beta[s] * own + (1 - beta[s]) * p if seen else own, True
            total += math.log10(p)
        out.append(total)
    return out


def test_leader_updates_are_the_plain_ones():
    """FTRL-proximal written out with a dictionary per coordinate."""
    rng = random.Random(7)
    rows = [(np.array(sorted(rng.sample(range(16), k)), np.int64), np.array([rng.random() for _ in range(k)]), rng.randint(0, 1)) for k in (rng.randint(0, 6) for _ in range(80))]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.1
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(3):
        for at, x, y in rows:
            given = [*zip(at.tolist(), x.tolist()), (16, 1.0)]
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in given)))
            for i, v in given:
                g, w = (p - y) * v, weight(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w
                n[i] += g * g
    got = QU.follow_the_leader(rows, bits=4, rounds=3, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert np.allclose(got, [weight(i) for i in range(17)], atol=1e-12)


def test_every_operator_has_sql_or_a_plain_version():
    """Queries without SQL, and the tests that hold them against a plain version, an exact round trip or exact laws."""
    from scenelake.llm import queries
    plain = {"op3_token_files": test_token_files, "op5_quality_classifier": test_leader_updates_are_the_plain_ones, "op6_shard_two_pass": test_two_pass_shuffle,
             "op8_html_text": test_pages_and_licences.test_layout, "op10_context_tree": test_context_tree}
    assert set(queries.QUERIES) == set(queries.ORACLE) | set(plain)



def test_context_tree(spark, docs, rows, empty, monkeypatch):
    short = [(d, t) for d, t, _ in rows if d != 707]
    coded = [b"".join(w + b" " for w in brute.low(t).split()) + b"\n" for _, t in short]
    held = [brute.crc(d) % 7 == 2 for d, _ in short]
    train = [c for c, h in zip(coded, held) if not h]
    scores = plain_tree(train, coded)
    count = Counter(w for (_, t), h in zip(short, held) if not h for w in [*brute.low(t).split(), b"\n"])
    n, v = sum(count.values()), len(count)
    want = []
    for (d, t), h, s in zip(short, held, scores):
        tokens = [*brute.low(t).split(), b"\n"]
        want.append((d, h, len(tokens), sum(count[w] > 0 for w in tokens), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens), 6), round(s, 3)))
    part = docs.where("doc_id is null or doc_id <> 707").select("doc_id", "text")
    tidy = lambda df: [(*r[:5], round(r[5], 6), round(r[6], 3)) for r in df.collect()]
    same(tidy(CT.score_documents(part)), want)
    monkeypatch.setattr(CT, "TOGETHER", 2)                                 # more chunks than meet in one group
    same(tidy(CT.score_documents(part)), want)
    assert CT.score_documents(empty.select("doc_id", "text")).count() == 0
    one = spark.createDataFrame([(i, "a b") for i in range(200) if brute.crc(i) % 7 == 2][:3], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known, round(r.score, 6)) for r in CT.score_documents(one).collect()} == {(0, 0, round(-5 * 8 * math.log10(2), 6))}


def test_digest_of_no_items(spark, docs):
    bench = spark.createDataFrame([(1, "nowhere to be found")], "item_id long, text string")
    assert CO.contamination(docs.drop("hit"), bench).where(F.size("hit.items") > 0).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), ",").cast("binary"), 256)).first()[0]


def test_pieces_of_a_large_bucket_are_random(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        docs = spark.range(4000).selectExpr("id as doc_id", "cast(null as string) as text")
        rows = SH.two_pass_shuffle(docs, 1, bucket_bytes=1000).orderBy("slot").collect()
    finally:
        spark.conf.set(key, before)
    ids = [r.doc_id for r in rows]
    assert sorted(ids) == list(range(4000)) and [r.slot for r in rows] == list(range(4000))
    assert abs(sum(ids[:2000]) / 2000 - 2000) < 150 and abs(sum(ids[2000:]) / 2000 - 2000) < 150
