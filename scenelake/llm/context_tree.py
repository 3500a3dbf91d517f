"""Language-model scores by context-tree weighting over bytes.

A text is coded as its words (A-Z lower-cased), each followed by a space, and one end mark. A byte is eight binary decisions.
The context of a decision is the bits of the byte so far and up to five bytes before it. Every context of every depth keeps a
Krichevsky-Trofimov estimate, and a node's estimate and the product of its children's are weighted half and half (Willems,
Shtarkov and Tjalkens, 1995), so the prediction of a bit mixes the estimates of all depths by how well each coded the training
corpus. A context that training never met ends the mixture at the longest one it met.

A gram is a byte with its five bytes of context. Documents are cut into chunks; a chunk sends its distinct grams with their
training counts, as sorted arrays dealt by the two nearest bytes of context, and gets back the log probability of each. What
has the same two bytes is a branch of the tree and is worked out in one group; the part above, at most 256 x 255 nodes, is
gathered. Chunks meet in a group some at a time, so a group holds distinct grams only, however large the corpus.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.scale import settle, settled

from .catalog import id_crc, query, table, utf8

DEPTH, TOP = 5, 2                                # bytes of context; bytes by which branches are grouped
PARTS, TOGETHER = 128, 64                        # groups of branches; chunks that meet in one group
CHUNK_BYTES, CHUNK_WORDS = 32 << 20, 600_000     # text and distinct words of one chunk of documents
SLICE_BYTES = 2 << 20                            # text that is taken apart into grams at a time
HELD_OUT_OF, HELD_OUT = 7, 2
END = b"\n"                                      # no word holds white space
_U = np.uint64


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of coded texts, each as one number (zeros stand before a text), and how many each text has."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(bytes(DEPTH).join([b"", *texts]), np.uint8)
    key = np.zeros(len(flat) - DEPTH, np.uint64)
    for k in range(DEPTH, -1, -1):
        key = key << _U(8) | flat[DEPTH - k:len(flat) - k]
    inside = np.ones(len(key), bool)
    starts = np.cumsum(sizes + DEPTH)[:-1] - DEPTH
    inside[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return key[inside], sizes


def sliced(texts: list[bytes]):
    """Stretches of about SLICE_BYTES as (first, last + 1)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    every, n = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(n, first) if len(first) else n


def packed(values: np.ndarray) -> bytes:
    """Numbers as byte planes, of which the high ones compress to nothing."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=_U(0)))


def unpacked_keys(data) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def part_of(keys: np.ndarray) -> np.ndarray:
    return ((keys >> _U(8) & _U((1 << 8 * TOP) - 1)) * _U(40503) >> _U(4)) % _U(PARTS)


class _Numbers(dict):
    """Numbers words in order of their first use."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


_CHUNKS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.binary()), ("word", pa.binary()), ("number", pa.int32()),
                     ("n", pa.int64()), ("part", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
_CHUNKS_DDL = "chunk long, doc_id long, held_out boolean, tokens binary, word binary, number int, n long, part int, grams binary, counts binary"


class _Chunk:
    """What a stretch of documents has: its words by number and their counts in training rows, and its grams likewise."""

    def __init__(self, name: int):
        self.name, self.numbers, self.size, self.counts, self.grams = name, _Numbers(), 0, np.zeros(0, np.int64), ([], [])

    def rows(self, **cols):
        n = len(next(iter(cols.values())))
        full = [pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _CHUNKS]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.name)), *full[1:]], schema=_CHUNKS)

    def add(self, ids, held: list[bool], texts: list[bytes]):
        tokens, coded = [], ([], [])
        for text, apart in zip(texts, held):
            words = text.lower().split()
            coded[apart].append(b" ".join(words) + b" " + END if words else END)
            words.append(END)
            at = np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words))
            if not apart:
                if len(self.numbers) > len(self.counts):
                    self.counts = np.concatenate([self.counts, np.zeros(len(self.numbers), np.int64)])
                np.add.at(self.counts, at, 1)
            tokens.append(at.view(np.uint8).reshape(-1, 4).T[:3].tobytes())
            self.size += len(text)
        for apart, some in enumerate(coded):
            for lo, hi in sliced(some):
                keys, n = np.unique(grams(some[lo:hi])[0], return_counts=True)
                self.grams[0].append(keys)
                self.grams[1].append(n * (1 - apart))
        if len(self.grams[0]) > 16:
            self.grams = tuple([x] for x in merged(*self.grams))
        return self.rows(doc_id=ids, held_out=held, tokens=tokens)

    def close(self):
        n = np.concatenate([self.counts, np.zeros(len(self.numbers), np.int64)])[:len(self.numbers)]
        words = list(self.numbers)
        for lo in range(0, len(words), 50_000):
            hi = min(lo + 50_000, len(words))
            yield self.rows(word=words[lo:hi], number=np.arange(lo, hi, dtype=np.int32), n=n[lo:hi])
        keys, counts = merged(*self.grams)
        part = part_of(keys)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(PARTS + 1))
        for k in range(PARTS):
            at = order[cuts[k]:cuts[k + 1]]
            if len(at):
                yield self.rows(part=[k], grams=[packed_keys(keys[at])], counts=[packed(counts[at])])


def _chunks(batches):
    from pyspark import TaskContext
    task, seq = TaskContext.get().partitionId(), 0
    chunk = _Chunk(task << 20)
    for b in batches:
        ids, held, texts = b.column("doc_id"), b.column("held_out").to_pylist(), b.column("__utf8")
        for lo in range(0, b.num_rows, 500):
            yield chunk.add(ids.slice(lo, 500), held[lo:lo + 500], texts.slice(lo, 500).to_pylist())
            if chunk.size > CHUNK_BYTES or len(chunk.numbers) > CHUNK_WORDS:
                yield from chunk.close()
                seq += 1
                chunk = _Chunk(task << 20 | seq)
    if chunk.numbers:
        yield from chunk.close()


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up."""
    up, y = np.ones_like(x), x + 8
    for k in range(8):
        up = up * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - np.log(up)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a block with these counts."""
    a, b = n0.astype(np.float64), n1.astype(np.float64)
    return np.where(a + b > 0, _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi), 0.0)


class Level:
    """The nodes of one depth: for each of the eight bits, the node of every gram and that node's numbers."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, below: "Level | None"):
        self.keys, self.counts, self.node, self.first, self.n, self.pe, self.pw, self.beta = keys, counts, [], [], [], [], [], []
        for j in range(8):
            tag = keys >> _U(8 - j)
            new = np.concatenate([[True], tag[1:] != tag[:-1]])
            node, first = np.cumsum(new) - 1, np.flatnonzero(new)
            one = (keys >> _U(7 - j) & _U(1)).astype(bool)
            n1, all_n = np.add.reduceat(np.where(one, counts, 0), first), np.add.reduceat(counts, first)
            n0 = all_n - n1
            pe = log_kt(n0, n1)
            if below is None:
                pw, beta = pe, np.ones(len(pe))
            else:
                parent = node[below.up[below.first[j]]]
                kids = np.bincount(parent, weights=below.pw[j], minlength=len(pe))
                pw = np.logaddexp(pe, kids) - np.log(2)
                beta = 1 / (1 + np.exp(np.clip(kids - pe, -700, 700)))
            for held, x in zip((self.node, self.first, self.n, self.pe, self.pw, self.beta), (node, first, (n0, n1), pe, pw, beta)):
                held.append(x)


def branch(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels of depth 5 to 2 of the grams of some branches; `keys` is sorted and unique."""
    levels, level = [], Level(keys, counts, None)
    levels.append(level)
    for depth in range(DEPTH - 1, TOP - 1, -1):
        short = level.keys & _U((1 << 8 * (depth + 1)) - 1)
        upper, level.up = np.unique(short, return_inverse=True)
        total = np.zeros(len(upper), np.int64)
        np.add.at(total, level.up, level.counts)
        level = Level(upper, total, level)
        levels.append(level)
    return levels


def _estimate(n0, n1, bit):
    return (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1)


def _mix(below, seen_below, n0, n1, beta, bit):
    """A node's prediction from its own estimate and that of its child, which counts only if training met it."""
    own = _estimate(n0, n1, bit)
    return np.where(seen_below, beta * own + (1 - beta) * below, own), n0 + n1 > 0


def predict(levels: list[Level], top: dict) -> np.ndarray:
    """log10 probability of the last byte of each gram."""
    leaf, out = levels[0], np.zeros(len(levels[0].keys))
    places = [np.arange(len(leaf.keys))]
    for level in levels[:-1]:
        places.append(level.up[places[-1]])
    byte, before = (leaf.keys & _U(255)).astype(np.int64), (leaf.keys >> _U(8) & _U(255)).astype(np.int64)
    for j in range(8):
        bit = (byte >> (7 - j) & 1).astype(bool)
        p, seen = np.full(len(byte), 0.5), np.zeros(len(byte), bool)
        for level, at in zip(levels, places):
            node = level.node[j][at]
            p, seen = _mix(p, seen, level.n[j][0][node], level.n[j][1][node], level.beta[j][node], bit)
        name = 1 << j | byte >> (8 - j)
        for n0, n1, beta in ((top["n0"][1][before, name], top["n1"][1][before, name], top["beta"][1][before, name]),
                             (top["n0"][0][name], top["n1"][0][name], top["beta"][0][name])):
            p, seen = _mix(p, seen, n0, n1, beta, bit)
        out += np.log10(p)
    return out


def _blocks(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return merged([unpacked_keys(x.as_buffer()) for x in t.column("grams")], [unpacked(x.as_buffer()).astype(np.int64) for x in t.column("counts")])


def _merge(key, t):
    keys, n = _blocks(t)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int64()), "grams": [packed_keys(keys)], "counts": [packed(n)]})


def _roots(t):
    """Counts and weighted probability of the two-byte context of a branch, for each of its nodes."""
    last = branch(*_blocks(t))[-1]
    out = []
    for j in range(8):
        k = last.keys[last.first[j]]
        out.append(((k >> _U(8) & _U(255)).astype(np.int32), (1 << j | (k & _U(255)) >> _U(8 - j)).astype(np.int32), *last.n[j], last.pw[j]))
    before, node, n0, n1, pw = (np.concatenate(x) for x in zip(*out))
    return pa.table({"before": before, "node": node, "n0": n0, "n1": n1, "pw": pw})


def top_of(rows) -> dict:
    """Nodes of one and no byte of context from the sums over their branches (before, node, n0, n1, pw)."""
    n0, n1, kids = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
    for before, node, a, b, pw in rows:
        n0[before, node], n1[before, node], kids[before, node] = a, b, pw
    pe = log_kt(n0, n1)
    pw = np.logaddexp(pe, kids) - np.log(2)
    m0, m1, low = n0.sum(0), n1.sum(0), pw.sum(0)
    weight = lambda own, below: 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
    return {"n0": [m0, n0], "n1": [m1, n1], "beta": [weight(log_kt(m0, m1), low), weight(pe, kids)]}


def _predictor(top):
    def run(key, t):
        keys, n = _blocks(t)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "known": [packed_keys(keys)], "lp": [predict(branch(keys, n), top.value).astype("<f4").tobytes()]})
    return run


def _answer(key, asked, model):
    """The log probabilities of the grams of some chunks."""
    known = np.concatenate([unpacked_keys(x.as_buffer()) for x in model.column("known")] or [np.zeros(0, np.uint64)])
    lp = np.concatenate([np.frombuffer(x.as_buffer(), "<f4") for x in model.column("lp")] or [np.zeros(0, "<f4")])
    out = [lp[np.searchsorted(known, unpacked_keys(x.as_buffer()))].tobytes() for x in asked.column("grams")]
    return pa.table({"chunk": asked.column("chunk"), "grams": asked.column("grams"), "lp": pa.array(out, pa.binary())})


def gram_scores(blocks: DataFrame, chunks: int) -> DataFrame:
    """chunk, grams and lp, the log10 probability of each gram under the context tree of all counts, for every block of
    `blocks` (chunk, part, grams, counts)."""
    group, tree = (lambda n: F.pmod(F.xxhash64("chunk"), F.lit(n))), blocks.select("part", "chunk", "grams", "counts")
    n = chunks
    while n > TOGETHER:
        n = -(-n // TOGETHER)
        tree = settle(tree.withColumn("g", group(n)).groupBy("part", "g").applyInArrow(_merge, "part int, chunk long, grams binary, counts binary"), "grams")
    roots = tree.groupBy("part").applyInArrow(_roots, "before int, node int, n0 long, n1 long, pw double")
    rows = roots.groupBy("before", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "pw")]).collect()      # 256 x 255 at most
    top = blocks.sparkSession.sparkContext.broadcast(top_of(rows))
    model = tree.groupBy("part").applyInArrow(_predictor(top), "part int, known binary, lp binary")
    groups = -(-chunks // TOGETHER)
    copies = model.select(F.col("part").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("h"), "known", "lp")
    asked = blocks.select("part", group(groups).alias("g"), "chunk", "grams")
    return asked.groupBy("part", "g").cogroup(copies.groupBy("p", "h")).applyInArrow(_answer, "chunk long, grams binary, lp binary")


def _totals(n_train: int, vocabulary: int):
    def run(key, docs, known):
        is_word = pa.compute.is_valid(known.column("word"))
        words, blocks = known.filter(is_word), known.filter(pa.compute.invert(is_word))
        number = words.column("number").to_numpy()
        c, names = np.zeros(len(number), np.int64), np.empty(len(number), object)
        c[number] = words.column("c").to_numpy()
        names[number] = [w if w == END else w + b" " for w in words.column("word").to_pylist()]
        base = np.log10((c + 1) / (n_train + vocabulary + 1))
        grams_known = np.concatenate([unpacked_keys(x.as_buffer()) for x in blocks.column("grams")] or [np.zeros(0, np.uint64)])
        lp = np.concatenate([np.frombuffer(x.as_buffer(), "<f4") for x in blocks.column("lp")] or [np.zeros(0, "<f4")]).astype(np.float64)
        order = np.argsort(grams_known)
        grams_known, lp = grams_known[order], lp[order]
        n, found, b, s, coded = [], [], [], [], []

        def flush():
            key, sizes = grams(coded)
            at, back = np.unique(key, return_inverse=True)
            each = lp[np.searchsorted(grams_known, at)][back]
            s.extend(np.add.reduceat(each, np.cumsum(sizes) - sizes).tolist())
            coded.clear()
        size = 0
        for planes in docs.column("tokens"):
            three = np.frombuffer(planes.as_buffer(), np.uint8).reshape(3, -1).astype(np.int64)
            at = three[0] | three[1] << 8 | three[2] << 16
            n.append(len(at))
            found.append(int(np.count_nonzero(c[at])))
            b.append(float(base[at].sum()))
            coded.append(b"".join(names[at]))
            size += len(coded[-1])
            if size > SLICE_BYTES:
                flush()
                size = 0
        if coded:
            flush()
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(found, pa.int64()),
                         "train_tokens": pa.array([n_train] * len(n), pa.int64()), "base_score": pa.array(b, pa.float64()), "score": pa.array(s, pa.float64())})
    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs` (doc_id, text).

    Null and empty texts hold the end mark alone. A null id counts as empty text in the choice of held-out rows. Rows that
    share an id are scored each; repeated rows teach as often as they come. An empty table gives no rows. If all rows are
    held out nothing is learnt: every bit costs one bit.
    """
    held = F.pmod(id_crc(), F.lit(HELD_OUT_OF)) == HELD_OUT
    parts = settle(docs.select("doc_id", held.alias("held_out"), utf8().alias("__utf8")).mapInArrow(_chunks, _CHUNKS_DDL), "chunks")
    dictionary = parts.where("word is not null").select("chunk", "word", "number", "n")
    words = settle(dictionary.groupBy("word").agg(F.sum("n").alias("c")), "words", total=F.sum("c"), vocabulary=F.count_if(F.col("c") > 0))
    n_train, vocabulary = settled(words)["total"] or 0, settled(words)["vocabulary"]
    blocks = parts.where("grams is not null").select("chunk", "part", "grams", "counts")
    chunks = blocks.select("chunk").distinct().count()
    scores = gram_scores(blocks, max(1, chunks))
    looked_up = dictionary.select("chunk", "word", "number").join(words, "word").select(F.col("chunk").alias("of"), "word", "number", "c", F.lit(None).cast("binary").alias("grams"), F.lit(None).cast("binary").alias("lp"))
    answers = scores.select(F.col("chunk").alias("of"), F.lit(None).cast("binary").alias("word"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("long").alias("c"), "grams", "lp")
    by_doc = parts.where("tokens is not null").select("chunk", "doc_id", "held_out", "tokens")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_doc.groupBy("chunk").cogroup(looked_up.unionByName(answers).groupBy("of")).applyInArrow(_totals(n_train, vocabulary), out)


@query("op10_context_tree")
def op10_context_tree(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
