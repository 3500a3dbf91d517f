"""Near-duplicate documents by HyperMinHash signatures, banding, corrected estimates and exact confirmation.

A document is its set of distinct word shingles. One pass over the text gives a hash of each shingle; the hash range is cut
into 320 buckets and the smallest hash in each is kept in 16 bits: its number of leading zeros and ten bits of mantissa (Yu
and Weber, 2017). Documents with equal sets are one class, and classes go on alone, so groups of copies cost nothing.

Empty buckets borrow from full ones for the purpose of banding. Five neighbouring registers are a band. Two sets of similarity 0.8 agree in a band with probability about a third, so that
they share none of 64 bands with probability below 1e-11. Classes that share a band are compared in two steps:

1. each class with the smallest class of every band it is in. This is linear, and it joins large groups of near copies;
2. classes in bands that still hold several components, by a prefix join on their rarest shingles, which is exact: in a crowd of texts that
   resemble each other too little, the shingles of their own fill the prefixes, and few pairs are left to compare. The most typical members
   of a large component go first, so that a class that links with one of them isn't compared with all others.

A pair is confirmed on the full sets if its estimate, corrected for equal registers of different hashes, is not six standard
deviations below the wanted similarity.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.operators.components import _stars
from scenelake.scale import attach, settle, settled, skew_join

from .catalog import discard, mapped, query, table, utf8

BANDS, ROWS, MANTISSA = 64, 5, 10
REGISTERS = BANDS * ROWS
SIGMAS = 6.0
ATTEMPTS = 64
SLICE_ROWS = 1_000                                # rows that a step in Python lays out at once: banding takes some 15 KB for each
CENTRES, CENTRE_ROWS = 4, 25_000                  # a cell's centres take some 300 bytes, so fewer cells than of plain statistics are broadcast
_U = np.uint64
_WALK = np.random.default_rng(20_170).integers(0, REGISTERS, (ATTEMPTS, REGISTERS))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


class Shingles:
    """Sorted distinct 64-bit hashes of the word shingles of texts; hashes of words are kept up to a bound."""

    def __init__(self, width: int, keep: int = 100_000):
        self.width, self.keep, self.known = width, keep, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words, known = text.lower().split(), self.known
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > self.keep:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        acc = np.full(len(words) - width + 1, width, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(width):
                acc = acc * _U(0x9E3779B97F4A7C15) + h[j:len(words) - width + 1 + j]
            return np.unique(_mixed(acc))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 320 registers of a sorted set: 0 for an empty bucket, else 1 + leading zeros and mantissa of its smallest hash."""
    spread = (hashes >> _U(32)) * _U(REGISTERS)
    bucket = (spread >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    m, e = np.frexp((spread[first] & _U(0xFFFFFFFF)).astype(np.float64))
    out = np.zeros(REGISTERS, "<u2")
    out[bucket[first]] = 1 + ((32 - e) << MANTISSA) + np.where(m > 0, (2 * m - 1) * (1 << MANTISSA), 0).astype(np.int64)
    return out


def corrected(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of rows of registers and how many buckets it rests on. Different minima share a register
    with a chance of about 0.7213 * na * nb / (na + nb)^2 / 2^mantissa, which is taken out."""
    used = ((a > 0) | (b > 0)).sum(1)
    share = ((a == b) & (a > 0)).sum(1) / np.maximum(used, 1)
    by_chance = 0.7213 / (1 << MANTISSA) * na * nb / np.maximum(na + nb, 1.0) ** 2
    return (share - by_chance) / (1 - by_chance), used


def densified(regs: np.ndarray) -> np.ndarray:
    """Registers without empty ones: an empty bucket takes the value of the first full one on its own fixed random walk
    (Shrivastava, 2017), after ATTEMPTS steps that of the next full one in order. So a register of a short document, too,
    agrees with probability equal to the similarity, and its bands are as selective as those of a long one."""
    full, out = regs, regs.copy()
    for step in range(ATTEMPTS):
        row, col = np.nonzero(out == 0)
        if not len(row):
            return out
        out[row, col] = full[row, _WALK[step][col]]
    here = np.where(full > 0, np.arange(REGISTERS), 1 << 20)
    after = np.minimum.accumulate(np.concatenate([here, here + REGISTERS], 1)[:, ::-1], 1)[:, ::-1][:, :REGISTERS] % REGISTERS
    row, col = np.nonzero(out == 0)
    out[row, col] = full[row, after[row, col]]
    return out


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band of the densified registers."""
    r = densified(regs).reshape(-1, BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            acc = _mixed(acc * _U(0x9E3779B97F4A7C15) + r[:, :, j])
    row, band = np.nonzero(r.any(2))
    return row, acc[row, band].view(np.int64)


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return tuple(int(v) for v in np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), "<i8"))


def _signer(width: int):
    def start():
        shingles = Shingles(width)

        def step(batch):
            n, c1, c2, regs, own = [], [], [], [], []
            for key, text in zip(batch.column("doc_id"), batch.column("__utf8")):
                t = text.as_py()
                h = shingles(t)
                n.append(len(h))
                d = _fingerprint(h) if len(h) else (None, None)
                c1.append(d[0])
                c2.append(d[1])
                regs.append(registers(h).tobytes() if len(h) else None)
                own.append(None if key.is_valid else t)
            return [batch.column("doc_id"), batch.column("rid"), n, c1, c2, regs, own]
        return step
    return start


def _bander():
    def step(batch):
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
        row, key = band_keys(regs)
        return [key, batch.column("node").to_numpy()[row]]
    return step


def _bands(classes: DataFrame) -> DataFrame:
    """key and node of every band of every class."""
    return mapped(classes.select("node", "regs"), _bander, "key long, node long", SLICE_ROWS)


def _plausible(least: float):
    def start():
        def step(batch):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
            j, used = corrected(a, b, na, nb)
            keep = pa.array(j >= least - SIGMAS * np.sqrt(least * (1 - least) / np.maximum(used, 1)))
            return [batch.column("u").filter(keep), batch.column("v").filter(keep)]
        return step
    return start


def _confirmer(width: int, percent: int):
    def start():
        shingles, held = Shingles(width), {}

        def of(node, text):
            if node not in held:
                if len(held) > 64:
                    held.clear()
                held[node] = shingles(text)
            return held[node]

        def step(batch):
            keep = []
            for u, v, tu, tv in zip(*(batch.column(c) for c in ("u", "v", "tu", "tv"))):
                a, b = shingles(tu.as_py()), of(v.as_py(), tv.as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            return [batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("u", "v")]
        return step
    return start


def _linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of `pairs` (u, v) whose full sets are similar enough."""
    end = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{'a' if c == 'u' else 'b'}"), F.col("regs").alias(f"r{'a' if c == 'u' else 'b'}"))
    sized = pairs.join(end("u"), "u").join(end("v"), "v").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    likely = settle(mapped(sized, _plausible(percent / 100), "u long, v long", SLICE_ROWS), "likely")
    needed = texts.join(likely.select(F.col("u").alias("node")).union(likely.select("v")).distinct(), "node", "left_semi")
    needed = mapped(needed, _same_set(width), "node long, t binary", SLICE_ROWS).dropDuplicates(["node"])
    full = likely.join(needed.select(F.col("node").alias("u"), F.col("t").alias("tu")), "u").join(needed.select(F.col("node").alias("v"), F.col("t").alias("tv")), "v")
    links = settle(mapped(full, _confirmer(width, percent), "u long, v long", SLICE_ROWS), "links")
    discard(likely)
    return links


def _open_classes(crowd: DataFrame, roots: DataFrame | None) -> DataFrame:
    """node and part (its component so far) of the classes in bands that still hold several components."""
    at = crowd.select("key", "node")
    if roots is not None:
        at = at.join(roots.select(F.col("label").alias("node"), "root"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("part"))
    else:
        at = at.withColumn("part", F.col("node"))
    at = settle(at, "parts")
    mixed = at.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("key")
    out = settle(at.join(mixed, "key", "left_semi").select("node", "part").distinct(), "open")
    discard(at)
    return out


def _setter(width: int):
    """The shingle hashes of those texts that have their class's set: rows that share a doc_id may differ."""
    def start():
        shingles = Shingles(width)

        def step(batch):
            sets = [shingles(t.as_py()) for t in batch.column("t")]
            keep = pa.array([_fingerprint(h)[1] == c.as_py() for h, c in zip(sets, batch.column("c2"))], pa.bool_())
            return [*(batch.column(c).filter(keep) for c in ("node", "part")), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64())).filter(keep)]
        return step
    return start


def _prefixes(open_: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """h, node, part, size, own, place and indexed of the rarest shingles of each open class.

    Each set is ordered by how rare its shingles are among the open classes. Of two sets with at least `percent` in common the
    larger one's first n - ceil(percent n / 100) + 1 shingles and the smaller one's first n - ceil(2 percent n / (100 + percent)) + 1 share one, at places
    that leave enough for the rest (Xiao et al., PPJoin, 2008), so no pair is lost. A shingle that no other open class has (`own` of them) counts for
    the places only and is never joined.
    """
    sets = mapped(texts.join(open_, "node").select("node", "part", "c2", "t"), _setter(width), "node long, part long, h array<long>", SLICE_ROWS).dropDuplicates(["node"])
    sets = settle(sets, "sets")
    tokens = sets.select("node", F.explode("h").alias("h"))
    rarity = settle(tokens.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "rarity", peak=F.max("n"))
    shared = skew_join(tokens, rarity, ["h"], counts=rarity).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("s"))
    size = F.col("size")
    probe = size - F.ceil(size * percent / 100) + 1
    index = size - F.ceil(size * (2 * percent) / (100 + percent)) + 1
    ordered = shared.join(sets.select("node", "part", F.size("h").alias("size")), "node").withColumn("own", size - F.size("s"))
    first = ordered.select("node", "part", "size", "own", index.alias("index"), F.posexplode(F.slice("s", F.lit(1), F.greatest(probe - F.col("own"), F.lit(0)).cast("int"))).alias("i", "s"))
    first = first.select(F.col("s.h").alias("h"), "node", "part", "size", "own", (F.col("own") + F.col("i")).alias("place"), (F.col("own") + F.col("i") < F.col("index")).alias("indexed"))
    first = settle(first, "prefixes")
    discard(sets, rarity)
    return first


def _may_link(percent: int):
    """Condition on rows `l` and `r` of `_prefixes` that share a shingle; a pair of similar sets meets it at their first common one."""
    larger = (F.col("l.size") > F.col("r.size")) | ((F.col("l.size") == F.col("r.size")) & (F.col("l.node") > F.col("r.node")))
    able = F.when(larger, F.col("r.indexed")).otherwise(F.col("l.indexed")) & (100 * F.least("l.size", "r.size") >= percent * F.greatest("l.size", "r.size"))
    enough = F.least(F.col("l.size") - F.col("l.place"), F.col("r.size") - F.col("r.place")) * (100 + percent) >= percent * (F.col("l.size") + F.col("r.size"))
    return able & enough


def _new_pairs(met: DataFrame, done: DataFrame) -> DataFrame:
    pairs = met.select(F.greatest("l.node", "r.node").alias("u"), F.least("l.node", "r.node").alias("v")).distinct()
    return settle(pairs.join(done, ["u", "v"], "left_anti"), "pairs")


def _centre_pairs(first: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """In each shingle's cell the members of other components with the centres of the largest one: at most CENTRES rows a prefix row.

    Centres are the members with the fewest shingles of their own. In a group of near copies they are the nearest to what all
    are copies of, so a member that links with any of the group mostly links with them.
    """
    seed = F.pmod(F.xxhash64("node"), F.lit(CENTRES))
    best = first.groupBy("h", "part", seed.alias("seed")).agg(F.count("*").alias("n"), F.min(F.struct("own", "node", "size", "place", "indexed")).alias("c"))
    parts = best.groupBy("h", "part").agg(F.sum("n").alias("n"), F.min("c.own").alias("own"), F.array_sort(F.collect_list("c")).alias("cs"))
    cells = parts.groupBy("h").agg(F.max(F.struct("n", (-F.col("own")).alias("own"), "part", "cs")).alias("m"), F.count("*").alias("parts"))
    cells = settle(cells.where("parts > 1").select("h", F.col("m.part").alias("largest"), F.col("m.cs").alias("cs")), "centres")
    near = attach(first, cells, ["h"], broadcast_rows=CENTRE_ROWS).where("part <> largest").select(F.struct("node", "size", "place", "indexed").alias("l"), F.explode("cs").alias("r"))
    out = _new_pairs(near.where(_may_link(percent)), done)
    discard(cells)
    return out


def _crossing_pairs(first: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components. In each shingle's cell the members of its largest component meet those of other components, not each other."""
    cells = first.groupBy("h", "part").agg(F.count("*").alias("n")).groupBy("h").agg(F.max(F.struct("n", "part")).alias("m"), F.count("*").alias("parts"))
    cells = settle(cells.where("parts > 1").select("h", F.col("m.part").alias("largest")), "cells")
    held = attach(first, cells, ["h"])
    l, r = held.where("part <> largest").drop("largest").alias("l"), held.drop("largest").alias("r")
    out = _new_pairs(l.join(r, (F.col("l.h") == F.col("r.h")) & (F.col("l.part") != F.col("r.part")) & _may_link(percent)), done)
    discard(cells)
    return out


def _second_look(open_: DataFrame, classes: DataFrame, texts: DataFrame, done: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between open classes of different components that make these whole; `done` are the pairs compared before.

    A prefix join in two steps. Centres first: what links with one joins its component, and isn't compared with the other members, of
    which there may be very many. Then, exactly, all pairs of those that are still apart.
    """
    first = _prefixes(open_, texts, width, percent)
    near = _centre_pairs(first, done, percent)
    links = _linked(near, classes, texts, width, percent)
    if settled(links)["rows"]:
        part = lambda c: open_.select(F.col("node").alias(c), F.col("part").alias(f"p{c}"))
        joined = links.join(part("u"), "u").join(part("v"), "v").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct()
        roots = _stars(settle(joined, "joined"), []).select(F.col("label").alias("part"), "root")
        apart, first = first, settle(attach(first, roots, ["part"], "left").withColumn("part", F.coalesce("root", "part")).drop("root"), "prefixes")
        discard(apart)
    rest = _crossing_pairs(first, done.union(near), percent)
    more = _linked(rest, classes, texts, width, percent)
    discard(first, near, rest)
    return settle(links.unionByName(more), "links")


def _members(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` (doc_id, rid, text) with the fingerprint (c1, c2) of their set, and for each fingerprint the root of its
    component and the smallest doc_id there. Equal 128-bit fingerprints count as equal sets."""
    signed = settle(mapped(docs.select("doc_id", "rid", utf8().alias("__utf8")), _signer(width), "doc_id long, rid long, n long, c1 long, c2 long, regs binary, own binary", SLICE_ROWS), "signed")
    some = signed.where("n > 0")
    classes = settle(some.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("own").alias("own")).withColumnRenamed("c1", "node"), "classes")
    signed, sketched = settle(signed.select("doc_id", "rid", "n", "c1", "c2"), "named"), signed
    discard(sketched)                            # of many copies of a set only the class keeps its registers
    bands = settle(_bands(classes), "bands")
    heads = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "lo")
    crowd = settle(bands.join(heads, "key"), "crowd")
    discard(bands)
    by_rep = docs.select(F.col("doc_id").alias("rep"), utf8().alias("t"))
    named = classes.where("rep is not null").select("node", "c2", "rep")
    texts = by_rep.join(named, "rep").select("node", "c2", "t").unionByName(classes.where("rep is null").select("node", "c2", F.col("own").alias("t")))
    stars = settle(crowd.where("node > lo").select(F.col("node").alias("u"), F.col("lo").alias("v")).distinct(), "stars")
    links = _linked(stars, classes, texts, width, percent)
    roots = _stars(links, []) if settled(links)["rows"] else None
    open_ = _open_classes(crowd, roots)
    discard(crowd)
    if settled(open_)["rows"]:
        more = _second_look(open_, classes, texts, stars, width, percent)
        if settled(more)["rows"]:
            links = links.unionByName(more)
            roots = _stars(links, [])
    discard(stars, open_)
    node = classes.select("node", "c2", "rep")
    joined = node.join(roots.select(F.col("label").alias("node"), "root"), "node", "left") if roots is not None else node.withColumn("root", F.lit(None).cast("long"))
    joined = joined.withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    members = settle(joined.join(least, "root").select(F.col("node").alias("c1"), "c2", "root", "component_id"), "members")
    discard(classes)
    return signed, members


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs` (doc_id, text).

    Documents are linked if their sets' intersection is at least `percent` of the union; component_id is the smallest doc_id
    that links lead to. Null and empty texts and texts of white space have no shingles and stand alone; a text with fewer
    than `width` words is one shingle. Rows that share a doc_id are separate documents, so of two equal rows both have
    kept = true. A row with a null id is linked like any other but gives no component its name: component_id is null where
    all ids are, and kept is false where another row has an id, else true. An empty table gives no rows.
    """
    signed, members = _members(docs.select("doc_id", F.lit(None).cast("long").alias("rid"), "text"), width, percent)
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "c1", "c2").join(members, ["c1", "c2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, less all but one of each component: the one with the smallest doc_id
    (a null only where all are null), and of rows that share it one. Rows without shingles all stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    whole = settle(docs.select(row).withColumn("rid", F.monotonically_increasing_id()), "rows")
    signed, members = _members(whole.select(F.col("__row.doc_id").alias("doc_id"), "rid", F.col("__row.text").alias("text")), width, percent)
    rows = signed.where("n > 0").select("doc_id", "rid", "c1", "c2").join(members.select("c1", "c2", "root"), ["c1", "c2"])
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")).select("first.rid")
    keep = first.union(signed.where("n = 0").select("rid"))
    return whole.join(keep, "rid", "left_semi").select("__row.*")


def _same_set(width: int):
    """Of rows that share the id of a class, those that have its set."""
    def start():
        shingles = Shingles(width)

        def step(batch):
            keep = [_fingerprint(shingles(t.as_py()))[1] == c.as_py() for t, c in zip(batch.column("t"), batch.column("c2"))]
            keep = pa.array(keep, pa.bool_())
            return [batch.column("node").filter(keep), batch.column("t").filter(keep)]
        return step
    return start


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, sh from (
  select doc_id, array_to_string(ws[i:i + 1], ' ') as sh from (select doc_id, ws, unnest(range(1, greatest(len(ws), 2))) as i from w where len(ws) > 0))),
n as (select doc_id, count(*) as n from s group by 1),
f as (select sh, count(*) as df from s group by 1),
r as (select s.doc_id, s.sh, n.n, row_number() over (partition by s.doc_id order by f.df, s.sh) as pos from s join f using (sh) join n using (doc_id)),
p as (select doc_id, sh, n from r where pos <= n - ceil(0.8 * n) + 1),
c as (select distinct a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb from p a join p b on a.sh = b.sh and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
i as (select a, b, na, nb, count(*) as shared from c join s x on x.doc_id = a join s y on y.doc_id = b and y.sh = x.sh group by all),
e as (select a, b from i where 100 * shared >= 80 * (na + nb - shared)),
l as (select a as u, b as v from e union all select b, a from e),
g(u, root) as (select doc_id, doc_id from w union select l.u, g.root from g join l on l.v = g.u and g.root < l.u)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.root as component_id, m.root = w.doc_id as kept
from w left join n using (doc_id) join (select u, min(root) as root from g group by 1) m on m.u = w.doc_id"""


@query("op1_near_duplicates", SQL)
def op1_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)
