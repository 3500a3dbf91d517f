"""Vector codes: vectors cut into parts, one codebook a part, fitted by exact integer k-means over anchors-hierarchy metric trees.

Each task turns the batches of vectors it reads into trees, one for every part, by Moore's anchors hierarchy (2000): about sqrt(n)
anchors take the points nearest to them, a new one always at the point furthest from its anchor, and the triangle inequality
tells which points can't change hands. Anchors are then merged in pairs of smallest common ball, and those with many
points are divided likewise. Every ball keeps the sum and the count of its points.

A round sends the codebooks, 256 entries a part, to all trees. A ball inherits the candidate entries of its parent and drops each one
that loses to another for all points of the ball; a ball with one candidate left is wholly owned and adds its cached sum and
count, and a leaf with several compares its points with those only. Entries' sums and counts, at most 256 a part and task, are
all that is shuffled.
"""

import pickle
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenelake.scale import attach, settle

from .catalog import mapped, query, table
from .topk import quantised

PARTS, ENTRIES, ROUNDS, STEPS = 4, 256, 4, 1024.0
LEAF, EXACT = 64, 2.0 ** 52                      # points of a leaf; bound below which doubles hold every intermediate result exactly
SLACK = 1e-9


def numbers(x: np.ndarray) -> np.ndarray:
    """Integers in doubles where squared distances of these stay exact, else Python's integers."""
    top = float(np.abs(x.astype(np.float64)).max(initial=0))
    return x.astype(np.float64) if 8 * top * top * max(x.shape[1], 1) < EXACT else x.astype(object)


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a, b) if a.dtype == b.dtype else tuple(v if v.dtype == object else v.astype(np.int64).astype(object) for v in (a, b))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `a` from all rows of `b`, exact."""
    a, b = alike(a, b)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


class Tree:
    """A metric tree over the rows of an integer matrix: nodes in preorder, points in the order of the leaves.

    first, count: a node's points; skip: the node after its subtree; sums: of its points, exact; centre, radius: its ball.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.order, self.nodes = numbers(points), [], []
        near = points.astype(np.float64)
        self._grow(_anchored(near, np.arange(len(points))))
        self.order = np.concatenate(self.order)
        self.first, self.count, self.skip = np.array(self.nodes, np.int64).T
        exact = points if self.points.dtype != object else self.points
        run = np.concatenate([exact[:1] * 0, np.cumsum(exact[self.order], 0)])
        self.sums = run[self.first + self.count] - run[self.first]
        self.centre = self.sums.astype(np.float64) / self.count[:, None]
        q = near[self.order]
        self.radius = np.array([np.sqrt(((q[f:f + n] - c) ** 2).sum(1).max()) for f, n, c in zip(self.first, self.count, self.centre)])
        self.least = 1e-18 * float(np.abs(near).max(initial=0)) ** 2 + SLACK

    def __getstate__(self):
        """Points are kept in the narrowest type that holds them."""
        state = {k: v for k, v in vars(self).items() if k != "nodes"}
        if self.points.dtype != object:
            state["points"] = self.points.astype(np.min_scalar_type(-int(np.abs(self.points).max(initial=0)) - 1))
        return state

    def __setstate__(self, state):
        vars(self).update(state)
        self.points = numbers(self.points)

    def _grow(self, shape) -> None:
        """Preorder numbers for a nested shape: an array of points is a leaf, a pair has two children."""
        stack, placed = [shape], 0
        while stack:
            s = stack.pop()
            if isinstance(s, int):
                f, _, _ = self.nodes[s]
                self.nodes[s] = (f, placed - f, len(self.nodes))
            elif isinstance(s, tuple):
                stack += [len(self.nodes), s[1], s[0]]
                self.nodes.append((placed, 0, 0))
            else:
                self.order.append(s)
                self.nodes.append((placed, len(s), len(self.nodes) + 1))
                placed += len(s)


def _anchors(x: np.ndarray, ids: np.ndarray, wanted: int) -> list[np.ndarray]:
    """The points `ids` dealt to at most `wanted` anchors, each to the nearest, by stealing from sorted lists."""
    d = np.sqrt(((x[ids] - x[ids[0]]) ** 2).sum(1))
    by = np.argsort(-d, kind="stable")
    pivot, own, far = [ids[0]], [ids[by]], [d[by]]
    while len(pivot) < wanted:
        k = max(range(len(pivot)), key=lambda i: far[i][0])
        if far[k][0] == 0:
            break
        new = own[k][0]
        apart = np.sqrt(((x[pivot] - x[new]) ** 2).sum(1))
        got, at = [], []
        for i in range(len(pivot)):
            m = int(np.searchsorted(-far[i], -apart[i] / 2 * (1 - SLACK), "right"))    # nearer points can't be stolen
            if m:
                near = np.sqrt(((x[own[i][:m]] - x[new]) ** 2).sum(1))
                take = near < far[i][:m]
                if take.any():
                    got.append(own[i][:m][take])
                    at.append(near[take])
                    left = np.concatenate([~take, np.ones(len(own[i]) - m, bool)])
                    own[i], far[i] = own[i][left], far[i][left]
        got, at = np.concatenate(got), np.concatenate(at)
        by = np.argsort(-at, kind="stable")
        pivot.append(new)
        own.append(got[by])
        far.append(at[by])
    return own


def _anchored(x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
    """Nested shape of the tree over the points `ids`, from the middle outwards."""
    if len(ids) <= leaf:
        return ids
    groups = _anchors(x, ids, max(2, int(np.sqrt(len(ids)))))
    if len(groups) == 1:                         # copies of one point
        return groups[0]
    shapes = [_anchored(x, g, leaf) for g in groups]
    count = np.array([len(g) for g in groups], np.float64)
    centre = np.array([x[g].mean(0) for g in groups])
    radius = np.array([np.sqrt(((x[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centre)])
    alive = list(range(len(groups)))
    both = np.full((len(groups),) * 2, np.inf)

    def ball(i, others):
        """Radius of the smallest ball around two balls."""
        gap = np.sqrt(((centre[others] - centre[i]) ** 2).sum(1))
        return np.maximum((gap + radius[i] + radius[others]) / 2, np.maximum(radius[i], radius[others]))
    for i in alive[1:]:
        both[i, :i] = ball(i, np.arange(i))
    while len(alive) > 1:
        i, j = divmod(int(both.argmin()), len(groups))
        r = both[i, j]
        centre[i] = (centre[i] * count[i] + centre[j] * count[j]) / (count[i] + count[j])
        shapes[i], count[i], radius[i] = (shapes[i], shapes[j]), count[i] + count[j], r
        alive.remove(j)
        both[j, :], both[:, j] = np.inf, np.inf
        rest = np.array([k for k in alive if k != i], np.int64)
        if len(rest):
            b = ball(i, rest)
            low, high = rest < i, rest > i
            both[i, rest[low]], both[rest[high], i] = b[low], b[high]
    return shapes[alive[0]]


def owners(tree: Tree, book: np.ndarray):
    """For a tree and a codebook: (node, entry) of wholly owned balls, and (point, entry) of all other points, in the order of
    the leaves. Ties go to the lower entry."""
    near = book.astype(np.float64)
    gap = np.sqrt(np.maximum(squares(near, near), 0))
    open_, balls, points = {0: np.arange(len(book))}, [], []
    node, end = 0, len(tree.count)
    while node < end:
        some = open_.pop(node)
        if len(some) > 1:
            d = ((near[some] - tree.centre[node]) ** 2).sum(1)
            best = int(d.argmin())
            lost = d - d[best] - 2 * tree.radius[node] * gap[some, some[best]]
            some = some[lost <= tree.least + SLACK * (d + tree.radius[node] ** 2)]
        n, f = int(tree.count[node]), int(tree.first[node])
        if len(some) == 1:
            balls.append((node, int(some[0])))
        elif tree.skip[node] == node + 1:
            d = squares(tree.points[tree.order[f:f + n]], book[some])
            points.append((np.arange(f, f + n), some[d.argmin(1).astype(np.int64)]))
        else:
            left = node + 1
            open_[left] = open_[int(tree.skip[left])] = some
            node = left
            continue
        node = int(tree.skip[node])
    return balls, points


def totals(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and exact sum of the points nearest to each entry."""
    count, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, object)
    balls, points = owners(tree, book)
    for node, e in balls:
        count[e] += tree.count[node]
        sums[e] += tree.sums[node]
    if points:
        at, e = (np.concatenate(v) for v in zip(*points))
        count += np.bincount(e, minlength=len(book))
        by = np.argsort(e, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(e[by]) > 0]))
        x = tree.points[tree.order[at[by]]]
        sums[e[by][first]] += np.add.reduceat(x.astype(np.int64 if x.dtype != object else object), first, axis=0)
    return count, sums


def assigned(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every row, in the rows' own order."""
    out = np.zeros(len(tree.order), np.int64)
    balls, points = owners(tree, book)
    for node, e in balls:
        out[tree.first[node]:tree.first[node] + tree.count[node]] = e
    for at, e in points:
        out[at] = e
    code = np.empty_like(out)
    code[tree.order] = out
    a, b = alike(tree.points, book[code])
    return code, ((a - b) ** 2).sum(1)


def _planter(kept: list[str], width: int, parts: int):
    """A batch of vectors as one row: its other columns, and a tree for each part."""
    def start():
        def step(batch):
            lists = batch.column("__v")
            v = np.zeros((batch.num_rows, width), np.int64)
            size = np.diff(lists.offsets.to_numpy())
            v[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
            sink = pa.BufferOutputStream()
            rows = batch.select(kept)
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            return [[sink.getvalue().to_pybytes()], [pickle.dumps([Tree(np.ascontiguousarray(p)) for p in np.split(v, parts, 1)])]]
        return step
    return start


def _totals(books):
    def run(batches):
        count, sums = [np.zeros(len(b), np.int64) for b in books.value], [np.zeros(b.shape, object) for b in books.value]
        for batch in batches:
            for trees in batch.column("trees"):
                for k, tree in enumerate(pickle.loads(trees.as_py())):
                    n, s = totals(tree, books.value[k])
                    count[k] += n
                    sums[k] += s
        rows = [(k, e, int(n), [Decimal(int(x)) for x in sums[k][e]]) for k, c in enumerate(count) for e, n in enumerate(c) if n]
        if rows:
            part, entry, n, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "s"])
    return run


def _coder(books):
    def run(batches):
        for batch in batches:
            for rows, trees in zip(batch.column("rows"), batch.column("trees")):
                kept = pa.ipc.open_stream(rows.as_py()).read_all().combine_chunks()
                both = [assigned(tree, book) for tree, book in zip(pickle.loads(trees.as_py()), books.value)]
                code = np.stack([c for c, _ in both], 1).astype(np.uint8)
                error = sum(e.astype(object) if e.dtype == object else e.astype(np.int64) for _, e in both)
                for out in kept.append_column("code", pa.array([c.tobytes().hex() for c in code])).append_column("error", pa.array(error.tolist(), pa.int64())).to_batches():
                    yield out
    return run


def codebooks(trees: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after `rounds` rounds of assignment and floored means; an entry that nothing is nearest to stays."""
    context = trees.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(books)
        sums = trees.select("trees").mapInArrow(_totals(sent), "part int, entry int, n long, s array<decimal(38,0)>")
        per_entry = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(books[0].shape[1])])
        books = [[[int(x) for x in row] for row in b] for b in books]
        for r in per_entry.collect():            # at most 256 entries a part
            books[r.part][r.entry] = [int(x) // r.n for x in r[3:]]
        books = [numbers(np.array(b, dtype=object)) for b in books]
        sent.unpersist()
    return books


def vector_codes(vectors: DataFrame, vector: str, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The other columns of `vectors` with code (two hex digits a part) and error (squared distances summed over the parts), and the codebooks.

    `vector` names a column of 64-bit integers, `key` the column whose smallest values give the first codebooks (nulls last, ties by
    the smaller vector). A null vector takes no part and gives no row. Shorter vectors count as filled with zeros up to the longest one's
    length, and that up to a multiple of `parts`. Repeated rows count each time; fewer rows than `entries` give smaller
    codebooks; without rows the result is empty, and so are the codebooks. Components up to 2^63 are handled exactly, as long as errors fit 64 bits. Beside `code` and
    `error` the columns may have any name. What reaches the driver, and what is broadcast, is the codebooks only.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kept = [c for c in vectors.columns if c != vector]
    some = vectors.where(F.col(f"`{vector}`").isNotNull()).withColumnRenamed(vector, "__v")
    width = max(1, some.agg(F.max(F.size("__v"))).first()[0] or 1)
    width = -(-width // parts) * parts
    first = [list(r["__v"]) + [0] * (width - len(r["__v"])) for r in some.orderBy(F.asc_nulls_last(f"`{key}`"), "__v").select("__v").limit(entries).collect()]
    books = [numbers(b) for b in np.split(np.array(first, np.int64).reshape(-1, width), parts, 1)]
    trees = settle(mapped(some, _planter(kept, width, parts), "rows binary, trees binary"), "trees")
    if first:
        books = codebooks(trees, books, rounds)
    schema = T.StructType([*some.select(*[f"`{c}`" for c in kept]).schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return trees.mapInArrow(_coder(trees.sparkSession.sparkContext.broadcast(books)), schema), books


def digest(books: list[np.ndarray]) -> str:
    return sha256(",".join(str(int(x)) for b in books for row in b for x in row).encode()).hexdigest()


def _sql(parts: int = PARTS, width: int = 16, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    out = [f"v as (select vec_id, label, list_transform(embedding, lambda x: floor({STEPS}::double * x::double)) as v from embeddings "
           "where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
           f"p as (select vec_id, label, k, v[{width} * k + 1:{width} * k + {width}] as x from v, range({parts}) t(k))",
           f"e0 as (select k, row_number() over (partition by k order by vec_id) - 1 as e, x as c from p qualify e < {entries})"]
    for r in range(rounds + 1):
        out.append(f"d{r} as (select vec_id, label, p.k, arg_min({{'e': e, 'd': d}}, (d, e)) as best from (select vec_id, label, p.k, x, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) as d "
                   f"from p join e{r} using (k)) p group by all)")
        if r < rounds:
            out.append(f"m{r} as (select k, e, list(floor(s / n) order by i) as c from (select d.k, d.best.e as e, i, sum(p.x[i]) as s, count(*) as n from d{r} d join p using (vec_id, k), range(1, {width + 1}) t(i) group by all) group by all)")
            out.append(f"e{r + 1} as (select k, e, coalesce(m.c, b.c) as c from e{r} b left join m{r} m using (k, e))")
    last = rounds
    return ("with " + ",\n".join(out) + f",\nh as (select sha256(string_agg(array_to_string(list_transform(c, lambda x: x::bigint), ','), ',' order by k, e)) as h from e{last}),\n"
            f"r as (select vec_id, label, string_agg(format('{{:02x}}', best.e), '' order by k) as code, sum(best.d)::bigint as error from d{last} group by all)\n"
            "select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h.h as codebooks_sha256 from r, h")


@query("op13_vector_codes", _sql())
def op13_vector_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", quantised("embedding", STEPS).alias("v"))
    coded, books = vector_codes(vectors, "v", "vec_id")
    coded = settle(coded, "coded")
    by_label = coded.groupBy(F.struct("label").alias("l")).agg(F.sum("error").alias("label_error"))
    out = attach(coded.withColumn("l", F.struct("label")), by_label, ["l"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
