"""Merkle manifest of a table: every row is a leaf, every group of rows a tree, and the trees' roots one more tree above them.

A tree is cut into superblocks of 8^4 consecutive nodes. Upwards, each superblock is reduced to its top node, and the tops are
the nodes of the next layer, until one node is left. Downwards, each superblock is cogrouped with the one row it needs from
outside, the path from its top to the root: there its nodes are reduced again, each node's siblings are put before the outer
path, and leaves are folded. So a layer costs one exchange up and one down, and a layer has 1/4096 of the rows below it.
"""

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.scale import attach, settle, settled

from .catalog import ASCII_LOWER, ASCII_UPPER, crc32_sql, query, table

ARITY, HEIGHT = 8, 4                             # a task holds the 8^4 nodes of one superblock at a time


def field(value: Column) -> Column:
    """A value as it enters a leaf: '-' for null, else its length in UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def joined(digests) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def levels_of(nodes: list[str], size: int, height: int = HEIGHT) -> list[list[str]]:
    """The nodes of a superblock, level by level up to its top; `size` is the number of nodes in the whole tree. In a tree of
    several superblocks all have the full height, so that a last run of one node is hashed like any other."""
    out = [list(nodes)]
    while len(out) <= height if size > ARITY ** height else len(out[-1]) > 1:
        out.append([joined(out[-1][i:i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


def path_of(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Siblings left and right of node `at` of the lowest level, of its parent, and so on below the top."""
    out = []
    for level in levels[:-1]:
        lo = at - at % ARITY
        out.append(("".join(level[lo:at]), "".join(level[at + 1:lo + ARITY])))
        at //= ARITY
    return out


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a node leads to by a path of siblings."""
    for before, after in path:
        digest = joined((before, digest, after))
    return digest


def packed(path: list[tuple[str, str]]) -> str:
    return "".join(f"{a},{b};" for a, b in path)


def unpacked(path: str) -> list[tuple[str, str]]:
    return [tuple(level.split(",")) for level in path.split(";")[:-1]]


def _top(height: int):
    def run(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        size = int(nodes["size"].iloc[0])
        top = levels_of(nodes.sort_values("pos")["digest"].tolist(), size, height)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "size": [-(-size // ARITY ** height)], "digest": [top]})
    return run


def _reduced(nodes: pd.DataFrame, outer: pd.DataFrame, height: int):
    """A superblock's rows in order, their levels, and what the outer row adds: path, subroot and root."""
    nodes = nodes.sort_values("pos")
    return nodes, levels_of(nodes["digest"].tolist(), int(nodes["size"].iloc[0]), height), outer.iloc[0]


def _paths(height: int):
    def run(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes, levels, above = _reduced(nodes, outer, height)
        return pd.DataFrame({"tree": key[0], "pos": nodes["pos"], "path": [packed(path_of(levels, i)) + above["path"] for i in range(len(nodes))],
                             "subroot": above["subroot"], "root": above["root"]})
    return run


def _proofs(height: int):
    def run(key: tuple, leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves, levels, above = _reduced(leaves, outer, height)
        rest, proof, root = unpacked(above["path"]), [], []
        for i, claimed in enumerate(leaves["claimed"]):
            path = path_of(levels, i) + rest
            proof.append("".join(a + b for a, b in path))
            root.append(folded(claimed, path))
        return pd.DataFrame({"tree": key[0], "key": leaves["key"], "leaf": leaves["digest"], "position": leaves["pos"], "subroot": above["subroot"],
                             "root": above["root"], "proof": proof, "folded_root": root})
    return run


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """`nodes` (tree, …) with pos, a row's place in its tree by `order`, and size, the tree's number of rows; also observed as `largest`.

    One range partitioning by (tree, order) cuts a tree of any size into many ranges. Rows are frozen in that order, so a row's
    place in its range is its number less the range's first, and only the totals of the ranges are joined back.
    """
    frozen = settle(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                    .withColumn("id", F.monotonically_increasing_id()).withColumn("range", F.shiftright("id", 33)), "placed")
    tree = Window.partitionBy("tree")
    ranges = frozen.groupBy("tree", "range").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(tree.orderBy("range")) - F.col("n")
    ranges = settle(ranges.select("tree", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size")), "ranges", largest=F.max("size"))
    out = attach(frozen, ranges, ["tree", "range"]).withColumn("pos", F.col("id") + F.col("shift")).drop("id", "range", "shift")
    return out, settled(ranges)["largest"] or 0


def _blocks(nodes: DataFrame, height: int):
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY ** height)).groupBy("tree", "block")


def _below(nodes: DataFrame, outer: DataFrame, height: int):
    return _blocks(nodes, height).cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block"))


def _up(nodes: DataFrame, largest: int, height: int) -> list[DataFrame]:
    """`nodes` and the layers of tops above them, the last one with one node a tree."""
    layers = [nodes]
    while largest > 1 or len(layers) == 1:
        tops = _blocks(layers[-1].select("tree", "pos", "size", "digest"), height).applyInPandas(_top(height), "tree string, pos long, size long, digest string")
        layers.append(settle(tops, "tops"))
        largest = -(-largest // ARITY ** height)
    return layers


def _down(layers: list[DataFrame], outer: DataFrame, height: int) -> DataFrame:
    """Paths of the nodes of layers[0], from those of the nodes of the last layer."""
    for nodes in reversed(layers[:-1]):
        lower = _below(nodes.select("tree", "pos", "size", "digest"), outer, height)
        outer = settle(lower.applyInPandas(_paths(height), "tree string, pos long, path string, subroot string, root string"), "paths")
    return outer


def merkle_manifest(rows: DataFrame, key: str, group: str, fields: list[Column], claimed: list[Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """`key`, `group`, leaf, position, subroot, root, proof and folded_root of every row of `rows`.

    `fields` make the leaf. The trees are the values of `group`, ordered null first, then UTF-8 bytewise; in a tree rows ascend
    by `key`, nulls first, then by leaf. `proof` holds all sibling digests from the leaf's level to the root's, 64 characters
    each. `folded_root` is where the fields `claimed` (by default `fields`) lead with these siblings: it equals `root` where
    nothing was changed. A superblock holds 8^`height` nodes.

    Null fields and a null group are values of their own, an empty text differs from null, and texts of any length are hashed in
    whole. Equal rows are separate leaves with equal digests, and as many rows come out as went in. A tree of one row has its
    leaf as subroot, and the subroot of a single tree is the root. An empty table gives no rows. `rows` may have further columns
    of any name; `key` and `group` may have any type that survives a cast to text, and any name but those of the new columns.
    """
    types = {c: rows.schema[c].dataType for c in (key, group)}
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = settle(rows.select(tree.alias("tree"), F.col(key).alias("at"), F.col(key).cast("string").alias("key"), leaf(*fields).alias("digest"), leaf(*(claimed or fields)).alias("claimed")), "leaves")
    leaves, largest = placed(leaves, ["at", "digest"])
    lower = _up(leaves, largest, height)
    subroots, trees = placed(lower[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    upper = _up(subroots, trees, height)
    root = upper[-1].select("tree", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    paths = _down(upper, root, height)
    named = attach(subroots.select("tree", "pos", "name", "digest"), paths.select("tree", "pos", "path", "root"), ["tree", "pos"])
    outer = named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    outer = _down(lower[1:], outer, height)
    proofs = _below(leaves.drop("at"), outer, height).applyInPandas(_proofs(height), "tree string, key string, leaf string, position long, subroot string, root string, proof string, folded_root string")
    value = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    return proofs.select(F.col("key").cast(types[key]).alias(key), value.cast(types[group]).alias(group), "leaf", "position", "subroot", "root", "proof", "folded_root")


def _sql(lower: int = 8, upper: int = 3) -> str:
    """SQL for trees of at most 8^`lower` rows and 8^`upper` trees."""
    def f(c):
        return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"

    low = f"case when {crc32_sql('doc_id::varchar')} % 3 = 0 then translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}') else text end"
    parts = [f("doc_id"), f("source"), f("lang"), f("n_chars")]
    out = [f"l0 as (select row_number() over () as rid, doc_id, coalesce('=' || lang, '') as tree, sha256({' || '.join([*parts, f('text')])}) as h, sha256({' || '.join([*parts, f(f'({low})')])}) as claimed from documents)",
           "a0 as (select rid, tree, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as pos, h from l0)"]

    def levels(a, n):
        for k in range(n):
            out.append(f"{a}{k + 1} as (select tree, pos // 8 as pos, case when any_value(size) > 1 then sha256(string_agg(h, '' order by pos)) else any_value(h) end as h "
                       f"from (select *, count(*) over (partition by tree) as size from {a}{k}) group by tree, pos // 8)")

    def climb(name, start, a, n, at):
        """Path texts and the folded digest over the levels of a tree."""
        prev = start
        for k in range(n):
            out.append(f"{name}{k} as (select p.rid, p.tree, p.{at} // 8 as {at}, p.proof || coalesce(string_agg(s.h, '' order by s.pos) filter (s.pos <> p.{at}), '') as proof, "
                       f"case when any_value(z.n) > 1 then sha256(coalesce(string_agg(s.h, '' order by s.pos) filter (s.pos < p.{at}), '') || p.claimed || coalesce(string_agg(s.h, '' order by s.pos) filter (s.pos > p.{at}), '')) else p.claimed end as claimed "
                       f"from {prev} p join {a}{k} s on s.tree = p.tree and s.pos // 8 = p.{at} // 8 join (select tree, count(*) as n from {a}{k} group by 1) z on z.tree = p.tree group by p.rid, p.tree, p.{at}, p.proof, p.claimed)")
            prev = f"{name}{k}"
        return prev

    levels("a", lower)
    out.append(f"b0 as (select '' as tree, row_number() over (order by encode(tree)) - 1 as pos, tree as name, h from a{lower})")
    levels("b", upper)
    out.append("s0 as (select a0.rid, a0.tree, a0.pos as at, '' as proof, l0.claimed from a0 join l0 using (rid))")
    last = climb("p", "s0", "a", lower, "at")
    out.append(f"s1 as (select p.rid, '' as tree, b0.pos as at, p.proof, p.claimed from {last} p join b0 on b0.name = p.tree)")
    last = climb("q", "s1", "b", upper, "at")
    return ("with " + ",\n".join(out) + f"\nselect l0.doc_id, l0.h as leaf, b0.h as subroot, r.h as root, sha256(q.proof) as proof_sha256, q.claimed as folded_root, q.claimed = r.h as verified "
            f"from l0 join b0 on b0.name = l0.tree join {last} q using (rid) cross join b{upper} r")


@query("op11_merkle_manifest", _sql())
def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", ASCII_UPPER, ASCII_LOWER)).otherwise(F.col("text"))
    same = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    out = merkle_manifest(docs, "doc_id", "lang", [*same, F.col("text")], [*same, changed])
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
