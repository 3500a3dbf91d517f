"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items in whole documents.

Patterns are sequences of words, so a block of the shift table is a few consecutive words. At a position whose block occurs
in no pattern the search jumps over all but one block of the pattern's length; a block that can end a pattern selects the
patterns to compare word by word. Windows of one length are searched together.
"""

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.scale import attach, settle

from .catalog import computed, query, table, utf8

WIDTH, BLOCK = 13, 3
BATCH_BYTES = 4 << 20                            # benchmark text that one pass over the documents searches for
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return text.translate(_WORDS).split()


class WuManber:
    """Finds the windows of one length in lists of words."""

    def __init__(self, windows: dict[tuple, list[str]], length: int):
        self.windows, self.length, self.block = windows, length, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.ends: dict[tuple, list[tuple]] = defaultdict(list)
        for w in windows:
            for end in range(self.block, length + 1):
                key = w[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.ends[w[-self.block:]].append(w)

    def search(self, words: list[bytes]):
        """(first word, items) of every occurrence, from left to right."""
        at, n, block, length, far, shift = self.length, len(words), self.block, self.length, self.far, self.shift
        while at <= n:
            step = shift.get(tuple(words[at - block:at]), far)
            if step:
                at += step
                continue
            found = tuple(words[at - length:at])
            for window in self.ends[found[-block:]]:
                if window == found:
                    yield at - length, self.windows[window]
            at += 1


def windows_of(items, width: int) -> list[WuManber]:
    """One searcher a window length: `width`, and for shorter items their own number of words."""
    by: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        length = min(width, len(words))
        for i in range(len(words) - length + 1 if words else 0):
            by[length][tuple(words[i:i + length])].add(item)
    return [WuManber({w: sorted(names) for w, names in found.items()}, length) for length, found in sorted(by.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


FOUND = "struct<n:long,spans:array<struct<lo:long,hi:long>>,items:array<string>>"
_FOUND = pa.struct([("n", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _searcher(items, width: int):
    def start():
        searchers = windows_of(items.value, width)

        def step(texts):
            out = []
            for text in texts:
                words, at, found = words_of(text.as_py()), [], set()
                for s in searchers:
                    for lo, who in s.search(words):
                        at.append((lo, lo + s.length))
                        found.update(who)
                out.append({"n": len(words), "spans": [{"lo": a, "hi": b} for a, b in merged(at)], "items": sorted(found)})
            return pa.array(out, _FOUND)
        return step
    return start


def _merged(spans: Column) -> Column:
    """Sorted spans without overlaps."""
    none = F.array().cast("array<struct<lo:long,hi:long>>")

    def step(a, s):
        last = F.element_at(a, -1)
        joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last.lo.alias("lo"), F.greatest(last.hi, s.hi).alias("hi"))))
        return F.when((F.size(a) > 0) & (s.lo <= F.get(a, F.size(a) - 1).hi), joined).otherwise(F.concat(a, F.array(s)))
    return F.aggregate(F.array_sort(spans), none, step)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The rows of `docs` with n_words, n_hit, spans (word ranges that are hit), items and contaminated in a struct `hit`.

    Items go to the executors in batches of `batch_bytes`, so what is broadcast is bounded for any benchmark (one item is never cut). The documents
    are read once a batch; all but the last pass keep only what was found, by the digest of the text, and that is joined to the
    documents in the end. Only the text goes to Python and only what was found comes back.

    Null and empty texts have no words and no hits; texts of any length are searched in whole; null and empty items have no windows; a null
    item_id is named "null"; repeated items count once and repeated documents each get their own row. Without items nothing is
    hit, and an empty table gives no rows. A column `hit` of `docs` is replaced; others may have any name.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), utf8().alias("t")).distinct()
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = max(1, -(-total // batch_bytes))
    context, found = docs.sparkSession.sparkContext, []
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "hit"]).alias("row"), utf8().alias("t"))
    for k in range(passes):
        part = rows.where(F.pmod(F.xxhash64("item", "t"), F.lit(passes)) == k).collect()
        search = computed(_searcher(context.broadcast(sorted((r.item, bytes(r.t)) for r in part)), width), FOUND)
        if k + 1 == passes:
            out = whole.select("row", F.md5("t").alias("key"), search("t").alias("f")) if found else whole.select("row", search("t").alias("f"))
        else:
            hits = whole.select(F.md5("t").alias("key"), search("t").alias("f")).where(F.size("f.spans") > 0).select("key", "f.spans", "f.items")
            found.append(settle(hits.groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits"))
    if found:
        before = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        more = lambda c: F.coalesce(F.col(c), F.array())
        out = attach(out, before, ["key"], "left").select("row", F.struct("f.n", _merged(F.concat("f.spans", more("spans"))).alias("spans"),
                                                                          F.array_sort(F.array_union("f.items", more("items"))).alias("items")).alias("f"))
    n_hit = F.aggregate("f.spans", F.lit(0).cast("long"), lambda a, s: a + s.hi - s.lo)
    hit = F.struct(F.col("f.n").alias("n_words"), n_hit.alias("n_hit"), "f.spans", "f.items", ((n_hit > 0) & (20 * n_hit >= F.col("f.n"))).alias("contaminated"))
    return out.select("row.*", hit.alias("hit"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `docs` of which less than a twentieth of the words are hit. Columns may have any name."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return contamination(whole, benchmark, width).where("not hit.contaminated").select("doc.*")


SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
p as (select distinct item, least(len(ws), 13) as l, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') as win
  from (select item, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) as i from b where len(ws) > 0)),
d as (select doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') as win
  from (select doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) as i from w, (select distinct l from p))),
h as (select doc_id, d.i, d.l, p.item from d join p on d.l = p.l and d.win = p.win),
n as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + l)) as k from h) group by 1),
m as (select doc_id, count(distinct item) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from h) group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join n using (doc_id) left join m using (doc_id)"""


@query("op4_decontaminate", SQL)
def op4_decontaminate(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort("hit.items"), ",")
    return found.select("doc_id", "hit.n_words", "hit.n_hit", F.size("hit.items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "hit.contaminated")
