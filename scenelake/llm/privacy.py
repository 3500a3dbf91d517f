"""Personal data: patterns with checks, and terms of the corpus that give such data away.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers found by pattern. What else in a text tells who it is
about is learnt from the corpus (after Sanchez and Batet, C-sanitized, 2016): texts are cut into blocks of 32 words, and a
term t discloses an entity c by the share PMI(c; t) / IC(c) of c's information content -log2 p(c), with probabilities counted over
blocks. It is 1 where t never occurs without c. A term that discloses some entity by DISCLOSURE or more, in at least SUPPORT
different surroundings, is generalised to its first three letters if these stay below the threshold for every entity, and removed if not.

All of it is DataFrame operations. A pattern's matches get their places from the lengths of matches and of the gaps between them.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.scale import attach, settle, settled

from .catalog import query, table

KINDS = ("email", "ip", "card", "phone", "general", "removed")
BLOCK, NEAR, STEM = 32, 4, 3
DISCLOSURE, SUPPORT = 0.9, 3
CHUNK = 64
_LOCAL = "A-Za-z0-9._%+-"
# As in the contract, but never tried again inside a run of characters where it can't begin, and without recursion: Java's repeated groups
# and long runs would else cost the stack or a square of the run.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SIGNS = {"email": "@", "phone": r"\+[0-9]", "ip": r"\.[0-9]", "card": "[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
TERM = r"[\p{L}\p{M}\p{N}]+"
OPEN, CLOSE, OTHER = "", "", ""      # an entity in a masked text is a code between the first two


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with the value worked out once however often, and in whatever lambda, it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda v: let(_digits(v), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def matches(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """start, end (code points, end exclusive) and value of the leftmost non-overlapping matches that pass `keep`."""
    none = F.array().cast("array<struct<start:long,end:long,value:string>>")

    def placed(gaps, hits, at):
        lens = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))

        def spans(lens):
            chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lens) / CHUNK).cast("int")), lambda j: _sum(F.slice(lens, j * CHUNK + 1, F.lit(CHUNK))))

            def span(chunks, i):
                c = F.floor(i / CHUNK).cast("int")
                start = _sum(F.slice(chunks, F.lit(1), c)) + _sum(F.slice(lens, c * CHUNK + 1, i - c * CHUNK)) + F.length(F.get(gaps, i))
                return F.struct(start.alias("start"), (start + F.length(F.get(hits, i))).alias("end"), F.get(hits, i).alias("value"))
            return let(chunks, lambda chunks: F.transform(at, lambda i: span(chunks, i)))
        return let(lens, spans)

    def found(hits):
        at = F.filter(F.transform(hits, lambda h, i: F.when(keep(h), i)), lambda i: i.isNotNull())
        return let(at, lambda at: F.when(F.size(at) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: placed(gaps, hits, at))))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def base_spans(text: Column) -> Column:
    """Sorted spans (start, kind number, end, value) of the four patterns."""
    none = F.array().cast("array<struct<start:long,kind:int,end:long,value:string>>")

    def of(k, kind):
        spans = F.transform(matches(text, PATTERNS[kind], CHECKS[kind]), lambda s: F.struct(s.start.alias("start"), F.lit(k).alias("kind"), s.end.alias("end"), s.value.alias("value")))
        return F.when(text.rlike(SIGNS[kind]), spans).otherwise(none)
    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS[:4])]))


def masked(text: Column) -> Column:
    """The text with a code of letters in place of each entity: equal for equal values, whatever their case or separators."""
    def code(kind, value):
        plain = F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)
        return F.concat(F.lit(OPEN + "abcd"[KINDS.index(kind)]), F.translate(F.md5(plain.cast("binary")), "0123456789", "ghijklmnop"), F.lit(CLOSE))

    def without(kind, text):
        def put(hits):
            return F.array_join(F.flatten(F.zip_with(F.split(text, PATTERNS[kind], -1), hits, lambda g, h: F.array(g, F.when(h.isNull(), "").when(CHECKS[kind](h), code(kind, h)).otherwise(h)))), "")
        hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(text.rlike(SIGNS[kind]), let(hits, put)).otherwise(text)

    def chain(kinds, text):
        return let(without(kinds[0], text), lambda t: chain(kinds[1:], t)) if kinds else text
    return let(F.translate(text, OPEN + CLOSE, OTHER * 2), lambda t: chain(KINDS[:4], t))


def _tokens(text: Column) -> Column:
    """Entities (codes that begin with OPEN) and lower-case terms in order."""
    return F.transform(F.regexp_extract_all(masked(text), F.lit(f"{TERM}|{OPEN}[^{CLOSE}]*{CLOSE}"), F.lit(0)), lambda t: F.lower(t))


def _forms(block: Column) -> Column:
    """The terms of a block, their stems, marked by a star, and '' for the block itself, each once."""
    terms = F.filter(block, lambda t: ~t.startswith(OPEN))
    return let(terms, lambda ts: F.array_distinct(F.concat(ts, F.transform(F.filter(ts, lambda t: F.length(t) > STEM), lambda t: stem(t)), F.array(F.lit("")))))


def stem(term: Column) -> Column:
    return F.concat(F.substring(term, 1, STEM), F.lit("*"))


def _mentions(tokens: Column) -> Column:
    """For each mention of an entity: its code, whether it is the first in its block, what stands around it, and the block's forms."""
    def mention(t, i):
        lo = F.floor(i / BLOCK).cast("int") * BLOCK
        before = F.slice(tokens, lo + 1, i - lo)
        near = F.slice(tokens, F.greatest(i - NEAR, F.lit(0)) + 1, F.lit(2 * NEAR + 1))
        return F.when(t.startswith(OPEN), F.struct(t.alias("entity"), (~F.array_contains(before, t)).cast("int").alias("first"), F.xxhash64(near).alias("near"), _forms(F.slice(tokens, lo + 1, F.lit(BLOCK))).alias("forms")))
    return F.filter(F.transform(tokens, mention), lambda m: m.isNotNull())


def disclosures(texts: DataFrame, support: int = SUPPORT) -> DataFrame | None:
    """entity, form and ratio for the forms (terms, stems) that occur around an entity in at least `support` different surroundings; None where
    there are none. `texts` has a column text. Pairs are made inside blocks of 32 words only and counted before they are shuffled."""
    mentions = texts.select(F.explode(let(_tokens(F.col("text")), _mentions)).alias("m"))
    pairs = mentions.select("m.entity", "m.first", "m.near", F.explode("m.forms").alias("form"))
    pairs = pairs.groupBy("entity", "form", "near").agg(F.sum("first").alias("n")).groupBy("entity", "form").agg(F.sum("n").alias("n"), F.count("*").alias("support"))
    pairs = settle(pairs.where((F.col("support") >= support)), "pairs", terms=F.count_if(F.col("form") != ""))
    if not settled(pairs)["terms"]:
        return None
    blocks = lambda ts: F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(ts) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: _forms(F.slice(ts, b * BLOCK + 1, F.lit(BLOCK)))))
    counts = texts.select(F.explode(let(_tokens(F.col("text")), blocks)).alias("form")).groupBy("form").agg(F.count("*").alias("n_form"))
    counts = settle(counts.join(pairs.select("form").distinct().union(texts.sparkSession.sql("select ''")).distinct(), "form", "left_semi"), "forms", blocks=F.max(F.when(F.col("form") == "", F.col("n_form"))))
    n = F.lit(float(settled(counts)["blocks"] or 1))
    whole = pairs.where("form = ''").select("entity", F.col("n").alias("n_entity"))
    both = pairs.where("form <> ''").join(whole, "entity").join(counts, "form")
    ratio = F.log2(F.col("n") * n / (F.col("n_entity") * F.col("n_form"))) / F.log2(n / F.col("n_entity"))
    return both.where(F.col("n_entity") < n).select("entity", "form", "n", "support", ratio.alias("ratio"))


def _revealing(texts: DataFrame, disclosure: float, support: int) -> DataFrame | None:
    """Terms to change (term, general): general where the stem discloses no entity."""
    found = disclosures(texts, support)
    if found is None:
        return None
    forms = settle(found.where(F.col("ratio") >= disclosure).select("form").distinct(), "revealing")
    if not settled(forms)["rows"]:
        return None
    terms = forms.where("form not like '%*'").select(F.col("form").alias("term"), F.when(F.length("form") > STEM, stem(F.col("form"))).alias("stem"))
    marked = terms.join(forms.select(F.col("form").alias("stem"), F.lit(1).alias("bad")), "stem", "left")
    return settle(marked.select("term", (F.col("stem").isNotNull() & F.col("bad").isNull()).alias("general")), "terms")


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The rows of `docs` (text, …) with a struct `private`: spans and the sanitised text.

    A span is (start, kind, end, value), in code points, end exclusive, kind a place in KINDS; spans are sorted by start, then kind, and may
    overlap. In the sanitised text entities give way to their kind in angle brackets, revealing terms to their stem or to <TERM>; of
    overlapping spans the first counts. Terms are runs of letters and digits that touch no entity, without regard to case.

    Null and empty texts have no spans; the sanitised text of null is empty. Texts of any length are searched in whole. Repeated rows are
    kept and count each time in probabilities, but give a term no more support than one. A corpus without entities, or
    without rows, changes nothing. `private` and names that begin with two underscores are the only ones that `docs` must not have.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(text.alias("text"))
    terms = _revealing(texts, disclosure, support)
    rows = docs.withColumn("__text", text)
    none = F.array().cast("array<struct<term:string,general:boolean>>")
    if terms is None:
        rows = rows.withColumn("__terms", none)
    else:
        # equal texts hold equal terms: what is found goes by a text's digest, so one of many copies is looked at once
        key = F.md5(F.col("text").cast("binary"))
        has = texts.select(key.alias("__key"), F.explode(F.array_distinct(_tokens(F.col("text")))).alias("term"))
        held = settle(attach(has, terms, ["term"]).distinct().groupBy("__key").agg(F.collect_list(F.struct("term", "general")).alias("__terms")), "held")
        rows = attach(rows.withColumn("__key", F.md5(F.col("__text").cast("binary"))), held, ["__key"], "left").withColumn("__terms", F.coalesce("__terms", none)).drop("__key")
    rows = rows.withColumn("__base", base_spans(F.col("__text")))

    def added(base, terms):
        names = F.transform(terms, lambda t: t.term)
        spans = matches(F.col("__text"), TERM, lambda v: F.array_contains(names, F.lower(v)))
        apart = F.filter(spans, lambda s: ~F.exists(base, lambda b: (b.start < s.end) & (s.start < b.end)))
        general = lambda v: F.exists(terms, lambda t: (t.term == F.lower(v)) & t.general)
        return F.transform(apart, lambda s: F.struct(s.start.alias("start"), F.when(general(s.value), 4).otherwise(5).alias("kind"), s.end.alias("end"), s.value.alias("value")))
    more = F.when(F.size("__terms") == 0, F.array().cast("array<struct<start:long,kind:int,end:long,value:string>>")).otherwise(added(F.col("__base"), F.col("__terms")))
    rows = rows.withColumn("__spans", F.array_sort(F.concat("__base", more)))
    return rows.withColumn("private", F.struct(F.col("__base").alias("base"), F.col("__spans").alias("spans"), sanitised(F.col("__text"), F.col("__spans")).alias("text"))).select(*[F.col(f"`{c}`") for c in docs.columns], "private")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced; of overlapping ones the first counts."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS[:4]])
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("parts"))

    def step(a, s):
        new = F.when(s.kind < 4, F.get(names, s.kind)).when(s.kind == 4, stem(s.value)).otherwise(F.lit("<TERM>"))
        kept = F.substring(text, (a.end + 1).cast("int"), (s.start - a.end).cast("int"))
        return F.when(s.start < a.end, a).otherwise(F.struct(s.end.alias("end"), F.concat(a.parts, F.array(kept, new)).alias("parts")))
    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a.parts, ""), F.substring(text, (a.end + 1).cast("int"), F.length(text))))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def _sql(disclosure: float = DISCLOSURE, support: int = SUPPORT) -> str:
    patterns = {"email": rf"[{_LOCAL}]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def digits(v):
        return f"regexp_replace({v}, '[^0-9]', '', 'g')"

    def passes(kind, v):
        d = digits(v)
        luhn = f"list_sum(list_transform(range(1, length({d}) + 1), lambda p: case when p % 2 = 0 then [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][{d}[length({d}) - p + 1]::int + 1] else {d}[length({d}) - p + 1]::int end)) % 10 = 0"
        return {"email": "true", "ip": rf"regexp_full_match({v}, '{_BYTE}(?:\.{_BYTE}){{3}}')", "card": f"case when length({d}) between 14 and 19 then {luhn} else false end", "phone": f"length({d}) between 10 and 15"}[kind]

    def places(gaps, hits):
        return f"list_sum(list_transform({gaps}[1:i], lambda g: length(g)))::bigint + coalesce(list_sum(list_transform({hits}[1:i - 1], lambda h: length(h))), 0)::bigint"
    out = ["t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents)",
           f"x0 as (select rid, translate(text, '{OPEN}{CLOSE}', '{OTHER * 2}') as text from t)"]
    for k, kind in enumerate(KINDS[:4]):
        plain = {"email": "lower({})", "ip": "{}"}.get(kind, digits("{}")).format("hits[i]")
        cut = f"regexp_extract_all(text, '{patterns[kind]}') as hits, regexp_split_to_array(text, '{patterns[kind]}') as gaps"
        out += [f"b{k} as (select rid, {k} as kind, {places('gaps', 'hits')} as start, hits[i] as value from (select rid, hits, gaps, unnest(range(1, len(hits) + 1)) as i from (select rid, {cut} from t)) where {passes(kind, 'hits[i]')})",
                f"x{k + 1} as (select rid, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || case when i > len(hits) then '' when {passes(kind, 'hits[i]')} "
                f"then '{OPEN}{'abcd'[k]}' || translate(md5({plain}), '0123456789', 'ghijklmnop') || '{CLOSE}' else hits[i] end), '') as text from (select rid, {cut} from x{k}))"]
    forms = f"list_distinct(list_concat(list_filter(w, lambda t: not starts_with(t, '{OPEN}')), list_transform(list_filter(w, lambda t: not starts_with(t, '{OPEN}') and length(t) > {STEM}), lambda t: t[1:{STEM}] || '*'), ['']))"
    out += ["base as (select rid, kind, start, start + length(value) as stop, value from (" + " union all ".join(f"select * from b{k}" for k in range(4)) + "))",
            f"w as (select rid, list_transform(regexp_extract_all(text, '{TERM}|{OPEN}[^{CLOSE}]*{CLOSE}'), lambda x: lower(x)) as ts from x4)",
            f"blocks as (select rid, b, {forms} as forms from (select rid, b, ts[{BLOCK} * b + 1:{BLOCK} * b + {BLOCK}] as w from (select rid, ts, unnest(range(0, greatest(len(ts) - 1, 0) // {BLOCK} + 1)) as b from w)))",
            f"mentions as (select rid, ts[i] as entity, i, (i - 1) // {BLOCK} as b, not list_contains(ts[{BLOCK} * ((i - 1) // {BLOCK}) + 1:i - 1], ts[i]) as first, ts[greatest(i - {NEAR}, 1):greatest(i - {NEAR}, 1) + {2 * NEAR}] as near "
            f"from (select rid, ts, unnest(range(1, len(ts) + 1)) as i from w) where starts_with(ts[i], '{OPEN}'))",
            f"pairs as (select entity, form, count(*) filter (first) as n, count(distinct near) as support from (select m.entity, m.first, m.near, unnest(k.forms) as form from mentions m join blocks k using (rid, b)) group by all having count(distinct near) >= {support})",
            "forms as (select form, count(*) as n_form from (select unnest(forms) as form from blocks) group by 1)",
            "n as (select n_form as n from forms where form = '')",
            "reveal as (select distinct p.form from pairs p join pairs c on c.entity = p.entity and c.form = '' join forms f on f.form = p.form, n "
            f"where p.form <> '' and c.n < n.n and log2(p.n * n.n::double / (c.n * f.n_form)) / log2(n.n::double / c.n) >= {disclosure})",
            f"terms as (select form as term, length(form) > {STEM} and form[1:{STEM}] || '*' not in (select form from reveal) as general from reveal where form not like '%*')",
            f"held as (select distinct rid from (select rid, unnest(ts) as term from w) join terms using (term))",
            f"cut as (select rid, regexp_extract_all(text, '{TERM}') as hits, regexp_split_to_array(text, '{TERM}') as gaps from t join held using (rid))",
            f"more as (select rid, case when general then 4 else 5 end as kind, {places('gaps', 'hits')} as start, hits[i] as value from (select rid, hits, gaps, unnest(range(1, len(hits) + 1)) as i from cut) join terms on term = lower(hits[i]))",
            "spans as (select rid, kind, start, stop from base union all select rid, kind, start, start + length(value) from more m where not exists (select 1 from base b where b.rid = m.rid and b.start < m.start + length(m.value) and m.start < b.stop))"]
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = f"coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind)"
    return ("with " + ",\n".join(out) + "\nselect doc_id, " + ", ".join(f"(count(*) filter (kind = {k}))::bigint as n_{kind}" for k, kind in enumerate(KINDS[:4])) +
            f", sha256({text} filter (kind < 4), '')) as base_sha256, {text}, '') as spans from t left join spans using (rid) group by rid, doc_id")


@query("op12_personal_data", _sql())
def op12_personal_data(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("private.base", lambda s: s.kind)
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("private.base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("private.spans")).alias("spans"))
