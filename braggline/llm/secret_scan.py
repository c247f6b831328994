"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in every whole text by fixed patterns. Each candidate's value is hashed and aggregated over
the corpus by distinct owners and repositories: a value that several owners hold is a copied example, one that
stays with a single owner looks live. The base kinds are always reported; long strings of mixed characters
(kind ``mixed``) are added only where they stay with one owner and touch no base span.

Places count code points, ends are exclusive. Null texts are empty and have no spans; a null owner or repository
counts as one of its own; repeated rows each get the whole result of their text; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Kinds in the order of the report, their patterns, the group that holds the value, its least length.
KINDS = ("assign", "access", "hex", "mixed")
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
MIXED_LENGTH = 20


def either_case(word: str) -> str:
    """ASCII letters in either case, without the engine's own ideas of case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = f"({'|'.join(map(either_case, KEYWORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# a match of these three fills a whole run, so that the least length can stand in the pattern; not so for assignments
PATTERNS = (ASSIGN, "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}", f"[A-Za-z0-9+/_=-]{{{MIXED_LENGTH},}}")
ASSIGN_LENGTH = 12


def _width(pairs: Column) -> Column:
    """Length of the blocks that a text's matches are handled in: the root of their number."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(pairs))).cast("int"))


def _blocks(pairs: Column, body) -> Column:
    """body(block number, its matches) for each block."""
    count = F.ceil(F.size(pairs) / _width(pairs)).cast("int")
    return F.when(F.size(pairs) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: body(b, F.slice(pairs, b * _width(pairs) + 1, _width(pairs)))))


def _sizes(pairs: Column) -> Column:
    """Characters that each block moves on."""
    return _blocks(pairs, lambda b, block: F.aggregate(block, F.lit(0), lambda acc, x: acc + F.length(x["g"]) + F.length(x["m"])))


def _spans(kind: int, pairs: Column, sizes: Column) -> Column:
    """Spans from a text's matches and the strings before them: each gap and match moves the place on. Arrays grow by
    copies, so that they grow within blocks alone: n matches take some n ** 1.5 steps."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def spans(b: Column, block: Column) -> Column:
        before = F.aggregate(F.slice(sizes, F.lit(1), b), F.lit(0), lambda acc, x: acc + x)
        return F.aggregate(block, F.struct(before.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    return F.coalesce(F.flatten(_blocks(pairs, spans)), none)


def candidates(docs: DataFrame, text: str, key: str, owner: Column, repository: Column) -> DataFrame:
    """(key, th, owner, repository, base, added) per row; spans as (start, kind, end, hash), the value's hash in its place."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), t.alias("t"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"))
    none = F.array().cast("array<string>")
    lists = []
    for k, p in enumerate(PATTERNS):
        has = F.col("t").rlike(p)
        lists += [F.when(has, F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none).alias(f"m{k}"), F.when(has, F.split("t", p, -1)).otherwise(none).alias(f"g{k}")]
    lists.append(F.when(F.col("t").rlike(ASSIGN), F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))).otherwise(none).alias("v0"))
    rows = rows.select("id", F.xxhash64("t").alias("th"), "owner", "repository", *lists)
    pairs = [F.arrays_zip(F.col(f"m{k}").alias("m"), F.col("v0" if k == 0 else f"m{k}").alias("v"), F.slice(f"g{k}", F.lit(1), F.size(f"m{k}")).alias("g")).alias(f"p{k}") for k in range(4)]
    rows = rows.select("id", "th", "owner", "repository", *pairs)
    rows = rows.select("*", *(_sizes(F.col(f"p{k}")).alias(f"s{k}") for k in range(4)))
    spans = [_spans(k, F.col(f"p{k}"), F.col(f"s{k}")) for k in range(4)]
    rows = rows.select("id", "th", "owner", "repository", F.filter(spans[0], lambda s: F.length(s["value"]) >= ASSIGN_LENGTH).alias("a"), spans[1].alias("b"), spans[2].alias("c"), F.filter(spans[3], lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")).alias("d"))
    rows = rows.select("id", "th", "owner", "repository", F.array_sort(F.concat("a", "b", "c")).alias("base"), "d")
    added = F.filter("d", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    return rows.select("id", "th", "owner", "repository", hashed(F.col("base")).alias("base"), hashed(added).alias("added"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_rows, n_owners, n_repositories) of each candidate value, aggregated map-side first."""
    spans = found.select("owner", "repository", F.explode(F.concat("base", "added")).alias("s"))
    each = spans.groupBy(F.col("s.hash").alias("value_hash"), "owner", "repository").agg(F.count("*").alias("n"))
    owners = each.groupBy("value_hash", "owner").agg(F.sum("n").alias("n")).groupBy("value_hash").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_owners"))
    repositories = each.groupBy("value_hash", "repository").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("*").alias("n_repositories"))
    return owners.join(repositories, "value_hash")


def scan(docs: DataFrame, owner: Column, repository: Column, most_owners: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: key, th (hash of the text), base, all_spans (start, kind, end, n_owners, n_repositories), joined digests and counts."""
    found = written(candidates(docs, text, key, owner, repository), "candidates")
    freq = written(ownership(found), "ownership")  # a table, so that both sides of the join are plain exchanges, whose skew can be split
    once = found.where("size(base) + size(added) > 0").dropDuplicates(["id", "th"]).select("id", "th", F.explode(F.concat("base", "added")).alias("s"))
    once = once.select("id", "th", "s.start", "s.kind", "s.end", F.col("s.hash").alias("value_hash"))
    known = once.join(freq, "value_hash").where((F.col("kind") < 3) | (F.col("n_owners") <= most_owners))
    per_text = known.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repositories"))).alias("all_spans"))
    per_text = per_text.select(F.col("id").alias("i2"), F.col("th").alias("h2"), "all_spans")
    out = found.join(per_text, F.col("id").eqNullSafe(F.col("i2")) & (F.col("th") == F.col("h2")), "left")
    spans = F.coalesce("all_spans", F.array().cast("array<struct<start:int,kind:int,end:int,n_owners:bigint,n_repositories:bigint>>"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        F.col("id").alias(key), "th", *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["n_owners"] <= most_owners)).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: s["n_owners"] > most_owners)).cast("long").alias("n_copied"), spans.alias("all_spans"),
    )


def _runs(spans: DataFrame) -> DataFrame:
    """Touching or overlapping spans (id, th, start, end, live) of a text as runs: (id, th, runs), in their order."""
    text = Window.partitionBy("id", "th").orderBy("start", "end")
    before = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    each = spans.withColumn("first", first).withColumn("run", F.sum("first").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    runs = each.groupBy("id", "th", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("live").alias("live"))
    return runs.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "live"))).alias("runs"))


def _masked(t: Column, runs: Column) -> Column:
    """``t`` with a mark for each run. The text is cut into as many blocks as the root of the number of runs, and pieces are cut from blocks:
    a cut reads its string from the first character on, so that n runs take n ** 0.5 times the text's length, not n times."""
    width = F.ceil(F.sqrt(F.size(runs))).cast("int")

    def block(b: Column) -> Column:
        own = F.slice(runs, b * width + 1, width)
        begin = F.when(b == 0, 0).otherwise(F.element_at(runs, F.greatest(b * width, F.lit(1)))["end"])
        return F.struct(own.alias("own"), begin.alias("begin"), F.substring(t, begin + 1, F.element_at(own, F.lit(-1))["end"] - begin).alias("text"))

    def put(x: Column) -> Column:
        def piece(run: Column, i: Column) -> Column:
            at = F.when(i == 0, x["begin"]).otherwise(F.element_at(x["own"], F.greatest(i, F.lit(1)))["end"])
            return F.concat(F.substring(x["text"], at - x["begin"] + 1, run["start"] - at), F.when(run["live"], "[SECRET]").otherwise("[EXAMPLE]"))

        return F.array_join(F.transform(x["own"], piece), "")

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(runs) / width).cast("int") - 1), block)
    return F.concat(F.array_join(F.transform(blocks, put), ""), F.substring(t, F.element_at(runs, F.lit(-1))["end"] + 1, F.length(t)))


def redact(docs: DataFrame, owner: Column, repository: Column, most_owners: int = 1, text: str = "text", key: str = "doc_id", was: str | None = None) -> DataFrame:
    """``docs`` with every span replaced: live-looking values by [SECRET], copied examples by [EXAMPLE]. Touching
    or overlapping spans become one mark, a live one if any part is. Texts without spans stay as they are; ``was`` names a column
    that tells whether a row was changed. Helper columns take names that the table hasn't."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    of_key, of_text, found, hashed = (mark + n for n in ("key", "text", "runs", "hash"))
    spans = scan(docs, owner, repository, most_owners, text, key).where("size(all_spans) > 0").select(F.col(key).alias("id"), "th", "all_spans").dropDuplicates(["id", "th"])
    each = spans.select("id", "th", F.explode("all_spans").alias("s")).select("id", "th", "s.start", "s.end", (F.col("s.n_owners") <= most_owners).alias("live"))
    runs = _runs(each).select(F.col("id").alias(of_key), F.col("th").alias(of_text), F.col("runs").alias(found))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    both = docs.withColumn(hashed, F.xxhash64(t)).join(runs, F.col(key).cast("long").eqNullSafe(F.col(of_key)) & (F.col(hashed) == F.col(of_text)), "left")
    if was:
        both = both.withColumn(was, F.col(found).isNotNull())
    return both.withColumn(text, F.when(F.col(found).isNotNull(), _masked(t, F.col(found))).otherwise(F.col(text))).drop(hashed, of_key, of_text, found)


def oracle(most_owners: int = 1) -> str:
    """The query's result as DuckDB SQL."""
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda q: length(q))), 0)"
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    parts = []
    for k, p in enumerate(PATTERNS):
        value = f"regexp_extract_all(t, {quote(p)}, {2 if k == 0 else 0})"
        parts.append(f"""list_transform(range(1, len(regexp_extract_all(t, {quote(p)})) + 1), lambda i: {{'s': CAST({size(f"string_split_regex(t, {quote(p)})[1:i]")} + {size(f"regexp_extract_all(t, {quote(p)})[1:i-1]")} AS BIGINT), 'k': {k}, 'e': CAST({size(f"string_split_regex(t, {quote(p)})[1:i]")} + {size(f"regexp_extract_all(t, {quote(p)})[1:i]")} AS BIGINT), 'v': {value}[i]}}) AS x{k}""")
    names = "['assign', 'access', 'hex', 'mixed']"
    joined = lambda xs: f"array_to_string(list_transform({xs}, lambda z: concat({names}[z.k + 1], ':', z.s, ':', z.e)), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat(coalesce(source, ''), '/', coalesce(lang, '')) AS repo FROM documents),
f AS (SELECT doc_id, owner, repo, {", ".join(parts)} FROM d),
b AS (SELECT doc_id, owner, repo, list_sort(list_concat(list_filter(x0, lambda z: length(z.v) >= {ASSIGN_LENGTH}), x1, x2)) AS base,
      list_filter(x3, lambda z: regexp_matches(z.v, '[0-9]') AND regexp_matches(z.v, '[a-z]') AND regexp_matches(z.v, '[A-Z]')) AS x3 FROM f),
c AS (SELECT doc_id, owner, repo, base, list_filter(x3, lambda z: len(list_filter(base, lambda y: y.s < z.e AND z.s < y.e)) = 0) AS added FROM b),
e AS (SELECT doc_id, owner, repo, unnest(list_concat(base, added)) AS z FROM c),
n AS (SELECT z.v AS v, count(DISTINCT owner) AS owners FROM e GROUP BY 1),
g AS (SELECT doc_id, list_sort(list({{'s': z.s, 'k': z.k, 'e': z.e, 'o': owners}})) AS a FROM e JOIN n ON e.z.v = n.v WHERE z.k < 3 OR owners <= {most_owners} GROUP BY 1)
SELECT c.doc_id, CAST(len(list_filter(base, lambda z: z.k = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(base, lambda z: z.k = 1)) AS BIGINT) AS n_access,
       CAST(len(list_filter(base, lambda z: z.k = 2)) AS BIGINT) AS n_hex, sha256({joined("base")}) AS base_sha256, coalesce({joined("a")}, '') AS spans,
       CAST(coalesce(len(list_filter(a, lambda z: z.o <= {most_owners})), 0) AS BIGINT) AS n_live, CAST(coalesce(len(list_filter(a, lambda z: z.o > {most_owners})), 0) AS BIGINT) AS n_copied
FROM c LEFT JOIN g ON c.doc_id = g.doc_id"""
