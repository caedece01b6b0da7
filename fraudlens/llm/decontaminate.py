"""Benchmark decontamination by template windows.

A text's words (between blanks) lose punctuation at both ends; words that were
only punctuation are dropped.  The others become template tokens, each from the
word alone: numbers (a digit first) become `0`, names (a capital first,
but not capitals alone) become `A`, units of measure become `u`, all else is
lower-cased.  A template window is
`width` consecutive tokens, of which at least `literals` must not be
placeholders; an item of fewer than `width` but at least `shortest` tokens is
one window.  Shorter items are not searched for: they'd match clean texts.

A document is contaminated if one of its windows has the tokens of a benchmark
window and fills the slots consistently: equal values in the benchmark's window
stand for equal values in the document's, so that a question with other numbers
and names is found, and a chance agreement of placeholders isn't.

Only DataFrame expressions are used.  The first pass hashes each document's
windows inside its row and looks the hashes up among the benchmark's; the
second compares tokens and slots, and reads only the documents that had a hit.
The benchmark's windows and the ids of documents with hits are broadcast if
counted to be few, else joined by a shuffle.

Null and empty texts have no windows.  Repeated rows are judged alike; hits are
counted for each doc_id over all its rows.  Rows with a null doc_id are never
contaminated.  Null items are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._checkpoint import checkpoint

#: Units of measure, lower case.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons", "lb", "lbs", "oz", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "km/h", "mph", "usd", "eur", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "°c", "°f", "kwh", "mb", "gb")

#: What is cut from both ends of a word.
MARKS = ".,;:!?%$&*#()[]{}<>\"'`|~^_=+/\\-…«»“”‘’„¿¡—–"

_BLANKS = "' \\t\\n\\u000B\\f\\r'"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once and not again in each step of a lambda."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words without outer punctuation, in order; words of punctuation alone are left out."""
    split = F.split(F.btrim(F.coalesce(text, F.lit("")), F.expr(_BLANKS)), "[\\x20\\x09-\\x0D]+")
    return F.filter(F.transform(split, lambda w: F.btrim(w, F.expr(_quote(MARKS)))), lambda w: w != "")


def tokens(array: Column) -> Column:
    """Template tokens of words()."""

    def token(w: Column) -> Column:
        first = F.ascii(w)
        return (
            F.when(first.between(48, 57), F.lit("0"))
            .when((first.between(65, 90) | (first.between(192, 222) & (first != 215))) & (w != F.upper(w)), F.lit("A"))
            .when(w.isin(*UNITS), F.lit("u"))
            .otherwise(F.lower(w))
        )

    return F.transform(array, token)


def _hashes(array: Column, width: Column | int) -> Column:
    """The hash of each window of a token array."""
    width = F.lit(width) if isinstance(width, int) else width

    def windows(own: Column) -> Column:
        starts = F.when(F.size(own) >= width, F.sequence(F.lit(1), F.size(own) - width + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(own, i, width)))

    return _let(F.transform(array, lambda t: F.xxhash64(t)), windows)


def benchmark_windows(benchmark: DataFrame, width: int, literals: int, shortest: int) -> DataFrame:
    """(item_id, n, h, tokens, words): the windows of all items."""
    items = benchmark.where("text IS NOT NULL").select("item_id", words(F.col("text")).alias("w")).withColumn("t", tokens(F.col("w")))
    items = items.where(F.size("t") >= shortest).withColumn("n", F.least(F.size("t"), F.lit(width)))
    at = items.select("item_id", "n", "t", "w", F.posexplode(_hashes(F.col("t"), F.col("n"))).alias("i", "h"))
    out = at.select("item_id", "n", "h", F.slice("t", F.col("i") + 1, F.col("n")).alias("tokens"), F.slice("w", F.col("i") + 1, F.col("n")).alias("words"))
    plain = F.size(F.filter("tokens", lambda t: ~t.isin("0", "A", "u")))
    return out.where(plain >= F.least(F.lit(literals), F.col("n") - 1))


def consistent(theirs: Column, ours: Column, template: Column) -> Column:
    """Whether equal slot values of `theirs` stand for equal values in `ours`."""
    pairs = F.filter(F.arrays_zip(theirs.alias("a"), ours.alias("b"), template.alias("t")), lambda x: x["t"].isin("0", "A", "u"))
    both = F.array_distinct(F.transform(pairs, lambda x: F.struct(x["a"], x["b"])))
    return F.size(both) == F.size(F.array_distinct(F.transform(pairs, lambda x: x["a"])))


def _few(side: DataFrame, most: int) -> DataFrame:
    return F.broadcast(side) if side.count() <= most else side


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 8, literals: int = 5, shortest: int = 5, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_windows, n_items and first_item of every contaminated doc_id."""
    windows = checkpoint(benchmark_windows(benchmark, width, literals, shortest))
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most `width` of them
    if not lengths:
        return docs.select("doc_id").limit(0).selectExpr("doc_id", "0L AS n_windows", "0L AS n_items", "0L AS first_item")
    wanted = _few(windows.select("h").distinct(), broadcast_rows)
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    template = docs.select("doc_id", tokens(words(F.col("text"))).alias("t"))
    found = template.select("doc_id", F.explode(_let(F.col("t"), lambda t: F.concat(*(_hashes(t, n) for n in lengths)))).alias("h"))
    ids = checkpoint(found.join(wanted, "h", "left_semi").select("doc_id").distinct())
    some = docs.join(_few(ids, broadcast_rows), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("dw"))
    some = some.withColumn("dt", tokens(F.col("dw")))
    at = None
    for n in lengths:
        part = some.select("doc_id", "dw", "dt", F.posexplode(_hashes(F.col("dt"), n)).alias("i", "h")).withColumn("n", F.lit(n))
        at = part if at is None else at.unionByName(part)
    few = _few(windows, broadcast_rows)
    pairs = at.join(few, ["h", "n"]).select("doc_id", "item_id", "i", "n", "tokens", "words", F.slice("dt", F.col("i") + 1, F.col("n")).alias("dt"), F.slice("dw", F.col("i") + 1, F.col("n")).alias("dw"))
    good = pairs.where(F.col("dt") == F.col("tokens")).where(consistent(F.col("words"), F.col("dw"), F.col("tokens")))
    return good.groupBy("doc_id").agg(F.count_distinct("i", "n").alias("n_windows"), F.count_distinct("item_id").alias("n_items"), F.min("item_id").cast("long").alias("first_item"))


def judge(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_windows, n_items and first_item of every row of docs."""
    found = hits(docs, benchmark, **options)
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.col("n_windows").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "first_item"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whose doc_id isn't contaminated."""
    return docs.join(hits(docs, benchmark, **options).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def oracle(width: int = 8, literals: int = 5, shortest: int = 5) -> str:
    """DuckDB SQL for judge() over documents and benchmark."""
    marks, units = MARKS.replace("'", "''"), ", ".join("'" + u + "'" for u in UNITS)
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    words = f"list_filter(list_transform(regexp_split_to_array(trim(coalesce(text, ''), {blanks}), '[ \\x09-\\x0D]+'), lambda x: trim(x, '{marks}')), lambda x: x <> '')"
    capital = "(unicode(x) BETWEEN 65 AND 90 OR (unicode(x) BETWEEN 192 AND 222 AND unicode(x) <> 215))"
    tokens = f"list_transform(w, lambda x: CASE WHEN unicode(x) BETWEEN 48 AND 57 THEN '0' WHEN {capital} AND x <> upper(x) THEN 'A' WHEN x IN ({units}) THEN 'u' ELSE lower(x) END)"
    return f"""
WITH bw AS (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL),
  bt AS (SELECT item_id, w, {tokens} AS t, least(len(w), {width}) AS n FROM bw WHERE len(w) >= {shortest}),
  bi AS (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM bt),
  win AS (SELECT item_id, n, t[i:i + n - 1] AS tk, w[i:i + n - 1] AS ww FROM bi),
  good AS (SELECT * FROM win WHERE len(list_filter(tk, lambda x: x NOT IN ('0', 'A', 'u'))) >= least({literals}, n - 1)),
  dw AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
  dt AS (SELECT doc_id, w, {tokens} AS t FROM dw),
  dn AS (SELECT doc_id, w, t, n FROM dt CROSS JOIN (SELECT DISTINCT n FROM good) l WHERE len(t) >= n),
  di AS (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM dn),
  hit AS (SELECT d.doc_id, d.i, d.n, g.item_id, list_filter(list_zip(g.ww, d.w[d.i:d.i + d.n - 1], g.tk), lambda z: z[3] IN ('0', 'A', 'u')) AS slots
    FROM di d JOIN good g ON g.n = d.n AND g.tk = d.t[d.i:d.i + d.n - 1]),
  ok AS (SELECT * FROM hit WHERE len(list_distinct(list_transform(slots, lambda z: [z[1], z[2]]))) = len(list_distinct(list_transform(slots, lambda z: z[1])))),
  found AS (SELECT doc_id, count(DISTINCT [i, n]) AS n_windows, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item FROM ok GROUP BY doc_id)
SELECT d.doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(n_windows, 0) AS n_windows, coalesce(n_items, 0) AS n_items, first_item
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id"""
