"""Removal of lines that several documents share.

Each line is hashed (128 bits of its trimmed, lower-cased form). The hashes are dealt out by
ranges of their space and sorted there by document, greatest first, and position, so that one
pass over a range sees the first occurrence of a line before the others. A range with far more
lines than the mean holds a very common line: its rows are dealt out by document besides, the
heads of the parts are merged, and what is found of the commonest lines, a bounded number, goes to
their rows by broadcast. What goes back to a document is a bitmap of the
lines that it keeps, compressed to runs, and not text.

Defined results: a null text counts as one empty line. Rows that share a doc_id are one document,
and a position dropped there is dropped in each of them; a null doc_id ranks below all others.
Lines shorter than `min_chars` are never dropped. Empty tables give no rows; other columns pass
through, and columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import SPACE_CHARS, ascii_lower, fresh, join_on_hot, written

#: The hash space is cut into this many equal ranges.
RANGE_BITS = 14
#: A range with so many times the mean number of lines is dealt out by document, to so many parts.
HOT_TIMES, HOT_PARTS = 4, 256


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashed_lines(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(doc, pos, h1, h2, part): the lines that are long enough to be compared."""
    trimmed = docs.select(F.col(key).alias("doc"), F.posexplode(_lines(F.col(text))).alias("pos", "line")).select("doc", "pos", F.btrim("line", F.lit(SPACE_CHARS)).alias("line"))
    low = trimmed.where(F.length("line") >= min_chars).select("doc", "pos", ascii_lower(F.col("line")).alias("line"))
    return low.select("doc", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).withColumn("part", F.shiftrightunsigned("h1", 64 - RANGE_BITS).cast("int"))


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, pos) of each line to drop."""
    lines = hashed_lines(docs, key, text, min_chars)
    counts = {r["part"]: r["count"] for r in lines.groupBy("part").count().collect()}  # 2^14 rows at most
    mean = sum(counts.values()) / (1 << RANGE_BITS)
    hot = [part for part, n in counts.items() if n > max(HOT_TIMES * mean, 64)]
    is_hot = F.array_contains(F.lit(sorted(hot)), F.col("part")) if hot else F.lit(False)
    dealt = lines.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("doc"), F.lit(HOT_PARTS))).otherwise(0).cast("int")).repartition("part", "salt")
    run = Window.partitionBy("part", "salt", "h1", "h2")
    ordered = run.orderBy(F.col("doc").desc_nulls_last(), "pos")
    runs = dealt.withColumn("rank", F.dense_rank().over(run.orderBy(F.col("doc").desc_nulls_last()))).withColumn("first", F.row_number().over(ordered) == 1).withColumn("docs", F.max("rank").over(run))
    runs = runs.withColumn("hot", is_hot)
    #: In the other ranges the first occurrence is known to be the one to keep.
    found = written(runs.where(F.col("hot") | ((F.col("docs") >= min_docs) & (F.col("rank") > 1))).select("doc", "pos", "h1", "h2", "rank", "docs", "first", "hot"), "line-runs")
    sure = found.where(~F.col("hot")).select("doc", "pos")
    parts = found.where("hot")
    per = parts.groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.sum(F.when(F.col("first"), F.col("docs"))).alias("docs"), F.count("*").alias("rows"))
    heads = per.where(F.col("docs") >= min_docs).select("h1", "h2", "keeper", "rows")
    shared = join_on_hot(parts, heads, ["h1", "h2"], "rows", parts.count() if hot else 0)
    return sure.unionByName(shared.where(~F.col("doc").eqNullSafe(F.col("keeper"))).select("doc", "pos"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All rows of `docs`, with n_lines, n_dropped and keep_runs: the runs (start, n) of kept lines."""
    docs = docs.drop("n_lines", "n_dropped", "keep_runs")
    gone, own = fresh(docs, "gone"), fresh(docs, "doc")
    found = dropped_lines(docs.select(key, text), key, text, min_chars, min_docs).groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias(gone)).withColumnRenamed("doc", own)
    out = docs.join(found, docs[key].eqNullSafe(found[own]), "left").drop(own)
    out = out.withColumn("n_lines", F.size(_lines(F.col(text))).cast("long")).withColumn(gone, F.coalesce(gone, F.array().cast("array<int>")))
    # Places beyond the end come from longer rows with the same key; the rare case alone looks at each place, as a
    # filter above this puts the counting of lines into the lambda.
    beyond = F.coalesce(F.array_max(gone), F.lit(-1)) >= F.col("n_lines")
    out = out.withColumn(gone, F.when(beyond, F.filter(gone, lambda p: p < F.col("n_lines"))).otherwise(F.col(gone)))
    #: Between two neighbouring dropped lines lies one run of kept ones, perhaps empty.
    edges = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.col("n_lines").cast("int")))
    runs = F.transform(F.slice(edges, 2, F.size(edges)), lambda end, i: F.struct((F.get(edges, i) + 1).alias("start"), (end - F.get(edges, i) - 1).alias("n")))
    return out.withColumn("n_dropped", F.size(gone).cast("long")).withColumn("keep_runs", F.filter(runs, lambda r: r["n"] > 0)).drop(gone)


def kept_text(text: Column, runs: Column, n_dropped: Column) -> Column:
    """The lines in `runs`, joined again; the text itself where nothing was dropped."""
    whole = F.coalesce(text, F.lit(""))
    pieces = F.transform(F.array(_lines(text)), lambda lines: F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["n"]))), "\n"))
    return F.when(n_dropped == 0, whole).otherwise(pieces[0])


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id <> g.keeper AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
