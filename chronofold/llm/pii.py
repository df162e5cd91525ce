"""Personal data by patterns that extend themselves from their contexts.

Base spans are found by regular expressions. They are the seeds of a bootstrap: the words before
and after a span are its lexical patterns, and pattern and instance score one another in turns. A
pattern's score for a kind is the share of its distinct instances that have the kind, an
instance's is the chance that one of its patterns is right. Candidates that no expression matches,
but whose patterns score high, are added as spans of that kind: tokens without blanks that have a
digit or an at sign, groups of digits joined by blanks, dots, hyphens, slashes or parentheses, and
addresses with (at), [at] or {at}, all of at least six characters. Of added spans within one another
the longest counts. Base spans always stay. A neighbouring word of more than 200 characters is no pattern.

All rows are expressions over one scan of the texts, and only mentions leave it. Offsets are code
points, ends exclusive.

Defined results: null and empty texts have no span. Equal rows get equal spans; rows are told apart
by key and a hash of the text. Empty tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import discard, join_on_hot, written

#: The kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: The given expressions. A look-behind keeps a match from being tried inside a run that has failed from its start
#: already, and possessive repeats keep the matcher from going back; neither changes what matches.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Tokens that may be identifiers: no white space, and a digit or an at sign.
_TOKEN = r"(?<![^\s,;])(?=[A-Za-z._%+()\[\]-]*[0-9@])[A-Za-z0-9(][A-Za-z0-9._%+()@\[\]-]*+"
#: Groups of digits with signs between them, as phones and cards are written.
_GROUPS = r"(?<![A-Za-z0-9])[+(]{0,2}+[0-9]++(?:[\x20()./-]{1,3}+[0-9]++)++"
#: Addresses whose at sign, and maybe dots, are written out.
_AT = r"(?:\([aA][tT]\)|\[[aA][tT]\]|\{[aA][tT]\})"
_DOT = r"(?:\.|\x20?(?:\([dD][oO][tT]\)|\[[dD][oO][tT]\]|\{[dD][oO][tT]\})\x20?)"
_WRITTEN_OUT = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?{_AT}\x20?[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
_MENTION = "array<struct<start:int,end:int,m:string>>"


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


#: Matches whose places are counted one after the other; those of longer lists are counted block by block.
_BLOCK = 64
#: Code points of the pieces of a text in which the neighbours of a mention are looked for, and of the longest neighbour.
_PIECE, _NEIGHBOUR = 1024, 200


def _blocks(values: Column) -> Column:
    """An array cut into arrays of _BLOCK members."""
    return _let(values, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda i: F.slice(v, i * _BLOCK + 1, F.lit(_BLOCK))))


def _append(values: Column, value: Column) -> Column:
    return F.concat(values, F.array(value))


def matches(text: Column, pattern: str) -> Column:
    """(start, end, m) of all matches, leftmost first.

    An array grows by copying, so places are summed up by blocks: the work stays in proportion to the text.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = _blocks(F.arrays_zip(between.alias("b"), found.alias("m")))
    width = lambda x: F.length(x["b"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["m"])
        more = _append(acc["out"], F.struct(s.alias("start"), e.alias("end"), x["m"].alias("m")))
        return F.struct(F.coalesce(e, s).alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(more).alias("out"))

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + width(x)))
        first = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: _append(a, F.element_at(a, -1) + n))
        lists = _let(first, lambda at: F.transform(blocks, lambda b, i: F.aggregate(b, F.struct(F.get(at, i).alias("at"), F.array().cast(_MENTION).alias("out")), step, lambda acc: acc["out"])))
        return F.flatten(lists)

    return _let(parts, placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others."""
    every = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))))
    return F.aggregate(every, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """(kind, start, end, m) of all base spans; kind is a place in KINDS."""
    none = F.array().cast(_MENTION)
    digit = text.rlike("[0-9]")

    def kind(k: int, found: Column, valid) -> Column:
        return F.transform(F.filter(found, lambda x: valid(x["m"])), lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m")))

    email = F.when(F.contains(text, F.lit("@")), matches(text, _EMAIL)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), matches(text, _IP)).otherwise(none)
    card = F.when(digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), matches(text, _CARD)).otherwise(none)
    phone = F.when(text.rlike(r"\+[0-9]"), matches(text, _PHONE)).otherwise(none)
    is_card = lambda m: _let(_digits(m), lambda d: F.length(d).between(16, 19) & luhn(d))
    return F.concat(
        kind(0, email, lambda m: F.lit(True)),
        kind(1, ip, lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        kind(2, card, is_card),
        kind(3, phone, lambda m: F.length(_digits(m)).between(8, 15)),
    )


def _mentions(text: Column, base: Column) -> Column:
    """Base spans and candidates (kind -1), with the words before and after."""
    none = F.array().cast(_MENTION)
    sign = text.rlike("[0-9@]")
    token = F.when(sign, F.filter(matches(text, _TOKEN), lambda x: x["m"].rlike("[0-9@]"))).otherwise(none)
    groups = F.when(text.rlike(r"[0-9][\x20()./-]{1,3}[0-9]"), matches(text, _GROUPS)).otherwise(none)
    address = F.when(text.rlike(_AT), matches(text, _WRITTEN_OUT)).otherwise(none)
    tokens = F.filter(F.concat(token, groups, address), lambda x: F.length(x["m"]) >= 6)
    other = F.transform(tokens, lambda x: F.struct(F.lit(-1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m")))
    word = lambda x: F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}:=#]+$", ""))
    size = F.length(text)

    def around(pieces: Column) -> Column:
        # A place in a long text costs a walk from its start; in a piece it doesn't.
        def cut(at: Column, n: Column) -> Column:
            i = F.floor(at / _PIECE).cast("int")
            return F.substring(F.concat(F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, i + 1), F.lit(""))), at % _PIECE + 1, n)

        def left(x: Column) -> Column:
            lo = F.greatest(x["start"] - _NEIGHBOUR, F.lit(0))
            whole = lambda s: F.when((lo == 0) | s.rlike(r"^\s|\s\S+\s*$"), word(F.regexp_extract(s, r"(\S++)\s*$", 1)))
            return F.coalesce(_let(cut(lo, x["start"] - lo), whole), F.lit(""))

        def right(x: Column) -> Column:
            whole = lambda s: F.when((x["end"] + _NEIGHBOUR >= size) | s.rlike(r"^\s*\S+\s"), word(F.regexp_extract(s, r"^\s*(\S+)", 1)))
            return F.coalesce(_let(cut(x["end"], F.lit(_NEIGHBOUR)), whole), F.lit(""))

        return F.transform(F.concat(base, other), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), left(x).alias("left"), right(x).alias("right")))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), around)


def _free(mentions: DataFrame) -> DataFrame:
    """The mentions (key, tid, kind, start, end, ...) without candidates that overlap a base span of their text."""
    seed, text = F.col("kind") >= 0, Window.partitionBy("key", "tid")
    so_far = lambda *by: text.orderBy(*by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.max(F.when(seed, F.col("end"))).over(so_far("start"))
    #: Read from the end, as a frame that ends with its partition would be summed up anew for each row.
    next_ = F.min(F.when(seed, F.col("start"))).over(so_far(F.desc("start")))
    marked = mentions.withColumn("until", until).withColumn("next", next_)
    return marked.where(seed | ((F.coalesce("until", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))).drop("until", "next")


def discovered(mentions: DataFrame, rounds: int = 3, least_score: float = 0.9, least_support: int = 5) -> DataFrame:
    """(key, tid, kind, start, end) of the mentions of kind -1 that the bootstrap gives a kind.

    mentions: (key, tid, kind, start, end, m, left, right).
    """
    sides = F.array(F.concat(F.lit("<"), F.col("left")), F.concat(F.lit(">"), F.col("right")))
    edges = written(mentions.select("m", "kind", F.explode(sides).alias("pattern")).where(F.length("pattern") > 1).distinct(), "pii-graph")
    support = edges.groupBy("pattern").agg(F.count_distinct("m").alias("n")).where(F.col("n") >= least_support)
    seeds = edges.where("kind >= 0").select("m", "kind", F.lit(1.0).alias("score")).distinct()
    open_ = written(edges.where("kind < 0").select("m", "pattern").distinct(), "pii-open")
    pairs = written(edges.select("m", "pattern").distinct(), "pii-pairs")
    n_pairs, n_open = pairs.count(), open_.count()
    by_m = pairs.groupBy("m").agg(F.count("*").alias("pairs"))
    scores = None
    for _ in range(rounds):
        known = (seeds if scores is None else scores).groupBy("m").agg(F.collect_list(F.struct("kind", "score")).alias("scores"))  # one or two kinds, by pattern at most all
        hits = join_on_hot(pairs, known.join(by_m, "m"), ["m"], "pairs", n_pairs).select("pattern", F.inline("scores")).groupBy("pattern", "kind").agg(F.sum("score").alias("hits"))
        #: One unseen instance more than there is keeps rare patterns from being sure.
        good = hits.join(support, "pattern").select("pattern", "n", "kind", (F.col("hits") / (F.col("n") + 1)).alias("p")).where(F.col("p") >= 0.5)
        patterns = written(good.groupBy("pattern", "n").agg(F.collect_list(F.struct("kind", "p")).alias("kinds")), "pii-patterns")
        found = join_on_hot(open_, patterns, ["pattern"], "n", n_open).select("m", F.inline("kinds")).groupBy("m", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("score"))
        was, scores = scores, written(seeds.unionByName(found), "pii-scores")
        discard(patterns, *([was] if was is not None else []))
    best = scores.where(F.col("score") >= least_score).groupBy("m").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("named"))
    candidates = mentions.where("kind < 0")
    times = candidates.groupBy("m").agg(F.count("*").alias("times"))
    return join_on_hot(candidates, best.join(times, "m"), ["m"], "times", candidates.count()).select("key", "tid", F.col("named").alias("kind"), "start", "end")


def _longest(spans: DataFrame) -> DataFrame:
    """Each of the spans (key, tid, kind, start, end) that lies within no other of its text, once."""
    before = Window.partitionBy("key", "tid").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.distinct().withColumn("_reach", F.max("end").over(before)).where("_reach IS NULL OR _reach < end").drop("_reach")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans) of each row of `docs`: arrays of (kind, start, end), by kind and start."""
    whole = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = F.when(F.col("t").rlike("[0-9@]|" + _AT), _let(F.col("t"), lambda t: _let(base_spans(t), lambda b: F.struct(b.alias("base"), _mentions(t, b).alias("mentions")))))
    table = written(whole.select("key", F.xxhash64("t").alias("tid"), found.alias("x")).select("key", "tid", "x.base", "x.mentions"), "pii-mentions")
    mentions = table.select("key", "tid", "base", F.explode("mentions").alias("x")).select("key", "tid", (F.size("base") > 0).alias("seeded"), "x.*")
    mentions = mentions.where("NOT seeded").unionByName(_free(mentions.where("seeded").distinct()))
    mentions = written(mentions.drop("seeded"), "pii-free")
    span = F.struct("kind", "start", "end")
    added = _longest(discovered(mentions)).groupBy("key", "tid").agg(F.collect_set(span).alias("added")).withColumnRenamed("key", "k").withColumnRenamed("tid", "h")
    slim = F.transform(F.coalesce("base", F.array().cast("array<struct<kind:int,start:int,end:int,m:string>>")), lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    out = table.select("key", "tid", F.array_sort(slim).alias("base")).join(added, F.col("key").eqNullSafe(F.col("k")) & (F.col("tid") == F.col("h")), "left")
    return out.select(F.col("key").alias(key), "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
