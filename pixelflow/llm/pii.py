"""Personal data: base patterns, and identifiers that bootstrapped contexts discover. DataFrame operations alone.

One expression per kind marks its matches, so that a split gives them and the text between them, whose lengths, summed over a
document's matches, give every match's place in code points. The expressions are written so that Java's matcher
neither recurses nor rescans (possessive runs, starts tied to a run's first character or the
previous match's end); they match what the plain forms in `PLAIN` match.

The method. Seeds are the base spans, and credentials (kind `secret`: access key ids, and values assigned to a password,
token or the like). Candidates are other identifier-like strings: runs of letters, digits and `@._%+#/-` with a
digit or an at sign, and up to six groups of digits with single blanks between them; none is too long. What stands around a seed or
candidate is its lexical patterns: the two words before it, the word before it, the word after it (lower-cased, digits
made alike). Patterns and distinct strings form a graph, scored in rounds until nothing changes or ROUNDS are over:

- a pattern's score for a kind is the mean, over its distinct strings, of their scores for the kind (a seed's is 1, an unknown string's 0);
- it is accepted with a score of MIN_SCORE or more and MIN_SEEDS distinct strings of such a score;
- a candidate of the kind's make-up (`_made_like`) gets 1 - product(1 - score) over its accepted patterns,
  and so supports, in the next round, the patterns around it wherever else it occurs.

A candidate with a score becomes a span at all its places. Discovered spans overlap no seed.

Defined results: null and empty texts have no spans; rows with equal doc_id and text get equal spans; spans
of different kinds may overlap; U+FFFF in a text counts as U+FFFE; extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4  # the first kinds are base kinds
#: The base patterns as they are stated.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OWN = r"A-Za-z0-9@._%+#/\-"  # what identifiers are made of
MATCHERS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<=[A-Za-z0-9-]|\.(?=[A-Za-z0-9-])))*+",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[0-9 -](?<=[0-9]|[ -](?=[0-9])))++",
    PLAIN["phone"],
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=(?i:password|passwd|secret|token|api.?key)[\"']? ?[=:] ?[\"']?)[A-Za-z0-9/+_-]{12,}+",
)
CANDIDATE = rf"(?<![{OWN}])(?:[(+]?[0-9][0-9().-]*+(?: [(]?[0-9][0-9().-]*+){{1,5}}+(?![{OWN}])|[{OWN}&&[^0-9@]]*+[0-9@][{OWN}]*+)"
NEED = ("@", r"[0-9]\.[0-9]", "[0-9]", r"\+[0-9]", r"AKIA|[=:]")
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WORDS_BACK = r"^[ \t\n\x0B\f\r\"'(\[<]*+([^ \t\n\x0B\f\r\"'(\[<]++)(?:[ \t\n\x0B\f\r\"'(\[<]++([^ \t\n\x0B\f\r\"'(\[<]++))?"
WORD_ON = r"^[ \t\n\x0B\f\r\"')\]>.,;:!?]*+([^ \t\n\x0B\f\r\"')\]>.,;:!?]++)"
MARK, OTHER = "\uffff", "\ufffe"
ROUNDS = 6
MIN_SEEDS = 3
MIN_SCORE = 0.8
CANDIDATES, ROW = -1, -2  # ranks of what is no seed: candidates, and a mark for each document row

_KEY = ("did", "th")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    digit = lambda i: F.substr(back, i, F.lit(1)).cast("int")
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _holds(rank: Column, match: Column) -> Column:
    """Whether a seed's match stands; emails always do."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    ip = match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    card = F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.when(rank == 1, ip).when(rank == 2, card).when(rank == 3, F.length(digits).between(9, 15)).when(rank == 4, match.rlike("[0-9]")).otherwise(True)


def _matches(text: Column, rank: int, pattern: str, need: str) -> Column:
    """array<struct<rank, i, gap, text, before, second, after>>: every match, the length of the text since the last one, and the words around."""
    none = "array<struct<rank:int,i:int,gap:int,text:string,before:string,second:string,after:string>>"

    def every(cut):  # a variable of a lambda, so that the text is cut once
        def one(k):
            back, on = F.reverse(F.get(cut, k - 1)), F.get(cut, k + 1)
            word = lambda n: F.reverse(F.regexp_extract(back, WORDS_BACK, n))
            return F.struct(F.lit(rank).alias("rank"), k.alias("i"), F.length(back).alias("gap"), F.get(cut, k).alias("text"), word(1).alias("before"), word(2).alias("second"), F.regexp_extract(on, WORD_ON, 1).alias("after"))

        return F.when(F.size(cut) > 1, F.transform(F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2)), one)).otherwise(F.array().cast(none))

    cut = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(text.rlike(need), F.flatten(F.transform(F.array(cut), every))).otherwise(F.array().cast(none))


def _contexts() -> Column:
    alike = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "9")
    some = lambda c: F.col(c) != ""
    return F.array_compact(F.array(F.when(some("second"), F.concat(F.lit("2 "), alike("second"), F.lit(" "), alike("before"))), F.when(some("before"), F.concat(F.lit("1 "), alike("before"))), F.when(some("after"), F.concat(F.lit("+ "), alike("after")))))


def found(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(did, th, doc_id) of every document row, and of every (did, th) once its seeds and the candidates that overlap none:
    (did, th, rank, start, end, text, contexts)."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, OTHER)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64("text").alias("th"), text.alias("text"))
    empty = lambda kind: F.lit(None).cast(kind)
    row = F.array(F.struct(F.lit(ROW).alias("rank"), F.lit(0).alias("i"), F.lit(0).alias("gap"), *(empty("string").alias(c) for c in ("text", "before", "second", "after"))))
    every = F.concat(row, *(_matches(F.col("text"), k, p, n) for k, (p, n) in enumerate(zip(MATCHERS, NEED, strict=True))), _matches(F.col("text"), CANDIDATES, CANDIDATE, "[0-9@]"))
    each = rows.select(*_KEY, "doc_id", F.explode(F.when(F.col("text").rlike("[0-9@]"), every).otherwise(row)).alias("m")).select(*_KEY, "doc_id", "m.*")
    each = scratch.save(each, "matches")
    # repeated rows count once; places are running sums within a document and kind
    once = each.where(F.col("rank") != ROW).repartition(*_KEY).dropDuplicates([*_KEY, "rank", "i"])
    before = Window.partitionBy(*_KEY, "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("gap") + F.length("text")).over(before), F.lit(0)) + F.col("gap")
    placed = once.withColumn("start", at.cast("int")).where((F.col("rank") < 0) | _holds(F.col("rank"), F.col("text")))
    # a candidate stands without the punctuation at its ends
    left = F.length("text") - F.length(F.regexp_replace("text", "^[._%#/-]++", ""))
    right = F.when(F.col("rank") < 0, F.regexp_replace("text", "^[._%#/-]++|(?<![._%#/+-])[._%#/+-]++$", "")).otherwise(F.col("text"))
    placed = placed.withColumn("start", F.when(F.col("rank") < 0, F.col("start") + left).otherwise(F.col("start"))).withColumn("text", right)
    placed = placed.withColumn("end", F.col("start") + F.length("text")).where("end > start")
    seeds = lambda c: F.when(F.col("rank") >= 0, F.col(c))
    over = lambda *o: Window.partitionBy(*_KEY).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(seeds("end")).over(over("start", F.desc("rank")))  # by seeds that begin before, or there
    following = F.min(seeds("start")).over(over(F.desc("start"), F.desc("rank")))
    free = F.coalesce(reached <= F.col("start"), F.lit(True)) & F.coalesce(following >= F.col("end"), F.lit(True))
    placed = placed.withColumn("free", (F.col("rank") >= 0) | free).where("free")
    return each.where(F.col("rank") == ROW).select(*_KEY, "doc_id"), scratch.save(placed.select(*_KEY, "rank", "start", "end", "text", _contexts().alias("contexts")), "placed")


def _made_like(rank: Column, text: Column) -> Column:
    """Whether a string is made like those of a kind."""
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    ip = text.rlike(r"^[0-9]{1,3}(?:\.(?:[0-9]{1,3}|[x*])){2,3}(?:/[0-9]{1,2})?$")
    card = text.rlike("^[0-9][0-9 -]*[0-9]$") & digits.between(12, 19)
    phone = text.rlike(r"^[+(]?[0-9][0-9 ().-]*$") & digits.between(7, 15)
    secret = text.rlike("^[a-z0-9/+_.-]{12,}$") & text.rlike("[0-9]") & text.rlike("[a-z]")
    return F.when(rank == 0, text.rlike("^[^@]+@[^@]+$")).when(rank == 1, ip).when(rank == 2, card).when(rank == 3, phone).otherwise(secret)


def discovered(placed: DataFrame, scratch: Scratch, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """The accepted patterns (context, rank, score, seeds), and the strings they discover (instance, rank, score)."""
    every = placed.select(F.explode("contexts").alias("context"), F.lower("text").alias("instance"), "rank").distinct()
    every = scratch.save(every, "pattern-edges")
    # a pattern of fewer distinct strings can't be accepted
    totals = scratch.save(every.select("context", "instance").distinct().groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds), "pattern-totals")
    edges = scratch.save(every.join(totals, "context"), "pattern-links")
    links, open_ends = edges.select("context", "n", "instance").distinct(), edges.where(F.col("rank") == CANDIDATES).select("context", "instance")
    seeds = scratch.save(edges.where("rank >= 0").select("instance", "rank", F.lit(1.0).alias("score")).distinct(), "seeds")
    known, state, got = seeds, None, None
    for n in range(rounds):
        support = links.join(known, "instance").groupBy("context", "n", "rank").agg(F.sum("score").alias("held"), F.count_if(F.col("score") >= min_score).alias("seeds"))
        good = support.select("context", "rank", (F.col("held") / F.col("n")).alias("score"), "seeds").where((F.col("seeds") >= min_seeds) & (F.col("score") >= min_score))
        good = scratch.save(good, f"patterns-{n}")
        held = open_ends.join(good, "context").where(_made_like(F.col("rank"), F.col("instance"))).groupBy("instance", "rank")
        got = held.agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("score")))))).alias("score"))
        got = scratch.save(got.join(seeds.select("instance", "rank"), ["instance", "rank"], "left_anti"), f"instances-{n}")
        before, state = state, tuple(got.agg(F.count("*"), F.round(F.sum("score"), 6)).first())
        if state == before or not state[0]:
            break
        known = seeds.union(got)
    return good, got


def spans(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, base, all): sorted array<struct<start, rank, end>> of the base spans, and of all spans."""
    scratch = Scratch(docs.sparkSession)
    rows, placed = found(docs, scratch)
    _, got = discovered(placed, scratch, **how)
    more = placed.where(F.col("rank") == CANDIDATES).select(*_KEY, "start", "end", F.lower("text").alias("instance")).join(got.select("instance", "rank"), "instance")
    own = placed.where("rank >= 0").select(*_KEY, "start", "rank", "end", (F.col("rank") < BASE).alias("own"))
    every = own.union(more.select(*_KEY, "start", "rank", "end", F.lit(False))).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "own"))).alias("every"))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    full = rows.join(every, list(_KEY), "left")
    return full.select("doc_id", F.coalesce(plain(F.filter("every", lambda s: s["own"])), none).alias("base"), F.coalesce(plain("every"), none).alias("all"))


def digest(docs: DataFrame, **how) -> DataFrame:
    """The contract's columns of every document row, and n_spans, the number of all spans; the other n_* count base spans."""
    names = F.array(*(F.lit(k) for k in KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(rank):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return spans(docs, **how).select("doc_id", *(number(r) for r in range(BASE)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))
