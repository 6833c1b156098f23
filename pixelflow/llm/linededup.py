"""Removal of line chunks that repeat across the corpus, in DataFrame operations alone.

Every non-blank line is hashed, and hashes, and pairs of neighbouring ones, are counted over all
documents. Repeated lines that always stand together (both as often as the pair) form a run: a passage that
was pasted into several documents is one, whatever stands around it. A run is cut
where the rolling hash of the last WINDOW line hashes inside it is 0 modulo DIVISOR. Both
kinds of boundary depend on content alone, so a shift moves neither. Chunks with equal
hashes are then compared byte by byte, as the text itself is the grouping key. The first
occurrence (least doc_id, then line) stays; later ones go, with blank lines between
their lines. Only chunks of a repeated stretch of two lines or more, or with a line of over MIN_WORDS words, take part:
lone short lines, such as licences and footers, stay.

Defined results: null texts stay null and empty ones empty; texts without repeated lines keep every byte; rows with equal
doc_id and text are one document and all keep what it keeps; null doc_ids count as -2**63, and so come first; blank lines are never counted;
other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WINDOW = 3
DIVISOR = 8
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]++"
BLANKS = " \t\r"

_KEY = ("did", "th")


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as one struct, with the keys of its document."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(docs["text"]).alias("th"), docs["text"].alias("body"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))


def _lines(keyed: DataFrame) -> DataFrame:
    """(did, th, nb, line, h, wide): nb numbers the non-blank lines; wide: over MIN_WORDS words."""
    numbered = F.transform(F.split("body", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    full = F.filter(numbered, lambda s: F.btrim(s["x"], F.lit(BLANKS)) != "")
    rows = keyed.where("body is not null").select(*_KEY, F.posexplode(full).alias("nb", "s"))
    wide = F.when(F.length("s.x") > 2 * MIN_WORDS, F.regexp_count("s.x", F.lit(WORD)) > MIN_WORDS).otherwise(False)  # so many words have that many characters
    return rows.select(*_KEY, "nb", F.col("s.line").alias("line"), F.xxhash64("s.x").alias("h"), wide.alias("wide"))


def _chunks(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(did, th, start, stop, hash) of every chunk of repeated lines that may be removed.

    Counts are written before they are joined: then both sides of a join are plain shuffles, of which a frequent line's can be split.
    """
    repeated = scratch.save(lines.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "repeated")
    own = scratch.save(lines.join(repeated, "h").distinct(), "repeated-lines")
    w = Window.partitionBy(*_KEY).orderBy("nb")
    following = F.when(F.lead("nb").over(w) == F.col("nb") + 1, F.xxhash64("h", F.lead("h").over(w)))
    paired = own.withColumn("pair", following)
    standing = paired.where("pair is not null")
    pairs = scratch.save(standing.groupBy("pair").agg(F.count("*").alias("pc")), "pairs")
    alone = paired.where("pair is null").withColumn("pc", F.lit(None).cast("long"))  # kept out of the join: nulls would share one task
    paired = standing.join(pairs, "pair").select(*paired.columns, "pc").union(alone)
    before = F.lag("pc").over(w)  # how often this line follows that one; null where none stands before it
    runs = paired.withColumn("breaks", F.coalesce((before != F.col("c")) | (F.lag("c").over(w) != F.col("c")), F.lit(True)).cast("int"))
    runs = runs.withColumn("leaves", F.coalesce(before < 2, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("breaks").over(w)).withColumn("stretch", F.sum("leaves").over(w))
    inside = Window.partitionBy(*_KEY, "run").orderBy("nb")
    rolling = F.pmod(F.xxhash64("h", *(F.lag("h", k).over(inside) for k in range(1, WINDOW))), F.lit(DIVISOR)) == 0
    cut = runs.withColumn("ends", rolling.cast("int"))
    cut = cut.withColumn("chunk", F.coalesce(F.sum("ends").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = Window.partitionBy(*_KEY, "stretch")
    cut = cut.withColumn("lines", F.count("*").over(whole)).withColumn("any_wide", F.max("wide").over(whole))
    found = cut.where("lines > 1 or any_wide").groupBy(*_KEY, "run", "chunk")
    return found.agg(F.min("line").alias("start"), F.max("line").alias("stop"), F.xxhash64(F.array_sort(F.collect_list(F.struct("nb", "h")))["h"]).alias("hash")).drop("run", "chunk")


def removals(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(did, th, gone): for each document that loses lines, the sorted ranges of line numbers that go."""
    keyed = _keyed(docs)
    chunks = scratch.save(_chunks(_lines(keyed), scratch), "chunks")
    again = scratch.save(chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "again")
    spots = chunks.join(again, "hash").groupBy(*_KEY).agg(F.collect_list(F.struct("start", "stop", "hash")).alias("spots"))
    texts = keyed.select(*_KEY, "body").join(spots.hint("shuffle_hash"), list(_KEY))
    bytes_of = lambda s: F.array_join(F.filter(F.slice("lines", s["start"] + 1, s["stop"] - s["start"] + 1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), "\n")
    held = texts.select(*_KEY, F.split("body", "\n", -1).alias("lines"), "spots")
    held = held.select(*_KEY, F.explode(F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["hash"].alias("hash"), bytes_of(s).alias("bytes")))).alias("s"))
    held = scratch.save(held.select(*_KEY, "s.*").dropDuplicates([*_KEY, "start"]), "candidates")
    # equal bytes, not equal hashes, make chunks the same: the bytes are part of the key
    first = scratch.save(held.groupBy("hash", "bytes").agg(F.min(F.struct(*_KEY, "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "bytes", "first"), "first")
    same = held.join(first, ["hash", "bytes"]).where(F.struct(*_KEY, "start") != F.col("first"))
    return same.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("gone"))


def _applied(docs: DataFrame) -> DataFrame:
    """(row, kept, n_lines, n_gone) of every document row."""
    scratch = Scratch(docs.sparkSession)
    gone = scratch.save(removals(docs, scratch), "gone")
    joined = _keyed(docs).join(gone.hint("shuffle_hash"), list(_KEY), "left")
    lines = F.split("body", "\n", -1)
    edges = F.concat(F.array(F.lit(-1)), F.transform("gone", lambda g: g["stop"])), F.concat(F.transform("gone", lambda g: g["start"]), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.arrays_zip(edges[0].alias("after"), edges[1].alias("until")), lambda z: F.slice("lines", z["after"] + 2, z["until"] - z["after"] - 1)))
    text = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n"))
    n_gone = F.coalesce(F.aggregate("gone", F.lit(0), lambda a, g: a + g["stop"] - g["start"] + 1), F.lit(0))
    return joined.select("row", "body", "gone", lines.alias("lines")).select("row", text.alias("kept"), F.coalesce(F.when(F.col("body") == "", 0).otherwise(F.size("lines")), F.lit(0)).cast("long").alias("n_lines"), n_gone.cast("long").alias("n_gone"))


def dedup(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """docs in their own columns, repeated chunks cut from `text`; n_chars, if there is one, follows.

    drop_emptied: documents of which nothing but white space is left go.
    """
    done = _applied(docs)
    if drop_emptied:
        done = done.where("n_gone = 0 or btrim(kept, ' \\t\\r\\n') <> ''")
    length = {"n_chars": F.when(F.col("n_gone") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])} if "n_chars" in docs.columns else {}
    return done.select(*(F.col("kept").alias(c) if c == "text" else length[c].alias(c) if c in length else F.col("row")[c].alias(c) for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text_sha256) of every document row; text_sha256 is that of the text that stays."""
    return _applied(docs).select(F.col("row")["doc_id"].alias("doc_id"), "n_lines", F.col("n_gone").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("text_sha256"))
