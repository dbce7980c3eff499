"""Line dedup: an exact set-similarity join over the token sets of lines, in DataFrame expressions alone.

Tokens of a line are ordered by rarity. Two lines of n and m tokens are alike if 100 * shared >= percent * union, so they share at
least a = ceil(percent * (n + m) / (100 + percent)) tokens, and their first common token lies so early in both that
enough tokens can follow (prefix and positional filters), in lines whose sizes are near (length filter). Rarity comes from a count sketch of fixed size: any one order gives exact results, so the sketch only
decides how few candidates there are. Parity bitmaps bound the symmetric difference from below and drop nearly
all other candidates in the join itself. The rest are verified on their words. Bitmaps of fixed size only keep rows out of a shuffle that nothing there
would meet (a prefix token that no two lines share, a document without a candidate); where they are full they keep nothing out, and results stay the same.

Thousands of lines may be alike. So each line with a common prefix token first meets the earliest line of the groups that the least and greatest hashes of its prefix
and its size make; lines that this removes ("closed") do not meet each other in the join, but all others do.

Lines with the same set of words are found by hashes: of the whole ordered set (64 bits), of its rarest token (60 bits), and by the number of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, one_array, within
from .util import Scratch, clean_names, fresh, table

#: Counts in the sketch.
SKETCH = 1 << 17
#: A token that is in the prefixes of so many lines is common.
COMMON = 512
PERCENT = 80


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Tokens that lines of n and m tokens must share."""
    return F.floor(((n + m) * percent + (99 + percent)) / (100 + percent)).cast("int")


def _plain(text: Column) -> Column:
    """Lower case, with spaces as the only blanks within lines."""
    out = F.lower(text)
    for blank in "\t\x0b\x0c\r":
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return out


def _sketch(docs: DataFrame) -> DataFrame:
    """One row: for each of SKETCH hash values, how many words of the texts fall on it, 43 bits up. Its size is fixed."""
    found = docs.select(F.explode(F.split(F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = found.groupBy(F.xxhash64("w").bitwiseAND(F.lit(SKETCH - 1)).cast("int").alias("at")).agg(F.count("*").alias("n"))
    return one_array(counts.select("at", F.shiftleft(F.least("n", F.lit((1 << 20) - 1)), 43).alias("n")), SKETCH, "n")


def _parity(tokens: Column, half: int) -> Column:
    """64 bits by a token's hash, each set where an odd number of tokens fall on it: of all tokens, or of each half beyond 64 tokens."""

    def flip(acc: Column, t: Column) -> Column:
        return acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int")))

    own = F.when(F.size(tokens) > 64, F.filter(tokens, lambda t: t.bitwiseAND(F.lit(64)) == 64 * half)).otherwise(tokens)
    return F.aggregate(own, F.lit(0).cast("long"), flip)


def later_lines(docs: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, mark and the array `later` of the line numbers that go, for documents that lose lines.

    A line goes if an earlier line (by doc_id, then line number) is like it; documents without id come last.
    """
    spark, c = docs.sparkSession, F.col
    scratch = scratch or Scratch(spark)
    texts = clean_names(docs, ["doc_id", "text"]).where(c("text").isNotNull())
    sketch = scratch.stage(_sketch(texts), "sketch", tidy=False).scalar()

    each = texts.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split(_plain(c("text")), "\n")).alias("line_no", "line"))  # a line's row holds neither the text nor the other lines
    # a token: its count above 43 bits of its hash; the bits that chose the count are not among them
    token = lambda w: F.get("counts", F.xxhash64(w).bitwiseAND(F.lit(SKETCH - 1)).cast("int")).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 21))
    # the sketch is used in one place, so that Spark puts its one value into the expression; as a column, it would be copied for each line
    each = each.select("doc_id", "mark", "line_no", F.array_remove(F.split("line", " "), "").alias("ws"), sketch.alias("counts"))
    each = each.select("doc_id", "mark", "line_no", F.sort_array(F.array_distinct(F.transform("ws", token))).alias("ts"))
    # no filter on n here: it would be moved below, and the tokens would be made twice
    each = each.withColumn("n", F.size("ts"))
    low = F.ceil(c("n") * percent / 100).cast("int")
    longest = c("n") - _needed(c("n"), low, percent) + 1
    at = F.struct(c("doc_id").isNull().alias("no_id"), "doc_id", "mark", "line_no").alias("at")
    each = each.select(F.xxhash64("ts").alias("k0"), F.get("ts", F.lit(0)).alias("k1"), "n", at, F.slice("ts", F.lit(1), longest).alias("prefix"), _parity(c("ts"), 0).alias("b0"), F.when(c("n") > 64, _parity(c("ts"), 1)).otherwise(F.lit(0).cast("long")).alias("b1"))
    each = scratch.stage(each, "each").where("n > 0")
    sets = each.groupBy("k0", "k1", "n").agg(F.min(F.struct("at", "prefix", "b0", "b1")).alias("f"), F.count("*").alias("copies"))
    sets = scratch.stage(sets.select(F.monotonically_increasing_id().alias("id"), "k0", "k1", "n", "copies", "f.*"), "sets")

    # every line whose words an earlier line has as a set
    again = sets.where("copies > 1").select("k0", "k1", c("at").alias("first"))
    copies = scratch.stage(each.select("k0", "k1", "at").join(again, ["k0", "k1"]).where(c("at") > c("first")).select("at"), "copies")
    scratch.drop("each")

    # prefix tokens that a line is indexed by and another one may meet, and those of many lines
    shortest = c("n") - _needed(c("n"), c("n"), percent) + 1
    held = sets.select(shortest.alias("own"), F.posexplode("prefix").alias("i", "key")).groupBy("key").agg(F.count("*").alias("lines"), F.max(F.when(c("i") < c("own"), 1).otherwise(0)).alias("indexed"))
    held = scratch.stage(held.where("lines > 1 and indexed = 1").select("key", "lines"), "held")
    shared = scratch.stage(bitmap(held), "shared", tidy=False).scalar()
    common = scratch.stage(bitmap(held.where(c("lines") >= COMMON)), "common", tidy=False).scalar()
    scratch.drop("held")

    need = _needed(c("n"), c("pn"), percent)
    x0, x1 = c("b0").bitwiseXOR(c("p0")), c("b1").bitwiseXOR(c("p1"))
    # beyond 64 tokens, b0 and b1 hold one half of them each; up to there, b0 holds all
    apart = F.when((c("n") > 64) == (c("pn") > 64), F.bit_count(x0) + F.bit_count(x1)).otherwise(F.bit_count(x0.bitwiseXOR(c("b1")).bitwiseXOR(c("p1"))))
    may = (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent) & (apart <= c("n") + c("pn") - need * 2)

    # leaders: each line with a common token against the earliest of its groups
    hashes = F.explode(F.array(F.transform("prefix", lambda t: t.bitwiseAND(F.lit((1 << 43) - 1))))).alias("hs")
    dense = sets.select("id", "at", "n", "b0", "b1", "prefix", common.alias("common")).where(F.exists("prefix", lambda t: within(c("common"), t)))
    dense = scratch.stage(dense.select("id", "at", "n", "b0", "b1", hashes).select("id", "at", "n", "b0", "b1", F.array_min("hs").alias("low"), F.array_max("hs").alias("high")), "dense", tidy=False)
    group = F.explode(F.array(F.xxhash64("low", "high"), F.xxhash64("n", "low"), F.xxhash64("n", "high"))).alias("g")
    grouped = dense.select("id", "at", "n", "b0", "b1", group)
    leaders = grouped.groupBy("g").agg(F.min(F.struct("at", "id", "n", "b0", "b1")).alias("l"), F.count("*").alias("m")).where("m > 1")
    leaders = leaders.select("g", c("l.at").alias("pat"), c("l.id").alias("pid"), c("l.n").alias("pn"), c("l.b0").alias("p0"), c("l.b1").alias("p1"))
    led = scratch.stage(grouped.join(leaders, "g").where((c("at") > c("pat")) & may).select("id", "pid").distinct(), "led")
    closed = scratch.stage(_confirmed(texts, sets, led, percent, scratch, "led_words").select("id", "at").distinct(), "closed")

    # an open line is indexed for open and for closed ones, a closed line for open ones alone
    flagged = sets.select("id", "n", "b0", "b1", "prefix").join(closed.select("id", F.lit(1).alias("shut")), "id", "left").withColumn("shut", F.coalesce("shut", F.lit(0)))
    flagged = scratch.stage(flagged, "flagged")
    met = scratch.stage(bitmap(flagged.where("shut = 1").select(F.explode("prefix").alias("key"))), "met", tidy=False).scalar()
    near = ((c("n") < c("pn")) | ((c("n") == c("pn")) & (c("id") < c("pid")))) & may & (F.least(c("pn") - c("pi"), c("n") - c("i")) >= need)
    index = flagged.select("id", "n", "b0", "b1", "shut", F.posexplode(F.slice("prefix", F.lit(1), shortest)).alias("i", "key"), shared.alias("shared"), met.alias("met")).where(within(c("shared"), c("key")))
    for_open, for_shut = F.xxhash64("key", F.lit(0)), F.xxhash64("key", F.lit(1))
    twice = (c("shut") == 0) & within(c("met"), c("key"))  # a closed line may have the token
    index = index.select("id", "n", "b0", "b1", "i", F.explode(F.when(twice, F.array(for_open, for_shut)).otherwise(F.array(for_open))).alias("key"))
    probe = flagged.select(c("id").alias("pid"), c("n").alias("pn"), c("b0").alias("p0"), c("b1").alias("p1"), "shut", F.posexplode("prefix").alias("pi", "key"), shared.alias("shared")).where(within(c("shared"), c("key")))
    probe = probe.select("pid", "pn", "p0", "p1", "pi", F.xxhash64("key", "shut").alias("key"))
    pairs = scratch.stage(probe.join(index, "key").where(near).select("id", "pid").distinct(), "pairs")
    unlike_first = _confirmed(texts, sets, pairs, percent, scratch, "words").select(F.greatest("at", "pat").alias("at")).distinct()

    gone = copies.union(closed.select("at")).union(unlike_first).select("at.doc_id", "at.mark", "at.line_no")
    gone = gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("line_no")).alias("later"))
    gone = scratch.stage(gone, "later")
    scratch.drop("sets", "dense", "led", "closed", "flagged", "shared", "common", "pairs", "led_words", "words", "copies", "sketch", "met")
    return gone


def _confirmed(texts: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (id, pid) whose words are alike, with their places at and pat. Words come from the documents again: only lines' places were kept."""
    c = F.col
    wanted = pairs.select("id").union(pairs.select(c("pid").alias("id"))).distinct()
    wanted = sets.select("id", "at").join(wanted, "id").select(c("at.doc_id").alias("wanted_doc"), c("at.mark").alias("wanted_mark"), F.struct("id", "at").alias("w"))
    wanted = wanted.groupBy("wanted_doc", "wanted_mark").agg(F.collect_list("w").alias("wanted"))
    # only texts that may be wanted are shuffled
    place = lambda d, m: F.xxhash64(d, m)
    wanted = scratch.stage(wanted, f"{name}_places", tidy=False)
    docs_ = scratch.stage(bitmap(wanted.select(place("wanted_doc", "wanted_mark").alias("key"))), f"{name}_docs", tidy=False).scalar()
    source = texts.select("doc_id", F.xxhash64("text").alias("mark"), "text", docs_.alias("map")).where(within(c("map"), place("doc_id", "mark"))).drop("map")
    split = source.join(wanted, c("doc_id").eqNullSafe(c("wanted_doc")) & (c("mark") == c("wanted_mark"))).select(F.split(_plain(c("text")), "\n").alias("ls"), "wanted")
    split = split.select(F.inline(F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), w["at"].alias("at"), F.element_at("ls", w["at"]["line_no"] + 1).alias("line")))))
    held = split.select("id", "at", F.array_remove(F.array_distinct(F.split("line", " ")), "").alias("ws")).dropDuplicates(["id"])  # rows that repeat a document
    held = scratch.stage(held, name)
    scratch.drop(f"{name}_places", f"{name}_docs")
    other = held.withColumnsRenamed({"id": "pid", "ws": "pws", "at": "pat"})
    alike = F.size(F.array_intersect("ws", "pws")) * (100 + percent) >= (F.size("ws") + F.size("pws")) * percent
    return pairs.join(held, "id").join(other, "pid").where(alike).select("id", "pid", "at", "pat")


def decide(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_removed, and removed (the numbers, from 0, of its lines that go, with commas).

    Lines without a word stay. Null or empty text: no line goes. Rows that repeat doc_id and text share their decisions
    and do not remove each other's lines; documents without id come after all others. Empty table: no rows. Other columns are not read.
    """
    gone = later_lines(docs, percent).withColumnsRenamed({"doc_id": "gone_doc", "mark": "gone_mark"})
    base = clean_names(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    base = base.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))
    both = base.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_doc")) & (F.col("mark") == F.col("gone_mark")), "left")
    return both.select("doc_id", "n_lines", F.coalesce(F.size("later"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("later").cast("array<string>"), ","), F.lit("")).alias("removed"))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without the lines that go; n_chars, where there is such a column, follows the text.

    A document that loses every line with a word goes; one that had none stays. Null and empty texts stay as they are; rows that repeat
    doc_id and text lose the same lines; documents without id come after all others. Empty table: no rows. All columns are kept, whatever their names.
    """
    later, doc, mark = fresh(docs, "later", "gone_doc", "gone_mark")
    gone = later_lines(docs, percent).withColumnsRenamed({"doc_id": doc, "mark": mark, "later": later})
    both = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(mark)), "left")
    left = F.filter(F.split(docs["text"], "\n"), lambda l, i: ~F.array_contains(later, i))
    whole = F.col(later).isNull()
    text = F.when(whole, docs["text"]).otherwise(F.array_join(left, "\n"))
    new = {"text": text} | ({"n_chars": F.when(whole, docs["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    kept = both.where(whole | text.rlike("[^\\x20\\x09-\\x0D]"))
    return kept.select(*[new[n].alias(n) if n in new else docs[n] for n in docs.columns])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"))
