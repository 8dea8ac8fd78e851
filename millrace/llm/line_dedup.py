"""Line deduplication, native: an exact set-similarity join of lines; later matches are removed.

A line is the set of its distinct 5-word shingles (words: lower-cased, divided by ASCII white space); a line
of fewer words is its whole sequence, as one token. A line goes if an earlier one (by doc_id, then the text's
hash, then place) has a Jaccard similarity of 0.8 or more with it. The first of equal lines stands for all.

1. Screen. Later copies of a line go first. Any global order of tokens gives prefixes that similar lines share a
   token of; here the order is the hash of a shingle's first two words, so only the shingles of a prefix are ever
   hashed. A prefix is SPARE tokens longer than one that shares a token, so that it shares SPARE + 1. A token that occurs
   twice is live (a count, combined in map tasks), and only lines with so many live tokens can have a partner.
2. Join. Over these lines every token is counted, one class of tokens after the other: a line goes as soon as more of its
   tokens than a partner may lack are its own alone. The tokens of a line that is left are ordered by rarity: a
   token that only one line has comes first and pairs nothing. Prefix, positional and length filters are in the join itself.
   A token of up to HOT lines pairs them all; one of more pairs its lines with their first one, the hub, only.
3. Survivors of a hub (lines that match nothing so far) are joined to the hub's other lines by what they
   have more or less than the hub, again by rarest-first prefixes: x and y match if their differences from the
   hub have (dx + dy - (nx + ny) / 9) / 2 members in common or more, which is above zero for a
   survivor. So a crowd of near copies or a common passage never expands to all pairs, and no partner is lost.

Candidates are verified on their whole token sets. A key of a line is two 64-bit hashes, and the sets of two lines that have
a single token must agree in a second hash of its words, so a match rests on 128 bits.

Defined cases: null and empty texts have no lines; a null doc_id comes before all others; rows of equal doc_id
and text are one document, rows of one doc_id with other texts are documents of their own; lines of white space stay;
a line of any length is read whole; of lines that tie in all but place the first stays; other columns pass through,
whatever their names (the column of removed places replaces one of its own name); an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, cut, gathered, let, packed, small_or_not, table

SHINGLE, LEAST, OF = 5, 80, 100
#: Sets match if they differ in at most the RATIO-th part of their summed sizes.
RATIO = (OF + LEAST) // (OF - LEAST)
#: Tokens that a prefix of the screen has beyond those that make it share one; 3 at most.
SPARE = 2
#: Classes of tokens, by hash, that are counted one after the other.
CLASSES = 4
#: Lines of a token beyond which they meet through their first one.
HOT = 8
#: Rows of a few numbers that may be broadcast; more are shuffled.
BROADCAST_ROWS = 300_000

PLACE = ("doc_id", "th", "at")


def line_words(line: Column) -> Column:
    flat = F.lower(line)
    for space in "\t\x0b\x0c\r":
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def lines_of(documents: DataFrame) -> DataFrame:
    """doc_id, th, at, line of every line."""
    return documents.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("at", "line"))


def hashed(lines: DataFrame, *columns: str) -> DataFrame:
    """columns, h (a hash of each word and the next), n (shingles, repeated ones counted again; 0 without words)."""
    worded = lines.select(*columns, line_words(F.col("line")).alias("w"))
    paired = worded.select(*columns, "w", F.expr("transform(w, (x, i) -> xxhash64(x, get(w, i + 1)))").alias("h"))
    return paired.withColumn("n", F.greatest(F.size("h") - SHINGLE + 1, F.least(F.size("h"), F.lit(1))))


def shingle_hash(h: Column, pair: Column, i: Column) -> Column:
    """Of the five words from i on: pairs i, i + 2 and i + 3; of a line with fewer words, of them all."""
    return F.when(F.size(h) < SHINGLE, F.xxhash64(h)).otherwise(F.xxhash64(pair, F.get(h, i + 2), F.get(h, i + 3)))


def prefix_length(n: Column) -> Column:
    return F.floor(n * (OF - LEAST) / OF).cast("int") + 1


def marked(key: Column, least: Column | None = None) -> Column:
    """key with `least`, of 0 to 3, in place of its last two bits."""
    least = F.lit(0) if least is None else least
    return key.bitwiseAND(F.lit(-4)).bitwiseOR(least.cast("long"))


def prefix_rows(lines: DataFrame) -> DataFrame:
    """token, mark of each line's prefix in the order of the shingles' first two words, ties included. mark: the line's key
    with the number of live tokens that it needs; a partner lacks a fifth of the line's tokens at most, in a whole line too.
    """
    rows = hashed(lines.select(F.xxhash64("line").alias("key"), "line"), "key")
    own = F.slice("h", F.lit(1), F.col("n"))
    rows = rows.select("key", "h", "n", F.sort_array(F.array_distinct(own)).alias("order"))
    last = F.coalesce(F.get("order", prefix_length(F.col("n")) - 1 + SPARE), F.lit((1 << 63) - 1))
    mark = marked(F.col("key"), F.least(F.lit(SPARE + 1), F.ceil(F.size("order") * LEAST / OF)))
    rows = rows.select(mark.alias("mark"), "h", last.alias("last"), F.posexplode(own).alias("i", "pair")).where("pair <= last")
    return rows.select(shingle_hash(F.col("h"), F.col("pair"), F.col("i")).alias("token"), "mark")


def with_enough(live_rows: DataFrame) -> DataFrame:
    """mark (as marked() gives it for a key alone) of the lines that have enough of live_rows(token, mark)."""
    counts = live_rows.groupBy("mark").agg(F.count(F.lit(1)).alias("tokens"))
    return counts.where(F.col("tokens") >= F.col("mark").bitwiseAND(F.lit(3))).select(marked(F.col("mark")).alias("mark")).distinct()


def occurrences(documents: DataFrame) -> DataFrame:
    """key, proof, doc_id, th, at of every line with a word; equal lines have equal keys and proofs."""
    lines = lines_of(documents).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.select(F.xxhash64("line").alias("key"), F.xxhash64(F.lit("proof"), "line").alias("proof"), *PLACE)


def first_lines(places: DataFrame) -> DataFrame:
    """key, proof, doc_id, th, at, copies: the first of each group of equal lines of occurrences()."""
    first = places.groupBy("key", "proof").agg(F.min(F.struct(*PLACE)).alias("f"), F.count(F.lit(1)).alias("copies"))
    return first.select("key", "proof", "f.*", "copies")


def without_places(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """line: every line of documents but those at gone(doc_id, th, ats)."""
    docs = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")
    joined = docs.join(gone, same_document(docs, gone), "left").select("text", "ats")

    def others(parts: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "ats"), lambda at: F.get(parts, at))

    split = F.split("text", "\n")
    return joined.select(F.explode(F.when(F.col("ats").isNull(), split).otherwise(let(split, others))).alias("line"))


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def line_sets(documents: DataFrame, places: DataFrame) -> DataFrame:
    """id, doc_id, th, at, n, t (distinct tokens), proof of the lines at places (doc_id, th, at)."""
    wanted = cut(places.groupBy("doc_id", "th").agg(F.collect_list("at").alias("ats")))
    wanted = small_or_not(wanted, wanted.count(), BROADCAST_ROWS)
    docs = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")

    def picked(parts: Column) -> Column:
        return F.transform("ats", lambda at: F.struct(at.alias("at"), F.get(parts, at).alias("line")))

    joined = docs.join(wanted, same_document(docs, wanted)).select(docs["doc_id"], docs["th"], "text", "ats")
    lines = joined.select("doc_id", "th", F.explode(let(F.split("text", "\n"), picked)).alias("x")).select("doc_id", "th", "x.*")
    rows = hashed(lines, *PLACE)
    long_line = F.transform(F.slice("h", F.lit(1), F.col("n")), lambda x, i: F.xxhash64(x, F.get("h", i + 2), F.get("h", i + 3)))
    short_line = F.slice(F.array(F.xxhash64("h")), F.lit(1), F.col("n"))
    every = F.array_distinct(F.when(F.size("h") < SHINGLE, short_line).otherwise(long_line))
    words = F.xxhash64(F.lit("proof"), F.slice("w", F.lit(1), F.lit(SHINGLE)))
    rows = rows.select(*PLACE, every.alias("t"), words.alias("words"))
    return rows.select(
        F.monotonically_increasing_id().alias("id"), *PLACE, F.size("t").alias("n"), "t", F.when(F.size("t") == 1, F.col("words")).alias("proof")
    )


def once(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """sets with one row for each place: rows of equal id and text have several."""
    again = sets.groupBy(*PLACE).agg(F.min("id").alias("kept"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = cut(again.select(*[F.col(c).alias(f"p_{c}") for c in PLACE], "kept"))
    n = again.count()
    if not n:
        return sets
    place = F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("th") == F.col("p_th")) & (F.col("at") == F.col("p_at"))
    joined = sets.join(small_or_not(again, n, BROADCAST_ROWS), place, "left")
    out = scratch.stored(joined.where("kept is null or id = kept").select(*sets.columns))
    scratch.drop(sets)
    return out


def renamed(df: DataFrame, *columns: str) -> DataFrame:
    """df with e_ before the names of columns: those of the earlier line of a pair."""
    return df.withColumnsRenamed({c: f"e_{c}" for c in columns})


def near_lengths() -> Column:
    return F.greatest("n", "e_n") * LEAST <= F.least("n", "e_n") * OF


def is_later() -> Column:
    return F.struct(*PLACE) > F.struct(*[f"e_{c}" for c in PLACE])


def rarest_first(rows: DataFrame, by: tuple[str, ...], group: tuple[str, ...]) -> DataFrame:
    """by, s: the tokens of rows(by, token) that others of the group have too, rarest first, as (lines, token)."""
    counts = rows.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    # hashed by partition: the rows themselves need no sort
    return rows.join(counts.hint("shuffle_hash"), [*group, "token"]).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("lines", "token"))).alias("s"))


def matching(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """id of the pairs (id, e_id) whose sets match."""
    # only the sets that a pair needs are shuffled, to where both of it meet
    need = cut(pairs.select("id").union(pairs.select("e_id")).distinct())
    own = sets.select("id", "t", "proof").join(few_or_hashed(need), "id", "left_semi")
    both = pairs.join(own, "id").join(renamed(own, "id", "t", "proof"), "e_id")
    common = F.size(F.array_intersect("t", "e_t"))
    hit = OF * common >= LEAST * (F.size("t") + F.size("e_t") - common)
    return both.where(hit & F.coalesce(F.col("proof") == F.col("e_proof"), F.lit(True))).select("id").distinct()


def hub_pairs(open_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, e_id): candidate pairs within the hubs of open_rows(hub, id, open), for lines that are open."""
    sets = sets.join(few_or_hashed(cut(open_rows.select("id").union(open_rows.select("hub")).distinct())), "id", "left_semi")
    own = sets.select("id", "n", *PLACE, "t")
    hubs = sets.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("t").alias("hub_t"))
    less = F.transform(F.array_except("hub_t", "t"), lambda x: F.xxhash64(x, F.lit("less")))
    joined = open_rows.join(own, "id").join(hubs, "hub")
    members = cut(joined.select("hub", "id", "open", "n", "hub_n", *PLACE, F.concat(F.array_except("t", "hub_t"), less).alias("delta")))
    ordered = rarest_first(members.select("hub", "id", F.explode("delta").alias("token")), ("hub", "id"), ("hub",))
    members = members.withColumn("d", F.size("delta")).drop("delta").join(ordered, ["hub", "id"])
    # least members in common: of an open line with any other, and of any line with an open one
    least_open = F.greatest(F.lit(1), F.ceil((RATIO * F.col("d") - F.col("n") - F.col("hub_n")) / (RATIO + 1))).cast("int")
    least = F.floor((RATIO - 1) * F.col("d") / (2 * RATIO)).cast("int") + 1
    alone = F.col("d") - F.size("s")
    length = F.greatest(F.when(F.col("open"), F.col("d") - least_open + 1).otherwise(0), F.col("d") - least + 1) - alone
    rows = members.where(length > 0).select(
        "hub", "id", "open", "n", "d", *PLACE, alone.alias("alone"),
        (F.col("d") - least_open).alias("last_open"), (F.col("d") - least).alias("last"),
        F.posexplode(F.slice("s", F.lit(1), length)).alias("pos", "x"),
    )
    rows = cut(rows.withColumn("pos", F.col("pos") + F.col("alone")).withColumn("token", F.col("x.token")).drop("x", "alone"))
    later = rows.where("open and pos <= last_open").drop("open", "last", "last_open")
    earlier = renamed(rows.where("pos <= last"), "id", "n", "d", *PLACE, "pos").drop("open", "last", "last_open")
    sizes = F.col("n") + F.col("e_n")
    need = F.ceil((RATIO * (F.col("d") + F.col("e_d")) - sizes) / (2 * RATIO))
    return (
        later.join(earlier, ["hub", "token"])
        .where(is_later() & near_lengths() & (RATIO * (F.col("d") - F.col("e_d")) <= sizes))
        .where(F.least(F.col("d") - F.col("pos"), F.col("e_d") - F.col("e_pos")) >= need)
        .select("id", "e_id")
        .distinct()
    )


def shared_tokens(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """id, s: as rarest_first() for all lines, but only of lines that share enough tokens to have a partner."""
    left, found = sets.select("id", "n", F.lit(0).cast("long").alias("alone")), []
    for c in range(CLASSES):
        lines = sets if c == 0 else sets.join(few_or_hashed(left.select("id")), "id", "left_semi")
        rows = lines.select("id", F.explode("t").alias("token")).where(F.pmod("token", F.lit(CLASSES)) == c)
        counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
        found.append(scratch.stored(rows.join(counts.hint("shuffle_hash"), "token")))
        seen = rows.groupBy("id").agg(F.count(F.lit(1)).alias("seen"))
        shared = found[-1].groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
        alone = F.col("alone") + F.coalesce("seen", F.lit(0)) - F.coalesce("shared", F.lit(0))
        left = left.join(seen, "id", "left").join(shared, "id", "left").select("id", "n", alone.alias("alone"))
        left = gathered(left.where(F.col("alone") < prefix_length(F.col("n"))))
        del lines, rows, counts, seen, shared
        scratch.release()
    ids = few_or_hashed(left.select("id"))
    rows = reduce(DataFrame.union, [f.join(ids, "id", "left_semi") for f in found])
    out = scratch.stored(rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("lines", "token"))).alias("s")))
    scratch.drop(*found)
    return out


def matched_lines(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """id of the lines of sets that match an earlier one."""
    lines = sets.select("id", "n", *PLACE).join(shared_tokens(sets, scratch), "id")
    alone = F.col("n") - F.size("s")
    left = prefix_length(F.col("n")) - alone
    rows = lines.where(left > 0).select("id", "n", *PLACE, alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), left)).alias("pos", "x"))
    rows = scratch.stored(rows.select("id", "n", *PLACE, (F.col("pos") + F.col("alone")).alias("pos"), "x.token"))
    scratch.release()
    buckets = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(*PLACE, "id", "n")).alias("first"))
    rows = scratch.stored(rows.join(buckets.where("size > 1"), "token"))
    few = rows.where(F.col("size") <= HOT).drop("size", "first")
    need = F.ceil((F.col("n") + F.col("e_n")) * LEAST / (OF + LEAST))
    rest = F.least(F.col("n") - F.col("pos"), F.col("e_n") - F.col("e_pos"))
    pairs = (
        few.join(renamed(few, "id", "n", *PLACE, "pos"), "token")
        .where(is_later() & near_lengths() & (rest >= need - F.least("pos", "e_pos")))
        .select("id", "e_id")
    )
    hubs = rows.where((F.col("size") > HOT) & (F.col("id") != F.col("first.id")))
    members = cut(hubs.select("id", "n", F.col("first.id").alias("e_id"), F.col("first.n").alias("e_n")).distinct())
    pairs = cut(pairs.union(members.where(near_lengths()).select("id", "e_id")).distinct())
    found = cut(matching(pairs, sets))
    flagged = members.select(F.col("e_id").alias("hub"), "id").join(found.withColumn("hit", F.lit(True)), "id", "left")
    flagged = cut(flagged.select("hub", "id", F.col("hit").isNull().alias("open")))
    open_rows = flagged.join(flagged.where("open").select("hub").distinct(), "hub", "left_semi")
    if open_rows.isEmpty():
        return found
    return found.union(matching(cut(hub_pairs(open_rows, sets)), sets)).distinct()


def removals(documents: DataFrame) -> DataFrame:
    """doc_id, th, removed: places of the lines that match an earlier line, in order; cut."""
    docs = documents.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession, "line-dedup")
    places = scratch.stored(occurrences(docs))
    firsts = scratch.stored(first_lines(places))
    again = firsts.where("copies > 1").select("key", "proof", F.struct(*PLACE).alias("first"))
    again = small_or_not(again, again.count(), BROADCAST_ROWS)
    copies = places.join(again, ["key", "proof"]).where(F.struct(*PLACE) > F.col("first"))
    copies = cut(copies.groupBy("doc_id", "th").agg(F.collect_set("at").alias("ats")))
    scratch.drop(places)
    rows = scratch.stored(prefix_rows(without_places(docs, small_or_not(copies, copies.count(), BROADCAST_ROWS))))
    live = scratch.stored(rows.groupBy("token").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("token"))
    scratch.release()
    # live tokens grow with the corpus: hashed by partition at every size
    marks = cut(with_enough(rows.join(live.hint("shuffle_hash"), "token", "left_semi")))
    sets = line_sets(docs, firsts.withColumn("mark", marked(F.col("key"))).join(few_or_hashed(marks), "mark", "left_semi").select(*PLACE))
    sets = once(scratch.stored(sets), scratch)
    scratch.drop(rows, live, firsts)
    scratch.release()
    found = cut(matched_lines(sets, scratch))
    matched = sets.join(few_or_hashed(found), "id", "left_semi").select(*PLACE)
    gone = matched.union(copies.select("doc_id", "th", F.explode("ats").alias("at")))
    gone = cut(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("at")).alias("removed")))
    scratch.drop(sets)
    scratch.release()
    return gone


def few_or_hashed(df: DataFrame) -> DataFrame:
    """A few numbers a row: broadcast up to BROADCAST_ROWS rows, else hashed by partition of a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def without(text: Column, removed: Column) -> Column:
    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    return F.when(removed.isNull(), text).otherwise(let(F.split(text, "\n"), kept))


def dedup_lines(documents: DataFrame, removed: str = "__removed") -> DataFrame:
    """documents with text less its later matches, and the removed places in the column `removed` (null: none)."""
    gone = removals(documents)
    gone = small_or_not(gone, gone.count(), BROADCAST_ROWS)
    docs = packed(documents, F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("th"))
    joined = docs.join(gone, same_document(docs, gone), "left").select(docs["row"], docs["text"], gone["removed"])
    columns = [without(F.col("text"), F.col("removed")).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in documents.columns if c != removed]
    return joined.select(*columns, F.col("removed").alias(removed))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
        F.coalesce(F.array_join("__removed", ","), F.lit("")).alias("removed_lines"),
    )
