"""Duplicate listings by fuzzy title, venue and date overlap.

Titles that share three words match, venues that share two; with fewer it takes a
list of few words, or one that repeats them. So up to three words of the title and
two of the venue, with a quarter that both cover, are a key under which counts and
dates alone tell a match, and the rows of a key with the same counts and dates are
one: phase one compares no two listings. A title of n words has n^3 / 6 keys. Rows
whose words and dates are the same are one row from the start, and for phase two
and the links so are rows that match the same others: near copies of one title are
of one form, however many they are, and only forms are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_title, normalize_venue
from . import graph
from .graph import written
from .ordered import best_before, numbered


def _subset(a: Column, b: Column) -> Column:
    return F.forall(a, lambda w: F.array_contains(b, w))


def words_match(a: Column, b: Column, threshold: Column) -> Column:
    """Whether the shorter list lies in the longer, or b has enough words, repeats counted, that a has."""
    whole = F.when(F.size(a) <= F.size(b), _subset(a, b)).otherwise(_subset(b, a))
    return (F.size(a) > 0) & (F.size(b) > 0) & (whole | (F.size(F.filter(b, lambda w: F.array_contains(a, w))) >= threshold))


def titles_match(a: Column, b: Column) -> Column:
    return words_match(a, b, F.when(F.least(F.size(a), F.size(b)) < 4, 2).otherwise(3))


def venues_match(a: Column, b: Column) -> Column:
    return words_match(a, b, F.lit(2))


def dates_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= F.coalesce(b_end, b_start)) & (b_start <= F.coalesce(a_end, a_start))


def brief(rows: DataFrame) -> DataFrame:
    """What the phases ask of listings, written, so that their texts are read once: words, dates and the description's length."""
    said = F.length(F.coalesce("raw_description", F.lit("")))
    return written(_worded(rows).withColumn("said", said).select("id", *SHAPE, "said", *[c for c in ("raw_title", "source", "created_at", "included", "is_duplicate") if c in rows.columns]))


def _brief(rows: DataFrame) -> DataFrame:
    return rows if "said" in rows.columns else brief(rows)


def _worded(rows: DataFrame) -> DataFrame:
    if set(SHAPE) <= set(rows.columns):
        return rows
    return rows.withColumns({"tt": normalize_title(F.col("raw_title")), "vt": normalize_venue(F.col("venue")), "s": F.col("event_date_start"), "e": F.coalesce("event_date_end", "event_date_start")})


SHAPE = ("tt", "vt", "s", "e")


def _hashes(words: str) -> Column:
    return F.transform(F.array_distinct(words), lambda x: F.xxhash64(x))


def _witnesses(rows: DataFrame, words: str, most: int, at: str, own: str | None = None) -> DataFrame:
    """A row for each 1 to `most` different words of a list, or of those whose hashes the column own has.

    Lists that share `most` words match. Fewer shared words are enough for some lists only, which the list's length {at}n,
    how often it has the words {at}c and whether it has no others {at}full tell; with `most` words these are 0 and false.
    """
    different = F.transform(F.array_distinct(words), lambda x: F.struct(F.xxhash64(x).alias("x"), F.size(F.filter(words, lambda y: y == x)).alias("c")))
    if own:
        different = F.filter(different, lambda w: F.array_contains(own, w["x"]))
    out = rows.withColumn("w", F.sort_array(different)).withColumn("y", F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("c"), F.lit(0).alias("m")))
    for taken in range(most):
        after = F.slice("w", F.col("y.i") + 1, F.size("w"))
        more = F.transform(after, lambda x, j: F.struct((F.col("y.i") + j + 1).alias("i"), F.xxhash64(F.col("y.k"), x["x"]).alias("k"), (F.col("y.c") + x["c"]).alias("c"), (F.col("y.m") + 1).alias("m")))
        as_is = F.array("y")
        out = out.withColumn("y", F.explode(F.when(F.col("y.m") == taken, F.concat(as_is, more)).otherwise(as_is) if taken else more))
    sure = F.col("y.m") == most
    said = {f"{at}k": F.col("y.k"), f"{at}n": F.when(sure, 0).otherwise(F.size(words)), f"{at}c": F.when(sure, 0).otherwise(F.col("y.c")), f"{at}full": ~sure & (F.size(F.array_distinct(words)) == F.col("y.m"))}
    return out.withColumns(said).drop("w", "y")


def _told(at: str, threshold: Column) -> Column:
    """Whether the words that two lists share let a_ match b_."""
    an, bn = F.col(f"a_{at}n"), F.col(f"b_{at}n")
    return (an == 0) | F.when(an <= bn, F.col(f"a_{at}full")).otherwise(F.col(f"b_{at}full")) | (F.col(f"b_{at}c") >= threshold)


CLASS = ("tn", "tc", "tfull", "vn", "vc", "vfull", "s", "e")


def _venue_keys(shapes: DataFrame) -> DataFrame:
    """The witnesses of each different venue. One shared word is enough only where a venue has no other or repeats it; words of no such venue are left out."""
    found = _witnesses(shapes.select("vt").distinct(), "vt", 2, "v")
    telling = found.where((F.col("vn") > 0) & (F.col("vfull") | (F.col("vc") > 1))).select("vk").distinct()
    return found.where("vn = 0").unionByName(found.where("vn > 0").join(telling, "vk", "left_semi"))


def _title_words(shapes: DataFrame, venues: DataFrame) -> DataFrame:
    """vk and x, the hash of a word, for each different word of a shape's title and each witness of its venue."""
    return shapes.where("s is not null").join(venues.select("vt", "vk"), "vt").select("vk", F.explode(_hashes("tt")).alias("x"))


def _keyed(shapes: DataFrame, venues: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """key and CLASS for each witness of the title and of the venue and each quarter of a shape. Two shapes match if and only if some key and classes tell so.

    kept: vk and x of the words that more than one shape has, where only keys that shapes share are asked for; a title of
    which few words are shared then has few keys.
    """
    # an end before the start is met by what covers both
    quarters = F.sequence(F.trunc(F.least("s", "e"), "quarter"), F.trunc(F.greatest("s", "e"), "quarter"), F.expr("interval 3 month"))
    # few bytes become many rows, so that they are dealt out by number and not by size
    n = max(1, int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dated = shapes.where("s is not null").join(venues, "vt").withColumn("g", F.xxhash64("tt", "vk"))
    if kept is not None:
        each = dated.select("g", "vk", "tt").dropDuplicates(["g"]).select("g", "vk", F.explode(_hashes("tt")).alias("x"))
        dated = dated.join(each.join(kept, ["vk", "x"]).groupBy("g").agg(F.collect_list("x").alias("own")), "g")
    told = _witnesses(dated.repartition(n).withColumn("q", F.explode(quarters)), "tt", 3, "t", None if kept is None else "own")
    return told.withColumn("key", F.xxhash64("tk", "vk", "q")).drop("tt", "vt", "q", "tk", "vk", "g", "own")


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a and b, as _keyed gives them, of which one tells that a's listings match b's in this order of arguments. A pair may be told more than once."""
    sides = [df.select("key", *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c != "key"]) for x, df in (("a", a), ("b", b))]
    titles = _told("t", F.when(F.least("a_tn", "b_tn") < 4, 2).otherwise(3))
    return sides[0].join(sides[1], "key").where((F.col("a_s") <= F.col("b_e")) & (F.col("b_s") <= F.col("a_e")) & titles & _told("v", F.lit(2)))


def _shaped(rows: DataFrame) -> DataFrame:
    return _worded(rows).select(*SHAPE).distinct().withColumn("h", F.xxhash64(*SHAPE))


def matching_shapes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of shapes, as hashes, whose listings match in this order of arguments."""
    a, b = _shaped(left), _shaped(right)
    venues = _venue_keys(a.select("vt").union(b.select("vt")))
    return _met(_keyed(a, venues), _keyed(b, venues)).select(F.col("a_h").alias("a"), F.col("b_h").alias("b")).distinct()


def _with_shape(rows: DataFrame) -> DataFrame:
    return _worded(rows).withColumn("h", F.xxhash64(*SHAPE))


def forms(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """h and form of each shape, and pairs (a, b) of forms whose listings match in this order of arguments.

    Shapes of one form match the same others in the same orders; they match each other, unless their end is before their
    start. Keys that no two shapes share, or whose counts tell nothing, are left out, and so is a key all of whose shapes
    have one larger key in common, under which dates alone tell a match. Shapes that keep the same keys and counts are of
    one form if one of these keys is such.
    """
    shapes = written(_shaped(rows))
    can = lambda x: (F.col(f"{x}n") == 0) | F.col(f"{x}full") | (F.col(f"{x}c") > 1)
    venues = written(_venue_keys(shapes))
    kept = written(_title_words(shapes, venues).groupBy("vk", "x").count().where("count > 1").select("vk", "x"))
    keyed = written(_keyed(shapes, venues, kept))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bool_or(can("t")).alias("t"), F.bool_or(can("v")).alias("v")).where("n > 1 and t and v")
    some = written(keyed.join(shared.select("key", "n"), "key").withColumn("sure", F.expr("tn = 0 and vn = 0")))
    top = some.where("sure").groupBy("h").agg(F.max(F.struct("n", "key"))["key"].alias("top"))
    tops = some.select("h", "key").join(top, "h", "left").withColumn("top", F.coalesce("top", "key")).groupBy("key").agg(F.min("top").alias("lo"), F.max("top").alias("hi"))
    few = written(some.join(tops.where("lo <> hi or lo = key").select("key"), "key", "left_semi"))
    like = few.groupBy("h").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("key", *CLASS)))).alias("like"), F.bool_or(F.expr("sure and s <= e")).alias("sure")).where("sure")
    formed = written(shapes.join(like.select("h", "like"), "h", "left").withColumn("form", F.coalesce("like", "h")))
    each = written(few.join(formed.select("h", "form"), "h").select(F.col("form").alias("h"), "key", *CLASS).distinct())
    alone = formed.where("s <= e and size(tt) > 0 and size(vt) > 0").select(F.col("form").alias("a"), F.col("form").alias("b"))
    pairs = _met(each, each).where("a_h <> b_h").select(F.col("a_h").alias("a"), F.col("b_h").alias("b")).union(alone).distinct()
    return formed.select("h", "form"), pairs


def near_targets(pending: DataFrame, targets: DataFrame, days: int = 7) -> DataFrame:
    """Targets that start within some days of the pending rows' starts."""
    start = "s" if "s" in pending.columns else "event_date_start"
    span = pending.agg(F.date_sub(F.min(start), days).alias("lo"), F.date_add(F.max(start), days).alias("hi"))
    return targets.join(F.broadcast(span), F.col(start).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")  # one row


def phase_one(listings: DataFrame) -> DataFrame:
    """duplicate_id and canonical_id: each unprocessed row takes the first matching processed one, by start, created_at and id."""
    live = _brief(listings).where(~F.col("is_duplicate"))
    pending, done = live.where(F.col("included").isNull()), live.where(F.col("included").isNotNull())
    targets = near_targets(pending, done)
    first = _worded(targets).groupBy(*SHAPE).agg(F.min(F.struct(F.col("s").alias("start"), "created_at", "id")).alias("t"))
    first, shapes = written(first), written(_shaped(pending))
    venues = written(_venue_keys(shapes.select("vt").union(first.select("vt"))))
    kept = written(_title_words(shapes, venues).distinct().join(_title_words(first, venues), ["vk", "x"], "left_semi"))
    # of targets that one key tells alike only the first can be taken; a row takes the first of all its keys
    alike = _keyed(first, venues, kept).groupBy("key", *CLASS).agg(F.min("t").alias("t"))
    best = _met(_keyed(shapes, venues, kept), alike).groupBy("a_h").agg(F.min("b_t").alias("t"))
    rows = _with_shape(pending).select("id", "h")
    return rows.join(best, rows["h"] == best["a_h"]).select(F.col("id").alias("duplicate_id"), F.col("t.id").alias("canonical_id"))


def matching_pairs(rows: DataFrame, most: int = 1000) -> DataFrame:
    """Links (a, b) of ids, a before b in order of start and id, of all matching pairs.

    Forms are paired, and their rows are dealt into blocks of about `most`; a pair of blocks is one row until its links are
    given, so that no task has more than its share of the links of a form, however many rows are of it.
    """
    rows = written(_worded(rows).select("id", *SHAPE).withColumn("h", F.xxhash64(*SHAPE)))
    total = rows.count()
    formed, pairs = forms(rows)
    facts = written(rows.groupBy("h").agg(F.count("*").alias("seen")).join(formed, "h"))
    shaped = written(graph.met(rows.select("id", "h", "s"), facts, ["h"], total).select("id", "form", "s"))
    # rows of one form start on one day
    sizes = written(shaped.groupBy("form", "s").agg(F.count("*").alias("seen")).withColumn("n", F.ceil(F.col("seen") / most)))
    block = F.pmod(F.xxhash64("id"), F.col("n")).alias("block")
    blocks = written(graph.met(shaped.drop("s"), sizes, ["form"], total).groupBy("form", "s", block).agg(F.collect_list("id").alias("ids")))
    of = lambda x: blocks.select(F.col("form").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("block", "s", "ids")])
    found = pairs.join(of("a"), "a").join(of("b"), "b").where("a_s <= b_s")
    # few bytes become many rows, so that they are dealt out by number and not by size
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = found.repartition(n, "a", "a_block", "b", "b_block").withColumn("before", F.expr("a_s < b_s"))
    links = dealt.select("before", "b_ids", F.explode("a_ids").alias("a")).select("before", "a", F.explode("b_ids").alias("b"))
    return links.where(F.col("before") | (F.col("a") < F.col("b"))).select("a", "b")


def link_counts(rows: DataFrame) -> DataFrame:
    """id, class_id, the smallest id with the same words and dates, and n_links, in how many links of matching_pairs the row is; copies and near copies of one form are not paired.

    Rows that start earlier come first in a link, whatever their ids; of forms that start on one day and match in one
    order alone, the places of their ids tell how many of the other come after or before.
    """
    rows = _brief(rows)
    formed, pairs = forms(rows)
    shaped = _with_shape(rows).select("id", F.col("h").alias("shape"), "s")
    classes = shaped.groupBy("shape").agg(F.min("id").alias("class_id"))
    shaped = written(shaped.join(formed.toDF("shape", "h"), "shape"))
    shapes = written(shaped.groupBy("h").agg(F.min("s").alias("s"), F.count("*").alias("n")))
    of = lambda x: shapes.select(F.col("h").alias(x), F.col("s").alias(f"{x}_s"), F.col("n").alias(f"{x}_n"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").where("a_s <= b_s")
    # each pair of forms once, with the orders it matches in
    ahead = F.col("a") <= F.col("b")
    met = written(pairs.groupBy(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("y")).agg(F.bool_and(F.col("a_s") == F.col("b_s")).alias("same"), F.count("*").alias("ways"), F.bool_and(ahead).alias("forth"), F.min(F.when(ahead, F.col("a_n")).otherwise(F.col("b_n"))).alias("x_n"), F.min(F.when(ahead, F.col("b_n")).otherwise(F.col("a_n"))).alias("y_n")))
    by_place = F.col("same") & (F.col("ways") == 1) & (F.col("x") != F.col("y"))
    plain = met.where(~by_place)
    each = plain.select(F.col("x").alias("h"), F.when(F.col("x") == F.col("y"), F.col("y_n") - 1).otherwise(F.col("y_n")).alias("k")).union(plain.where("x <> y").select(F.col("y").alias("h"), F.col("x_n").alias("k")))
    whole = each.groupBy("h").agg(F.sum("k").alias("k"))

    placed = met.where(by_place).select(F.when(F.col("forth"), F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("forth"), F.col("y")).otherwise(F.col("x")).alias("b"))
    first, second = (placed.join(shaped.select(F.col("h").alias(x), "id"), x).select("a", "b", "id", F.lit(x == "a").alias("first")) for x in ("a", "b"))
    order = Window.partitionBy("a", "b").orderBy("id")
    before = F.count_if("first").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.count_if(~F.col("first")).over(order.rowsBetween(1, Window.unboundedFollowing))
    few = first.union(second).select("id", F.when(F.col("first"), after).otherwise(before).alias("k")).groupBy("id").agg(F.sum("k").alias("few"))
    named = shaped.join(classes, "shape").join(whole, "h", "left").join(few, "id", "left")
    return named.select("id", "class_id", (F.coalesce("k", F.lit(0)) + F.coalesce("few", F.lit(0))).alias("n_links"))


def sweep(rows: list[tuple], links: set[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """The greedy pass over one component; rows (id, description length, created_at) come in order. Gives (duplicate, canonical, position)."""
    marked: set[str] = set()
    out: list[tuple[str, str, int]] = []
    for i, (a, a_len, a_at) in enumerate(rows):
        if a in marked:
            continue
        for b, b_len, b_at in rows[i + 1 :]:
            if b in marked or (a, b) not in links:
                continue
            keep_a = a_len > b_len or a_len == b_len and a_at <= b_at
            lost, kept = (b, a) if keep_a else (a, b)
            marked.add(lost)
            out.append((lost, kept, len(out)))
    return out


def _marked(edges: DataFrame) -> DataFrame:
    """Ids that the greedy pass marks, of edges (a, b) in which a, if unmarked, marks the later b.

    A row that no undecided row may mark stays, and what it marks is decided with it. So the rounds go on, each written,
    until no edge is left: as many as the longest chain of rows that wait for each other.
    """
    edges = written(edges)
    marked = edges.select("b").limit(0)
    while not edges.isEmpty():
        stays = written(edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti"))
        lost = written(edges.join(stays, "a", "left_semi").select("b").distinct())
        marked = marked.union(lost)
        edges = written(edges.join(lost, "b", "left_anti").join(lost.toDF("a"), "a", "left_anti"))
    return marked


def phase_two(pending: DataFrame) -> DataFrame:
    """duplicate_id, canonical_id and seq among unprocessed rows: the greedy pass.

    Rows of one form match each other and the same others, so that only a row that is worth more than all earlier ones of
    its form may find itself unmarked when its turn comes; these rows are settled by _marked, and the pairs follow. seq is the order
    in which the pass comes to the pairs; an id may occur more than once, and its last pair counts.
    """
    pending = _brief(pending)
    worth = F.struct(F.col("said").alias("n"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("at"))
    formed, linked = forms(pending)
    shaped = _with_shape(pending).select("h", F.struct(F.col("s").alias("start"), "id").alias("r"), worth.alias("k"), F.expr("e < s").alias("apart"))
    rows = written(shaped.join(formed, "h").drop("h").withColumnRenamed("form", "h"))
    firsts = rows.groupBy("h").agg(F.min("r").alias("first"), F.max("r").alias("last"))
    pairs = linked.join(firsts.select(F.col("h").alias("a"), "first"), "a").join(firsts.select(F.col("h").alias("b"), "last"), "b")
    pairs = written(pairs.where(F.col("first") < F.col("last")).select("a", "b"))
    # a row that no pair can name is done
    rows = rows.join(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), "h", "left_semi")
    of = lambda df, x: df.select(F.col("h").alias(x), F.col("r").alias(f"r{x}"), F.col("k").alias(f"k{x}"))

    # rows that end before they start match others, but not their copies
    turns = written(best_before(rows, "h", "r", "k", "best").where(F.col("apart") | F.col("best").isNull() | (F.col("best") < F.col("k"))).drop("best"))
    links = pairs.join(of(turns, "a"), "a").join(of(turns, "b"), "b").where(F.col("ra") < F.col("rb"))
    marked = _marked(links.where(F.col("ka") >= F.col("kb")).select(F.col("ra.id").alias("a"), F.col("rb.id").alias("b")))
    unmarked = turns.join(marked, turns["r"]["id"] == marked["b"], "left_anti")

    met = pairs.join(of(unmarked, "a"), "a").join(of(rows, "b"), "b").where(F.col("ra") < F.col("rb")).withColumn("keep_a", F.col("ka") >= F.col("kb"))
    met = written(met.select("ra", "rb", "keep_a"))
    # a row is met no more once it is marked
    ends = met.where("keep_a").groupBy("rb").agg(F.min("ra").alias("end"))
    found = met.join(ends, "rb", "left").where(F.col("end").isNull() | (F.col("ra") <= F.col("end")))
    named = found.select("ra", "rb", F.when(F.col("keep_a"), F.col("rb.id")).otherwise(F.col("ra.id")).alias("duplicate_id"), F.when(F.col("keep_a"), F.col("ra.id")).otherwise(F.col("rb.id")).alias("canonical_id"))
    return numbered(named, F.col("ra"), F.col("rb"), name="seq").select("duplicate_id", "canonical_id", "seq")


def named_pairs(pairs: DataFrame, listings: DataFrame) -> DataFrame:
    """pairs with the titles and the sources of both rows."""
    out = pairs
    for side in ("duplicate", "canonical"):
        out = out.join(listings.select(F.col("id").alias(f"{side}_id"), F.col("raw_title").alias(f"{side}_title"), F.col("source").alias(f"{side}_source")), f"{side}_id")
    return out


def canonical_first(a: Column, b: Column) -> Column:
    """Whether a is kept of two matching rows: the processed one, else the longer description, else the earlier row, else a."""
    a_done, b_done = a["included"].isNotNull(), b["included"].isNotNull()
    size = lambda r: F.length(F.coalesce(r["raw_description"], F.lit("")))
    return F.when(a_done & ~b_done, True).when(b_done & ~a_done, False).when(size(a) != size(b), size(a) > size(b)).otherwise(a["created_at"] <= b["created_at"])


def dedup_totals(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_distinct("duplicate_id").alias("marked"), F.count("*").alias("pairs"))


def resolved(pairs: DataFrame) -> DataFrame:
    """canonical_id followed through rows that are duplicates themselves, however many: each written round doubles the steps."""
    out = written(pairs.groupBy("duplicate_id").agg(F.max_by("canonical_id", "seq").alias("canonical_id")))
    while True:
        ahead = out.select(F.col("duplicate_id").alias("canonical_id"), F.col("canonical_id").alias("next"))
        new = written(out.join(ahead, "canonical_id", "left").select("duplicate_id", F.coalesce("next", "canonical_id").alias("canonical_id"), F.col("next").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.drop("moved")
        out = new.drop("moved")


def inspected(listings: DataFrame) -> DataFrame:
    """Duplicates with the title of what they point at, or 'not found'."""
    to = listings.select(F.col("id").alias("duplicate_of"), F.col("raw_title").alias("canonical_title"))
    return listings.where("is_duplicate").join(to, "duplicate_of", "left").select("id", "raw_title", "duplicate_of", F.coalesce("canonical_title", F.lit("not found")).alias("canonical_title"))


def inspection_totals(listings: DataFrame) -> DataFrame:
    """How many listings there are, how many are duplicates and how many are left."""
    gone = F.count_if(F.coalesce("is_duplicate", F.lit(False)))
    return listings.agg(F.count("*").alias("total"), gone.alias("duplicates"), (F.count("*") - gone).alias("unique"))
