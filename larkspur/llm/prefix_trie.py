"""The trie of all prefixes of conversations that share rebuilt heads.

A conversation is rebuilt from the first turns of a base conversation and its
own turns after as many: none of the rebuilt texts is made. Sequences of turns
are told by a composable fingerprint instead. The fingerprint of turns t1 .. tn
is the sum of t_i B**i modulo several primes, t_i a keyed digest of the turn; it
is the product in a monoid whose elements are pairs of a power of B and such a
sum: (p, a) (q, b) = (p q, a + p b). One scan of the sorted turns gives the
product of every stored prefix, task by task, and the tasks' products, one for
each task, are carried forward. A rebuilt prefix is then the product of the
base's head and of the own suffix, which is the own prefix divided by its head,
a sum, a difference and a power of B for columns.

Equal fingerprints are a node. Nothing rests on chance: for every node with
several members the stored turns that these refer to are compared as whole texts
with each other, and the nodes before them too. Should two different turns ever
meet in a node, all is done again with another key.

Numbers of a subtree need no descent. A node belongs to its smallest member; so
what nodes save and which have no children are facts of conversations, summed
over the members of each node, and nodes of the smallest member that lie above
are taken off.

Nulls: a null turn number comes first, a null role or text is empty; rows with a
null conv_id belong to no conversation and are left out. Rows of one turn number
follow each other in order of role and text, repeated rows are repeated turns.
Texts of any length are read whole, conversations of any length or frequency are
spread over tasks; only rows that agree in conversation, turn number and the
first characters of role and text are sorted by one task. An empty table gives
no rows, not even a root. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_to, lean_worker, partitions, saved, small_batches
from .ranges import ranges

#: Below 2 ** 31, so that a product fits a long.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASE = 1103515245
SUMS = [f"a{k}" for k in range(len(PRIMES))]
EARLIER = [f"before_{c}" for c in SUMS]
POWERS = [f"p{k}" for k in range(len(PRIMES))]
_CHUNK = 1 << 12
_IDS = 1 << 16


def stored_turns(turns: DataFrame, key: bytes = b"0") -> DataFrame:
    """conv_id, pos (from 1), role, text, words and the fingerprints of the turns up to this one (a0 .. a3) and before it, from a table in the shared folder."""
    spark = turns.sparkSession
    small_batches(spark)
    clean = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    near = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 64)]
    placed = ranges(clean, *near, within=(*near[:2], F.col("role"), F.col("text"))).withColumn("part", F.spark_partition_id())
    names = ["part", "conv_id", "role", "text", "words", "pos", *SUMS, *POWERS, *EARLIER]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        last, n, sums, powers = None, 0, [0] * len(PRIMES), [1] * len(PRIMES)
        for batch in batches:
            convs, words, out = batch.column("conv_id").to_pylist(), [], []
            for c, role, text in zip(convs, batch.column("role"), batch.column("text"), strict=True):
                if c != last:
                    last, n, sums, powers = c, 0, [0] * len(PRIMES), [1] * len(PRIMES)
                raw, said = role.as_py().encode(), text.as_py().encode()
                d = hashlib.blake2b(len(raw).to_bytes(8, "little") + raw, digest_size=32, key=key)
                d.update(said)
                digest = d.digest()
                n += 1
                earlier = sums
                powers = [p * BASE % m for p, m in zip(powers, PRIMES, strict=True)]
                sums = [(a + p * int.from_bytes(digest[8 * k : 8 * k + 8], "little")) % m for k, (a, p, m) in enumerate(zip(sums, powers, PRIMES, strict=True))]
                words.append(len(said.split()))  # of bytes: split at blank and \x09 to \x0D alone
                out.append((n, *sums, *powers, *earlier))
            own = np.array(out, np.int64).reshape(-1, 1 + 3 * len(PRIMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(words, pa.int64()), *[pa.array(own[:, k]) for k in range(own.shape[1])]], names)

    kinds = f"part int, conv_id long, role string, text string, words long, pos long, {', '.join(f'{c} long' for c in SUMS + POWERS + EARLIER)}"
    local = saved(placed.select("part", "conv_id", "role", "text").mapInArrow(scan, kinds), "turns")
    # what the last conversation of each task, which may go on in the next one, came to: a row for each task
    ends = local.groupBy("part").agg(F.max(F.struct("conv_id", "pos", *SUMS, *POWERS)).alias("e"), F.min("conv_id").alias("first")).select("part", "first", "e.*").orderBy("part").collect()
    carried, last, one = [], None, (0, [0] * len(PRIMES), [1] * len(PRIMES))
    for r in ends:
        if last is not None and r["first"] == last:
            carried.append((r["part"], last, one[0], *one[1], *one[2]))
        before = one if r["conv_id"] == last else (0, [0] * len(PRIMES), [1] * len(PRIMES))
        n, a, p = before
        one = (n + r["pos"], [(x + q * r[y]) % m for x, q, y, m in zip(a, p, SUMS, PRIMES, strict=True)], [q * r[y] % m for q, y, m in zip(p, POWERS, PRIMES, strict=True)])
        last = r["conv_id"]
    before = spark.createDataFrame(carried, f"part int, conv_id long, n0 long, {', '.join(f'b{k} long' for k in range(len(PRIMES)))}, {', '.join(f'q{k} long' for k in range(len(PRIMES)))}")
    joined = local.join(F.broadcast(before), ["part", "conv_id"], "left")
    product = [F.when(F.col("n0").isNull(), F.col(a)).otherwise((F.col(f"b{k}") + F.col(f"q{k}") * F.col(a)) % PRIMES[k]).alias(a) for names in (SUMS, EARLIER) for k, a in enumerate(names)]
    return joined.select("conv_id", (F.col("pos") + F.coalesce("n0", F.lit(0))).alias("pos"), "role", "text", "words", *product)


def _two(sums: list[Column], f: str, g: str) -> list[Column]:
    """A fingerprint as two longs."""
    return [(sums[0] * (1 << 31) + sums[1]).alias(f), (sums[2] * (1 << 31) + sums[3]).alias(g)]


def _moved(prefix: str, k: int, heads: int) -> Column:
    """The sum of a rebuilt prefix: the head's, and after it the own suffix, moved from behind h own turns to behind n_head others."""
    m, zero = PRIMES[k], F.lit(0).cast("long")
    shift = F.lit(1).cast("long")
    for by in range(1, heads):
        shift = F.when(F.col("h") - F.col("n_head") == by, F.lit(pow(BASE, -by, m))).otherwise(shift)
    suffix = F.pmod(F.col(prefix) - F.coalesce(F.col("skipped")[SUMS[k]], zero), F.lit(m))
    return (F.coalesce(F.col("onto")[SUMS[k]], zero) + shift * suffix) % m


def rebuilt(turns: DataFrame, family: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables. A row per rebuilt conversation and depth from 0: conv_id, depth, length (of the conversation),
    the fingerprint f, g, that of the prefix before it as pf, pg, the stored turn that it ends with as ref_conv, ref_pos,
    and that turn's words. A row per conversation: conv_id, length and its fingerprint f, g.
    """
    at = F.struct("pos", "words", *SUMS)
    mine = turns.select("conv_id", "pos", "words", *SUMS, *EARLIER)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    early = F.sort_array(F.collect_list(F.when(F.col("pos") < heads, at)))  # fewer than `heads` turns
    convs = saved(mine.groupBy("conv_id").agg(F.max("pos").alias("own"), early.alias("early")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family), "conversations")
    heads_of = convs.where("conv_id = base").select("base", F.col("early").alias("head"))
    known = convs.join(heads_of, "base", "left").withColumns({"head": F.expr("slice(coalesce(head, slice(early, 1, 0)), 1, h)"), "taken": F.expr("slice(early, 1, h)")})
    last = lambda c: F.try_element_at(c, F.lit(-1))
    known = known.select("conv_id", "base", "own", "h", "head", F.size("head").alias("n_head"), last("taken").alias("skipped"), last("head").alias("onto"))
    known = saved(known.withColumn("length", F.col("n_head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "rebuilt")

    out = ["conv_id", "depth", "length", "f", "g", "pf", "pg", "ref_conv", "ref_pos", "words"]
    zero = F.lit(0).cast("long")
    head = known.select("conv_id", "base", "length", "head", F.posexplode("head").alias("k", "t"))
    earlier = [F.coalesce(F.get("head", F.col("k") - 1)[a], zero) for a in SUMS]
    first = head.select("conv_id", (F.col("k") + 1).cast("long").alias("depth"), "length", *_two([F.col("t")[a] for a in SUMS], "f", "g"), *_two(earlier, "pf", "pg"), F.col("base").alias("ref_conv"), F.col("t.pos").alias("ref_pos"), F.col("t.words").alias("words"))
    # the facts of a long conversation meet its turns by broadcast
    own = joined_to(mine, known.where("own > h").select("conv_id", "own", "h", "n_head", "length", "skipped", "onto"), ["conv_id"], "own", max(1, turns.count())).where("pos > h")
    now = own.select("*", F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"), (F.col("n_head") + F.col("pos") - F.col("h")).alias("depth"), *_two([_moved(a, k, heads) for k, a in enumerate(SUMS)], "f", "g"), *_two([_moved(f"before_{a}", k, heads) for k, a in enumerate(SUMS)], "pf", "pg"))
    top = known.select("conv_id", zero.alias("depth"), "length", *[zero.alias(c) for c in ("f", "g")], *[F.lit(None).cast("long").alias(c) for c in ("pf", "pg", "ref_conv", "ref_pos")], zero.alias("words"))
    paths = saved(first.select(*out).unionByName(now.select(*out)).unionByName(top.select(*out)), "paths")
    return paths, paths.where("depth = length").select("conv_id", "length", "f", "g")


KEY = ["depth", "f", "g"]


def verified(turns: DataFrame, paths: DataFrame) -> bool:
    """Whether all prefixes of a node are equal: their last turns, compared as stored, and the nodes before them."""
    refs = paths.where("depth > 0").select(*KEY, "pf", "pg", "ref_conv", "ref_pos").distinct()
    # members that refer to one stored turn, as those of one base do, need no comparison
    several = saved(refs.groupBy(*KEY).agg(F.count("*").alias("n_refs")).where("n_refs > 1"), "several")
    total = several.agg(F.sum("n_refs")).first()[0]
    if not total:
        return True
    met = joined_to(refs, several, KEY, "n_refs", total)
    said = turns.select(F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"), "role", "text")
    of = met.join(said, ["ref_conv", "ref_pos"]).groupBy(*KEY)
    same = ("role", "text", "pf", "pg")
    differ = F.lit(False)
    for c in same:
        differ = differ | (F.col(f"lo_{c}") != F.col(f"hi_{c}"))
    return of.agg(*[F.min(c).alias(f"lo_{c}") for c in same], *[F.max(c).alias(f"hi_{c}") for c in same]).where(differ).isEmpty()


def _digests(ends: DataFrame) -> DataFrame:
    """The SHA-256 of the comma-joined ids of each node's ends, in ascending order: ids in pieces of a bounded range, which one digest takes in turn."""
    pieces = ends.groupBy(F.col("length").alias("depth"), "f", "g", F.shiftright("conv_id", _IDS.bit_length() - 1).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).cast("array<string>").alias("ids"))
    dealt = pieces.select(*KEY, "piece", F.array_join("ids", ",").alias("ids")).repartition(partitions(ends.sparkSession), *KEY).sortWithinPartitions(*KEY, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])

        for batch in batches:
            for key, ids in zip(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True), batch.column("ids"), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            yield out()
            done = []
        if now is not None:
            done.append((*now, digest.hexdigest()))
        yield out()

    return dealt.select(*KEY, "ids").mapInArrow(run, "depth long, f long, g long, ends_sha256 string")


def _above(nodes: DataFrame) -> DataFrame:
    """conv_id, depth and what the nodes of the same smallest member that lie above save: summed in chunks of depths, whose totals are carried on."""
    own = nodes.where("n_convs > 1").select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saves"), F.floor(F.col("depth") / _CHUNK).alias("chunk"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("conv_id", "chunk").agg(F.sum("saves").alias("saves"))
    carried = sums.select("conv_id", "chunk", F.sum("saves").over(before.partitionBy("conv_id").orderBy("chunk")).alias("carried"))
    inner = own.withColumn("inner", F.sum("saves").over(before.partitionBy("conv_id", "chunk").orderBy("depth")))
    return inner.join(carried, ["conv_id", "chunk"]).select("conv_id", "depth", (F.coalesce("inner", F.lit(0)) + F.coalesce("carried", F.lit(0))).alias("above"))


def prefix_trie(turns: DataFrame, family: int = 20, heads: int = 4, attempts: int = 8) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c starts with the first h turns of conversation c - c % family (the remainder has the sign of c), h being the CRC-32 of c's digits modulo
    `heads`, and goes on with its own turns after its first h.
    """
    for attempt in range(attempts):
        stored = stored_turns(turns, str(attempt).encode())
        paths, ends = rebuilt(stored, family, heads)
        if verified(stored, paths):
            break
    else:
        raise RuntimeError("turns that differ had equal fingerprints under every key")
    nodes = saved(paths.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("pf").alias("pf"), F.min("pg").alias("pg"), F.min("words").alias("words")), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pf").alias("f"), F.col("pg").alias("g")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    above_all = nodes.where("n_children > 0").select(F.col("depth").alias("pd"), F.col("f").alias("pf"), F.col("g").alias("pg"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("seen"))
    born = joined_to(nodes.where("depth > 0").withColumn("pd", F.col("depth") - 1).select(*KEY, "pd", "pf", "pg"), above_all, ["pd", "pf", "pg"], "seen", max(1, nodes.count())).select(*KEY, "parent_conv_id")
    # what a conversation adds to every node that it is in
    adds = nodes.groupBy("conv_id").agg(F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saves"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    adds = adds.where("saves > 0 or leaf > 0").join(ends.select("conv_id", (F.col("length") + 1).alias("steps")), "conv_id")
    sums = joined_to(paths.select("conv_id", *KEY), adds, ["conv_id"], "steps", max(1, paths.count())).groupBy(*KEY).agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("n_leaves"))
    all_of = nodes.join(sums, KEY, "left").join(_digests(ends), KEY, "left").join(born, KEY, "left").join(_above(nodes), ["conv_id", "depth"], "left")
    saved_tokens = F.when(F.col("n_convs") > 1, F.col("saves") - F.coalesce("above", F.lit(0))).otherwise(0).cast("long")
    return all_of.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved_tokens.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
