"""Similarity join of documents by the Jaccard index of their word n-gram sets.

The universe of shingles is partitioned by hash, and each set is indexed by the
segments it has.  The allocation is by cost, from posting lengths that are counted
from all sets: a segment that only one set has can match nothing, so its difference is
booked in advance (allowance for free), and a set with more than ``(1 - t) * l``
such segments leaves before any pair is formed.  Of what stays, the cheapest
``m - ceil(t * l) + 1`` segments are indexed (allowance 0) and the others skipped
(allowance -1): by the pigeonhole principle two sets that reach the threshold meet
in one of them.  Segments are of one shingle each, for which the one-deletion
neighbourhood is empty; README has the measured size of the coarser partitions.
Sizes and positions prune what meets in a segment, and every candidate is then
verified on the whole sets.

All this up to the candidates is done for one band of set sizes after the other, as
sets that reach the threshold have sizes within a factor of ``1 / t``: what is shuffled
and stored at a time is a band's share, besides the hashes of all sets, which are stored once.  A band holds its own sizes and the larger ones
that can be partners of those; a pair belongs to the band of its smaller set.

Sets that are equal are one class from the start, so copies never meet.  A class
is known by the 64-bit hash of its sorted set; should two different sets get the
same (a second hash tells), the run starts again with another seed.  Shingles are
held as 58-bit hashes.

Defined results: a null or wordless text has an empty set, n_similar 0 and its own
id as component; a text of one word has that word as its only shingle; rows that
repeat are linked as any others; an empty table gives an empty result.  Extra
columns aren't read.

Everything here is DataFrame operations.  Shingles that a sample sees often never
go through the count by shingle (at most HOT_SHINGLES of them, so no other one holds
more than that share of all rows); long posting lists are joined as a grid of parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Work, may_be_among

#: Frequent shingles are found on one document in so many, and at most so many are taken (a table of 4 MB).
#: Results don't depend on either.
COST_SAMPLE, HOT_SHINGLES = 16, 1 << 18
#: A shingle's hash has so many bits; log2 of its posting length stands above them.
HASH_BITS = 58
#: A band of sizes, with the larger partners, has at most this share of all shingles, or so many of them, unless a single step of sizes has more.
BAND_SHARE, BAND_SHINGLES = 0.35, 2_000_000
#: Steps of sizes in an octave; bands consist of whole steps.
SIZE_STEPS = 8
#: Posting lists of 2 ** GRID_CLASS sets and more are split into a grid.
GRID_CLASS = 12
_SPACE = "[\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def shingle_hashes(words: Column, n: int, seed: int) -> Column:
    """58-bit hashes of the distinct n-word shingles; of all words as one if there are fewer than n."""
    cut = lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS)
    whole = F.array(cut(F.xxhash64(F.lit(seed), F.concat_ws(" ", words))))
    grams: Column = words
    for k in range(1, n):
        tail = F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - k, F.lit(0)))
        grams = F.zip_with(grams, tail, lambda a, b: F.when(b.isNotNull(), F.xxhash64(F.lit(seed), a, b) if k == 1 else F.xxhash64(a, b)))
    if n == 1:
        hashes = F.transform(words, lambda w: cut(F.xxhash64(F.lit(seed), w)))
    else:
        hashes = F.array_distinct(F.transform(F.slice(grams, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0))), cut))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < n, whole).otherwise(hashes)


def _hot(work: Work, sample: DataFrame) -> tuple[Column, int]:
    """A scalar array of cells, each with the hash and log2 of the posting length of the most frequent shingle there."""
    counts = sample.select(F.explode_outer("hashes").alias("h")).groupBy("h").count().where("count > 1 and h is not null")
    counts = work.save(counts, "counts")
    cells = min(2 * HOT_SHINGLES, 1 << max(4, (2 * counts.count()).bit_length()))
    cost = F.least(F.lit(31), F.floor(F.log2(F.col("count") * COST_SAMPLE))).cast("long")
    known = counts.select(F.col("h").bitwiseAND(cells - 1).alias("id"), F.struct("count", F.shiftleft("h", 5).bitwiseOR(cost).alias("v")).alias("v"))
    known = known.groupBy("id").agg(F.max("v").alias("v"))
    every = work.spark.range(cells).join(known, "id", "left").select("id", F.coalesce("v.v", F.lit(0)).cast("long").alias("v"))
    table = every.agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("all")).select(F.transform("all", lambda x: x["v"]).alias("cells"))
    return work.save(table, "hot").scalar(), cells


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def content_key(text_col: str = "text", id_col: str = "doc_id") -> Column:
    """A 128-bit key of identifier and text."""
    parts = F.col(id_col).cast("long").cast("string"), F.col(text_col).cast("string")
    return F.unhex(F.md5(F.concat_ws(":", *(F.coalesce(p, F.lit("")) for p in parts)).cast("binary")))


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, text, and a key of both."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), content_key(text_col, id_col).alias("key"))


def _hashes(n: int, seed: int) -> Column:
    return let(word_array(lower_ascii(F.col("text"))), lambda w: shingle_hashes(w, n, seed))


def ngram_jaccard_join(
    spark: SparkSession, docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", n: int = 2, percent: int = 60
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, n_similar, component_id, class_id.

    Two rows are linked when ``100 * |A & B| >= percent * |A | B|``, for non-empty sets.
    """
    work, table, classes, links = _linked(spark, docs, text_col, id_col, n, percent, every=True)
    return _answer(work, table, classes, links)


def surplus_rows(
    spark: SparkSession, docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", n: int = 2, percent: int = 60
) -> DataFrame:
    """(row_key, kept): the ``content_key`` of every row but one of each group of linked rows.

    The one has the smallest doc_id (null is larger than any), then the smallest key.  ``kept`` marks its key
    where further rows have it too.
    """
    work, table, classes, links = _linked(spark, docs, text_col, id_col, n, percent, every=False)
    label = components(work, links).withColumnRenamed("node", "class_id")
    named = classes.select("class_id", "rep", "n_class").join(label, "class_id", "left").where("label is not null or n_class > 1")
    named = named.select("class_id", "rep", F.coalesce("label", "class_id").alias("label"))
    best = named.groupBy("label").agg(F.min("rep").alias("best"))
    named = work.save(named.join(best, "label").select("class_id", F.col("best.key").alias("best")), "best")
    rows = table.where("l > 0").join(named, "class_id").groupBy("key").agg(F.max(F.col("key") == F.col("best")).alias("kept"), F.count(F.lit(1)).alias("n"))
    out = work.save(rows.where("not kept or n > 1").select(F.col("key").alias("row_key"), "kept"), "surplus")
    work.drop("sets", "classes", "links_near", "links_apart", "best")
    return out


def _linked(spark: SparkSession, docs: DataFrame, text_col: str, id_col: str, n: int, percent: int, every: bool) -> tuple[Work, DataFrame, DataFrame, DataFrame]:
    """The run's folder, its rows, their classes, and the linked pairs of classes; if not ``every``, enough of those for the components."""
    keyed = _keyed(docs, text_col, id_col)
    for seed in range(42, 50):
        work = Work(spark, "ngram_join")
        # The only time that all texts are split: what follows reads the hashes, band by band.
        split = work.save(_split(work, keyed, n, seed), "split")
        sets = work.save(split.select("doc_id", "key", "l", "class_id", "check", F.size("hot").alias("n_hot")), "sets")
        table = sets.select("doc_id", "key", "l", "class_id")
        classes = work.save(
            sets.where("l > 0").groupBy("class_id").agg(
                F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "key")).alias("rep"), F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("n_class"),
                F.min("check").alias("c0"), F.max("check").alias("c1"), F.max("l").alias("l"), F.min("l").alias("l0"), F.max("n_hot").alias("n_hot"),
            ),
            "classes",
        )
        if not classes.where("c0 != c1 or l != l0").take(1):
            links = _links(work, split, classes, percent, every)
            work.drop("split")
            return work, table, classes, links
        work.drop("split", "sets", "classes")
    raise RuntimeError("eight hash functions in turn gave different sets the same hash")


def _split(work: Work, keyed: DataFrame, n: int, seed: int) -> DataFrame:
    """(doc_id, key, l, class_id, check, hot, light) of each row of ``keyed``.

    ``light`` are the hashes of the set's shingles but for the known frequent ones, which are in ``hot`` with the
    log2 of their posting length in front.
    """
    sample = keyed.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(COST_SAMPLE)) == 0)
    table, cells = _hot(work, sample.select(_hashes(n, seed).alias("hashes")))

    shifted = F.array(*(F.lit(k << HASH_BITS) for k in range(32)), F.lit(0).cast("long"))

    def ranked(h: Column) -> Column:
        cell = F.element_at("q_hot", (h.bitwiseAND(cells - 1) + 1).cast("int"))
        other = F.least(cell.bitwiseXOR(F.shiftleft(h, 5)), F.lit(32))  # the cost class; 32 where the cell is another's
        return F.element_at(shifted, (other + 1).cast("int")).bitwiseOR(h)

    # The optimizer moves the scalar into the expression, so it never is a column of any row.
    tokens = F.sort_array(F.transform(_hashes(n, seed), ranked))
    sets = keyed.withColumn("q_hot", table).select("doc_id", "key", tokens.alias("tokens"))
    bare = 1 << HASH_BITS
    return sets.select(
        "doc_id", "key", F.size("tokens").alias("l"), F.xxhash64("tokens").alias("class_id"), F.xxhash64(F.lit(7), "tokens").alias("check"),
        F.filter("tokens", lambda t: t >= bare).alias("hot"), F.filter("tokens", lambda t: t < bare).alias("light"),
    )


def _bands(classes: DataFrame, percent: int) -> list[tuple[int, int, int]]:
    """(low, high, reach) of each band: its own sizes are low to high, and partners of those have at most ``reach`` shingles."""
    step = F.floor(F.log2("l") * SIZE_STEPS)
    steps = classes.groupBy(step.alias("step")).agg(F.min("l").alias("low"), F.max("l").alias("high"), F.sum("l").alias("n")).orderBy("low").collect()
    most = max(BAND_SHINGLES, BAND_SHARE * sum(r.n for r in steps))
    held = lambda low, reach: sum(r.n for r in steps if low <= r.low <= reach)
    out: list[tuple[int, int, int]] = []
    for r in steps:
        reach = 100 * r.high // percent
        if out and held(out[-1][0], reach) <= most:
            out[-1] = (out[-1][0], r.high, reach)
        else:
            out.append((r.low, r.high, reach))
    return out


def _live(work: Work, split: DataFrame, classes: DataFrame, band: tuple[int, int, int], percent: int) -> DataFrame:
    """(class_id, l, m, tokens): of each class of the band that can have a partner, the number of shingles that another class
    may have too, and the rarest of those, as many as the set is indexed by."""
    low, _, reach = band
    # One document stands for its class.  Rows that the filter lets through besides do no harm: copies raise counts only.
    some = work.save(classes.where(F.col("l").between(low, reach)).select("class_id", "l", "n_hot", F.col("rep.key").alias("key")), "some")
    rows = may_be_among(split.where(F.col("l").between(low, reach)).select("key", "class_id", "light"), F.col("key"), some, "key").select("class_id", F.explode("light").alias("h"))
    token = F.shiftleft(F.floor(F.log2("n")).cast("long"), HASH_BITS).bitwiseOR(F.col("h"))
    counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("n > 1")
    counted = work.save(counted.select("class_id", token.alias("token")).sortWithinPartitions("class_id"), "counted")
    shared = counted.groupBy("class_id").agg(F.count(F.lit(1)).alias("shared"))
    stay = some.join(shared, "class_id", "left").where(f"100 * (n_hot + coalesce(shared, 0)) >= {percent} * l")
    stay = work.save(stay.select("class_id", "l", "n_hot", "key"), "stay")
    light = work.save(may_be_among(counted, F.col("class_id"), stay, "class_id"), "light")
    work.drop("some", "counted")
    sets = stay.join(light.groupBy("class_id").agg(F.collect_set("token").alias("light")), "class_id", "left").withColumn("light", F.coalesce("light", F.array().cast("array<bigint>")))
    # The frequent shingles stand last; only sets that have this many of them are indexed by any.
    many = stay.where(f"100 * n_hot >= {percent} * l")
    if many.take(1):
        hot = may_be_among(split.where(F.col("l").between(low, reach)).select("key", "class_id", "hot"), F.col("key"), many, "key").groupBy("class_id").agg(F.first("hot").alias("hot"))
        sets = sets.join(hot.join(many.select("class_id"), "class_id", "left_semi"), "class_id", "left")
        sets = sets.withColumn("tokens", F.when(F.col("hot").isNull(), F.col("light")).otherwise(F.concat("light", "hot")))
    else:
        sets = sets.withColumn("tokens", F.col("light"))
    sets = sets.select("class_id", "l", (F.col("n_hot") + F.size("light")).alias("m"), "tokens").where(f"100 * m >= {percent} * l")
    live = work.save(sets.select("class_id", "l", "m", F.expr(f"slice(sort_array(tokens), 1, m - cast(ceil({percent} * l / 100) as int) + 1)").alias("tokens")), "live")
    work.drop("light", "stay")
    return live


def _heads(live: DataFrame) -> DataFrame:
    """(token, class_id, l, rest, prev): the segments that a set is indexed by, with how many live ones follow, itself included.

    ``prev`` is the segment before it; short postings go without, as little is saved there.
    """
    rows = live.select("class_id", "l", "m", "tokens", F.posexplode("tokens").alias("pos", "token"))
    return rows.select("token", "class_id", "l", (F.col("m") - F.col("pos")).alias("rest"), F.expr(f"if(pos > 0 and shiftright(token, {HASH_BITS}) > 1, tokens[pos - 1], null)").alias("prev"))


def _met(a: DataFrame, b: DataFrame, on: list[str], band: tuple[int, int, int], percent: int) -> DataFrame:
    """Pairs of the band that meet in a posting list and whose sizes and positions allow the threshold.

    A pair is passed over where both have the same segment before, as it meets there already.  So it is
    enough to ask whether it can reach the threshold with this as the first common one.
    """
    a, b = (x.select(*on, F.col("class_id").alias(f"{s}c"), F.col("l").alias(f"{s}l"), F.col("rest").alias(f"{s}r"), F.col("prev").alias(f"{s}p")) for x, s in ((a, "a"), (b, "b")))
    need = f"cast(ceil({percent} * (al + bl) / {100 + percent}) as int)"  # of the intersection
    met = a.join(b, on).where(f"100 * least(al, bl) >= {percent} * greatest(al, bl) and least(ar, br) >= {need}").where("ap is null or bp is null or ap != bp")
    return met.where(f"least(al, bl) <= {band[1]}")


def _pairs(live: DataFrame, band: tuple[int, int, int], percent: int) -> DataFrame:
    """Candidates (ac, bc, al, bl) of the band, ac < bc."""
    heads = _heads(live)
    is_long = F.shiftright("token", HASH_BITS) >= GRID_CLASS
    short = heads.where(~is_long)  # one exchange, read by both sides
    met = _met(short, short, ["token"], band, percent).where("ac < bc").select("ac", "bc", "al", "bl")
    # Long posting lists: a grid, in whose cell (i, j) the parts i <= j of the list meet.
    side = F.expr(f"cast(shiftleft(1, cast(shiftright(token, {HASH_BITS}) as int) - {GRID_CLASS - 1}) as int)")
    long = heads.where(is_long).withColumn("side", side).withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("side")).cast("int"))
    left = long.select(*heads.columns, F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("side") - 1)).alias("j"))
    right = long.select(*heads.columns, F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"))
    grid = _met(left, right, ["token", "i", "j"], band, percent).where("ac != bc and (i < j or ac < bc)")
    first = F.col("ac") < F.col("bc")
    grid = grid.select(*(F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("ac", "bc"), ("bc", "ac"), ("al", "bl"), ("bl", "al"))))
    return met.unionByName(grid).distinct()


def _links(work: Work, split: DataFrame, classes: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (a, b) of classes, a < b, that reach the threshold: all of them, or if not ``every`` enough to connect what they connect."""
    pairs = work.spark.range(0).selectExpr("id as ac", "id as bc", "cast(id as int) as al", "cast(id as int) as bl")
    for k, band in enumerate(_bands(classes, percent)):
        live = _live(work, split, classes, band, percent)
        pairs = pairs.unionByName(work.save(_pairs(live, band, percent), f"pairs{k}"))
        work.drop("live")

    def verified(some: DataFrame, name: str) -> DataFrame:
        out = work.save(_verified(work, split, classes, some, percent), name)
        work.drop("chunks", "cells", "reps")
        return out

    if every:
        return verified(pairs, "links")
    # First each set with the smallest candidate; then only candidates that this hasn't connected.
    near = work.save(pairs.groupBy("bc").agg(F.min(F.struct("ac", "al", "bl")).alias("x")).select("x.ac", "bc", "x.al", "x.bl"), "near")
    links = verified(near, "links_near")
    label = work.save(components(work, links), "labels")
    for c, to in (("ac", "la"), ("bc", "lb")):
        pairs = pairs.join(label.select(F.col("node").alias(c), F.col("label").alias(to)), c, "left")
    apart = pairs.where("coalesce(la, ac) != coalesce(lb, bc)").select("ac", "bc", "al", "bl")
    apart = work.save(apart.join(near, ["ac", "bc"], "left_anti"), "apart")
    return links.unionByName(verified(apart, "links_apart"))


#: Tokens that a chunk of documents holds on average (2 MB); two chunks meet in one cell.  A set counts for so many at least.
CHUNK_TOKENS, SET_TOKENS = 262_144, 64


def _verified(work: Work, split: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Candidates whose whole sets reach the threshold.

    Documents with a common smallest candidate form a block, cut into chunks of bounded size.  A set goes
    once to each cell (pair of chunks) in which it has a candidate, not once per candidate; the candidates
    of a cell are read as a stream beside its sets.
    """
    ends = pairs.select(F.col("ac").alias("v"), F.col("al").alias("l"), F.col("bc").alias("u")).union(pairs.select("bc", "bl", "ac"))
    nodes = ends.groupBy("v").agg(F.first("l").alias("l"), F.least(F.min("u"), F.col("v")).alias("block"))
    sizes = nodes.groupBy("block").agg(F.ceil(F.sum(F.greatest("l", F.lit(SET_TOKENS))) / CHUNK_TOKENS).cast("int").alias("parts"))
    chunk = F.xxhash64("block", F.pmod(F.xxhash64("v"), F.col("parts")))
    chunks = work.save(nodes.join(sizes, "block").select("v", chunk.alias("chunk")), "chunks")
    placed = pairs.join(chunks.select(F.col("v").alias("ac"), F.col("chunk").alias("ak")), "ac").join(chunks.select(F.col("v").alias("bc"), F.col("chunk").alias("bk")), "bc")
    placed = work.save(placed.select(F.xxhash64(F.least("ak", "bk"), F.greatest("ak", "bk")).alias("cell"), "ac", "bc", "al", "bl"), "cells")
    members = placed.select("cell", F.col("ac").alias("class_id")).union(placed.select("cell", "bc")).distinct()
    reps = work.save(classes.select("class_id", F.col("rep.key").alias("key")).join(chunks.select(F.col("v").alias("class_id")), "class_id").select("key"), "reps")
    some = may_be_among(split.select("key", "class_id", "hot", "light"), F.col("key"), reps, "key").select("class_id", F.concat("hot", "light").alias("tokens"))
    # Rows that repeat and copies that the filter lets through give equal entries, of which the set keeps one.
    held = members.join(some, "class_id").groupBy("cell").agg(F.map_from_entries(F.collect_set(F.struct("class_id", "tokens"))).alias("sets"))
    same = F.size(F.array_intersect(F.element_at("sets", F.col("ac")), F.element_at("sets", F.col("bc"))))
    both = placed.join(held, "cell").select(F.col("ac").alias("a"), F.col("bc").alias("b"), (F.col("al") + F.col("bl")).alias("t"), same.alias("i"))
    return both.where(f"100 * i >= {percent} * (t - i)").select("a", "b")


def components(work: Work, links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links``; label is the smallest node reachable.

    Large-star and small-star in turn: the larger neighbours of each node, then the smaller ones and the node
    itself, are linked to the smallest of its neighbourhood instead.  That keeps what is connected, adds no edges,
    and ends, after about logarithmically many rounds, when each component is one star around its smallest node.
    """
    stars = work.save(links.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "stars0")
    step = 0
    while True:
        parents = stars.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        if not parents.where("n > 1").take(1) and not stars.join(parents.select(F.col("v").alias("m")), "m", "left_semi").take(1):
            break
        step += 1
        top = stars.union(stars.select("m", "v")).groupBy(F.col("v").alias("m")).agg(F.least(F.min("m"), F.first("v")).alias("top"))
        large = work.save(stars.join(top, "m").select("v", F.col("top").alias("m")).distinct(), f"large{step}")
        top = large.groupBy("v").agg(F.min("m").alias("top"))
        rest = large.join(top, "v").where("m != top").select(F.col("m").alias("v"), F.col("top").alias("m"))
        stars = work.save(rest.union(top).distinct(), f"stars{step}")
        work.drop(f"stars{step - 1}", f"large{step}")
    return stars.select(F.col("v").alias("node"), F.col("m").alias("label")).union(stars.select("m", "m").distinct())


def _answer(work: Work, table: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    sizes = classes.select("class_id", "n_class")
    ends = links.union(links.select("b", "a"))
    degree = ends.join(sizes, ends["b"] == sizes["class_id"]).groupBy(F.col("a").alias("class_id")).agg(F.sum("n_class").alias("others"))
    label = components(work, links).withColumnRenamed("node", "class_id")
    named = classes.select("class_id", "lowest", "n_class").join(label, "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))
    lowest = named.groupBy("label").agg(F.min("lowest").alias("component_id"))
    per_class = named.join(lowest, "label").join(degree, "class_id", "left").select(
        "class_id", "component_id", (F.coalesce("others", F.lit(0)) + F.col("n_class") - 1).alias("n_similar"), "n_class"
    )
    per_class = work.save(per_class, "per_class")
    docs = work.save(table.select("doc_id", "l", "class_id"), "docs")
    work.drop("sets", "classes", "links")
    total = docs.count()
    limit = max(1000, total // 1000)
    hot = F.broadcast(per_class.where(F.col("n_class") > limit))  # at most a thousand classes
    out = lambda df: df.select(
        "doc_id", F.col("l").cast("long").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"),
        F.coalesce("component_id", "doc_id").alias("component_id"), "class_id",
    )
    some = docs.where("l > 0")
    empty = docs.where("l = 0").withColumns({"n_similar": F.lit(0), "component_id": F.col("doc_id")})
    cold = some.join(hot.select("class_id"), "class_id", "left_anti").join(per_class.where(F.col("n_class") <= limit), "class_id")
    return out(some.join(hot, "class_id")).unionByName(out(cold)).unionByName(out(empty))
