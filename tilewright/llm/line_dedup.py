"""Fuzzy line dedup with DataFrame functions alone: MinHash of character shingles, banding, exact Jaccard, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import connected_components
from ..storage import discard, materialize, small_enough

SHINGLE = 5
BINS = 16
#: Each bin in two halves, whose minima are compared one by one before texts are looked at.
HALVES = 2 * BINS
#: Shingle hashes that a line keeps for its bins, about; all of a shorter line.
KEPT = 96
#: Longer lines are sampled no more thinly, so that one that repeats itself keeps some of its few shingles.
LONG = 512
#: Half bins of each long, in ``BITS`` bits each; a sum of two such fields stays in them.
PACKS, BITS = [range(k, k + 8) for k in range(0, HALVES, 8)], 7
#: A sampled line with fewer full bins is hashed whole: it repeats itself, as others have this many but for one in 100,000.
FEW = 14
#: Half bins that must agree, of 32, for a proposal to be confirmed: more than four standard errors below the mean at a similarity of 0.8.
LEAST_AGREEING = 14
#: Bins of each band: three parallel classes of a four by four grid (columns, rows, one diagonal), so two bands share one bin at most.
BANDS = [[4 * x + y for y in range(4)] for x in range(4)] + [[4 * x + (m * x + b) % 4 for x in range(4)] for m in (0, 1) for b in range(4)]
#: Members up to which all of a bucket meet each other; those of larger ones meet a leader first.
SMALL = 16
#: Members a side of a block of a larger bucket that leaders leave in several components.
BLOCK = 1024
#: Longs of a line's bitmap of shingles.
WORDS = 64
#: Pairs a line, on average, beyond which each line's best pair is confirmed before the others.
PAIRS_A_LINE = 8


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(row if named, doc_id, pos, line, a, b): the lines of every text; ``a`` and ``b`` are 128 bits that equal lines share."""
    rows = docs.select(*([F.col(row).alias("row")] if row else []), F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)).alias("pos", "line"))
    return rows.withColumns({"a": F.xxhash64("line"), "b": F.xxhash64("line", F.lit("second"))})


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _shingles(line: Column) -> Column:
    """Hashes of a line's ``SHINGLE``-character substrings, by place.

    A shorter line is its own one shingle. Characters are UTF-16 units, so that
    each substring is a slice of bytes at any place of a long line.
    """
    places = lambda u: F.sequence(F.lit(1), F.greatest(F.octet_length(u) - F.lit(2 * SHINGLE - 1), F.lit(1)), F.lit(2))
    return _let(F.encode(line, "UTF-16BE"), lambda u: F.transform(places(u), lambda p: F.xxhash64(F.substring(u, p, F.lit(2 * SHINGLE)))))


def similar(a: Column, b: Column, min_percent: int) -> Column:
    """Whether the Jaccard similarity of two lines' sets of :func:`_shingles` is ``min_percent`` or more."""
    sets = F.struct(_shingles(a).alias("a"), _shingles(b).alias("b"))
    return _let(sets, lambda s: 100 * F.size(F.array_intersect(s["a"], s["b"])) >= min_percent * F.size(F.array_union(s["a"], s["b"])))


def _at_places(lines: DataFrame, *columns: Column) -> DataFrame:
    """(a, n, columns, u, p): a row for each of a line's ``n`` shingle places, ``u`` being its UTF-16 bytes."""
    units = lines.select("a", F.encode("line", "UTF-16BE").alias("u"))
    units = units.withColumn("n", F.greatest(F.expr(f"cast(length(u) / 2 as int) - {SHINGLE - 1}"), F.lit(1)))
    return units.select("a", "n", *columns, "u", F.explode(F.expr("sequence(1, n)")).alias("p"))


def _bins(lines: DataFrame, kept: int) -> DataFrame:
    """One permutation hashing: (a, n, m0 ..), the least shingle hash of each of ``HALVES`` half bins.

    A shingle counts if its hash is below a threshold of about ``kept`` / length,
    the length taken as ``LONG`` at most, so long lines cost little, and a bin's
    value, where there is one, is the same under any threshold. ``n`` is the
    line's number of shingle places. Minima combine before the shuffle.
    """
    below = F.expr(f"case when n <= {kept} then {(1 << 63) - 1}L else cast({float(1 << 63)}D * {kept} / least(n, {LONG}) as long) end").alias("below")
    hashed = _at_places(lines, below).withColumn("x", F.xxhash64(F.expr(f"substring(u, 2 * p - 1, {2 * SHINGLE})")).bitwiseAND((1 << 63) - 1))
    near = hashed.where("x <= below or p = 1").select("a", "n", F.expr("x <= below").alias("ok"), F.expr(f"cast(x & {HALVES - 1}L as int)").alias("bin"), F.expr("cast(shiftright(x, 33) as int)").alias("v"))
    least = [F.min(F.expr(f"case when ok and bin = {i} then v end")).alias(f"m{i}") for i in range(HALVES)]
    return near.groupBy("a").agg(F.max("n").alias("n"), *least)


def _filled(bins: DataFrame) -> DataFrame:
    """(a, sparse, b, p0 ..): all bins as an array, and ``BITS`` bits of each half bin packed into longs.

    A bin's value is the lesser of its halves'. Empty bins borrow from the next
    full one, found by the lowest bit of a turned mask of full bins; empty
    halves are 0.
    """
    whole = [F.least(f"m{i}", f"m{i + BINS}") for i in range(BINS)]
    mask = sum((F.when(m.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(whole)), F.lit(0))
    field = lambda i, k: F.expr(f"shiftleft(cast(coalesce(m{i}, 0) & {(1 << BITS) - 1} as bigint), {BITS * k})")
    packs = [sum((field(i, k) for k, i in enumerate(part)), F.lit(0)).cast("long").alias(f"p{h}") for h, part in enumerate(PACKS)]
    packed = bins.select("a", "n", mask.alias("mask"), F.array(*whole).alias("m"), *packs)
    ahead = f"transform(sequence(0, {BINS - 1}), i -> bit_count((shiftrightunsigned(mask * {(1 << BINS) + 1}L, i) & -shiftrightunsigned(mask * {(1 << BINS) + 1}L, i)) - 1L))"
    # most lines have no empty bin
    filled = F.when(F.col("mask") == (1 << BINS) - 1, F.col("m")).otherwise(F.expr(f"transform({ahead}, (k, i) -> m[(i + k) % {BINS}] + k)"))
    return packed.select("a", ((F.bit_count("mask") < FEW) & (F.col("n") > KEPT)).alias("sparse"), filled.alias("b"), *[f"p{h}" for h in range(len(PACKS))])


def _signatures(lines: DataFrame) -> DataFrame:
    """(a, sparse, b, p0 ..) of every line, written; self-repeating lines are hashed whole."""
    bins = materialize(_filled(_bins(lines, KEPT)), "bins")
    sparse = materialize(bins.where("sparse").select("a"), "sparse")
    if sparse.isEmpty():
        return bins
    return bins.where("not sparse").union(materialize(_filled(_bins(_texts(lines, sparse), 1 << 30)), "bins"))


def _equal_bins(a: str, b: str) -> Column:
    """How many half bins have equal bits, by the carries of adding to each field of the difference."""
    top = 1 << (BITS - 1)
    low, high = (F.lit(sum(v << (BITS * k) for k in range(len(PACKS[0])))) for v in (top - 1, top))
    total = F.lit(0)
    for h in range(len(PACKS)):
        v = F.col(f"{a}p{h}").bitwiseXOR(F.col(f"{b}p{h}"))
        total = total + F.bit_count(F.bitwise_not(v.bitwiseAND(low) + low).bitwiseAND(F.bitwise_not(v)).bitwiseAND(high))
    return total


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, line) of the wanted lines alone, each once."""
    wanted = F.broadcast(wanted) if small_enough(wanted.count(), 40) else wanted
    return lines.select("a", "line").join(wanted, "a", "left_semi").groupBy("a").agg(F.first("line").alias("line"))


def _bitmaps(texts: DataFrame) -> DataFrame:
    """(a, n, w0 ..): the number of different shingles of lines, and their bitmaps in ``WORDS`` columns."""
    each = texts.select("a", F.array_distinct(_shingles(F.col("line"))).alias("s")).select("a", F.size("s").alias("n"), F.explode("s").alias("x"))
    bits = each.select("a", "n", F.expr(f"cast(x & {WORDS - 1}L as int)").alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(x, 8) & 63L as int))").alias("bit"))
    return bits.groupBy("a").agg(F.max("n").alias("n"), *[F.expr(f"coalesce(bit_or(case when w = {i} then bit end), 0L)").alias(f"w{i}") for i in range(WORDS)])


def _components(links: DataFrame) -> DataFrame:
    """(node, component) of the lines that have a link."""
    near = materialize(connected_components(links, "x", "y"), "components")
    return F.broadcast(near) if small_enough(near.count(), 40) else near


def _apart(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs whose ends have different components."""
    for end in ("x", "y"):
        pairs = pairs.join(near.toDF(end, f"c{end}"), end, "left")
    return pairs.where("coalesce(cx, x) <> coalesce(cy, y)").drop("cx", "cy")


def _may_be_similar(x: str, y: str, min_percent: int) -> Column:
    """Whether lines of ``m`` shingles whose bitmaps differ in so many bits can be similar.

    Lines that differ in d shingles differ in d bits of their bitmaps at most, so
    no similar pair is put aside.
    """
    differ = sum((F.bit_count(F.col(f"{x}w{i}").bitwiseXOR(F.col(f"{y}w{i}"))) for i in range(WORDS)), F.lit(0))
    return differ * (100 + min_percent) <= (100 - min_percent) * (F.col(f"{x}m") + F.col(f"{y}m"))


def _confirmed(texts: DataFrame, pairs: DataFrame, min_percent: int) -> DataFrame:
    """Links (x, y) that join all lines that similar ones among the ``pairs`` (x, y, agree) join, by their full sets.

    Where there are very many pairs, each line's pair with most equal bins is
    confirmed first, then those that this does not join.
    """

    def full(some: DataFrame) -> DataFrame:
        # merged, never broadcast by the size of their file, which says little about that of texts
        both = some.join(texts.toDF("x", "lx").hint("merge"), "x").join(texts.toDF("y", "ly").hint("merge"), "y")
        return materialize(both.where(similar(F.col("lx"), F.col("ly"), min_percent)).select("x", "y"), "links")

    if pairs.count() <= PAIRS_A_LINE * texts.count():
        return full(pairs)
    best = pairs.select(F.explode(F.array("x", "y")).alias("a"), F.struct("agree", "x", "y").alias("p")).groupBy("a").agg(F.max("p").alias("p")).select("p.x", "p.y").distinct()
    first = full(best)
    return first.union(full(materialize(_apart(pairs, _components(first)), "apart")))


def _members(each: DataFrame, packed: DataFrame) -> DataFrame:
    """(key, members, lead, a, p0 ..) of every bucket of two lines at least.

    The leader is the least of an order that differs from bucket to bucket, and
    counts and leaders combine map-side, so a large bucket gathers in no task.
    """
    order = F.col("a").bitwiseXOR(F.col("key"))
    buckets = each.groupBy("key").agg(F.min(order).alias("lead"), F.count("*").alias("members")).where("members > 1")
    buckets = materialize(buckets.select("key", "members", F.col("lead").bitwiseXOR(F.col("key")).alias("lead")), "buckets")
    # the many rows of keys are not sorted for those few that share one
    return materialize(each.join(buckets.hint("shuffle_hash"), "key").join(packed, "a"), "members")


def _proposed(members: DataFrame) -> DataFrame:
    """Pairs (x, y, agree): all of every small bucket, and each member of a large one with its leader, if enough bins agree."""
    side = members.select("key", "a", *[f"p{h}" for h in range(len(PACKS))])
    small, large = members.where(F.col("members") <= SMALL).select(side.columns), members.where(F.col("members") > SMALL)
    few = _renamed(small, "l_").join(_renamed(small, "r_"), F.expr("l_key = r_key and l_a < r_a"))
    led = _renamed(large.select(side.columns), "l_").join(_renamed(large.where("a = lead").select(side.columns), "r_"), F.expr("l_key = r_key and l_a <> r_a"))
    pairs = few.union(led).select(F.least("l_a", "r_a").alias("x"), F.greatest("l_a", "r_a").alias("y"), _equal_bins("l_", "r_").alias("agree"))
    return pairs.where(F.col("agree") >= LEAST_AGREEING).distinct()


def _mixed(members: DataFrame, near: DataFrame) -> DataFrame:
    """The members of large buckets of more than one component, with their component ``c``, the buckets' sizes and largest one."""
    inside = members.join(near.toDF("a", "c"), "a", "left").withColumn("c", F.coalesce("c", "a"))
    inside = materialize(inside, "inside")
    parts = inside.groupBy("key", "c").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("key").agg(F.sum("k").alias("n"), F.max("k").alias("top"), F.max_by("c", "k").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    return inside.join(mixed.drop("parts"), "key")


def _blocks(mixed: DataFrame, *more: str) -> tuple[DataFrame, DataFrame, Column]:
    """Members outside their bucket's largest component, all members, dealt to blocks, and the condition that two may be similar by their bins."""
    blocks = mixed.withColumns({"other": F.col("c") != F.col("most"), "all_blocks": F.ceil(F.col("n") / BLOCK).cast("int"), "other_blocks": F.ceil((F.col("n") - F.col("top")) / BLOCK).cast("int")})
    columns = ["a", "c", "other", *[f"p{h}" for h in range(len(PACKS))], *more]
    block = lambda seed, of: F.pmod(F.xxhash64("a", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = blocks.where("other").select("key", block("other", "other_blocks").alias("i"), every("all_blocks").alias("j"), *columns)
    right = blocks.select("key", every("other_blocks").alias("i"), block("all", "all_blocks").alias("j"), *columns)
    meet = F.expr("l_key = r_key and l_i = r_i and l_j = r_j and l_c <> r_c and (not r_other or l_a < r_a)")
    return _renamed(left, "l_"), _renamed(right, "r_"), meet & (_equal_bins("l_", "r_") >= LEAST_AGREEING)


def _in_blocks(lines: DataFrame, mixed: DataFrame, min_percent: int) -> tuple[DataFrame, DataFrame]:
    """Texts (a, line), and the pairs (x, y, agree) of them between each member outside its bucket's largest component and all of other components.

    Members with another one whose bins agree bring their bitmaps along, so pairs
    that cannot be similar end in their block. Two lines that share several
    buckets are judged in the one of the least key.
    """
    left, right, meet = _blocks(mixed)
    found = left.join(right, meet, "left_semi").select(F.col("l_a").alias("a")).union(right.join(left, meet, "left_semi").select("r_a")).distinct()
    texts = materialize(_texts(lines, materialize(found, "wanted")), "texts")
    maps = materialize(_bitmaps(texts), "bitmaps")
    mixed = mixed.join(maps.select("a"), "a", "left_semi")
    own = mixed.groupBy("a").agg(F.collect_list("key").alias("keys"))
    bits = ["m", *[f"w{i}" for i in range(WORDS)]]
    left, right, meet = _blocks(mixed.join(own, "a").join(maps.withColumnRenamed("n", "m"), "a"), "keys", *bits)
    first = F.expr("array_min(array_intersect(l_keys, r_keys)) = l_key")
    met = left.join(right, meet & _may_be_similar("l_", "r_", min_percent) & first)
    return texts, materialize(met.select(F.least("l_a", "r_a").alias("x"), F.greatest("l_a", "r_a").alias("y"), _equal_bins("l_", "r_").alias("agree")), "proposed")


def near_lines(docs: DataFrame, min_percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links (x, y) between similar lines, by their hash ``a``: exact Jaccard similarity of ``min_percent`` or more.

    Each band of four of the sixteen bins is a key. In a bucket of ``SMALL``
    lines at most all meet each other; in a larger one each meets a leader.
    Pairs whose bins agree far less than similar lines' would are put aside; the
    rest are confirmed on full shingle sets (:func:`_confirmed`). In a large bucket
    that this leaves in several components, members outside the largest one meet
    all of others, block by block (:func:`_in_blocks`), so no bucket has a member
    that is not looked at. Joined lines are not compared again, so the links keep
    the components, not every similar pair.
    """
    lines = lines_of(docs, doc_id, text).where("line <> ''").select("a", "line")
    bins = _signatures(lines)
    packed = bins.select("a", *[f"p{h}" for h in range(len(PACKS))])
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.col("b")[i] for i in band]) for k, band in enumerate(BANDS)])
    members = _members(bins.select("a", F.explode(keys).alias("key")), packed)
    discard(bins)
    proposed, large = materialize(_proposed(members), "proposed"), materialize(members.where(F.col("members") > SMALL), "large")
    discard(members)
    ends = proposed.select(F.explode(F.array("x", "y")).alias("a")).distinct()
    texts = materialize(_texts(lines, materialize(ends, "wanted")), "texts")
    links = _confirmed(texts, proposed, min_percent)
    discard(proposed, texts)
    if large.isEmpty():
        return links
    mixed = materialize(_mixed(large, _components(links)), "mixed")
    discard(large)
    if mixed.isEmpty():
        return links
    texts, pairs = _in_blocks(lines, mixed, min_percent)
    links = links.union(_confirmed(texts, pairs, min_percent))
    discard(mixed, texts, pairs)
    return links


def dedup_lines(docs: DataFrame, min_percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``docs`` with repeated and nearly repeated lines taken out of ``text``, and ``n_lines``, ``n_dropped``.

    Equal lines, and lines linked by :func:`near_lines`, form components; the
    line with the smallest (doc_id, position) stays (null ids last) and every
    other is dropped. Empty lines always stay. A null text stays null with no
    lines; a text whose lines all go is empty. Rows equal in id and text are one
    document with one decision. Other columns are kept; columns named like a
    result are replaced. Nothing here runs Python on executors.
    """
    near = _components(near_lines(docs, min_percent, doc_id, text))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = lines_of(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(body).alias("row")), row="row").where("line <> ''").drop("line")
    lines = materialize(lines.join(near, lines["a"] == near["node"], "left").select("row", "doc_id", "pos", F.coalesce("component", "a").alias("c"), F.when(F.col("component").isNull(), F.col("b")).alias("d")), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pos", "row")
    first = lines.groupBy("c", "d").agg(F.min(place).alias("first"), F.max(place).alias("other")).where(~F.col("first").eqNullSafe(F.col("other"))).select(F.col("c").alias("c1"), F.col("d").alias("d1"), "first")
    first = materialize(first, "repeated")
    first = F.broadcast(first) if small_enough(first.count(), 80) else first
    dropped = lines.join(first, (F.col("c") == F.col("c1")) & F.col("d").eqNullSafe(F.col("d1"))).where(~F.col("first").eqNullSafe(place))
    dropped = materialize(dropped.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone")), "dropped")
    size = dropped.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    dropped = F.broadcast(dropped) if small_enough(size[0] + size[1], 40) else dropped
    # the caller's columns travel as one struct, so no name of theirs can clash
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = docs.select(F.struct(*kept).alias("own"), F.col(doc_id).alias("id"), F.xxhash64(body).alias("of"), F.col(text).cast("string").alias("body"))
    own = own.join(dropped, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("row")), "left")
    pieces = F.split("body", "\n", -1)
    rest = F.array_join(F.filter(pieces, lambda line, i: ~F.array_contains("gone", i)), "\n")
    count = F.when(F.col("body").isNull(), F.lit(0)).otherwise(F.size(pieces)).cast("long")
    columns = [F.when(F.col("gone").isNull(), F.col("body")).otherwise(rest).alias(c) if c == text else F.col("own")[c].alias(c) for c in kept]
    return own.select(*columns, count.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
