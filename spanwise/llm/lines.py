"""Line dedup within an edit bound, by a join of hashed keys that near lines must share.

Only DataFrame functions. Equal lines are first made one row. Two lines at distance one agree
when one character is deleted at the right place; hashes of such variants are joined. So that
not every line emits a variant for each of its characters, two filters that lose no pair come
first: halves (one half of the two lines must be equal, by hash) and blocks (everything around one
block of 32 characters must be equal); only characters of blocks whose surroundings occur in
several lines are deleted.

For a bound k of two or more every line has k + 1 segments, the first ones counted from its
start, the others from its end, of a width that lines of about one length share. With k edits
some segment i has at most i edits before it, none in it and at most k - i behind it, so the
other line holds it at most min(i, k - i) characters away: 5, 8 or 13 keys for k of 2, 3 or 4.
Lines that share a key are compared with ``levenshtein`` where a key has few pairs. Where it has
many, the longer rest beside the segment, which holds at most k - i (or i) edits, is cut in the
same way, and key and segment together are the next key. A rest of at most SHORT characters emits
its deletion variants: all that is left of it without up to that many characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import cut, last_id, partitions

BLOCK = 32
#: Bound of the query and the pipeline: two edits, three from 400 characters, four from 800.
NEAR = {"edits": 2, "per": 400, "most": 4}
#: Both remove equal lines of any length that are not blank.
EQUAL = {"least": 1}
#: Keys with more pairs than this are cut further. Up to it marks are compared, two longs a pair, while
#: every cut gives a line five to 13 new rows: lines that differ here and there share most of their cuts.
PAIRS = 4_194_304
#: In keys with more pairs than this every line is held against the earliest first.
STAR = 64
#: Rests up to this long emit their deletion variants.
SHORT = 12
#: Lines that occur more often than this are searched for near ones at their first occurrence only.
OFTEN = 100
#: Letters counted before ``levenshtein`` is asked; lines of other scripts are all asked.
LETTERS = "etaoinsrhldu"
#: Hashes of lines up to this many are broadcast.
BROADCAST_LINES = 1_000_000
#: Lines up to this many (counted), of at most BROADCAST_CHARS characters in all, are broadcast to the pairs they stand in.
BROADCAST_TEXTS = 20_000
BROADCAST_CHARS = 8_000_000


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: _doc, _hash of the text, _pos, _line."""
    d = docs.select(last_id(key).alias("_doc"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    return d.select("_doc", F.xxhash64("_text").alias("_hash"), F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))


def shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key more than one row has. Keys are counted before they move."""
    several = rows.groupBy(key).agg(F.count("*").alias("_k")).filter("_k > 1").select(key)
    return rows.join(several, key, "left_semi")


def roles(n: Column) -> Column:
    """Frames a line of n characters takes part in: of n (the other has n or n + 1), and of n - 1 (it is the longer one)."""
    return F.array(n, n - 1)


def halves(line: Column, n: Column) -> Column:
    """Hashes of the line's first and last half in both of its frames; equal lengths give one hash."""
    front = F.array_distinct(F.transform(roles(n), lambda f: F.floor((f + 1) / 2).cast("int")))
    back = F.array_distinct(F.transform(roles(n), lambda f: f - F.floor((f + 1) / 2).cast("int")))
    return F.concat(F.transform(front, lambda h: F.xxhash64(F.lit("p"), h, left(line, h))), F.transform(back, lambda h: F.xxhash64(F.lit("s"), h, tail(line, h))))


def left(s: Column, n: Column) -> Column:
    return F.substring(s, F.lit(1), F.greatest(n, F.lit(0)))


def tail(s: Column, n: Column) -> Column:
    """The last n characters."""
    return F.when(n > 0, F.substring(s, F.length(s) - n + 1, n)).otherwise("")


def bound(n: Column, edits: int, per: int, most: int) -> Column:
    """Edits by which two lines may differ, the shorter one having n characters."""
    return F.least(F.lit(most), F.lit(edits) + F.floor(n / per)).cast("int") if per else F.lit(edits)


def width(n: Column) -> Column:
    """``n`` with all but its three highest bits cleared: what lines of about one length share."""
    low = F.greatest(F.length(F.bin(n)) - 3, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n, low), low)


def framed(lines: DataFrame, line: str, k, most: int) -> DataFrame:
    """A row for each frame of a line: _n, _width, _k, _own. It is the shorter of two lines (own) or up to
    ``most`` characters the longer one; lengths that share width and bound are one frame. ``k`` gives the bound for a length."""
    d, n = F.col("_d"), F.col("_n")
    same = lambda m: (width(m) == width(n)) & (k(m) == k(n))
    out = lines.withColumn("_n", F.length(line)).withColumn("_d", F.explode(F.array(*[F.lit(i) for i in range(most + 1)])))
    out = out.filter((d == 0) | ((n >= d) & (k(n - d) >= d) & ((width(n - d) != width(n - d + 1)) | (k(n - d) != k(n - d + 1)))))
    return out.select(*lines.columns, "_n", width(n - d).alias("_width"), k(n - d).alias("_k"), same(n - d).alias("_own"))


def places(k: int) -> Column:
    """Segments (i) for bound ``k`` and how far from its place each is looked for (by)."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(by).alias("by")) for i in range(k + 1) for by in range(-min(i, k - i), min(i, k - i) + 1)])


def segments(rows: DataFrame, line: str, least: int, most: int, seed: Column) -> DataFrame:
    """Rows of ``framed`` with the keys of their segments: key, own, start and size (of the longer rest beside the segment) and left (the edits left for it)."""
    n, k, i, by = (F.col(c) for c in ("_n", "_k", "_p.i", "_p.by"))
    of = places(most)
    for t in range(most - 1, least - 1, -1):
        of = F.when(k == t, places(t)).otherwise(of)
    out = rows.withColumn("_p", F.explode(of))
    first = 2 * i <= k
    size = F.floor(F.col("_width") / (k + 1)).cast("int")
    out = out.withColumn("_size", size).withColumn("_at", F.when(first, size * i).otherwise(n - size * (k + 1 - i)) + by)
    at = F.col("_at")
    key = F.xxhash64(seed, "_width", "_k", i, F.substring(F.col(line), at + 1, F.col("_size")))
    end = at + F.col("_size")
    start, rest = F.when(first, end).otherwise(0), F.greatest(F.when(first, n - end).otherwise(at), F.lit(0))
    return out.withColumn("_s", F.struct(key.alias("key"), (F.col("_own") & (by == 0)).alias("own"), start.alias("start"), rest.alias("size"), F.when(first, k - i).otherwise(i).alias("left")))


def variants(rest: Column, edits: Column, most: int) -> Column:
    """All that is left of a text without up to ``edits`` of its characters."""
    out = F.array(rest)
    drop = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(left(s, i - 1), F.substring(s, i + 1, F.length(s))))
    for e in range(1, most + 1):
        out = F.when(edits >= e, F.array_distinct(F.concat(out, F.flatten(F.transform(out, drop))))).otherwise(out)
    return out


def placed(df: DataFrame) -> DataFrame:
    """``df``, dealt by a key, cut. The copy knows how it is dealt, so joins on the key leave it where it is;
    a plan that is changed while it runs would not keep that."""
    spark = df.sparkSession
    name = "spark.sql.adaptive.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return cut(df)
    finally:
        spark.conf.set(name, was)


def candidates(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """_a, _first, _line of lines that share a _key of ``keys`` (_a, _key) with a different line.

    Only keys are compared, in one shuffle; the text of the few lines that are left is then
    gathered, one row per distinct line. The list of these is broadcast if its counted rows
    are at most BROADCAST_LINES; beyond that the lines are dealt by hash to meet it.
    """
    same = Window.partitionBy("_key")
    several = keys.withColumn("_lo", F.min("_a").over(same)).withColumn("_hi", F.max("_a").over(same)).filter("_lo <> _hi")
    hot = cut(several.select("_a").distinct())
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_LINES else hot
    first = F.min(F.struct(F.struct("_doc", "_pos", "_hash").alias("at"), F.col("_line").alias("line"))).alias("m")
    dealt = lines.join(hot, "_a").repartition(partitions(lines.sparkSession), "_a")
    return placed(dealt.groupBy("_a").agg(first).select("_a", F.col("m.at").alias("_first"), F.col("m.line").alias("_line")))


def earlier_neighbours(lines: DataFrame) -> DataFrame:
    """_a (hash of a line) and _near, the first occurrence of the earliest other line at distance
    one, where that is earlier than the line's own."""
    line, n = F.col("_line"), F.length("_line")
    frame = F.col("_n")
    near = candidates(lines, lines.select("_a", F.explode(halves(line, n)).alias("_key"))).withColumn("_n", F.explode(roles(n))).filter("_n > 0")

    # blocks
    block = F.col("_block")
    start, rest = block * BLOCK, F.greatest(frame - (block + 1) * BLOCK, F.lit(0))
    near = near.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((frame - 1) / BLOCK).cast("int"))))
    around = [F.xxhash64(F.lit(seed), frame, block, left(line, start), F.lit(seed), tail(line, rest)) for seed in (3, 5)]
    near = near.select("_a", "_first", (n > frame).alias("_longer"), around[0].alias("_key"), around[1].alias("_key2"), F.substring(line, start + 1, n - start - rest).alias("_part"))
    near = shared(near, "_key")

    # variants: a character replaced (same place deleted in both), or one inserted in the longer line
    part = F.col("_part")
    drop = lambda i: F.concat(left(part, i), F.substring(part, i + 2, F.length(part)))
    cuts = F.sequence(F.lit(0), F.length(part) - 1)
    same = F.transform(cuts, lambda i: F.struct(F.xxhash64(F.lit(7), "_key", i, drop(i)).alias("v"), F.xxhash64(F.lit(11), "_key2", i, drop(i)).alias("u")))
    whole = lambda s: F.struct(F.xxhash64(F.lit(13), "_key", s).alias("v"), F.xxhash64(F.lit(17), "_key2", s).alias("u"))
    gone = F.array_distinct(F.transform(cuts, lambda i: whole(drop(i))))
    variants = near.select(
        "_a", "_first", "_part", "_longer",
        F.explode(F.when(F.col("_longer"), gone).otherwise(F.array_append(same, whole(part)))).alias("_v"),
    )
    variants = variants.select("_a", "_first", "_part", "_longer", "_v.v", "_v.u")
    one = F.struct("_first", "_part")
    low = variants.groupBy("v", "u").agg(F.min(F.when(~F.col("_longer"), one)).alias("_short"), F.min(F.when(F.col("_longer"), one)).alias("_long"), F.count("*").alias("_k"))
    found = variants.join(low.filter("_k > 1"), ["v", "u"])
    # Two longer lines are no pair here: they meet as lines of one length in their other frame.
    # Lines whose own text is the variant are one class, so for them only the longer ones count.
    others = F.array(F.col("_short"), F.when(~F.col("_longer"), F.col("_long")))
    other = F.array_min(F.filter(others, lambda o: o.isNotNull() & (o["_first"] < F.col("_first")) & (F.levenshtein(o["_part"], F.col("_part"), 1) == 1)))
    found = found.withColumn("_other", other).filter(F.col("_other").isNotNull())
    return found.groupBy("_a").agg(F.min("_other._first").alias("_near"))


def finer(rows: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Rows of keys with many pairs under longer keys; ``last`` where nothing is left to cut."""
    rows = rows.join(texts.select("_a", "_line"), "_a").withColumn("rest", F.substring(F.col("_line"), F.col("start") + 1, F.col("size")))
    n = F.length("rest")
    none = F.lit(0)
    done = lambda df, rest: df.select("_a", "_first", "_marks", "_open", F.xxhash64("key", rest).alias("key"), "own", none.alias("start"), none.alias("size"), "left", F.lit(True).alias("last"))
    # a rest a little longer than SHORT may have a partner that is not: it goes both ways
    short = rows.filter((F.col("left") > 0) & (n <= SHORT + F.col("left"))).withColumn("_v", F.explode(variants(F.col("rest"), F.col("left"), most)))
    out = done(rows.filter(F.col("left") == 0), "rest").unionByName(done(short, "_v"))
    for t in range(1, most + 1):
        some = framed(rows.filter((F.col("left") == t) & (n > SHORT)), "rest", lambda _: F.lit(t), t)
        # the shorter line need not have the shorter rest: roles of this cut do not bind
        out = out.unionByName(segments(some, "rest", t, t, F.col("key")).select("_a", "_first", "_marks", "_open", "_s.key", "own", (F.col("start") + F.col("_s.start")).alias("start"), "_s.size", "_s.left", F.lit(False).alias("last")))
    return out


def given(value: Column, f) -> Column:
    """``f(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shared_start(a: Column, b: Column) -> Column:
    """Number of characters that two texts share at their start, by halving steps."""
    top = F.least(F.length(a), F.length(b))
    same = lambda p, s: (p + s <= top) & (F.substring(a, p + 1, s) == F.substring(b, p + 1, s))
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), F.lit(0), lambda p, s: F.when(same(p, s), p + s).otherwise(p))


def distance(a: Column, b: Column, most: int) -> Column:
    """``levenshtein`` up to ``most`` (else -1) of what lies between the shared start and the shared
    end: its time grows with the product of the lengths."""
    rest = lambda s, p: F.substring(s, p + 1, F.length(s))
    turned = given(shared_start(a, b), lambda p: F.struct(F.reverse(rest(a, p)).alias("a"), F.reverse(rest(b, p)).alias("b")))
    return given(turned, lambda t: given(shared_start(t["a"], t["b"]), lambda q: F.levenshtein(rest(t["a"], q), rest(t["b"], q), most)))


def letters(line: Column) -> Column:
    """How often each of LETTERS occurs."""
    return F.array(*[F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS])


def marks(line: Column, k: Column) -> Column:
    """x, y: 16 counts in eight bits each: of each of LETTERS, other letters before and behind the middle of the
    alphabet, blanks and all characters; a step of a count changes one bit (Johnson code: counts 16 apart are alike). And the bound ``k``."""
    step = F.array(*[F.lit(v) for v in [(1 << c) - 1 for c in range(8)] + [256 - (1 << c) for c in range(8)]])
    other = lambda some: F.length(line) - F.length(F.translate(line, some, ""))
    counts = [F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS] + [other("bcfgjk"), other("mpqvwxyz"), other(" "), F.length(line)]
    code = [F.get(step, (c % 16).cast("int")).cast("long") for c in counts]
    pack = lambda part: reduce(lambda x, y: x.bitwiseOR(y), [F.call_function("shiftleft", c, F.lit(8 * i)) for i, c in enumerate(part)])
    return F.struct(pack(code[:8]).alias("x"), pack(code[8:]).alias("y"), k.alias("k"))


def differ(a: Column, b: Column) -> Column:
    """Whether the marks of two lines rule them out: an edit moves two counts by one, of two characters, or of one and of all."""
    return F.bit_count(a["x"].bitwiseXOR(b["x"])) + F.bit_count(a["y"].bitwiseXOR(b["y"])) > 2 * F.greatest(a["k"], b["k"])


def near_of(pairs: DataFrame, texts: DataFrame, edits: int, per: int, most: int) -> DataFrame:
    """Of pairs (_one, _two) of lines those within the bound: _one, _two and their first occurrences _f, _g. Only here texts are
    fetched: ``texts`` stays in place for _two, and what _one names, where one line may stand in many pairs, is taken out of it."""
    side = lambda rows, at, name, first: rows.select(F.col("_a").alias(at), F.col("_first").alias(first), F.col("_line").alias(name))
    heads = cut(texts.join(pairs.select(F.col("_one").alias("_a")).distinct(), "_a", "left_semi"))
    n, chars = heads.agg(F.count("*"), F.coalesce(F.sum(F.length("_line")), F.lit(0))).first()
    heads = side(heads, "_one", "_x", "_f")
    heads = F.broadcast(heads) if n <= BROADCAST_TEXTS and chars <= BROADCAST_CHARS else heads
    pairs = pairs.join(heads, "_one").join(side(texts, "_two", "_y", "_g"), "_two")
    x, y, n = F.col("_x"), F.col("_y"), F.least(F.length("_x"), F.length("_y"))
    near = pairs.filter(F.greatest(F.length(x), F.length(y)) - n <= most).withColumn("_apart", distance(x, y, most))
    return near.filter(F.col("_apart").between(F.lit(1), bound(n, edits, per, most))).select("_one", "_two", "_f", "_g")


def compared(rows: DataFrame) -> DataFrame:
    """Pairs of rows that share a key, one of them as its own, the later one open, and that the marks do not rule out: _one (the earlier), _f (its first occurrence) and _two."""
    one = rows.filter("own").select("key", *[F.col(c).alias(f"_s{c}") for c in ("_a", "_first", "_marks", "_open")])
    rows = rows.select(F.col("key").alias("_key"), "_a", "_first", "_marks", "_open")
    earlier = F.col("_s_first") < F.col("_first")
    later = F.when(earlier, F.col("_open")).otherwise(F.col("_s_open"))
    pairs = one.join(rows, (F.col("key") == F.col("_key")) & (F.col("_s_a") != F.col("_a")) & later & ~differ(F.col("_s_marks"), F.col("_marks")))
    return pairs.select(F.when(earlier, F.col("_s_a")).otherwise(F.col("_a")).alias("_one"), F.least("_s_first", "_first").alias("_f"), F.when(earlier, F.col("_a")).otherwise(F.col("_s_a")).alias("_two"))


def earlier_within(lines: DataFrame, edits: int, per: int, most: int) -> DataFrame:
    """As ``earlier_neighbours`` for a bound of two edits and more.

    In a key of several pairs every line is first held against the earliest one. A line near that
    one has no earlier neighbour under this key or a longer one: it is not open, and from then on only the
    earlier one of a pair. So a large group of near lines costs one comparison a line. Of the other lines each
    is held against the earliest one that the marks allow: if that is near, no other can be its earlier
    neighbour under these keys. Only lines whose first try fails are compared with all that the marks allow.
    """
    of = lambda n: bound(n, edits, per, most)
    cutting = lambda df: segments(framed(df, "_line", of, most), "_line", edits, most, F.lit(0))
    texts = candidates(lines, cutting(lines).select("_a", F.col("_s.key").alias("_key")))
    rows = cutting(texts.withColumn("_marks", marks(F.col("_line"), of(F.length("_line")))))
    rows = rows.select("_a", "_first", "_marks", "_s.key", "_s.own", "_s.start", "_s.size", "_s.left", F.lit(True).alias("_open"), F.lit(False).alias("last"))
    found = None
    pair = ["_one", "_two"]
    while True:
        sizes = rows.groupBy("key").agg(F.min("_a").alias("lo"), F.max("_a").alias("hi"), F.count("*").alias("_c"), F.count_if("own").alias("_o")).filter("_o > 0 and lo <> hi")
        rows = cut(rows.join(sizes.select("key", (F.col("_c") * F.col("_o")).alias("_pairs")), "key"))
        # the earliest line of a key against the others
        several = rows.filter(F.col("_pairs") > STAR)
        hubs = several.groupBy("key").agg(F.min(F.struct("_first", "_a", "_marks")).alias("_hub"))
        spokes = several.filter("_open").join(hubs, "key").filter((F.col("_a") != F.col("_hub._a")) & ~differ(F.col("_marks"), F.col("_hub._marks")))
        spokes = cut(spokes.select(F.col("_hub._a").alias("_one"), F.col("_a").alias("_two"), "key"))
        star = cut(near_of(spokes.select("_one", "_two").distinct(), texts, edits, per, most))
        shut = spokes.join(star.select("_one", "_two"), ["_one", "_two"]).select("key", F.col("_two").alias("_a")).distinct()
        rows = rows.join(shut.withColumn("_shut", F.lit(True)), ["key", "_a"], "left").withColumn("_open", F.col("_open") & F.col("_shut").isNull()).drop("_shut")
        still = rows.groupBy("key").agg(F.count_if("_open").alias("_u"), F.count_if(F.col("_open") & F.col("own")).alias("_v"), F.count("*").alias("_c"), F.count_if("own").alias("_o"))
        # pairs with an open line; alone open, the earliest one is compared with nothing
        still = still.select("key", (F.col("_u") * F.col("_o") + F.col("_v") * F.col("_c")).alias("_pairs")).filter("_pairs > 0")
        rows = cut(rows.drop("_pairs").join(still, "key").withColumn("_many", ~F.col("last") & (F.col("_pairs") > 2 * PAIRS)))
        few = rows.filter("not _many")
        best = cut(compared(few).groupBy("_two").agg(F.min(F.struct("_f", "_one"))["_one"].alias("_one")).select(*pair))
        near = cut(near_of(best.join(spokes, pair, "left_anti"), texts, edits, per, most))
        # near lines need no other try; of a star, the others are open where they are not near the earliest line
        done = near.unionByName(star.join(best, pair, "left_semi")).select(F.col("_two").alias("_a"), F.lit(True).alias("_done")).distinct()
        few = few.join(done, "_a", "left").withColumn("_open", F.col("_open") & F.col("_done").isNull()).drop("_done")
        tried = spokes.select(*pair).unionByName(best).distinct()
        pairs = cut(compared(few).select(*pair).distinct().join(tried, pair, "left_anti"))
        part = star.unionByName(near).unionByName(near_of(pairs, texts, edits, per, most))
        part = cut(part.select(F.col("_two").alias("_a"), F.col("_f").alias("_near")))
        found = part if found is None else found.unionByName(part)
        rows = rows.filter("_many")
        if rows.isEmpty():
            return found.groupBy("_a").agg(F.min("_near").alias("_near"))
        rows = finer(rows, texts, most)


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, edits: int = 1, per: int = 0, most: int | None = None, least: int | None = None) -> DataFrame:
    """One row per line to remove: _doc, _hash (of the text), _pos, _near (no equal line is earlier), _by (the line kept for it).

    A line goes if an earlier line of the corpus, by (id, position), equals it or is within
    ``edits`` edits (0: equals it); with ``per`` one edit more for each ``per`` characters of the
    shorter line, up to ``most``. What else is removed does not matter. Lines under
    ``min_chars`` characters are not searched for near ones; they stay too, unless they have at
    least ``least`` characters (default: ``min_chars``), are not blank and equal an earlier line. A null id comes last; texts that share an id are ordered by
    their hash, equal rows are judged alike. The order of lines decides ties, so none is left.
    """
    most = max(edits, most or 0) if per else edits
    if edits < 0 or per < 0 or (per and (edits < 2 or most == edits)):
        raise ValueError("edits is 0 or more; per needs edits of 2 or more and a larger most")
    searched = F.length("_line") >= min_chars
    equal = (F.length("_line") >= (min_chars if least is None else least)) & F.col("_line").rlike("\\S")
    lines = lines_of(docs, key, text).filter(searched | equal)
    lines = lines.select("_doc", "_hash", "_pos", F.xxhash64(F.lit(1), "_line").alias("_a"), F.xxhash64(F.lit(2), "_line").alias("_b"), "_line")
    every = cut(lines.drop("_line"))
    at = F.struct("_doc", "_pos", "_hash")
    classes = every.groupBy("_a").agg(F.min(F.struct(at.alias("at"), F.col("_b").alias("b"))).alias("m"), F.count("*").alias("_k")).filter("_k > 1")
    verdict = cut(classes.select("_a", F.col("m.b").alias("_same"), F.col("m.at").alias("_first"), "_k"))
    if edits:
        # of a line that occurs very often only the first occurrence is searched
        often = cut(verdict.filter(F.col("_k") > OFTEN).select("_a", F.col("_first").alias("_only")))
        often = F.broadcast(often) if often.count() <= BROADCAST_LINES else often
        long = lines.filter(searched).join(often, "_a", "left").filter(F.col("_only").isNull() | (F.col("_only") == at)).drop("_only")
        near = earlier_neighbours(long) if edits == 1 else earlier_within(long, edits, per, most)
        verdict = cut(verdict.join(near, "_a", "full"))
    else:
        verdict = verdict.withColumn("_near", F.lit(None).cast("struct<_doc:long,_pos:int,_hash:long>"))
    by = F.least("_first", "_near")
    # a line that occurs once has no _same and is its own first
    out = every.join(verdict, "_a").filter(F.col("_same").isNull() | (F.col("_b") == F.col("_same")))
    return out.filter(by < at).select("_doc", "_hash", "_pos", F.coalesce(F.col("_first") == at, F.lit(True)).alias("_near"), by.alias("_by"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, edits: int = 1, into: str = "line_dedup", per: int = 0, most: int | None = None, least: int | None = None) -> DataFrame:
    """``docs`` with ``text`` without its removed lines, and a struct(n_lines, n_removed, n_near).

    Removed lines are listed per document (by position) and cut out as gaps between the rest,
    in linear time. A null text stays null, with no lines; an empty text is one empty line. A
    text that loses every line becomes empty. Other columns are untouched, whatever their names.
    """
    gone = removed_lines(docs, key, text, min_chars, edits, per, most, least)
    gone = gone.groupBy("_doc", "_hash").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"), F.count_distinct(F.when(F.col("_near"), F.col("_pos"))).alias("_near"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), last_id(key).alias("_doc"), F.xxhash64(text).alias("_hash"))
    both = base.join(gone, ["_doc", "_hash"], "left")
    old = F.col("_row").getField(text)
    lines = F.split(old, "\n")
    cuts = F.col("_gone")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1) + 1)
    stop = lambda i: F.coalesce(F.get(cuts, i), F.size(F.col("_lines")))
    both = both.withColumn("_lines", lines)
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.slice(F.col("_lines"), begin(i) + 1, F.greatest(stop(i) - begin(i), F.lit(0)))))
    new = F.when(cuts.isNull(), old).otherwise(F.array_join(kept, "\n"))
    facts = F.struct(
        F.when(old.isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size(cuts), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"),
    )
    columns = [new.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return both.select(*columns, facts.alias(into))


__all__ = ["dedup_lines", "removed_lines"]
