"""Line deduplication by a segment-partition edit join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small, text_of, written
from tessera.llm.graph import components

#: Dropped line numbers that are broadcast at most; with more the texts are shuffled to them.
BROADCAST_LINES = 1_000_000

#: Production: the least length of a line whose exact copies are dropped.
EXACT_CHARS = 1

#: Production: (least characters, edits) of the shorter of two near lines: one edit for each 20 characters, up to 3.
LENGTH_EDITS = ((32, 1), (40, 2), (60, 3))

#: Offsets whose differences are all numbers up to the key.
RULERS = {0: (0,), 1: (0, 1), 2: (0, 1, 2), 3: (0, 1, 3)}

#: Longer lines than this are not linked by deletions, as each emits a row for every character.
DELETION_CHARS = 2_000

#: A band of lengths ends at this multiple of its least length; the last one begins below LAST_BAND.
BAND_GROWTH, LAST_BAND = 1.5, 100_000


def segment_keys(line: Column, threshold: int) -> Column:
    """An array of (key, indexed, probes) of a line for the edit join.

    A line of length n is cut into ``threshold`` + 1 segments, as even as can be. If two lines are
    within ``threshold`` edits, one segment of the shorter (length l) stands unchanged in the
    longer, and not far from its own place: at segment i (from 1) shifted by at most i - 1 from the
    left end, and by at most threshold + 1 - i from the right end. A key is a hash of l, i and the
    segment. A line is indexed by its own segments and probes with its substrings for all l.
    """
    n, parts, keys = F.length(line), threshold + 1, []
    for delta in range(parts):
        size = n - delta
        for i in range(1, parts + 1):
            even, long_from = F.floor(size / parts).cast("int"), parts - size % parts  # the last ones are longer
            start = 1 + even * (i - 1) + F.greatest(F.lit(0), F.lit(i - 1) - long_from)
            length = even + F.when(F.lit(i) > long_from, 1).otherwise(0)
            for shift in range(max(1 - i, delta - parts + i), min(i - 1, delta + parts - i) + 1):
                own = delta == 0 and shift == 0
                key = F.xxhash64(size, F.lit(i), F.substring(line, start + shift, length))
                keys.append(F.struct(key.alias("key"), F.lit(own).alias("indexed")))
    return F.array(*keys)


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two strings if it is at most ``threshold``, else a larger number.

    Bit-parallel, within a band of 2 * threshold + 1 diagonals: in each column, one bit vector
    holds where the distance rises by one from row to row and one where it falls.
    """
    both = F.struct(F.split(a, "").alias("rows"), F.split(b, "").alias("columns"), F.length(a).alias("m"), F.length(b).alias("n"))
    return _let(both, lambda s: _walk(s["rows"], s["columns"], s["m"], s["n"], threshold))


def _walk(rows: Column, columns: Column, m: Column, n: Column, threshold: int) -> Column:
    width = 2 * threshold + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)

    def step(acc: Column, j: Column) -> Column:
        char = F.get(columns, j)
        match = F.lit(0)
        for k in range(width):  # the row at bit k; none matches before the first and after the last
            row = j + (k - threshold)
            same = (row >= 0) & F.coalesce(F.get(rows, F.greatest(row, F.lit(0))) == char, F.lit(False))
            match = match + F.when(same, 1 << k).otherwise(0)
        state = F.struct(
            match.alias("x"),
            F.shiftright(acc["up"], 1).bitwiseOR(F.lit(top)).alias("up"),
            F.shiftright(acc["down"], 1).alias("down"),
            acc["d"].alias("d"),
        )
        zero = _let(
            state,
            lambda s: F.struct(
                s["up"].alias("up"),
                s["down"].alias("down"),
                s["d"].alias("d"),
                (s["x"].bitwiseAND(s["up"]) + s["up"])
                .bitwiseXOR(s["up"])
                .bitwiseOR(s["x"])
                .bitwiseOR(s["down"])
                .bitwiseAND(F.lit(mask))
                .alias("zero"),
            ),
        )
        right = _let(
            zero,
            lambda s: F.struct(
                s["zero"].alias("zero"),
                s["d"].alias("d"),
                F.shiftleft(s["down"].bitwiseOR(F.bitwise_not(s["zero"].bitwiseOR(s["up"]))), 1)
                .bitwiseOR(F.lit(1))
                .bitwiseAND(F.lit(mask))
                .alias("plus"),
                F.shiftleft(s["zero"].bitwiseAND(s["up"]), 1).bitwiseAND(F.lit(mask)).alias("minus"),
            ),
        )
        return _let(
            right,
            lambda s: F.struct(
                s["minus"].bitwiseOR(F.bitwise_not(s["zero"].bitwiseOR(s["plus"])).bitwiseAND(F.lit(mask))).alias("up"),
                s["zero"].bitwiseAND(s["plus"]).alias("down"),
                (s["d"] + F.when(s["zero"].bitwiseAND(F.lit(1 << threshold)) == 0, 1).otherwise(0)).alias("d"),
            ),
        )

    def finish(acc: Column) -> Column:  # from the main diagonal to the last row
        out = acc["d"]
        for k in range(1, threshold + 1):
            for sign in (1, -1):
                bit = F.lit(1 << (threshold + k if sign > 0 else threshold - k + 1))
                delta = F.when(acc["up"].bitwiseAND(bit) != 0, 1).when(acc["down"].bitwiseAND(bit) != 0, -1).otherwise(0)
                out = out + F.when(sign * (m - n) >= k, sign * delta).otherwise(0)
        return out

    rising = F.lit(mask - (1 << (threshold + 1)) + 1)
    first = F.struct(rising.alias("up"), F.lit(0).alias("down"), F.lit(0).alias("d"))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    walked = F.aggregate(at, first, step, finish)
    return F.when(F.abs(m - n) > threshold, threshold + 1).otherwise(walked)


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def near_lines(lines: DataFrame, threshold: int = 1, crowd: int = 50) -> DataFrame:
    """Links ``a``, ``b`` between ``lid`` of distinct ``line``s that connect the same lines as all close pairs do.

    Lines that share a segment key are compared pair by pair. At ``threshold`` 1, lines of a key that
    more than ``crowd`` lines share are linked otherwise, without pairs and as exact: each line
    meets the others by what is left when one character is deleted. Lines equal but for the
    character at one place are all within one edit, and link to the smallest; a line that equals
    another but for one extra character links to that one. At other thresholds all pairs are compared.
    """
    keyed = lines.select("lid", F.explode(segment_keys(F.col("line"), threshold)).alias("k")).select("lid", "k.*")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("indexed").alias("m")).where("n > 1 and m > 0")
    shared = written(keyed.join(sizes.drop("m"), "key"), "line-keys")
    lids = written(shared.select("lid").distinct(), "line-ids")
    near = written(lines.join(F.broadcast(lids) if small(lids) else lids, "lid").select("lid", "line"), "near-lines")
    few = shared.where(F.col("n") <= crowd) if threshold == 1 else shared
    pairs = (
        few.where("indexed")
        .select("key", F.col("lid").alias("a"))
        .join(few.select("key", F.col("lid").alias("b")), "key")
        .where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    if threshold == 1:
        crowded = shared.where(F.col("n") > crowd).select("lid").distinct()
        pairs = pairs.unionByName(_deletion_links(near.join(crowded, "lid", "left_semi")))
    return (
        pairs.distinct()
        .join(near.select(F.col("lid").alias("a"), F.col("line").alias("left")), "a")
        .join(near.select(F.col("lid").alias("b"), F.col("line").alias("right")), "b")
        .where(banded_distance(F.col("left"), F.col("right"), threshold) <= threshold)
        .select("a", "b")
    )


def _deletion_links(lines: DataFrame) -> DataFrame:
    n = F.length("line")
    cut = lines.select("lid", "line", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("at")).select(
        "lid", "n", "at", F.expr("xxhash64(concat(substring(line, 1, at - 1), substring(line, at + 1)))").alias("rest")
    )
    swapped = (
        cut.join(cut.groupBy("n", "at", "rest").agg(F.min("lid").alias("b"), F.count("*").alias("c")).where("c > 1"), ["n", "at", "rest"])
        .where("lid <> b")
        .select("lid", "b")
    )
    whole = lines.select(F.col("lid").alias("b"), (n + 1).alias("n"), F.xxhash64("line").alias("rest"))
    longer = cut.join(whole, ["n", "rest"]).select("lid", "b")
    return swapped.unionByName(longer).select(F.least("lid", "b").alias("a"), F.greatest("lid", "b").alias("b"))


def _bands(edits) -> list[tuple[int, int]]:
    """(least length, edits) of all bands of lengths."""
    bands = list(edits)
    while (low := int(bands[-1][0] * BAND_GROWTH)) < LAST_BAND:
        bands.append((low, bands[-1][1]))
    if any(t not in RULERS or low // (t + 1) <= max(RULERS[t]) for low, t in bands):
        raise ValueError(f"no band for {edits}")
    return bands


def chunk_keys(line: Column, low: Column, threshold: int, parts: int) -> Column:
    """An array of (part, key) of a line in the band of least length ``low``, the same for both lines of a pair.

    ``line`` has four bytes for each character (``wide``), so that a chunk is reached without counting characters up to it.

    The first ``low`` characters are cut into ``parts`` chunks of one size. A chunk of one line that no edit
    touches stands in the other line, shifted by at most ``threshold``. If there is one chunk more than
    edits, an untouched one has as many edits before it as chunks, so that chunk i (from 1) need only be
    looked for up to i - 1 away. Both lines give the hashes of the chunk at the offsets of a ruler:
    for any shift within reach, two of them differ by it.
    """
    size, keys = F.floor(low / parts).cast("int"), []
    for i in range(parts):
        ruler = RULERS[min(i, threshold) if parts == threshold + 1 else threshold]
        for x in ruler:
            key = F.xxhash64(low, F.lit(parts), F.lit(i), F.substring(line, 4 * (size * i + x) + 1, 4 * (size - max(ruler))))
            keys.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
    return F.array(*keys)


def wide(line: Column) -> Column:
    """The text with four bytes for each character."""
    return F.encode(line, "UTF-32")


#: Characters are counted by their code modulo CLASSES; a number has four bits for each class of one SIDE, the highest unused, as sums must not overflow.
CLASSES, SIDE = 30, 15


def with_counts(lines: DataFrame) -> DataFrame:
    """Add ``c1`` and ``c2``, how often characters of CLASSES classes stand in ``line``, modulo 8: an edit changes two bits at most.

    A count has the bits 0000, 0001, 0011, 0111, 1111, 1110, 1100, 1000: as many differ as two counts are apart around the circle.
    """
    nibbles = lambda bits: sum(bits << (4 * i) for i in range(SIDE))

    def circle(classes: Column, side: int) -> Column:
        own = F.filter(classes, lambda c: c >= SIDE if side else c < SIDE)
        one = lambda acc, c: (acc + F.call_function("shiftleft", F.lit(1).cast("long"), 4 * (c - side * SIDE))).bitwiseAND(F.lit(nibbles(7)))
        # bit k is the highest of the count plus 3 - k
        high = lambda n, k: F.shiftright((n + F.lit(nibbles(3 - k))).bitwiseAND(F.lit(nibbles(4))), 2)
        return _let(F.aggregate(own, F.lit(0).cast("long"), one), lambda n: sum((F.shiftleft(high(n, k), k) for k in range(1, 4)), high(n, 0)))

    classes = F.transform(F.split("line", ""), lambda c: F.ascii(c) % CLASSES)
    both = _let(classes, lambda c: F.struct(*[circle(c, side).alias(f"c{side + 1}") for side in (0, 1)]))
    # exploded, so that the classes are found once
    return lines.select("lid", "line", F.explode(F.array(both)).alias("c")).select("lid", "line", "c.*")


def count_keys(key: Column, changes: int) -> Column:
    """An array of keys of a row of ``key``, ``c1`` and ``c2``: two rows that differ in at most so many counts have one in common.

    The classes are dealt into one group more than that; a key is a hash of the counts of one group.
    """
    groups, keys = changes + 1, []
    for g in range(groups):
        masks = [sum(0b1111 << (4 * (c % SIDE)) for c in range(g, CLASSES, groups) if c // SIDE == side) for side in (0, 1)]
        own = [F.col(name).bitwiseAND(F.lit(mask).cast("long")) for name, mask in zip(("c1", "c2"), masks, strict=True)]
        keys.append(F.xxhash64(key, F.lit(g), *own))
    return F.array(*keys)


#: Of two rows, what ``t`` edits can't part: lengths, and counts of characters.
ALIKE = "abs(chars - _chars) <= {t} and bit_count(c1 ^ _c1) + bit_count(c2 ^ _c2) <= 2 * {t}"


def _pairs(keyed: DataFrame, edits: int) -> DataFrame:
    """All ``a`` < ``b`` of the ``lid`` that share a ``key`` and are ALIKE for so many edits."""
    right = keyed.select("key", F.col("lid").alias("b"), *[F.col(c).alias(f"_{c}") for c in ("chars", "c1", "c2")])
    left = keyed.select("key", F.col("lid").alias("a"), "chars", "c1", "c2")
    return left.join(right, "key").where(f"a < b and {ALIKE.format(t=edits)}").select("a", "b")


def near_by_length(lines: DataFrame, edits=LENGTH_EDITS, crowd: int = 50) -> DataFrame:
    """Links ``a``, ``b`` between ``lid`` of distinct ``line``s within the edits that ``edits`` allows the shorter one.

    ``edits`` has (least length, edits) ascending; lines below the first length are not compared. Lines
    meet in bands of lengths; one that is little longer than a band enters that band too. In each, lines
    that share one of t + 1 chunks are compared pair by pair, unless more than ``crowd`` share it. The lines
    of such crowded chunks are cut finer: of these chunks, t at most are touched, so that a line with
    t + 1 fine chunks that are not crowded meets all its neighbours there. Lines with fewer, which differ
    from the crowd in next to nothing, such as those with a running number, are first linked where one edit parts them,
    without pairs (``_deletion_links``); those that this leaves in different classes meet within their crowded chunk where a group
    of character counts is equal (``count_keys``). All pairs are ALIKE before their texts are compared. No class of linked lines is split.
    """
    bands, n = _bands(edits), F.col("n")
    own, lower, allowed = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (low, t) in enumerate(bands):
        own, allowed = F.when(n >= low, low).otherwise(own), F.when(n >= low, t).otherwise(allowed)
        if i:
            before, reach = bands[i - 1]
            lower = F.when(n >= low, F.when(n < low + reach, before)).otherwise(lower)
    # exploded, so that the length is counted once and not in every comparison
    sized = lines.select("lid", F.explode(F.array(F.struct(wide(F.col("line")).alias("wide"), F.length("line").alias("n")))).alias("s")).select("lid", "s.*")
    banded = sized.select("lid", "wide", F.col("n").alias("chars"), F.explode(F.array_compact(F.array(own, lower))).alias("low"))
    edits_of = {t: [low for low, e in bands if e == t] for _, t in bands}
    most = max(edits_of)

    def keyed_by(rows: DataFrame, parts) -> DataFrame:
        """Keys of rows of lid, wide, chars and low, by ``parts`` of (edits, least length of the band) chunks, in one pass."""
        keys = F.lit(None)
        for t, k in sorted({(t, parts(t, low)) for low, t in bands}):
            lows = [low for low in edits_of[t] if parts(t, low) == k]
            here = F.col("low").between(lows[0], lows[-1])
            keys = F.when(here, chunk_keys(F.col("wide"), F.col("low"), t, k)).otherwise(keys)
        return rows.select("lid", "chars", "low", F.explode(keys).alias("k")).select("lid", "chars", "low", "k.*")

    keyed = keyed_by(banded, lambda t, low: t + 1).select("lid", "chars", "low", "key")
    # counted where the keys are, so that they are made and shuffled once
    shared = written(keyed.withColumn("n", F.expr("count(*) over (partition by key)")).where("n > 1"), "line-keys")
    lids = written(shared.select("lid").distinct(), "line-ids")
    near = written(lines.join(F.broadcast(lids) if small(lids) else lids, "lid").transform(with_counts), "near-lines")
    counts = near.select("lid", "c1", "c2")
    counts = F.broadcast(counts) if small(near) else counts

    many = shared.where(F.col("n") > crowd)
    pairs = _pairs(shared.where(F.col("n") <= crowd).join(counts, "lid"), most)
    crowded = written(many.select("lid", "chars", "low").distinct().join(near.select("lid", wide(F.col("line")).alias("wide")), "lid"), "crowded-lines")
    if not crowded.isEmpty():
        fine = written(keyed_by(crowded, lambda t, low: (2 if low < 180 else 6) * (t + 1)), "fine-keys")
        # crowded keys are counted and taken out: no join gives a row for each key of a crowded chunk
        hot = written(fine.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "crowded-keys")
        sparse = written(fine.join(F.broadcast(hot) if small(hot) else hot, "key", "left_anti"), "sparse-keys")
        at, ruler = F.lit(None).cast("int"), F.lit(None).cast("int")
        for low, t in bands:
            at, ruler = F.when(F.col("low") >= low, t).otherwise(at), F.when(F.col("low") >= low, len(RULERS[t])).otherwise(ruler)
        free = (
            sparse.groupBy("lid", "low", "part")
            .agg(F.count("*").alias("n"))
            .where(F.col("n") == ruler)
            .groupBy("lid", "low")
            .agg(F.collect_set("part").alias("free"))
        )
        hard = (
            crowded.select("lid", "chars", "low", at.alias("t"))
            .join(free, ["lid", "low"], "left")
            .withColumn("free", F.coalesce("free", F.array().cast("array<int>")))
            .where("size(free) <= t")
        )
        pairs = pairs.unionByName(_pairs(sparse.join(counts, "lid"), most))
        same = written(many.select("key", "lid", "low").join(hard, ["lid", "low"]).join(counts, "lid"), "hard-lines")
        if not same.isEmpty():
            own = near.join(same.select("lid").distinct(), "lid", "left_semi").where(F.length("line") <= DELETION_CHARS)
            one = written(_deletion_links(own), "one-edit-links")
            classes = components(one).withColumnRenamed("node", "lid")
            same = same.join(classes, "lid", "left").withColumn("component", F.coalesce("component", "lid"))
            apart = same.groupBy("key").agg(F.min("component").alias("_min"), F.max("component").alias("_max")).where("_min <> _max").select("key")
            same = written(same.join(apart, "key", "left_semi"), "hard-classes")
            met = same.withColumn("key", F.explode(count_keys(F.col("key"), 2 * most)))
            names = ("component", "free", "chars", "c1", "c2")
            right = met.select("key", F.col("lid").alias("b"), *[F.col(c).alias(f"_{c}") for c in names])
            left = met.select("key", F.col("lid").alias("a"), *names, "t")
            # an edit touches one chunk: a free one that none touches has made the pair meet already
            near_by = f"a < b and component <> _component and {ALIKE.format(t='t')} and size(array_union(free, _free)) <= t"
            pairs = pairs.unionByName(left.join(right, "key").where(near_by).select("a", "b")).unionByName(one)
    sides = (
        pairs.distinct()
        .join(near.select(F.col("lid").alias("a"), F.col("line").alias("left")), "a")
        .join(near.select(F.col("lid").alias("b"), F.col("line").alias("right")), "b")
        .withColumn("n", F.least(F.length("left"), F.length("right")))
    )
    # the built-in distance is compiled, and leaves few pairs to the expression
    close = F.when(F.levenshtein("left", "right", most) >= 0, banded_distance(F.col("left"), F.col("right"), most))
    return sides.where(close <= allowed).select("a", "b")


def repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int | tuple = 1,
    least_chars: int = 32,
    exact_chars: int | None = None,
) -> DataFrame:
    """doc_id and ``drop``, the numbers (from 0) of its lines that repeat an earlier line."""
    digest, compared = F.unhex(F.md5("line")), F.length("line") >= least_chars
    lines = (
        docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_of(text_col), "\n")).alias("line_no", "line"))
        .where("doc_id is not null")
        .withColumn("line", F.trim("line"))
        .where(F.length("line") >= max(1, least_chars if exact_chars is None else min(exact_chars, least_chars)))
        .withColumn("digest", digest)
    )
    distinct = written(
        lines.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"), F.first(F.when(compared, F.col("line"))).alias("line"))
        .withColumn("lid", F.monotonically_increasing_id()),
        "lines",
    )
    compared = distinct.where("line is not null").select("lid", "line")
    if isinstance(threshold, int) and least_chars // (threshold + 1) > max(RULERS.get(threshold, (least_chars,))):
        threshold = ((least_chars, threshold),)
    classes = components(near_lines(compared, threshold) if isinstance(threshold, int) else near_by_length(compared, threshold))
    linked = distinct.select("lid", "digest", "first", "n").join(
        classes.select(F.col("node").alias("lid"), "component"), "lid", "left"
    )
    firsts = linked.where("component is not null").groupBy("component").agg(F.min("first").alias("best"))
    repeated = written(
        linked.where("n > 1 or component is not null")
        .join(firsts, "component", "left")
        .select("digest", F.coalesce("best", "first").alias("best")),
        "repeated-lines",
    )
    return (
        lines.select("doc_id", "line_no", "digest")
        .join(F.broadcast(repeated) if small(repeated) else repeated, "digest")
        .where("best.doc_id <> doc_id or best.line_no <> line_no")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("line_no")).alias("drop"))
    )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int | tuple = 1,
    least_chars: int = 32,
    exact_chars: int | None = None,
) -> DataFrame:
    """Drop lines that are equal to an earlier line of the corpus, or within ``threshold`` edits of one.

    ``threshold`` may grow with the length, as (least characters, edits) in ascending order; then the shorter of
    two lines decides. The registered query and the pipeline use LENGTH_EDITS.

    Lines are what newlines separate, without spaces at either end; the first line of each class
    of linked lines, by smallest id and line number, stays. Lines below ``least_chars`` characters
    are not compared by edits, as short ones are too easily confused. Exact copies are dropped from
    ``exact_chars`` characters on, ``least_chars`` if that is None; the registered query and the
    pipeline drop them at any length (EXACT_CHARS). Empty lines always stay. Exact copies are collapsed by
    digest before the edit join, so that a line with any number of copies is one row there. Lines are compared by
    ``near_by_length``, but if ``least_chars`` is too short for its bands, by ``near_lines``.

    The numbers of dropped lines are joined to the documents: broadcast up to BROADCAST_LINES of them, beyond that by a
    shuffle of the texts, once.

    Null text counts as empty, and empty text has one empty line. Lines of rows with a null id stay
    and don't count as earlier lines. Rows that repeat an id are treated as one document. An empty
    table gives an empty result.

    Returns all columns of ``docs`` with the text rewritten, and n_lines and n_dropped (replaced, where
    ``docs`` has columns of those names).
    """
    drops = written(repeated_lines(docs, id_col, text_col, threshold, least_chars, exact_chars), "dropped-lines")
    dropped = drops.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()[0]
    if dropped <= BROADCAST_LINES:
        drops = F.broadcast(drops)
    # the row is a struct, so that no column of it can clash
    rows = docs.select(F.struct(*[_quoted(c) for c in docs.columns]).alias("row"))
    joined = rows.join(drops, F.col("row")[id_col] == drops["doc_id"], "left")
    own, none = F.col("row")[text_col], F.array().cast("array<int>")
    lines = F.split(F.coalesce(own.cast("string"), F.lit("")), "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.coalesce("drop", none), i))
    text = F.when(F.col("drop").isNull(), own).otherwise(F.array_join(kept, "\n"))
    new = {text_col: text, "n_lines": F.size(lines), "n_dropped": F.coalesce(F.array_size("drop"), F.lit(0))}
    names = [*docs.columns, *[n for n in new if n not in docs.columns]]
    return joined.select(*[new.get(n, F.col("row")[n]).alias(n) for n in names])


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"
