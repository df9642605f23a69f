"""Secret scan: fixed patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of

#: Fixed patterns by kind, in the order that breaks ties of position. Group 2 of ``assign`` is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings for entropy, and what each must hold.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIXED = ("[0-9]", "[A-Za-z]")
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
#: Character classes, narrowest first, with the least entropy in bits that some window must reach.
CLASSES = (("^[0-9a-fA-F]+$", 2.9), ("^(?:[0-9a-z]+|[0-9A-Z]+)$", 3.5), ("^.*$", 3.75))
#: Allow list: identifiers, placeholders and test values that look random but are not secret.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[-_]?(?:key|token|secret)|x{6,}|0{8,}|12345678|abcdefgh",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
)
#: A candidate with a slash is a path, and allowed, if it matches none of these: a part of over 15 characters, a sign
#: of base 64, a capital within a part.
NOT_PATH = (r"[^/]{16,}", r"[+=]", r"[^/][A-Z]")
#: One with a hyphen or underscore is a name made of words and numbers, if it matches none of these.
NOT_NAME = (r"[+=/]", r"[0-9][A-Za-z]")

SPAN = "struct<start:int,rank:int,end:int,kind:string,match:string>"


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running_sums(numbers: Column, block: int = 128) -> Column:
    """The sum up to and with each number of an array: within blocks of it, and before each block."""

    def add(total: Column, x: Column) -> Column:
        return total + x

    def within(part: Column, before: Column) -> Column:
        return F.transform(part, lambda _, i: before + F.aggregate(F.slice(part, 1, i + 1), F.lit(0), add))

    def join(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), add))
        return _let(
            F.struct(parts.alias("p"), totals.alias("t")),
            lambda s: F.flatten(
                F.transform(s["p"], lambda p, i: within(p, F.aggregate(F.slice(s["t"], 1, i), F.lit(0), add)))
            ),
        )

    cut = lambda a: F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / block).cast("int")), lambda b: F.slice(a, b * block + 1, block))
    none = F.array().cast("array<int>")
    return _let(numbers, lambda a: F.when(F.size(a) == 0, none).otherwise(_let(cut(a), join)))


def spans(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """All matches as (start, rank, end, kind, match), in code points; with ``least``, by length of group 2.

    What stands between matches and the matches alternate, so that running sums of their lengths are
    the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), value.alias("value"))

    def place(parts: Column) -> Column:
        sizes = F.transform(parts, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
        placed = F.arrays_zip(parts.alias("part"), running_sums(sizes).alias("end"))
        kept = F.filter(placed, lambda x: x["part"]["match"].isNotNull() & (F.length(x["part"]["value"]) >= least))
        return F.transform(
            kept,
            lambda x: F.struct(
                (x["end"] - F.length(x["part"]["match"])).alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                x["end"].alias("end"),
                F.lit(kind).alias("kind"),
                x["part"]["match"].alias("match"),
            ),
        )

    return F.when(text.rlike(pattern), _let(parts, place)).otherwise(_none())


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def apart(candidates: Column, base: Column) -> Column:
    """The candidates, in order and apart from each other, that overlap no base span.

    A candidate meets as many base spans as start before its end, less those that end by its start. Both
    are running counts over one sorted array, so that no candidate is held against every span.
    """

    def counts(at: str, where: str, first: int) -> Column:
        """How many ``at`` of base spans there are before (``first``: or at) the ``where`` of each candidate."""
        marks = F.transform(base, lambda b: F.struct(b[at].alias("at"), F.lit(1 - first).alias("turn"), F.lit(1).alias("n")))
        asked = F.transform(candidates, lambda c: F.struct(c[where].alias("at"), F.lit(first).alias("turn"), F.lit(0).alias("n")))

        def count(both: Column) -> Column:
            sums = F.arrays_zip(both.alias("x"), running_sums(F.transform(both, lambda x: x["n"])).alias("sum"))
            return F.transform(F.filter(sums, lambda y: y["x"]["n"] == 0), lambda y: y["sum"])

        return _let(F.array_sort(F.concat(marks, asked)), count)

    both = F.arrays_zip(candidates.alias("c"), counts("start", "end", 0).alias("begun"), counts("end", "start", 1).alias("over"))
    free = F.transform(F.filter(both, lambda x: x["begun"] == x["over"]), lambda x: x["c"])
    return F.when((F.size(candidates) == 0) | (F.size(base) == 0), candidates).otherwise(free)


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any ``window`` characters in a row; 0 for shorter strings.

    The sum of c * log2(c) over character counts is carried along; each step changes the count of
    the character that enters and of the one that leaves. Counts have five bits each, twelve to a
    long, so that a step is the same work for any window; ``window`` may be 30 at most.
    """
    if not 0 < window <= 30:
        raise ValueError("window must be from 1 to 30")
    term = F.array(*[F.lit(0.0), *[F.lit(float(c)) * F.log2(F.lit(float(c))) for c in range(1, window + 2)]])
    alphabet, words = F.lit(ALPHABET), (len(ALPHABET) + 1 + 11) // 12
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(alphabet, c))
    unit = F.array(*[F.lit(1 << (5 * k)).cast("long") for k in range(12)])

    def step(s: Column, acc: Column, i: Column) -> Column:
        enters = F.get(s["codes"], i)
        leaves = F.when(i >= window, F.get(s["codes"], F.greatest(i - window, F.lit(0)))).otherwise(F.lit(-1))
        return _let(F.struct(enters.alias("in"), leaves.alias("out")), lambda c: changed(s, acc, i, c))

    def count(acc: Column, code: Column) -> Column:
        at = F.greatest(code, F.lit(0))
        return F.call_function("shiftright", F.get(acc["n"], F.floor(at / 12).cast("int")), (at % 12) * 5).bitwiseAND(F.lit(31)).cast("int")

    def changed(s: Column, acc: Column, i: Column, c: Column) -> Column:
        both = F.struct(count(acc, c["in"]).alias("a"), count(acc, c["out"]).alias("b"))
        return _let(both, lambda n: after(s, acc, i, c, n))

    def after(s: Column, acc: Column, i: Column, c: Column, n: Column) -> Column:
        gain = F.get(s["terms"], n["a"] + 1) - F.get(s["terms"], n["a"])
        loss = F.when(c["out"] >= 0, F.get(s["terms"], F.greatest(n["b"] - 1, F.lit(0))) - F.get(s["terms"], n["b"])).otherwise(0.0)
        total = acc["sum"] + F.when(c["in"] == c["out"], 0.0).otherwise(gain + loss)
        counts = F.transform(
            acc["n"],
            lambda x, k: x
            + F.when(k == F.floor(c["in"] / 12), F.get(s["unit"], c["in"] % 12)).otherwise(0)
            - F.when((c["out"] >= 0) & (k == F.floor(c["out"] / 12)), F.get(s["unit"], F.greatest(c["out"], F.lit(0)) % 12)).otherwise(0),
        )
        bits = F.when(i >= window - 1, F.log2(F.lit(float(window))) - total / window).otherwise(0.0)
        return F.struct(counts.alias("n"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"))

    def walk(s: Column) -> Column:
        zero = F.array_repeat(F.lit(0).cast("long"), words)
        first = F.struct(zero.alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        at = F.sequence(F.lit(0), F.size(s["codes"]) - 1)
        return F.aggregate(at, first, lambda acc, i: step(s, acc, i), lambda acc: acc["best"])

    return _let(F.struct(codes.alias("codes"), term.alias("terms"), unit.alias("unit")), walk)


def _random(span: Column) -> Column:
    """Whether a candidate looks random: not allowed, mixed, and with enough entropy for its class."""
    match = span["match"]
    path, name = match.contains("/"), match.rlike("[_-]")
    for pattern in NOT_PATH:
        path = path & ~match.rlike(pattern)
    for pattern in NOT_NAME:
        name = name & ~match.rlike(pattern)
    allowed = path | name
    for pattern in ALLOWED:
        allowed = allowed | match.rlike(pattern)
    least = F.lit(0.0)
    for pattern, bits in reversed(CLASSES):
        least = F.when(match.rlike(pattern), bits).otherwise(least)
    mixed = match.rlike(MIXED[0]) & match.rlike(MIXED[1])
    return F.when(mixed & ~allowed, window_entropy(match) >= least).otherwise(False)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find secrets in every whole text: doc_id, text and two arrays of spans, ``base`` and ``added``.

    ``base`` has the matches of the fixed patterns, leftmost and non-overlapping for each kind, by start and
    then kind. ``added`` has candidate strings of which some window of WINDOW characters has the
    entropy of random text of its character class, that no allow-list pattern suppresses, and that
    overlap no base span. A span has start, rank, end (exclusive, code points), kind and match.

    One pass without a shuffle. Null text counts as empty and gets empty arrays. Ids may be null or
    repeat: there is a row for every input row. Texts, tokens and the number of matches may be of any length:
    no pattern repeats a group, and positions are running sums. Other columns are not read.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    text = F.col("text")
    base = rows.withColumns({
        "_assign": spans(text, ASSIGN, "assign", 6),
        "_access": spans(text, ACCESS, "access"),
        "_hex": spans(text, HEX, "hex"),
        "_entropy": F.filter(spans(text, CANDIDATE, "entropy"), _random),
    }).withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    return base.select("doc_id", "text", "base", apart(F.col("_entropy"), F.col("base")).alias("added"))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans, for each row of ``docs``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secret_spans(docs, id_col, text_col).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.size("added").cast("long").alias("n_entropy"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
