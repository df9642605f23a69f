"""Value rules, record splitting, ordered state and streams, on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import maths, regex, strings, times, values
from tessera.operators import folds, lookups
from tessera.operators.rules import Like, Rule, switch_bodies
from tessera.plans import ordered
from tessera.sources import records, sinks
from tessera.streaming import rules as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("3.14abc", 3.14), ("0x10", 0.0), ("+inf", float("inf")), ("inf", 0.0), ("", 0.0), (" 12 ", 12.0), ("-.5e2x", -50.0), (".", 0.0), ("1e", 1.0)],
)
def test_numeric_prefix(spark, text, want):
    assert one(spark, values.num(F.lit(text))) == want


@pytest.mark.parametrize(
    ("number", "want"),
    [(1e6, "1000000"), (0.1 + 0.2, "0.3"), (-0.0, "0"), (1e300 * 1e300, "+inf"), (3.14159265, "3.14159"), (1234567.8, "1.23457e+06"),
     (0.00001234, "1.234e-05"), (999999.9, "1e+06"), (-2.5, "-2.5"), (100.0, "100")],
)
def test_text_of_number(spark, number, want):
    assert one(spark, values.text(F.lit(number))) == want


def test_comparison_by_kind(spark):
    ten, nine = F.lit("10"), F.lit(9.0)
    assert one(spark, values.compare(ten, "<", nine, "string", "number"))
    assert not one(spark, values.compare(ten, "<", nine, "input", "number"))
    unset = F.lit(None).cast("string")
    assert one(spark, values.compare(unset, "==", F.lit(0.0), "input", "number"))
    assert one(spark, values.compare(unset, "==", F.lit(""), "input", "string"))
    assert not one(spark, values.compare(F.lit(float("nan")), "==", F.lit(float("nan")), "number", "number"))
    assert not one(spark, values.truthy(F.lit("0.0")))
    assert one(spark, values.truthy(F.lit("0.0"), "string"))


def test_text_functions(spark):
    hello, abc = F.lit("hello"), F.lit("abc")
    assert one(spark, strings.substr(hello, 0, 2)) == one(spark, strings.substr(hello, -1, 2)) == "he"
    assert one(spark, strings.index(abc, "")) == 1
    assert one(spark, strings.pieces(F.lit(""))) == []
    assert one(spark, strings.pieces(F.lit("a.b"), ".")) == ["a", "b"]
    assert len(one(spark, strings.pieces(F.lit("  a  b  "), "[ ]"))) == 7
    assert one(spark, strings.gsub(abc, "", "-")) == "-a-b-c-"
    assert one(spark, strings.gensub(abc, "(.)", r"[\1]")) == "[a][b][c]"
    assert one(spark, strings.gensub(F.lit("a1b2c3"), "([a-z])([0-9])", r"\2\1", 2)) == "a12bc3"
    assert one(spark, strings.sub(F.lit("aaa"), "a", r"[&\&]")) == "[a&]aa"
    assert one(spark, strings.formatted("%c|%d|%x|%%", F.lit(65), F.lit(3.9), F.lit(-3))) == "A|3|fffffffffffffffd|%"
    assert [one(spark, strings.ordinal(F.lit(c))) for c in ("A", "é", "😀", "")] == [65, 233, 128512, 0]
    assert one(spark, strings.character(F.lit(300))) == "Ĭ"
    assert [one(spark, strings.strtonum(F.lit(t))) for t in ("0x1F", "017", "12ab")] == [31.0, 15.0, 12.0]
    assert one(spark, strings.match(F.lit("foobar"), "o+")).asDict() == {"start": 2, "length": 2}
    assert one(spark, strings.match(F.lit("foobar"), "z")).asDict() == {"start": 0, "length": -1}


def test_patterns():
    assert regex.java("[[:digit:]]+\\.") == r"(?s)[0-9]+\."
    assert regex.java("[]a]") == r"(?s)[\]a]"
    assert regex.java(r"\d") == "(?s)d"
    assert regex.is_literal("abc") and not regex.is_literal("a.c")
    with pytest.raises(ValueError, match="unmatched"):
        regex.java("[a")


def test_numbers_and_times(spark):
    assert one(spark, maths.truncated(F.lit(-2.7))) == -2.0
    assert one(spark, maths.log(F.lit(0.0))) == float("-inf")
    assert one(spark, maths.intdiv0(F.lit(7), F.lit(0))) == 0
    assert one(spark, maths.shift_left(F.lit(1), 70)) == 64
    with pytest.raises(Exception, match="negative"):
        one(spark, maths.complement(F.lit(-1)))
    with pytest.raises(Exception, match="ZERO"):
        one(spark, maths.modulo(F.lit(1), F.lit(0)))
    assert one(spark, times.mktime(F.lit("2024 02 30 0 0 0"))) == -1
    assert one(spark, times.mktime(F.lit("2024 02 29 0 0 1"))) == 1709164801
    assert one(spark, times.strftime("%Y-%m-%d %e|%u|%%", F.lit(1709164801))) == "2024-02-29 29|4|%"


def test_record_splitting(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a b\r\nc\n\n \nd e\nf")
    got = records.read_records(spark, str(tmp_path)).orderBy("pos")
    assert [r["record"] for r in got.collect()] == ["a b\r", "c", "", " ", "d e", "f"]
    assert [r["record"] for r in records.read_records(spark, str(tmp_path), "").orderBy("pos").collect()] == ["a b\r\nc", "d e\nf"]
    assert [r["record"] for r in records.read_records(spark, str(tmp_path), "[ \n]+").orderBy("pos").collect()] == ["a", "b\r", "c", "d", "e", "f"]
    assert one(spark, records.fields(F.lit(" a \r b\t"))) == ["a", "b"]
    assert one(spark, records.fields(F.lit(""), ":")) == []
    assert one(spark, records.fields(F.lit("a:b::"), ":")) == ["a", "b", "", ""]
    assert one(spark, records.fields(F.lit("a:b\nc"), ":", paragraph=True)) == ["a", "b", "c"]
    assert one(spark, records.csv_fields(F.lit(',a,"b, ""c""",'))) == ["", "a", 'b, "c"', ""]
    assert one(spark, records.fields_by_width(F.lit("abcdefgh"), "2 1:3 *")) == ["ab", "def", "gh"]
    assert one(spark, records.with_field(F.array(F.lit("a")), 3, F.lit("z"))) == ["a", "", "z"]


def test_output(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "x"), (2, 3.0, None)], "n int, v double, k string")
    lines = df.withColumn("line", sinks.printed(df, ["n", "v", "k"], ":"))
    assert [r["line"] for r in lines.orderBy("n").collect()] == ["1:0.5:x", "2:3:"]
    sinks.write_lines(lines, "line", str(tmp_path / "all"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "all")).collect()) == ["1:0.5:x", "2:3:"]
    sinks.redirect(lines, "line", "n", str(tmp_path / "by"), salts=2)
    assert spark.read.text(str(tmp_path / "by")).where("n = 2").first()["value"] == "2:3:"


@pytest.mark.parametrize("ranges", [1, 7])
def test_ordered_state(spark, ranges):
    rows = [(i, (i * 7) % 11) for i in range(100)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(5)
    total, seen, open_, span = 0, None, False, []
    want = {}
    for i, v in rows:
        total += v
        want[i] = (i + 1, total, seen)
        if v > 8:
            seen = v
        if not open_ and v == 3:
            open_ = True
        if open_:
            span.append(i)
            open_ = v != 5
    got = ordered.running(ordered.numbered(df, "i", "nr", ranges), "i", "total", "v", ranges=ranges)
    got = ordered.latched(got, "i", "seen", "v", "v > 8", before=True, ranges=ranges)
    assert {r["i"]: (r["nr"], r["total"], r["seen"]) for r in got.collect()} == want
    assert sorted(r["i"] for r in ordered.between(df, "i", "v = 3", "v = 5", ranges).collect()) == span
    empty = df.where("false")
    assert ordered.numbered(empty, "i").count() == ordered.between(empty, "i", "true", "true").count() == 0


def test_streams(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 as k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k long").parquet(str(tmp_path / "in"))
    lines = streams.stream_lines(stream, [Rule(F.col("k") == 0, F.lit("zero"), stop=True), Rule(None, F.lit("other"))], ["id"])
    counts = streams.stream_fold(stream, ["k"], n=F.count("*"))
    for name, df, mode in (("lines", lines, "append"), ("counts", counts, "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("lines").where("out = 'zero'").count() == 4
    assert {r["k"]: r["n"] for r in spark.table("counts").collect()} == {0: 4, 1: 3, 2: 3}


def test_accumulators(spark):
    df = spark.createDataFrame([("a", -2.0), ("a", 3.0), ("b", 0.0)], "k string, v double")
    got = {r["k"]: round(r["p"], 9) for r in folds.fold(df, ["k"], p=folds.product(F.col("v"))).collect()}
    assert got == {"a": -6.0, "b": 0.0}


@pytest.mark.parametrize(
    ("template", "args", "want"),
    [
        ("%5.3d|%-6i|%.2f", (-7, 42.9, 2.5), " -007|42    |2.50"),
        ("%u|%X|%o", (-1, 255, 8), "18446744073709551615|FF|10"),
        ("%c%c|%s|%.2s", (65, "xyz", 0.1, "abc"), "Ax|0.1|ab"),
        ("%g|%g|%.3g|%G|%g", (1e6, 0.0, 1234.5, 1e-5, 100000.0), "1e+06|0|1.23e+03|1E-05|100000"),
        ("%2$s %1$s|%q|100%", ("a", "b"), "b a|%q|100%"),
        ("%'d|%*d|%-*d|", (1234567, 4, 7, 3, 8), "1,234,567|   7|8  |"),
    ],
)
def test_printf(spark, template, args, want):
    assert one(spark, strings.formatted(template, *args)) == want


def test_more_text_and_times(spark):
    assert one(spark, strings.match_groups(F.lit("ab12"), "([a-z]+)([0-9]+)", 2)) == ["ab12", "ab", "12"]
    assert one(spark, strings.match_groups(F.lit("-"), "([a-z])", 1)) == []
    assert one(spark, strings.between_found(F.lit(" a, b;c "), "[a-z]")) == [", ", ";"]
    at = F.lit(1709164801)  # a Thursday
    assert one(spark, times.strftime("%C %k %l %G-%V %U %W %r", at)) == "20  0 12 2024-09 08 09 12:00:01 AM"
    assert one(spark, times.strftime(times.DEFAULT, at, utc=True)) == "Thu Feb 29 00:00:01 UTC 2024"


@pytest.mark.parametrize("ranges", [1, 7])
def test_state_by_key(spark, ranges):
    rows = [(i * i % 997, (None, "a", "b")[i % 3], i) for i in range(300)]
    df = spark.createDataFrame(rows, "t long, k string, i long").dropDuplicates(["k", "t"])
    want, last, count = {}, {}, {}
    for r in sorted(df.collect(), key=lambda r: r["t"]):
        if r["k"] not in last or r["t"] - last[r["k"]] > 9:
            count[r["k"]] = count.get(r["k"], 0) + 1
        last[r["k"]] = r["t"]
        want[r["k"], r["t"]] = count[r["k"]]
    got = ordered.sessions(df, ["k"], "t", 9, ranges=ranges).collect()
    assert {(r["k"], r["t"]): r["session"] for r in got} == want and len(got) == len(want)
    table = df.where("i % 5 = 0").select("k", "t", F.col("i").alias("v"))
    known = [(r["k"], r["t"], r["v"]) for r in table.collect()]
    got = ordered.as_of(df.select("k", "t"), table, ["k"], "t", ["v"], ranges).collect()
    for r in got:
        earlier = [(t, v) for k, t, v in known if k == r["k"] and t <= r["t"]]
        assert r["v"] == (max(earlier)[1] if earlier else None)
    assert len(got) == len(want)
    assert ordered.ranked_within(df, ["k"], "t").count() == len(want)


def split(spark, text, separator):
    rows = records.split_records(spark.createDataFrame([(text,)], "value string"), separator).orderBy("pos").collect()
    return [(r["record"], r["rt"]) for r in rows]


def test_separator_texts(spark):
    assert split(spark, "a\nb\n\n\nc \nd \n \n", "") == [("a\nb", "\n\n\n"), ("c \nd ", "\n \n")]
    assert split(spark, "\n \nx", "") == [("x", "")]
    assert split(spark, "a1b22c", "[0-9]+") == [("a", "1"), ("b", "22"), ("c", "")]
    assert split(spark, "a;;b;", ";") == [("a", ";"), ("", ";"), ("b", ";")]
    assert split(spark, "\n", "\n") == [("", "\n")]
    for empty in (None, "", "\n\n"):
        assert split(spark, empty, "") == []


def test_long_runs_in_records(spark):
    """Patterns that repeat a group must not call themselves for each repeat."""
    blank = "\n" * 100_000
    assert split(spark, f"a{blank}b{blank}", "") == [("a", blank), ("b", blank)]
    assert one(spark, records.csv_fields(F.lit('x,"' + '""' * 100_000 + '",y'))) == ["x", '"' * 100_000, "y"]


def test_patterns_with_signs_at_the_start_and_brackets(spark):
    assert one(spark, strings.matches(F.lit("x*ab"), "*a")) and one(spark, strings.matches(F.lit("a+"), "b|+"))
    assert one(spark, strings.gensub(F.lit("?x(x(x"), "[(]x", "Y", 2)) == "?x(xY"
    assert one(spark, strings.gensub(F.lit("a1b2c3"), "([a-z])([0-9])", r"\2\1", 3)) == "a1b23c"
    assert regex.ungrouped("(a)[(](?:b)") == "(?:a)[(](?:b)"


def test_ignore_case(spark):
    text = F.lit("Alpha ALPHA")
    assert one(spark, strings.gsub(text, "alpha", "<&>", ignore_case=True)) == "<Alpha> <ALPHA>"
    assert one(spark, strings.sub(text, "ALPHA", "x", ignore_case=True)) == "x ALPHA"
    assert one(spark, strings.gensub(text, "a(l)", r"\1", 2, ignore_case=True)) == "Alpha LPHA"
    assert one(spark, strings.pieces(F.lit("1x2X3"), "x", ignore_case=True)) == ["1", "2", "3"]
    assert one(spark, values.compare(F.lit("ABC"), "==", F.lit("abc"), "string", "string", ignore_case=True))


def test_match_offsets_and_bytes(spark):
    df = spark.createDataFrame([("xab12",), ("none",), (None,)], "t string")
    got = [[tuple(x) for x in r["m"]] for r in df.select(strings.match_offsets(F.col("t"), "([a-z]b)([0-9]+)?(z)?", 3).alias("m")).collect()]
    assert got == [[(2, 4), (2, 2), (4, 2), (0, -1)], [(0, -1)] * 4, [(0, -1)] * 4]
    assert one(spark, strings.byte_length(F.lit("é😀"))) == 6
    assert one(spark, strings.byte_index(F.lit("éa"), "a")) == 3
    assert one(spark, strings.byte_substr(F.lit("éab"), 3, 1)) == "a" and one(spark, strings.byte_substr(F.lit("éab"), 2, 2)) == "\ufffda"


def test_kinds_and_separators(spark):
    df = spark.createDataFrame([("42",), ("42abc",), (" -7.5e2 ",), (None,)], "t string")
    assert [r["k"] for r in df.select(values.kind_of(F.col("t")).alias("k")).collect()] == ["strnum", "string", "strnum", "untyped"]
    assert one(spark, strings.separators(F.lit("a1b22c"), "[0-9]+")) == ["1", "22"]


def test_groups_with_null_and_products(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "stop"), (3, None, "x"), (4, "a", "x")], "i long, g string, t string")
    assert sorted(r["i"] for r in ordered.until(df, "i", "t = 'stop'", ["g"]).collect()) == [1, 2, 4]
    numbers = spark.createDataFrame([(3.0,), (7.0,), (11.0,), (None,)], "v double")
    assert numbers.agg(folds.product(F.col("v")).alias("p")).first()["p"] == 231.0


def test_order_by_text(spark):
    df = spark.createDataFrame([(f"k{i * 7919 % 1000:04d}é"[: 4 + i % 3], i) for i in range(1000)], "k string, i long").dropDuplicates(["k"])
    got = ordered.numbered(df, "k", "nr", ranges=7)
    want = {k: n for n, k in enumerate(sorted((r["k"] for r in df.collect()), key=str.encode), 1)}
    assert {r["k"]: r["nr"] for r in got.collect()} == want
    assert ordered.with_ranges(df, "k", 7).select("_range").distinct().count() == 7
    with pytest.raises(TypeError):
        ordered.numbered(df.withColumn("a", F.array("i")), "a")


def test_switch_and_comparator(spark):
    cases = [(Like("^a"), F.lit("1"), False), ("b", F.lit("2"), True), (None, F.lit("3"), False), ("c", F.lit("4"), True)]
    ran = [one(spark, switch_bodies(F.lit(v), cases, default=2)) for v in ("ax", "b", "c", "zz")]
    assert ran == [["1", "2"], ["2"], ["4"], ["3", "4"]]
    df = spark.createDataFrame([("b", 2), ("a", 30), ("c", 100)], "k string, v long")
    backwards = lambda a, b: b["v"] - a["v"]
    assert [(r["i"], r["k"]) for r in folds.sorted_with(df, backwards, ["k", "v"]).orderBy("i").collect()] == [(1, "c"), (2, "a"), (3, "b")]
    with pytest.raises(Exception, match="2 rows at most"):
        folds.sorted_with(df, backwards, ["k", "v"], most=2).collect()
    mixed = spark.createDataFrame([("10",), ("9",), ("b",), ("B",), ("9",)], "value string")
    assert [(r["i"], r["value"]) for r in folds.values_in_order(mixed).orderBy("i").collect()] == [(1, "9"), (2, "9"), (3, "10"), (4, "B"), (5, "b")]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "in" / "deep" / "b.txt").write_text("three")
    top = str(tmp_path / "in")
    assert [(r["name"], r["size"]) for r in records.listing(spark, top).collect()] == [("a.txt", 8)]
    assert sorted(r["name"] for r in records.listing(spark, top, recursive=True).collect()) == ["a.txt", "b.txt"]
    assert [r["text"] for r in records.whole_files(spark, top + "/a.txt").collect()] == ["one\ntwo\n"]
    table = spark.createDataFrame([("a\tb", "x\\n\ny"), ("", None), ("é", "\\\\t")], "key string, value string")
    sinks.write_table(table, str(tmp_path / "table"))
    got = sorted(tuple(r) for r in records.read_table(spark, str(tmp_path / "table")).collect())
    assert got == sorted([("a\tb", "x\\n\ny"), ("", ""), ("é", "\\\\t")])
    stream = records.stream_records(spark, top)
    query = stream.writeStream.format("memory").queryName("read").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["record"] for r in spark.table("read").collect()) == ["one", "two"]


def test_fragments_and_assignments(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b\nc\n\nd"), (3, None), (4, "e")], "i long, p string").repartition(3)
    got = sorted((r["line_no"], r["line"]) for r in sinks.fragments(df, "i", "p").collect())
    assert got == [(0, "ab"), (1, "c"), (2, ""), (3, "de")]
    ended = spark.createDataFrame([(1, "a\n")], "i long, p string")
    assert [r["line"] for r in sinks.fragments(ended, "i", "p").collect()] == ["a"]
    files = spark.createDataFrame([(0,), (1,), (2,)], "f int")
    assert [r["v"] for r in records.assigned(files, "f", [(1, "x")], "v").orderBy("f").collect()] == ["", "x", "x"]
    said = spark.createDataFrame([("dog", "dogs", 1), ("dog", "dogs", 3), ("cow", "cows", 2)], "m string, p string, n int")
    known = spark.createDataFrame([("dog", "Hund", "Hunde")], "msgid string, msgstr string, msgstr_plural string")
    assert [r["s"] for r in lookups.translated(said, "m", known, "s", "p", "n").collect()] == ["Hund", "Hunde", "cows"]


def test_random_and_exact_numbers(spark):
    x, want = 1, []
    for _ in range(40):
        x = (x * 1103515245 + 12345) % 2**64
        want.append((x >> 16 & 0x7FFF) / 32768)
    got = spark.range(1, 41).select(maths.random_at(F.col("id")).alias("v")).collect()
    assert [r["v"] for r in got] == want
    assert one(spark, maths.exact(F.lit("12345678901234567890123")).cast("string")) == "12345678901234567890123"
    assert one(spark, maths.exact(F.lit("x"))) is None
    assert abs(one(spark, times.systime()) - one(spark, F.unix_timestamp())) < 60
    assert one(spark, times.mktime(F.lit("2024 02 29 0 0 1"), utc=True)) == 1709164801


def run_stream(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


def test_streams_with_time_and_order(spark, tmp_path):
    rows = [(i, i % 2, float(i), f"2024-01-01 00:{i:02d}:00") for i in range(30)]
    df = spark.createDataFrame(rows, "i long, k long, v double, at string").withColumn("at", F.col("at").cast("timestamp"))
    for part in (0, 1):
        df.where(f"i div 15 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_stream(streams.stream_windows(stream, "at", "10 minutes", "1 minute", ["k"], n=F.count("*")), "windows")
    assert {(r["start"].minute, r["k"]): r["n"] for r in spark.table("windows").collect()} == {(m, k): 5 for m in (0, 10) for k in (0, 1)}
    run_stream(streams.stream_seen_first(stream.select("k", "at"), ["k"], "at", "1 hour"), "firsts")
    assert sorted(r["k"] for r in spark.table("firsts").collect()) == [0, 1]
    run_stream(streams.stream_running(stream, ["k"], "i", "v"), "ran")
    got = spark.table("ran").collect()
    assert len(got) == 30
    for k in (0, 1):
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["n"])
        assert [r["n"] for r in own] == list(range(1, 16))
        total = 0.0
        for before, r in zip([None, *own], own, strict=False):
            total += r["v"]
            assert r["total"] == total and r["before"] == (None if before is None else before["v"])


@pytest.mark.parametrize("most", ["10m", "-1"])
def test_intervals(spark, monkeypatch, most):
    monkeypatch.setattr(lookups, "BLOCK", 3)
    points = [0.0, -0.0, 0.5, -10.0, -10.5, 9.999, 10.0, 19.999, 20.0, 35.0, None, float("nan")] + [7.0] * 20 + [n / 7 for n in range(-90, 200)]
    bands = [(0.0, 10.0), (-10.0, 0.0), (-10.5, 35.0), (7.0, 7.0), (9.0, 8.0), (7.0, 7.5), (6.5, 7.0), (None, 5.0), (5.0, None), (20.0, 30.0), (20.0, 30.0)]
    df = spark.createDataFrame([(i, p, {"a": i}) for i, p in enumerate(points)], "id long, p double, m map<string,long>")
    table = spark.createDataFrame([(i, *b) for i, b in enumerate(bands)], "t long, low double, high double")
    want = [(i, t) for i, p in enumerate(points) for t, (a, b) in enumerate(bands) if None not in (p, a, b) and a <= p < b]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        got = lookups.in_interval(df, "p", table, "low", "high", 10)
        assert got.columns == ["id", "p", "m", "t", "low", "high"]
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r["id"], r["t"]) for r in rows) == sorted(want)
    assert all(r["m"] == {"a": r["id"]} and (r["low"], r["high"]) == bands[r["t"]] for r in rows)


def test_pairs_of_intervals_take_few_bytes(spark, tmp_path):
    df = spark.range(50_000).selectExpr("id", "pmod(xxhash64(id), 1000000) / 1000 as p")
    table = spark.range(1_000).selectExpr("id as t", "pmod(xxhash64(id, 1), 1000000) / 1000 as low").withColumn("high", F.col("low") + 50)
    out = str(tmp_path / "pairs")
    lookups.in_interval(df, "p", table, "low", "high", 50).select("id", "t").write.parquet(out)
    rows = spark.read.parquet(out).count()
    assert rows > 2_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < rows  # under a byte a pair


def test_pairs_of_one_cell_are_dealt_over_tasks(spark):
    df = spark.range(2_000).selectExpr("id", "id / 100 as p")
    table = spark.range(200).selectExpr("id as t", "id / 20 as low", "id / 20 + 5 as high")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lookups.in_interval(df, "p", table, "low", "high", 50)
        rows = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = sum(t / 20 <= i / 100 < t / 20 + 5 for i in range(2_000) for t in range(200))
    assert sum(r["count"] for r in rows) == want
    assert len(rows) > 1 and max(r["count"] for r in rows) < 0.75 * want
