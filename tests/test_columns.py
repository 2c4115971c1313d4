"""Column functions: native and exact plans give the same, with NULLs and odd texts."""

import io

import pytest
from pyspark.sql import functions as F

from gristmill import grep as cli
from gristmill.functions import columns as rx
from gristmill.functions import sql
from gristmill.operators import grep, matching, sets
from gristmill.plans.errors import FuzzyUnsupported
from gristmill.plans.pattern import compile, compile_bytes
from gristmill.sources import lines

TEXTS = [None, "", "abc", "one,two,", "a1b22c333", "😀cat c2t cAt", "x\n", "\r\nfoo\r\n", "é É ß SS", "Customer#0042", "aaaa", "the then", "tab\tsep", "ſ K", "a,b;c", "$1 \\d {x}"]
PATTERNS = ["b", "[0-9]+", "c.t", "(a)(1)?", r"\w+", r"\bthe\b", "(?i)é|ſ", "a|aa", ",|;", "^x$", r"\Aone", r"\R", "(?m)^foo$", "(a)b|(c)", "a*", r"(?<=c)a", r"(.)\1", "[^a-z]", r"\p{Lu}", r"\.", r"\Athe then\z", "(?=t)the then", r"one\K,(?:t)wo", "Customer(?>#)[0-9]+"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string").repartition(2).cache()


def values(texts, column):
    return [r[0] for r in texts.select(column.alias("v"), "id").orderBy("id").select("v").collect()]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_plans_agree(texts, pattern):
    p, t = compile(pattern), F.col("text")
    each = lambda fn: [None if x is None else fn(x) for x in TEXTS]
    forms = {
        "is": (rx.is_match, lambda x: matching.is_match(p, x)),
        "full": (rx.full_match_p, lambda x: matching.full_match(p, x) is not None),
        "text": (rx.match_text, lambda x: (f := matching.find(p, x)) and f.string(x)),
        "start": (rx.match_start, lambda x: (f := matching.find(p, x)) and f.start),
        "end": (rx.match_end, lambda x: (f := matching.find(p, x)) and f.end),
        "captures": (rx.match_captures, lambda x: (f := matching.find(p, x)) and f.captures(x)),
        "texts": (rx.all_texts, lambda x: [f.string(x) for f in matching.each(p, x)]),
        "count": (rx.count_matches, lambda x: len(list(matching.each(p, x)))),
        "split": (rx.split, lambda x: matching.split(p, x)),
        "terminator": (rx.split_terminator, lambda x: matching.split(p, x, mode="terminator")),
        "inclusive": (rx.split_inclusive, lambda x: matching.split(p, x, mode="inclusive")),
    }
    columns = [fn(t, p, engine=e).alias(f"{n}_{e}") for n, (fn, _) in forms.items() for e in (None, "exact")]
    columns += [rx.split_n(t, p, 2).alias("n"), rx.replace_all(t, p, "<$0>\\$$").alias("all"), rx.replace_first(t, p, "<$0>").alias("first"), rx.replace_n(t, p, "", 2).alias("two")]
    rows = texts.select("id", *columns).orderBy("id").collect()
    for name, (_, fn) in forms.items():
        want = each(fn)
        assert [r[f"{name}_None"] for r in rows] == want, name
        assert [r[f"{name}_exact"] for r in rows] == want, name
    assert [r["n"] for r in rows] == each(lambda x: matching.split(p, x, 2))
    assert [r["all"] for r in rows] == each(lambda x: matching.replace(p, x, "<$0>\\$$"))
    assert [r["first"] for r in rows] == each(lambda x: matching.replace(p, x, "<$0>", 1))
    assert [r["two"] for r in rows] == each(lambda x: matching.replace(p, x, "", 2))


def test_plans_are_native(spark, texts):
    plan = lambda c: texts.select(c)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan(rx.is_match(F.col("text"), r"[a-z]+\d")) and "Arrow" in plan(rx.is_match(F.col("text"), r"a\Kb"))
    assert "StartsWith" in plan(rx.is_match(F.col("text"), r"\Aone")) and "Contains" in plan(rx.is_match(F.col("text"), "needle[0-9]"))


def test_structs_and_ranges(spark, texts):
    found = values(texts, rx.scan(F.col("text"), "(?<d>[0-9])([a-z])?", F.least(F.lit(2), F.length("text"))))
    assert found[4].start == 3 and [g and g.text for g in found[4].groups] == ["2", "2", None] and found[0] is None and found[2] is None
    assert values(texts, rx.captures_struct(F.col("text"), "(?<d>[0-9]+)(?<l>[a-z])?"))[4].asDict() == {"d": "1", "l": "b"}
    assert values(texts, rx.captures_spans(F.col("text"), "(c)(x)?"))[2] == [(2, 3), (2, 3), None]
    assert values(texts, rx.match_group_span(F.col("text"), "(c)(x)?", 1))[2] == (2, 3)
    assert [m.start for m in values(texts, rx.all_matches_overlapping(F.col("text"), "aa"))[10]] == [0, 1, 2]
    assert [tuple(s) for s in values(texts, rx.all_spans(F.col("text"), "c.t"))[5]] == [(1, 4), (5, 8), (9, 12)]
    assert values(texts, rx.longest_match(F.col("text"), "th|the|then"))[11].text == "the"
    assert values(texts, rx.shortest_match(F.col("text"), "a+"))[10] == 1
    assert values(texts, rx.full_match(F.col("text"), "a|aaaa"))[10].end == 4
    assert values(texts, rx.is_match_at(F.col("text"), "^a", F.lit(0)))[2] is True
    assert values(texts, rx.split_n(F.col("text"), ",", 0))[:2] == [None, []]
    assert values(texts, rx.run_advanced(F.col("text"), "b"))[2].start == 1
    assert values(texts, rx.fuzzy_scan(F.col("text"), "abd", 1))[2].edit_distance == 1
    assert values(texts, rx.replace_all(F.col("text"), "a", lambda m, t: m.string(t).upper()))[2] == "Abc"
    kinds = values(texts, rx.match_errors(F.col("text"), "(?=a)a", size_limit=1))
    assert kinds[2].kind == "steps" and kinds[2].used > kinds[2].limit and kinds[0] is None
    assert values(texts, rx.is_match(F.col("text"), "b", timeout=60)) == [None if t is None else "b" in t for t in TEXTS]
    assert len(values(texts, rx.all_matches(F.col("text"), "[0-9]", timeout=60))[4]) == 6
    assert values(texts, rx.shortest_match(F.col("text"), "a+", timeout=60))[10] == 1
    with pytest.raises(TypeError):
        rx.match_group(F.col("text"), "(?<a>x)", "b")
    with pytest.raises(FuzzyUnsupported):
        rx.fuzzy_scan(F.col("text"), "(?=a)")
    octets = texts.select("id", F.encode("text", "utf-8").alias("text"))
    assert values(octets, rx.scan(F.col("text"), compile_bytes("c.t")))[5].start == 4
    assert bytes(values(octets, rx.replace_all(F.col("text"), compile_bytes("b"), b"<$0>"))[2]) == b"a<b>c"


def test_escape_column(texts):
    from gristmill.plans.pattern import escape

    assert values(texts, rx.escape(F.col("text"))) == [None if t is None else escape(t) for t in TEXTS]


def test_sets(spark, texts):
    held, t = sets.compile_set(["cat", "[0-9]+", "(?=a)a", "c(?:at|2t)"]), F.col("text")
    for engine in (None, "exact"):
        assert values(texts, sets.set_matches(t, held, engine=engine)) == [None if x is None else held.matches(x) for x in TEXTS]
        assert values(texts, sets.set_match_p(t, held, engine=engine)) == [None if x is None else held.any(x) for x in TEXTS]
        assert values(texts, sets.set_matches_bits(t, held, engine=engine))[4] == [False, True, True, False]
    assert sets.compile_set(["cat", "dog", r"\d+"]).matches("dog42") == [1, 2] and sets.compile_set(["a", "a", "^z"]).matches("a") == [0, 1]
    found = sets.compile_set(["dog", "cat", "c(at)"]).search("xxcat dog")
    assert (found[0], found[1].spans[0]) == (1, (2, 5))
    assert values(texts, sets.set_search(t, held))[5].pattern_index == 0
    patterns = spark.createDataFrame([(1, "cat"), (2, "zzz"), (3, "[0-9]"), (4, r"a\Kb"), (5, None)], "pattern_id int, pattern string")
    want = {i: sum(x is not None and matching.is_match(compile(p), x) for x in TEXTS) for i, p in ((1, "cat"), (2, "zzz"), (3, "[0-9]"), (4, r"a\Kb"))} | {5: 0}
    assert {r.pattern_id: r.hits for r in sets.hits_per_pattern(texts, patterns).collect()} == want
    old, sets.BLOCK_PATTERNS = sets.BLOCK_PATTERNS, 2  # several blocks
    try:
        assert {r.pattern_id: r.hits for r in sets.hits_per_pattern(texts, patterns).collect()} == want
    finally:
        sets.BLOCK_PATTERNS = old
    assert sets.compile_set([]).empty and sets.compile_byte_set(["a"]).matches(b"a") == [0]


def test_lines_and_grep(spark, tmp_path):
    df = spark.createDataFrame([("f", "b\na\n"), ("g", ""), ("h", "A\n\nx"), ("i", None)], "label string, text string")
    held = lines.numbered_lines(df)
    assert sorted(map(tuple, held.collect())) == [("f", 1, "b"), ("f", 2, "a"), ("h", 1, "A"), ("h", 2, ""), ("h", 3, "x")]
    assert sorted(map(tuple, grep.grep(held, "a", ignore_case=True).collect())) == [("f", 2, "a"), ("h", 1, "A")]
    assert sorted(map(tuple, grep.grep(held, "a", count=True).collect())) == [("f", 1), ("h", 0)]
    one, two = tmp_path / "one", tmp_path / "two"
    one.write_text("b\na\n")
    two.write_text("c\n")
    run = lambda *a: (cli.main([*a], spark, out := io.StringIO()), out.getvalue())
    assert run("-n", "a", str(one)) == (0, "2:a\n") and run("x", str(one)) == (1, "") and run("(", str(one))[0] == 2
    code, out = run("-c", "a", str(one), str(two))
    assert code == 0 and [x.rpartition(":")[2] for x in out.split()] == ["1", "0"]
    assert run("-v", "a", str(one)) == (0, "b\n") and run("a", str(tmp_path / "none"))[0] == 2


def test_sql(spark, texts):
    sql.register(spark)
    texts.createOrReplaceTempView("t")
    row = spark.sql("SELECT rx_is_match(text, 'b+') a, rx_full_match(text, '[a-z0-9]+') b, rx_scan(text, '([0-9]+)').text c, size(rx_all_matches(text, '[0-9]+')) d, rx_split(text, '[0-9]+') e, rx_replace_all(text, '([0-9])', '<$1>') f, rx_fuzzy(text, 'a2').edit_distance g FROM t WHERE id = 4").first()
    assert tuple(row)[:4] == (True, True, "1", 3) and row["e"] == ["a", "b", "c", ""] and row["f"] == "a<1>b<2><2>c<3><3><3>" and row["g"] == 1
    got = spark.sql("SELECT m.* FROM t, LATERAL rx_matches(text, '[0-9]+') m WHERE id = 4 ORDER BY nth").collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, "1"), (1, 3, 5, "22"), (2, 6, 9, "333")]


MANY = ["(?:[a-z]*[a-z]*)*ing", "(?:a|aa)+b", r"\bthe\b", "[0-9]{2}", "(?=t)the", r"(e|o)\1", "customer", "then|cat", "^x", "lonely", "tab", "one", "two,", "foo", "#00"]


@pytest.mark.parametrize("options", [{}, {"case_insensitive": True}])
def test_sets_are_their_members(options):
    """A merged scan, an index of literals and members one by one give what each pattern alone gives."""
    held = sets.compile_set(MANY, **options)
    assert held.merged[1] and (held.index is not None) == (not options)
    texts = [t for t in TEXTS if t is not None] + ["the ring sings", "aab then", "book tab", "Customer#0042 one two,", "abcdefghij" * 50]
    for text in texts:
        for start in (0, min(2, len(text))):
            each = [matching.find(p, text, start) for p in held.members]
            hits = [i for i, f in enumerate(each) if f]
            assert held.matches(text, start) == hits == held.matches(text, start, timeout=60) and held.any(text, start) == bool(hits)
            found = held.search(text, start)
            assert (found and (found[0], found[1].start)) == (min(((f.start, i) for i, f in enumerate(each) if f), default=None) and min(((f.start, i) for i, f in enumerate(each) if f))[::-1])
    octets = sets.compile_byte_set(["é(?:a*a*)*b", r"(?-u:\xA9)x", "(?:a|aa)+b"])
    for text in ("éab", "éx", "aab", "é"):
        assert octets.matches(text.encode()) == [i for i, p in enumerate(octets.members) if matching.is_match(p, text.encode())]


def test_pattern_tables_of_several_blocks(spark, texts, monkeypatch):
    rows = [(1, "c.t"), (2, "c.t"), (2, "c.t"), (3, "the"), (3, "(?:a*a*)*a"), (4, "nothing"), (None, "a"), (5, None)]
    patterns = spark.createDataFrame(rows, "pattern_id long, pattern string")
    want = sorted((i, pid) for i, t in enumerate(TEXTS) if t is not None for pid, p in rows if pid and p and matching.is_match(compile(p), t))
    for block in (1, 2, 3, 100):
        monkeypatch.setattr(sets, "BLOCK_PATTERNS", block)
        for engine in (None, "exact"):
            got = sets.match_table(texts, patterns, engine=engine)
            assert sorted((r.id, r.pattern_id) for r in got.collect()) == want
    assert {r.pattern_id: r.hits for r in sets.hits_per_pattern(texts, patterns).collect()}[4] == 0


def test_long_runs_are_linear(spark):
    """A run of a million characters that a pattern starts with: tried once."""
    df = spark.range(1).select(F.concat(F.repeat(F.lit("a"), 1_000_000), F.lit(" b@c.d")).alias("text"))
    email = r"[a-z0-9._]+@[a-z0-9]+\.[a-z.]+"
    assert df.select(rx.is_match(F.col("text"), email), rx.is_match(F.substring("text", 1, 1_000_000), email)).first()[:] == (True, False)


def test_timeouts_of_all_operators(texts):
    text = F.col("text")
    assert values(texts, rx.split(text, ",", timeout=60)) == [None if t is None else t.split(",") for t in TEXTS]
    assert values(texts, rx.replace_all(text, "[0-9]+", "#", timeout=60))[4] == "a#b#c#"
    assert values(texts, rx.captures_spans(text, "c", timeout=60))[2] == [(2, 3)]
    assert values(texts, sets.set_matches(text, sets.compile_set(["a", "b"]), timeout=60))[2] == [0, 1]
    held = values(texts, rx.match_errors(text, "qqqqqq", max_edits=2, state_limit=1))
    assert held[0] is None and held[2].kind == "states"
