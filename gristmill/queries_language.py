"""Catalogue queries of the pattern language: syntax, escapes, classes, properties, boundaries, options, readers and errors.

Imported by ``queries``, whose tables of queries and SQL it fills.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import columns as rx
from .operators import grep, matching, sets
from .plans.errors import FuzzyUnsupported, PatternError, PatternSyntaxError
from .plans.pattern import Pattern, compile_bytes
from .plans.pattern import compile as compile_pattern
from .queries import EMAIL, NUMBER, SPANS_SQL, joined, query, table
from .sources import lines
from .streaming import streams

#: Letters, digits and signs of many kinds that the tables' texts lack, put after each text.
SAMPLE = "Ωλ Жж אב ع漢字かカ한 ٣९ Ⅷ ½ €£ «q» – — ‿ \u00ad\u200d \u2028 é e\u0301 ǅ ʰ ª ª× ﬁ 😀 ☃ \u3000 \ufdd0 ـ 𝄞 \u05f3"


def counted(columns: dict[str, str], text: str) -> str:
    """SQL of the number of matches of each pattern."""
    return ", ".join(f"len(regexp_extract_all({text}, '{p}')) AS {n}" for n, p in columns.items())


def counts(columns: dict[str, str], text, **options) -> list:
    return [rx.count_matches(text, p, **options).cast("long").alias(n) for n, p in columns.items()]


_TEXT = f"(text || '{SAMPLE}')"


def _with_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(SAMPLE)).alias("text"))


# --- properties ---------------------------------------------------------------


@query(f"""SELECT doc_id, {counted({"greek": r"\p{Greek}", "cyrl": r"\p{Cyrillic}", "han": r"\p{Han}", "latin": r"\p{Latin}", "hebr": r"\p{Hebrew}", "not_latin": r"\P{Latin}", "hira": r"\p{Hiragana}"}, _TEXT)} FROM documents""")
def q70_scripts(spark, d):
    named = {"greek": r"\p{Greek}", "cyrl": r"\p{sc=Cyrl}", "han": r"\p{Script=Han}", "latin": r"\p{ l a t i n }", "hebr": r"\p{Script:Hebrew}", "not_latin": r"\P{Latin}", "hira": r"\p{Hiragana}"}
    return _with_sample(spark, d).select("doc_id", *counts(named, F.col("text"), ignore_whitespace=True))


@query(f"""SELECT doc_id, {counted({"lu": r"\p{Lu}", "ll": r"\p{Ll}", "lt": r"\p{Lt}", "lm": r"\p{Lm}", "lo": r"\p{Lo}", "m": r"\p{M}", "nd": r"\p{Nd}", "nl": r"\p{Nl}", "no": r"\p{No}", "pd": r"\p{Pd}", "pi": r"\p{Pi}", "sc": r"\p{Sc}", "sm": r"\p{Sm}", "zs": r"\p{Zs}", "cf": r"\p{Cf}", "lc": r"[\p{Lu}\p{Ll}\p{Lt}]"}, _TEXT)} FROM documents""")
def q71_categories(spark, d):
    named = {"lu": r"\p{Lu}", "ll": r"\p{Lowercase_Letter}", "lt": r"\p{gc=Lt}", "lm": r"\p{General_Category=Modifier_Letter}", "lo": r"\p{Lo}", "m": r"\p{Mark}", "nd": r"\p{Decimal_Number}", "nl": r"\p{Nl}", "no": r"\p{gc:No}", "pd": r"\p{dash punctuation}", "pi": r"\p{Pi}", "sc": r"\p{Currency-Symbol}", "sm": r"\p{Sm}", "zs": r"\p{Zs}", "cf": r"\p{Cf}", "lc": r"\p{LC}"}
    return _with_sample(spark, d).select("doc_id", *counts(named, F.col("text")))


#: The same sets as ranges, for the letters that stand in the texts and the sample.
_BINARY = {
    "alphabetic": r"[\p{L}\p{Nl}]", "uppercase": r"[\p{Lu}\x{2160}-\x{216F}]", "lowercase": r"[\p{Ll}\x{aa}\x{ba}\x{2b0}-\x{2b8}]", "white": r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", "hex": r"[0-9A-Fa-f\x{ff10}-\x{ff19}\x{ff21}-\x{ff26}\x{ff41}-\x{ff46}]", "ascii_hex": "[0-9A-Fa-f]",
    "dash": r"[\-\x{58a}\x{5be}\x{2010}-\x{2015}\x{2053}\x{2212}]", "joiner": r"[\x{200c}\x{200d}]", "nonchar": r"[\x{fdd0}-\x{fdef}]", "ideographic": r"\p{Han}", "any_char": r"(?s:.)", "ascii": r"[\x00-\x7f]", "assigned": r"[^\x{fdd0}-\x{fdef}]", "diacritic": r"[\^`\x{a8}\x{af}\x{b4}\x{b7}\x{b8}\x{2b0}-\x{2b8}\x{301}]", "soft_dotted": "[ij]", "quotation": r"[\"\x27\x{ab}\x{bb}]",
}


_PART = f"(p_name || '{SAMPLE}')"


@query(f"""SELECT p_partkey, {counted({n: p.replace(chr(39), chr(39) * 2) for n, p in _BINARY.items()}, _PART)} FROM part""")
def q72_binary_properties(spark, d):
    named = {
        "alphabetic": r"\p{Alphabetic}", "uppercase": r"\p{Uppercase}", "lowercase": r"\p{Lowercase}", "white": r"\p{White_Space}", "hex": r"\p{Hex_Digit}", "ascii_hex": r"\p{AHex}", "dash": r"\p{Dash}", "joiner": r"\p{Join_Control}", "nonchar": r"\p{Noncharacter_Code_Point}",
        "ideographic": r"\p{Ideographic}", "any_char": r"\p{Any}", "ascii": r"\p{ASCII}", "assigned": r"\p{Assigned}", "diacritic": r"\p{Diacritic}", "soft_dotted": r"\p{Soft_Dotted}", "quotation": r"\p{Quotation_Mark}",
    }
    return table(spark, d, "part").select("p_partkey", *counts(named, F.concat("p_name", F.lit(SAMPLE))))


@query(f"""SELECT doc_id, {counted({"greek": r"[\x{370}-\x{3ff}]", "basic": r"[\x00-\x7f]", "punct": r"[\x{2000}-\x{206f}]", "added_15": r"\x{1f6dc}", "added_11": r"[A-Z]", "extend": r"[\x{301}\x{200d}]", "numeric": r"[\p{Nd}]", "scx_hebr": r"[\x{5d0}\x{5d1}\x{5f3}]"}, _TEXT)} FROM documents""")
def q73_blocks_ages_breaks(spark, d):
    # Introduced in 1.1, among the capital letters; in 15.0, nothing that stands here.
    named = {"greek": r"\p{Block=Greek_And_Coptic}", "basic": r"\p{blk=Basic Latin}", "punct": r"\p{InGeneralPunctuation}", "added_15": r"\p{Age=V15_0}", "added_11": r"[\p{Age=1.1}&&[A-Z]]", "extend": r"\p{GCB=Extend}|\p{GCB=ZWJ}", "numeric": r"\p{WB=Numeric}", "scx_hebr": r"\p{scx=Hebrew}"}
    return _with_sample(spark, d).select("doc_id", *counts(named, F.col("text")))


# --- escapes and classes ------------------------------------------------------

_WORD = r"[\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200c}\x{200d}]"
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"""SELECT doc_id, {counted({"d": r"\p{Nd}", "w": _WORD, "s": _SPACE, "h": r"[\t \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", "not_d": r"\P{Nd}", "ascii_d": "[0-9]", "ascii_w": "[0-9A-Za-z_]", "ascii_s": r"[\t-\r ]"}, _TEXT)} FROM documents""")
def q74_perl_classes(spark, d):
    named = {"d": r"\d", "w": r"\w", "s": r"\s", "h": r"\h", "not_d": r"\D", "ascii_d": r"(?-u:\d)", "ascii_w": r"(?-u:\w)", "ascii_s": r"(?-u:\s)"}
    return _with_sample(spark, d).select("doc_id", *counts(named, F.col("text")))


@query(f"""SELECT doc_id, {counted({"x": "the", "u": "é", "wide": r"\x{1f600}", "braces": "A", "controls": r"[\t\n\r]", "octal": "e", "not_newline": r"[^\n]", "quoted": r"\*\*\*", "by_name": "é", "empty_class": r"[^\x00-\x{10ffff}]", "any_class": r"(?s:.)", "posix": "[A-Za-z0-9]", "not_posix": "[^0-9]", "nested": "[aeiou0-9]", "letters": r"[ABGKZz]", "commented": "th[a-z]", "spaced": "[0-9]{2}", "lazy": "o[a-z]{1,3}?", "stray": r"\]"}, _TEXT)} FROM documents""")
def q75_escapes(spark, d):
    named = {
        "x": r"\x74\x68\x65", "u": r"\u00e9", "wide": r"\U0001F600", "braces": r"\x{41}", "controls": r"[\t\n\r]", "octal": r"\145|\o{145}", "not_newline": r"\N", "quoted": r"\Q***\E", "by_name": r"\N{LATIN SMALL LETTER E WITH ACUTE}", "empty_class": "[]", "any_class": "[^]", "posix": "[[:alnum:]]", "not_posix": "[[:^digit:]]", "nested": "[aeiou[0-9]]", "letters": r"[\A\B\G\K\Z\z]",
        "commented": "th(?#any letter)[a-z]", "spaced": "(?x) [0-9]{ 2 }  # two\n", "lazy": "o[a-z]{1,3}?", "stray": "]",
    }
    return _with_sample(spark, d).select("doc_id", *counts(named, F.col("text")))


@query("SELECT page_id, strlen(url) AS octets, len(regexp_extract_all(url, '(?i)HTTPS?')) AS folded, len(regexp_extract_all(url, '[^/]+')) AS parts, regexp_replace(url, '([a-z]+)://', '<\\1>') AS swapped FROM pages")
def q76_octets(spark, d):
    octets = F.encode("url", "utf-8")
    count = lambda p: rx.count_matches(octets, compile_bytes(p)).cast("long")
    swapped = rx.replace_first(octets, compile_bytes("(?<scheme>[a-z]+)://"), b"<$scheme>")
    return table(spark, d, "pages").select("page_id", count(r"\C").alias("octets"), count("(?i)HTTPS?").alias("folded"), count("[^/]+").alias("parts"), F.decode(swapped, "utf-8").alias("swapped"))


# --- boundaries and anchors ---------------------------------------------------


@query("SELECT p_partkey, 2 * len(string_split(p_name, ' ')) AS words, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS sentences, length(p_name) + 2 AS graphemes, length(regexp_extract(p_name, '^[a-z]*')) AS from_start, p_size % 3 <= 1 AS before_end, len(string_split(p_name, ' ')) AS starts, len(string_split(p_name, ' ')) AS ends, 2 * len(string_split(p_name, ' ')) AS edges, length(p_name) + 1 - 2 * len(string_split(p_name, ' ')) AS inside FROM part")
def q77_boundaries(spark, d):
    name, n = F.col("p_name"), lambda text, p: rx.count_matches(text, p).cast("long")
    sentences = F.concat(name, F.when(F.col("p_size") % 2 == 0, ". A").otherwise(". a"))
    return table(spark, d, "part").select(
        "p_partkey", n(name, r"\b{wb}").alias("words"), n(sentences, r"\b{sb}").alias("sentences"), n(F.concat(name, F.lit("e\u0301")), r"\b{g}").alias("graphemes"), n(name, r"\G[a-z]").alias("from_start"),
        rx.is_match(F.concat(name, F.repeat(F.lit("\n"), (F.col("p_size") % 3).cast("int"))), r"[a-z]\Z").alias("before_end"), n(name, r"\b{start}").alias("starts"), n(name, r"\>").alias("ends"), n(name, r"\b").alias("edges"), n(name, r"\B").alias("inside"),
    )


@query("SELECT page_id, len(regexp_extract_all(url, '[0-9A-Za-z_]+')) AS n, len(regexp_extract_all(url, '[a-z]+')) AS halves FROM pages")
def q78_octet_boundaries(spark, d):
    words = rx.count_matches(F.encode("url", "utf-8"), compile_bytes(r"\b\w+\b"))
    halves = rx.count_matches(F.regexp_replace("url", "[^a-z]", " "), r"\b{start-half}[a-z]+\b{end-half}")
    return table(spark, d, "pages").select("page_id", words.cast("long").alias("n"), halves.cast("long").alias("halves"))


# --- what backtracking adds ---------------------------------------------------

@query("""WITH t AS (SELECT p_partkey, p_name AS text, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)
SELECT p_partkey, a AS twice, a AS named, a AS relative, b AS called, length(a) AS variable, length(text) + 6 AS recursive FROM t""")
def q79_references(spark, d):
    name = F.col("p_name")
    twice = F.concat(F.substring_index(name, " ", 1), F.lit(" "), F.substring_index(name, " ", 1))
    size = lambda found: (found["end"] - found["start"]).cast("long")
    return table(spark, d, "part").select(
        "p_partkey", rx.match_group(twice, r"\A([a-z]+) \1\z", 1).alias("twice"), rx.match_group(twice, r"\A(?<w>[a-z]+) \k<w>\z", "w").alias("named"), rx.match_group(twice, r"\A([a-z]+) \g{-1}\z", 1).alias("relative"),
        F.substring_index(rx.match_text(name, r"(?<w>[a-z]+) \g'w'"), " ", -1).alias("called"), (rx.match_end(F.concat(name, F.lit("|")), r"(?<=\A[a-z]{1,40}) ").cast("long") - 1).alias("variable"), size(rx.scan(F.concat(F.lit("x(a"), name, F.lit("(b)))")), r"\((?:[^()]|(?R))*\)")).alias("recursive"),
    )


@query("""SELECT o_orderkey, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'high' ELSE 'low' END AS mark, substr(o_orderpriority, 1, 2) AS accepted,
  CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'URGENT' END AS committed, regexp_extract(o_orderpriority, '[A-Z]') AS pruned, regexp_extract(o_orderpriority, '[A-Z]+') AS then_other, regexp_extract(o_orderpriority, '[A-DF-Z]+') AS without_e FROM orders""")
def q80_verbs_and_callouts(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", rx.scan(p, "(?:[12](*MARK:high)|[345](*MARK:low))-")["mark"].alias("mark"), rx.match_text(p, "[0-9]-(*ACCEPT)never").alias("accepted"), rx.match_text(p, r"(?:1-\KURGENT|[2-5](*COMMIT)(*FAIL))").alias("committed"),
        rx.match_text(p, "[0-9](*PRUNE)x|[A-Z]").alias("pruned"), rx.match_text(p, "(?:[0-9](*THEN)x|[A-Z]+)").alias("then_other"), rx.match_text(p, compile_pattern("(?:[A-Z](?C1))+", callout=_no_e)).alias("without_e"),
    )


def _no_e(number, tag, at, text):
    return "fail" if text[at - 1] == "E" else None


@query("SELECT o_orderkey, regexp_extract(o_orderpriority, '[A-Z]+') AS ahead, regexp_extract(o_orderpriority, '[A-Z]+') AS behind, regexp_extract(o_orderpriority, '^([0-9])', 1) AS again, o_orderpriority LIKE '%T%' AS has_t FROM orders")
def q81_look_verbs(spark, d):
    p, twice = F.col("o_orderpriority"), F.concat("o_orderpriority", F.lit(" "), F.substring("o_orderpriority", 1, 1))
    return table(spark, d, "orders").select("o_orderkey", rx.match_text(p, "(*pla:[A-Z])[A-Z]+").alias("ahead"), rx.match_text(p, "(*plb:-)[A-Z]+").alias("behind"), rx.match_group(twice, r"\A(?*.*?([0-9])).* \1\z", 1).alias("again"), rx.is_match(p, r"(*napla:.*T)\A").alias("has_t"))


# --- one match ----------------------------------------------------------------


@query(f"SELECT doc_id, regexp_extract(text, '{NUMBER}') AS compiled, regexp_extract(text, '{NUMBER}') AS octets, regexp_extract(text, '{NUMBER}') AS backtracked, len(regexp_extract_all(text, '{NUMBER}')) > 0 AS found FROM documents")
def q82_match_forms(spark, d):
    text, octets = F.col("text"), F.encode("text", "utf-8")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, d, "documents").select("doc_id", empty(rx.match(text, NUMBER)["text"]).alias("compiled"), empty(F.decode(rx.match(octets, compile_bytes(NUMBER))["text"], "utf-8")).alias("octets"), empty(rx.run_advanced(text, NUMBER)["text"]).alias("backtracked"), rx.scan(text, NUMBER).isNotNull().alias("found"))


@query("""WITH t AS (SELECT p_partkey, string_split(p_name, ' ')[2] AS w FROM part)
SELECT p_partkey, CASE WHEN least(levenshtein(w, 'gear'), levenshtein(w, 'gearx') + 99) <= 2 THEN levenshtein(w, 'gear') END::INTEGER AS edits, CASE WHEN w = 'gear' THEN 0 END::INTEGER AS exact, w = 'gear' AS same FROM t WHERE length(w) = 4""")
def q83_edit_distance(spark, d):
    held = table(spark, d, "part").select("p_partkey", F.substring_index("p_name", " ", -1).alias("w")).filter(F.length("w") == 4)
    w = F.col("w")
    # Of words of the pattern's length an insertion at the end never pays.
    return held.select("p_partkey", rx.fuzzy_match(w, "^gear$", 2)["edit_distance"].alias("edits"), rx.fuzzy_scan_at(F.concat(F.lit("ab"), w), "gear$", 0, 2)["edit_distance"].alias("exact"), (rx.fuzzy_match(F.encode(w, "utf-8"), compile_bytes("^gear$"), 0).isNotNull()).alias("same"))


@query("""WITH m AS (SELECT event_id, regexp_extract_all(props, '"([a-z]+)": ([0-9]+)', 1) AS k, regexp_extract_all(props, '"([a-z]+)": ([0-9]+)', 2) AS v FROM events)
SELECT event_id, array_to_string(k, ',') AS keys, array_to_string(v, ',') AS numbers, len(k) AS n FROM m""")
def q84_captures(spark, d):
    found = rx.all_matches(F.col("props"), '"([a-z]+)": ([0-9]+)')
    group = lambda i: F.array_join(F.transform(found, lambda m: F.get(m["groups"], F.lit(i))["text"]), ",")
    return table(spark, d, "events").select("event_id", group(1).alias("keys"), group(2).alias("numbers"), F.size(found).cast("long").alias("n"))


@query("SELECT p_partkey, array_to_string(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i + 1, 1)), ',') AS middles FROM part")
def q85_captures_overlapping(spark, d):
    found = rx.all_matches_overlapping(F.col("p_name"), "[a-z ]([a-z ])[a-z ]")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(found, lambda m: F.get(m["groups"], F.lit(1))["text"]), ",").alias("middles"))


# --- options ------------------------------------------------------------------


@query("SELECT event_id, regexp_extract(props, '\"([a-z]+)\"', 1) AS only_named, len(string_split(props, ',')) AS fields, regexp_matches(props, '[0-9]') AS digits FROM events")
def q86_options(spark, d):
    props = F.col("props")
    only = rx.match_captures(props, "(\")(?<key>[a-z]+)(\")", never_capture=True)
    fields = rx.count_matches(props, "^.*$", multi_line=True, line_terminator=",")
    return table(spark, d, "events").select("event_id", F.get(only, F.lit(1)).alias("only_named"), fields.cast("long").alias("fields"), rx.is_match(props, r"\x30|\061|[2-9]", octal=True).alias("digits"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)^[A-Z]')) AS lines, len(regexp_extract_all(text, '(?i)the')) AS folded, len(regexp_extract_all(text, '[0-9]{2}')) AS spaced, md5(array_to_string(string_split_regex(text, '[0-9]+'), '|')) AS timed, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS replaced FROM documents")
def q87_scoped_flags_and_timeouts(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", rx.count_matches(text, "(?m:^)[A-Z]").cast("long").alias("lines"), rx.count_matches(text, "(?i)t(?-i:h|H)(?:e)").cast("long").alias("folded"), rx.count_matches(text, "[0-9] {2}", ignore_whitespace=True).cast("long").alias("spaced"), joined(rx.split(text, NUMBER, timeout=60)).alias("timed"), F.md5(rx.replace_all(text, NUMBER, "#", timeout=60)).alias("replaced"))


# --- readers and errors, of patterns in a table -------------------------------

#: Patterns of many shapes; what they have can be read off their text.
SHAPES = ["[a-z]+", "(a)(b)", "(?<year>[0-9]{4})-(?<month>[0-9]{2})", "(a)|(b)", "(?:a)(?P<n>b)?", "(?=(a))b", r"(a)\1", "(?>a)b", "((a)(b(c)))", "a++"]
_SHAPES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(SHAPES))


@query(f"""WITH s(id, p) AS (VALUES {_SHAPES}),
g AS (SELECT *, len(regexp_extract_all(p, '\\(')) - len(regexp_extract_all(p, '\\(\\?[:=>]')) AS n FROM s)
SELECT id::BIGINT AS id, p AS source, n AS groups, n + 1 AS captures, array_to_string(regexp_extract_all(p, '\\?P?<([a-z]+)>', 1), ',') AS names, regexp_matches(p, '\\(\\?[=>]|\\\\1|\\+\\+') AS advanced,
  CASE WHEN contains(p, '|') THEN n // 2 + 1 WHEN regexp_matches(p, '\\)\\?$') THEN NULL ELSE n + 1 END AS static_captures, true AS is_pattern, false AS in_octets, 7 AS nest, true AS never_newline, 2 AS members FROM g""")
def q88_readers(spark, d):
    held = []
    for i, source in enumerate(SHAPES):
        p = compile_pattern(source, nest_limit=7, never_newline=True)
        both = sets.compile_set([source, "x"])
        held.append((i, p.source, p.group_count, p.capture_count, ",".join(n for n in p.capture_names if n), p.advanced, p.static_capture_count, isinstance(p, Pattern) and isinstance(both, sets.PatternSet) and both.patterns == [source, "x"] and not both.empty, p.byte_mode, p.options.nest_limit, p.options.never_newline and p.options.callout is None, len(both)))
    return spark.createDataFrame(held, "id long, source string, groups long, captures long, names string, advanced boolean, static_captures long, is_pattern boolean, in_octets boolean, nest int, never_newline boolean, members int")


#: Well and badly formed ones, of rules that the other engine shares.
FORMS = ["ab", "a{2,3}", "(a", "a)", "[a-z", "[z-a]", "*a", "a**", "x{1001}", "x{1000}", "a{3,2}", r"\q", "[[:foo:]]", "[[:alpha:]]", r"\p{Nonesuch}", r"\p{Greek}", "(?z)a", "(?i)a", "(?P<n>a", r"\x{110000}", r"\x{10ffff}", "a\\\\", "a|*", "[^", "(?P<n>a)|b", "(?:a|b", "+"]
_FORMS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(FORMS))


@query(f"SELECT id::BIGINT AS id, TRY(regexp_matches('', p)) IS NULL AS malformed FROM (VALUES {_FORMS}) f(id, p)")
def q89_syntax_errors(spark, d):
    def malformed(source: str) -> bool:
        try:
            compile_pattern(source)
        except PatternError as e:
            return isinstance(e, PatternSyntaxError) and e.pattern == source and 0 <= e.position <= len(source) and bool(e.reason)
        return False

    return spark.createDataFrame([(i, malformed(p)) for i, p in enumerate(FORMS)], "id long, malformed boolean")


#: Rules of this language only: references, octets in texts, templates, sizes; what is wrong can be read off the text.
OWN = [(r"(a)\g{2}", "reference"), (r"(a)\g{1}", ""), ("(?P=no)", "reference"), ("(?&no)", "reference"), ("(?<no>a)(?&no)", ""), ("(?(3)a)", "reference"), ("(a)(?(1)b)", ""), ("(?-u:.)", "octets"), (r"(?-u:\D)", "octets"), (r"(?-u:\xE9)", "octets"), (r"(?-u:\d)", ""), (r"(?-u:[^a])", "octets"), (r"\p{Age=1.1}", ""), ("(?:[a-z]{100}){100}", "size"), ("[a-z]{100}", ""), ("(?=a)", "fuzzy"), ("a++", "fuzzy")]
_OWN = ", ".join(f"({i}, '{p}', '{k}')" for i, (p, k) in enumerate(OWN))


@query(f"""WITH o(id, p, k) AS (VALUES {_OWN}) SELECT id::BIGINT AS id, CASE
  WHEN regexp_matches(p, '\\(\\?-u:(\\.|\\\\D|\\[\\^|\\\\x[89A-F])') THEN 'octets'
  WHEN regexp_matches(p, '(P=|&|g\\{{)([a-z2-9]+)') AND NOT regexp_matches(p, '\\?<no>') OR regexp_matches(p, '\\(3\\)') THEN 'reference'
  WHEN regexp_matches(p, '\\}}\\)\\{{100') THEN 'size' WHEN p IN ('(?=a)', 'a++') THEN 'fuzzy' ELSE '' END AS error FROM o""")
def q90_own_errors(spark, d):
    def error(source: str, kind: str) -> str:
        try:
            p = compile_pattern(source, size_limit=5_000)
            if kind == "fuzzy":
                matching.fuzzy(p, "a")
        except FuzzyUnsupported:
            return "fuzzy"
        except PatternSyntaxError as e:
            return "size" if "large" in e.reason else "octets" if "(?-u:" in source else "reference"
        return ""

    return spark.createDataFrame([(i, error(p, k)) for i, (p, k) in enumerate(OWN)], "id long, error string")


@query("SELECT p_partkey, length(p_name) > 8 AS steps, length(p_name) > 0 AS nesting, length(p_name) > 0 AS states, false AS none FROM part")
def q53_budget(spark, d):
    # A budget in steps shows as an error, never as no match: some names exceed it, others stay within.
    kind = lambda found: F.coalesce(found["kind"], F.lit(""))
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", (kind(rx.match_errors(name, STEPS, step_limit=STEP_LIMIT)) == "steps").alias("steps"), (kind(rx.match_errors(name, "(?=(?=[a-z]))[a-z]", nest_limit=1)) == "nest-depth").alias("nesting"),
        (kind(rx.match_errors(name, "qqqqqqqq", max_edits=3, state_limit=3)) == "states").alias("states"), rx.match_errors(name, STEPS).isNotNull().alias("none"),
    )


#: Takes a fixed number of steps for each character; the limit lies between names of 8 and of 9.
STEPS, STEP_LIMIT = r"\A(?=.)(?:[a-z ])*+\z", 35


# --- sets, lines, streams -----------------------------------------------------


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 0 END, CASE WHEN regexp_matches(o_orderpriority, 'U.*T') THEN 1 END, CASE WHEN regexp_matches(o_orderpriority, 'EE|PP') THEN 2 END, CASE WHEN regexp_matches(o_orderpriority, '[A-Z]+$') THEN 3 END, CASE WHEN regexp_matches(o_orderpriority, '-[HL]') THEN 4 END], lambda x: x IS NOT NULL), ',') AS hits FROM orders")
def q91_set_of_all_kinds(spark, d):
    # A look-around, a loop of loops for the merged scan, a reference, a native member, a required literal.
    held = sets.compile_set(["^(?=[12])", "U(?:[A-Z]*[A-Z]*)*T", r"(E|P)\1", "[A-Z]+$", "-[HL]"])
    return table(spark, d, "orders").select("o_orderkey", F.array_join(sets.set_matches(F.col("o_orderpriority"), held), ",").alias("hits"))


_REPEATED = [(1, "ring"), (2, "ring"), (2, "ring"), (3, "^red"), (4, "nothing"), (5, "(?:[a-z]*[a-z]*)*bolt")]
_REPEATED_SQL = ", ".join(f"({i}, '{p}')" for i, p in _REPEATED)


@query(f"SELECT p.id::BIGINT AS pattern_id, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM (VALUES {_REPEATED_SQL}) AS p(id, pattern) JOIN part ON regexp_matches(p_name, replace(p.pattern, '(?:[a-z]*[a-z]*)*', '')) GROUP BY p.id")
def q92_repeated_patterns(spark, d):
    patterns = spark.createDataFrame(_REPEATED, "pattern_id long, pattern string")
    old, sets.BLOCK_PATTERNS = sets.BLOCK_PATTERNS, 2  # several blocks
    try:
        found = sets.match_table(table(spark, d, "part"), patterns, "p_name")
    finally:
        sets.BLOCK_PATTERNS = old
    return found.groupBy("pattern_id").agg(F.count("*").alias("n"), F.sum("p_partkey").cast("long").alias("keys"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id AS label, line_no, md5(doc_id || ':' || line_no || ':' || line) AS out FROM l WHERE NOT (line = '' AND line_no = n) AND regexp_matches(line, '[0-9]{2}')")
def q93_grep_output(spark, d):
    held = lines.numbered_lines(table(spark, d, "documents"), label="doc_id").withColumn("label", F.col("label").cast("string"))
    found = grep.formatted(grep.grep(held, "[0-9]{2}"), labels=True, line_number=True)
    return found.select(F.col("label").cast("long").alias("label"), "line_no", F.md5("out").alias("out"))


def _streamed(spark, d, make, label: str):
    """The matches that a stream of chunks gives, as a table: chunks and results stand in the shared folder."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='gristmill-')}"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    cut = lines.chunks(table(spark, d, "documents"), 512, "doc_id")
    cut.write.parquet(f"{path}/in")
    found = make(spark.readStream.schema(cut.schema).parquet(f"{path}/in"))
    query_ = found.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e")).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    query_.awaitTermination()
    return spark.read.schema("doc_id long, s int, e int").parquet(f"{path}/out")


@query(SPANS_SQL)
def q94_buffered_streaming(spark, d):
    return _streamed(spark, d, lambda held: streams.buffered_stream(held, NUMBER, "doc_id"), "buffered")


@query(SPANS_SQL)
def q95_incremental_streaming(spark, d):
    return _streamed(spark, d, lambda held: streams.incremental_stream(held, NUMBER, "doc_id"), "incremental")


@query("""WITH t AS (SELECT page_id, url || 'éß漢😀ñ' || url AS text FROM pages),
w AS (SELECT page_id, regexp_extract_all(text, '[\\p{L}]+') AS m, string_split_regex(text, '[\\p{L}]+') AS g FROM t),
i AS (SELECT page_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM w)
SELECT page_id, CAST(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: strlen(x))), 0) AS INTEGER) AS s,
  CAST(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + list_sum(list_transform(m[1:i], lambda x: strlen(x))) AS INTEGER) AS e FROM i""")
def q96_octet_stream(spark, d):
    # Octets cut anywhere, also inside characters, and put together again by the live search.
    octets = table(spark, d, "pages").filter("url IS NOT NULL").select("page_id", F.encode(F.concat("url", F.lit("éß漢😀ñ"), "url"), "utf-8").alias("raw"))
    many = F.greatest(F.ceil(F.octet_length("raw") / 7).cast("int"), F.lit(1))
    cut = octets.select("page_id", "raw", many.alias("many"), F.explode(F.sequence(F.lit(0), many - 1)).alias("seq"))
    cut = cut.select("page_id", F.col("seq").cast("long").alias("seq"), F.substr(F.col("raw"), F.col("seq") * 7 + 1, F.lit(7)).alias("chunk"), (F.col("seq") == F.col("many") - 1).alias("is_last"))
    return streams.incremental_matches(cut, compile_bytes(r"\p{L}+"), "page_id").select("page_id", F.col("start").alias("s"), F.col("end").alias("e"))


@query(f"SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '{EMAIL}|[A-Z]{{3}}[a-z0-9]{{2}}') GROUP BY lang")
def q97_long_runs(spark, d):
    # A pattern that starts with a run; each text is followed by a run that no match ends.
    text = F.concat("text", F.lit(" "), F.repeat(F.lit("a"), 2_000))
    return table(spark, d, "documents").filter(rx.is_match(text, EMAIL) | rx.is_match(F.col("text"), "[A-Z]{3}[a-z0-9]{2}")).groupBy("lang").agg(F.count("*").alias("n"))
