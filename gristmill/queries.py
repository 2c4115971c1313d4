"""The query catalogue: one query for each operator, over whole tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as rx
from .operators import grep, sets
from .plans.pattern import compile as compile_pattern
from .plans.pattern import compile_bytes
from .sources import lines
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EMAIL = r"[a-z0-9._]+@[a-z0-9]+\.[a-z.]+"
NUMBER = r"[0-9]+"


def joined(fields):
    return F.md5(F.array_join(fields, "|", "~"))


# --- predicates ---------------------------------------------------------------


@query(f"SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '{EMAIL}') GROUP BY lang")
def q01_match_by_lang(spark, d):
    return table(spark, d, "documents").filter(rx.is_match(F.col("text"), EMAIL)).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM documents WHERE NOT regexp_matches(text, '{EMAIL}')")
def q02_inverted(spark, d):
    return table(spark, d, "documents").filter(~rx.is_match(F.col("text"), EMAIL)).agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS n FROM part WHERE regexp_full_match(p_brand, 'Brand#[0-9]+') GROUP BY p_brand")
def q03_full_match(spark, d):
    return table(spark, d, "part").filter(rx.full_match_p(F.col("p_brand"), "Brand#[0-9]+")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'licen[cs]e', 'i')")
def q04_ignore_case(spark, d):
    return table(spark, d, "documents").filter(rx.is_match(F.col("text"), "licen[cs]e", case_insensitive=True)).select("doc_id")


@query("SELECT doc_id, regexp_matches(substr(text, 11), 'th.r') AS hit FROM documents")
def q04b_match_at(spark, d):
    return table(spark, d, "documents").select("doc_id", rx.is_match_at(F.col("text"), "th.r", F.least(F.lit(10), F.length("text"))).alias("hit"))


@query("SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000')")
def q04c_anchored_literal(spark, d):
    return table(spark, d, "customer").filter(rx.is_match(F.col("c_name"), r"\ACustomer\#00000")).select("c_custkey")


# --- one match ----------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN regexp_matches(props, '"k": [0-9]+') THEN regexp_extract(props, '"k": ([0-9]+)', 1) END AS k FROM events""")
def q05_capture(spark, d):
    return table(spark, d, "events").select("event_id", rx.match_group(F.col("props"), '"k": ([0-9]+)', 1).alias("k"))


@query("SELECT c_custkey, nullif(regexp_extract(c_name, 'Customer#0*([1-9][0-9]*)', 1), '') AS n FROM customer")
def q06_named_captures(spark, d):
    return table(spark, d, "customer").select("c_custkey", rx.captures_struct(F.col("c_name"), "Customer\\#0*(?P<n>[1-9][0-9]*)")["n"].alias("n"))


@query("SELECT doc_id, CASE WHEN regexp_matches(source, 'src1[0-9]+') THEN '1' END AS g1, CASE WHEN regexp_matches(source, 'src1[0-9]+') THEN regexp_extract(source, 'src1([0-9]+)', 1) ELSE regexp_extract(source, 'src([0-9]+)', 1) END AS g2 FROM documents")
def q07_optional_group(spark, d):
    held = rx.match_captures(F.col("source"), "src(1)?([0-9]+)")
    return table(spark, d, "documents").select("doc_id", F.get(held, F.lit(1)).alias("g1"), F.get(held, F.lit(2)).alias("g2"))


@query("SELECT doc_id, length(string_split_regex(text, '[0-9]+')[1]) AS s, length(string_split_regex(text, '[0-9]+')[1]) + length(regexp_extract(text, '[0-9]+')) AS e FROM documents WHERE regexp_matches(text, '[0-9]+')")
def q08_span(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").filter(rx.is_match(text, NUMBER)).select("doc_id", rx.match_start(text, NUMBER).cast("long").alias("s"), rx.match_end(text, NUMBER).cast("long").alias("e"))


@query("SELECT doc_id, CAST(length(string_split_regex(text, '[a-z]+,')[1]) AS INTEGER) AS s, regexp_extract(text, '([a-z]+),', 1) AS who FROM documents WHERE regexp_matches(text, '[a-z]+,')")
def q08b_scan(spark, d):
    found = table(spark, d, "documents").select("doc_id", rx.scan(F.col("text"), "([a-z]+),").alias("m")).filter("m IS NOT NULL")
    return found.select("doc_id", F.col("m.start").alias("s"), F.get("m.groups", F.lit(1))["text"].alias("who"))


@query("SELECT doc_id, regexp_extract(text, 'then|the|th') AS longest, regexp_extract(text, 'th') AS first FROM documents WHERE regexp_matches(text, 'th')")
def q28_longest(spark, d):
    text, p = F.col("text"), "th|the|then"
    return table(spark, d, "documents").filter(rx.is_match(text, p)).select("doc_id", rx.longest_match(text, p)["text"].alias("longest"), rx.match_text(text, p).alias("first"))


@query("SELECT doc_id, CAST(length(string_split_regex(text, 'th[a-z]*?e')[1]) + length(regexp_extract(text, 'th[a-z]*?e')) AS INTEGER) AS e FROM documents WHERE regexp_matches(text, 'th[a-z]*e')")
def q29_shortest(spark, d):
    text, p = F.col("text"), "th[a-z]*e"
    return table(spark, d, "documents").filter(rx.is_match(text, p)).select("doc_id", rx.shortest_match(text, p).alias("e"))


@query("""SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)\\}', 1) AS VARCHAR) AS k FROM events""")
def q32_lookaround(spark, d):
    return table(spark, d, "events").select("event_id", rx.match_text(F.col("props"), r'(?<="k": )[0-9]+(?=\})').alias("k"))


# --- all matches --------------------------------------------------------------


@query("SELECT doc_id, unnest(range(len(regexp_extract_all(text, '[0-9]+')))) AS nth, unnest(regexp_extract_all(text, '[0-9]+')) AS value FROM documents")
def q09_all_matches(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(rx.all_texts(F.col("text"), NUMBER)).alias("nth", "value")).withColumn("nth", F.col("nth").cast("long"))


SPANS_SQL = """
WITH m AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m, string_split_regex(text, '[0-9]+') AS g FROM documents),
i AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM m)
SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS s,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS INTEGER) AS e FROM i
"""


@query(SPANS_SQL)
def q09b_all_spans(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(rx.all_spans(F.col("text"), NUMBER))).withColumnsRenamed({"start": "s", "end": "e"})


@query("SELECT doc_id, len(regexp_extract_all(text, '[Tt]h[a-z]+')) AS n FROM documents")
def q10_count(spark, d):
    return table(spark, d, "documents").select("doc_id", rx.count_matches(F.col("text"), "[Tt]h[a-z]+").cast("long").alias("n"))


@query("SELECT p_partkey, md5(array_to_string(list_filter(list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2)), lambda x: regexp_matches(x, '^[a-z][a-z]$')), '|')) AS grams FROM part")
def q11_overlapping(spark, d):
    return table(spark, d, "part").select("p_partkey", joined(rx.all_texts(F.col("p_name"), "[a-z][a-z]", overlapping=True)).alias("grams"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '\\p{L}'), lambda x: ord(x) > 127)) AS n FROM documents")
def q30_letters(spark, d):
    return table(spark, d, "documents").select("doc_id", rx.count_matches(F.col("text"), r"[\p{L}--[A-Za-z]]").cast("long").alias("n"))


@query("""
WITH w AS (SELECT doc_id, lang, string_split(regexp_replace(text, '[\\t\\n\\v\\f\\r]', ' - ', 'g'), ' ') AS w FROM documents),
p AS (SELECT doc_id, lang, w, unnest(range(1, len(w))) AS i FROM w)
SELECT lang, count(DISTINCT doc_id) AS n FROM p WHERE w[i] = w[i + 1] AND regexp_full_match(w[i], '[a-z]+') GROUP BY lang""")
def q31_back_reference(spark, d):
    # A word said twice: lines are apart.
    return table(spark, d, "documents").filter(rx.is_match(F.col("text"), r"(?:^|\s)([a-z]+) \1(?:\s|$)")).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\bthe\\b')) AS n FROM documents")
def q33_whole_words(spark, d):
    return table(spark, d, "documents").select("doc_id", rx.count_matches(F.col("text"), r"(?-u:\b)the(?-u:\b)").cast("long").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\r\\n|\\n|\\r')) AS n FROM documents")
def q40_line_breaks(spark, d):
    return table(spark, d, "documents").select("doc_id", rx.count_matches(F.col("text"), r"\R").cast("long").alias("n"))


@query("SELECT p_partkey, length_grapheme(p_name) AS n FROM part")
def q41_graphemes(spark, d):
    return table(spark, d, "part").select("p_partkey", rx.count_matches(F.col("p_name"), r"\X").cast("long").alias("n"))


# --- splitting ----------------------------------------------------------------


@query("SELECT doc_id, len(string_split_regex(text, '[.,] ?')) AS n, md5(array_to_string(string_split_regex(text, '[.,] ?'), '|')) AS fields FROM documents")
def q12_split(spark, d):
    held = rx.split(F.col("text"), "[.,] ?")
    return table(spark, d, "documents").select("doc_id", F.size(held).cast("long").alias("n"), joined(held).alias("fields"))


@query("""
WITH a AS (SELECT doc_id, text, string_split_regex(text, ' +') AS g, regexp_extract_all(text, ' +') AS m FROM documents)
SELECT doc_id, md5(array_to_string(CASE WHEN len(g) <= 3 THEN g ELSE list_concat(g[1:2], [substr(text, length(g[1]) + length(m[1]) + length(g[2]) + length(m[2]) + 1)]) END, '|')) AS fields FROM a""")
def q13_split_n(spark, d):
    return table(spark, d, "documents").select("doc_id", joined(rx.split_n(F.col("text"), " +", 3)).alias("fields"))


@query("""
WITH a AS (SELECT doc_id, string_split_regex(text, '\\.') AS g FROM documents)
SELECT doc_id, md5(array_to_string(CASE WHEN len(g) > 1 AND g[-1] = '' THEN g[1:len(g)-1] ELSE g END, '|')) AS fields FROM a""")
def q14_split_terminator(spark, d):
    return table(spark, d, "documents").select("doc_id", joined(rx.split_terminator(F.col("text"), r"\.")).alias("fields"))


@query("""
WITH a AS (SELECT doc_id, string_split_regex(text, '[.!]') AS g, regexp_extract_all(text, '[.!]') AS m FROM documents),
b AS (SELECT doc_id, m, list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(m[i], '')) AS f FROM a)
SELECT doc_id, md5(array_to_string(CASE WHEN len(m) > 0 AND f[-1] = '' THEN f[1:len(f)-1] ELSE f END, '|')) AS fields FROM b""")
def q15_split_inclusive(spark, d):
    return table(spark, d, "documents").select("doc_id", joined(rx.split_inclusive(F.col("text"), "[.!]")).alias("fields"))


# --- replacing ----------------------------------------------------------------


@query("SELECT doc_id, md5(regexp_replace(text, '([a-z]+) ([a-z]+)', '\\2-\\1')) AS t FROM documents")
def q16_replace_first(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(rx.replace_first(F.col("text"), "([a-z]+) ([a-z]+)", "$2-$1")).alias("t"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'th[a-z]', '#'), 'th[a-z]', '#')) AS t FROM documents")
def q17_replace_n(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(rx.replace_n(F.col("text"), "th[a-z]", "#", 2)).alias("t"))


@query("SELECT doc_id, md5(regexp_replace(text, '([aeiou])([a-z])', '\\2$\\1', 'g')) AS t FROM documents")
def q18_replace_all(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(rx.replace_all(F.col("text"), "(?<v>[aeiou])([a-z])", "$2$$${v}")).alias("t"))


@query("SELECT p_partkey, regexp_replace(p_name, 'l*', '-', 'g') AS t FROM part")
def q18b_replace_nullable(spark, d):
    return table(spark, d, "part").select("p_partkey", rx.replace_all(F.col("p_name"), "l*", "-").alias("t"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS t FROM pages")
def q19_strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(rx.replace_all(F.col("html"), "<[^>]*>", "")).alias("t"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/?#]+)(/[^?#]*)?', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/?#]+)(/[^?#]*)?', 2) AS host, nullif(regexp_extract(url, '^([a-z]+)://([^/?#]+)(/[^?#]*)?', 3), '') AS path FROM pages")
def q20_url_parts(spark, d):
    held = rx.captures_struct(F.col("url"), r"^(?<scheme>[a-z]+)://(?<host>[^/?\#]+)(?<path>/[^?\#]*)?")
    return table(spark, d, "pages").select("page_id", held.alias("u")).select("page_id", "u.scheme", "u.host", "u.path")


@query(f"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '{EMAIL}', '<mail>', 'g'), '[0-9]{{3,}}', '<n>', 'g')) AS t FROM conversations")
def q21_redaction(spark, d):
    clean = rx.replace_all(rx.replace_all(F.col("text"), EMAIL, "<mail>"), "[0-9]{3,}", "<n>")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(clean).alias("t"))


# --- sets ---------------------------------------------------------------------

MEMBERS = ["[0-9]{3}", "licen[cs]e", r"[a-z]+@[a-z]+", "th[a-z]+ed", r"\*\*\*", "[A-Z]{5}"]
_HITS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {i} END" for i, p in enumerate(MEMBERS))
_ANY = " OR ".join(f"regexp_matches(text, '{p}')" for p in MEMBERS)
_AT = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN length(string_split_regex(text, '{p}')[1]) * 100 + {i} END" for i, p in enumerate(MEMBERS))


@query(f"SELECT doc_id, array_to_string(list_filter([{_HITS}], lambda x: x IS NOT NULL), ',') AS hits FROM documents")
def q22_set_matches(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(sets.set_matches(F.col("text"), sets.compile_set(MEMBERS)), ",").alias("hits"))


@query(f"SELECT doc_id FROM documents WHERE {_ANY}")
def q23_set_any(spark, d):
    return table(spark, d, "documents").filter(sets.set_match_p(F.col("text"), sets.compile_set(MEMBERS))).select("doc_id")


@query(f"WITH a AS (SELECT doc_id, list_min([{_AT}]) AS best FROM documents) SELECT doc_id, CAST(best % 100 AS INTEGER) AS member, CAST(best // 100 AS INTEGER) AS s FROM a WHERE best IS NOT NULL")
def q24_set_search(spark, d):
    found = table(spark, d, "documents").select("doc_id", sets.set_search(F.col("text"), sets.compile_set(MEMBERS)).alias("f")).filter("f IS NOT NULL")
    return found.select("doc_id", F.col("f.pattern_index").alias("member"), F.col("f.match.start").alias("s"))


_VALUES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(MEMBERS))


@query(f"SELECT CAST(p.id AS BIGINT) AS pattern_id, count(d.doc_id) AS hits FROM (VALUES {_VALUES}) AS p(id, pattern) LEFT JOIN documents d ON regexp_matches(d.text, p.pattern) GROUP BY p.id")
def q25_pattern_table(spark, d):
    patterns = spark.createDataFrame(list(enumerate(MEMBERS)), "pattern_id long, pattern string")
    return sets.hits_per_pattern(table(spark, d, "documents"), patterns)


@query("SELECT page_id, regexp_matches(html, 'http.//[a-z]+') AS b0, regexp_matches(html, '<table') AS b1, regexp_matches(html, '&[a-z]+;') AS b2 FROM pages")
def q25b_set_bits(spark, d):
    bits = sets.set_matches_bits(F.col("html"), sets.compile_set(["http.//[a-z]+", "<table", r"\&[a-z]+;"]))
    return table(spark, d, "pages").select("page_id", *(F.get(bits, F.lit(i)).alias(f"b{i}") for i in range(3)))


# --- lines --------------------------------------------------------------------

_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, len(string_split(text, chr(10))) AS n FROM documents), k AS (SELECT * FROM l WHERE NOT (line = '' AND line_no = n))"


@query(f"{_LINES} SELECT doc_id AS label, line_no, md5(line) AS line FROM k WHERE regexp_matches(line, 'licen[cs]e', 'i')")
def q26_grep(spark, d):
    held = lines.numbered_lines(table(spark, d, "documents"), label="doc_id")
    return grep.grep(held, "licen[cs]e", ignore_case=True).withColumn("line", F.md5("line"))


@query(f"{_LINES} SELECT doc_id AS label, coalesce(sum(CASE WHEN regexp_matches(line, '[0-9]') THEN 0 ELSE 1 END), 0)::BIGINT AS n FROM k GROUP BY doc_id")
def q26b_grep_count(spark, d):
    held = lines.numbered_lines(table(spark, d, "documents"), label="doc_id")
    return grep.grep(held, "[0-9]", invert=True, count=True)


# --- others -------------------------------------------------------------------


@query("SELECT p_partkey, regexp_full_match(p_name, regexp_escape(p_name)) AS same FROM part")
def q27_escape(spark, d):
    return table(spark, d, "part").select("p_partkey", F.rlike(F.col("p_name"), F.concat(F.lit(r"\A(?:"), rx.escape(F.col("p_name")), F.lit(r")\z"))).alias("same"))


@query("SELECT p_partkey, CAST(length(p_name) + 5 AS INTEGER) AS n FROM part")
def q34_recursion(spark, d):
    text = F.concat(F.lit("(("), F.col("p_name"), F.lit(")x)("))
    found = rx.scan(text, r"(?<paren>\((?:[^()]|(?&paren))*\))")
    return table(spark, d, "part").select("p_partkey", (found["end"] - found["start"]).alias("n"))


@query("""SELECT event_id, regexp_extract(regexp_replace(props, '"[^"]*"', '', 'g'), '[0-9]+') AS k FROM events""")
def q35_verbs(spark, d):
    return table(spark, d, "events").select("event_id", rx.match_text(F.col("props"), '"[^"]*"(*SKIP)(*FAIL)|[0-9]+').alias("k"))


@query("""
WITH s AS (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part),
l AS (SELECT p_partkey, min(least(levenshtein(substr(p_name, i, 4), 'ring'), levenshtein(substr(p_name, i, 3), 'ring'), levenshtein(substr(p_name, i, 5), 'ring'))) AS best FROM s GROUP BY p_partkey)
SELECT p_partkey, best <= 1 AS near FROM l""")
def q36_fuzzy(spark, d):
    return table(spark, d, "part").select("p_partkey", rx.fuzzy_scan(F.col("p_name"), "ring", 1).isNotNull().alias("near"))


@query("SELECT page_id, strlen(url) - length(regexp_replace(url, '[^a-z]', '', 'g')) AS n FROM pages")
def q37_bytes(spark, d):
    return table(spark, d, "pages").select("page_id", rx.count_matches(F.encode("url", "utf-8"), compile_bytes(r"(?-u:[^a-z])")).cast("long").alias("n"))


@query(SPANS_SQL)
def q38_buffered_stream(spark, d):
    cut = lines.chunks(table(spark, d, "documents"), 64, "doc_id")
    found = streams.all_stream_matches(cut, NUMBER, "doc_id")
    return found.select("doc_id", F.col("match.start").alias("s"), F.col("match.end").alias("e"))


@query(SPANS_SQL)
def q39_incremental_stream(spark, d):
    cut = lines.chunks(table(spark, d, "documents"), 4096, "doc_id")
    return streams.incremental_matches(cut, NUMBER, "doc_id").select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))


@query("""
WITH c AS (SELECT d.lang, d.doc_id, l.quality, len(regexp_extract_all(d.text, '[A-Z][a-z]+')) AS n FROM documents d JOIN labels l USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY n DESC, doc_id) AS place FROM c)
SELECT lang, quality, place, doc_id, n FROM r WHERE place <= 5""")
def q42_composition(spark, d):
    counted = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").select("lang", "doc_id", "quality", rx.count_matches(F.col("text"), "[A-Z][a-z]+").cast("long").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "quality").orderBy(F.desc("n"), "doc_id"))
    return counted.withColumn("place", place.cast("long")).filter("place <= 5").select("lang", "quality", "place", "doc_id", "n")


#: Four plain workloads.
WORKLOADS = {"literal": "needle", "identifier": r"^[A-Za-z_][A-Za-z0-9_]*$", "alternation": "^(cat|dog|fox)+$", "search": "[0-9]{3}[a-z]{5}"}
#: Texts on both sides of each, by the part's number: some end in what the workload looks for, some don't.
_SAID = "(CASE p_partkey % 5 WHEN 0 THEN p_name || 'needle' WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN repeat('cat', p_size % 4) || 'dog' WHEN 3 THEN p_name || p_partkey || 'abcde' ELSE p_name END)"


@query("SELECT p_partkey, " + ", ".join(f"regexp_matches({_SAID}, '{p}') AS {n}" for n, p in WORKLOADS.items()) + " FROM part")
def q43_workloads(spark, d):
    said = F.expr(_SAID.replace("p_size % 4", "cast(p_size % 4 as int)"))
    return table(spark, d, "part").select("p_partkey", *(rx.is_match(said, compile_pattern(p)).alias(n) for n, p in WORKLOADS.items()))


# --- syntax and options -------------------------------------------------------


@query("""SELECT event_id, nullif(regexp_extract(props, '"k": ([0-9]+)', 1), '') AS k FROM events""")
def q44_keep(spark, d):
    return table(spark, d, "events").select("event_id", rx.match_text(F.col("props"), r'"k": \K[0-9]+').alias("k"))


@query("SELECT p_partkey, nullif(regexp_extract(p_name, '^[a-z]+ [a-z]+'), '') AS t FROM part")
def q45_atomic_possessive(spark, d):
    return table(spark, d, "part").select("p_partkey", rx.match_text(F.col("p_name"), "^[a-z]++ (?>[a-z]+)").alias("t"))


@query("SELECT doc_id, CASE WHEN starts_with(text, 'The') THEN 'The' WHEN regexp_matches(text, '^[A-Z]') THEN substr(text, 1, 1) END AS t FROM documents")
def q46_conditional(spark, d):
    return table(spark, d, "documents").select("doc_id", rx.match_text(F.col("text"), "^(?:(?=(The))|)(?(1)The|[A-Z])").alias("t"))


@query("SELECT p_partkey, regexp_extract(p_brand, 'Brand#([0-9])', 1) AS a, nullif(regexp_extract(p_brand, 'Brand#[0-9]([0-9])', 1), '') AS b FROM part")
def q47_branch_reset(spark, d):
    held = rx.match_captures(F.col("p_brand"), r"(?|x(y)(z)|Brand\#([0-9])([0-9])?)")
    return table(spark, d, "part").select("p_partkey", F.get(held, F.lit(1)).alias("a"), F.get(held, F.lit(2)).alias("b"))


@query("SELECT p_partkey, p_size % 5 = p_partkey % 5 AS balanced FROM part")
def q48_balancing(spark, d):
    size, key = (F.col("p_size") % 5).cast("int"), (F.col("p_partkey") % 5).cast("int")
    text = F.concat(F.repeat(F.lit("<"), size), F.lit("-"), F.repeat(F.lit(">"), key))
    pattern = r"\A(?<open><)*-(?<-open>>)*(?(open)(*FAIL))\z"
    return table(spark, d, "part").select("p_partkey", rx.is_match(text, pattern).alias("balanced"))


def _bracket(found, text):
    return f"[{found.string(text)}]"


@query("SELECT p_partkey, regexp_replace(p_name, '([aeiou]+)', '[\\1]', 'g') AS t FROM part")
def q49_replace_function(spark, d):
    return table(spark, d, "part").select("p_partkey", rx.replace_all(F.col("p_name"), "[aeiou]+", _bracket).alias("t"))


@query("SELECT c_custkey, CAST(9 AS INTEGER) AS s, CAST(9 + length(regexp_extract(c_name, '#(0*)', 1)) AS INTEGER) AS e FROM customer")
def q50_group_spans(spark, d):
    held = rx.match_group_span(F.col("c_name"), r"\#(?<zeros>0*)", "zeros")
    return table(spark, d, "customer").select("c_custkey", held["start"].alias("s"), held["end"].alias("e"))


@query("SELECT c_custkey, CAST(12 + length(regexp_extract(substr(c_name, 13), '^[0-9]*?[1-9]')) AS INTEGER) AS e FROM customer WHERE regexp_matches(substr(c_name, 13), '[1-9]')")
def q51_scan_at(spark, d):
    found = table(spark, d, "customer").select("c_custkey", rx.scan_at(F.col("c_name"), "[1-9]", 12).alias("m")).filter("m IS NOT NULL")
    return found.select("c_custkey", F.col("m.end").alias("e"))


@query("SELECT p_partkey, regexp_extract(p_name, '^([a-z]+) ([a-z]+)$', 2) AS noun FROM part WHERE regexp_full_match(p_name, '[a-z]+ [a-z]+')")
def q52_full_match_captures(spark, d):
    found = table(spark, d, "part").select("p_partkey", rx.full_match(F.col("p_name"), "([a-z]+) ([a-z]+)").alias("m")).filter("m IS NOT NULL")
    return found.select("p_partkey", F.get("m.groups", F.lit(2))["text"].alias("noun"))


@query("SELECT doc_id, CAST(length(string_split_regex(text, '[0-9]+')[1]) AS INTEGER) AS s FROM documents WHERE regexp_matches(text, '[0-9]+')")
def q54_scan_stream(spark, d):
    cut = lines.chunks(table(spark, d, "documents"), 1000, "doc_id")
    return streams.scan_stream(cut, NUMBER, "doc_id").filter("match IS NOT NULL").select("doc_id", F.col("match.start").alias("s"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)^[A-Z]')) AS n FROM documents")
def q56_multi_line(spark, d):
    return table(spark, d, "documents").select("doc_id", rx.count_matches(F.col("text"), "^[A-Z]", multi_line=True).cast("long").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[[:upper:]][[:alpha:]]+')) AS n, len(regexp_extract_all(text, '\\p{Lu}')) AS u FROM documents")
def q57_classes(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", rx.count_matches(text, "[[:upper:]][[:alpha:]]+").cast("long").alias("n"), rx.count_matches(text, r"\p{Lu}").cast("long").alias("u"))


@query("SELECT page_id, md5(regexp_extract(html, '(?s)<article>.*</article>')) AS whole, regexp_extract(html, '(?U)<.*>') AS lazy FROM pages")
def q58_dotall_and_greed(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.md5(rx.match_text(html, "<article>.*</article>", dot_matches_new_line=True)).alias("whole"), rx.match_text(html, "<.*>", swap_greed=True).alias("lazy"))


@query("SELECT page_id, contains(html, '<br><p>') AS a, regexp_matches(html, '(?i)DOCTYPE HTML') AS b FROM pages")
def q59_literal(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", rx.is_match(html, "<br><p>", literal=True).alias("a"), rx.is_match(html, "DOCTYPE HTML", literal=True, case_insensitive=True).alias("b"))


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[^\\n]+'), '|')) AS t FROM documents")
def q60_never_newline(spark, d):
    return table(spark, d, "documents").select("doc_id", joined(rx.all_texts(F.col("text"), r"[\s\S]+", never_newline=True)).alias("t"))


@query("SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(url, '^https') THEN 0 END, CASE WHEN regexp_matches(url, '[0-9]+') THEN 1 END, CASE WHEN regexp_matches(url, 'org') THEN 2 END], lambda x: x IS NOT NULL), ',') AS hits FROM pages")
def q61_byte_set(spark, d):
    held = sets.compile_byte_set(["^https", r"(?-u:[0-9])+", "org"])
    return table(spark, d, "pages").select("page_id", F.array_join(sets.set_matches(F.encode("url", "utf-8"), held), ",").alias("hits"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?:^|[^a-z])the')) AS n FROM documents")
def q62_negative_lookbehind(spark, d):
    return table(spark, d, "documents").select("doc_id", rx.count_matches(F.col("text"), "(?<![a-z])the").cast("long").alias("n"))


@query("SELECT n_nationkey, CASE WHEN n_name ILIKE 'f%' THEN 'F' ELSE 'other' END AS k FROM nation")
def q63_case_folding(spark, d):
    hit = rx.is_match(F.col("n_name"), r"\A(?i:f)")
    return table(spark, d, "nation").select("n_nationkey", F.when(hit, "F").otherwise("other").alias("k"))


@query("SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN regexp_matches(o_orderpriority, '^[12]-') THEN 1 ELSE 0 END)::BIGINT AS high FROM orders GROUP BY o_orderpriority")
def q64_grouped(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(rx.is_match(F.col("o_orderpriority"), "^[12]-").cast("long")).alias("high"))


@query("SELECT doc_id, CAST(length(string_split_regex(text, 'th[a-z]')[1]) AS INTEGER) AS s, regexp_extract(text, 'th[a-z]') AS t FROM documents WHERE regexp_matches(text, 'th[a-z]')")
def q65_sql_names(spark, d):
    from .functions import sql

    sql.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("gristmill_documents")
    return spark.sql("SELECT doc_id, m.start AS s, m.text AS t FROM gristmill_documents, LATERAL rx_matches(text, 'th[a-z]') m WHERE m.nth = 0")


from . import queries_language  # noqa: E402,F401  fills the tables above
