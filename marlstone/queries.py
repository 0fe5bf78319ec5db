"""Registered queries of the library and the DuckDB SQL that gives the same rows.

Messages are the `documents`, patterns the `benchmark` items, persons and
payloads are made from `customer` and `orders` by fixed rules.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import extract, text
from .operators import classifier, eligibility, payments, scoring, similarity, span_join, spans
from .message_cases import CONTEXT_CASES, FOLD_CASES, PAYLOAD_CASES, SIGNAL_CASES
from .operators import signals as signal_rules
from .plans import check
from .plans.logic import Scope, name_of, truth
from .sources import packs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def literal(x) -> str:
    """A value as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]"
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values_sql(columns: dict[str, str], rows: list[tuple]) -> str:
    """SQL for rows known in advance: a column `case_no` and the given ones, by name and type."""
    body = ", ".join(f"({k}, {', '.join(map(literal, r))})" for k, r in enumerate(rows))
    return f"SELECT case_no, {', '.join(f'{c}::{t} AS {c}' for c, t in columns.items())} FROM (VALUES {body}) v(case_no, {', '.join(columns)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- similarity

GRAMS_SQL = """
words AS (SELECT side, id, ' ' || w || ' ' AS w FROM (
  SELECT side, id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM texts) WHERE w <> ''),
grams AS (SELECT side, id, substr(w, k::INT, n::INT) AS term
  FROM words, (VALUES (3), (4), (5)) v(n), LATERAL (SELECT unnest(range(1, greatest(length(w) - n + 2, CASE WHEN n = 3 THEN 2 ELSE 1 END))) AS k)),
tf AS (SELECT side, id, term, count(*) AS tf FROM grams GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)) + 1 AS idf FROM tf WHERE side = 'p' GROUP BY term),
w AS (SELECT side, id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
unit AS (SELECT side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM w),
sims AS (SELECT q.id AS doc_id, p.id AS item_id, sum(q.w * p.w) AS s FROM unit q JOIN unit p ON q.term = p.term AND q.side = 'q' AND p.side = 'p' GROUP BY ALL),
best AS (SELECT doc_id, item_id, s FROM sims QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, item_id) = 1)
"""
BOTH_SQL = "WITH texts AS (SELECT 'q' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'p', item_id, text FROM benchmark)," + GRAMS_SQL
PATTERNS_SQL = "WITH texts AS (SELECT 'p' AS side, item_id AS id, text FROM benchmark)," + GRAMS_SQL.split("idf AS")[0].rstrip().rstrip(",")


def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.best_match(table(spark, sf_dir, "documents").hint("rebalance"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(BOTH_SQL + "SELECT d.doc_id, coalesce(item_id, (SELECT min(item_id) FROM benchmark)) AS item_id, round(coalesce(s, 0), 6) AS similarity FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN best USING (doc_id)")
def pattern_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_matches(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(BOTH_SQL + "SELECT doc_id, item_id, 'c' || (item_id % 5) AS category FROM best WHERE s >= 0.55")
def pattern_match_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("c"), F.col("item_id") % 5).alias("category"))
    return best_matches(spark, sf_dir).where("similarity >= 0.55").join(patterns, "item_id").select("doc_id", "item_id", "category")


@query(PATTERNS_SQL + " SELECT id AS item_id, term, tf FROM tf")
def ngram_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.term_counts(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(PATTERNS_SQL + " SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)) + 1, 9) AS idf FROM tf GROUP BY term")
def pattern_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = table(spark, sf_dir, "benchmark")
    weights = similarity.pattern_weights(patterns, "item_id", "text")
    return weights.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.round(F.max("idf"), 9).alias("idf"))


@query(BOTH_SQL + "SELECT doc_id, item_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, item_id)::INT AS rank FROM sims QUALIFY rank <= 3")
def pattern_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.top_matches(table(spark, sf_dir, "documents").hint("rebalance"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.withColumn("similarity", F.round("similarity", 6)).select("doc_id", "item_id", "similarity", "rank")


CONTAINS_BLOCK = 1000


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def pattern_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of items whose whole text a document holds: candidates hold its longest inner word, then the text is compared.

    The first and last word may lie within longer words of the document; an inner one may not. Items of one or two
    words have no inner word: they are looked for in each document, CONTAINS_BLOCK of them in a pass.
    """
    pieces = F.split("text", " ")
    inner = F.array_max(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    items = items.where(F.col("text").isNotNull()).select("item_id", F.col("text").alias("item"), inner["w"].alias("w"))
    docs = docs.select("doc_id", "text")
    candidates = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w")).join(items, "w").select("doc_id", "item_id", "item")
    found = candidates.join(docs, "doc_id").where(F.contains("text", "item")).select("doc_id", "item_id")
    short = items.where("w IS NULL").select("item_id", "item").toLocalIterator()
    while block := list(islice(short, CONTAINS_BLOCK)):
        known = F.array(*(F.struct(F.lit(r["item_id"]).alias("item_id"), F.lit(r["item"]).alias("item")) for r in block))
        own = docs.select("doc_id", F.explode(F.filter(known, lambda x: F.contains("text", x["item"]))).alias("x")).select("doc_id", "x.item_id")
        found = found.unionByName(own)
    return found


# ---------------------------------------------------------------- text and entities

ROMAN = "', '".join(sorted(extract.ROMAN_HINDI))


@query("SELECT doc_id, length(text) - length(regexp_replace(text, '[\\x{0900}-\\x{097f}]', '', 'g')) AS devanagari, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS latin FROM documents")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count("[ऀ-ॿ]").alias("devanagari"), count("[A-Za-z]").alias("latin"))


LANGUAGE_SQL = f"""CASE WHEN dev > 0 AND dev >= 0.4 * (dev + lat) THEN 'hi'
  WHEN len(ws) > 0 AND len(list_filter(ws, lambda w: w IN ('{ROMAN}'))) >= greatest(2, len(ws) // 8) THEN 'hinglish' ELSE 'en' END"""


def _language_sql(key: str, source: str) -> str:
    counts = "len(regexp_extract_all(text, '[\\x{0900}-\\x{097f}]')) AS dev, len(regexp_extract_all(text, '[A-Za-z]')) AS lat, regexp_extract_all(lower(text), '[a-z]+') AS ws"
    return f"SELECT {key}, {LANGUAGE_SQL} AS lang_class FROM (SELECT {key}, {counts} FROM {source})"


@query(_language_sql("doc_id", "documents"))
def language_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", extract.language_col(F.col("text")).alias("lang_class"))


@query(f"SELECT lang_class, count(*) AS turns FROM ({_language_sql('conv_id', 'conversations')}) GROUP BY lang_class")
def conversation_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(extract.language_col(F.col("text")).alias("lang_class")).agg(F.count(F.lit(1)).alias("turns"))


#: A letter of some scripts that aren't read, in the order in which they are tried.
SOME_SCRIPTS = ("bn", "ta", "ur", "mni")
SOME_LETTERS = ("ক", "அ", "ا", "ꯀ")


@query(f"""SELECT o_orderkey, CASE WHEN o_custkey % 7 = 6 AND o_orderkey % 3 < 2 THEN 'mr' WHEN o_custkey % 7 < 6 AND n >= 8 AND n >= 0.25 * (n + latin) THEN {literal(list(SOME_SCRIPTS))}[(o_custkey % 4 + 1)::INT] END AS unread
  FROM (SELECT o_orderkey, o_custkey, o_orderkey % 17 AS n, o_custkey % 40 AS latin FROM orders)""")
def unread_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up texts: some letters of a script beside Latin ones, or Marathi words beside Hindi ones."""
    letter = F.element_at(F.lit(list(SOME_LETTERS)), (F.col("o_custkey") % 4 + 1).cast("int"))
    mixed = F.concat(F.repeat(letter, (F.col("o_orderkey") % 17).cast("int")), F.lit(" "), F.repeat(F.lit("x"), (F.col("o_custkey") % 40).cast("int")))
    words = F.concat(F.lit("आहे आणि "), F.repeat(F.lit("है "), (F.col("o_orderkey") % 3).cast("int")))
    made = F.when(F.col("o_custkey") % 7 == 6, words).otherwise(mixed)
    return table(spark, sf_dir, "orders").select("o_orderkey", extract.unread_script_col(made).alias("unread"))


DIGITS_SQL = "lpad((o_custkey % 100000)::VARCHAR, 5, '0')"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN ['98765' || {DIGITS_SQL}] WHEN o_orderkey % 6 = 3 THEN ['98765' || {DIGITS_SQL}, '61234' || {DIGITS_SQL}] ELSE [] END::VARCHAR[] AS mobiles FROM orders""")
def extract_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of made-up messages: with a country code, with a 0, twice in two writings, two of them, of a first digit that no mobile has, too long."""
    tail = F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    made = [join("call +91 98765 ", tail, "."), join("ring 098765", tail), join("98765-", tail, " and 98765", tail), join("98765", tail, " or 61234 ", tail), join("51234", tail), join("9876543", tail)]
    text_ = F.element_at(F.array(*made), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", extract.mobiles_col(text_).alias("mobiles"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')) AS n_quads FROM documents WHERE regexp_matches(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')")
def extract_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")).cast("long").alias("n_quads"))
    return found.where("n_quads > 0")


@query("SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\\.[A-Za-z]+') AS emails FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\\.[A-Za-z]+')")
def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+"), F.lit(0)).alias("emails"))
    return found.where(F.size("emails") > 0)


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ['shop' || c_custkey || '@okbank'] WHEN 1 THEN ['a.' || c_custkey || '-b@ybl', 'c' || c_custkey || '@upi'] WHEN 2 THEN ['s' || c_custkey || '@ab'] ELSE [] END::VARCHAR[] AS upi_ids FROM customer""")
def extract_upi_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles of made-up messages: beside a mail address, two of them, one written twice, none with a dot after it, none with one sign before the @."""
    key = F.col("c_custkey").cast("string")
    forms = ("pay to Shop#@okbank now or mail a#@mail.com", "A.#-b@ybl or c#@UPI!", "s#@ab and S#@AB", "mail me: x#@post.in", "x@y or #@9ab")
    message = F.element_at(F.array(*(F.replace(F.lit(f), F.lit("#"), key) for f in forms)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", extract.handles_col(message).alias("upi_ids"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN [(n * 1000)::DOUBLE, (n % 90 + 10) * 100000.0] WHEN 1 THEN [n + 0.5::DOUBLE] WHEN 2 THEN [(n % 9 + 1) * 1e7] WHEN 3 THEN [100000.0 + n % 1000]
  WHEN 4 THEN [n::DOUBLE] ELSE [] END::DOUBLE[] AS amounts FROM (SELECT o_orderkey, o_custkey % 1000 + 1000 AS n FROM orders)""")
def extract_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of made-up messages: two with the currency first and last, paise, crores, Indian commas, "/-", and numbers that are no amounts."""
    n = F.col("o_custkey") % 1000 + 1000
    word = lambda x: x.cast("string")
    made = [
        F.concat(F.lit("pay rs "), word(n * 1000), F.lit(" or "), word(n % 90 + 10), F.lit(" lakh rupees")), F.concat(F.lit("₹"), word(n), F.lit(".50 due")),
        F.concat(word(n % 9 + 1), F.lit(" crore रुपये")), F.concat(F.lit("INR 1,00,"), F.lpad(word(n % 1000), 3, "0")), F.concat(word(n), F.lit("/-")), F.concat(F.lit("call "), word(n), F.lit(" or rsvp 5")),
    ]
    return table(spark, sf_dir, "orders").select("o_orderkey", extract.amounts_col(F.element_at(F.array(*made), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("amounts"))


@query()
def amounts_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The money that each document asks for."""
    folded = table(spark, sf_dir, "documents").select("doc_id", text.fold_col("text").alias("norm"))
    return folded.select("doc_id", extract.amounts_col("norm").alias("amounts"), extract.money_at_risk_col("norm").alias("rupees_at_risk"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '1600' WHEN 1 THEN 'mobile' WHEN 2 THEN 'dlt' ELSE 'other' END AS kind FROM customer")
def sender_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0")
    sender = F.element_at(F.array(F.concat(F.lit("1600"), number), F.concat(F.lit("+91 98765 "), F.substring(number, 2, 5)), F.lit("AX-SHOPIN-T"), F.col("c_name")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", extract.sender_kind_col(sender).alias("kind"))


HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '')"


@query(f"SELECT page_id, {HOST_SQL} AS host, string_split({HOST_SQL}, '.')[-1] AS tld FROM pages")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.slice(extract.links_col("url"), 1, 1)).alias("x"))
    return found.select("page_id", "x.host", "x.tld")


@query(f"SELECT tld, count(DISTINCT host) AS hosts, count(*) AS pages FROM (SELECT {HOST_SQL} AS host, string_split({HOST_SQL}, '.')[-1] AS tld FROM pages) GROUP BY tld")
def host_tld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_hosts(spark, sf_dir).groupBy("tld").agg(F.count_distinct("host").alias("hosts"), F.count(F.lit(1)).alias("pages"))


@query(f"SELECT page_id FROM (SELECT page_id, {HOST_SQL} AS host FROM pages) WHERE host LIKE '%.example.org' OR host = 'example.net' OR host LIKE '%.example.net'")
def host_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official hosts: a join of each host's suffixes with the list of domains."""
    official = spark.createDataFrame([("example.org", False), ("example.net", True)], "suffix string, itself boolean")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("suffix"), (k == 1).alias("whole")))
    own = url_hosts(spark, sf_dir).select("page_id", F.explode(suffixes).alias("s")).select("page_id", "s.*")
    return own.join(F.broadcast(official), "suffix").where(~F.col("whole") | F.col("itself")).select("page_id").distinct()


@query(f"SELECT page_id, CASE WHEN len(list_filter(parts, lambda p: starts_with(p, 'thth') OR ends_with(p, 'thth'))) > 0 THEN 'thth' ELSE 'm' END AS token FROM (SELECT page_id, string_split(replace(array_to_string(string_split({HOST_SQL}, '.')[:-2], '.'), '-', '.'), '.') AS parts FROM pages) WHERE len(list_filter(parts, lambda p: starts_with(p, 'thth') OR ends_with(p, 'thth') OR starts_with(p, 'm'))) > 0 AND (len(list_filter(parts, lambda p: starts_with(p, 'thth') OR ends_with(p, 'thth'))) > 0 OR len(list_filter(parts, lambda p: starts_with(p, 'm'))) > 0)")
def host_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand that a part of the host begins or ends with, the longest first."""
    parts = F.flatten(F.transform(F.slice(F.split("host", r"\."), 1, F.size(F.split("host", r"\.")) - 1), lambda x: F.split(x, "-")))
    found = F.coalesce(*(F.when(F.exists(parts, _token(t)), F.lit(t)) for t in ("thth", "m")))
    return url_hosts(spark, sf_dir).select("page_id", found.alias("token")).where("token IS NOT NULL")


def _token(token: str):
    return lambda p: p.startswith(token) | (p.endswith(token) if len(token) > 3 else F.lit(False))


@query(f"SELECT p.page_id FROM pages p WHERE split_part({HOST_SQL.replace('url', 'p.url')}, '.', 1) IN ('m', 'www2')")
def semi_shortener(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = spark.createDataFrame([("m",), ("www2",)], "first string")
    return url_hosts(spark, sf_dir).withColumn("first", F.split_part("host", F.lit("."), F.lit(1))).join(F.broadcast(short), "first", "left_semi").select("page_id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (l.toxic = 1 OR l.quality = 0))")
def anti_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "labels").where("toxic = 1 OR quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(flagged, "doc_id", "left_anti")


@query("SELECT doc_id, regexp_matches(lower(text), '(?s)(?:^|[^a-z0-9])that(?:[^a-z0-9].{0,38}[^a-z0-9]|[^a-z0-9])with(?:$|[^a-z0-9])') OR regexp_matches(lower(text), '(?s)(?:^|[^a-z0-9])with(?:[^a-z0-9].{0,38}[^a-z0-9]|[^a-z0-9])that(?:$|[^a-z0-9])') AS is_near FROM documents")
def near_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two phrases stand within 40 signs of each other."""
    first, second = spans.lexicon(["that"]), spans.lexicon(["with"])

    def close(t: str) -> bool:
        return spans.near([m.span() for m in first.finditer(t)], [m.span() for m in second.finditer(t)], 40)

    return table(spark, sf_dir, "documents").select("doc_id", text.udf(close, "boolean")(F.lower("text")).alias("is_near"))


WORD_SPANS_SQL = """WITH tokens AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '{pattern}') AS t FROM documents)),
placed AS (SELECT doc_id, token, (sum(length(token)) OVER (PARTITION BY doc_id ORDER BY k))::INT AS "end" FROM tokens), spans AS (SELECT doc_id, token, ("end" - length(token))::INT AS start, "end" FROM placed)
"""
WORDS_SQL = WORD_SPANS_SQL.format(pattern="[a-z0-9]+|[^a-z0-9]+")


def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two words in all documents, from one pass of the phrase automaton."""
    found = span_join.phrase_spans_col({"that": ["that"], "with": ["with"]})(F.lower("text"))
    return span_join.exploded(table(spark, sf_dir, "documents"), "doc_id", found)


@query(WORDS_SQL + """SELECT a.doc_id, a.start, b.start AS right_start FROM spans a JOIN spans b ON a.doc_id = b.doc_id
WHERE a.token = 'that' AND b.token = 'with' AND greatest(b.start - a."end", a.start - b."end", 0) <= 60""")
def span_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spans at most 60 signs apart, as a join by bins of offsets."""
    found = word_spans(spark, sf_dir)
    return span_join.near_join(found.where("name = 'that'"), found.where("name = 'with'"), "doc_id", 60).select("doc_id", "start", "right_start")


@query(WORDS_SQL + """, lines AS (SELECT doc_id, line, start FROM (SELECT doc_id, line, k, (sum(length(line)) OVER (PARTITION BY doc_id ORDER BY k) - length(line))::INT AS start
  FROM (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^\n]+|\n+') AS t FROM documents))) WHERE line[1] <> chr(10))
SELECT s.doc_id, s.start, l.start AS right_start FROM spans s JOIN lines l ON s.doc_id = l.doc_id AND s.start >= l.start AND s."end" <= l.start + length(l.line) WHERE s.token = 'that'""")
def span_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and the lines that they lie in."""
    lines = span_join.exploded(table(spark, sf_dir, "documents"), "doc_id", span_join.pattern_spans_col({"line": r"[^\n]+"})(F.lower("text")))
    return span_join.inside_join(word_spans(spark, sf_dir).where("name = 'that'"), lines, "doc_id").select("doc_id", "start", "right_start")


@query(WORDS_SQL + """SELECT a.doc_id, a.start, min(CASE WHEN b.start IS NOT NULL THEN greatest(b.start - a."end", a.start - b."end", 0) END)::INT AS distance FROM spans a LEFT JOIN spans b ON a.doc_id = b.doc_id AND b.token = 'with' WHERE a.token = 'that' GROUP BY ALL""")
def span_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the nearest span of another word is, for each span of one."""
    found = word_spans(spark, sf_dir)
    return span_join.nearest(found.where("name = 'that'"), found.where("name = 'with'"), "doc_id").select("doc_id", "start", "distance")


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[ \\t]+', ' ', 'g'), '\\s*[\\[({]\\s*(?:\\.|dot)\\s*[\\])}]\\s*', '.', 'g'), E' \\t\\n\\r') AS folded FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7f]*')")
def fold_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("^[\\x00-\\x7f]*$"))
    return docs.select("doc_id", text.fold_ascii(F.col("text")).alias("folded"))


@query()
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fold_col("text").alias("folded"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['S' || 'В' || 'I' || p_size] WHEN 2 THEN ['p' || 'α', 'q' || 'ж' || p_size] ELSE [] END::VARCHAR[] AS mixed FROM part")
def token_mixed_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of made-up names: plain, one with a Cyrillic letter, two mixed, and whole words of another script."""
    size = F.col("p_size").cast("string")
    made = [F.concat("p_name", F.lit(" "), size), F.concat(F.lit("SВI"), size, F.lit(" bank")), F.concat(F.lit("pα, (qж"), size, F.lit(")")), F.concat(F.lit("слово λόγος "), size)]
    return table(spark, sf_dir, "part").select("p_partkey", text.mixed_script_col(F.element_at(F.array(*made), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("mixed"))


@query(values_sql({"folded": "VARCHAR"}, [(f,) for _, f in FOLD_CASES]))
def fold_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(FOLD_CASES)], "case_no int, text string")
    return made.select("case_no", text.fold_col("text").alias("folded"))


@query(values_sql({"signals": "VARCHAR[]"}, [(signals,) for *_, signals in SIGNAL_CASES]))
def signal_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fired signals of messages whose signals are known."""
    made = spark.createDataFrame([(k, t, s, i) for k, (t, s, i, _) in enumerate(SIGNAL_CASES)], "case_no int, text string, sender string, kind string").hint("rebalance")
    fired = signal_rules.signals_col(spark, packs.SIGNALS)("text", "sender", "kind")
    return made.select("case_no", F.transform(fired, lambda x: x["id"]).alias("signals"))


CONTEXT_COLUMNS = {"lang": "VARCHAR", "sender_kind": "VARCHAR", "hosts": "VARCHAR[]", "mobiles": "VARCHAR[]", "amounts": "DOUBLE[]", "rupees_at_risk": "DOUBLE"}


@query(values_sql(CONTEXT_COLUMNS, [r[2:] for r in CONTEXT_CASES]))
def context_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(CONTEXT_CASES)], "message_id int, text string, sender string").withColumn("input_type", F.lit("text"))
    found = check.context(made).withColumn("hosts", F.transform("urls", lambda x: x["host"]))
    return found.select(F.col("message_id").alias("case_no"), *CONTEXT_COLUMNS)


PAYLOAD_COLUMNS = {"kind": "VARCHAR", "amount_text": "VARCHAR", "flags": "VARCHAR[]", "n_facts": "INT", "check_text": "VARCHAR"}


@query(values_sql(PAYLOAD_COLUMNS, [r[1:] for r in PAYLOAD_CASES]))
def payload_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(k, r[0]) for k, r in enumerate(PAYLOAD_CASES)], "case_no int, payload string")
    found = made.select("case_no", payments.analyse_col("payload").alias("q"))
    return found.select("case_no", "q.kind", "q.amount_text", "q.flags", F.size("q.facts").alias("n_facts"), "q.check_text")


@query(values_sql({"bucket": "INT", "n": "INT"}, [(27654, 1)]))
def murmur_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the n-grams of "abc", that of the word itself, whose bucket is known."""
    found = spark.createDataFrame([(0, "abc")], "case_no int, text string").select("case_no", F.explode(classifier.ngram_buckets(F.col("text"))).alias("b"))
    return found.select("case_no", F.col("b.bucket").cast("int").alias("bucket"), F.col("b.n").cast("int").alias("n")).where("bucket = 27654")


@query()
def murmur_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "benchmark").select("item_id", F.explode(classifier.ngram_buckets(F.col("text"))).alias("b"))
    return found.select("item_id", "b.bucket", "b.n")


@query("SELECT event_id, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE))::INT AS age_days, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) > 45 AS stale FROM events")
def pack_age_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.lit("2020-01-01")
    return table(spark, sf_dir, "events").select("event_id", packs.pack_age_days(date, F.col("ts")).alias("age_days"), packs.is_stale(date, F.col("ts")).alias("stale"))


@query("SELECT conv_id, list(role ORDER BY turn)[:3] AS roles FROM conversations GROUP BY conv_id")
def first_k_by_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.slice(rows, 1, 3), lambda r: r["role"]).alias("roles"))


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, sum(length(text))::BIGINT AS chars, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def conversation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("role").alias("roles"), F.sum(F.length("text").cast("long")).alias("chars"), F.min_by("role", "turn").alias("first_role"))


# ---------------------------------------------------------------- scoring

#: Made-up signals of a document: (id, weight, hard, condition in SQL that both engines take).
MADE = [
    ("kyc_mention", 0.4, False, "n_chars % 2 = 0"), ("urgency", 0.6, False, "n_chars % 3 = 0"), ("prize", 1.5, False, "n_chars % 5 = 0"), ("advance_fee", 1.8, False, "n_chars % 7 = 0"),
    ("dlt_sender", -0.6, False, "n_chars % 4 = 1"), ("advisory", -1.0, False, "n_chars % 11 = 0"), ("otp_request", 3.0, True, "n_chars % 13 = 0"), ("easy_money_weak", 0.4, False, "lang = 'fr'"),
]
PRIORITY = {k: v["priority"] for k, v in packs.SIGNALS["categories"].items()}


def made_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    rows = F.array(*(F.when(F.expr(c), F.struct(F.lit(k).alias("ord"), F.lit(i).alias("id"), F.lit(w).alias("weight"), F.lit(h).alias("hard"), none.alias("evidence"), F.lit(None).cast("string").alias("category"))) for k, (i, w, h, c) in enumerate(MADE)))
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(rows, lambda s: s.isNotNull()).cast(scoring.FIRED).alias("fired"), F.lit(None).cast("string").alias("unread"))


def _made_sql() -> str:
    parts = []
    for k, (i, w, h, c) in enumerate(MADE):
        cat = packs.SIGNALS["signals"][i].get("category")
        show = packs.SIGNALS["signals"][i].get("show", True)
        parts.append(f"SELECT doc_id, {k} AS ord, '{i}' AS id, {w}::DOUBLE AS weight, {h} AS hard, {f"'{cat}'" if cat else 'NULL'} AS category, {PRIORITY.get(cat, 0)} AS priority, {show} AS shown FROM documents WHERE {c}")
    return "WITH fired AS (" + " UNION ALL ".join(parts) + """),
scores AS (SELECT d.doc_id, round(coalesce(sum(weight) FILTER (weight > 0), 0) + greatest(coalesce(sum(weight) FILTER (weight < 0), 0), -3), 3) AS risk_score,
  coalesce(bool_or(hard), false) AS hard FROM documents d LEFT JOIN fired f USING (doc_id) GROUP BY d.doc_id),
levels AS (SELECT *, CASE WHEN hard OR risk_score >= 3 THEN 'scam' WHEN risk_score >= 1.5 THEN 'suspicious' ELSE 'no_signs' END AS verdict FROM scores)"""


@query(_made_sql() + " SELECT doc_id, risk_score FROM scores")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(made_signals(spark, sf_dir), packs.SIGNALS).select("doc_id", "risk_score")


@query(_made_sql() + " SELECT doc_id, verdict, hard AS hard_signal, round(CASE WHEN hard THEN greatest(1 / (1 + exp(-1.5 * (risk_score - 2.25))), 0.97) ELSE 1 / (1 + exp(-1.5 * (risk_score - 2.25))) END, 3) AS confidence FROM levels")
def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(made_signals(spark, sf_dir), packs.SIGNALS).select("doc_id", "verdict", "hard_signal", "confidence")


@query(_made_sql() + """, sums AS (SELECT doc_id, category, sum(weight + CASE WHEN hard THEN 10 ELSE 0 END) AS total, any_value(priority) AS priority, min(ord) AS first FROM fired WHERE weight > 0 AND category IS NOT NULL GROUP BY doc_id, category)
SELECT l.doc_id, CASE WHEN verdict <> 'no_signs' THEN coalesce(s.category, 'generic') END AS category FROM levels l
LEFT JOIN (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, priority DESC, first) = 1) s USING (doc_id)""")
def category_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(made_signals(spark, sf_dir), packs.SIGNALS).select("doc_id", "category")


@query(_made_sql() + """ SELECT l.doc_id, CASE WHEN verdict = 'no_signs' THEN coalesce((list(id ORDER BY weight, ord) FILTER (weight < 0 AND shown))[:2], ['no_signals'])
  ELSE coalesce((list(id ORDER BY f.hard DESC, weight DESC, ord) FILTER (weight > 0 AND shown))[:3], (list(id ORDER BY weight DESC, ord) FILTER (weight > 0))[:2]) END AS reason_ids
FROM levels l LEFT JOIN fired f USING (doc_id) GROUP BY l.doc_id, verdict""")
def top3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(made_signals(spark, sf_dir), packs.SIGNALS).select("doc_id", "reason_ids")


def as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages, rebalanced: the rules cost far more than a shuffle, and one row group would keep one core busy."""
    return table(spark, sf_dir, "documents").hint("rebalance").select(F.col("doc_id").alias("message_id"), "text", F.lit("AX-SHOPIN").alias("sender"), F.lit("text").alias("input_type"))


@query()
def message_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.context(as_messages(spark, sf_dir)).drop("text", "norm")


@query()
def fired_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = as_messages(spark, sf_dir).withColumn("fired", signal_rules.signals_col(spark, packs.SIGNALS)("text", "sender", "input_type"))
    return found.select("message_id", F.explode("fired").alias("s")).select("message_id", "s.ord", "s.id", "s.weight", "s.hard")


@query()
def classifier_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").hint("rebalance").select("doc_id", F.round(classifier.probability_col(spark, packs.MODEL)("text", F.lit(["urgency"])), 9).alias("probability"))


@query()
def message_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole check: cards of all documents against the benchmark's items as patterns."""
    patterns = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit("p"), "item_id").alias("id"), F.lit("prize").alias("category"), "text")
    cards = check.check(as_messages(spark, sf_dir), packs.SIGNALS, patterns, packs.MODEL, 0.6)
    return cards.select("message_id", "verdict", "risk_score", "confidence", "category", "reason_ids", F.round("similarity", 6).alias("similarity"), F.round("classifier_p", 9).alias("classifier_p"), "lang", "rupees_at_risk")


# ---------------------------------------------------------------- payments

PAYLOAD_SQL = "'upi://pay?pa=c' || o_custkey || '%40bank&PN=Shop+' || o_custkey || '&am=' || (o_orderkey % 100000) || '.50&tn=Order%20' || o_orderkey"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    made = F.concat(F.lit("upi://pay?pa=c"), customer, F.lit("%40bank&PN=Shop+"), customer, F.lit("&am="), (F.col("o_orderkey") % 100000).cast("string"), F.lit(".50&tn=Order%20"), key)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", made.alias("payload"))


@query("SELECT o_orderkey, 'pay' AS action, 'c' || o_custkey || '@bank' AS payee, 'Shop ' || o_custkey AS name, (o_orderkey % 100000) + 0.5::DOUBLE AS amount, 'INR' AS currency, 'Order ' || o_orderkey AS note FROM orders")
def upi_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payloads(spark, sf_dir).select("o_orderkey", payments.parse_col("payload").alias("p"))
    return found.select("o_orderkey", "p.action", "p.payee", "p.name", "p.amount", "p.currency", "p.note")


@query("SELECT o_orderkey, 'upi' AS kind, CASE WHEN o_orderkey % 100000 >= 10000 THEN ['large_amount'] ELSE [] END AS flags FROM orders")
def qr_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payloads(spark, sf_dir).select("o_orderkey", payments.analyse_col("payload").alias("q"))
    return found.select("o_orderkey", "q.kind", "q.flags")


@query("""SELECT o_orderkey, '₹' || CASE WHEN length(w) > 5 THEN CASE WHEN length(w) > 7 THEN left(w, length(w) - 7) || ',' ELSE '' END || substr(w, greatest(length(w) - 6, 1), length(w) - 5 - greatest(length(w) - 7, 0)) || ',' || right(w, 5)[1:2] || ',' || right(w, 3)
  WHEN length(w) > 3 THEN left(w, length(w) - 3) || ',' || right(w, 3) ELSE w END || CASE WHEN p = '00' THEN '' ELSE '.' || p END AS rupees
FROM (SELECT o_orderkey, printf('%.2f', o_totalprice)[:-4] AS w, printf('%.2f', o_totalprice)[-2:] AS p FROM orders)""")
def rupee_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", payments.rupees_col("o_totalprice").alias("rupees"))


@query()
def qr_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rules cost far more than a shuffle, and orders have few row groups, which would keep few cores busy.
    made = payloads(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism).select(F.col("o_orderkey").alias("message_id"), "payload")
    return check.check_payloads(made, packs.SIGNALS).select("message_id", "verdict", "risk_score", "qr.kind", "qr.amount_text")


# ---------------------------------------------------------------- eligibility

WORK, PLACE = ["farm", "study", "other", "unsure"], ["town", "village", "unsure"]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of customers by fixed rules; every seventh leaves out the last ones."""
    key = F.col("c_custkey")
    pick = lambda options, by: F.element_at(F.lit(options), (F.floor(key / by) % len(options) + 1).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda k, q, i=None, s=None, a=None: F.struct(
        F.lit(k).alias("ord"), F.lit(q).alias("qid"), (none("int") if i is None else i.cast("int")).alias("int_val"), (none("string") if s is None else s).alias("str_val"), (none("array<string>") if a is None else a).alias("arr_val")
    )
    given = F.array(row(0, "age", i=key % 101), row(1, "work", s=pick(WORK, 2)), row(2, "place", s=pick(PLACE, 3)), row(3, "account", s=F.when(key % 5 < 2, "no").otherwise("yes")), row(4, "more", a=F.when(key % 3 == 0, F.lit(["tax"])).otherwise(F.array().cast("array<string>"))))
    given = F.slice(given, F.lit(1), F.when(key % 7 == 0, 3).otherwise(5))
    return table(spark, sf_dir, "customer").select(key.alias("person_id"), F.explode(given).alias("a")).select("person_id", "a.*")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.facts_of(answers(spark, sf_dir), packs.SCHEMES)


PEOPLE_SQL = """WITH p AS (SELECT c_custkey AS person_id, (c_custkey % 101)::INT AS age, ['farm', 'study', 'other', 'unsure'][((c_custkey // 2) % 4 + 1)::INT] AS work,
  ['town', 'village', 'unsure'][((c_custkey // 3) % 3 + 1)::INT] AS place, c_custkey % 7 = 0 AS brief, c_custkey % 5 < 2 AS no_account, c_custkey % 3 = 0 AS tax FROM customer),
f AS (SELECT *, CASE work WHEN 'farm' THEN 3 WHEN 'unsure' THEN 2 ELSE 0 END AS farmer, CASE work WHEN 'study' THEN 3 WHEN 'unsure' THEN 1 ELSE 0 END AS student,
  CASE place WHEN 'town' THEN 3 WHEN 'village' THEN 0 ELSE 1 END AS urban, CASE WHEN brief THEN 1 WHEN no_account THEN 0 ELSE 3 END AS account, CASE WHEN brief THEN 1 WHEN tax THEN 3 ELSE 0 END AS taxpayer, CASE WHEN brief THEN 1 ELSE 0 END AS widow FROM p),
t AS (SELECT *, least(farmer, [3, 1, 1, 0][taxpayer + 1], account) AS t1, least(farmer, [3, 1, 1, 0][taxpayer + 1]) AS t1_open,
  least(CASE WHEN age >= 60 THEN 3 ELSE 0 END, greatest([3, 1, 1, 0][taxpayer + 1], widow)) AS t2, least(CASE WHEN age BETWEEN 16 AND 30 THEN 3 ELSE 0 END, student) AS t3,
  least([3, 1, 1, 0][urban + 1], greatest(farmer, widow), CASE WHEN age >= 18 THEN 3 ELSE 0 END) AS t4 FROM f),
s AS (SELECT *, CASE WHEN t1 = 0 AND account = 0 AND t1_open > 0 THEN 'u' ELSE 'FULT'[t1 + 1] END AS s1, 'FULT'[t2 + 1] AS s2, 'FULT'[t3 + 1] AS s3, 'FULT'[t4 + 1] AS s4 FROM t),
long AS (SELECT person_id, unnest([{'ord': 0, 'scheme': 'farm_support', 'sig': s1}, {'ord': 1, 'scheme': 'old_age_pension', 'sig': s2}, {'ord': 2, 'scheme': 'student_grant', 'sig': s3}, {'ord': 3, 'scheme': 'village_homes', 'sig': s4}]) AS x FROM s),
cards AS (SELECT person_id, x.ord AS ord, x.scheme AS scheme, CASE x.sig WHEN 'u' THEN 'F' ELSE x.sig END AS truth, CASE x.sig WHEN 'u' THEN 'unlock' WHEN 'F' THEN 'not_eligible' WHEN 'U' THEN 'check' WHEN 'L' THEN 'likely' ELSE 'eligible' END AS status, x.sig AS sig FROM long)
"""


@query(PEOPLE_SQL + "SELECT person_id, t1::INT AS farm_support, t2::INT AS old_age_pension, t3::INT AS student_grant, t4::INT AS village_homes FROM t")
def rule_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = eligibility.scope_of()
    return people(spark, sf_dir).select("person_id", *(truth(s["rule"], scope).cast("int").alias(s["id"]) for s in packs.SCHEMES["schemes"]))


@query(PEOPLE_SQL + "SELECT person_id, CASE WHEN s1 = 'u' THEN 'bank_account' END AS unlock FROM s")
def rule_unlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("person_id", eligibility.unlock(packs.SCHEMES["schemes"][0], packs.SCHEMES, eligibility.scope_of()).alias("unlock"))


@query(PEOPLE_SQL + "SELECT person_id, s1 || s2 || s3 || s4 AS signature FROM s")
def rule_outcome_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("person_id", eligibility.outcomes(packs.SCHEMES, eligibility.scope_of()).alias("signature"))


@query(PEOPLE_SQL + """SELECT person_id, CASE WHEN NOT brief THEN NULL WHEN least(farmer, 1) > 0 THEN 'account'
  WHEN age >= 60 OR (age >= 18 AND urban < 3) THEN 'more' END AS next_question FROM s""")
def next_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.next_question(people(spark, sf_dir), packs.SCHEMES).select("person_id", "next_question")


@query(PEOPLE_SQL + "SELECT person_id, scheme, truth, status FROM cards")
def scheme_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.cards(people(spark, sf_dir), packs.SCHEMES).select("person_id", "scheme", "truth", "status")


@query(PEOPLE_SQL + "SELECT person_id, status, list(scheme ORDER BY ord) AS schemes FROM cards GROUP BY person_id, status")
def status_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.groups(eligibility.cards(people(spark, sf_dir), packs.SCHEMES))


@query(PEOPLE_SQL + """, docs AS (SELECT person_id, arg_min(doc, r * 100 + ord * 10 + pos) AS document, count(DISTINCT scheme) AS schemes, min(r * 100 + ord * 10 + pos) AS first FROM (
  SELECT c.*, d.pos, d.doc, CASE status WHEN 'eligible' THEN 1 WHEN 'likely' THEN 2 ELSE 3 END AS r FROM cards c JOIN (VALUES ('farm_support', 0, 'ID card (any)'), ('farm_support', 1, 'Land record'), ('old_age_pension', 0, 'id card (original)'), ('old_age_pension', 1, 'Age proof'), ('student_grant', 0, 'ID card'), ('student_grant', 1, 'Marks'), ('village_homes', 0, 'ID card')) d(scheme, pos, doc) ON c.scheme = d.scheme
  WHERE status IN ('eligible', 'likely', 'check')) GROUP BY person_id, lower(trim(split_part(doc, ' (', 1))))
SELECT person_id, (row_number() OVER (PARTITION BY person_id ORDER BY schemes DESC, first))::INT AS place, document, schemes FROM docs""")
def documents_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.checklist(eligibility.cards(people(spark, sf_dir), packs.SCHEMES))


CODES_SQL = """'age=' || age || '; work=' || work || '; place=' || place || CASE WHEN brief THEN '' ELSE '; account=' || CASE WHEN no_account THEN 'no' ELSE 'yes' END || '; more=' || CASE WHEN tax THEN 'tax' ELSE 'none' END END"""
BY_STATUS_SQL = ", by_status AS (SELECT person_id, " + ", ".join(f"string_agg(scheme, ', ' ORDER BY ord) FILTER (WHERE status = '{g}') AS {g}" for g in eligibility.GROUPS) + ", count(*) FILTER (WHERE status <> 'not_eligible') AS useful FROM cards GROUP BY person_id)"


@query(PEOPLE_SQL + BY_STATUS_SQL + f"""SELECT person_id, concat_ws(chr(10), 'SLIP | synthetic-schemes pack 1 | 2026-01-01', {CODES_SQL}, 'ELIGIBLE: ' || eligible, 'LIKELY (needs proof): ' || likely,
  'CHECK AT OFFICE: ' || "check", 'AFTER OPENING A BANK ACCOUNT: ' || unlock, 'No name stored. Guidance only; the office decides.') AS slip FROM by_status JOIN p USING (person_id)""")
def slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.slip(people(spark, sf_dir), packs.SCHEMES, "2026-01-01")


@query(PEOPLE_SQL + BY_STATUS_SQL + """SELECT person_id, CASE WHEN brief THEN 3 ELSE 5 END::INT AS asked, useful::INT AS useful, eligible, not_eligible FROM by_status JOIN p USING (person_id)""")
def interview_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = eligibility.results(people(spark, sf_dir), packs.SCHEMES, "2026-01-01")
    joined = {g: F.when(F.size(f"groups.{g}") > 0, F.array_join(f"groups.{g}", ", ")).alias(g) for g in ("eligible", "not_eligible")}
    return found.select("person_id", "asked", "useful", *joined.values())


@query(PEOPLE_SQL + """SELECT person_id, x.id AS id, x.answer AS answer, x.code AS code FROM (SELECT person_id, unnest([{'id': 'age', 'answer': age || ' years', 'code': age::VARCHAR}, {'id': 'work', 'answer': work, 'code': work},
  {'id': 'place', 'answer': place, 'code': place}] || CASE WHEN brief THEN [] ELSE [{'id': 'account', 'answer': CASE WHEN no_account THEN 'no' ELSE 'yes' END, 'code': CASE WHEN no_account THEN 'no' ELSE 'yes' END},
  {'id': 'more', 'answer': CASE WHEN tax THEN 'tax' ELSE 'none' END, 'code': CASE WHEN tax THEN 'tax' ELSE 'none' END}] END) AS x FROM p)""")
def interview_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = people(spark, sf_dir).select("person_id", F.explode(eligibility.profile(packs.SCHEMES)).alias("x"))
    return found.select("person_id", "x.id", F.col("x.answer.en").alias("answer"), "x.code")


@query("SELECT * FROM (VALUES (0, 'farm_support', 'farm support'), (1, 'old_age_pension', 'old age pension'), (2, 'student_grant', 'student grant'), (3, 'village_homes', 'village homes')) t(ord, scheme, name)")
def scheme_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.catalog(spark, packs.SCHEMES).select("ord", "scheme", F.col("name.en").alias("name"))


@query(PEOPLE_SQL + "SELECT person_id, scheme, replace(scheme, '_', ' ') AS what, 'made up' AS source FROM cards WHERE status = 'eligible'")
def described_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = eligibility.cards(people(spark, sf_dir), packs.SCHEMES).where("status = 'eligible'")
    return eligibility.described(found, packs.SCHEMES).select("person_id", "scheme", F.col("what.en").alias("what"), F.col("source_rows")[0]["title"].alias("source"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 40 >= 18 AND c_custkey % 40 + 10 <= 40 THEN 'T' WHEN c_custkey % 40 + 10 < 18 OR c_custkey % 40 > 40 THEN 'F' ELSE 'U' END AS truth FROM customer")
def age_interval_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An age that is only known as an interval of ten years, against 18 to 40."""
    low = (F.col("c_custkey") % 40).cast("int")
    scope = Scope(F.create_map().cast("map<string,tinyint>"), low, low + 10)
    return table(spark, sf_dir, "customer").select("c_custkey", name_of(truth({"age": [18, 40]}, scope)).alias("truth"))
