"""Named queries over the driver's tables, each with the SQL it is checked against.

The tables stand in for the documents of a review: a text is a file, its lines are paragraphs, ``lang`` is the language, ``source`` the chapter,
``benchmark`` the specification, ``labels`` rule outcomes, ``conversations`` documents of several sections, ``pages`` files with a path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lektor.functions import text as T
from lektor.functions import udf
from lektor.operators import assisted, matching, packing, segments, sinks, status
from lektor.sources.tables import paragraphs, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
SHORT = 60

_PARAS = """paras AS (SELECT doc_id, lang, source, idx, trim(raw) AS line FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw,
 unnest(range(len(string_split(text, chr(10))))) AS idx FROM documents) WHERE trim(raw) <> '')"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql.replace("{PARAS}", _PARAS)
        return f

    return register


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs(table(spark, d, "documents"), "lang", "source")


# scans and scalars


@query("WITH {PARAS} SELECT doc_id, idx::INT AS idx, line FROM paras")
def scan_paragraphs(spark, d):
    return _lines(spark, d).select("doc_id", "idx", "line")


@query("WITH {PARAS} SELECT doc_id, count(*) AS paras, sum(length(line))::BIGINT AS chars, max(length(line))::INT AS longest, avg(length(line)) AS mean_len FROM paras GROUP BY doc_id")
def doc_profile(spark, d):
    n = F.length("line")
    return _lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("paras"), F.sum(n).alias("chars"), F.max(n).alias("longest"), F.avg(n).alias("mean_len"))


@query("SELECT doc_id, md5(translate(text, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')) AS digest FROM documents")
def western_digits(spark, d):
    """Digest of each whole text with its digits folded."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.western_digits(F.col("text"))).alias("digest"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]'))::INT AS latin, 0 AS arabic, CASE WHEN len(regexp_extract_all(text, '[A-Za-z]')) > 0 THEN 'latin' END AS script FROM documents")
def script_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.latin_letters(F.col("text")).alias("latin"), T.arabic_letters(F.col("text")).alias("arabic"), T.dominant_script(F.col("text")).alias("script"))


@query("""SELECT source, sum(a)::BIGINT AS ascii_letters, sum(o)::BIGINT AS other, CASE WHEN sum(a) + sum(o) = 0 THEN NULL WHEN sum(o) * 20 >= sum(a) THEN 'accented' ELSE 'plain' END AS kind FROM
 (SELECT source, len(regexp_extract_all(text, '[A-Za-z]')) AS a, len(regexp_extract_all(text, '[à-ÿ]')) AS o FROM documents) GROUP BY source""")
def dominant_language(spark, d):
    a, o = F.sum(F.regexp_count("text", F.lit("[A-Za-z]"))), F.sum(F.regexp_count("text", F.lit("[à-ÿ]")))
    return table(spark, d, "documents").groupBy("source").agg(a.alias("ascii_letters"), o.alias("other"), F.when(a + o == 0, None).when(o * 20 >= a, "accented").otherwise("plain").alias("kind"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS loose FROM documents")
def loose_form(spark, d):
    return table(spark, d, "documents").select("doc_id", T.loose(F.col("text")).alias("loose"))


@query()
def comparison_form(spark, d):
    """Compatibility composition and folding; SQL has no counterpart of the former."""
    return table(spark, d, "documents").select("doc_id", T.fold(udf.nfkc("text")).alias("folded"))


_LABELS = ["released under", "the and attion", "licensed under", "permission is"]


@query(r"""WITH {PARAS}, b AS (SELECT doc_id, idx, regexp_replace(lower(trim(regexp_replace(line, '[\s\x{00A0}]+', ' ', 'g'))), '^[ 0-9.()\-–—•*#]+', '') AS s FROM paras),
 l AS (SELECT unnest(['released under', 'the and attion', 'licensed under', 'permission is']) AS label), r AS (SELECT *, ltrim(substr(s, length(label) + 1)) AS rest FROM b, l WHERE starts_with(s, label))
 SELECT DISTINCT doc_id, idx::INT AS idx, s AS bare FROM r WHERE rest = '' OR regexp_matches(rest, '^[:：—–\-|·]') OR length(s) <= 80""")
def label_prefix(spark, d):
    bare = F.regexp_replace(F.lower(T.fold(F.col("line"))), "^[ 0-9.()\\-–—•*#]+", "")
    return _lines(spark, d).where(T.starts_with_label(F.col("line"), _LABELS)).select("doc_id", "idx", bare.alias("bare"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]*spam') THEN 'spam' WHEN regexp_matches(url, '^https?://blog\.') THEN 'blog' WHEN regexp_matches(url, '/en/') THEN 'english'
 WHEN regexp_matches(url, '/(fr|de|es)/') THEN 'other_language' ELSE 'unclassified' END AS kind FROM pages""")
def first_match_wins(spark, d):
    u = F.col("url")
    kind = F.when(u.rlike("^https?://[^/]*spam"), "spam").when(u.rlike(r"^https?://blog\."), "blog").when(u.rlike("/en/"), "english").when(u.rlike("/(fr|de|es)/"), "other_language").otherwise("unclassified")
    return table(spark, d, "pages").select("page_id", kind.alias("kind"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS folder,
 try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS INT) AS number, regexp_extract(url, '[?&]ref=([a-z]+)', 1) AS ref FROM pages""")
def path_parts(spark, d):
    x = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, d, "pages").select("page_id", x("^https?://([^/]+)").alias("host"), x("^https?://[^/]+/([a-z]+)/").alias("folder"), x("/([0-9]+)").try_cast("int").alias("number"), x("[?&]ref=([a-z]+)").alias("ref"))


@query(r"SELECT page_id, try_cast(nullif(regexp_extract(lower(url), 'page[^0-9a-z]*([0-9]{1,2})', 1), '') AS INT) AS page FROM pages")
def number_after(spark, d):
    return table(spark, d, "pages").select("page_id", T.number_after(F.col("url"), "page").alias("page"))


@query("""WITH r AS (SELECT range AS n FROM range(1, 200)), t AS (SELECT n, repeat('c', (n // 100)::INT) || ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][((n % 100) // 10 + 1)::INT] ||
 ['','i','ii','iii','iv','v','vi','vii','viii','ix'][(n % 10 + 1)::INT] AS s FROM r) SELECT s AS text, n::INT AS number FROM t UNION ALL SELECT n::VARCHAR, n::INT FROM r UNION ALL SELECT 'abc' || n, NULL FROM r""")
def question_number(spark, d):
    tens, ones = ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"], ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
    n = F.col("id")
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (k + 1).cast("int"))
    text = F.concat(F.repeat(F.lit("c"), F.floor(n / 100).cast("int")), pick(tens, F.floor(n % 100 / 10)), pick(ones, n % 10))
    r = spark.range(1, 200)
    rows = r.select(text.alias("text")).unionAll(r.select(n.cast("string"))).unionAll(r.select(F.concat(F.lit("abc"), n.cast("string"))))
    return rows.select("text", T.question_number(F.col("text")).alias("number"))


@query(r"""SELECT o_custkey, o_orderkey, v AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY major DESC, minor DESC, o_orderkey DESC) > 1 AS superseded FROM
 (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS major, o_orderkey % 12 AS minor, 'plan-v' || o_orderkey % 4 || '.' || o_orderkey % 12 AS v FROM orders)""")
def version_latest(spark, d):
    name = F.concat(F.lit("plan-v"), (F.col("o_orderkey") % 4).cast("string"), F.lit("."), (F.col("o_orderkey") % 12).cast("string"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", name.alias("version"))
    return status.latest(rows, "o_custkey", T.version_key(F.col("version")), "o_orderkey")


@query("""SELECT n, CASE WHEN k = 0 THEN m || ':' || lpad((n % 60)::VARCHAR, 2, '0') WHEN k = 1 THEN m || ' s' ELSE m || '-' || (m + 2) || ' min' END AS text,
 (CASE WHEN k = 0 THEN m * 60 + n % 60 WHEN k = 1 THEN m ELSE (m + 2) * 60 END)::INT AS secs, CASE WHEN k = 2 THEN m::INT END AS lo, CASE WHEN k = 2 THEN (m + 2)::INT END AS hi
 FROM (SELECT range AS n, range % 3 AS k, range // 7 AS m FROM range(0, 500))""")
def duration_parse(spark, d):
    n, k, m = F.col("id"), F.col("id") % 3, F.floor(F.col("id") / 7)
    text = F.when(k == 0, F.concat(m.cast("string"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"))).when(k == 1, F.concat(m.cast("string"), F.lit(" s"))).otherwise(F.concat(m.cast("string"), F.lit("-"), (m + 2).cast("string"), F.lit(" min")))
    rows = spark.range(500).select(n.alias("n"), text.alias("text"))
    span = T.minutes_range(F.col("text"))
    return rows.select("n", "text", T.seconds(F.col("text")).cast("int").alias("secs"), span["lo"].alias("lo"), span["hi"].alias("hi"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


# segmentation


@query(r"""WITH {PARAS} SELECT doc_id, idx::INT AS idx, line FROM paras WHERE length(line) <= 60 AND NOT regexp_matches(line, '[.!?:,;]$') AND NOT regexp_matches(line, '^[-*0-9]') AND len(string_split(line, ' ')) <= 8""")
def heading_like(spark, d):
    line = F.col("line")
    return _lines(spark, d).where((F.length(line) <= SHORT) & ~line.rlike("[.!?:,;]$") & ~line.rlike("^[-*0-9]") & (F.size(F.split(line, " ")) <= 8)).select("doc_id", "idx", "line")


def _islands(spark, d):
    return segments.islands(_lines(spark, d), ["doc_id"], ["idx"], F.length("line") <= SHORT)


_ISL = "WITH {PARAS}, isl AS (SELECT *, sum(CASE WHEN length(line) <= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM paras)"


@query(_ISL + " SELECT doc_id, island::BIGINT AS island, count(*) AS n, min(idx)::INT AS first_idx, sum(length(line))::BIGINT AS chars FROM isl GROUP BY ALL")
def segment_islands(spark, d):
    return _islands(spark, d).groupBy("doc_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.sum(F.length("line")).alias("chars"))


@query(_ISL + " SELECT doc_id, island::BIGINT AS island, min(idx)::INT AS start, max(idx)::INT AS stop, count(*) AS n, string_agg(line, ' ' ORDER BY idx) AS block FROM isl WHERE island > 0 GROUP BY doc_id, island")
def segment_blocks(spark, d):
    return segments.blocks(_islands(spark, d).where("island > 0"), ["doc_id"], "idx", "line")


@query("""WITH a AS (SELECT user_id, ts, event_id, (event_id % 7)::BIGINT AS lesson FROM events), b AS (SELECT *, CASE WHEN lesson < lag(lesson) OVER w THEN 1 ELSE 0 END AS fell FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 c AS (SELECT *, sum(fell) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM b) SELECT user_id, grp::BIGINT AS grp, count(*) AS n, min(lesson) AS lo, max(lesson) AS hi FROM c GROUP BY ALL""")
def lesson_groups(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 7).alias("lesson"))
    return segments.drop_groups(rows, ["user_id"], ["ts", "event_id"], "lesson").groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("lesson").alias("lo"), F.max("lesson").alias("hi"))


@query("""WITH {PARAS}, n AS (SELECT doc_id, max(idx) + 1 AS total FROM paras GROUP BY doc_id) SELECT doc_id, idx::INT AS start, coalesce(lead(idx) OVER (PARTITION BY doc_id ORDER BY idx), total)::INT AS stop, line AS title
 FROM paras JOIN n USING (doc_id) WHERE length(line) <= 60""")
def section_ranges(spark, d):
    rows = _lines(spark, d).withColumn("total", F.max("idx").over(Window.partitionBy("doc_id")) + 1)
    heads = rows.where(F.length("line") <= SHORT).select("doc_id", F.col("idx").alias("start"), "total", F.col("line").alias("title"))
    return segments.ranges(heads, ["doc_id"], "start", F.col("total")).drop("total")


@query("""WITH {PARAS} SELECT doc_id, idx::INT AS idx, last_value(CASE WHEN length(line) <= 60 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS heading FROM paras""")
def forward_fill(spark, d):
    return segments.carried(_lines(spark, d), ["doc_id"], ["idx"], F.when(F.length("line") <= SHORT, F.col("line")), "heading").select("doc_id", "idx", "heading")


@query("SELECT conv_id, bool_and(turn = rn) AS regular FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM conversations) GROUP BY conv_id")
def numbering_regular(spark, d):
    return segments.numbered(table(spark, d, "conversations"), ["conv_id"], ["turn"], "turn", 0)


@query("""SELECT o_custkey, bool_and(ok) AS in_order FROM (SELECT o_custkey, coalesce(o_totalprice >= lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), true) AS ok FROM orders) GROUP BY o_custkey""")
def sorted_check(spark, d):
    return segments.ascending(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_totalprice"))


@query("""WITH a AS (SELECT source, doc_id, lang, CASE WHEN lang IS DISTINCT FROM lag(lang) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS c FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
 b AS (SELECT *, sum(c) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT source, run::BIGINT AS run, any_value(lang) AS lang, count(*) AS n, min(doc_id) AS first_doc FROM b GROUP BY source, run""")
def item_islands(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", "lang")
    return segments.runs(rows, ["source"], ["doc_id"], "lang").groupBy("source", "run").agg(F.any_value("lang").alias("lang"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("""WITH a AS (SELECT conv_id, text AS question, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'),
 b AS (SELECT conv_id, text AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'assistant') SELECT conv_id, place::INT AS place, question, answer FROM a JOIN b USING (conv_id, place)""")
def positional_zip(spark, d):
    t = table(spark, d, "conversations")
    a, b = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")), t.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return segments.zipped(a, b, ["conv_id"], ["turn"], ["turn"]).select("conv_id", "place", "question", "answer")


@query("""WITH {PARAS}, p AS (SELECT doc_id, idx, CASE WHEN length(line) > 60 THEN left(line, 60) END AS t FROM paras) SELECT doc_id, idx::INT AS idx,
 last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 first_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS behind FROM p""")
def neighbour_text(spark, d):
    return segments.neighbours(_lines(spark, d), ["doc_id"], ["idx"], F.when(F.length("line") > SHORT, F.left("line", F.lit(60)))).select("doc_id", "idx", "before", "behind")


@query("""WITH {PARAS}, k AS (SELECT doc_id, idx, line, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM paras)
 SELECT doc_id, idx::INT AS idx FROM k WHERE n <= 3 OR k = 0 OR floor(k * 3 / n) > floor((k - 1) * 3 / n)""")
def sample_spread(spark, d):
    return segments.spread(_lines(spark, d), ["doc_id"], ["idx"], 3).select("doc_id", "idx")


# rules, findings and roll-ups


@query("WITH {PARAS} SELECT doc_id, sum(length(line) * CASE WHEN length(line) <= 60 THEN 1 ELSE 0 END)::DOUBLE / sum(length(line)) AS share FROM paras GROUP BY doc_id")
def weighted_share(spark, d):
    n = F.length("line")
    return _lines(spark, d).groupBy("doc_id").agg((F.sum(n * (n <= SHORT).cast("int")).cast("double") / F.sum(n)).alias("share"))


_ROLE = "CASE WHEN idx = 0 THEN 'title' WHEN length(line) <= 60 THEN 'heading' WHEN contains(line, ' | ') THEN 'table' ELSE 'body' END"


@query(f"WITH {{PARAS}} SELECT doc_id, {_ROLE} AS role, count(*) AS n, sum(length(line))::BIGINT AS chars FROM paras GROUP BY ALL")
def role_case(spark, d):
    line = F.col("line")
    role = F.when(F.col("idx") == 0, "title").when(F.length(line) <= SHORT, "heading").when(line.contains(" | "), "table").otherwise("body")
    return _lines(spark, d).groupBy("doc_id", role.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(line)).alias("chars"))


_BANDS = [(0, 499, "1-3"), (500, 1999, "4-5"), (2000, 4999, "6-8"), (5000, 10**9, "9-12")]


@query("SELECT doc_id, grade FROM documents JOIN (VALUES (0, 499, '1-3'), (500, 1999, '4-5'), (2000, 4999, '6-8'), (5000, 1000000000, '9-12')) b(lo, hi, grade) ON n_chars BETWEEN lo AND hi")
def grade_band(spark, d):
    bands = spark.createDataFrame(_BANDS, "lo long, hi long, grade string")  # four rows
    return table(spark, d, "documents").join(F.broadcast(bands), F.col("n_chars").between(F.col("lo"), F.col("hi"))).select("doc_id", "grade")


def _findings(spark, d) -> DataFrame:
    """Three rules over documents: share of short lines, digits, and length."""
    docs = table(spark, d, "documents")
    n = F.length("line")
    share = F.sum(n * (n <= SHORT).cast("int")).cast("double") / F.sum(n)
    r1 = _lines(spark, d).groupBy("doc_id").agg(share.alias("s"))
    r1 = r1.select(*status.finding("R1", F.col("doc_id"), F.when(F.col("s") > 0.5, "fail").when(F.col("s") > 0.2, "needs_review").otherwise("pass"), F.lit("short lines"), (F.col("s") > 0.1) & (F.col("s") <= 0.2)))
    digits = F.regexp_count("text", F.lit("[0-9]"))
    r2 = docs.select(*status.finding("R2", F.col("doc_id"), F.when(digits == 0, "na").when(digits > 40, "fail").otherwise("pass"), F.lit("digits")))
    r3 = docs.select(*status.finding("R3", F.col("doc_id"), F.when(F.col("n_chars") < 100, "fail").when(F.col("n_chars") > 15000, "needs_review").otherwise("pass"), F.lit("length")))
    return r1.unionByName(r2).unionByName(r3)


_FINDINGS = """{PARAS}, s AS (SELECT doc_id, sum(length(line) * CASE WHEN length(line) <= 60 THEN 1 ELSE 0 END)::DOUBLE / sum(length(line)) AS s FROM paras GROUP BY doc_id),
 findings AS (SELECT 'R1' AS code, doc_id AS doc, CASE WHEN s > 0.5 THEN 'fail' WHEN s > 0.2 THEN 'needs_review' ELSE 'pass' END AS status, 'short lines' AS message, s > 0.1 AND s <= 0.2 AS partial FROM s
 UNION ALL SELECT 'R2', doc_id, CASE WHEN len(regexp_extract_all(text, '[0-9]')) = 0 THEN 'na' WHEN len(regexp_extract_all(text, '[0-9]')) > 40 THEN 'fail' ELSE 'pass' END, 'digits', false FROM documents
 UNION ALL SELECT 'R3', doc_id, CASE WHEN n_chars < 100 THEN 'fail' WHEN n_chars > 15000 THEN 'needs_review' ELSE 'pass' END, 'length', false FROM documents)"""
_FOLD = "CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_and(status = 'na') THEN 'na' WHEN bool_and(status IN ('pass', 'na') AND NOT partial) THEN 'pass' END"


@query(f"WITH {_FINDINGS} SELECT * FROM findings")
def rule_findings(spark, d):
    return _findings(spark, d)


@query(f"WITH {_FINDINGS} SELECT doc, {_FOLD} AS status, count(*) AS n FROM findings GROUP BY doc")
def status_fold(spark, d):
    return status.cells(_findings(spark, d), "doc")


@query(f"WITH {_FINDINGS}, f AS (SELECT doc, {_FOLD} AS s FROM findings WHERE code IN ('R1', 'R3') GROUP BY doc) SELECT 'LPX' AS code, doc, CASE WHEN s = 'na' THEN 'pass' ELSE coalesce(s, 'needs_review') END AS status FROM f")
def derived_rule(spark, d):
    return status.derived(_findings(spark, d), "LPX", ["R1", "R3"])


@query(f"""WITH {_FINDINGS}, j AS (SELECT f.*, lang FROM findings f JOIN documents ON doc = doc_id) SELECT lang, code, count(*) AS n, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'fail') AS n_fail,
 count(*) FILTER (status = 'na') AS n_na, count(*) FILTER (status = 'needs_review') AS n_needs_review, {_FOLD} AS verdict,
 CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN count(*) FILTER (status = 'fail') || ' of ' || count(*) || ' documents fail' ELSE '' END AS note FROM j GROUP BY lang, code""")
def subject_rollup(spark, d):
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang")
    return status.rollup(_findings(spark, d).join(lang, "doc"), "lang", "code")


@query(f"""WITH {_FINDINGS}, j AS (SELECT f.*, source FROM findings f JOIN documents ON doc = doc_id), g AS (SELECT source, code, {_FOLD} AS s FROM j GROUP BY ALL)
 SELECT source, max(s) FILTER (code = 'R1') AS R1, max(s) FILTER (code = 'R2') AS R2, max(s) FILTER (code = 'R3') AS R3 FROM g GROUP BY source""")
def grid_pivot(spark, d):
    source = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source")
    return status.grid(_findings(spark, d).join(source, "doc"), "source", ["R1", "R2", "R3"])


@query(f"""WITH {_FINDINGS}, o AS (SELECT * FROM findings WHERE status IN ('fail', 'needs_review')) SELECT code, count(*) FILTER (status = 'fail') AS fails, count(*) FILTER (status = 'needs_review') AS reviews,
 coalesce(min(doc) FILTER (status = 'fail'), min(doc) FILTER (status = 'needs_review')) AS example_doc, min(message) AS example FROM o GROUP BY code""")
def overview_rollup(spark, d):
    return status.overview(_findings(spark, d), "code")


@query(f"""WITH {_FINDINGS} SELECT doc, arg_max(status, CASE status WHEN 'fail' THEN 3 WHEN 'needs_review' THEN 2 WHEN 'pass' THEN 0 ELSE -1 END) AS worst FROM findings WHERE status <> 'na' GROUP BY doc""")
def worst_status(spark, d):
    return _findings(spark, d).where("status <> 'na'").groupBy("doc").agg(status.worst(F.col("status")).alias("worst"))


@query(f"""WITH {_FINDINGS}, again AS (SELECT code, doc, CASE WHEN doc % 2 = 0 THEN 'pass' ELSE status END AS status, message, partial FROM findings)
 SELECT code, doc, status FROM findings WHERE NOT (code IN ('R1', 'R2') AND status IN ('fail', 'needs_review'))
 UNION ALL SELECT a.code, a.doc, a.status FROM again a JOIN findings f USING (code, doc) WHERE f.code IN ('R1', 'R2') AND f.status IN ('fail', 'needs_review') AND a.status <> 'pass'""")
def after_repair(spark, d):
    findings = _findings(spark, d)
    again = findings.withColumn("status", F.when(F.col("doc") % 2 == 0, "pass").otherwise(F.col("status")))
    return status.after_repair(findings, again, ["R1", "R2"]).select("code", "doc", "status")


@query(f"""WITH {_FINDINGS} SELECT status, code, doc_n FROM (SELECT status, code, count(*) AS doc_n, row_number() OVER (PARTITION BY status ORDER BY count(*) DESC, code) AS r FROM findings GROUP BY status, code) WHERE r <= 2""")
def topk_evidence(spark, d):
    counts = _findings(spark, d).groupBy("status", "code").agg(F.count(F.lit(1)).alias("doc_n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("status").orderBy(F.col("doc_n").desc(), "code"))).where("r <= 2").drop("r")


@query("""SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(lang, source)::BIGINT AS grain FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())""")
def grain_rollup(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupingSets([[F.col("lang"), F.col("source")], [F.col("lang")], []], F.col("lang"), F.col("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("grain"))


# joins


@query("""SELECT i.item_id, lang, count(*) FILTER (contains(d.text, i.text)) AS hits FROM benchmark i CROSS JOIN documents d GROUP BY i.item_id, lang""")
def coverage_matrix(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    hits = matching.contains_pairs(docs, items, "doc_id", "item_id").join(docs.select("doc_id", "lang"), "doc_id").groupBy("item_id", "lang").agg(F.count(F.lit(1)).alias("hits"))
    every = items.select("item_id").crossJoin(F.broadcast(docs.select(F.col("lang").alias("_lang")).distinct()))  # a row a language, null included
    hits = hits.withColumnRenamed("item_id", "_item")
    return every.join(hits, (F.col("item_id") == F.col("_item")) & F.col("_lang").eqNullSafe(F.col("lang")), "left").select("item_id", F.col("_lang").alias("lang"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


@query("SELECT item_id FROM benchmark i WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, i.text))")
def coverage_gaps(spark, d):
    items = table(spark, d, "benchmark")
    return matching.gaps(items, matching.contains_pairs(table(spark, d, "documents"), items, "doc_id", "item_id"), "item_id").select("item_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def presence_missing(spark, d):
    return matching.gaps(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query("""SELECT doc_id, CASE WHEN l.quality IS NOT NULL AND (l.quality = 1 OR l.toxic IS NULL) THEN 'left' WHEN l.toxic IS NOT NULL THEN 'right' END AS source,
 CASE WHEN l.quality IS NOT NULL AND (l.quality = 1 OR l.toxic IS NULL) THEN l.quality ELSE l.toxic END AS value FROM labels l""")
def full_reconcile(spark, d):
    """Quality labels against toxic labels."""
    t = table(spark, d, "labels")
    return matching.reconcile(t.select("doc_id", F.col("quality").alias("value_l")), t.select("doc_id", F.col("toxic").alias("value_r")), ["doc_id"], F.col("value_l") == 1).select("doc_id", "source", "value")


@query("""WITH {PARAS}, h AS (SELECT item_id, doc_id, idx FROM paras JOIN benchmark b ON contains(line, b.text)) SELECT item_id, doc_id, idx::INT AS idx FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id, idx) AS r FROM h) WHERE r = 1""")
def marks_locate(spark, d):
    lines = _lines(spark, d).withColumn("text", F.col("line")).withColumn("place", F.struct("doc_id", "idx"))
    hits = matching.contains_pairs(lines.select("place", "text"), table(spark, d, "benchmark"), "place", "item_id")
    return hits.groupBy("item_id").agg(F.min("place").alias("p")).select("item_id", "p.doc_id", "p.idx")


@query(r"""WITH a AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS t FROM pages), b AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations GROUP BY conv_id),
 ta AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(t), '\p{L}{2,}')) AS w FROM a), tb AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(t), '\p{L}{2,}')) AS w FROM b),
 v AS (SELECT page_id, conv_id, count(*) AS shared FROM ta JOIN tb USING (w) GROUP BY ALL), m AS (SELECT *, max(shared) OVER (PARTITION BY page_id) AS top FROM v),
 u AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM m WHERE shared = top) SELECT page_id, conv_id, shared FROM u WHERE n = 1""")
def title_vote(spark, d):
    """Titles of all pages against the first turns of all conversations; turns without text don't count, as in the SQL's arg_min."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    c = table(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))
    return matching.title_votes(p, c, "page_id", "conv_id")


@query()
def near_duplicate(spark, d):
    """Lines of documents that copy a benchmark line at a ratio of 0.85, at any length; SQL has no such ratio."""
    left = _lines(spark, d).select(F.struct("doc_id", "idx").alias("a"), F.col("line").alias("x"))
    right = table(spark, d, "benchmark").select(F.col("item_id").alias("b"), F.explode(F.split("text", "\n")).alias("y"))
    return matching.similar_lines(left, right, 0.85).select("a.doc_id", "a.idx", F.col("b").alias("item_id"), "ratio")


@query("SELECT min(doc_id) AS first_doc, count(*) AS copies, md5(text) AS digest FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}{2,}') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t), tf AS (SELECT doc_id, len AS len, term, count(*) AS f FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM t) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS term FROM benchmark) GROUP BY ALL),
 sc AS (SELECT item_id, doc_id, round(sum(q * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / a))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 3) DESC, doc_id) AS rank FROM sc) SELECT item_id, doc_id, rank::INT AS rank, round(score, 3) AS score FROM r WHERE rank <= 3""")
def bm25_topk(spark, d):
    return matching.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 3, 3).select("item_id", "doc_id", "rank", "score")


@query(r"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS term FROM documents) GROUP BY term")
def doc_frequency(spark, d):
    return matching.document_frequency(table(spark, d, "documents"), "doc_id")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\([A-Z][A-Za-z]+, [0-9]{4}\)'))::INT AS good, len(regexp_extract_all(text, '\[[0-9]{1,3}\]'))::INT AS numbered, len(regexp_extract_all(text, '\([A-Z][A-Za-z]+ [0-9]{4}\)'))::INT AS bare FROM documents""")
def citation_check(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p))
    return table(spark, d, "documents").select("doc_id", n(r"\([A-Z][A-Za-z]+, [0-9]{4}\)").alias("good"), n(r"\[[0-9]{1,3}\]").alias("numbered"), n(r"\([A-Z][A-Za-z]+ [0-9]{4}\)").alias("bare"))


@query("""WITH m AS (SELECT doc_id % 10 AS fold, doc_id FROM labels WHERE toxic = 1), s AS (SELECT doc_id % 10 AS fold, doc_id FROM labels WHERE quality = 0 OR toxic = 1)
 SELECT fold, count(*) FILTER (m.doc_id IS NOT NULL AND s.doc_id IS NOT NULL) AS hits, count(*) FILTER (m.doc_id IS NOT NULL AND s.doc_id IS NOT NULL) / nullif(count(m.doc_id), 0) AS precision,
 count(*) FILTER (m.doc_id IS NOT NULL AND s.doc_id IS NOT NULL) / nullif(count(s.doc_id), 0) AS recall FROM m FULL JOIN s USING (fold, doc_id) GROUP BY fold""")
def eval_precision_recall(spark, d):
    t = table(spark, d, "labels").withColumn("fold", F.col("doc_id") % 10)
    m, s = t.where("toxic = 1").select("fold", "doc_id", F.lit(1).alias("m")), t.where("quality = 0 or toxic = 1").select("fold", "doc_id", F.lit(1).alias("s"))
    both = m.join(s, ["fold", "doc_id"], "full")
    hits, ms, ss = F.count_if(F.col("m").isNotNull() & F.col("s").isNotNull()), F.count("m"), F.count("s")
    return both.groupBy("fold").agg(hits.alias("hits"), F.try_divide(hits, ms).alias("precision"), F.try_divide(hits, ss).alias("recall"))


# relational and event-time extensions


@query("""SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""")
def join_revenue(spark, d):
    t = lambda n: table(spark, d, n)
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def setops_union(spark, d):
    t = table(spark, d, "orders")
    return t.where("o_orderstatus = 'O'").select("o_custkey").union(t.where("o_totalprice > 200000").select("o_custkey")).distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def setops_except(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 0")
def setops_intersect(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").where("quality = 0").select("doc_id"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_events(spark, d):
    w = F.window("ts", "1 day")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY user_id""")
def session_events(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("c"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("c").alias("n"))


# budgets, colours, notes and quotes


@query("""WITH r AS (SELECT source, doc_id, n_chars AS size, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 count(*) OVER (PARTITION BY source) - row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) + 1 AS rest FROM documents),
 l AS (SELECT *, floor((12000 - before) / rest) AS level FROM r), m AS (SELECT source, max(level) FILTER (size > level) AS level FROM l GROUP BY source)
 SELECT source, doc_id, least(size, coalesce(level, size))::BIGINT AS share FROM r JOIN m USING (source)""")
def budget_fit(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("size"))
    return packing.fitted(rows, "source", "doc_id", "size", 12000).select("source", "doc_id", F.col("share").cast("long").alias("share"))


@query()
def chunk_pack(spark, d):
    """Lines packed to 7000 characters with two lines of overlap: a fold over all lines before, so rows only."""
    return packing.chunks(_lines(spark, d).select("doc_id", "idx", "line"), "doc_id", "idx", "line", 7000)


@query("""WITH c AS (SELECT range AS n, range % 256 AS r, (range * 7) % 256 AS g, (range * 13) % 256 AS b FROM range(0, 4096)) SELECT n, printf('%02X%02X%02X', r, g, b) AS hex, r >= 200 AND g >= 190 AND b <= 170 AS yellow,
 greatest(r, g, b) - least(r, g, b) <= 14 AS grey FROM c""")
def colour_kinds(spark, d):
    n = F.col("id")
    two = lambda x: F.lpad(F.hex(x), 2, "0")
    rows = spark.range(4096).select(n.alias("n"), F.concat(two(n % 256), two(n * 7 % 256), two(n * 13 % 256)).alias("hex"))
    return rows.select("n", "hex", T.is_yellow(F.col("hex")).alias("yellow"), T.is_grey(F.col("hex")).alias("grey"))


@query(f"""WITH {_FINDINGS}, n AS (SELECT DISTINCT doc, CASE status WHEN 'fail' THEN 0 WHEN 'needs_review' THEN 1 ELSE 2 END AS r, code,
 CASE status WHEN 'fail' THEN 'To fix: ' WHEN 'needs_review' THEN 'Please check: ' ELSE 'OK: ' END || message || ' [' || code || ']' AS line FROM findings WHERE status <> 'na') SELECT doc, string_agg(line, chr(10) ORDER BY r, code, line) AS note FROM n GROUP BY doc""")
def notes_text(spark, d):
    return sinks.notes(_findings(spark, d))


@query(r"""WITH q AS (SELECT c.conv_id, c.turn, list_filter(list_transform(string_split_regex(c.text, '\.\.\.|…|\[\.\.\.[^\]]*\]'), lambda p: trim(regexp_replace(lower(p), '[^\p{L}\p{N}_]+', ' ', 'g'))), lambda f: length(f) >= 8) AS fs,
 trim(regexp_replace(lower(d.text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS m FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id)
 SELECT conv_id, turn, coalesce(len(fs) > 0 AND len(list_filter(fs, lambda f: contains(m, f))) = len(fs), false) AS kept FROM q""")
def verify_quotes(spark, d):
    """Every turn's whole text as a quote, cut at its ellipses; ``verify_quotes`` and its SQL take the first 40 characters of turns with a document."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("material"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("quote")).join(docs, "conv_id", "left")
    return assisted.quoted(rows, "quote", "material").select("conv_id", "turn", "kept")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def distinct_in_order(spark, d):
    first = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda r: r["role"]), ",").alias("roles"))


@query("SELECT doc_id, sha1(text) AS digest FROM documents")
def content_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("digest"))
