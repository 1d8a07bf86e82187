"""Queries over the driver's tables: one for each operator, with SQL that gives the same rows.

The corpus stands in for ordinances: a paragraph is a line of a document, a jurisdiction a source, and rules use words
that occur in the texts.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import charset, lines, text
from lexspark.operators import aggregates, classify, coding, rules, segmentation, statistics, store, terms, tokens, views
from lexspark.sources import ledger, tables
from lexspark.streaming import coding as stream

#: Rules over words of the corpus; keywords only, so that SQL can follow.
KEYWORDS = {"*P": "that", "*N": "with", "*Z1": "from", "*Z2": "this", "*S1": "for", "*S2": "was", "*S3": "are", "*Q1": "und", "*Q2": "que"}
RULES_TEXT = "\n\n".join(f"{c}\n{w}" for c, w in KEYWORDS.items())
PROXIMITY_TEXT = "*NEAR\nnear(that-with)[6] or near(for-was)[b4]\n\n*SEQ\nseq(the-and)[3] and not this\n\n*MIX\n( und or que ) and not ( near(of-in)[2] or from )"


@cache
def _rules(source: str) -> dict:
    return rules.read_rules(source)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", "lang", "source", (F.col("p") + 1).cast("bigint").alias("dan"), F.trim("line").alias("s")).filter("s <> ''")


def _coded(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their codes; keyword rules need no terms beyond the text."""
    return _lines(spark, d).withColumn("codes", rules.codes(_rules(RULES_TEXT), F.col("s"), F.array().cast("array<string>")))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return coding.counts_by(_coded(spark, d), F.col("source"), list(KEYWORDS))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    resid = statistics.contingency(_counts(spark, d))
    at = lambda c, k: F.max(F.when(F.col("code") == k, F.col(c)))
    n = lambda k: at("n", k)
    return resid.groupBy("grp").agg(
        F.max("cases").alias("cases"), n("*P").alias("p"), n("*N").alias("n"), at("resid", "*P").alias("rp"), at("resid", "*N").alias("rn"), n("*Z1").alias("a"), n("*Z2").alias("b"), at("resid", "*Z1").alias("ra"), at("resid", "*Z2").alias("rb"),
        (n("*S1") + n("*S2") - n("*S3")).alias("strict"), (n("*Q1") + n("*S1")).alias("part"), (n("*Q2") + n("*S2") + n("*S3")).alias("proc"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often does each source use each code, which use is unusual, and what type of source is it?"""
    resid = statistics.contingency(_counts(spark, sf_dir))
    kinds = classify.integrated(_wide(spark, sf_dir)).select("grp", "regulation", "zone")
    return resid.join(kinds, "grp").select("grp", "code", "n", "cases", F.round("resid", 6).alias("resid"), "regulation", "zone")


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


# SQL that several oracles share.
_LINES = r"ln AS (SELECT doc_id, lang, source, p AS dan, trim(line) AS s FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents) WHERE trim(line) <> '')"
_CODES = "cd(code, w) AS (VALUES " + ", ".join(f"('{c}', '{w}')" for c, w in KEYWORDS.items()) + ")"
_COUNTS = f"{_LINES}, {_CODES}, cs AS (SELECT source AS grp, count(*) AS cases FROM ln GROUP BY source), ct AS (SELECT cs.grp, code, count(*) FILTER (contains(s, w)) AS n, any_value(cases) AS cases FROM ln JOIN cs ON cs.grp = ln.source CROSS JOIN cd GROUP BY cs.grp, code)"
_SUMS = "sm AS (SELECT code, sum(n)::DOUBLE AS sn, sum(cases)::DOUBLE AS sc FROM ct GROUP BY code)"
_RESID = f"{_COUNTS}, {_SUMS}, rs AS (SELECT grp, ct.code, n, cases, cases * sn / sc AS expected, CASE WHEN sn > 0 AND sn < sc THEN (n - cases * sn / sc) / sqrt(cases * sn / sc) ELSE 0 END AS resid FROM ct JOIN sm ON sm.code = ct.code)"


def _pick(column: str, code: str) -> str:
    return f"max({column}) FILTER (code = '{code}')"


_WIDE = f"""{_RESID}, wd AS (SELECT grp, max(cases) AS cases, {_pick('n', '*P')} AS p, {_pick('n', '*N')} AS n, {_pick('resid', '*P')} AS rp, {_pick('resid', '*N')} AS rn, {_pick('n', '*Z1')} AS a, {_pick('n', '*Z2')} AS b, {_pick('resid', '*Z1')} AS ra, {_pick('resid', '*Z2')} AS rb,
 {_pick('n', '*S1')} + {_pick('n', '*S2')} - {_pick('n', '*S3')} AS strict, {_pick('n', '*Q1')} + {_pick('n', '*S1')} AS part, {_pick('n', '*Q2')} + {_pick('n', '*S2')} + {_pick('n', '*S3')} AS proc FROM rs GROUP BY grp)"""
_REG = "CASE WHEN n = 0 AND p = 0 THEN '規定なし' WHEN rp > 1 THEN '許可制優位' WHEN rn > 1 AND rp < 1 THEN '届出制優位' WHEN p > 0 AND n = 0 THEN '許可制優位' WHEN p > 0 AND p / n >= 0.5 THEN '許可制優位' WHEN p > 0 THEN '混合型' ELSE '届出制優位' END"


def _zone(two: str, part: str) -> str:
    return f"CASE WHEN a = 0 AND b = 0 THEN '区域設定なし' WHEN rb > 1 AND a >= 3 AND b >= 3 THEN '{two}' WHEN rb > 1 THEN '禁止地区制' WHEN ra > 1 AND rb < 1 AND b > 0 THEN '{part}' WHEN ra > 1 AND rb < 1 THEN '抑制地区制' WHEN b > 0 AND a >= 3 AND b >= 3 THEN '{two}' WHEN b > 0 AND a >= 2 * b THEN '{part}' WHEN b > 0 THEN '禁止地区制' WHEN a >= 3 THEN '抑制地区制' ELSE '区域設定あり(少数)' END"


_Z1, _Z2 = _zone("2層構造(禁止+抑制)", "抑制地区制(禁止区域含む)"), _zone("2層構造(抑制+禁止)", "2層構造(抑制+禁止)")
_LEVEL = "CASE WHEN {s} >= {a} THEN '非常に厳格' WHEN {s} >= {b} THEN '厳格' WHEN {s} >= {c} THEN '標準' ELSE '緩やか' END"
_PROCESS = "CASE WHEN part >= 10 AND proc >= 15 THEN '住民参加・手続き重視型' WHEN part >= 10 THEN '住民参加重視型' WHEN proc >= 15 THEN '手続き重視型' ELSE '標準型' END"


# -- text functions ------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, '　', ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS norm FROM documents")
def norm_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_\-.]', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM pages")
def safe_name(spark, d):
    return _t(spark, d, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1), ''), 'index') AS name FROM pages")
def url_basename(spark, d):
    return _t(spark, d, "pages").select("page_id", text.url_basename(F.col("url")).alias("name"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_doc(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.sha256(F.col("text")).alias("digest"))


@query("SELECT page_id, (lower(url) LIKE '%.pdf') AS pdf, length(html) < 200 AS short FROM pages")
def is_pdf(spark, d):
    return _t(spark, d, "pages").select("page_id", text.is_pdf(F.lit("text/html; charset=utf-8"), F.col("url")).alias("pdf"), text.is_scanned(F.col("html")).alias("short"))


_STRIP_TAGS = "regexp_replace(html, '(?s)<!--.*?-->', chr(10), 'g')"
for _tag in text.SILENT_TAGS:
    _STRIP_TAGS = rf"regexp_replace({_STRIP_TAGS}, '(?is)<{_tag}(?:[ \t\n/][^>]*)?>.*?</{_tag}[ \t\n]*>', chr(10), 'g')"
_STRIP_TAGS = f"regexp_replace({_STRIP_TAGS}, '(?s)<[^>]*>', chr(10), 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIP_TAGS = f"replace({_STRIP_TAGS}, '{_e}', '{_c}')"


@query(rf"SELECT page_id, coalesce(array_to_string(list_filter(list_transform(string_split({_STRIP_TAGS}, chr(10)), lambda x: trim(regexp_replace(replace(x, '　', ' '), '[ \t]+', ' ', 'g'), ' ' || chr(13) || chr(160))), lambda x: x <> ''), chr(10)), '') AS body FROM pages")
def html_to_text(spark, d):
    return _t(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


@query()
def nfkc(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.nfkc(F.col("text")).alias("norm"))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS n, (l_partkey % 100)::DOUBLE AS ratio FROM lineitem")
def parse_counts(spark, d):
    cell = F.concat(F.col("l_partkey").cast("string"), F.lit(" ("), (F.col("l_partkey") % 100).cast("string"), F.lit(".0%)"))
    n, ratio = text.counted(F.col("cell"))
    return _t(spark, d, "lineitem").withColumn("cell", cell).select("l_orderkey", "l_linenumber", n.alias("n"), ratio.alias("ratio"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(spark, d):
    return _t(spark, d, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query()
def highlight(spark, d):
    return _coded(spark, d).select("doc_id", "dan", text.highlight(F.col("s"), F.col("codes"), {c: [w] for c, w in KEYWORDS.items()}).alias("marked"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '条例' WHEN c_custkey % 3 = 1 THEN '施行規則' ELSE '不明' END AS category, regexp_replace(c_name, '#', ' ') AS town, 2014 + c_custkey % 5 AS year FROM customer")
def file_metadata(spark, d):
    kind = F.when(F.col("c_custkey") % 3 == 0, "_Ordinance").when(F.col("c_custkey") % 3 == 1, "_Regulation").otherwise("")
    name = F.concat(F.translate("c_name", "#", "_"), kind, F.lit("_HTML.txt"))
    path = F.concat(F.lit("/data/out_"), (2014 + F.col("c_custkey") % 5).cast("string"), F.lit("/x"))
    rows = _t(spark, d, "customer").withColumn("name", name).withColumn("path", path)
    return rows.select("c_custkey", text.category_of(F.col("name")).alias("category"), text.municipality_of(F.col("name")).alias("town"), text.year_of(F.col("path")).cast("bigint").alias("year"))


# -- lines -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, dan, s AS text FROM ln")
def paragraphs_posexplode(spark, d):
    return lines.paragraphs(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("dan").cast("bigint").alias("dan"), "text")


@query(f"WITH {_LINES} SELECT source, count(*) AS n, sum(length(s))::BIGINT AS chars FROM ln GROUP BY source")
def paragraph_count(spark, d):
    return _lines(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


#: Lines of every title form, and some that only look like one; # stands for a number, fullwidth numbers for that of a region.
_FORMS = ("- # -", "－#－", "- # - 終", "○第#章", "令和#年４月１日", "平成#年一月二日の会議において決めた規則", "昭和３年", "条例第#号", "条例第#号　", "告示第#号の写し", "第#条", "第#条の２", "第＃条", "#", "（目的#）", "(目的#) ", "（目的）#", "附則", "附　則（#）", "＃", "本則#")
_WIDE_DIGITS = "translate({}, '0123456789', '０１２３４５６７８９')"
_FORM_LINES = "fl AS (SELECT k, f, trim(replace(replace(form, '#', k::VARCHAR), '＃', " + _WIDE_DIGITS.format("k::VARCHAR") + ")) AS s FROM (SELECT n_nationkey AS k FROM nation), (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(_FORMS)) + ") AS v(f, form))"
_TITLES = (("page", r"^[-－―ー]\s*\d+\s*[-－―ー]$"), ("number", "^[０-９]+$"), ("heading", "^○"), ("date", r"^(令和|平成|昭和)[\d０-９]+年.{0,10}$"), ("serial", r"^(条例|規則|告示)第[\d０-９]+号[\s　]*$"), ("article", r"^第[\d０-９]+条[\s　]*$"), ("digit", "^[2-9]$"), ("caption", r"^[（(][^)）]+[）)][\s　]*$"), ("supplement", "^(附則|附　則)"))


@query(f"WITH {_LINES}, {_FORM_LINES}, al AS (SELECT s FROM ln UNION ALL SELECT s FROM fl) SELECT CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in _TITLES) + " ELSE 'text' END AS kind, count(*) AS n, min(s) AS first FROM al GROUP BY kind")
def line_class(spark, d):
    """The corpus' lines, and those of every form with the keys of a table for numbers."""
    k = F.col("n_nationkey").cast("string")
    form = F.explode(F.array(*[F.lit(x) for x in _FORMS])).alias("form")
    made = _t(spark, d, "nation").select(k.alias("k"), form).select(F.replace(F.replace("form", F.lit("#"), F.col("k")), F.lit("＃"), F.translate("k", "0123456789", "０１２３４５６７８９")).alias("s"))
    rows = _lines(spark, d).select("s").unionByName(made.select(F.trim("s").alias("s")))
    return rows.groupBy(F.coalesce(lines.title_class(F.col("s")), F.lit("text")).alias("kind")).agg(F.count("*").alias("n"), F.min("s").alias("first"))


@query(rf"""WITH {_LINES}, m AS (SELECT *, regexp_matches(s, '^[ET]') AS marks, lag(s) OVER w AS before FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY dan)),
g AS (SELECT *, NOT marks OR before IS NULL AS begins FROM m), h AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY dan) AS g FROM g)
SELECT doc_id, min(dan) AS i, string_agg(CASE WHEN NOT begins AND NOT ends_with(before, '.') THEN '.' || s ELSE s END, '' ORDER BY dan) AS s FROM h GROUP BY doc_id, g""")
def reflow_lines(spark, d):
    rows = _lines(spark, d).select("doc_id", F.col("dan").alias("i"), "s")
    return lines.join_items(rows, "doc_id", marker="^[ET]", stop=".")


@query()
def reflow_pdf(spark, d):
    return lines.reflow_text(_t(spark, d, "documents"), "doc_id", "text", pdf=True)


# -- rules -----------------------------------------------------------------------------------------------------------------

_HITS = ", ".join(f"CASE WHEN contains(s, '{w}') THEN '{c}' END" for c, w in KEYWORDS.items())


@query(f"WITH {_LINES} SELECT doc_id, dan, array_to_string(list_filter([{_HITS}], lambda x: x IS NOT NULL), ',') AS codes FROM ln")
def code_keywords(spark, d):
    return _coded(spark, d).select("doc_id", "dan", F.array_join("codes", ",").alias("codes"))


@query(f"WITH {_LINES}, {_CODES} SELECT doc_id, code, max(contains(s, w)::INT) AS hit FROM ln CROSS JOIN cd GROUP BY doc_id, code")
def code_matrix_long(spark, d):
    by_doc = _coded(spark, d).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set("codes"))).alias("codes"))
    return coding.matrix_long(by_doc, "doc_id", list(KEYWORDS))


@query("WITH " + _LINES + " SELECT doc_id, dan, " + ", ".join(f"contains(s, '{w}')::INT AS \"{c}\"" for c, w in KEYWORDS.items()) + " FROM ln")
def code_matrix_wide(spark, d):
    return coding.matrix_wide(_coded(spark, d), ["doc_id", "dan"], list(KEYWORDS))


@query(f"WITH {_LINES}, {_CODES} SELECT code, count(*) AS n FROM ln JOIN cd ON contains(s, w) GROUP BY code")
def wide_to_long(spark, d):
    wide = coding.matrix_wide(_coded(spark, d), ["doc_id", "dan"], list(KEYWORDS))
    return coding.wide_to_long(wide, ["doc_id", "dan"], list(KEYWORDS)).groupBy("code").agg(F.count("*").alias("n"))


@query()
def code_proximity(spark, d):
    return rules.with_codes(_lines(spark, d), _rules(PROXIMITY_TEXT), "s").select("doc_id", "dan", F.array_join("codes", ",").alias("codes"))


_NEAR = "len(list_filter(range(1, len(t) + 1), lambda i: (contains(t[i], '{a}') OR contains('{a}', t[i])) AND len(list_filter(t[{lo}:{hi}], lambda x: contains(x, '{b}') OR contains('{b}', x))) > 0)) > 0"


@query(rf"""WITH {_LINES}, tk AS (SELECT doc_id, dan, regexp_extract_all(s, '[\p{{Latin}}]+|\p{{Nd}}+|[^\s\p{{Latin}}\p{{Nd}}]') AS f FROM ln), tt AS (SELECT doc_id, dan, list_concat(f, list_transform(f, lambda x: lower(x))) AS t FROM tk)
SELECT doc_id, dan, {_NEAR.format(a='that', b='with', lo='i + 1', hi='i + 6')} AS near_that_with FROM tt""")
def code_near(spark, d):
    coded = rules.with_codes(_lines(spark, d), {"*": rules.parse("near(that-with)[6]")}, "s")
    return coded.select("doc_id", "dan", (F.size("codes") > 0).alias("near_that_with"))


@query(rf"""WITH {_LINES}, tk AS (SELECT doc_id, dan, regexp_extract_all(s, '[\p{{Latin}}]+|\p{{Nd}}+|[^\s\p{{Latin}}\p{{Nd}}]') AS f FROM ln), tt AS (SELECT doc_id, dan, list_concat(f, list_transform(f, lambda x: lower(x))) AS t FROM tk)
SELECT doc_id, dan, {_NEAR.format(a='der', b='die', lo='greatest(1, i - 4)', hi='i - 1')} AS seq_der_die FROM tt""")
def code_seq(spark, d):
    coded = rules.with_codes(_lines(spark, d), {"*": rules.parse("seq(der-die)[b4]")}, "s")
    return coded.select("doc_id", "dan", (F.size("codes") > 0).alias("seq_der_die"))


@query()
def morphemes(spark, d):
    rows = _lines(spark, d).withColumnRenamed("s", "text")
    return tokens.morphemes(rows, ["doc_id", "dan"]).groupBy("pos1").agg(F.count("*").alias("n"), F.count_distinct("surface").alias("surfaces"))


def _user_dictionary(spark, d):
    """The mined terms as entries of a user's dictionary."""
    return terms.mecab_rows(_candidates(spark, d)).select("term", "cost")


@query()
def dictionary_segments(spark, d):
    """Tokens of the corpus' lines by the dictionary of its own terms: how often each word, and what is unknown, occurs."""
    return segmentation.token_counts(_lines(spark, d).select("s"), _user_dictionary(spark, d))


# -- counts and statistics ------------------------------------------------------------------------------------------------------


@query(f"WITH {_COUNTS} SELECT grp, code, n, cases FROM ct")
def counts_by_source(spark, d):
    return _counts(spark, d)


@query(f"WITH {_COUNTS}, al AS (SELECT grp, code, n, cases FROM ct UNION ALL SELECT '合計', code, sum(n)::BIGINT, sum(cases)::BIGINT FROM ct GROUP BY code) SELECT *, 100.0::DOUBLE * n / cases AS ratio FROM al")
def counts_with_total(spark, d):
    return coding.with_total(_counts(spark, d))


@query(f"WITH {_RESID} SELECT * FROM rs")
def chi2_residual(spark, d):
    return statistics.contingency(_counts(spark, d))


@query(f"WITH {_COUNTS}, {_SUMS} SELECT ct.code, sum(pow(n - cases * sn / sc, 2) / (cases * sn / sc * (1 - sn / sc))) AS chi2 FROM ct JOIN sm ON sm.code = ct.code GROUP BY ct.code")
def chi2_stat(spark, d):
    return statistics.chi_square(_counts(spark, d))


@query(f"WITH {_COUNTS} SELECT grp, code, n, (n - avg(n) OVER w) / sqrt(avg(n) OVER w) AS resid FROM ct WINDOW w AS (PARTITION BY code)")
def poisson_residual(spark, d):
    return statistics.poisson(_counts(spark, d))


@query(f'WITH {_COUNTS} SELECT code, count(*) AS groups, count(*) FILTER (n = 0) AS zeros, avg((n = 0)::INT) AS zero_share, avg(n) AS mean, var_samp(n) AS variance, var_samp(n) / avg(n) AS phi, var_samp(n) / avg(n) > 1.5 AS "over" FROM ct GROUP BY code')
def dispersion(spark, d):
    return statistics.dispersion(_counts(spark, d))


_Z = f"{_COUNTS}, z AS (SELECT grp, code, n, (n - avg(n) OVER w) / stddev_samp(n) OVER w AS z FROM ct WINDOW w AS (PARTITION BY code))"


@query(f"WITH {_Z} SELECT * FROM z")
def zscore(spark, d):
    return statistics.z_scores(_counts(spark, d))


@query(f"WITH {_Z} SELECT grp, count(*) FILTER (abs(z) > 2) AS n_outliers, max(abs(z)) AS max_abs_z FROM z GROUP BY grp")
def outlier_profile(spark, d):
    return statistics.outliers(statistics.z_scores(_counts(spark, d)))


@query(f"WITH {_COUNTS}, mv AS (SELECT log10(avg(n)) AS x, log10(var_samp(n)) AS y FROM ct GROUP BY code) SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM mv")
def power_law(spark, d):
    return statistics.power_law(_counts(spark, d))


@query()
def gof_pvalue(spark, d):
    return statistics.goodness_of_fit(_counts(spark, d))


@query()
def poisson_aic(spark, d):
    return statistics.poisson_aic(_counts(spark, d))


@query(f"WITH {_COUNTS}, {_SUMS} SELECT ct.code, grp, n / sn AS share FROM ct JOIN sm ON sm.code = ct.code WHERE sn > 0")
def shares_by_row(spark, d):
    return statistics.shares_by_row(_counts(spark, d))


@query()
def ward_order(spark, d):
    return spark.createDataFrame(statistics.ward_order(_counts(spark, d)), "step int, left string, right string, distance double, size int")


@query(f"WITH {_RESID} SELECT grp, code, 100.0::DOUBLE * n / cases AS share, greatest(-2, least(2, resid))::DOUBLE AS resid FROM rs WHERE n > 0")
def bubble_table(spark, d):
    return statistics.bubbles(_counts(spark, d), 2.0)


@query("SELECT CASE WHEN p_size < 10 THEN '<10' WHEN p_size < 50 THEN '10-50' WHEN p_size < 100 THEN '50-100' ELSE '>=100' END AS bucket, count(*) AS n FROM part GROUP BY bucket")
def dispersion_bucket(spark, d):
    return _t(spark, d, "part").groupBy(statistics.dispersion_bucket(F.col("p_size")).alias("bucket")).agg(F.count("*").alias("n"))


# -- classifiers -------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_WIDE} SELECT grp, {_REG} AS kind FROM wd")
def regulation_type(spark, d):
    c = F.col
    return _wide(spark, d).select("grp", classify.regulation_type(c("p"), c("n"), c("rp"), c("rn")).alias("kind"))


@query(f"WITH {_WIDE} SELECT grp, {_Z1} AS kind, coalesce(b / nullif(a + b, 0), 0) AS ban_share FROM wd")
def zone_type_v1(spark, d):
    c = F.col
    return _wide(spark, d).select("grp", classify.zone_type(c("a"), c("b"), c("ra"), c("rb"), 1).alias("kind"), classify.ban_share(c("a"), c("b")).alias("ban_share"))


@query(f"WITH {_WIDE} SELECT grp, {_Z2} AS kind FROM wd")
def zone_type_v2(spark, d):
    c = F.col
    return _wide(spark, d).select("grp", classify.zone_type(c("a"), c("b"), c("ra"), c("rb"), 2).alias("kind"))


@query(f"WITH {_WIDE}, x AS (SELECT grp, 100.0::DOUBLE * strict / cases AS score FROM wd) SELECT grp, score, {_LEVEL.format(s='score', a=5, b=2, c=0)} AS level FROM x")
def strictness(spark, d):
    score = classify.per_hundred([(F.col("strict"), 1)], F.col("cases"))
    return _wide(spark, d).select("grp", score.alias("score")).withColumn("level", classify.strictness(F.col("score")))


@query(f"WITH {_WIDE}, x AS (SELECT grp, 100.0::DOUBLE * strict / cases AS score FROM wd), q AS (SELECT quantile_cont(score, 0.75) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.25) AS c FROM x) SELECT grp, score, {_LEVEL.format(s='score', a='a', b='b', c='c')} AS relative FROM x CROSS JOIN q")
def strictness_relative(spark, d):
    score = classify.per_hundred([(F.col("strict"), 1)], F.col("cases"))
    return classify.relative_strictness(_wide(spark, d).select("grp", score.alias("score")), "score")


@query(f"WITH {_WIDE}, x AS (SELECT grp, 100.0::DOUBLE * part / cases AS part, 100.0::DOUBLE * proc / cases AS proc FROM wd) SELECT grp, {_PROCESS} AS kind FROM x")
def process_type(spark, d):
    c = F.col
    return _wide(spark, d).select("grp", classify.process_type(classify.per_hundred([(c("part"), 1)], c("cases")), classify.per_hundred([(c("proc"), 1)], c("cases"))).alias("kind"))


@query(f"""WITH {_WIDE}, x AS (SELECT * REPLACE (100.0::DOUBLE * part / cases AS part, 100.0::DOUBLE * proc / cases AS proc, 100.0::DOUBLE * strict / cases AS strict) FROM wd),
q AS (SELECT quantile_cont(strict, 0.75) AS q3, quantile_cont(strict, 0.5) AS q2, quantile_cont(strict, 0.25) AS q1 FROM x)
SELECT grp, cases, {_REG} AS regulation, {_Z2} AS zone, coalesce(b / nullif(a + b, 0), 0) AS ban_share, {_LEVEL.format(s='strict', a=5, b=2, c=0)} AS strictness, {_LEVEL.format(s='strict', a='q3', b='q2', c='q1')} AS relative, {_PROCESS} AS process,
round_even(strict, 1) AS strict_score, round_even(part, 1) AS part_score, round_even(proc, 1) AS proc_score FROM x CROSS JOIN q""")
def integrated(spark, d):
    return classify.integrated(_wide(spark, d))


# -- aggregates, sorts, sets --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus")
def value_counts(spark, d):
    return aggregates.value_counts(_t(spark, d, "orders"), "o_orderstatus")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority")
def crosstab(spark, d):
    return aggregates.crosstab(_t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT CASE WHEN grouping(lang) = 1 THEN 'All' ELSE lang END AS row_value, CASE WHEN grouping(source) = 1 THEN 'All' ELSE source END AS column_value, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY CUBE (lang, source)")
def crosstab_margins(spark, d):
    return aggregates.crosstab_margins(_t(spark, d, "documents"), "lang", "source")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS std FROM events GROUP BY event_type")
def score_stats(spark, d):
    out = aggregates.score_stats(_t(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) if c in ("mean", "median", "std") else c for c in ("mean", "median", "min", "max", "std")])


@query("SELECT count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, min(c_acctbal) AS min, round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(quantile_cont(c_acctbal, 0.5), 6) AS q50, round(quantile_cont(c_acctbal, 0.75), 6) AS q75, max(c_acctbal) AS max FROM customer")
def quartiles(spark, d):
    out = aggregates.describe(_t(spark, d, "customer"), "c_acctbal")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "max")


@query("SELECT count(*) FILTER (l_tax > 0.04) AS l_tax, count(*) FILTER (l_discount > 0.04) AS l_discount FROM lineitem")
def threshold_counts(spark, d):
    return aggregates.above(_t(spark, d, "lineitem"), ["l_tax", "l_discount"], 0.04)


@query("SELECT source, lang, min(doc_id) AS doc_id, count(*) AS n_rows FROM documents GROUP BY source, lang")
def dedup_first_wins(spark, d):
    return aggregates.first_wins(_t(spark, d, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])


@query("SELECT DISTINCT w AS term FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark UNION ALL SELECT p_brand FROM part) WHERE w <> ''")
def union_terms(spark, d):
    words = _t(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("term"))
    return words.union(_t(spark, d, "part").select("p_brand")).filter("term <> ''").distinct()


@query("SELECT DISTINCT w AS term FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' EXCEPT SELECT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark)")
def removed_terms(spark, d):
    words = lambda t: t.select(F.explode(F.split("text", " ")).alias("term")).filter("term <> ''")
    return words(_t(spark, d, "documents")).subtract(words(_t(spark, d, "benchmark")))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def top_rows(spark, d):
    return _t(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)


# -- store, joins, ledger ------------------------------------------------------------------------------------------------------------------


def _store(spark, d):
    coded = _coded(spark, d).select(F.col("source").alias("municipality"), F.lit("2020").alias("year"), F.col("lang").alias("category"), F.col("doc_id").alias("h5"), "dan", F.col("s").alias("text"), "codes")
    return store.build(coded)


_STORE = f"{_LINES}, {_CODES}, tw AS (SELECT DISTINCT source AS name FROM documents), cn AS (SELECT doc_id * 16777216 + dan AS id, doc_id AS h5, source, lang, dan, s FROM ln)"


@query(f"WITH {_STORE} SELECT id, source AS municipality, array_to_string(list_sort(list_filter([{_HITS}], lambda x: x IS NOT NULL)), '|') AS codes FROM cn")
def store_paragraph_codes(spark, d):
    t = _store(spark, d)
    named = t["paragraphs"].join(t["municipalities"].select(F.col("id").alias("municipality_id"), F.col("name").alias("municipality")), "municipality_id")
    return store.codes_of(named, t["paragraph_codings"], t["coding_types"]).select("id", "municipality", F.array_join("codes", "|").alias("codes"))


@query(f"WITH {_STORE} SELECT id, h5, source AS municipality, s AS text FROM cn WHERE contains(s, 'that')")
def export_by_code(spark, d):
    t = _store(spark, d)
    return store.export_by_code(t["paragraphs"], t["paragraph_codings"], t["municipalities"], store.code_id(t["coding_types"], "*P"), ["id", "h5", "municipality", "text"])


#: The four tables in SQL, and the same with rows that break each rule.
_TABLES = f"""{_STORE}, mun AS (SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT source AS name FROM ln WHERE source IS NOT NULL)),
typ AS (SELECT row_number() OVER (ORDER BY code) AS id, code FROM (SELECT DISTINCT code FROM ln JOIN cd ON contains(s, w))),
par AS (SELECT cn.id, mun.id AS municipality_id, h5, dan, s FROM cn JOIN mun ON source = name),
cod AS (SELECT par.id || '-' || typ.id AS id, par.id AS paragraph_id, typ.id AS coding_type_id FROM par JOIN cd ON contains(s, w) JOIN typ USING (code))"""
_BROKEN = f"""{_TABLES}, mun2 AS (SELECT * FROM mun UNION ALL SELECT * FROM mun WHERE id % 4 = 1),
typ2 AS (SELECT * FROM typ UNION ALL SELECT id + 100, code FROM typ WHERE id % 3 = 0 UNION ALL SELECT id, code || 'x' FROM typ WHERE id % 5 = 0),
par2 AS (SELECT id, CASE WHEN h5 % 70 = 3 THEN municipality_id + 1000 ELSE municipality_id END AS municipality_id FROM par UNION ALL SELECT id, municipality_id FROM par WHERE h5 % 50 = 0 AND dan = 1),
cod2 AS (SELECT * FROM cod UNION ALL SELECT 'again-' || id, paragraph_id, coding_type_id FROM cod WHERE paragraph_id % 97 = 0 UNION ALL SELECT id, -1 - paragraph_id, coding_type_id + 1000 FROM cod WHERE paragraph_id % 101 = 0)"""


def _twice(table: str, columns: str) -> str:
    return f"SELECT count(*) AS n FROM (SELECT 1 FROM {table} GROUP BY {columns} HAVING count(*) > 1)"


def _lost(child: str, column: str, parent: str) -> str:
    return f"SELECT count(*) FROM {child} WHERE {column} NOT IN (SELECT id FROM {parent})"


_CHECKED = {
    "unique municipalities(id)": _twice("mun2", "id"), "unique coding_types(id)": _twice("typ2", "id"), "unique paragraphs(id)": _twice("par2", "id"), "unique paragraph_codings(id)": _twice("cod2", "id"),
    "unique municipalities(name)": _twice("mun2", "name"), "unique coding_types(code)": _twice("typ2", "code"), "unique paragraph_codings(paragraph_id, coding_type_id)": _twice("cod2", "paragraph_id, coding_type_id"),
    "paragraphs.municipality_id -> municipalities": _lost("par2", "municipality_id", "mun2"), "paragraph_codings.paragraph_id -> paragraphs": _lost("cod2", "paragraph_id", "par2"), "paragraph_codings.coding_type_id -> coding_types": _lost("cod2", "coding_type_id", "typ2"),
}


def _broken_store(spark, d):
    """The store with rows that break every rule: repeated ids, names and codes, repeated pairs, references to nothing."""
    t = _store(spark, d)
    mun, typ, par, cod = (t[k] for k in ("municipalities", "coding_types", "paragraphs", "paragraph_codings"))
    typ = typ.unionByName(typ.filter("id % 3 = 0").withColumn("id", F.col("id") + 100)).unionByName(typ.filter("id % 5 = 0").withColumn("code", F.concat("code", F.lit("x"))))
    moved = par.withColumn("municipality_id", F.when(F.col("h5") % 70 == 3, F.col("municipality_id") + 1000).otherwise(F.col("municipality_id")))
    again = cod.filter("paragraph_id % 97 = 0").withColumn("id", F.concat(F.lit("again-"), "id"))
    astray = cod.filter("paragraph_id % 101 = 0").withColumn("paragraph_id", -1 - F.col("paragraph_id")).withColumn("coding_type_id", F.col("coding_type_id") + 1000)
    return {
        "municipalities": mun.unionByName(mun.filter("id % 4 = 1")), "coding_types": typ, "paragraphs": moved.unionByName(par.filter("h5 % 50 = 0 AND dan_number = 1")),
        "paragraph_codings": cod.unionByName(again).unionByName(astray),
    }


@query(f"WITH {_BROKEN} " + " UNION ALL ".join(f"SELECT '{name}' AS \"check\", ({sql})::BIGINT AS n" for name, sql in _CHECKED.items()))
def store_checks(spark, d):
    return store.violations(_broken_store(spark, d))


@query(f"WITH {_STORE} SELECT id, s AS text FROM cn WHERE h5 = 3 AND dan = 1")
def paragraph_lookup(spark, d):
    return _store(spark, d)["paragraphs"].filter(F.col("id") == 3 * (1 << 24) + 1).select("id", "text")


@query("SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)")
def enrich_left(spark, d):
    marks = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return store.enrich(_t(spark, d, "documents").select("doc_id", "source"), marks, "doc_id")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def resolve_names(spark, d):
    regions = _t(spark, d, "region")
    nations = _t(spark, d, "nation").join(regions.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")), "n_regionkey").select("n_nationkey", "n_name", "region")
    back = store.resolve(nations, regions.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), "region", "rid")
    return back.join(regions, F.col("rid") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def first_match_lookup(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return store.first_match(_t(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"], "o_orderkey")


@query(f"WITH {_LINES} SELECT doc_id, dan FROM ln WHERE contains(s, 'that') AND contains(s, 'with')")
def filter_all_codes(spark, d):
    return store.having_all(_coded(spark, d), ["*P", "*N"]).select("doc_id", "dan")


@query("SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS info FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def map_info(spark, d):
    counts = _t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.transform(F.map_entries("info"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["n"].cast("string"))))
    return store.info_map(counts, "lang", ["source"]).select("source", F.array_join(entries, ",").alias("info"))


@query("SELECT d.doc_id, md5(CASE WHEN t.doc_id IS NULL THEN text ELSE '[withdrawn]' END) AS text, CASE WHEN t.doc_id IS NOT NULL THEN md5(text) END AS previous, t.doc_id IS NOT NULL AS stamped FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t USING (doc_id)")
def edited_snapshot(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    marks = _t(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct().join(docs, "doc_id", "left_semi").withColumn("value", F.lit("[withdrawn]"))
    new = store.edited(docs, "doc_id", "text", marks, F.lit("2020-01-01T00:00:00Z"))
    return new.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), F.md5(F.col("previous").cast("binary")).alias("previous"), F.col("edited_at").isNotNull().alias("stamped"))


_ENTRIES = "e AS (SELECT c_custkey, c_name AS municipality, unnest(['Ordinance_HTML', 'Regulation_HTML', 'Ordinance_PDF', 'Regulation_PDF']) AS doc_type, unnest([c_custkey % 2 = 0, c_custkey % 3 = 0, true, c_custkey % 5 = 0]) AS there FROM customer), en AS (SELECT municipality, doc_type FROM e WHERE there)"


def _entries(spark, d):
    k = F.col("c_custkey")
    url = lambda cond, kind: F.when(cond, F.concat(F.lit(' "http://x/'), k.cast("string"), F.lit(kind), F.lit('" '))).alias(kind)
    urls = _t(spark, d, "customer").select(F.col("c_name").alias("Municipality"), F.lit("p").alias("Prefecture"), url(k % 2 == 0, "Ordinance_HTML"), url(k % 3 == 0, "Regulation_HTML"), url(F.lit(True), "Ordinance_PDF"), url(k % 5 == 0, "Regulation_PDF"))
    return ledger.url_entries(urls)


@query(f"WITH {_ENTRIES} SELECT municipality, doc_type FROM en")
def url_entries(spark, d):
    return _entries(spark, d).select("municipality", "doc_type")


@query(f"WITH {_ENTRIES} SELECT municipality, doc_type FROM en WHERE doc_type LIKE '%_PDF' AND municipality IN (SELECT municipality FROM en WHERE doc_type LIKE '%_HTML' GROUP BY municipality HAVING count(*) = 2)")
def skip_pdf_if_html(spark, d):
    return ledger.skippable_pdfs(_entries(spark, d)).select("municipality", "doc_type")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 10 = 0)")
def not_yet_fetched(spark, d):
    fetched = _t(spark, d, "orders").filter("o_orderstatus = 'P' OR o_orderkey % 10 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return ledger.to_fetch(_t(spark, d, "customer").select("c_custkey"), fetched, ["c_custkey"])


@query("SELECT year(o_orderdate)::INT AS year, count(*) FILTER (o_orderstatus = 'F') AS fetched, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) FILTER (o_orderstatus = 'P') AS errors, count(*) AS records FROM orders GROUP BY ROLLUP (year(o_orderdate))")
def ledger_summary(spark, d):
    rows = _t(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "O", "skipped").alias("status"), F.when(F.col("o_orderstatus") == "P", "error").alias("error"))
    return ledger.summary(rows)


@query("SELECT 2020 AS year, sha256(text) AS bytes_sha256, count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def dup_hash(spark, d):
    return ledger.duplicate_contents(_t(spark, d, "documents").select(F.lit(2020).alias("year"), F.sha2("text", 256).alias("bytes_sha256")))


# -- terms -----------------------------------------------------------------------------------------------------------------------------------

#: Endings of words of the corpus stand in for suffixes, laws and ordinances.
LISTS = terms.Lists(suffixes=("tion", "heit", "mente", "ement"), curated=("the", "nation"), laws=("ungen",), law_ending="ung", ordinance_ending="able", run="[A-Za-z]+", name="[A-Za-z]+")


def _candidates(spark, d):
    return terms.candidates(_t(spark, d, "documents"), LISTS, whole=True)


_CAND = "cand AS (SELECT DISTINCT w AS term FROM (SELECT unnest(list_concat(list_concat(regexp_extract_all(text, '[A-Za-z]+(?:tion|heit|mente|ement)'), regexp_extract_all(text, '[A-Za-z]+ung')), regexp_extract_all(text, '[A-Za-z]+able'))) AS w FROM documents) WHERE length(w) BETWEEN 2 AND 50)"


@query(f"WITH {_CAND} SELECT term FROM cand")
def term_candidates(spark, d):
    return _candidates(spark, d)


@query(f"WITH {_CAND}, f AS (SELECT term FROM cand WHERE length(term) <= 40 UNION SELECT unnest(['the', 'nation', 'ungen'])) SELECT (SELECT count(*) FROM (SELECT term FROM cand UNION SELECT unnest(['the', 'nation', 'ungen']))) AS terms, count(*) AS stage_1, count(*) AS stage_2, count(*) AS stage_3, count(*) FILTER (length(term) <= 30) AS stage_4, count(*) FILTER (length(term) <= 30) AS stage_5, count(*) FILTER (length(term) <= 30) AS stage_6 FROM f")
def term_funnel(spark, d):
    return terms.funnel_counts(terms.funnel(_candidates(spark, d), LISTS))


#: Terms of Japanese ordinances, with the filter that takes each away (0: none); # stands for the key of a region.
_JAPANESE_LISTS = terms.Lists(suffixes=("区域", "届出"), curated=("事業計画の届出", "その区域"), laws=("森林法",))
_TERMS = (
    ("禁止区域#", 0), ("太陽光発電設備#の設置", 0), ("森林法", 0), ("事業計画の届出", 0), ("その区域", 0), ("区域", 1), ("申請書", 1), ("第#条", 1), ("第#号", 1), ("道路法(昭和#", 1), ("とても長い名前の設備に関する事前の説明会の開催及び結果の報告に係る様式の届出の区域その#", 1),
    ("#)届出", 2), ("同法", 2), ("前項", 2), ("次に掲げる区域#", 2), ("住民票#の写し", 2), ("第#条の２第１項の区域", 2), ("河川法", 3), ("法律#の区域", 3), ("農地#法", 3), ("町条例(案#", 3), ("この条例の区域#", 4), ("当該#区域", 4), ("上記#区域", 4), ("氏名及び住所#届出", 4), ("設備の維持管理#及び撤去の届出の区域", 4), ("三十文字を越える長い名前を持つ届出の区域と名前の対象の地域の一覧#", 4),
    ("な設置#届出", 5), ("に規定する#区域", 5), ("町#の条例", 5), ("令和#年町条例", 5), ("防災", 5), ("景観", 5), ("塀(届出#", 6), ("様式第#号届出", 6), ("を行う者の氏名#", 6),
)


@query("SELECT DISTINCT replace(t, '#', r_regionkey::VARCHAR) AS term, lost FROM region, (VALUES " + ", ".join(f"('{t}', {k})" for t, k in _TERMS) + ") AS v(t, lost)")
def term_filters(spark, d):
    """For each term the first filter that it does not pass."""
    made = _t(spark, d, "region").select(F.explode(F.array(*[F.replace(F.lit(t), F.lit("#"), F.col("r_regionkey").cast("string")) for t, _ in _TERMS])).alias("term")).distinct()
    flags = terms.funnel(made, _JAPANESE_LISTS)
    return flags.select("term", F.coalesce(*[F.when(~F.col(f"stage_{k}"), k) for k in range(1, 7)], F.lit(0)).alias("lost"))


@query(f"WITH {_CAND}, o AS (SELECT length(term) AS n, row_number() OVER (ORDER BY length(term)) AS k, count(*) OVER () AS c FROM cand) SELECT count(*) AS terms, avg(n) AS mean, min(n)::INT AS min, max(n)::INT AS max, (max(n) FILTER (k = c // 2 + 1))::INT AS median FROM o")
def term_length_stats(spark, d):
    return terms.length_stats(_candidates(spark, d))


@query(f"WITH {_CAND} SELECT term, '8000' AS cost, '名詞' AS pos1, term AS base FROM cand")
def dictionary_rows(spark, d):
    return terms.mecab_rows(_candidates(spark, d)).select("term", "cost", "pos1", "base")


# -- extensions -------------------------------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    out = stream.event_windows(_t(spark, d, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {_LINES}, {_CODES} SELECT source AS grp, code, count(*) AS n FROM ln JOIN cd ON contains(s, w) OR contains(lower(s), w) GROUP BY ALL")
def running_counts(spark, d):
    coded = stream.coded_paragraphs(_t(spark, d, "documents"), _rules(RULES_TEXT), ["doc_id", "source"])
    return stream.running_counts(coded, F.col("source"))


# -- remaining scalars, predicates and set operations ----------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'html' WHEN c_custkey % 3 = 1 THEN 'pdf' END AS kind FROM customer")
def file_kinds(spark, d):
    end = F.when(F.col("c_custkey") % 3 == 0, "_HTML.txt").when(F.col("c_custkey") % 3 == 1, "_PDF.txt").otherwise(".md")
    return _t(spark, d, "customer").select("c_custkey", text.file_kind(F.concat("c_name", end)).alias("kind"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_custkey / 4 END::DOUBLE AS n, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey / 4 END::DOUBLE AS share FROM customer")
def coerced_numbers(spark, d):
    k = F.col("c_custkey")
    cell = F.when(k % 4 == 0, F.when(k % 8 == 0, "n/a")).otherwise((k / 4).cast("string"))
    part = F.when(k % 4 == 0, "NA").otherwise(F.concat((k / 4).cast("string"), F.lit("%")))
    return _t(spark, d, "customer").select("c_custkey", text.number(cell).alias("n"), text.percent(part).alias("share"))


@query("SELECT o_orderkey, (o_orderstatus = 'F') AS final, (o_orderkey % 3 = 0) AS marked FROM orders")
def cell_tests(spark, d):
    ending = F.when(F.col("o_orderstatus") == "F", "とする。）").otherwise("とする、")
    cell = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise(" True ")).when(F.col("o_orderkey") % 3 == 1, "0")
    return _t(spark, d, "orders").select("o_orderkey", text.sentence_final(ending).alias("final"), text.truthy(cell).alias("marked"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey <> 0 AND l_linenumber % 3 <> 0 THEN l_orderkey || '-' || (l_linenumber % 3) ELSE '' END AS label FROM lineitem")
def paragraph_labels(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.paragraph_label(F.col("l_orderkey"), F.col("l_linenumber") % 3).alias("label"))


@query("SELECT p_partkey, replace(replace(p_brand, 'Brand#1', 'one-'), 'Brand#2', 'two-') AS label FROM part")
def shortened_labels(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.shorten(F.col("p_brand"), {"Brand#1": "one-", "Brand#2": "two-"}).alias("label"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS url, CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'application/pdf' END AS base FROM pages")
def valid_urls(spark, d):
    even = F.col("page_id") % 2 == 0
    cell = F.when(even, F.concat(F.lit('　"'), F.col("url"), F.lit('" '))).otherwise(F.concat(F.lit("ftp:"), F.col("url")))
    kind = F.when(even, "Text/HTML ; charset=utf-8").otherwise("application/pdf")
    return _t(spark, d, "pages").select("page_id", text.valid_url(cell).alias("url"), text.content_base(kind).alias("base"))


@query("SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL UNION ALL SELECT DISTINCT c_custkey, 'F' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def insert_ignore(spark, d):
    there = _t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s")).distinct()
    more = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("F").alias("s"))
    return store.insert_ignore(there, more.unionByName(more), ["k", "s"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def append_new_rows(spark, d):
    orders = _t(spark, d, "orders")
    first = orders.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return tables.append_new(orders.filter("o_orderstatus = 'F'").select("o_custkey"), first, ["o_custkey"])


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def missing_outputs(spark, d):
    return tables.missing_outputs(_t(spark, d, "lineitem").select("l_partkey"), _t(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1995")
def year_filter(spark, d):
    return tables.in_years(_t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), "1993-1995")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def latest_year(spark, d):
    return tables.in_years(_t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), None)


@query(f"WITH {_WIDE}, z AS (SELECT *, {_Z2} AS zone FROM wd) SELECT zone, count(*) AS n, round(avg(CASE WHEN a + b > 0 THEN b / (a + b) ELSE 0 END), 6) AS ban FROM z GROUP BY zone")
def zone_stats(spark, d):
    w = _wide(spark, d)
    c = lambda k: F.col(k)
    rows = w.select(classify.zone_type(c("a"), c("b"), c("ra"), c("rb")).alias("zone"), classify.ban_share(c("a"), c("b")).alias("ban"))
    return rows.groupBy("zone").agg(F.count("*").alias("n"), F.round(F.avg("ban"), 6).alias("ban"))


@query(f"WITH {_LINES} SELECT doc_id, dan, s FROM ln WHERE source = (SELECT min(source) FROM documents) ORDER BY doc_id, dan LIMIT 3")
def first_rows_of_group(spark, d):
    rows = _lines(spark, d)
    one = _t(spark, d, "documents").agg(F.min("source").alias("source"))
    return rows.join(F.broadcast(one), "source").select("doc_id", "dan", "s").orderBy("doc_id", "dan").limit(3)


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL ORDER BY value")
def value_counts_by_label(spark, d):
    return aggregates.value_counts(_t(spark, d, "orders"), "o_orderstatus").orderBy("value")


@query("SELECT source, length(s) AS n, s FROM (SELECT source, lang || ':' || n_chars AS s FROM documents) ORDER BY n DESC, s, source")
def longest_first(spark, d):
    rows = _t(spark, d, "documents").select("source", F.concat_ws(":", "lang", "n_chars").alias("s"))
    return rows.select("source", F.length("s").cast("bigint").alias("n"), "s").orderBy(F.desc("n"), "s", "source")


@query("SELECT doc_id, string_agg(w, ' ' ORDER BY length(w) DESC, w) AS words FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY doc_id")
def keywords_longest_first(spark, d):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    # A filter on the words would be pushed below them, and sort them a second time.
    rows = _t(spark, d, "documents").filter(F.col("text").rlike("[A-Za-z]"))
    return rows.select("doc_id", F.array_join(text.longest_first(words), " ").alias("words"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 < 2")
def suspicious_terms(spark, d):
    k = F.col("c_custkey") % 4
    ending = F.when(k == 0, "条例を定める規則の案").when(k == 1, "の(要綱)").when(k == 2, "に関する特別措置条例").otherwise("")
    return terms.suspicious(_t(spark, d, "customer").select("c_custkey", F.concat("c_name", ending).alias("term"))).select("c_custkey")


@query("SELECT DISTINCT w AS term, '5000' AS cost, w AS normalized FROM (SELECT p_brand AS w FROM part UNION ALL SELECT r_name FROM region)")
def dictionary_rows_18(spark, d):
    words = _t(spark, d, "part").select(F.col("p_brand").alias("term")).union(_t(spark, d, "region").select("r_name"))
    return terms.sudachi_rows(words).select("term", "cost", "normalized")


# -- filters, column choices and display forms ------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, dan FROM ln WHERE source = (SELECT max(source) FROM documents)")
def municipality_filter(spark, d):
    name = _t(spark, d, "documents").agg(F.max("source").alias("m")).first()["m"]
    return views.of_municipality(_lines(spark, d), name, "source").select("doc_id", "dan")


@query("SELECT doc_id, quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) WHERE quality IS NOT NULL")
def analysed_only(spark, d):
    marks = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return views.analysed(store.enrich(_t(spark, d, "documents").select("doc_id"), marks, "doc_id"), "quality")


@query(f"WITH {_WIDE}, z AS (SELECT grp, {_Z2} AS zone FROM wd) SELECT grp, zone FROM z WHERE zone IN ('2層構造(抑制+禁止)', '禁止地区制', '抑制地区制') AND grp <> ''")
def attribute_filter(spark, d):
    c = F.col
    rows = _wide(spark, d).select("grp", classify.zone_type(c("a"), c("b"), c("ra"), c("rb")).alias("zone"), F.when(c("grp") != "", "named").alias("kind"))
    return views.matching(rows, zone=["2層構造(抑制+禁止)", "禁止地区制", "抑制地区制"], kind="named").select("grp", "zone")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate FROM lineitem")
def column_family(spark, d):
    return views.column_family(_t(spark, d, "lineitem"), "key$|^l_ship", ["l_linenumber"])


@query("SELECT lang AS row_value, source AS column_value, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL")
def without_summary_rows(spark, d):
    table = aggregates.crosstab_margins(_t(spark, d, "documents"), "lang", "source")
    return views.without_summary(views.without_summary(table, "row_value", ("All",)), "column_value", ("All",))


@query("SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 60")
def seeded_sample(spark, d):
    return views.seeded_sample(_t(spark, d, "documents").select("doc_id", "source"), 60, 7, "doc_id")


@query("SELECT o_orderkey, printf('%.2f', o_totalprice) AS price, printf('%.2f%%', (o_orderkey % 1000)::DOUBLE / 80000 * 100) AS share, printf('%.2f', (o_orderkey % 5000 + 0.5::DOUBLE) / 100) AS tie, printf('%.2f', (o_orderkey % 999)::DOUBLE / 8) AS eighths FROM orders")
def formatted_numbers(spark, d):
    k = F.col("o_orderkey")
    tie, eighths = views.fixed((k % 5000 + 0.5) / 100), views.fixed((k % 999).cast("double") / 8)
    return _t(spark, d, "orders").select("o_orderkey", views.fixed(F.col("o_totalprice")).alias("price"), views.percent_text((k % 1000).cast("double") / 80000).alias("share"), tie.alias("tie"), eighths.alias("eighths"))


@query(f"WITH {_RESID}, b AS (SELECT max(100.0 * n / cases) AS top FROM rs WHERE cases > 0) SELECT list_filter([0.01, 0.1, 1.0, 5.0, 20.0, 1000.0]::DOUBLE[], lambda x: x >= 0.05 AND x <= top) AS shown, 0.05::DOUBLE AS lower, ceil(top)::DOUBLE AS upper FROM b")
def legend_breaks(spark, d):
    return views.legend_breaks(statistics.bubbles(_counts(spark, d)), "share", [0.01, 0.1, 1.0, 5.0, 20.0, 1000.0])


@query()
def chi2_stars(spark, d):
    return statistics.chi_square_stars(_counts(spark, d))


@query(f"WITH {_CAND} SELECT 'laws' AS category, count(*) FILTER (term IN ('森林法', '農地法')) AS n FROM (SELECT term FROM cand UNION ALL SELECT DISTINCT replace(t, '#', r_regionkey::VARCHAR) FROM region, (VALUES {', '.join(f"('{t}')" for t, _ in _TERMS)}) AS v(t)) UNION ALL SELECT 'ab', count(*) FILTER (contains(term, 'ab')) FROM cand UNION ALL SELECT 'endings', count(*) FILTER (contains(term, 'tion') OR contains(term, 'heit')) FROM cand UNION ALL SELECT 'areas', count(DISTINCT replace(t, '#', r_regionkey::VARCHAR)) FROM region, (VALUES {', '.join(f"('{t}')" for t, _ in _TERMS)}) AS v(t) WHERE contains(t, '区域') OR contains(t, '地域')")
def term_categories(spark, d):
    made = _t(spark, d, "region").select(F.explode(F.array(*[F.replace(F.lit(t), F.lit("#"), F.col("r_regionkey").cast("string")) for t, _ in _TERMS])).alias("term")).distinct()
    return terms.category_counts(_candidates(spark, d).unionByName(made), ("森林法", "農地法"), {"ab": ("ab",), "endings": ("tion", "heit"), "areas": ("区域", "地域")})


@query(f"WITH {_STORE}, one AS (SELECT min(id) AS id FROM cn WHERE contains(s, 'that') AND contains(s, 'with')) SELECT code FROM cn JOIN one USING (id) JOIN cd ON contains(s, w)")
def paragraph_codings(spark, d):
    t, p = _store(spark, d), F.col("paragraph_id")
    both = t["paragraph_codings"].join(t["coding_types"].filter("code IN ('*P', '*N')").select(F.col("id").alias("coding_type_id")), "coding_type_id")
    found = both.groupBy(p).agg(F.count("*").alias("n")).filter("n = 2").agg(F.min(p).alias("id")).first()["id"]
    return store.codings_of(-1 if found is None else found, t["paragraph_codings"], t["coding_types"]).select("code")


@query(f"WITH {_STORE} SELECT 'municipalities' AS \"table\", (SELECT count(*) FROM tw WHERE name IS NOT NULL AND name IN (SELECT source FROM ln)) AS n_rows UNION ALL SELECT 'coding_types', (SELECT count(DISTINCT code) FROM ln JOIN cd ON contains(s, w)) UNION ALL SELECT 'paragraphs', (SELECT count(*) FROM cn) UNION ALL SELECT 'paragraph_codings', (SELECT count(*) FROM ln JOIN cd ON contains(s, w))")
def table_counts(spark, d):
    return store.table_counts(_store(spark, d))


@query("SELECT * FROM (VALUES ('municipalities', 'primary key', 'id', NULL), ('coding_types', 'primary key', 'id', NULL), ('paragraphs', 'primary key', 'id', NULL), ('paragraph_codings', 'primary key', 'id', NULL), ('municipalities', 'unique', 'name', NULL), ('coding_types', 'unique', 'code', NULL), ('paragraph_codings', 'unique', 'paragraph_id, coding_type_id', NULL), ('paragraphs', 'reference', 'municipality_id', 'municipalities(id)'), ('paragraph_codings', 'reference', 'paragraph_id', 'paragraphs(id)'), ('paragraph_codings', 'reference', 'coding_type_id', 'coding_types(id)'), ('paragraphs', 'index', 'municipality_id', NULL), ('paragraph_codings', 'index', 'paragraph_id', NULL), ('paragraph_codings', 'index', 'coding_type_id', NULL)) AS t(\"table\", kind, columns, target)")
def schema_constraints(spark, d):
    return store.constraints(spark)


@query("SELECT n_regionkey, '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS document FROM nation GROUP BY n_regionkey")
def nested_json(spark, d):
    return store.nested_documents(_t(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name"), "n_regionkey")


@query()
def reflow_html(spark, d):
    return lines.reflow_text(_t(spark, d, "documents"), "doc_id", "text")


@query(rf"""WITH {_LINES}, m AS (SELECT *, regexp_matches(s, '^[ET]') AS marks, lag(s) OVER w AS before FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY dan)),
g AS (SELECT *, NOT marks OR before IS NULL AS begins FROM m), h AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY dan) AS g FROM g)
SELECT doc_id, min(dan) AS i, string_agg(s, '' ORDER BY dan) AS s FROM h GROUP BY doc_id, g""")
def items_without_stop(spark, d):
    """The older joining of items: no full stop goes between."""
    return lines.join_items(_lines(spark, d).select("doc_id", F.col("dan").alias("i"), "s"), "doc_id", marker="^[ET]", stop="")


LOGIC_TEXT = "*AND\nthat and with\n\n*NOT\nthat and not ( with or from )\n\n*DEEP\n( und or que ) and not that or this and with and not from"


@query(f"WITH {_LINES}, k AS (SELECT doc_id, dan, contains(s, 'that') AS a, contains(s, 'with') AS b, contains(s, 'from') AS c, contains(s, 'und') AS e, contains(s, 'que') AS f, contains(s, 'this') AS g FROM ln) SELECT doc_id, dan, a AND b AS both, a AND NOT (b OR c) AS without, ((e OR f) AND NOT a) OR (g AND b AND NOT c) AS deep FROM k")
def rule_logic(spark, d):
    codes = rules.codes(_rules(LOGIC_TEXT), F.col("s"), F.array().cast("array<string>"))
    has = lambda c: F.array_contains("codes", c)
    return _lines(spark, d).withColumn("codes", codes).select("doc_id", "dan", has("*AND").alias("both"), has("*NOT").alias("without"), has("*DEEP").alias("deep"))


@query("SELECT c_custkey, c_custkey % 4 IN (0, 1, 2) AS item FROM customer")
def item_markers(spark, d):
    k = F.col("c_custkey") % 4
    line = F.concat(F.when(k == 0, "(12) ").when(k == 1, "（3）").when(k == 2, "ア ").otherwise("第1 "), "c_name")
    return _t(spark, d, "customer").select("c_custkey", lines.is_item(line).alias("item"))


@query("SELECT p_partkey, contains(p_type, 'A') AS hit FROM part")
def escaped_words(spark, d):
    cell = F.concat(F.lit("a.b(["), "p_type")
    return _t(spark, d, "part").select("p_partkey", F.concat(cell, F.lit("\\E")).rlike(text.regex_escape("a.b([") + ".*A.*" + text.regex_escape("\\E")).alias("hit"))


#: Texts, and the encodings in which they are met.
_PHRASES = ("第１条　この条例は、太陽光発電設備の設置に関し必要な事項を定めるものとする。", "ﾊﾟﾈﾙ設置ﾉ届出", "事業者は、森林法の区域に設置してはならない。")
_PLACES = ("Le règlement général a été adopté à l'unanimité.", "Für größere Flächen gilt §5.")
_ENCODED = [(t, e, t.encode(e).hex()) for ts, es in ((_PHRASES, ("utf-8", "cp932", "euc_jp", "iso2022_jp", "utf-16", "utf-16-le", "utf-8-sig")), (_PLACES, ("utf-8", "cp1252"))) for t in ts for e in es if not (e == "iso2022_jp" and "ﾊ" in t)]


@query("SELECT 'document' AS kind, doc_id AS id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL UNION ALL SELECT e, n_nationkey, sha256(t || CASE WHEN e LIKE 'utf-16%' THEN '' ELSE ' ' || n_name END) FROM nation, (VALUES " + ", ".join("('{}', '{}')".format(t.replace("'", "''"), e) for t, e, _ in _ENCODED) + ") AS v(t, e)")
def decoded_bytes(spark, d):
    """The corpus' texts, and phrases in other encodings before the names of a table."""
    raw = _t(spark, d, "documents").filter("text IS NOT NULL").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("bytes"))
    phrases = F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(h).alias("h")) for _, e, h in _ENCODED])).alias("p")
    name = F.when(F.col("p.e").startswith("utf-16"), F.lit("")).otherwise(F.concat(F.lit(" "), "n_name"))
    made = _t(spark, d, "nation").select("n_nationkey", "n_name", phrases).select(F.col("p.e").alias("kind"), F.col("n_nationkey").cast("bigint").alias("id"), F.unhex(F.concat("p.h", F.hex(name))).alias("bytes"))
    return raw.unionByName(made).select("kind", "id", F.sha2(text.decode_detected(F.col("bytes")), 256).alias("digest"))


_REQUIRED = {"documents": ("doc_id", "text", "source", "year"), "labels": ("doc_id", "toxic", "score"), "nation": ("n_name", "n_area")}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS n_rows, coalesce((SELECT string_agg(c, ', ' ORDER BY c) FROM (VALUES {', '.join(f"('{c}')" for c in names)}) AS v(c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE {t}))), '') AS missing" for t, names in _REQUIRED.items()))
def required_columns(spark, d):
    """Which of the columns that a step wants its table lacks."""
    parts = []
    for name, wanted in _REQUIRED.items():
        df = _t(spark, d, name)
        parts.append(df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(", ".join(sorted(classify.missing_columns(df, wanted)))).alias("missing")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_DISTINCT = "SELECT count(DISTINCT ({c})) FROM {t}"
_DECLARED = [
    ("municipalities", "primary key", "id", None, "mun", "id"), ("coding_types", "primary key", "id", None, "typ", "id"), ("paragraphs", "primary key", "id", None, "par", "id"), ("paragraph_codings", "primary key", "id", None, "cod", "id"),
    ("municipalities", "unique", "name", None, "mun", "name"), ("coding_types", "unique", "code", None, "typ", "code"), ("paragraph_codings", "unique", "paragraph_id, coding_type_id", None, "cod", "paragraph_id, coding_type_id"),
    ("paragraphs", "reference", "municipality_id", "municipalities(id)", "par", "municipality_id"), ("paragraph_codings", "reference", "paragraph_id", "paragraphs(id)", "cod", "paragraph_id"), ("paragraph_codings", "reference", "coding_type_id", "coding_types(id)", "cod", "coding_type_id"),
    ("paragraphs", "index", "municipality_id", None, "par", "municipality_id"), ("paragraph_codings", "index", "paragraph_id", None, "cod", "paragraph_id"), ("paragraph_codings", "index", "coding_type_id", None, "cod", "coding_type_id"),
]


@query(f"WITH {_TABLES} " + " UNION ALL ".join("SELECT '{}' AS \"table\", '{}' AS kind, '{}' AS columns, {} AS target, ({})::BIGINT AS n_values".format(t, k, c, f"'{to}'" if to else "NULL::VARCHAR", _DISTINCT.format(c=cols, t=cte)) for t, k, c, to, cte, cols in _DECLARED))
def schema_constraints(spark, d):
    """The declared keys, references and indexes, with the number of distinct values that they hold in the store."""
    return store.constraints(_store(spark, d))


_SCORES = """par AS (SELECT *, 0.05::DOUBLE AS lo, top AS hi, top - 0.05 AS w FROM b),
c AS (SELECT *, j * q * pow(10.0::DOUBLE, z) AS step FROM par, (SELECT unnest(range(1, 5)) AS j), (VALUES (0, 1.0::DOUBLE), (1, 5), (2, 2), (3, 2.5), (4, 4), (5, 3)) AS v(i, q), (SELECT unnest(range(2, 15)) AS k), (SELECT unnest(range(-4, 5)) AS z)),
st AS (SELECT *, unnest(range(floor(hi / step)::BIGINT * j - (k - 1) * j, ceil(lo / step)::BIGINT * j + 1)) AS s FROM c WHERE step * (k - 1) BETWEEN w / 20 AND w * 20),
l AS (SELECT *, s * (step / j) AS a, s * (step / j) + step * (k - 1) AS z2 FROM st),
sc AS (SELECT *, 0.25 * (1 - i / 5.0::DOUBLE - j + CASE WHEN s % j = 0 AND a <= 0 AND z2 >= 0 THEN 1 ELSE 0 END) + 0.2 * (1 - 0.5 * (pow(hi - z2, 2) + pow(lo - a, 2)) / pow(0.1 * w, 2))
  + 0.5 * (2 - greatest(((k - 1) / (z2 - a)) / (4 / (greatest(z2, hi) - least(lo, a))), (4 / (greatest(z2, hi) - least(lo, a))) / ((k - 1) / (z2 - a)))) + 0.05 AS score FROM l),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, j, i, k, z, s) = 1)"""


@query(f"WITH {_RESID}, b AS (SELECT code, max(100.0::DOUBLE * n / cases) AS top FROM rs WHERE n > 0 GROUP BY code), {_SCORES.format(by='code')} SELECT code, list_transform(list_filter(list_transform(range(0, k), lambda x: a + x * step), lambda x: x >= 0.05 AND x <= hi), lambda x: round(x, 6)) AS shown, 0.05::DOUBLE AS lower, ceil(hi)::DOUBLE AS upper FROM best")
def computed_breaks(spark, d):
    """Breaks of the legend of each code, from the range of its shares; the SQL looks at all labellings."""
    out = views.computed_breaks(statistics.bubbles(_counts(spark, d)), "share", ["code"])
    return out.withColumn("shown", F.transform("shown", lambda x: F.round(x, 6)))


@query()
def ward_clusters(spark, d):
    return spark.createDataFrame(statistics.ward_clusters(_counts(spark, d)), "code string, place int, cluster int")


@query()
def charset_detected(spark, d):
    """Encoding and confidence of the pages, and of phrases in every encoding."""
    pages = _t(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.encode("html", "UTF-8").alias("bytes"))
    some = _t(spark, d, "nation").select("n_nationkey", F.posexplode(F.array(*[F.lit(h) for _, _, h in _ENCODED])).alias("p", "h")).select(F.concat_ws("-", F.lit("phrase"), "n_nationkey", "p").alias("id"), F.unhex("h").alias("bytes"))
    return pages.unionByName(some).withColumn("found", charset.detected("bytes")).select("id", "found.encoding", "found.confidence", F.sha2("found.text", 256).alias("digest"))
