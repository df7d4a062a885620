"""Guard queries on documents, labels, orders, events and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions.columns import clean_number, is_finite, number_class, strict_bool, try_double
from tracksieve.operators import guards as gd
from tracksieve.plans import fixtures as fx
from tracksieve.plans.registry import Query


def universe_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Labels against the document universe, with injected duplicates and out-of-range keys."""
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("caseid"))
    lab = fx.table(spark, d, "labels").select(F.col("doc_id").alias("caseid"))
    odd = lab.where("caseid % 13 = 0").unionByName(lab.where("caseid % 17 = 0").select((-F.col("caseid") - 1).alias("caseid")))
    return gd.completeness(lab.unionByName(odd), docs)


COMPLETENESS_SQL = """WITH r AS (SELECT doc_id AS caseid FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id%13=0
  UNION ALL SELECT -doc_id-1 FROM labels WHERE doc_id%17=0), n AS (SELECT caseid, count(*) AS c FROM r GROUP BY 1)
SELECT coalesce(n.caseid, u.doc_id) AS caseid, CASE WHEN c IS NULL THEN 'missing' WHEN u.doc_id IS NULL THEN 'extra' ELSE 'duplicate' END AS problem,
  coalesce(c,0)::BIGINT AS occurrences FROM n FULL JOIN documents u ON n.caseid=u.doc_id WHERE c IS NULL OR u.doc_id IS NULL OR c>1"""


def key_alignment(spark: SparkSession, d: str) -> DataFrame:
    a = fx.table(spark, d, "documents").select(F.col("doc_id").alias("caseid"))
    b = fx.table(spark, d, "labels").select((F.col("doc_id") + 50).alias("caseid"))
    return gd.key_alignment(a, b)


ALIGNMENT_SQL = """SELECT CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*)::BIGINT AS keys
 FROM (SELECT DISTINCT doc_id AS k FROM documents) a FULL JOIN (SELECT DISTINCT doc_id+50 AS k FROM labels) b ON a.k=b.k GROUP BY 1"""


def _source_rows(spark: SparkSession, d: str) -> DataFrame:
    e, k = fx.table(spark, d, "events"), F.col("event_id")
    user = F.col("user_id").cast("string")
    raw = (F.when(k % 31 == 0, F.concat(F.lit("x"), user)).when(k % 37 == 0, F.concat(F.lit("9000"), user))
           .when(k % 41 == 0, F.concat(F.lit(" "), user, F.lit(" "))).otherwise(user))
    return e.select(k.alias("seq"), raw.alias("raw_case"),
                    F.when(k % 43 == 0, "  ").otherwise(F.col("event_type")).alias("tname"),
                    F.when(k % 47 == 0, F.lit(None).cast("string")).otherwise((k % 5).cast("string")).alias("tid"))


SOURCE_CTE = """src AS (SELECT event_id AS seq, CASE WHEN event_id%31=0 THEN 'x'||user_id WHEN event_id%37=0 THEN '9000'||user_id
   WHEN event_id%41=0 THEN ' '||user_id||' ' ELSE user_id::VARCHAR END AS raw_case,
   trim(CASE WHEN event_id%43=0 THEN '  ' ELSE event_type END) AS tname, trim(coalesce(CASE WHEN event_id%47=0 THEN NULL ELSE (event_id%5)::VARCHAR END,'')) AS tid FROM events),
 cl AS (SELECT *, TRY_CAST(trim(raw_case) AS BIGINT) AS caseid FROM src),
 hd AS (SELECT *, CASE WHEN caseid IS NULL THEN 'invalid_caseid' WHEN caseid<0 OR caseid>80000 THEN 'out_of_range_caseid'
   WHEN tname='' OR tid='' THEN 'track_parse_error' END AS h FROM cl),
 q AS (SELECT *, coalesce(h, CASE WHEN row_number() OVER (PARTITION BY caseid, tname, tid, h IS NULL ORDER BY seq)>1 THEN 'duplicate_track_row' END) AS failure_type FROM hd)"""


def classified(spark: SparkSession, d: str) -> DataFrame:
    return gd.classify_rows(_source_rows(spark, d), raw_key="raw_case", order="seq", start=0, end=80000, required=("tname", "tid"), unique=("tname", "tid"))


def row_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d)


def quarantine_counts(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).groupBy(F.coalesce("failure_type", F.lit("clean")).alias("failure_type"), "passes").agg(F.count(F.lit(1)).alias("rows"))


def failures(spark: SparkSession, d: str) -> DataFrame:
    c = classified(spark, d).where(F.col("caseid").isNotNull() & F.col("failure_type").isNotNull())
    msg = F.concat(F.col("failure_type"), F.lit(":"), F.col("tname"), F.lit("/"), F.col("tid"))
    return c.select("caseid", F.when(F.col("passes"), 2).otherwise(1).alias("source_rank"), "seq", "failure_type", msg.alias("message"))


def failure_digest(spark: SparkSession, d: str) -> DataFrame:
    return gd.failure_digest(failures(spark, d)).withColumn("failure_types", F.array_join("failure_types", "|"))


def failure_messages(spark: SparkSession, d: str) -> DataFrame:
    return gd.failure_messages(failures(spark, d), 2).withColumn("messages", F.array_join("messages", "|"))


MESSAGES_SQL = f"""WITH {SOURCE_CTE} SELECT caseid, (r-1)//2 AS chunk, count(*)::BIGINT AS n, string_agg(message, '|' ORDER BY r) AS messages FROM (
  SELECT caseid, message, row_number() OVER (PARTITION BY caseid ORDER BY o, failure_type, message) AS r FROM (
    SELECT caseid, failure_type, failure_type||':'||tname||'/'||tid AS message, (CASE WHEN h IS NULL THEN 2 ELSE 1 END)*1000000000+seq AS o FROM q WHERE caseid IS NOT NULL AND failure_type IS NOT NULL)) GROUP BY 1,2"""
DIGEST_SQL = f"""WITH {SOURCE_CTE} SELECT caseid, count(*)::BIGINT AS failures, arg_min(failure_type, r) AS first_type, arg_min(failure_type||':'||tname||'/'||tid, r) AS first_message,
  array_to_string(list_sort(list(DISTINCT failure_type)),'|') AS failure_types FROM (SELECT *, (CASE WHEN h IS NULL THEN 2 ELSE 1 END)*1000000000+seq AS r FROM q)
  WHERE caseid IS NOT NULL AND failure_type IS NOT NULL GROUP BY 1"""


def _number_text(k):
    s = k.cast("string")
    return (F.when(k % 13 == 0, "NA").when(k % 17 == 0, " nan ").when(k % 19 == 0, "abc").when(k % 23 == 0, "inf").when(k % 29 == 0, "")
            .when(k % 31 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" "), s, F.lit(".5 "))))


NUMBER_SQL = """CASE WHEN o_orderkey%13=0 THEN 'NA' WHEN o_orderkey%17=0 THEN ' nan ' WHEN o_orderkey%19=0 THEN 'abc' WHEN o_orderkey%23=0 THEN 'inf'
 WHEN o_orderkey%29=0 THEN '' WHEN o_orderkey%31=0 THEN NULL ELSE ' '||o_orderkey||'.5 ' END"""


def numeric_parse(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("caseid"), _number_text(F.col("o_orderkey")).alias("raw"))
    return o.select("caseid", number_class("raw").alias("class"), clean_number("raw").alias("value"),
                    F.coalesce(is_finite(try_double("raw")), F.lit(False)).alias("finite"))


PARSE_SQL = f"""SELECT o_orderkey AS caseid, CASE WHEN m THEN 'missing' WHEN x IS NULL OR NOT isfinite(x) THEN 'invalid' ELSE 'value' END AS class,
  CASE WHEN NOT m AND isfinite(x) THEN x END AS value, coalesce(isfinite(x),false) AS finite FROM (
  SELECT o_orderkey, raw IS NULL OR lower(trim(raw)) IN ('','na','n/a','nan','none','null') AS m, TRY_CAST(trim(raw) AS DOUBLE) AS x
  FROM (SELECT o_orderkey, {NUMBER_SQL} AS raw FROM orders))"""


def boolean_parse(spark: SparkSession, d: str) -> DataFrame:
    o, k = fx.table(spark, d, "orders"), F.col("o_orderkey")
    raw = F.when(k % 3 == 0, "TRUE").when(k % 3 == 1, " false ").otherwise("True")
    return o.select(k.alias("caseid"), strict_bool(raw).alias("flag"))


def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    li = fx.table(spark, d, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    v = gd.violations(li, ["l_suppkey"], {
        "quantity_within_1_45": F.col("l_quantity").between(1, 45), "discount_at_most_8pct": F.col("l_discount") <= 0.08,
        "flag_known": F.col("l_returnflag").isin("A", "N", "R"), "shipped_1992_2001": F.year("l_shipdate").between(1992, 2001),
        "unit_price_below_3000": F.coalesce(price < 3000, F.lit(False))})
    return v.groupBy("l_suppkey", "rule").agg(F.count(F.lit(1)).alias("rows"))


VIOLATIONS_SQL = " UNION ALL ".join(f"SELECT l_suppkey, '{n}' AS rule, count(*)::BIGINT AS rows FROM lineitem WHERE NOT coalesce({c},false) GROUP BY 1" for n, c in {
    "quantity_within_1_45": "l_quantity BETWEEN 1 AND 45", "discount_at_most_8pct": "l_discount<=0.08", "flag_known": "l_returnflag IN ('A','N','R')",
    "shipped_1992_2001": "year(l_shipdate) BETWEEN 1992 AND 2001", "unit_price_below_3000": "l_extendedprice/l_quantity<3000"}.items())


def authorise_reads(spark: SparkSession, d: str) -> DataFrame:
    """Requests from lineitem (case = order, track = brand) against split, cohort and two manifests."""
    req = fx.tracks(spark, d).select("caseid", F.col("tname").alias("track")).distinct()
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("caseid"), "o_orderstatus")
    k = F.col("caseid")
    splits = o.select("caseid", F.when(k % 5 == 0, "test").otherwise("train").alias("split"))
    cohort = o.where(F.col("o_orderstatus") != "P")
    sha = F.concat(F.lit("s"), k.cast("string"))
    downloads = req.where(k % 7 != 0).select("caseid", "track", F.when(k % 11 == 0, "failed").otherwise("complete").alias("status"), (k % 100).alias("bytes"), sha.alias("sha"))
    checks = req.where(k % 13 != 0).select("caseid", "track", (k % 17 != 0).alias("verified"), (k % 100 + F.when(k % 19 == 0, 1).otherwise(0)).alias("bytes"), sha.alias("sha"))
    brands = [f"Brand#{i}" for i in range(1, 21)]
    return gd.authorise_reads(req, splits, cohort, downloads, checks, split="train", tracks=brands)


AUTHORISE_SQL = fx.sql("""SELECT caseid, tname AS track, reason='allowed' AS allowed, reason FROM (SELECT r.caseid, r.tname,
  CASE WHEN o_orderkey IS NULL OR r.caseid%5=0 THEN 'split_not_permitted' WHEN NOT tname IN (""" + ",".join(f"'Brand#{i}'" for i in range(1, 21)) + """) THEN 'track_outside_allowlist'
   WHEN o_orderstatus='P' THEN 'case_not_in_cohort' WHEN r.caseid%7=0 OR r.caseid%13=0 THEN 'unlisted_source' WHEN r.caseid%11=0 THEN 'download_incomplete'
   WHEN r.caseid%17=0 THEN 'checksum_unverified' WHEN r.caseid%19=0 THEN 'manifest_disagreement' ELSE 'allowed' END AS reason
  FROM (SELECT DISTINCT caseid, tname FROM tk) r LEFT JOIN orders ON r.caseid=o_orderkey)""", "tk")


def split_policy(spark: SparkSession, d: str) -> DataFrame:
    """Requests drawn from orders: the operation by key, the requested splits by priority."""
    ops = ("scaler_fit", "early_stopping", "test_summary", "evaluation", "feature_selection")
    o, k = fx.table(spark, d, "orders"), F.col("o_orderkey")
    op = F.element_at(F.array(*[F.lit(x) for x in ops]), (k % 5 + 1).cast("int"))
    p = F.col("o_orderpriority")
    splits = (F.when(p == "1-URGENT", F.array(F.lit("train"))).when(p == "2-HIGH", F.array(F.lit("train"), F.lit("validation")))
              .when(p == "3-MEDIUM", F.array(F.lit("test"))).when(p == "4-NOT SPECIFIED", F.array(F.lit("train"), F.lit("holdout"))).otherwise(F.array(F.lit("validation"), F.lit("test"))))
    v = gd.split_policy(o.select(op.alias("operation"), splits.alias("splits"), (k % 2 == 0).alias("authorised")))
    return v.groupBy("operation", F.array_join("splits", "+").alias("requested"), "authorised", "allowed", "reason").agg(F.count(F.lit(1)).alias("requests"))


POLICY_SQL = """SELECT operation, requested, authorised, reason='allowed' AS allowed, reason, count(*)::BIGINT AS requests FROM (SELECT *, CASE
   WHEN requested LIKE '%holdout%' THEN 'unknown_split' WHEN operation='test_summary' AND t THEN 'sealed_summary_prohibited'
   WHEN operation IN ('scaler_fit','feature_selection') AND requested<>'train' THEN 'train_only' WHEN operation='early_stopping' AND t THEN 'validation_but_not_test'
   WHEN t AND NOT authorised THEN 'test_not_authorised' ELSE 'allowed' END AS reason FROM (
  SELECT ['scaler_fit','early_stopping','test_summary','evaluation','feature_selection'][(o_orderkey%5+1)::INT] AS operation, o_orderkey%2=0 AS authorised,
   CASE o_orderpriority WHEN '1-URGENT' THEN 'train' WHEN '2-HIGH' THEN 'train+validation' WHEN '3-MEDIUM' THEN 'test' WHEN '4-NOT SPECIFIED' THEN 'train+holdout' ELSE 'validation+test' END AS requested,
   o_orderpriority NOT IN ('1-URGENT','2-HIGH','4-NOT SPECIFIED') AS t FROM orders)) GROUP BY ALL"""


def lineage_equality(spark: SparkSession, d: str) -> DataFrame:
    o, k = fx.table(spark, d, "orders"), F.col("o_orderkey")
    a = o.select(k.alias("caseid"), k.cast("string").alias("txt"), F.col("o_totalprice").alias("num"))
    b = o.select(k.alias("caseid"), F.when(k % 101 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise(k.cast("string")).alias("txt"),
                 F.when(k % 103 == 0, F.col("o_totalprice") + 1).when(k % 107 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("num"))
    return gd.lineage_mismatches(a, b, "caseid", "txt", "num")


LINEAGE_SQL = """SELECT o_orderkey AS caseid, CASE WHEN o_orderkey%101=0 AND (o_orderkey%103=0 OR o_orderkey%107=0) THEN 'text_and_number'
  WHEN o_orderkey%101=0 THEN 'text' ELSE 'number' END AS mismatch FROM orders WHERE o_orderkey%101=0 OR o_orderkey%103=0 OR o_orderkey%107=0"""


def precondition_table(spark: SparkSession, d: str) -> DataFrame:
    li = fx.table(spark, d, "lineitem")
    return gd.preconditions(li, {
        "row_count_positive": (F.count(F.lit(1)) > 0, "true"), "flags": (F.array_join(F.array_sort(F.collect_set("l_returnflag")), ","), "A,N,R"),
        "status_literal": (F.count_if(~F.col("l_linestatus").isin("F", "O")), "0"), "null_keys": (F.count_if(F.col("l_orderkey").isNull()), "0"),
        "smallest_line": (F.min("l_linenumber"), "1"), "largest_quantity": (F.max("l_quantity").cast("bigint"), "49"),
        "suppliers": (F.count_distinct("l_suppkey"), "10000")})


PRECONDITION_SQL = """SELECT "check", expected, observed, expected=observed AS ok FROM (SELECT unnest([
  {'check':'row_count_positive','expected':'true','observed':(count(*)>0)::VARCHAR}, {'check':'flags','expected':'A,N,R','observed':array_to_string(list_sort(list(DISTINCT l_returnflag)),',')},
  {'check':'status_literal','expected':'0','observed':(count(*) FILTER (WHERE l_linestatus NOT IN ('F','O')))::VARCHAR},
  {'check':'null_keys','expected':'0','observed':(count(*) FILTER (WHERE l_orderkey IS NULL))::VARCHAR}, {'check':'smallest_line','expected':'1','observed':min(l_linenumber)::VARCHAR},
  {'check':'largest_quantity','expected':'49','observed':max(l_quantity)::BIGINT::VARCHAR}, {'check':'suppliers','expected':'10000','observed':count(DISTINCT l_suppkey)::VARCHAR}], recursive:=true) FROM lineitem)"""


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """A registry grown from part: brand = name, type = concept, size = state and unit status."""
    p = fx.table(spark, d, "part")
    return p.select(F.col("p_name").alias("tname"), F.col("p_type").alias("concept"), F.when(F.col("p_size") > 35, "pending").otherwise("active").alias("state"),
                    F.when(F.col("p_size") == 7, "guessed").when(F.col("p_size") % 2 == 0, "pending").otherwise("validated").alias("unit_status"))


REGISTRY_CTE = """rg AS (SELECT p_name AS tname, p_type AS concept, CASE WHEN p_size>35 THEN 'pending' ELSE 'active' END AS state,
  CASE WHEN p_size=7 THEN 'guessed' WHEN p_size%2=0 THEN 'pending' ELSE 'validated' END AS unit_status FROM part)"""


def registry_check(spark: SparkSession, d: str) -> DataFrame:
    return gd.registry_problems(_registry(spark, d))


REGISTRY_SQL = f"""WITH {REGISTRY_CTE} SELECT tname, 'several_concepts' AS problem FROM rg GROUP BY 1 HAVING count(DISTINCT concept)>1
 UNION ALL SELECT tname, 'active_and_pending' FROM rg GROUP BY 1 HAVING bool_or(state='active') AND bool_or(state='pending')
 UNION ALL SELECT tname, 'unknown_unit_status' FROM rg GROUP BY 1 HAVING bool_or(unit_status NOT IN ('validated','pending','unknown'))"""


def unit_gate(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "part")
    reg = _registry(spark, d).where("unit_status = 'validated' OR concept = 'ECONOMY'")
    return gd.units_approved(reg, p.select(F.col("p_brand").alias("request"), F.col("p_type").alias("concept")).distinct().where(F.col("concept") != F.when(F.col("request") < "Brand#15", "ECONOMY").otherwise("none")))


UNIT_SQL = f"""WITH {REGISTRY_CTE}, ok AS (SELECT concept, bool_and(unit_status='validated') AS o FROM rg WHERE unit_status='validated' OR concept='ECONOMY' GROUP BY 1)
SELECT p_brand AS request, bool_and(coalesce(o,false)) AS approved FROM (SELECT DISTINCT p_brand, p_type FROM part) r LEFT JOIN ok ON r.p_type=ok.concept
WHERE p_type<>CASE WHEN p_brand<'Brand#15' THEN 'ECONOMY' ELSE 'none' END GROUP BY 1"""


def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    a = o.select(F.col("o_custkey").alias("caseid"), F.when(F.col("o_custkey") % 5 == 0, "test").otherwise("train").alias("split"))
    leak = o.where(F.col("o_custkey") % 55 == 0).select(F.col("o_custkey").alias("caseid"), F.lit("train").alias("split"))
    return gd.overlapping_splits(a.unionByName(leak)).withColumn("splits", F.array_join("splits", "+"))


def paired_accounting(spark: SparkSession, d: str) -> DataFrame:
    return gd.paired_accounting(fx.faulty_metrics(spark, d), fx.CONDITIONS, fx.METRICS)


ACCOUNTING_SQL = fx.sql("""SELECT unnest([{'check':'rows','observed':count(*)::BIGINT}, {'check':'cases','observed':count(DISTINCT caseid)::BIGINT},
   {'check':'duplicate_pairs','observed':(count(*)-count(DISTINCT (caseid,condition_id)))::BIGINT}, {'check':'unknown_conditions','observed':count(DISTINCT CASE WHEN condition_id='P9S9' THEN caseid END)::BIGINT},
   {'check':'nonfinite_rows','observed':count(*) FILTER (WHERE isnan(m3))::BIGINT},
   {'check':'incomplete_cases','observed':(count(DISTINCT caseid)-(SELECT count(*) FROM (SELECT caseid FROM mf WHERE condition_id<>'P9S9' GROUP BY 1 HAVING count(DISTINCT condition_id)=4)))::BIGINT},
   {'check':'mapping_conflicts','observed':(SELECT count(*) FROM (SELECT caseid FROM mf GROUP BY 1 HAVING count(DISTINCT subjectid)>1))::BIGINT}], recursive:=true) FROM mf""", "mf")


def mapping_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Orders seen as cases, customers of a part as subjects: cases naming more than one."""
    li = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("caseid"), F.when(F.col("l_linenumber") == 7, F.col("l_suppkey")).otherwise(0).alias("subjectid"))
    return gd.subject_mapping_conflicts(li)


def plausible_ranges(spark: SparkSession, d: str) -> DataFrame:
    lk = fx.linkage_source(spark, d)
    return gd.violations(lk, ["caseid"], {
        "age_18_90": F.col("age").between(18, 90), "height_155_195": F.col("height").between(155, 195), "weight_50_110": F.col("weight").between(50, 110),
        "sex_known": F.col("sex").isin("M", "F"), "operation_known": F.length(F.trim("operation")) > 0})


RANGES_SQL = fx.sql(" UNION ALL ".join(f"SELECT caseid, '{n}' AS rule FROM lk WHERE NOT ({c})" for n, c in {
    "age_18_90": "age BETWEEN 18 AND 90", "height_155_195": "height BETWEEN 155 AND 195", "weight_50_110": "weight BETWEEN 50 AND 110",
    "sex_known": "sex IN ('M','F')", "operation_known": "length(trim(operation))>0"}.items()), "lk")


def disclosure_scan(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.table(spark, d, "pages").select("url", F.regexp_extract("url", r"^https?://[^/]*(/.*)$", 1).alias("path"), F.col("page_id").alias("caseid"), "html")
    return gd.disclosure_findings(pages, ["caseid", "subjectid"])


DISCLOSURE_SQL = r"""WITH p AS (SELECT url, regexp_extract(url,'^https?://[^/]*(/.*)$',1) AS path, html FROM pages)
SELECT 'caseid' AS "column", 'forbidden_name' AS finding, count(*)::BIGINT AS rows FROM p UNION ALL """ + " UNION ALL ".join(
    rf"SELECT '{c}', 'path_like_text', count(*) FILTER (WHERE regexp_matches({c}, '^(/|[A-Za-z]:\\|\\\\|~/|\.\./)'))::BIGINT FROM p HAVING count(*) FILTER (WHERE regexp_matches({c}, '^(/|[A-Za-z]:\\|\\\\|~/|\.\./)'))>0" for c in ("url", "path", "html"))

QUERIES = {
    "universe_completeness": Query(universe_completeness, COMPLETENESS_SQL),
    "key_alignment": Query(key_alignment, ALIGNMENT_SQL),
    "row_quarantine": Query(row_quarantine, f"WITH {SOURCE_CTE} SELECT seq, raw_case, tname, tid, caseid, failure_type, h IS NULL AS passes FROM q"),
    "quarantine_counts": Query(quarantine_counts, f"WITH {SOURCE_CTE} SELECT coalesce(failure_type,'clean') AS failure_type, h IS NULL AS passes, count(*)::BIGINT AS rows FROM q GROUP BY 1,2"),
    "failure_digest": Query(failure_digest, DIGEST_SQL),
    "failure_messages": Query(failure_messages, MESSAGES_SQL),
    "numeric_parse": Query(numeric_parse, PARSE_SQL),
    "boolean_parse": Query(boolean_parse, "SELECT o_orderkey AS caseid, o_orderkey%3<>1 AS flag FROM orders"),
    "rule_violations": Query(rule_violations, VIOLATIONS_SQL),
    "authorise_reads": Query(authorise_reads, AUTHORISE_SQL),
    "split_policy": Query(split_policy, POLICY_SQL),
    "lineage_equality": Query(lineage_equality, LINEAGE_SQL),
    "precondition_table": Query(precondition_table, PRECONDITION_SQL),
    "registry_check": Query(registry_check, REGISTRY_SQL),
    "unit_gate": Query(unit_gate, UNIT_SQL),
    "split_overlap": Query(split_overlap, "SELECT DISTINCT o_custkey AS caseid, 'test+train' AS splits FROM orders WHERE o_custkey%55=0"),
    "paired_accounting": Query(paired_accounting, ACCOUNTING_SQL),
    "mapping_conflicts": Query(mapping_conflicts, """SELECT l_orderkey AS caseid FROM lineitem GROUP BY 1
      HAVING count(DISTINCT CASE WHEN l_linenumber=7 THEN l_suppkey ELSE 0 END)>1"""),
    "plausible_ranges": Query(plausible_ranges, RANGES_SQL),
    "disclosure_scan": Query(disclosure_scan, DISCLOSURE_SQL),
}
