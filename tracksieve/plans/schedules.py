"""Schedule, template, state-feature, scaler and exposure queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksieve.functions import columns as c
from tracksieve.functions.quantiles import moments
from tracksieve.operators import align, checksums, features as ft
from tracksieve.plans import alignment as al, fixtures as fx
from tracksieve.plans.registry import Query
from tracksieve.plans.sequences import _r

MINUTE = 129600.0  # seconds that stand for one minute, so that a grid step stands for 10 s
RECENT = 6 * fx.STEP


def deduped(spark: SparkSession, d: str, track: str) -> DataFrame:
    return align.dedupe_last_finite(fx.signal(spark, d).where(F.col("track") == track), fx.cases(spark, d))


def schedule(spark: SparkSession, d: str) -> DataFrame:
    return ft.step_schedule(deduped(spark, d, fx.RATE_A), fx.cases(spark, d), c.ml_per_hour_to_ug_per_min("v"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    return ft.schedule_intervals(schedule(spark, d), fx.cases(spark, d))


SCHED = dict(
    s0="SELECT dd.caseid, t-w0 AS t, v*20/60 AS rate FROM dd JOIN cs USING (caseid) WHERE track='RATE_A' AND v>=0",
    s1="SELECT * FROM s0 UNION ALL SELECT caseid, 0.0, 0.0 FROM cs WHERE caseid NOT IN (SELECT caseid FROM s0 WHERE t=0)",
    sc="SELECT caseid, t, rate FROM (SELECT *, lag(rate) OVER (PARTITION BY caseid ORDER BY t) AS p FROM s1) WHERE rate IS DISTINCT FROM p",
    iv="SELECT caseid, t AS t_from, coalesce(lead(t) OVER (PARTITION BY caseid ORDER BY t), w1-w0) AS t_to, rate, w1-w0 AS h FROM sc JOIN cs USING (caseid)",
    stp=f"SELECT caseid, unnest(range(floor((w1-w0)/21600)::BIGINT)) AS step_no FROM cs",
    dz=f"""SELECT s.caseid, step_no, coalesce(sum(CASE WHEN least(t_to,(step_no+1)*21600.0)>greatest(t_from,step_no*21600.0) THEN rate*(least(t_to,(step_no+1)*21600.0)-greatest(t_from,step_no*21600.0))/{MINUTE} END),0) AS dose
      FROM stp s LEFT JOIN iv ON s.caseid=iv.caseid AND t_from<(step_no+1)*21600.0 AND t_to>step_no*21600.0 GROUP BY 1,2""",
)


def sch_sql(body: str, *needs: str, **more: str) -> str:
    return fx.sql(body, "dd", "cs", *needs, **SCHED, **more)


def doses(spark: SparkSession, d: str) -> DataFrame:
    return _r(ft.dose_integrals(intervals(spark, d), RECENT, MINUTE))


DOSES_SQL = sch_sql(f"""SELECT caseid, any_value(h) AS horizon, count(*)::BIGINT AS knots, round(sum(greatest(least(t_to,h)-t_from,0)*rate/{MINUTE}),6)+0.0 AS total_amount,
  round(sum(greatest(least(t_to,h)-greatest(t_from,greatest(0,h-{RECENT})),0)*rate/{MINUTE}),6)+0.0 AS recent_amount FROM iv GROUP BY 1""")


def steps(spark: SparkSession, d: str) -> DataFrame:
    return ft.step_doses(intervals(spark, d), fx.cases(spark, d), fx.STEP, MINUTE)


def rate_at(spark: SparkSession, d: str) -> DataFrame:
    """The schedule's rate at each signal time (general as-of on knots)."""
    points = fx.cases(spark, d).join(deduped(spark, d, fx.SIG), "caseid").select("caseid", (F.col("t") - F.col("w0")).alias("g"))
    found = align.align_points(schedule(spark, d), points, ["caseid"])
    return _r(found.select("caseid", "g", F.col("obs.rate").alias("rate"), F.col("obs.t").alias("knot")))


RATE_AT_SQL = sch_sql("""SELECT p.caseid, p.g, round(rate,6)+0.0 AS rate, sc.t AS knot FROM (SELECT dd.caseid, t-w0 AS g FROM dd JOIN cs USING (caseid) WHERE track='SIG') p
  ASOF LEFT JOIN sc ON p.caseid=sc.caseid AND p.g>=sc.t""")


def events_per_step(spark: SparkSession, d: str) -> DataFrame:
    """Signal events in (start, end] per step: an equi-bucket, not a range join."""
    t = ft.event_template(al.exact_ts_join(spark, d), fx.cases(spark, d))
    return t.groupBy("caseid", F.ceil(F.col("t") / fx.STEP).alias("step_end")).agg(F.count(F.lit(1)).alias("events"), F.count_if("accepted").alias("accepted"))


def template(spark: SparkSession, d: str) -> DataFrame:
    return ft.event_template(al.exact_ts_join(spark, d), fx.cases(spark, d))


TPL = dict(tp="""SELECT a.caseid, a.t-w0 AS t, round(a.v,6) BETWEEN 0 AND 100 AS in_range, q.v AS quality, a.v BETWEEN 0 AND 100 AND coalesce(q.v>=50,false) AS accepted
  FROM dd a JOIN cs USING (caseid) LEFT JOIN dd q ON a.caseid=q.caseid AND a.t=q.t AND q.track='QLT' WHERE a.track='SIG'""")
COUNTERS = """SELECT caseid, count(*)::BIGINT AS events, count(*) FILTER (WHERE in_range)::BIGINT AS in_range, count(*) FILTER (WHERE NOT in_range)::BIGINT AS out_of_range,
  count(quality)::BIGINT AS quality_matches, count(*) FILTER (WHERE quality<0 OR quality>100)::BIGINT AS quality_outside_range, count(*) FILTER (WHERE accepted)::BIGINT AS accepted FROM tp GROUP BY 1"""


def template_qc(spark: SparkSession, d: str) -> DataFrame:
    long = ft.template_counters(template(spark, d)).select(*[F.col(x).cast("double").alias(x) for x in ("events", "quality_matches", "accepted")]).unpivot([], ["events", "quality_matches", "accepted"], "counter", "x")
    return _r(moments(long, ["counter"], "x"))


CHUNK = 5 * 86400.0


def payload(spark: SparkSession, d: str) -> DataFrame:
    p = ft.template_payload(template(spark, d), CHUNK)
    text = F.transform("events", lambda e: F.concat_ws(":", e["t"].cast("bigint").cast("string"), e["in_range"].cast("string"), F.coalesce(e["quality"].cast("bigint").cast("string"), F.lit("-"))))
    return p.select("caseid", "chunk", "n", F.array_join(text, ",").alias("events"))


PAYLOAD_SQL = fx.sql(f"""SELECT caseid, floor(t/{CHUNK})::BIGINT AS chunk, count(*)::BIGINT AS n, string_agg(t::BIGINT||':'||in_range||':'||coalesce(quality::BIGINT::VARCHAR,'-'), ',' ORDER BY t) AS events FROM tp GROUP BY 1,2""", "dd", "cs", **TPL)


def payload_problems(spark: SparkSession, d: str) -> DataFrame:
    """Invariants of payload chunks, some of them damaged on purpose."""
    p = ft.template_payload(template(spark, d), CHUNK)
    odd = F.col("caseid") % 9
    damaged = p.withColumn("events", F.when(odd == 0, F.reverse("events")).otherwise(F.col("events"))).withColumn("n", F.when(odd == 4, F.col("n") + 1).otherwise(F.col("n")))
    h = ft.complete_horizon(fx.cases(spark, d), fx.STEP)
    return ft.payload_problems(damaged, h, CHUNK)


PROBLEMS_SQL = fx.sql(f"""SELECT caseid, problem, count(*)::BIGINT AS chunks FROM (
   SELECT caseid, unnest([CASE WHEN caseid%9=0 AND n>1 THEN 'not_strictly_increasing' END, CASE WHEN m>hz THEN 'outside_horizon' END, CASE WHEN caseid%9=4 THEN 'wrong_size' END]) AS problem
   FROM (SELECT tp.caseid, floor(t/{CHUNK}) AS c, count(*) AS n, max(t) AS m, any_value(floor((w1-w0)/21600)*21600) AS hz FROM tp JOIN cs USING (caseid) GROUP BY 1,2)) WHERE problem IS NOT NULL GROUP BY 1,2""", "dd", "cs", **TPL)


def states(spark: SparkSession, d: str) -> DataFrame:
    """State features per grid point: six causal lookups and six completed doses with recent and cumulative amount."""
    a = al.grid(spark, d, (al.GOOD_SIGNAL,), halo=True)
    age = F.least(align.age("good"), F.lit(al.AGE_CLIP))
    shown = F.coalesce(align.age("good") <= al.SIGNAL_CAP, F.lit(False))
    look = ft.lookup_features(a, F.when(shown, F.col("good.v")).otherwise(0.0), F.when(shown, 1.0).otherwise(0.0), F.coalesce(age, F.lit(al.AGE_CLIP)), 6, al.AGE_CLIP)
    dose = ft.dose_features(steps(spark, d).select("caseid", "step_no", "dose")).withColumn("slot", F.col("step_no") + 1).drop("step_no")
    return look.join(dose, ["caseid", "slot"], "left").fillna(0.0, ["cumulative", "recent", *[f"dose_t{j}" for j in range(6)]])


STATE = dict(
    lk0=f"""SELECT gr.caseid, gr.k, gr.i AS slot, CASE WHEN age<={al.SIGNAL_CAP} THEN v ELSE 0 END AS value, CASE WHEN age<={al.SIGNAL_CAP} THEN 1.0 ELSE 0.0 END AS mask, coalesce(least(age,{al.AGE_CLIP}),{al.AGE_CLIP}) AS age
      FROM gr JOIN as_ge_50 USING (caseid, k)""",
    df="""SELECT caseid, step_no+1 AS slot, sum(dose) OVER (PARTITION BY caseid ORDER BY step_no) AS cumulative, sum(dose) OVER (PARTITION BY caseid ORDER BY step_no ROWS 5 PRECEDING) AS recent, """ + ", ".join(
        f"coalesce(lag(dose,{j}) OVER (PARTITION BY caseid ORDER BY step_no),0) AS dose_t{j}" for j in range(6)) + " FROM dz",
    sf="SELECT l.*, " + ", ".join(f"coalesce({x},0) AS {x}" for x in ("cumulative", "recent", *[f"dose_t{j}" for j in range(6)])) + " FROM (SELECT caseid, k, slot, " + ", ".join(
        f"coalesce(lag({n},{j}) OVER (PARTITION BY caseid ORDER BY k),{e}) AS {n}_t{j}" for j in range(6) for n, e in (("value", 0), ("mask", 0), ("age", al.AGE_CLIP))) + " FROM lk0) l LEFT JOIN df USING (caseid, slot)",
)
DOUBLES = [f"{n}_t{j}" for j in range(6) for n in ("value", "mask", "age")] + ["cumulative", "recent"] + [f"dose_t{j}" for j in range(6)]
STATE_SQL = sch_sql("SELECT caseid, k, slot, " + ", ".join(f"round({x}::DOUBLE,6)+0.0 AS {x}" for x in DOUBLES) + " FROM sf", "as_ge_50", **STATE)
FIELDS = ("value_t0", "mask_t0", "age_t0", "dose_t0", "recent", "cumulative")


def scaler(spark: SparkSession, d: str) -> DataFrame:
    return ft.fit_scaler(states(spark, d).where("caseid % 5 <> 0"), FIELDS, identity=("mask_t0",))


SCALER = dict(sl=" UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*)::BIGINT AS n, {'0.0' if f == 'mask_t0' else f'avg({f})'}::DOUBLE AS center, {'1.0' if f == 'mask_t0' else f'CASE WHEN stddev_samp({f})<=1e-12 THEN 1.0 ELSE stddev_samp({f}) END'}::DOUBLE AS scale FROM sf WHERE caseid%5<>0" for f in FIELDS))


def scaled(spark: SparkSession, d: str) -> DataFrame:
    return _r(ft.apply_scaler(states(spark, d), scaler(spark, d), FIELDS, ["caseid", "k"]), 5)


def frozen_scaler(spark: SparkSession, d: str) -> DataFrame:
    """The fitted scaler against a frozen copy with a changed, a lost, an unknown and an invalid field."""
    fitted = scaler(spark, d)
    f = F.col("field")
    frozen = fitted.where(f != "recent").select(
        F.when(f == "cumulative", "cumulative_old").otherwise(f).alias("field"), (F.col("center") + F.when(f == "age_t0", 1.0).otherwise(0.0)).alias("center"),
        F.when(f == "dose_t0", 0.0).otherwise(F.col("scale")).alias("scale"))
    return ft.verify_scaler(fitted, frozen)


FROZEN_SQL = """SELECT * FROM (VALUES ('value_t0','ok'),('mask_t0','ok'),('age_t0','different'),('dose_t0','invalid'),('recent','missing'),('cumulative','missing'),('cumulative_old','unknown')) t(field, verdict)"""


def scaled_rejects(spark: SparkSession, d: str) -> DataFrame:
    """States of which some carry NaN, infinity or nothing, scaled: every bad value is a row."""
    c = F.col("caseid")
    bad = states(spark, d).withColumn("value_t0", F.when(c % 9 == 0, float("nan")).when(c % 10 == 0, float("inf")).otherwise(F.col("value_t0"))).withColumn(
        "recent", F.when(c % 7 != 0, F.col("recent")))
    return ft.scaled_rejects(ft.apply_scaler(bad, scaler(spark, d), FIELDS, ["caseid", "k"]), FIELDS, ["caseid", "k"])


REJECT_SQL = sch_sql("""SELECT caseid, k, 'value_t0' AS field, CASE WHEN caseid%9=0 THEN 'nan' ELSE 'infinite' END AS reason FROM sf WHERE caseid%9=0 OR caseid%10=0
  UNION ALL SELECT caseid, k, 'recent', 'null' FROM sf WHERE caseid%7=0""", "as_ge_50", **STATE)


SCALED_SQL = sch_sql("SELECT caseid, k, " + ", ".join(
    f"round(({f}-(SELECT center FROM sl WHERE field='{f}'))/(SELECT scale FROM sl WHERE field='{f}'),5)+0.0 AS {f}" for f in FIELDS) + " FROM sf", "as_ge_50", **STATE, **SCALER)


def _patient():
    k = F.col("caseid")
    return (18 + k % 70).cast("double"), F.when(k % 2 == 0, "male").otherwise("female"), (150 + k % 40).cast("double"), (45 + k % 60).cast("double")


def _customer():
    k = F.col("c_custkey")
    return 18 + (F.col("c_acctbal") + 1000) / 150, F.when(k % 2 == 0, "male").otherwise("female"), (150 + k % 50).cast("double"), (45 + k % 70).cast("double")


def covariates(spark: SparkSession, d: str) -> DataFrame:
    """Both covariate models per customer; the second in its two variants."""
    age, sex, height, weight = _customer()
    cu = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("caseid"), age.alias("age"), sex.alias("sex"), height.alias("height"), weight.alias("weight"))
    who = [F.col(x) for x in ("age", "sex", "height", "weight")]
    a = c.schnider(*who)
    one = cu.select("caseid", F.lit("schnider_primary").alias("variant"), *[v.alias(n) for n, v in a.items()])
    variants = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(x).alias("f12")) for n, x in c.MINTO_F12.items()]))
    two = cu.select("*", variants.alias("_v")).select("*", "_v.*")
    b = c.minto(*who, F.col("f12"))
    both = one.unionByName(two.select("caseid", "variant", *[v.alias(n) for n, v in b.items()]))
    k = c.rate_constants({n: F.col(n) for n in ("v1", "v2", "v3", "cl1", "cl2", "cl3")})
    return _r(both.select("*", *[v.alias(n) for n, v in k.items()]))


_S, _M = c.SCHNIDER, c.MINTO
COVARIATE_SQL = f"""WITH p AS (SELECT c_custkey AS caseid, 18+(c_acctbal+1000)/150 AS age, c_custkey%2=0 AS male, (150+c_custkey%50)::DOUBLE AS height, (45+c_custkey%70)::DOUBLE AS weight FROM customer),
 l AS (SELECT *, CASE WHEN male THEN 1.1*weight-128*(weight/height)*(weight/height) ELSE 1.07*weight-148*(weight/height)*(weight/height) END AS lbm FROM p),
 m AS (SELECT caseid, 'schnider_primary' AS variant, {_S['h1']}::DOUBLE AS v1, {_S['h2']}-{_S['h3']}*(age-{_S['h4']}) AS v2, {_S['h5']}::DOUBLE AS v3,
   {_S['h6']}+{_S['h7']}*(weight-{_S['h8']})-{_S['h9']}*(lbm-{_S['h10']})+{_S['h11']}*(height-{_S['h12']}) AS cl1, {_S['h13']}-{_S['h14']}*(age-{_S['h15']}) AS cl2, {_S['h16']}::DOUBLE AS cl3, {_S['h17']}::DOUBLE AS ke0 FROM l
  UNION ALL SELECT caseid, variant, {_M['f1']}-{_M['f2']}*(age-40)+{_M['f3']}*(lbm-55), {_M['f4']}-{_M['f5']}*(age-40)+{_M['f6']}*(lbm-55), {_M['f7']}::DOUBLE, {_M['f8']}-{_M['f9']}*(age-40)+{_M['f10']}*(lbm-55),
   {_M['f11']}-f12*(age-40), {_M['f13']}-{_M['f14']}*(age-40), {_M['f15']}-{_M['f16']}*(age-40) FROM l, (VALUES ('primary_minto_0.0301',0.0301::DOUBLE),('sensitivity_yun_0.030',0.030::DOUBLE)) v(variant,f12))
SELECT caseid, variant, """ + ", ".join(f"round({x},6)+0.0 AS {x}" for x in ("v1", "v2", "v3", "cl1", "cl2", "cl3", "ke0")) + """, round(cl1/v1,6)+0.0 AS k10, round(cl2/v1,6)+0.0 AS k12, round(cl3/v1,6)+0.0 AS k13,
  round(cl2/v2,6)+0.0 AS k21, round(cl3/v3,6)+0.0 AS k31 FROM m"""


def response(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    a, b = F.col("value") / 40, F.col("event_id") % 97 / 5.0
    act = c.clip_action(F.col("value") / 7)
    out = e.select(F.col("event_id").alias("seq"), c.response_surface(a, b).alias("response"), act.alias("x"), c.ml_per_hour_to_ug_per_min(F.col("value") - 20).alias("rate"))
    return _r(out.select("seq", "response", F.col("x.applied").alias("applied"), F.col("x.clipped").alias("clipped"), F.col("x.rate_per_min").alias("per_min"), "rate",
                         c.inverse_distance_score(F.col("response")).alias("score")))


RESPONSE_SQL = """SELECT seq, round(r,6)+0.0 AS response, round(least(greatest(w,0),27.7),6)+0.0 AS applied, least(greatest(w,0),27.7)<>w AS clipped, round(least(greatest(w,0),27.7)*6,6)+0.0 AS per_min,
  round(CASE WHEN value>=20 THEN (value-20)*20/60 END,6)+0.0 AS rate, round(1/(abs(50-r)+1),6)+0.0 AS score
  FROM (SELECT event_id AS seq, value, value/7 AS w, 98*pow(1+value/40/4.47+(event_id%97)/5.0/19.3,-1.43) AS r FROM events)"""


def one_compartment(spark: SparkSession, d: str) -> DataFrame:
    iv = intervals(spark, d)
    return _r(iv.groupBy("caseid").agg(ft.one_compartment_amount(0.1, F.col("horizon"), MINUTE).alias("amount_end"), ft.one_compartment_amount(0.1, F.col("horizon") / 2, MINUTE).alias("amount_half")))


# Oracle of the one-compartment amount: the recursion over the ordered intervals of a case.
ONE_SQL = sch_sql(f"""SELECT caseid, round(arg_max(a, n),6)+0.0 AS amount_end, any_value(hf) AS amount_half FROM rc JOIN hv USING (caseid) GROUP BY 1""",
                  od="SELECT *, row_number() OVER (PARTITION BY caseid ORDER BY t_from) AS n FROM iv",
                  hv=f"SELECT caseid, round(sum(rate/0.1*(exp(-0.1*(h/2-least(t_to,h/2))/{MINUTE})-exp(-0.1*(h/2-least(t_from,h/2))/{MINUTE}))),6)+0.0 AS hf FROM iv GROUP BY 1",
                  ).replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT caseid, round(arg_max", f""",
rc AS (SELECT caseid, n, rate/0.1*(1-exp(-0.1*(t_to-t_from)/{MINUTE})) AS a FROM od WHERE n=1 UNION ALL
  SELECT od.caseid, od.n, rc.a*exp(-0.1*(t_to-t_from)/{MINUTE})+rate/0.1*(1-exp(-0.1*(t_to-t_from)/{MINUTE})) FROM rc JOIN od ON od.caseid=rc.caseid AND od.n=rc.n+1)
SELECT caseid, round(arg_max""", 1)


def patients(spark: SparkSession, d: str) -> DataFrame:
    age, sex, height, weight = _patient()
    p = fx.cases(spark, d).select("caseid", age.alias("age"), sex.alias("sex"), height.alias("height"), weight.alias("weight"))
    par = c.minto(F.col("age"), F.col("sex"), F.col("height"), F.col("weight"), c.MINTO_F12["primary_minto_0.0301"])
    roots = p.select("caseid", *[v.alias(n) for n, v in par.items()]).select("caseid", *[v.alias(n) for n, v in ft.modal_parameters({n: F.col(n) for n in par}).items()])
    return roots.select("caseid", "ke0", "l1", "l2", "l3", *[v.alias(n) for n, v in ft.modal_coefficients().items()])


def three_compartment(spark: SparkSession, d: str) -> DataFrame:
    return _r(ft.three_compartment(intervals(spark, d), patients(spark, d), F.col("horizon"), MINUTE))


def _gone(x: str) -> str:
    return f"(exp(-{x}*(h-t_to)/{MINUTE})-exp(-{x}*(h-t_from)/{MINUTE}))"


THREE_SQL = sch_sql(f"""SELECT caseid, round(sum(rate*a*{_gone('l')}/l),6)+0.0 AS plasma, round(sum(rate*ke0*a/(ke0-l)*({_gone('l')}/l-{_gone('ke0')}/ke0)),6)+0.0 AS effect FROM iv JOIN ml USING (caseid) GROUP BY 1""",
                    lb="SELECT caseid, 18+caseid%70 AS age, CASE WHEN caseid%2=0 THEN 1.1*w-128*(w/h)*(w/h) ELSE 1.07*w-148*(w/h)*(w/h) END AS lbm FROM (SELECT caseid, (45+caseid%60)::DOUBLE AS w, (150+caseid%40)::DOUBLE AS h FROM cs)",
                    pr=f"""SELECT caseid, {_M['f1']}-{_M['f2']}*(age-40)+{_M['f3']}*(lbm-55) AS v1, {_M['f4']}-{_M['f5']}*(age-40)+{_M['f6']}*(lbm-55) AS v2, {_M['f7']}::DOUBLE AS v3, {_M['f8']}-{_M['f9']}*(age-40)+{_M['f10']}*(lbm-55) AS cl1,
                      {_M['f11']}-0.0301*(age-40) AS cl2, {_M['f13']}-{_M['f14']}*(age-40) AS cl3, {_M['f15']}-{_M['f16']}*(age-40) AS ke0 FROM lb""",
                    kk="SELECT caseid, v1, ke0, cl1/v1 AS k10, cl2/v1 AS k12, cl3/v1 AS k13, cl2/v2 AS k21, cl3/v3 AS k31 FROM pr",
                    ss="SELECT *, k10+k12+k13+k21+k31 AS s2, k10*k31+k21*k31+k21*k13+k10*k21+k31*k12 AS s1, k10*k21*k31 AS s0 FROM kk",
                    rr="SELECT *, s1-s2*s2/3 AS p, 2*s2*s2*s2/27-s1*s2/3+s0 AS q FROM ss",
                    rt="SELECT *, " + ", ".join(f"s2/3-cos(acos(greatest(-1,least(1,-q/2/sqrt(-(p*p*p)/27))))/3+{2 * j}*pi()/3)*2*cbrt(sqrt(-(p*p*p)/27)) AS l{j + 1}" for j in range(3)) + " FROM rr",
                    ml=" UNION ALL ".join(f"SELECT caseid, ke0, l{j} AS l, (l{j}-k21)*(l{j}-k31)/((l{j}-l{o[0]})*(l{j}-l{o[1]})*v1) AS a FROM rt" for j, o in ((1, (2, 3)), (2, (1, 3)), (3, (1, 2)))))


def bundle(spark: SparkSession, d: str) -> DataFrame:
    """Profile, template counters and schedule fingerprint of a case, with derived ids."""
    age, sex, height, weight = _patient()
    prof = fx.cases(spark, d).select("caseid", age.alias("age"), sex.alias("sex"), height.alias("height"), weight.alias("weight"))
    knots = schedule(spark, d).select("caseid", (F.col("t") / fx.STEP).cast("bigint").alias("n"), F.concat_ws(":", F.col("t").cast("bigint"), F.format_string("%.3f", F.round(F.col("rate") + 1.7e-5, 3))).alias("line"))
    tree = checksums.tree_checksum(knots, "n", keys=["caseid"], text="line").select("caseid", F.col("ids").alias("knots"), F.col("sha256").alias("schedule_sha256"))
    h = ft.complete_horizon(fx.cases(spark, d), fx.STEP)
    out = prof.join(ft.template_counters(template(spark, d)), "caseid", "left").join(tree, "caseid", "left").join(h, "caseid")
    return out.withColumn("bundle_id", c.nul_hash(F.lit("bundle-v1"), F.lit("seal"), "caseid"))


BUNDLE_SQL = sch_sql("""SELECT cs.caseid, (18+cs.caseid%70)::DOUBLE AS age, CASE WHEN cs.caseid%2=0 THEN 'male' ELSE 'female' END AS sex, (150+cs.caseid%40)::DOUBLE AS height, (45+cs.caseid%60)::DOUBLE AS weight,
  ctr.* EXCLUDE (caseid), knots, schedule_sha256, floor((w1-w0)/21600)*21600 AS horizon, floor((w1-w0)/21600)*21600>=21600 AS usable, sha256('bundle-v1'||chr(0)||'seal'||chr(0)||cs.caseid) AS bundle_id
  FROM cs LEFT JOIN ctr USING (caseid) LEFT JOIN (SELECT k AS caseid, ids AS knots, sha256 AS schedule_sha256 FROM kt) USING (caseid)""", **TPL, ctr=COUNTERS,
                    kl="SELECT caseid, (t/21600)::BIGINT AS n, t::BIGINT||':'||printf('%.3f', round(rate+1.7e-5,3)) AS line FROM sc", **fx.tree("kt", "kl", "caseid", "n", "line"))

QUERIES = {
    "step_schedule": Query(lambda s, d: _r(schedule(s, d)), sch_sql("SELECT caseid, t, round(rate,6)+0.0 AS rate FROM sc")),
    "dose_integrals": Query(doses, DOSES_SQL),
    "step_doses": Query(lambda s, d: _r(steps(s, d)), sch_sql(f"SELECT caseid, step_no, round(dose,6)+0.0 AS dose, round(dose*{MINUTE}/21600,6)+0.0 AS mean_rate FROM dz")),
    "rate_at_time": Query(rate_at, RATE_AT_SQL),
    "events_per_step": Query(events_per_step, fx.sql("SELECT caseid, ceil(t/21600)::BIGINT AS step_end, count(*)::BIGINT AS events, count(*) FILTER (WHERE accepted)::BIGINT AS accepted FROM tp GROUP BY 1,2", "dd", "cs", **TPL)),
    "event_template": Query(template, fx.sql("SELECT * FROM tp", "dd", "cs", **TPL)),
    "template_counters": Query(lambda s, d: ft.template_counters(template(s, d)), fx.sql(COUNTERS, "dd", "cs", **TPL)),
    "template_qc": Query(template_qc, fx.sql(" UNION ALL ".join(f"""SELECT '{x}' AS counter, count(*)::BIGINT AS n, round(avg({x}),6)+0.0 AS mean, round(stddev_samp({x}),6)+0.0 AS sd, min({x})::DOUBLE AS minimum, max({x})::DOUBLE AS maximum,
      quantile_cont({x}::DOUBLE,0.25) AS q1, median({x}::DOUBLE) AS median, quantile_cont({x}::DOUBLE,0.75) AS q3 FROM ctr""" for x in ("events", "quality_matches", "accepted")), "dd", "cs", **TPL, ctr=COUNTERS)),
    "template_payload": Query(payload, PAYLOAD_SQL),
    "payload_problems": Query(payload_problems, PROBLEMS_SQL),
    "complete_horizon": Query(lambda s, d: ft.complete_horizon(fx.cases(s, d), fx.STEP), fx.sql("SELECT caseid, floor((w1-w0)/21600)*21600 AS horizon, floor((w1-w0)/21600)>=1 AS usable FROM cs", "cs")),
    "state_features": Query(lambda s, d: _r(states(s, d)), STATE_SQL),
    "scaler_fit": Query(lambda s, d: _r(scaler(s, d)), sch_sql("SELECT field, n, round(center,6)+0.0 AS center, round(scale,6)+0.0 AS scale FROM sl", "as_ge_50", **STATE, **SCALER)),
    "scaler_apply": Query(scaled, SCALED_SQL),
    "scaler_verify": Query(frozen_scaler, FROZEN_SQL),
    "scaled_rejects": Query(scaled_rejects, REJECT_SQL),
    "covariate_params": Query(covariates, COVARIATE_SQL),
    "response_surface": Query(response, RESPONSE_SQL),
    "exposure_one_compartment": Query(one_compartment, ONE_SQL),
    "exposure_three_compartment": Query(three_compartment, THREE_SQL),
    "runtime_bundle": Query(bundle, BUNDLE_SQL),
}
