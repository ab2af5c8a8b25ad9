"""Queries of evaluation statistics, severity and model-side aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from florascope.functions import scalars as sc
from florascope.operators import severity, stats

from .catalog import query


def _r(c, k=6):
    return F.round(c, k)


@query("AGG14_percentiles", "select round(quantile_cont(s, 0.1), 6) as p10, round(quantile_cont(s, 0.05), 6) as p5, round(quantile_cont(s, 0.95), 6) as p95 from pred where y = 1")
def agg14(v):
    p = stats.percentiles(v.pred.where("y = 1"), "s", {"p10": 0.1, "p5": 0.05, "p95": 0.95})
    return p.select(*[_r(c).alias(c) for c in p.columns])


@query("AGG15_trimmed_max", "select round(least(quantile_cont(bio12, 0.75) + 1.5e0 * (quantile_cont(bio12, 0.75) - quantile_cont(bio12, 0.25)), max(bio12)), 4) as trimmed_max from pred")
def agg15(v):
    return stats.trimmed_max(v.pred, "bio12").select(_r("trimmed_max", 4).alias("trimmed_max"))


_AUC = "with t as (select s, sum(y) as n1, sum(1 - y) as n0 from pred group by s), r as (select s, n1, n0, sum(n1 + n0) over (order by s rows between unbounded preceding and current row) - (n1 + n0) as below from t)"


@query("AGG16_auc", _AUC + " select round((sum(n1 * (below + (n1 + n0 + 1) / 2e0)) - sum(n1) * (sum(n1) + 1) / 2e0) / (sum(n1) * sum(n0) * 1e0), 6) as auc from r")
def agg16(v):
    return stats.auc(v.pred).select(_r("auc").alias("auc"))


@query("AGG17_tss", """with t as (select s, sum(y) as n1, sum(1 - y) as n0 from pred group by s), k as (select s, sum(n1) over (order by s desc rows between unbounded preceding and current row) * 1e0 / sum(n1) over () - sum(n0) over (order by s desc rows between unbounded preceding and current row) * 1e0 / sum(n0) over () as j from t),
 q as (select s, j, row_number() over (order by j desc, s desc) as rn from k) select round(j, 6) as tss, round(least(s, 1e0), 6) as threshold from q where rn = 1""")
def agg17(v):
    return stats.tss(v.pred).select(_r("tss").alias("tss"), _r("threshold").alias("threshold"))


_CBI = """with b as (select min(s) as lo, max(s) as hi from pred), g0 as (select unnest(range(101)) as k), w as (select k, lo + k * ((hi - (hi - lo) * 0.1e0) - lo) / 100e0 as a, (hi - lo) * 0.1e0 as width from b cross join g0),
 f as (select k, a, avg(case when p.y = 1 then case when p.s >= a and p.s <= a + width then 1e0 else 0e0 end end) as pp, avg(case when p.y = 0 then case when p.s >= a and p.s <= a + width then 1e0 else 0e0 end end) as pe from w cross join pred p group by k, a),
 g as (select k, pp / pe as fr, lag(pp / pe) over (order by k) as prev from f where pe > 0), h as (select k, fr, rank() over (order by fr) as r1, count(*) over (partition by fr) as c1, row_number() over (order by k) as r2 from g where prev is null or fr <> prev)"""


@query("AGG18_boyce_index", _CBI + " select round(corr(r1 + (c1 - 1) / 2e0, cast(r2 as double)), 4) as cbi from h")
def agg18(v):
    return stats.boyce(v.pred).select(_r("cbi", 4).alias("cbi"))


@query("AGG19_spearman", "with r as (select rank() over (order by bio1) + (count(*) over (partition by bio1) - 1) / 2e0 as a, rank() over (order by bio12) + (count(*) over (partition by bio12) - 1) / 2e0 as b from pred where y = 1) select round(corr(a, b), 6) as rho from r")
def agg19(v):
    return stats.spearman(v.pred.where("y = 1"), "bio1", "bio12").select(_r("rho").alias("rho"))


@query("WIN4_average_rank", "select id, y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2e0 as rank from pred where y = 1")
def win4(v):
    return stats.average_rank(v.pred.where("y = 1"), "s", "rank").select("id", "y", "rank")


@query("WIN3_successive_duplicates", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) over (partition by o_custkey order by o_orderkey) as prev from orders) t where prev is null or prev <> o_orderstatus")
def win3(v):
    prev = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return v.orders.withColumn("prev", prev).where(F.col("prev").isNull() | (F.col("prev") != F.col("o_orderstatus"))).select("o_custkey", "o_orderkey")


@query("AGG20_predictor_agreement", "select round(corr(bio1, bio12), 6) as pearson_r, round(avg(bio12 - bio1), 4) as mean_diff, round(avg(abs(bio12 - bio1)), 4) as mean_abs_diff, round(median(abs(bio12)) / median(abs(bio1)), 4) as scale_ratio from pred")
def agg20(v):
    d = stats.predictor_agreement(v.pred, "bio1", "bio12")
    return d.select(_r("pearson_r").alias("pearson_r"), *[_r(c, 4).alias(c) for c in ("mean_diff", "mean_abs_diff", "scale_ratio")])


@query("AGG21_kappa", "with m as (select avg(case when (s >= 0.5e0) = (bio1 > 15e0) then 1e0 else 0e0 end) as po, avg(case when s >= 0.5e0 then 1e0 else 0e0 end) as a, avg(case when bio1 > 15e0 then 1e0 else 0e0 end) as b from pred) select round(po, 6) as agreement, round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) as kappa from m")
def agg21(v):
    return stats.kappa(v.pred, F.col("s") >= 0.5, F.col("bio1") > 15.0).select(_r("agreement").alias("agreement"), _r("kappa").alias("kappa"))


@query("AGG22_schoener_d", "with d as (select suitability as a, bio12 as b from cells), t as (select sum(a) as ta, sum(b) as tb from d) select round(1 - 0.5e0 * sum(abs(a / ta - b / tb)), 6) as d from d cross join t")
def agg22(v):
    return stats.schoener_d(v.cells, "suitability", "bio12").select(_r("d").alias("d"))


@query("AGG23_independent_evaluation", """with r as (select dataset_id, occurrence_status = 'present' as p, suitability as s from ref_rec r left join cells c on c.row = cast(floor(90e0 - r.latitude) as int) and c.col = cast(floor(r.longitude + 180e0) as int))
select dataset_id, count(*) filter (p and s is not null) as n_presence, count(*) filter (not p and s is not null) as n_absence, count(*) filter (s is null) as n_outside_grid, case when count(*) filter (p and s is not null) >= 5 then round(avg(case when s >= 0.3e0 then 1e0 else 0e0 end) filter (p and s is not null), 6) end as sensitivity, case when count(*) filter (not p and s is not null) >= 5 then round(avg(case when s < 0.3e0 then 1e0 else 0e0 end) filter (not p and s is not null), 6) end as specificity from r group by 1""")
def agg23(v):
    at = v.ref_rec.select("dataset_id", (F.col("occurrence_status") == "present").alias("p"), F.floor(90.0 - F.col("latitude")).cast("int").alias("row"), F.floor(F.col("longitude") + 180.0).cast("int").alias("col"))
    d = at.join(v.cells.select("row", "col", F.col("suitability").alias("s")), ["row", "col"], "left")
    pres, abse = F.col("p") & F.col("s").isNotNull(), ~F.col("p") & F.col("s").isNotNull()
    share = lambda which, hit: F.when(F.count_if(which) >= 5, _r(F.avg(F.when(which, hit.cast("double")))))
    return d.groupBy("dataset_id").agg(
        F.count_if(pres).alias("n_presence"), F.count_if(abse).alias("n_absence"), F.count_if(F.col("s").isNull()).alias("n_outside_grid"),
        share(pres, F.col("s") >= 0.3).alias("sensitivity"), share(abse, F.col("s") < 0.3).alias("specificity"),
    )


@query("AGG24_fold_metrics", "with p as (select cast(floor(id / 6e0) as bigint) % 4 as fold, y, s from pred), t as (select fold, s, sum(y) as n1, sum(1 - y) as n0 from p group by 1, 2), r as (select *, sum(n1 + n0) over (partition by fold order by s rows between unbounded preceding and current row) - (n1 + n0) as below from t), a as (select fold, (sum(n1 * (below + (n1 + n0 + 1) / 2e0)) - sum(n1) * (sum(n1) + 1) / 2e0) / (sum(n1) * sum(n0) * 1e0) as auc from r group by fold) select round(avg(auc), 6) as auc_mean, round(stddev_pop(auc), 6) as auc_std, count(*) as folds from a")
def agg24(v):
    a = stats.auc(v.pred.withColumn("fold", F.floor(F.col("id") / 6.0) % 4), ["fold"])
    return a.agg(_r(F.avg("auc")).alias("auc_mean"), _r(F.stddev_pop("auc")).alias("auc_std"), F.count("*").alias("folds"))


@query("AGG25_threshold_candidates", """with k as (select quantile_cont(s, 0.1) as p10, min(s) as mtp from pred where y = 1), c as (select 'p10' as rule, p10 as t from k union all select 'min_training_presence', mtp from k union all select 'fixed', 0.4e0)
select rule, round(t, 6) as value, round(avg(case when s >= t then 1e0 else 0e0 end) filter (y = 1), 4) as sensitivity, round(avg(case when s < t then 1e0 else 0e0 end) filter (y = 0), 4) as specificity from c cross join pred group by rule, t""")
def agg25(v):
    k = stats.percentiles(v.pred.where("y = 1"), "s", {"p10": 0.1, "m": 0.0})
    c = k.select(F.explode(F.array(F.struct(F.lit("p10").alias("rule"), F.col("p10").alias("t")), F.struct(F.lit("min_training_presence").alias("rule"), F.col("m").alias("t")), F.struct(F.lit("fixed").alias("rule"), F.lit(0.4).alias("t")))).alias("r")).select("r.*")
    sens, spec = stats.rates(v.pred, F.col("t"))
    return v.pred.crossJoin(F.broadcast(c)).groupBy("rule", "t").agg(_r(sens, 4).alias("sensitivity"), _r(spec, 4).alias("specificity")).select("rule", _r("t").alias("value"), "sensitivity", "specificity")  # three rules


@query("AGG25_equal_rates", "with q as (select unnest(quantile_cont(s, [" + ", ".join(str(i / 200) for i in range(201)) + "])) as t from pred where y = 0), g as (select t from q union select s from pred where y = 1), n as (select t, abs(avg(case when s >= t then 1e0 else 0e0 end) filter (y = 1) - avg(case when s < t then 1e0 else 0e0 end) filter (y = 0)) as gap from g cross join pred group by t) select round(t, 4) as threshold from n order by gap, t limit 1")
def agg25b(v):
    return stats.equal_rates_threshold(v.pred).select(_r("threshold", 4).alias("threshold"))


@query("AGG36_vif_pair", "select round(1e0 / (1e0 - corr(bio1, bio12) * corr(bio1, bio12)), 4) as vif from pred")
def agg36(v):
    f = stats.vif(v.pred, ["bio1", "bio12"])
    return v.spark.createDataFrame([(f["bio1"],)], "vif double").select(_r("vif", 4).alias("vif"))


@query("AGG36_greedy_elimination")
def agg36b(v):
    kept = stats.low_collinearity(v.cells.withColumn("twin", F.col("bio1") * 2.0 + 1.0), ["bio1", "bio4", "bio12", "twin"], protected=("bio1",))
    return v.spark.createDataFrame([(i, c) for i, c in enumerate(kept)], "position int, predictor string")


@query("AGG37_standardise", "select id, y, round((bio1 - m) / coalesce(nullif(d, 0), 1e0), 6) as z from pred cross join (select avg(bio1) as m, stddev_pop(bio1) as d from pred) t where y = 1")
def agg37(v):
    t = v.pred.agg(F.avg("bio1").alias("m"), F.stddev_pop("bio1").alias("d"))
    z = (F.col("bio1") - F.col("m")) / F.coalesce(F.nullif("d", F.lit(0.0)), F.lit(1.0))
    return v.pred.where("y = 1").crossJoin(F.broadcast(t)).select("id", "y", _r(z).alias("z"))  # t is one row


_PREDICTORS = ("bio1", "bio4", "bio12")


@query("AGG38_covariance", " union all ".join(f"select '{a}' as a, '{b}' as b, round(covar_samp({a}, {b}), 3) as covariance from cells" for a in _PREDICTORS for b in _PREDICTORS))
def agg38(v):
    mean, cov, n = stats.covariance(v.cells, ["bio1", "bio4", "bio12"])
    names = ["bio1", "bio4", "bio12"]
    return v.spark.createDataFrame([(a, b, round(float(cov[i][j]), 3)) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, covariance double")


@query("AGG39_permutation_importance")
def agg39(v):
    from florascope.operators import models

    return models.permutation_importance(v.pred, ["bio1", "bio12"], lambda c: 1.0 / (1.0 + ((c["bio1"] - 15.0) / 8.0) ** 2 + ((c["bio12"] - 900.0) / 700.0) ** 2), repeats=3)


@query("AGG49_ensemble_weights", "with w as (select member, case when max(auc) over () >= 0.7e0 then case when auc >= 0.7e0 then auc - 0.5e0 else 0e0 end else 1e0 end as w from member_rows) select member, round(w / sum(w) over (), 6) as weight from w where w > 0")
def agg49(v):
    return severity.ensemble_weights(v.member_rows, 0.7).select("member", _r("weight").alias("weight"))


@query("AGG50_severity", """with i as (select cast(s_suppkey as int) as id, (s_suppkey % 10) / 10e0 as suit, (s_suppkey % 7) / 20e0 as frac, (s_suppkey % 5) / 4e0 as env, cast(s_suppkey % 13 as double) as spread from supplier),
 c as (select id, greatest(least(suit * least(1e0, frac / 0.1e0), 1e0), 0e0) as s1, greatest(least(env, 1e0), 0e0) as s2, spread / (spread + 5e0) as s3 from i), x as (select id, 0.35e0 * s1 + 0.25e0 * s2 + 0.2e0 * s3 + 0.2e0 * 0.5e0 as score from c)
select id, round(score, 4) as score, case when score >= 0.75e0 then 'very high' when score >= 0.5e0 then 'high' when score >= 0.25e0 then 'moderate' else 'low' end as category from x""")
def agg50(v):
    i = v.supplier.select(F.col("s_suppkey").cast("int").alias("id"), ((F.col("s_suppkey") % 10) / 10.0).alias("suit"), ((F.col("s_suppkey") % 7) / 20.0).alias("frac"), ((F.col("s_suppkey") % 5) / 4.0).alias("env"), (F.col("s_suppkey") % 13).cast("double").alias("spread"))
    s = severity.score(F.col("suit"), F.col("frac"), F.col("env"), F.col("spread"))
    return i.select("id", _r(s, 4).alias("score"), severity.category(s).alias("category"))


@query("AGG51_confidence", """with i as (select s_suppkey as id, case when s_suppkey % 3 = 0 then 'A' else 'B' end as model_type, (s_suppkey % 40) / 100e0 as extrapolated, (s_suppkey % 90) / 100e0 as analog, (s_suppkey % 50) / 100e0 as mess_out, case when s_suppkey % 7 <> 0 then (s_suppkey % 60) / 100e0 end as cbi from supplier),
 r as (select id, list_filter([case when model_type = 'A' then 'model_a' end, case when extrapolated > 0.25e0 then 'extrapolated_low' when extrapolated > 0.1e0 then 'extrapolated_moderate' end, case when analog < 0.6e0 then 'few_analogs' end, case when mess_out > 0.25e0 then 'mess_cap' end, case when cbi < 0.2e0 then 'cbi_floor' end], lambda x: x is not null) as reasons from i)
select id, case when list_contains(reasons, 'model_a') or list_contains(reasons, 'extrapolated_low') then 'low' when len(reasons) > 0 then 'moderate' else 'high' end as level, array_to_string(reasons, ';') as reasons from r""")
def agg51(v):
    k = F.col("s_suppkey")
    i = v.supplier.select(k.alias("id"), F.when(k % 3 == 0, "A").otherwise("B").alias("model_type"), ((k % 40) / 100.0).alias("e"), ((k % 90) / 100.0).alias("a"), ((k % 50) / 100.0).alias("m"), F.when(k % 7 != 0, (k % 60) / 100.0).alias("cbi"))
    level, reasons = severity.confidence(F.col("model_type"), F.col("e"), F.col("a"), F.col("m"), F.col("cbi"))
    return i.withColumn("r", reasons).select("id", level(F.col("r")).alias("level"), F.array_join("r", ";").alias("reasons"))


@query("AGG53_ranked_predictor_sets", "with s as (select p_brand as set_name, avg(p_size) / 50e0 as cbi, avg(p_retailprice) as auc from part group by 1) select set_name, row_number() over (order by cbi desc nulls last, auc desc nulls last, set_name) as rank, cbi >= max(cbi) over () - 0.02e0 as tied from s")
def agg53(v):
    s = v.part.groupBy(F.col("p_brand").alias("set_name")).agg((F.avg("p_size") / 50.0).alias("cbi"), F.avg("p_retailprice").alias("auc"))
    order = Window.orderBy(F.desc_nulls_last("cbi"), F.desc_nulls_last("auc"), "set_name")  # a row for each set
    return s.select("set_name", F.row_number().over(order).alias("rank"), (F.col("cbi") >= F.max("cbi").over(Window.partitionBy()) - 0.02).alias("tied"))


@query("WIN5_rank_nulls_last", "select p_partkey, row_number() over (order by case when p_size % 5 = 0 then null else p_size end desc nulls last, p_retailprice desc, p_partkey) as rank from part")
def win5(v):
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    return v.part.select("p_partkey", F.row_number().over(Window.orderBy(size.desc_nulls_last(), F.desc("p_retailprice"), "p_partkey")).alias("rank"))


@query("AGG54_target_groups", "select p_type, arg_max(p_brand, struct_pack(a := p_size, b := p_retailprice, c := p_partkey)) as best from part where p_size > 5 group by 1")
def agg54(v):
    return v.part.where("p_size > 5").groupBy("p_type").agg(F.max_by("p_brand", F.struct("p_size", "p_retailprice", "p_partkey")).alias("best"))


@query("WIN6_argmin_first", "select row, col, case when a <= b and a <= c then 'bio1' when b <= c then 'bio4' else 'bio12' end as lowest from (select row, col, abs(bio1 - 10e0) as a, bio4 / 60e0 as b, bio12 / 90e0 as c from cells) t")
def win6(v):
    a = F.array(F.abs(F.col("bio1") - 10.0), F.col("bio4") / 60.0, F.col("bio12") / 90.0)
    names = F.array(F.lit("bio1"), F.lit("bio4"), F.lit("bio12"))
    return v.cells.select("row", "col", F.element_at(names, F.array_position(a, F.array_min(a)).cast("int")).alias("lowest"))


@query("WIN12_top_importances", "select id, array_to_string([x.k for x in list_sort([{v: -bio1, k: 'bio1'}, {v: -bio12, k: 'bio12'}, {v: -bio4, k: 'bio4'}])][1:2], ',') as top from importance_rows")
def win12(v):
    named = F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(c).alias("k")) for c in ("bio1", "bio12", "bio4")])
    return v.importance_rows.select("id", F.array_join(F.transform(F.slice(F.array_sort(named), 1, 2), lambda e: e["k"]), ",").alias("top"))


@query("WIN11_best_repetition")
def win11(v):
    from florascope.operators import sampling

    return sampling.best_thinning(v.occ.where("taxon_key = 5000002"), "record_id", 100.0, repetitions=3)


@query("TXT1_score_words", "select case when s >= 0.9e0 then 'excellent' when s >= 0.8e0 then 'good' when s >= 0.7e0 then 'fair' else 'poor' end as word, count(*) as n from pred group by 1")
def txt1(v):
    return v.pred.groupBy(sc.auc_words(F.col("s")).alias("word")).agg(F.count("*").alias("n"))
