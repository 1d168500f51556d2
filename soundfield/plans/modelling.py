"""Queries over models: folds, out-of-fold predictions, scores, intervals, map and artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundfield import config as C
from soundfield.functions.numbers import rounded
from soundfield.models import baselines, emissions, features, folds, kernel, trees
from soundfield.operators import evaluation, grid
from soundfield.plans.counts import _CM, _matched_counts
from soundfield.plans.registry import query
from soundfield.plans.spatial import _DIST, _to_segment
from soundfield.plans.tables import Tables, oracle
from soundfield.session import cut_lineage

SITES = ("site0", "site1", "site2")
TREES_SMALL = trees.TreeSize(rounds=20, depth=4, step=0.1)
RESIDUAL_SMALL = trees.TreeSize(rounds=15, depth=3, step=0.1)


def _blocked(t: Tables) -> DataFrame:
    return features.with_block(t.meas)


def _folded(t: Tables) -> DataFrame:
    return folds.with_block_folds(_blocked(t))


def _with_roads(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.join(features.road_distances(t.meas, t.roads), ["x", "y"])


def _featured(t: Tables) -> DataFrame:
    """Measurements with all features, block folds; reused by several fits, so kept."""
    rows = folds.with_block_folds(_blocked(t))
    return cut_lineage(features.time_features(rows.join(features.morphology(t.meas, t.building_points, t.nodes, t.roads), ["x", "y"])))


_BLOCKED = "select *, cast(floor(x / 600) as bigint) as block_x, cast(floor(y / 600) as bigint) as block_y from meas"
_ORDERED = "select *, row_number() over (order by size desc, block_x, block_y) as i from (select block_x, block_y, count(*) as size from blocked group by 1, 2)"
_PICK = "case when l0 <= l1 and l0 <= l2 and l0 <= l3 and l0 <= l4 then 0 when l1 <= l2 and l1 <= l3 and l1 <= l4 then 1 when l2 <= l3 and l2 <= l4 then 2 when l3 <= l4 then 3 else 4 end"
_GREEDY = f"""select cast(0 as bigint) as i, cast(0 as bigint) as l0, cast(0 as bigint) as l1, cast(0 as bigint) as l2, cast(0 as bigint) as l3, cast(0 as bigint) as l4, cast(-1 as int) as fold
 union all select i1, l0 + case when f = 0 then size else 0 end, l1 + case when f = 1 then size else 0 end, l2 + case when f = 2 then size else 0 end, l3 + case when f = 3 then size else 0 end, l4 + case when f = 4 then size else 0 end, f
 from (select o.i as i1, o.size, l0, l1, l2, l3, l4, cast({_PICK} as int) as f from greedy g join ordered o on o.i = g.i + 1)"""
_FOLDED = "select b.*, g.fold from blocked b join ordered o on o.block_x = b.block_x and o.block_y = b.block_y join greedy g on g.i = o.i"
_FOLDS = {"blocked": _BLOCKED, "ordered": _ORDERED, "greedy": _GREEDY, "folded": _FOLDED}


@query("spatial_blocks", oracle("select obs_id, cast(block_x as string) || '_' || cast(block_y as string) as block from blocked", blocked=_BLOCKED))
def spatial_blocks(t: Tables):
    return _blocked(t).select("obs_id", "block")


@query("block_folds", oracle("select distinct block_x, block_y, fold from folded", **_FOLDS))
def block_folds(t: Tables):
    return folds.block_folds(_blocked(t))


_MEANS = """select obs_id, ga as global_mean, coalesce(sa, ga) as site_mean, coalesce(ha, sa, ga) as site_hour_mean from
 (select r.*, (select avg(noise_db) from {t} q where q.{f} <> r.{f}) as ga, (select avg(noise_db) from {t} q where q.{f} <> r.{f} and q.site = r.site) as sa,
   (select avg(noise_db) from {t} q where q.{f} <> r.{f} and q.site = r.site and q.hour = r.hour) as ha from {t} r)"""


@query("block_fold_means", oracle(_MEANS.format(t="folded", f="fold"), "global_mean site_mean site_hour_mean", **_FOLDS))
def block_fold_means(t: Tables):
    return baselines.fold_means(_folded(t)).select("obs_id", "global_mean", "site_mean", "site_hour_mean")


@query("site_out_means", oracle(_MEANS.format(t="meas", f="site"), "global_mean site_mean site_hour_mean"))
def site_out_means(t: Tables):
    rows = t.meas.withColumn("fold", F.col("site"))
    return baselines.fold_means(rows).select("obs_id", "global_mean", "site_mean", "site_hour_mean")


_IN = f"select a.obs_id, b.noise_db, b.site, b.hour, a.site as site_a, a.hour as hour_a from meas a join meas b on {_DIST} <= 300"


@query("buffered_means", oracle(
    """select r.obs_id, n - n_in as n_train, (s - s_in) / (n - n_in) as global_mean, coalesce((ss - ss_in) / nullif(sn - sn_in, 0), (s - s_in) / (n - n_in)) as site_mean,
       coalesce((hs - hs_in) / nullif(hn - hn_in, 0), (ss - ss_in) / nullif(sn - sn_in, 0), (s - s_in) / (n - n_in)) as site_hour_mean
       from (select obs_id, count(*) over () as n, sum(noise_db) over () as s, count(*) over (partition by site) as sn, sum(noise_db) over (partition by site) as ss, count(*) over (partition by site, hour) as hn, sum(noise_db) over (partition by site, hour) as hs from meas) r
       join (select obs_id, count(*) as n_in, sum(noise_db) as s_in, count(*) filter (site = site_a) as sn_in, sum(noise_db) filter (site = site_a) as ss_in, count(*) filter (site = site_a and hour = hour_a) as hn_in, sum(noise_db) filter (site = site_a and hour = hour_a) as hs_in from near group by 1) i on i.obs_id = r.obs_id""",
    "global_mean site_mean site_hour_mean", near=_IN))
def buffered_means(t: Tables):
    """Buffered leave-one-out of the mean models, with the training size of every row."""
    return baselines.buffered_means(t.meas).select("obs_id", "n_train", "global_mean", "site_mean", "site_hour_mean")


_ROADED = "select m.*, r.d as dist_road_m, log10(greatest(r.d, 1)) as lx from {t} m join (select px, py, min(d) as d from seg group by 1, 2) r on r.px = m.x and r.py = m.y"
_SEG = {"seg": _to_segment("meas")}
_LINE_FIT = """select r.obs_id, slope * lx + icpt as dist_road from {t} r join (select f, regr_slope(noise_db, lx) as slope, regr_intercept(noise_db, lx) as icpt
 from (select distinct {f} as f from {t}) k join {t} q on q.{f} <> k.f group by f) m on m.f = r.{f}"""


@query("block_fold_line", oracle(_LINE_FIT.format(t="roaded", f="fold"), "dist_road", **_FOLDS, **_SEG, roaded=_ROADED.format(t="folded")))
def block_fold_line(t: Tables):
    rows = cut_lineage(_with_roads(t, _folded(t)).select("obs_id", "fold", "noise_db", "dist_road_m"))
    return baselines.fold_distance_line(rows).select("obs_id", "dist_road")


@query("site_out_line", oracle(_LINE_FIT.format(t="roaded", f="site"), "dist_road", **_SEG, roaded=_ROADED.format(t="meas")))
def site_out_line(t: Tables):
    rows = cut_lineage(_with_roads(t, t.meas).select("obs_id", "site", "noise_db", "dist_road_m"))
    return baselines.fold_distance_line(rows, "site").select("obs_id", "dist_road")


@query("buffered_line", oracle(
    """select obs_id, ((n * sxy - sx * sy) / (n * sxx - sx * sx)) * lx + (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n as dist_road from
       (select r.obs_id, r.lx, t.n - i.n as n, t.sx - i.sx as sx, t.sy - i.sy as sy, t.sxx - i.sxx as sxx, t.sxy - i.sxy as sxy from roaded r,
         (select count(*) as n, sum(lx) as sx, sum(noise_db) as sy, sum(lx * lx) as sxx, sum(lx * noise_db) as sxy from roaded) t,
         (select a.obs_id, count(*) as n, sum(b.lx) as sx, sum(b.noise_db) as sy, sum(b.lx * b.lx) as sxx, sum(b.lx * b.noise_db) as sxy from roaded a join roaded b on """ + _DIST + """ <= 300 group by 1) i where i.obs_id = r.obs_id)""",
    "dist_road", **_SEG, roaded=_ROADED.format(t="meas")))
def buffered_line(t: Tables):
    rows = cut_lineage(_with_roads(t, t.meas).select("obs_id", "x", "y", "noise_db", "dist_road_m"))
    return baselines.buffered_distance_line(rows).select("obs_id", "dist_road")


@query("log_line_in_sample", oracle(
    """select count(*) as n, regr_slope(noise_db, ln(1 + dist_road_m)) as slope, regr_intercept(noise_db, ln(1 + dist_road_m)) as intercept, regr_r2(noise_db, ln(1 + dist_road_m)) as r2 from roaded""",
    "slope intercept r2", **_SEG, roaded=_ROADED.format(t="meas")))
def log_line_in_sample(t: Tables):
    return baselines.log1p_fit(_with_roads(t, t.meas))


_IDW = """select obs_id, sum(w * v) / sum(w) as idw from (select a.obs_id, b.noise_db as v, 1 / pow(greatest({d}, 1e-6), 2) as w, row_number() over (partition by a.obs_id order by {d}, b.seq) as rn
 from {t} a join {t} b on {c}) where rn <= 8 group by 1"""


@query("block_fold_idw", oracle(_IDW.format(t="folded", d=_DIST, c="a.fold <> b.fold"), "idw", **_FOLDS))
def block_fold_idw(t: Tables):
    return baselines.inverse_distance(_folded(t), fold="fold").select("obs_id", "idw")


@query("site_out_idw", oracle(_IDW.format(t="meas", d=_DIST, c="a.site <> b.site"), "idw"))
def site_out_idw(t: Tables):
    return baselines.inverse_distance(t.meas, fold="site").select("obs_id", "idw")


@query("buffered_idw", oracle(_IDW.format(t="meas", d=_DIST, c=f"{_DIST} > 300"), "idw"))
def buffered_idw(t: Tables):
    return baselines.inverse_distance(t.meas, buffer=C.BUFFER_M).select("obs_id", "idw")


# ------------------------------------------------------------------------- scores, intervals


def _mean_predictions(t: Tables) -> DataFrame:
    """Long table: mean models under block folds and leave-one-site-out."""
    parts = []
    for protocol, rows in (("block_cv", _folded(t)), ("site_out", _blocked(t).withColumn("fold", F.col("site")))):
        wide = baselines.fold_means(rows)
        models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("global_mean", "site_mean", "site_hour_mean")])
        parts.append(wide.select(
            F.lit(protocol).alias("protocol"), "obs_id", "site", "block_x", "block_y", F.col("noise_db").alias("y"), F.explode(models).alias("m")
        ).select("protocol", "obs_id", "site", "block_x", "block_y", "y", "m.model", "m.p"))
    return parts[0].unionByName(parts[1])


_PRED = """select protocol, obs_id, site, block_x, block_y, noise_db as y, model, p from (
 select 'block_cv' as protocol, m.*, b.site, b.block_x, b.block_y, b.noise_db from bm m join blocked b on b.obs_id = m.obs_id union all select 'site_out', m.*, b.site, b.block_x, b.block_y, b.noise_db from sm m join blocked b on b.obs_id = m.obs_id)
 unpivot (p for model in (global_mean, site_mean, site_hour_mean))"""
_PRED_CTES = {**_FOLDS, "bm": _MEANS.format(t="folded", f="fold"), "sm": _MEANS.format(t="meas", f="site"), "pred": _PRED}
_SCORES = """select {k}, count(*) as n, case when stddev_pop(p) > 1e-9 then corr(y, p) end as r, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as r2, avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse
 from pred group by {k}"""


@query("model_scores", oracle(_SCORES.format(k="protocol, model"), "r r2 mae rmse", **_PRED_CTES))
def model_scores(t: Tables):
    return evaluation.scores(_mean_predictions(t))


@query("scores_per_site", oracle(_SCORES.format(k="protocol, model, site"), "r r2 mae rmse", **_PRED_CTES))
def scores_per_site(t: Tables):
    return evaluation.scores(_mean_predictions(t), ["protocol", "model", "site"])


@query("bootstrap_intervals", oracle(
    """select protocol, model, quantile_cont(r2, 0.025) as r2_lo, quantile_cont(r2, 0.975) as r2_hi, quantile_cont(mae, 0.025) as mae_lo, quantile_cont(mae, 0.975) as mae_hi from
       (select protocol, model, b, 1 - sum(see) / (sum(syy) - sum(sy) * sum(sy) / sum(n)) as r2, sum(sae) / sum(n) as mae from draws d join idx on idx.i = d.i group by 1, 2, 3) group by 1, 2""",
    "r2_lo r2_hi mae_lo mae_hi", **_PRED_CTES,
    idx="""select *, row_number() over (partition by protocol, model order by block_x, block_y) - 1 as i from (select protocol, model, block_x, block_y, count(*) as n, sum(y - mu) as sy, sum((y - mu) * (y - mu)) as syy, sum((y - p) * (y - p)) as see, sum(abs(y - p)) as sae
           from (select *, avg(y) over (partition by protocol, model) as mu from pred) group by 1, 2, 3, 4)""",
    nb="select count(*) as nb from (select distinct block_x, block_y from blocked)",
    draws="""select b, cast('0x' || substr(md5('0:' || b || ':' || j), 1, 8) as bigint) % nb as i from nb, (select unnest(range(0, 2000)) as b) bs, lateral (select unnest(range(0, nb.nb)) as j) js"""))
def bootstrap_intervals(t: Tables):
    """95 % block-bootstrap intervals, 2000 replicates."""
    return evaluation.bootstrap_intervals(_mean_predictions(t))


_SC = {**_PRED_CTES, "sc": _SCORES.format(k="protocol, model")}


@query("model_ranking", oracle("select protocol, model, r2, rank() over (partition by protocol order by r2 desc) as rank from sc", "r2", **_SC))
def model_ranking(t: Tables):
    return evaluation.rank_models(evaluation.scores(_mean_predictions(t))).select("protocol", "model", "r2", F.col("rank").cast("bigint").alias("rank"))


@query("rank_shift", oracle(
    """select a.model, a.rank as rank_first, b.rank as rank_second, b.rank - a.rank as shift from (select *, rank() over (order by r2 desc) as rank from sc where protocol = 'block_cv') a
       join (select *, rank() over (order by r2 desc) as rank from sc where protocol = 'site_out') b on b.model = a.model""", **_SC))
def rank_shift(t: Tables):
    got = evaluation.rank_shift(evaluation.scores(_mean_predictions(t)), "block_cv", "site_out")
    return got.select("model", *[F.col(c).cast("bigint").alias(c) for c in ("rank_first", "rank_second", "shift")])


@query("paired_gains", oracle(
    """select a.protocol, a.model, b.model as versus, a.r2 - b.r2 as gain_r2, b.mae - a.mae as gain_mae_db from sc a join sc b on a.protocol = b.protocol
       and ((a.model = 'site_hour_mean' and b.model = 'site_mean') or (a.model = 'site_mean' and b.model = 'global_mean'))""", "gain_r2 gain_mae_db", **_SC))
def paired_gains(t: Tables):
    return evaluation.paired_gains(
        evaluation.scores(_mean_predictions(t)), [("site_hour_mean", "site_mean"), ("site_mean", "global_mean")]
    )


@query("delivered_model", oracle(
    "select model, r2 from sc where protocol = 'block_cv' order by r2 desc, case model when 'global_mean' then 0 when 'site_mean' then 1 else 2 end limit 1", "r2", **_SC))
def delivered_model(t: Tables):
    return evaluation.delivered_model(
        evaluation.scores(_mean_predictions(t)), "block_cv", ("global_mean", "site_mean", "site_hour_mean")
    )


_TRANSFER = "select * exclude (y), noise_db as y, 30 + 0.4e0 * noise_db + obs_id % 20 as p from folded"


def _transferred(t: Tables) -> DataFrame:
    return _folded(t).withColumn("y", F.col("noise_db")).withColumn("p", 30 + 0.4 * F.col("noise_db") + F.col("obs_id") % 20)


@query("transfer_diagnostics", oracle(
    """select site, count(*) as n, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as r2_raw, 1 - var_pop(y - p) / var_pop(y) as r2_bias_removed, pow(corr(y, p), 2) as r2_bias_and_scale_removed,
       corr(y, p) as r, avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse, avg(p) - avg(y) as bias, regr_slope(y, p) as slope from tr group by site""",
    "r2_raw r2_bias_removed r2_bias_and_scale_removed r mae rmse bias slope", **_FOLDS, tr=_TRANSFER))
def transfer_diagnostics(t: Tables):
    return evaluation.transfer_diagnostics(_transferred(t), ["site"])


@query("offset_transfer", oracle(
    "select obs_id, p + (select avg(y - p) from tr q where q.fold <> r.fold) as p_offset from tr r", "p_offset", **_FOLDS, tr=_TRANSFER))
def offset_transfer(t: Tables):
    return evaluation.offset_per_fold(_transferred(t)).select("obs_id", "p_offset")


@query("random_split", oracle("select obs_id, cast('0x' || substr(md5('42:' || obs_id), 1, 8) as bigint) / 4294967296e0 < 0.2 as is_test from meas"))
def random_split(t: Tables):
    return folds.random_split(t.meas, "obs_id").select("obs_id", "is_test")


@query("group_split", oracle(
    """select obs_id, who, i < round(g * 0.3) as is_train from meas join (select who, row_number() over (order by md5('42:' || who), who) - 1 as i, count(*) over () as g from (select distinct who from meas)) s using (who)"""))
def group_split(t: Tables):
    return folds.group_split(t.meas, "who", 0.3).select("obs_id", "who", "is_train")


# ---------------------------------------------------------------------- kernel, trees, map


@query("kernel_fit")
def kernel_fit(t: Tables):
    """Coefficients of the kernel on all rows and for each left-out site."""
    rows = cut_lineage(_with_roads(t, t.meas).select("site", "noise_db", "dist_highway_m", "dist_residential_m"))
    fits = {"all": kernel.fit_kernels(rows)[None], **kernel.fit_kernels(rows, "site", SITES)}
    return t.spark.createDataFrame(
        [(str(k), v.a_hw, v.a_res, v.b, v.cost, v.iterations) for k, v in fits.items()],
        "left_out string, a_hw double, a_res double, b double, cost double, iterations int",
    )


@query("kernel_scores")
def kernel_scores(t: Tables):
    """Kernel against the distance line under three protocols, with intervals."""
    rows = cut_lineage(_with_roads(t, _folded(t)))
    fold_names = list(range(C.N_FOLDS))
    by_block = kernel.predict_by_fold(baselines.fold_distance_line(rows), kernel.fit_kernels(rows, "fold", fold_names), "fold")
    by_site = kernel.predict_by_fold(baselines.fold_distance_line(rows, "site"), kernel.fit_kernels(rows, "site", SITES), "site")
    buffered = baselines.buffered_distance_line(kernel.buffered_kernel(rows))
    parts = []
    for protocol, wide in (("block_cv", by_block), ("site_out", by_site), ("buffered", buffered)):
        models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("dist_road", "kernel")])
        parts.append(wide.select(F.lit(protocol).alias("protocol"), F.col("noise_db").alias("y"), "block_x", "block_y", F.explode(models).alias("m")))
    long = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("protocol", "y", "block_x", "block_y", "m.model", "m.p")
    long = cut_lineage(long)
    return evaluation.scores(long).join(evaluation.bootstrap_intervals(long), ["protocol", "model"])


@query("kernel_predictions", oracle(
    """select px as x, py as y, 10 * log10(4.774e7 / greatest(coalesce(min(d) filter (kind = 'major'), 2000), 5) + 3.8e7 / greatest(coalesce(min(d) filter (kind = 'minor'), 2000), 5) + 1.1e-10) as level_db from seg group by 1, 2""",
    "x y level_db", **_SEG))
def kernel_predictions(t: Tables):
    """Published kernel at the measured positions."""
    near = features.road_distances(t.meas, t.roads)
    return near.select("x", "y", kernel.predict(kernel.published(), F.col("dist_highway_m"), F.col("dist_residential_m")).alias("level_db"))


@query("grid_prediction", oracle(
    f"""select c.site, c.ix, c.iy, round_even(d_hw, 1) as d_hw, round_even(d_res, 1) as d_res, round_even(10 * log10(4.774e7 / greatest(d_hw, 5) + 3.8e7 / greatest(d_res, 5) + 1.1e-10), 2) as level_db
        from cells c join (select px, py, min(d) filter (kind = 'major') as d_hw, min(d) filter (kind = 'minor') as d_res from seg group by 1, 2) s on s.px = c.x and s.py = c.y""",
    "d_hw d_res level_db", seg=_to_segment("cells")))
def grid_prediction(t: Tables):
    """Noise map: grid, road distances, kernel; the level is the same at every hour without a residual."""
    cells = grid.grid_cells(t.layout)
    placed = cells.join(features.road_distances(cells, t.roads), ["x", "y"])
    level = kernel.predict(kernel.published(), F.col("dist_highway_m"), F.col("dist_residential_m"))
    return placed.select(
        "site", "ix", "iy", rounded("dist_highway_m", 1).alias("d_hw"), rounded("dist_residential_m", 1).alias("d_res"), rounded(level, 2).alias("level_db")
    )


@query("emissions_by_flow")
def emissions_by_flow(t: Tables):
    coefficients, _ = emissions.fit_emissions(emissions.with_heavy(_matched_counts(t)), "_flow")
    return coefficients.select("category", "identifiable", "level_db")


@query("emissions_by_density")
def emissions_by_density(t: Tables):
    coefficients, _ = emissions.fit_emissions(emissions.with_heavy(_matched_counts(t)), "_mean")
    return coefficients.select("category", "identifiable", "level_db")


@query("morphology_correlations", oracle(
    """select count(*) as n, corr(noise_db, lx) as r_dist, corr(noise_db, dist_road_m) as r_dist_road_m from roaded""", "r_dist r_dist_road_m", **_SEG, roaded=_ROADED.format(t="meas")))
def morphology_correlations(t: Tables):
    rows = _with_roads(t, t.meas)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.corr("noise_db", features.log_distance(F.col("dist_road_m"))).alias("r_dist"),
        F.corr("noise_db", "dist_road_m").alias("r_dist_road_m"),
    )


@query("trees_by_block")
def trees_by_block(t: Tables):
    """Boosted trees on morphology and time, scored out of fold."""
    rows = _featured(t)
    got = trees.trees_by_fold(rows, "fold", range(C.N_FOLDS), trees.FEATURE_SETS["trees_v2"], "p", size=TREES_SMALL)
    return evaluation.scores(got.withColumn("y", F.col("noise_db")).withColumn("protocol", F.lit("block_cv")).withColumn("model", F.lit("trees_v2")))


@query("hybrid_by_site")
def hybrid_by_site(t: Tables):
    """Kernel plus trees on its residual, leave-one-site-out."""
    got = trees.hybrid_by_fold(_featured(t), "site", SITES, "p", size=RESIDUAL_SMALL)
    return evaluation.scores(got.withColumn("y", F.col("noise_db")).withColumn("protocol", F.lit("site_out")).withColumn("model", F.lit("hybrid")), ["protocol", "model", "site"])
