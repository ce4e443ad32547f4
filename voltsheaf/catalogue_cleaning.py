"""Registered queries of the cleaning chain, of norms with site effects and of stored tables, with SQL where it can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from voltsheaf.catalogue import query, rounded, table
from voltsheaf.functions import filters
from voltsheaf.operators import normdata, site_norms, stats
from voltsheaf.plans import cleaning, rejection
from voltsheaf.plans import kernels as K
from voltsheaf.sources import files, tables
from voltsheaf.sources.scratch import scratch

SERIES = """s AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS v FROM events WHERE value IS NOT NULL),
n AS (SELECT user_id, max(i) AS last, max(v) FILTER (i = 0) AS v0, arg_max(v, i) AS v1 FROM s GROUP BY 1)"""


def padded(reach: int) -> str:
    """A recording with its ends turned about the end values, as far as it reaches, then zero."""
    return f"""p AS MATERIALIZED (SELECT user_id, i, v FROM s UNION ALL SELECT user_id, -i, 2 * v0 - v FROM s JOIN n USING (user_id) WHERE i BETWEEN 1 AND {reach}
UNION ALL SELECT user_id, 2 * last - i, 2 * v1 - v FROM s JOIN n USING (user_id) WHERE last - i BETWEEN 1 AND {reach})"""


def values(taps) -> str:
    return ", ".join(f"({k}, {float(h)!r}::DOUBLE)" for k, h in enumerate(taps))


TAPS = filters.fir_kernel(24.0, 2.0, 8.0, 10.0)
HALF = len(TAPS) // 2


@query(
    f"""WITH {SERIES}, {padded(HALF)}, h(k, h) AS (VALUES {values(TAPS)})
SELECT s.user_id::VARCHAR AS subject, s.i AS t_idx, round(sum(h * p.v), 6) + 0 AS value FROM s JOIN h ON true JOIN p ON p.user_id = s.user_id AND p.i = s.i + k - {HALF} GROUP BY 1, 2"""
)
def filtered_samples(spark, sf_dir):
    samples = K.event_series(spark, sf_dir)
    return rounded(cleaning.filtered(samples, 24.0, 2.0, 8.0, 10.0, block=10.0).select("subject", "t_idx", "value"), "value")


PHASES, REACH = filters.resample_taps(5, 12)


@query(
    f"""WITH {SERIES}, {padded(REACH)}, h(phase, k, h) AS (VALUES {", ".join(f"({a}, {k}, {float(x)!r}::DOUBLE)" for a, row in enumerate(PHASES) for k, x in enumerate(row))}),
m AS (SELECT user_id, unnest(range(0, last * 5 // 12 + 1)) AS m FROM n)
SELECT m.user_id::VARCHAR AS subject, m AS t_idx, round(sum(h * p.v), 6) + 0 AS value FROM m JOIN h ON phase = m * 12 % 5 JOIN p ON p.user_id = m.user_id AND p.i = m * 12 // 5 - {REACH} + k GROUP BY 1, 2"""
)
def resampled_samples(spark, sf_dir):
    samples = K.event_series(spark, sf_dir)
    return rounded(cleaning.resampled(samples, 24.0, 10.0, block=10.0).select("subject", "t_idx", "value"), "value")


def vectors(spark, sf_dir):
    """embeddings as recordings: the label is the subject, a vector an instant, a component a channel."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("subject"), F.col("vec_id").alias("t_idx"), F.posexplode("embedding").alias("c", "v")).select("subject", F.format_string("c%02d", F.col("c")).alias("channel"), "t_idx", F.col("v").cast("double").alias("value"))


@query(
    "SELECT label::VARCHAR AS subject, vec_id AS t_idx, printf('c%02d', c) AS channel, round(CASE WHEN c % 2 = 0 THEN v - avg(v) FILTER (c % 2 = 0) OVER (PARTITION BY label, vec_id) ELSE v END, 6) + 0 AS value FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS c FROM embeddings)"
)
def average_referenced(spark, sf_dir):
    samples = vectors(spark, sf_dir)
    channels = samples.select("channel").distinct().filter("cast(substring(channel, 2, 2) AS int) % 2 = 0")
    return rounded(cleaning.average_reference(samples, channels).select("subject", "t_idx", "channel", "value"), "value")


@query()
def artefacts_removed(spark, sf_dir):
    """Components of the vectors are sensors, but for the last, the heart's channel."""
    samples = vectors(spark, sf_dir)
    sensors, heart = samples.filter("channel <> 'c63'"), samples.filter("channel = 'c63'")
    return cleaning.components_removed(sensors, heart, n=8, threshold=0.1, block=256, rounds=60, tolerance=1e-4)[0]


@query()
def artefact_components(spark, sf_dir):
    samples = vectors(spark, sf_dir)
    sensors, heart = samples.filter("channel <> 'c63'"), samples.filter("channel = 'c63'")
    return cleaning.components_removed(sensors, heart, n=8, threshold=0.1, block=256, rounds=60, tolerance=1e-4)[1]


@query()
def fastica(spark, sf_dir):
    return cleaning.independent_components(cleaning.lagged(K.event_series(spark, sf_dir), 2), n=2)


# rejection of epochs by learnt thresholds

STEPS, FOLDS = 5, 3
EPOCHS = f"""v AS MATERIALIZED (SELECT label % 4 AS s, 'c' || label // 4 AS ch, vec_id AS e, embedding::DOUBLE[] AS x, ((vec_id * 40503) % 65521) % {FOLDS} AS fold FROM embeddings),
r AS (SELECT *, list_max(x) - list_min(x) AS ptp FROM v), g AS (SELECT s, ch, min(ptp) AS lo, max(ptp) AS hi FROM r GROUP BY 1, 2),
b AS MATERIALIZED (SELECT r.*, lo, hi, greatest(1, least(coalesce(ceil((ptp - lo) / nullif(hi - lo, 0) * {STEPS}), 1), {STEPS}))::INTEGER AS step FROM r JOIN g USING (s, ch)),
p AS MATERIALIZED (SELECT s, ch, fold, step, unnest(x) AS v, unnest(range(len(x))) AS t FROM b),
m AS MATERIALIZED (SELECT s, ch, fold, t, median(v) AS med FROM p GROUP BY 1, 2, 3, 4),
k AS (SELECT m.s, m.ch, m.fold, m.t, j, any_value(med) AS med, avg(p.v) FILTER (p.fold <> m.fold AND p.step <= j) AS train FROM m JOIN p ON p.s = m.s AND p.ch = m.ch AND p.t = m.t CROSS JOIN range(1, {STEPS} + 1) j(j) GROUP BY 1, 2, 3, 4, 5),
f AS (SELECT s, ch, fold, j, sqrt(avg((train - med) * (train - med))) AS rms, count(train) = count(*) AS whole FROM k GROUP BY 1, 2, 3, 4),
h AS (SELECT s, ch, j, avg(rms) AS error FROM f GROUP BY 1, 2, 3 HAVING bool_and(whole)),
w AS (SELECT s, ch, arg_min(j, (error, j)) AS j, min(error) AS error FROM h GROUP BY 1, 2)"""


def vector_epochs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = F.col("label")
    return e.select((n % 4).cast("string").alias("subject"), F.concat(F.lit("c"), F.expr("label div 4").cast("string")).alias("channel"), F.col("vec_id").alias("epoch"), F.col("embedding").cast("array<double>").alias("x"))


@query(
    f"WITH {EPOCHS} SELECT g.s::VARCHAR AS subject, g.ch AS channel, round(CASE WHEN coalesce(j, {STEPS}) = {STEPS} THEN hi ELSE lo + (hi - lo) * j / {STEPS} END, 6) + 0 AS threshold, round(error, 6) + 0 AS error FROM g LEFT JOIN w USING (s, ch)"
)
def learnt_thresholds(spark, sf_dir):
    return rounded(rejection.learnt_thresholds(vector_epochs(spark, sf_dir), STEPS, FOLDS), "threshold", "error")


@query()
def learnt_rejection(spark, sf_dir):
    """Epochs of several channels: the parts of a vector are the channels of its instant."""
    e = table(spark, sf_dir, "embeddings")
    epochs = e.select((F.col("label") % 4).cast("string").alias("subject"), F.col("vec_id").alias("epoch"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(F.col("embedding").cast("array<double>"), k * 8 + 1, 8))).alias("c", "x"))
    return rejection.rejected(epochs.select("subject", F.concat(F.lit("c"), F.col("c").cast("string")).alias("channel"), "epoch", "x"), STEPS, FOLDS, 4)


# norms with site effects

FLAT = site_norms.Form(degree=0, spread_degree=0, ridge=1e-9, site_mean=1e-9, site_spread=1e-9)


def measures(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_returnflag").alias("site"), F.col("l_quantity").cast("double").alias("age"), F.explode(F.array(F.struct(F.lit("price").alias("response"), F.col("l_extendedprice").cast("double").alias("y")), F.struct(F.lit("tax").alias("response"), F.col("l_tax").cast("double").alias("y")))).alias("m")).select("site", "age", "m.response", "m.y")


@query(
    "SELECT response, site, round(avg(y), 2) + 0 AS mu, round(stddev_pop(y), 2) + 0 AS sigma FROM (SELECT l_returnflag AS site, unnest(['price', 'tax']) AS response, unnest([l_extendedprice::DOUBLE, l_tax::DOUBLE]) AS y FROM lineitem) GROUP BY 1, 2"
)
def site_spread_norms(spark, sf_dir):
    """Almost without priors and a covariate, sites have their own mean and spread, which SQL can tell."""
    rows = measures(spark, sf_dir)
    models = site_norms.fit_site_norms(rows, "age", "site", FLAT)
    return rounded(site_norms.predicted(rows.select("response", "site", "age").groupBy("response", "site").agg(F.max("age").alias("age")), models, "age", "site").select("response", "site", "mu", "sigma"), "mu", "sigma", digits=2)


@query()
def shaped_norms(spark, sf_dir):
    """Centiles by site of norms with a slope, site effects and a free shape."""
    rows = measures(spark, sf_dir)
    models = site_norms.fit_site_norms(rows, "age", "site", site_norms.Form(degree=1, shape=True), rounds=12, tolerance=1e-3)
    grid = rows.select("response", "site").distinct().withColumn("age", F.explode(F.array(*[F.lit(float(a)) for a in range(1, 51, 7)])))
    return rounded(site_norms.centiles(site_norms.predicted(grid, models, "age", "site")).select("response", "site", "age", "quantile", "value"), "value", digits=3)


@query(
    """WITH d AS (SELECT l_returnflag AS site, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS base, min(x) AS lo, max(x) AS hi FROM d),
g AS (SELECT i, lo + (hi - lo) * i / 149.0::DOUBLE AS x, base, slope FROM m, range(150) r(i)), c AS (SELECT i, x, base + slope * x AS v FROM g WHERE x <= 40)
SELECT 'price' AS response, round(x, 6) + 0 AS x, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 100, 6) + 0 AS value, v = max(v) OVER () AS peak, v = min(v) OVER () AS lowest, false AS turn FROM c"""
)
def response_curve(spark, sf_dir):
    rows = measures(spark, sf_dir).filter("response = 'price'")
    line = rows.groupBy("response").agg(F.regr_slope("y", "age").alias("slope"), F.regr_intercept("y", "age").alias("base"))
    sites = F.create_map(F.lit("A"), F.struct(F.lit(0.0).alias("u"), F.lit(0.0).alias("v")))
    models = line.select("response", F.lit(0.0).alias("y_mean"), F.lit(1.0).alias("y_sd"), F.lit(0.0).alias("x_mean"), F.lit(1.0).alias("x_sd"), F.array("base", "slope").alias("b"), F.array(F.lit(0.0)).alias("g"), F.lit(0.0).alias("e"), F.lit(0.0).alias("log_d"), sites.alias("sites"))
    return rounded(site_norms.response_curve(rows, models, "age", "site", upper=40.0), "x", "value")


# splits and quantiles of groups that hold most rows


@query(
    """SELECT c_name AS subject, c_mktsegment, CASE WHEN n <= floor(m * 0.5) THEN 'train' WHEN n <= floor(m * 0.5) + floor(m * 0.2) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT c_name, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (('0x' || substr(md5(c_name), 1, 8))::BIGINT % 1000003 * 2654435761 + 42 * 40503) % 1000003, c_name) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS m FROM customer)"""
)
def split_of_named_subjects(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("subject"), "c_mktsegment")
    return normdata.stratified_split(rows, ["c_mktsegment"], "subject", 0.5, 0.2)


@query(
    "SELECT hot, round(quantile_cont(v, 0.05), 6) + 0 AS low, round(quantile_cont(v, 0.5), 6) + 0 AS mid, round(quantile_cont(v, 0.99), 6) + 0 AS high FROM (SELECT l_linenumber < 7 AS hot, CASE WHEN l_orderkey % 10 = 0 THEN l_extendedprice ELSE 100 END::DOUBLE AS v FROM lineitem) GROUP BY 1"
)
def skewed_quantiles(spark, sf_dir):
    """A group of nearly all rows, nine tenths of which hold one value."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") < 7).alias("hot"), F.when(F.col("l_orderkey") % 10 == 0, F.col("l_extendedprice")).otherwise(100).cast("double").alias("v"))
    return rounded(stats.quantiles(l, "v", {"low": 0.05, "mid": 0.5, "high": 0.99}, by=("hot",)), "low", "mid", "high")


@query(
    "SELECT label::VARCHAR AS subject, vec_id AS t_idx, printf('c%02d', c) AS channel, round(v, 6) + 0 AS value, CASE WHEN r_name IS NULL THEN NULL ELSE lower(r_name) END AS type, n_nationkey::DOUBLE AS x, r_regionkey::DOUBLE AS y, 0.5::DOUBLE AS z FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS c FROM embeddings) LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) ON n_nationkey = c"
    .replace("0.5::DOUBLE AS z", "CASE WHEN n_nationkey IS NOT NULL THEN 0.5::DOUBLE END AS z")
)
def prepared_samples(spark, sf_dir):
    """Types and positions of the first channels come from the nations, the others have none."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.format_string("c%02d", "n_nationkey")
    types = n.select(name.alias("name"), F.upper("r_name").alias("type"))
    places = n.select(name.alias("Channel"), F.col("n_nationkey").cast("double").alias("X"), F.col("r_regionkey").cast("double").alias("Y"), F.lit(0.5).alias("Z"))
    return rounded(files.prepared(vectors(spark, sf_dir), types, places), "value")


# stored tables: each kind is written, and for a part of its keys written again


def stored(spark, sf_dir) -> dict:
    """Rows of every kind of table, from the tables at hand."""
    e, o, l = (table(spark, sf_dir, t) for t in ("embeddings", "orders", "lineitem"))
    text = lambda c: F.col(c).cast("string")
    c = table(spark, sf_dir, "customer")
    return {
        "psd": e.select(text("label").alias("subject"), text("vec_id").alias("channel"), F.array(F.lit(1.0), F.lit(2.0)).alias("freqs"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("power")),
        "features": l.select(text("l_orderkey").alias("subject"), F.lit("f").alias("feature"), F.col("l_returnflag").alias("band"), text("l_linenumber").alias("region"), F.col("l_quantity").alias("value")),
        "splits": c.select(text("c_custkey").alias("subject"), F.lit("train").alias("split"), F.lit(42).alias("seed")),
        "quantile_cube": o.select(F.col("o_orderpriority").alias("response"), F.lit(0).alias("sex"), F.lit(1).alias("site"), F.col("o_orderkey").alias("age"), F.lit(0.5).alias("quantile"), F.col("o_totalprice").alias("value")),
        "z_scores": o.select(text("o_custkey").alias("subject"), (F.col("o_orderkey") % 4).alias("run"), F.lit("g").alias("group"), F.lit(1).alias("site"), F.col("o_orderstatus").alias("response"), F.col("o_totalprice").alias("z")),
        "diagnostics": c.select(F.col("c_mktsegment").alias("model"), text("c_custkey").alias("parameter"), F.col("c_acctbal").alias("r_hat"), F.lit(1.0).alias("ess_bulk"), F.lit(1.0).alias("ess_tail"), F.lit(1.0).alias("mcse_sd")),
        "exclusions": c.filter("c_acctbal < 0").select(text("c_custkey").alias("subject"), F.lit("quality").alias("reason")),
        "run_manifest": o.select(F.col("o_orderpriority").alias("job"), text("o_orderkey").alias("subject"), F.lit("x").alias("command"), F.col("o_orderstatus").alias("state")),
    }


@query(
    """SELECT 'psd' AS kind, count(*) AS n, count(DISTINCT label) AS n_keys FROM embeddings UNION ALL SELECT 'features', count(*), count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'splits', count(*), count(DISTINCT c_custkey) FROM customer
UNION ALL SELECT 'quantile_cube', count(*), count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'z_scores', count(*), count(DISTINCT (o_orderstatus, o_orderkey % 4)) FROM orders UNION ALL SELECT 'diagnostics', count(*), count(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'exclusions', count(*), count(DISTINCT c_custkey) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'run_manifest', count(*), count(DISTINCT (o_orderpriority, o_orderkey)) FROM orders"""
)
def stored_tables(spark, sf_dir):
    """Every kind is written twice by the same run and read back: nothing doubles."""
    out = []
    with scratch(spark) as s:
        for kind, rows in stored(spark, sf_dir).items():
            path = s.folder(kind)
            tables.upsert(rows, kind, path, "run-1")
            tables.upsert(rows, kind, path, "run-1")
            keys = F.struct(*tables.KEYS[kind])
            out.append(tables.latest(spark, kind, path).agg(F.count("*").alias("n"), F.count_distinct(keys).alias("n_keys")).select(F.lit(kind).alias("kind"), "n", "n_keys"))
        return s.saved(reduce(lambda a, b: a.unionByName(b), out), "stored", lasts=True)


@query(
    "SELECT subject, band, region, value FROM (SELECT l_orderkey::VARCHAR AS subject, l_returnflag AS band, l_linenumber::VARCHAR AS region, (CASE WHEN l_orderkey % 3 = 0 THEN -l_quantity ELSE l_quantity END)::DOUBLE AS value, l_orderkey FROM lineitem) WHERE l_orderkey % 7 <> 0 OR l_orderkey % 3 = 0"
)
def features_written_again(spark, sf_dir):
    """A second run covers a third of the subjects, a third one finds nothing for a seventh of the others."""
    rows = stored(spark, sf_dir)["features"]
    number = F.col("subject").cast("long")
    with scratch(spark) as s:
        path = s.folder("features")
        files.write_features(rows, path, "first")
        gone = rows.filter((number % 7 == 0) & (number % 3 != 0)).select("subject").distinct()
        files.write_features(rows.limit(0), path, "empty", gone)
        files.write_features(rows.filter(number % 3 == 0).withColumn("value", -F.col("value")), path, "second")
        return s.saved(tables.latest(spark, "features", path).select("subject", "band", "region", "value"), "features", lasts=True)
