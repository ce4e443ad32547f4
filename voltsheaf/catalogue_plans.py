"""More registered queries: kernels over segments, the feature driver, norms and sources, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltsheaf.catalogue import psd, query, rounded, table
from voltsheaf.config import FEATURE_CATEGORIES, OFFSETS, RATIO_PAIRS, RunConfig
from voltsheaf.operators import cohort, normative, normdata, qc, spectral, stats
from voltsheaf.plans import charts, extraction
from voltsheaf.plans import kernels as K
from voltsheaf.plans import norms
from voltsheaf.sources import files
from voltsheaf.sources import text as logs

# spectra of segments: the closed form of the Fourier sums, over segments of two seconds at 24 Hz

SEGMENTS = """s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS v FROM events WHERE value IS NOT NULL),
c AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), g AS (SELECT user_id, n, unnest(range(0, greatest((n - 48) // 24, 0) + 1)) AS k, least(n, 48) AS m FROM c WHERE n >= 4),
x AS (SELECT g.user_id, k, m, i - 24 * k AS j, v - avg(v) OVER (PARTITION BY g.user_id, k) AS v FROM g JOIN s ON s.user_id = g.user_id AND i >= 24 * k AND i < 24 * k + m),
f AS (SELECT DISTINCT m, unnest(range(0, m // 2 + 1)) AS f FROM g)"""


def exploded(df):
    return df.select("subject", F.posexplode(F.arrays_zip("freqs", "power")).alias("i", "p")).select("subject", F.round("p.freqs", 6).alias("freq"), F.round("p.power", 4).alias("power"))


@query(
    f"""WITH {SEGMENTS}, t AS (SELECT *, 0.54 - 0.46 * cos(2 * pi() * j / (m - 1)) AS w FROM x),
p AS (SELECT user_id, k, t.m, f, (power(sum(v * w * cos(2 * pi() * f * j / t.m)), 2) + power(sum(v * w * sin(2 * pi() * f * j / t.m)), 2)) / (24 * sum(w * w)) * CASE WHEN f = 0 OR 2 * f = t.m THEN 1 ELSE 2 END AS power FROM t JOIN f ON f.m = t.m GROUP BY 1, 2, 3, 4)
SELECT user_id::VARCHAR AS subject, round(f * 24.0::DOUBLE / m, 6) AS freq, round(avg(power), 4) AS power FROM p GROUP BY user_id, f, m"""
)
def welch_psd(spark, sf_dir):
    return exploded(K.welch(K.event_series(spark, sf_dir), sfreq=24.0, segment=2.0, overlap=1.0))


@query(
    f"""WITH {SEGMENTS}, q(q) AS (VALUES (1), (2), (3)), t AS (SELECT x.*, q, sqrt(2.0::DOUBLE / (m + 1)) * sin(pi() * q * (j + 1) / (m + 1)) AS w FROM x, q),
p AS (SELECT user_id, k, t.m, f, q, (power(sum(v * w * cos(2 * pi() * f * j / t.m)), 2) + power(sum(v * w * sin(2 * pi() * f * j / t.m)), 2)) / 24 * CASE WHEN f = 0 OR 2 * f = t.m THEN 1 ELSE 2 END AS power FROM t JOIN f ON f.m = t.m GROUP BY 1, 2, 3, 4, 5)
SELECT user_id::VARCHAR AS subject, round(f * 24.0::DOUBLE / m, 6) AS freq, round(avg(power), 4) AS power FROM p GROUP BY user_id, f, m"""
)
def multitaper_psd(spark, sf_dir):
    return exploded(K.multitaper(K.event_series(spark, sf_dir), sfreq=24.0, segment=2.0, overlap=1.0, tapers=3))


# the normal quantile, of the same published coefficients, for queries that need it in SQL


def poly_sql(x: str, coefficients: tuple) -> str:
    out = repr(float(coefficients[-1]))
    for c in coefficients[-2::-1]:
        out = f"({out} * {x} + {float(c)!r})"
    return out


def quantile_sql(p: str) -> str:
    q, s = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1 - {p})))"
    r = f"(0.180625::DOUBLE - {q} * {q})"
    inner = f"{q} * {poly_sql(r, stats.CENTRE[0])} / {poly_sql(r, stats.CENTRE[1])}"
    tail = f"CASE WHEN {s} <= 5 THEN {poly_sql(f'({s} - 1.6)', stats.MIDDLE[0])} / {poly_sql(f'({s} - 1.6)', stats.MIDDLE[1])} ELSE {poly_sql(f'({s} - 5)', stats.OUTER[0])} / {poly_sql(f'({s} - 5)', stats.OUTER[1])} END"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {inner} ELSE sign({q}) * ({tail}) END"


@query(f"WITH o AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) / (count(*) OVER (PARTITION BY p_brand) + 1)::DOUBLE AS position, p_retailprice FROM part) SELECT p_brand, p_retailprice, round(position, 6) + 0 AS position, round({quantile_sql('position')}, 6) + 0 AS normal FROM o")
def qq_normal(spark, sf_dir):
    points = stats.quantile_points(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"])
    return rounded(stats.with_normal_quantile(points), "position", "normal")


@query(
    f"""WITH r AS (SELECT p_brand, floor((p_size - min(p_size) OVER w) / nullif(max(p_size) OVER w - min(p_size) OVER w, 0)::DOUBLE * 10) AS bin, p_retailprice AS z FROM part WINDOW w AS (PARTITION BY p_brand)),
o AS (SELECT p_brand, bin, z, row_number() OVER (PARTITION BY p_brand, bin ORDER BY z)::DOUBLE AS i, count(*) OVER (PARTITION BY p_brand, bin)::DOUBLE AS n FROM r WHERE bin BETWEEN 0 AND 9), q AS (SELECT *, (i - 0.375) / (n + 0.25) AS pos FROM o), m AS (SELECT *, {quantile_sql('pos')} AS m FROM q),
g AS (SELECT p_brand, bin, max(n) AS n, sum(m * m) AS ss, sum(m * z) AS mz, var_pop(z) AS v, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2, max(z) AS hi, min(z) AS lo, max(z) FILTER (i = n - 1) AS hi2, max(z) FILTER (i = 2) AS lo2 FROM m GROUP BY 1, 2),
a AS (SELECT *, 1 / sqrt(n) AS u FROM g), b AS (SELECT *, m1 / sqrt(ss) + u * (0.221157 + u * (-0.147981 + u * (-2.071190 + u * (4.434685 - 2.706056 * u)))) AS l1, m2 / sqrt(ss) + u * (0.042981 + u * (-0.293762 + u * (-1.752461 + u * (5.682633 - 3.582633 * u)))) AS l2 FROM a),
t AS (SELECT p_brand, n, v, hi, lo, CASE WHEN n = 3 THEN sqrt(0.5) * (hi - lo) WHEN n > 5 THEN l1 * (hi - lo) + l2 * (hi2 - lo2) + (mz - m1 * (hi - lo) - m2 * (hi2 - lo2)) / sqrt((ss - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * l1 * l1 - 2 * l2 * l2)) WHEN n > 3 THEN l1 * (hi - lo) + (mz - m1 * (hi - lo)) / sqrt((ss - 2 * m1 * m1) / (1 - 2 * l1 * l1)) END AS t FROM b)
SELECT p_brand AS response, round(avg(CASE WHEN n >= 3 AND hi > lo THEN t * t / (n * v) END), 6) + 0 AS w, count(CASE WHEN n >= 3 AND hi > lo THEN 1 END) AS n_bins FROM t GROUP BY 1"""
)
def shapiro_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("response"), F.col("p_size").cast("double").alias("covariate"), F.col("p_retailprice").alias("z"))
    return rounded(K.shapiro_by_bins(rows, "response", "covariate", "z", 10), "w")


@query(
    """WITH h AS (SELECT event_type, user_id % 4 AS c, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) AS i, value - avg(value) OVER (PARTITION BY event_type, user_id % 4) AS v, count(*) OVER (PARTITION BY event_type, user_id % 4) AS n FROM events),
r AS (SELECT a.event_type, a.c, b.i - a.i AS k, max(a.n) AS n, sum(a.v * b.v) AS s FROM h a JOIN h b ON a.event_type = b.event_type AND a.c = b.c AND b.i >= a.i GROUP BY 1, 2, 3),
z AS (SELECT event_type, c, max(n) AS n, max(s) FILTER (k = 0) AS s0, min(k) FILTER (s <= 0) AS stop FROM r GROUP BY 1, 2),
t AS (SELECT z.event_type, z.c, z.n, coalesce(sum(s / nullif(s0, 0)) FILTER (k > 0 AND (stop IS NULL OR k < stop)), 0) AS total FROM z JOIN r ON r.event_type = z.event_type AND r.c = z.c GROUP BY 1, 2, 3)
SELECT event_type, round(sum(n / (1 + 2 * total)), 4) + 0 AS ess FROM t GROUP BY 1"""
)
def effective_draws(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("chain", F.col("user_id") % 4)
    return rounded(stats.effective_size(rows, ["event_type"], "chain", "event_id", "value"), "ess", digits=4)


@query()
def convergence_table(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("chain", F.col("user_id") % 4)
    return rounded(stats.convergence(rows, ["event_type"], "chain", "event_id", "value"), "r_hat", "ess_bulk", "ess_tail", "mcse_sd", digits=4)


# the feature driver

ALL_ON = RunConfig(features=dict.fromkeys(FEATURE_CATEGORIES, True))
SHAPES = ", ".join(f"('{b}', {lo}, {hi}, {OFFSETS[b][0]}, {OFFSETS[b][1]})" for b, (lo, hi) in ALL_ON.bands.items())
PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in RATIO_PAIRS)
CUT = "coalesce(list_sum(list_transform(range({lo}, {hi}), lambda i: (v[i] + v[i + 1]) / 2)), 0)"
DRIVER = f"""WITH b(band, lo, hi, dn, up) AS (VALUES {SHAPES}), pairs(n, d) AS (VALUES {PAIRS}), m AS (SELECT vec_id, label % 4 AS s, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS p, 0.5 + vec_id % 10 / 10.0::DOUBLE AS r2, 3 + vec_id % 35 AS cf, 0.5::DOUBLE + vec_id % 3 AS pw FROM embeddings),
k AS (SELECT * FROM m WHERE r2 >= 0.9), sp AS (SELECT vec_id, s, cf, pw, 'OriginalPSD' AS kind, p AS v FROM k UNION ALL SELECT vec_id, s, cf, pw, 'Adjusted', list_transform(p, lambda x: greatest(0, x - 0.05::DOUBLE)) FROM k),
ar AS (SELECT *, cf BETWEEN lo AND hi AS has, {CUT.format(lo='lo', hi='hi')} AS a, {CUT.format(lo='3', hi='40')} AS total, {CUT.format(lo='greatest(cf + dn, 1)', hi='least(cf + up, 64)')} AS ind FROM sp, b),
l AS (SELECT vec_id, s, 'Offset' AS feature, '' AS band, log10(0.05::DOUBLE) AS value FROM k UNION ALL SELECT vec_id, s, 'Exponent', '', 0 FROM k
UNION ALL SELECT vec_id, s, 'Peak_Center', band, cf::DOUBLE FROM k, b WHERE cf BETWEEN lo AND hi UNION ALL SELECT vec_id, s, 'Peak_Power', band, pw FROM k, b WHERE cf BETWEEN lo AND hi UNION ALL SELECT vec_id, s, 'Peak_Width', band, 2 FROM k, b WHERE cf BETWEEN lo AND hi
UNION ALL SELECT vec_id, s, kind || '_Canonical_Absolute_Power', band, CASE WHEN a > 0 THEN log10(a) END FROM ar UNION ALL SELECT vec_id, s, kind || '_Canonical_Relative_Power', band, a / nullif(total, 0) FROM ar
UNION ALL SELECT vec_id, s, kind || '_Individualized_Absolute_Power', band, CASE WHEN ind > 0 THEN log10(ind) END FROM ar WHERE has UNION ALL SELECT vec_id, s, kind || '_Individualized_Relative_Power', band, ind / nullif(total, 0) FROM ar WHERE has
UNION ALL SELECT x.vec_id, x.s, x.kind || '_Band_Ratio', n || '_over_' || d, CASE WHEN x.a / nullif(y.a, 0) > 0 THEN log10(x.a / nullif(y.a, 0)) END FROM ar x JOIN ar y ON x.vec_id = y.vec_id AND x.kind = y.kind JOIN pairs ON n = x.band AND d = y.band),
pm AS (SELECT s, feature, band, CASE WHEN vec_id % 2 = 0 THEN 'lobe_lh_a' ELSE 'lobe_rh_a' END AS channel, avg(value) AS value FROM l WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4),
al AS (SELECT * FROM pm UNION ALL SELECT s, feature, band, 'lobe_lh_vs_rh_a', x.value - y.value FROM pm x JOIN pm y USING (s, feature, band) WHERE x.channel = 'lobe_lh_a' AND y.channel = 'lobe_rh_a')"""


@query(
    """WITH p AS (SELECT label::VARCHAR AS subject, vec_id::VARCHAR AS channel, unnest(range(1, len(embedding) + 1)) AS f, unnest(embedding) AS v FROM embeddings),
l AS (SELECT subject, channel, log10(f::DOUBLE) AS x, log10(abs(v::DOUBLE)) AS y FROM p WHERE v <> 0)
SELECT subject, channel, round(regr_intercept(y, x), 6) + 0 AS "offset", NULL::DOUBLE AS knee, round(-regr_slope(y, x), 6) + 0 AS exponent, round(regr_r2(y, x), 6) + 0 AS r2 FROM l GROUP BY 1, 2"""
)
def aperiodic_fits(spark, sf_dir):
    spectra = psd(spark, sf_dir).select(F.col("label").cast("string").alias("subject"), F.col("vec_id").cast("string").alias("channel"), "freqs", F.col("power").alias("aperiodic"))
    return rounded(K.aperiodic_models(spectra).select("subject", "channel", "offset", "knee", "exponent", "r2"), "offset", "exponent", "r2")


def run_settings(**changes):
    """Settings for the events as samples at 100 Hz: half-second spectra, two-second epochs."""
    return RunConfig(features=dict.fromkeys(FEATURE_CATEGORIES, True), which_layout=None, psd_segment=0.5, psd_overlap=0.25, segments_length=2.0, segments_overlap=0.5, hset=(1.1, 1.55, 0.1), least_r2=0.3, **changes)


@query()
def decomposed_models(spark, sf_dir):
    samples, found = K.event_series(spark, sf_dir), []
    for method, mode in (("fooof", "knee"), ("irasa", "fixed")):
        settings = run_settings(parameterization=method, aperiodic_mode=mode)
        models = extraction.decomposed(samples, settings, 100.0)[1]
        found.append(spectral.fits_by_band(models, settings.bands).withColumn("method", F.lit(method)))
    return found[0].unionByName(found[1])


@query()
def extracted_features(spark, sf_dir):
    return rounded(extraction.extracted(K.event_series(spark, sf_dir), run_settings(parameterization="fooof", aperiodic_mode="fixed"), 100.0), "value")


@query(f"{DRIVER} SELECT s::VARCHAR AS subject, channel, feature, band, round(value, 6) + 0 AS value FROM al")
def feature_driver(spark, sf_dir):
    spectra = psd(spark, sf_dir).select((F.col("label") % 4).cast("string").alias("subject"), F.col("vec_id").alias("channel"), "freqs", "power")
    n = F.col("channel")
    peak = F.struct((3 + n % 35).cast("double").alias("cf"), (0.5 + n % 3).cast("double").alias("pw"), F.lit(2.0).alias("bw"))
    flat = F.log10(F.lit(0.05))
    models = spectra.select("subject", "channel", flat.alias("offset"), F.lit(0.0).alias("exponent"), (0.5 + n % 10 / 10.0).alias("r2"), F.transform("freqs", lambda f: flat).alias("ap"), F.array(peak).alias("peaks"))
    layout = spectra.select("channel", F.when(n % 2 == 0, "lobe_lh_a").otherwise("lobe_rh_a").alias("parcel"))
    return rounded(spectral.features(spectra, models, ALL_ON, layout), "value")


@query(
    f"""WITH psd AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS p FROM embeddings), b(band, lo, hi, dn, up) AS (VALUES {SHAPES}), k AS (SELECT vec_id, band, p AS v, dn, up, lo - 1 + list_position(p[lo:hi], list_max(p[lo:hi])) AS peak FROM psd, b)
SELECT vec_id, band, round({CUT.format(lo='greatest(peak + dn, 1)', hi='least(peak + up, 64)')} / nullif({CUT.format(lo='3', hi='40')}, 0), 6) + 0 AS rel_power FROM k"""
)
def individual_rel_power(spark, sf_dir):
    return rounded(spectral.individual_powers(psd(spark, sf_dir), keys=("vec_id",)).select("vec_id", "band", "rel_power"), "rel_power")


@query("SELECT vec_id, round(0.5 + vec_id % 10 / 10.0, 6) + 0 AS r2, 0.5 + vec_id % 10 / 10.0 >= 0.9 AS good FROM embeddings")
def r2_gate(spark, sf_dir):
    models = table(spark, sf_dir, "embeddings").select("vec_id", (0.5 + F.col("vec_id") % 10 / 10.0).alias("r2"))
    good, poor = spectral.well_fitted(models), spectral.poorly_fitted(models)
    return rounded(good.withColumn("good", F.lit(True)).unionByName(poor.withColumn("good", F.lit(False))), "r2")


# norms

WITHIN = """d AS (SELECT l_returnflag AS site, l_quantity AS x, l_extendedprice AS y FROM lineitem), g AS (SELECT site, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM d GROUP BY 1), c AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS slope FROM d JOIN g USING (site)),
a AS (SELECT site, my - slope * mx AS intercept FROM g, c), e AS (SELECT sqrt(sum((y - intercept - slope * x) * (y - intercept - slope * x)) / (count(*) - 4)) AS sigma FROM d JOIN a USING (site), c)"""
SITES = {"site": ["A", "N", "R"]}


def site_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("site"), F.col("l_quantity").alias("age"), F.lit("price").alias("response"), F.col("l_extendedprice").alias("y"))


@query(f"WITH {WITHIN} SELECT 'price' AS response, round(max(intercept) FILTER (site = 'A'), 2) + 0 AS base, round(max(slope), 3) + 0 AS slope, round(max(intercept) FILTER (site = 'N') - max(intercept) FILTER (site = 'A'), 2) + 0 AS site_n, round(max(intercept) FILTER (site = 'R') - max(intercept) FILTER (site = 'A'), 2) + 0 AS site_r, round(max(sigma), 2) + 0 AS sigma FROM a, c, e")
def norm_fit(spark, sf_dir):
    models = normative.fit_norms(site_rows(spark, sf_dir), "age", SITES, degree=1, ridge=0.0)
    b = F.col("beta")
    out = normative.model_table(spark, models).select("response", b[0].alias("base"), b[1].alias("slope"), b[2].alias("site_n"), b[3].alias("site_r"), "sigma")
    return rounded(rounded(out, "base", "site_n", "site_r", "sigma", digits=2), "slope", digits=3)


@query(
    f"""WITH {WITHIN}, z(quantile, zq) AS (VALUES (0.05::DOUBLE, -1.6448536269514726::DOUBLE), (0.25::DOUBLE, -0.6744897501960818::DOUBLE), (0.5::DOUBLE, 0::DOUBLE), (0.75::DOUBLE, 0.6744897501960818::DOUBLE), (0.95::DOUBLE, 1.6448536269514715::DOUBLE))
SELECT 'price' AS response, site, age::INTEGER AS age, quantile, round(intercept + slope * age + sigma * zq, 1) + 0 AS value FROM a, c, e, z, generate_series(1, 46, 5) s(age)"""
)
def centile_cube(spark, sf_dir):
    rows = site_rows(spark, sf_dir)
    models = normative.model_table(spark, normative.fit_norms(rows, "age", SITES, degree=1, ridge=0.0))
    grid = cohort.level_grid(rows, ["site"], 1, 46, 5).withColumn("response", F.lit("price"))
    out = normative.centiles(normative.predicted(grid, models, "age", SITES, degree=1))
    return rounded(out.select("response", "site", F.col("age").cast("int").alias("age"), "quantile", "value"), "value", digits=1)


@query("SELECT c_custkey, c_mktsegment, c_nationkey, response, y FROM (SELECT c_custkey, c_mktsegment, c_nationkey, unnest(['bal', 'key']) AS response, unnest([c_acctbal, c_custkey::DOUBLE]) AS y FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 10 <> 0)")
def complete_norm_data(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("bal"), F.col("c_custkey").cast("double").alias("key"))
    out = norms.prepared(c, "c_custkey", ["bal", "key"], "c_nationkey", ["c_mktsegment"], ("c_mktsegment", ["BUILDING", "MACHINERY"]), impute=False)
    return out.drop("split")


@query("SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM customer) WHERE c_acctbal IS NOT NULL")
def complete_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(F.lit(float("nan"))).alias("c_acctbal"))
    return normdata.complete_rows(c, ["c_acctbal"])


@query("SELECT c_custkey, unnest(['covariate', 'batch', 'response']) AS part, unnest([c_acctbal, 0, c_custkey]) AS value FROM customer")
def split_parts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("y", F.col("c_custkey").cast("double"))
    x, b, y = normdata.split_tables(c, "c_custkey", ["c_acctbal"], [], ["y"])
    parts = [x.select("c_custkey", F.lit("covariate").alias("part"), F.col("c_acctbal").alias("value")), b.select("c_custkey", F.lit("batch").alias("part"), F.col("batch").cast("double").alias("value")), y.select("c_custkey", F.lit("response").alias("part"), F.col("y").alias("value"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# cohort and quality


@query("SELECT c_custkey AS subject FROM customer WHERE c_acctbal > 9000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").withColumnRenamed("c_custkey", "subject")
    b = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").withColumnRenamed("o_custkey", "subject")
    return cohort.union_distinct([a, b], ["subject"])


@query("SELECT s_name AS subject FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 AND s_name NOT LIKE '%7'")
def discovered_subjects(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.when(F.col("s_suppkey") % 10 == 0, ".").otherwise("fsaverage"), "s_name")).otherwise(F.col("s_name"))
    dirs = s.filter("s_name not like '%7'").select(name.alias("subject"), (F.col("s_suppkey") % 3 == 0).alias("has_log"))
    return cohort.discovered(dirs, ["nobody"])


@query("SELECT p_partkey AS name, p_type AS type FROM part WHERE lower(p_type) IN ('economy', 'promo', 'standard') AND p_partkey NOT IN (1, 2, 3)")
def picked_sensors(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_type").alias("type"))
    return cohort.picked_channels(p, ["Economy", "PROMO", "standard"], [1, 2, 3])


@query("SELECT user_id, round(stddev_samp(value), 4) + 0 AS sd, CASE WHEN stddev_samp(value) < 25 THEN 'flat' WHEN stddev_samp(value) > 35 THEN 'noisy' ELSE 'good' END AS verdict FROM events GROUP BY 1")
def flat_or_noisy(spark, sf_dir):
    return rounded(qc.flat_or_noisy(table(spark, sf_dir, "events"), ["user_id"], "value", 25.0, 35.0), "sd", digits=4)


WINDOWED = """s AS (SELECT user_id % 3 AS s, event_type AS c, event_id // 500 AS w, value AS v FROM events WHERE value IS NOT NULL),
x AS (SELECT s, c, w, max(v) - min(v) AS span, stddev_samp(v) AS sd FROM s GROUP BY 1, 2, 3), m AS (SELECT *, sd - median(sd) OVER (PARTITION BY s, w) AS d FROM x), z AS (SELECT *, median(abs(d)) OVER (PARTITION BY s, w) AS mad FROM m),
k AS (SELECT s, c, count(*) AS n_windows, count(*) FILTER (mad > 0 AND d / (1.4826::DOUBLE * mad) > 2.5) AS n_noisy, count(*) FILTER (span < 40) AS n_flat FROM z GROUP BY 1, 2),
g AS (SELECT s::VARCHAR AS subject, c AS channel, n_windows, n_noisy, n_flat, CASE WHEN s = 0 AND c = 'view' THEN 'known' WHEN n_flat >= 2 THEN 'flat' WHEN n_noisy >= 2 THEN 'noisy' ELSE 'good' END AS verdict FROM k)"""


def windowed_verdicts(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("string").alias("subject"), F.col("event_type").alias("channel"), F.col("event_id").alias("t_idx"), "value")
    known = samples.select("subject", "channel").distinct().filter("subject = '0' AND channel = 'view'")
    return samples, qc.bad_channels(samples, 500, flat=40.0, limit=2.5, least=2, known=known)


@query(f"WITH {WINDOWED} SELECT * FROM g")
def bad_channels(spark, sf_dir):
    return windowed_verdicts(spark, sf_dir)[1]


@query(f"WITH {WINDOWED} SELECT subject, channel, count(*) AS n, round(sum(v), 4) + 0 AS total FROM s JOIN g ON g.subject = s.s::VARCHAR AND g.channel = s.c WHERE verdict = 'good' GROUP BY 1, 2")
def good_channel_samples(spark, sf_dir):
    samples, verdicts = windowed_verdicts(spark, sf_dir)
    kept = qc.without_bad_channels(samples, verdicts).filter("value IS NOT NULL")
    return rounded(kept.groupBy("subject", "channel").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


@query(
    """WITH c AS (SELECT l_returnflag, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) AS d FROM lineitem GROUP BY 1), e AS (SELECT l_returnflag, (a + d) / 2 AS m, sqrt((a - d) * (a - d) / 4 + b * b) AS r FROM c)
SELECT l_returnflag, 2 AS rank, round((m + r) / (m - r) / 1000, 3) + 0 AS condition_k FROM e"""
)
def covariance_spectrum(spark, sf_dir):
    cov = qc.covariances(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"])
    out = qc.covariance_spectrum(cov, ["l_returnflag"])
    return rounded(out.select("l_returnflag", "rank", (F.col("condition") / 1000).alias("condition_k")), "condition_k", digits=3)


# logs

LOG_LINES = ["ERROR: x", "an error in a word: terrors", "Segmentation fault", "killed", "Killedness", "Out of memory", "no space left on device ", "Bus error", "assertion a > b failed", "fine", "Aborted", "failed"]


@query(
    f"""WITH l AS (SELECT user_id, event_id, {LOG_LINES!r}[event_id % {len(LOG_LINES)} + 1] AS line FROM events),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM l WHERE regexp_matches(line, '(?i){"|".join(logs.ERROR_PATTERNS)}')) SELECT user_id, string_agg(trim(line), '|' ORDER BY event_id) AS hints FROM h WHERE n <= 10 GROUP BY 1"""
)
def error_hints(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("user_id", "event_id", F.element_at(F.array(*[F.lit(x) for x in LOG_LINES]), (F.col("event_id") % len(LOG_LINES) + 1).cast("int")).alias("line"))
    return logs.error_hints(lines, ["user_id"], "event_id").select("user_id", F.array_join("hints", "|").alias("hints"))


@query("SELECT p_brand, -p_size::DOUBLE AS lh_en, -(p_size + 1)::DOUBLE AS rh_en, -(p_size + 0.5)::DOUBLE AS avg_en FROM (SELECT p_brand, arg_max(p_size, p_partkey) AS p_size FROM part GROUP BY 1)")
def euler_numbers(spark, sf_dir):
    line = F.format_string("orig.nofix lheno =  -%d, rheno = -%d", F.col("p_size"), F.col("p_size") + 1)
    return logs.euler_numbers(table(spark, sf_dir, "part").select("p_brand", "p_partkey", line.alias("line")), ["p_brand"], "p_partkey")


@query("SELECT n_name AS name, n_nationkey AS id FROM nation WHERE n_nationkey % 4 <> 0")
def label_table(spark, sf_dir):
    n = F.col("n_nationkey")
    line = F.when(n % 8 == 0, "# a comment").when(n % 4 == 0, "  ").otherwise(F.format_string("%d  %s 1 2 3 0", n, F.col("n_name")))
    return logs.lookup_table(table(spark, sf_dir, "nation").select(line.alias("line")))


@query("SELECT DISTINCT 's' || user_id AS subject FROM events WHERE event_id % 2 = 0 AND event_id % 3 = 0")
def failed_subjects(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("/logs/s"), "user_id", F.lit("_run."), F.when(F.col("event_id") % 2 == 0, "err").otherwise("out")).alias("path"), F.when(F.col("event_id") % 3 == 0, "an error").otherwise("fine").alias("content"))
    return logs.subjects_with_errors(rows)


@query("SELECT device, layout, parcel, channel FROM (SELECT 'EEG' AS device, 'l' || s_nationkey AS layout, 'old' AS parcel, s_name AS channel FROM supplier WHERE s_nationkey % 2 = 1 AND s_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) UNION ALL SELECT 'EEG', 'l' || s_nationkey, 'new', s_name FROM supplier WHERE s_acctbal > 8000)")
def layout_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit("EEG").alias("device"), F.concat(F.lit("l"), "s_nationkey").alias("layout"), "s_name", "s_nationkey", "s_acctbal")
    side = lambda df, parcel: df.select("device", "layout", F.lit(parcel).alias("parcel"), F.col("s_name").alias("channel"))
    return files.saved_layouts(side(s.filter("s_nationkey % 2 = 1"), "old"), side(s.filter("s_acctbal > 8000"), "new"))


# charts


@query("WITH c AS (SELECT p_brand, p_size, avg(p_retailprice) AS value FROM part GROUP BY 1, 2) SELECT p_brand, p_size, 0.5::DOUBLE AS quantile, round(value, 4) + 0 AS value, round(avg(value) OVER (PARTITION BY p_size), 4) + 0 AS site_mean FROM c")
def site_differences(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("value")).withColumn("quantile", F.explode(F.array(F.lit(0.5), F.lit(0.95))))
    return rounded(charts.site_differences(c, ["p_size"], 0.5), "value", "site_mean", digits=4)


@query("SELECT n_name AS full_name, r_name AS region_name, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey::DOUBLE WHEN r_regionkey % 2 = 0 THEN 100.0 + r_regionkey END AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def brain_texture(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    vertices = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("full_name"), F.col("r_name").alias("region_name"))
    values = n.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("region"), F.col("n_nationkey").cast("double").alias("value")).unionByName(r.filter("r_regionkey % 2 = 0").select(F.col("r_name").alias("region"), (F.col("r_regionkey") + 100.0).alias("value")))
    return charts.brain_texture(vertices, values)[0].select("full_name", "region_name", "value")


@query("WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.05) AS low, quantile_cont(o_totalprice, 0.95) AS high, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1) SELECT o_orderpriority, round(low, 4) + 0 AS low, round(high, 4) + 0 AS high, value FROM q")
def range_markers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    centiles = normative.empirical_centiles(o, ["o_orderpriority"], "o_totalprice")
    seen = o.groupBy("o_orderpriority").agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))
    return rounded(charts.range_markers(centiles, seen, ["o_orderpriority"]), "low", "high", digits=4)
