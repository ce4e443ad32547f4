"""Group statistics and inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_sided_p(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal variable, to about 1e-12: a series near 0, a continued fraction beyond."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), lambda a, n: F.struct((-a["t"] * x * x / n).alias("t"), (a["s"] - a["t"] * x * x / n / (2 * n + 1)).alias("s")), lambda a: 1 - a["s"] * 1.1283791670955126)
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, n: n / 2.0 / (x + f))
    far = F.exp(-x * x) / (x + tail) * 0.5641895835477563
    return F.when(F.isnan(z), None).when(x < 2.5, near).otherwise(far)


# fixed values: the published coefficients of algorithm AS 241 (Wichura 1988), the constant first
CENTRE = ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727), (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610))
MIDDLE = ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4), (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
OUTER = ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7), (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def polynomial(x: Column, coefficients: tuple) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + c
    return out


def named(value: Column, use) -> Column:
    """use(value), with the value computed once: a polynomial names it many times, which generated code would repeat."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile, to about 1e-15; null outside (0, 1)."""

    def quotient(x: Column, table: tuple) -> Column:
        return named(x, lambda x: polynomial(x, table[0]) / polynomial(x, table[1]))

    def of(p: Column) -> Column:
        q = p - 0.5
        inner = q * quotient(0.180625 - q * q, CENTRE)
        tail = named(F.sqrt(-F.ln(F.least(p, 1 - p))), lambda s: F.when(s <= 5, quotient(s - 1.6, MIDDLE)).otherwise(quotient(s - 5, OUTER)))
        return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, inner).otherwise(F.signum(q) * tail))

    return named(p, of)


def sequence(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number (from 0) in the order of their group, ties in any order.

    Rows are sorted by ranges of (by, order); a range numbers its own, and what the group has in earlier
    ranges is added.  So a group may hold any share of the rows and no task sorts more than a range.
    """
    ranged = held(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__range", F.shiftright("__at", 33))
    parts = ranged.groupBy(*by, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = parts.select(*[F.col(c).alias(f"__r_{c}") for c in by], F.col("__range").alias("__r_range"), (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by], F.col("__range") == F.col("__r_range"))
    return ranged.join(parts, same).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias(name))


#: Ranges that a sort over all rows is cut into.
RANGES = 200


def meet(left: DataFrame, right: DataFrame, names: tuple) -> DataFrame:
    """An inner join on names, where NULL meets NULL; a table without names is one row."""
    if not names:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.withColumnsRenamed({n: f"__r_{n}" for n in names})
    same = reduce(lambda x, y: x & y, [left[n].eqNullSafe(other[f"__r_{n}"]) for n in names])
    return left.join(other, same).drop(*[f"__r_{n}" for n in names])


def before(rows: DataFrame, order: str, weight: Column, by: tuple = (), ranges: int = RANGES, key: tuple = ()) -> DataFrame:
    """rows with __range and __before, the sum of weight over all rows of smaller order (ties: by key) in their group.

    Rows are dealt to ranges of the order by approximate quantiles, which decide balance alone, and
    summed up within their range; sums of whole ranges, at most ``ranges`` a group, are added.  So no
    sort holds more than a range, even where all rows are one group.  Rows of equal order share a range:
    where values repeat, count them first.  The approximate quantiles are computed once, as another
    computation could give others.
    """
    cut = F.percentile_approx(order, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(1000)).alias("__cuts")
    if by:
        cuts = meet(rows, held(rows.groupBy(*by).agg(cut)), by)
    else:
        at = sorted(set(rows.agg(cut).first()[0] or []))  # fewer than ``ranges`` numbers
        cuts = rows.withColumn("__cuts", F.array(*[F.lit(x) for x in at]))
    keyed = cuts.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts").withColumn("__w", weight)
    sums = keyed.groupBy(*by, "__range").agg(F.sum("__w").alias("__sum"))
    earlier = Window.partitionBy(*(by or [F.lit(1)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    offsets = sums.select(*by, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    own = Window.partitionBy(*by, "__range").orderBy(order, *key).rowsBetween(Window.unboundedPreceding, -1)
    out = meet(keyed.withColumn("__own", F.coalesce(F.sum("__w").over(own), F.lit(0))), offsets, (*by, "__range"))
    return out.withColumn("__before", F.col("__own") + F.col("__offset")).drop("__w", "__own", "__offset")


def quantiles(df: DataFrame, value: str, at: dict[str, float], ranges: int = RANGES, by: tuple = ()) -> DataFrame:
    """The exact quantiles of a column, interpolated, over all rows or by group: a column for each name of at.

    An exact percentile aggregate gathers all distinct values of a group in one task.  Here equal values
    are counted first, so that a value of any number of rows is one row, every range of values is
    ranked on its own, and only the few rows of the wanted ranks go on.  Groups without values have no row.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("__v"))
    counts = rows.groupBy(*by, "__v").agg(F.count("*").alias("__k"))
    sizes = counts.groupBy(*by).agg(F.sum("__k").alias("__n"))
    ranked = meet(before(counts, "__v", F.col("__k"), by, ranges), sizes, by)
    place = {name: (F.col("__n") - 1) * F.lit(float(q)) for name, q in at.items()}

    def holds(rank: Column) -> Column:
        return (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__k"))

    picked = ranked.filter(reduce(lambda x, y: x | y, [holds(F.floor(h)) | holds(F.ceil(h)) for h in place.values()]))
    ends = [x for name, h in place.items() for x in (F.max(F.when(holds(F.floor(h)), F.col("__v"))).alias(f"__a_{name}"), F.max(F.when(holds(F.ceil(h)), F.col("__v"))).alias(f"__b_{name}"), F.max(h - F.floor(h)).alias(f"__f_{name}"))]
    found = picked.groupBy(*by).agg(*ends)
    found = found.select(*by, *[(F.col(f"__a_{n}") + F.col(f"__f_{n}") * (F.col(f"__b_{n}") - F.col(f"__a_{n}"))).alias(n) for n in at])
    if by:
        return found
    # one row, computed now: whatever uses it, and quantiles of that in turn, would compute it again
    return df.sparkSession.createDataFrame([found.first()], ", ".join(f"`{n}` double" for n in at))


def rank_sum(df: DataFrame, value: str, group: str, first, by: tuple = ()) -> DataFrame:
    """Rank-sum statistic of the first group against the others, with mid-ranks: by, n1, n2, r1, z.

    Values are first counted, and ranks come from the counts of distinct values, so that equal
    values are one row; a family of tests (by) is ranked in parallel.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.sum((F.col(group) == F.lit(first)).cast("long")).alias("n1"))
    ranked = before(counts, value, F.col("n"), by).withColumn("rank", F.col("__before") + (F.col("n") + 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n2"), F.sum(F.col("rank") * F.col("n1")).alias("r1"))
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")
    sd = F.sqrt(a * b * (a + b + 1) / 12)
    return out.withColumn("z", F.when(sd > 0, (F.col("r1") - a * (a + b + 1) / 2) / sd))


def false_discovery(df: DataFrame, p: str, key: str, ranges: int = RANGES) -> DataFrame:
    """df with p_adjusted (Benjamini-Hochberg step-up) over all rows with a p-value: a family of tests.

    Equal p-values have equal results and are one row while they are ranked.  Ranks are prefix counts over
    ranges of p, and the running minimum is taken within a range and then with the least value of the
    ranges above.  key is not needed any more and kept for callers.
    """
    tests = df.filter(F.col(p).isNotNull())
    n = tests.agg(F.count("*").alias("__m"))
    counts = tests.groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__k"))
    ranked = before(counts, "__p", F.col("__k"), (), ranges).crossJoin(F.broadcast(n))  # one row
    raw = ranked.withColumn("__raw", F.col("__p") * F.col("__m") / (F.col("__before") + F.col("__k")))  # the last of equal ones decides
    later = Window.partitionBy(F.lit(1)).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    above = raw.groupBy("__range").agg(F.min("__raw").alias("__least")).select("__range", F.min("__least").over(later).alias("__above"))
    own = Window.partitionBy("__range").orderBy(F.desc("__before")).rowsBetween(Window.unboundedPreceding, 0)
    out = raw.withColumn("__own", F.min("__raw").over(own)).join(F.broadcast(above), "__range").select("__p", F.least("__own", "__above", F.lit(1.0)).alias("p_adjusted"))
    return tests.join(out, F.col(p) == F.col("__p")).select(*df.columns, "p_adjusted")


def density(df: DataFrame, value: str, by: list[str], lo: float, hi: float, points: int, bandwidth: float) -> DataFrame:
    """Epanechnikov density on a grid.  A value is sent to the grid points within its bandwidth alone."""
    step = (hi - lo) / (points - 1)
    i0 = F.greatest(F.ceil((F.col(value) - bandwidth - lo) / step), F.lit(0)).cast("int")
    i1 = F.least(F.floor((F.col(value) + bandwidth - lo) / step), F.lit(points - 1)).cast("int")
    rows = df.filter(F.col(value).isNotNull())
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    near = rows.withColumn("__i0", i0).withColumn("__i1", i1).filter("__i0 <= __i1").withColumn("i", F.explode(F.sequence("__i0", "__i1")))
    u = (F.lit(lo) + F.col("i") * step - F.col(value)) / bandwidth
    sums = near.groupBy(*by, "i").agg(F.sum(F.greatest(F.lit(0.0), 0.75 * (1 - u * u))).alias("__s"))
    return sums.join(sizes, by).select(*by, "i", (F.lit(lo) + F.col("i") * step).alias("x"), (F.col("__s") / (F.col("__n") * bandwidth)).alias("density"))


def histogram(df: DataFrame, value: str, by: list[str], start: int, stop: int, step: int) -> DataFrame:
    """Counts in half-open bins, the last one closed; values outside are left out."""
    inside = df.filter((F.col(value) >= start) & (F.col(value) <= stop))
    lo = F.least(F.floor((F.col(value) - start) / step) * step + start, F.lit(stop - step)).cast("int")
    return inside.groupBy(*by, lo.alias("bin_lo")).agg(F.count("*").alias("n"))


#: Rows of one value that are numbered from one row of the counts.
PIECE_ROWS = 1 << 16


def ordered(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, value, __i (place in the ascending order of the group, from 1) and __n (the group's size), a row a row.

    Values are counted and the counts ranked by ranges, then each value is given its places again, in
    pieces that are dealt out anew: neither a group nor a value has to fit a task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__k"))
    sizes = counts.groupBy(*by).agg(F.sum("__k").alias("__n"))
    ranked = meet(before(counts, value, F.col("__k"), tuple(by)), sizes, tuple(by))
    end = F.col("__before") + F.col("__k")
    pieces = ranked.select(*by, value, "__n", end.alias("__end"), F.explode(F.sequence(F.col("__before") + 1, end, F.lit(PIECE_ROWS).cast("long"))).alias("__from"))
    places = F.sequence("__from", F.least(F.col("__from") + (PIECE_ROWS - 1), F.col("__end")))
    return pieces.repartition(*by, value, "__from").select(*by, value, F.explode(places).alias("__i"), "__n")


def quantile_points(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Order statistics with their plotting position i / (n + 1)."""
    return ordered(df, value, by).select(*by, value, (F.col("__i") / (F.col("__n") + 1)).alias("position"))


def split_r_hat(draws: DataFrame, by: list[str], chain: str, draw: str, value: str) -> DataFrame:
    """Split-chain R-hat: by, n_chains, r_hat; each chain is halved by its draws' order (draws are numbers)."""
    keys = (*by, chain)
    placed = meet(before(draws, draw, F.lit(1), keys), draws.groupBy(*keys).agg(F.count("*").alias("__n")), keys)
    half = placed.withColumn("__half", F.when((F.col("__before") + 1) * 2 <= F.col("__n"), 0).otherwise(1))
    per = half.groupBy(*by, chain, "__half").agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n"))
    out = per.groupBy(*by).agg(F.avg("v").alias("within"), F.var_samp("m").alias("between"), F.avg("n").alias("n"), F.count("*").alias("n_chains"))
    return out.select(*by, "n_chains", F.when(F.col("within") > 0, F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between")) / F.col("within"))).alias("r_hat"))


def melted_boxes(long: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles and extremes for box plots; a group without values has a row of nulls."""
    ends = long.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    q = quantiles(long, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=tuple(by)).withColumnsRenamed({c: f"__r_{c}" for c in by})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by])
    return ends.join(q, same, "left").select(*by, "low", "q1", "median", "q3", "high", "n")


def held(df: DataFrame) -> DataFrame:
    """df computed once: a checkpoint in the folder that spark.checkpoint.dir names, which also cuts the
    plan, or where none is named (a local session) in memory."""
    spark = df.sparkSession
    if place := spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(place)
        return df.checkpoint()
    return df.persist()


#: Lags of the first round of autocorrelations, and of a late one.
FIRST_LAGS, MOST_LAGS = 20, 160


def effective_size(draws: DataFrame, by: list[str], chain: str, draw: str, value: str) -> DataFrame:
    """Effective sample size from the autocorrelations up to the first that is not positive, summed
    over chains: by, ess.

    Lags are taken in rounds, each of twice as many up to MOST_LAGS, and after each only chains whose
    autocorrelation is still positive go on, so slowly mixing chains are followed as far as they need.
    """
    w = Window.partitionBy(*by, chain)
    o = w.orderBy(draw)
    rows = held(draws.filter(F.col(value).isNotNull()).select(*by, chain, draw, (F.col(value) - F.avg(value).over(w)).alias("__c")))
    chains = rows.groupBy(*by, chain).agg(F.sum(F.col("__c") * F.col("__c")).alias("__s0"), F.count("*").alias("__n"))
    ended, going, first, size = [], chains.withColumn("__sum", F.lit(0.0)), 1, FIRST_LAGS
    while True:
        lags = range(first, first + size)
        lagged = rows.join(going.select(*by, chain), [*by, chain], "left_semi").select(*by, chain, "__c", *[F.lag("__c", k).over(o).alias(f"__l{k}") for k in lags])
        products = lagged.groupBy(*by, chain).agg(F.array(*[F.sum(F.col("__c") * F.col(f"__l{k}")) for k in lags]).alias("__p"))
        rho = F.transform("__p", lambda x: F.coalesce(x / F.nullif(F.col("__s0"), F.lit(0.0)), F.lit(0.0)))
        start = F.struct(F.lit(0.0).alias("s"), F.lit(True).alias("on"))
        summed = F.aggregate(rho, start, lambda a, r: F.struct((a["s"] + F.when(a["on"] & (r > 0), r).otherwise(0.0)).alias("s"), (a["on"] & (r > 0)).alias("on")))
        step = going.join(products, [*by, chain]).withColumn("__a", summed).withColumn("__sum", F.col("__sum") + F.col("__a.s")).withColumn("__on", F.col("__a.on"))
        step = held(step.select(*by, chain, "__s0", "__n", "__sum", "__on"))  # a row a chain
        ended.append(step.filter(~F.col("__on")))
        going, first, size = step.filter("__on").drop("__on"), first + size, min(2 * size, MOST_LAGS)
        if going.isEmpty():
            break
    done = reduce(DataFrame.unionByName, ended)
    return done.withColumn("__t", F.col("__n") / (1 + 2 * F.col("__sum"))).groupBy(*by).agg(F.sum("__t").alias("ess"))


def rank_normalised(draws: DataFrame, by: list[str], value: str) -> DataFrame:
    """draws with z, the normal score of the mid-rank of each value among all draws of its parameter."""
    counts = draws.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__k"))
    sizes = counts.groupBy(*by).agg(F.sum("__k").alias("__n"))
    ranked = before(counts, value, F.col("__k"), tuple(by)).join(sizes, by)
    score = normal_quantile((F.col("__before") + (F.col("__k") + 1) / 2 - 0.375) / (F.col("__n") + 0.25))
    return draws.join(ranked.select(*by, value, score.alias("z")), [*by, value])


def convergence(draws: DataFrame, by: list[str], chain: str, draw: str, value: str) -> DataFrame:
    """by, r_hat, ess_bulk, ess_tail, mcse_sd of rank-normalised split chains (Vehtari et al. 2021).

    ess_bulk is that of the normal scores, ess_tail the lesser of those of the indicators of the 5 %
    and 95 % quantiles; mcse_sd is the deviation over the square root of twice the plain size.
    """
    scored = rank_normalised(draws, by, value)
    q = quantiles(draws, value, {"__q05": 0.05, "__q95": 0.95}, by=tuple(by)).join(draws.groupBy(*by).agg(F.stddev_samp(value).alias("__sd")), by)
    marked = scored.join(q, by).withColumn("__low", (F.col(value) <= F.col("__q05")).cast("double")).withColumn("__high", (F.col(value) <= F.col("__q95")).cast("double"))
    out = split_r_hat(scored, by, chain, draw, "z").select(*by, "r_hat")
    for column, name in (("z", "ess_bulk"), ("__low", "__ess_low"), ("__high", "__ess_high"), (value, "__ess")):
        out = out.join(effective_size(marked, by, chain, draw, column).withColumnRenamed("ess", name), by)
    out = out.join(q.select(*by, "__sd"), by)
    return out.select(*by, "r_hat", "ess_bulk", F.least("__ess_low", "__ess_high").alias("ess_tail"), (F.col("__sd") / F.sqrt(2 * F.col("__ess"))).alias("mcse_sd"))


def with_normal_quantile(points: DataFrame, position: str = "position") -> DataFrame:
    """Plotting positions with their normal quantile beside them, for QQ plots."""
    return points.withColumn("normal", normal_quantile(F.col(position)))
