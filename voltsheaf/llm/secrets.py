"""Secret scans with a randomness test battery, in DataFrame functions throughout.

Base patterns (assignments, access keys, long hex runs) are matched leftmost and non-overlapping,
each kind on its own.  The battery adds spans for other tokens: runs of 20 and more characters that
hold a letter and a digit.  The encoding of a token is inferred from its characters, and its symbol
codes are put to three tests: chi-squared for a uniform alphabet, the number of runs above and
below the middle code, and lag-one serial correlation.  A token is a secret if

* no test rejects randomness (each at RANDOM_P / 3), and
* under the null "written by a person" the token's p-value is small enough: Benjamini-Hochberg at FDR
  within each class of length (powers of two), over all tokens of the corpus, from a histogram of
  log p-values.  That p-value combines chi-squared, which grows with the length as text repeats its
  letters, and the runs of capitals, small letters and digits, which are long in words and names.

Time grows a little faster than the matches of a text (power 1.5): running positions are made block by block.

Null text counts as empty.  Spans are code points, the end exclusive.  Repeated rows, ties and
extra columns need no rule: rows are judged one by one, against thresholds for the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: A token may begin after "=", as in query strings and environment files; "=" belongs to it only as padding.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: How often two letters of written text agree, which makes its chi-squared grow with its length; in
#: text of the letters a to f and digits two symbols agree more often.
TEXT_MATCH, HEX_MATCH = 0.066, 0.113
#: Encodings tried in turn: name, what the whole token looks like, its alphabet in order of code,
#: and how often two symbols of written text in that alphabet agree.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6], HEX_MATCH),
    ("HEX", "^[0-9A-F]+$", DIGITS + LOWER[:6].upper(), HEX_MATCH),
    ("base32", "^[A-Z2-7]+$", LOWER.upper() + DIGITS[2:8], TEXT_MATCH),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER, TEXT_MATCH),
    ("base62", "^[0-9A-Za-z]+$", LOWER.upper() + LOWER + DIGITS, TEXT_MATCH),
    ("base64", "^[0-9A-Za-z+/]+$", LOWER.upper() + LOWER + DIGITS + "+/", TEXT_MATCH),
    ("base64url", "^[0-9A-Za-z_-]+$", LOWER.upper() + LOWER + DIGITS + "-_", TEXT_MATCH),
    ("mixed", "", LOWER.upper() + LOWER + DIGITS + "+/-_", TEXT_MATCH),
)
RANDOM_P, FDR = 0.003, 0.05
#: How often neighbours of written text differ in kind (capital, small letter, digit): names of both cases, of one, and hex words.
MIXED_CHANGE, PLAIN_CHANGE, HEX_CHANGE = 0.35, 0.12, 0.25
#: Deviation of the sum of the two scores under the null, which go together a little (correlation 0.3).
SUM_SD = 1.61
#: Elements of a block of a running aggregate.
RUN_BLOCK = 128
#: Bins of -ln p a unit, and the last bin.
FINE, LAST_BIN = 20, 2000


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable (Abramowitz and Stegun 26.2.17; error below 1e-7)."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    # fixed values: the published coefficients
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_blocks(items: Column, size: int) -> Column:
    """A non-empty array cut into arrays of at most size items."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, F.lit(size)))


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], row: Callable[[Column, Column], Column]) -> Column:
    """Array of row(carry, item), carry being what step has made of zero and the items before; null without items.

    Lists grow inside blocks alone, so no long list is copied again and again.
    """

    def whole(items: Column) -> Column:
        def list_of(carry: Column, out: Column) -> Column:
            return F.struct(carry.alias("carry"), out.alias("out"))

        def blocks(cut: Column) -> Column:
            after = F.aggregate(cut, list_of(zero, F.array(zero)), lambda acc, x: bound(F.aggregate(x, acc["carry"], step), lambda c: list_of(c, F.concat(acc["out"], F.array(c)))), lambda acc: acc["out"])

            def rows(block: Column, carry: Column) -> Column:
                first = F.slice(block, 1, 1)
                start = F.transform(first, lambda x: list_of(step(carry, x), F.array(row(carry, x))))
                return F.aggregate(F.slice(block, 2, F.lit(RUN_BLOCK)), F.element_at(start, 1), lambda acc, x: list_of(step(acc["carry"], x), F.concat(acc["out"], F.array(row(acc["carry"], x)))), lambda acc: acc["out"])

            return bound(after, lambda after: F.flatten(F.zip_with(cut, F.slice(after, F.lit(1), F.size(cut)), rows)))

        return bound(in_blocks(items, RUN_BLOCK), blocks)

    return bound(items, lambda x: F.when(F.size(x) > 0, whole(x)))


def located(text: Column, pattern: str, gate: str | None = None) -> Column:
    """Array of (start, stop, match) of all matches, from the matches and the text between them."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("gap"))
    found = F.filter(found, lambda x: x["match"].isNotNull())

    def row(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["match"])).alias("stop"), x["match"].alias("match"))

    spans = running(found, F.lit(0).cast("long"), lambda at, x: at + F.length(x["gap"]) + F.length(x["match"]), row)
    none = F.array().cast("array<struct<start:bigint,stop:bigint,match:string>>")
    return F.when(text.rlike(gate or pattern), F.coalesce(spans, none)).otherwise(none)


def base_spans(text: Column, kind: str) -> Column:
    if kind == "assign":
        spans = located(text, ASSIGN, ASSIGN[:-1].removesuffix("+") + "{8,})")
        return F.filter(spans, lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8)
    return located(text, {"access": ACCESS, "hex": HEX}[kind])


def battery(token: Column) -> Column:
    """Struct of cls (length class), p_random (least of the three tests, two-sided) and p_text.

    Every value that several others use is bound first: a lambda computes what it names for each element.
    """
    bare = F.rtrim(token, F.lit("="))
    alphabet = reduce(lambda rest, e: F.when(bare.rlike(e[1]), F.lit(e[2])).otherwise(rest), reversed(ENCODINGS[:-1]), F.lit(ENCODINGS[-1][2]))

    def coded(x: Column) -> Column:
        """The symbols as codes from 1 to k, and what the kinds of characters tell."""
        codes = F.transform(F.regexp_extract_all(x["bare"], F.lit("."), F.lit(0)), lambda c: F.call_function("instr", x["alphabet"], c))
        # words between separators count as joined: their ends are no evidence
        plain = F.regexp_replace(x["bare"], "[+/_-]", "")
        kinds = F.size(F.regexp_extract_all(plain, F.lit("[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)))
        k = F.length(x["alphabet"]).cast("double")
        rate = F.when(k == 16, HEX_CHANGE).when(x["bare"].rlike("[a-z]") & x["bare"].rlike("[A-Z]"), MIXED_CHANGE).otherwise(PLAIN_CHANGE)
        return bound(F.struct(codes.alias("codes"), k.alias("k"), F.greatest(F.length(plain), F.lit(2)).alias("n_plain"), kinds.alias("kinds"), rate.alias("rate")), summed)

    def summed(x: Column) -> Column:
        codes, k = x["codes"], x["k"]
        n = F.size(codes).cast("double")
        high = F.size(F.filter(codes, lambda c: c * 2 > k)).cast("double")
        mean = F.aggregate(codes, F.lit(0.0), lambda s, c: s + c) / n
        # how often each symbol of the token stands in it
        squares = F.aggregate(F.transform(F.array_distinct(codes), lambda c: n - F.size(F.array_remove(codes, c))), F.lit(0.0), lambda s, c: s + c * c)
        held = F.struct(codes.alias("codes"), k.alias("k"), n.alias("n"), high.alias("high"), mean.alias("mean"), (squares * k / n - n).alias("chi"), x["n_plain"].alias("n_plain"), x["kinds"].alias("kinds"), x["rate"].alias("rate"))
        return bound(held, tested)

    def tested(x: Column) -> Column:
        codes, k, n, high, mean = (x[c] for c in ("codes", "k", "n", "high", "mean"))
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(((a * 2 > k) != (b * 2 > k)).cast("int").alias("turn"), ((a - mean) * (b - mean)).alias("both")))
        sums = F.aggregate(pairs, F.struct(F.lit(1.0).alias("runs"), F.lit(0.0).alias("serial")), lambda s, p: F.struct((s["runs"] + p["turn"]).alias("runs"), (s["serial"] + p["both"]).alias("serial")))
        power = F.aggregate(codes, F.lit(0.0), lambda s, c: s + (c - mean) * (c - mean))
        mu = 2.0 * high * (n - high) / n + 1.0
        var = (mu - 1.0) * (mu - 2.0) / (n - 1.0)
        # the cube root of chi-squared over its degrees is near normal (Wilson and Hilferty)
        spread = 2.0 / (9.0 * (k - 1))
        z_chi = (F.pow(x["chi"] / (k - 1), F.lit(1 / 3)) - (1.0 - spread)) / F.sqrt(spread)

        def scored(y: Column) -> Column:
            z_runs = F.when(y["var"] > 0, (y["s"]["runs"] - y["mu"]) / F.sqrt(y["var"])).otherwise(F.lit(9.0))
            z_serial = F.when(y["power"] > 0, y["s"]["serial"] / y["power"] * F.sqrt(n)).otherwise(F.lit(9.0))
            # under "written text" chi-squared is non-central, by the length times the excess of agreements
            shift = n * (k * F.when(k == 16, HEX_MATCH).otherwise(TEXT_MATCH) - 1.0)
            z_text = (k - 1 + shift - x["chi"]) / F.sqrt(2.0 * (k - 1) + 4.0 * shift)
            rate, n_plain = x["rate"], x["n_plain"].cast("double") - 1.0
            z_kinds = (x["kinds"] - 1.0 - n_plain * rate) / F.sqrt(n_plain * rate * (1.0 - rate))
            z = F.struct(y["z_chi"].alias("chi"), F.abs(z_runs).alias("runs"), F.abs(z_serial).alias("serial"), ((z_text + z_kinds) / SUM_SD).alias("text"))
            return bound(z, lambda z: F.struct(F.floor(F.log2(n)).cast("int").alias("cls"), F.least(upper_tail(z["chi"]), 2.0 * upper_tail(z["runs"]), 2.0 * upper_tail(z["serial"])).alias("p_random"), upper_tail(z["text"]).alias("p_text")))

        return bound(F.struct(sums.alias("s"), power.alias("power"), mu.alias("mu"), var.alias("var"), z_chi.alias("z_chi")), scored)

    return bound(F.struct(bare.alias("bare"), alphabet.alias("alphabet")), coded)


def candidates(text: Column) -> Column:
    """Located tokens with their battery results: array of (start, stop, cls, p_random, p_text)."""

    def row(s: Column) -> Column:
        return bound(battery(s["match"]), lambda r: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), r["cls"].alias("cls"), r["p_random"].alias("p_random"), r["p_text"].alias("p_text")))

    return F.transform(located(text, TOKEN), row)


def bin_of(p: Column) -> Column:
    return F.least(F.floor(-F.ln(F.greatest(p, F.lit(1e-300))) * FINE), F.lit(LAST_BIN)).cast("int")


def thresholds(texts: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Least bin of -ln p that counts as a discovery, by length class: Benjamini-Hochberg.

    Tokens shuffle as counts of (class, bin), a table of bounded size; the few thresholds come back.
    """
    from pyspark.sql import Window

    tokens = texts.select(F.explode(candidates(F.col("text"))).alias("t")).select("t.cls", bin_of(F.col("t.p_text")).alias("bin"))
    counts = tokens.groupBy("cls", "bin").count()
    falling = Window.partitionBy("cls").orderBy(F.desc("bin"))
    ranked = counts.select("cls", "bin", F.sum("count").over(falling).alias("rank"), F.sum("count").over(Window.partitionBy("cls")).alias("m"))
    # the weakest p of a bin stands for all of it
    passed = ranked.filter(F.exp(-F.col("bin") / F.lit(float(FINE))) <= F.lit(fdr) * F.col("rank") / F.col("m"))
    return {r.cls: r.least for r in passed.groupBy("cls").agg(F.min("bin").alias("least")).collect()}


def all_spans(text: Column, least: dict[int, int], random_p: float = RANDOM_P) -> Column:
    """Base spans and those the battery adds beside them, by start, then kind: (start, rank, stop)."""

    def plain(kind: str) -> Column:
        return F.transform(base_spans(text, kind), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["stop"].alias("stop")))

    base = F.concat(*[plain(k) for k in KINDS[:3]])
    if not least:
        return F.array_sort(base)
    limit = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    good = F.filter(candidates(text), lambda c: (c["p_random"] >= random_p / 3) & F.coalesce(bin_of(c["p_text"]) >= limit[c["cls"]], F.lit(False)))

    def beside(held: Column) -> Column:
        both = F.array_sort(F.concat(held, F.transform(good, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["stop"].alias("stop")))))

        def apart(both: Column) -> Column:
            # a token is dropped if a base span before it reaches into it, or one after it begins inside
            reach = running(both, F.lit(0).cast("long"), lambda at, s: F.when(s["rank"] < 3, F.greatest(at, s["stop"])).otherwise(at), lambda at, s: F.struct(s.alias("s"), (at > s["start"]).alias("hit")))
            ahead = running(F.reverse(reach), F.lit(2**62), lambda at, r: F.when(r["s"]["rank"] < 3, r["s"]["start"]).otherwise(at), lambda at, r: F.struct(r["s"].alias("s"), (r["hit"] | (at < r["s"]["stop"])).alias("hit")))
            return F.transform(F.filter(F.reverse(ahead), lambda r: (r["s"]["rank"] < 3) | ~r["hit"]), lambda r: r["s"])

        return bound(both, lambda b: F.when(F.exists(b, lambda s: s["rank"] == 3), apart(b)).otherwise(b))

    return bound(base, beside)


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row per document.

    Two narrow passes over the texts: one for the thresholds, one for the spans.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    least = thresholds(texts)
    found = texts.select("doc_id", all_spans(F.col("text"), least).alias("found"))

    def count(rank: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(digest(F.filter("found", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        digest(F.col("found")).alias("spans"),
        count(3).alias("n_random"),
    )


def kept(text: Column, spans: Column) -> Column:
    """Array of (start, stop) of what a text holds between its spans; spans that overlap count as one."""
    zero = F.lit(0).cast("long")
    gaps = running(spans, zero, lambda at, s: F.greatest(at, s["stop"]), lambda at, s: F.struct(at.alias("start"), s["start"].alias("stop")))
    tail = F.struct(F.array_max(F.transform(spans, lambda s: s["stop"])).alias("start"), F.length(text).cast("long").alias("stop"))
    return F.concat(F.filter(gaps, lambda g: g["stop"] >= g["start"]), F.array(tail))


def pieces(text: Column, base: Column, spans: Column, size: int = RUN_BLOCK**2) -> Column:
    """The texts of ordered spans, of a text that begins at base.

    A substring is sought from the start of its text, so a text is cut into blocks of spans first, and these again.
    """

    def part(start: Column, stop: Column) -> Column:
        return F.substring(text, (start - base).cast("int") + 1, (stop - start).cast("int"))

    if size == 1:
        return F.transform(spans, lambda s: part(s["start"], s["stop"]))

    def block(spans: Column) -> Column:
        first = F.element_at(spans, 1)["start"]
        cut = F.struct(first.alias("base"), part(first, F.element_at(spans, -1)["stop"]).alias("text"))
        return bound(cut, lambda c: pieces(c["text"], c["base"], spans, size // RUN_BLOCK))

    return F.flatten(F.transform(in_blocks(spans, size), block))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of its texts replaced by a mark (overlapping spans by one); null stays null."""
    least = thresholds(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    spans = all_spans(F.coalesce("text", F.lit("")), least)
    held = docs.withColumn("__spans", spans)
    done = F.array_join(bound(kept(F.col("text"), F.col("__spans")), lambda k: pieces(F.col("text"), F.lit(0).cast("long"), k)), mark)
    text = F.when(F.size("__spans") > 0, done).otherwise(F.col("text"))
    out = held.withColumn("text", text).drop("__spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
