"""Secret scans in DataFrame functions only: fixed patterns, and a randomness test battery for other tokens.

The battery takes runs of TOKEN characters long enough to carry a secret, infers their encoding (hexadecimal,
base32, base36, base64 or its letters and digits) and asks two questions.

Does the token look drawn at random from the encoding's alphabet? A chi-squared test of uniform use of the alphabet, a
runs test of the halves of the alphabet, and a serial correlation test of neighbouring places; a token that one of them
rejects (Sidak's correction, level EXCLUDE) is a name or a code of a pattern.

Can it be a name all the same? Short names pass such tests by chance. Names repeat their letters (COINCIDENCE of all
pairs of places are equal) and seldom change between capitals, small letters and digits (CHANGES of all neighbours):
the chances of as few equal pairs and of as many changes, combined by Fisher's method, are the token's p-value. Among the
tokens of one encoding and length class Benjamini-Hochberg control names those of them that are secrets, so that at most
FALSE_DISCOVERIES of the tokens named are names in expectation, as far as the two rates hold: a short token has to be
more striking among many names than a long one. Those are spans of the kind ``random``.

The sorted p-values of a class are kept as counts over P_BINS bins, never as rows: a class is at most that many sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)password|passwd|secret|token|api_?key"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "random")

HEXADECIMAL, BASE32 = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"hex": HEXADECIMAL, "base32": BASE32, "base36": BASE36, "alnum": BASE64[:62], "base64": BASE64}
#: Level at which the battery rejects randomness.
EXCLUDE = 0.001
#: Of names: the share of equal characters among all pairs of places, at least twice the alphabet's own; and the share
#: of neighbours of different kinds, in tokens of both cases and in others.
COINCIDENCE, CHANGES = 0.06, (0.35, 0.15)
FALSE_DISCOVERIES = 0.05
P_BINS = 400

_MATCHES = "array<struct<gap:int,size:int,found:string>>"
_SPANS = "array<struct<start:int,end:int,found:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Array of (gap: code points since the last match, size, found) of the leftmost non-overlapping matches."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    one = lambda before, m: F.struct(F.length(before).alias("gap"), F.length(m).alias("size"), m.alias("found"))
    return F.filter(F.zip_with(between, found, one), lambda x: x["found"].isNotNull())


def spans(pairs: str) -> Column:
    """Array of (start, end, found) of a column of ``matches``, in code points.

    Places are running sums. An array that grows is copied at each step, so n matches are taken in parts of about the
    square root of n, whose starts are summed first."""
    n = F.size(pairs)
    part = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(n / part).cast("int") - 1), lambda i: F.slice(pairs, i * part + 1, part))
    lengths = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
    begin = F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["found"].alias("found"))
        return F.struct((start + x["size"]).alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

    def within(p: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(F.coalesce(p, F.array().cast(_MATCHES)), first, step, lambda x: x["out"])

    return F.when(n > 0, F.flatten(F.zip_with(parts, begin, within))).otherwise(F.array().cast(_SPANS))


def base_spans(docs: DataFrame) -> DataFrame:
    """row (a number of the row), doc_id, and arrays assign, access, hex, tokens of (start, end, found), without the texts.

    Texts are read once; the matches, without them, are written."""
    text, none = F.col("_text"), F.array().cast(_MATCHES)
    rows = docs.select("doc_id", whole_text().alias("_text"))
    hints = {"assign": (F.rlike(text, F.lit(ASSIGN_HINT)), ASSIGN), "access": (F.contains(text, F.lit("AKIA")), ACCESS)}
    hints |= {k: (F.rlike(text, F.lit(p)), p) for k, p in (("hex", HEX), ("tokens", TOKEN))}
    matched = [F.when(hint, matches(text, p)).otherwise(none).alias(k) for k, (hint, p) in hints.items()]
    found = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *matched), "secret-matches")
    placed = found.select("row", "doc_id", *[spans(k).alias(k) for k in hints])
    return placed.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= 12))


def encoding(token: Column) -> Column:
    """The narrowest encoding whose alphabet and mix of characters fit, or null: words without a digit, numbers
    and names of letters only aren't encoded bytes. Hexadecimal, base32 and base36 may be of either case."""
    has = lambda p: F.rlike(token, F.lit(p))
    mixed_case = has("[A-Z]") & has("[a-z]") & has("[0-9]")
    return (
        F.when((has("^[0-9a-f]+$") | has("^[0-9A-F]+$")) & has("[0-9]") & has("[A-Fa-f]"), "hex")
        .when((has("^[A-Z2-7]+$") & has("[A-Z]") | has("^[a-z2-7]+$") & has("[a-z]")) & has("[2-7]"), "base32")
        .when((has("^[A-Z0-9]+$") & has("[A-Z]") | has("^[a-z0-9]+$") & has("[a-z]")) & has("[0-9]"), "base36")
        .when(mixed_case & has("^[A-Za-z0-9]+$"), "alnum")
        .when(mixed_case, "base64")
    )


def upper_tail(z: Column) -> Column:
    """The normal distribution above z, to 1e-7, and in its tail to about a thousandth of itself (formula 26.2.17 of Abramowitz and Stegun)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(F.greatest(F.lit(-700.0), -x * x / 2)) / 2.5066282746310002 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _letters(kind: Column) -> Column:
    return reduce(lambda rest, k: F.when(kind == k, F.lit(ALPHABETS[k])).otherwise(rest), ALPHABETS, F.lit(BASE64))


def plain(token: Column, kind: Column) -> Column:
    """The token in the letters of its alphabet."""
    return F.when(kind.isin("hex", "base32", "base36"), F.upper(token)).otherwise(F.translate(token, "-_", "+/"))


def _characters(token: Column) -> Column:
    return F.filter(F.split(token, ""), lambda c: c != "")


def _pairs(values: Column) -> Column:
    return F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def token_sums(tokens: DataFrame) -> DataFrame:
    """Adds to tokens (found) kind and, as numbers: n, its size, k, the letters of its alphabet, equal, the sum of squared
    counts of its letters, and of its letters' places in the alphabet mean, squares, joint (products of neighbours), ends
    (the first and the last), high (in the upper half) and runs; and changes between capitals, small letters and digits.

    Each step is a projection of its own: an expression that is used twice isn't written out twice."""
    rows = tokens.withColumn("kind", encoding(F.col("found"))).where("kind IS NOT NULL")
    rows = rows.withColumns({"own": plain(F.col("found"), F.col("kind")), "letters": _letters(F.col("kind")), "shape": F.regexp_replace(F.regexp_replace(F.regexp_replace("found", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")})
    rows = rows.withColumns({"characters": _characters(F.col("own")), "classes": _characters(F.col("shape")), "size": F.length("own"), "half": F.floor(F.length("letters") / 2)})
    squares = F.aggregate(F.array_distinct("characters"), F.lit(0).cast("long"), lambda a, c: a + F.pow(F.col("size") - F.length(F.replace(F.col("own"), c, F.lit(""))), F.lit(2)).cast("long"))
    rows = rows.withColumns({"places": F.transform("characters", lambda c: F.position(c, F.col("letters")) - 1), "equal": squares.cast("double")})
    rows = rows.withColumns({"pairs": _pairs(F.col("places")), "class_pairs": _pairs(F.col("classes"))})
    sums = {
        "n": F.col("size"), "k": F.length("letters"), "mean": F.aggregate("places", F.lit(0.0), lambda a, x: a + x) / F.col("size"),
        "squares": F.aggregate("places", F.lit(0.0), lambda a, x: a + x * x), "joint": F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p["a"] * p["b"]),
        "ends": F.element_at("places", 1) + F.element_at("places", -1), "high": F.size(F.filter("places", lambda x: x >= F.col("half"))),
        "runs": F.size(F.filter("pairs", lambda p: (p["a"] >= F.col("half")) != (p["b"] >= F.col("half")))) + 1, "changes": F.size(F.filter("class_pairs", lambda p: p["a"] != p["b"])),
    }
    return rows.select(*tokens.columns, "kind", "equal", *[v.cast("double").alias(c) for c, v in sums.items()])


def p_values(sums: DataFrame) -> DataFrame:
    """Adds to ``token_sums`` random, the battery's combined p-value of a token that is random, and name, how likely a name has
    as few equal pairs and as many changes of kind."""
    col = F.col
    n, k = col("n"), col("k")
    rate = F.greatest(F.lit(COINCIDENCE), 2 / k)
    change = F.when(col("kind").isin("alnum", "base64"), CHANGES[0]).otherwise(CHANGES[1])
    mean_runs = 2 * col("high") * (n - col("high")) / n + 1
    rows = sums.withColumns({"mean_runs": mean_runs, "spread": col("squares") - n * col("mean") * col("mean"), "expected": n * (n - 1) / 2 * rate, "change": change})
    # The sum of products of neighbours' distances from the mean.
    joint = col("joint") - col("mean") * (2 * n * col("mean") - col("ends")) + (n - 1) * col("mean") * col("mean")
    rows = rows.withColumns({"var_runs": (col("mean_runs") - 1) * (col("mean_runs") - 2) / (n - 1), "joint": joint})
    rows = rows.withColumns(
        {
            # The exact mean and variance of the statistic for n draws from k letters.
            "z_chi": (col("equal") * k / n - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n),
            "z_runs": F.when(col("var_runs") > 0, F.abs(col("runs") - col("mean_runs")) / F.sqrt("var_runs")).otherwise(F.lit(9.0)),
            "z_serial": F.when(col("spread") > 0, F.abs(col("joint") / col("spread") + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0)),
            "z_few": (col("expected") - (col("equal") - n) / 2 - 0.5) / F.sqrt("expected"),
            "z_many": (col("changes") - 0.5 - (n - 1) * col("change")) / F.sqrt((n - 1) * col("change") * (1 - col("change"))),
        }
    )
    rows = rows.withColumns({"worst": F.least(upper_tail(col("z_chi")), 2 * upper_tail(col("z_runs")), 2 * upper_tail(col("z_serial")), F.lit(1.0)), "both": upper_tail(col("z_few")) * upper_tail(col("z_many"))})
    fisher = F.when(col("both") > 0, F.least(F.lit(1.0), col("both") * (1 - F.log("both")))).otherwise(F.lit(0.0))
    return rows.withColumns({"random": 1 - F.pow(1 - col("worst"), F.lit(3.0)), "name": fisher})


def _bin(p: Column) -> Column:
    """P_BINS bins, twenty for each power of ten; the bin's upper edge stands for its p-values."""
    return F.greatest(F.lit(0), F.least(F.lit(P_BINS - 1), F.floor(-20 * F.log10(F.greatest(p, F.lit(1e-300)))))).cast("int")


def length_class(n: Column) -> Column:
    return F.least(F.lit(15), F.floor(2 * F.log2(n / 12.0))).cast("int")


def in_assignments(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """(row, start) of the tokens that meet a span of ``assign``: both meet by stretches of 32 code points."""

    def pieces(rows: DataFrame, name: str) -> DataFrame:
        cut = F.explode(F.sequence(F.floor(F.col("start") / 32), F.floor((F.col("end") - 1) / 32)))
        return rows.select("row", F.col("start").alias(f"start_{name}"), F.col("end").alias(f"end_{name}"), cut.alias("piece"))

    left = pieces(tokens, "t")
    right = pieces(found.select("row", F.explode("assign").alias("a")).select("row", "a.start", "a.end"), "a")
    met = left.join(right, ["row", "piece"]).where((F.col("start_t") < F.col("end_a")) & (F.col("start_a") < F.col("end_t")))
    return met.select("row", F.col("start_t").alias("start")).distinct()


def judged(found: DataFrame) -> DataFrame:
    """(row, start, end, stratum, bin, apart: it meets no base span) of each token; bin is -1 for those that aren't random.

    A token ends where no letter of it can follow, so codes and hexadecimal runs that it meets lie inside it."""
    tokens = found.select("row", F.explode("tokens").alias("t")).select("row", "t.start", "t.end", "t.found")
    inside = F.rlike("found", F.lit(HEX)) | F.rlike("found", F.lit(ACCESS))
    # A table between the two steps keeps their code small enough to be compiled.
    rows = p_values(stored(token_sums(tokens.withColumn("inside", inside)).drop("found"), "secret-token-sums"))
    rows = rows.select("row", "start", "end", "inside", F.concat_ws(":", "kind", length_class(F.col("n")).cast("string")).alias("stratum"), F.when(F.col("random") < EXCLUDE, F.lit(-1)).otherwise(_bin(F.col("name"))).alias("bin"))
    rows = stored(rows, "secret-p-values")
    met = in_assignments(rows, found).withColumn("met", F.lit(True))
    return rows.join(met, ["row", "start"], "left").select("row", "start", "end", "stratum", "bin", (~F.col("inside") & F.col("met").isNull()).alias("apart"))


def named_bins(tokens: DataFrame, share: float = FALSE_DISCOVERIES) -> dict[str, int]:
    """Of each stratum with discoveries the lowest bin number whose tokens are named.

    At most encodings x length classes strata come to the driver."""
    counts = tokens.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    whole = Window.partitionBy("stratum")
    ranked = counts.withColumns({"rank": F.sum("n").over(down), "all": F.sum("n").over(whole)})
    passed = ranked.where((F.col("bin") >= 0) & (F.pow(F.lit(10.0), -F.col("bin") / 20.0) <= share * F.col("rank") / F.col("all")))
    return {r["stratum"]: r["bin"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of these columns, by start, then kind as listed, comma-joined."""
    ranked = lambda i: lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"))
    parts = [F.transform(k, ranked(i)) for i, k in enumerate(kinds)]
    rows = F.array_sort(F.concat(*parts))
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the arrays assign, access, hex, random of (start, end), and confirmed, of the tokens that the battery names
    inside the first three, of every row.

    Null and empty texts have no spans; repeated rows repeat theirs; a null doc_id stays null; an empty table gives no
    rows. Texts of any length are taken whole, and other columns are left out."""
    found = base_spans(docs)
    tokens = stored(judged(found), "secret-tokens")
    limits = named_bins(tokens)
    limit = F.create_map(*[v for k, b in limits.items() for v in (F.lit(k), F.lit(b))]) if limits else F.create_map().cast("map<string,int>")
    named = tokens.where(F.col("bin") >= F.coalesce(F.try_element_at(limit, F.col("stratum")), F.lit(P_BINS)))
    listed = lambda apart: F.array_sort(F.collect_list(F.when(F.col("apart") == apart, F.struct("start", "end"))))
    named = named.groupBy("row").agg(listed(True).alias("random"), listed(False).alias("confirmed"))
    place = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    base = found.select("row", "doc_id", *[place(F.col(c)).alias(c) for c in KINDS[:3]])
    none = F.array().cast("array<struct<start:int,end:int>>")
    return base.join(named, "row", "left").select("doc_id", *KINDS[:3], *[F.coalesce(c, none).alias(c) for c in ("random", "confirmed")])


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, n_confirmed, base_sha256, spans."""
    rows = scan(docs)
    counts = [F.size(c).cast("long").alias(f"n_{c}") for c in (*KINDS, "confirmed")]
    return rows.select("doc_id", *counts, F.sha2(joined(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), joined(KINDS).alias("spans"))
