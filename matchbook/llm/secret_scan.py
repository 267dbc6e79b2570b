"""Secrets by fixed patterns and by a battery of randomness tests.

Base spans come from three patterns (assignments, access keys, hex runs).  The
battery adds long tokens that look random: the encoding of a token is inferred
from its characters, and chi-squared uniformity over that alphabet, a runs
test and a lag-one serial correlation test its characters.  The smallest of
the three p-values, times three, is the evidence that a token is *not* random.
Tokens are then rejected as not random by a Benjamini-Hochberg step inside
each length class (short tokens give weak tests, so their classes reject at a
higher rate); those that stay are added as spans of kind ``random``.  A long token
of which a base span is only a part is one secret as a whole: it is added without a
test, so that no piece of it outlives a redaction.

Everything is built-in functions and stays in the row; only the counts of
p-values on a fixed logarithmic grid (at most classes x grid steps rows) are
aggregated over the corpus, and one threshold per length class is collected.
P-values are defined on that grid (rounded up), which makes the step exact.

Defined cases: null text counts as empty and has no span; a token of one
character class is no encoding and is never added by a test; tested tokens never
overlap a base span, and a token inside one adds nothing; repeated rows are judged and counted each; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.common import table, write_shared
from matchbook.llm.spans import let, match_spans

# Fixed values of the contract.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""[A-Za-z0-9+/_.=-]+""")
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)$"""
# a run that fails the length test holds no shorter run that passes it, so the
# least length can stand in the pattern of these two kinds
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN = 20
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
# (name, alphabet, what a token must match)
ENCODINGS = [
    ("hex", DIGITS + "abcdef", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    ("HEX", DIGITS + "ABCDEF", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    ("base32", UPPER + "234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$"),
    ("base36", DIGITS + LOWER, r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    ("base62", DIGITS + UPPER + LOWER, r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z]+$"),
    ("base64", DIGITS + UPPER + LOWER + "+/", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/]+=*$"),
    ("base64url", DIGITS + UPPER + LOWER + "-_", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z_-]+=*$"),
]
GRID = 50                      # grid steps per decade of a p-value
LEAST_P = 1e-30
# rejection rate by length class (class c holds lengths 20 * 2^c and up)
RATES = (0.2, 0.1, 0.05)


def upper_tail(z: Column) -> Column:
    """Normal upper tail for z >= 0 (polynomial approximation, error < 1e-7)."""
    def poly(t: Column) -> Column:
        out = F.lit(0.0)
        for b in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
            out = (out + b) * t
        return out
    return 0.3989422804 * F.exp(-z * z / 2) * let(1 / (1 + 0.2316419 * z), poly)


def one_sided(z: Column) -> Column:
    return let(z, lambda v: F.when(v >= 0, upper_tail(v)).otherwise(1 - upper_tail(-v)))


def two_sided(z: Column) -> Column:
    return let(F.abs(z), lambda v: F.least(F.lit(1.0), 2 * upper_tail(v)))


def chi_squared_p(token: Column, alphabet: str) -> Column:
    """Uniformity over the alphabet, by the cube-root normal approximation."""
    n, k = F.length(token), len(alphabet)
    squares = F.aggregate(
        F.transform(F.split(F.lit(alphabet), ""), lambda ch: n - F.length(F.replace(token, ch, F.lit("")))),
        F.lit(0.0), lambda acc, c: acc + (c * c).cast("double"))
    chi, df = squares * k / n - n, k - 1
    spread = 2 / (9 * df)
    return one_sided((F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - spread)) / spread ** 0.5)


def runs_p(token: Column, alphabet: str) -> Column:
    """Runs above and below the middle of the alphabet."""
    half = len(alphabet) // 2
    bits = F.translate(token, alphabet, "0" * half + "1" * (len(alphabet) - half))

    def test(b: Column) -> Column:
        n = F.length(b).cast("double")
        ones = F.length(F.replace(b, F.lit("0"), F.lit(""))).cast("double")
        zeros = n - ones
        turns = (2 * n - F.length(F.replace(b, F.lit("01"), F.lit(""))) - F.length(F.replace(b, F.lit("10"), F.lit("")))) / 2
        mean = 2 * ones * zeros / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(var <= 0, 0.0).otherwise(two_sided((turns + 1 - mean) / F.sqrt(var)))
    return let(bits, test)


def serial_p(token: Column, alphabet: str) -> Column:
    """Lag-one correlation of the characters' places in the alphabet."""
    places = F.transform(F.filter(F.split(token, ""), lambda ch: ch != ""),
                         lambda ch: F.instr(F.lit(alphabet), ch).cast("double"))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)

    def test(x: Column) -> Column:
        n = F.size(x)
        return let(total(x) / n, lambda mean: let(F.transform(x, lambda v: v - mean), lambda d: let(
            total(F.transform(d, lambda v: v * v)),
            lambda s: F.when(s <= 0, 0.0).otherwise(two_sided(
                total(F.zip_with(F.slice(d, F.lit(1), n - 1), F.slice(d, F.lit(2), n - 1), lambda a, b: a * b))
                / s * F.sqrt(n.cast("double")))))))
    return let(places, test)


def battery(token: Column) -> Column:
    """The p-value on the grid (steps, larger: less random) of a token in its
    inferred encoding; null for a token in none."""
    def tests(alphabet: str):
        def test(core: Column) -> Column:
            p = 3 * F.least(chi_squared_p(core, alphabet), runs_p(core, alphabet), serial_p(core, alphabet))
            return F.floor(-GRID * F.log10(F.least(F.greatest(p, F.lit(LEAST_P)), F.lit(1.0)))).cast("int")
        return test

    out = F.lit(None).cast("int")
    for _, alphabet, shape in reversed(ENCODINGS):
        out = F.when(token.rlike(shape), let(F.rtrim(token, F.lit("=")), tests(alphabet))).otherwise(out)
    return out


def length_class(n: Column) -> Column:
    return F.floor(F.log2(n / MIN_TOKEN)).cast("int")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``_base`` (sorted base spans), ``_tokens`` (candidate spans
    with their length class and grid step) and ``_wider`` (tokens that reach beyond
    a base span in them)."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def spans(kind: int, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    assigned = F.filter(match_spans(text, ASSIGN),
                        lambda s: F.length(F.regexp_extract(s["text"], ASSIGN_VALUE, 1)) >= MIN_VALUE)
    base = F.array_sort(F.concat(spans(0, assigned), spans(1, match_spans(text, ACCESS)),
                                 spans(2, match_spans(text, HEX))))
    found = docs.withColumn("_base", base).withColumn("_found", match_spans(text, TOKEN))
    free = F.filter("_found", lambda t: ~F.exists(
        "_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    tokens = F.transform(free, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"),
        length_class(F.length(t["text"])).alias("class"), battery(t["text"]).alias("step")))
    # an assignment begins before its value, so only what follows it belongs to it
    wider = F.filter("_found", lambda t: F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]) & (
        (b["end"] < t["end"]) | ((b["kind"] > 0) & (t["start"] < b["start"])))) &
        ~F.exists("_base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])))
    return found.withColumns({
        "_tokens": F.filter(tokens, lambda t: t["step"].isNotNull()),
        "_wider": F.transform(wider, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"))),
    }).drop("_found")


def reject_from(scanned: DataFrame) -> dict[int, int]:
    """Per length class the least grid step that the Benjamini-Hochberg step
    rejects as not random; classes that reject nothing are absent.  One row per
    class reaches the driver."""
    from pyspark.sql import Window

    seen = scanned.select(F.explode("_tokens").alias("t")).groupBy("t.class", "t.step").agg(
        F.count(F.lit(1)).alias("n"))
    smaller = Window.partitionBy("class").orderBy(F.desc("step"))
    rate = F.element_at(F.array(*[F.lit(r) for r in RATES]), F.least(F.col("class") + 1, F.lit(len(RATES))))
    rejected = (seen.withColumn("k", F.sum("n").over(smaller))
                    .withColumn("m", F.sum("n").over(Window.partitionBy("class")))
                    .filter(F.pow(F.lit(10.0), -F.col("step") / GRID) <= rate * F.col("k") / F.col("m")))
    return {r["class"]: r["step"] for r in rejected.groupBy("class").agg(F.min("step").alias("step")).collect()}


def all_spans(limits: dict[int, int]) -> Column:
    """Base spans, the tokens around them and those that stay random, sorted by
    start and kind."""
    def stays(t: Column) -> Column:
        out = F.lit(True)
        for cls, step in limits.items():
            out = F.when(t["class"] == cls, t["step"] < step).otherwise(out)
        return out
    added = F.transform(F.filter("_tokens", stays), lambda t: F.struct(
        t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return F.array_sort(F.concat("_base", "_wider", added))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones merged, replaced by ``mark``."""
    kind = "array<string>"
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.array(F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark)).cast(kind)
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"),
                        F.when(s["start"] >= acc["pos"], F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        spans, zero, step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text)))))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = write_shared(scan(docs).drop("text"), "secrets")
    spans = all_spans(reject_from(scanned))

    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"),
                          count(2).alias("n_hex"), F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
                          written(spans).alias("spans"))


def _sql_battery() -> str:
    """SQL expression of a token's grid step (columns ``core``, ``n``, ``enc``),
    by the formulas of the battery."""
    def case(values) -> str:
        return "CASE enc " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
    sizes = [len(a) for _, a, _ in ENCODINGS]
    spread = [2 / (9 * (k - 1)) for k in sizes]
    bits = [f"translate(core, '{a}', '{'0' * (len(a) // 2) + '1' * (len(a) - len(a) // 2)}')" for _, a, _ in ENCODINGS]

    def tail(z: str) -> str:
        t = f"(1 / (1 + 0.2316419 * {z}))"
        poly = "0.0"
        for b in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
            poly = f"(({poly} + {b}) * {t})"
        return f"(0.3989422804::DOUBLE * exp(-{z} * {z} / 2) * {poly})"

    def both_sides(z: str) -> str:
        return f"least(1.0::DOUBLE, 2 * {tail(f'abs({z})')})"
    return f"""
alpha AS (SELECT *, {case([f"'{a}'" for _, a, _ in ENCODINGS])} AS alphabet, {case(sizes)}::DOUBLE AS size,
                 {case(bits)} AS bits FROM token),
place AS (SELECT *, length(core)::DOUBLE AS n,
                 list_sum(list_transform(string_split(alphabet, ''), lambda c: ((length(core) - length(replace(core, c, ''))) ** 2)::DOUBLE)) AS squares,
                 list_transform(string_split(core, ''), lambda c: instr(alphabet, c)::DOUBLE) AS x FROM alpha),
mean AS (SELECT *, list_transform(x, lambda v: v - list_sum(x) / len(x)) AS d,
                length(replace(bits, '0', ''))::DOUBLE AS ones,
                (2 * n - length(replace(bits, '01', '')) - length(replace(bits, '10', ''))) / 2 AS turns FROM place),
stat AS (SELECT *, (pow(greatest(squares * size / n - n, 0) / (size - 1), 1.0::DOUBLE / 3) - {case([repr(1 - s) for s in spread])}::DOUBLE)
                   / {case([repr(s ** 0.5) for s in spread])}::DOUBLE AS chi_z,
                2 * ones * (n - ones) / n + 1 AS runs_mean, list_sum(list_transform(d, lambda v: v * v)) AS ss FROM mean),
test AS (SELECT *, (runs_mean - 1) * (runs_mean - 2) / (n - 1) AS runs_var,
                CASE WHEN ss <= 0 THEN 0 ELSE list_sum(list_transform(range(1, len(d)), lambda i: d[i] * d[i + 1])) / ss * sqrt(n) END AS serial_z
         FROM stat),
p AS (SELECT *, 3 * least(CASE WHEN chi_z >= 0 THEN {tail("chi_z")} ELSE 1 - {tail("(-chi_z)")} END,
                          CASE WHEN runs_var <= 0 THEN 0 ELSE {both_sides("((turns + 1 - runs_mean) / sqrt(runs_var))")} END,
                          CASE WHEN ss <= 0 THEN 0 ELSE {both_sides("serial_z")} END) AS p FROM test)"""


def _sql_encoding() -> str:
    """Number of the first encoding a token fits (SQL has no look-ahead: the
    parts of the shapes are tested one by one)."""
    whens = []
    for i, (_, _, shape) in enumerate(ENCODINGS):
        parts = shape.strip("^$").split("(?=.*")
        must = [q.split(")")[0] for q in parts[1:]]
        whole = shape.rsplit(")", 1)[1].rstrip("$")
        whens.append(f"WHEN regexp_full_match(m, '{whole}')" + "".join(f" AND regexp_matches(m, '{q}')" for q in must) + f" THEN {i}")
    return "CASE " + " ".join(whens) + " END"


_SQL_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                      for w in ("password", "passwd", "secret", "token", "api_?key"))
_SQL_PATTERNS = [r"(?:%s)[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.=-]+" % _SQL_WORDS, "AKIA[A-Z0-9]+", "[0-9a-f]+", TOKEN]
_SQL_VALUE = r"^(?:%s)[\"'']?\x20*[:=]\x20*[\"'']?(.*)$" % _SQL_WORDS
_SQL_MADE = " UNION ALL ".join(
    f"SELECT k, {kind} AS kind, regexp_extract_all(text, '{p}') AS h, string_split_regex(text, '{p}') AS g FROM t"
    for kind, p in enumerate(_SQL_PATTERNS))

OP7_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
made AS ({_SQL_MADE}),
hit AS (SELECT k, kind, h[i] AS m, (list_sum(list_transform(g[1:i], lambda s: length(s)))
               + coalesce(list_sum(list_transform(h[1:i - 1], lambda s: length(s))), 0))::BIGINT AS start
        FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM made)),
span AS (SELECT *, start + length(m) AS stop FROM hit),
base AS (SELECT * FROM span WHERE (kind = 0 AND length(regexp_extract(m, '{_SQL_VALUE}', 1)) >= {MIN_VALUE})
            OR (kind = 1 AND length(m) >= 18) OR (kind = 2 AND length(m) >= 16)),
token AS (SELECT * FROM (
            SELECT k, start, stop, rtrim(m, '=') AS core, floor(log2(length(m) / {MIN_TOKEN}.0))::INTEGER AS class, {_sql_encoding()} AS enc
            FROM span s WHERE kind = 3 AND NOT EXISTS (
              SELECT 1 FROM base b WHERE b.k = s.k AND b.start < s.stop AND s.start < b.stop))
          WHERE enc IS NOT NULL),
{_sql_battery()},
step AS (SELECT k, start, stop, class, floor(-{GRID} * log10(least(greatest(p, {LEAST_P}::DOUBLE), 1.0)))::INTEGER AS step FROM p),
seen AS (SELECT class, step, count(*) AS n FROM step GROUP BY ALL),
ranked AS (SELECT class, step, sum(n) OVER (PARTITION BY class ORDER BY step DESC) AS k, sum(n) OVER (PARTITION BY class) AS m FROM seen),
cut AS (SELECT class, min(step) AS step FROM ranked
        WHERE pow(10.0::DOUBLE, -step / {GRID}.0::DOUBLE) <= ([{', '.join(f'{r}::DOUBLE' for r in RATES)}])[least(class + 1, {len(RATES)})] * k / m
        GROUP BY class),
every AS (SELECT k, kind, start, stop FROM base
          UNION ALL SELECT s.k, 3, s.start, s.stop FROM step s LEFT JOIN cut c ON c.class = s.class
          WHERE c.step IS NULL OR s.step < c.step
          UNION ALL SELECT k, 3, start, stop FROM span s WHERE kind = 3
            AND EXISTS (SELECT 1 FROM base b WHERE b.k = s.k AND b.start < s.stop AND s.start < b.stop
                        AND (b.stop < s.stop OR (b.kind > 0 AND s.start < b.start)))
            AND NOT EXISTS (SELECT 1 FROM base b WHERE b.k = s.k AND b.start <= s.start AND s.stop <= b.stop)),
named AS (SELECT *, (['assign', 'access', 'hex', 'random'])[kind + 1] || ':' || start || ':' || stop AS name FROM every),
out AS (SELECT k, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
               count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(name, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
               string_agg(name, ',' ORDER BY start, kind) AS spans FROM named GROUP BY k)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN out ON out.k = t.k
"""
