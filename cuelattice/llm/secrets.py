"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern names.

Runs of encoding characters are candidates. Of each the least alphabet that holds it is inferred; chi-squared
uniformity over that alphabet, a runs test and a serial-correlation test give p-values for "drawn at random", which
are combined. Words fail these tests, the surer the longer they are. So per alphabet and band of length the number of
candidates that are random is estimated from the upper p-values, and the limit is set where the share of false
discoveries stays under a bound; where words can't be told, as they can't be in short bands, no limit is low enough.
Each string counts once, however often it occurs; counts of p-values by bin are all that is gathered for it.
Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Fixed patterns by kind, in the order in which spans of one start are listed, and the shortest match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f] that are long enough
RUN = r"[A-Za-z0-9+/_-]{16,}"

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the least alphabet up: name, characters, pattern.
ENCODINGS: list[tuple[str, str, str]] = [
    ("digits", DIGITS, "^[0-9]+$"),
    ("hex", DIGITS + "abcdef", "^[0-9a-f]+$"),
    ("HEX", DIGITS + "ABCDEF", "^[0-9A-F]+$"),
    ("lower", LOWER, "^[a-z]+$"),
    ("upper", UPPER, "^[A-Z]+$"),
    ("base32", UPPER + "234567", "^[A-Z2-7]+$"),
    ("lower36", DIGITS + LOWER, "^[0-9a-z]+$"),
    ("upper36", DIGITS + UPPER, "^[0-9A-Z]+$"),
    ("letters", UPPER + LOWER, "^[A-Za-z]+$"),
    ("base62", UPPER + LOWER + DIGITS, "^[A-Za-z0-9]+$"),
    ("base64", UPPER + LOWER + DIGITS + "+/-_", "^[A-Za-z0-9+/_-]+$"),
]
#: Upper ends of the bands of length.
BANDS = (20, 24, 32, 48, 64)
BINS = 48
#: Share of false discoveries that is let pass.
FALSE_SHARE = 0.05
#: A band's counts are drawn towards those of all encodings in it, and these towards all, by as many candidates' worth.
PRIOR = 20
#: Code points of the blocks that a text is cut into for redaction.
BLOCK = 16_384


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, add: Callable[[Column, Column], Column], nothing: Column) -> Column:
    """Running totals of an array, in blocks of the cube root of its size: of blocks, and within each. n^(4/3) steps."""
    total = lambda xs: F.aggregate(xs, nothing, add)

    def placed(q: Column) -> Column:
        within = lambda block, before: F.transform(block, lambda v, i: add(before, total(F.slice(block, F.lit(1), i + 1))))
        return F.flatten(F.transform(q["blocks"], lambda block, k: let(total(F.slice(q["totals"], F.lit(1), k)), lambda before: within(block, before))))

    def blocks(x: Column) -> Column:
        by = F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(x)))).cast("int")
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.size(x), n), lambda at: F.slice(x, at, n))
        found = let(let(by, cut), lambda xs: let(F.struct(xs.alias("blocks"), F.transform(xs, total).alias("totals")), placed))
        return F.when(F.size(x) > 1, found).otherwise(x)

    return let(values, blocks)


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic curve (to about 1e-4)."""
    z = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_tail(F.abs(z)))


def _sum(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x).cast("double"))


def chi_squared_p(x: Column, n: Column, size: Column) -> Column:
    """Upper tail of chi-squared uniformity of codes x over `size` letters (Wilson-Hilferty)."""
    squares = _sum(F.array_distinct(x), lambda d: F.pow(F.size(F.filter(x, lambda y: y == d)).cast("double"), F.lit(2.0)))
    df = size - 1.0
    c = 2.0 / (9.0 * df)
    return normal_tail((F.pow(F.greatest(F.lit(0.0), squares * size / n - n) / df, F.lit(1.0 / 3)) - (1 - c)) / F.sqrt(c))


def runs_p(x: Column, n: Column, size: Column) -> Column:
    """Two-sided test of the number of runs of codes in the upper and lower half of the alphabet."""
    up = lambda v: (v * 2 >= size).cast("int")
    a = _sum(x, up)
    steps = F.sequence(F.lit(1), F.size(x) - 1)
    runs = 1 + _sum(steps, lambda i: (up(F.get(x, i)) != up(F.get(x, i - 1))).cast("int"))

    def test(q: Column) -> Column:
        both = 2 * q["a"] * (n - q["a"])
        variance = both * (both - n) / (n * n * (n - 1))
        return F.when(variance > 0, two_sided((q["runs"] - both / n - 1) / F.sqrt(variance))).otherwise(0.0)

    return let(F.struct(a.alias("a"), runs.alias("runs")), test)


def serial_p(x: Column, n: Column) -> Column:
    """Two-sided test of the correlation of each code with the next."""
    steps = F.sequence(F.lit(1), F.size(x) - 1)

    def test(mean: Column) -> Column:
        spread = _sum(x, lambda v: (v - mean) * (v - mean))
        shared = _sum(steps, lambda i: (F.get(x, i) - mean) * (F.get(x, i - 1) - mean))
        return let(F.struct(spread.alias("s"), shared.alias("c")), lambda q: F.when(q["s"] > 0, two_sided((q["c"] / q["s"] + 1 / n) * F.sqrt(n))).otherwise(0.0))

    return let(_sum(x, lambda v: v) / n, test)


def _encoding(c: Column, of: Callable[[int], Column]) -> Column:
    found = of(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        found = F.when(c.rlike(ENCODINGS[i][2]), of(i)).otherwise(found)
    return found


def battery(candidate: Column) -> Column:
    """struct<p double, encoding int, band int> of one candidate."""

    def tested(e: Column) -> Column:
        n = F.length(candidate).cast("double")
        alphabet = F.element_at(F.array(*[F.lit(x[1]) for x in ENCODINGS]), e + 1)
        size = F.length(alphabet).cast("double")
        codes = F.transform(F.split(candidate, ""), lambda ch: (F.instr(alphabet, ch) - 1).cast("double"))
        least = let(codes, lambda x: F.least(chi_squared_p(x, n, size), runs_p(x, n, size), serial_p(x, n)))
        p = 1 - F.pow(1 - least, F.lit(3.0))
        band = sum(((F.length(candidate) >= b).cast("int") for b in BANDS), F.lit(0))
        return F.struct(p.alias("p"), e.alias("encoding"), band.alias("band"))

    return let(_encoding(candidate, lambda i: F.lit(i)), tested)


def _matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if gate is None else F.when(gate, found).otherwise(F.array().cast("array<string>"))


def _spans(text: Column, pattern: str, found: Column, rank: int, kind: str, keep: Callable[[Column], Column]) -> Column:
    """array<struct<start, rank, kind, end>> of the matches that pass `keep`; the text between them is what split leaves."""

    def placed(q: Column) -> Column:
        m = q["m"]
        sizes = F.zip_with(m, F.slice(q["b"], F.lit(1), F.size(m)), lambda x, between: (F.length(x) + F.length(between)).cast("long"))
        ends = running(sizes, lambda x, y: x + y, F.lit(0).cast("long"))
        of = lambda end, x: F.struct((end - F.length(x)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), keep(x).alias("keep"), x.alias("text"))
        return F.filter(F.zip_with(ends, m, of), lambda s: s["keep"])

    return F.when(F.size(found) > 0, let(F.struct(found.alias("m"), F.split(text, pattern, -1).alias("b")), placed)).otherwise(F.array().cast(SPANS))


def candidates(docs: DataFrame) -> DataFrame:
    """Rows (encoding, band, p) of all candidates, each string once."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("c")).distinct()
    return runs.select(battery(F.col("c")).alias("b")).select("b.*")


def limits(docs: DataFrame) -> dict[tuple[int, int], float]:
    """(encoding, band) -> the least p of a discovery. Gathers at most encodings x bands x bins counts."""
    bin_ = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    counts = {(e, band): [0.0] * BINS for e in range(len(ENCODINGS)) for band in range(len(BANDS) + 1)}
    for row in candidates(docs).groupBy("encoding", "band", bin_).count().collect():
        counts[row["encoding"], row["band"]][row["bin"]] += row["count"]
    all_ = _drawn([sum(x) for x in zip(*counts.values(), strict=True)], [1.0] * BINS)
    of_band = [_drawn([sum(x) for x in zip(*(c for (_, b), c in counts.items() if b == band), strict=True)], all_) for band in range(len(BANDS) + 1)]
    return {(e, band): _limit(_drawn(c, of_band[band])) for (e, band), c in counts.items()}


def _drawn(bins: list[float], towards: list[float]) -> list[float]:
    return [x + PRIOR * y / sum(towards) for x, y in zip(bins, towards, strict=True)]


def _limit(bins: list[float]) -> float:
    """Random strings have even p-values, so no part of the upper p-values tells of more of them than there are."""
    random = min(sum(bins), 2 * sum(bins[BINS // 2 :]), 4 * sum(bins[3 * BINS // 4 :]))
    for i in range(BINS):
        above = sum(bins[i:])
        if 1 - random * (1 - i / BINS) / max(above, 1e-9) <= FALSE_SHARE:
            return i / BINS
    return 2.0


SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,keep:boolean,text:string>>"


def with_spans(docs: DataFrame, least_p: dict[tuple[int, int], float], name: str = "__spans") -> DataFrame:
    """All columns of docs and all spans of its text, sorted: struct<start, rank, kind, end, keep, text>."""
    text = F.coalesce("text", F.lit(""))
    yes = lambda x: F.lit(True)

    def random(c: Column) -> Column:
        table = F.array(*[F.lit(least_p[e, b]) for e in range(len(ENCODINGS)) for b in range(len(BANDS) + 1)])
        return let(battery(c), lambda q: (q["p"] >= F.element_at(table, q["encoding"] * (len(BANDS) + 1) + q["band"] + 1)))

    assign = _spans(text, ASSIGN, _matches(text, ASSIGN), 0, "assign", lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 6)

    def rest(runs: Column) -> Column:
        some = F.size(runs) > 0  # access keys and long hexadecimal runs lie within runs
        access = _spans(text, ACCESS, _matches(text, ACCESS, some), 1, "access", lambda x: F.length(x) >= 20)
        hexes = _spans(text, HEX, _matches(text, HEX, some), 2, "hex", yes)
        return F.struct(F.concat(assign, access, hexes).alias("base"), F.when(some, _spans(text, RUN, runs, 3, "random", random)).otherwise(F.array().cast(SPANS)).alias("random"))

    def merged(q: Column) -> Column:
        """Of the spans of the tests those go that end within one of a pattern that starts no later."""

        def outside(all_: Column) -> Column:
            reach = running(F.transform(all_, lambda s: F.when(s["rank"] < 3, s["end"]).otherwise(0)), lambda x, y: F.greatest(x, y), F.lit(0).cast("long"))
            return let(reach, lambda r: F.filter(all_, lambda s, i: (s["rank"] < 3) | (F.get(r, i) < s["end"])))

        return let(F.sort_array(F.concat(q["base"], q["random"])), outside)

    return docs.withColumn(name, let(let(_matches(text, RUN), rest), merged))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one per input row.

    docs has doc_id and text; other columns are ignored. A null or empty text has no spans: the digest of nothing and
    an empty list. Offsets are code points, ends exclusive. Spans of the tests ("random") that lie within one of a
    pattern aren't listed. Null doc_ids and repeated rows are given each. An empty table gives no rows.
    """
    found = with_spans(docs.select("doc_id", "text"), limits(docs)).drop("text")
    base = F.filter("__spans", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("__spans", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("__spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span of its text replaced by a mark; overlapping spans become one. Null texts stay null.

    Other columns are passed through, whatever their names. An empty table stays empty.
    """
    name = unused(docs, "spans")

    def cut_out(spans: Column) -> Column:
        # Each span that starts where none before it reaches keeps what lies between that reach and its start.
        def kept(q: Column) -> Column:
            blocks, reach = q["blocks"], q["reach"]

            def between(a: Column, b: Column) -> Column:
                part = lambda k: F.substring(F.get(blocks, k.cast("int")), (F.greatest(a - k * BLOCK, F.lit(0)) + 1).cast("int"), (F.least(b - k * BLOCK, F.lit(BLOCK)) - F.greatest(a - k * BLOCK, F.lit(0))).cast("int"))
                return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / BLOCK), F.floor((b - 1) / BLOCK)), part), "")).otherwise("")

            def piece(s: Column, i: Column) -> Column:
                before = F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long"))
                return F.when(s["start"] >= before, F.concat(between(before, s["start"]), F.lit(mark))).otherwise("")

            return F.concat(F.array_join(F.transform(spans, piece), ""), between(F.get(reach, F.size(reach) - 1), F.length("text").cast("long")))

        reach = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y), F.lit(0).cast("long"))
        return let(F.struct(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), reach.alias("reach")), kept)

    spans = with_spans(docs, limits(docs), name)
    return spans.withColumn("text", F.when(F.size(name) > 0, cut_out(F.col(name))).otherwise(F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])
