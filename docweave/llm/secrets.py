"""Secret scan with a battery of randomness tests [DataFrame functions only].

Base spans: assignments, access keys and hex strings by regular expression. The method
adds spans: tokens of 20 or more key characters, for which an encoding is inferred
(hex, base 32, base 64) and three tests run on the codes: chi-squared uniformity over the
alphabet, Wald-Wolfowitz runs about its middle, and serial correlation at lag 1. A token
passes if the three together do not reject randomness. Chance passes of ordinary words are
held down by a false-discovery rate: the p-value of its chi-squared value under
natural writing sinks with length, and Benjamini-Hochberg cutoffs are found for each
length class over all tokens of the corpus, from a histogram of bounded size.

Offsets come from splitting the text at the matches: a match starts after all pieces
and matches before it. Texts are read once and not shuffled.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

KINDS = ("assign", "access", "hex", "random")
#: Fixed values. hex and access with their least length inside the pattern find the same runs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
_ALPHABETS = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Under natural writing (letter frequencies of English; digits for hex), growth of the
#: chi-squared value's mean and variance with each sign.
_NATURAL = {16: (0.6, 0.0), 32: (1.1, 4.0), 64: (3.2, 16.4)}
BINS = 400  #: of -log10 p, a tenth wide


def spans_of(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """array<struct<s, e>> of the matches, leftmost and not overlapping; with group, only
    those whose group has least characters or more."""
    hits, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.transform(F.arrays_zip(hits.alias("h"), F.slice(parts, F.lit(1), F.size(hits)).alias("p"), sizes.alias("g")), lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["h"]).alias("h"), F.length(x["g"]).alias("g")))
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["p"]
        one = F.array(F.struct(s.alias("s"), (s + x["h"]).alias("e")))
        return F.struct((s + x["h"]).alias("at"), F.when(x["g"] >= least, F.concat(acc["of"], one)).otherwise(acc["of"]).alias("of"))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("of")), step, lambda a: a["of"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _tested(span: Column, text: Column) -> Column:
    """A candidate span with its length, class, -log10 p bin and whether randomness is not rejected."""
    token = F.regexp_replace(text.substr(span["s"] + 1, span["e"] - span["s"]), "=+$", "")
    url = F.translate(token, "-_", "+/")
    k = F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(token.rlike("^[A-Z2-7]+$"), 32).otherwise(64)
    signs = F.filter(F.split(F.when(k == 16, F.lower(token)).otherwise(url), "", -1), lambda c: c != "")
    alphabet = F.when(k == 16, F.lit(_ALPHABETS[16])).when(k == 32, F.lit(_ALPHABETS[32])).otherwise(F.lit(_ALPHABETS[64]))
    codes = F.filter(F.transform(signs, lambda c: F.call_function("locate", c, alphabet) - 1), lambda x: x >= 0)
    return F.struct(span["s"].alias("s"), span["e"].alias("e"), k.alias("k"), codes.alias("codes"), token.rlike("[0-9]").alias("digit"))


def _statistics(x: Column) -> Column:
    k, codes = x["k"], x["codes"]
    n = F.size(codes)
    square = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0).cast("long"), lambda a, v: a + F.pow(F.size(F.filter(codes, lambda c: c == v)), F.lit(2)).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a + c)
    steps = F.sequence(F.lit(1), n - 1)
    half = k / 2
    runs = F.size(F.filter(steps, lambda i: (F.get(codes, i) >= half) != (F.get(codes, i - 1) >= half))) + 1
    above = F.size(F.filter(codes, lambda c: c >= half))
    mean = total / n
    var = F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
    lag = F.aggregate(steps, F.lit(0.0), lambda a, i: a + (F.get(codes, i) - mean) * (F.get(codes, i - 1) - mean))
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), k.alias("k"), n.alias("n"), x["digit"].alias("digit"), (k * square / n - n).alias("chi"), runs.alias("runs"), above.alias("above"), (lag / F.greatest(var, F.lit(1e-9))).alias("serial"))


def _judged(x: Column) -> Column:
    k, n, chi = x["k"], x["n"], x["chi"]
    free = 2.0 / (9 * (k - 1))
    z1 = (F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - free)) / F.sqrt(free)  # Wilson-Hilferty
    two = 2.0 * x["above"] * (n - x["above"])
    mean, var = two / n + 1, two * (two - n) / (F.pow(n, F.lit(2)) * (n - 1))
    z2 = F.when(var > 0, (x["runs"] - mean) / F.sqrt(var)).otherwise(F.lit(9.0))
    z3 = (x["serial"] + 1.0 / n) * F.sqrt(n)
    passed = F.pow(F.greatest(z1, F.lit(0.0)), F.lit(2)) + z2 * z2 + z3 * z3 <= 16.27  # chi-squared, 3 degrees, 0.001
    grow = F.when(k == 16, F.lit(_NATURAL[16][0])).when(k == 32, F.lit(_NATURAL[32][0])).otherwise(F.lit(_NATURAL[64][0]))
    noise = F.when(k == 16, F.lit(_NATURAL[16][1])).when(k == 32, F.lit(_NATURAL[32][1])).otherwise(F.lit(_NATURAL[64][1]))
    z = ((k - 1) + grow * (n - 1) - chi) / F.sqrt(2.0 * (k - 1) + noise * n)  # how far below natural writing
    tail = lambda q: q * q / 2 / 2.302585 + F.log10(1.64 * q + F.sqrt(0.76 * q * q + 4))  # noqa: E731  -log10 of the normal tail
    score = F.when(z > 0, tail(z)).otherwise(F.lit(0.0))
    good = passed & x["digit"]
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.least(F.floor(F.log2(n.cast("double"))), F.lit(8)).cast("int").alias("class"), F.when(good, F.least(F.floor(score * 10), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int").alias("bin"))


def cutoffs(counts: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """Benjamini-Hochberg from rows (class, bin, tokens): the lowest bin of each class that is a discovery."""
    out = {}
    for c in {r[0] for r in counts}:
        own = {b: n for k, b, n in counts if k == c}
        total, seen, low = sum(own.values()), 0, BINS
        for b in sorted((b for b in own if b), reverse=True):
            seen += own[b]
            if 10 ** (-b / 10) <= rate * seen / total:
                low = b
        out[c] = low
    return out


def _text(spans: Column) -> Column:
    """Spans (s, kind number, e) as kind:start:end, comma-joined, by start, then kind."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rate: float = 0.01) -> DataFrame:
    """The columns keep of docs (all by default) with n_assign, n_access, n_hex, base_sha256,
    spans (all, kind:start:end in code points; kind random for added ones) and n_added.

    Null text counts as empty. Rows come out as often as they come in; columns of docs with
    the new names are replaced. Without candidates there is nothing to add."""
    new = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added")
    cols = [c for c in (docs.columns if keep is None else keep) if c not in new]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.withColumn("docweave_text", text).select(
        *cols, "docweave_text", spans_of(F.col("docweave_text"), ASSIGN, 2, 8).alias("dw_0"), spans_of(F.col("docweave_text"), ACCESS).alias("dw_1"), spans_of(F.col("docweave_text"), HEX).alias("dw_2"), spans_of(F.col("docweave_text"), CANDIDATE).alias("dw_c"))
    with_codes = base.withColumn("dw_c", F.transform("dw_c", lambda x: _tested(x, F.col("docweave_text"))))
    judged = with_codes.withColumn("dw_c", F.transform(F.filter("dw_c", lambda x: F.size(x["codes"]) >= 16), _statistics)).withColumn("dw_c", F.transform("dw_c", _judged)).drop("docweave_text")
    found = materialise(judged, "secrets")
    counts = found.select(F.explode("dw_c").alias("x")).groupBy("x.class", "x.bin").count().collect()  # at most 9 * BINS rows
    cut = cutoffs([tuple(r) for r in counts], rate)
    of = lambda name, kind: F.transform(F.col(name), lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))
    all_base = F.concat(of("dw_0", 0), of("dw_1", 1), of("dw_2", 2))

    def bar(x: Column) -> Column:
        out = F.when(F.lit(False), F.lit(BINS))
        for c, b in cut.items():
            out = out.when(x["class"] == c, F.lit(b))
        return out.otherwise(F.lit(BINS))

    added = F.filter("dw_c", lambda x: (x["bin"] >= bar(x)) & ~F.exists("dw_b", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    out = found.withColumn("dw_b", all_base).withColumn("dw_a", added)
    more = F.transform("dw_a", lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("kind"), x["e"].alias("e")))
    size = lambda c: F.size(c).cast("long")
    return out.select(*cols, size("dw_0").alias("n_assign"), size("dw_1").alias("n_access"), size("dw_2").alias("n_hex"), F.sha2(_text(F.col("dw_b")), 256).alias("base_sha256"), _text(F.concat("dw_b", more)).alias("spans"), size("dw_a").alias("n_added"))
