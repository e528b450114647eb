"""Operator 4, secret scans, in DataFrame functions alone.

Base patterns are found by regular expressions; places come from running sums of the lengths of matches and of what lies
between them. The method adds spans: base spans are blanked, candidate strings of token characters are taken from the rest, a
window of WINDOW characters is slid over each, its Shannon entropy kept by incremental counts, with a threshold for each
character class, and an allow list suppresses harmless candidates.

Every step is linear in the text: patterns repeat single characters only (Java recurses on repeated groups), values that a
lambda uses more than once are bound by ``_let``, and arrays grow within blocks of fixed size.
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, read

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: Leftmost greedy matches are whole runs, so a least length in the pattern drops the same matches as a later test.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: What is blanked once assignments are.
KEYS = r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Part of a candidate that an allowed whole does not excuse.
SEGMENT = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}"
WINDOW = 20
#: Character classes, the first that fits a candidate, with the least entropy in bits a character.
CLASSES = (
    (r"^[0-9a-fA-F]*$", 3.0),
    (r"^[0-9a-z+/_=-]*$", 3.7),
    (r"^[0-9A-Z+/_=-]*$", 3.7),
    (r"", 3.8),
)
#: Candidates that are never secrets: without a digit or a letter, UUIDs, placeholders, words joined by marks, alphabets.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|your[_-]",
    r"^[A-Za-z+/_=-]*[0-9]{0,4}$",
    r"(?i)0123456789|abcdefghij",
)
#: Elements of an array that one fold appends to.
RUN = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _appended(values: Column) -> Column:
    """Running sums of a short array."""
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x
        return F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out"))

    return F.aggregate(values, begin, step, lambda acc: acc["out"])


def running(values: Column) -> Column:
    """Running sums of an array of int: of each run of RUN elements, then of the runs' totals."""

    def of(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda k: _appended(F.slice(v, k * RUN + 1, F.lit(RUN))))
        return _let(runs, lambda r: _let(_appended(F.transform(r, lambda x: F.element_at(x, -1))), lambda t: F.flatten(F.transform(r, lambda x, k: F.transform(x, lambda y: y + F.when(k > 0, F.get(t, k - 1)).otherwise(0))))))

    return _let(values, lambda v: F.when(F.size(v) == 0, F.expr("cast(array() as array<int>)")).otherwise(of(v)))


def _rows(text: Column, pattern: str, group: int) -> Column:
    """Matches in order: match, value of the group, and what lies between it and the match before."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return _let(match, lambda m: F.arrays_zip(m.alias("match"), value.alias("value"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)).alias("gap")))


def _placed(text: Column, pattern: str, rank: int, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Matches whose ``keep`` (of match and value) holds, with their places in code points."""

    def of(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: F.char_length(x["gap"]) + F.char_length(x["match"])))
        kept = rows if keep is None else F.filter(F.transform(rows, lambda x, k: F.struct(x["match"].alias("match"), x["value"].alias("value"), k.alias("k"))), keep)

        def span(x: Column, end: Column) -> Column:
            start = (end - F.char_length(x["match"])).cast("int")
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(KINDS[rank]).alias("kind"), x["match"].alias("match"))

        if keep is None:
            return _let(ends, lambda e: F.transform(kept, lambda x, k: span(x, F.get(e, k))))
        return _let(ends, lambda e: F.transform(kept, lambda x: span(x, F.get(e, x["k"]))))

    # Most texts have no match: one pass tells.
    return F.when(text.rlike(pattern), _let(_rows(text, pattern, group), of)).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,match:string>>)"))


def _blanked(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """``text`` with spaces for the matches whose ``keep`` holds; places stay."""

    def one(x: Column) -> Column:
        blank = F.repeat(F.lit(" "), F.char_length(x["match"]))
        return F.concat(x["gap"], blank if keep is None else F.when(keep(x), blank).otherwise(x["match"]))

    joined = F.concat(F.array_join(F.transform(_rows(text, pattern, group), one), ""), F.element_at(F.split(text, pattern, -1), -1))
    return F.when(text.rlike(pattern), joined).otherwise(text)


def _hot_span(candidate: Column, window: int = WINDOW) -> Column:
    """struct(first, last): code points from the first to the last window at or over the threshold, 1-based; 0 if none is."""
    bits = F.lit(CLASSES[-1][1])
    for pattern, least in reversed(CLASSES[:-1]):
        bits = F.when(candidate.rlike(pattern), F.lit(least)).otherwise(bits)
    # What a character adds to the sum of n log n when its count rises from c to c + 1.
    f = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]
    gain = F.array(*(F.lit(f[c + 1] - f[c]) for c in range(window + 1)))
    # Counts by character are the letters of a string, "a" for none, which overlay updates in place.
    begin = F.struct(F.lit("a" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    count = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1))) - 97
    put = lambda counts, at, n: F.overlay(counts, F.char(n + 97), at, F.lit(1))

    def fold(chars: Column, bits: Column, gain: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            def leave(at: Column) -> Column:
                return _let(count(acc["counts"], at) - 1, lambda n: F.struct(put(acc["counts"], at, n).alias("counts"), (acc["sum"] - F.get(gain, n)).alias("sum")))

            def come(s: Column, at: Column) -> Column:
                return _let(count(s["counts"], at), lambda n: F.struct(put(s["counts"], at, n + 1).alias("counts"), (s["sum"] + F.get(gain, n)).alias("sum")))

            gone = F.when(i > window, _let(place(F.get(chars, i - 1 - window)), leave)).otherwise(F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum")))
            both = _let(gone, lambda s: _let(place(F.get(chars, i - 1)), lambda at: come(s, at)))

            def close(s: Column) -> Column:
                hot = (i >= window) & (F.lit(math.log2(window)) - s["sum"] / window >= bits)
                first = F.when((acc["first"] == 0) & hot, i - window + 1).otherwise(acc["first"])
                return F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), first.cast("int").alias("first"), F.when(hot, i).otherwise(acc["last"]).cast("int").alias("last"))

            return _let(both, close)

        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), begin, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return _let(F.split(candidate, ""), lambda chars: _let(bits, lambda b: _let(gain, lambda g: fold(chars, b, g))))


def _narrowed(spans: Column) -> Column:
    """From candidates with their places, those with hot windows, narrowed to them."""

    def narrow(x: Column) -> Column:
        def of(hot: Column) -> Column:
            start, end = (x["start"] + hot["first"] - 1).cast("int"), (x["start"] + hot["last"]).cast("int")
            inner = F.substring(x["match"], hot["first"], hot["last"] - hot["first"] + 1)
            return F.when(hot["last"] > 0, F.struct(start.alias("start"), F.lit(3).alias("rank"), end.alias("end"), F.lit("entropy").alias("kind"), inner.alias("match")))

        return _let(_hot_span(x["match"]), of)

    return F.filter(F.transform(spans, narrow), lambda x: x.isNotNull())


def _suspect(x: Column) -> Column:
    """Whether no allow-list pattern fits a match."""
    out = F.lit(True)
    for pattern in ALLOW:
        out = out & ~x["match"].rlike(pattern)
    return out


def secret_scan(df: DataFrame) -> DataFrame:
    """doc_id, base and added spans (arrays of start, rank, end, kind, match) for each row of ``df`` (doc_id, text).

    Null text counts as empty and has no spans. Repeated rows and null ids stay; other columns are ignored; an empty frame
    gives an empty frame. Places are code points, ends exclusive. Texts of any length are scanned whole, in time and memory in
    proportion to them. Base spans are found in the text as it is; for added ones assignments are blanked, then access keys
    and hex strings of the rest. A candidate on the allow list is not scanned, but for parts between marks that are long
    enough and not on the list themselves.
    """
    rows = pick(df, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    long_value = lambda x: F.char_length(x["value"]) >= ASSIGN_LEAST
    base = F.array_sort(F.concat(_placed(text, ASSIGN, 0, long_value, 2), _placed(text, ACCESS, 1), _placed(text, HEX, 2)))
    rows = rows.select("doc_id", base.alias("base"), _blanked(text, ASSIGN, long_value, 2).alias("text"))
    rows = rows.select("doc_id", "base", _blanked(text, KEYS).alias("text"))
    rows = rows.select("doc_id", "base", _placed(text, CANDIDATE, 3, _suspect).alias("whole"), _blanked(text, CANDIDATE, _suspect).alias("text"))
    rows = rows.select("doc_id", "base", F.concat("whole", _placed(text, SEGMENT, 3, _suspect)).alias("runs"))
    return rows.select("doc_id", "base", F.array_sort(_narrowed(F.col("runs"))).alias("added"))


def _say(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_say(F.col("base")), 256).alias("base_sha256"),
        _say(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
