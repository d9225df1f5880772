"""Secrets in texts, in DataFrame functions only: fixed patterns, and runs of high entropy.

Positions come from the lengths of what lies between matches: one pattern takes the gap before each match lazily and
the match, or the end of the text, so that scanning stays linear and no character is set aside as a delimiter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolith.llm.common import bound

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character that a window must reach, by the narrowest class its candidate fits: of WINDOW characters at most log2(20) = 4.3.
CLASSES = (("^[0-9A-Fa-f]+$", 3.0), ("^[A-Za-z]+$", 4.1), ("^[0-9A-Za-z]+$", 3.6), ("", 3.7))
#: Candidates never reported: without letters, UUIDs, placeholders. None of the patterns repeats a group without bound, which would recurse.
ALLOWED = (r"^[^A-Za-z]*$", r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$", r"(?i)(example|sample|dummy|placeholder|changeme|x{6})")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPANS = "array<struct<s:int,e:int,t:string>>"
#: Counts below 32 that one long holds, matches appended to one array before a new one begins.
_PACKED, _CHUNK = 12, 256


def _rows(text: Column, pattern: str, value_group: int = 0) -> Column:
    """The text as (g, h, v): what lies before each match, the match, its value group; the last h is empty."""
    whole = F.lit(rf"(?s)(.*?)({pattern}|\z)")
    part = lambda i: F.regexp_extract_all(text, whole, F.lit(i))
    return F.arrays_zip(part(1).alias("g"), part(2).alias("h"), part(2 + value_group).alias("v")) if value_group else F.arrays_zip(part(1).alias("g"), part(2).alias("h"))


def spans(text: Column, pattern: str, value_group: int = 0, least: int = 1) -> Column:
    """Leftmost non-overlapping matches as (s, e, t): start, end exclusive, text; only those whose value group has least characters.

    An append copies its array, so matches are appended to short arrays, and these to one: time stays near the number of matches.
    """
    value = "v" if value_group else "h"

    def step(a: Column, x: Column) -> Column:
        start = a["p"] + F.length(x["g"])
        end = start + F.length(x["h"])
        kept = F.array_append(a["o"], F.struct(start.alias("s"), end.alias("e"), x["h"].alias("t")))
        return F.struct(end.alias("p"), F.when((x["h"] != "") & (F.length(x[value]) >= least), kept).otherwise(a["o"]).alias("o"))

    def found(rows: Column) -> Column:
        def some(a: Column, i: Column) -> Column:
            none = F.struct(a["p"].alias("p"), F.array().cast(_SPANS).alias("o"))
            return bound(F.aggregate(F.slice(rows, i, _CHUNK), none, step), lambda c: F.struct(c["p"].alias("p"), F.array_append(a["o"], c["o"]).alias("o")))

        none = F.struct(F.lit(0).alias("p"), F.array().cast(f"array<{_SPANS}>").alias("o"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(_CHUNK)), none, some, lambda a: F.flatten(a["o"]))

    return F.when(text.rlike(pattern), bound(_rows(text, pattern, value_group), found)).otherwise(F.array().cast(_SPANS))


def blanked(text: Column, pattern: str, value_group: int = 0, least: int = 1) -> Column:
    """text with as many blanks in place of each match whose value group has least characters."""
    value = "v" if value_group else "h"
    piece = lambda x: F.concat(x["g"], F.when(F.length(x[value]) >= least, F.repeat(F.lit(" "), F.length(x["h"]))).otherwise(x["h"]))
    return F.when(text.rlike(pattern), F.array_join(F.transform(_rows(text, pattern, value_group), piece), "")).otherwise(text)


def entropy_span(run: Column, bits: Column, width: int = WINDOW) -> Column:
    """(a, z): from the first to the last window of width characters in run whose Shannon entropy reaches bits; a is null without one.

    Counts change by one character in and one out; sum(c * log2 c) over the counts changes with them. Counts are kept
    _PACKED to a long, and the run's character numbers and bits are bound once, so a step costs the same in a run of any length.
    """
    cost = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    longs = -(-(len(_ALPHABET) + 1) // _PACKED)
    unit = F.array(*[F.lit(1 << 5 * k) for k in range(_PACKED)]).cast("array<bigint>")

    def walk(given: Column) -> Column:
        codes, least = given["codes"], given["least"]
        word = lambda c: F.floor(c / _PACKED).cast("int")
        one = lambda c: F.element_at(unit, (c % _PACKED + 1).cast("int"))
        held = lambda n, c: F.floor(F.element_at(n, word(c) + 1) / one(c)).cast("long").bitwiseAND(F.lit(31)).cast("int")
        at = lambda c: F.element_at(cost, c + 1)

        def step(a: Column, i: Column) -> Column:
            full = i > width
            come, gone = F.element_at(codes, i), F.element_at(codes, F.greatest(i - width, F.lit(1)))
            n = held(a["n"], come)
            m = held(a["n"], gone) + F.when(gone == come, 1).otherwise(0)
            counts = F.transform(a["n"], lambda x, k: x + F.when(k == word(come), one(come)).otherwise(F.lit(0)) - F.when(full & (k == word(gone)), one(gone)).otherwise(F.lit(0)))
            total = a["c"] + at(n + 1) - at(n) + F.when(full, at(F.greatest(m - 1, F.lit(0))) - at(m)).otherwise(0.0)
            high = (i >= width) & (math.log2(width) - total / width >= least - 1e-9)
            return F.struct(counts.alias("n"), total.alias("c"), F.when(high, F.coalesce(a["a"], i - width)).otherwise(a["a"]).alias("a"), F.when(high, i).otherwise(a["z"]).alias("z"))

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0.0).alias("c"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("z"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda a: F.struct(a["a"].alias("a"), a["z"].alias("z")))

    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    return bound(F.struct(codes.alias("codes"), bits.alias("least")), walk)


def _entropy(text: Column) -> Column:
    """Spans of high entropy in candidate runs of what the fixed patterns leave of a text, if they are not allowed."""

    def fits(x: Column) -> Column:
        # runs without a digit are words and paths, but for letters of both cases, which must look random throughout
        own = x["t"].rlike("[0-9]") | (x["t"].rlike("[a-z]") & x["t"].rlike("[A-Z]") & ~x["t"].rlike("[^A-Za-z]"))
        for pattern in ALLOWED:
            own = own & ~x["t"].rlike(pattern)
        return own

    def scored(x: Column) -> Column:
        bits = F.lit(CLASSES[-1][1])
        for pattern, least in reversed(CLASSES[:-1]):
            bits = F.when(x["t"].rlike(pattern), F.lit(least)).otherwise(bits)
        return F.transform(F.array(entropy_span(x["t"], bits)), lambda w: F.struct((x["s"] + w["a"]).alias("s"), (x["s"] + w["z"]).alias("e"), x["t"].alias("t")))

    return F.filter(F.flatten(F.transform(F.filter(spans(text, CANDIDATE), fits), scored)), lambda x: x["s"].isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id and found: all spans (start, kind_no, end, kind, value) by start and kind.

    A null text is empty; empty texts and tables give no spans; repeated rows are scanned each; only these columns are read.
    Texts are scanned whole: time grows with their length, and a run of high entropy may be as long as the text. Spans
    found by entropy lie in what is left when the fixed patterns' spans are taken out one kind after the other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    d = d.select("doc_id", "text", spans(F.col("text"), ASSIGN, 2, 6).alias("k0"), spans(F.col("text"), ACCESS).alias("k1"), spans(F.col("text"), HEX).alias("k2"))
    left = blanked(blanked(blanked(F.col("text"), ASSIGN, 2, 6), ACCESS), HEX)
    d = d.withColumn("left", F.when(F.col("text").rlike(CANDIDATE), left).otherwise(F.lit("")))
    d = d.withColumn("k3", _entropy(F.col("left")))
    kind = lambda i: F.transform(f"k{i}", lambda x: F.struct(x["s"].alias("start"), F.lit(i).alias("kind_no"), x["e"].alias("end"), F.lit(KINDS[i]).alias("kind"), x["t"].alias("value")))
    return d.select("doc_id", F.sort_array(F.concat(*[kind(i) for i in range(4)])).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda i: F.size(F.filter("found", lambda x: x["kind_no"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", *[count(i) for i in range(4)], F.sha2(joined(F.filter("found", lambda x: x["kind_no"] < 3)), 256).alias("base_sha256"), joined("found").alias("spans"))
