"""Secret scans: patterns, and sliding-window Shannon entropy per character class.

All of it is DataFrame expressions. Matches are found by marking them in the
text and cutting it at the marks; a match's place is the sum of the lengths
before it, taken in blocks so that many matches cost little more than few.
Candidates of a class are runs of its letters. A window of WINDOW letters slides
over each; its counts are a string with one letter per code, of which a step
changes two, and the sum of c log2 c follows by the changed terms alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds that the scan states, with their patterns, in their order.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN), ("access", r"AKIA[A-Z0-9]{12,}"), ("hex", r"[0-9a-f]{32,}"))
LEAST_VALUE = 8

WINDOW = 20
#: Entropy is held in units of 2 ** -SCALE bits, so that sums are whole numbers.
SCALE = 20


@dataclass(frozen=True)
class CharClass:
    """A run of at least WINDOW letters is a candidate; it is kept if a window of it has ``bits`` of entropy or more."""

    name: str
    letters: str
    bits: float


CLASSES = (CharClass("entropy_hex", "0-9A-Fa-f", 3.3), CharClass("entropy_base64", "A-Za-z0-9+/_-", 3.9))

#: Candidates in which one of these is found are no secrets: letters alone, digits and signs alone, one word or number after another, UUIDs, and the keys of documentation.
#: No group is repeated without a bound: the matcher calls itself for each turn of one, and a long candidate would end its stack.
ALLOW = (
    r"^[A-Za-z]+$",
    r"^[0-9+/_-]+$",
    r"^(?![\s\S]*(?:[A-Za-z][0-9]|[0-9][A-Za-z]))[A-Za-z0-9](?:[\s\S]*[A-Za-z0-9])?$",
    r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|x{8}",
)

OPEN, CLOSE, OTHER = "\u0001", "\u0002", "\u0003"
STEP = 256


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def starts(lengths: Column) -> Column:
    """The sum of the lengths before each, in blocks of STEP."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int"))
    part = lambda b: F.slice(lengths, b * STEP + 1, STEP)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    running = lambda a, first: F.aggregate(a, F.array(first), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))
    return let(
        running(F.transform(blocks, lambda b: total(part(b))), F.lit(0)),
        lambda firsts: F.flatten(F.transform(blocks, lambda b: let(part(b), lambda a: F.slice(running(a, firsts[b]), 1, F.size(a))))),
    )


def marked(text: Column, pattern: str) -> Column:
    """The text cut before each match: every piece but the first is a match, CLOSE, and what follows."""
    clean = F.translate(text, OPEN + CLOSE, OTHER + OTHER)
    return F.split(F.regexp_replace(clean, pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1)


def matches(pieces: Column) -> Column:
    """Array of start, end, found from marked(); places in code points."""
    lengths = F.transform(pieces, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))

    def match(p: Column, at: Column) -> Column:
        found = F.substring_index(p, CLOSE, 1)
        return F.struct(at.alias("start"), (at + F.length(found)).alias("end"), found.alias("found"))

    empty = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")
    rest = lambda a: F.slice(a, 2, F.size(a) - 1)
    return F.when(F.size(pieces) < 2, empty).otherwise(let(starts(lengths), lambda s: F.zip_with(rest(pieces), rest(s), match)))


def least_sum(found: Column) -> Column:
    """The least sum of c log2 c over the windows of a string of ASCII letters, in units of 2 ** -SCALE.

    Each letter is two steps: the letter that leaves the window is counted down,
    then the new one up.
    """
    terms = F.array(*[F.lit(round(c * math.log2(c) * 2**SCALE) if c else 0).cast("long") for c in range(WINDOW + 2)])

    def slide(codes: Column) -> Column:
        def step(state: Column, j: Column) -> Column:
            i = (j + 1).cast("int") / 2
            i = F.floor(i).cast("int")
            comes = j % 2 == 0
            place = F.element_at(codes, F.when(comes, i).otherwise(i - WINDOW)) + 1
            change = F.when(comes, 1).otherwise(-1)

            def changed(c: Column) -> Column:
                counts = F.overlay(state["counts"], F.char(c + 48 + change), place)
                total = state["total"] + terms[c + change] - terms[c]
                return F.struct(counts.alias("counts"), total.alias("total"), F.when(comes & (i >= WINDOW), F.least(state["low"], total)).otherwise(state["low"]).alias("low"))

            return F.when(~comes & (i <= WINDOW), state).otherwise(let(F.ascii(F.substring(state["counts"], place, F.lit(1))) - 48, changed))

        none = F.struct(F.lit("0" * 128).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(1 << 62).cast("long").alias("low"))
        return F.aggregate(F.sequence(F.lit(1), 2 * F.size(codes)), none, step)["low"]

    return let(F.transform(F.split(found, ""), lambda c: F.ascii(c)), slide)


def dense(allow: tuple[str, ...], most: int):
    """The test of a candidate: on no allow-list, and a window whose sum is ``most`` or less."""

    def test(m: Column) -> Column:
        listed = F.lit(False)
        for pattern in allow:
            listed = listed | m["found"].rlike(pattern)
        return F.when(listed, False).otherwise(least_sum(m["found"]) <= most)

    return test


def of_kind(k: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"))


def counted(k: int):
    return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")


def spans(docs: DataFrame, text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with ``base`` and ``added``: arrays of start, kind (its place among KINDS, then classes), end, by start, then kind.

    Null texts count as empty, and no text is cut. Places are code points, the
    end exclusive. Rows that repeat are scanned each, and an empty table gives
    no rows. Nothing is shuffled. Columns of docs named base or added are
    replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [c for c in docs.columns if c not in ("base", "added")]
    patterns = [p for _, p in KINDS] + [f"(?<![{c.letters}])[{c.letters}]{{{WINDOW},}}" for c in classes]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.struct(*[marked(text, p).alias(f"p{k}") for k, p in enumerate(patterns)]).alias("_cut"))
    ends = {}
    for k in range(len(patterns)):
        found = matches(F.col(f"_cut.p{k}"))
        if k == 0:
            found = F.filter(found, lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= LEAST_VALUE)
        if k >= len(KINDS):
            kind = classes[k - len(KINDS)]
            most = int((math.log2(WINDOW) - kind.bits) * WINDOW * 2**SCALE)
            found = F.filter(found, dense(allow, most))
        ends[k] = F.transform(found, of_kind(k))
    n = len(KINDS)
    return out.select(*[F.col(f"`{c}`") for c in keep], F.array_sort(F.concat(*[ends[k] for k in range(n)])).alias("base"), F.array_sort(F.concat(*[ends[k] for k in range(n, len(patterns))])).alias("added"))


def said(found: Column, classes: tuple[CharClass, ...] = CLASSES) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(x) for x in [*(k for k, _ in KINDS), *(c.name for c in classes)]])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, the digest of the base spans, and all spans.

    Null and empty texts have no spans and the digest of an empty string; rows
    that repeat, and rows with a null id, give a row each; an empty table gives
    none. Other columns are not carried.
    """
    found = spans(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "base", "added")
    return found.select("doc_id", *[counted(k).alias(f"n_{name}") for k, (name, _) in enumerate(KINDS)], F.sha2(F.encode(said(F.col("base")), "UTF-8"), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", "added"))).alias("spans"))


#: Code points of the pieces that a text is cut into before spans are cut out of it.
PIECE = 1024


def reached(found: Column) -> Column:
    """The largest end of the spans before each, 0 before the first, in blocks of STEP."""
    ends = F.transform(found, lambda s: s["end"])
    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STEP).cast("int"))
    part = lambda b: F.slice(ends, b * STEP + 1, STEP)
    running = lambda a, first: F.aggregate(a, F.array(first), lambda s, x: F.array_append(s, F.greatest(F.element_at(s, -1), x)))
    return let(
        running(F.transform(blocks, lambda b: F.array_max(part(b))), F.lit(0)),
        lambda firsts: F.flatten(F.transform(blocks, lambda b: let(part(b), lambda a: F.slice(running(a, firsts[b]), 1, F.size(a))))),
    )


def between(pieces: Column, a: Column, b: Column) -> Column:
    """The code points from a up to b of a text that is cut into pieces of PIECE; only the pieces at its ends are walked."""
    first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    head = F.coalesce(F.get(pieces, first), F.lit(""))
    tail = F.substring(F.coalesce(F.get(pieces, last), F.lit("")), F.lit(1), b % PIECE)
    inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, F.substring(head, a % PIECE + 1, b - a)).otherwise(F.concat(F.substring(head, a % PIECE + 1, F.lit(PIECE)), inner, tail))


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """docs with every span, base or added, replaced in the text by ``mask``; spans that touch or overlap are one.

    Null texts stay null, empty ones empty; rows that repeat are redacted each,
    and an empty table gives no rows. All other columns stay, whatever their
    names. The time of a text grows with its length and its spans, not with
    their product.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    text = F.col("_text")
    found = spans(rows, "_text").withColumn("_spans", F.array_sort(F.concat("base", "added")))
    some = F.size("_spans") > 0
    found = found.withColumn("_at", F.when(some, F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), reached(F.col("_spans")).alias("reached"))))
    pieces = F.col("_at.pieces")

    def masked(s: Column, a: Column) -> Column:
        # a span that starts beyond all ends before it opens a mask, and so does the first; the others are under one already
        return F.when((s["start"] > a) | (a == 0), F.concat(between(pieces, a, s["start"]), F.lit(mask))).otherwise("")

    end = F.array_max(F.transform("_spans", lambda s: s["end"]))
    new = F.when(some, F.concat(F.array_join(F.zip_with("_spans", "_at.reached", masked), ""), between(pieces, end, F.length(text)))).otherwise(text)
    return found.select(*[(new if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])
