"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Everything is a column expression, so texts stay in the JVM and nothing is shuffled.

Patterns: `split` gives the text between matches and `regexp_extract_all` the matches; running sums of their lengths
are the positions (code points, end exclusive).

Entropy: candidate strings are maximal runs of a class (see CLASSES). A window of `window` characters moves over each
candidate; one step adds the entering character's count and takes off the leaving one's, and the sum of c * log2(c)
follows by two differences from a table, so a step costs the same however long the window. Counts are held in a few
bits each, a dozen to a number. With S that sum, the entropy of a window of w characters is log2(w) - S / w. Windows at or above the class's threshold are joined into spans.
Candidates that an allow-list pattern matches as a whole (words, paths, dates, fillers) are suppressed, and so are
spans that lie within a pattern's match. A filler such as `example` doesn't clear the whole of its run: what stands
before, between and after fillers has to be words, numbers or shorter than a window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Patterns in the order in which kinds are listed; equal starts sort by it.
BASE = ("assign", "access", "hex")
_PATTERN = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    pattern: str  # maximal runs of `window` characters or more
    alphabet: str  # characters beyond it count as one
    window: int
    bits: float


CLASSES = (
    CharacterClass("entropy_base64", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.8),
    CharacterClass("entropy_hex", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}", "0123456789abcdefABCDEF", 20, 2.9),
)
_FILLER = r"(?i:example|placeholder|changeme|your[_-]?key|xxxx)"
#: What may stand between fillers: words, numbers, or less than a window. Possessive, so time is linear and the stack flat.
_BESIDE = "|".join(rf"(?:(?!{_FILLER}){c}(?={_FILLER}|$)" for c in (r"[A-Za-z_=/-])*+", r"[0-9_=/+-])*+", r".){0,19}+"))
#: A candidate that one of these matches as a whole is no secret.
ALLOWED = (
    # words, paths and identifiers without digits; letters of either case without order are none
    r"(?:(?:[A-Z][a-z])?(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)|(?<![A-Za-z])[A-Za-z][a-z]?(?![A-Za-z])|[_=/-]++)++",
    r"[0-9_=/+-]+",  # numbers, dates and rules
    rf"(?:(?:{_BESIDE}){_FILLER})++(?:{_BESIDE})",  # fillers, with no room for a secret beside them
)


#: Arrays of up to so many elements are folded one by one.
FEW = 64
#: Steps of the entropy fold that share one list of runs; longer candidates are folded in blocks of so many.
BLOCK = 4096
#: Code points of a piece of text from which redaction takes its parts.
PAGE = 4096


def _running(values: Column, join, levels: int = 3) -> Column:
    """Running totals of an array of ints under `join` (a sum or a maximum). A fold that appends copies its list at every
    step, so lists are folded in blocks of FEW, what the blocks come to likewise, and added to the next blocks."""

    def fold(a: Column) -> Column:
        start = F.array().cast("array<int>")
        return F.aggregate(a, start, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, join(x, F.get(acc, F.size(acc) - 1))).otherwise(x))))

    def in_blocks(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(FEW)), lambda at: fold(F.slice(a, at + 1, FEW)))
        return _bound(blocks, lambda bs: _bound(_running(F.transform(bs, lambda x: F.element_at(x, -1)), join, levels - 1), partial(ahead, bs)))

    def ahead(blocks: Column, before: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: join(x, F.get(before, i - 1))))))

    return _bound(values, lambda v: F.when(F.size(v) <= FEW, fold(v)).otherwise(in_blocks(v))) if levels else fold(values)


def _bound(value: Column, make) -> Column:
    """make(value), with the value computed once."""
    return F.get(F.transform(F.array(value), lambda v: make(v)), 0)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _positions(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, s): the leftmost matches that don't overlap."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.filter(F.arrays_zip(pieces.alias("p"), matches.alias("m")), lambda x: x["m"].isNotNull())

    def placed(found: Column) -> Column:
        ends = _running(F.transform(found, lambda x: F.length(x["p"]) + F.length(x["m"])), _sum)
        return F.zip_with(found, ends, lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("s")))

    nothing = F.array().cast("array<struct<start:int,end:int,s:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), _bound(pairs, placed)).otherwise(nothing)


def _spans(kind: str, order: int, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _entropy_runs(candidate: Column, c: CharacterClass) -> Column:
    """Array of (start, end) within the candidate: joined windows whose entropy reaches the threshold."""
    bits = c.window.bit_length()
    each = 63 // bits  # counts in a number
    numbers = len(c.alphabet) // each + 1
    # what the sum of c * log2(c) gains when a count of n - 1 becomes n
    plogp = [n * math.log2(n) if n else 0.0 for n in range(c.window + 2)]
    gain = F.lit([plogp[n] - plogp[n - 1] for n in range(1, c.window + 2)])
    limit = F.lit(c.window * math.log2(c.window) - c.bits * c.window + 1e-9)  # S <= limit
    # a character's number, and where its count lies in it; characters beyond the alphabet share a count
    code = lambda x: F.instr(F.lit(c.alphabet), x)
    at = lambda k: F.struct(F.floor(k / each).cast("int").alias("number"), (k % each * bits).cast("int").alias("shift"))
    chars = F.transform(F.split(candidate, ""), lambda x: at(code(x)))
    nothing = F.struct(F.lit(-1).alias("number"), F.lit(0).alias("shift"))
    begin = F.struct(
        F.array_repeat(F.lit(0).cast("long"), numbers).alias("counts"), F.lit(0.0).cast("double").alias("s"), F.lit(0).alias("n"), F.lit(-1).alias("start"), F.lit(-1).alias("end"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"),
    )

    def step(acc: Column, pair: Column) -> Column:
        enter, leave = pair["enter"], pair["leave"]
        count = lambda k: F.call_function("shiftright", F.element_at(acc["counts"], k["number"] + 1), k["shift"]).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k["shift"])
        less = F.when(leave["number"] >= 0, F.element_at(gain, count(leave) + F.when(enter == leave, 1).otherwise(0)))
        s = acc["s"] + F.element_at(gain, count(enter) + 1) - F.coalesce(less, F.lit(0.0))
        zero = F.lit(0).cast("long")
        counts = F.transform(acc["counts"], lambda x, i: x + F.when(i == enter["number"], one(enter)).otherwise(zero) - F.when(i == leave["number"], one(leave)).otherwise(zero))
        n = acc["n"] + 1
        high = (n >= c.window) & (s <= limit)
        joins = high & (acc["end"] >= n - c.window)
        closed = F.when(high & ~joins & (acc["start"] >= 0), F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"])
        return F.struct(
            counts.alias("counts"), s.alias("s"), n.alias("n"), F.when(joins, acc["start"]).when(high, n - c.window).otherwise(acc["start"]).alias("start"),
            F.when(high, n).otherwise(acc["end"]).alias("end"), closed.alias("out"),
        )

    def runs(entering: Column, at: Column) -> Column:
        """Runs in the block of windows that end with its characters; it starts a window before them, with nothing counted."""
        block = F.slice(entering, F.greatest(at - c.window + 1, F.lit(0)) + 1, BLOCK + c.window - 1 - F.greatest(c.window - 1 - at, F.lit(0)))
        leaving = F.concat(F.array_repeat(nothing, c.window), block)
        steps = F.filter(F.arrays_zip(block.alias("enter"), leaving.alias("leave")), lambda x: x["enter"].isNotNull())
        first = F.greatest(at - c.window + 1, F.lit(0))
        ends = F.aggregate(
            steps, begin, step, lambda acc: F.when(acc["start"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"])
        )
        return F.transform(ends, lambda r: F.struct((r["start"] + first).alias("start"), (r["end"] + first).alias("end")))

    def whole(entering: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(entering) - 1, F.lit(0)), F.lit(BLOCK))
        return _bound(F.flatten(F.transform(places, lambda at: runs(entering, at))), _joined)

    return _bound(chars, whole)


def _joined(runs: Column) -> Column:
    """Runs, sorted by start and by end, of which those that touch become one."""
    n = F.size(runs)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(runs, i)["start"] > F.get(runs, i - 1)["end"]))
    nexts = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n))
    pairs = F.filter(F.arrays_zip(starts.alias("a"), nexts.alias("b")), lambda p: p["a"].isNotNull())
    return F.transform(pairs, lambda p: F.struct(F.get(runs, p["a"])["start"].alias("start"), F.get(runs, p["b"] - 1)["end"].alias("end")))


def _entropy_spans(text: Column, c: CharacterClass, order: int, allowed: tuple[str, ...]) -> Column:
    def within(m: Column) -> Column:
        return F.transform(_entropy_runs(m["s"], c), lambda r: F.struct((m["start"] + r["start"]).alias("start"), F.lit(order).alias("order"), F.lit(c.kind).alias("kind"), (m["start"] + r["end"]).alias("end")))

    whole = "|".join(f"(?:{p})" for p in allowed)
    candidates = F.filter(_positions(text, c.pattern), lambda m: ~m["s"].rlike(f"^(?:{whole})$")) if allowed else _positions(text, c.pattern)
    return F.flatten(F.transform(candidates, within))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, keep_text: bool = False) -> DataFrame:
    """doc_id, base and spans (arrays of start, order, kind, end, sorted) of every row; with `keep_text`, text too.

    Null texts are empty and have no spans. Ids, null or repeated, are passed through; other columns are not read.
    `base` has the pattern matches alone, `spans` those of the method as well."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    assign = F.filter(_positions(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["s"], ASSIGN, 2)) >= 6)
    base = [_spans("assign", 0, assign), *(_spans(k, i, _positions(text, _PATTERN[k])) for i, k in enumerate(BASE[1:], 1))]
    df = df.withColumn("base", F.array_sort(F.concat(*base)))
    more = F.concat(*(_entropy_spans(text, c, len(BASE) + i, allowed) for i, c in enumerate(classes)))
    df = df.withColumn("more", more)
    df = df.withColumn("spans", F.when((F.size("base") == 0) | (F.size("more") == 0), F.array_sort(F.concat("base", "more"))).otherwise(_bound(_by_start(F.col("base"), F.col("more")), _outside)))
    return df.select("doc_id", *(["text"] if keep_text else []), "base", "spans")


def _by_start(base: Column, more: Column) -> Column:
    """Both lists in one order: by start, matches of patterns before spans of the method."""
    tagged = lambda spans, new: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(new).alias("new"), s.alias("span")))
    return F.array_sort(F.concat(tagged(base, False), tagged(more, True)))


def _outside(both: Column) -> Column:
    """All spans but the method's that lie within a pattern's match: one that begins no later and ends no earlier."""
    reach = _running(F.transform(both, lambda x: F.when(x["new"], -1).otherwise(x["span"]["end"])), F.greatest)
    kept = F.filter(F.zip_with(both, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), lambda p: ~p["x"]["new"] | (p["r"] < p["x"]["span"]["end"]))
    return F.array_sort(F.transform(kept, lambda p: p["x"]["span"]))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) from `scan`."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, BASE), F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of spans that overlap, replaced by `mark`.

    What stands between runs is taken from pages of the text, as a position in a long string is found by walking there."""
    ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    lists = F.struct(spans.alias("spans"), ends.alias("ends"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)).alias("pages"))

    def part(pages: Column, a: Column, b: Column) -> Column:
        """Code points a to b; b is null for the end."""
        last = F.floor(F.coalesce(b, F.lit(0)) / PAGE).cast("int")
        first = F.floor(a / PAGE).cast("int")
        head = F.coalesce(F.get(pages, first), F.lit(""))
        whole = F.substring(head, a % PAGE + 1, F.lit(PAGE))
        tail = F.when(b.isNull(), F.array_join(F.slice(pages, first + 2, F.size(pages)), "")).otherwise(F.concat(F.array_join(F.slice(pages, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(pages, last), F.lit("")), F.lit(1), b % PAGE)))
        return F.when(b.isNotNull() & (first == last), F.substring(head, a % PAGE + 1, b - a)).otherwise(F.concat(whole, tail))

    def made(x: Column) -> Column:
        n = F.size(x["spans"])
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(x["spans"], i)["start"] >= F.get(x["ends"], i - 1)))
        # a gap before each run, and one after the last
        gaps = F.transform(F.concat(starts, F.array(n)), lambda i: F.struct(F.when(i == 0, 0).otherwise(F.get(x["ends"], i - 1)).alias("a"), F.when(i < n, F.get(x["spans"], i)["start"]).alias("b")))
        return F.array_join(F.transform(gaps, lambda g: part(x["pages"], g["a"], g["b"])), mark)

    return F.when(F.size(spans) == 0, text).otherwise(_bound(lists, made))
