"""Secret scans: known patterns, and strings of high entropy.

Candidate strings are runs of the characters of a class: hexadecimal digits,
letters of one case with digits, or Base64 with both cases and digits.  A window
slides along each; the counts of its characters are kept up to date, one
character in and one out, and with them the sum of n * log2(n) from which the
Shannon entropy follows.  Windows above the class's threshold are joined to
spans.  Candidates and spans on the allow lists, such as UUIDs and placeholders,
are suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.textsql import let, packed


@dataclass(frozen=True)
class Pattern:
    """A kind of secret: its regular expression, and the least length of one of its groups.

    quick finds a match where there is one of that length.  Without a group (0)
    the two differ in nothing else, and quick is used alone.
    """

    kind: str
    regex: str
    group: int
    least: int
    quick: str


@dataclass(frozen=True)
class EntropyClass:
    """Candidates of a class: strings of `regex` that match `must`, and `mixed` where it is given; symbols are counted by class index."""

    name: str
    regex: str
    must: str
    symbols: str
    window: int
    threshold: float
    mixed: str = ""


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

#: Kinds of secrets.
PATTERNS = (
    Pattern("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12,}"),
    Pattern("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32,}"),
)
CLASSES = (
    EntropyClass("base64", r"[A-Za-z0-9+/_=-]{24,}", r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])", _UPPER + _LOWER + _DIGITS + "+/_=-", 24, 4.0),
    EntropyClass("short", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,23}(?![A-Za-z0-9+/_=-])", r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9].*[0-9])", _UPPER + _LOWER + _DIGITS + "+/_=-", 16, 3.45),
    EntropyClass("lower", r"(?<![A-Za-z0-9])[a-z0-9]{16,}(?![A-Za-z0-9])", r"[g-z]", _LOWER + _DIGITS, 16, 3.3, r"[0-9][a-z]+[0-9]+[a-z]"),
    EntropyClass("upper", r"(?<![A-Za-z0-9])[A-Z0-9]{16,}(?![A-Za-z0-9])", r"[G-Z]", _UPPER + _DIGITS, 16, 3.3, r"[0-9][A-Z]+[0-9]+[A-Z]"),
    EntropyClass("hexadecimal", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])", r"^(?=.*[a-fA-F])(?=.*[0-9])", _DIGITS + "abcdefABCDEF", 24, 3.0),
)
#: Candidates that are no secret.
ALLOWED = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",)
#: Spans of high entropy that are no secret.
ALLOWED_SPANS = (r"(?i)example|sample|placeholder|dummy|changeme|your[_-]", r"(.)\1{7}")

_BLOCK = 128  # positions are summed up within blocks of matches, and over blocks


def _running(sizes: Column) -> Column:
    """Sums of all sizes before each: within blocks and over them, so that no long array is copied at every step."""

    def before(xs: Column) -> Column:
        folded = F.aggregate(
            xs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )
        return folded["out"]

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def blocks(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(_BLOCK))
        return F.transform(starts, lambda i: F.slice(xs, i, _BLOCK))

    def over(cut: Column) -> Column:
        return let(before(F.transform(cut, total)), lambda first: F.flatten(F.transform(cut, lambda xs, i: let(F.get(first, i), lambda f: F.transform(before(xs), lambda a: a + f)))))

    return let(blocks(sizes), over)


def _matches(text: Column, regex: str, group: int) -> Column:
    """(start, end, found) of all matches: code points, the end exclusive, and what the group holds."""
    between = F.split(text, regex, -1)
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(regex), F.lit(group)) if group else whole
    parts = F.struct(F.transform(between, lambda b: F.char_length(b)).alias("skip"), F.transform(whole, lambda w: F.char_length(w)).alias("size"), inner.alias("inner"))

    def placed(x: Column) -> Column:
        sizes = F.transform(x["size"], lambda n, i: n + F.get(x["skip"], i))
        return let(_running(sizes), lambda at: F.transform(
            x["inner"],
            lambda found, i: let(F.get(at, i) + F.get(x["skip"], i), lambda a: F.struct(a.alias("start"), (a + F.get(x["size"], i)).alias("end"), found.alias("found"))),
        ))

    return let(parts, placed)


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _of_pattern(text: Column, p: Pattern) -> Column:
    good = F.filter(_matches(text, p.regex if p.group else p.quick, p.group), lambda m: F.char_length(m["found"]) >= p.least)
    spans = F.transform(good, lambda m: F.struct(F.lit(p.kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    return F.when(text.rlike(p.quick), spans).otherwise(_none())  # most texts hold none


def _nlogn(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _windows(found: Column, c: EntropyClass) -> Column:
    """Spans [start, end) within the string over which the window's entropy is at the threshold or above.

    The counts lie in a few longs, some bits for each symbol, so a step changes
    two of them.
    """
    w, bits = c.window, c.window.bit_length()
    each = 63 // bits  # symbols to a long
    codes = F.transform(F.split(found, "", -1), lambda ch: F.instr(F.lit(c.symbols), ch) - 1)

    def one(code: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(code, F.lit(each)) * bits)

    def count(counts: Column, code: Column) -> Column:
        held = F.get(counts, F.floor(code / each).cast("int"))
        return F.call_function("shiftright", held, F.pmod(code, F.lit(each)) * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")

    def scan(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new = F.get(x, i)
            old = F.when(i >= w, F.get(x, i - w)).otherwise(F.lit(-1))
            n_new, n_old = count(acc["counts"], new), F.when(old >= 0, count(acc["counts"], old)).otherwise(0)
            same = new == old
            total = F.when(same, acc["total"]).otherwise(
                acc["total"] + _nlogn(n_new + 1) - _nlogn(n_new) + F.when(old >= 0, _nlogn(n_old - 1) - _nlogn(n_old)).otherwise(F.lit(0.0))
            )
            place = lambda code: F.floor(code / each).cast("int")
            counts = F.when(same, acc["counts"]).otherwise(
                F.transform(
                    acc["counts"],
                    lambda n, s: n + F.when(s == place(new), one(new)).otherwise(F.lit(0).cast("long")) - F.when((old >= 0) & (s == place(old)), one(old)).otherwise(F.lit(0).cast("long")),
                )
            )
            return F.struct(counts.alias("counts"), total.alias("total"), acc["high"].alias("high"), i.alias("i"))

        def close(acc: Column) -> Column:
            high = (acc["i"] >= w - 1) & (F.log2(F.lit(float(w))) - acc["total"] / w >= c.threshold)
            begin, last = acc["i"] - w + 1, F.element_at(acc["high"], -1)
            out = F.when(~high, acc["high"]).when(
                (F.size(acc["high"]) > 0) & (last["end"] >= begin),
                F.concat(F.slice(acc["high"], F.lit(1), F.size(acc["high"]) - 1), F.array(F.struct(last["start"].alias("start"), (acc["i"] + 1).alias("end")))),
            ).otherwise(F.concat(acc["high"], F.array(F.struct(begin.alias("start"), (acc["i"] + 1).alias("end")))))
            return F.struct(acc["counts"].alias("counts"), acc["total"].alias("total"), out.alias("high"), acc["i"].alias("i"))

        start = F.struct(
            F.array_repeat(F.lit(0).cast("long"), -(-len(c.symbols) // each)).alias("counts"), F.lit(0.0).alias("total"), F.array().cast("array<struct<start:int,end:int>>").alias("high"), F.lit(-1).alias("i")
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), start, lambda acc, i: let(step(acc, i), close), lambda acc: acc["high"])

    return let(F.filter(codes, lambda x: x >= 0), scan)


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (text.rlike(a) for a in patterns), F.lit(False))


def _of_entropy(text: Column, c: EntropyClass, allowed: tuple[str, ...], allowed_spans: tuple[str, ...]) -> Column:
    def wanted(found: Column) -> Column:
        return found.rlike(c.must) & (found.rlike(c.mixed) if c.mixed else F.lit(True)) & ~_any(found, allowed)

    good = F.filter(_matches(text, c.regex, 0), lambda m: wanted(m["found"]))
    spans = F.flatten(
        F.transform(
            good,
            lambda m: F.transform(
                F.filter(_windows(m["found"], c), lambda s: ~_any(F.substring(m["found"], s["start"] + 1, s["end"] - s["start"]), allowed_spans)),
                lambda s: F.struct(F.lit("entropy").alias("kind"), (m["start"] + s["start"]).alias("start"), (m["start"] + s["end"]).alias("end")),
            ),
        )
    )
    return F.when(text.rlike(c.regex), spans).otherwise(_none())


def scan(
    documents: DataFrame,
    text_col: str = "text",
    patterns: tuple[Pattern, ...] = PATTERNS,
    classes: tuple[EntropyClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
    allowed_spans: tuple[str, ...] = ALLOWED_SPANS,
) -> DataFrame:
    """All columns, and base_spans and spans, arrays of (kind, start, end) in code points, the end exclusive.

    base_spans are the patterns' matches, leftmost and not overlapping for each
    kind; spans adds those of kind entropy that do not lie within a base span.
    Both are ordered by start, then by kind as listed with entropy last; of two
    matches of a kind the leftmost counts.  Null and empty texts have none, texts
    of any length are scanned whole, an empty table gives an empty one.  Rows are
    judged one by one, so ids may be null or repeated.  Columns called base_spans
    or spans are replaced; other names are free.
    """
    rows, columns = packed(documents, ("base_spans", "spans"), s_text=text_col)
    text = rows.withColumn("s_text", F.coalesce(F.col("s_text"), F.lit("")))
    found = text.withColumns({f"s_{p.kind}": _of_pattern(F.col("s_text"), p) for p in patterns} | {f"s_{c.name}_e": _of_entropy(F.col("s_text"), c, allowed, allowed_spans) for c in classes})
    order = [p.kind for p in patterns] + ["entropy"]
    base = F.concat(*(F.col(f"s_{p.kind}") for p in patterns))
    high = F.concat(*(F.col(f"s_{c.name}_e") for c in classes)) if classes else _none()
    found = found.withColumns({"base_spans": base, "s_high": F.array_distinct(high)})
    outside = F.filter("s_high", lambda s: ~F.exists("base_spans", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    found = found.withColumn("s_all", F.concat("base_spans", outside))

    def ordered(spans: str) -> Column:
        keyed = F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, order)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
        )
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))

    return found.select(*columns, ordered("base_spans").alias("base_spans"), ordered("s_all").alias("spans"))


def as_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span replaced; overlapping spans are replaced as one.

    spans are ordered by start.  They go in blocks, each over its own piece of
    the text, so that a text with very many of them is not passed for every one.
    """

    def largest(xs: Column) -> Column:
        return F.array_max(F.transform(xs, lambda x: x["end"]))

    def piece(xs: Column, base: Column) -> Column:
        upto = F.greatest(base, largest(xs))

        def fold(own: Column) -> Column:
            done = F.aggregate(
                xs,
                F.struct(base.alias("at"), F.array().cast("array<string>").alias("parts")),
                lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
                    F.struct(
                        s["end"].alias("at"),
                        F.when((s["start"] < acc["at"]) & (acc["at"] > 0), acc["parts"])
                        .otherwise(F.concat(acc["parts"], F.array(F.substring(own, acc["at"] - base + 1, s["start"] - acc["at"]), F.lit(mark)))).alias("parts"),
                    )
                ),
            )
            return F.array_join(done["parts"], "")

        return let(F.substring(text, base + 1, upto - base), fold)

    def over(cut: Column) -> Column:
        ends = F.transform(cut, largest)
        bases = F.transform(cut, lambda xs, i: F.greatest(F.lit(0), F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0))))
        pieces = let(bases, lambda b: F.transform(cut, lambda xs, i: let(F.get(b, i), lambda base: piece(xs, base))))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(ends) + 1, F.char_length(text)))

    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(_BLOCK)), lambda i: F.slice(spans, i, _BLOCK))
    return F.when(F.size(spans) == 0, text).otherwise(let(blocks, over))
