"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import whole


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of the base kinds, in the order in which spans at one place are listed.
_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

# Scale of the whole-number entropies, which add up alike in any order.
SCALE = 1_000_000


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``pattern``; a window of ``window`` characters is suspect from ``bits`` of entropy on.

    ``needs``: patterns of which a candidate holds each.
    """

    name: str
    pattern: str
    alphabet: str
    window: int
    bits: float
    needs: tuple[str, ...] = ()


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("entropy_hex", r"[0-9A-F]{20,}", "0123456789ABCDEF", 20, 3.0, (r"[0-9]", r"[A-F]")),
    CharClass(
        "entropy_base64",
        r"[A-Za-z0-9+/_=-]{20,}",
        _UPPER + _UPPER.lower() + "0123456789+/_=-",
        20,
        3.7,
        (r"[0-9]", r"[A-Za-z]"),
    ),
)

# What looks random and is no secret: identifiers, digests with a name, placeholders, runs of the alphabet.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^(sha1|sha256|sha384|sha512|md5)[-=_]",
    r"EXAMPLE|example|PLACEHOLDER|placeholder",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
    r"^[A-Za-z_-]+[0-9]{0,4}$",
)


def weights(window: int) -> list[int]:
    """c * log2(c) for every count c, in whole numbers of 1/SCALE."""
    return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]


def most(window: int, bits: float) -> int:
    """The largest sum of weights that still means ``bits`` of entropy."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _running(values: Column) -> Column:
    """The sum of all earlier values at each place, by the totals of blocks of about the root of their number."""

    def within(v: Column) -> Column:
        wide = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        blocks = F.transform(
            F.sequence(F.lit(0), wide - 1), lambda b: _total(F.slice(v, b * wide + 1, wide))
        )
        return _let(
            F.struct(wide.alias("wide"), blocks.alias("blocks")),
            lambda k: _let(
                F.transform(k["blocks"], lambda x, b: _total(F.slice(k["blocks"], F.lit(1), b))),
                lambda before: F.transform(
                    v,
                    lambda x, i: F.get(before, F.floor(i / k["wide"]).cast("int"))
                    + _total(F.slice(v, i - i % k["wide"] + 1, i % k["wide"])),
                ),
            ),
        )

    return F.when(F.size(values) > 0, _let(values, within)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, stop, kind, string), leftmost and without overlap, in code points from 0.

    The strings between the matches and the matches themselves give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,stop:int,string:string>>")
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))
    sizes = lambda p: F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["hit"]))
    walk = _let(
        pairs,
        lambda p: F.zip_with(
            p,
            _running(sizes(p)),
            lambda x, at: F.struct(
                (at + F.length(x["gap"])).alias("start"),
                (at + F.length(x["gap"]) + F.length(x["hit"])).alias("stop"),
                x["hit"].alias("string"),
            ),
        ),
    )
    walk = walk if keep is None else F.filter(walk, keep)
    return F.when(text.rlike(pattern), walk).otherwise(empty)


def _suspect(string: Column, c: CharClass) -> Column:
    """Array of (first, last) windows of a candidate, runs of suspect ones merged.

    One step of the window changes two counts and the two terms of the sum that belong to them.
    """
    table = F.array(*[F.lit(w).cast("long") for w in weights(c.window)])
    zeros = F.array_repeat(F.lit(0), len(c.alphabet))

    def code(i: Column) -> Column:
        return F.instr(F.lit(c.alphabet), F.substring(string, i, 1))

    def term(n: Column) -> Column:
        return F.get(table, n)

    def step(a: Column, i: Column) -> Column:
        enters, leaves = code(i), F.when(i > c.window, code(i - c.window)).otherwise(F.lit(0))
        n_in = F.get(a["counts"], enters - 1)
        n_out = F.get(a["counts"], leaves - 1)
        moved = F.when(
            leaves == enters, F.lit(0).cast("long")
        ).otherwise(
            term(n_in + 1)
            - term(n_in)
            + F.when(leaves > 0, term(n_out - 1) - term(n_out)).otherwise(F.lit(0).cast("long"))
        )
        counts = F.when(leaves == enters, a["counts"]).otherwise(
            F.transform(
                a["counts"],
                lambda n, k: n + F.when(k == enters - 1, 1).when(k == leaves - 1, -1).otherwise(0),
            )
        )
        total = a["total"] + moved
        at = i - c.window
        hot = (at >= 0) & (total <= most(c.window, c.bits))
        last = F.element_at(a["runs"], -1)
        joins = (F.size(a["runs"]) > 0) & F.coalesce(F.try_element_at(a["runs"], F.lit(-1))["last"] == at - 1, F.lit(False))
        one = F.array(F.struct(at.alias("first"), at.alias("last")))
        runs = (
            F.when(~hot, a["runs"])
            .when(
                joins,
                F.concat(
                    F.slice(a["runs"], 1, F.size(a["runs"]) - 1),
                    F.array(F.struct(last["first"].alias("first"), at.alias("last"))),
                ),
            )
            .otherwise(F.concat(a["runs"], one))
        )
        return F.struct(counts.alias("counts"), total.alias("total"), runs.alias("runs"))

    return F.aggregate(
        F.sequence(F.lit(1), F.length(string)),
        F.struct(
            zeros.alias("counts"),
            F.lit(0).cast("long").alias("total"),
            F.array().cast("array<struct<first:int,last:int>>").alias("runs"),
        ),
        step,
        lambda a: a["runs"],
    )


def _candidate(string: Column, c: CharClass) -> Column:
    ok = F.lit(True)
    for need in c.needs:
        ok = ok & string.rlike(need)
    for allowed in ALLOWED:
        ok = ok & ~string.rlike(allowed)
    return ok


def _entropy_spans(text: Column, c: CharClass) -> Column:
    return F.flatten(
        F.transform(
            _spans(text, c.pattern, c.name, lambda x: _candidate(x["string"], c)),
            lambda x: F.transform(
                _suspect(x["string"], c),
                lambda r: F.struct(
                    (x["start"] + r["first"]).alias("start"), (x["start"] + r["last"] + c.window).alias("stop")
                ),
            ),
        )
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``n_assign``, ``n_access``, ``n_hex`` and two arrays of (start, rank, stop, kind),
    ``base`` from the fixed patterns and ``spans`` with those of the entropy windows.

    Null and empty texts hold nothing; texts are read whole; repeated rows repeat their result; other columns are not
    read. Spans of several kinds may overlap: each kind is searched by itself.
    """
    d = docs.select(docs[id_col].alias("id"), whole(docs[text_col]).alias("body"))
    tail = F.length
    d = d.select(
        "id",
        _spans(
            F.col("body"),
            ASSIGN,
            "assign",
            lambda x: tail(F.regexp_extract(x["string"], ASSIGN, 2)) >= ASSIGN_LEAST,
        ).alias("assign"),
        F.when(F.contains("body", F.lit("AKIA")), _spans(F.col("body"), ACCESS, "access"))
        .otherwise(F.array().cast("array<struct<start:int,stop:int,string:string>>"))
        .alias("access"),
        _spans(F.col("body"), HEX, "hex").alias("hex"),
        *[_entropy_spans(F.col("body"), c).alias(c.name) for c in CLASSES],
    )

    def listed(name: str, rank: int) -> Column:
        return F.transform(
            name,
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), F.lit(name).alias("kind")
            ),
        )

    base = F.sort_array(F.concat(*[listed(n, k) for k, n in enumerate(("assign", "access", "hex"))]))
    d = d.withColumn("base", base)
    return d.select(
        F.col("id").alias(id_col),
        *[F.size(n).cast("long").alias(f"n_{n}") for n in ("assign", "access", "hex")],
        "base",
        F.sort_array(F.concat("base", *[listed(c.name, 3 + k) for k, c in enumerate(CLASSES)])).alias("spans"),
    )


def joined(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
