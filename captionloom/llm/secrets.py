"""Secret scans: known shapes, and strings whose sliding-window entropy is too high for language.

All of it is column functions over one pass of the texts, without an exchange. A candidate is a run of
base64 letters, or what is left of it between the marks of the allow-list; a path is cut into its segments. Its
window's entropy per character class is kept up by the count of the character that enters and of the one that leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import find_matches, let, span_text

WINDOW = 20
#: Least entropy of some window, in bits per character, by class.
HEX_BITS = 2.9
BASE64_BITS = 3.7
LETTER_BITS = 3.9
#: The shapes every scan reports.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GATE = "(?i)password|passwd|secret|token|api_?key"
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
LEAST_SECRET = 12
KINDS = ["assign", "access", "hex", "entropy"]
RUN = r"A-Za-z0-9+/_-"
CANDIDATE = f"[{RUN}]{{{WINDOW},}}+"
#: Runs that are not secret as a whole: the documented sample key.
ALLOWED_RUN = "EXAMPLEKEY$"
#: What looks random inside a run but is not secret, and the length of each: sample marks, runs of the alphabet. A
#: mark takes itself out of a run, not what stands beside it.
MARKS = (("EXAMPLE", 7), ("(?i)0123456789|abcdefghij|1234567890", 10))
#: Runs that are paths; their segments are candidates of their own.
PATH = "^([a-z0-9_-]*/){3,}"
#: Candidates that are not secret: UUIDs, and numbers without a letter.
ALLOWED = ("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "^[0-9+/_-]+$")
HEX_LETTERS = "0123456789abcdef"
BASE64_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"


def peak_entropy(value: Column, letters: str, window: int = WINDOW) -> Column:
    """Largest entropy of a window over the string ``value``, all of whose characters are in ``letters``.

    With the sum of c log2 c over the counts c, entropy is log2(window) less that sum over the window.
    A step changes two counts and two terms of the sum.
    """
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    start = F.struct(
        F.array_repeat(F.lit(0), len(letters)).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(0.0).alias("most"),
        F.lit(0).alias("at"),
    )

    def walk(spots: Column) -> Column:
        def step(st: Column, add: Column) -> Column:
            lost = F.when(st["at"] >= window, spots[st["at"] - window]).otherwise(F.lit(0))

            def moved(lost: Column) -> Column:
                more, less = F.element_at(st["counts"], add), F.element_at(st["counts"], lost)
                gain = terms[more + 1] - terms[more]
                loss = F.when(lost > 0, terms[less - 1] - terms[less]).otherwise(0.0)
                total = F.when(add == lost, st["total"]).otherwise(st["total"] + gain + loss)
                counts = F.transform(
                    st["counts"],
                    lambda c, k: c + F.when(k + 1 == add, 1).otherwise(0) - F.when(k + 1 == lost, 1).otherwise(0),
                )

                def state(total: Column) -> Column:
                    bits = F.lit(math.log2(window)) - total / window
                    most = F.when(st["at"] >= window - 1, F.greatest(st["most"], bits)).otherwise(st["most"])
                    return F.struct(
                        counts.alias("counts"), total.alias("total"), most.alias("most"), (st["at"] + 1).alias("at")
                    )

                return let(total, state)

            return let(lost, moved)

        return F.aggregate(spots, start, step, lambda st: st["most"])

    return let(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(letters), c)), walk)


def _kept(spans: str, kind: str, test: str = "true") -> str:
    at = KINDS.index(kind)
    return f"transform(filter({spans}, s -> {test}), s -> struct(s.start as start, {at} as k, s.end as end, '{kind}' as kind))"


def pieces(run: Column) -> Column:
    """The candidates in a run: what stands between marks of the allow-list, and between slashes of a path."""
    value = run["value"]
    for mark, length in MARKS:
        value = F.regexp_replace(value, mark, " " * length)
    value = F.when(run["value"].rlike(PATH), F.translate(value, "/", " ")).otherwise(value)
    found = let(value, lambda v: find_matches(v, CANDIDATE, CANDIDATE))
    return F.transform(
        found,
        lambda s: F.struct(
            (run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end"), s["value"].alias("value")
        ),
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` (``text`` and others) with ``__base`` and ``__spans``: arrays of ``start, k, end, kind``, sorted.

    Null text is empty. Positions are code points, end exclusive.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumns(
        {
            "__assign": find_matches(text, ASSIGN_GATE, ASSIGN, 1),
            "__access": find_matches(text, "AKIA", ACCESS),
            "__hex": find_matches(text, HEX, HEX),
            "__cand": find_matches(text, CANDIDATE, CANDIDATE),
        }
    )
    base = ",".join(
        [_kept("__assign", "assign", f"length(s.part) >= {LEAST_SECRET}"), _kept("__access", "access"), _kept("__hex", "hex")]
    )
    df = df.withColumn("__base", F.expr(f"array_sort(concat({base}))"))
    runs = F.filter("__cand", lambda s: ~s["value"].rlike(ALLOWED_RUN))
    df = df.withColumn("__cand", F.flatten(F.transform(runs, pieces)))

    def high(s: Column) -> Column:
        value = s["value"]
        least = F.when(value.rlike("[0-9]"), BASE64_BITS).otherwise(LETTER_BITS)
        is_high = F.when(value.rlike("^[0-9a-fA-F]+$"), peak_entropy(F.lower(value), HEX_LETTERS) >= HEX_BITS).otherwise(
            peak_entropy(value, BASE64_LETTERS) >= least
        )
        return F.when(value.rlike("|".join(ALLOWED)), False).otherwise(is_high)

    df = df.withColumn("__high", F.filter("__cand", high))
    df = df.withColumn("__spans", F.expr(f"array_sort(concat(__base, {_kept('__high', 'entropy')}))"))
    return df.drop("__high", "__cand", *[f"__{k}" for k in KINDS[:3]])


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and ``n_entropy`` of every row."""
    found = find_secrets(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(span_text(F.col("__base")), 256).alias("base_sha256"),
        span_text(F.col("__spans")).alias("spans"),
        count("entropy"),
    )
