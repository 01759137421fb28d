"""Personal data: fixed shapes, and identifiers found by the contexts that those shapes stand in.

Bootstrapping: spans of the fixed shapes are seeds. The word before and the word after a seed, and both
together, are patterns of its kind. Patterns and the identifier-like strings they surround form a graph,
scored in rounds: a pattern by the mean score of its instances, an instance by the patterns it stands in.
Strings in patterns of high score are personal data that no fixed shape has. All of it is column functions
and joins on the pattern; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from captionloom.llm.common import find_matches, span_text
from captionloom.session import materialize

KINDS = ["email", "ip", "card", "phone", "context"]
#: The shapes every scan reports. Written so that no long run is read again and again.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What may be an identifier: a run with a digit.
RUN = r"A-Za-z0-9._%+@#/-"
CANDIDATE = rf"(?<![{RUN}])(?=[A-Za-z._%+@#/-]*+[0-9])[{RUN}]{{6,}}+"
#: Seeds of different value that a pattern must have; rounds of scoring; scores that count.
SUPPORT = 5
ROUNDS = 3
SURE = 0.7
#: Unseen instances that weigh against a pattern from the start.
DOUBT = 1.0


def find_shapes(docs: DataFrame) -> DataFrame:
    """``docs`` (``text`` and others) with the arrays ``email, ip, card, phone, cand`` (prefixed ``__``) of matches."""
    found = {
        "__email": ("@", EMAIL),
        "__ip": (r"[0-9]\.[0-9]", IP),
        "__card": ("[0-9](?:[ -]?[0-9]){12}", CARD),
        "__phone": (r"\+[0-9]", PHONE),
        "__cand": ("[0-9]", CANDIDATE),
    }
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumns({name: find_matches(text, *patterns) for name, patterns in found.items()})
    valid = {
        "__ip": lambda s: s["value"].rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"),
        "__card": lambda s: _is_card(F.regexp_replace(s["value"], "[^0-9]", "")),
        "__phone": lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(9, 15),
    }
    return df.withColumns({name: F.filter(name, test) for name, test in valid.items()})


def _is_card(digits: Column) -> Column:
    return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)


def _bare(spans: str, kind: str) -> str:
    at = KINDS.index(kind)
    return f"transform({spans}, s -> struct({at} as k, s.start as start, s.end as end, '{kind}' as kind))"


def _context(span: str) -> list[str]:
    """SQL of the word before and the word after a span, digits as 0; empty at the ends of the text."""
    before = rf"regexp_extract({span}.before, '(\\S+)\\s*$', 1)"
    after = rf"regexp_extract({span}.after, '^\\s*(\\S+)', 1)"
    return [f"regexp_replace(lower({x}), '[0-9]', '0')" for x in (before, after)]


def mentions(rows: DataFrame) -> DataFrame:
    """One row per span of ``rows`` (``rid`` and the arrays): ``rid, kind, start, end, value, left, right``.

    Candidates that overlap a fixed shape are left out. They have kind null.
    """
    left, right = _context("s")
    parts = [
        f"transform(__{k}, s -> struct({repr(k) if k != 'cand' else 'cast(null as string)'} as kind, s.start as start, s.end as end,"
        f" lower(s.value) as value, {left} as left, {right} as right))"
        for k in [*KINDS[:4], "cand"]
    ]
    spans = rows.select("rid", F.expr(f"inline(concat({','.join(parts)}))"))
    fixed = F.col("kind").isNotNull()
    up = W.partitionBy("rid").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy("rid").orderBy(F.desc("start"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    reach = spans.withColumn("upto", F.max(F.when(fixed, F.col("end"))).over(up))
    reach = reach.withColumn("next", F.min(F.when(fixed, F.col("start"))).over(down))
    clear = (F.coalesce("upto", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.lit(2**31 - 1)) >= F.col("end"))
    return reach.filter(fixed | clear).drop("upto", "next")


def patterns_of(spans: DataFrame) -> DataFrame:
    """The patterns each span stands in: adds ``pattern``, up to three rows a span."""
    left, right = F.col("left"), F.col("right")
    made = F.array(
        F.when(left != "", F.concat(F.lit("L "), left)),
        F.when(right != "", F.concat(F.lit("R "), right)),
        F.when((left != "") & (right != ""), F.concat(F.lit("B "), left, F.lit(" "), right)),
    )
    return spans.withColumn("pattern", F.explode(F.filter(made, lambda p: p.isNotNull())))


def score_patterns(
    spans: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS, doubt: float = DOUBT
) -> DataFrame:
    """``pattern, kind, score`` of the patterns that at least ``support`` different seeds induce.

    The edges of the graph are distinct pairs of pattern and value, made before any join, so that a
    frequent context costs its different values only.
    """
    edges = materialize(patterns_of(spans).select("pattern", "value", "kind").distinct(), "edges")
    seeds = edges.filter("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    induced = materialize(seeds.filter(F.col("seeds") >= support), "induced")
    other = edges.filter("kind IS NULL").select("pattern", "value")
    unseen = materialize(other.join(induced.select("pattern", "kind"), "pattern"), "unseen")
    foreign = (
        edges.filter("kind IS NOT NULL").groupBy("pattern").agg(F.count("*").alias("every"))
    )
    base = materialize(induced.join(foreign, "pattern"), "base")
    # Seeds of the kind score 1, those of other kinds 0.
    scores = base.select("pattern", "kind", (F.col("seeds") / (F.col("every") + doubt)).alias("score"))
    for _ in range(rounds):
        scores = materialize(scores, "scores")
        instances = unseen.join(scores, ["pattern", "kind"]).groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("belief"), F.count("*").alias("n")
        )
        # One context alone is no more evidence than its own pattern.
        believed = materialize(instances.select("value", "kind", F.when(F.col("n") > 1, F.col("belief")).otherwise(0.0).alias("belief")), "beliefs")
        gained = unseen.join(believed, ["value", "kind"]).groupBy("pattern", "kind").agg(
            F.sum("belief").alias("sum"), F.count("*").alias("unseen")
        )
        rated = (F.col("seeds") + F.coalesce("sum", F.lit(0.0))) / (
            F.col("every") + F.coalesce("unseen", F.lit(0)) + doubt
        )
        scores = base.join(gained, ["pattern", "kind"], "left").select("pattern", "kind", rated.alias("score"))
    return materialize(scores, "scores")


def find_personal(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id, base, more``; arrays of ``k, start, end, kind``, sorted.

    ``more`` are identifiers in patterns that score ``sure`` or more. Null text is empty. Positions are
    code points, end exclusive.
    """
    shapes = find_shapes(docs.select("doc_id", "text")).drop("text").withColumn("rid", F.monotonically_increasing_id())
    # Numbered and written in one pass: from here on no text is read, and numbers stay.
    rows = materialize(shapes, "shapes")
    spans = materialize(mentions(rows.drop("doc_id")), "mentions")
    good = score_patterns(spans).filter(F.col("score") >= sure).select("pattern").distinct()
    good = materialize(good, "good")
    unseen = patterns_of(spans.filter("kind IS NULL"))
    found = unseen.join(good, "pattern").select("rid", "start", "end").distinct()
    at = F.struct(F.lit(4).alias("k"), "start", "end", F.lit("context").alias("kind"))
    more = materialize(found.groupBy("rid").agg(F.array_sort(F.collect_list(at)).alias("more")), "more")
    base = ",".join(_bare(f"__{k}", k) for k in KINDS[:4])
    none = F.expr("cast(array() as array<struct<k:int,start:int,end:int,kind:string>>)")
    slim = rows.select("rid", "doc_id", F.expr(f"array_sort(concat({base}))").alias("base"))
    return slim.join(more, "rid", "left").select("doc_id", "base", F.coalesce("more", none).alias("more"))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and ``n_context`` of every row."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_personal(docs).select(
        "doc_id",
        *[count(k) for k in KINDS[:4]],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_context"),
    )
