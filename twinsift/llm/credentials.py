"""Secret scans with linking of credentials that come in several parts.

Strong patterns are reported where they stand. Weak ones, which clean texts
have as well, are candidates: account identifiers, opaque values, endpoints.
They are reported only where complementary parts start in one scope, a
distance in characters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

# The base patterns, and by which group of what least length a match counts.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
ACCESS = (r"AKIA[A-Z0-9]+", 0, 20)
HEX = (r"[0-9a-f]{24,}", 0, 24)
# Weak candidates: identifier of an account, opaque value, endpoint.
IDENTIFIER = (r"""\b(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 1, 3)
OPAQUE = (r"\b[A-Za-z0-9+/_-]{20,}", 0, 20)
ENDPOINT = (r"\b(?:https?|postgres(?:ql)?|mysql|redis|mongodb|amqp|s3|ftp)://[^\x20\x09-\x0D\"'<>]+", 0, 8)

KINDS = ["assign", "access", "hex", "identifier", "opaque", "endpoint"]
#: What a match has to have besides; tested on the match, so that a long run is walked once.
NEEDS = {"opaque": ["[0-9]", "[A-Z]", "[a-z]"]}
_PATTERNS = [ASSIGN, ACCESS, HEX, IDENTIFIER, OPAQUE, ENDPOINT]
#: Which other kinds make a weak kind a finding: an identifier or endpoint with
#: a secret value beside it, a value with the identifier it belongs to or with
#: an endpoint to use it at.
COMPLEMENTS = {
    "identifier": ["assign", "hex", "opaque"], "opaque": ["access", "identifier", "endpoint"],
    "endpoint": ["assign", "access", "opaque"],
}
_SPANS = "array<struct<start:int,kind_no:int,end:int>>"
_STRONG = 3                 # kinds below are strong
_BLOCK = 256


def with_running(df: DataFrame, values: str, out: str, zero: Column, op: Callable[[Column, Column], Column]) -> DataFrame:
    """Add ``out``: for each element of the array ``values``, ``op`` over those before it.

    A fold that appends copies its array each time. So values are taken in
    blocks of ``_BLOCK``: one fold over the blocks, one in each of them.
    """
    none = F.array().cast("array<int>")
    blocks = F.sequence(F.lit(0), F.ceil(F.size(values) / _BLOCK).cast("int") - 1)
    block = lambda k: F.slice(values, k * _BLOCK + 1, _BLOCK)

    def append(s: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    first = F.struct(zero.alias("at"), none.alias("out"))
    begins = F.aggregate(blocks, first, lambda s, k: append(s, F.aggregate(block(k), s["at"], op)), lambda s: s["out"])
    inside = F.transform(blocks, lambda k: F.aggregate(
        block(k), F.struct(F.get("_begins", k).alias("at"), none.alias("out")), lambda s, x: append(s, op(s["at"], x)), lambda s: s["out"]))
    # Named twice, the begins are a column of their own and not computed per block.
    return df.withColumn("_begins", F.when(F.size(values) > 0, begins)).withColumn(
        out, F.when(F.size("_begins") > 0, F.flatten(inside)).otherwise(none)).drop("_begins")


def pattern_spans(matches: Column, gaps: Column, before: Column, pattern: str, group: int, least: int, kind_no: int) -> Column:
    """Code-point spans of the matches, leftmost and non-overlapping.

    ``matches`` are the whole matches, ``gaps`` what stands between them, from
    splitting at the same pattern, ``before`` the characters before each gap.
    All have to be columns, not expressions, which would be computed per match.
    Matches whose group is shorter than ``least`` or that lack what the kind
    needs are dropped at the end.
    """
    def span(m: Column, i: Column) -> Column:
        start = F.get(before, i) + F.length(F.get(gaps, i))
        counts = F.length(F.regexp_extract(m, pattern, group)) >= least
        for needed in NEEDS.get(KINDS[kind_no], []):
            counts = counts & m.rlike(needed)
        return F.when(counts, F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), (start + F.length(m)).alias("end")))

    # ``before`` is named twice, or it would be computed again for every match.
    return F.when(F.size(before) > 0, F.filter(F.transform(matches, span), lambda x: x.isNotNull())).otherwise(F.array().cast(_SPANS))


def _linked(spans: Column, scope: int) -> Column:
    """Drop weak spans without a complementary part that starts within ``scope`` characters.

    Spans are sorted by their start. Those of one kind do not overlap and have
    eight characters at least, so at most ``near`` starts lie within reach on
    either side: the interval join looks at that many neighbours and misses
    nothing, and takes time in proportion to the spans.
    """
    near = len(KINDS) * (scope // 8 + 2)

    def stays(p: Column, i: Column) -> Column:
        beside = F.slice(spans, F.greatest(i - near + 1, F.lit(1)), 2 * near + 1)

        def completes(kinds: Sequence[str]) -> Column:
            numbers = [KINDS.index(k) for k in kinds]
            return F.exists(beside, lambda q: q["kind_no"].isin(numbers) & (
                F.abs(q["start"] - p["start"]) <= scope))

        weak = F.lit(True)
        for kind, others in COMPLEMENTS.items():
            weak = F.when(p["kind_no"] == KINDS.index(kind), completes(others)).otherwise(weak)
        return weak

    return F.filter(spans, stays)


def secret_spans(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", scope: int = 160) -> DataFrame:
    """The ``keep`` columns of every row and ``found``: array of (start, kind_no, end).

    Positions are code points, end exclusive; ``KINDS[kind_no]`` names the kind.
    Strong kinds are always there. Weak ones are there if a complementary part
    starts at most ``scope`` characters before or after their start. A weak span equal to or inside a
    strong one is the strong one's part and not reported again.

    Null and empty texts have no spans; repeated rows are scanned each; an
    empty table gives no rows. Columns not in ``keep`` are left out.
    """
    step = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), text_of(text_col).alias("_text"))
    for k, (pattern, _, _) in enumerate(_PATTERNS):
        step = step.withColumn(f"_m{k}", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    for k, (pattern, _, _) in enumerate(_PATTERNS):
        step = step.withColumn(f"_g{k}", F.when(F.size(f"_m{k}") > 0, F.split("_text", pattern, -1)))
    spans = []
    for k, (pattern, group, least) in enumerate(_PATTERNS):
        step = step.withColumn(f"_l{k}", F.transform(f"_m{k}", lambda m, i: F.length(m) + F.length(F.get(f"_g{k}", i))))
        step = with_running(step, f"_l{k}", f"_b{k}", F.lit(0), lambda x, y: x + y)
        spans.append(pattern_spans(F.col(f"_m{k}"), F.col(f"_g{k}"), F.col(f"_b{k}"), pattern, group, least, k))
    # By start, and strong kinds first: a weak span is a strong one's part if these reach its end.
    step = step.select("_row", F.sort_array(F.concat(*spans)).cast(_SPANS).alias("_every"))
    step = step.withColumn("_weak", F.filter("_every", lambda x: x["kind_no"] >= _STRONG))
    step = step.withColumn("_ends", F.when(F.size("_weak") > 0, F.transform(
        "_every", lambda x: F.when(x["kind_no"] < _STRONG, x["end"]).otherwise(0))).otherwise(F.array().cast("array<int>")))
    step = with_running(step, "_ends", "_reach", F.lit(0), lambda x, y: F.greatest(x, y))
    every = F.when((F.size("_weak") > 0) & (F.size("_reach") > 0), F.filter("_every", lambda x, i: (
        x["kind_no"] < _STRONG) | (F.get("_reach", i) < x["end"]))).otherwise(F.col("_every"))
    step = step.withColumn("_all", every)
    return step.select("_row.*", F.when(F.size("_weak") > 0, _linked(F.col("_all"), scope)).otherwise(
        F.col("_all")).alias("found"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", scope: int = 160, mark: str = "[SECRET]") -> DataFrame:
    """Rows with ``mark`` in place of each found span; other columns pass through.

    Overlapping spans are covered by one mark. A null text stays null. Other
    columns pass through, whatever their names.
    """
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_given"), F.col(text_col).cast("string").alias("_shown"))
    found = secret_spans(given, ["_given", "_shown"], "_shown", scope)
    found = found.withColumn("_ends", F.transform("found", lambda p: p["end"])).withColumn(
        "_chars", F.when(F.size("found") > 0, F.split("_shown", "")))
    found = with_running(found, "_ends", "_reach", F.lit(0), lambda x, y: F.greatest(x, y))
    part = lambda low, size: F.array_join(F.slice("_chars", low + 1, size), "")
    pieces = F.transform("found", lambda p, i: F.when(p["start"] >= F.get("_reach", i), F.concat(
        part(F.get("_reach", i), p["start"] - F.get("_reach", i)), F.lit(mark))).otherwise(""))
    end = F.array_max("_ends")
    clean = F.concat(F.array_join(pieces, ""), part(end, F.greatest(F.size("_chars") - end, F.lit(0))))
    text = F.when(F.size("found") > 0, clean).otherwise(F.col("_shown"))
    return found.select(*[text.alias(c) if c == text_col else F.col("_given")[c].alias(c) for c in docs.columns])
