"""Secret scanning with linked multipart credentials, in DataFrame expressions alone."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_id

# The base patterns. Matches of the last two are runs of one kind of character, so that a run that is
# too short holds no longer one and the least length can stand in the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: kind: pattern, and the least length of its group 1 if it has one
BASE = {"assign": (ASSIGN, 6), "access": (ACCESS, None), "hex": (HEX, None)}
#: Parts that say little alone: a bare 40-character key, an identifier of temporary or other accounts, an endpoint.
WEAK = {
    "key": (r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=.-])", None),
    "ident": (r"(?<![A-Z0-9])(?:ASIA|AROA|AIDA|AGPA|AIPA|ANPA)[A-Z0-9]{16}(?![A-Z0-9])", None),
    "endpoint": (r"(?i)\b(?:https?|ftp|amqps?|rediss?|mongodb(?:\+srv)?|postgres(?:ql)?|mysql)://[a-z0-9_.:@-]+", None),
}
#: A line that sets one name to a value of a few words, or a comment; a configuration block is a run of them.
LINE = r"""[\x20\t]*+(?:[#;][^\n]*+|(?:(?:export|set)[\x20\t]++|-[\x20\t]++)?+["']?[A-Za-z_][A-Za-z0-9_.-]*+["']?[\x20\t]*+[:=](?:[\x20\t]*+[^\s]++){0,8}+[\x20\t\r]*+)(?:\n|\z)"""
BLOCK = rf"(?<![^\n])(?:{LINE})++"
#: What makes up a credential: an identifier, a secret, a place where they are used.
ROLE = {"assign": "secret", "access": "ident", "hex": "secret", "key": "secret", "ident": "ident", "endpoint": "endpoint"}
KINDS = [*BASE, *WEAK]


def may_hold(kind: str) -> Column:
    """A cheap test of ``text`` and ``low``, the text in lower case, that every text with a match of the kind passes.

    What can be found by a fixed substring is; runs are tried where they begin alone.
    """
    text, low = F.col("text"), F.col("low")
    any_of = lambda col, parts: functools.reduce(Column.__or__, [col.contains(x) for x in parts])
    return {
        "assign": lambda: any_of(low, ["password", "passwd", "secret", "token", "apikey", "api_key"]),
        "access": lambda: text.contains("AKIA"),
        "hex": lambda: text.rlike(r"(?<![0-9a-f])[0-9a-f]{24}"),
        "key": lambda: text.rlike(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/]{40}"),
        "ident": lambda: any_of(text, ["ASIA", "AROA", "AIDA", "AGPA", "AIPA", "ANPA"]),
        "endpoint": lambda: text.contains("://"),
    }[kind]()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def walked(steps: Column) -> Column:
    """(start, end, n) of steps (gap, hit, n), each of which begins where the one before ended.

    Arrays grow by being copied, so running sums over n steps in one fold would copy
    n * n / 2 elements. The steps are cut into about sqrt(n) pieces: a fold over the
    pieces' sums gives their starts, and one fold in each piece the rest.
    """
    none = F.array().cast("array<struct<start:int,end:int,n:int>>")

    def piece(at: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(at.alias("at"), none.alias("out")),
            lambda s, x: let(
                s["at"] + x["gap"], lambda start: F.struct((start + x["hit"]).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), (start + x["hit"]).alias("end"), x["n"].alias("n")))).alias("out"))
            ),
            lambda s: s["out"],
        )

    def over(pieces: Column) -> Column:
        sums = F.transform(pieces, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["gap"] + x["hit"]))
        starts = F.aggregate(
            sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"]
        )
        return F.flatten(F.zip_with(starts, pieces, piece))

    def cut(steps: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(steps))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(steps) - 1) / size), F.lit(0)).cast("int")), lambda k: F.slice(steps, k * size + 1, size))

    return let(steps, lambda held: let(cut(held), over))


def matches(text: Column, pattern: str, least: int | None = None) -> Column:
    """(start, end) of all leftmost non-overlapping matches, in code points; with ``least``, of those whose group 1 has so many.

    ``\\G`` ties each match to the end of the one before, so that the gap and the
    match of every step come out in order and their lengths add up to positions.
    """
    stepped = F.lit(rf"\G(?s:(.*?))({pattern})")
    gaps, hits = (F.transform(F.regexp_extract_all(text, stepped, F.lit(i)), F.length) for i in (1, 2))
    steps = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"), F.lit(0).alias("n")))
    if least:
        values = F.transform(F.regexp_extract_all(text, stepped, F.lit(3)), F.length)
        steps = F.zip_with(steps, values, lambda s, n: F.struct(s["gap"].alias("gap"), s["hit"].alias("hit"), n.alias("n")))
    return F.filter(walked(steps), lambda s: s["n"] >= (least or 0))


def spans_of(kind: str, pattern: str, least: int | None) -> Column:
    """The matches of a kind as (start, kind number, end)."""
    found = F.transform(matches(F.col("text"), pattern, least), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))
    return F.when(may_hold(kind), found).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """Find secrets in whole texts, and link the parts of multipart credentials.

    Base patterns are always reported. Weak parts (a bare key, an identifier, an
    endpoint) are reported only if a part of another role lies within ``scope``
    characters in the same text: an endpoint needs an identifier or secret beside
    it, a bare key an identifier or endpoint, an identifier a secret or endpoint.
    So any two parts of different roles support each other, weak or not. Parts of
    one configuration block (lines ``name = value`` or ``name: value`` and comments
    without a blank line or section header between them) do so at any distance.

    Parts are binned by ``scope``: an interval join on (row, bin) meets parts of
    the same or a neighbouring bin and reduces to "has a partner", so no pairs are
    listed; a bin holds few parts since each takes eight characters or more. Of a
    block three roles with their outermost positions are enough. Texts
    are read once; what is joined are positions in texts with weak parts.

    Returns per input row: row_id, ``id_col`` (long), ``base`` and ``spans``, arrays
    of (start, kind number in KINDS, end) sorted by start, then kind. Null text is
    empty; repeated rows give repeated results; an empty table an empty result;
    texts of any length are searched whole; other columns are not read.
    """
    docs = df.select(row_id().alias("row_id"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("low", F.lower("text"))
    base = F.array_sort(F.concat(*[spans_of(k, *BASE[k]) for k in BASE]))
    weak = F.array_sort(F.concat(*[spans_of(k, *WEAK[k]) for k in WEAK]))
    blocks = F.transform(matches(F.col("text"), BLOCK), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    blocks = F.when(functools.reduce(Column.__or__, [may_hold(k) for k in WEAK]), blocks).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    found = materialize(docs.select("row_id", "id", base.alias("base"), weak.alias("weak"), blocks.alias("blocks")), "secret-spans")
    busy = found.where(F.size("weak") > 0)
    part = busy.select("row_id", F.explode(F.concat("base", "weak")).alias("p")).select("row_id", "p.*")
    roles = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    part = part.withColumn("role", F.element_at(roles, F.col("kind") + 1))
    # a part covers the bins from its start less the scope to its end, a partner stands in the bin of its start
    left = part.where(F.col("kind") >= len(BASE)).withColumn("bin", F.explode(F.expr(f"sequence(cast(floor((start - {scope}) / {scope}) as int), cast(floor((end + {scope}) / {scope}) as int))")))
    right = part.select(
        F.col("row_id").alias("r"), F.explode(F.expr(f"sequence(cast(floor(start / {scope}) as int), cast(floor((end - 1) / {scope}) as int))")).alias("b"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("o")
    )
    near = (F.col("s") <= F.col("end") + scope) & (F.col("e") >= F.col("start") - scope)
    apart = (F.col("e") <= F.col("start")) | (F.col("s") >= F.col("end"))
    other = F.col("o") != F.col("role")
    linked = left.join(right, (F.col("row_id") == F.col("r")) & (F.col("bin") == F.col("b")) & near & apart & other, "left_semi")
    columns = ["row_id", "start", "kind", "end"]
    block = busy.select("row_id", F.explode("blocks").alias("s")).select("row_id", "s.start", F.lit(None).cast("int").alias("kind"), "s.end", F.lit(None).cast("string").alias("role"))
    before = Window.partitionBy("row_id").orderBy("start", F.col("kind").isNotNull())
    last = lambda c: F.last(F.when(F.col("kind").isNull(), F.col(c)), ignorenulls=True).over(before)
    placed = part.select(*columns, "role").unionByName(block).withColumns({"block": last("start"), "stop": last("end")})
    placed = placed.where(F.col("kind").isNotNull() & (F.col("end") <= F.col("stop")))
    roles_of = placed.groupBy(F.col("row_id").alias("r"), F.col("block").alias("b"), F.col("role").alias("o")).agg(F.min("end").alias("e"), F.max("start").alias("s"))
    inside = placed.where(F.col("kind") >= len(BASE)).join(roles_of, (F.col("row_id") == F.col("r")) & (F.col("block") == F.col("b")) & apart & other, "left_semi")
    linked = linked.select(*columns).unionByName(inside.select(*columns)).select("row_id", F.struct("start", "kind", "end").alias("p")).groupBy("row_id").agg(F.collect_set("p").alias("linked"))
    joined = found.join(linked.withColumnRenamed("row_id", "r"), F.col("row_id") == F.col("r"), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return joined.select("row_id", F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", F.coalesce("linked", none))).alias("spans"))
