"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Everything here is a DataFrame or SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, keyed, materialize, row_id


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Words wanted of each source: weights over ``share`` of all words, at most ``cap`` times a source.

    ``sources`` has (source, source_size). Sources in code-point order, null last,
    take the weights in turn. With sources sorted by cap/weight, those below the
    common level are full and the others get weight times level, which is the
    largest of the levels that the sorted prefixes leave. Adds ``sid`` (place in
    order), ``weight``, ``target``. One row per source is all that one task sees.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    level = Window.orderBy("full_at", "sid")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("sid", F.row_number().over(order)).withColumn("weight", w)
    ranked = ranked.withColumn("full", F.lit(float(cap)) * F.col("source_size")).withColumn("full_at", F.col("full") / F.col("weight"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    ranked = ranked.withColumn("lev", rest / F.sum("weight").over(after))
    ranked = ranked.withColumn("target", F.least("full", F.col("weight") * F.max("lev").over(all_rows)))
    return ranked.select("source", "sid", "source_size", "weight", "target")


def split(nodes: DataFrame, seed: int) -> DataFrame:
    """Both halves of every node: its blocks dealt to two equal parts, without replacement.

    A node holds ``blocks`` = array of (sid, quota). Each block in turn goes left
    with probability (places left on the left) / (blocks left), which gives the
    quotas of the left half exactly their multivariate hypergeometric distribution.
    """
    # s: blocks and left places that remain, and the quotas so far; y: the same within one source
    inner = f"""aggregate(
        if(x.quota > 0, sequence(1L, x.quota), array()),
        named_struct('rem', s.rem, 'need', s.need, 'got', 0L),
        (y, i) -> if(pmod(xxhash64({seed}, node, x.sid, i), y.rem) < y.need,
            named_struct('rem', y.rem - 1, 'need', y.need - 1, 'got', y.got + 1),
            named_struct('rem', y.rem - 1, 'need', y.need, 'got', y.got)))"""
    total = "aggregate(blocks, 0L, (a, x) -> a + x.quota)"
    left = f"""aggregate(blocks,
        named_struct('rem', {total}, 'need', {total} div 2, 'quotas', cast(array() as array<bigint>)),
        (s, x) -> transform(array({inner}), z -> named_struct('rem', z.rem, 'need', z.need, 'quotas', concat(s.quotas, array(z.got))))[0],
        s -> s.quotas)"""
    halves = nodes.withColumn("left", F.expr(left))
    part = "transform(blocks, (x, i) -> named_struct('sid', x.sid, 'quota', {}))"
    both = F.expr(f"array(named_struct('node', node * 2, 'blocks', {part.format('left[i]')}), named_struct('node', node * 2 + 1, 'blocks', {part.format('x.quota - left[i]')}))")
    return halves.select(F.explode(both).alias("half")).select("half.node", "half.blocks")


def leaf_quotas(nodes: DataFrame, shards: int) -> DataFrame:
    """(shard, sid, quota): how many blocks of each source the tree's leaves give each shard."""
    return nodes.select((F.col("node") - shards).alias("shard"), F.explode("blocks").alias("b")).select("shard", "b.sid", "b.quota")


def plan_blocks(sources: DataFrame, shards: int, blocks: int, seed: int) -> DataFrame:
    """Which word blocks of which source are taken, and the shard and place that get them.

    A source's documents in hash order are one stream of words, cut into at most
    ``blocks`` blocks. Whole passes take every block; the last pass takes blocks in
    random order up to the words still wanted, the last of them in part. The tree
    splits the exact quotas of blocks among ``shards`` (a power of two); then each
    shard draws its number of blocks from the source's permuted blocks, disjoint
    from the others', and orders them by hash. What all shards together take of a
    source is its target, whatever their number; the tree decides which shard gets
    which of these blocks.

    One row per taken block: sid, epoch, block, take (words from its start), shard, place.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    src = sources.where("source_size > 0").withColumn("want", F.round("target").cast("long"))
    src = src.withColumn("len", F.ceil(F.col("source_size") / F.lit(blocks)).cast("long")).withColumn("n", F.ceil(F.col("source_size") / F.col("len")).cast("long"))
    each = src.where("want > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, (want - 1) div source_size)"))).withColumn("block", F.explode(F.expr("sequence(0L, n - 1)")))
    each = each.withColumn("words", F.least("len", F.col("source_size") - F.col("block") * F.col("len")))
    draw = Window.partitionBy("sid", "epoch").orderBy(F.xxhash64(F.lit(seed), "sid", "epoch", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.col("want") - F.col("epoch") * F.col("source_size")
    each = each.withColumn("take", F.least("words", wanted - F.coalesce(F.sum("words").over(draw), F.lit(0)))).where("take > 0")
    deal = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 1), "sid", "epoch", "block"), "epoch", "block")
    each = each.select("sid", "epoch", "block", "take", (F.row_number().over(deal) - 1).alias("drawn"))
    quotas = each.groupBy("sid").agg(F.count("*").alias("quota"))
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("sid", "quota"))).alias("blocks")).select(F.lit(1).cast("long").alias("node"), "blocks")
    for _ in range(shards.bit_length() - 1):
        nodes = split(nodes, seed)
    leaves = leaf_quotas(nodes, shards)
    share = leaves.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("shares"))
    share = share.withColumn("ends", F.expr("transform(shares, (x, i) -> aggregate(slice(shares, 1, i + 1), 0L, (a, y) -> a + y.quota))")).select("sid", "ends")
    dealt = each.join(share, "sid").withColumn("shard", F.expr("size(filter(ends, e -> e <= drawn))"))
    return dealt.select("sid", "epoch", "block", "take", "shard", F.xxhash64(F.lit(seed + 2), "shard", "sid", "epoch", "block").alias("place"))


def hashed(col: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 3), col)


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    shards: int = 8,
    blocks: int = 512,
    buckets: int = 1024,
    seed: int = 17,
    row_col: str | None = None,
) -> DataFrame:
    """The mix as pieces of documents: words ``words_from``..``words_to`` of a document, in a shard.

    Columns: row_id, ``id_col``, ``source_col``, size, source_size, target, epoch,
    shard, place, words_from, words_to (end exclusive). A document without a piece
    has one row with nulls in the last five. Order by (place, row_id, words_from)
    within a shard gives the shuffled shard: ``place`` hashes block and document.

    Sizes are numbers of words (null text: 0); null is a source of its own, the
    last. Offsets in a source's stream come from sums over (source, hash bucket)
    and running sums within one bucket, so a source that holds most rows spreads
    over ``buckets`` groups. Repeated rows, also of one id, are separate documents.
    Hashes of ids and of the seed decide everything: reruns agree. An empty table
    gives an empty result; other columns are not read.
    """
    rows = df.select(
        (F.col(f"`{row_col}`") if row_col else row_id()).alias("row_id"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size")
    )
    rows = materialize(rows.withColumn("h", hashed(F.col("id"), seed)).withColumn("bucket", F.pmod(F.shiftright("h", 16), F.lit(buckets)).cast("int")), "mix-rows")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    goal = materialize(targets(sums.groupBy("source").agg(F.sum("held").alias("source_size")), weights, share, cap), "mix-sources", gathered=True)
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("held").over(in_order), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    within = Window.partitionBy("source", "bucket").orderBy("h", "id", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("base") + F.col("offset"))
    plan = plan_blocks(goal, shards, blocks, seed)
    goal = goal.withColumn("len", F.ceil(F.col("source_size") / F.lit(blocks)).cast("long"))
    placed = placed.join(goal.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")))
    spans = placed.select("row_id", "id", "h", "source", "size", "source_size", "target", "sid", "start", "len", F.explode_outer(F.expr("if(size > 0, sequence(start div len, (start + size - 1) div len), array(cast(null as bigint)))")).alias("block"))
    met = spans.join(plan, ["sid", "block"], "left")
    low = F.greatest("start", F.col("block") * F.col("len"))
    high = F.least(F.col("start") + F.col("size"), F.col("block") * F.col("len") + F.col("take"))
    real = F.col("epoch").isNotNull() & (high > low)  # greatest and least skip nulls
    return met.select(
        "row_id",
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        *[F.when(real, F.col(c)).alias(c) for c in ("epoch", "shard")],
        F.when(real, F.xxhash64(F.lit(seed + 4), "place", "h")).alias("place"),
        F.when(real, low - F.col("start")).alias("words_from"),
        F.when(real, high - F.col("start")).alias("words_to"),
    )


def taken(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of :func:`mix`: id, size, source_size, target and the words the mix takes.

    ``pieces`` says where they go: (shard, place, epoch, words_from, words_to), in this order;
    empty for documents that are not taken.
    """
    words = F.coalesce(F.sum(F.col("words_to") - F.col("words_from")), F.lit(0)).cast("long")
    where = F.when(F.col("epoch").isNotNull(), F.struct("shard", "place", "epoch", "words_from", "words_to"))  # no more than blocks a document meets
    whole = pieces.groupBy("row_id", id_col, "size", "source_size", "target").agg(words.alias("taken"), F.array_sort(F.collect_list(where)).alias("pieces"))
    return whole.drop("row_id")


def apply_mix(df: DataFrame, text_col: str = "text", length_col: str = "n_chars", shards: int = 64, **options: object) -> DataFrame:
    """The mixed documents with the columns of ``df``, whatever their names: a row per document and pass that takes it.

    A document that a pass takes whole keeps its text, null too; of others the taken
    words remain, joined by one space; ``length_col``, if there is one, is counted
    again. The rows come by shard and, within a shard, in the order of their places:
    a document is in the shard and at the place of its first words in that pass, ties
    by row. Written, each file holds part of one shard's order. Empty texts hold no
    words, so no pass takes them. Repeated rows are documents of their own; an empty
    table gives an empty result.
    """
    columns, kind = df.columns, dict(df.dtypes)
    row, spans, whole, words, shard, place = (fresh(columns, f"__{x}") for x in ("row", "spans", "whole", "words", "shard", "place"))
    df = keyed(df, "mix-docs", row)
    pieces = mix(df, id_col=options.pop("id_col", "doc_id"), text_col=text_col, row_col=row, shards=shards, **options)
    first = F.min(F.struct("words_from", "shard", "place")).alias("first")
    own = pieces.where("epoch is not null").groupBy("row_id", "epoch", "size").agg(F.sort_array(F.collect_list(F.struct("words_from", "words_to"))).alias("spans"), F.sum(F.col("words_to") - F.col("words_from")).alias("got"), first)
    own = own.select(F.col("row_id").alias(row), F.col("spans").alias(spans), (F.col("got") == F.col("size")).alias(whole), F.col("first.shard").alias(shard), F.col("first.place").alias(place))
    joined = df.join(own, row)
    text = F.col(f"`{text_col}`")
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(F.col(words), (s["words_from"] + 1).cast("int"), (s["words_to"] - s["words_from"]).cast("int")))), " ")
    joined = joined.withColumn(words, F.when(~F.col(whole), found)).withColumn(text_col, F.when(F.col(whole), text).otherwise(cut))
    if length_col in kind:
        joined = joined.withColumn(length_col, F.length(text).cast(kind[length_col]))
    # places are hashes, so that equal ranges of them hold equal shares of a shard: no sample of the rows is needed
    ordered = joined.drop(words, spans, whole).repartition(F.col(shard), F.shiftrightunsigned(place, 60)).sortWithinPartitions(shard, place, row)
    return ordered.select(*[F.col(f"`{c}`") for c in columns])
