"""Mixing sources to target weights, with DataFrame functions only.

A source's share of all tokens is raised to an exponent and the shares are normalised: exponent 1 keeps the sources' own shares,
0 makes them equal; beyond 1 the mix gets sharper than the corpus, without a limit to the exponent. Bisection finds the smallest
exponent (the flattest mix) at which no source is repeated more often than a limit, or the exponent at which the mix has a target
entropy. Where no exponent meets the limit or the target, that is an error. The mix has a budget of tokens, and each source its
weight's part of it. A source is dealt into blocks of about equal size by the hash of its documents; each pass over a source takes
its blocks in another permutation. Whole passes take every document; of the last pass come the blocks that fit the rest of the
budget, and of the block at the border the documents that fit.

Sources are rows of a table of their own, however many there are: each step of the bisection is a sum over it, and only such sums
reach the driver. What decides on a document is in its source's row (how many passes, the last block that fits, and the last
document of the border block), so documents meet that table only. Running sums run over a source's blocks and over the documents
of border blocks, so a source with a third of all rows is spread over its blocks.

A null source is a source of its own. Null and empty texts have no tokens and come once. A source without tokens has weight 0 and its
documents come once. A null id is dealt by its text. Repeated rows count each. Very long texts count whole. An empty table gives
an empty mix. Columns other than the id, the text and the source are not read, and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import freed, stored

#: Steps of bisection, how many of them one sum looks ahead, and the digits that the exponent is rounded to.
STEPS, AHEAD, DIGITS = 40, 4, 9
#: A source has the root of its tokens over this many blocks: both their number and their size grow slowly.
BLOCK_RULE = 100
#: Ends of the exponent's range: the upper one is the first that meets the limit or the target, but for rounding.
LOW, HIGHS, SLACK = 0.0, [2.0**k for k in range(21)], 1e-9


def tokens_of(text: Column) -> Column:
    """Runs of characters other than white space, of ASCII."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("bigint"), F.lit(0))


def hashed(*parts: Column | str) -> Column:
    """A whole number under 2**32 from an md5 of the parts, the same in every engine."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def share(tokens: Column, e: float, total: float, top: float) -> Column:
    """What is raised to the exponent: for sharp mixes a source's size against the largest one, so that it doesn't vanish."""
    return tokens / F.lit(float(top if e > 1 else total))


def exponent(per: DataFrame, *, max_repeats: float | None, entropy: float | None, budget: int) -> tuple[float, float, float]:
    """per: a row a source with tokens. Bisects between LOW and the first end that will do. The exponent, and what shares divide by."""
    used = per.where("tokens > 0")
    ends = used.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("top"), F.min("tokens").alias("low")).first()
    if ends.total is None:
        return LOW, 1.0, 1.0
    total, top, low = float(ends.total), float(ends.top), float(ends.low)

    def good(exponents: list[float], slack: float = 0.0) -> list[bool]:
        """Whether each exponent is large enough, from one pass over the sources."""
        x = [share(F.col("tokens"), e, total, top) for e in exponents]
        norms = [F.sum(F.pow(s, F.lit(e))) for s, e in zip(x, exponents, strict=True)]
        logs = [F.sum(F.pow(s, F.lit(e)) * F.log2(s)) for s, e in zip(x, exponents, strict=True)] if entropy is not None else []
        row = used.agg(*[c.alias(f"s{k}") for k, c in enumerate([*norms, *logs])]).first()
        if entropy is not None:
            return [math.log2(n) - e * m / n <= entropy + slack for e, n, m in zip(exponents, row[: len(x)], row[len(x) :], strict=True)]
        # the smallest source is repeated most
        most = [(low / (top if e > 1 else total)) ** e / low for e in exponents]
        return [m * budget <= n * max_repeats * (1 + slack) for m, n in zip(most, row, strict=True)]

    if good([LOW])[0]:
        return LOW, total, top
    # repeats are fewest at exponent 1, where all sources have the same; beyond it the largest has more
    highs = HIGHS if entropy is not None else HIGHS[:1]
    high = next((e for e, ok in zip(highs, good(highs, SLACK), strict=True) if ok), None)
    if high is None:
        raise ValueError(f"no exponent gives a mix of entropy {entropy}" if entropy is not None else f"the budget repeats a source more than {max_repeats} times at every exponent")
    return round(halved(good, high / 2 if high > 1 else LOW, high), DIGITS), total, top


def halved(good: Callable[[list[float]], list[bool]], low: float, high: float) -> float:
    """The upper end after STEPS halvings, of which AHEAD are looked at in one pass: all midpoints that they can come to."""
    for _ in range(STEPS // AHEAD):
        middles = [low + (high - low) * k / 2**AHEAD for k in range(1, 2**AHEAD)]
        k = next((k for k, ok in enumerate(good(middles)) if ok), len(middles))
        low, high = [low, *middles][k], [*middles, high][k]
    return high


def weights(docs: DataFrame, *, max_repeats: float | None = 2.0, entropy: float | None = None, budget_tokens: int | None = None) -> DataFrame:
    """docs: source and tokens. Per source: tokens, weight, budget (tokens, whole) and the exponent, the same for all.
    The budget is by default all tokens there are."""
    per = stored(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    all_tokens = per.agg(F.sum("tokens")).first()[0] or 0
    budget = int(all_tokens if budget_tokens is None else budget_tokens)
    e, total, top = exponent(per, max_repeats=max_repeats, entropy=entropy, budget=budget)
    part = F.when(F.col("tokens") > 0, F.pow(share(F.col("tokens"), e, total, top), F.lit(e))).otherwise(F.lit(0.0))
    norm = per.agg(F.sum(part)).first()[0] or 0.0
    weight = F.round(part / F.lit(norm), 9) if norm else F.lit(0.0)
    out = per.select("source", "tokens", weight.alias("weight"))
    return out.select("*", F.floor(F.col("weight") * F.lit(budget)).cast("bigint").alias("budget"), F.lit(e).alias("exponent"))


def counted(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, tokens and key (what a document is dealt by) of every row, without the texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(text.cast("binary")))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), tokens_of(F.col(text_col)).alias("tokens"), key.alias("key"))


def block_of(key: Column, blocks: Column, seed: int) -> Column:
    return hashed(str(seed), key) % F.greatest(blocks, F.lit(1))


def turn_of(source: Column, passes: Column, block: Column, seed: int) -> Column:
    """What a pass orders its blocks by."""
    return hashed(str(seed), F.coalesce(source.cast("string"), F.lit("")), passes, block)


def planned(rows: DataFrame, seed: int, **targets) -> tuple[DataFrame, DataFrame]:
    """rows: as counted() gives them, stored. A row a source (its weight, passes and blocks; last, the last whole block of the last
    pass; border, the block that is taken in part, and cut, its last document), and a row a block with its place."""
    per = weights(rows.select("source", "tokens"), **targets)
    some = F.col("tokens") > 0
    per = per.select(
        F.col("source").alias("p_source"), "weight",
        F.when(some, F.expr("budget div tokens")).otherwise(1).cast("bigint").alias("passes"),
        F.when(some, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"),
        F.ceil(F.sqrt(F.col("tokens") / F.lit(BLOCK_RULE))).cast("bigint").alias("blocks"),
    )
    per = stored(per)
    dealt = rows.join(per, rows["source"].eqNullSafe(per["p_source"])).withColumn("block", block_of(F.col("key"), F.col("blocks"), seed))
    blocks = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("size"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    blocks = blocks.withColumn("turn", turn_of(F.col("source"), F.col("passes"), F.col("block"), seed))
    order = Window.partitionBy("source").orderBy("turn", "block")
    blocks = blocks.withColumn("place", F.row_number().over(order)).withColumn("room", F.col("rest") - F.sum("size").over(order) + F.col("size"))
    blocks = stored(blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "turn", "place", "size", "room"))
    whole = F.col("room") >= F.col("size")
    ends = blocks.groupBy("b_source").agg(
        F.max(F.when(whole, F.struct("turn", "b_block"))).alias("last"), F.max(F.when(~whole & (F.col("room") > 0), F.struct("b_block", "room"))).alias("border")
    )
    ends = ends.select(F.col("b_source").alias("e_source"), "last", F.col("border.b_block").alias("border"), F.col("border.room").alias("room"))
    at_border = dealt.join(ends.where("border IS NOT NULL"), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("border")))
    at_border = at_border.withColumn("h", hashed(str(seed), F.lit("d"), F.col("key")))
    fits = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("h", "id")) <= F.col("room")
    cuts = at_border.select("source", "h", "id", fits.alias("fits")).where("fits").groupBy(F.col("source").alias("c_source")).agg(F.max(F.struct("h", "id")).alias("cut"))
    plan = per.join(ends, F.col("p_source").eqNullSafe(F.col("e_source")), "left").join(cuts, F.col("p_source").eqNullSafe(F.col("c_source")), "left")
    plan = stored(plan.select("p_source", "weight", "passes", "blocks", "last", "border", "cut"))
    freed(per)
    return plan, blocks


def copies(seed: int) -> Column:
    """How often the mix has a row, from its own columns, its block and its source's row of the plan."""
    turn = turn_of(F.col("source"), F.col("passes"), F.col("block"), seed)
    in_whole = F.struct(turn, "block") <= F.struct("last.turn", "last.b_block")
    h = hashed(str(seed), F.lit("d"), F.col("key"))
    in_part = (F.col("block") == F.col("border")) & F.col("cut").isNotNull() & (F.struct(h, "id") <= F.struct("cut.h", "cut.id"))
    last = F.coalesce(F.col("last").isNotNull() & in_whole, F.lit(False)) | F.coalesce(in_part, F.lit(False))
    return F.when(F.col("tokens") > 0, F.col("passes") + last.cast("int")).otherwise(F.lit(1)).cast("bigint")


def mixed(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    max_repeats: float | None = 2.0, entropy: float | None = None, budget_tokens: int | None = None, seed: int = 1,
) -> DataFrame:
    """Per row of docs: id, source, tokens, block, weight (of its source), copies (how often the mix has it) and place, the
    position of its block in the last pass's permutation. Rows with copies = 0 are not in the mix.

    Rows equal in id and source share a block and, at a border, come in or stay out in an order of their ids' hashes; equal
    rows at a border all stay out unless all of them fit.
    """
    # read several times below
    rows = stored(counted(docs, id_col, text_col, source_col))
    plan, blocks = planned(rows, seed, max_repeats=max_repeats, entropy=entropy, budget_tokens=budget_tokens)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("block", block_of(F.col("key"), F.col("blocks"), seed))
    rows = rows.join(blocks.select("b_source", "b_block", "place"), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("tokens").alias("n_tokens"), "block", "place", "weight", copies(seed).alias("copies"))


def repeated(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    max_repeats: float | None = 2.0, entropy: float | None = None, budget_tokens: int | None = None, seed: int = 1,
) -> DataFrame:
    """The rows of docs, each as often as the mix has it."""
    rows = stored(counted(docs, id_col, text_col, source_col))
    plan, blocks = planned(rows, seed, max_repeats=max_repeats, entropy=entropy, budget_tokens=budget_tokens)
    freed(rows, blocks)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    field = lambda name: F.col("row").getField(name)
    text = F.coalesce(field(text_col).cast("string"), F.lit(""))
    key = F.coalesce(field(id_col).cast("string"), F.md5(text.cast("binary")))
    own = whole.select("row", field(id_col).alias("id"), field(source_col).alias("source"), tokens_of(text).alias("tokens"), key.alias("key"))
    own = own.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("block", block_of(F.col("key"), F.col("blocks"), seed))
    own = own.select("row", F.explode(F.array_repeat(F.lit(0), copies(seed).cast("int"))).alias("copy"))
    return own.select("row.*")
