"""Mixing sources to target weights: hierarchical token budgets, then seeded prefixes.

The tree is domain > language > source.  Weights are whole numbers, so budgets
are exact.  From the root down, a node's budget is shared among its children
by weight; a child that can't hold its share (its leaves' tokens times
max_epochs) is filled, and what it leaves over goes to its siblings by their
weights.  A subtree gets no more than it can hold, so only what all siblings
together can't take up has been passed on to the ancestor's siblings before.

Each leaf then takes whole epochs of its documents while they fit, and of the
next epoch the longest prefix in that epoch's seeded order that fits.  The
order is by a hash whose upper bits cut a leaf into ranges; sums by range find
the one where the prefix ends, so no leaf, however large, is sorted as a whole.

Texts are split into words once; (id, leaf, words) is written and decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Work

LEVELS = ["domain", "lang", "source"]
RANGES = 4096
SALTS = 64
_D = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """Words of a text; of a null, none."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def seeded_hash(seed: int, doc_id: Column, epoch: Column) -> Column:
    """0 to 2**32 - 1 from the first digits of an MD5, as any SQL engine has it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))), 1, 8), 16, 10).cast("long")


def _fill(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """budget of each child: the parent's (column total) by weight, at most cap, the rest to its siblings.

    In the order of cap / weight, filled children come before the others; the
    first that can't be filled fixes the level for itself and all after it.
    Shares are rounded down, which leaves less than a token a child.
    """
    every = Window.partitionBy(*parent)
    at = every.orderBy("ratio", key)
    before, onward = at.rowsBetween(Window.unboundedPreceding, -1), at.rowsBetween(0, Window.unboundedFollowing)
    x = children.where("weight > 0 and cap > 0").withColumn("ratio", F.expr(f"(cast(cap as {_D}) * 1000000) div weight"))
    x = x.withColumns({"above": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("long"), "weights": F.sum("weight").over(onward).cast("long")})
    x = x.withColumn("fits", F.expr(f"cast(cap as {_D}) * weights <= cast(total - above as {_D}) * weight"))
    x = x.withColumn("open", F.min(F.when(~F.col("fits"), F.struct("ratio", key))).over(every))
    x = x.withColumn("filled", F.col("open").isNull() | (F.struct("ratio", key) < F.col("open")))
    x = x.withColumns({
        "spent": F.coalesce(F.sum(F.when(F.col("filled"), F.col("cap"))).over(every), F.lit(0)).cast("long"),
        "shared": F.coalesce(F.sum(F.when(~F.col("filled"), F.col("weight"))).over(every), F.lit(1)).cast("long"),
    })
    return x.withColumn("budget", F.expr(f"case when filled then cap else cast((cast(total - spent as {_D}) * weight) div shared as long) end"))


def leaf_budgets(leaves: DataFrame, total: int, weights: dict[str, Column | None]) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens, cap).

    weights has, for each level, a whole-number weight as a Column over that
    level's and its ancestors' columns; 1 where it is None.
    """
    budgets = None
    for depth, key in enumerate(LEVELS):
        names = LEVELS[: depth + 1]
        weight = weights.get(key)
        here = leaves.groupBy(*names).agg(F.sum("cap").cast("long").alias("cap"), F.sum("tokens").cast("long").alias("tokens"))
        here = here.withColumn("weight", (F.lit(1) if weight is None else weight).cast("long"))
        if budgets is None:
            here = here.withColumn("total", F.least(F.lit(total).cast("long"), F.sum("cap").over(Window.partitionBy(F.lit(0)))))
        else:
            here = here.join(budgets.withColumnRenamed("budget", "total"), names[:-1])
        parent = names[:-1] or [F.lit(0)]  # the domains, a handful of rows, have only the root above them
        budgets = _fill(here, parent, key).select(*names, "budget", *(["tokens"] if key == LEVELS[-1] else []))
    return budgets


def select_mix(
    docs: DataFrame, *, share: tuple[int, int] | None = None, total_tokens: int | None = None, domain: Column, weights: dict[str, Column | None] | None = None,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", max_epochs: int = 2, seed: int = 7, carry: bool = False,
) -> DataFrame:
    """The documents that the mix takes: doc_id, domain, lang, source, n_tokens, epochs (how often).

    The budget is total_tokens, or share = (a, b): a/b of the input's tokens.
    domain is a Column over doc_id, lang and source.  With carry, all columns
    of the input come along in the struct `row` instead of n_tokens.  Null domains, languages and
    sources are groups of their own, spelt "unknown".  Texts without words,
    null ones too, have no tokens and are never taken.  Rows without an id
    sort as if it were empty; repeated rows are counted each and taken
    together or not at all.  Places that tie are in the order of ids.  Texts of any length are
    counted whole.  An empty table or budget takes nothing.
    """
    work = Work(docs.sparkSession, "mix")
    group = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    at = lambda c: F.col(f"`{c}`")
    text = at(text_col).cast("string")
    named = [at(id_col).cast("long").alias("doc_id"), group(at(lang_col)).alias("lang"), group(at(source_col)).alias("source")]
    base = work.table("sizes", docs.select(*named, n_words(text).alias("n_tokens")).withColumn("domain", group(domain)).where("n_tokens > 0"))

    def place(epoch: Column) -> Column:
        return seeded_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), epoch)

    def range_of(epoch: Column) -> Column:
        return F.shiftright(place(epoch), 32 - RANGES.bit_length() + 1).cast("int")

    # tokens of every leaf by range, in the order of each epoch that may be begun: leaves * RANGES rows at most
    places = F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), range_of(F.lit(e)).alias("range")) for e in range(max_epochs)])).alias("at")
    sums = base.select(*LEVELS, "n_tokens", places).groupBy(*LEVELS, "at.epoch", "at.range").agg(F.sum("n_tokens").alias("tokens"))
    sums = work.table("sums", sums)
    leaves = work.table("leaves", sums.where("epoch = 0").groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs))
    if total_tokens is None:
        every = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0]
        total_tokens = int(every) * share[0] // share[1]
    plan = leaf_budgets(leaves, total_tokens, weights or {}).select(*LEVELS, F.expr("cast(budget div tokens as int)").alias("full"), F.expr("budget % tokens").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.join(plan, LEVELS).where("epoch = full").withColumn("below", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).cast("long"))
    ends = ends.where("below + tokens > rest").groupBy(*LEVELS).agg(F.min(F.struct("range", "below")).alias("edge"))
    plan = plan.join(ends, LEVELS, "left").select(*LEVELS, "full", "rest", F.coalesce("edge.range", F.lit(-1)).alias("edge"), F.coalesce("edge.below", F.lit(0).cast("long")).alias("below"))
    # a hot leaf's documents meet the plan under SALTS keys
    plan = work.table("plan", plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    work.drop("sums")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")

    def met(rows: DataFrame) -> DataFrame:
        return rows.withColumn("salt", salt).join(plan, [*LEVELS, "salt"]).drop("salt").withColumn("range", range_of(F.col("full")))

    # of the one range in which the prefix ends, the running sum decides; peers, which repeat a row, go together
    order = Window.partitionBy(*LEVELS).orderBy(place(F.col("full")), "doc_id")
    upto = (F.col("below") + F.sum("n_tokens").over(order)) <= F.col("rest")
    decided = met(base).where("range = edge").select("doc_id", *LEVELS, "n_tokens", (F.col("full") + upto.cast("int")).alias("epochs"))
    epochs = (F.col("full") + (F.col("range") < F.col("edge")).cast("int")).alias("epochs")
    if not carry:
        clear = met(base).where("range <> edge").select("doc_id", *LEVELS, "n_tokens", epochs)
        return clear.union(decided).where("epochs > 0")
    # whole rows meet the plan, and the few of ending ranges their decisions: no text is sorted or counted again
    whole = docs.select(*named, F.struct(*[at(c) for c in docs.columns]).alias("row"), text.rlike("[^\\x20\\x09-\\x0D]").alias("said")).withColumn("domain", group(domain)).where("said").drop("said")
    here = met(whole)
    clear = here.where("range <> edge").select("doc_id", *LEVELS, "row", epochs)
    ids = work.table("decided", decided.select("doc_id", *LEVELS, "epochs").distinct())
    a, b = here.where("range = edge").select("doc_id", *LEVELS, "row").alias("a"), ids.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    for c in LEVELS:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    ending = a.join(b, same).select("a.doc_id", *[f"a.{c}" for c in LEVELS], "a.row", "b.epochs")
    return clear.union(ending).where("epochs > 0")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The columns of docs for the documents taken, each as often as its epochs say; odd rows as in select_mix."""
    taken = select_mix(docs, carry=True, **how)
    return taken.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select("row.*")
