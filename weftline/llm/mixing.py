"""Mixing sources to target weights, with a hierarchical token budget.

The levels (say domain, language, source) make a tree.  A node's budget is dealt to its children in
proportion to their weights; what a child cannot use - its documents' tokens times ``max_epochs``
are its capacity - goes to its siblings by weight, and reaches the siblings of an ancestor only
once a whole subtree is full (weighted water-filling from the top, with the capacity of whole
subtrees).  Budgets are whole tokens and add up exactly.

A leaf's stream is epoch 0, epoch 1, ... of its documents, each epoch in the order of a hash of seed,
epoch and id.  The leaf takes the prefix of that stream that its budget covers: full epochs, then a
part of one.  For that part only sums of hash ranges (about ``range_rows`` rows each, or the square root
of a leaf's rows if that is more) are ordered,
and the rows of the single range in which the budget ends; a leaf with a third of all rows is never
ordered as a whole and never moves.

Built of DataFrame functions alone.  Tokens are words ``[^\\x20\\x09-\\x0D]+``.  A null level is the
node ''; a null text has no tokens; a null id hashes as ''.  Repeated rows count each.  A leaf
without tokens gets nothing.  Columns pass through; the added ones are renamed if taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

WORD = r"[^\x20\x09-\x0D]+"
BIG = "decimal(38,0)"


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(seed: int, epoch: Column, id: Column) -> Column:
    """60 bits of md5, uniform."""
    key = F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def hash_range(key: Column, ranges: Column) -> Column:
    return F.shiftright(F.shiftright(key, 30) * ranges, 30)


#: A level's weight: a non-negative whole number, from the path of levels down to it.
Weight = Callable[..., Column]


def budgets(leaves: DataFrame, levels: list[str], weights: list[Weight], total: Column, max_epochs: int) -> DataFrame:
    """leaves: one row a leaf, with the levels, ``tokens`` and ``docs``.  Adds ``quota``."""
    w = [f"__w{i}" for i in range(len(levels))]
    path = [F.col(x) for x in levels]
    t = leaves.select("*", *(f(*path[: i + 1]).cast("bigint").alias(w[i]) for i, f in enumerate(weights)))
    usable = F.least(*(F.col(x) for x in w), F.lit(1)) if len(w) > 1 else F.least(F.col(w[0]), F.lit(1))
    t = t.withColumn("__cap", F.when(usable > 0, F.col("tokens") * max_epochs).otherwise(0).cast(BIG))
    nodes = t.agg(F.least(F.floor(F.coalesce(total, F.lit(0))).cast(BIG), F.coalesce(F.sum("__cap"), F.lit(0)).cast(BIG)).alias("__parent"))
    above: list[str] = []
    for level, weight in zip(levels, w, strict=True):
        here = [*above, level]
        children = t.groupBy(*here).agg(F.max(weight).cast(BIG).alias("w"), F.sum("__cap").cast(BIG).alias("cap"))
        # the root is one row; below it a parent's row is found by its path
        joined = children.join(nodes, above) if above else children.crossJoin(F.broadcast(nodes))
        parent = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        fill = parent.orderBy((F.col("cap").cast("double") / F.col("w").cast("double")).asc_nulls_last(), level)
        upto, before, after = (fill.rowsBetween(a, b) for a, b in ((Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1), (0, Window.unboundedFollowing)))
        dec = lambda c: c.cast(BIG)
        filled = joined.withColumn("full", (F.col("w") > 0) & (dec(F.col("cap") * F.sum("w").over(after)) <= dec(F.col("w") * (F.col("__parent") - F.coalesce(F.sum("cap").over(before), F.lit(0))))))
        filled = filled.withColumn("rest", dec(F.col("__parent") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(parent)))
        filled = filled.withColumn("open_w", dec(F.when(F.col("full"), 0).otherwise(F.col("w")))).withColumn("all_w", dec(F.sum("open_w").over(parent)))
        upto_w = dec(F.sum("open_w").over(upto))
        share = lambda x: F.when(F.col("all_w") > 0, F.expr(f"{x} * rest div all_w")).otherwise(0)
        filled = filled.withColumn("to_w", upto_w).withColumn("from_w", dec(upto_w - F.col("open_w")))
        quota = F.when(F.col("full"), F.col("cap")).otherwise(dec(share("to_w")) - dec(share("from_w")))
        nodes, above = filled.select(*here, dec(quota).alias("__parent")), here
    return leaves.join(nodes, levels).withColumnRenamed("__parent", "__quota").withColumn("quota", F.col("__quota").cast("bigint")).drop("__quota")


def plan(df: DataFrame, levels: dict[str, Column], weights: list[Weight], id: str = "doc_id", text: str = "text", fraction: float = 1.0, max_epochs: int = 4, seed: int = 17, range_rows: int = 1000) -> tuple[DataFrame, DataFrame]:
    """df with the levels and n_tokens, and one row a leaf: quota, full_epochs, rest (tokens of the
    epoch after those), ranges, cut_range (where the rest ends) and cut_before (tokens before it)."""
    names = list(levels)
    marked = df.withColumns({k: F.coalesce(v.cast("string"), F.lit("")) for k, v in levels.items()} | {"n_tokens": words(F.col(text))})
    leaves = marked.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    # one row for each combination of levels: written, so that its size is known where it is joined
    leaves = written(leaves)
    total = F.sum("tokens") * F.lit(fraction)
    quotas = budgets(leaves, names, weights, total, max_epochs)
    quotas = quotas.withColumn("full_epochs", F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(0))
    quotas = quotas.withColumn("rest", F.col("quota") - F.col("full_epochs") * F.col("tokens"))
    # as many ranges as rows in one, where a leaf has very many: neither the sums nor the cut range grow long
    quotas = written(quotas.withColumn("ranges", F.ceil(F.col("docs") / F.greatest(F.lit(range_rows).cast("double"), F.sqrt("docs")))))
    parts = marked.select(*names, "n_tokens", F.col(id).alias("__id")).join(quotas.where("rest > 0"), names)
    sums = parts.groupBy(*names, hash_range(order_key(seed, F.col("full_epochs"), F.col("__id")), F.col("ranges")).alias("r"), "rest").agg(F.sum("n_tokens").alias("t"))
    run = F.sum("t").over(Window.partitionBy(*names).orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    cuts = sums.withColumn("upto", run).where("upto >= rest and upto - t < rest").select(*names, F.col("r").alias("cut_range"), (F.col("upto") - F.col("t")).alias("cut_before"))
    return marked, written(quotas.join(cuts, names, "left"))


def mix(df: DataFrame, levels: dict[str, Column], weights: list[Weight], id: str = "doc_id", text: str = "text", seed: int = 17, **kw) -> DataFrame:
    """One row for each time a document is taken: df's columns, the levels, n_tokens, epoch,
    order_key (a leaf's stream goes by epoch, order_key, id) and take_tokens (less than n_tokens
    only where a leaf's budget ends within the document)."""
    # work under names that cannot clash with df's
    cols = [f"__c{i}" for i in range(len(df.columns))]
    inner = [f"__level{i}" for i in range(len(levels))]
    base = df.select(*(df[c].alias(a) for c, a in zip(df.columns, cols, strict=True)), df[id].alias("__key"), df[text].alias("__text"), *(v.alias(a) for v, a in zip(levels.values(), inner, strict=True)))
    marked, leaves = plan(base, {a: F.col(a) for a in inner}, weights, "__key", "__text", seed=seed, **kw)
    rows = marked.drop("__text").join(leaves.select(*inner, "full_epochs", "rest", "ranges", "cut_range", "cut_before"), inner)
    keep = [*cols, "__key", *inner, "n_tokens"]
    out = [*keep, "epoch", "order_key", "take_tokens"]
    key = order_key(seed, F.col("epoch"), F.col("__key"))
    epochs = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("rest") > 0, F.col("full_epochs")).otherwise(F.col("full_epochs") - 1))
    each = rows.where("full_epochs > 0 or rest > 0").withColumn("epoch", F.explode(epochs)).withColumn("order_key", key)
    before = (F.col("epoch") < F.col("full_epochs")) | (hash_range(F.col("order_key"), F.col("ranges")) < F.col("cut_range"))
    whole = each.where(before).withColumn("take_tokens", F.col("n_tokens")).select(*out)
    last = rows.where("rest > 0").withColumn("epoch", F.col("full_epochs")).withColumn("order_key", key).where(hash_range(F.col("order_key"), F.col("ranges")) == F.col("cut_range"))
    w = Window.partitionBy(*inner).orderBy("order_key", "__key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("cut_before") + F.sum("n_tokens").over(w) - F.col("n_tokens")
    cut = last.withColumn("start", start).where("start < rest").withColumn("take_tokens", F.least(F.col("n_tokens"), F.col("rest") - F.col("start"))).select(*out)
    taken, used, final = whole.unionByName(cut), list(df.columns), [F.col(a).alias(c) for a, c in zip(cols, df.columns, strict=True)]
    for name, column in [*((n, a) for n, a in zip(levels, inner, strict=True) if n not in df.columns), *((x, x) for x in ("n_tokens", "epoch", "order_key", "take_tokens"))]:
        final.append(F.col(column).alias(fresh(used, name)))
        used.append(fresh(used, name))
    return taken.select(*final)


def mixed_documents(df: DataFrame, levels: dict[str, Column], weights: list[Weight], **kw) -> DataFrame:
    """The rows of df as often as they are taken, with df's columns.  The document in which a
    leaf's budget ends stays whole."""
    return mix(df, levels, weights, **kw).select(*df.columns)


def document_levels(source: str = "source", lang: str = "lang") -> dict[str, Column]:
    """Domain (made of the source's name), language, source."""
    s = F.col(source)
    domain = F.when(s == "src0", "crawl").when(s.rlike("^src[1-9]$"), "books").otherwise("forum")
    return {"domain": domain, "lang": F.col(lang), "source": s}


DOCUMENT_WEIGHTS: list[Weight] = [
    lambda domain: F.when(domain == "crawl", 2).when(domain == "books", 5).otherwise(3),
    lambda domain, lang: F.when(lang == "en", 6).when(lang == "de", 2).otherwise(1),
    lambda domain, lang, source: F.lit(1),
]
