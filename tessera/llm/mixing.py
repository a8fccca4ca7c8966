"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Leaves are the paths of a tree of levels (such as domain, language, source). Weights name the target share of a
path's children; what has none shares equally in weight 1. A token total is dealt from the root: each node's
budget goes to its children by weight, but no child gets more than its capacity, the tokens of its subtree times
max_epochs. What a child can't take goes to its siblings by weight, and leaves the family only when no sibling can
take it, since a node's capacity is its children's sum. A family is dealt in one pass: with its children in order of
capacity per weight, a child is full if those up to it are filled and the others get its ratio without using up the
budget; the rest is shared by weight. Children are summed by bins of the ratio first, so that only those of the one bin
where filling ends are put in order.

A leaf's budget is filled from epochs: whole passes over the leaf, then a prefix of the next, each pass in an
order of its own (md5 of seed, epoch and id, then tokens, then a hash of the text). A document is taken if the pass has
tokens left before it, so that a leaf gets its budget or less than one document more. A prefix is one value of the
order, the last key taken, and is found on (leaf, key, tokens) alone: tokens are summed by the key's first digits, the
digit where the budget ends is refined by the next ones, until so few keys are left that a window can order them. The
documents are then read once more and compared with their leaf's last keys. Texts are never shuffled for that, unless
there are so many leaves that Spark can't broadcast their table.

Defined cases: null level values are a child of their own; texts without tokens are never taken, as nothing is
left to fill by them; documents without an id are ordered by their text; rows of one leaf with equal ids and equal texts
are taken or left together; an empty table, a total of zero, or weights that are all zero give no rows (a child of
weight zero gets nothing while its siblings have room, and what none can take is not dealt); columns of the documents
stay as they are, and a column of the result whose name a document column has already gets `_` appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, quoted, written

SEED = "mix-1"
#: Keys of a leaf that one window orders, about.
SLOT_ROWS = 4096
#: Digits of the key by which tokens are summed at once, and all that it has.
DIGITS, KEY_DIGITS = 3, 64
#: Bins of capacity per weight for each doubling.
BINS = 16


def count_tokens(text: Column) -> Column:
    """Spaces and line feeds of a text that has other characters, and one."""
    bare = F.octet_length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(bare > 0, F.octet_length(text) - bare + 1).otherwise(0).cast("long")


def _same(a: list[str], b: list[str]) -> Column:
    """Equality of columns, null being equal to null."""
    on = F.lit(True)
    for x, y in zip(a, b):
        on = on & F.col(x).eqNullSafe(F.col(y))
    return on


def _shares(family: DataFrame, parent: list[str]) -> DataFrame:
    """(parent..., child, __c capacity, __w weight, __b the parent's budget) -> the same with __share."""
    family = family.withColumn("__r", F.when(F.col("__w") > 0, F.col("__c") / F.col("__w")))
    order = Window.partitionBy(*parent, "__one").orderBy("__r")
    onward, after, before = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)

    def first_short(rows: DataFrame, full: Column, rest: Column) -> DataFrame:
        """The first row that isn't full. full, rest: what is filled before the rows at hand and the weight after them, for the parent."""
        rows = rows.withColumn("__one", F.lit(1))
        rows = rows.withColumns({"__full": full + F.coalesce(F.sum("__c").over(before), F.lit(0.0)), "__after": rest + F.coalesce(F.sum("__w").over(after), F.lit(0.0)), "__onward": rest + F.sum("__w").over(onward)})
        short = rows.where(F.col("__full") + F.col("__c") + F.col("__r") * F.col("__after") > F.col("__b"))
        return short.groupBy(*parent).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in parent]), "__r").alias("__s"))

    weighed = family.where("__r IS NOT NULL").withColumn("__bin", F.floor(F.log2(F.greatest("__r", F.lit(1e-9))) * BINS))
    sums = [F.sum("__c").alias("__c"), F.sum("__w").alias("__w"), F.max("__b").alias("__b")]
    bins = first_short(weighed.groupBy(*parent, "__bin").agg(*sums, F.max("__r").alias("__r")), F.lit(0.0), F.lit(0.0))
    bins = bins.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parent)], F.col("__s.__bin").alias("__at"), F.col("__s.__full").alias("__f"), F.col("__s.__after").alias("__a"))
    within = weighed.join(bins, _same(parent, [f"__p{i}" for i in range(len(parent))]) & (F.col("__bin") == F.col("__at")))
    within = within.groupBy(*parent, "__r").agg(*sums, F.max("__f").alias("__f"), F.max("__a").alias("__a"))
    level = first_short(within, F.col("__f"), F.col("__a"))
    level = level.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parent)], (F.greatest(F.col("__s.__b") - F.col("__s.__full"), F.lit(0.0)) / F.col("__s.__onward")).alias("__level"))
    dealt = family.join(level, _same(parent, [f"__p{i}" for i in range(len(parent))]), "left").drop(*[f"__p{i}" for i in range(len(parent))])
    # a family without a child that isn't full is filled, as far as it has weights
    share = F.when(~(F.col("__w") > 0), F.lit(0.0)).when(F.col("__level").isNull(), F.col("__c")).otherwise(F.least(F.col("__c"), F.col("__level") * F.col("__w")))
    return dealt.withColumn("__share", share).drop("__level", "__r")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[Column], total: int, max_epochs: int) -> DataFrame:
    """(levels..., n_docs, tokens) -> the same with budget: the tokens dealt to each leaf.

    weights: a weight for each level, as a column over the levels.
    """
    nodes = leaves.withColumns({"__cap": (F.col("tokens") * max_epochs).cast("double"), "__budget": F.lit(float(total))})
    above: list[str] = []
    for level, weight in zip(levels, weights):
        path = [*above, level]
        family = nodes.groupBy(*path).agg(F.sum("__cap").alias("__c"), F.max("__budget").alias("__b"), F.max(weight).cast("double").alias("__w"))
        mine = [f"__{c}" for c in path]
        family = written(_shares(family, above).select(*[F.col(c).alias(m) for c, m in zip(path, mine)], "__share"), "mix-shares")
        nodes = nodes.join(family, _same(path, mine)).drop("__budget", *mine).withColumnRenamed("__share", "__budget")
        above = path
    return nodes.withColumn("budget", F.floor(F.col("__budget") + 1e-6).cast("long")).drop("__cap", "__budget")


def _key(seed: str) -> Column:
    """The order of a pass: KEY_DIGITS hexadecimal digits of (md5 of seed, epoch and id; tokens; hash of the text)."""
    first = F.md5(F.concat_ws(":", F.lit(seed), F.col("__epoch").cast("string"), F.col("__id")).cast("binary"))
    return F.concat(first, F.lpad(F.lower(F.hex("__tokens")), 16, "0"), F.lpad(F.lower(F.hex("__hash")), 16, "0"))


def last_keys(light: DataFrame, passes: DataFrame, names: list[str], seed: str, slot_rows: int) -> DataFrame:
    """Passes (names..., __epoch, __room, fewer tokens than the leaf has) over (names..., __id, __tokens, __hash) -> (names..., __epoch, __last): the last key taken."""
    path = [*names, "__epoch"]
    held = [f"__h{i}" for i in range(len(path))]
    renamed = lambda df: df.withColumnsRenamed(dict(zip(path, held)))
    at_leaf = passes.withColumnsRenamed({n: h for n, h in zip(names, held)})
    rows = light.join(at_leaf, _same(names, held[:-1])).drop(*held[:-1]).withColumn("__key", _key(seed))
    found, done = [], 0
    ordered = Window.partitionBy(*path).orderBy("__bin")
    while done < KEY_DIGITS:
        # the tokens of each key that begins with the next digits
        bins = rows.groupBy(*path, F.substring("__key", 1, done + DIGITS).alias("__bin")).agg(F.sum("__tokens").alias("__in"), F.count("*").alias("__n"), F.max("__room").alias("__room"))
        ahead = F.coalesce(F.sum("__in").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = bins.withColumn("__ahead", ahead).where("__ahead < __room").groupBy(*path).agg(F.max_by(F.struct("__bin", "__in", "__n", "__room", "__ahead"), "__bin").alias("__l"))
        last = written(last.select(*path, "__l.*"), "mix-bins")
        whole = F.col("__ahead") + F.col("__in") <= F.col("__room")
        found.append(last.where(whole).select(*path, F.concat("__bin", F.lit("g")).alias("__last")))  # sorts after every digit
        split = last.where(~whole)
        most = split.agg(F.max("__n")).first()[0]
        if most is None:
            return _united(found)
        done += DIGITS
        mine = renamed(split.select(*path, F.col("__bin").alias("__at"), (F.col("__room") - F.col("__ahead")).alias("__left")))
        rows = rows.join(mine, _same(path, held) & (F.substring("__key", 1, done) == F.col("__at"))).withColumn("__room", F.col("__left")).select(*light.columns, "__epoch", "__room", "__key")
        if most <= slot_rows:
            break
        rows = written(rows, "mix-open")
    each = rows.groupBy(*path, F.col("__key").alias("__bin")).agg(F.sum("__tokens").alias("__in"), F.max("__room").alias("__room"))
    before = F.coalesce(F.sum("__in").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found.append(each.withColumn("__before", before).where("__before < __room").groupBy(*path).agg(F.max("__bin").alias("__last")))
    return _united(found)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[Column], total: int | None = None, max_epochs: int = 2, seed: str = SEED, tokens: Column | None = None, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) -> the documents taken, with mix_leaf (struct of the levels), mix_epoch and mix_tokens.

    levels: name -> column over docs, from the root down; weights: for each level, a column over the levels' names.
    total: the tokens to take (all of docs' by default).
    """
    names = list(levels)
    own = docs.columns
    hashed = F.xxhash64("text")
    by_id = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), hashed.cast("string")))
    light = docs.select(*[c.alias(n) for n, c in levels.items()], by_id.alias("__id"), (count_tokens(F.col("text")) if tokens is None else tokens).alias("__tokens"), hashed.alias("__hash"))
    light = written(light, "mix-tokens").where("__tokens > 0")
    leaves = written(light.groupBy(*names).agg(F.count("*").alias("n_docs"), F.sum("__tokens").alias("tokens")), "mix-leaves")
    if total is None:
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
    planned = leaf_budgets(leaves, names, weights, total, max_epochs)
    # passes: whole ones have the leaf's tokens as their budget, the last one what is left
    passes = planned.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("__room", F.least(F.col("tokens"), F.col("budget") - F.col("__epoch") * F.col("tokens"))).where("__room > 0")
    passes = written(passes.select(*names, "__epoch", "__room", (F.col("__room") == F.col("tokens")).alias("__whole")), "mix-passes")
    last = last_keys(light, passes.where(~F.col("__whole")).drop("__whole"), names, seed, slot_rows)
    last = written(last.unionByName(passes.where("__whole").select(*names, "__epoch", F.lit("g").alias("__last"))), "mix-last")

    plain = [f"__c{i}" for i in range(len(own))]
    mine = [f"__n{i}" for i in range(len(names))]
    rows = docs.select(*[F.col(quoted(c)).alias(p) for c, p in zip(own, plain)], *[c.alias(m) for m, c in zip(mine, levels.values())], by_id.alias("__id"), hashed.alias("__hash"), (count_tokens(F.col("text")) if tokens is None else tokens).alias("__tokens"))
    taken = rows.join(last, _same(mine, names)).where(F.col("__tokens") > 0).where((F.col("__last") == "g") | (_key(seed) <= F.col("__last")))
    results = {"mix_leaf": F.struct(*[F.col(m).alias(n) for m, n in zip(mine, names)]), "mix_epoch": F.col("__epoch"), "mix_tokens": F.col("__tokens")}
    return taken.select(*[F.col(p).alias(c) for p, c in zip(plain, own)], *[c.alias(free_name(n, own)) for n, c in results.items()])
