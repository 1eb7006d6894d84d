"""Mixing sources to target weights by hierarchical budgeting.

The documents form a tree (domain, language, source by default). A token budget
goes down the tree: at each node the children get shares proportional to their
weights, but never more than their capacity (tokens below them times
``max_epochs``). What a child cannot use is shared among its siblings; only what
the whole subtree cannot use reaches the ancestors' siblings, because a subtree's
capacity already limits its own share. With the children sorted by capacity per
weight this water-filling has a closed form, so each level is two window sums
over the (small) table of nodes.

A leaf then takes whole epochs and a prefix of one more epoch: its documents in
the order of a seeded hash, up to the first that no longer fits into the rest of
its budget (what is then left of it is used by nobody). The order
is cut into hash buckets of about ``BUCKET_ROWS`` documents; bucket totals decide
all buckets but one, and only that one is put in order. No leaf is ever sorted
as a whole, so a leaf with a third of all rows costs no more than the others.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terminus.llm.common import written

WORDS = r"[^ \t\n\r\f\x0B]+"
BUCKET_ROWS = 1000
NONE = "(none)"
LEVELS = ("domain", "lang", "source")
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
}
BUDGET_SHARE = 0.9
MAX_EPOCHS = 2
SEED = 42


def domain_of(source: Column) -> Column:
    """Domain of a source: one of four, fixed by the first hex digit of its MD5."""
    digit = F.conv(F.substring(F.md5(F.coalesce(source, F.lit(NONE)).cast("binary")), 1, 1), 16, 10).cast("int")
    return F.concat(F.lit("domain"), (digit % 4).cast("string"))


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: Mapping[str, Mapping[str, float]],
            share: float, max_epochs: int) -> DataFrame:
    """``leaves(*levels, tokens, ..)`` -> the same rows with ``target`` (whole tokens)."""
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # of the leaf table, one row a leaf
    nodes = leaves.withColumn("budget", F.floor(everything * F.lit(share)).cast("double"))
    for i, level in enumerate(levels):
        path = list(levels[:i + 1])
        own = weights.get(level) or {}
        weight = F.lit(1.0) if not own else F.coalesce(
            F.create_map(*[F.lit(x) for kv in own.items() for x in kv])[F.col(level)], F.lit(1.0))
        level_nodes = nodes.groupBy(*path).agg(
            (F.sum("tokens") * max_epochs).cast("double").alias("cap"), F.first("budget").alias("given"))
        siblings = Window.partitionBy(*levels[:i]) if i else Window.partitionBy(F.lit(0))
        ranked = siblings.orderBy(F.col("cap") / F.col("w"), level)
        before = F.coalesce(F.sum("cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        onward = F.sum("w").over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        level_nodes = (level_nodes.withColumn("w", weight)
                       .withColumn("lam", (F.col("given") - before) / onward)
                       .withColumn("lam", F.max("lam").over(siblings)).withColumn("all_cap", F.sum("cap").over(siblings))
                       .select(*path, F.when(F.col("given") >= F.col("all_cap"), F.col("cap")).otherwise(
                           F.least(F.col("cap"), F.col("lam") * F.col("w"))).alias("budget")))
        nodes = nodes.drop("budget").join(level_nodes, path)
    return nodes.withColumn("target", F.floor(F.col("budget") + 1e-6).cast("bigint")).drop("budget")


def mix(docs: DataFrame, levels: tuple[str, ...] = LEVELS, weights: Mapping[str, Mapping[str, float]] = WEIGHTS,
        share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        names: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of ``docs`` (all columns) with ``epoch`` and ``n_tokens``, one per use.

    ``names`` gives the expression of a level that is not a column. A null node
    name is the node ``(none)``; nodes without a weight weigh 1. Tokens are
    words; a null or blank text has none and is taken when it stands in its
    leaf's prefix. Rows with one doc_id are ordered by their size and text; equal
    rows are interchangeable. Columns called epoch or n_tokens are replaced; all
    others are kept as they are. An empty table gives no rows.
    """
    names = dict(names if names is not None else {"domain": domain_of(F.col("source"))})
    keys = [f"_mx_{x}" for x in levels]
    rows = docs.select(
        *[F.col(c) for c in docs.columns if c not in ("epoch", "n_tokens")],
        *[F.coalesce(names.get(x, F.col(x)).cast("string"), F.lit(NONE)).alias(k) for x, k in zip(levels, keys, strict=True)],
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("bigint").alias("n_tokens"))
    # One row a leaf; written, as every level of the tree adds it up anew.
    sizes = written(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
                    .withColumnsRenamed(dict(zip(keys, levels, strict=True))))
    plan = budgets(sizes, levels, weights, share, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("tokens")))).otherwise(0)
    plan = written(plan.withColumn("_mx_whole", whole.cast("int"))
                   .withColumn("_mx_rest", F.col("target") - F.col("_mx_whole") * F.col("tokens"))
                   .withColumn("_mx_buckets", F.ceil(F.col("rows") / BUCKET_ROWS).cast("bigint"))
                   .select(*[F.col(x).alias(k) for x, k in zip(levels, keys, strict=True)],
                           "_mx_whole", "_mx_rest", "_mx_buckets"))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("_mx_whole"), F.col("doc_id")).cast("binary"))
    placed = (rows.join(plan, keys).withColumn("_mx_order", order)
              .withColumn("_mx_bucket", F.floor(F.conv(F.substring("_mx_order", 1, 8), 16, 10).cast("bigint")
                                                * F.col("_mx_buckets") / F.lit(float(1 << 32))).cast("bigint")))
    bucket = [*keys, "_mx_bucket"]
    in_order = Window.partitionBy(*keys).orderBy("_mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    fill = written(placed.filter(f"_mx_whole < {max_epochs}").groupBy(*bucket).agg(
        F.sum("n_tokens").alias("_mx_sum"), F.first("_mx_rest").alias("_mx_r"))
        .withColumn("_mx_before", F.coalesce(F.sum("_mx_sum").over(in_order), F.lit(0)))
        .filter("_mx_before <= _mx_r")
        .select(*bucket, (F.col("_mx_r") - F.col("_mx_before")).alias("_mx_left"),
                (F.col("_mx_before") + F.col("_mx_sum") <= F.col("_mx_r")).alias("_mx_all")))
    inside = placed.join(fill.filter("_mx_all").select(*bucket), bucket, "left_semi")
    partly = placed.join(fill.filter("not _mx_all").drop("_mx_all"), bucket)
    running = F.sum("n_tokens").over(
        Window.partitionBy(*bucket).orderBy("_mx_order", "doc_id", "n_tokens", F.xxhash64("text"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    partly = partly.withColumn("_mx_run", running).filter("_mx_run <= _mx_left")
    kept = [F.col(c) for c in rows.columns if c not in keys]
    prefix = inside.select(*kept, F.col("_mx_whole").alias("epoch")).unionByName(
        partly.select(*kept, F.col("_mx_whole").alias("epoch")))
    epochs = F.explode(F.sequence(F.lit(0), F.col("_mx_whole") - 1))
    return placed.filter("_mx_whole > 0").select(*kept, epochs.alias("epoch")).unionByName(prefix)


def oracle_sql() -> str:
    """The default mix as DuckDB SQL (sorts every leaf as a whole)."""
    def weight(level: str) -> str:
        cases = " ".join(f"when '{k}' then {v!r}" for k, v in WEIGHTS.get(level, {}).items())
        return f"case {level} {cases} else 1.0 end" if cases else "1.0"

    domain = "'domain' || ((instr('0123456789abcdef', substr(md5(source), 1, 1)) - 1) % 4)"
    parts = []
    for i, level in enumerate(LEVELS):
        path, up = ", ".join(LEVELS[:i + 1]), ", ".join(LEVELS[:i])
        given = "join b{0} using ({1})".format(i - 1, up) if i else "cross join (select floor(sum(tokens) * %r) as budget from leaf)" % BUDGET_SHARE
        part = f"partition by {up}" if i else ""
        parts.append(f"""
n{i} as (select {path}, cast(sum(tokens) * {MAX_EPOCHS} as double) as cap from leaf group by {path}),
g{i} as (select n{i}.*, cast(budget as double) as given, cast({weight(level)} as double) as w from n{i} {given}),
l{i} as (select *, (given - coalesce(sum(cap) over ({part} order by cap / w, {level} rows between unbounded preceding and 1 preceding), 0))
   / sum(w) over ({part} order by cap / w, {level} rows between current row and unbounded following) as lam from g{i}),
b{i} as (select {path}, case when given >= sum(cap) over ({part}) then cap
   else least(cap, max(lam) over ({part}) * w) end as budget from l{i})""")
    last = len(LEVELS) - 1
    return f"""with d as (select doc_id, lang, source, {domain} as domain,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+')) as bigint) as n_tokens from documents),
leaf as (select domain, lang, source, sum(n_tokens) as tokens from d group by all),{','.join(parts)},
p as (select domain, lang, source, tokens, cast(floor(budget + 1e-6) as bigint) as target,
  case when tokens > 0 then least({MAX_EPOCHS}, floor(floor(budget + 1e-6) / tokens)) else 0 end as whole
  from leaf join b{last} using (domain, lang, source)),
o as (select d.*, cast(whole as int) as whole, target - whole * tokens as rest, sum(n_tokens) over (
  partition by domain, lang, source order by md5('{SEED}|' || cast(whole as int) || '|' || doc_id), doc_id
  rows between unbounded preceding and current row) as run from d join p using (domain, lang, source))
select doc_id, domain, lang, source, whole as epoch, n_tokens from o where whole < {MAX_EPOCHS} and run <= rest
union all
select doc_id, domain, lang, source, cast(e as int) as epoch, n_tokens from o, range({MAX_EPOCHS}) as r(e) where e < whole"""
