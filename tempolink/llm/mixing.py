"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves are the paths of a domain-language-source tree.  A token budget goes
down the tree by weight; at every node, what a child can't use is handed to its
siblings by weight, so a shortage stays among siblings while they have tokens
and only then shows to the level above.  A leaf offers its documents in seeded
epochs, each in an order of its own, and gives the prefix of that stream that
its budget covers.

A hot leaf is no burden: its tokens are summed in 4096 buckets of the order
key, the one bucket where the budget ends in 4096 smaller ones, and only the
smallest bucket, a sixteen-millionth of the leaf, is put in order.  All other
rows pass by comparison with the last row taken.  Texts are read once to count
their tokens, and once more where the caller wants the rows themselves.

Defined cases: null path columns are the name ''; a null or empty text has no
tokens and is taken if its place lies before the budget's end; ties of the order
key go by id, then text hash; a row without id is ordered by its text; repeated
rows each have a place; an empty table gives no rows; weights of names that
aren't listed are 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

PATH = ("domain", "lang", "source")
#: Target weights below each level's name; what isn't named has 1.
WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 1},
    "source": {},
}
SHARE = 0.9
EPOCHS = 2
SEED = "mix-1"
_HEX = 3


def domain_of(source: Column) -> Column:
    """One of four domains by a hash of the source's name, where a table has none."""
    return F.concat(F.lit("domain"), (F.conv(F.substring(F.md5(source), 1, 1), 16, 10).cast("int") % 4).cast("string"))


def token_count(text: Column) -> Column:
    """Blank-separated words, as a count of tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("double")


def fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``given``: each parent's ``budget`` shared among its children in whole tokens.

    Children get the same amount a weight, none more than its ``cap``.  In the
    order of cap a weight, the level at which the rest would be filled evenly
    rises up to the first child that isn't used up, so the greatest is it.
    Tokens that rounding leaves go to the first children by name that have more.
    """
    among = Window.partitionBy(*parent)
    names = [c for c in PATH if c in children.columns]
    by = among.orderBy(F.col("cap") / F.col("weight"), *names)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")
    left = F.sum("weight").over(among) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = children.withColumn("level", (F.col("budget") - used) / left)
    leveled = leveled.withColumn("level", F.max("level").over(among))
    leveled = leveled.withColumn("given", F.least(F.col("cap"), F.floor(F.col("level") * F.col("weight") + 1e-6).cast("long")))
    more = (F.col("given") < F.col("cap")).cast("int")
    place = F.sum(more).over(among.orderBy(*names).rowsBetween(Window.unboundedPreceding, 0))
    leveled = leveled.withColumn("more", more * (place <= F.col("budget") - F.sum("given").over(among)).cast("int"))
    return leveled.withColumn("given", (F.col("given") + F.col("more")).cast("long")).drop("level", "more")


def budgets(leaves: DataFrame, weights: dict, share: float, epochs: int) -> DataFrame:
    """(path, tokens, budget): whole tokens for each leaf of (path, tokens)."""
    nodes = leaves.withColumn("cap", F.col("tokens") * epochs)
    given = nodes.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("long").alias("budget"))
    for depth in range(1, len(PATH) + 1):
        path, parent = list(PATH[:depth]), list(PATH[: depth - 1])
        children = nodes.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(path[-1], weights))
        children = children.join(given, parent) if parent else children.crossJoin(F.broadcast(given))
        given = fill(children, parent).select(*path, F.col("given").alias("budget"))
    return leaves.join(given, list(PATH)).select(*PATH, "tokens", "budget")


_LEAF = [f"_{c}" for c in PATH]


def _columns(docs: DataFrame, domain: Column | None = None) -> list[Column]:
    """_domain, _lang, _source, _id, _tie, _n: what places a row, and its tokens."""
    names = [docs["domain"] if domain is None else domain, docs["lang"], docs["source"]]
    text = docs["text"].cast("string")
    path = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(_LEAF, names)]
    return [*path, docs["doc_id"].cast("long").alias("_id"), F.xxhash64(text).alias("_tie"), token_count(text).alias("_n")]


def _last_taken(counted: DataFrame, scratch: Scratch, weights: dict, share: float, epochs: int, seed: str) -> DataFrame:
    """Where each leaf's budget ends in its stream of the kept counted rows."""
    leaves = counted.groupBy(*[F.col(n).alias(c) for c, n in zip(PATH, _LEAF)]).agg(F.sum("_n").alias("tokens"))
    given = scratch.keep(budgets(scratch.keep(leaves), weights, share, epochs))
    return _ends(_streamed(counted, epochs, seed), given, scratch)


def _streamed(rows: DataFrame, epochs: int, seed: str) -> DataFrame:
    """Each row once an epoch, with its place in the leaf's stream, a struct that sorts."""
    name = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("text "), F.col("_tie").cast("string")))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("_epoch").cast("string"), name))
    rows = rows.withColumn("_epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
    place = F.struct(F.col("_epoch").alias("epoch"), key.alias("key"), F.coalesce("_id", F.lit(-(2**63))).alias("id"), F.col("_tie").alias("tie"))
    return rows.withColumn("_place", place)


#: Leaves up to which their ends are sent to all tasks; beyond it the same join shuffles.
SEND = 200_000


def _sent(ends: DataFrame) -> DataFrame:
    return F.broadcast(ends) if ends.counts["n"] <= SEND else ends


def _ends(rows: DataFrame, budget: DataFrame, scratch: Scratch) -> DataFrame:
    """(leaf, _last, _before, _budget): the place of each leaf's last taken row and the tokens before it.

    ``rows`` are streamed; leaves without budget have no last row.
    """
    ends = budget.where("budget > 0").select(*[F.col(c).alias(n) for c, n in zip(PATH, _LEAF)], F.col("budget").alias("_budget"), F.lit(0).cast("long").alias("_before"))
    cut = rows
    for depth in range(2):
        bucket = F.struct("_place.epoch", F.substring("_place.key", depth * _HEX + 1, _HEX).alias("b"))
        sums = scratch.keep(cut.withColumn("_bucket", bucket).groupBy(*_LEAF, "_bucket").agg(F.sum("_n").alias("n")))
        along = Window.partitionBy(*_LEAF).orderBy("_bucket")
        until = sums.withColumn("until", F.sum("n").over(along)).join(ends, _LEAF).withColumn("until", F.col("until") + F.col("_before")).where("until >= _budget")
        first = until.groupBy(*_LEAF).agg(F.min(F.struct("_bucket", (F.col("until") - F.col("n")).alias("before"))).alias("end"), F.first("_budget").alias("_budget"))
        ends = scratch.keep(first.select(*_LEAF, F.col("end._bucket").alias("_in"), F.col("end.before").alias("_before"), "_budget"), n=F.count(F.lit(1)))
        cut = cut.join(_sent(ends).select(*_LEAF, "_in"), _LEAF).where(bucket == F.col("_in")).drop("_in")
        ends = ends.drop("_in")
    alike = cut.groupBy(*_LEAF, "_place").agg(F.sum("_n").alias("n")).join(ends, _LEAF)
    start = F.col("_before") + F.sum("n").over(Window.partitionBy(*_LEAF).orderBy("_place")) - F.col("n")
    last = alike.withColumn("start", start).where("start < _budget").groupBy(*_LEAF).agg(F.max(F.struct("_place", "start")).alias("last"), F.first("_budget").alias("_budget"))
    return scratch.keep(last.select(*_LEAF, F.col("last._place").alias("_last"), F.col("last.start").alias("_before"), "_budget"), n=F.count(F.lit(1)))


def _taken(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """The streamed rows up to the last place, with ``_taken``; of equal rows at it, as many as the budget covers."""
    placed = rows.join(_sent(ends), _LEAF)
    whole = placed.where(F.col("_place") < F.col("_last")).withColumn("_taken", F.col("_n"))
    nth = F.row_number().over(Window.partitionBy(*_LEAF).orderBy("_place"))
    last = placed.where(F.col("_place") == F.col("_last")).withColumn("_start", F.col("_before") + (nth - 1) * F.col("_n")).where("_start < _budget")
    last = last.withColumn("_taken", F.least("_n", F.col("_budget") - F.col("_start"))).drop("_start")
    return whole.unionByName(last)


def mix(
    docs: DataFrame, weights: dict = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, domain: Column | None = None, only_rows: bool = False
) -> DataFrame:
    """The chosen rows of docs (with path columns and ``text``), once for each epoch.

    Adds ``epoch``, ``n_tokens`` and ``taken``, the tokens that the budget
    covers: all, or fewer for a leaf's last document.  They replace columns of
    those names, unless ``only_rows``.  ``domain`` stands for that column.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    ends = _last_taken(scratch.keep(docs.select(*_columns(docs, domain))), scratch, weights, share, epochs, seed)
    scratch.release(ends)
    added = ("epoch", "n_tokens", "taken")
    own = [c for c in docs.columns if only_rows or c.lower() not in added]
    rows = docs.select(F.struct(*own).alias("_row"), *_columns(docs, domain))
    out = _taken(_streamed(rows, epochs, seed), ends)
    return out.select("_row.*", *([] if only_rows else [F.col("_epoch").alias("epoch"), F.col("_n").alias("n_tokens"), F.col("_taken").alias("taken")]))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "mixing")
    counted = scratch.keep(docs.select(*_columns(docs, domain_of(F.col("source")))))
    ends = _last_taken(counted, scratch, WEIGHTS, SHARE, EPOCHS, SEED)
    scratch.release(counted, ends)
    out = _taken(_streamed(counted, EPOCHS, SEED), ends)
    return out.select(F.col("_id").alias("doc_id"), *[F.col(n).alias(c) for c, n in zip(PATH, _LEAF)], F.col("_epoch").alias("epoch"), F.col("_n").alias("n_tokens"), F.col("_taken").alias("taken"))


SQL = r"""
WITH rows AS (
  SELECT doc_id, 'domain' || (('0x' || substr(md5(source), 1, 1))::INT % 4) AS domain, lang, source,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM rows GROUP BY ALL),
d0 AS (
  SELECT domain, sum(tokens * 2)::DOUBLE AS cap,
         CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END::DOUBLE AS w,
         (SELECT floor(sum(tokens) * 0.9::DOUBLE) FROM leaf) AS budget
  FROM leaf GROUP BY domain),
d1 AS (
  SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv
  FROM d0 WINDOW b AS (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d2 AS (SELECT *, least(cap, floor(max(lv) OVER () * w + 1e-6)) AS part FROM d1),
d AS (
  SELECT domain, part + CASE WHEN part < cap AND count(*) FILTER (part < cap) OVER (ORDER BY domain) <= budget - sum(part) OVER () THEN 1 ELSE 0 END AS given
  FROM d2),
l0 AS (
  SELECT domain, lang, sum(tokens * 2)::DOUBLE AS cap, any_value(given) AS budget,
         CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::DOUBLE AS w
  FROM leaf JOIN d USING (domain) GROUP BY domain, lang),
l1 AS (
  SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER b, 0)) AS lv
  FROM l0 WINDOW b AS (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT *, least(cap, floor(max(lv) OVER (PARTITION BY domain) * w + 1e-6)) AS part FROM l1),
l AS (
  SELECT domain, lang, part + CASE WHEN part < cap AND count(*) FILTER (part < cap) OVER (PARTITION BY domain ORDER BY lang) <= budget - sum(part) OVER (PARTITION BY domain) THEN 1 ELSE 0 END AS given
  FROM l2),
s0 AS (
  SELECT domain, lang, source, (tokens * 2)::DOUBLE AS cap, tokens, given AS budget, 1::DOUBLE AS w
  FROM leaf JOIN l USING (domain, lang)),
s1 AS (
  SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER b, 0)) AS lv
  FROM s0 WINDOW b AS (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, least(cap, floor(max(lv) OVER (PARTITION BY domain, lang) * w + 1e-6)) AS part FROM s1),
s AS (
  SELECT domain, lang, source, tokens, (part + CASE WHEN part < cap AND count(*) FILTER (part < cap) OVER (PARTITION BY domain, lang ORDER BY source)
    <= s2.budget - sum(part) OVER (PARTITION BY domain, lang) THEN 1 ELSE 0 END)::BIGINT AS budget
  FROM s2),
streamed AS (
  SELECT r.*, e.epoch, s.budget,
         (sum(n_tokens) OVER (PARTITION BY domain, lang, source
            ORDER BY e.epoch, md5('mix-1:' || e.epoch || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - n_tokens)::BIGINT AS start
  FROM rows r JOIN s USING (domain, lang, source), (VALUES (0), (1)) e(epoch))
SELECT doc_id, domain, lang, source, epoch, n_tokens, least(n_tokens, budget - start)::BIGINT AS taken
FROM streamed WHERE start < budget
"""
