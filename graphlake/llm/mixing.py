"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.operators.prefix import running_total
from graphlake.session import cut

BLOCK, ALPHA, SEED = 4096, 0.7, "mix-1"
CELLS, RUN = 4096, 65536
PHI = 0.6180339887498949
_TOKEN = r"[^ \t\n\r\f\x0B]+"


def n_tokens(text) -> F.Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("long")


def placed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs(doc_id, source, n_tokens, ...)`` with ``_start``, a document's first place in its source's shuffled token stream.

    The shuffle order is that of md5(seed, doc_id); the prefix sum goes by cells of that hash, so a hot source
    is spread over 4096 windows.
    """
    tag = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    d = docs.withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_tag", tag).withColumn("_cell", F.substring("_tag", 1, 3))
    return running_total(d, ["_source"], "_cell", [F.col("_tag"), F.col("doc_id"), F.col("n_tokens")], "n_tokens", "_start").drop("_tag", "_cell")


def source_shares(placed_docs: DataFrame, block: int, alpha: float, weights: dict[str, float] | None) -> DataFrame:
    """One row per source that has tokens: its number of blocks and its interval ``[lo, hi)`` of the unit line."""
    s = placed_docs.groupBy(F.col("_source").alias("source")).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    s = s.withColumn("n_blocks", F.ceil(F.col("tokens") / block).cast("long"))
    if weights is None:
        s = s.withColumn("w", F.pow(F.col("n_blocks").cast("double"), F.lit(float(alpha))))
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        s = s.withColumn("w", F.coalesce(table[F.col("source")], F.lit(0.0)).cast("double")).where("w > 0")
    up_to = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("hi", F.sum("w").over(up_to))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("source")), F.lit(0.0)))
    total = F.max("hi").over(Window.partitionBy())
    return s.select("source", "n_blocks", (F.col("lo") / total).alias("lo"), (F.col("hi") / total).alias("hi"))


def slots(shares: DataFrame) -> DataFrame:
    """The schedule: ``(slot, source, block, epoch)``.

    Slot i goes to the source whose interval holds frac(i * golden ratio). The k-th slot of a source takes its block
    k modulo its number of blocks. The schedule ends with the first slot by which every source has been used up once.
    """
    spark = shares.sparkSession
    need, least = shares.agg(F.max(F.col("n_blocks") / (F.col("hi") - F.col("lo"))), F.min(F.col("hi") - F.col("lo"))).first()
    n = 0
    if need:
        n = math.ceil(need)
        n += math.ceil((4 + 2 * math.log(n + 1)) / least)
    u = F.col("slot") * F.lit(PHI) - F.floor(F.col("slot") * F.lit(PHI))
    s = spark.range(n).withColumnRenamed("id", "slot").withColumn("u", u).withColumn("cell", F.floor(F.col("u") * CELLS))
    owned = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    s = s.join(owned, "cell").where("u >= lo AND u < hi").withColumn("run", F.floor(F.col("slot") / RUN)).withColumn("one", F.lit(1))
    s = running_total(s.select("slot", "source", "n_blocks", "run", "one"), ["source"], "run", [F.col("slot")], "one", "rank")
    s = cut(s.select("slot", "source", "rank", "n_blocks"))
    end = s.where("rank = n_blocks - 1").agg(F.max("slot").alias("end"))
    return s.join(F.broadcast(end), F.col("slot") <= F.col("end")).select("slot", "source", (F.col("rank") % F.col("n_blocks")).alias("block"), F.floor(F.col("rank") / F.col("n_blocks")).alias("epoch"))


def mixture(docs: DataFrame, block: int = BLOCK, alpha: float = ALPHA, weights: dict[str, float] | None = None, seed: str = SEED) -> DataFrame:
    """A token mixture of sources: ``(slot, source, block, epoch, doc_id, start_token, end_token)``, one row per piece of a document in a slot.

    The documents of a source, shuffled by md5 of their ids, form one stream that is cut every ``block`` tokens, through
    documents where need be (the last block may be shorter). Target weights are ``weights`` or, by default,
    the number of blocks to the power of ``alpha``. Slots follow :func:`slots`; small sources come round again
    (``epoch``) as often as the weights ask until the last source has been used up, so no document is left out.

    Null and empty texts have no tokens and no piece; a null source counts as the source ''; null doc_ids
    are pieces with a null id; repeated rows are documents of their own; sources without a weight are left out.
    Ties in the shuffle are ordered by doc_id and token count. An empty table gives no rows.
    """
    d = docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"))
    p = cut(placed(d, seed))
    schedule = slots(cut(source_shares(p, block, alpha, weights)))
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("n_tokens") - 1) / block)
    pieces = p.where("n_tokens > 0").withColumn("block", F.explode(F.sequence(first, last))).select(
        F.col("_source").alias("source"),
        "block",
        "doc_id",
        F.greatest(F.lit(0), F.col("block") * block - F.col("_start")).alias("start_token"),
        F.least(F.col("n_tokens"), (F.col("block") + 1) * block - F.col("_start")).alias("end_token"),
    )
    return schedule.join(pieces, ["source", "block"]).select("slot", "source", "block", "epoch", "doc_id", "start_token", "end_token")


def mixed_documents(docs: DataFrame, block: int = BLOCK, alpha: float = ALPHA, weights: dict[str, float] | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` as the mixture holds them: every document as often as the block with its first token is scheduled, columns as they are.

    So documents stay whole and each comes at least once (with ``weights`` given: if its source has one). Documents without tokens stay once.
    """
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    c = lambda name: F.col(f"c{names.index(name)}")
    d = flat.withColumns({"doc_id": c("doc_id"), "source": c("source"), "n_tokens": n_tokens(c("text"))})
    p = cut(placed(d, seed).withColumn("_block", F.floor(F.col("_start") / block)).drop("doc_id", "source", "_start"))
    schedule = slots(cut(source_shares(p, block, alpha, weights)))
    copies = schedule.groupBy(F.col("source").alias("_source"), F.col("block").alias("_block")).agg(F.count("*").cast("int").alias("_copies"))
    out = p.where("n_tokens > 0").join(copies, ["_source", "_block"]).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*flat.columns).unionByName(p.where("n_tokens = 0").select(*flat.columns)).toDF(*names)


def op2_mixing(spark, sf_dir):
    """The mixture of the whole documents table."""
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WITH = f"""
d AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))::BIGINT AS n,
             md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS tag FROM {{docs}}),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY tag, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
b AS (SELECT source, ((sum(n) + {BLOCK - 1}) // {BLOCK})::BIGINT AS n_blocks FROM p GROUP BY source HAVING sum(n) > 0),
c AS (SELECT *, sum(pow(n_blocks::DOUBLE, {ALPHA}::DOUBLE)) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) AS cum FROM b),
s AS (SELECT source, n_blocks, coalesce(lag(cum) OVER (ORDER BY source), 0) / max(cum) OVER () AS lo, cum / max(cum) OVER () AS hi FROM c),
z AS (SELECT ceil(max(n_blocks / (hi - lo)))::BIGINT AS n, min(hi - lo) AS least FROM s),
i AS (SELECT unnest(range((SELECT n + ceil((4 + 2 * ln(n + 1)) / least)::BIGINT FROM z))) AS slot),
u AS (SELECT slot, slot * {PHI}::DOUBLE - floor(slot * {PHI}::DOUBLE) AS u FROM i),
k AS (SELECT slot, source, n_blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM u JOIN s ON u >= lo AND u < hi),
m AS (SELECT slot, source, (rank % n_blocks)::BIGINT AS block, (rank // n_blocks)::BIGINT AS epoch FROM k
      WHERE slot <= (SELECT max(slot) FROM k WHERE rank = n_blocks - 1))"""
SQL = f"""
WITH {_WITH.format(docs='documents')},
q AS (SELECT source, doc_id, n, start, unnest(range(start // {BLOCK}, (start + n - 1) // {BLOCK} + 1)) AS block FROM p WHERE n > 0)
SELECT slot, source, block, epoch, doc_id, greatest(0, block * {BLOCK} - start)::BIGINT AS start_token, least(n, (block + 1) * {BLOCK} - start)::BIGINT AS end_token
FROM m JOIN q USING (source, block)
"""
