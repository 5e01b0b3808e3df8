"""MinHash near-dedup with min-max hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from graphlake.llm import lsh
from graphlake.llm import textops as T
from graphlake.session import cut

SHINGLE, PERMUTATIONS, ROWS, THRESHOLD = 3, 64, 4, 0.45
_SIGS = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("sig", pa.binary())])


def _sign(shingle: int, permutations: int):
    def run(batches):
        for batch in batches:
            doc_ids = T.ids(batch.column("doc_id"))
            for i, j, data, offs in T.chunks(batch):
                if j - i == 1 and len(data) > 2 * T.CHUNK_BYTES:  # a very long text, piece by piece
                    parts = [lsh.raw_extremes(h, np.zeros(len(h), np.int64), 1, permutations, both=True)[1] for h in T.long_shingles(data, shingle) if len(h)]
                    has, sig = np.zeros(min(1, len(parts)), np.int64), lsh.fold(lsh.joined(parts, both=True)) if parts else None
                else:
                    h, doc = T.shingles(data, offs, shingle)
                    has, sig = lsh.extremes(h, doc, j - i, permutations, both=True)
                if len(has):
                    raw = sig.tobytes()
                    step = sig.shape[1] * 2
                    yield pa.RecordBatch.from_arrays([T.id_array(doc_ids[i:j][has]), pa.array(lsh.signature_id(sig)), pa.array([raw[k : k + step] for k in range(0, len(raw), step)], pa.binary())], schema=_SIGS)

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Groups of near-duplicate documents: ``(doc_id, group_id, group_size, keep)``, one row per document of a group of two or more.

    Min-max hashing (Ji et al., 2013): under each of ``permutations`` hash functions both the least and the
    greatest shingle are kept, so a signature of ``2 * permutations`` values takes half the hash evaluations;
    the share of equal values estimates the Jaccard similarity of the sets of lower-cased ``shingle``-token shingles
    without bias. Documents that share a band of ``rows`` values and agree in at least ``threshold`` of the
    signature are linked; groups are the connected components; ``group_id`` is the least doc_id, which is the one kept.

    Null, empty or blank texts have no shingle and are in no group; a text of fewer tokens than a
    shingle has the one shingle of all its tokens; very long texts are read whole, in pieces. Rows with one doc_id count as one document (texts that differ
    join their groups); null doc_ids take no part. Ties cannot arise: the least id keeps. An empty table gives no rows.
    """
    marked = cut(docs.select("doc_id", "text").mapInArrow(_sign(shingle, permutations), "doc_id bigint, sid bigint, sig binary"))
    out = lsh.document_groups(marked, rows, threshold).where("group_size > 1")
    return out.groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.max("group_size").alias("group_size")).withColumn("keep", F.col("doc_id") == F.col("group_id"))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row for each group of near-duplicates, the one of the least doc_id; its columns stay as they are.

    Of repeated rows (one doc_id and text) one stays, the least by the other columns. Rows of one doc_id whose texts differ are both
    kept if their doc_id is. Documents in no group (also those without text or id) stay.
    """
    dup = cut(near_duplicates(docs, **params))
    gone = dup.where("NOT keep").select("doc_id")
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    names = docs.columns
    again = kept.join(twice, "doc_id", "left_semi").select(*names).toDF(*[f"c{i}" for i in range(len(names))])
    key = [f"c{names.index(x)}" for x in ("doc_id", "text")]
    rest = [F.col(f"c{i}") if isinstance(f.dataType, ST.AtomicType) and not isinstance(f.dataType, ST.VariantType) else F.to_json(F.struct(f"c{i}")) for i, f in enumerate(docs.schema.fields) if f"c{i}" not in key]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*(rest or [F.col(c) for c in key])))
    once = again.withColumn("_rank", first).where("_rank = 1").drop("_rank").toDF(*names)
    return kept.join(twice, "doc_id", "left_anti").select(*names).unionByName(once)


def op9_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate groups of the whole documents table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
