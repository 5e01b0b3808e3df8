"""Knowledge-graph ingestion: triple files, wide CSV, N-Triples, JSON graphs; entities, relations, groups and linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.graph import EDGE_CAPACITY, NODE_CAPACITY
from graphlake.operators.prefix import running_total

HEADER_WORDS = ("subject", "entity1", "head", "source", "sentence")
#: Groups of entities in order of precedence, with the parts of names that tell them.
GROUPS = (
    ("disease", ("tumor", "cancer", "carcinoma")),
    ("gene", ("enzyme", "gene", "protein")),
    ("drug", ("therapy", "drug", "treatment")),
    ("pathway", ("signaling", "pathway")),
    ("symptom", ("jaundice", "pain", "symptom")),
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of text files; numbers rise within a file and differ between files."""
    raw = spark.read.text(path).withColumnRenamed("value", "line")
    return raw.withColumn("line_no", F.monotonically_increasing_id()).select("line_no", "line")


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, '^[ \\t"]+|[ \\t"]+$', "")


def parse_triples(lines: DataFrame) -> DataFrame:
    """Lines ``(line_no, line)`` as ``(line_no, subject, predicate, object, error)``.

    Three fields are a triple; of four or more, fields 2, 4 and 3 are. The first line that is not blank is a header, and dropped, if it has a header word in it. Blank
    lines are dropped; bad ones keep their number and say why: TooFewFields or EmptyField. Fields lose white space and quotes at both ends.
    """
    some = lines.where(F.trim(F.regexp_replace("line", "[\\t\\r]", " ")) != "")
    first = some.agg(F.min("line_no").alias("_first"))
    header = F.lit(False)
    for w in HEADER_WORDS:
        header = header | F.col("line").contains(w)
    some = some.crossJoin(F.broadcast(first)).where(~((F.col("line_no") == F.col("_first")) & header))
    p = F.split(F.regexp_replace("line", "\\r$", ""), ",")
    some = some.withColumn("p", p).withColumn("n", F.size("p"))
    at = lambda i: _clean(F.get("p", F.lit(i)))
    wide = F.col("n") >= 4
    out = some.select("line_no", F.when(wide, at(1)).otherwise(at(0)).alias("subject"), F.when(wide, at(3)).otherwise(at(1)).alias("predicate"), at(2).alias("object"), "n")
    empty = (F.col("subject") == "") | (F.col("predicate") == "") | (F.col("object") == "")
    return out.withColumn("error", F.when(F.col("n") < 3, "TooFewFields").when(empty, "EmptyField")).drop("n")


def entity_id(name: Column | str) -> Column:
    """A positive 62-bit id of a name."""
    return F.xxhash64(F.col(name) if isinstance(name, str) else name).bitwiseAND((1 << 62) - 1) + 1


def triples_to_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities ``(id, name)``, one for each distinct name, and edges ``(src, dst, label)``: loops go, repeated triples stay."""
    good = triples.where("error IS NULL") if "error" in triples.columns else triples
    names = good.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    edges = good.where("subject <> object").select(entity_id("subject").alias("src"), entity_id("object").alias("dst"), F.col("predicate").alias("label"))
    return names.select(entity_id("name").alias("id"), "name"), edges


def parse_wide(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id,name,type[,from,to,label]`` lines: entities of those with three fields or more, relations of those with six; ids that are no numbers are 0."""
    p = lines.where(F.trim("line") != "").withColumn("p", F.transform(F.split("line", ","), lambda x: F.trim(x))).withColumn("n", F.size("p"))
    num = lambda i: F.coalesce(F.get("p", F.lit(i)).try_cast("bigint"), F.lit(0)).cast("long")
    text = lambda i: F.get("p", F.lit(i))
    return p.where("n >= 3").select(num(0).alias("id"), text(1).alias("name"), text(2).alias("type")), p.where("n >= 6").select(num(3).alias("src"), num(4).alias("dst"), text(5).alias("label"))


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """``(subject, predicate, object)`` of N-Triples lines; IRIs lose their brackets, literals their quotes, languages and types. Plain ``s p o`` lines do too. Comments and broken lines are dropped."""
    term = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?|[^\s<"#]\S*)'
    pattern = rf"^\s*{term}\s+{term}\s+{term}\s*\.?\s*$"
    strip = lambda i: F.regexp_replace(F.regexp_replace(F.regexp_extract("line", pattern, i), r'"(@[\w-]+|\^\^<[^>]*>)$', '"'), r'^[<"]|[>"]$', "")
    good = lines.where(~F.col("line").startswith("#") & F.col("line").rlike(pattern))
    return good.select(strip(1).alias("subject"), strip(2).alias("predicate"), strip(3).alias("object"))


def read_json_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` of JSON graph documents."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.explode("nodes").alias("x")).select("x.*"), doc.select(F.explode("edges").alias("x")).select("x.*")


def group_of(name: Column | str) -> Column:
    """The first group that has a keyword in the lower-cased name; ``other`` for none."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    out = None
    for group, words in GROUPS:
        hit = low.rlike("|".join(words))
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise("other")


def relation_histogram(triples: DataFrame, top: int | None = None) -> DataFrame:
    """``(relation, n)``, the most frequent first, ties by name."""
    out = triples.groupBy(F.col("predicate").alias("relation")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation")
    return out.limit(top) if top else out


def number_entities(names: DataFrame) -> DataFrame:
    """``(entity_no, name)``: distinct names numbered from 0 in order. Ranks are local to names of one beginning; only their counts are summed up in one place."""
    n = names.select("name").distinct().withColumn("cell", F.substring("name", 1, 4)).withColumn("one", F.lit(1))
    return running_total(n, [], "cell", [F.col("name")], "one", "entity_no").select("entity_no", "name")


def link_entities(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(doc_id, entity, alias, confidence)``: whole tokens of ``texts(doc_id, text)`` that are aliases ``(entity, alias)``, case folded; confidence is shared among entities of one alias."""
    a = aliases.select("entity", F.lower("alias").alias("alias")).distinct()
    n = a.groupBy("alias").agg(F.count("*").alias("n"))
    tokens = texts.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("alias")).where("alias <> ''")
    return tokens.join(a, "alias").join(n, "alias").select("doc_id", "entity", "alias", F.round(1 / F.col("n"), 6).alias("confidence"))


def extract_relations(texts: DataFrame, patterns: list[tuple[str, str, float]]) -> DataFrame:
    """``(doc_id, subject, relation, object, confidence)`` of all matches of ``(regex with two groups, relation type, confidence)``."""
    out = None
    for regex, kind, confidence in patterns:
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(regex), 1).alias("s"), F.regexp_extract_all("text", F.lit(regex), 2).alias("o"))
        one = texts.where(F.col("text").rlike(regex)).select("doc_id", F.explode(pairs).alias("x"))
        one = one.select("doc_id", F.lower("x.s").alias("subject"), F.lit(kind).alias("relation"), F.lower("x.o").alias("object"), F.lit(float(confidence)).alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


def import_csv(spark: SparkSession, path: str) -> dict:
    """Parse and load a triple file; the counts that the import endpoint reports."""
    t = parse_triples(read_lines(spark, path)).where("error IS NULL")
    nodes, edges = triples_to_graph(t)
    counts = t.agg(F.count("*").alias("t")).crossJoin(nodes.agg(F.count("*").alias("n"))).crossJoin(edges.agg(F.count("*").alias("e"))).first()
    return {"status": "success", "message": "CSV data imported", "triples_parsed": counts.t, "database_nodes": counts.n, "database_edges": counts.e, "utilization": (counts.n + counts.e) / (NODE_CAPACITY + EDGE_CAPACITY)}


def read_edge_csv(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """CSV with a header that names ``source``, ``target`` and ``label`` columns (by default the first three): entities once each, and edges."""
    raw = spark.read.option("header", True).csv(path)
    pick = [n if n in raw.columns else raw.columns[i] for i, n in enumerate(("source", "target", "label"))]
    rows = raw.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in zip(pick, ("subject", "object", "predicate"), strict=True)])
    rows = rows.where("subject <> '' AND object <> ''")
    return triples_to_graph(rows.limit(limit) if limit else rows)


def dataset_summary(rows: DataFrame, top: int = 10) -> DataFrame:
    """Of ``(head, relation, tail)`` rows: one row with the numbers of triples, entities and relation types, and JSON of group sizes and of the ``top`` relations."""
    good = rows.where("head IS NOT NULL AND tail IS NOT NULL AND relation IS NOT NULL")
    names = good.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    groups = names.groupBy(group_of("name").alias("g")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("entities"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("g", "n"))))).alias("groups"))
    kinds = good.groupBy("relation").agg(F.count("*").alias("n"))
    best = kinds.orderBy(F.desc("n"), "relation").limit(top).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "relation", "n"))), lambda x: F.struct(x["relation"].alias("relation"), x["n"].alias("n")))).alias("top_relations"))
    counts = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("triples"), F.count("*").alias("relation_types"))
    return counts.crossJoin(groups).crossJoin(best).select("triples", F.coalesce("entities", F.lit(0)).alias("entities"), "relation_types", "groups", "top_relations")
