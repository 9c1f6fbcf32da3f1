"""Term lookups: building them, exact and nearest matches, and query expansion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.lexicon import FIELD_ONTOLOGIES
from quarry.functions.text import norm_key
from quarry.functions.vector import GUARD


def build_lookup(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(onto, key, id): names beat synonyms; of equal names the last wins, of equal synonyms the first.

    ``terms``: onto, id, name, pos; ``synonyms``: onto, id, syn, pos.
    """
    names = terms.select("onto", norm_key(F.col("name")).alias("key"), "id", F.struct(F.lit(0).alias("kind"), (-F.col("pos")).alias("at")).alias("o"))
    syns = synonyms.select("onto", norm_key(F.col("syn")).alias("key"), "id", F.struct(F.lit(1).alias("kind"), F.col("pos").alias("at")).alias("o"))
    return names.unionByName(syns).groupBy("onto", "key").agg(F.min_by("id", "o").alias("id"))


def field_priority() -> Column:
    """Map of field to its ontologies in order."""
    return F.create_map(*(x for field, ontos in FIELD_ONTOLOGIES.items() for x in (F.lit(field), F.array(*(F.lit(o) for o in ontos)))))


def exact_matches(wanted: DataFrame, lookup: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct (category, raw) with the match of the first ontology that has the term, or nulls.

    A category without ontologies of its own searches all of them in order of name.
    """
    distinct = wanted.select("category", "raw").distinct().withColumn("key", norm_key(F.col("raw")))
    order = F.try_element_at(field_priority(), F.col("category"))
    names = terms.select("onto", "id", F.col("name").alias("onto_name"))
    hits = distinct.join(lookup, "key").withColumn("order", order)
    at = F.when(F.col("order").isNull(), 0).otherwise(F.array_position("order", F.col("onto")))
    hits = hits.withColumn("at", at).where(F.col("order").isNull() | (F.col("at") > 0))
    best = hits.groupBy("category", "raw").agg(F.min(F.struct("at", "onto", "id")).alias("m")).select("category", "raw", "m.onto", "m.id")
    named = best.join(names, ["onto", "id"], "left")
    return distinct.join(named, ["category", "raw"], "left").select("category", "raw", "onto", "id", "onto_name", F.when(F.col("id").isNotNull(), 1.0).otherwise(0.0).alias("confidence"), F.when(F.col("id").isNotNull(), "exact").otherwise("none").alias("method"))


def best_cosines(q: np.ndarray, v: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, cosine) of the row of ``v`` most similar to each row of ``q``, the first of equal ones; 256 by 8192 are compared at a time."""
    size = lambda x: np.sqrt((x * x).sum(1)) + GUARD
    at, score, norms = [], [], size(v)
    for start in range(0, len(q), 256):
        some = q[start : start + 256]
        best_at, best_cos = np.zeros(len(some), np.int64), np.full(len(some), -np.inf)
        for first in range(0, len(v), 8192):
            cos = np.round(some @ v[first : first + 8192].T / (size(some)[:, None] * norms[first : first + 8192]), digits)
            cos[np.isnan(cos)] = -np.inf
            near = cos.argmax(1)
            high = cos[np.arange(len(some)), near]
            better = high > best_cos
            best_at, best_cos = np.where(better, near + first, best_at), np.where(better, high, best_cos)
        at.append(best_at)
        score.append(best_cos)
    return np.concatenate(at), np.concatenate(score)


def nearest_matches(wanted: DataFrame, vectors: DataFrame, threshold: float = 0.65, digits: int = 9, by: str | None = None, block: int = 16_384, chunk: int = 16_384) -> DataFrame:
    """Best term for each (raw, vec) with a cosine of at least ``threshold``; ties go to the smaller id.

    ``wanted`` holds the distinct terms that found no exact match; ``vectors``: id, vec; ``by`` names a column of both
    that must agree. All wanted terms are compared with all vectors, as matrix products of a block of terms and a chunk of
    vectors, so a task holds no more than one of each; vectors are shuffled once for every ``block`` terms. Terms without
    a vector or of another length than a vector don't match it.
    """
    keys = [by] if by else []
    blocks, chunks = (max(1, -(-df.count() // size)) for df, size in ((wanted, block), (vectors, chunk)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = wanted.where("vec is not null").select(*keys, "raw", F.col("vec").cast("array<double>").alias("vec"), F.size("vec").alias("dim"), part("raw", blocks).alias("block"), spread(chunks).alias("chunk"))
    right = vectors.where("vec is not null").select(*keys, "id", F.col("vec").cast("array<double>").alias("vec"), F.size("vec").alias("dim"), part("id", chunks).alias("chunk"), spread(blocks).alias("block"))
    cell = [*keys, "dim", "block", "chunk"]

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {**{k: asked[k] for k in keys}, "raw": asked["raw"]}
        if not len(asked) or not len(held):
            return pa.table({**{k: c.slice(0, 0) for k, c in out.items()}, "id": held["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        held = held.sort_by("id")
        matrix = lambda t: t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        q, v = matrix(asked), matrix(held)
        at, score = best_cosines(q, v, digits)
        return pa.table({**out, "id": held["id"].take(pa.array(at)), "score": pa.array(score)}).filter(pa.array(score >= threshold))

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = ", ".join([*(f"{k} {kind(wanted, k)}" for k in keys), f"raw {kind(wanted, 'raw')}", f"id {kind(vectors, 'id')}", "score double"])
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(best, schema)
    nth = F.row_number().over(Window.partitionBy(*keys, "raw").orderBy(F.desc("score"), "id"))
    return found.withColumn("_nth", nth).where("_nth = 1").select(*keys, "raw", "id", F.round("score", digits).alias("score"))


def normalize_terms(wanted: DataFrame, lookup: DataFrame, terms: DataFrame, vectors: DataFrame | None = None, encode=None, threshold: float = 0.65, nearest=None) -> DataFrame:
    """Exact matches, then nearest ones for the rest; each distinct term is matched once.

    ``vectors``: onto, id, vec; ``encode`` turns a DataFrame with ``raw`` into one with ``raw, vec``. ``nearest`` may stand for ``nearest_matches``:
    it takes terms (raw, vec, onto) and a threshold, and gives (onto, raw, id, score).
    """
    exact = exact_matches(wanted, lookup, terms)
    if vectors is None or encode is None:
        return exact
    missing = encode(exact.where("method = 'none'").select("category", "raw"))
    order = F.coalesce(F.try_element_at(field_priority(), F.col("category")), F.array_sort(F.lit([r[0] for r in vectors.select("onto").distinct().collect()])))  # a handful
    asked = missing.select("category", "raw", "vec", F.posexplode(order).alias("at", "onto"))
    once = asked.select("raw", "vec", "onto").dropDuplicates(["raw", "onto"])
    found = nearest(once, threshold) if nearest else nearest_matches(once, vectors.select("onto", "id", "vec"), threshold, by="onto")
    near = asked.drop("vec").join(found, ["raw", "onto"])
    nth = F.row_number().over(Window.partitionBy("category", "raw").orderBy("at"))
    near = near.withColumn("nth", nth).where("nth = 1").select("category", "raw", F.col("onto").alias("o2"), F.col("id").alias("i2"), "score")
    near = near.join(terms.select(F.col("onto").alias("o2"), F.col("id").alias("i2"), F.col("name").alias("n2")), ["o2", "i2"], "left")
    out = exact.join(near, ["category", "raw"], "left")
    hit = F.col("i2").isNotNull()
    return out.select("category", "raw", F.coalesce("onto", "o2").alias("onto"), F.coalesce("id", "i2").alias("id"), F.coalesce("onto_name", "n2").alias("onto_name"), F.when(hit, F.col("score")).otherwise(F.col("confidence")).alias("confidence"), F.when(hit, "embedding").otherwise(F.col("method")).alias("method"))


def expand_queries(queries: DataFrame, fields: list[str], lookup: DataFrame, synonyms: DataFrame, most: int = 3) -> DataFrame:
    """``queries`` (query_id, query, fields...) with ``expanded``: the query and up to ``most`` synonyms per field."""
    prio = {f: i for i, f in enumerate(FIELD_ONTOLOGIES)}
    ontos = field_priority()
    long = queries.select("query_id", F.explode(F.array(*(F.struct(F.lit(prio.get(f, 99)).alias("fpos"), F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("query_id", "x.*")
    long = long.where("value is not null and value != ''").withColumn("key", norm_key(F.col("value")))
    wanted = long.withColumn("ontos", F.try_element_at(ontos, F.col("field"))).where("ontos is not null").select("query_id", "fpos", "key", F.posexplode("ontos").alias("opos", "onto"))
    hits = wanted.join(lookup, ["onto", "key"])
    nth = F.row_number().over(Window.partitionBy("onto", "id").orderBy("pos"))
    few = synonyms.withColumn("nth", nth).where(F.col("nth") <= most).select("onto", "id", "syn", "nth")
    words = hits.join(few, ["onto", "id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("fpos", "opos", "nth", "syn"))).alias("found"))
    out = queries.join(words, "query_id", "left")
    return out.withColumn("expanded", F.concat_ws(" ", "query", F.array_join(F.transform("found", lambda x: x["syn"]), " "))).drop("found")
