"""Technique similarity: groups and their techniques from a STIX bundle, inverse frequencies, norms, cosine ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP, EXPLAINED = 3, 5
TECHNIQUE = r"^T\d{4}(\.\d{3})?$"


def with_parents(uses: DataFrame, term: str = "technique_id") -> DataFrame:
    """A sub-technique counts for its parent too."""
    base = F.substring_index(term, ".", 1)
    out = uses.withColumn(term, F.explode(F.array_distinct(F.array(F.col(term), base))))
    return out.where(F.col(term).rlike(TECHNIQUE)).distinct()


def stix_uses(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group_id, technique_id) and (technique_id, tactic_id) of a bundle's objects, one object a row."""
    external = F.try_element_at(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(1))["external_id"]
    objects = objects.withColumn("xid", external)
    groups = objects.where("type = 'intrusion-set'").select(F.col("id").alias("source_ref"), F.coalesce("xid", "id").alias("group_id"))
    techniques = objects.where((F.col("type") == "attack-pattern") & F.col("xid").rlike(TECHNIQUE)).select(F.col("id").alias("target_ref"), F.col("xid").alias("technique_id"), "kill_chain_phases")
    relations = objects.where("type = 'relationship' AND relationship_type = 'uses'").select("source_ref", "target_ref")
    uses = relations.join(groups, "source_ref").join(techniques.select("target_ref", "technique_id"), "target_ref").select("group_id", "technique_id")
    tactics = objects.where("type = 'x-mitre-tactic' AND xid IS NOT NULL AND x_mitre_shortname IS NOT NULL").select(F.col("xid").alias("tactic_id"), F.col("x_mitre_shortname").alias("phase_name"))
    phases = techniques.select("technique_id", F.explode("kill_chain_phases").alias("p")).where("p.kill_chain_name = 'mitre-attack'").select("technique_id", F.col("p.phase_name").alias("phase_name"))
    of = phases.join(tactics, "phase_name").select("technique_id", "tactic_id")
    return with_parents(uses), with_parents(of)


def idf(uses: DataFrame, term: str, n_groups: int) -> DataFrame:
    """term, df, idf = ln((N + 1) / (df + 1)) + 1, N being the number of groups that use a technique."""
    out = uses.select("group_id", term).distinct().groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    return out.withColumn("idf", F.log(F.lit(n_groups + 1.0) / (F.col("df") + 1)) + 1)


def norms(uses: DataFrame, weights: DataFrame, term: str) -> DataFrame:
    """group_id, norm: the Euclidean norm of each group's weights."""
    return uses.select("group_id", term).distinct().join(weights, term).groupBy("group_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))


def cosine(attack: DataFrame, uses: DataFrame, weights: DataFrame, term: str) -> DataFrame:
    """group_id, cosine, shared (the shared terms of most weight) for an attack's terms (one a row)."""
    own = attack.select(term).distinct().join(weights, term)
    length = own.agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("own_norm"))
    hits = uses.select("group_id", term).distinct().join(own.select(term, "idf"), term)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("w"), F.col(term).alias("t")))), 1, EXPLAINED)
    both = hits.groupBy("group_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"), best.alias("b"))
    out = both.join(norms(uses, weights, term), "group_id").crossJoin(F.broadcast(length))  # one row
    return out.select("group_id", (F.col("dot") / (F.col("norm") * F.col("own_norm"))).alias("cosine"), F.transform("b", lambda x: x["t"]).alias("shared"))


def ranked(attack_techniques: DataFrame, attack_tactics: DataFrame, uses: DataFrame, tactic_uses: DataFrame, top: int = TOP) -> DataFrame:
    """group_id, score, techniques, tactics: half the cosine of techniques and half that of tactics; the best ``top``."""
    n = uses.select("group_id").distinct().count()
    by_technique = cosine(attack_techniques, uses, idf(uses, "technique_id", n), "technique_id")
    by_tactic = cosine(attack_tactics, tactic_uses, idf(tactic_uses, "tactic_id", n), "tactic_id")
    a = by_technique.select("group_id", F.col("cosine").alias("c1"), F.col("shared").alias("techniques"))
    b = by_tactic.select("group_id", F.col("cosine").alias("c2"), F.col("shared").alias("tactics"))
    score = F.lit(0.5) * F.coalesce("c1", F.lit(0.0)) + F.lit(0.5) * F.coalesce("c2", F.lit(0.0))
    out = a.join(b, "group_id", "full_outer").select("group_id", score.alias("score"), "techniques", "tactics").where("score > 0")
    return out.orderBy(F.col("score").desc(), "group_id").limit(top)


def cosines(attacks: DataFrame, uses: DataFrame, weights: DataFrame, term: str) -> DataFrame:
    """entity, group_id, cosine, shared of all entities (entity, term) and the groups that they share a term with.

    A sparse product: entities meet groups by equal terms, and products are summed by pairs; pairs without a shared term
    are never made. Groups, their terms and weights are a table of reference data and small beside the entities.
    """
    own = attacks.select("entity", term).distinct().join(weights.select(term, "idf"), term)
    length = own.groupBy("entity").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("own_norm"))
    hits = own.join(uses.select("group_id", term).distinct(), term)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("w"), F.col(term).alias("t")))), 1, EXPLAINED)
    both = hits.groupBy("entity", "group_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"), best.alias("b"))
    out = both.join(length, "entity").join(norms(uses, weights, term), "group_id")
    return out.select("entity", "group_id", (F.col("dot") / (F.col("norm") * F.col("own_norm"))).alias("cosine"), F.transform("b", lambda x: x["t"]).alias("shared"))


def ranked_all(techniques: DataFrame, tactics: DataFrame, uses: DataFrame, tactic_uses: DataFrame, top: int = TOP) -> DataFrame:
    """entity, place, group_id, score, techniques, tactics: ``ranked`` for all entities at once, the best ``top`` groups of each.

    Ties (scores equal to 12 decimals) go by group_id.
    """
    n = uses.select("group_id").distinct().count()
    sides = [cosines(a, u, idf(u, term, n), term) for a, u, term in ((techniques, uses, "technique_id"), (tactics, tactic_uses, "tactic_id"))]
    a = sides[0].select("entity", "group_id", F.col("cosine").alias("c1"), F.col("shared").alias("techniques"))
    b = sides[1].select("entity", "group_id", F.col("cosine").alias("c2"), F.col("shared").alias("tactics"))
    score = F.lit(0.5) * F.coalesce("c1", F.lit(0.0)) + F.lit(0.5) * F.coalesce("c2", F.lit(0.0))
    out = a.join(b, ["entity", "group_id"], "full_outer").select("entity", "group_id", score.alias("score"), "techniques", "tactics").where("score > 0")
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.round("score", 12).desc(), "group_id"))
    return out.withColumn("place", place).where(F.col("place") <= top)
