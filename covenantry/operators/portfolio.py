"""Portfolio figures, risk signals and the party graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

# Weights of severities in the risk score.
WEIGHTS = {"LOW": 10, "MEDIUM": 25, "HIGH": 45, "CRITICAL": 70}


def histogram(facts: DataFrame, name: str, missing: str) -> DataFrame:
    return facts.groupBy(F.coalesce(F.col(name).cast("string"), F.lit(missing)).alias(name)).agg(F.count(F.lit(1)).alias("n_contracts"))


def risk_signals(facts: DataFrame, obligations: DataFrame) -> DataFrame:
    """document_id, risk_type, severity; at most one row per document and rule."""
    renewal = F.lower("renewal")
    trap = facts.filter(renewal.rlike("automatic|successive")).select("document_id", F.lit("AUTO_RENEWAL_TRAP").alias("risk_type"), F.when(renewal.rlike("60 days|90 days|120 days"), "HIGH").otherwise("MEDIUM").alias("severity"))
    short = facts.filter(F.col("payment_days").cast("string").startswith("15")).select("document_id", F.lit("SHORT_PAYMENT_WINDOW").alias("risk_type"), F.lit("HIGH").alias("severity"))
    late = obligations.filter(F.lower("action").contains("late") & F.lower("action").rlike(r"1\.5%|interest")).select("document_id", F.lit("LATE_INTEREST").alias("risk_type"), F.lit("MEDIUM").alias("severity")).distinct()
    return trap.unionByName(short).unionByName(late)


def risk_scores(facts: DataFrame, signals: DataFrame) -> DataFrame:
    """document_id, n_signals, risk_score (at most 100) of every document."""
    weight = F.create_map(*(F.lit(x) for k, v in WEIGHTS.items() for x in (k, v)))
    found = signals.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.element_at(weight, F.col("severity"))).alias("w"))
    return facts.select("document_id").join(found, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_signals"), F.least(F.lit(100), F.coalesce("w", F.lit(0))).cast("long").alias("risk_score"))


def party_key(name: Column) -> Column:
    """A party's key: punctuation and corporate words dropped, lower case, underscores."""
    plain = F.lower(F.regexp_replace(name, r"[,.\"']", ""))
    bare = F.trim(F.regexp_replace(plain, P.COMPANY_WORDS, ""))
    return F.regexp_replace(F.when(bare != "", bare).otherwise(F.trim(plain)), r"\s+", "_")


def parties(blocks: DataFrame) -> DataFrame:
    """document_id, name, party_key of the named company in each preamble."""
    name = F.regexp_extract("text", r"between\s+(.{1,80}?\s+(Inc|LLC|Ltd|Corp)\.?)\s", 1)
    found = blocks.filter("page_number <= 2").select("document_id", name.alias("name")).filter("name != ''")
    return found.withColumn("party_key", party_key(F.col("name")))


def counterparties(found: DataFrame) -> DataFrame:
    """party_key, n_contracts, first_document."""
    return found.groupBy("party_key").agg(F.count_distinct("document_id").alias("n_contracts"), F.min("document_id").alias("first_document"))


def graph_edges(found: DataFrame, facts: DataFrame) -> DataFrame:
    """source, relationship, target: parties and jurisdictions of contracts."""
    contract = F.concat(F.lit("contract_"), F.col("document_id").cast("string"))
    party = found.select(contract.alias("source"), F.lit("HAS_PARTY").alias("relationship"), F.concat(F.lit("party_"), "party_key").alias("target"))
    back = party.select(F.col("target").alias("source"), F.lit("COUNTERPARTY_TO").alias("relationship"), F.col("source").alias("target"))
    law = facts.filter("governing_law IS NOT NULL").select(contract.alias("source"), F.lit("GOVERNED_BY").alias("relationship"), F.concat(F.lit("jurisdiction_"), F.regexp_replace(F.lower("governing_law"), " ", "_")).alias("target"))
    return party.unionByName(back).unionByName(law)


def graph_nodes(found: DataFrame, facts: DataFrame) -> DataFrame:
    """node_id, node_type of contracts, parties and jurisdictions, each once."""
    contract = facts.select(F.concat(F.lit("contract_"), F.col("document_id").cast("string")).alias("node_id"), F.when(F.col("contract_type") == "Amendment", "AMENDMENT").otherwise("CONTRACT").alias("node_type"))
    party = found.select(F.concat(F.lit("party_"), "party_key").alias("node_id"), F.lit("PARTY").alias("node_type"))
    law = facts.filter("governing_law IS NOT NULL").select(F.concat(F.lit("jurisdiction_"), F.regexp_replace(F.lower("governing_law"), " ", "_")).alias("node_id"), F.lit("JURISDICTION").alias("node_type"))
    return contract.unionByName(party.unionByName(law).distinct())


def graph_check(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """relationship, n_edges, n_orphans (an end is no node), n_loops."""
    known = lambda end: nodes.select(F.col("node_id").alias(end), F.lit(True).alias(f"_{end}")).distinct()
    rows = edges.join(known("source"), "source", "left").join(known("target"), "target", "left")
    orphan = F.col("_source").isNull() | F.col("_target").isNull()
    return rows.groupBy("relationship").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(orphan).alias("n_orphans"), F.count_if(F.col("source") == F.col("target")).alias("n_loops"))


def comparison(found: DataFrame, facts: DataFrame) -> DataFrame:
    """party_key, attribute, n_contracts, n_values, differs: how the contracts of a party compare; missing values count as one."""
    names = ("contract_type", "effective_date", "renewal", "payment_days", "notice_days", "governing_law")
    pairs = F.array(*(F.struct(F.lit(n).alias("attribute"), F.coalesce(F.lower(F.col(n).cast("string")), F.lit("not specified")).alias("value")) for n in names))
    rows = found.select("document_id", "party_key").distinct().join(facts, "document_id").select("party_key", F.inline(pairs))
    # one row per value first, so that a party of a third of the contracts is summed before the shuffle
    values = rows.groupBy("party_key", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("party_key", "attribute").agg(F.sum("n").alias("n_contracts"), F.count(F.lit(1)).alias("n_values"), (F.count(F.lit(1)) > 1).alias("differs"))
