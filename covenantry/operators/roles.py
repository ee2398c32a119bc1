"""Roles of parties: stated beside the name, defined, implied by the kind of contract, or stated in a clause. Nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words for each role, and the roles of the first two parties by a word of the contract's type.
ROLE_WORDS = {
    "CUSTOMER": ("customer", "client"),
    "BUYER": ("buyer", "purchaser"),
    "SERVICE_PROVIDER": ("service provider", "provider", "consultant"),
    "SUPPLIER": ("supplier", "vendor", "manufacturer", "seller"),
    "CONTRACTOR": ("contractor", "subcontractor"),
    "LICENSOR": ("licensor", "grantor"),
    "LICENSEE": ("licensee", "grantee"),
    "BORROWER": ("borrower", "debtor"),
    "LENDER": ("lender", "creditor"),
}
PREAMBLE_BLOCKS, DEFINING_PAGES = 8, 3
ARCHETYPES = (("supply", "BUYER", "SUPPLIER"), ("services", "CUSTOMER", "SERVICE_PROVIDER"), ("msa", "CUSTOMER", "SERVICE_PROVIDER"), ("license", "LICENSOR", "LICENSEE"))

#: Patterns over a lower-case text in which \x01 stands for each mention of a party; WORDS for the words of a role.
MENTION, REACH = "\\x01", r"[^.;\x01]"
STATED = rf"""(?:^|[^a-z0-9_]){MENTION}{REACH}{{0,100}}?\((?:the\s+)?['"“]?(?:WORDS)['"”]?\)"""
DEFINED = rf"""['"“]?(?:WORDS)['"”]?\s+(?:means|shall\s+mean|refers\s+to)\s+{REACH}{{0,60}}?{MENTION}"""
ACTING = rf"(?:^|[^a-z0-9_]){MENTION}\s+(?:is\s+the|acts\s+as(?:\s+the)?)\s+(?:WORDS)\b"


def marked(text: Column, name: Column) -> Column:
    """The text in lower case with each mention of the name as one mark, so that all names share their patterns; null without a name."""
    return F.when(name != "", F.replace(F.translate(F.lower(text), "\x01", " "), F.lower(name), F.lit("\x01")))


def _role(text: Column, pattern: str) -> Column:
    """The first role, in their fixed order, whose words the pattern finds."""
    return F.coalesce(*(F.when(text.rlike(pattern.replace("WORDS", "|".join(words))), role) for role, words in ROLE_WORDS.items()))


def opening_texts(blocks: DataFrame) -> DataFrame:
    """document_id, preamble (the first eight blocks of page 1 as one text), definitions array<string> (the blocks of the first
    three pages) of blocks (document_id, page_number, reading_order, is_noise, text). Noise is left out, a null text is empty."""
    kept = blocks.filter((F.col("page_number") <= DEFINING_PAGES) & ~F.coalesce("is_noise", F.lit(False)))
    held = kept.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "reading_order", F.coalesce("text", F.lit("")).alias("text")))).alias("_b"))
    first = F.slice(F.filter("_b", lambda b: b["page_number"] == 1), 1, PREAMBLE_BLOCKS)
    return held.select("document_id", F.array_join(first["text"], " ").alias("preamble"), F.col("_b.text").alias("definitions"))


def party_roles(contracts: DataFrame) -> DataFrame:
    """document_id, ord, name, role from contracts (document_id, contract_type, preamble, definitions, parties array<string>).

    definitions: array<string>, a text each for itself. A role stands in brackets at most 100 characters after a mention of
    the name, without a full stop or semicolon between them; or a definition of it names the party within 60. Of several
    roles in reach the first of ROLE_WORDS counts, and the first definition that has one. Archetypes apply if both of the
    first two parties are still without a role, to supply contracts only if the preamble has a buyer or customer; then
    the preamble may say that a party is the role or acts as it. A party without evidence has a null role; null texts are
    empty; a null or empty list gives no rows."""
    preamble, defined = F.coalesce("preamble", F.lit("")), F.coalesce("definitions", F.array().cast("array<string>"))
    told = lambda n: F.get(F.filter(F.transform(defined, lambda d: _role(marked(d, n), DEFINED)), lambda r: r.isNotNull()), F.lit(0))
    stated = lambda n: F.coalesce(_role(marked(preamble, n), STATED), told(n))
    rows = contracts.select("document_id", F.lower(F.coalesce("contract_type", F.lit(""))).alias("_type"), preamble.alias("preamble"), "parties", F.transform("parties", stated).alias("_found"))
    open_ = (F.size("parties") >= 2) & F.get("_found", F.lit(0)).isNull() & F.get("_found", F.lit(1)).isNull()
    named, kind = F.lower("preamble").rlike("buyer|customer"), F.lit(None).cast("int")
    for k, (word, _, _) in reversed(list(enumerate(ARCHETYPES))):
        kind = F.when(F.col("_type").contains(word), k).otherwise(kind)
    rows = rows.withColumn("_kind", F.when(open_ & ((F.lit(0) != kind) | named), kind))
    implied = F.element_at(F.array(*(F.array(F.lit(a), F.lit(b)) for _, a, b in ARCHETYPES)), F.col("_kind") + 1)
    out = rows.select("document_id", "preamble", "_found", F.when(F.col("_kind").isNotNull(), implied).alias("_implied"), F.posexplode("parties").alias("ord", "name"))
    acting = _role(marked(F.col("preamble"), F.col("name")), ACTING)
    role = F.coalesce(F.get("_found", F.col("ord")), F.get("_implied", F.col("ord")), acting)
    return out.select("document_id", "ord", "name", role.alias("role"))
