"""Amendments: the agreement each one changes, the sections it touches, and chains of versions.

Candidates for an amendment's parent are the agreements that share a party with it; an agreement without one
cannot reach the score that is asked for. Linking looks at groups of agreements that score alike, not at
pairs: a party that has many contracts costs no more than they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .details import located

# Weights of the five signals, what is accepted, words that say nothing of a title, and what a change means.
WEIGHTS = {"parties": 0.40, "recital": 0.25, "title": 0.15, "date": 0.10, "changes": 0.10}
LEAST_SCORE, LEAST_MARGIN = 0.75, 0.20
LISTED, GROUPED = 4, 64  # parties up to which all sets of a document's parties are listed, groups of agreements in a row
AGREEMENT = r"Master\s+Services\s+Agreement|Supply\s+Agreement"
TITLE_CHARACTERS = r"[()\-_.pdf]"
EMPTY_TITLE_WORDS = ("agreement", "contract")
EMPTY_FILE_WORDS = ("amendment", "amended", "first", "second")
IMPACTS = {
    "1.2": "Price calculation and Scope of Work compensation terms replaced.",
    "3": "Contract duration and term provisions replaced.",
    "6": "Payment terms and invoicing mechanics replaced.",
    "15.4": "Additional Errors & Omissions (E&O) insurance coverage requirement added.",
    "general": "Unamended terms remain binding and in full force and effect.",
}
BASES = ("explicit_argument", "composite_candidate_scoring")
PRESERVED = "Preservation: All other provisions of the base agreement remain in full force and effect."


def _says_amendment(c: str = "") -> Column:
    return F.lower(F.coalesce(F.col(f"{c}contract_type"), F.lit(""))).contains("amend") | F.lower(f"{c}filename").contains("amend")


def party_sets(parties: DataFrame) -> DataFrame:
    """document_id, party: the different names of each document in lower case."""
    name = F.lower(F.trim("name"))
    return parties.select("document_id", name.alias("party")).filter("party IS NOT NULL AND party != ''").distinct()


def _recital_words(title: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(F.regexp_replace(title, TITLE_CHARACTERS, " "))), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*EMPTY_TITLE_WORDS))


def _file_words(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"\b[a-z]{4,}\b"), F.lit(0)))


def _is_agreement_file(title: Column) -> Column:
    file = F.lower(title)
    return file.contains("msa") | file.contains("supply") | file.contains("agreement")


def _base(both: Column, c_n: Column, words: Column, typed: Column, theirs: Column) -> Column:
    """What an amendment (a_n, a_low: its opening in lower case, a_names: whether that names an agreement, a_words) scores with an agreement but for days and changes."""
    overlap = F.when(both == F.col("a_n"), 1.0).otherwise(both / (F.col("a_n") + c_n - both))
    recital = F.when(F.exists(words, lambda w: F.col("a_low").contains(w)), 1.0).when(F.col("a_names") & typed, 0.8).otherwise(0.0)
    size = F.size("a_words")
    title = F.when(size == 0, 0.0).otherwise(F.size(F.array_intersect("a_words", theirs)) / F.greatest(size, F.lit(1)))
    return overlap * F.lit(WEIGHTS["parties"]) + recital * F.lit(WEIGHTS["recital"]) + title * F.lit(WEIGHTS["title"])


def _whole(base: Column, date: Column) -> Column:
    changes = F.when(F.col("a_n_changes") > 0, 1.0).otherwise(0.5)
    return F.bround(base + date * F.lit(WEIGHTS["date"]) + changes * F.lit(WEIGHTS["changes"]), 3)


def _sides(contracts: DataFrame, parties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Amendments and agreements with their different parties in order (a_own, c_own); those without a party are left out."""
    sets = party_sets(parties).groupBy("document_id").agg(F.sort_array(F.collect_list("party")).alias("own"))
    rows = contracts.join(sets, "document_id")
    opening = F.coalesce("opening", F.lit(""))
    amending = rows.filter(_says_amendment() | (F.col("n_changes") > 0)).select(
        F.col("document_id").alias("a_id"), F.col("own").alias("a_own"), F.size("own").alias("a_n"), F.lower(opening).alias("a_low"), opening.rlike("(?i)" + AGREEMENT).alias("a_names"),
        F.filter(_file_words(F.col("filename")), lambda w: ~w.isin(*EMPTY_FILE_WORDS)).alias("a_words"), F.col("effective_date").alias("a_date"), F.col("n_changes").alias("a_n_changes"),
        F.coalesce(~_says_amendment(), F.lit(False)).alias("a_agreed"),
    )
    agreed = rows.filter(~_says_amendment()).select(
        F.col("document_id").alias("c_id"), F.col("own").alias("c_own"), F.size("own").alias("c_n"), F.col("filename").alias("c_filename"), F.col("effective_date").alias("c_date"),
    )
    return amending, agreed


def _candidates(amending: DataFrame, agreed: DataFrame) -> DataFrame:
    """a_id, c_id, score of every agreement that shares a party with an amendment: all pairs, each scored."""
    mine = amending.select("a_id", F.explode("a_own").alias("party"))
    theirs = agreed.select("c_id", F.explode("c_own").alias("party"))
    shared = mine.join(theirs, "party").filter("a_id != c_id").groupBy("a_id", "c_id").agg(F.count(F.lit(1)).alias("both"))
    pairs = shared.join(amending, "a_id").join(agreed, "c_id")
    date = F.when(F.col("c_date").isNull() | F.col("a_date").isNull(), 0.7).when(F.col("c_date") <= F.col("a_date"), 1.0).otherwise(0.2)
    file = F.col("c_filename")
    return pairs.select("a_id", "c_id", _whole(_base(F.col("both"), F.col("c_n"), _recital_words(file), _is_agreement_file(file), _file_words(file)), date).alias("score"))


def _subsets(own: Column) -> Column:
    """Every set of some of the parties: a key (names with their lengths, so that no two sets have the same) and its size."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size(own)).cast("int") - 1)
    named = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    return F.transform(masks, lambda m: F.struct(F.concat_ws("", F.transform(F.filter(own, lambda x, i: F.getbit(m, i) == 1), named)).alias("key"), F.bit_count(m).alias("both")))


def _groups(agreed: DataFrame) -> DataFrame:
    """key, groups (array of words, c_n, n, undated, steps): agreements by the sets of parties they have, ``GROUPED`` groups a row at most.

    Agreements of a key whose file names have the same words and who have as many parties score alike but for their day. steps: day, the three least documents up to it, wherever they change;
    undated: the three least documents without a day."""
    breaks = F.lit("\n")  # in no word
    file = F.col("c_filename")
    words = F.concat(F.concat_ws(" ", F.array_sort(F.array_distinct(_recital_words(file)))), breaks, F.concat_ws(" ", F.array_sort(_file_words(file))), breaks, _is_agreement_file(file).cast("string"))
    group = ["hash", "key", "words", "c_n"]
    rows = agreed.select(words.alias("words"), "c_n", F.col("c_date").alias("date"), F.col("c_id").alias("id"), F.explode(_subsets(F.col("c_own"))).alias("s")).select("s.key", "words", "c_n", "date", "id")
    rows = rows.withColumns({"hash": F.xxhash64(*group[1:]), "undated": F.col("date").isNull()}).repartition("hash")
    order = Window.partitionBy(*group, "undated").orderBy("date", "id")
    # three running minima: what the first one lets go of is offered to the second, and so on
    least = lambda c: F.min(c).over(order)
    beaten = lambda c, held: F.when(F.col(c).isNotNull() & F.lag(held).over(order).isNotNull(), F.greatest(F.col(c), F.lag(held).over(order)))
    rows = rows.withColumns({"n": F.row_number().over(order), "m1": least("id")})
    rows = rows.withColumn("x2", beaten("id", "m1")).withColumn("m2", least("x2")).withColumn("x3", beaten("x2", "m2")).withColumn("m3", least("x3"))
    ids = F.struct("m1", "m2", "m3")
    rows = rows.withColumn("new", ~F.lag(ids).over(order).eqNullSafe(ids))
    step = F.struct("date", "n", F.array_compact(F.array("m1", "m2", "m3")).alias("ids"))
    steps = lambda yes: F.sort_array(F.collect_list(F.when(F.col("new") & (F.col("undated") == yes), step)))
    size = lambda yes: F.coalesce(F.max(F.when(F.col("undated") == yes, F.col("n"))), F.lit(0))
    made = rows.groupBy(*group).agg((size(True) + size(False)).cast("long").alias("n"), steps(True).alias("without"), steps(False).alias("steps"))
    none = F.array().cast(agreed.select(F.array("c_id")).schema[0].dataType)
    made = made.select("key", "words", "c_n", "n", F.coalesce(F.get("without", F.size("without") - 1)["ids"], none).alias("undated"), "steps")
    part = F.floor((F.row_number().over(Window.partitionBy("key").orderBy("words", "c_n")) - 1) / GROUPED)
    return made.withColumn("part", part).groupBy("key", "part").agg(F.collect_list(F.struct("words", "c_n", "n", "undated", "steps")).alias("groups")).drop("part")


def _listed(amending: DataFrame, agreed: DataFrame) -> DataFrame:
    """a_id, n, entries (array of less, id) of amendments and agreements of up to ``LISTED`` parties, without looking at pairs.

    Of each group an amendment sees the three least documents up to its own day, without a day, and of all with a day (one may be itself,
    one the best, so a second is left), as if they shared just the group's key and, of all, came after it. No pair is
    scored too high that way, and each at least once by what it really shares: the best score, the least document that has it, and
    the second score are those of all pairs. The number of candidates follows by inclusion and exclusion."""
    mine = amending.select(*(c for c in amending.columns if c != "a_own"), F.explode(_subsets(F.col("a_own"))).alias("s")).select("s.key", "s.both", *(c for c in amending.columns if c != "a_own"))
    pairs = mine.join(_groups(agreed), "key")
    kind = f"array<struct<less:double,id:{agreed.schema['c_id'].dataType.simpleString()}>>"
    steps_kind = f"struct<date:string,n:int,ids:array<{agreed.schema['c_id'].dataType.simpleString()}>>"

    def scored(g: Column) -> Column:
        said = F.split(g["words"], "\n")
        words = F.filter(F.split(said[0], " "), lambda w: w != "")  # no word comes back as an empty one
        base = _base(F.col("both"), g["c_n"], words, said[2] == "true", F.split(said[1], " "))
        last = lambda steps: F.element_at(F.concat(F.array(F.lit(None).cast(steps_kind)), steps), -1)["ids"]
        upto = F.filter(g["steps"], lambda x: x["date"] <= F.col("a_date"))
        return F.struct(base.alias("base"), last(upto).alias("upto"), g["undated"].alias("undated"), last(g["steps"]).alias("every"))

    def entries(x: Column) -> Column:
        some = lambda ids, date: F.transform(F.filter(ids, lambda i: i != F.col("a_id")), lambda i: F.struct((-_whole(x["base"], date)).alias("less"), i.alias("id")))
        parts = (some(x["upto"], F.lit(1.0)), some(x["undated"], F.lit(0.7)), some(x["every"], F.when(F.col("a_date").isNull(), 0.7).otherwise(0.2)))
        return F.concat(*(F.coalesce(p, F.array().cast(kind)) for p in parts))

    n = F.aggregate("groups", F.lit(0).cast("long"), lambda total, g: total + g["n"]) * F.when(F.col("both") % 2 == 1, 1).otherwise(-1)
    seen = pairs.select("a_id", "a_agreed", n.alias("n"), F.flatten(F.transform(F.transform("groups", scored), entries)).alias("all"))
    found = seen.select("a_id", "a_agreed", "n", _best_two(F.col("all")).alias("entries")).groupBy("a_id").agg((F.sum("n") - F.max(F.col("a_agreed").cast("long"))).alias("n"), F.flatten(F.collect_list("entries")).alias("entries"))
    return found.filter("n > 0")


def _best_two(entries: Column) -> Column:
    """Of entries (less, id) the first and the first of another id."""
    return F.flatten(F.transform(F.array(F.array_min(entries)), lambda e: F.array_compact(F.array(e, F.array_min(F.filter(entries, lambda x: x["id"] != e["id"]))))))


def link_amendments(contracts: DataFrame, parties: DataFrame) -> DataFrame:
    """amendment_id, parent_id (null if none is clear), status, top_score, margin, n_candidates of every amendment.

    contracts: document_id, filename, contract_type, effective_date, opening (text of the first two pages), n_changes.
    A parent is clear from a score of 0.75 on, if the second is 0.20 behind or there is no second. Of
    equal scores the least document counts as first. Without a candidate: NO_PARENT_CANDIDATES.

    Documents of more than ``LISTED`` parties are compared in pairs, and with all others; the rest never is."""
    amending, agreed = _sides(contracts, parties)
    small = lambda df, c, yes=True: df.filter((F.size(c) <= LISTED) if yes else (F.size(c) > LISTED))
    found = _listed(small(amending, "a_own"), small(agreed, "c_own"))
    if not party_sets(parties).groupBy("document_id").count().filter(F.col("count") > LISTED).isEmpty():
        pairs = _candidates(small(amending, "a_own", False), agreed).unionByName(_candidates(small(amending, "a_own"), small(agreed, "c_own", False)))
        one = pairs.groupBy("a_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("c_id").alias("id"))).alias("entries"))
        found = found.unionByName(one).groupBy("a_id").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("entries")).alias("entries"))
    first = found.withColumn("first", F.array_min("entries"))
    second = F.array_max(F.transform(F.filter("entries", lambda x: x["id"] != F.col("first.id")), lambda x: -x["less"]))
    best = first.select(F.col("a_id").alias("amendment_id"), F.col("n").alias("n_candidates"), "first", second.alias("second"))
    amendments = contracts.filter(_says_amendment() | (F.col("n_changes") > 0)).select(F.col("document_id").alias("amendment_id"))
    rows = amendments.join(best, "amendment_id", "left")
    top = -F.col("first.less")
    margin = F.bround(top - F.coalesce("second", F.lit(0.0)), 3)
    clear = (top >= LEAST_SCORE) & ((margin >= LEAST_MARGIN) | (F.col("n_candidates") == 1))
    status = F.when(F.col("first").isNull(), "NO_PARENT_CANDIDATES").when(clear, "RESOLVED").otherwise("UNKNOWN_PARENT")
    return rows.select(
        "amendment_id", F.when(clear, F.col("first.id")).alias("parent_id"), status.alias("status"), top.alias("top_score"),
        F.when(top.isNotNull(), margin).alias("margin"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
    )


def catalog(contracts: DataFrame, parties: DataFrame, links: DataFrame) -> DataFrame:
    """document_id, n_parties, parties (different names in order, joined by "; "), parent_id of every document."""
    names = parties.select("document_id", F.trim("name").alias("name")).filter("name != ''").groupBy("document_id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    rows = contracts.select("document_id").join(names, "document_id", "left").join(links.select(F.col("amendment_id").alias("document_id"), "parent_id"), "document_id", "left")
    held = F.coalesce("names", F.array().cast("array<string>"))
    return rows.select("document_id", F.size(held).cast("long").alias("n_parties"), F.array_join(held, "; ").alias("parties"), "parent_id")


def all_parties(parties: DataFrame) -> DataFrame:
    """name, n_documents of every different party."""
    return parties.select("document_id", F.trim("name").alias("name")).filter("name != ''").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_documents"))


def documents_by_party(asked: DataFrame, parties: DataFrame) -> DataFrame:
    """query, document_id (null unless one document alone has it) of queries (query), by substring either way.

    Different names and queries are looked up once each, by the pieces of a text that are as long as some text of the other side: what is compared is equal
    text, never every name with every query. A name or query of any length is one row; its pieces are as many as its places, for each length the other side has."""
    names = parties.select("document_id", F.trim("name").alias("name")).filter("name != ''").select("document_id", F.lower("name").alias("own"))
    held = stored(names.groupBy("own").agg(F.min("document_id").alias("low"), F.max("document_id").alias("high")), "names")
    wanted = asked.select(F.lower(F.trim("query")).alias("want")).filter("want IS NOT NULL").distinct()
    # a name in a query; a query in a name, where a query of equal text is left to the first
    by_name = _pieces(wanted, "want", held, "own").join(held, F.col("_piece") == F.col("own")).select("want", "low", "high")
    in_name = wanted.join(_pieces(held, "own", wanted, "want").filter(F.length("own") > F.length("_piece")), F.col("_piece") == F.col("want")).select("want", "low", "high")
    empty = held.agg(F.min("low").alias("low"), F.max("high").alias("high")).select(F.lit("").alias("want"), "low", "high")  # in every name
    found = by_name.unionByName(in_name).unionByName(empty).groupBy("want").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = asked.select("query", F.lower(F.trim("query")).alias("want")).join(found, "want", "left")
    return rows.select("query", F.when(F.col("low") == F.col("high"), F.col("low")).alias("document_id"))


def _pieces(texts: DataFrame, text: str, others: DataFrame, other: str) -> DataFrame:
    """``texts`` with each different piece (_piece) of ``text`` that is as long as some ``other``; none of no characters."""
    lengths = sorted(r[0] for r in others.select(F.length(other)).distinct().collect() if r[0])  # different lengths
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    fits = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length(text))
    return texts.withColumn("_piece", F.explode(F.array_distinct(F.flatten(F.transform(fits, at)))))


def recital_evidence(blocks: DataFrame) -> DataFrame:
    """document_id, page_number, reading_order of the first block on pages 1 and 2 that names an agreement, else of the first block."""
    at = F.struct("page_number", "reading_order")
    named = (F.col("page_number") <= 2) & F.col("text").rlike("(?i)" + AGREEMENT)
    rows = blocks.groupBy("document_id").agg(F.coalesce(F.min(F.when(named, at)), F.min(at)).alias("at"))
    return rows.select("document_id", F.col("at.page_number").alias("page_number"), F.col("at.reading_order").alias("reading_order"))


def align_sections(changes: DataFrame, links: DataFrame, blocks: DataFrame) -> DataFrame:
    """amendment_id, parent_id, reading_order, section_number, section_title, change_type, before_text, after_text, impact,
    page_number, parent_at (page_number and reading_order of the parent's section; null if it has none).

    changes: amendment_id, page_number, reading_order, action, target_section, raw_text. The parent's section is the first
    block that begins with its number, else the first that names it; what it became is the amendment's block
    that says so on the last page that has one, else the change's own text."""
    key = F.coalesce(F.nullif(F.regexp_extract("target_section", r"([0-9.]+)", 1), F.lit("")), F.lit("general"))
    rows = changes.join(links.filter("parent_id IS NOT NULL").select("amendment_id", "parent_id"), "amendment_id").withColumn("key", key)
    at = F.struct("page_number", "reading_order")
    text = F.trim("text")
    number = F.rtrim(F.regexp_extract(text, r"(?i)^(?:Section\s+)?([0-9.]+)\b(?:\s+([A-Za-z\s]+))?", 1), F.lit("."))
    parents = blocks.join(rows.select(F.col("parent_id").alias("document_id")).distinct(), "document_id", "left_semi")
    numbered = parents.select(F.col("document_id").alias("parent_id"), number.alias("key"), at.alias("at"), "text").filter("key != ''")
    numbered = numbered.groupBy("parent_id", "key").agg(F.min_by(F.struct("text", "at"), "at").alias("numbered"))
    rows = rows.join(numbered, ["parent_id", "key"], "left")
    # the fallback looks only at parents of changes that are still open
    open_ = rows.filter("numbered IS NULL AND key != 'general'").select("parent_id", "key").distinct()
    names = F.col("text").contains(F.concat("key", F.lit("."))) | F.col("text").contains(F.concat(F.lit("Section "), "key"))
    naming = parents.select(F.col("document_id").alias("parent_id"), at.alias("at"), "text").join(open_, "parent_id").filter(names).groupBy("parent_id", "key").agg(F.min_by(F.struct("text", "at"), "at").alias("naming"))
    own = blocks.select(F.col("document_id").alias("amendment_id"), F.struct("page_number", (-F.col("reading_order")).alias("back")).alias("late"), "text").join(rows.select("amendment_id", "key").distinct(), "amendment_id")
    own = own.filter(F.col("text").contains(F.concat(F.lit("Section "), "key")) & F.col("text").contains("shall be")).groupBy("amendment_id", "key").agg(F.max_by("text", "late").alias("became"))
    rows = rows.join(naming, ["parent_id", "key"], "left").join(own, ["amendment_id", "key"], "left")
    titled = F.nullif(F.trim(F.regexp_extract("numbered.text", r"^(?:Section\s+)?[0-9.]+\s+([A-Za-z\s]+)", 1)), F.lit(""))
    title = F.when(F.col("numbered").isNotNull(), titled).when(F.col("naming").isNotNull(), F.concat(F.lit("Section "), "key"))
    impact = reduce(lambda out, x: F.when(F.col("key") == x[0], x[1]).otherwise(out), IMPACTS.items(), F.concat(F.lit("Modifications made to "), "target_section", F.lit(".")))
    kind = F.when(F.col("action").isin("ADD_COVERAGE", "CONFIRM_FULL_FORCE"), F.col("action")).otherwise("DELETE_AND_REPLACE")
    return rows.select(
        "amendment_id", "parent_id", "reading_order", F.col("target_section").alias("section_number"), F.coalesce(title, F.lit("General")).alias("section_title"), kind.alias("change_type"),
        F.coalesce("numbered.text", "naming.text").alias("before_text"), F.coalesce("became", "raw_text").alias("after_text"), impact.alias("impact"),
        "page_number", F.coalesce("numbered.at", "naming.at").alias("parent_at"),
    )


def compare_versions(aligned: DataFrame) -> DataFrame:
    """amendment_id, parent_id, total_modifications, full_force_confirmed, impacts (joined by "; ") of every linked amendment."""
    force = F.col("change_type") == "CONFIRM_FULL_FORCE"
    item = F.when(~force, F.struct("reading_order", F.concat("section_number", F.lit(" ("), "section_title", F.lit("): "), "impact").alias("says")))
    rows = aligned.groupBy("amendment_id", "parent_id").agg(
        F.count(F.lit(1)).alias("total_modifications"), F.max(force).alias("full_force_confirmed"), F.sort_array(F.collect_list(item)).alias("items"),  # of one document
    )
    said = F.concat(F.transform("items", lambda x: x["says"]), F.when(F.col("full_force_confirmed"), F.array(F.lit(PRESERVED))).otherwise(F.array().cast("array<string>")))
    return rows.select("amendment_id", "parent_id", "total_modifications", "full_force_confirmed", F.array_join(said, "; ").alias("impacts"))


def compared_amendments(asked: DataFrame, contracts: DataFrame, links: DataFrame, changes: DataFrame, blocks: DataFrame) -> DataFrame:
    """ask_id, status, amendment_id, parent_id, both file names, confidence, basis, total_modifications, full_force_confirmed,
    impacts, evidence (array of document_id, page_number, reading_order) of each ask (ask_id, wanted, parent_id).

    ``wanted`` is looked up by ``details.located``. A parent that is named counts (confidence 1) if it and an amendment of
    exactly that id are there; else the linked parent does, with its score. Without either the status is NO_RESULTS and all
    else null. Evidence begins with what ties the two together (the first block for a named parent, else the recital), then
    each change and the section it changes in order of the changes; a block counts once, at its first place. A pair
    without changes has 0 of them; a pair asked for twice is compared once. Evidence is null where the amendment has no block.
    Null asks give NO_RESULTS."""
    at = F.struct("page_number", "reading_order")
    names = contracts.select("document_id", "filename")
    found = located(asked, names).select("ask_id", "how", F.col("document_id").alias("amendment_id")).join(asked.select("ask_id", F.col("parent_id").alias("named")), "ask_id")
    found = found.join(names.select(F.col("document_id").alias("amendment_id"), F.col("filename").alias("amendment_filename")), "amendment_id", "left")
    found = found.join(names.select(F.col("document_id").alias("named"), F.lit(True).alias("is_there")), "named", "left")
    found = found.join(links.select("amendment_id", F.col("parent_id").alias("linked"), "top_score"), "amendment_id", "left")
    explicit = (F.col("how") == "exact") & F.coalesce("is_there", F.lit(False))
    found = found.select("ask_id", "amendment_id", "amendment_filename", "top_score", explicit.alias("explicit"), F.when(explicit, F.col("named")).otherwise(F.col("linked")).alias("parent_id"))
    found = found.join(names.select(F.col("document_id").alias("parent_id"), F.col("filename").alias("parent_filename")), "parent_id", "left")
    known = found.filter("parent_id IS NOT NULL")
    pairs = known.select("amendment_id", "parent_id").distinct()
    aligned = align_sections(changes, pairs, blocks)
    own = blocks.join(pairs.select(F.col("amendment_id").alias("document_id")).distinct(), "document_id", "left_semi")
    recitals = recital_evidence(own).select(F.col("document_id").alias("amendment_id"), at.alias("recital"))
    firsts = own.groupBy(F.col("document_id").alias("amendment_id")).agg(F.min(at).alias("opening"))
    # places in order of their first mention, of one pair each
    tie = known.select("amendment_id", "parent_id", "explicit").distinct().join(recitals, "amendment_id").join(firsts, "amendment_id")
    tie = tie.select("amendment_id", "parent_id", "explicit", F.col("amendment_id").alias("document_id"), F.when(F.col("explicit"), F.col("opening")).otherwise(F.col("recital")).alias("at"), F.lit(-1).alias("ord"), F.lit(0).alias("side"))
    sides = F.array(F.struct(F.col("amendment_id").alias("document_id"), at.alias("at"), F.lit(0).alias("side")), F.struct(F.col("parent_id").alias("document_id"), F.col("parent_at").alias("at"), F.lit(1).alias("side")))
    ways = known.select("amendment_id", "parent_id", "explicit").distinct()
    said = aligned.select("amendment_id", "parent_id", F.col("reading_order").alias("ord"), F.inline(sides)).filter("at IS NOT NULL").join(ways, ["amendment_id", "parent_id"])
    key = ["amendment_id", "parent_id", "explicit"]
    places = tie.unionByName(said).groupBy(*key, "document_id", "at").agg(F.min(F.struct("ord", "side")).alias("first"))
    place = F.struct("first", F.struct("document_id", F.col("at.page_number").alias("page_number"), F.col("at.reading_order").alias("reading_order")).alias("place"))
    evidence = places.groupBy(*key).agg(F.sort_array(F.collect_list(place)).alias("_places")).select(*key, F.col("_places.place").alias("evidence"))  # of one amendment's changes
    rows = found.join(compare_versions(aligned), ["amendment_id", "parent_id"], "left").join(evidence, key, "left")
    there = F.col("parent_id").isNotNull()
    return rows.select(
        "ask_id", F.when(there, "SUCCESS").otherwise("NO_RESULTS").alias("status"), F.when(there, F.col("amendment_id")).alias("amendment_id"), "parent_id",
        F.when(there, F.col("amendment_filename")).alias("amendment_filename"), "parent_filename",
        F.when(there, F.when(F.col("explicit"), 1.0).otherwise(F.col("top_score"))).alias("confidence"),
        F.when(there, F.when(F.col("explicit"), BASES[0]).otherwise(BASES[1])).alias("basis"),
        F.when(there, F.coalesce("total_modifications", F.lit(0))).alias("total_modifications"), F.when(there, F.coalesce("full_force_confirmed", F.lit(False))).alias("full_force_confirmed"),
        F.when(there, F.coalesce("impacts", F.lit(""))).alias("impacts"), "evidence",
    )


def version_chains(ordered: DataFrame) -> DataFrame:
    """root_id, layer (from 1), amendment_id, base_id of amendments (root_id, ord, amendment_id): each becomes the next one's base."""
    order = Window.partitionBy("root_id").orderBy("ord", "amendment_id")
    return ordered.select("root_id", F.row_number().over(order).alias("layer"), "amendment_id", F.coalesce(F.lag("amendment_id").over(order), F.col("root_id")).alias("base_id"))


def pairs_of(links: DataFrame) -> DataFrame:
    """document_id, side (amendment or parent), other_id: what a document is paired with, looked up from either side."""
    known = links.filter("parent_id IS NOT NULL")
    amends = known.select(F.col("amendment_id").alias("document_id"), F.lit("amendment").alias("side"), F.col("parent_id").alias("other_id"))
    return amends.unionByName(known.select(F.col("parent_id").alias("document_id"), F.lit("parent").alias("side"), F.col("amendment_id").alias("other_id")))
