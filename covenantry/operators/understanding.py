"""Questions analysed as a table: cues in their words, the document and parties they name, roles, expansion and route.

What a question says by itself is column expressions. Names of the catalog are found by equi-joins on their
longest run of letters and digits, then compared whole; they are summed up per name first, so that a name
that many documents have is one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

# Questions that contracts do not answer; roles; words of names that say nothing; triggers and synonyms of routes.
UNANSWERABLE = (
    r"\btell me something not contained\b", r"\bceo personal salary\b", r"\bstock ticker\b", r"\bweather\b", r"\bwho is the president\b", r"\bnot mentioned in the contracts\b",
    r"\bgdpr.*(penalty|fine|multiplier|administrative)\b", r"\blondon arbitration|lcia\b", r"\bbitcoin|cryptocurrency\b", r"\bcarbon emission\b", r"\b2025.*non-renewal\b", r"\b2029\b",
    r"\bparent guarantee.*hon hai\b", r"\bon what exact calendar date\b", r"\bexact deadline date\b", r"\bspecific calendar date of final payment\b", r"\bon what date did.*cure\b",
    r"\bliquidated damages for delayed shipment\b", r"\bnon-compete restriction period\b", r"\bwhat calendar day\b",
)
ROLES = (
    ("vendor", "SUPPLIER"), ("supplier", "SUPPLIER"), ("manufacturer", "SUPPLIER"), ("seller", "SUPPLIER"), ("buyer", "BUYER"), ("purchaser", "BUYER"), ("customer", "CUSTOMER"),
    ("client", "CUSTOMER"), ("service provider", "SERVICE_PROVIDER"), ("provider", "SERVICE_PROVIDER"), ("contractor", "CONTRACTOR"), ("licensor", "LICENSOR"), ("licensee", "LICENSEE"),
    ("borrower", "BORROWER"), ("lender", "LENDER"), ("both parties", "MUTUAL"), ("each party", "MUTUAL"),
)
UNKNOWN_ROLE = r"\bunknown\s+(vendor|supplier|party|entity|contractor)\b"
WITHIN = r"\bwithin\s+(\d{1,3})\s+(days?|months?|years?)\b"
RECURRING = r"\b(monthly|quarterly|annually|weekly|semi-annually)\b"
BEFORE_AFTER = r"\b(\d{1,3})\s+days?\s+(before|after|prior to)\s+([a-z\s]+?)(\?|$|\.|,)"
CHANGE_WORDS = ("what changed", "modifications", "amended", "amendment diff", "what did the amendment change")
COMPARE_WORDS = ("compare", "difference between", "how do.*differ", "across agreements")
COMPANY_END = r"[,\s]+(Inc|LLC|Corp|Corporation|Co|Ltd|N\.A\.)\.?$"
NAME_STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "what", "which", "when", "where", "how", "all", "any", "our", "your", "their", "its", "inc", "llc", "corp", "corporation",
    "company", "limited", "ltd", "agreement", "contract", "services", "management", "holdings", "group", "partners", "fund", "advisers", "advisors", "investment", "financial",
    "national", "association", "bank", "chief", "compliance", "officer", "executive", "director", "under",
)
FIRST_STOPWORDS = ("the", "inc", "llc", "corp", "co", "ltd", "company", "financial", "corporation")
FILE_STOPWORDS = ("agreement", "master", "services", "contract")
AMENDMENT_FILE_STOPWORDS = ("amendment", "agreement")
DISTRACTING = ("obligations", "responsibilities", "under")
SYNONYMS = {
    "obligation": ("shall", "obligations", "duties", "covenants"), "payment": ("payment terms", "invoices", "payable", "net"),
    "timeline": ("term", "expiration", "effective date", "renewal"), "amendment": ("amendment", "replaces", "deletes", "modifies"), "comparison": ("amendment", "replaces", "deletes", "modifies"),
}
TRIGGERS = {
    "comparison": (
        r"\bdifferen(ce|t)\s+(table|between|of)\b", r"\bcompare\b", r"\bcompar(e|ison)\s+(the\s+)?(two|both|documents?|contracts?)\b", r"\bcontrast\s+(the\s+)?(two|both|documents?|contracts?)\b",
        r"\bhow\s+(do|does|did)\s+(the\s+)?(two|both|these)\b", r"\bdiff(erence)?\s+(between|of)\b", r"\bside[\s-]?by[\s-]?side\b", r"\bvs\.?\s+\b", r"\bkey\s+differences?\b",
        r"\bwhat('s|\s+is|\s+are)\s+(the\s+)?differences?\b", r"\bhow\s+(are|do)\s+(the\s+)?(two|both|these|they)\s+(differ|compare|contrast)\b",
    ),
    "amendment": (r"\bwhat changed in (the|an)?\s*([a-z0-9*.'\-]+\s+)*amendment\b", r"\bhow did the amendment change\b", r"\bamendment modifications?\b", r"\bamends?\b", r"\bwhich amendments?\b"),
    "timeline": (
        r"\bwhen does ([a-z0-9*.'\-]+\s+)*(agreement|contract|msa)?\s*expire\b", r"\bexpiration date\b", r"\beffective date\b", r"\bupcoming (contract )?events?\b", r"\bupcoming deadlines?\b",
        r"\btimeline\b", r"\bcalendar\b", r"\bwhat should i (review|worry about) (first|this month)\b",
    ),
    "obligation": (
        r"\bwhat obligations?\b", r"\bwhat duties\b", r"\b(vendor|supplier|client|party|buyer|customer)['s]*\s+obligations?\b", r"\bobligations?\s+of\s+(the\s+)?(vendor|supplier|client|party|buyer|customer)\b",
        r"\bwhat must (the\s+)?[a-z0-9*.'\-]+\b", r"\bwhat does (the\s+)?[a-z0-9*.'\-]+\s+have to\b", r"\breporting obligations?\b", r"\bcompliance obligations?\b", r"\bongoing covenant\b",
    ),
    "graph_party": (r"\bwhich contracts involve\b", r"\bcontracts involving\b", r"\bcontracts with\b", r"\bwho are the parties\b", r"\bparties to\b", r"\bcounterpart(y|ies)\b"),
    "graph_term": (
        r"\bwhich contracts have net\b", r"\bwhich contracts have \d+-day\b", r"\bcontracts with payment terms?\b", r"\bwhich agreements have renewal\b", r"\bwhich contracts contain renewal\b",
        r"\bwhich contracts specify termination notice\b", r"\bwhich contracts have termination notice\b",
    ),
}
OVERVIEWS = (
    "what is the contract about", "what is this contract about", "what is this agreement about", "what is this about", "what is it about", "summarize this contract", "summarize the contract",
    "summarize this agreement", "summarize the agreement", "summarize this", "summarize it", "contract summary", "agreement summary", "tell me about this contract", "tell me about this agreement",
    "tell me about this", "tell me about it", "what does this contract cover", "what does this agreement cover", "what is the scope of this contract", "what is the scope of this agreement",
    "overview of this contract", "overview of the contract", "overview of this agreement", "overview of this", "who are the parties", "parties involved", "who signed this", "who is involved",
    "what parties", "who entered into this",
)
DETAILS, DETAILED = ("payment terms in", "governing law of", "details of", "overview of", "parties to"), ("agreement", "contract", "msa")
AMONG, MONEY = ("involving", "with"), ("net", "payment")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _triggered(text: Column, name: str) -> Column:
    return text.rlike("|".join(TRIGGERS[name]))


def comparison(low: Column) -> Column:
    return F.when(_has(low, CHANGE_WORDS), "amendment_change").when(_has(low, COMPARE_WORDS), "multi_contract")


def intent(low: Column) -> Column:
    rules = reversed([(name, [_has(low, group) for group in groups]) for name, groups in P.INTENTS])
    found = reduce(lambda out, r: F.when(reduce(lambda a, b: a & b, r[1]), r[0]).otherwise(out), rules, F.lit("information"))
    said = comparison(low)
    return F.when(low.rlike("|".join(UNANSWERABLE)), "unanswerable").when(said == "amendment_change", "amendment").when(said == "multi_contract", "comparison").otherwise(found)


def role(low: Column) -> tuple[Column, Column]:
    """The longest role that a question names, and what it is called; an "unknown vendor" is no role."""
    longest = sorted(ROLES, key=lambda r: -len(r[0]))
    pick = lambda k: reduce(lambda out, r: F.when(low.rlike(rf"\b{r[0]}s?\b"), r[k]).otherwise(out), reversed(longest), F.lit(None).cast("string"))
    unknown = low.rlike(UNKNOWN_ROLE)
    return F.when(unknown, "unknown vendor").otherwise(pick(0)), F.when(unknown, "UNKNOWN").otherwise(pick(1))


def cues(questions: DataFrame) -> DataFrame:
    """What each question (query_id, text) says by itself: intent, comparison, sections, role, times and numbers. A null text says nothing."""
    text = F.trim(F.coalesce("text", F.lit("")))
    low = F.lower(text)
    group = lambda p, k: F.regexp_extract(low, p, k)
    some = lambda c: F.nullif(c, F.lit(""))
    each = F.when(group(WITHIN, 2).contains("month"), 30).when(group(WITHIN, 2).contains("year"), 365).otherwise(1)
    surface, called = role(low)
    sign = F.when(group(BEFORE_AFTER, 2) == "after", 1).otherwise(-1)
    return questions.select(
        "query_id", intent(low).alias("intent"), comparison(low).alias("comparison"),
        F.array_join(F.when(comparison(low) == "amendment_change", F.regexp_extract_all(low, F.lit(r"section\s+([0-9.]+)"), F.lit(1))), ",").alias("sections"),
        surface.alias("role_surface"), called.alias("role"), (group(WITHIN, 1).try_cast("int") * each).alias("within_days"), some(group(RECURRING, 1)).alias("recurring"),
        (group(BEFORE_AFTER, 1).try_cast("int") * sign).alias("offset_days"), some(F.trim(group(BEFORE_AFTER, 3))).alias("offset_event"),
        F.coalesce(some(F.regexp_extract(text, r"(?i)\b(net\s*)?(\d{2,3})\b", 2)), F.lit("30")).alias("payment_term"), F.regexp_extract(text, r"\b(\d{1,3})\b", 1).try_cast("int").alias("number"),
    )


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))


def _longest(text: Column) -> Column:
    """The longest run of letters and digits, of equal ones the last."""
    start = F.lit("")
    return F.aggregate(_runs(text), start, lambda a, x: F.when(F.length(x) >= F.length(a), x).otherwise(a))


def _whole(low: Column, part: Column) -> Column:
    return F.regexp_like(low, F.concat(F.lit(r"(^|[^a-z0-9])\Q"), part, F.lit(r"\E([^a-z0-9]|$)")))


def _asked(questions: DataFrame) -> DataFrame:
    low = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    return questions.select("query_id", low.alias("low"), F.explode(F.array_distinct(_runs(low))).alias("run"))


def _found(questions: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` (part, ...) that stand in a question as whole words, each once."""
    return _asked(questions).join(parts.withColumn("run", _longest(F.col("part"))).filter("run != ''"), "run").filter(_whole(F.col("low"), F.col("part"))).drop("low", "run")


def entities(questions: DataFrame, parties: DataFrame) -> DataFrame:
    """query_id, surface, canonical_name, document_id of the parties that questions name, by full name, name without its ending, or first word.

    A surface form counts once, for the first document and party that has it."""
    names = parties.filter("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("document_id", "ord")).alias("at"))
    base = F.trim(F.regexp_replace("name", "(?i)" + COMPANY_END, ""))
    first = F.get(F.filter(F.split("name", r"[\s,]"), lambda t: (t != "") & ~F.lower(t).isin(*FIRST_STOPWORDS)), F.lit(0))
    forms = names.select("at", "name", F.posexplode(F.array_distinct(F.array_compact(F.array("name", F.nullif(base, F.lit("")), first)))).alias("k", "surface"))
    forms = forms.withColumn("part", F.lower(F.trim("surface"))).filter(F.length("part") > 2)
    once = forms.groupBy("part").agg(F.min(F.struct("at", "k", "name", "surface")).alias("x"))
    return _found(questions, once).select("query_id", F.col("x.surface").alias("surface"), F.col("x.name").alias("canonical_name"), F.col("x.at.document_id").alias("document_id"))


def _span(rows: DataFrame, key: str) -> DataFrame:
    """The least and greatest document of a key, of all and of those that are no amendments."""
    other = F.when(~F.col("amends"), F.col("document_id"))
    return rows.groupBy(key).agg(F.min("document_id").alias("lo"), F.max("document_id").alias("hi"), F.min(other).alias("lo_other"), F.max(other).alias("hi_other"))


def _only(found: DataFrame, name: str) -> DataFrame:
    """query_id and the one document of its hits; of several, the one that is no amendment, unless the question is on amendments."""
    hit = found.groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("lo_other").alias("lo_other"), F.max("hi_other").alias("hi_other"))
    return hit.select("query_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias(name), F.when(F.col("lo_other") == F.col("hi_other"), F.col("lo_other")).alias(f"{name}_other"))


def documents_of(questions: DataFrame, contracts: DataFrame, parties: DataFrame) -> DataFrame:
    """query_id, document_id: by id (doc_7), by the title of an amendment, by a party or a title word that one document alone has, or the only document there is.

    contracts: document_id, filename; parties: document_id, name."""
    title = F.lower(F.regexp_replace("filename", r"[()\-_.pdf]", " "))
    files = contracts.select("document_id", F.lower("filename").contains("amend").alias("amends"), F.explode(F.array_distinct(_runs(title))).alias("part")).filter(F.length("part") > 3)
    named = parties.filter("name IS NOT NULL").select("document_id", F.lower("name").alias("low"), F.lower(F.trim(F.regexp_replace("name", "(?i)" + COMPANY_END, ""))).alias("base"))
    pieces = F.concat(F.transform(F.split("low", "[,–-]"), lambda x: F.trim(x)), F.array("base"), F.split("base", r"\s+"))
    parts = named.select("document_id", F.explode(F.array_distinct(pieces)).alias("part")).filter((F.length("part") >= 3) & ~F.col("part").isin(*NAME_STOPWORDS) & F.col("part").rlike("^[a-z0-9]") & F.col("part").rlike("[a-z0-9]$"))
    parts = parts.join(contracts.select("document_id", F.lower("filename").contains("amend").alias("amends")), "document_id")
    by_party = _only(_found(questions, _span(parts, "part")), "party_doc")
    by_file = _only(_found(questions, _span(files.filter(~F.col("part").isin(*FILE_STOPWORDS)), "part")), "file_doc")
    by_title = _found(questions, files.filter(F.col("amends") & ~F.col("part").isin(*AMENDMENT_FILE_STOPWORDS)).groupBy("part").agg(F.min("document_id").alias("lo")))
    by_title = by_title.groupBy("query_id").agg(F.min("lo").alias("title_doc"))
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = questions.select("query_id", low.contains("amend").alias("on_amendments"), F.explode_outer(F.array_distinct(F.regexp_extract_all(low, F.lit("doc_([0-9]+)"), F.lit(1)))).alias("id"))
    by_id = rows.select("query_id", F.col("id").try_cast("long").alias("document_id")).join(contracts.select("document_id"), "document_id", "left_semi").groupBy("query_id").agg(F.min("document_id").alias("id_doc"))
    single = contracts.agg(F.when(F.count(F.lit(1)) == 1, F.min("document_id")).alias("single_doc"))
    out = rows.select("query_id", "on_amendments").distinct().join(by_id, "query_id", "left").join(by_title, "query_id", "left").join(by_party, "query_id", "left").join(by_file, "query_id", "left").join(F.broadcast(single))  # one row
    unless = lambda c: F.when(~F.col("on_amendments"), F.col(c))
    return out.select("query_id", F.coalesce("id_doc", F.when(F.col("on_amendments"), F.col("title_doc")), "party_doc", unless("party_doc_other"), "file_doc", unless("file_doc_other"), "single_doc").alias("document_id"))


def analyse(questions: DataFrame, contracts: DataFrame, parties: DataFrame, roles: DataFrame) -> DataFrame:
    """query_id, document_id, intent, role_status, resolved_party, entities, note, expanded, route of every question.

    roles: document_id, name, role. A question that names a party which its document lacks, or a party in the
    other's role, is unanswerable; note says which."""
    docs, named, said = documents_of(questions, contracts, parties), entities(questions, parties), cues(questions)
    low = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    rows = questions.select("query_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"), low.alias("low")).join(docs, "query_id").join(said, "query_id")
    asked = rows.filter("document_id IS NOT NULL").select("query_id", "document_id", "low", "role")
    own = asked.select("query_id", "document_id").join(parties.select("document_id", F.lower("name").alias("party")), "document_id")
    kin = named.select("query_id", F.lower("canonical_name").alias("entity")).join(own.select("query_id", "party"), "query_id")
    strange = kin.groupBy("query_id", "entity").agg(F.max(F.col("party").contains(F.col("entity")) | F.col("entity").contains(F.col("party"))).alias("known")).groupBy("query_id").agg(F.min("known").alias("all_known"))
    # a document without parties has none of the named ones
    bare = named.select("query_id").distinct().join(asked.select("query_id"), "query_id").join(own.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(False).alias("all_known"))
    strange = strange.unionByName(bare)
    held = asked.join(roles.select("document_id", "name", F.col("role").alias("has")), "document_id")
    short = F.lower(F.trim(F.get(F.split("name", ","), F.lit(0))))
    swapped = ((F.col("has") == "SUPPLIER") & _has(F.col("low"), ("customer obligations", "buyer obligations"))) | (F.col("has").isin("BUYER", "CUSTOMER") & _has(F.col("low"), ("supplier obligations", "vendor obligations", "as the supplier")))
    of_roles = held.groupBy("query_id").agg(
        F.max(F.col("low").contains(short) & swapped).alias("swapped"), F.count_if(F.col("has") == F.col("role")).alias("n_role"), F.min(F.when(F.col("has") == F.col("role"), F.col("name"))).alias("role_party"),
    )
    listed = named.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("document_id", "canonical_name"))).alias("e")).select("query_id", F.array_distinct(F.transform("e", lambda x: x["canonical_name"])).alias("names"))
    rows = rows.join(strange, "query_id", "left").join(of_roles, "query_id", "left").join(listed, "query_id", "left")
    never = F.col("intent") == "unanswerable"
    distracted = F.coalesce(~F.col("all_known"), F.lit(False)) & _has(F.col("low"), DISTRACTING)
    note = F.when(never, "out_of_domain").when(distracted, "other_party").when(F.coalesce("swapped", F.lit(False)), "inverted_role")
    status = F.when(F.col("role").isNull(), None).when(F.col("n_role") == 1, "resolved").when(F.col("n_role") > 1, "ambiguous").otherwise("unresolved")
    final = F.when(note.isNotNull(), "unanswerable").otherwise(F.col("intent"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    by_role = F.when((F.col("role").isNotNull()) & (F.col("role") != "UNKNOWN"), F.when(F.col("n_role") == 1, F.col("role_party")).otherwise(F.lower("role")))
    synonyms = reduce(lambda out, x: F.when(F.col("intent") == x[0], F.array(*(F.lit(w) for w in x[1]))).otherwise(out), SYNONYMS.items(), F.array().cast("array<string>"))
    terms = F.filter(F.concat(F.array_compact(F.array(by_role)), names, synonyms), lambda t: ~F.col("low").contains(F.lower(t)))
    once = F.filter(terms, lambda t, i: ~F.exists(F.slice(terms, 1, i), lambda o: F.lower(o) == F.lower(t)))
    expanded = F.when(note.isNotNull(), F.col("text")).otherwise(F.trim(F.concat_ws(" ", F.col("text"), F.array_join(once, " "))))
    party = F.size(names) > 0
    money = _has(F.col("low"), MONEY)
    mixed = party & money & ((F.col("intent") == "cross_contract") | (_has(F.col("low"), AMONG) & F.col("low").contains("which contracts")))
    t = lambda name: _triggered(F.col("low"), name)
    route = (
        F.when(note.isNotNull(), "UNANSWERABLE").when(mixed, "HYBRID_REASONING").when(t("comparison"), "COMPARISON_QUERY").when((F.col("intent") == "amendment") | t("amendment"), "AMENDMENT_QUERY")
        .when((F.col("intent") == "timeline") | t("timeline"), "TIMELINE_QUERY").when((F.col("intent") == "obligation") | t("obligation"), "OBLIGATION_QUERY")
        .when(t("graph_party") | t("graph_term"), "DIRECT_GRAPH").when(_has(F.col("low"), OVERVIEWS) | (_has(F.col("low"), DETAILS) & _has(F.col("low"), DETAILED)), "CONTRACT_DETAILS").otherwise("DIRECT_RETRIEVAL")
    )
    return rows.select(
        "query_id", "document_id", final.alias("intent"), status.alias("role_status"), F.when(F.col("n_role") == 1, F.col("role_party")).alias("resolved_party"),
        F.array_join(names, "; ").alias("entities"), note.alias("note"), expanded.alias("expanded"), route.alias("route"),
    )
