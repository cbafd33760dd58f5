"""Deterministic classification of reports: relevance, signals, kinds, labels. Patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.patterns import has, java

# Patterns of the classifier, case ignored.
OFF_TOPIC = (
    r"\b(?:lock and code\b|s[0-9]{1,2}e[0-9]{1,2}\b|a week in security\b|this week in\b|weekly (recap|roundup|digest)\b|podcast\b|pwn2own\b|black hat\b|def con\b|"
    r"rsa conference\b|preview:|webinar\b|use cases (for|of)\b|joins (the|forces)\b|alliance to\b|platform helps\b|helps meet\b|helps (organi[sz]ations|customers|you)\b|"
    r"general availability\b|magic quadrant\b|gartner\b|forrester\b|named a leader\b|strengthen(s|ing)? (cyber )?resilience\b|customer story\b|case study\b|"
    r"register (now|today)\b|whitepaper series\b|acquisition\b|acquires\b|merger\b|funding round\b|raises \$|series [a-e] funding\b|earnings\b|legal scrutiny\b|"
    r"don'?t get fooled\b|don'?t trust\b)"
)
STRONG_INTEL = (
    r"\b(?:malware\b|ransomware\b|exploit(ed|ation|s)?\b|vulnerabilit|cve-[0-9]|zero.?day\b|backdoor\b|c2\b|command.and.control\b|botnet\b|phishing\b|threat actor\b|"
    r"apt[0-9]|espionage\b|stealer\b|trojan\b|rootkit\b|spyware\b|implant\b|exfiltrat|data (leak|breach)\b|threat landscape\b)"
)
MARKETING = (
    r"\b(webinar|introducing|announc|acquir|acquisition|partner(ship)?|pricing|gartner|magic quadrant|now available|product update|forrester|sponsor|join us|register (now|today)|"
    r"ebook|whitepaper series|customer story|case study)\b"
)
ROUTING_CVE = r"\bCVE-[0-9]{4}-[0-9]{3,7}\b"
BREACH = r"\b(data breach|breached|suffered a breach|hacked|leaked (data|records)|stolen data|exfiltrated|extortion|ransom(ware)? (attack|incident))\b"
LARGE_SCALE = (
    r"\b(mass|widespread|hundreds|thousands|dozens of (victims|organi[sz]ations)|supply.chain|global campaign|multiple (victims|sectors|organi[sz]ations)|critical infrastructure|zero.day)\b"
)
INCIDENT = (
    r"\b(ransom(ware)?|extort(ion|ed|ing)?|leak(ed|s| site)?|dedicated leak site|\bdls\b|data (leak|dump|breach|for sale|theft)|breach(ed)?|hack(ed|er|ers)?|stole|stolen|exfiltrat|"
    r"encrypt(ed|ion)?|victim|claim(ed|s|ing)?|listed|posted|initial access|access broker|attack(ed|s|ing)?|target(ed|s|ing)?|compromis(e|ed|es|ing)|hits?\b|deploy(ed|s|ing)?|"
    r"affiliate|intrusion|campaign)\b"
)
RESEARCH = (
    r"\b(analysis|analy[sz]ing|analy[sz]ed|deep.?dive|write-?ups?|unpacking|dissect(ing|s|ed)?|reverse.?engineer(ing|ed)?|teardown|anatomy of|a look at|profile of|explained|"
    r"technical report|malware report|threat (report|research|spotlight)|research (report|paper)|new (tool|toy|malware|variant|loader|backdoor|implant|rootkit|stealer|dropper|framework))\b"
)
CONFIRMED = r"\b(confirmed|disclosed|acknowledged|patched|actively exploited|exploited in the wild|advisory)\b"
POC = r"\b(proof.?of.?concept|\bpoc\b|exploit code|not yet (exploited|observed))\b"
HACKTIVISM = r"\bhacktivis(?:m|t|ts)\b"
ADVISORY = r"\bvulnerabilit(?:y|ies|es?)\b"
# Animal families and the country each stands for.
FAMILIES = {"PANDA": "China", "BEAR": "Russia", "CHOLLIMA": "North Korea", "KITTEN": "Iran", "TIGER": "India", "WOLF": "Turkey", "BUFFALO": "Vietnam", "LEOPARD": "Pakistan", "CRANE": "South Korea", "BAT": None, "SPIDER": None, "JACKAL": None}
NEXUS_FAMILY = {"china": "PANDA", "russia": "BEAR", "north_korea": "CHOLLIMA", "iran": "KITTEN", "rest_of_world": "BAT", "other": "SPIDER"}
NEXUS_OF = {"China": "china", "Russia": "russia", "North Korea": "north_korea", "Iran": "iran"}
ADJECTIVES = {"TIGER": "india|indian", "WOLF": "turkey|turkish", "BUFFALO": "vietnam|vietnamese", "LEOPARD": "pakistan|pakistani", "CRANE": "south korea|south korean"}
PLACEHOLDERS = ("", "UNKNOWN", "UNID", "UNATTRIBUTED", "N/A")
# Ordinary words that are also somebody's alias.
ORDINARY = (
    "lead play royal hive snake tick grief maze gold silver bronze copper iron cloud storm shadow ghost light stone sand dust comment group team crew force unit sector energy solar lunar "
    "orange blue green white black grey gray magic mint moth wolf bear panda tiger kitten spider jackal crane leopard buffalo dark static mission charming cosmic phantom wizard"
).split()
DROP_KINDS = ("incomplete", "marketing", "not_intelligence", "screened", "low_signal", "other")


def relevant(text: Column) -> Column:
    """Kept unless off topic without a strong signal."""
    return ~has(text, OFF_TOPIC) | has(text, STRONG_INTEL)


def marketing(title: Column, description: Column) -> Column:
    return has(title, MARKETING) | has(description, MARKETING)


def routing_cve(text: Column) -> Column:
    """The first CVE id in upper case, or null."""
    return F.nullif(F.upper(F.regexp_extract(text, "(?i)" + java(ROUTING_CVE), 0)), F.lit(""))


def item_type(text: Column, named: Column, category: Column) -> Column:
    """vuln, actor_activity, breach, breaking or report, the first that holds."""
    return F.when(has(text, ROUTING_CVE), "vuln").when(named, "actor_activity").when(has(text, BREACH), "breach").when((category == "news") & has(text, LARGE_SCALE), "breaking").otherwise("report")


def exploit_status(text: Column, category: Column) -> Column:
    return F.when(has(text, POC), "poc").when((category == "government") | has(text, CONFIRMED), "confirmed").otherwise("suspected")


def verdict(title: Column, url: Column, description: Column, category: Column, nexus: Column, motivation: Column) -> Column:
    """struct(verdict, reason, item_type): keep, drop or unsure; nexus and motivation are those of the matched alias, if any."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))
    named, activist = nexus.isNotNull(), F.coalesce(motivation == "hacktivism", F.lit(False))
    kind = item_type(text, named, category)
    quiet = (nexus == "other") & ~activist & ~has(text, LARGE_SCALE) & ~has(text, RESEARCH) & ~has(text, INCIDENT)
    missing = (F.coalesce(title, F.lit("")) == "") | (F.coalesce(url, F.lit("")) == "")
    unsure = ~named & (kind == "report") & (category == "news") & ~has(text, HACKTIVISM)
    said = lambda v, why=None: F.struct(F.lit(v).alias("verdict"), F.lit(why).cast("string").alias("reason"), F.when(F.lit(v == "keep"), kind).alias("item_type"))
    return F.when(missing, said("drop", "missing title or URL")).when(marketing(title, description), said("drop", "marketing / product")).when(F.coalesce(quiet, F.lit(False)), said("drop", "low-signal crew mention")).when(F.coalesce(unsure, F.lit(False)), said("unsure")).otherwise(said("keep"))


def report_kind(kind: Column, attributed: Column, cve: Column, text: Column, choice: Column | None = None) -> Column:
    """exploit, breach, research or other; choice is an outside verdict that decides where the rules do not."""
    choice = choice if choice is not None else F.lit(None).cast("string")
    rest = F.when(choice == "exploit", F.when(cve.isNotNull(), "exploit").otherwise("other")).otherwise(F.coalesce(choice, F.lit("other")))
    return F.when((kind == "vuln") & cve.isNotNull(), "exploit").when(kind == "breach", "breach").when(attributed | (kind == "actor_activity") | has(text, HACKTIVISM), "research").otherwise(rest)


def specific(name: Column) -> Column:
    """Whether a name is a group and not a bare family or placeholder."""
    return F.coalesce(~F.upper(F.trim(name)).isin(*FAMILIES, *PLACEHOLDERS), F.lit(False))


def nexus_of_country(country: Column) -> Column:
    mapped = None
    for name, nexus in NEXUS_OF.items():
        test = F.lower(F.trim(country)) == name.lower()
        mapped = F.when(test, nexus) if mapped is None else mapped.when(test, nexus)
    return mapped.otherwise("rest_of_world")


def unid(nexus: Column, text: Column, country: Column) -> Column:
    """UNID and the family of a nexus; for the rest of the world by the stored country, else by a country in the text."""
    by_country, by_text = None, None
    for family, name in FAMILIES.items():
        if name:
            test = F.lower(F.trim(country)) == name.lower()
            by_country = F.when(test, family) if by_country is None else by_country.when(test, family)
    for family, words in ADJECTIVES.items():
        test = has(text, rf"\b({words})\b")
        by_text = F.when(test, family) if by_text is None else by_text.when(test, family)
    world = F.coalesce(by_country, by_text, F.lit("BAT"))
    other = None
    for key, family in NEXUS_FAMILY.items():
        if key != "rest_of_world":
            other = F.when(nexus == key, family) if other is None else other.when(nexus == key, family)
    return F.concat(F.lit("UNID "), F.when(nexus == "rest_of_world", world).otherwise(other))


def adversary_label(name: Column, nexus: Column, text: Column, country: Column) -> Column:
    """A specific name as it is, else the unidentified family; null without a nexus."""
    return F.when(nexus.isNotNull(), F.when(specific(name), name).otherwise(unid(nexus, text, country)))


def matchable(alias: Column) -> Column:
    """At least four characters, and not a single ordinary word."""
    v = F.trim(alias)
    return F.coalesce((F.length(v) >= 4) & ~(~v.rlike(r"\s") & F.lower(v).isin(*ORDINARY)), F.lit(False))


def strong(alias: Column) -> Column:
    """Matchable, and a phrase or with a digit."""
    return matchable(alias) & F.trim(alias).rlike(r"\s|[0-9]")


def drop_kind(reason: Column) -> Column:
    """The category of a drop reason; how it begins or ends decides, the rest are a model's own words."""
    r = F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    by = ((r.contains("missing title or url"), "incomplete"), (r.startswith("marketing") | r.contains("marketing / product"), "marketing"), (r.contains("low-signal crew mention"), "low_signal"), (r.endswith("not intelligence"), "not_intelligence"), (r.startswith("llm:") | r.startswith("screened out"), "screened"))
    return F.coalesce(*(F.when(test, kind) for test, kind in by), F.lit("other"))


DESIGNATOR = r"\bAPT\s?[0-9]+\b|\bUNC[0-9]{3,}\b|\bTA[0-9]{3,}\b"
BULLETIN = r"\bCVE-[0-9]{4}-[0-9]{4,7}\b|\bvulnerabilit(?:y|ies|es?)\b|\bsecurity (?:advisory|bulletin|update)s?\b|\bpatch tuesday\b|\bcritical patch update\b|\bsecurity release\b"


def model_tier(title: Column, named: Column) -> Column:
    """cheap for a vulnerability record that names no actor, else standard."""
    return F.when(~has(title, DESIGNATOR) & ~named & has(title, BULLETIN), "cheap").otherwise("standard")


def feed_health(active: Column, feed_url: Column, last_item: Column, last_error: Column, now: Column) -> Column:
    """off, ok (nothing to fetch), error, never, stale (over 30 days), ok; the first that holds."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    age = F.unix_timestamp(now) - F.unix_timestamp(last_item)
    return F.when(~active, "off").when(blank(feed_url), "ok").when(~blank(last_error), "error").when(last_item.isNull(), "never").when(age > 30 * 86400, "stale").otherwise("ok")
