"""Indicators in text: making them whole, finding, checking and excluding them. All Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.patterns import java, let

# File extensions that mark a filename.
FILE_EXTENSIONS = (
    "exe dll sys ps1 bat cmd vbs js jse wsf hta scr lnk jar apk dmg iso img bin msi doc docx xls xlsx ppt pptx pdf rtf zip rar 7z gz tar py sh elf so tmp dat macho "
    "jpg jpeg png gif webp svg ico css html htm woff woff2 ttf otf php phtml php3 php4 php5 php7 asp aspx ashx asmx jsp jspx cgi shtml xhtml "
    "txt json xml yml yaml ini conf cfg csv sql bak log db dmp pcap eml msg"
).split()
# Last and first labels that mark an identifier in code.
CODE_TAILS = (
    "log error warn debug trace fetch then catch push pop map filter join split slice call apply bind exec spawn send write read open close start stop create delete update "
    "get put head command commands argv env path json stringify parse test match replace trim length value data type url href src innerhtml textcontent prototype constructor "
    "tostring valueof now random floor round ceil min max abs keys values entries assign freeze target origin hostname search hash body title status headers params query state "
    "props self this default module exports require import main init setup config options args result response request client server session token key secret user admin root "
    "local remote temp tmp cache buffer stream file dir folder list item items count total sum avg first last next prev current active enabled disabled visible hidden open_ close_"
).split()
CODE_HEADS = (
    "window document console process os sys math json object array string number boolean regexp promise map set error exec child_process subprocess shutil urllib requests axios fs "
    "path http https net crypto util events stream buffer assert zlib querystring readline cluster worker navigator location history screen localstorage sessionstorage globalthis "
    "module exports require this self super new typeof instanceof"
).split()
# Domains of page furniture, registrars and name servers, never reported infrastructure.
EXCLUDED_DOMAINS = (
    "twitter.com x.com linkedin.com facebook.com fb.com instagram.com youtube.com youtu.be reddit.com pinterest.com tiktok.com flipboard.com whatsapp.com bsky.app bsky.social "
    "discord.gg join.slack.com infosec.exchange mastodon.social spotify.com threads.net w3.org schema.org creativecommons.org gravatar.com gmpg.org google-analytics.com "
    "googletagmanager.com doubleclick.net feedburner.com publicdomainregistry.com godaddy.com namecheap.com namesilo.com name.com enom.com tucows.com gandi.net ovh.com ovh.net "
    "dynadot.com porkbun.com networksolutions.com register.com namebright.com internetbs.net nicenic.net regery.com hostinger.com ionos.com west.cn 22.cn eranet.com "
    "ns.cloudflare.com domaincontrol.com registrar-servers.com azure-dns.com azure-dns.net azure-dns.org azure-dns.info googledomains.com dnsmadeeasy.com nsone.net dnspod.net "
    "sedoparking.com bodis.com afternic.com parkingcrew.net above.com"
).split()

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
PREFIX_32, PREFIX_128 = r"(?:3[0-2]|[12]?[0-9])", r"(?:12[0-8]|1[01][0-9]|[1-9]?[0-9])"
NON_ROUTABLE = r"^(?:0|10|127)\.|^(?:22[4-9]|2[3-5][0-9])\.|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.168\."
DOMAIN = r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}"
HASH = r"(?:[a-f0-9]{64}|[a-f0-9]{40}|[a-f0-9]{32})"
CVE, TECHNIQUE = r"CVE-[0-9]{4}-[0-9]{4,7}", r"T[0-9]{4}(?:\.[0-9]{3})?"


def _ipv6() -> str:
    """All forms of an IPv6 address, from the number of groups before and after the gap."""
    group = "[0-9a-f]{1,4}"
    forms = [rf"(?:{group}:){{7}}{group}", rf"(?:{group}:){{1,7}}:", rf":(?::{group}){{1,7}}", "::"]
    forms += [rf"(?:{group}:){{1,{7 - n}}}(?::{group}){{1,{n}}}" for n in range(1, 7)]
    forms += [rf"::(?:ffff(?::0{{1,4}})?:)?{IPV4}", rf"(?:{group}:){{1,4}}:{IPV4}"]
    return "(?:" + "|".join(forms) + ")"


IPV6 = _ipv6()


def refang(text: Column) -> Column:
    """Obfuscated dots, schemes and slashes made plain; texts without brackets or hxxp stay as they are."""

    def opened(t: Column) -> Column:
        for pattern, plain in ((r"(?i)\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)", "."), (r"\[://\]", "://"), (r"\[:\]", ":"), (r"\[/\]", "/")):
            t = F.regexp_replace(t, pattern, plain)
        return t

    plain = let(text, lambda t: F.when(t.rlike(r"[\[({][.:/dD]"), opened(t)).otherwise(t))
    return let(plain, lambda t: F.when(t.rlike("[hH][xX][xX][pP]"), F.regexp_replace(t, java(r"(?i)\bhxxp(s?)\b"), "http$1")).otherwise(t))


def found(text: Column, pattern: str, hint: str | None = None) -> Column:
    """All matches of pattern; hint is a cheap pattern that every text with a match has."""
    every = F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))
    return every if hint is None else F.when(text.rlike(hint), every).otherwise(F.array().cast("array<string>"))


def non_routable(ip: Column) -> Column:
    """Private, loopback, shared, link-local, multicast and reserved IPv4 addresses and ranges."""
    return F.regexp_extract(ip, r"^[^/]*", 0).rlike(rf"^{IPV4}\z") & ip.rlike(NON_ROUTABLE)


def non_routable_v6(ip: Column) -> Column:
    v = F.lower(F.regexp_extract(ip, r"^[^/]*", 0))
    return v.isin("::", "::1") | v.rlike(r"^fe[89ab][0-9a-f]?:|^f[cd][0-9a-f]{2}:")


def addresses(text: Column) -> Column:
    """IPv4 addresses and ranges of refanged text, in order of appearance.

    Behind "//" a /nn is a path, not a prefix; so it is taken off before the search.
    """
    hosts = F.regexp_replace(text, java(rf"(//(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}})/[0-9]{{1,3}}\b"), "$1 ")
    raw = found(hosts, r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?:/[0-9]{1,3})?\b")
    whole = F.transform(raw, lambda v: F.when(v.rlike(rf"^{IPV4}/{PREFIX_32}\z"), v).otherwise(F.regexp_extract(v, r"^[^/]*", 0)))
    every = F.array_distinct(F.filter(whole, lambda v: v.rlike(rf"^{IPV4}(?:/{PREFIX_32})?\z")))
    return F.when(text.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]"), every).otherwise(F.array().cast("array<string>"))


def filename_or_code(domain: Column) -> Column:
    """Whether a name with a dot is a filename or an identifier in code."""
    d = F.lower(F.trim(domain))
    tail, head = F.element_at(F.split(d, r"\."), -1), F.element_at(F.split(d, r"\."), 1)
    return d.contains(".") & (tail.isin(*FILE_EXTENSIONS, *CODE_TAILS) | head.isin(*CODE_HEADS))


def suffixes(domain: Column) -> Column:
    """The domain and all its parents."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def excluded(domain: Column, more: Column | None = None) -> Column:
    """Whether the domain or a parent of it is excluded; more is an array of further domains."""
    listed = F.array(*map(F.lit, EXCLUDED_DOMAINS))
    also = F.transform(more, lambda d: F.lower(F.trim(d))) if more is not None else F.array().cast("array<string>")
    return F.arrays_overlap(suffixes(F.lower(domain)), F.concat(listed, also))


def domains(text: Column, ips: Column, more: Column | None = None) -> Column:
    # the look ahead passes over words without a dot behind them, which the pattern itself would try at every length
    names = F.transform(found(text, rf"(?i)\b(?=[a-z0-9-]{{1,63}}+\.){DOMAIN}\b", r"[A-Za-z0-9]\.[A-Za-z]"), lambda d: F.regexp_replace(F.lower(d), "^2f", ""))
    return F.filter(F.array_distinct(names), lambda d: ~F.array_contains(ips, d) & ~filename_or_code(d) & ~excluded(d, more))


def indicators(text: Column, exclude_domains: Column | None = None, exclude_ips: Column | None = None) -> Column:
    """A struct of arrays ips, domains, files, cves and mitre, each in order of appearance."""
    upper = lambda a: F.array_distinct(F.transform(a, F.upper))

    def routable(t: Column) -> Column:
        ips = F.filter(addresses(t), lambda v: ~non_routable(v))
        return ips if exclude_ips is None else F.array_except(ips, exclude_ips)

    def every(t: Column, ips: Column) -> Column:
        return F.struct(
            ips.alias("ips"),
            domains(t, ips, exclude_domains).alias("domains"),
            F.array_distinct(F.transform(found(t, rf"(?i)\b{HASH}\b", "[A-Fa-f0-9]{32}"), F.lower)).alias("files"),
            upper(found(t, rf"(?i)\b{CVE}\b", "[cC][vV][eE]-[0-9]{4}-")).alias("cves"),
            upper(found(t, rf"\b{TECHNIQUE}\b", "T[0-9]{4}")).alias("mitre"),
        )

    return let(refang(F.coalesce(text, F.lit(""))), lambda t: let(routable(t), lambda ips: every(t, ips)))


def stored_else_found(kept: Column, seen: Column) -> Column:
    """Of two structs as indicators() gives: what is stored for a report where it has any address, domain, file or CVE, else what its text
    has; techniques apart, as they are stored by another way."""
    any_ = F.size(F.concat(*(kept[k] for k in ("ips", "domains", "files", "cves")))) > 0
    return F.struct(*(F.when(any_, kept[k]).otherwise(seen[k]).alias(k) for k in ("ips", "domains", "files", "cves")), F.when(F.size(kept["mitre"]) > 0, kept["mitre"]).otherwise(seen["mitre"]).alias("mitre"))


def valid(value: Column, kind: Column) -> Column:
    """Whether a value is a whole indicator of its kind; no value of an unknown kind is."""
    v = F.trim(value)
    whole = lambda p: v.rlike(rf"(?i)^(?:{p})\z")
    ip = whole(f"{IPV4}(?:/{PREFIX_32})?") | whole(f"{IPV6}(?:/{PREFIX_128})?")
    checked = F.when(kind == "ip", ip).when(kind == "domain", whole(DOMAIN)).when(kind == "file_hash", whole(HASH)).when(kind == "cve", whole(CVE)).when(kind == "mitre", whole(TECHNIQUE))
    return F.coalesce(checked, F.lit(False))


def stored(value: Column, kind: Column) -> Column:
    """A value as it is stored: domains and hashes in lower case, CVE and technique ids in upper case."""
    v = F.trim(value)
    return F.when(kind.isin("domain", "file_hash"), F.lower(v)).when(kind.isin("cve", "mitre"), F.upper(v)).otherwise(v)


def host(url: Column) -> Column:
    """The URL's host in lower case without www., empty if it has none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def not_allowed(iocs: DataFrame, allow: DataFrame) -> DataFrame:
    """iocs (value, ioc_type) without those on the list: domains by any parent, addresses exactly.

    Each domain is exploded into its few suffixes, so the test is an equi-join whatever the size of the list.
    """
    listed = allow.select(F.lower(F.trim("value")).alias("listed"), F.col("ioc_type").alias("listed_type")).distinct()
    names = F.when(F.col("ioc_type") == "domain", suffixes(F.lower("value"))).otherwise(F.array(F.lower(F.trim("value"))))
    keys = iocs.select("value", "ioc_type", F.explode(names).alias("name"))
    gone = keys.join(listed, (F.col("name") == F.col("listed")) & (F.col("ioc_type") == F.col("listed_type")), "left_semi").select("value", "ioc_type").distinct()
    return iocs.join(gone, ["value", "ioc_type"], "left_anti")


def extracted(text: Column, exclude_domains: Column | None = None, exclude_ips: Column | None = None) -> Column:
    """All indicators of a text as an array of struct(kind, value); targets of markdown links are left out, as page furniture has most of them."""
    kinds = {"ip": "ips", "domain": "domains", "file_hash": "files", "cve": "cves", "mitre": "mitre"}
    plain = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")

    def of(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    def pairs(i: Column) -> Column:
        return F.flatten(F.array(*(of(kind, i[field]) for kind, field in kinds.items())))

    return let(indicators(plain, exclude_domains, exclude_ips), pairs)


def reconcile(claimed: Column, text: Column, exclude_domains: Column | None = None, exclude_ips: Column | None = None, extract: bool = True) -> Column:
    """A model's claims (array of struct kind, value) that hold, with what the text itself gives; of equal ones the later stays.

    A claim holds if it is valid once it is refanged, neither non-routable nor excluded, and stands in the text; without a text nothing
    can be looked up, and valid claims hold.
    """
    key = lambda c: F.concat_ws("|", c["kind"], F.lower(c["value"]))

    def holding(plain: Column) -> Column:
        clean = F.transform(claimed, lambda c: F.struct(c["kind"].alias("kind"), stored(refang(c["value"]), c["kind"]).alias("value")))
        ips = exclude_ips if exclude_ips is not None else F.array().cast("array<string>")
        barred = lambda c: ((c["kind"] == "ip") & (non_routable(c["value"]) | non_routable_v6(c["value"]) | F.array_contains(ips, c["value"]))) | ((c["kind"] == "domain") & (excluded(c["value"], exclude_domains) | filename_or_code(c["value"])))
        return F.filter(clean, lambda c: valid(c["value"], c["kind"]) & ~barred(c) & (plain.isNull() | plain.contains(F.lower(c["value"]))))

    def last_of_each(both: Column) -> Column:
        return let(F.transform(both, key), lambda keys: F.filter(both, lambda c, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), key(c))))

    kept = let(F.lower(refang(text)), holding)
    if not extract:
        return let(kept, last_of_each)
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return let(F.concat(kept, F.when(text.isNull(), none).otherwise(extracted(text, exclude_domains, exclude_ips))), last_of_each)


#: Literal characters that a search finds in every obfuscated form.
_FORMS = {".": r"(?:\.|\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\))", ":": r"(?::|\[:\])", "/": r"(?:/|\[/\])", "@": r"(?:@|\[@\]|\(@\)|\[at\]|\(at\))"}


def find_pattern(query: str) -> str:
    """A pattern that finds query in text, however either of them is obfuscated; empty for an empty query."""
    import re

    plain = re.sub(r"\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)", ".", query.strip(), flags=re.I)
    for marked, sign in (("[://]", "://"), ("[:]", ":"), ("[/]", "/"), ("[@]", "@")):
        plain = plain.replace(marked, sign)
    plain = re.sub(r"\bhxxp(s?)\b", r"http\1", plain, flags=re.I)
    parts = re.split(r"(\bhttps?(?=://)|://|\s+|[.:/@])", plain, flags=re.I)
    out = []
    for part in parts:
        if part.lower() in ("http", "https"):
            out.append(r"h(?:tt|xx)p" + ("s" if part.lower() == "https" else ""))
        elif part == "://":
            out.append(rf"(?:\[://\]|{_FORMS[':']}{_FORMS['/']}{_FORMS['/']})")
        elif part.isspace():
            out.append(r"\s+")
        else:
            out.append(_FORMS.get(part) or "".join(rf"\{c}" if not c.isalnum() and ord(c) < 128 and c != "_" else c for c in part))
    return "(?i)" + "".join(out) if plain else ""
