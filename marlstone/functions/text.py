"""Text functions as Columns: routing, tickets, links, redaction, identifier tokens, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.secrets import SHAPES

# Prefixes that look like ticket keys but name standards and formats.
NOT_TICKETS = [
    "SHA", "MD", "RSA", "DSA", "ECDSA", "AES", "DES", "HMAC", "PBKDF", "CRC", "BLAKE", "UTF", "UCS", "ASCII", "LATIN", "ISO", "CP", "BASE", "GB",
    "BIG", "HTTP", "HTTPS", "TLS", "SSL", "SSH", "FTP", "SMTP", "IMAP", "TCP", "UDP", "IP", "IPV", "RFC", "IEEE", "ANSI", "NIST", "FIPS", "PKCS",
    "ECMA", "JSR", "PEP", "DIN", "EN", "CVE", "CWE", "GHSA", "CAPEC", "OWASP", "OAUTH", "SAML", "JWT", "JWE", "JWS", "OIDC", "LDAP", "ES", "CSS",
    "HTML", "XHTML", "SQL", "USB", "PCI", "ARM", "X", "H", "MP", "AV",
]
# Shapes of queries.
TICKET = r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b"
PATH = r"\b(\S+/\S+\.\w{1,8}|\S+\.(?:java|py|go|ts|tsx|js|rb|kt|scala|sql))(?::\d+)?\b"
QUOTED = r'"([^"]{3,})"'
ERROR = r"\b(\w*(?:Exception|Error))\b"
# Parameters that carry credentials.
CREDENTIAL = r"([?&](?:token|api[-_]?key|access[-_]?token|password|secret|auth|pat|client[-_]?secret)=)[^&\s]*"


def is_ticket(key: Column) -> Column:
    return ~F.regexp_extract(key, r"^([A-Z][A-Z0-9]*?)-\d+$", 1).isin(NOT_TICKETS)


def classify_route(query: Column) -> Column:
    """entity, path, exact, symbol or docs: the first shape that fits."""
    q = F.btrim(query)
    first = F.regexp_extract(q, TICKET, 1)
    symbol = q.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & (q.contains("_") | ((q != F.lower(q)) & (q != F.upper(q))))
    return (
        F.when((first != "") & is_ticket(first), "entity")
        .when(q.rlike(PATH), "path")
        .when(q.rlike(QUOTED) | q.rlike(ERROR), "exact")
        .when(symbol, "symbol")
        .otherwise("docs")
    )


def ticket_keys(text: Column) -> Column:
    """Ticket keys in order of first appearance."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(TICKET), F.lit(1)), is_ticket))


def url_links(text: Column) -> Column:
    """Ids of pages and issues that the text's addresses point to."""
    page = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.concat(F.lit("confluence:page:"), x))
    issues = F.transform(F.regexp_extract_all(text, F.lit(r"/browse/([A-Z][A-Z0-9]+-\d+)"), F.lit(1)), lambda x: F.concat(F.lit("jira:issue:"), x))
    return F.array_distinct(F.concat(page(r"viewpage\.action\?pageId=(\d+)"), page(r"/spaces/[^/\s]+/pages/(\d+)"), issues))


def wiki_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))


def links(text: Column, own: Column) -> Column:
    """Tickets, addresses, wiki links; first appearance, without the document itself."""
    tickets = F.transform(ticket_keys(text), lambda x: F.concat(F.lit("jira:issue:"), x))
    return F.filter(F.array_distinct(F.concat(tickets, url_links(text), wiki_links(text))), lambda x: x != own)


def redact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"://[^\s/@]+(:[^\s/@]*)?@", "://***@"), "(?i)" + CREDENTIAL, "$1***")


def secrets(text: Column) -> Column:
    """Names of the secret rules that match."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SHAPES.items()]))


def subtokens(identifier: Column) -> Column:
    """Fixed rules: parts at case and acronym boundaries, and their letter and digit runs; lower case, two characters at least, first appearance."""
    parts = F.flatten(F.transform(F.split(identifier, r"[^A-Za-z0-9]+", -1), lambda x: F.split(x, r"(?<=[A-Z]{2})(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])", -1)))
    runs = lambda p: F.concat(F.array(p), F.when(p.rlike("[A-Za-z]") & p.rlike("[0-9]"), F.split(p, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", -1)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(parts, runs)), F.lower), lambda x: F.char_length(x) >= 2))


def tokenize(identifier: Column) -> Column:
    """The identifier and its subtokens."""
    whole = F.lower(identifier)
    return F.array_distinct(F.concat(F.filter(F.array(whole), lambda x: F.char_length(x) >= 2), subtokens(identifier)))


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """Suffixes of a path (itself first), segments with the name without its extension, and subtokens; lower case, two characters at least."""
    clean = F.regexp_replace(path, r"^/+", "")
    segments = F.filter(F.split(clean, "/", -1), lambda x: x != "")
    suffixes = F.transform(segments, lambda _, i: F.when(i == 0, clean).otherwise(F.array_join(F.slice(segments, i + 1, F.size(segments)), "/")))
    bare = F.regexp_replace(F.coalesce(F.get(segments, F.size(segments) - 1), F.lit("")), r"\.[^.]+$", "")
    kept = lambda a: F.array_distinct(F.filter(F.transform(a, F.lower), lambda x: F.char_length(x) >= 2))
    return kept(suffixes), kept(F.concat(segments, F.array(bare))), subtokens(clean)


def path_tokens(path: Column) -> Column:
    """Suffixes, segments, name without extension and subtokens of a path."""
    return F.array_distinct(F.concat(*path_parts(path)))


def identifiers(text: Column) -> Column:
    """Distinct identifiers of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))


def code_tokens(path: Column, text: Column) -> Column:
    """All tokens under which a file is found."""
    return F.array_distinct(F.concat(path_tokens(path), F.flatten(F.transform(identifiers(text), tokenize))))


def query_tokens(query: Column) -> Column:
    """Tokens of a query, by the rules of the index: words that look like paths give those of paths too."""
    words = F.regexp_extract_all(query, F.lit(r"[A-Za-z0-9_$./-]+"), F.lit(0))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.when(w.contains("/") | w.rlike(r"\.[A-Za-z0-9]{1,8}$"), path_tokens(w)).otherwise(none), tokenize(w)))))


def slice_snippet(text: Column, most: int = 540) -> Column:
    """At most ``most`` characters, without a broken last word and white space at the end; the plain cut where one word fills it."""
    cut = F.substring(text, 1, most)
    whole = F.regexp_replace(F.regexp_replace(cut, r"\S*\z", ""), r"\s+\z", "")
    return F.when(F.char_length(text) <= most, text).when(whole != "", whole).otherwise(cut)


def code_chunks(body: Column, size: int = 60, step: int = 50) -> Column:
    """array<struct<a,b,text>>: windows of ``size`` lines that overlap; the last one ends at the last line."""
    lines = F.split(body, "\n", -1)
    n = F.size(lines)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - (size - step) - 1), F.lit(step))
    return F.transform(starts, lambda s: F.struct((s + 1).alias("a"), F.least(s + size, n).alias("b"), F.array_join(F.slice(lines, s + 1, size), "\n").alias("text")))


def windows(text: Column, heading: Column, most: int = 1024) -> Column:
    """Embedding windows with their heading in front, a quarter of each in the next."""
    head = F.substring(F.concat(heading, F.lit("\n\n")), 1, most // 2)
    budget = most - F.char_length(head)
    step = F.greatest(F.lit(1), F.floor(budget * 0.75)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.char_length(text) - (budget - step) - 1), step)
    return F.transform(starts, lambda s: F.concat(head, F.substring(text, s + 1, budget)))
