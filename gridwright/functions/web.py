"""Links, hosts and robots rules. Columns in, Columns out."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import first_match, text_of, trim_ws

# How links name their kind, and which hosts and words matter.
EXTENSIONS = (
    (r"(?i)\.pdf($|[?#])", "pdf"),
    (r"(?i)\.(xlsx|xlsm|xls|ods)($|[?#])", "spreadsheet"),
    (r"(?i)\.(csv|tsv)($|[?#])", "csv"),
    (r"(?i)\.(docx|doc|rtf|odt)($|[?#])", "document"),
    (r"(?i)\.(png|jpe?g|gif|webp|tiff?|bmp|svg)($|[?#])", "image"),
    (r"(?i)\.(zip|7z|tar|gz)($|[?#])", "archive"),
    (r"(?i)\.(html?|xhtml)($|[?#])", "html"),
)
MIMES = (
    (r"(?i)^application\/pdf", "pdf"),
    (r"(?i)spreadsheetml|ms-excel|vnd\.oasis\.opendocument\.spreadsheet", "spreadsheet"),
    (r"(?i)^text\/csv|^text\/tab-separated", "csv"),
    (r"(?i)wordprocessingml|msword|vnd\.oasis\.opendocument\.text|^application\/rtf", "document"),
    (r"(?i)^image\/", "image"),
    (r"(?i)^application\/(zip|x-7z|x-tar|gzip)", "archive"),
    (r"(?i)^text\/html|^application\/xhtml", "html"),
)
VAGUE = r"(?i)^(application\/octet-stream|binary\/octet-stream|application\/force-download|application\/download|content\/unknown)$"
PLAIN = r"(?i)^text\/plain"
DOCUMENT_KINDS = ("pdf", "spreadsheet", "csv", "document", "image")
INDEX_WORDS = r"(?i)(report|investor|financ|annual|interim|quarter|result|download|publication|media|disclosure|filing|archive|statement|document|presentation|circular)"
FILE_WORDS = r"(?i)download|file|attachment|asset|document"
INTERNAL = (".local", ".internal", ".localdomain", ".home.arpa", ".localhost", ".lan", ".intranet")
PORTS = ("", "80", "443", "8080", "8443")
#: Address blocks that are not of the public network: this one, private, shared, loopback, link-local, protocol and benchmark ones, multicast and above.
NETWORKS = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/16", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/3")
NETWORKS_6 = ("::/128", "::1/128", "fc00::/7", "fe80::/10")

#: What stays as it is in a query's value, besides letters, digits and -_.
_PLAIN = "!'()*~"


def sniff_kind(url: Column, content_type: Column) -> Column:
    """struct(kind, basis, mime): a specific content type wins, then the extension; text/plain defers to the extension."""
    mime = trim_ws(F.element_at(F.split(text_of(content_type), ";"), 1))
    by_mime = F.when(~mime.rlike(VAGUE), first_match(mime, MIMES))
    by_name = first_match(text_of(url), EXTENSIONS)
    plain = mime.rlike(PLAIN)
    kind = F.coalesce(by_mime, by_name, F.when(plain, "text"), F.lit("unknown"))
    basis = F.when(by_mime.isNotNull(), "content-type").when(by_name.isNotNull(), "extension").when(plain, "content-type").otherwise("unknown")
    return F.struct(kind.alias("kind"), basis.alias("basis"), mime.alias("mime"))


def is_document_kind(kind: Column) -> Column:
    return kind.isin(*DOCUMENT_KINDS)


def url_parts(url: Column) -> Column:
    """struct(scheme, user, host, port, path) of an absolute http-like url; nulls where there is none."""
    get = lambda i: F.regexp_extract(text_of(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)", i)
    return F.when(text_of(url).rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.struct(F.lower(get(1)).alias("scheme"), get(2).alias("user"), F.lower(get(3)).alias("host"), get(4).alias("port"), F.when(get(5) == "", "/").otherwise(get(5)).alias("path")))


def without_fragment(url: Column) -> Column:
    return F.element_at(F.split(text_of(url), "#"), 1)


def is_index_link(url: Column, label: Column, origin: Column) -> Column:
    """Worth following one level down: same origin, another page, not a file, and named like an index."""
    a, b = url_parts(url), url_parts(origin)
    same = (a["scheme"] == b["scheme"]) & (a["host"] == b["host"]) & (a["port"] == b["port"])
    page = sniff_kind(url, F.lit(""))["kind"].isin("unknown", "html")
    return F.coalesce(same & (without_fragment(url) != without_fragment(origin)) & page & (a["path"].rlike(INDEX_WORDS) | text_of(label).rlike(INDEX_WORDS)), F.lit(False))


def worth_sniffing(url: Column, label: Column, kind: Column) -> Column:
    path = url_parts(url)["path"]
    named = url.rlike(INDEX_WORDS) | text_of(label).rlike(INDEX_WORDS) | url.rlike(FILE_WORDS)
    return F.when(is_document_kind(kind), True).when(kind != "unknown", False).otherwise(F.coalesce(~path.endswith("/") & (path != "") & named, F.lit(False)))


def _in_network(address: Column, network: str) -> Column:
    """Whether a whole number is an address of a version 4 network."""
    net = ipaddress.ip_network(network)
    return address.between(int(net.network_address), int(net.broadcast_address))


def _in_network_6(group: Column, host: Column, network: str) -> Column:
    """The same for version 6, by the address's first group of 16 bits; single addresses by their text."""
    net = ipaddress.ip_network(network)
    if net.prefixlen == 128:
        return host == str(net.network_address)
    return group.between(int(net.network_address) >> 112, int(net.broadcast_address) >> 112)


def blocked_host(hostname: Column) -> Column:
    """Hosts of private and special networks, internal names, bare numbers, and addresses that are none."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text_of(hostname)), r"^\[|\]$", ""), r"\.$", ""), "^::ffff:", "")
    parts = F.transform(F.split(host, r"\."), lambda x: x.try_cast("long"))
    address = F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
    group = F.conv(F.regexp_extract(host, "^([0-9a-f]{1,4})(?::|$)", 1), 16, 10).cast("long")
    any_of = lambda tests: F.coalesce(reduce(or_, tests), F.lit(False))
    named = any_of([host == "", host == "localhost", host.rlike(r"^\d+$"), host.rlike("^0x[0-9a-f]+$"), *[host.endswith(x) for x in INTERNAL]])
    four = F.exists(parts, lambda x: x > 255) | any_of([_in_network(address, n) for n in NETWORKS])
    six = any_of([_in_network_6(group, host, n) for n in NETWORKS_6]) | (host.contains(":") & ~host.rlike("^[0-9a-f:.]+$"))
    return F.when(named, True).when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), four).otherwise(six)


def validate_target(url: Column, block: list[str] = (), allow: list[str] = ()) -> Column:
    """struct(ok, status, code)."""
    p = url_parts(url)
    listed = lambda hosts: F.exists(F.array(*[F.lit(h.strip().lower()) for h in hosts]), lambda h: (p["host"] == h) | p["host"].endswith(F.concat(F.lit("."), h))) if hosts else F.lit(False)
    bad = lambda status, code: F.struct(F.lit(False).alias("ok"), F.lit(status).alias("status"), F.lit(code).alias("code"))
    default = ((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443"))
    return (
        F.when(p.isNull() & ~text_of(url).rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bad(400, "BAD_URL"))
        .when(p.isNull() | ~p["scheme"].isin("http", "https"), bad(400, "BAD_SCHEME"))
        .when(p["user"] != "", bad(400, "CREDENTIALS_IN_URL"))
        .when(~default & ~p["port"].isin(*PORTS) & (p["port"].try_cast("int") < 1024), bad(403, "BLOCKED_PORT"))
        .when(blocked_host(p["host"]), bad(403, "BLOCKED_HOST"))
        .when(listed(block), bad(403, "HOST_BLOCKLISTED"))
        .when(F.lit(bool(allow)) & ~listed(allow), bad(403, "HOST_NOT_ALLOWLISTED"))
        .otherwise(F.struct(F.lit(True).alias("ok"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("code")))
    )


def filename_from_url(url: Column, fallback: str = "download") -> Column:
    last = F.element_at(F.filter(F.split(F.coalesce(url_parts(url)["path"], F.lit("")), "/"), lambda x: x != ""), -1)
    name = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    return F.coalesce(F.when(name != "", name), F.lit(fallback))


def proxy_url(base: str, target: Column, params: dict[str, str] | None = None) -> Column:
    """The url by which a proxy at base is asked for target; further params follow, empty ones left out."""
    base = (base or "").strip()
    if not base:
        raise ValueError("no proxy is set")
    if not base.lower().startswith(("http://", "https://")):
        raise ValueError("the proxy must be a valid absolute http(s) address")
    more = "".join(f"&{quote(k, safe=_PLAIN)}={quote(str(v), safe=_PLAIN)}" for k, v in (params or {}).items() if v not in (None, ""))
    encoded = F.url_encode(target)
    for code, plain in (("+", "%20"), *[(f"%{ord(c):02X}", c) for c in _PLAIN]):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return F.concat(F.lit(base + ("&" if "?" in base else "?") + "url="), encoded, F.lit(more))


def robots_match_length(pattern: Column, path: Column) -> Column:
    """How much of a rule matches a path from its start, or -1; * and a last $ are wildcards, an empty rule matches nothing."""
    wild = pattern.contains("*") | pattern.endswith("$")
    quoted = F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1")
    source = F.concat(F.lit("^"), F.regexp_replace(F.replace(quoted, F.lit("*"), F.lit(".*")), r"\\\$$", r"\$"))
    return F.when(pattern == "", -1).when(wild, F.when(F.rlike(path, source), F.length(F.replace(pattern, F.lit("*"), F.lit("")))).otherwise(-1)).when(F.startswith(path, pattern), F.length(pattern)).otherwise(-1)


# Responses


def response_info(url: Column, content_type: Column, content_length: Column, content_range: Column) -> Column:
    """struct(content_type, bytes, kind, basis) of a response's headers: a length that is missing, 0 or 1, as ranged requests have it, gives way to the range's total."""
    told = F.regexp_extract(text_of(content_range), r"/(\d+)\s*$", 1)
    length = F.nullif(text_of(content_length), F.lit(""))
    size = F.when((length.isNull() | length.isin("0", "1")) & (told != ""), told).otherwise(length)
    kind = sniff_kind(url, content_type)
    return F.struct(text_of(content_type).alias("content_type"), size.try_cast("long").alias("bytes"), kind["kind"].alias("kind"), kind["basis"].alias("basis"))


def response_error(ok: Column, proxied: Column, status: Column, target_status: Column) -> Column:
    """Why a response that came through a proxy is none: a code, or null if it is one. What doesn't bear the proxy's mark did not come from it."""
    n = F.coalesce(target_status, status)
    by_status = F.when(n == 404, "TARGET_NOT_FOUND").when(n.isin(401, 403), "TARGET_FORBIDDEN").when(n == 413, "TOO_LARGE").when(n >= 500, "TARGET_ERROR").otherwise("PROXY_ERROR")
    return F.when(~ok, F.when(~proxied & (status >= 400), "NOT_A_PROXY").otherwise(by_status))


SUFFIXES = (("pdf", "pdf"), ("spreadsheet", "xlsx"), ("csv", "csv"), ("document", "docx"), ("image", "png"), ("html", "html"))


def download_name(url: Column, content_type: Column, asked: Column | None = None) -> Column:
    """The file name of a download: the one asked for or the url's own, with the suffix of its kind if it has none."""
    name = filename_from_url(url) if asked is None else F.coalesce(F.nullif(asked, F.lit("")), filename_from_url(url))
    suffix = first_match(sniff_kind(url, content_type)["kind"], [(f"^{k}$", s) for k, s in SUFFIXES])
    return F.when(name.rlike(r"(?i)\.[a-z0-9]{2,5}$") | suffix.isNull(), name).otherwise(F.concat(name, F.lit("."), suffix))


def is_html(content_type: Column) -> Column:
    """Whether a response can be read as a page."""
    return trim_ws(F.element_at(F.split(text_of(content_type), ";"), 1)).rlike("(?i)text/html|application/xhtml|text/plain|^$")
