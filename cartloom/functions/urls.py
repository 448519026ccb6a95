"""URL parsing and normalisation as chained column steps over a table of URLs.

The steps are plain projections, so a whole URL table is normalised in the scan stage without a shuffle. Rules that the
common URL standard leaves to the implementer are settled here as follows:

* a query parameter that was written without ``=`` keeps that form;
* escapes of ordinary characters are decoded and the result is escaped again where a URL needs it;
* ``.`` and ``..`` segments are resolved;
* a host whose last label is numeric must be a dotted IPv4 address.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.sources.public_suffixes import with_domain_base

# Query parameters that only track visits.
TRACKING_PARAMS = [
    "_ga", "gclid", "gclsrc", "_gl", "fbclid", "twclid", "t", "msclkid",
    "ref", "referral", "source", "campaign", "medium", "content", "term",
    "igshid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "_kx", "zanpid", "affid", "aff_id", "affiliate", "cjevent",
]
TRACKING_FAMILIES = r"^(utm|fb|hsa)_\w+"

# Brand subdomains that stay part of the domain.
BRAND_SUBDOMAINS = ["oldnavy", "bananarepublic", "athleta", "bananarepublicfactory", "gapfactory", "gap"]

# Common public suffixes of more than one label. The full list is too large to ship; callers pass it, or their own, as
# ``suffixes`` in the list's notation: "a.b", "*.b" for any label in front of b, "!a.b" for an exception to such a rule.
PUBLIC_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "nhs.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au",
    "co.nz", "net.nz", "org.nz", "govt.nz", "ac.nz",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp",
    "co.kr", "or.kr", "co.in", "net.in", "org.in", "firm.in", "gen.in", "ind.in",
    "com.br", "net.br", "org.br", "gov.br", "com.mx", "org.mx", "com.ar", "net.ar", "org.ar",
    "com.cn", "net.cn", "org.cn", "gov.cn", "com.hk", "org.hk", "com.tw", "org.tw", "com.sg", "edu.sg",
    "com.my", "com.ph", "com.vn", "co.th", "in.th", "co.id", "or.id", "com.tr", "org.tr", "com.ua", "co.il", "org.il",
    "co.za", "org.za", "com.eg", "com.sa", "com.pl", "net.pl", "com.ru", "com.pt", "com.es", "com.co", "com.pe",
    "com.ve", "co.cr", "com.ec", "com.uy", "com.pk", "com.bd", "co.ke", "com.ng", "com.gh",
    "github.io", "gitlab.io", "blogspot.com", "herokuapp.com", "myshopify.com", "netlify.app", "vercel.app",
    "web.app", "pages.dev", "s3.amazonaws.com", "cloudfront.net", "azurewebsites.net",
]

# Host names and address ranges that are not public.
PRIVATE_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1", "[::1]"]
PRIVATE_RANGES = r"^(?:10\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.)"

PART_COLUMNS = ["u_url", "u_text", "u_scheme", "u_host", "u_port", "u_path", "u_query", "u_error", "u_message"]
COMPONENTS = ["href", "encoded_href", "hostname", "pathname", "search", "domain", "key", "original"]
_IPV4_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"


def _escape(c: Column, keep: str) -> Column:
    """Percent-encodes everything except ASCII letters, digits and the characters in ``keep``."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for ch in keep:
        if ch not in "*-._":
            out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return out


def _decode(c: Column) -> Column:
    """Decodes percent escapes; text with broken escapes stays as it is."""
    return F.when(F.contains(c, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def _resolve_dots(path: Column) -> Column:
    """Resolves ``.`` and ``..`` segments."""
    none = F.array().cast("array<string>")
    segments = F.split(path, "/")
    tagged = F.transform(segments, lambda s, i: F.struct(s.alias("s"), (i == F.size(segments) - 1).alias("last")))

    def step(acc: Column, x: Column) -> Column:
        closing = F.when(x["last"], F.array(F.lit(""))).otherwise(none)
        parent = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return (
            F.when(x["s"] == "..", F.concat(parent, closing))
            .when(x["s"] == ".", F.concat(acc, closing))
            .otherwise(F.array_append(acc, x["s"]))
        )

    return F.array_join(F.aggregate(tagged, none, step), "/")


#: Reads a column by name: ``F.col`` over a table, a field of the element within a list.
Get = Callable[[str], Column]
#: Named columns, each of which may read the ones before it; a name that comes again takes the place of the earlier one.
Steps = list[tuple[str, Callable[[Get], Column]]]


def path_steps() -> Steps:
    """``pathname``; every step looks at the path first, since most paths need none of the rewriting."""
    reserved = r"%(2[346BCFbcf]|3[ABDFabdf]|40)"

    def step(change: Callable[[Column], Column]) -> tuple[str, Callable[[Get], Column]]:
        return "c_path", lambda g: change(g("c_path"))

    return [
        ("c_path", lambda g: F.when(F.contains(g("u_path"), F.lit("%")), _decode(F.regexp_replace(g("u_path"), reserved, "%25$1"))).otherwise(g("u_path"))),
        step(lambda p: F.when(p.rlike(r"""[^!$-;=@-_a-z|~]|[`\x7f]"""), _escape(p, "!$%&'()+,/:;=@[\\]|~")).otherwise(p)),
        step(lambda p: F.when(F.contains(p, F.lit("/.")) & p.rlike(r"(^|/)\.{1,2}(/|$)"), _resolve_dots(p)).otherwise(p)),
        step(lambda p: F.when(F.contains(p, F.lit("//")), F.regexp_replace(p, r"(?<!\b[a-z][a-z\d+.-]{1,50}:)/{2,}", "/")).otherwise(p)),
        step(lambda p: F.when(p.endswith("/"), p.substr(F.lit(1), F.length(p) - 1)).otherwise(p)),
        ("pathname", lambda g: F.when(g("u_error").isNull(), F.when(g("c_path") == "", F.lit("/")).otherwise(g("c_path")))),
    ]


def param_name(part: Column) -> Column:
    return F.substring_index(part, "=", 1)


def query_steps() -> Steps:
    """``search``: tracking parameters dropped, the others sorted by name and escaped where a URL needs it."""

    def named(g: Get) -> Column:
        return F.transform(F.split(g("u_query"), "&"), lambda p, i: F.struct(_decode(param_name(p)).alias("n"), i.alias("i"), p.alias("p")))

    def kept(g: Get) -> Column:
        return F.filter(g("c_params"), lambda x: (x["p"] != "") & ~x["n"].isin(TRACKING_PARAMS) & ~x["n"].rlike(TRACKING_FAMILIES))

    def step(change: Callable[[Column], Column]) -> tuple[str, Callable[[Get], Column]]:
        return "c_query", lambda g: change(g("c_query"))

    return [
        ("c_params", lambda g: F.when(g("u_query") != "", named(g))),
        ("c_params", lambda g: F.when(g("c_params").isNotNull(), F.array_sort(kept(g)))),
        ("c_query", lambda g: F.coalesce(F.array_join(g("c_params")["p"], "&"), F.lit(""))),
        step(lambda q: F.when(F.contains(q, F.lit("%")) | F.contains(q, F.lit("+")), F.coalesce(F.try_url_decode(q), q)).otherwise(q)),
        step(lambda q: F.when(q.rlike(r"[^!$-&(-;=?-~]"), _escape(q, "!$%&()+,/:;=?@[\\]^`{|}~")).otherwise(q)),
        step(lambda q: F.when(q.endswith("/"), q.substr(F.lit(1), F.length(q) - 1)).otherwise(q)),
        ("search", lambda g: F.when(g("u_error").isNull(), F.when(g("c_query") == "", F.lit("")).otherwise(F.concat(F.lit("?"), g("c_query"))))),
    ]


def with_steps(df: DataFrame, steps: Steps) -> DataFrame:
    """The table with the columns of the steps; names that begin with ``c_`` are only used on the way."""
    for name, column in steps:
        df = df.withColumn(name, column(F.col))
    return df.drop(*{name for name, _ in steps if name.startswith("c_")})


def over_elements(elements: Column, steps: Steps) -> Column:
    """A list of structs, each with the fields of the steps added: the same steps as over a table, within a row."""

    def added(name: str, column: Callable[[Get], Column]) -> Column:
        return F.transform(elements, lambda x: x.withField(name, column(lambda field: x[field])))

    for name, column in steps:
        elements = added(name, column)
    return elements


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """Emits computed columns through a one-row generator.

    Filters and projections on them then read the result instead of being rewritten in terms of the whole computation,
    which would evaluate long column chains several times per row and make their plans grow with every step.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns))))


def with_url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds a validated but not normalised split of a URL.

    ``u_url, u_text, u_scheme, u_host, u_port, u_path, u_query, u_error, u_message``.
    """
    # one projection whose later columns refer to the earlier ones
    split = df.select("*", *[c(F.col).alias(n) for n, c in part_steps(lambda g: F.col(url_col))]).select(*df.columns, *PART_COLUMNS)
    return settled(split, *PART_COLUMNS)


def part_steps(url: Callable[[Get], Column]) -> Steps:
    """The columns of ``with_url_parts`` and some that they are worked out from."""

    def ascii_host(g: Get) -> Column:
        host = g("u_host0")
        return F.when(host.rlike(r"[^\x00-\x7f]"), F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host))).otherwise(host)

    def bad_host(g: Get) -> Column:
        host, port = g("u_host"), g("u_port")
        name_form = host.rlike(r"^[^\x00-\x20#%/:<>?@\[\\\]^|\x7f]+$") | host.rlike(r"^\[[0-9a-f:.]+\]$")
        numeric = host.rlike(r"(^|\.)\d+\.?$")
        ipv4 = host.rlike(rf"^{_IPV4_OCTET}(?:\.{_IPV4_OCTET}){{3}}\.?$")
        # an empty port is no number, and telling so by the cast costs an exception
        high = F.coalesce(F.when(F.length(port).between(1, 9), port.try_cast("int")), F.lit(0)) > 65535
        return host.isNull() | ~name_form | (numeric & ~ipv4) | high | (F.length(port) > 9)

    def missing(g: Get) -> Column:
        return F.coalesce(F.length(url(g)), F.lit(0)) == 0

    def foreign(g: Get) -> Column:
        return ~g("u_scheme").isin("http", "https")

    def after(text: Column, head: Column, skip: int) -> Column:
        return F.substr(text, F.length(head) + skip)

    return [
        ("u_url", lambda g: F.when(url(g).startswith("www."), F.concat(F.lit("https://"), url(g))).otherwise(url(g))),
        ("u_text", lambda g: F.regexp_replace(F.regexp_replace(g("u_url"), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")),
        ("u_scheme", lambda g: F.lower(F.regexp_extract(g("u_text"), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))),
        ("u_main", lambda g: F.substring_index(g("u_text"), "#", 1)),
        ("u_rest", lambda g: F.regexp_replace(F.translate(F.substring_index(g("u_main"), "?", 1), "\\", "/"), r"^[A-Za-z]+:/*", "")),
        ("u_query", lambda g: after(g("u_main"), F.substring_index(g("u_main"), "?", 1), 2)),
        ("u_authority", lambda g: F.substring_index(g("u_rest"), "/", 1)),
        ("u_path", lambda g: after(g("u_rest"), g("u_authority"), 1)),
        ("u_hostport", lambda g: F.lower(F.substring_index(g("u_authority"), "@", -1))),
        ("u_port", lambda g: F.regexp_extract(g("u_hostport"), r":(\d*)$", 1)),
        ("u_host0", lambda g: _decode(F.regexp_replace(g("u_hostport"), r":\d*$", ""))),
        ("u_host", ascii_host),
        ("u_bad_host", bad_host),
        ("u_error", lambda g: F.when(missing(g) | foreign(g) | g("u_bad_host"), F.lit("InvalidUrlError"))),
        # fixed values: the texts that go with an error
        (
            "u_message",
            lambda g: F.when(missing(g), F.lit("URL must be a non-empty string"))
            .when(g("u_scheme") == "", F.concat(F.lit("Invalid URL format: "), g("u_url")))
            .when(foreign(g), F.concat(F.lit("Invalid protocol: "), g("u_scheme"), F.lit(":. Only HTTP(S) protocols are allowed")))
            .when(g("u_bad_host"), F.concat(F.lit("Invalid URL format: "), g("u_url"))),
        ),
    ]


# Second-level labels that are taken for suffixes below any two-letter country, so that unlisted countries' sites don't merge.
COUNTRY_LEVELS = ["ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "mil", "ne", "net", "or", "org"]


def domain_of(host: Column, suffixes: Iterable[str] = PUBLIC_SUFFIXES) -> Column:
    """Registrable domain of a host: the longest known public suffix plus one label; IP addresses stay whole.

    Suffixes may have any number of labels; exceptions count before other rules, and longer rules before shorter ones.
    """
    exact, wild, spared = {}, {}, {}
    for s in suffixes:
        group, text = (spared, s[1:]) if s.startswith("!") else (wild, s[2:]) if s.startswith("*.") else (exact, s)
        group.setdefault(text.count(".") + 1, []).append(text)

    def tail(n: int) -> Column:
        return F.substring_index(host, ".", -n)

    labels = F.size(F.split(host, r"\."))
    rules = [(tail(n).isin(names), tail(n)) for n, names in sorted(spared.items(), reverse=True)]
    for n in sorted({*exact, *(k + 1 for k in wild)} - {1}, reverse=True):
        if n in exact:
            rules.append((tail(n).isin(exact[n]), tail(n + 1)))
        if n - 1 in wild:
            rules.append((tail(n - 1).isin(wild[n - 1]) & (labels >= n), tail(n + 1)))
    by_suffix = tail(2)
    by_suffix = F.when(tail(2).rlike(rf"^({'|'.join(COUNTRY_LEVELS)})\.[a-z]{{2}}$"), tail(3)).otherwise(by_suffix)
    for holds, domain in reversed(rules):
        by_suffix = F.when(holds, domain).otherwise(by_suffix)
    return F.when(host.rlike(r"^(\[.*\]|[\d.]+)$"), host).otherwise(by_suffix)


def host_steps() -> Steps:
    """``hostname``: without a dot at the end and, where a whole domain follows, without ``www.``"""
    www = r"^www\.(?!www\.)([a-z\d-]{1,63}\.[a-z\d.-]{2,63})$"

    def hostname(g: Get) -> Column:
        bare = F.regexp_replace(g("u_host"), r"\.$", "")
        return F.when(g("u_error").isNull(), F.when(g("u_host").startswith("www."), F.regexp_replace(bare, www, "$1")).otherwise(bare))

    return [("hostname", hostname)]


def brand_steps() -> Steps:
    """``domain``: the registrable domain ``c_base`` with the first brand subdomain kept in front of it."""

    def brand(g: Get) -> Column:
        host, base = g("hostname"), g("c_base")
        inner = host.substr(F.lit(1), F.length(host) - F.length(base) - 1)
        brands = F.array(*[F.lit(b) for b in BRAND_SUBDOMAINS])
        return F.when(F.length(host) > F.length(base), F.get(F.array_intersect(F.split(inner, r"\."), brands), 0))

    def domain(g: Get) -> Column:
        first, base = g("c_brand"), g("c_base")
        return F.when(first.isNotNull() & ~base.startswith(F.concat(first, F.lit("."))), F.concat(first, F.lit("."), base)).otherwise(base)

    return [("c_brand", brand), ("domain", domain)]


def domain_steps(suffixes: Iterable[str]) -> Steps:
    """``domain`` by a short list of public suffixes."""
    return [("c_base", lambda g: domain_of(g("hostname"), suffixes)), *brand_steps()]


def url_key(text: Column) -> Column:
    """16-character dedup key: URL-safe head of the base64 SHA-1."""
    return F.translate(F.substring(F.base64(F.unhex(F.sha1(text))), 1, 16), "+/=", "___")


def encode_component(c: Column) -> Column:
    return _escape(c, "!~*'()")


def with_url_components(
    df: DataFrame, url_col: str = "url", suffixes: Iterable[str] | DataFrame = PUBLIC_SUFFIXES
) -> DataFrame:
    """Adds href, encoded_href, hostname, pathname, search, domain, key, original, error and message.

    ``suffixes`` is a short list of public suffixes, which becomes part of the expression, or a table of rules of any size
    (``public_suffixes.suffix_rules``), which the distinct hosts are joined with; streams take the list.
    """
    ok = F.col("u_error").isNull()
    parts = with_steps(with_url_parts(df, url_col), host_steps())
    if isinstance(suffixes, DataFrame):
        cleaned = settled(with_steps(parts, [*path_steps(), *query_steps()]), "pathname", "search")
        split = with_steps(with_domain_base(cleaned, suffixes, "hostname", "c_base"), brand_steps()).drop("c_base")
    else:
        steps = [*path_steps(), *query_steps(), *domain_steps(suffixes)]
        split = settled(with_steps(parts, steps), "pathname", "search", "domain")
    return (
        split.withColumn("href", F.concat(F.lit("https://"), "hostname", "pathname", "search"))
        .withColumn("encoded_href", encode_component(F.col("href")))
        .withColumn("key", url_key(F.concat("domain", F.lower("pathname"), F.lower("search"))))
        .withColumn("original", F.when(ok, F.col(url_col)))
        .withColumn("error", F.col("u_error"))
        .withColumn("message", F.col("u_message"))
        .drop(*PART_COLUMNS)
    )


def is_public_host(host: Column) -> Column:
    """False for loopback, private and link-local hosts."""
    return ~(host.isin(PRIVATE_HOSTS) | host.rlike(PRIVATE_RANGES))
