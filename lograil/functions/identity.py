"""Canonical identifiers: scoped entity ids, addresses, hosts, digests, record hashes."""
import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

try:
    import idna
except ImportError:  # a job that needs it fails when it is defined
    idna = None

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
HOST = rf"^{_LABEL}(\.{_LABEL})*$"


def quote(value: Column) -> Column:
    """Percent-encode everything outside A-Z a-z 0-9 _ . - ~ (RFC 3986)."""
    # Form encoding differs from that in exactly three characters.
    return F.replace(F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")),
                               F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def entity_id(environment: str | Column, kind: str, value: Column) -> Column:
    environment = F.lit(environment) if isinstance(environment, str) else environment
    return F.concat(quote(environment), F.lit(":"), F.lit(kind), F.lit(":"), quote(value))


@F.pandas_udf(StringType())
def _canon_ip6(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(text):
        try:
            return str(ipaddress.ip_address(text))
        except ValueError:
            return None
    for batch in values:
        yield batch.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def _canon_idn(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(text):
        try:
            return idna.encode(text, uts46=True, std3_rules=True, transitional=False).decode("ascii").lower()
        except idna.IDNAError:
            return None
    for batch in values:
        yield batch.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def _canon_either(values: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(addressed, text):
        try:
            if addressed:
                return str(ipaddress.ip_address(text))
            return idna.encode(text, uts46=True, std3_rules=True, transitional=False).decode("ascii").lower()
        except (ValueError, idna.IDNAError):
            return None
    for addressed, batch in values:
        yield pd.Series([None if x is None else one(six, x) for six, x in zip(addressed, batch)], dtype=object)


def canon_ip4(value: Column) -> Column:
    return F.when(value.rlike(IPV4), value)


def canon_ip(value: Column) -> Column:
    """Canonical address or null. Python sees only values with a colon."""
    six = _canon_ip6(F.when(value.contains(":"), value))
    return F.when(value.contains(":"), six).otherwise(canon_ip4(value))


def canon_domain_ascii(value: Column) -> Column:
    """Canonical ASCII host or null: no wildcard, path or address, one closing dot dropped."""
    host = F.lower(F.regexp_replace(value, r"\.$", ""))
    hyphens = host.rlike(r"(^|\.)[^.][^.]--") & ~host.rlike(r"(^|\.)xn--")
    return F.when(host.rlike(HOST) & (F.length(host) <= 253) & ~host.rlike(IPV4) & ~hyphens
                  & ~value.rlike(r"\.\.$"), host)


def _foreign_host(value: Column) -> Column:
    if idna is None:
        raise ImportError("non-ASCII hosts need the package idna on the driver and on all executors")
    return value.rlike(r"[^\x00-\x7F]") & ~value.rlike(r"[*/@]") & ~value.rlike(r"\.\.$")


def canon_domain(value: Column) -> Column:
    """Canonical host or null. Python sees only non-ASCII hosts."""
    foreign = _foreign_host(value)
    encoded = _canon_idn(F.when(foreign, F.regexp_replace(value, r"\.$", "")))
    return F.when(foreign, F.when(F.length(encoded) <= 253, encoded)).otherwise(canon_domain_ascii(value))


def foreign_canon(addressed: Column, value: Column) -> Column:
    """What Python makes of addresses with a colon, where `addressed`, and else of non-ASCII hosts; null for other values.

    One worker a task serves both. Give it a column of its own, which `canon_ip_or_domain` reads.
    """
    return _canon_either(addressed, F.when(addressed & value.contains(":"), value)
                         .when(~addressed & _foreign_host(value), F.regexp_replace(value, r"\.$", "")))


def canon_ip_or_domain(addressed: Column, value: Column, found: Column) -> Column:
    """`canon_ip` where `addressed`, else `canon_domain`; `found` is their `foreign_canon`."""
    return (F.when(addressed & value.contains(":"), found).when(addressed, canon_ip4(value))
            .when(_foreign_host(value), F.when(F.length(found) <= 253, found)).otherwise(canon_domain_ascii(value)))


def canon_sha256(value: Column) -> Column:
    return F.when(value.rlike("^[0-9a-fA-F]{64}$"), F.lower(value))


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON object with sorted keys, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def record_sha256(columns: list[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def event_identity(dataset: Column, source: Column, vendor_id: Column, content_sha256: Column) -> Column:
    """Hash of dataset, source and the vendor's id, or the content hash where there is none."""
    chosen = F.coalesce(F.when(vendor_id != "", vendor_id), content_sha256)
    return F.sha2(F.to_json(F.array(dataset, source, chosen)), 256)


def csv_safe(value: Column) -> Column:
    """Prefix a quote where a spreadsheet would read the cell as a formula."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[ \t\r\n]*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
