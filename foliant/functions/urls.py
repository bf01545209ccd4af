"""Which URLs may be fetched."""

from __future__ import annotations

from collections.abc import Callable
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

QUAD = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"{QUAD}(?:\.{QUAD}){{3}}"
MAPPED = "00000000000000000000ffff"


def _quads(dotted: Column) -> Column:
    """Eight hexadecimal digits of a dotted address."""
    return F.array_join(F.transform(F.split(dotted, r"\."), lambda q: F.lpad(F.lower(F.hex(q.cast("bigint"))), 2, "0")), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def address_digits(host: Column) -> Column:
    """A literal address as 32 hexadecimal digits, an IPv4 one in its mapped form; null if the host is no address."""
    return _let(F.substring_index(host, "%", 1), lambda bare: F.when(
        bare.rlike(f"^{DOTTED}$"), F.concat(F.lit(MAPPED), _quads(bare))).when(bare.contains(":"), _let(_without_dots(bare), _wide)))


def _without_dots(bare: Column) -> Column:
    """An IPv6 address whose dotted tail, if any, is written as two groups."""
    def swapped(tail: Column) -> Column:
        return _let(_quads(tail), lambda d: F.concat(F.regexp_replace(bare, r"[0-9.]*$", ""), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))

    return _let(F.regexp_extract(bare, rf":({DOTTED})$", 1), lambda tail: F.when(tail != "", swapped(tail)).otherwise(bare))


def _wide(six: Column) -> Column:
    """All eight groups in full, null where they are not sound."""
    groups = lambda side: F.when(F.coalesce(side, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
    padded = lambda side: F.array_join(F.transform(side, lambda g: F.lpad(g, 4, "0")), "")

    def joined(x: Column) -> Column:
        shown = F.size(x["left"]) + F.size(x["right"])
        whole = F.when(x["sides"] == 1, shown == 8).otherwise((x["sides"] == 2) & (shown <= 7))
        sound = F.forall(F.concat(x["left"], x["right"]), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(whole & sound, F.concat(padded(x["left"]), F.repeat(F.lit("0000"), F.greatest(F.lit(0), 8 - shown)), padded(x["right"])))

    return _let(F.split(six, "::"), lambda sides: _let(F.struct(
        F.size(sides).alias("sides"), groups(F.get(sides, F.lit(0))).alias("left"), groups(F.get(sides, F.lit(1))).alias("right")), joined))


def _within(digits: Column, networks: list[str]) -> Column:
    """Whether an address lies in one of the networks."""
    out = F.lit(False)
    for network in map(ip_network, networks):
        start, end = (f"{int(x):0{network.max_prefixlen // 4}x}" for x in (network[0], network[-1]))
        if network.version == 4:
            start, end = MAPPED + start, MAPPED + end
        out = out | digits.between(start, end)
    return out


def is_public(host: Column) -> Column:
    """Whether a literal address can be reached from anywhere; null if the host is no address."""
    return _let(address_digits(host), lambda digits: F.when(
        digits.isNotNull(), ~_within(digits, fv.SPECIAL_NETWORKS) | _within(digits, fv.PUBLIC_EXCEPTIONS)))


def url_parts(url: Column) -> Column:
    """Struct of scheme, user, host (lower case, no brackets) and port; empty where missing."""
    text = F.btrim(F.regexp_replace(url, r"[\t\r\n]", ""), F.lit("".join(map(chr, range(0x21)))))
    scheme = F.lower(F.regexp_extract(text, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    authority = F.regexp_extract(text, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
    user = F.regexp_extract(authority, r"^(.*)@", 1)
    place = F.regexp_extract(authority, r"([^@]*)\z", 1)
    host = F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(place, r"^([^:]*)", 1))
    after = F.when(place.startswith("["), F.regexp_extract(place, r"\](.*)\z", 1)).otherwise(F.regexp_extract(place, r"^[^:]*(:.*)\z", 1))
    port = F.regexp_extract(after, r"^:(.*)\z", 1)
    return F.struct(scheme.alias("scheme"), user.alias("user"), F.lower(host).alias("host"), port.alias("port"))


def url_rejection(url: Column) -> Column:
    """Reason why a URL may not be fetched, or null."""
    return _let(url_parts(F.coalesce(url, F.lit(""))), _rejection)


def _rejection(parts: Column) -> Column:
    host, port = parts["host"], parts["port"]
    local = host == "localhost"
    for suffix in fv.LOCAL_SUFFIXES:
        local = local | host.endswith(suffix)
    # most hosts are names: only what looks like an address is taken apart
    private = F.when(host.rlike(r"^[0-9.]+$|:"), ~F.coalesce(is_public(host), F.lit(True))).otherwise(F.lit(False))
    return (
        F.when(~parts["scheme"].isin("http", "https"), fv.URL_BAD_SCHEME)
        .when(host == "", fv.URL_NO_HOST)
        .when(parts["user"].rlike("[^:]"), fv.URL_CREDENTIALS)
        .when((port != "") & ~port.rlike("^0*(80|443)$"), fv.URL_BAD_PORT)
        .when(local | private, fv.URL_NOT_PUBLIC)
    )
