"""URLs: canonical form, hosts, social profiles, and what may be fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of parameters that only track, and of hosts that are not public (fixed values).
TRACKING = "^(utm_.*|fbclid|gclid|mc_cid|mc_eid|_hsenc|_hsmi|ref)$"
PRIVATE_NAMES = ["localhost", "instance-data", "metadata.google.internal"]
PRIVATE_SUFFIXES = [".local", ".internal", ".lan", ".corp", ".test", ".example", ".invalid"]
#: Hosts of social platforms, and first path segments that are no profiles (fixed values).
SOCIAL = {"linkedin.com": "linkedin", "facebook.com": "facebook", "instagram.com": "instagram", "x.com": "x", "twitter.com": "x", "youtube.com": "youtube", "youtu.be": "youtube", "tiktok.com": "tiktok"}
NO_PROFILE = {
    "facebook": ["sharer", "sharer.php", "share.php", "dialog", "policy.php", "privacy", "events", "groups", "plugins", "profile.php"],
    "instagram": ["p", "reel", "reels", "stories", "explore"],
    "x": ["intent", "share", "home", "search", "i"],
}


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", group)


def authority(url: Column) -> Column:
    return F.lower(_part(url, 2))


def host(url: Column) -> Column:
    """The host without credentials, port and a leading ``www.``; empty if there is none."""
    bare = F.regexp_replace(F.regexp_replace(authority(F.coalesce(url, F.lit(""))), "^[^@]*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(bare, r"^www\.", "")


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case without the scheme's own port, single slashes in the path, the query decoded, sorted without tracking
    and blank parameters and encoded again, no fragment."""
    url = F.trim(url)
    scheme = F.lower(_part(url, 1))
    where = F.when(scheme == "http", F.regexp_replace(authority(url), ":80$", "")).when(scheme == "https", F.regexp_replace(authority(url), ":443$", "")).otherwise(authority(url))
    path = F.regexp_replace(_part(url, 3), "/+", "/")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.filter(F.split(_part(url, 4), "&"), lambda p: p.rlike("^[^=]+=.+")), lambda p: F.struct(plain(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), plain(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).rlike(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(scheme, F.lit("://"), where, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def homepage(raw: Column) -> Column:
    """A homepage as given in a register, with https where no scheme is given, without query and fragment; null for blank."""
    text = F.trim(raw)
    full = F.when(text.rlike("^(?i)https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lower(_part(full, 1)), F.lit("://"), authority(full), _part(full, 3)))


def social_profile(url: Column) -> Column:
    """The profile that a URL stands for, as a struct of ``platform`` and ``url``; null for others."""
    h = host(url)
    platform = F.lit(None).cast("string")
    for domain, label in SOCIAL.items():
        platform = F.when((h == domain) | F.endswith(h, F.lit("." + domain)), label).otherwise(platform)
    parts = F.filter(F.transform(F.split(_part(url, 3), "/"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.lower(F.get(parts, F.lit(0)))
    handle = F.startswith(F.get(parts, F.lit(0)), F.lit("@"))
    refused = F.size(parts) == 0
    for label, names in NO_PROFILE.items():
        refused = refused | (platform == label) & first.isin(names)
    refused = (
        refused | (platform == "linkedin") & ((first != "company") | (F.size(parts) < 2)) | (h == "youtu.be")
        | (platform == "youtube") & ~first.isin("channel", "user", "c") & ~handle | (platform == "tiktok") & ~handle | (platform == "x") & (F.size(parts) != 1)
    )
    kept = F.when((platform == "linkedin") | (platform == "youtube") & ~handle, F.slice(parts, 1, 2)).when(platform == "youtube", F.slice(parts, 1, 1)).otherwise(parts)
    full = F.concat(F.lit("https://"), platform, F.lit(".com/"), F.array_join(kept, "/"))
    return F.when(platform.isNotNull() & ~refused, F.struct(platform.alias("platform"), full.alias("url")))


def reject_reason(url: Column) -> Column:
    """Why a URL must not be fetched, or null: scheme, credentials, host, private suffix, literal address. Names aren't resolved."""
    where = authority(url)
    h = F.regexp_replace(F.regexp_replace(where, "^[^@]*@", ""), ":[0-9]*$", "")
    v4 = h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    private = h.rlike(r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^192\.0\.[02]\.|^198\.51\.100\.|^203\.0\.113\.|^198\.1[89]\.|^(22[4-9]|2[3-5][0-9])\.")
    suffix = F.lit(False)
    for s in PRIVATE_SUFFIXES:
        suffix = suffix | F.endswith(h, F.lit(s))
    return (
        F.when(~F.lower(_part(url, 1)).isin("http", "https") | url.isNull(), "scheme")
        .when(F.contains(where, F.lit("@")), "credentials")
        .when(h == "", "host")
        .when(h.isin(PRIVATE_NAMES) | suffix, "private name")
        .when(v4 & private, "private address")
        .when((h.rlike(r"^\[") & ~h.rlike(r"^\[[23][0-9a-f]{3}:") | h.rlike(r"^\[2001:0?db8:")) | h.rlike(r"^[0-9]+$|^0x"), "literal address")
    )


def bound(value: Column, of) -> Column:
    """``of(value)``, with the value worked out once however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _stepped(full: Column) -> Column:
    """A path with its steps of ``.`` and ``..`` taken."""
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    parts = F.split(F.regexp_replace(full, "^/", ""), "/")
    tail = F.when(full.rlike(r"/\.{1,2}$"), "/").otherwise("")
    walked = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    taken = bound(walked, lambda w: F.concat(F.lit("/"), w, F.when(w == "", "").otherwise(tail)))
    return F.when(full.rlike(r"(^|/)\.{1,2}(/|$)"), taken).otherwise(full)


def joined(base: Column, reference: Column) -> Column:
    """A reference as it stands on the page ``base``, absolute: with the page's scheme, host, path or query where it has none of its own, steps of ``.`` and
    ``..`` taken. Null if either is null."""

    def absolute(ref: Column) -> Column:
        origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        path, query = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
        folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
        own, rest = F.regexp_extract(ref, "^([^?#]*)", 1), F.regexp_extract(ref, "^[^?#]*(.*)$", 1)
        full = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))
        return (
            F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
            .when(F.startswith(ref, F.lit("//")), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), ref))
            .when(ref == "", base)
            .when(own == "", F.concat(origin, path, F.when(F.startswith(rest, F.lit("?")), rest).otherwise(F.concat(query, rest))))
            .otherwise(F.concat(origin, bound(full, _stepped), rest))
        )

    return bound(F.trim(reference), absolute)
