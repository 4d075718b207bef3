"""Scalar helpers: URLs, versions, levels, identities, options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remote_host(url: Column) -> Column:
    """Lower-cased host of an http(s), ssh, git or scp-like remote without user and port; empty for others."""
    scheme = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    scp = F.regexp_extract(url, r"^(?:[^/@:]+@)?([^/:]+):(?!//)", 1)
    return F.lower(F.when(scheme != "", scheme).otherwise(scp))


def remote_path(url: Column) -> Column:
    """Path of a remote without slashes around it, query and .git ending."""
    scheme = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
    scp = F.regexp_extract(url, r"^(?:[^/@:]+@)?[^/:]+:(?!//)(.*)$", 1)
    path = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), scheme).otherwise(scp)
    return F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), r"\.git$", "")


def remote_identity(url: Column) -> Column:
    """host[:port]/path of a hosted remote, ports of the scheme's default left out; other texts trimmed."""
    url = F.trim(url)
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    usual = F.when(scheme == "http", "80").when(scheme == "https", "443").when(scheme.isin("ssh", "git+ssh", "ssh+git"), "22").when(scheme == "git", "9418").otherwise("")
    host = F.concat(remote_host(url), F.when((port != "") & (port != usual), F.concat(F.lit(":"), port)).otherwise(""))
    return F.when((remote_host(url) != "") & (remote_path(url) != ""), F.concat(host, F.lit("/"), remote_path(url))).otherwise(url)


def _unsafe(part: Column, slash: bool) -> Column:
    bad = (part == "") | part.rlike(r"^\s|\s$|^/|\\") | F.exists(F.split(part, "/"), lambda p: p.isin("", ".", ".."))
    return F.coalesce(bad if slash else bad | part.contains("/"), F.lit(True))


def clone_path(base: str, host: Column, owner: Column, name: Column) -> Column:
    """base/host/owner/name.git, or null where a part could leave its place; only an owner may hold slashes."""
    safe = ~_unsafe(host, False) & ~_unsafe(owner, True) & ~_unsafe(name, False)
    return F.when(safe, F.concat(F.lit(base.rstrip("/") + "/"), host, F.lit("/"), owner, F.lit("/"), name, F.lit(".git")))


def module_url(line: Column) -> Column:
    """The value of a line `url = value` of a module file, without quotes around it; null for comments and other lines."""
    line = F.trim(line)
    value = F.trim(F.regexp_extract(line, r"(?i)^url\s*=(.*)$", 1))
    quoted = value.rlike(r'^"[^"\\]*"$')
    return F.when(line.rlike(r"(?i)^url\s*="), F.when(quoted, F.regexp_replace(value, '^"|"$', "")).otherwise(value))


def is_local_url(url: Column) -> Column:
    """Whether a URL names the local file system: file:, absolute and relative paths, drives, network shares."""
    return url.rlike(r"^(?:(?i:file:)|/|\./|\.\./|[A-Za-z]:|\\\\)")


def default_branch(head: Column, remote_refs: Column, local_refs: Column) -> Column:
    """The remote's head if it is a remote or else a local branch, then local main or master, else null."""
    has = lambda refs, name: F.coalesce(F.array_contains(refs, name), F.lit(False))
    named = F.coalesce(head, F.lit("")) != ""
    return (
        F.when(named & has(remote_refs, head), F.concat(F.lit("origin/"), head)).when(named & has(local_refs, head), head)
        .when(has(local_refs, F.lit("main")), "main").when(has(local_refs, F.lit("master")), "master")
    )


def short_sha(sha: Column) -> Column:
    return F.left(sha, F.lit(7))


def looks_like_sha(sha: Column) -> Column:
    return sha.rlike("^[0-9a-fA-F]{7,40}$")


def version_key(v: Column) -> Column:
    """An array that orders versions: release numbers, then a prerelease before its release.

    v is stripped of a leading v and build metadata, a git-describe ending is dropped, rc1 is rc.1.
    """
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "^v", ""), r"\+.*$", ""), r"-[0-9]+-g[0-9a-f]+$", "")
    release = F.regexp_extract(core, r"^([0-9.]+)", 1)
    pre = F.regexp_replace(F.regexp_extract(core, r"^[0-9.]+-(.+)$", 1), "([a-z])([0-9])", "$1.$2")
    numbers = F.transform(F.slice(F.concat(F.split(release, r"\."), F.array(F.lit("0"), F.lit("0"))), 1, 3), lambda x: F.lpad(x, 12, "0"))
    ids = F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(x, 12, "0"))).otherwise(F.concat(F.lit("1"), x)))
    return F.concat(numbers, F.when(pre == "", F.array(F.lit("~"))).otherwise(ids))


def parse_level(name: Column) -> Column:
    """debug, info, warn or error of a trimmed name in any case; info otherwise."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(n.isin("debug", "error"), n).when(n.isin("warn", "warning"), "warn").otherwise("info")


def parse_format(name: Column) -> Column:
    """auto, json or text of a trimmed name in any case, auto for none; null for others."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(n == "", "auto").when(n.isin("auto", "json", "text"), n)


def normal_option(value: Column) -> Column:
    """none is empty, true and false are yes and no."""
    low = F.lower(value)
    return F.when(low == "none", "").when(low == "true", "yes").when(low == "false", "no").otherwise(value)


def identity_digest(*parts: Column) -> Column:
    """SHA-256 over the parts, each after its length in eight big-endian bytes."""
    pieces = []
    for p in parts:
        p = F.coalesce(p, F.lit("")).cast("binary")
        pieces += [F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), p]
    return F.sha2(F.concat(*pieces), 256)


def fingerprint(model: Column, dimensions: Column, params: Column) -> Column:
    """First 16 hex digits of SHA-256 over the compact JSON with keys sorted at every level; zero fields are left out."""

    def text(c: Column) -> Column:
        out = F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":|\}$', "")
        for plain, escaped in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
            out = F.replace(out, F.lit(plain), F.lit(escaped))
        return out

    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(text(e["key"]), F.lit(":"), text(e["value"])))
    fields = F.array_compact(F.array(
        F.when(dimensions != 0, F.concat(F.lit('"dimensions":'), dimensions.cast("string"))), F.when(model != "", F.concat(F.lit('"model":'), text(model))),
        F.when(F.size(params) > 0, F.concat(F.lit('"params":{'), F.array_join(pairs, ","), F.lit("}"))),
    ))
    return F.substring(F.sha2(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")), 256), 1, 16)
