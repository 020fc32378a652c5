"""Repository URLs, session ids, lock keys, point ids and cleaned names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = "github.com"
BASE = f"https://{HOST}/"


def _path(url: Column) -> Column:
    """Path of a URL: after scheme and host where there is ``://``, else the text itself; no query or fragment."""
    bare = F.regexp_replace(url, "[?#].*$", "")
    return F.when(bare.contains("://"), F.regexp_extract(bare, "://[^/]*(.*)$", 1)).otherwise(bare)


def normalize_repo_url(url: Column) -> Column:
    """``https://github.com/owner/repo`` in lower case. Without a scheme the host counts as a path segment."""
    u = F.lower(F.trim(url))
    ssh = F.regexp_extract(u, "^git@github\\.com:(.+?)(?:\\.git)?$", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(_path(u), "^/+", ""), "/+$", ""), "\\.git$", "")
    parts = F.split(path, "/")
    short = F.when(F.size(parts) >= 2, F.concat_ws("/", parts[0], F.get(parts, F.lit(1)))).otherwise(path)
    return F.concat(F.lit(BASE), F.when(ssh != "", ssh).otherwise(short))


def parse_repo_url(url: Column) -> Column:
    """struct(owner, repo) with case kept, or null: SSH, ``owner/repo``, and web forms of the one host."""
    u = F.trim(url)
    ssh = F.regexp_extract(u, "(?i)^git@github\\.com:([^/]+)/([^/]+?)(?:\\.git)?/?$", 1)
    ssh_repo = F.regexp_extract(u, "(?i)^git@github\\.com:([^/]+)/([^/]+?)(?:\\.git)?/?$", 2)
    short = ~u.contains("://") & (F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit(""))) == 1) & ~F.lower(u).startswith(HOST + "/")
    full = F.when(~u.contains("://") & F.lower(u).startswith(HOST + "/"), F.concat(F.lit("https://"), u)).otherwise(u)
    host = F.regexp_replace(F.lower(F.regexp_extract(full, "://([^/?#]*)", 1)), "^www\\.", "")
    parts = F.filter(F.split(_path(full), "/"), lambda p: p != "")
    cut = lambda r: F.regexp_replace(F.trim(r), "\\.git$", "")
    pair = lambda o, r: F.when((F.trim(o) != "") & (cut(r) != ""), F.struct(F.trim(o).alias("owner"), cut(r).alias("repo")))
    halves = F.split(u, "/")
    return (
        F.when(ssh != "", F.struct(F.trim(ssh).alias("owner"), F.trim(ssh_repo).alias("repo")))
        .when(short, pair(halves[0], F.get(halves, F.lit(1))))
        .when((host == HOST) & (F.size(parts) >= 2), pair(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    )


def _alnum(text: Column, most: int) -> Column:
    return F.substring(F.regexp_replace(text, "[^a-zA-Z0-9]", ""), 1, most)


def repo_info(url: Column) -> tuple[Column, Column]:
    """(owner, repo) of the normalized URL; empty where it has fewer than two segments."""
    parts = F.split(F.regexp_replace(normalize_repo_url(url), f"^{BASE}", ""), "/")
    two = F.size(parts) >= 2
    return F.when(two, parts[0]).otherwise(""), F.when(two, F.get(parts, F.lit(1))).otherwise("")


def session_id(url: Column) -> Column:
    owner, repo = repo_info(url)
    return F.concat(F.lit("repo_"), F.substring(F.sha2(normalize_repo_url(url), 256), 1, 8), F.lit("_"), _alnum(owner, 10), F.lit("_"), _alnum(repo, 15))


def lock_key(url: Column) -> Column:
    """The same key for all forms of a repository's URL."""
    u = F.trim(F.coalesce(url, F.lit("")))
    got = parse_repo_url(u)
    owner, repo = repo_info(normalize_repo_url(u))
    known = got.isNotNull()
    own = F.when(known, F.lower(got["owner"])).when(u != "", owner).otherwise("")
    rep = F.when(known, F.lower(got["repo"])).when(u != "", repo).otherwise("")
    source = F.when(known, F.concat(F.lit(BASE), F.lower(got["owner"]), F.lit("/"), F.lower(got["repo"]))).when(u != "", normalize_repo_url(u)).otherwise("unknown_repo")
    named = lambda c, n: F.when(_alnum(c, n) == "", "unknown").otherwise(_alnum(c, n))
    return F.concat(F.lit("repo_lock_"), F.substring(F.sha2(source, 256), 1, 10), F.lit("_"), named(own, 20), F.lit("_"), named(rep, 30))


def point_id(doc_id: Column) -> Column:
    """The first 8 bytes of SHA-256, as a big-endian number without its top bit."""
    digest = F.sha2(doc_id, 256)
    top = F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") % 8
    return F.conv(F.concat(F.hex(top.cast("long")), F.substring(digest, 2, 15)), 16, 10).cast("long")


def eval_key(query: Column, session: Column) -> Column:
    return F.concat(session, F.lit(":"), F.substring(F.md5(query), 1, 8))


def clean_session(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_-]", "")


def clean_collection(text: Column) -> Column:
    cut = F.substring(F.regexp_replace(text, "[^a-zA-Z0-9_-]", "_"), 1, 63)
    return F.when(cut == "", "default").otherwise(cut)


def clean_segment(text: Column) -> Column:
    """Letters and digits of any script, ``_``, ``.`` and ``-`` stay."""
    return F.regexp_replace(text, "[^\\p{L}\\p{N}_.-]", "_")
