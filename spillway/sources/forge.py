"""Listings of repositories and snippets from code hosts (SRC-11, SRC-12).

The caller hands over a `fetch` function (URL to JSON), so tests and offline runs need no
network; pages are asked for one after another, as each host links them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

PAGES = 200
Fetch = Callable[[str], object]


def _github(name: str, fetch: Fetch) -> Iterator[str]:
    for kind in ("orgs", "users"):
        some = False
        for page in range(1, PAGES + 1):
            try:
                rows = fetch(f"https://api.github.com/{kind}/{quote(name)}/repos?per_page=100&page={page}")
            except LookupError:
                break
            if not rows:
                break
            some = True
            yield from (r["clone_url"] for r in rows)
        if some:
            return


def _gitlab(name: str, fetch: Fetch) -> Iterator[str]:
    for kind in ("groups", "users"):
        some = False
        for page in range(1, PAGES + 1):
            try:
                rows = fetch(f"https://gitlab.com/api/v4/{kind}/{quote(name, safe='')}/projects?include_subgroups=true&per_page=100&page={page}")
            except LookupError:
                break
            if not rows:
                break
            some = True
            yield from (r["http_url_to_repo"] for r in rows)
        if some:
            return


def _bitbucket(name: str, fetch: Fetch) -> Iterator[str]:
    url: str | None = f"https://api.bitbucket.org/2.0/repositories/{quote(name)}?pagelen=100"
    for _ in range(PAGES):
        if not url:
            return
        body = fetch(url)
        for r in body.get("values", []):
            yield from (x["href"] for x in r["links"]["clone"] if x["name"] == "https")
        url = body.get("next")


_HOSTS = {"github": _github, "gitlab": _gitlab, "bitbucket": _bitbucket}


def repositories(spark: SparkSession, target: str, fetch: Fetch) -> DataFrame:
    """Clone URLs of host:name."""
    host, _, name = target.partition(":")
    if host not in _HOSTS or not name:
        raise ValueError(f"not host:name of a known host: {target!r}")
    return spark.createDataFrame([(u,) for u in dict.fromkeys(_HOSTS[host](name, fetch))], "url string")


def snippets(spark: SparkSession, user: str, fetch: Fetch) -> DataFrame:
    """Clone URLs of a user's snippets."""
    out = []
    for page in range(1, PAGES + 1):
        rows = fetch(f"https://api.github.com/users/{quote(user)}/gists?per_page=100&page={page}")
        if not rows:
            break
        out += [r["git_pull_url"] for r in rows]
    return spark.createDataFrame([(u,) for u in dict.fromkeys(out)], "url string")
