"""Signed requests of the AWS kind, version 4 (SCL-30)."""

from __future__ import annotations

import hashlib
import hmac
from datetime import datetime, timezone
from urllib.parse import parse_qsl, quote, urlsplit

ALGORITHM = "AWS4-HMAC-SHA256"


def encoded(s: str, slash: bool = False) -> str:
    """Percent-encoded, all but letters, digits and -._~."""
    return quote(s, safe="-._~/" if slash else "-._~")


def canonical_query(query: str) -> str:
    return "&".join(f"{k}={v}" for k, v in sorted((encoded(k), encoded(v)) for k, v in parse_qsl(query, keep_blank_values=True)))


def signing_key(secret: str, day: str, region: str, service: str) -> bytes:
    key = ("AWS4" + secret).encode()
    for part in (day, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def signed(method: str, url: str, id: str, secret: str, region: str, service: str, headers: dict[str, str] | None = None, body: bytes = b"", token: str | None = None, now: datetime | None = None) -> dict[str, str]:
    """Headers of the request, with its time and signature."""
    parts, stamp = urlsplit(url), (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
    all_ = {**(headers or {}), "host": parts.netloc, "x-amz-date": stamp} | ({"x-amz-security-token": token} if token else {})
    low = sorted((k.lower(), " ".join(v.split())) for k, v in all_.items())
    names = ";".join(k for k, _ in low)
    request = "\n".join([method, encoded(parts.path or "/", True), canonical_query(parts.query), *(f"{k}:{v}" for k, v in low), "", names, hashlib.sha256(body).hexdigest()])
    scope = f"{stamp[:8]}/{region}/{service}/aws4_request"
    what = "\n".join([ALGORITHM, stamp, scope, hashlib.sha256(request.encode()).hexdigest()])
    signature = hmac.new(signing_key(secret, stamp[:8], region, service), what.encode(), hashlib.sha256).hexdigest()
    return {**all_, "authorization": f"{ALGORITHM} Credential={id}/{scope}, SignedHeaders={names}, Signature={signature}"}
