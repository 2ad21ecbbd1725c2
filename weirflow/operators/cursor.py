"""Signed page tokens: values in JSON, with an HMAC over them and over the fingerprint of the query they belong to."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from datetime import datetime

from .flows import QueryError


def fingerprint(query: object) -> str:
    """Of a query's repr without its cursor: tokens of one query don't fit another."""
    return hashlib.sha256(repr(query).encode()).hexdigest()[:32]


def encode(values: tuple, secret: bytes, query: str = "") -> str:
    plain = [["t", v.isoformat()] if isinstance(v, datetime) else ["b", bytes(v).hex()] if isinstance(v, bytes | bytearray) else ["v", v] for v in values]
    body = json.dumps(plain, separators=(",", ":")).encode()
    return ".".join(base64.urlsafe_b64encode(x).rstrip(b"=").decode() for x in (body, _sign(body, secret, query)))


def decode(token: str, secret: bytes, query: str = "") -> tuple:
    try:
        body, sign = (base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in token.split("."))
        if not hmac.compare_digest(sign, _sign(body, secret, query)):
            raise ValueError("signature")
        read = {"t": datetime.fromisoformat, "b": lambda v: bytearray.fromhex(v), "v": lambda v: v}
        return tuple(read[kind](v) for kind, v in json.loads(body))
    except (ValueError, KeyError, TypeError) as e:
        raise QueryError("invalid_cursor", "the cursor is malformed or of another query") from e


def _sign(body: bytes, secret: bytes, query: str) -> bytes:
    return hmac.new(secret, body + b"|" + query.encode(), hashlib.sha256).digest()
