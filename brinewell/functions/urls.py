"""Canonical form of external URLs."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query keys, besides those that start with utm_, that only track.
TRACKING_KEYS = frozenset(["fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref_src", "ref_url", "source"])
_DEFAULT_PORTS = {"http": 80, "https": 443}


def canonical(url: str | None) -> str | None:
    """Host, path and sorted query of a web address, equal for addresses of one resource; None if it is none.

    Scheme, fragment, user info, a leading ``www.``, the default port, trailing
    slashes and tracking keys go. An address with an invalid port has no form.
    """
    try:
        parts = urlsplit((url or "").strip())
        scheme, host, port = parts.scheme.lower(), (parts.hostname or "").lower(), parts.port
    except ValueError:
        return None
    if scheme not in _DEFAULT_PORTS or not host:
        return None
    host = host.removeprefix("www.") + ("" if port in (None, _DEFAULT_PORTS[scheme]) else f":{port}")
    path = parts.path.rstrip("/") or "/"
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in TRACKING_KEYS]
    query = urlencode(sorted(kept, key=lambda kv: (kv[0].lower(), kv[1])))
    return f"{host}{path}" + (f"?{query}" if query else "")


@F.pandas_udf(StringType())
def canonical_url(urls: pd.Series) -> pd.Series:
    return urls.map(canonical)
