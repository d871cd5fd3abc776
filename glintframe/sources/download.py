"""Downloads of the ingest stage: retries with doubling pauses, one token refresh, atomic rename."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable

RETRIED = (429, 500, 502, 503, 504)


def fetch(url: str, target: str, headers: Callable[[], dict] = dict, refresh: Callable[[], None] | None = None, attempts: int = 5, backoff: float = 1.0, open_url=urllib.request.urlopen, pause=time.sleep) -> bool:
    """The content of `url` as file `target`; False where it is there already.

    Connection errors and RETRIED answers are tried again after backoff * 2^(n - 1) seconds; a 403
    refreshes the credentials once. The file appears under its name only when it is whole.
    """
    if os.path.exists(target):
        return False
    refreshed, n = False, 0
    while True:
        try:
            with open_url(urllib.request.Request(url, headers=headers())) as answer, open(f"{target}.part", "wb") as out:
                while block := answer.read(1 << 20):
                    out.write(block)
            os.replace(f"{target}.part", target)
            return True
        except urllib.error.HTTPError as error:
            if error.code == 403 and refresh is not None and not refreshed:
                refreshed = True
                refresh()
                continue
            if error.code not in RETRIED:
                raise
            failure = error
        except (urllib.error.URLError, ConnectionError) as error:
            failure = error
        n += 1
        if n >= attempts:
            raise failure
        pause(backoff * 2 ** (n - 1))
