"""The edge of the cluster: package listings, downloads to a landing folder, year specifications. Runs on the driver; Spark
reads what has landed."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from http.client import HTTPException
from pathlib import Path
from typing import BinaryIO
from urllib.parse import urlencode
from urllib.request import urlopen


def _default_get(url: str) -> bytes:
    with urlopen(url, timeout=60) as reply:
        return reply.read()


def _default_open(url: str) -> BinaryIO:
    return urlopen(url, timeout=60)


#: Bytes of a download that are in memory at once.
PIECE_BYTES = 1 << 20


class OpenDataPortal:
    """A portal with CKAN's action API. ``get`` fetches a URL whole, ``open`` as a stream; tests put in their own."""

    def __init__(self, base_url: str, get: Callable[[str], bytes] = _default_get, tries: int = 5, wait: Callable[[float], None] = time.sleep, open: Callable[[str], BinaryIO] = _default_open):
        self.base_url, self.get, self.tries, self.wait, self.open = base_url.rstrip("/"), get, tries, wait, open

    def _call(self, action: str, **parameters) -> dict:
        url = f"{self.base_url}/api/3/action/{action}?{urlencode(parameters)}"
        for attempt in range(1, self.tries + 1):
            try:
                reply = json.loads(self.get(url))
                if reply.get("success"):
                    return reply["result"]
                raise ValueError(f"{action} was refused: {reply.get('error')}")
            except (OSError, ValueError):
                if attempt == self.tries:
                    raise
                self.wait(2.0 ** (attempt - 1))
        raise AssertionError("unreachable")

    def package(self, package_id: str) -> dict:
        """Metadata of a package and its resources."""
        return self._call("package_show", id=package_id)

    def resource(self, resource_id: str) -> dict:
        """Metadata of one resource, its address included."""
        return self._call("resource_show", id=resource_id)

    def download(self, resource_id: str, target: Path) -> Path:
        """A resource in the landing folder, looked up by its id and read in pieces of PIECE_BYTES; tried again from the
        start when it breaks off. A partial file never has the final name."""
        url = self.resource(resource_id)["url"]
        target.parent.mkdir(parents=True, exist_ok=True)
        partial = target.with_suffix(target.suffix + ".part")
        for attempt in range(1, self.tries + 1):
            try:
                with self.open(url) as source, partial.open("wb") as file:
                    announced = getattr(source, "headers", {}).get("Content-Length")
                    while piece := source.read(PIECE_BYTES):
                        file.write(piece)
                    if announced and file.tell() != int(announced):
                        raise OSError(f"{url} broke off after {file.tell()} of {announced} bytes")
                break
            except (OSError, HTTPException):
                if attempt == self.tries:
                    raise
                self.wait(2.0 ** (attempt - 1))
        partial.rename(target)
        return target

    def total(self, resource_id: str) -> int:
        """Number of rows that the data store reports for a resource: where ``files.PagedSource.read`` stops."""
        return int(self._call("datastore_search", id=resource_id, limit=0)["total"])

    def rows(self, resource_id: str):
        """``fetch`` for ``files.PagedSource``: pages of a data store, with a filter in SQL if there is one."""
        call = self._call

        def fetch(offset: int, limit: int, where: str | None) -> list[dict]:
            if where:
                sql = f'SELECT * FROM "{resource_id}" WHERE {where} ORDER BY _id LIMIT {limit} OFFSET {offset}'
                return call("datastore_search_sql", sql=sql)["records"]
            return call("datastore_search", id=resource_id, limit=limit, offset=offset)["records"]

        return fetch
