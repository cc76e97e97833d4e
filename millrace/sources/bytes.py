"""Files by URI, opened on the driver or in tasks, without Spark's readers."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyarrow import fs


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; a path without a scheme is a local one.

    Spark lists files with full URIs, in which nothing is escaped.
    """
    scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", uri)
    if scheme is None:
        return fs.LocalFileSystem(), uri
    if scheme[1] == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(quote(uri, safe="/:@?=&%+"))
