"""Files as tasks open them: parts of a file by offset, on any file system that Arrow reads."""

from __future__ import annotations

from urllib.parse import quote

from pyarrow import fs


def opened(uri: str):
    """``(file system, path)`` of an address as Spark's metadata column gives it; one without a scheme is a local path, and ``file:/x`` is ``file:///x``."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    # Spark escapes blanks and percent signs, but not letters beyond ASCII.
    return fs.FileSystem.from_uri(quote(uri, safe=":/%?#[]@!$&'()*+,;=~")) if "://" in uri else (fs.LocalFileSystem(), uri)
