"""Files opened by Python tasks, wherever their URI points."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, urlencode, urlsplit, urlunsplit

from pyarrow import fs

# Scheme in Spark -> scheme here.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}


def locate(path: str, options: dict[str, str] | None = None) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI as Spark spells it.

    ``options`` (such as ``region`` or ``endpoint_override`` for object stores) go to the
    file system. Schemes that only Spark's own readers know are refused by name.
    """
    if path.startswith("file:") or "://" not in path:
        if ":/" in path and not path.startswith(("file:", "/")):
            raise ValueError(f"no reader for the scheme of {path!r}")
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    parts = urlsplit(quote(path, safe=":/@?=&%"))
    scheme = _SCHEMES.get(parts.scheme)
    if scheme is None:
        raise ValueError(f"no reader for the scheme of {path!r}; known: file, {', '.join(_SCHEMES)}")
    query = urlencode([*parse_qsl(parts.query), *(options or {}).items()])
    return fs.FileSystem.from_uri(urlunsplit((scheme, parts.netloc, parts.path, query, "")))


def open_file(path: str, options: dict[str, str] | None = None):
    """Open a file for reading at any position."""
    system, inner = locate(path, options)
    return system.open_input_file(inner)
