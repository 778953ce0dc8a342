"""Files that the driver and all executors reach, by their URI or path, outside of Spark's own readers and writers."""

from __future__ import annotations

import posixpath

from pyarrow import fs


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or the local one for a plain path, and the path within it."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def below(root: str, path: str) -> str:
    """``path`` below ``root``; one that would leave it raises."""
    clean = posixpath.normpath(path)
    if not path or path.startswith("/") or clean in (".", "..") or clean.startswith("../") or "\0" in path:
        raise ValueError(f"not a path below the folder: {path!r}")
    return posixpath.join(root, clean)


def names(files: fs.FileSystem, path: str, kind: fs.FileType) -> list[str]:
    """The names of the files or folders in a folder, in order; none if it isn't there."""
    return sorted(x.base_name for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.type == kind)
