"""Files of the local or a shared file system, or of a store that a URI names.

Plain paths and file:// are local (or mounted); other URIs (hdfs://, s3://, gs:// and
so on) are opened by pyarrow's file systems, in the driver and in the tasks alike.
"""

from __future__ import annotations

import fnmatch

from pyarrow import fs as stores


def located(path: str) -> tuple[stores.FileSystem, str]:
    if "://" in path and not path.startswith("file://"):
        return stores.FileSystem.from_uri(path)
    return stores.LocalFileSystem(), path.removeprefix("file://")


def _named(path: str, inner: str, found: str) -> str:
    """The found inner path, spelt like path."""
    return path[: len(path) - len(inner)] + found if path.endswith(inner) else found


def listed(path: str) -> list[str]:
    """The files that a file, a folder or a pattern names; hidden ones are left out.  A name without a file stays."""
    store, inner = located(path)
    kind = store.get_file_info(inner).type
    if kind == stores.FileType.Directory:
        folder, pattern = inner, "*"
    elif kind == stores.FileType.NotFound and any(c in inner for c in "*?["):
        folder, _, pattern = inner.rpartition("/")
    else:
        return [path]
    infos = store.get_file_info(stores.FileSelector(folder or ".", allow_not_found=True))
    names = [i.path for i in infos if i.type == stores.FileType.File and fnmatch.fnmatchcase(i.base_name, pattern) and not i.base_name.startswith((".", "_"))]
    return sorted(_named(path, inner, n) for n in names) or [path]


def size(path: str) -> int:
    store, inner = located(path)
    info = store.get_file_info(inner)
    if info.type != stores.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def opened(path: str):
    """A file to read from, with read and seek."""
    store, inner = located(path)
    return store.open_input_file(inner)


def created(path: str):
    """A file to write to; its folder is made."""
    store, inner = located(path)
    if "/" in inner:
        store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner)


def exists(path: str) -> bool:
    store, inner = located(path)
    return store.get_file_info(inner).type != stores.FileType.NotFound


def is_folder(path: str) -> bool:
    store, inner = located(path)
    return store.get_file_info(inner).type == stores.FileType.Directory


def renamed(source: str, target: str) -> None:
    """Move a file to where nothing is yet; the folder is made."""
    store, inner = located(source)
    to = located(target)[1]
    store.create_dir(to.rpartition("/")[0], recursive=True)
    store.move(inner, to)


def moved(source: str, target: str) -> None:
    """Put source in the place of target."""
    store, inner = located(source)
    dropped(target)
    store.move(inner, located(target)[1])


def dropped(path: str) -> None:
    store, inner = located(path)
    kind = store.get_file_info(inner).type
    if kind == stores.FileType.Directory:
        store.delete_dir(inner)
    elif kind == stores.FileType.File:
        store.delete_file(inner)
