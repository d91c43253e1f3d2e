"""Files read and written by Python workers, on any store that Arrow has a file system for (local and mounted folders, object stores, HDFS)."""

from __future__ import annotations

import re

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; ``file:/x``, ``file:///x`` and ``/x`` are the same."""
    path = re.sub("^file:/+", "/", path)
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    try:
        return fs.FileSystem.from_uri(path)
    except (OSError, ValueError) as e:
        raise ValueError(f"no file system for {path!r} in Python workers: {e}") from e


def opened(path: str):
    """A seekable file of any of these stores; reading at an offset fetches what is asked for."""
    store, at = located(path)
    return store.open_input_file(at)


def listed(folder: str, suffix: str) -> list[str]:
    """Paths of the files of a folder that end so, in order of their names; a file is itself. FileNotFoundError where there are none."""
    store, at = located(folder)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [folder]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._")
    if not names:
        raise FileNotFoundError(f"no {suffix} file in {folder}")
    return [f"{folder.rstrip('/')}/{n}" for n in names]


def put(path: str, write) -> None:
    """``write(file)`` to a file that appears under its name only when it is whole."""
    store, at = located(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at.rsplit('/', 1)[0]}/.{at.rsplit('/', 1)[1]}.part"
    with store.open_output_stream(part) as f:
        write(f)
    store.move(part, at)


def removed(paths: list[str]) -> None:
    for p in paths:
        store, at = located(p)
        if store.get_file_info(at).type == fs.FileType.File:
            store.delete_file(at)
