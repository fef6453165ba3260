"""Small files beside tables, in any file system that a path's scheme names."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it); a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def exists(path: str) -> bool:
    where, at = place(path)
    return where.get_file_info(at).type != fs.FileType.NotFound


def names(path: str) -> list[str]:
    """The names in a folder, ascending; none if it is missing."""
    where, at = place(path)
    return sorted(info.base_name for info in where.get_file_info(fs.FileSelector(at, allow_not_found=True)))


def read(path: str) -> str:
    where, at = place(path)
    with where.open_input_stream(at) as file:
        return file.read().decode()


def write(path: str, text: str) -> None:
    """Written as a draft and moved in one step: readers see the whole file or none."""
    where, at = place(path)
    where.create_dir(at.rsplit("/", 1)[0], recursive=True)
    draft = f"{at.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as file:
        file.write(text.encode())
    where.move(draft, at)


def remove(path: str) -> None:
    where, at = place(path)
    kind = where.get_file_info(at).type
    if kind == fs.FileType.Directory:
        where.delete_dir(at)
    elif kind == fs.FileType.File:
        where.delete_file(at)
