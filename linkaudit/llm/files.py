"""Files that tasks write to and read from the shared folder.

A task writes under a name of its own and returns the name in its rows. The rows are stored by Spark, which keeps those of one
successful attempt per task, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder: a plain path, or a URI that pyarrow knows (file, hdfs, s3, gs, abfss)."""
    plain = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(uri)


def new_file(uri: str, stem: str, ending: str) -> tuple[str, object]:
    """Create a file of a new name in a folder; returns its name and an output stream."""
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{ending}"
    return name, system.open_output_stream(f"{path}/{name}", compression=None)


def open_file(uri: str, name: str):
    """A file of the folder for reading at any place."""
    system, path = open_folder(uri)
    return system.open_input_file(f"{path}/{name}")
