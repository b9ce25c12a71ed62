"""Binary files in the shared folder, written and read inside tasks.

Files go below the session's checkpoint folder through Arrow's file systems
(local mounts, HDFS, object stores). A task names its files with a fresh id,
so a retry never touches what another attempt wrote; only files listed in the
manifest of the attempts that Spark accepted are read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def fresh(folder: str, suffix: str) -> str:
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def make_folder(folder: str) -> None:
    files, path = opened(folder)
    files.create_dir(path, recursive=True)


class Reader:
    """Random reads from one file at a time; the last one stays open."""

    def __init__(self):
        self.uri, self.file = None, None

    def of(self, uri: str):
        if uri != self.uri:
            self.close()
            files, path = opened(uri)
            self.file, self.uri = files.open_input_file(path), uri
        return self.file

    def close(self):
        if self.file is not None:
            self.file.close()
            self.file, self.uri = None, None
