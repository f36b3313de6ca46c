"""Small files at a URI: manifests and the like."""

from __future__ import annotations

import json
import os
import uuid

from pyarrow import fs


class Files:
    """A folder on any file system that pyarrow reaches."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self.system, self.base = fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")

    def __truediv__(self, name: str) -> Files:
        return Files(f"{self.uri}/{name}")

    def path(self, name: str = "") -> str:
        return f"{self.base}/{name}" if name else self.base

    def exists(self, name: str = "") -> bool:
        return self.system.get_file_info(self.path(name)).type != fs.FileType.NotFound

    def make(self) -> None:
        self.system.create_dir(self.base, recursive=True)

    def delete(self, name: str = "") -> None:
        self.system.delete_dir(self.path(name))

    def folders(self) -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)

    def read_json(self, name: str) -> dict:
        with self.system.open_input_stream(self.path(name)) as file:
            return json.loads(file.read())

    def names(self) -> list[str]:
        """Names of the files, without those of attempts."""
        found = self.system.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith("."))

    def delete_file(self, name: str) -> None:
        self.system.delete_file(self.path(name))

    def create_json(self, name: str, value: dict) -> bool:
        """Make a file in one step unless there is one of that name already; returns whether it was made.

        A local file system links the finished file, HDFS renames it: both refuse a name that exists.
        Stores that can't refuse would lose one of two writers' changes and aren't written to.
        """
        attempt = self.path(f".{name}.{uuid.uuid4().hex}")
        local = isinstance(self.system, fs.LocalFileSystem)
        if not local and not isinstance(self.system, fs.HadoopFileSystem):
            raise OSError(f"{self.uri}: keyed tables need a local file system or HDFS, which rename only to new names")
        with self.system.open_output_stream(attempt) as file:
            file.write(json.dumps(value, indent=1).encode())
        try:
            if local:
                os.link(attempt, self.path(name))
            else:
                self.system.move(attempt, self.path(name))
            return True
        except OSError:
            if self.exists(name):
                return False
            raise
        finally:
            if self.system.get_file_info(attempt).type != fs.FileType.NotFound:
                self.system.delete_file(attempt)
