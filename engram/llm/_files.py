"""Binary files in the shared folder, written and read by Python tasks through Arrow's file systems."""

from __future__ import annotations

import os

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        path = "file://" + os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


class Replaced:
    """A file that appears under its name only when it is whole.

    A task that is run again, or twice at once, writes the same bytes under a name of its own and moves them
    over the same final name.
    """

    def __init__(self, path: str):
        from pyspark import TaskContext

        self.system, self.path = opened(path)
        task = TaskContext.get()
        self.draft = f"{self.path}.{task.taskAttemptId() if task else os.getpid()}.tmp"
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.system.open_output_stream(self.draft)
        self.size = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.draft, self.path)
