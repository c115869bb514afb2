"""Single files that the driver writes: private, plain, and never through a link."""

from __future__ import annotations

import fcntl
import os
import stat
from collections.abc import Iterable
from typing import IO

from pyspark.sql import DataFrame

from tracelake.sources.export import CSV_COLUMNS, csv_rows

#: Columns of expired flows; files of before the application columns have the first LEGACY.
EXPIRED_COLUMNS = ("ts", "reason", *CSV_COLUMNS)
LEGACY = 25


def open_private(path: str, append: bool = False) -> IO[bytes]:
    """A file that only its owner may read. A symbolic or further hard link, a file of another owner and what
    is no regular file raise an error before anything is changed."""
    flags = os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW | os.O_CLOEXEC | os.O_NONBLOCK | (os.O_APPEND if append else 0)
    handle = os.open(path, flags, 0o600)
    try:
        found = os.fstat(handle)
        if not stat.S_ISREG(found.st_mode):
            raise OSError(f"{path} is no regular file")
        if found.st_nlink != 1:
            raise OSError(f"{path} has another hard link")
        if found.st_uid != os.geteuid():
            raise OSError(f"{path} belongs to another user")
        os.fchmod(handle, 0o600)
        if not append:
            os.ftruncate(handle, 0)
        return os.fdopen(handle, "r+b" if not append else "a+b")
    except BaseException:
        os.close(handle)
        raise


def distinct_targets(paths: Iterable[str]) -> None:
    """Raises an error where two paths are the same file, however they are written."""
    seen: dict = {}
    for path in paths:
        real = os.path.realpath(path)
        mark = (os.stat(real).st_dev, os.stat(real).st_ino) if os.path.exists(real) else real
        if mark in seen:
            raise ValueError(f"{path} and {seen[mark]} are the same file")
        seen[mark] = path


def append_expired_csv(expired: DataFrame, path: str) -> int:
    """Appends expired flows to one CSV file and returns their number. An empty file gets a header; one with
    another header is an error and stays as it is. Rows come to the driver a partition at a time."""
    with open_private(path, append=True) as out:
        fcntl.flock(out, fcntl.LOCK_EX)
        out.seek(0)
        first = out.readline(1024)
        columns = EXPIRED_COLUMNS
        if not first:
            out.write(",".join(columns).encode() + b"\n")
        else:
            if not first.endswith(b"\n"):
                raise ValueError("the header of an expired-flow CSV must end with a newline")
            told = first.removesuffix(b"\n").removesuffix(b"\r").removeprefix(b"\xef\xbb\xbf").decode(errors="replace").split(",")
            if told == list(EXPIRED_COLUMNS[:LEGACY]):
                columns = EXPIRED_COLUMNS[:LEGACY]
            elif told != list(EXPIRED_COLUMNS):
                raise ValueError(f"{path} has another header than expired flows")
        rows = 0
        for row in csv_rows(expired).select(*columns).toLocalIterator():
            out.write(",".join("" if v is None else str(v) for v in row).encode() + b"\n")
            rows += 1
        return rows
