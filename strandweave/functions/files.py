"""Names, command lines and words of files, and a report of time and memory."""

from __future__ import annotations

import resource
import sys
import time
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F


def tagged(name: str, tag: str) -> str:
    """A file name with its last ending, .gz apart, replaced by tag."""
    folder, slash, last = name.rpartition("/")
    base = last.removesuffix(".gz")
    return f"{folder}{slash}{base.rpartition('.')[0] or base}.{tag}"


def command_line(arguments: list[str] | None = None) -> str:
    """The program and its arguments, as a manifest or a header keeps them."""
    return " ".join(sys.argv if arguments is None else arguments)


def words(line: Column) -> Column:
    """The runs of visible ASCII characters of a line."""
    return F.filter(F.split(line, r"[^\x21-\x7e]+"), lambda w: w != "")


@contextmanager
def timed(say=print, what: str = ""):
    """Say how long what is inside took, the driver's CPU seconds and its largest size."""
    began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF)
    yield
    after = resource.getrusage(resource.RUSAGE_SELF)
    say(f"{what}{': ' if what else ''}elapsed {time.perf_counter() - began:.3f} s, user {after.ru_utime - before.ru_utime:.3f} s, system {after.ru_stime - before.ru_stime:.3f} s, largest size {after.ru_maxrss // 1024} MB")
