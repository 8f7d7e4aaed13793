"""COVERAGE.md says what is true: every row has a query, and its functions run in them."""

from __future__ import annotations

import importlib
import inspect
import re
import sys
from pathlib import Path

import pytest

from tidelog.plans import catalog

ROWS = [
    (m[1], [f.strip() for f in re.sub(r"\(.*?\)", "", m[2]).split(",")], [q.strip().rstrip("*") for q in m[3].split(",")])
    for line in (Path(__file__).parent.parent / "COVERAGE.md").read_text().splitlines()
    if (m := re.match(r"^\| (\w+) \| .*? \| (.*?) \| (.*?) \|$", line)) and m[1] != "#"
]


def resolve(name):
    """The code places of the function or class that "package.module.name" under tidelog is; none
    for a pandas UDF, whose code runs in workers."""
    parts = name.split(" ")[0].split(".")
    found = getattr(importlib.import_module("tidelog." + ".".join(parts[:-1])), parts[-1])
    if hasattr(found, "func"):
        return None
    if inspect.isclass(found):
        return {(inspect.getsourcefile(found), f"{found.__name__}.{m}") for m in vars(found)}
    return {(inspect.getsourcefile(found), parts[-1])}


def test_every_row_has_a_query():
    assert len(ROWS) == 259
    for row, functions, queries in ROWS:
        assert functions and queries and all(q in catalog.QUERIES for q in queries), row
        assert all(row in catalog.INVENTORY[q].split() for q in queries), row


@pytest.fixture(scope="module")
def called(spark, sf):
    """By query, the places of this package's functions that run while it is built and read."""
    out = {}
    here = str(Path(catalog.__file__).parent.parent)
    for name in sorted({q for _, _, queries in ROWS for q in queries}):
        seen = set()

        def watch(frame, event, arg, seen=seen):
            if event == "call" and frame.f_code.co_filename.startswith(here):
                seen.add((frame.f_code.co_filename, frame.f_code.co_qualname))

        sys.setprofile(watch)
        try:
            catalog.QUERIES[name](spark, sf).schema  # noqa: B018
        finally:
            sys.setprofile(None)
        out[name] = seen
    return out


def test_functions_run_in_their_queries(called):
    wrong = []
    for row, functions, queries in ROWS:
        ran = set().union(*(called[q] for q in queries))
        for f in functions:
            places = resolve(f)
            if places is not None and not places & ran:
                wrong.append((row, f, queries))
    assert not wrong
