"""Selections: ``source-id:YYYY``."""

from __future__ import annotations

import re

from cellfold.catalog.sources import SOURCES, Source

GRAMMAR = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*:(?:[0-9]{4}|latest)")


def looks_like_selection(value: object) -> bool:
    return isinstance(value, str) and GRAMMAR.fullmatch(value) is not None


def parse(selection: str) -> tuple[Source, int]:
    """The source and year of a selection; each way it can be wrong has its own error."""
    if not isinstance(selection, str):
        raise TypeError("selection must be a string such as 'worldpop-global-1km:2020'.")
    if selection.endswith(":latest"):
        raise ValueError(f"{selection!r} names no fixed year; give a year, so that results can be repeated.")
    if selection in SOURCES:
        raise ValueError(f"{selection!r} needs a year, such as '{selection}:{SOURCES[selection].years[-1]}'.")
    if not looks_like_selection(selection):
        raise ValueError(f"{selection!r} is not a selection of the form source-id:YYYY.")
    name, _, year = selection.partition(":")
    if name not in SOURCES:
        raise ValueError(f"unknown population source {name!r}; known are {', '.join(sorted(SOURCES))}.")
    source, year = SOURCES[name], int(year)
    if year not in source.years:
        ys = source.years
        shown = f"{ys[0]}-{ys[-1]}" if ys == tuple(range(ys[0], ys[-1] + 1)) else ", ".join(map(str, ys))
        raise ValueError(f"{name!r} has no year {year}; it has {shown}.")
    return source, year


def accepts(selection: str) -> bool:
    """Whether ``parse`` finds a source that has the year."""
    try:
        parse(selection)
    except ValueError:
        return False
    return True
