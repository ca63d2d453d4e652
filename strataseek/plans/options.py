"""Options of a search and its sort order."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class SortField(Enum):
    NAME = "name"
    PATH = "path"
    SIZE = "size"
    EXTENSION = "extension"
    DATE_CREATED = "date-created"
    DATE_MODIFIED = "date-modified"
    DATE_ACCESSED = "date-accessed"
    ATTRIBUTES = "attributes"
    FILE_LIST_FILE_NAME = "file-list-file-name"
    RUN_COUNT = "run-count"
    DATE_RECENTLY_CHANGED = "date-recently-changed"
    DATE_RUN = "date-run"


#: Other names of sort fields. Fixed values.
SORT_ALIASES = {
    "ext": SortField.EXTENSION,
    "dc": SortField.DATE_CREATED,
    "dm": SortField.DATE_MODIFIED,
    "da": SortField.DATE_ACCESSED,
    "attribs": SortField.ATTRIBUTES,
    "attrib": SortField.ATTRIBUTES,
    "rc": SortField.DATE_RECENTLY_CHANGED,
}

#: Letters of the short sort switch. Fixed values.
SORT_LETTERS = {"N": SortField.NAME, "S": SortField.SIZE, "E": SortField.EXTENSION, "D": SortField.DATE_MODIFIED}


@dataclass(frozen=True)
class SortSpec:
    field: SortField = SortField.NAME
    descending: bool = False


@dataclass(frozen=True)
class SearchOptions:
    regex: bool = False
    match_case: bool = False
    match_whole_word: bool = False
    match_path: bool = False
    match_diacritics: bool = False
    max_results: int = 1000
    offset: int = 0
    files_only: bool = False
    folders_only: bool = False
    sort: SortSpec = field(default_factory=SortSpec)


def parse_sort_name(text: str) -> SortSpec | None:
    """``size-descending`` and the like; None for a name that isn't a field's."""
    name, descending = text.lower(), False
    for suffix in ("-ascending", "-descending"):
        if name.endswith(suffix):
            name, descending = name.removesuffix(suffix), suffix == "-descending"
            break
    known = {f.value: f for f in SortField} | SORT_ALIASES
    return SortSpec(known[name], descending) if name in known else None


def parse_dir_sort(text: str) -> SortSpec | None:
    """A letter, descending after a minus: ``-S``."""
    letter = text.removeprefix("-").upper()
    return SortSpec(SORT_LETTERS[letter], text.startswith("-")) if letter in SORT_LETTERS else None
