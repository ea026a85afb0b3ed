"""What the path of a catalogued file says about it, and titles made of that."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names with the document type and authority they stand for, and marks in file names for the type.
FOLDER_TYPES = {
    "question-paper": ("past_paper", 1),
    "mark-scheme": ("mark_scheme", 1),
    "examiner-report": ("examiner_report", 1),
    "specification": ("specification", 1),
    "textbooks": ("textbook", 2),
    "revision-guide": ("revision_guide", 3),
    "topic-notes": ("topic_notes", 3),
}
NAME_TYPES = {"que": "past_paper", "rms": "mark_scheme", "pef": "examiner_report"}
TYPE_LABELS = {"past_paper": "Question paper", "mark_scheme": "Mark scheme", "examiner_report": "Examiner report"}


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?<=.)\\.[^.]*$", ""))


def document_type(path: Column) -> Column:
    """The type the first telling folder of a relative path names, else the first mark in the file's name, else unknown."""
    folders = F.filter(F.split(F.lower(path), "/"), lambda x: x.isin(*FOLDER_TYPES))
    by_folder = F.element_at(_lookup({k: v for k, (v, _) in FOLDER_TYPES.items()}), F.get(folders, 0))
    by_name = F.coalesce(*[F.when(_stem(path).rlike(f"-{mark}(-|$)"), t) for mark, t in NAME_TYPES.items()])
    return F.coalesce(by_folder, by_name, F.lit("unknown"))


def source_priority(path: Column) -> Column:
    """1 for what an authority publishes, 2 for textbooks, 3 for the rest; null where the path doesn't tell the type."""
    folders = F.filter(F.split(F.lower(path), "/"), lambda x: x.isin(*FOLDER_TYPES))
    by_folder = F.element_at(_lookup({k: v for k, (_, v) in FOLDER_TYPES.items()}), F.get(folders, 0))
    return F.coalesce(by_folder, F.when(document_type(path) != "unknown", 1))


def session(path: Column) -> tuple[Column, Column]:
    """(year, series) of the first folder named like `2023 winter`; nulls without one."""
    named = F.get(F.filter(F.split(path, "/"), lambda x: x.rlike("^\\d{4}\\s+.+$")), 0)
    return F.regexp_extract(named, "^(\\d{4})\\s+(.+)$", 1).cast("int"), F.trim(F.regexp_extract(named, "^(\\d{4})\\s+(.+)$", 2))


def subject_folder(path: Column) -> Column:
    """The first folder of a path; null for a file at the root."""
    return F.when(F.instr(path, "/") > 0, F.split(path, "/")[0])


def paper_code(path: Column, codes: list[str]) -> Column:
    """The first of the codes (given in their order) that stands in the file's name, in capitals."""
    return F.coalesce(*[F.when(F.contains(_stem(path), F.lit(c.lower())), c.upper()) for c in codes], F.lit(None).cast("string"))


def title_of(kind: Column, code: Column, unit: Column, year: Column, series: Column) -> Column:
    """A title such as `Question paper — ABC12 Unit 3 2023 winter`; parts that are missing are left out."""
    label = F.coalesce(F.element_at(_lookup(TYPE_LABELS), kind), kind, F.lit("Document"))
    tail = F.concat_ws(" ", code, F.concat(F.lit("Unit "), unit.cast("string")), year.cast("string"), series)
    return F.trim(F.concat(label, F.lit(" — "), tail))
