"""What a path tells: its language, whether it is a test, and its form relative to a working directory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension and by whole file name, directories and file names of tests.
LANGUAGES = {
    "py": "Python", "pyi": "Python", "ipynb": "Jupyter Notebook", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript",
    "mjs": "JavaScript", "cjs": "JavaScript", "rs": "Rust", "go": "Go", "java": "Java", "kt": "Kotlin", "rb": "Ruby", "php": "PHP", "c": "C",
    "h": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "cs": "C#", "swift": "Swift", "scala": "Scala", "sh": "Shell", "bash": "Shell",
    "zsh": "Shell", "ps1": "PowerShell", "sql": "SQL", "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "CSS", "sass": "CSS", "vue": "Vue",
    "svelte": "Svelte", "md": "Markdown", "markdown": "Markdown", "rst": "reStructuredText", "json": "JSON", "yml": "YAML", "yaml": "YAML",
    "toml": "TOML", "ini": "INI", "cfg": "INI", "xml": "XML", "txt": "Text", "csv": "CSV", "tf": "Terraform", "lua": "Lua", "r": "R", "dart": "Dart",
    "ex": "Elixir", "exs": "Elixir",
}
NAMES = {"dockerfile": "Dockerfile", "makefile": "Makefile"}
TEST_DIRECTORIES = ("test", "tests", "__tests__", "spec", "specs", "testing")
TEST_NAME = r"^(test[_-].+|.+[_-]test\.[a-z0-9]+|.+\.(test|spec)\.[a-z0-9]+|.+[_-]spec\.[a-z0-9]+|.+tests?\.(java|kt|cs|scala))$"
OTHER = "other"


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "([^/]*)/*$", 1)


def language_of(path: Column) -> Column:
    """The language of a path's name or extension; else the bare extension, and other without any."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    special = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    name = F.lower(base_name(path))
    extension = F.nullif(F.regexp_extract(name, r"^.+\.([^.]+)$", 1), F.lit(""))
    return F.coalesce(F.element_at(special, name), F.element_at(known, F.coalesce(extension, F.lit("?"))), extension, F.lit(OTHER))


def kind_of(path: Column) -> Column:
    """test for files in test directories or with a test's name, else code."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    directories = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    test = F.arrays_overlap(directories, F.array(*map(F.lit, TEST_DIRECTORIES))) | F.lower(base_name(path)).rlike(TEST_NAME)
    return F.when(test, "test").otherwise("code")


def relative(path: Column, directory: Column) -> Column:
    """``path`` below ``directory``, whole components only; the bare file name if it lies elsewhere."""
    path, directory = (F.replace(c, F.lit("\\"), F.lit("/")) for c in (path, directory))
    root = F.concat(F.regexp_replace(directory, "/+$", ""), F.lit("/"))
    inside = (F.length(directory) > 0) & F.startswith(path, root)
    return F.when(inside, F.substr(path, F.length(root) + 1)).otherwise(base_name(path))


def project_name(directory: Column) -> Column:
    """The last component of a working directory; backslashes separate only where there are any."""
    return base_name(directory)
