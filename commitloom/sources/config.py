"""Configuration of projects."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import constants as K


@dataclass(frozen=True)
class Project:
    """Where a project's sources lie and which of its files are analysed."""

    name: str
    repository: str | None = None
    corpus: str | None = None
    include_suffixes: tuple[str, ...] = tuple(K.INCLUDE_SUFFIXES)
    exclude_prefixes: tuple[str, ...] = tuple(K.EXCLUDE_PREFIXES)
    tracker: str | None = None
    reviews: str | None = None
    toolchain: tuple[str, ...] = ("git",)


@dataclass
class Registry:
    """Known projects by name."""

    projects: dict[str, Project] = field(default_factory=dict)

    def add(self, project: Project) -> Project:
        self.projects[project.name] = project
        return project

    def get(self, name: str) -> Project:
        """The project of a name; an unknown one is an error."""
        if name not in self.projects:
            raise KeyError(f"unknown project: {name}")
        return self.projects[name]

    def table_path(self, name: str, table: str) -> str:
        """Where a table of a project is kept."""
        return f"{(self.get(name).corpus or 'corpus').rstrip('/')}/{name}/{table}"
